"""Column expressions for tokens, stems, routes, paths, shapes and estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a query drops.
STOP_WORDS = (
    "a an and anybody anyone anything are as at be by can could does everybody everyone everything for from here how i in inside is it nobody nothing of on or "
    "shall should show shows someone something that the there these this those to what when where which who whom why will with would"
).split()
#: Words that a query term also looks for.
EXPANSIONS = {
    "avoid": ("guard", "skip", "block", "prevent"),
    "duplicate": ("double", "repeat", "repeated", "once", "idempotent"),
    "prevent": ("guard", "skip", "block", "avoid"),
    "repeat": ("duplicate", "repeated", "again"),
    "repeated": ("duplicate", "repeat", "again"),
    "running": ("run", "active", "started"),
    "validate": ("validation", "validator", "valid"),
    "validation": ("validate", "validator", "valid"),
}
#: BM25's constants, and the scale and bounds of a term's weight.
K1, B = 1.2, 0.75
WEIGHT_SCALE, MOST_WEIGHT = 90.0, 420


def tokens(text: Column) -> Column:
    """Lower-case ASCII tokens; camel case and borders of digits part them."""
    parted = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    parted = F.regexp_replace(parted, "([A-Za-z])([0-9])", "$1 $2")
    parted = F.regexp_replace(parted, "([0-9])([A-Za-z])", "$1 $2")
    return F.regexp_extract_all(F.lower(parted), F.lit("[a-z0-9]+"), F.lit(0))


def stem(token: Column) -> Column:
    """``ies`` to ``y`` in more than four letters, else a single final ``s`` dropped in more than three."""
    n = F.length(token)
    return (
        F.when((n > 4) & token.endswith("ies"), F.concat(F.substr(token, F.lit(1), n - 3), F.lit("y")))
        .when((n > 3) & token.endswith("s") & ~token.endswith("ss"), F.substr(token, F.lit(1), n - 1))
        .otherwise(token)
    )


def with_stems(found: Column) -> Column:
    """Sorted distinct tokens of an array and their stems; name a column here, as it is read twice."""
    return F.array_sort(F.array_distinct(F.concat(found, F.transform(found, stem))))


def token_set(text: Column) -> Column:
    """Sorted distinct tokens and their stems."""
    return with_stems(tokens(text))


def term_weight(files: Column, df: Column) -> Column:
    """The weight of a term by the files that hold it, a whole number from 0 to MOST_WEIGHT."""
    raw = F.floor(F.log((files + 1).cast("double") / (df + 1).cast("double")) * WEIGHT_SCALE)
    return F.least(F.greatest(raw, F.lit(0)), F.lit(MOST_WEIGHT)).cast("int")


def length_norm(count: Column, average: Column) -> Column:
    """BM25's norm of a file's length; 1 where there is no length."""
    norm = F.lit(K1 + 1) / (F.lit(K1) * (F.lit(1 - B) + F.lit(B) * (count.cast("double") / average)) + F.lit(1.0))
    return F.when((average <= 0) | (count <= 0), F.lit(1.0)).otherwise(norm)


def route_path(url: Column) -> Column:
    """The path of a URL or route: no scheme, host, query or fragment; parameters as ``:``; no trailing slash."""
    path = F.regexp_replace(F.trim(url), "^https?://[^/]*(/|$)", "$1")
    path = F.regexp_replace(path, "[?#].*$", "")
    path = F.regexp_replace(path, r"\$\{[^}]*\}", ":")
    path = F.regexp_replace(path, ":[A-Za-z_][A-Za-z0-9_]*", ":")
    path = F.replace(path, F.lit("//"), F.lit("/"))
    return F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def suffix_match(call: Column, route: Column) -> Column:
    """Whether the route's segments (two at least) end the call's, parameters matching anything and one segment matching itself."""
    extra = F.size(call) - F.size(route)
    tail = F.slice(call, F.greatest(extra, F.lit(0)) + 1, F.greatest(F.size(route), F.lit(1)))
    pairs = F.arrays_zip(tail.alias("c"), route.alias("r"))
    free = lambda p: (p["c"] == ":") | (p["r"] == ":")
    fits = F.forall(pairs, lambda p: free(p) | (p["c"] == p["r"])) & F.exists(pairs, lambda p: ~free(p) & (p["c"] == p["r"]))
    return (F.size(route) >= 2) & (extra >= 0) & fits


def directory(path: Column) -> Column:
    """All before the last slash; ``.`` without one."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def is_test_path(path: Column) -> Column:
    """Whether a path looks like a test: by folder or by file name."""
    low = F.lower(path)
    return low.rlike(r"(^|/)(tests?|__tests__|spec|specs|e2e|testdata)/") | low.rlike(r"(^|/)test_[^/]*\.py$") | low.rlike(r"[._-](test|spec|tests)\.[a-z]+$") | low.rlike(r"_test\.[a-z]+$")


#: Languages that call each other's symbols; any other language is a family of its own.
FAMILIES = {"javascript": "js", "typescript": "js", "vue": "js"}


def language_family(language: Column) -> Column:
    out = language
    for lang, group in FAMILIES.items():
        out = F.when(language == lang, group).otherwise(out)
    return out


def declaration(line: Column) -> Column:
    """A line without the white space that only formats: one space stays between two characters of words."""
    word = r"[\p{L}\p{Nd}_$]"
    bare = F.regexp_replace(line, rf"(?<![\s\p{{L}}\p{{Nd}}_$])\s++|\s++(?!{word})|^\s+|\s+$", "")
    return F.regexp_replace(bare, r"\s+", " ")


def term_mask(held: Column, terms: list[str]) -> Column:
    """Which of the first 64 terms the array ``held`` has, as bits."""
    out = F.lit(0).cast("bigint")
    for i, t in enumerate(terms[:64]):
        out = out.bitwiseOR(F.when(F.array_contains(held, t), F.shiftleft(F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    return out


def age_hours(indexed_at: Column, now: Column) -> Column:
    """Hours between two instants written as RFC 3339 text or given as such; null where either is none."""
    return (F.unix_micros(F.try_to_timestamp(now.cast("string"))) - F.unix_micros(F.try_to_timestamp(indexed_at.cast("string")))) / F.lit(3.6e9)


def unresolved_name(target: Column) -> Column:
    """The simple name of an unresolved target: what stands after the last ``#``, ``->``, ``::`` or ``.``."""
    plain = F.regexp_replace(target, "^unresolved:", "")
    return F.element_at(F.split(plain, r"#|->|::|\."), -1)


#: Words that the shape of a line keeps as they are.
KEYWORDS = (
    "async await break case catch class const continue def default delete do elif else enum except export extends finally fn for from func function if import in "
    "interface let match new not null or return static struct super switch this throw try type var while yield"
).split()


def shape(line: Column) -> Column:
    """A line without white space, identifiers as ``I`` (keywords stay) and numbers as ``N``."""
    kept = "|".join(KEYWORDS)
    out = F.regexp_replace(line, rf"\b(?!(?:{kept})\b)[A-Za-z_$][A-Za-z0-9_$]*", "I")
    out = F.regexp_replace(out, r"\b[0-9][0-9A-Za-z_.]*", "N")
    return F.regexp_replace(out, r"\s+", "")


def branches(line: Column) -> Column:
    """How many branches a masked line opens."""
    return F.regexp_count(line, F.lit(r"\b(?:if|elif|else if|for|while|case|catch|except)\b|&&|\|\||\?\?"))


def structured_estimate(text: Column) -> Column:
    """The estimate for JSON text: a fifth more than for plain text, rounded up."""
    return F.ceil(F.ceil(F.length(text) / 4) * F.lit(1.2)).cast("int")


def token_estimate(text: Column) -> Column:
    """A model's tokens by length: a quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("int")


def one_decimal(x: Column) -> Column:
    """Rounded half up to one decimal, in doubles."""
    return F.floor(x.cast("double") * F.lit(10.0) + F.lit(0.5)) / F.lit(10.0)

"""Quality rules as a short-circuit cascade, in native columns only.

Each rule rejects a text on its own.  Its cost (the time its columns and its test
take) and its selectivity (the share it rejects) are measured on a bounded sample;
rules then run in the order of rejections per cost.  What only a later rule needs is
not made for a text that an earlier one rejects: where only the good documents are
asked for, the rules are a chain of filters; in the report, which gives the base
counts of every text, the columns of the further rules are made under the condition
that no rule before rejected.  The order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.runtime import Scratch, spread

#: Rows, about, of the sample that costs and selectivities are measured on.
SAMPLE_ROWS = 1_000
WINDOW = 5
SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\x0b\x0c\r"

def _words(text: Column) -> Column:
    whole = F.btrim(text, F.lit(_SPACE))
    return F.when(whole == "", F.array().cast("array<string>")).otherwise(F.split(whole, "[ \\x09-\\x0D]+"))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != "")


def _symbols(text: Column) -> Column:
    size, count = F.octet_length(text), F.lit(0)
    for c in SYMBOLS:
        count = count + size - F.octet_length(F.replace(text, F.lit(c), F.lit("")))
    return count.cast("bigint")


def _shifted(array: Column, by: int, size: Column) -> Column:
    return F.slice(array, F.lit(by + 1), F.greatest(size, F.lit(0)))


def _windows(hashes: str) -> Column:
    """A hash for each window of WINDOW words: of two words, of two such pairs, and of those with the fifth.

    Lambdas see their own arguments only: an array of the row inside one could be made anew for each element.
    """
    h = F.col(hashes)
    n = F.size(h)
    two = F.zip_with(_shifted(h, 0, n - 1), _shifted(h, 1, n - 1), lambda x, y: F.xxhash64(x, y))
    four = F.zip_with(_shifted(two, 0, n - 3), _shifted(two, 2, n - 3), lambda x, y: F.xxhash64(x, y))
    five = F.zip_with(_shifted(four, 0, n - 4), _shifted(h, 4, n - 4), lambda x, y: F.xxhash64(x, y))
    return F.when(n >= WINDOW, five).otherwise(F.array().cast("array<bigint>"))


def _covered(order: str) -> Column:
    """Words in windows found twice or more; ``order`` has the windows as (hash, place), sorted."""
    o = F.col(order)
    less = F.size(o) - 1
    twice = F.zip_with(_shifted(o, 0, less), _shifted(o, 1, less), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])))
    places = F.array_sort(F.array_distinct(F.flatten(F.filter(twice, lambda x: x.isNotNull()))))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("total"))
    return F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(WINDOW), p - a["last"])).alias("total")), lambda a: a["total"])


#: A word's letterless start and its first letter; the search starts at words only.
_LETTER_WORD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]*+\p{L}"
_BULLET = r"^[\x20\x09-\x0D]*[-*•‣◦·]"
_ELLIPSIS = r"(?:\.\.\.|…)[\x20\x09-\x0D]*\z"
_BAD = r"[\x00-\x08\x0E-\x1F\x7F\uFFFD]"

#: Derived columns in the order they can be made, each from the text or an earlier one.
DERIVED = {
    "_text": lambda t: F.coalesce(F.col(t), F.lit("")),
    "_words": lambda t: _words(F.col("_text")),
    "n_words": lambda t: F.size("_words").cast("bigint"),
    "word_chars": lambda t: F.length(F.array_join("_words", "")).cast("bigint"),
    "n_symbols": lambda t: _symbols(F.col("_text")),
    "_lines": lambda t: _lines(F.col("_text")),
    "n_lines": lambda t: F.size("_lines").cast("bigint"),
    "n_dup_lines": lambda t: (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
    "_hashes": lambda t: F.transform("_words", lambda w: F.xxhash64(w)),
    "_windows": lambda t: _windows("_hashes"),
    "_order": lambda t: F.when(
        F.size(F.array_distinct("_windows")) < F.size("_windows"), F.array_sort(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    ),
    "n_letter_words": lambda t: F.regexp_count("_text", F.lit(_LETTER_WORD)).cast("bigint"),
    "n_bullet_lines": lambda t: F.size(F.filter("_lines", lambda x: x.rlike(_BULLET))).cast("bigint"),
    "n_ellipsis_lines": lambda t: F.size(F.filter("_lines", lambda x: x.rlike(_ELLIPSIS))).cast("bigint"),
    "n_bad_chars": lambda t: F.regexp_count("_text", F.lit(_BAD)).cast("bigint"),
    "n_repeat_words": lambda t: F.when(F.col("_order").isNull(), F.lit(0).cast("bigint")).otherwise(_covered("_order")),
}
_NEEDS = {
    "_words": ["_text"], "n_words": ["_words"], "word_chars": ["_words"], "n_symbols": ["_text"], "_lines": ["_text"], "n_lines": ["_lines"], "n_dup_lines": ["_lines"],
    "_hashes": ["_words"], "_windows": ["_hashes"], "_order": ["_windows"], "n_repeat_words": ["_order"], "_text": [],
    "n_letter_words": ["_text"], "n_bullet_lines": ["_lines"], "n_ellipsis_lines": ["_lines"], "n_bad_chars": ["_text"],
}


@dataclass(frozen=True)
class Rule:
    """``rejects`` is SQL over the derived columns in ``needs``."""

    name: str
    rejects: str
    needs: tuple[str, ...]


RULES = (
    Rule("few_words", "n_words < 10", ("n_words",)),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words", ("n_repeat_words", "n_words")),
    Rule("symbols", "10 * n_symbols > n_words", ("n_symbols", "n_words")),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words", ("word_chars", "n_words")),
    Rule("repeated_lines", "100 * n_dup_lines > 30 * n_lines", ("n_dup_lines", "n_lines")),
    Rule("letters", "10 * n_letter_words < 6 * n_words", ("n_letter_words", "n_words")),
    Rule("bullets", "n_lines >= 5 and 100 * n_bullet_lines > 90 * n_lines", ("n_bullet_lines", "n_lines")),
    Rule("ellipses", "n_lines >= 5 and 100 * n_ellipsis_lines > 30 * n_lines", ("n_ellipsis_lines", "n_lines")),
    Rule("bad_characters", "50 * n_bad_chars > word_chars", ("n_bad_chars", "word_chars")),
)
BASE = ("few_words", "repeated_windows")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _closure(names: list[str]) -> list[str]:
    wanted: set[str] = set()
    todo = list(names)
    while todo:
        x = todo.pop()
        if x not in wanted:
            wanted.add(x)
            todo += _NEEDS[x]
    return [x for x in DERIVED if x in wanted]


def derive(docs: DataFrame, text_col: str, names: list[str], have: set[str], alive: Column | None = None) -> DataFrame:
    """``docs`` with the derived columns that are not in ``have`` yet, one projection for each step; null where not ``alive``."""
    for x in _closure(names):
        if x not in have:
            made = DERIVED[x](text_col)
            docs = docs.withColumn(x, made if alive is None else F.when(alive, made))
            have.add(x)
    return docs


def measured_rules(docs: DataFrame, text_col: str, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share it rejects) on a sample of at most ``rows`` rows, by falling rejections per second.

    Each rule runs twice over the written sample, the second time counted, less the time of a rule that asks nothing.
    """
    sample = docs.select(F.col(f"`{text_col}`").alias("_t")).sample(min(1.0, rows / max(1, docs.count())), 7).limit(rows)
    scratch = Scratch(docs.sparkSession, "quality")
    sample = scratch.put("sample", sample)

    def run(rejects: str, needs: list[str]) -> tuple[float, float]:
        asked = derive(sample, "_t", needs, set()).agg(F.avg(F.expr(f"cast({rejects} as double)")).alias("share"))
        for _ in range(2):
            began = time.perf_counter()
            share = asked.first()["share"]
            took = time.perf_counter() - began
        return took, share or 0.0

    idle = run("_t is null", [])[0]
    found = []
    for rule in rules:
        took, share = run(rule.rejects, list(rule.needs))
        found.append((rule, max(took - idle, 1e-3), share))
    scratch.drop("sample")
    return sorted(found, key=lambda x: (-(x[2] + 1e-6) / x[1], x[0].name))


def ordered_rules(docs: DataFrame, text_col: str, rules: tuple[Rule, ...] = RULES) -> list[Rule]:
    return [rule for rule, _, _ in measured_rules(docs, text_col, rules)]


def good_documents(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, order: list[Rule] | None = None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with the columns of ``docs``.

    A null text counts as empty and is rejected as too short, as are texts of
    white space.  Repeated rows are judged alike; a null id changes nothing; an
    empty table stays empty.  Columns of ``docs`` may have any name: the derived
    ones are kept apart in a struct of the row.
    """
    names = docs.columns
    kept, have = spread(docs).select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(f"`{text_col}`").alias("_t")), set()
    for k, rule in enumerate(ordered_rules(docs, text_col, rules) if order is None else order):
        # A filter does not move below a column that is not deterministic: what a rule needs is made once, and only for texts that are left.
        wall = f"_wall{k}"
        kept = derive(kept, "_t", list(rule.needs), have).withColumn(wall, F.monotonically_increasing_id()).filter(~F.expr(rule.rejects) & (F.col(wall) >= 0))
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in names])


def cascade(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rules: tuple[Rule, ...] = RULES, order: list[Rule] | None = None) -> DataFrame:
    """(doc_id, the base counts, base_failed, rejected_by, and the further derived counts) for every row.

    ``rejected_by`` is the first rule of the order that rejects, null for a good text.  The counts that only further
    rules need are null where a rule before rejected: they were not made.  Nulls and empty texts as in ``good_documents``.
    """
    order = ordered_rules(docs, text_col, rules) if order is None else order
    have: set[str] = set()
    rows = spread(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("_t")))
    rows = derive(rows, "_t", [*COUNTS, "n_lines"], have).withColumn("rejected_by", F.lit(None).cast("string"))
    alive = F.col("rejected_by").isNull()
    for rule in order:
        rows = derive(rows, "_t", list(rule.needs), have, alive)
        rows = rows.withColumn("rejected_by", F.when(alive & F.expr(rule.rejects), F.lit(rule.name)).otherwise(F.col("rejected_by")))
    base = F.expr(" or ".join(f"({r.rejects})" for r in rules if r.name in BASE))
    further = [x for x in DERIVED if x in have and x[0] != "_" and x not in COUNTS and x != "n_lines"]
    return rows.select("doc_id", *COUNTS, base.alias("base_failed"), "rejected_by", *further)


def quality_report(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, the counts, base_failed, kept) for every row; nulls and empty texts as in ``good_documents``."""
    rows = cascade(docs, text_col, id_col, rules)
    return rows.select("doc_id", *COUNTS, "base_failed", F.col("rejected_by").isNull().alias("kept"))


REPORT_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
win as (select doc_id, i, array_to_string(w[i:i + 4], ' ') as k
        from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 5)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, k) as n from win) where n > 1),
cov as (select doc_id, count(distinct i + j) as n from rep, range(0, 5) as r(j) group by doc_id),
c as (select w.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
             (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words, len(l) as n_lines,
             len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) as n_letter_words, len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣◦·]'))) as n_bullet_lines,
             len(list_filter(l, lambda x: regexp_matches(x, '(?:\.\.\.|…)[\x20\x09-\x0D]*\z'))) as n_ellipsis_lines,
             len(regexp_extract_all(t, '[\x00-\x08\x0E-\x1F\x7F\x{FFFD}]')) as n_bad_chars
      from w left join cov on w.doc_id = cov.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words or 10 * n_symbols > n_words
            or word_chars < 2 * n_words or word_chars > 20 * n_words or 100 * n_dup_lines > 30 * n_lines
            or 10 * n_letter_words < 6 * n_words or (n_lines >= 5 and 100 * n_bullet_lines > 90 * n_lines) or (n_lines >= 5 and 100 * n_ellipsis_lines > 30 * n_lines)
            or 50 * n_bad_chars > word_chars) as kept
from c
"""

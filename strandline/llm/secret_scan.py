"""Secret scans over a trigram inverted index.

From each rule's pattern a Boolean query over mandatory trigrams is derived.
Texts are indexed in blocks: the trigrams that any query asks for get postings
(the block's texts that hold them); a rule's candidates come from intersecting
and uniting postings, and only they are matched.  A rule without mandatory
trigrams scans every text.  A block is a bounded slice of a partition, so there
is no shuffle and no state beyond the block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.text import _LOWER, pieces, utf8
from strandline.runtime import spread

try:  # the parser of Python's own patterns
    from re import _constants as C
    from re import _parser as parser
except ImportError:  # older interpreters
    import sre_constants as C  # type: ignore[no-redef]
    import sre_parse as parser  # type: ignore[no-redef]


@dataclass(frozen=True)
class SecretRule:
    """``least`` characters are asked of group ``group``; shorter matches are dropped but consumed.

    ``body`` is matched behind ``pattern`` and belongs to the span; it may be empty.  ``body_sql`` is the same without looking
    ahead, for SQL: what it takes in group 1 is behind the span.
    """

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    folded: bool = False
    body: str = ""
    body_sql: str = ""

    def compiled(self) -> re.Pattern[str]:
        pattern = self.pattern
        if self.group == 0 and not self.body and re.fullmatch(r"\[[^\[\]\\^]+\]\+", pattern):  # a run of one class: no shorter run can pass
            pattern = f"{pattern[:-1]}{{{self.least},}}"
        return re.compile(pattern + self.body, re.ASCII | (re.IGNORECASE if self.folded else 0))


#: The three base kinds come first; spans at one start are listed in this order.
BASE_RULES = (
    SecretRule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    SecretRule("access", r"AKIA[A-Z0-9]+", 20),
    SecretRule("hex", r"[0-9a-f]+", 24),
)
#: Behind a PEM header: anything up to the END line, or, if another marker or the text's end comes first, the header fields and
#: base64 lines (16 characters or more, a last one of whole groups of four), broken by white space, quoting or written \\n.
_GAP = r"""(?:[\x20\x09-\x0D>\#*"',]|\\[nrt])*"""


def _pem_body(to_marker: str, line_end: str) -> str:
    return (
        rf"(?:{to_marker}-----END (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"
        rf"|(?:{_GAP}(?:Proc-Type|DEK-Info):[^\r\n\\]*)*(?:{_GAP}[A-Za-z0-9+/]{{16,}}={{0,2}})+"
        rf"(?:{_GAP}(?:[A-Za-z0-9+/]{{4}})*(?:[A-Za-z0-9+/]{{4}}|[A-Za-z0-9+/]{{3}}=|[A-Za-z0-9+/]{{2}}==){line_end})?)?"
    )


_PEM_BODY = _pem_body(r"[^-]*(?:-(?!----)[^-]*)*", r"(?=[\r\n\\\"']|\Z)")
_PEM_BODY_SQL = _pem_body(r"(?:[^-]|-{1,4}[^-])*", r"([\r\n\\\"']|\z)")
RULES = BASE_RULES + (
    SecretRule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----", body=_PEM_BODY, body_sql=_PEM_BODY_SQL),
    SecretRule("github", r"gh[opsru]_[A-Za-z0-9]+", 40),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    SecretRule("google", r"AIza[A-Za-z0-9_-]+", 39),
    SecretRule("stripe", r"[rs]k_live_[A-Za-z0-9]+", 24),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    SecretRule("url_login", r"""://[^\x20\x09-\x0D:/@"']+:[^\x20\x09-\x0D:/@"']+@""", 7),
)

#: A query: True (every text), a trigram's code, or ("and" | "or", parts).
Query = bool | int | tuple
_MOST_STRINGS = 64


def trigram_code(s: str) -> int:
    a, b, c = s.encode("latin-1")
    return a << 16 | b << 8 | c


def _join(kind: str, parts: list[Query]) -> Query:
    idle = kind == "and"
    if kind == "or" and any(p is True for p in parts):
        return True
    flat = [p for p in dict.fromkeys(parts) if not (idle and p is True)]
    if not flat:
        return True
    return flat[0] if len(flat) == 1 else (kind, tuple(flat))


def _of_strings(found: set[str]) -> Query:
    """One of these strings occurs."""
    parts = []
    for s in sorted(found):
        if len(s) < 3 or not s.isascii():
            return True
        parts.append(_join("and", [trigram_code(s[i : i + 3]) for i in range(len(s) - 2)]))
    return _join("or", parts)


def _class_members(items: list) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(chr(arg).lower())
        elif op is C.RANGE and arg[1] - arg[0] < 8:
            out |= {chr(x).lower() for x in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _walk(tree) -> tuple[set[str] | None, Query]:
    """(all strings the pattern can match, lowered, if few; the query of what must occur)."""
    exact: set[str] = {""}
    whole, asked = True, []

    def cut() -> None:
        nonlocal exact, whole
        asked.append(_of_strings(exact))
        exact, whole = {""}, False

    for op, arg in tree:
        one: set[str] | None = None
        query: Query = True
        if op is C.LITERAL:
            one = {chr(arg).lower()}
        elif op is C.IN:
            one = _class_members(arg)
        elif op is C.SUBPATTERN:
            one, query = _walk(arg[3])
        elif op is C.BRANCH:
            ways = [_walk(x) for x in arg[1]]
            one = set().union(*(w[0] for w in ways)) if all(w[0] is not None for w in ways) else None
            query = _join("or", [_of_strings(w[0]) if w[0] is not None else w[1] for w in ways])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = arg
            strings, query = _walk(inner)
            if strings is not None and low == 0 and high == 1:
                one, query = strings | {""}, True
            elif strings is not None and low == high == 1:
                one = strings
            elif low == 0:
                query = True
            elif strings is not None:
                grown = {a + b for a in exact for b in strings}
                if len(grown) <= _MOST_STRINGS:
                    exact = grown
        if one is not None and len(one) * len(exact) <= _MOST_STRINGS:
            exact = {a + b for a in exact for b in one}
        else:
            cut()
            asked.append(query if one is None else _of_strings(one))
    if whole:
        return exact, _of_strings(exact)
    asked.append(_of_strings(exact))
    return None, _join("and", asked)


def trigram_query(pattern: str) -> Query:
    """The Boolean query over lowered trigrams that every text with a match meets."""
    return _walk(parser.parse(pattern, re.ASCII))[1]


def _codes(query: Query) -> set[int]:
    if query is True:
        return set()
    return {query} if isinstance(query, int) else set().union(*(_codes(p) for p in query[1]))


def candidates(query: Query, postings: dict[int, np.ndarray], n: int) -> np.ndarray:
    """The places of the block's texts that meet ``query``, ascending."""
    if query is True:
        return np.arange(n)
    if not isinstance(query, tuple):
        return postings.get(query, np.zeros(0, np.int64))
    parts = sorted((candidates(p, postings, n) for p in query[1]), key=len)
    out = parts[0]
    for p in parts[1:]:
        out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
    return out


@lru_cache(maxsize=4)
def _plan(rules: tuple[SecretRule, ...]):
    queries = [trigram_query(r.pattern) for r in rules]
    codes = np.array(sorted(set().union(*map(_codes, queries))), np.int64)
    slot = np.zeros(1 << 24, np.uint16)
    slot[codes] = np.arange(1, len(codes) + 1)
    return [(r, r.compiled(), q) for r, q in zip(rules, queries, strict=True)], codes, slot


def block_postings(buf: np.ndarray, offsets: np.ndarray, codes: np.ndarray, slot: np.ndarray) -> dict[int, np.ndarray]:
    """Trigram -> ascending places of the texts that hold it; trigrams never span two texts."""
    if len(buf) < 3 or not len(codes):
        return {}
    low = _LOWER[buf].astype(np.int32)
    hit = slot[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
    at = np.flatnonzero(hit)
    text = np.searchsorted(offsets, at, side="right") - 1
    inside = at + 3 <= offsets[text + 1]
    pairs = np.unique(hit[at[inside]].astype(np.int64) << 32 | text[inside])
    grams, places = pairs >> 32, pairs & 0xFFFFFFFF
    cut = np.flatnonzero(np.diff(grams)) + 1
    return {int(codes[g[0] - 1]): p for g, p in zip(np.split(grams, cut), np.split(places, cut), strict=True) if len(g)}


def block_spans(column: pa.Array, rules: tuple[SecretRule, ...] = RULES) -> dict[int, list[tuple[int, int, str]]]:
    """Place in the block -> its spans (start, end, kind), by start and then by the rules' order."""
    plan, codes, slot = _plan(rules)
    buf, offsets = utf8(column)
    postings = block_postings(buf, offsets, codes, slot)
    out: dict[int, list] = {}
    for k, (rule, pattern, query) in enumerate(plan):
        for place in candidates(query, postings, len(column)).tolist():
            text = column[place].as_py() or ""
            found = [m.span() for m in pattern.finditer(text) if len(m.group(rule.group)) >= rule.least]
            if found:
                out.setdefault(place, []).extend((a, b, k) for a, b in found)
    return {p: [(a, b, rules[k].kind) for a, b, k in sorted(v, key=lambda x: (x[0], x[2]))] for p, v in out.items()}


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find_secrets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """(doc_id, spans) for every row: spans of kind, start and end (code points, end exclusive).

    Null and empty texts have no spans; a null id is passed on; repeated rows get
    equal spans; an empty table gives an empty result.  Only the two named columns are read.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            spans = block_spans(b.column(1), rules)
            rows = [[{"kind": c, "start": x, "end": y} for x, y, c in spans.get(i, ())] for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("spans", SPANS)])
    return spread(docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))).mapInArrow(run, schema)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each span, or run of overlapping spans, replaced by ``<secret:kind>`` of the first."""
    merged: list[list] = []
    for start, end, kind in spans:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, kind])
    out, at = [], 0
    for start, end, kind in merged:
        out += [text[at:start], f"<secret:{kind}>"]
        at = end
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, text_col: str = "text", rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """``docs`` with its columns as they are and the secrets in ``text_col`` replaced; null stays null."""
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, inner[at]):
            spans = block_spans(b.column(at), rules)
            if spans:
                texts = b.column(at).to_pylist()
                for i, found in spans.items():
                    texts[i] = redacted(texts[i], found)
                b = b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
            yield b

    plain = docs.toDF(*inner)
    return plain.mapInArrow(run, plain.schema).toDF(*names)


def _kind_sql(rule: SecretRule, k: int) -> str:
    """Matches in order, and what lies between them; a match starts after all that comes before it."""
    pattern = ("(?i)" if rule.folded else "") + (rule.pattern + rule.body_sql).replace("'", "''")
    beyond = f"length(regexp_extract(x, '{pattern}', 1))" if rule.body_sql else "0"
    tested = f"length(regexp_extract(x, '{pattern}', {rule.group}))" if rule.group else "length(x)"
    return f"""
select doc_id, '{rule.kind}' as kind, {k} as k, s, s + length(x) - {beyond} as e from (
  select doc_id, m[i] as x, list_sum([0] || list_transform(p[1:i], lambda y: length(y))) + list_sum([0] || list_transform(m[1:i - 1], lambda y: length(y))) as s
  from (select *, unnest(range(1, len(m) + 1)) as i from (select doc_id, regexp_extract_all(t, '{pattern}') as m, regexp_split_to_array(t, '{pattern}') as p from d)))
where {tested} >= {rule.least}"""


def scan_sql(rules: tuple[SecretRule, ...] = RULES) -> str:
    """DuckDB SQL for the query over ``documents``."""
    parts = " union all ".join(_kind_sql(r, k) for k, r in enumerate(rules))
    n = len(BASE_RULES)
    joined = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, k){f}, '')"
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
f as (select doc_id, kind, k, s::bigint as s, e::bigint as e from ({parts})),
g as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
             {joined.format(f=f" filter (k < {n})")} as base, {joined.format(f="")} as spans from f group by doc_id)
select d.doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g on d.doc_id = g.doc_id
"""

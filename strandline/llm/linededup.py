"""Line dedup with a log-template tree.

Lines of five words or more, and runs of shorter lines that have as many together
(a list, an address, a verse; a line without words ends a run), are parsed by a tree
of fixed depth: first the number of words, then the leading words, where words that hold a digit are variable
fields.  Lines in one leaf that agree in four of five words or more are one
template, with the words that differ as further fields; leaders are taken in the
order of their documents, most first.  A template that occurs in two documents
or more is boilerplate: its lines stay in the document with the smallest id and
are dropped from all others.  A run is treated as the one line that its words would
be, and all its lines go or stay.

A line is named by a 64-bit digest of its words within its leaf (of another 64 bits), and its words by
32 bits each: two lines of one leaf with different words at a place agree there with probability 2^-32.

Equal lines are counted before anything is dealt by leaf, so a line in a third of
all documents is one row there.  A leaf of few lines is settled by one task.  A
crowded one is peeled in rounds: its first lines, a slice of bounded size, settle
their leaders; all its other lines, dealt over groups of bounded size, follow the
first leader they agree with; what follows none is left for the next round.  Leaders
are taken in the same order either way, so the result does not depend on the bounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.text import hash_spans, mix, pieces, utf8, word_bounds
from strandline.runtime import Scratch, spread


@dataclass(frozen=True)
class TemplateSettings:
    """Shortest line in words, depth of the tree in leading words, percent of equal words, documents that make a template recur."""

    words: int = 5
    depth: int = 3
    percent: int = 80
    documents: int = 2
    #: Distinct lines in a leaf before it is peeled in rounds; the result does not depend on it.
    leaf_lines: int = 1_000


#: Slices of a crowded leaf double each round, from ``leaf_lines`` to this many times as much.
WIDEST_SLICE = 16
#: Lines of a group that follows the leaders of a slice, in slices.
GROUP_SLICES = 8
#: A leaf's row stands this many times in a join by leaf, so that its lines are dealt over as many tasks.
SPREAD = 64

FIELD = np.uint64(0x2A2A_2A2A_2A2A_2A2A)
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_FACTOR = np.uint64(0xD6E8_FEB8_6659_FD93)


def parse_lines(buf: np.ndarray, offsets: np.ndarray, s: TemplateSettings) -> dict[str, np.ndarray]:
    """The lines, and runs of short lines, of all texts that are long enough: text, line (the first), span (lines), line_id, leaf, and their words' marks."""
    breaks = np.flatnonzero(buf == 10)
    starts, ends, _ = word_bounds(buf, offsets)
    # Lines begin at a text's start and after each break; a word belongs to the last line that begins at or before it.
    begins = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
    text_of = np.searchsorted(offsets, begins, side="right") - 1
    in_line = np.diff(np.searchsorted(starts, np.append(begins, len(buf))))
    # A short line goes on with the run of the short line right before it in its text.
    short = (in_line > 0) & (in_line < s.words)
    on = np.zeros(len(begins), bool)
    on[1:] = short[1:] & short[:-1] & (text_of[1:] == text_of[:-1])
    opens = np.flatnonzero((in_line > 0) & ~on)
    count = np.add.reduceat(in_line, opens) if len(opens) else np.zeros(0, np.int64)
    span = np.add.reduceat((in_line > 0).astype(np.int64), opens) if len(opens) else np.zeros(0, np.int64)
    text_of, firsts = text_of[opens], np.cumsum(count) - count
    long = np.flatnonzero(count >= s.words)
    hashed = hash_spans(buf, starts, ends)
    digits = np.concatenate(([0], np.cumsum(_DIGIT[buf], dtype=np.int64)))
    hashed[digits[ends] > digits[starts]] = FIELD
    inner = np.arange(len(starts)) - np.repeat(firsts, count)
    power = np.full(int(count.max()) if len(count) else 1, _FACTOR)
    power[:1] = 1
    power = np.multiply.accumulate(power)
    total = np.add.reduceat(mix(hashed + np.uint64(1)) * power[inner], firsts) if len(firsts) else np.zeros(0, np.uint64)
    n = count[long].astype(np.uint64)
    leaf = mix(n)
    for k in range(min(s.depth, s.words)):
        leaf = mix(leaf * np.uint64(31) + hashed[firsts[long] + k])
    line_begin = np.searchsorted(begins, offsets[text_of[long]])
    marks = (hashed >> np.uint64(32)).astype("<u4")
    return {
        "text": text_of[long], "line": opens[long] - line_begin, "span": span[long], "line_id": mix(total[long] + n).astype(np.int64), "leaf": leaf.astype(np.int64),
        "first": firsts[long], "count": count[long], "marks": marks,
    }


def line_rows(docs: DataFrame, s: TemplateSettings) -> DataFrame:
    """(doc_id, line, span, line_id, leaf, lead, marks) per long line or run of (doc_id, text); ``lead`` is its first time in its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            buf, offsets = utf8(b.column(1))
            x = parse_lines(buf, offsets, s)
            n = len(x["line"])
            order = np.lexsort((x["line"], x["line_id"], x["text"]))
            lead = np.zeros(n, bool)
            if n:
                t, i = x["text"][order], x["line_id"][order]
                lead[order[np.concatenate(([True], (t[1:] != t[:-1]) | (i[1:] != i[:-1])))]] = True
            # Marks of one line stand together: 32 bits for each word.
            at = np.arange(int(x["count"].sum())) - np.repeat(np.cumsum(x["count"]) - x["count"], x["count"]) + np.repeat(x["first"], x["count"])
            ends = np.concatenate(([0], np.cumsum(x["count"] * 4))).astype(np.int32)
            marks = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(x["marks"][at].tobytes())])
            ids = b.column(0).take(pa.array(x["text"]))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(x["line"].astype(np.int32)), pa.array(x["span"].astype(np.int32)), pa.array(x["line_id"]), pa.array(x["leaf"]), pa.array(lead), marks],
                names=["doc_id", "line", "span", "line_id", "leaf", "lead", "marks"],
            )

    return docs.mapInArrow(run, "doc_id bigint, line int, span int, line_id bigint, leaf bigint, lead boolean, marks binary")


class _Leaders:
    """Leaders of one leaf, found again by equal segments of their marks.

    Lines of a leaf differ past its leading words only.  If the words behind those
    are cut into one segment more than may differ, two lines of one template have a
    segment in common, so a line is compared with the leaders of its segments alone
    and no match is lost.
    """

    def __init__(self, words: int, s: TemplateSettings):
        self.least = words * s.percent
        depth = min(s.depth, s.words)
        parts = words * (100 - s.percent) // 100 + 1
        tail = words - depth
        # Where all words behind the leading ones may differ, the whole leaf is one segment.
        cuts = [4 * (depth + tail * k // parts) for k in range(parts + 1)] if tail >= parts else [0, 0]
        self.segments = [(a, b, {}) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.ids: list[int] = []
        self.marks = np.zeros((16, words), "<u4")

    def find(self, marks: bytes) -> int | None:
        """The first leader that a line agrees with."""
        near = sorted({k for a, b, at in self.segments for k in at.get(marks[a:b], ())})
        if not near:
            return None
        same = (self.marks[near] == np.frombuffer(marks, "<u4")).sum(1) * 100 >= self.least
        return self.ids[near[int(same.argmax())]] if same.any() else None

    def add(self, line_id: int, marks: bytes) -> None:
        n = len(self.ids)
        if n == len(self.marks):
            self.marks = np.concatenate((self.marks, np.zeros_like(self.marks)))
        self.marks[n] = np.frombuffer(marks, "<u4")
        self.ids.append(line_id)
        for a, b, at in self.segments:
            at.setdefault(marks[a:b], []).append(n)


def _settled(ids: list[int], marks: list[bytes], s: TemplateSettings) -> list[int]:
    """The leader of each line of one leaf, itself for a leader; lines come in the order of leaders."""
    if len(ids) > s.leaf_lines:
        leaders, out = _Leaders(len(marks[0]) // 4, s), []
        for i, m in zip(ids, marks, strict=True):
            found = leaders.find(m)
            if found is None:
                leaders.add(i, m)
            out.append(i if found is None else found)
        return out
    words = np.frombuffer(b"".join(marks), "<u4").reshape(len(ids), -1)
    leader, free = np.array(ids, np.int64), np.arange(len(ids))
    while len(free) > 1:
        same = (words[free[1:]] == words[free[0]]).sum(1) * 100 >= words.shape[1] * s.percent
        leader[free[1:][same]] = ids[free[0]]
        free = free[1:][~same]
    return leader.tolist()


def _leaf_leaders(lines: DataFrame, s: TemplateSettings) -> DataFrame:
    """(leaf, line_id, template) for each line of leaves, or slices of leaves, that one task may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, ids, marks = None, [], []
        out: tuple[list[int], list[int], list[int]] = ([], [], [])

        def close() -> None:
            if ids:
                out[0].extend([leaf] * len(ids))
                out[1].extend(ids)
                out[2].extend(_settled(ids, marks, s))

        for b in batches:
            for key, i, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if key != leaf:
                    close()
                    leaf, ids, marks = key, [], []
                ids.append(i)
                marks.append(m)
            if len(out[0]) > 10_000:
                yield _rows(out)
                out = ([], [], [])
        close()
        yield _rows(out)

    def _rows(out: tuple[list[int], list[int], list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["leaf", "line_id", "template"])

    dealt = lines.repartition("leaf").sortWithinPartitions("leaf", F.desc("documents"), "line_id")
    return dealt.select("leaf", "line_id", "marks").mapInArrow(run, "leaf bigint, line_id bigint, template bigint")


def _dealt(rest: DataFrame, sizes: DataFrame, group: int) -> DataFrame:
    """``rest`` with ``part``, the groups of about ``group`` lines of its leaf, and ``parts``, their number."""
    near = sizes.select("leaf", F.ceil(F.col("n") / group).cast("int").alias("parts"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_s"))
    both = rest.withColumn("_s", F.pmod("line_id", F.lit(SPREAD)).cast("int")).join(near.hint("merge"), ["leaf", "_s"])
    return both.withColumn("part", F.pmod(F.xxhash64("line_id"), F.col("parts")).cast("int")).select("leaf", "part", "parts", "line_id", "documents", "marks")


def _follow(others: DataFrame, leaders: DataFrame, s: TemplateSettings) -> DataFrame:
    """(leaf, line_id, documents, marks, template) for ``others``; template is null where a line follows none of its leaf's leaders."""

    def run(lines: pa.Table, leads: pa.Table) -> pa.Table:
        out = lines.select(["leaf", "line_id", "documents", "marks"])
        found: list[int | None] = [None] * out.num_rows
        if out.num_rows and leads.num_rows:
            index = _Leaders(len(leads["marks"][0].as_py()) // 4, s)
            ranked = leads.sort_by([("documents", "descending"), ("line_id", "ascending")])
            for i, m in zip(ranked["line_id"].to_pylist(), ranked["marks"].to_pylist(), strict=True):
                index.add(i, m)
            found = [index.find(m) for m in out["marks"].to_pylist()]
        return out.append_column("template", pa.array(found, pa.int64()))

    schema = "leaf bigint, line_id bigint, documents bigint, marks binary, template bigint"
    return others.groupBy("leaf", "part").cogroup(leaders.groupBy("leaf", "part")).applyInArrow(run, schema)


def _peeled(scratch: Scratch, rest: DataFrame, s: TemplateSettings) -> tuple[list[DataFrame], list[str]]:
    """Tables (leaf, line_id, template) of the lines (leaf, line_id, documents, marks) of crowded leaves, and the names of what they read.

    A round settles the slice's lines and all that follow them, so a leaf takes as many rounds as its leaders fill slices.
    """
    done: list[DataFrame] = []
    names: list[str] = []
    slice_, k = s.leaf_lines, 0
    order = (F.desc("documents"), F.col("line_id"))
    while True:
        sizes = scratch.put(f"sizes{k}", rest.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")))
        if sizes.isEmpty():
            return done, [*names, f"sizes{k}"]
        dealt = scratch.put(f"dealt{k}", _dealt(rest, sizes, slice_ * GROUP_SLICES))
        # The first lines of a leaf are among the first of its groups.
        first = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("leaf", "part").orderBy(*order))).filter(F.col("_n") <= slice_)
        heads = scratch.put(f"heads{k}", first.withColumn("_n", F.row_number().over(Window.partitionBy("leaf").orderBy(*order))).filter(F.col("_n") <= slice_).drop("_n"))
        settled = scratch.put(f"settled{k}", _leaf_leaders(heads, s))
        own = settled.filter("line_id = template").select("leaf", "line_id")
        leaders = heads.join(own.hint("merge"), ["leaf", "line_id"])
        leaders = leaders.select("leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "line_id", "documents", "marks")
        others = dealt.join(heads.select("leaf", "line_id").hint("merge"), ["leaf", "line_id"], "left_anti").select("leaf", "part", "line_id", "documents", "marks")
        met = scratch.put(f"met{k}", _follow(others, leaders, s))
        scratch.drop(f"sizes{k}", f"dealt{k}", f"heads{k}")
        done += [settled, met.filter("template is not null").select("leaf", "line_id", "template")]
        names += [f"settled{k}", f"met{k}"]
        rest = met.filter("template is null").drop("template")
        slice_, k = min(slice_ * 2, s.leaf_lines * WIDEST_SLICE), k + 1


def recurring_lines(spark: SparkSession, docs: DataFrame, settings: TemplateSettings = TemplateSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lines): the numbers of the lines to drop, for each document that has any."""
    s, scratch = settings, Scratch(spark, "lines")
    line = ["leaf", "line_id"]  # a line is named by its digest within its leaf
    plain = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).filter("doc_id is not null")
    rows = scratch.put("rows", line_rows(spread(plain), s))
    stats = scratch.put("stats", rows.groupBy(*line).agg(F.count(F.when(F.col("lead"), 1)).alias("documents"), F.min("doc_id").alias("first")))
    leaves = scratch.put("leaves", stats.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    # Under another name of the leaf, lines are combined where they are and dealt by line: a join by leaf alone can then be split.
    turned = F.col("leaf").bitwiseXOR(F.lit(1))
    some = rows.filter("lead").select(*line, "marks").join(leaves.hint("merge"), "leaf", "left_semi").select(turned.alias("leaf"), "line_id", "marks")
    some = some.groupBy(*line).agg(F.first("marks").alias("marks")).select(turned.alias("leaf"), "line_id", "marks")
    lines = scratch.put("several", some.join(stats.select(*line, "documents").hint("merge"), line))
    crowded = leaves.filter(F.col("n") > s.leaf_lines).select("leaf", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_s"))
    parted, by = lines.withColumn("_s", F.pmod("line_id", F.lit(SPREAD)).cast("int")), ["leaf", "_s"]
    settled = _leaf_leaders(parted.join(crowded.hint("merge"), by, "left_anti").drop("_s"), s)
    peeled, peels = _peeled(scratch, parted.join(crowded.hint("merge"), by, "left_semi").drop("_s"), s)
    grouped = scratch.put("templates", reduce(DataFrame.union, peeled, settled))
    scratch.drop("several", *peels)
    # A document may hold several lines of one template: count documents, not lines.
    held = rows.filter("lead").select("doc_id", *line).join(grouped.hint("merge"), line).select("doc_id", "leaf", "template").distinct()
    shared = scratch.put("shared", held.groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first")))
    own = stats.join(grouped.hint("merge"), line, "left_anti").select(*line, "documents", "first")
    known = own.union(grouped.join(shared.hint("merge"), ["leaf", "template"]).select(*line, "documents", "first")).filter(F.col("documents") >= s.documents)
    known = scratch.put("known", known.select(*line, "first"))
    gone = rows.select("doc_id", "line", "span", *line).join(known.hint("merge"), line).filter("doc_id <> first")
    gone = gone.select("doc_id", F.explode(F.sequence(F.col("line"), F.col("line") + F.col("span") - 1)).alias("line"))
    dropped = scratch.put("dropped", gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("lines")))
    scratch.drop("rows", "stats", "leaves", "templates", "shared", "known")
    return dropped


def without_recurring_lines(spark: SparkSession, docs: DataFrame, settings: TemplateSettings = TemplateSettings(), id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_dropped") -> DataFrame:
    """``docs`` with the recurring lines taken out of ``text_col``, and their number as ``count_col``.

    Texts without such lines are untouched.  Null stays null, empty stays empty.
    Rows that share an id are one document; rows with a null id are left alone.
    An empty table stays empty.  Other columns may have any name but ``count_col``.
    Very long lines and texts are parsed whole.
    """
    names = docs.columns
    dropped = recurring_lines(spark, docs, settings, id_col, text_col).select(F.col("doc_id").alias("_doc"), "lines")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(f"`{id_col}`").cast("bigint").alias("_id"), F.col(f"`{text_col}`").alias("_t"))
    both = row.join(dropped.hint("merge"), F.col("_id") == F.col("_doc"), "left")
    left = F.array_join(F.filter(F.split("_t", "\n", -1), lambda x, i: ~F.array_contains("lines", i)), "\n")
    text = F.when(F.col("lines").isNull(), F.col("_t")).otherwise(left)
    kept = [text.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in names]
    return both.select(*kept, F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("bigint").alias(count_col))

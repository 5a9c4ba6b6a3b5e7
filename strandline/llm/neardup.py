"""Near duplicates by banded SetSketch registers, joint likelihood and exact verification.

A document is the set of its distinct word shingles.  Register i of its sketch
is the truncated, exponentially spaced level of the smallest of exponentially
distributed hash values, ``clip(floor(1 - log_b h_i), 0, q + 1)``; the register-wise
maximum of two sketches is the sketch of the union, and two registers are equal
with a probability close to the Jaccard similarity J (base b = 1.001).

1. Documents with equal sets form a class, named by the set's digest; one set for each class goes on.
2. Bands of registers are hashed; documents that share a band are a bucket.
3. The hub of a bucket is its most central member (the one with the most company over
   all its buckets).  Every document is compared with the most central hub it meets and
   components are formed; then with the hubs of its buckets that lie in other components;
   then with the most central member outside the hub's component.  Each round is a star,
   so its work is linear in the bucket.
4. Documents in buckets that still hold several components are joined exactly, by the
   rare ends of their sets (prefix filter): two sets that share k shingles share one of
   the ``n - k + 1`` shingles of either that come first in the order of frequency, and
   the threshold and the two sizes give the least k.  The place of a shingle in one set
   so bounds the size of the other, and classes of sizes are part of the key: a family
   of texts below the threshold makes no pairs at its common shingles.  Only pairs in
   different components are made.  So no pair of a bucket stays undecided, and a large
   group of near copies never becomes all its pairs.
5. A pair goes on if the likelihood of J given both sketches and both set sizes
   does not rule out the threshold; what is left is verified on the full sets.

A pair at J = 0.8 exactly shares no band with a probability of
(1 - 0.8**5)**32 = 3e-6, one at J = 0.85 of 2e-8; nothing else is approximate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.components import smallest_reachable
from strandline.llm.text import mix, pieces, word_hashes
from strandline.runtime import Scratch, spread


@dataclass(frozen=True)
class SketchSettings:
    """``words`` per shingle; link at ``percent`` / 100; sketch of ``bands`` * ``rows`` registers."""

    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5
    base: float = 1.001
    rate: float = 20.0
    levels: int = 65_534
    #: A pair is dropped before verification if the likelihood ratio against the threshold exceeds e**slack.
    slack: float = 16.0

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; fewer words than ``words`` count as one shingle."""
    hashes, firsts = word_hashes(column, lower=True)
    rolled = hashes.copy()
    size = max(len(hashes) - words + 1, 0)
    rolled = np.zeros(size, np.uint64)
    for k in range(words):
        rolled = mix(rolled + hashes[k : k + size] * np.uint64(2 * k + 3))
    for begin, end in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        n = end - begin
        if n >= words:
            yield np.unique(rolled[begin : end - words + 1])
        elif n:
            one = np.full(1, n, np.uint64)
            for h in hashes[begin:end]:
                one = mix(one * np.uint64(31) + h)
            yield one
        else:
            yield hashes[:0]


def _seeds(n: int) -> np.ndarray:
    return np.random.default_rng(0x5E75).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(shingles: np.ndarray, s: SketchSettings) -> np.ndarray:
    """The registers of one set; all 0 for the empty set."""
    least = np.full(s.registers, 2**64 - 1, np.uint64)
    factors = _seeds(s.registers)
    for at in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[at : at + 1024, None] * factors).min(0), out=least)
    if not len(shingles):
        return np.zeros(s.registers, np.uint16)
    value = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / s.rate
    return np.clip(np.floor(1 - np.log(value) / math.log(s.base)), 0, s.levels + 1).astype(np.uint16)


def band_keys(registers: np.ndarray, s: SketchSettings) -> np.ndarray:
    """64-bit keys of the bands: (documents, bands)."""
    cut = registers.reshape(len(registers), s.bands, s.rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, s.bands + 1, dtype=np.uint64), cut.shape[:2])
    for k in range(s.rows):
        key = mix(key * np.uint64(65_599) + cut[:, :, k])
    return key.astype(np.int64)


def similar_enough(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, s: SketchSettings) -> np.ndarray:
    """Whether the likelihood of the joint registers leaves room for J at the threshold.

    With shares u = nx / (nx + ny) and v = ny / (nx + ny), the register of x exceeds that of y
    with probability p(u - v J), p(t) = -log_b(1 - t (b - 1) / b), and falls below with p(v - u J).
    """
    above, below = (x > y).sum(1), (x < y).sum(1)
    same = x.shape[1] - above - below
    u = nx / (nx + ny)
    v = 1 - u
    ratio = np.minimum(u / v, v / u)

    def log_likelihood(j: np.ndarray) -> np.ndarray:
        p = lambda t: -np.log1p(-np.clip(t, 1e-9, 1) * (s.base - 1) / s.base) / math.log(s.base)
        more, less = p(u - v * j), p(v - u * j)
        return above * np.log(more) + below * np.log(less) + same * np.log(np.clip(1 - more - less, 1e-9, 1))

    asked = s.percent / 100
    best = np.full(len(u), -np.inf)
    for share in np.linspace(0.0, 1.0, 41):
        best = np.maximum(best, log_likelihood(share * ratio))
    held = np.maximum.reduce([log_likelihood(np.clip(asked + (1 - asked) * k, 0, ratio)) for k in np.linspace(0.0, 1.0, 11)])
    return (ratio >= asked - 1e-9) & (best - held <= s.slack)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_id, text); id and text_id name a document: rows that repeat both are equal to all that follows."""
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.md5(text.cast("binary")), F.lit("")).alias("text_id"), text.alias("text"))


def sketches(rows: DataFrame, s: SketchSettings) -> DataFrame:
    """(doc_id, text_id, n_shingles, node, registers, bands) per row; ``node`` is the digest of the set, null if it is empty."""
    schema = "doc_id bigint, text_id string, n_shingles bigint, node binary, registers binary, bands array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in pieces(batches):
            sets = list(shingle_sets(b.column(2), s.words))
            regs = np.stack([sketch(x, s) for x in sets])
            keys = pa.array(band_keys(regs, s).reshape(-1))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([hashlib.md5(x.tobytes()).digest() if len(x) else None for x in sets], pa.binary()),
                    pa.array([r.tobytes() for r in regs], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, s.bands, dtype=np.int32)), keys),
                ],
                names=["doc_id", "text_id", "n_shingles", "node", "registers", "bands"],
            )

    return rows.mapInArrow(run, schema)


def full_sets(rows: DataFrame, s: SketchSettings) -> DataFrame:
    """(node, shingles) of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            sets = list(shingle_sets(b.column(1), s.words))
            ends = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
            flat = pa.array(np.concatenate(sets).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["node", "shingles"])

    return rows.mapInArrow(run, "node binary, shingles array<bigint>")


def _likely(pairs: DataFrame, parts: DataFrame, s: SketchSettings) -> DataFrame:
    """The pairs (a, b) that the joint likelihood does not rule out."""
    side = lambda x: parts.select(F.col("node").alias(x), F.col("registers").alias(f"r{x}"), F.col("n_shingles").alias(f"n{x}"))
    both = pairs.join(side("b").hint("merge"), "b").join(side("a").hint("merge"), "a")
    both = both.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * s.percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                x = whole.slice(at, 4096)
                col = lambda k, x=x: x.column(x.schema.get_field_index(k))
                regs = [np.frombuffer(b"".join(col(k).to_pylist()), np.uint16).reshape(x.num_rows, -1) for k in ("ra", "rb")]
                sizes = [np.asarray(col(k), np.float64) for k in ("na", "nb")]
                keep = pa.array(similar_enough(*regs, *sizes, s))
                yield pa.RecordBatch.from_arrays([col("a").filter(keep), col("b").filter(keep)], names=["a", "b"])

    return both.mapInArrow(run, "a binary, b binary")


def _verified(pairs: DataFrame, parts: DataFrame, s: SketchSettings) -> DataFrame:
    """The pairs (a, b) whose full sets meet the threshold."""
    side = lambda x: parts.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}"))
    both = pairs.join(side("b").hint("merge"), "b").join(side("a").hint("merge"), "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.filter(shared * 100 >= (F.size("sa") + F.size("sb") - shared) * s.percent).select("a", "b")


#: Sizes of sets are dealt to classes, each of which reaches this far beyond its least size.
CLASS_STEP = 1.06


def prefix_rows(sets: DataFrame, s: SketchSettings) -> DataFrame:
    """(g, class, node, component, n, place, most, probe) of (node, component, n, order).

    ``order`` has a set's shared shingles, rarest first; shingles of that set alone come before all of them and only
    count.  Two sets that meet the threshold have ``needed`` shingles in common, so the first that they share stands
    within the first n - needed + 1 places of both.  At a given place that bounds the other set's size from above
    (``most``): a row is looked up by the classes of the sizes its partner may have up to its own (``probe``), and is
    found under the class of its own size, which it only has while a set of its own size may be a partner.
    """
    lone = F.col("n") - F.size("order")
    length = F.col("n") - F.ceil(F.col("n") * s.percent / 100) + 1 - lone
    cut = F.transform(F.slice("order", F.lit(1), F.greatest(length, F.lit(0)).cast("int")), lambda x, i: F.struct(x["g"].alias("g"), (lone + i + 1).alias("place")))
    rows = sets.select("node", "component", "n", F.explode(cut).alias("x")).select("node", "component", "n", "x.g", "x.place")
    # needed = ceil((n + m) * percent / (100 + percent)) <= n - place + 1, solved for the partner's size m.
    most = F.floor((F.col("n") - F.col("place") + 1) * (100 + s.percent) / s.percent + F.lit(1e-9)) - F.col("n")
    rows = rows.withColumn("most", most.cast("bigint")).filter(F.col("most") >= F.ceil(F.col("n") * s.percent / 100))
    klass = lambda n: F.floor(F.log(n.cast("double")) / math.log(CLASS_STEP)).cast("int")
    probes = F.sequence(klass(F.ceil(F.col("n") * s.percent / 100)), klass(F.least("n", "most")))
    probe = rows.select("g", F.explode(probes).alias("class"), "node", "component", "n", "place", "most", F.lit(True).alias("probe"))
    return probe.union(rows.filter("most >= n").select("g", klass(F.col("n")).alias("class"), "node", "component", "n", "place", "most", F.lit(False).alias("probe")))


def _prefix_pairs(left: DataFrame, parts: DataFrame, s: SketchSettings, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of (node, component) in different components that share a shingle of their prefixes."""
    sets = left.join(parts.select("node", "n_shingles", "shingles").hint("merge"), "node").select("node", "component", F.col("n_shingles").alias("n"), F.explode("shingles").alias("g"))
    sets = scratch.put("prefix-sets", sets)
    common = scratch.put("prefix-df", sets.groupBy("g").count().filter("count > 1"))
    ranked = sets.join(common.hint("merge"), "g").groupBy("node").agg(F.first("component").alias("component"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("count", "g"))).alias("order"))
    keys = scratch.put("prefix-keys", prefix_rows(ranked, s))
    scratch.drop("prefix-sets", "prefix-df")
    # Most rows of a frequent shingle lie in one component: the others are paired with all rows, not all with all.
    most = keys.groupBy("g", "class", "component").count().groupBy("g", "class").agg(F.max(F.struct("count", "component")).alias("top"), F.count(F.lit(1)).alias("components"))
    most = most.filter("components > 1").select("g", "class", F.col("top.component").alias("main"))
    keys = scratch.put("prefix-several", keys.join(most.hint("merge"), ["g", "class"]).withColumn("minor", F.col("component") != F.col("main")).drop("main"))
    side = lambda x, rows: rows.select("g", "class", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "component", "n", "place", "most")])
    probes, found = keys.filter("probe"), keys.filter("not probe")
    met = side("a", probes.filter("minor")).join(side("b", found).hint("merge"), ["g", "class"])
    met = met.union(side("a", probes.filter("not minor")).join(side("b", found.filter("minor")).hint("merge"), ["g", "class"]).select(*met.columns))
    # Of two sets of one size, the one with the larger digest looks up the other.
    falling = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("node_a") > F.col("node_b")))
    fits = (F.col("n_b") <= F.col("most_a")) & (F.col("n_a") <= F.col("most_b"))
    met = met.filter(falling & fits & (F.col("component_a") != F.col("component_b")))
    return met.select(F.col("node_b").alias("a"), F.col("node_a").alias("b")).distinct()


#: Rows of one band that are dealt to one task; a band with more is dealt to several.
BAND_ROWS = 256


def _with_band(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """``rows`` (with band, n, node) joined with ``facts`` (one row for each band, with n); rows of a crowded band are dealt to many keys."""
    deals = F.ceil(F.col("n") / BAND_ROWS).cast("int")
    many = facts.select("*", F.explode(F.sequence(F.lit(0), deals - 1)).alias("deal")).drop("n")
    return rows.withColumn("deal", F.pmod(F.xxhash64("node"), deals).cast("int")).join(many.hint("merge"), ["band", "deal"]).drop("deal")


def linked_rows(spark: SparkSession, docs: DataFrame, settings: SketchSettings = SketchSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_id, n_shingles, component, smallest) for each row of ``docs``.

    ``component`` is the least digest of a set that can be reached, ``smallest`` the least doc_id that has one of
    those sets; both are null for rows without shingles or without an id.
    """
    s, scratch = settings, Scratch(spark, "neardup")
    found = scratch.put("sketches", sketches(spread(_rows(docs, id_col, text_col)), s))
    usable = found.filter("n_shingles > 0 and doc_id is not null")
    least = F.min(F.struct("doc_id", "text_id")).alias("x")
    classes = usable.groupBy("node").agg(least, *[F.first(c).alias(c) for c in ("n_shingles", "registers", "bands")])
    classes = scratch.put("classes", classes.select("node", "x.doc_id", "x.text_id", "n_shingles", "registers", "bands"))

    rows = classes.select("node", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = scratch.put("members", _with_band_count(rows, shared))
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    members = scratch.put("weighed", members.join(weight.hint("merge"), "node"))
    scratch.drop("members")
    named = classes.join(members.select("node").distinct().hint("merge"), "node", "left_semi")
    named = scratch.put("representatives", named.select("node", "doc_id", "text_id", "n_shingles", "registers"))
    texts = _rows(docs, id_col, text_col).join(named.select("doc_id", "text_id", "node").hint("merge"), ["doc_id", "text_id"]).select("node", "text")
    # Rows that repeat a representative have its set as well: one is enough.
    sets = full_sets(texts, s).groupBy("node").agg(F.first("shingles").alias("shingles"))
    parts = scratch.put("parts", named.select("node", "n_shingles", "registers").join(sets.hint("merge"), "node"))

    hubs = members.groupBy("band").agg(F.max(F.struct("weight", "node")).alias("x"), F.first("n").alias("n")).select("band", "n", F.col("x.node").alias("hub"), F.col("x.weight").alias("hub_weight"))
    component = scratch.put("starred", _with_band(members, hubs))
    # First each set with the most central hub it meets, then with the hubs of its other buckets that are still apart.
    nearest = component.groupBy("node").agg(F.max(F.struct("hub_weight", "hub")).alias("x"))
    pairs = nearest.select(F.col("x.hub").alias("a"), F.col("node").alias("b")).filter("a <> b")
    component = component.select("band", "n", "node", "weight", "hub")
    links = spark.createDataFrame([], "a binary, b binary")
    for k in (1, 2, 3):
        likely = scratch.put(f"likely-{k}", _likely(pairs, parts, s))
        links = scratch.put(f"links-{k}", links.union(_verified(likely, parts, s)).distinct())
        linked = smallest_reachable(scratch, links, f"cc-{k}")
        held = component.drop("component", "owner").join(linked.hint("merge"), "node", "left").join(linked.select(F.col("node").alias("hub"), F.col("component").alias("owner")).hint("merge"), "hub", "left")
        held = held.withColumns({"component": F.coalesce("component", "node"), "owner": F.coalesce("owner", "hub")})
        held = scratch.put(f"held-{k}", held.select("band", "n", "node", "weight", "hub", "component", "owner"))
        mixed = held.filter(F.col("n") > k).groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.first("n").alias("n")).filter("lo <> hi").select("band", "n")
        component = scratch.put(f"mixed-{k}", _with_band(held, mixed))
        scratch.drop(f"held-{k}", f"likely-{k}")
        if k == 1:
            pairs = component.filter("component <> owner").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
        elif k == 2:
            second = component.filter("component <> owner").groupBy("band").agg(F.max(F.struct("weight", "node", "component")).alias("x"), F.first("n").alias("n"))
            second = second.select("band", "n", F.col("x.node").alias("a"), F.col("x.component").alias("ca"))
            pairs = _with_band(component, second).filter("component <> ca and node <> hub").select("a", F.col("node").alias("b")).distinct()

    left = component.select("node", "component").distinct()
    rest = scratch.put("likely-rest", _likely(_prefix_pairs(left, parts, s, scratch), parts, s))
    more = scratch.put("links-rest", _verified(rest, parts, s))
    if not more.isEmpty():
        linked = smallest_reachable(scratch, links.union(more), "cc-rest")

    labelled = classes.select("node", "doc_id").join(linked.hint("merge"), "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    labelled = scratch.put("labelled", labelled)
    smallest = scratch.put("smallest", labelled.groupBy("component").agg(F.min("doc_id").alias("smallest")))
    labelled = scratch.put("named", labelled.drop("doc_id").join(smallest.hint("merge"), "component"))
    scratch.drop("parts", "classes", "starred", "weighed", "representatives")
    known = F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")
    return found.select("doc_id", "text_id", "n_shingles", known).join(labelled.hint("merge"), "node", "left").select("doc_id", "text_id", "n_shingles", "component", "smallest")


def _with_band_count(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """The rows (node, band) of the bands in ``shared``, with n; the exchange of ``rows`` is one that Spark may split."""
    key = shared.select(F.col("band").bitwiseXOR(F.lit(1)).alias("key"), "n")
    return rows.join(key.hint("merge"), F.col("band") == F.col("key").bitwiseXOR(F.lit(1))).select("band", "n", "node").distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, settings: SketchSettings = SketchSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Only the id and text columns are read, so other columns may have any name.
    Null and empty texts and texts of white space have no shingles and are linked
    with nothing.  Rows that repeat a doc_id get one row each; each is linked by its
    own text.  A null doc_id is linked with nothing and kept.  An empty table gives
    an empty result.  Long texts are handled whole.

    The joins of tables that grow with the corpus ask for a sort-merge join, so
    that a small input runs the plan of a large one.
    """
    component_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("smallest", "doc_id"))
    rows = linked_rows(spark, docs, settings, id_col, text_col)
    return rows.select("doc_id", "n_shingles", component_id.alias("component_id"), component_id.eqNullSafe(F.col("doc_id")).alias("kept"))


def one_of_each(spark: SparkSession, docs: DataFrame, settings: SketchSettings = SketchSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component, the document with the least id stays.

    A document is an id with a text.  Rows that repeat both are one document, of which any one row stays; rows that
    share an id but not the text are judged apart, the least digest of the text first.  Documents without shingles
    (null, empty, white space) are linked with nothing and stay, as do all rows with a null id.  An empty table stays
    empty; other columns may have any name; long texts are compared whole.
    """
    names = docs.columns
    rows = linked_rows(spark, docs, settings, id_col, text_col).filter("doc_id is not null")
    first = rows.filter("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "text_id")).alias("x")).select("x.doc_id", "x.text_id")
    kept = first.union(rows.filter("component is null").select("doc_id", "text_id").distinct())
    kept = Scratch(spark, "one-of-each").put("kept", kept.select(F.col("doc_id").alias("_d"), F.col("text_id").alias("_t")))
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")
    keyed = docs.select(row, F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.md5(F.col(f"`{text_col}`").cast("binary")), F.lit("")).alias("text_id"))
    single = keyed.filter("doc_id is not null").groupBy("doc_id", "text_id").agg(F.first("_row").alias("_row"))
    stay = single.join(kept.hint("merge"), (F.col("doc_id") == F.col("_d")) & (F.col("text_id") == F.col("_t")), "left_semi").select("_row")
    out = stay.union(keyed.filter("doc_id is null").select("_row"))
    return out.select(*[F.col("_row").getField(c).alias(c) for c in names])


def all_pairs_sql(words: int, percent: int) -> str:
    """DuckDB SQL for the same rows by comparing all pairs that share a shingle; for small tables."""
    grams = " || ' ' || ".join(f"w[i + {k}]" for k in range(words))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, {grams} as g from (select doc_id, w, unnest(range(1, len(w) - {words - 2})) as i from d where len(w) >= {words})
      union all select doc_id, array_to_string(w, ' ') from d where len(w) between 1 and {words - 1}),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= {percent} * (x.n + y.n - k)),
e as (select a, b from l union select b, a from l),
walk as (select distinct a as node, a as c from e union select b, c from walk join e on a = node),
comp as (select node, min(c) as c from walk group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(comp.c, d.doc_id) as component_id, coalesce(comp.c, d.doc_id) = d.doc_id as kept
from d left join n on n.doc_id = d.doc_id left join comp on comp.node = d.doc_id
"""

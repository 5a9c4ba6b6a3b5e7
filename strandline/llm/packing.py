"""Best-fit packing of token sequences by bin completion, solved on the histogram of lengths.

Pieces of one length are interchangeable, so a packing is a list of patterns
(which lengths share a sequence) with multiplicities.  The histogram has at most
``capacity`` entries whatever the size of the corpus; only it reaches the driver.
There, sequences are completed around the largest length that is left.  Plans
that fill greedily (best-fit decreasing, and with more pieces looked ahead) are
the incumbents; where they miss the lower bound, a branch and bound goes over
the undominated fillings of each largest length.  Pieces find their places by their rank within their length,
which is a distributed numbering.
"""

from __future__ import annotations

import base64
import bisect
import json
import os
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.text import pieces
from strandline.runtime import Scratch, spread

CAPACITY = 1024
END_ID = 2
#: Fillings looked at around one length before its best-fit incumbent is taken.
SEARCH_NODES = 2_000
#: Pieces looked ahead in the completions that are tried, and the wastes beyond which a sequence is taken apart.
LOOKAHEAD, WASTES = (3, 1, 2, 4), (0, 1, 2, 4, 8, 16, 32, 64)
#: Steps of the branch and bound, each weighed by the number of lengths; what it leaves open is in the README.
PLAN_WORK = 300_000
Pattern = tuple[tuple[int, int], ...]


@lru_cache(maxsize=2)
def byte_bpe(path: str):
    """The vocabulary's encoder; ids equal those of the JSON file of the same vocabulary, with its added tokens."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    added = {}
    if os.path.exists(whole := os.path.splitext(path)[0] + ".json"):
        with open(whole, encoding="utf-8") as f:
            added = {x["content"]: x["id"] for x in json.load(f)["added_tokens"] if x["content"].encode() not in ranks}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int, vocabulary: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for each piece of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(vocabulary).encode_to_numpy
        tail = np.array([end_id], "<u4")
        for b in pieces(batches):
            rows: list[list] = [[], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.concatenate((encode(text, allowed_special="all").astype("<u4"), tail)) if text else tail
                first = len(ids) % capacity or min(len(ids), capacity)
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for to, v in zip(rows, (doc, k, x, y - x, zlib.crc32(ids[x:y])), strict=True):
                        to.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    plain = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return spread(plain).mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_filling(room: int, lengths: list[int], counts: dict[int, int], most: int, nodes: int = SEARCH_NODES) -> list[int]:
    """The fullest filling of ``room`` with at most ``most`` pieces, as lengths in falling order.

    Depth first, the largest length that fits first, so the best-fit filling is
    the first incumbent and a filling is met before those it dominates (with a
    piece swapped for smaller ones of the same sum).  A branch ends when its waste
    is bounded below by the incumbent's: the pieces it may still take, each at most
    as long as the last, cannot fill the room that is left any better.
    """
    best: list[int] = []
    waste, seen = room, 0
    low = [-x for x in lengths]  # rising, for bisection

    def search(begin: int, left: int, chosen: list[int]) -> None:
        nonlocal best, waste, seen
        if left < waste:
            best, waste = list(chosen), left
        for k in range(max(begin, bisect.bisect_left(low, -left)), len(lengths)):
            if waste == 0 or len(chosen) == most or left - (most - len(chosen)) * lengths[k] >= waste:
                return
            if counts[lengths[k]] <= chosen.count(lengths[k]):
                continue
            seen += 1
            if seen > nodes:
                return
            chosen.append(lengths[k])
            search(k, left - lengths[k], chosen)
            chosen.pop()

    search(0, room, [])
    return best


def completed(histogram: dict[int, int], capacity: int, most: int) -> list[tuple[Pattern, int]]:
    """Patterns with multiplicities that use every piece once; each step of a completion looks ``most`` pieces ahead.

    One piece ahead is best-fit decreasing; more pieces ahead fill tighter but use
    up small pieces sooner.
    """
    counts = {k: int(v) for k, v in histogram.items() if v}
    lengths = sorted(counts, reverse=True)
    plan: list[tuple[Pattern, int]] = []
    while lengths:
        need = {lengths[0]: 1}
        left = capacity - lengths[0]
        while True:
            free = {k: counts[k] - need.get(k, 0) for k in lengths[bisect.bisect_left(lengths, -left, key=lambda x: -x) :]}
            usable = [k for k, v in free.items() if v]
            filling = best_filling(left, usable, free, most) if usable else []
            if not filling:
                break
            for k in filling:
                need[k] = need.get(k, 0) + 1
                left -= k
        times = min(counts[k] // n for k, n in need.items())
        plan.append((tuple(sorted(need.items(), reverse=True)), times))
        for k, n in need.items():
            counts[k] -= n * times
        lengths = [k for k in lengths if counts[k]]
    return plan


def improved(plan: list[tuple[Pattern, int]], capacity: int, bound: int) -> list[tuple[Pattern, int]]:
    """The plan with its loose sequences completed anew.

    Sequences whose waste exceeds a bound are taken apart and completed again, with
    each lookahead and bound in turn, as long as that saves a sequence.
    """
    best = plan
    before = sequences(best) + 1
    while bound < sequences(best) < before:
        before = sequences(best)
        for most in LOOKAHEAD:
            for waste in WASTES:
                tight, loose = [], Counter()
                for pattern, times in best:
                    if capacity - sum(k * n for k, n in pattern) <= waste:
                        tight.append((pattern, times))
                    else:
                        loose.update({k: n * times for k, n in pattern})
                again = tight + completed(loose, capacity, most)
                if sequences(again) < sequences(best):
                    best = again
    return best


def sequences(plan: list[tuple[Pattern, int]]) -> int:
    return sum(t for _, t in plan)


def fillings(room: int, counts: dict[int, int]) -> Iterator[tuple[int, tuple[int, ...]]]:
    """(waste, lengths) of every undominated filling of ``room``, by rising waste, then the largest length first.

    A filling is dominated if a free piece still fits, or fits in place of a smaller one.
    """
    lengths = sorted((k for k, v in counts.items() if v and k <= room), reverse=True)
    reach = [1]  # the sums that the lengths from the last on can make, as bits; counts are left aside
    for k in reversed(lengths):
        sums, step = reach[-1], k
        while step <= room:
            sums |= sums << step
            step *= 2
        reach.append(sums & ((2 << room) - 1))
    reach.reverse()

    def search(k: int, left: int, chosen: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        if not left:
            yield chosen
            return
        for j in range(k, len(lengths)):
            if not reach[j] >> left & 1:
                return
            x = lengths[j]
            if x <= left and reach[j] >> (left - x) & 1 and chosen.count(x) < counts[x]:
                yield from search(j, left - x, (*chosen, x))

    for waste in range(room + 1):
        if reach[0] >> (room - waste) & 1:
            for chosen in search(0, room - waste, ()):
                spare = [x for x in lengths if counts[x] > chosen.count(x)] if waste else []
                if not any(x <= waste or any(y < x <= y + waste for y in chosen) for x in spare):
                    yield waste, chosen


def branched(histogram: dict[int, int], capacity: int, best: list[tuple[Pattern, int]], bound: int) -> list[tuple[Pattern, int]]:
    """Branch and bound over whole plans: a better plan than ``best``, or ``best``.

    The sequences of the largest length left are filled by each undominated filling,
    as many times as counts allow, then by halves, then each number between.  A branch ends when its waste passes
    what a plan with one sequence less than the incumbent may waste.  First the
    plans that leave the first choice nowhere are tried, then once, twice, and so on;
    the search ends with the choices, at the lower bound, or after ``PLAN_WORK``.
    """
    tokens = sum(k * v for k, v in histogram.items())
    work = PLAN_WORK

    def choices(counts: dict[int, int], wasted: int) -> Iterator[tuple[dict[int, int], int, int]]:
        top = max(k for k, v in counts.items() if v)
        for waste, chosen in fillings(capacity - top, {**counts, top: counts[top] - 1}):
            if wasted + waste > (sequences(best) - 1) * capacity - tokens:
                return
            need = Counter((top, *chosen))
            most = min(counts[k] // n for k, n in need.items())
            for times in dict.fromkeys([*(most >> k for k in range(most.bit_length())), *range(most, 0, -1)]):
                if wasted + waste * times <= (sequences(best) - 1) * capacity - tokens:
                    yield need, times, waste * times

    for turns in range(len(histogram) * 4):
        if sequences(best) <= bound:
            break
        counts = {k: int(v) for k, v in histogram.items() if v}
        open_, path, wasted, spent, cut = [[choices(counts, 0), 0]], [], 0, 0, False
        while open_ and work > 0 and sequences(best) > bound:
            children, seen = open_[-1]
            allowed = seen == 0 or spent < turns
            cut |= not allowed
            chosen = next(children, None) if allowed else None
            if chosen is None:
                open_.pop()
                if path:
                    need, times, waste, turn = path.pop()
                    wasted, spent = wasted - waste, spent - turn
                    for k, n in need.items():
                        counts[k] += n * times
                continue
            need, times, waste = chosen
            turn = int(seen > 0)
            open_[-1][1] += 1
            work -= 1 + len(counts)
            path.append((need, times, waste, turn))
            wasted, spent = wasted + waste, spent + turn
            for k, n in need.items():
                counts[k] -= n * times
            if any(counts.values()):
                open_.append([choices(counts, wasted), 0])
                continue
            if sum(p[1] for p in path) < sequences(best):
                best = [(tuple(sorted(p[0].items(), reverse=True)), p[1]) for p in path]
            open_.append([iter(()), 0])  # taken back at once
        if work <= 0 or not cut:
            break
    return best


def complete(histogram: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """The best plan of best-fit decreasing, the completions of each lookahead, their improvements, and branch and bound.

    The lower bound (all tokens in full sequences) ends the search.
    """
    bound = -(-sum(k * int(v) for k, v in histogram.items()) // capacity)
    best = improved(completed(histogram, capacity, 1), capacity, bound)
    for most in sorted(LOOKAHEAD)[1:]:
        if sequences(best) > bound:
            best = min(best, improved(completed(histogram, capacity, most), capacity, bound), key=sequences)
    return branched(histogram, capacity, best, bound)


def slots(plan: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, uses of the length in the pattern, first sequence, offset): one row for each length of each pattern."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, times in plan:
        offset = 0
        for size, n in pattern:
            out.append((size, taken.get(size, 0), n, sequence, offset))
            taken[size] = taken.get(size, 0) + n * times
            offset += n * size
        sequence += times
    return out


def pack(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None
) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    A null or empty text is the end id alone.  A document longer than
    ``capacity`` is cut so that its first piece may be shorter.  A null doc_id is
    passed on; repeated rows are packed each; an empty table gives an empty
    result; only the two named columns are read.
    """
    scratch = Scratch(spark, "packing")
    cut = token_pieces(docs, id_col, text_col, capacity, end_id, vocabulary or default_vocabulary())
    # Ranks within a length: a number within (length, lot), plus what the lots before it hold.
    lots = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    lot = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(lots)).cast("int")
    cut = scratch.put("pieces", cut.withColumn("lot", lot))
    sizes = scratch.put("sizes", cut.groupBy("length", "lot").count())
    histogram = {int(r["length"]): int(r["n"]) for r in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most ``capacity`` rows
    rows = slots(complete(histogram, capacity))
    where = spark.createDataFrame(rows or [(0, 0, 1, 0, 0)], "length bigint, first bigint, uses bigint, sequence bigint, place bigint")
    by_length = Window.partitionBy("length").orderBy("lot")
    before = sizes.select("length", "lot", (F.sum("count").over(by_length) - F.col("count")).alias("before"))
    inner = Window.partitionBy("length", "lot").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("inner", F.row_number().over(inner) - 1).join(before.hint("merge"), ["length", "lot"]).withColumn("rank", F.col("before") + F.col("inner"))
    # The slot of a piece is the last one of its length that starts at or before its rank.
    table = where.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "uses", "sequence", "place"))).alias("slots"))
    found = ranked.join(F.broadcast(table), "length").withColumn("slot", F.element_at(F.filter("slots", lambda s: s["first"] <= F.col("rank")), -1))
    step = F.col("rank") - F.col("slot.first")
    return found.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("slot.sequence") + F.floor(step / F.col("slot.uses"))).cast("bigint").alias("sequence_id"),
        (F.col("slot.place") + (step % F.col("slot.uses")) * F.col("length")).cast("bigint").alias("offset"),
    )

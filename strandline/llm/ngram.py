"""Scores of texts under an interpolated bigram model that lives in sharded Elias-Fano tries.

The corpus is cut into blocks of about ``block_bytes`` of text.  A block keeps its
token stream as small local numbers.

1. Words: each shard adds up the training counts that the blocks send and answers
   with total counts and word ids.
2. Model: each shard adds up the training counts of its bigrams and builds a trie
   (contexts, Elias-Fano pointers, successors, 8-bit smoothed log probabilities),
   which is stored as one row of the model's table.  Text that is held out leaves
   no trace in it.
3. Scores: each block asks the model for its distinct bigrams; questions and training
   counts travel together.  A shard maps its stored trie and answers by successor
   search within the context; the block backs off to the word's own probability where
   the trie has no such bigram.

The number of shards follows the bytes of text, so the work of one shard stays the
same at any size.  Only distinct keys of a block are sent, packed and compressed, so
a word or pair in a third of all places costs one entry for each block; a context's
successors are dealt to SPREAD shards by the successor.  Nothing is gathered on the
driver but the bytes of text and the two totals N and V.

P(w | v) = (c(v w) + mu P1(w)) / (c(v) + mu) with P1(w) = (c(w) + 1) / (N + V + 1):
interpolation with Dirichlet weights, so P sums to one over all words and the unknown one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.eliasfano import BigramTrie
from strandline.llm.text import mix, pieces, word_hashes
from strandline.runtime import Scratch, spread

BLOCK_BYTES = 6 << 20
#: Bytes of text for which there is one shard of the words and of the model.
SHARD_BYTES = 4 << 20
SPREAD = 16
MU = 20.0
#: Codes are -log10 P in steps of 1 / STEPS; ABSENT marks an n-gram that was not seen.
STEPS, ABSENT = 16.0, 255
#: The hash of the end of a text, which is also the context of its first word.
END = np.uint64(0xE0D0_F7E8_7000_0001)


def packed(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes."""
    values = np.ascontiguousarray(values, "<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return np.array([len(values), width], "<u4").tobytes() + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> np.ndarray:
    n, width = (int(x) for x in np.frombuffer(blob[:8], "<u4"))
    out = np.zeros((n, 8), np.uint8)
    if n:
        raw = pa.decompress(blob[8:], n * width, codec="zstd", asbytes=True)
        out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.view("<u8").reshape(-1)


def in_training(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 != 2


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def _cut(shard: np.ndarray) -> list[tuple[int, int, int]]:
    """(shard, begin, end) of the runs of a sorted array."""
    edge = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(shard) else np.zeros(0, np.int64)
    return [(int(shard[a]), int(a), int(b)) for a, b in zip(edge, [*edge[1:], len(shard)], strict=True)]


def _blocks(docs: DataFrame, shards: int, block_bytes: int) -> DataFrame:
    """Kind 0: one row per block with its documents and token stream; kind 1: its distinct words with training counts, by shard."""
    schema = "kind int, block string, docs array<bigint>, sizes array<int>, stream binary, shard int, keys binary, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        for b in _gathered(batches, block_bytes):
            hashed = [word_hashes(p.column(1), lower=True) for p in pieces(iter([b]))]
            ids = b.column(0).to_pylist()
            size = np.concatenate([np.diff(f) for _, f in hashed]) + 1
            ends = np.cumsum(size) - 1
            tokens = np.full(int(size.sum()), END)
            inner = np.ones(len(tokens), bool)
            inner[ends] = False
            tokens[inner] = np.concatenate([h for h, _ in hashed])
            known = np.repeat(np.array([in_training(d) for d in ids]), size)
            del hashed
            words, local = np.unique(tokens, return_inverse=True)
            del tokens
            # Local numbers follow (shard, hash), the order in which the answers come back.
            shard = _shard(words, shards)
            order = np.argsort(shard, kind="stable")
            place = np.empty(len(words), np.int64)
            place[order] = np.arange(len(words))
            local, words, shard = place[local], words[order], shard[order]
            counts = np.bincount(local[known], minlength=len(words))
            # The stream itself is kept in frequency ranks, which compress well, with the ranks' local numbers.
            by_use = np.argsort(-np.bincount(local, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[by_use] = np.arange(len(words))
            a, c = packed(rank[local]), packed(by_use)
            runs = _cut(shard)
            yield _rows(
                f"{part}-{number}", len(runs),
                [("docs", pa.list_(pa.int64()), ids), ("sizes", pa.list_(pa.int32()), size.tolist()), ("stream", pa.binary(), len(a).to_bytes(8, "little") + a + c)],
                [("shard", pa.int32(), [s for s, _, _ in runs]), ("keys", pa.binary(), [words[x:y].tobytes() for _, x, y in runs]), ("counts", pa.binary(), [packed(counts[x:y]) for _, x, y in runs])],
            )
            number += 1

    return docs.mapInArrow(run, schema)


def _rows(block: str, n: int, one: list[tuple], many: list[tuple]) -> pa.RecordBatch:
    """A row of kind 0 with the values ``one`` and ``n`` rows of kind 1 with the lists ``many``."""
    columns = [pa.array([0] + [1] * n, pa.int32()), pa.array([block] * (n + 1))]
    columns += [pa.array([v] + [None] * n, t) for _, t, v in one] + [pa.array([None, *v], t) for _, t, v in many]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "block", *[c for c, _, _ in one], *[c for c, _, _ in many]])


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches joined and cut to about ``most`` bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in pieces(batches, most=most):
        if held and size + b.nbytes > most:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(b)
        size += b.nbytes
    if held:
        yield pa.concat_batches(held)


def _word_totals(asked: DataFrame, shards: int) -> DataFrame:
    """For each (block, shard): total counts and ids of its words; the shard's sums stand beside its first block."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
        counts = np.concatenate([unpacked(x) for x in table.column("counts").to_pylist()]).astype(np.float64)
        words, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, counts, len(words)).astype(np.int64)
        ids = np.arange(len(words)) * shards + shard
        ends = np.cumsum([len(k) for k in keys])[:-1]
        n = len(keys)
        return pa.table(
            {
                "block": table.column("block"), "shard": pa.array([shard] * n, pa.int32()),
                "totals": pa.array([packed(total[x]) for x in np.split(at, ends)], pa.binary()), "ids": pa.array([packed(ids[x]) for x in np.split(at, ends)], pa.binary()),
                "tokens": pa.array([int(total.sum())] + [0] * (n - 1), pa.int64()), "kinds": pa.array([int((total > 0).sum())] + [0] * (n - 1), pa.int64()),
            }
        )

    return asked.groupBy("shard").applyInArrow(run, "block string, shard int, totals binary, ids binary, tokens bigint, kinds bigint")


def _stream(blob: bytes) -> np.ndarray:
    cut = 8 + int.from_bytes(blob[:8], "little")
    return unpacked(blob[cut:])[unpacked(blob[8:cut])].astype(np.int64)


def _codes(log10p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10p * STEPS), 0, ABSENT - 1).astype(np.uint8)


def _ask_bigrams(blocks: DataFrame, answers: DataFrame, n: int, v: int, shards: int) -> DataFrame:
    """Kind 0: per block base scores, the stream of places in its list of bigrams, and the code of backing off for each;
    kind 1: that list, by shard, with the counts in training text."""
    schema = (
        "kind int, block string, docs array<bigint>, sizes array<int>, known array<bigint>, base array<double>, stream binary, fallback binary, "
        "shard int, contexts binary, successors binary, context_counts binary, lower binary, counts binary"
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("shard")
        total = np.concatenate([unpacked(x) for x in right.column("totals").to_pylist()]).astype(np.int64)
        ids = np.concatenate([unpacked(x) for x in right.column("ids").to_pylist()]).astype(np.int64)
        if int(ids.max()) >> 32:
            raise OverflowError("more word ids than 32 bits hold: use fewer, larger shards")
        docs, sizes = left.column("docs")[0].as_py(), np.array(left.column("sizes")[0].as_py(), np.int64)
        local = _stream(left.column("stream")[0].as_py())
        log_p1 = np.log10((total + 1) / (n + v + 1))
        firsts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        base = np.add.reduceat(log_p1[local], firsts)
        known = np.add.reduceat((total[local] > 0).astype(np.int64), firsts)
        before = np.empty_like(local)
        before[1:] = local[:-1]
        before[firsts] = local[firsts[0] + sizes[0] - 1]  # the end token's local number
        before *= len(total)
        before += local
        del local
        pairs, stream = np.unique(before, return_inverse=True)
        del before
        c, w = pairs // len(total), pairs % len(total)
        train = np.repeat(np.array([in_training(d) for d in docs]), sizes)
        counts = np.bincount(stream[train], minlength=len(pairs))
        shard = _shard(mix(ids[c].astype(np.uint64) * np.uint64(SPREAD) + mix(ids[w].astype(np.uint64)) % np.uint64(SPREAD)), shards)
        order = np.lexsort((ids[w], ids[c], shard))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        c, w, counts, shard = c[order], w[order], counts[order], shard[order]
        lower = _codes(log_p1[w])
        fallback = _codes(np.log10(MU / (total[c] + MU)) - lower / STEPS)
        runs = _cut(shard)
        sent = lambda a: [packed(a[x:y]) for _, x, y in runs]
        batch = _rows(
            left.column("block")[0].as_py(), len(runs),
            [("docs", pa.list_(pa.int64()), docs), ("sizes", pa.list_(pa.int32()), sizes.tolist()), ("known", pa.list_(pa.int64()), known.tolist()),
             ("base", pa.list_(pa.float64()), base.tolist()), ("stream", pa.binary(), packed(place[stream])), ("fallback", pa.binary(), packed(fallback))],
            [("shard", pa.int32(), [k for k, _, _ in runs]), ("contexts", pa.binary(), [packed(np.diff(ids[c][x:y], prepend=0)) for _, x, y in runs]),  # differences: nearly all are small
             ("successors", pa.binary(), sent(ids[w])), ("context_counts", pa.binary(), sent(total[c])), ("lower", pa.binary(), sent(lower)), ("counts", pa.binary(), sent(counts))],
        )
        return pa.Table.from_batches([batch])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def _keys(contexts: list[bytes], successors: list[bytes]) -> list[np.ndarray]:
    return [np.cumsum(unpacked(c)).astype(np.uint64) << np.uint64(32) | unpacked(w) for c, w in zip(contexts, successors, strict=True)]


def build_trie(contexts: np.ndarray, successors: np.ndarray, counts: np.ndarray, context_counts: np.ndarray, lower: np.ndarray) -> bytes:
    """The stored trie of sorted distinct (context, successor) with their training counts."""
    p = (counts + MU * 10.0 ** (-lower / STEPS)) / (context_counts + MU)
    return BigramTrie.stored(contexts, successors, _codes(np.log10(p)))


def _asked(trie: bytes | None, keys: np.ndarray) -> np.ndarray:
    """The codes of the bigrams ``keys`` (context << 32 | successor) in a stored trie, ABSENT for those that it has not."""
    if trie is None:
        return np.full(len(keys), ABSENT, np.uint8)
    mapped = BigramTrie(trie)
    codes = mapped.lookup(keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF), ABSENT)
    mapped.close()
    return codes


_CODES = "kind int, block string, shard int, codes binary, trie binary"


def _codes_table(blocks: pa.ChunkedArray, shard: int, codes: list[np.ndarray], tries: list[bytes]) -> pa.Table:
    n, m = len(codes), len(tries)
    return pa.table(
        {
            "kind": pa.array([1] * m + [0] * n, pa.int32()), "block": pa.array([None] * m + blocks.to_pylist(), pa.string()), "shard": pa.array([shard] * (n + m), pa.int32()),
            "codes": pa.array([None] * m + [packed(x) for x in codes], pa.binary()), "trie": pa.array(tries + [None] * n, pa.binary()),
        }
    )


def _model_and_codes(pairs: DataFrame) -> DataFrame:
    """Kind 1: the stored trie of each shard's training bigrams; kind 0: for each (block, shard) what it answers."""

    def run(table: pa.Table) -> pa.Table:
        column = lambda k: table.column(k).to_pylist()
        each = _keys(column("contexts"), column("successors"))
        ends = np.cumsum([len(x) for x in each])[:-1]
        keys, first, at = np.unique(np.concatenate(each), return_index=True, return_inverse=True)
        del each
        gathered = lambda k, kind: np.concatenate([unpacked(x).astype(kind) for x in column(k)])
        counts = np.bincount(at, gathered("counts", np.float64), len(keys))
        context, lower = gathered("context_counts", np.float64)[first], gathered("lower", np.uint8)[first].astype(np.float64)
        seen = counts > 0
        learned = keys[seen]
        trie = build_trie(learned >> np.uint64(32), learned & np.uint64(0xFFFFFFFF), counts[seen], context[seen], lower[seen]) if len(learned) else None
        del learned, counts, context, lower
        codes = _asked(trie, keys)
        return _codes_table(table.column("block"), table.column("shard")[0].as_py(), [codes[x] for x in np.split(at, ends)], [] if trie is None else [trie])

    return pairs.groupBy("shard").applyInArrow(run, _CODES)


def _codes_of(pairs: DataFrame, model: DataFrame) -> DataFrame:
    """What another stored ``model`` (shard, trie) of the same words answers to the same questions."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        each = _keys(left.column("contexts").to_pylist(), left.column("successors").to_pylist())
        trie = right.column("trie")[0].as_py() if right.num_rows else None
        return _codes_table(left.column("block"), left.column("shard")[0].as_py() if each else 0, [_asked(trie, x) for x in each], [])

    return pairs.select("block", "shard", "contexts", "successors").groupBy("shard").cogroup(model.groupBy("shard")).applyInArrow(run, _CODES)


def _scores(blocks: DataFrame, answers: DataFrame, n: int) -> DataFrame:
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("shard")
        codes = np.concatenate([unpacked(x) for x in right.column("codes").to_pylist()])
        codes = np.where(codes == ABSENT, unpacked(left.column("fallback")[0].as_py()), codes)
        value = codes.astype(np.float64) / -STEPS
        sizes = np.array(left.column("sizes")[0].as_py(), np.int64)
        firsts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        score = np.add.reduceat(value[unpacked(left.column("stream")[0].as_py()).astype(np.int64)], firsts)
        docs = left.column("docs")[0].as_py()
        return pa.table(
            {
                "doc_id": pa.array(docs, pa.int64()), "held_out": pa.array([not in_training(d) for d in docs]), "n_tokens": pa.array(sizes),
                "n_known": pa.array(left.column("known")[0].as_py(), pa.int64()), "train_tokens": pa.array([n] * len(docs), pa.int64()),
                "base_score": pa.array(left.column("base")[0].as_py(), pa.float64()), "score": pa.array(score),
            }
        )

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


@dataclass(frozen=True)
class Fitted:
    """The stored ``model`` (shard, trie) with its totals, what the blocks of the corpus ask, and what it answers."""

    scratch: Scratch
    model: DataFrame
    pairs: DataFrame
    codes: DataFrame
    streams: DataFrame
    tokens: int
    kinds: int


def fit(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> Fitted:
    """Learn from the texts that are ``in_training``, and ask the model for all texts."""
    scratch = Scratch(spark, "ngram")
    plain = spread(docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    shards = max(2, -(-size // shard_bytes))
    streams, words = scratch.split("blocks", _blocks(plain, shards, block_bytes), "kind", [0, 1])
    words = scratch.put("words", _word_totals(words.select("block", "shard", "keys", "counts"), shards))
    scratch.drop("blocks/kind=1")
    sums = words.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("v")).first()
    rows = _ask_bigrams(streams.select("block", "docs", "sizes", "stream"), words.select("block", "shard", "totals", "ids"), sums["n"], sums["v"], shards)
    streams, pairs = scratch.split("asked", rows, "kind", [0, 1])
    scratch.drop("blocks", "words")
    pairs = pairs.select("block", "shard", "contexts", "successors", "context_counts", "lower", "counts")
    codes, model = scratch.split("answered", _model_and_codes(pairs), "kind", [0, 1])
    return Fitted(scratch, model.select("shard", "trie"), pairs, codes.select("block", "shard", "codes"), streams.select("block", "docs", "sizes", "known", "base", "stream", "fallback"), sums["n"], sums["v"])


def score(fitted: Fitted, model: DataFrame | None = None) -> DataFrame:
    """Scores of all texts of ``fitted`` under its model, or under another table (shard, trie) of the same words."""
    codes = fitted.codes if model is None else _codes_of(fitted.pairs, model).select("block", "shard", "codes")
    return _scores(fitted.streams, codes, fitted.tokens)


def score_texts(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Null and empty texts and texts of white space consist of the end token alone.
    A null doc_id counts as in training and is passed on; repeated rows train and
    score each; without any training text every word is unknown; an empty table
    gives an empty result.  Only the two named columns are read; long texts are
    scored whole.  OverflowError where word ids would pass 32 bits.
    """
    fitted = fit(spark, docs, id_col, text_col, block_bytes, shard_bytes)
    fitted.scratch.drop("asked/kind=1")
    return score(fitted)

"""SentencePiece encoding and decoding with forward tables shared along a trie of words.

The given model merges pairs (byte-pair encoding with byte fallback), so the
best path is not the one with the largest sum of scores: a sum-of-scores Viterbi
gives other ids than the model's own.  The forward pass keeps its shape and
changes its score: a piece may end at a place if it and the piece before are a
pair that merging leaves apart, and exactly one piece qualifies at each place
(the last piece of the encoding of that prefix).  Words with their mark are
sorted and walked as a trie, depth first; a word reuses the forward table of
the prefix it shares with the word before it.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.text import pieces as slices
from strandline.runtime import spread

MARK = "▁"
#: Words whose ids a worker keeps between blocks; beyond it the table is started anew.
KEPT_WORDS = 1_000_000
BLOCK_BYTES = 4 << 20


class PieceModel:
    """The vocabulary of a SentencePiece BPE file, with its own encoder and decoder."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
        self.ids = {sp.id_to_piece(i): i for i in range(n) if not special[i]}
        self.text = {i: p for p, i in self.ids.items()}
        self.bytes_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.raw = [b"" if special[i] else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        for b, i in enumerate(self.bytes_ids):
            self.raw[i] = bytes([b])
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece goes on after the end of a word; words cannot be encoded one by one")
        if sp.encode(" a") == sp.encode("a") or sp.encode("ﬁ") == sp.encode("fi"):
            raise ValueError("the model normalises its input; only identity with a leading mark is supported")
        # Merge order: better scores first; single characters are there from the start.
        self.rank = {i: (-1.0 if len(p) == 1 else -sp.get_score(i)) for i, p in self.text.items()}
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._apart: dict[int, bool] = {}
        self.code = [i.to_bytes(4, "little") for i in range(n)]
        self._automaton()
        lone = "".join(map(re.escape, (c for c in "\n\t\r" if not any(c in p for p in self.ids))))
        self._units = re.compile(f"{MARK}*[^{MARK}{lone}]+|{MARK}+" + (f"|[{lone}]+" if lone else ""))
        self._known: dict[str, bytes] = {}

    def _automaton(self) -> None:
        """States for the prefixes of pieces: where a character leads, and the pieces that end there, longest first (length, id)."""
        step: list[dict[str, int]] = [{}]
        ends: list[tuple[tuple[int, int], ...]] = [()]
        for p, i in self.ids.items():
            if len(p) > 1 and self.parts(i) is None:
                continue  # merging never makes it
            at = 0
            for c in p:
                if c not in step[at]:
                    step[at][c] = len(step)
                    step.append({})
                    ends.append(())
                at = step[at][c]
            ends[at] = ((len(p), i),)
        back = [0] * len(step)
        todo = list(step[0].values())
        for at in todo:  # breadth first: the state of the longest proper end comes earlier
            for c, to in step[at].items():
                up = back[at]
                while up and c not in step[up]:
                    up = back[up]
                back[to] = step[up].get(c, 0)
                todo.append(to)
            ends[at] += ends[back[at]]
        self.step, self.ends, self.back = step, ends, back

    def _follow(self, state: int, c: str) -> int:
        """Where ``c`` leads from ``state``, kept for the next time."""
        up = state
        while up and c not in self.step[up]:
            up = self.back[up]
        to = self.step[up].get(c, 0)
        if c in self.ids:
            self.step[state][c] = to
        return to

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two pieces that are merged last on the way to ``token``; None for a character or a piece that merging never makes."""
        if token not in self._parts:
            left = [self.ids.get(c, -1) for c in self.text[token]]
            while len(left) > 2:
                at, best = -1, None
                for k in range(len(left) - 1):
                    made = self.merged(left[k], left[k + 1])
                    if made is not None and (best is None or self.rank[made] < self.rank[best]):
                        at, best = k, made
                if best is None:
                    break
                left[at : at + 2] = [best]
            self._parts[token] = (left[0], left[1]) if len(left) == 2 and -1 not in left else None
        return self._parts[token]

    def merged(self, a: int, b: int) -> int | None:
        if a < 0 or b < 0:
            return None
        return self.ids.get(self.text[a] + self.text[b])

    def apart(self, a: int, b: int) -> bool:
        """Whether merging the text of ``a`` and ``b`` ends in just these two.

        Undo the merges on both sides of the border from the last to the first:
        at each moment the two pieces that face each other must not have merged
        before the later of them was itself merged.
        """
        if a < 0 or b < 0:
            return True
        key = a << 20 | b
        found = self._apart.get(key)
        if found is None:
            found = self._apart[key] = self._checked(a, b)
        return found

    def _checked(self, a: int, b: int) -> bool:
        # A merge across the border wins if its (rank, place) comes before ``bound``; places left of the border come first.
        bound: tuple[float, int] = (float("inf"), 0)
        while True:
            made = self.merged(a, b)
            if made is not None and (self.rank[made], 1) < bound:
                return False
            left, right = self.parts(a), self.parts(b)
            if left is None and right is None:
                return True
            # Of equal ranks the right one was merged later.
            if right is None or (left is not None and self.rank[a] > self.rank[b]):
                bound = (self.rank[a], 0)
                a = left[1]
            else:
                bound = (self.rank[b], 2)
                b = right[0]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids (little-endian 32-bit) of sorted distinct words."""
        out = []
        step, ends, known_apart, apart, code = self.step, self.ends, self._apart, self.apart, self.code
        # For each prefix of the word: the last piece of its encoding (-1: none, or an unknown character), its length, the state.
        last: list[int] = [-1]
        size: list[int] = [0]
        states: list[int] = [0]
        before = ""
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], size[shared + 1 :], states[shared + 1 :]
            state, end = states[-1], shared
            for c in word[shared:]:
                end += 1
                to = step[state].get(c)
                state = self._follow(state, c) if to is None else to
                states.append(state)
                for n, token in ends[state]:
                    if n < end:
                        left = last[end - n]
                        fits = known_apart.get(left << 20 | token)
                        if not (apart(left, token) if fits is None else fits):
                            continue
                    last.append(token)
                    size.append(n)
                    break
                else:
                    last.append(-1)
                    size.append(1)
            found = []
            while end:
                token = last[end]
                found.append(code[token] if token >= 0 else b"".join([code[self.bytes_ids[x]] for x in word[end - 1].encode()]))
                end -= size[end]
            found.reverse()
            out.append(b"".join(found))
            before = word
        return out

    def encode_texts(self, texts: list[str | None]) -> list[bytes]:
        """The ids of whole texts; null and empty texts have none."""
        units = [self._units.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = sorted({u for us in units for u in us}.difference(self._known))
        if len(self._known) + len(new) > KEPT_WORDS:
            self._known.clear()
            self._apart.clear() if len(self._apart) > 4 * KEPT_WORDS else None
            new = sorted({u for us in units for u in us})
        self._known.update(zip(new, self.encode_words(new), strict=True))
        known = self._known
        return [b"".join(map(known.__getitem__, us)) for us in units]

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces with marks as spaces, bytes joined, the leading mark dropped."""
        raw = self.raw
        out = b"".join([raw[i] for i in memoryview(ids).cast("I")])
        return out[1:].decode(errors="replace") if out[:1] == b" " else out.decode(errors="replace")


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids) for every row; null and empty texts have no ids, a null id is passed on, an empty table stays empty."""
    at = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=BLOCK_BYTES):
            found = model(at).encode_texts(b.column(1).to_pylist())
            flat = pa.array(np.frombuffer(b"".join(found), "<u4").astype(np.int32))
            ends = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["doc_id", "ids"])

    return spread(docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give the empty text."""
    at = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [model(at).decode(np.asarray(ids or [], "<u4").tobytes()) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, decoded_sha256, round_trip): ids made, read back and compared, text by text.

    ``round_trip`` says whether the decoded text equals the text (with marks as spaces).
    """
    at = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=BLOCK_BYTES):
            m = model(at)
            texts = [t or "" for t in b.column(1).to_pylist()]
            found = m.encode_texts(texts)
            back = [m.decode(x) for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([len(x) // 4 for x in found], pa.int64()), pa.array([zlib.crc32(x) for x in found], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back]), pa.array([x == t.replace(MARK, " ") for x, t in zip(back, texts, strict=True)], pa.bool_()),
                ],
                names=["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "round_trip"],
            )

    schema = "doc_id bigint, n_pieces bigint, ids_crc32 bigint, decoded_sha256 string, round_trip boolean"
    return spread(docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))).mapInArrow(run, schema)

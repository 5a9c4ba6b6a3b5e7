"""Language identification with presence string kernels, Nyström landmarks and kernel ridge regression.

The kernel of two texts is the number of byte n-grams (n = 2, 3, 4, hashed to
BUCKETS each) that both hold, over the root of the product of their own
numbers.  Landmarks are texts of the training sample; a text's Nyström features
are its kernels with the landmarks times the inverse root of the landmarks'
kernel matrix; one ridge regression per language is fitted on them.  As the
kernel is a product of presence vectors, landmarks and regressions fold into one
matrix (buckets by languages), and a batch is scored by one product.

Only the fit is done on a sample, of at most SAMPLE_PER_LABEL texts for each
label, drawn by a hash of id and text; every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.text import pieces, utf8
from strandline.runtime import spread

GRAMS = (2, 3, 4)
BUCKETS = 1 << 15
SIZE = len(GRAMS) * BUCKETS
#: Bounds of the fit: texts per label, all texts, landmarks per label.
SAMPLE_PER_LABEL, SAMPLE_ALL, LANDMARKS = 200, 4_000, 32
#: Labels that are learned, the most frequent ones; it bounds the matrix that every task holds (393 kB a label).
MOST_LABELS = 200
RIDGE = 1e-2
#: Texts in one product of the scoring.
ROWS = 32
SHARPNESS = 6.0


_LETTER = np.full(256, 32, np.uint8)
_LETTER[128:] = np.arange(128, 256)
_LETTER[97:123] = _LETTER[65:91] = np.arange(97, 123)


def folded(buf: np.ndarray) -> np.ndarray:
    """Lower-case bytes with each run of other ASCII characters as one space; Latin-1 capitals are lowered too."""
    low = _LETTER[buf]
    if len(low) > 1:
        capital = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E)
        low[1:][capital] += 0x20
        space = low == 32
        low = low[~(space & np.concatenate(([True], space[:-1])))]
    return low


def buckets(buf: np.ndarray) -> np.ndarray:
    """The buckets of all n-grams of one text's folded bytes, with repeats."""
    wide, out = folded(buf).astype(np.uint32), []
    for k, n in enumerate(GRAMS):
        if len(wide) < n:
            break
        size = len(wide) - n + 1
        code = wide[:size]
        for j in range(1, n):
            code = (code << np.uint32(8)) | wide[j : j + size]
        mixed = ((code ^ (code >> np.uint32(15))) * np.uint32(2_654_435_761)) >> np.uint32(17)
        out.append(mixed.astype(np.int64) + k * BUCKETS)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Model:
    """Labels, and the folded weights (SIZE, labels)."""

    labels: tuple[str, ...]
    weights: np.ndarray

    def scores(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(place of the best label, its share of the softmax) for each text's bytes."""
        best, share = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        x = np.zeros((min(ROWS, max(len(texts), 1)), SIZE), np.float32)
        for at in range(0, len(texts), ROWS):
            some = [buckets(t) for t in texts[at : at + ROWS]]
            for row, b in zip(x, some, strict=False):
                row[b] = 1
            part = x[: len(some)]
            own = np.sqrt(np.maximum(part.sum(1), 1))
            value = (part @ self.weights) / own[:, None]
            for row, b in zip(x, some, strict=False):
                row[b] = 0
            power = np.exp(SHARPNESS * (value - value.max(1, keepdims=True)).astype(np.float64))
            best[at : at + len(some)] = value.argmax(1)
            share[at : at + len(some)] = (power / power.sum(1, keepdims=True)).max(1)
        return best, share


def fit_model(texts: list[np.ndarray], labels: list[str]) -> Model | None:
    """Fit on the distinct buckets of each text; None without any text."""
    names = sorted(set(labels))
    if not names:
        return None
    y = np.array([[1.0 if lab == n else -1.0 for n in names] for lab in labels])
    seen = {n: 0 for n in names}
    marks = []
    for i, lab in enumerate(labels):
        if seen[lab] < LANDMARKS:
            seen[lab] += 1
            marks.append(i)
    landmarks = np.zeros((len(marks), SIZE), np.float32)
    for row, i in zip(landmarks, marks, strict=True):
        row[texts[i]] = 1
    landmarks /= np.sqrt(np.maximum(landmarks.sum(1, keepdims=True), 1))
    kernel = np.empty((len(texts), len(marks)))
    for i, t in enumerate(texts):
        kernel[i] = landmarks[:, t].sum(1) / np.sqrt(max(len(t), 1))
    own = kernel[marks]
    value, vector = np.linalg.eigh((own + own.T) / 2)
    good = value > 1e-8 * max(value.max(), 1e-8)
    root = vector[:, good] / np.sqrt(value[good])
    phi = kernel @ root
    weight = np.array([1.0 / max(1, labels.count(lab)) for lab in labels])  # labels count alike
    gram = phi.T @ (phi * weight[:, None]) + RIDGE * np.eye(phi.shape[1]) / len(names)
    ridge = np.linalg.solve(gram, phi.T @ (y * weight[:, None]))
    return Model(tuple(names), (landmarks.T @ (root @ ridge)).astype(np.float32))


def train(docs: DataFrame, id_col: str, text_col: str, label_col: str, in_training: Column) -> Model | None:
    """A model of the labelled rows that ``in_training`` admits.

    At most SAMPLE_ALL rows reach the driver: the least hashes of id and text of each of the MOST_LABELS most frequent
    labels.  Rows that repeat id and text are drawn as any others; rows with a null id are told apart by their texts.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{label_col}`").alias("label"), in_training.alias("learn"))
    rows = rows.filter("learn and label is not null and text is not null")
    counts = {r[0]: r[1] for r in rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(MOST_LABELS).collect()}
    if not counts:
        return None
    each = max(1, min(SAMPLE_PER_LABEL, SAMPLE_ALL // len(counts)))
    place = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40))
    # A hash bound that admits somewhat more than asked, so that few rows are ranked; the rank makes the bound exact.
    edge = F.create_map(*[x for lab, n in counts.items() for x in (F.lit(lab), F.lit(int(min(1.0, (1.3 * each + 30) / n) * (1 << 40))))])
    near = rows.select("label", "text", place.alias("k")).filter(F.col("k") < edge[F.col("label")])
    rank = F.row_number().over(Window.partitionBy("label").orderBy("k"))
    drawn = near.withColumn("rank", rank).filter(F.col("rank") <= each).select("k", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            buf, offsets = utf8(b.column(2))
            found = [np.unique(buckets(buf[x:y])).astype(np.int32).tobytes() for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], names=["k", "label", "grams"])

    got = sorted((r["label"], r["k"], bytes(r["grams"])) for r in drawn.mapInArrow(run, "k bigint, label string, grams binary").collect())
    return fit_model([np.frombuffer(grams, np.int32).astype(np.int64) for _, _, grams in got], [label for label, _, _ in got])


def _has_letter(buf: np.ndarray) -> bool:
    low = buf | 0x20
    if ((low >= 97) & (low <= 122)).any():
        return True
    return bool((buf > 127).any()) and any(c.isalpha() for c in buf.tobytes().decode(errors="ignore"))


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row.

    Null texts, and texts without a letter, are ``und`` with score 0, as is
    everything under no model.  A null id is passed on, repeated rows get equal
    rows, an empty table stays empty; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            buf, offsets = utf8(b.column(1))
            texts = [buf[x:y] for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
            real = [i for i, t in enumerate(texts) if model is not None and _has_letter(t)]
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            if real and model is not None:
                best, share = model.scores([texts[i] for i in real])
                for i, k, s in zip(real, best, share, strict=True):
                    lang[i], score[i] = model.labels[k], s
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    plain = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return spread(plain).mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2

"""Media columns: baseline JPEG written and read in numpy, with DC-only luminance thumbnails.

A payload is stored losslessly as a grey baseline JPEG whose 8 x 8 blocks are
flat: the DC coefficient of a block, with a quantiser of 8, is one byte.  The
thumbnail that a DC-only decoder makes (one pixel for each block) is then the
payload itself.  Each row of 64 blocks is a restart interval.

The decoder takes any Huffman-coded baseline image: it parses the markers,
undoes byte stuffing, cuts scans at restart markers, and decodes the pieces of
many images in lockstep; AC symbols are decoded and skipped.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.text import pieces, utf8
from strandline.runtime import spread

ROW = 64
MOST_SIDE = 65_535 // 8
#: Bytes of text whose images are coded and decoded together.
BLOCK_BYTES = 1 << 20

#: Code lengths of the DC categories 0 to 8, chosen for differences between neighbouring text bytes.
DC_LENGTHS = (4, 4, 3, 3, 2, 3, 4, 3, 5)
AC_LENGTHS = {0x00: 1}


def _canonical(lengths: dict[int, int]) -> tuple[bytes, bytes, dict[int, tuple[int, int]]]:
    """(counts of the 16 lengths, symbols in order, symbol -> (code, length)) of a Huffman table."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = bytes(sum(1 for s in symbols if lengths[s] == n) for n in range(1, 17))
    codes, code, before = {}, 0, 0
    for s in symbols:
        code <<= lengths[s] - before
        before = lengths[s]
        codes[s] = (code, before)
        code += 1
    return counts, bytes(symbols), codes


_DC = _canonical(dict(enumerate(DC_LENGTHS)))
_AC = _canonical(AC_LENGTHS)
_CATEGORY = np.array([int(x).bit_length() for x in range(256)], np.int64)
_DC_CODE = np.array([_DC[2][c][0] for c in range(9)], np.int64)
_DC_SIZE = np.array([_DC[2][c][1] for c in range(9)], np.int64)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int, columns: int, payload: int) -> bytes:
    quantiser = bytes([0, 8] + [1] * 63)
    frame = struct.pack(">BHHBBBB", 8, rows * 8, columns * 8, 1, 1, 0x11, 0)
    return b"".join(
        [
            b"\xff\xd8", _segment(0xFE, b"payload " + str(payload).encode()), _segment(0xDB, quantiser), _segment(0xC0, frame),
            _segment(0xC4, bytes([0x00]) + _DC[0] + _DC[1]), _segment(0xC4, bytes([0x10]) + _AC[0] + _AC[1]),
            _segment(0xDD, struct.pack(">H", ROW)), _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
        ]
    )


def _code_rows(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of rows of blocks (rows, ROW), stuffed, and the size of each row."""
    dc = values.astype(np.int64) - 128
    step = np.diff(dc, axis=1, prepend=0).reshape(-1)
    category = _CATEGORY[np.abs(step)]
    extra = np.where(step < 0, step + (1 << category) - 1, step)
    size = _DC_SIZE[category] + category + 1  # with the end of the block, a single 0
    code = ((_DC_CODE[category] << category) | extra) << 1
    ends = np.cumsum(size.reshape(-1, ROW), axis=1)
    row_bytes = (ends[:, -1] + 7) >> 3
    first = np.concatenate(([0], np.cumsum(row_bytes)))
    at = (ends - size.reshape(-1, ROW)).reshape(-1) + np.repeat(first[:-1] * 8, ROW)
    spread = code << (24 - size - (at & 7))  # at most 14 + 7 bits
    total = int(first[-1])
    out = np.zeros(total + 3, np.float64)
    for k in range(3):
        out += np.bincount((at >> 3) + k, (spread >> (16 - 8 * k)) & 255, total + 3)
    coded = out[:total].astype(np.uint8)
    coded[first[1:] - 1] |= ((1 << (row_bytes * 8 - ends[:, -1])) - 1).astype(np.uint8)  # pad with ones
    wide = np.where(coded == 255, 2, 1)
    place = np.concatenate(([0], np.cumsum(wide)))
    stuffed = np.zeros(int(place[-1]), np.uint8)
    stuffed[place[:-1]] = coded
    return stuffed, np.diff(place[first])


def _parts(size: int) -> list[int]:
    """The bytes that each image of a payload holds."""
    return [min(ROW * MOST_SIDE, size - at) for at in range(0, size, ROW * MOST_SIDE)]


def encode_payloads(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The stored form of each payload ``data[offsets[i]:offsets[i + 1]]``, whose sizes are positive multiples of 64.

    One image of 64 columns of blocks, or several one after the other where the payload has more than MOST_SIDE rows.
    """
    cuts = [_parts(int(n)) for n in np.diff(offsets)]
    out: list[bytes] = []
    for begin, end in _lots([sum(c) for c in cuts]):
        images = iter(_encode_images(data[offsets[begin] : offsets[end]], [n for c in cuts[begin:end] for n in c]))
        out += [b"".join(next(images) for _ in c) for c in cuts[begin:end]]
    return out


def _lots(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of items of about BLOCK_BYTES, one item at least."""
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > BLOCK_BYTES:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield begin, len(sizes)


def _encode_images(data: np.ndarray, sizes: list[int]) -> Iterator[bytes]:
    at = 0
    for begin, end in _lots(sizes):
        size = sum(sizes[begin:end])
        coded, row_sizes = _code_rows(data[at : at + size].reshape(-1, ROW))
        at += size
        raw = coded.tobytes()
        ends = np.concatenate(([0], np.cumsum(row_sizes)))
        row = 0
        for n in sizes[begin:end]:
            rows = n // ROW
            cuts = ends[row : row + rows + 1].tolist()
            parts = [_header(rows, ROW, n)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if k:
                    parts.append(_RESTARTS[(k - 1) & 7])
                parts.append(raw[a:b])
            parts.append(b"\xff\xd9")
            yield b"".join(parts)
            row += rows


def images_of(media: bytes) -> list[bytes]:
    """The images that stand one after the other in a stored value."""
    out, at = [], 0
    while at < len(media):
        place = at + 2
        while media[place + 1] != 0xDA:
            place += 2 + int.from_bytes(media[place + 2 : place + 4], "big")
        end = media.index(b"\xff\xd9", place) + 2  # stuffing keeps the mark out of the scan
        out.append(media[at:end])
        at = end
    return out


_RESTARTS = [bytes([0xFF, 0xD0 + k]) for k in range(8)]


@dataclass
class Image:
    """What the markers say, and the scan's pieces."""

    width: int = 0
    height: int = 0
    interval: int = 0
    comment: bytes = b""
    quantisers: dict[int, int] = field(default_factory=dict)
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, horizontal, vertical, quantiser
    tables: dict[int, bytes] = field(default_factory=dict)  # class << 4 | number -> counts and symbols
    scan: list[tuple[int, int]] = field(default_factory=list)  # place of the component, dc << 4 | ac
    pieces: list[bytes] = field(default_factory=list)

    def mcus(self) -> tuple[int, int]:
        h, v = max(c[1] for c in self.components), max(c[2] for c in self.components)
        if len(self.components) == 1:
            h = v = 1
        return -(-self.height // (8 * v)), -(-self.width // (8 * h))


def parse(data: bytes) -> Image:
    """The markers and the entropy-coded pieces of one baseline image; ValueError for what is not one."""
    image = Image()
    if data[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at = 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        (size,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide, number = body[0] >> 4, body[0] & 15
                image.quantisers[number] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker in (0xC0, 0xC1):
            bits, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError("samples are not of 8 bits")
            image.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif marker in (0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF):
            raise ValueError("not a baseline image")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                image.tables[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xDD:
            (image.interval,) = struct.unpack(">H", body)
        elif marker == 0xFE:
            image.comment = body
        elif marker == 0xDA:
            numbers = [c[0] for c in image.components]
            image.scan = [(numbers.index(body[1 + 2 * k]), body[2 + 2 * k]) for k in range(body[0])]
            break
    if len(image.scan) != len(image.components) or not image.components:
        raise ValueError("only images with all components in one scan are read")
    scan = np.frombuffer(data, np.uint8)[at:]
    after = scan[np.flatnonzero(scan[:-1] == 255) + 1]
    places = np.flatnonzero(scan[:-1] == 255)
    real = (after != 0) & (after != 255)
    cuts = places[real].tolist()
    begin = 0
    for cut, what in zip(cuts, after[real].tolist(), strict=True):
        image.pieces.append(data[at + begin : at + cut].replace(b"\xff\x00", b"\xff"))
        begin = cut + 2
        if not 0xD0 <= what <= 0xD7:
            break
    else:
        image.pieces.append(data[at + begin :].replace(b"\xff\x00", b"\xff"))
    return image


@lru_cache(maxsize=64)
def _lookup(table: bytes) -> np.ndarray:
    """For 16 bits that come next: length << 8 | symbol; 0 for no code."""
    out = np.zeros(1 << 16, np.uint16)
    code, at = 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | table[at]
            code += 1
            at += 1
        code <<= 1
    return out


def dc_values(images: list[Image]) -> list[list[np.ndarray]]:
    """For each image and component: the quantised DC of its blocks, in scan order."""
    groups: dict[tuple, list[int]] = defaultdict(list)
    for i, m in enumerate(images):
        layout = tuple((k, 1 if len(m.components) == 1 else m.components[k][1] * m.components[k][2], t) for k, t in m.scan)
        groups[layout, tuple(sorted(m.tables.items()))].append(i)
    out: list[list[np.ndarray]] = [[] for _ in images]
    for (layout, tables), members in groups.items():
        table = dict(tables)
        order = [(k, _lookup(table[t >> 4]), _lookup(table[0x10 | t & 15])) for k, n, t in layout for _ in range(n)]
        parts, mcus = [], []
        for i in members:
            rows, columns = images[i].mcus()
            total, step = rows * columns, images[i].interval or rows * columns
            if len(images[i].pieces) < -(-total // step):
                raise ValueError("a scan ends early")
            for k in range(-(-total // step)):
                parts.append(images[i].pieces[k])
                mcus.append(min(step, total - k * step))
        found = _lockstep(parts, np.array(mcus), order)
        at = 0
        for i in members:
            rows, columns = images[i].mcus()
            n = -(-rows * columns // (images[i].interval or rows * columns))
            every = np.concatenate([f for f in found[at : at + n]])
            at += n
            for c in range(len(images[i].components)):
                out[i].append(every[:, [j for j, (k, _, _) in enumerate(order) if k == c]].reshape(-1))
    return out


def _lockstep(parts: list[bytes], mcus: np.ndarray, order: list[tuple[int, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """DC values (mcus, blocks of an MCU) of each part; all parts advance together."""
    sizes = np.array([len(p) for p in parts], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + 12)))
    data = np.frombuffer(b"".join(x for p in parts for x in (p, b"\xff" * 12)), np.uint8)
    window = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    where = starts[:-1] * 8
    limit = (starts[1:] - 8) * 8 - 1
    by_length = np.argsort(-mcus, kind="stable")
    where, limit, left = where[by_length], limit[by_length], mcus[by_length]
    out = np.zeros((int(mcus.max()), len(order), len(parts)), np.int32)
    before = np.zeros((1 + max(k for k, _, _ in order), len(parts)), np.int64)

    def symbol(at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bits = window[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)
        got = table[(bits >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        return bits, got >> 8, got & 255

    for m in range(len(out)):
        n = int(np.searchsorted(-left, -m, side="left"))  # parts that still have an MCU
        at = where[:n]
        for j, (k, dc, ac) in enumerate(order):
            bits, length, size = symbol(at, dc)
            if not length.all():
                raise ValueError("a code is not in its table")
            value = ((bits << length.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
            value = np.where((size > 0) & (value < (1 << np.maximum(size - 1, 0))), value - (1 << size) + 1, value)
            before[k, :n] += value
            out[m, j, :n] = before[k, :n]
            at = at + length + size
            busy, place = np.arange(n), np.ones(n, np.int64)
            while len(busy):
                _, length, got = symbol(at[busy], ac)
                run, size = got >> 4, got & 15
                at[busy] += length + size
                if (at[busy] > limit[busy] + 8).any() or not length.all():
                    raise ValueError("a scan ends early")
                place[busy] = np.where(size > 0, place[busy] + run + 1, np.where(run == 15, place[busy] + 16, 64))
                busy = busy[place[busy] < 64]
        where[:n] = at
    back = np.empty(len(parts), np.int64)
    back[by_length] = np.arange(len(parts))
    return [out[: mcus[i], :, back[i]] for i in range(len(parts))]


def thumbnail(image: Image, dc: list[np.ndarray]) -> np.ndarray:
    """The luminance of each block of the first component, 0 to 255, rows by columns."""
    rows, columns = image.mcus()
    _, h, v, q = image.components[0]
    if len(image.components) == 1:
        h = v = 1
    grid = dc[0].reshape(rows, columns, v, h).transpose(0, 2, 1, 3).reshape(rows * v, columns * h)
    level = np.rint(grid * image.quantisers[q] / 8).astype(np.int64) + 128
    top = max(c[1] for c in image.components), max(c[2] for c in image.components)
    high, wide = -(-image.height * v // (8 * (top[1] if len(image.components) > 1 else 1))), -(-image.width * h // (8 * (top[0] if len(image.components) > 1 else 1)))
    return np.clip(level, 0, 255).astype(np.uint8)[:high, :wide]


def average_hash(pixels: np.ndarray) -> str:
    """64 bits in hex: which cells of an 8 x 8 grid of means are brighter than their mean."""
    cells = pixels.astype(np.int64)
    for axis in (0, 1):
        n = cells.shape[axis]
        edge = np.arange(8) * n // 8
        cells = np.add.reduceat(cells, edge, axis=axis) if n >= 8 else np.repeat(cells, 8, axis=axis).reshape(*(cells.shape[:axis]), n, 8, *(cells.shape[axis + 1 :])).sum(axis=axis)
    counts = [np.maximum(1, np.diff(np.append(np.arange(8) * n // 8, n))) if n >= 8 else np.full(8, n) for n in pixels.shape]
    means = cells / np.outer(*counts)
    return f"{int(''.join('1' if x else '0' for x in (means > means.mean()).reshape(-1)), 2):016x}"


def features(images: list[bytes]) -> list[tuple[np.ndarray, str]]:
    """For each image: its luminance thumbnail, and ``WxH:average hash:md5 of the thumbnail``."""
    parsed = [parse(x) for x in images]
    out = []
    for image, dc in zip(parsed, dc_values(parsed) if parsed else [], strict=True):
        small = thumbnail(image, dc)
        out.append((small, f"{image.width}x{image.height}:{average_hash(small)}:{hashlib.md5(small.tobytes()).hexdigest()}"))
    return out


def _payloads(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with the zeros appended, their offsets, unpadded sizes) of a text column."""
    buf, offsets = utf8(column)
    size = np.diff(offsets)
    room = np.maximum(ROW, -(-size // ROW) * ROW)
    ends = np.concatenate(([0], np.cumsum(room)))
    out = np.zeros(int(ends[-1]), np.uint8)
    out[np.arange(len(buf)) + np.repeat(ends[:-1] - offsets[:-1], size)] = buf
    return out, ends, size


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's bytes as a JPEG, or several for a very long one; null and empty texts are 64 zero bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, most=BLOCK_BYTES):
            data, ends, size = _payloads(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(encode_payloads(data, ends), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return spread(docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))).mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def digests(media: DataFrame) -> DataFrame:
    """Of (doc_id, n_bytes, media): what is read back from the stored bytes.

    A null id is passed on, repeated rows get equal rows, an empty table stays
    empty.  A text above 524 224 bytes is several images, coded and read one lot
    after the other; their features are joined by ``+``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            ends = np.cumsum(np.diff(np.frombuffer(whole.column(2).buffers()[1], np.int32)[whole.column(2).offset :][: whole.num_rows + 1]).astype(np.int64))
            begin = 0
            while begin < whole.num_rows:
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + BLOCK_BYTES, side="right")))
                b = whole.slice(begin, end - begin)
                begin = end
                stored = b.column(2).to_pylist()
                rows = []
                cut = [images_of(media) for media in stored]
                read = _read([image for images in cut for image in images])
                for media, images in zip(stored, cut, strict=True):
                    found = [next(read) for _ in images]
                    data = b"".join(x for x, _ in found)
                    rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), "+".join(x for _, x in found)))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]], names=_NAMES)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, _SCHEMA)


def _read(images: list[bytes]) -> Iterator[tuple[bytes, str]]:
    """(payload, feature) of each image."""
    for begin, end in _lots([len(x) for x in images]):
        for image, (small, feature) in zip(images[begin:end], features(images[begin:end]), strict=True):
            yield small.reshape(-1)[: int(parse_comment(image))].tobytes(), feature


_NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
_SCHEMA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def parse_comment(media: bytes) -> bytes:
    """The payload's size, from the comment that the encoder writes first."""
    (size,) = struct.unpack_from(">H", media, 4)
    return media[6 + len(b"payload ") : 4 + size]

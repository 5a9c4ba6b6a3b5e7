"""Code-intelligence indexes in the SCIP protobuf format, read from the wire format without generated classes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Field numbers of the published schema, and role bits.
INDEX_DOCUMENTS, INDEX_EXTERNAL = 2, 3
DOCUMENT_PATH, DOCUMENT_OCCURRENCES, DOCUMENT_SYMBOLS, DOCUMENT_LANGUAGE = 1, 2, 3, 4
OCCURRENCE_RANGE, OCCURRENCE_SYMBOL, OCCURRENCE_ROLES = 1, 2, 3
SYMBOL_NAME, SYMBOL_RELATIONS, SYMBOL_DISPLAY = 1, 4, 6
RELATION_SYMBOL = 1
DEFINITION, IMPORT, FORWARD = 0x1, 0x2, 0x40

ROWS = "what string, file string, language string, symbol string, name string, line int, target string, type string"


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message: whole numbers and byte strings; fixed-width values are skipped."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    while at < len(data):
        key = varint()
        number, kind = key >> 3, key & 7
        if kind == 0:
            yield number, varint()
        elif kind == 2:
            n = varint()
            yield number, data[at : at + n]
            at += n
        elif kind in (1, 5):
            at += 8 if kind == 1 else 4
        else:
            raise ValueError(f"wire type {kind}")


def _packed(data: bytes) -> list[int]:
    out, value, shift = [], 0, 0
    for b in data:
        value |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            out.append(value)
            value = shift = 0
    return out


def display_name(symbol: str) -> str:
    """The last descriptor of a symbol without its punctuation."""
    last = symbol.rstrip(".#/:()!").replace("`", "")
    for c in "/#.:":
        last = last.rsplit(c, 1)[-1]
    return last.split(" ")[-1].removesuffix("()") or symbol


def document_rows(data: bytes) -> list[dict]:
    """Definitions, references and relations of one document; paths that leave the repository give none."""
    parts: dict[int, list] = {}
    for number, value in fields(data):
        parts.setdefault(number, []).append(value)
    text = lambda n: parts.get(n, [b""])[0].decode()
    path, language = text(DOCUMENT_PATH).replace("\\", "/"), text(DOCUMENT_LANGUAGE).lower()
    if not path or path.startswith(("/", "../")) or "/../" in path or path == ".":
        return []
    rows = []
    base = {"file": path, "language": language, "target": "", "type": ""}
    for occurrence in parts.get(DOCUMENT_OCCURRENCES, []):
        got = dict(fields(occurrence))
        symbol = got.get(OCCURRENCE_SYMBOL, b"").decode()
        if not symbol:
            continue
        place = _packed(got.get(OCCURRENCE_RANGE, b"\0"))
        roles = got.get(OCCURRENCE_ROLES, 0)
        local = f"{path}:{symbol}" if symbol.startswith("local ") else symbol
        what = "definition" if roles & (DEFINITION | FORWARD) else "reference"
        rows.append(base | {"what": what, "symbol": local, "name": display_name(symbol), "line": (place[0] if place else 0) + 1, "type": "scip-imports" if roles & IMPORT else "references-symbol"})
    for info in parts.get(DOCUMENT_SYMBOLS, []):
        symbol, name, related = "", "", []
        for number, value in fields(info):
            if number == SYMBOL_NAME:
                symbol = value.decode()
            elif number == SYMBOL_DISPLAY:
                name = value.decode()
            elif number == SYMBOL_RELATIONS:
                related.append(dict(fields(value)))
        if symbol:
            rows.append(base | {"what": "symbol", "symbol": symbol, "name": name or display_name(symbol), "line": 1})
            rows += [base | {"what": "relation", "symbol": symbol, "name": "", "line": 1, "target": r[RELATION_SYMBOL].decode(), "type": "references-symbol"} for r in related if r.get(RELATION_SYMBOL) and len(r) > 1]
    return rows


def read_scip(spark: SparkSession, path: str) -> DataFrame:
    """ROWS of SCIP index files, each read in its own task."""
    names = [x.split()[0] for x in ROWS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                for number, value in fields(bytes(content)):
                    if number == INDEX_DOCUMENTS:
                        yield pd.DataFrame(document_rows(value), columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ROWS)


def scip_nodes(rows: DataFrame) -> DataFrame:
    """(id, name, kind, language, file, start_line): one node for each defined symbol."""
    defined = rows.filter("what = 'definition'").groupBy("symbol").agg(F.min(F.struct("file", "line", "language", "name")).alias("x"))
    return defined.select(F.concat(F.lit("scip:"), "symbol").alias("id"), "x.name", F.lit("symbol").alias("kind"), "x.language", "x.file", F.col("x.line").alias("start_line"))


def scip_edges(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, type, confidence, reason, file, line): references from the definition before them in the file, or from the file; and relations."""
    from pyspark.sql import Window

    known = nodes.select("id")
    placed = rows.filter("what in ('definition', 'reference')").withColumn("own", F.when(F.col("what") == "definition", F.concat(F.lit("scip:"), "symbol")))
    w = Window.partitionBy("file").orderBy("line", F.desc("own")).rowsBetween(Window.unboundedPreceding, 0)
    around = placed.withColumn("src", F.coalesce(F.last("own", ignorenulls=True).over(w), F.concat(F.lit("file:"), "file"))).filter("what = 'reference'")
    used = around.select("src", F.concat(F.lit("scip:"), "symbol").alias("dst"), "type", "file", "line")
    related = rows.filter("what = 'relation'").select(F.concat(F.lit("scip:"), "symbol").alias("src"), F.concat(F.lit("scip:"), "target").alias("dst"), "type", "file", "line")
    met = used.union(related).filter("src <> dst").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return met.select("src", "dst", "type", F.lit("exact").alias("confidence"), F.lit("").alias("reason"), "file", "line").distinct()

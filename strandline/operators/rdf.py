"""Terms of a vocabulary: resolve, compact, trace, list; literals and shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LOCAL = r"^[A-Za-z_0-9][A-Za-z0-9_.-]*$"


def resolve_terms(terms: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, status, id): each query by the first of three tiers with a match: IRI, prefixed term, local name.

    One match is found, several are ambiguous, none is not_found (with a null id).
    """
    q = queries.select("query")
    tier = lambda n, key: q.join(terms.select("id", F.col(key).alias("query")), "query").select("query", "id", F.lit(n).alias("tier"))
    met = tier(1, "iri").union(tier(2, "term")).union(tier(3, "local_name")).distinct()
    w = Window.partitionBy("query")
    best = met.withColumn("best", F.min("tier").over(w)).filter("tier = best").select("query", "id").distinct()
    counted = best.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    out = q.join(best, "query", "left").join(counted, "query", "left")
    return out.select("query", F.when(F.col("id").isNull(), "not_found").when(F.col("n") == 1, "found").otherwise("ambiguous").alias("status"), "id")


def compact_iris(iris: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(iri, term): the longest base first, then the longest prefix, then its name; the rest must be a valid local name."""
    p = prefixes.select("prefix", F.col("iri").alias("base"))
    # Bases have few lengths: an IRI meets them by its beginnings of those lengths.
    sizes = [r["n"] for r in p.select(F.length("base").alias("n")).distinct().collect()]
    begins = F.filter(F.array(*[F.when(F.length("iri") > n, F.substring("iri", 1, n)) for n in sizes]).cast("array<string>"), lambda x: x.isNotNull())
    met = iris.select("iri", F.explode(begins).alias("base")).join(p, "base")
    local = F.substr("iri", F.length("base") + 1)
    good = met.withColumn("local", local).filter(F.col("local").rlike(_LOCAL))
    best = good.groupBy("iri").agg(F.min(F.struct((-F.length("base")).alias("b"), (-F.length("prefix")).alias("p"), "prefix", "local")).alias("x"))
    return iris.select("iri").join(best, "iri", "left").select("iri", F.when(F.col("x").isNotNull(), F.concat_ws(":", "x.prefix", "x.local")).otherwise(F.col("iri")).alias("term"))


def trace_term(terms: DataFrame, references: DataFrame, term_id: str, weak: bool = False) -> DataFrame:
    """(file, line, kind, confidence): where a term is defined and referred to; weak references only on request."""
    own = terms.filter(F.col("id") == term_id).select(F.explode("locations").alias("x")).select("x.file", F.col("x.start_line").alias("line"), F.lit("definition").alias("kind"), F.lit("exact").alias("confidence"))
    refs = references.filter(F.col("term_id") == term_id).select("file", F.col("start_line").alias("line"), "kind", "confidence")
    return own.union(refs if weak else refs.filter("confidence <> 'weak'")).distinct().orderBy("file", "line")


def search_literal(literals: DataFrame, text: str, lang: str | None = None, same_case: bool = False) -> DataFrame:
    """Literals (file, line, value, lang) that hold ``text`` in any case: equal ones first, then shorter, then by place.

    Equal are those that differ in case alone; with ``same_case``, only those that are ``text`` itself.
    """
    low = F.lower("value")
    found = literals.filter(F.contains(low, F.lit(text.lower())))
    if lang:
        found = found.filter(F.lower("lang") == lang.lower())
    return found.withColumn("exact", F.col("value") == text if same_case else low == text.lower()).orderBy(F.desc("exact"), F.length("value"), "file", "line")


def containing_shapes(shapes: DataFrame, path: str) -> DataFrame:
    """Shapes (id, target_class, properties array<struct<path, node>>) with a property of that path."""
    return shapes.filter(F.exists("properties", lambda p: p["path"] == path))


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """Terms (iri, local_name, ...) that a query may mean, well-formed ones first, then shorter IRIs, then by name."""
    return candidates.orderBy(F.desc(well_formed(F.col("iri"), F.col("local_name"))), F.length("iri"), "iri")


def term_edges(edges: DataFrame, term_id: str) -> DataFrame:
    """Edges that start or end at a term, or whose target holds its id."""
    return edges.filter((F.col("src") == term_id) | F.contains("dst", F.lit(term_id)))


def term_counts(terms: DataFrame, references: DataFrame, edges: DataFrame, term_ids: DataFrame, weak: bool = False) -> DataFrame:
    """(id, usages, references, edges, status): how often each term (id) is used, referred to and linked; not_found without any."""
    refs = references if weak else references.filter("confidence <> 'weak'")
    used = terms.select("id", F.explode("locations").alias("x")).select("id", F.struct("x.file", "x.start_line").alias("x")).distinct().groupBy("id").agg(F.count(F.lit(1)).alias("usages"))
    named = refs.groupBy(F.col("term_id").alias("id")).agg(F.count(F.lit(1)).alias("references"))
    ends = edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("edges"))
    met = term_ids.select("id").join(used, "id", "left").join(named, "id", "left").join(ends, "id", "left").na.fill(0, ["usages", "references", "edges"])
    return met.withColumn("status", F.when(F.col("usages") + F.col("references") + F.col("edges") > 0, "found").otherwise("not_found"))


def grouped_by_file(traced: DataFrame, limit: int = 50) -> DataFrame:
    """(file, places): what ``trace_term`` gives, ``limit`` places at most, listed by file."""
    return traced.limit(limit).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "kind", "confidence"))).alias("places"))


def find_references(terms: DataFrame, references: DataFrame, nodes: DataFrame, edges: DataFrame, query: str, weak: bool = False) -> tuple[str, DataFrame]:
    """(status, (file, line, kind, confidence, via)): references to a term; to a symbol's calls where no term has the name.

    Several terms, or several symbols, are ambiguous and give the candidates' ids as ``via`` with no place.
    """
    from strandline.operators.lookup import find_symbols

    spark = terms.sparkSession
    schema = "file string, line int, kind string, confidence string, via string"
    tiers = (F.col("iri") == query, F.col("term") == query, F.col("local_name") == query)
    found: list = []
    for tier in tiers:
        found = terms.filter(tier).select("id").limit(50).collect()
        if found:
            break
    if len(found) > 1:
        return "ambiguous", spark.createDataFrame([(None, None, "term", None, r["id"]) for r in found], schema)
    if found:
        traced = trace_term(terms, references, found[0]["id"], weak)
        linked = term_edges(edges, found[0]["id"]).select("file", "line", "type", "confidence")
        rows = traced.filter("kind <> 'definition'").select("file", "line", "kind", "confidence")
        if not traced.isEmpty() or not linked.isEmpty():
            return "found", rows.withColumn("via", F.lit(found[0]["id"]))
    symbols = find_symbols(nodes, query).select("id").limit(50).collect()
    if len(symbols) != 1:
        status = "ambiguous" if symbols else "not_found"
        return status, spark.createDataFrame([(None, None, "symbol", None, r["id"]) for r in symbols], schema)
    calls = edges.filter((F.col("dst") == symbols[0]["id"]) & (F.col("type") == "calls"))
    return "found", calls.select("file", "line", F.lit("call").alias("kind"), "confidence", F.lit(symbols[0]["id"]).alias("via")).distinct()


def inspect_term(terms: DataFrame, references: DataFrame, lines: DataFrame, term_id: str, context: int = 2, limit: int = 10) -> DataFrame:
    """(file, start_line, end_line, why): where to read about a term: its references, and lines with a name that code derives from it."""
    row = terms.filter(F.col("id") == term_id).select("prefix", "local_name").first()
    if row is None:
        raise ValueError(f"no term {term_id!r}")
    refs = trace_term(terms, references, term_id).filter("kind <> 'definition'").select("file", "line", F.lit("reference").alias("why"))
    names = "|".join(derived_identifiers(row["prefix"] or "", row["local_name"]))
    hits = lines.filter(F.col("text").rlike(rf"(?<![A-Za-z0-9_])(?:{names})(?![A-Za-z0-9_])")).select("file", "line", F.lit("implementation").alias("why"))
    best = hits.orderBy("file", "line").limit(limit).unionByName(refs.orderBy("file", "line").limit(limit))
    return best.groupBy("file", "line").agg(F.min("why").alias("why")).select("file", F.greatest(F.col("line") - context, F.lit(1)).alias("start_line"), (F.col("line") + context).alias("end_line"), "why")


def list_terms(terms: DataFrame, prefix: str | None = None) -> DataFrame:
    return (terms if prefix is None else terms.filter(F.col("prefix") == prefix)).orderBy("term")


def well_formed(iri: Column, local: Column) -> Column:
    """Whether an IRI reads as base and local name: it ends in the name after ``#`` or ``/``."""
    return iri.rlike("^[a-z][a-z0-9+.-]*:") & (iri.endswith(F.concat(F.lit("#"), local)) | iri.endswith(F.concat(F.lit("/"), local)))


def derived_identifiers(prefix: str, local: str) -> list[str]:
    """Names that code may use for a term: prefix and local name joined in the usual ways."""
    head = local[:1].upper() + local[1:]
    snake = "".join(f"_{c}" if c.isupper() and i else c for i, c in enumerate(local)).upper()
    return list(dict.fromkeys([f"{prefix}{head}", f"{prefix.upper()}_{snake}", f"{prefix}_{local}", f"{prefix.upper()}{head}", local]))

"""Counts of a graph by language, package, file and degree, and its rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.text import directory
from strandline.model import rank


def languages(nodes: DataFrame) -> DataFrame:
    """(language, symbols, files)."""
    return nodes.groupBy("language").agg(F.count(F.lit(1)).alias("symbols"), F.count_distinct("file").alias("files"))


def packages(nodes: DataFrame, ranks: DataFrame, top: int = 3) -> DataFrame:
    """(package, files, symbols, rank, top_files): folders with the sum of their files' ranks (file, rank)."""
    per_file = nodes.groupBy("file").agg(F.count(F.lit(1)).alias("symbols")).join(ranks, "file", "left").select("file", "symbols", F.coalesce("rank", F.lit(0.0)).alias("rank"))
    per_file = per_file.withColumn("package", directory(F.col("file")))
    w = Window.partitionBy("package").orderBy(F.desc("rank"), "file")
    best = per_file.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top).groupBy("package").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "file"))), lambda x: x["file"]).alias("top_files"))
    found = per_file.groupBy("package").agg(F.count(F.lit(1)).alias("files"), F.sum("symbols").alias("symbols"), F.sum("rank").alias("rank"))
    return found.join(best, "package")


def degree(edges: DataFrame) -> DataFrame:
    """(id, inbound, outbound, degree)."""
    ends = edges.select(F.col("src").alias("id"), F.lit(0).alias("inbound"), F.lit(1).alias("outbound")).union(edges.select(F.col("dst"), F.lit(1), F.lit(0)))
    return ends.groupBy("id").agg(F.sum("inbound").alias("inbound"), F.sum("outbound").alias("outbound"), F.count(F.lit(1)).alias("degree"))


def top_neighbourhood(nodes: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """(id, degree, chosen): the ``n`` nodes of highest degree, and their neighbours."""
    ranked = degree(edges).join(nodes.select("id"), "id", "left_semi").orderBy(F.desc("degree"), "id").limit(n).select("id", F.lit(True).alias("chosen"))
    near = edges.join(ranked.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    near = near.union(edges.join(ranked.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))).distinct()
    found = ranked.union(near.join(nodes.select("id"), "id", "left_semi").select("id", F.lit(False))).groupBy("id").agg(F.max("chosen").alias("chosen"))
    return found.join(degree(edges).select("id", "degree"), "id").select("id", "degree", "chosen")


def rollup(nodes: DataFrame, edges: DataFrame, level: str) -> tuple[DataFrame, DataFrame]:
    """Groups by the column ``level`` (group, symbols, complexity, language) and the edges between them.

    The language is that of most symbols, the first by name on a tie.
    """
    counted = nodes.groupBy(F.col(level).alias("group"), "language").agg(F.count(F.lit(1)).alias("symbols"), F.sum("complexity").alias("complexity"))
    groups = counted.groupBy("group").agg(F.sum("symbols").alias("symbols"), F.sum("complexity").alias("complexity"), F.min(F.struct((-F.col("symbols")).alias("n"), "language")).alias("x"))
    side = lambda x: nodes.select(F.col("id").alias(x), F.col(level).alias(f"{x}_group"))
    between = edges.join(side("src"), "src").join(side("dst"), "dst").filter("src_group <> dst_group")
    links = between.groupBy("src_group", "dst_group").agg(F.count(F.lit(1)).alias("edges"), F.min(rank(F.col("confidence"))).alias("best_rank"))
    return groups.select("group", "symbols", "complexity", F.col("x.language").alias("language")), links


#: Edge types that tie files together.
FILE_EDGES = ("calls", "depends-on", "imports", "renders-component", "passes-prop", "binds-model", "listens-event", "handles-route", "calls-http-route", "references-symbol", "scip-imports")


def file_graph(nodes: DataFrame, edges: DataFrame, mentioned: dict[str, float] | None = None) -> DataFrame:
    """(src_file, dst_file, type, weight, edges) across files: each edge weighs by what its target's name tells.

    One, times one and the weight of a mention of the name; times ten for a long
    compound identifier, a tenth for a leading underscore, a tenth for a name
    defined more than five times; imports times 0.8.
    """
    defined = nodes.groupBy("name").agg(F.count(F.lit(1)).alias("definitions"))
    target = nodes.join(defined, "name").select(F.col("id").alias("dst"), F.col("file").alias("dst_file"), "name", "definitions")
    source = nodes.select(F.col("id").alias("src"), F.col("file").alias("src_file"))
    telling = (F.length("name") >= 8) & F.col("name").rlike(r"^[A-Za-z_][A-Za-z0-9_]*$") & F.col("name").rlike(r"[a-z0-9][A-Z]|[A-Za-z0-9]_[A-Za-z0-9]")
    telling = telling | (F.contains(F.col("name"), F.lit("-")) & (F.length("name") >= 8))
    said = F.lit(0.0)
    for term, w in (mentioned or {}).items():
        said = F.when(F.lower("name") == term, w).otherwise(said)
    weight = (F.lit(1.0) + said) * F.when(telling, 10.0).otherwise(1.0) * F.when(F.col("name").startswith("_"), 0.1).otherwise(1.0) * F.when(F.col("definitions") > 5, 0.1).otherwise(1.0)
    weight = weight * F.when(F.col("type").isin("imports", "scip-imports"), 0.8).otherwise(1.0)
    met = edges.filter(F.col("type").isin(*FILE_EDGES)).join(target, "dst").join(source, "src").filter("src_file <> dst_file").withColumn("w", weight)
    return met.groupBy("src_file", "dst_file", "type").agg(F.sum("w").alias("weight"), F.count(F.lit(1)).alias("edges"))


def cochange(commits: DataFrame, most_files: int = 50, peers: int = 10) -> DataFrame:
    """(file, peer, count): the files changed together most, by count and then by name.

    Commits of more than ``most_files`` files say nothing about pairs and are left out.
    """
    small = commits.groupBy("commit").count().filter(F.col("count") <= most_files).select("commit")
    pairs = commits.join(small, "commit", "left_semi").distinct()
    both = pairs.join(pairs.withColumnRenamed("file", "peer"), "commit").filter("file <> peer").groupBy("file", "peer").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("file").orderBy(F.desc("count"), "peer")
    return both.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= peers).drop("r")


def qualified_names(nodes: DataFrame, levels: int = 25) -> DataFrame:
    """(id, qualified_name, depth): names from the topmost parent down, by at most ``levels`` parents."""
    from strandline.runtime import Scratch

    scratch = Scratch(nodes.sparkSession, "names")
    parents = nodes.select(F.col("id").alias("p"), F.col("name").alias("pname"), F.col("parent_id").alias("next"))
    rows = scratch.put("n0", nodes.select("id", F.col("name").alias("qualified_name"), F.col("parent_id").alias("up"), F.lit(0).alias("depth")))
    done, k = [], 0
    while k < levels:
        k += 1
        met = rows.join(parents, F.col("up") == F.col("p"), "left")
        done.append(scratch.put(f"t{k}", met.filter("p is null").select("id", "qualified_name", "depth")))
        rows = scratch.put(f"n{k}", met.filter("p is not null").select("id", F.concat_ws(".", "pname", "qualified_name").alias("qualified_name"), F.col("next").alias("up"), F.lit(k).alias("depth")))
        if rows.isEmpty():
            break
    out = rows.select("id", "qualified_name", "depth")
    for x in done:
        out = out.union(x)
    return out

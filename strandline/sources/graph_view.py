"""A property graph over the star-schema tables: nodes, edges, commits, lines, hunks and coverage.

The tables hold no source code, so every table is a fixed projection that both
Spark and SQL can express; the operators do not know about it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.runtime import table

LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey")


def _id(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), key.cast("string"))


@dataclass(frozen=True)
class GraphView:
    """Lazily made tables of one input folder."""

    spark: SparkSession
    sf_dir: str

    def _table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def parts(self) -> DataFrame:
        """Parts as functions: size as complexity, brand as language, type and brand as the file."""
        p = self._table("part")
        start = (F.col("p_partkey") % 200 * 5 + 1).cast("int")
        return p.select(
            _id("part", F.col("p_partkey")).alias("id"), F.col("p_name").alias("name"), F.lit("part").alias("kind"), F.col("p_brand").alias("language"),
            F.concat_ws("/", "p_type", "p_brand").alias("file"), start.alias("start_line"), (start + F.col("p_size")).cast("int").alias("end_line"),
            F.concat(F.col("p_name"), F.lit("("), F.col("p_type"), F.lit(")")).alias("signature"), F.lit("exact").alias("confidence"),
            (F.col("p_partkey") % 3 == 0).alias("exported"), F.col("p_size").cast("int").alias("complexity"), (F.col("p_size") % 4).cast("int").alias("loop_depth"),
            (F.col("p_size") % 4).cast("int").alias("transitive_loop_depth"), (F.col("p_size") % 3).cast("int").alias("linear_scan_in_loop"), (F.col("p_size") % 5).cast("int").alias("alloc_in_loop"),
            (F.col("p_size") % 11 == 0).alias("recursion_in_loop"), F.concat(F.lit("file:"), F.col("p_type")).alias("parent_id"), (F.col("p_partkey") % 7 == 0).alias("is_test"),
        )

    def _plain(self, kind: str, source: DataFrame, key: str, name: str, language: Column, file: Column, parent: Column) -> DataFrame:
        zero = F.lit(0)
        return source.select(
            _id(kind, F.col(key)).alias("id"), F.col(name).cast("string").alias("name"), F.lit(kind).alias("kind"), language.alias("language"), file.alias("file"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"),
            F.col(name).cast("string").alias("signature"), F.lit("exact").alias("confidence"), F.lit(False).alias("exported"), zero.alias("complexity"), zero.alias("loop_depth"), zero.alias("transitive_loop_depth"),
            zero.alias("linear_scan_in_loop"), zero.alias("alloc_in_loop"), F.lit(False).alias("recursion_in_loop"), parent.alias("parent_id"), F.lit(False).alias("is_test"),
        )

    @cached_property
    def places(self) -> DataFrame:
        """Regions, nations, customers, suppliers and orders, each with its parent."""
        none = F.lit("")
        region = self._plain("region", self._table("region"), "r_regionkey", "r_name", none, F.lit("geo"), none)
        nation = self._plain("nation", self._table("nation"), "n_nationkey", "n_name", none, F.lit("geo"), _id("region", F.col("n_regionkey")))
        customer = self._plain("customer", self._table("customer"), "c_custkey", "c_name", F.col("c_mktsegment"), F.lit("people"), _id("nation", F.col("c_nationkey")))
        supplier = self._plain("supplier", self._table("supplier"), "s_suppkey", "s_name", none, F.lit("people"), _id("nation", F.col("s_nationkey")))
        order = self._plain("order", self._table("orders"), "o_orderkey", "o_orderkey", F.col("o_orderpriority"), F.lit("orders"), _id("customer", F.col("o_custkey")))
        return region.unionByName(nation).unionByName(customer).unionByName(supplier).unionByName(order)

    @cached_property
    def nodes(self) -> DataFrame:
        return self.parts.unionByName(self.places)

    @staticmethod
    def _confidence() -> Column:
        flag = F.col("l_returnflag")
        return F.when(F.col("l_suppkey") % 10 == 0, "unresolved").when(flag == "A", "exact").when(flag == "N", "scoped").otherwise("heuristic")

    @cached_property
    def calls(self) -> DataFrame:
        """Consecutive parts of an order; unresolved calls go to the callee's name."""
        w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
        line = self._table("lineitem").select("l_orderkey", *LINE_ORDER, "l_returnflag", F.lead("l_partkey").over(w).alias("next"))
        line = line.filter(F.col("next").isNotNull())
        names = self._table("part").select(F.col("p_partkey").alias("next"), F.col("p_name").alias("callee"))
        found = line.join(names, "next")
        unresolved = F.col("l_suppkey") % 10 == 0
        return found.select(
            _id("part", F.col("l_partkey")).alias("src"), F.when(unresolved, F.concat(F.lit("unresolved:"), F.col("callee"))).otherwise(_id("part", F.col("next"))).alias("dst"),
            F.lit("calls").alias("type"), self._confidence().alias("confidence"), F.when(unresolved, F.when(F.col("l_linenumber") % 2 == 0, "ambiguous_name").otherwise("dynamic_receiver")).otherwise("").alias("reason"),
            _id("order", F.col("l_orderkey")).alias("file"), F.col("l_linenumber").cast("int").alias("line"),
        )

    @cached_property
    def resolved_calls(self) -> DataFrame:
        """The calls with a node at the other end: (src, dst, confidence, file, line)."""
        w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
        line = self._table("lineitem").select("l_orderkey", *LINE_ORDER, "l_returnflag", F.lead("l_partkey").over(w).alias("next"))
        return line.filter(F.col("next").isNotNull() & (F.col("l_suppkey") % 10 != 0)).select(
            _id("part", F.col("l_partkey")).alias("src"), _id("part", F.col("next")).alias("dst"), F.lit("calls").alias("type"), self._confidence().alias("confidence"), F.lit("").alias("reason"),
            _id("order", F.col("l_orderkey")).alias("file"), F.col("l_linenumber").cast("int").alias("line"),
        )

    @cached_property
    def edges(self) -> DataFrame:
        """Calls, and who places, includes and supplies what."""
        orders, line = self._table("orders"), self._table("lineitem")

        def edge(source: DataFrame, src: Column, dst: Column, kind: str, confidence: Column, file: Column, at: Column) -> DataFrame:
            return source.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), confidence.alias("confidence"), F.lit("").alias("reason"), file.alias("file"), at.cast("int").alias("line"))

        order = _id("order", F.col("l_orderkey"))
        placed = edge(orders, _id("customer", F.col("o_custkey")), _id("order", F.col("o_orderkey")), "places", F.lit("exact"), _id("order", F.col("o_orderkey")), F.lit(1))
        included = edge(line, order, _id("part", F.col("l_partkey")), "includes", self._confidence(), order, F.col("l_linenumber"))
        supplied = edge(line, _id("supplier", F.col("l_suppkey")), _id("part", F.col("l_partkey")), "supplies", self._confidence(), order, F.col("l_linenumber"))
        return self.calls.unionByName(placed).unionByName(included).unionByName(supplied)

    @cached_property
    def commits(self) -> DataFrame:
        """Orders as commits of the parts they include."""
        line = self._table("lineitem")
        return line.select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file")).distinct()

    @cached_property
    def hunks(self) -> DataFrame:
        """Changed line ranges: two lines of every 50th part's file."""
        p = self.parts.filter(F.expr("try_cast(substring(id, 6, 20) as bigint) % 50 = 0"))
        return p.select("file", (F.col("start_line") + 2).alias("start_line"), (F.col("start_line") + 4).alias("end_line")).distinct()

    @cached_property
    def coverage(self) -> DataFrame:
        """Hits per line of a part's file, from line items."""
        line = self._table("lineitem").select(F.col("l_partkey"), (F.col("l_linenumber") * 3).cast("int").alias("offset"), F.col("l_quantity").alias("q"))
        part = self._table("part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws("/", "p_type", "p_brand").alias("file"), (F.col("p_partkey") % 200 * 5 + 1).cast("int").alias("start"))
        hits = line.join(part, "l_partkey").select("file", (F.col("start") + F.col("offset")).alias("line"), F.when(F.col("q") > 25, 1).otherwise(0).alias("hits"))
        return hits.groupBy("file", "line").agg(F.sum("hits").alias("hits"))

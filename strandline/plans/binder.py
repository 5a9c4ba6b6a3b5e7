"""From a syntax tree to one DataFrame over nodes and edges.

Labels, edge types and every test on a variable are applied where the variable
is bound, so that Catalyst can push them into the scans; the rows of a hop are an
inner join by the edge's source and target.  A variable that is bound again
takes the later node.  Tests that can never hold (unknown variable or field,
impossible comparison) become false when the plan is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators.traverse import reachable
from strandline.plans.syntax import Item, Statement, Test, parse

#: The fields of a node that a query may name, as columns; spelling is free of case and underscores.
FIELDS = (
    "id", "name", "kind", "language", "file", "start_line", "end_line", "signature", "confidence", "exported", "complexity",
    "loop_depth", "transitive_loop_depth", "linear_scan_in_loop", "alloc_in_loop", "recursion_in_loop",
)
#: Fields whose name may also be written with underscores.
_SNAKE = FIELDS[FIELDS.index("loop_depth") :]
_COLUMN = {f.replace("_", ""): f for f in FIELDS} | {f: f for f in _SNAKE} | {"label": "kind"}


def column_of(field: str) -> str | None:
    return _COLUMN.get(field.lower())


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def holds(value: Column, kind: T.DataType, op: str, text: str) -> Column:
    """The comparison of one field as a condition."""
    if isinstance(kind, T.StringType):
        low = F.lower(value)
        if op == "IN":
            return low.isin([x.strip().lower() for x in text.split("|")])
        return {"=": low == text.lower(), "!=": low != text.lower(), "CONTAINS": low.contains(text.lower())}.get(op, F.lit(False))
    if isinstance(kind, T.BooleanType):
        wanted = F.lit(text.lower() == "true")
        return {"=": value == wanted, "!=": value != wanted}.get(op, F.lit(False))
    number = _number(text)
    if number is None:
        return F.lit(False)
    x = F.lit(number)
    return {"=": value == x, "!=": value != x, ">": value > x, ">=": value >= x, "<": value < x, "<=": value <= x}.get(op, F.lit(False))


class _Bound:
    """The rows so far: for each variable its id and the fields that the query names."""

    def __init__(self, statement: Statement, nodes: DataFrame, edges: DataFrame):
        self.statement, self.nodes, self.edges = statement, nodes, edges
        self.types = {f.name: f.dataType for f in nodes.schema.fields}
        asked = [*statement.items, *[t.item for t in statement.tests], *([statement.order] if statement.order else [])]
        self.fields: dict[str, set[str]] = {}
        for item in asked:
            if column := column_of(item.field):
                self.fields.setdefault(item.var, set()).add(column)
        # Only the last binding of a variable is tested.
        names = [statement.start.var, *[h.node.var for h in statement.hops]]
        self.last = {v: len(names) - 1 - names[::-1].index(v) for v in names}
        self.rows: DataFrame

    def scan(self, place: int) -> DataFrame:
        """The nodes that may stand at ``place``, with the columns named after the variable."""
        node = self.statement.start if place == 0 else self.statement.hops[place - 1].node
        found = self.nodes
        if node.kind is not None:
            found = found.filter(F.lower("kind") == node.kind.lower())
        for test in self.statement.tests if self.last[node.var] == place else ():
            if test.item.var == node.var:
                found = found.filter(self.condition(test))
        columns = sorted({"id"} | self.fields.get(node.var, set()))
        return found.select(*[F.col(c).alias(f"{node.var}.{c}") for c in columns])

    def condition(self, test: Test) -> Column:
        column = column_of(test.item.field)
        return F.lit(False) if column is None else holds(F.col(column), self.types[column], test.op, test.value)

    def matched(self) -> DataFrame:
        s = self.statement
        rows, before = self.scan(0), s.start.var
        for place, hop in enumerate(s.hops, 1):
            edges = self.edges.filter(F.lower("type") == hop.type.lower()).select("src", "dst")
            if not hop.fixed:
                starts = rows.select(F.col(f"`{before}.id`").alias("node")).distinct()
                reached = reachable(edges, starts, hop.high).filter(F.col("depth") >= hop.low)
                edges = reached.select(F.col("start").alias("src"), F.col("node").alias("dst"))
            target = self.scan(place)
            var = hop.node.var
            rows = rows.join(edges.withColumnsRenamed({"src": "_src", "dst": "_dst"}), F.col(f"`{before}.id`") == F.col("_src"))
            rows = rows.drop(*[c for c in rows.columns if c.startswith(f"{var}.")])
            rows = rows.join(target, F.col("_dst") == F.col(f"`{var}.id`")).drop("_src", "_dst")
            before = var
        if any(t.item.var not in self.last for t in s.tests):
            rows = rows.filter(F.lit(False))
        return rows

    def value(self, item: Item) -> Column:
        column = column_of(item.field)
        if column is None or item.var not in self.last:
            return F.lit(None).cast("string")
        return F.col(f"`{item.var}.{column}`")

    def kind(self, item: Item) -> T.DataType | None:
        column = column_of(item.field)
        return None if column is None or item.var not in self.last else self.types[column]

    def aggregate(self, item: Item) -> Column:
        """Sums and means take numbers only; counts take rows, whatever the field."""
        value, kind = self.value(item), self.kind(item)
        numeric = isinstance(kind, T.NumericType)
        match item.aggregate:
            case "COUNT":
                return F.count(F.lit(1))
            case "SUM":
                return F.coalesce(F.sum(value), F.lit(0)).cast("bigint") if numeric else F.max(F.lit(0)).cast("bigint")
            case "AVG":
                return F.avg(value) if numeric else F.max(F.lit(None).cast("double"))
            case "MIN":
                return F.min(value)
            case "MAX":
                return F.max(value)
            case _:  # the order of rows is no order in Spark: the list comes sorted
                return F.array_sort(F.collect_list(value))


def _sorted(order: Column, descending: bool) -> Column:
    return order.desc_nulls_last() if descending else order.asc_nulls_first()


def compile_query(statement: Statement, nodes: DataFrame, edges: DataFrame, most_rows: int | None = None) -> DataFrame:
    """The answer of ``statement``; columns are titled as the items are written.

    Ties of ORDER BY are broken by the group keys, or by the node ids.  All rows are
    given but for LIMIT, and for ``most_rows`` where a caller wants no more.
    """
    b = _Bound(statement, nodes, edges)
    rows = b.matched()
    items = statement.items
    order = statement.order
    if any(i.aggregate for i in items):
        keys = [i for i in items if i.aggregate is None]
        made = {i.title: b.aggregate(i).alias(i.title) for i in items if i.aggregate}
        if keys:
            rows = rows.groupBy(*{k.title: b.value(k).alias(k.title) for k in keys}.values()).agg(*made.values())
        else:
            rows = rows.agg(*made.values())
        columns = [F.col(f"`{title}`").asc_nulls_first() for title in dict.fromkeys(k.title for k in keys)]
        if order is not None and any(order.title == i.title for i in items):
            columns.insert(0, _sorted(F.col(f"`{order.title}`"), statement.descending))
        if columns:
            rows = rows.orderBy(*columns)
        out = rows.select(*[F.col(f"`{i.title}`") for i in items])
    else:
        ids = [F.col(f"`{v}.id`").asc() for v in dict.fromkeys([statement.start.var, *[h.node.var for h in statement.hops]])]
        first = [_sorted(b.value(order), statement.descending)] if order is not None else []
        out = rows.orderBy(*first, *ids).select(*[b.value(i).alias(i.title) for i in items])
    limits = [n for n in (most_rows, statement.limit) if n is not None]
    return out.limit(min(limits)) if limits else out


def query_graph(text: str, nodes: DataFrame, edges: DataFrame, most_rows: int | None = None) -> DataFrame:
    """The answer of a query; QuerySyntaxError if ``text`` is none."""
    return compile_query(parse(text), nodes, edges, most_rows)


def query_total(text: str, nodes: DataFrame, edges: DataFrame, most_rows: int | None = None) -> tuple[int, bool]:
    """(rows before LIMIT and ``most_rows``, whether the latter cuts them)."""
    statement = parse(text)
    b = _Bound(statement, nodes, edges)
    rows = b.matched()
    keys = [b.value(i) for i in statement.items if i.aggregate is None]
    if any(i.aggregate for i in statement.items):
        total = rows.select(*[k.alias(f"k{j}") for j, k in enumerate(keys)]).distinct().count() if keys else 1
    else:
        total = rows.count()
    return total, most_rows is not None and total > most_rows

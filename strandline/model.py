"""The version of the graph's tables, and the order of confidences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA_VERSION = 1

#: Confidences from strongest to weakest; a path is as weak as its weakest edge.
CONFIDENCES = ("exact", "scoped", "heuristic", "unresolved")


def rank(confidence: Column) -> Column:
    """1 for the strongest confidence to 4 for the weakest; anything unknown is weakest."""
    out = F.lit(len(CONFIDENCES))
    for k, name in reversed(list(enumerate(CONFIDENCES[:-1], 1))):
        out = F.when(confidence == name, k).otherwise(out)
    return out


def confidence_of(rank_column: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in CONFIDENCES]), rank_column)

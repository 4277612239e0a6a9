"""Choosing one of several candidates for an identity, with an audit of each decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A candidate with this many times the articles, and so many more, wins before any other criterion.
TIMES, MORE = 3, 20
#: The tier of a candidate without one.
WORST_TIER = 4


def wins(new: Column, old: Column) -> Column:
    """Whether ``new`` replaces ``old``: overwhelming size first, then the first criterion that differs; a tie keeps the old.

    Candidates are structs of tier (the smaller, the better), complete, quality,
    articles, hierarchy and length; a null counts as the least.
    """
    value = lambda c, name: F.coalesce(c[name].cast("double"), F.lit(0.0))
    much = lambda a, b: (value(a, "articles") >= TIMES * F.greatest(value(b, "articles"), F.lit(1.0))) & (value(a, "articles") - value(b, "articles") >= MORE)
    tier = lambda c: F.coalesce(c["tier"], F.lit(WORST_TIER))
    decided = F.when(much(new, old), True).when(much(old, new), False).when(tier(new) != tier(old), tier(new) < tier(old))
    for name in ("complete", "quality", "articles", "hierarchy", "length"):
        decided = decided.when(value(new, name) != value(old, name), value(new, name) > value(old, name))
    return decided.otherwise(False)


def ordered_fold(rows: DataFrame) -> DataFrame:
    """Rows of k, order and candidate c: each group's survivor, members and number of replacements.

    The comparator isn't transitive, so the candidates of a group are folded in
    order; candidates are small structs, and a group is one identity's documents.
    """
    groups = rows.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("order", "c"))).alias("g"))
    start = F.struct(F.get("g", F.lit(0))["c"].alias("c"), F.lit(0).alias("replaced"))
    step = lambda a, x: F.struct(F.when(wins(x["c"], a["c"]), x["c"]).otherwise(a["c"]).alias("c"), (a["replaced"] + wins(x["c"], a["c"]).cast("int")).alias("replaced"))
    folded = F.aggregate(F.slice("g", 2, F.greatest(F.size("g") - 1, F.lit(0))), start, step)
    return groups.withColumn("f", folded).select("k", F.col("f.c.id").alias("survivor"), F.size("g").cast("long").alias("members"), F.col("f.replaced").cast("long").alias("replaced"))

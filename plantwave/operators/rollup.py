"""Weighted means, roll-ups over hours, days and months, and over the plant tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.signals import LEVEL_WEIGHTS, rank_of

GRADES = ("A", "B", "C", "D", "E")


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mean_all_rows(v: Column | str, w: Column | str) -> Column:
    """W1: a null weight is 1, a null value stays in the denominator."""
    weight = F.coalesce(c(w), F.lit(1.0))
    total = F.sum(weight)
    return F.when(total != 0, F.sum(c(v) * weight) / total)


def mean_level(v: Column | str, level: Column | str) -> Column:
    """W2: importance levels as weights, all rows in the denominator, half-even to 0.01; null if all values are."""
    weight = F.lit(1.0)
    for k, x in LEVEL_WEIGHTS.items():
        weight = F.when(c(level) == k, x).otherwise(weight)
    return F.when(F.count(c(v)) > 0, F.bround(F.sum(c(v) * weight) / F.sum(weight), 2))


def mean_present(v: Column | str, w: Column | str) -> Column:
    """W3: only rows with a value; weights of zero fall back to the plain mean."""
    total = F.sum(F.when(c(v).isNotNull(), c(w)))
    return F.when(total != 0, F.sum(F.when(c(v).isNotNull(), c(v) * c(w))) / total).otherwise(F.avg(c(v)))


def mean_filtered(v: Column | str, n: Column | str) -> Column:
    """W4: per value the counts of rows that have it."""
    total = F.sum(F.when(c(v).isNotNull(), c(n)))
    return F.when(total != 0, F.sum(c(v) * c(n)) / total)


def mean_valid(v: Column | str, valid: Column | str) -> Column:
    """W5: weighted by valid share; shares of zero weigh alike."""
    total = F.sum(F.when(c(v).isNotNull(), F.coalesce(c(valid), F.lit(0.0))))
    return F.when(total > 0, F.sum(c(v) * F.coalesce(c(valid), F.lit(0.0))) / total).otherwise(F.avg(c(v)))


def mean_conclusive(v: Column | str, level: Column | str, confidence: Column | str) -> Column:
    """W6: level weights over rows whose confidence is not E."""
    weight = F.lit(1.0)
    for k, x in LEVEL_WEIGHTS.items():
        weight = F.when(c(level) == k, x).otherwise(weight)
    counts = (c(confidence) != "E") & c(v).isNotNull()
    total = F.sum(F.when(counts, weight))
    return F.when(total > 0, F.sum(F.when(counts, c(v) * weight)) / total)


def worst(confidence: Column | str) -> Column:
    return F.element_at(F.array(*map(F.lit, GRADES)), F.max(rank_of(confidence, GRADES)) + 1)


def period_rollup(hours: DataFrame, keys: list[str], ts: str, period: str, values: list[str], count: str = "loop_count", last: str | None = None) -> DataFrame:
    """Days or months of snapshots: count-weighted means, largest count, last value of the period."""
    grouped = hours.groupBy(*keys, F.date_trunc(period, ts).alias("period"))
    extra = [F.max_by(last, ts).alias(last)] if last else []
    return grouped.agg(*(mean_present(v, count).alias(v) for v in values), F.max(count).alias(count), *extra)


def descendants(nodes: DataFrame, view: str = "_plant_nodes") -> DataFrame:
    """(root, node) for every node and all below it, itself included, by a recursive query over (id, parent_id)."""
    nodes.select("id", "parent_id").createOrReplaceTempView(view)
    return nodes.sparkSession.sql(
        f"""with recursive tree(root, node) as (
        select id, id from {view} union all select t.root, n.id from tree t join {view} n on n.parent_id = t.node)
        select root, node from tree"""
    )


def representatives(loops: DataFrame, group: str, role: str, confidence: str, unique: str) -> DataFrame:
    """A complex group counts once: its MAIN loop, else the most certain one; loops without a group all count."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(F.when(F.col(role) == "MAIN", 0).otherwise(1), F.asc_nulls_last(rank_of(confidence, GRADES)), unique)
    ranked = loops.where(F.col(group).isNotNull()).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return ranked.unionByName(loops.where(F.col(group).isNull()))

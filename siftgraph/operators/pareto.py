"""Pareto fronts, hypervolume, inverted generational distance.

Points are (group columns, fr, er), both to be small. Windows over a group first
see one row for each fr (its least er), which a partial aggregate makes.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_finite

TOLERANCE = 1e-12


def front(points: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, fr, er): points that improve er by more than the tolerance over all of smaller fr."""
    rows = points.where(is_finite(F.col("fr")) & is_finite(F.col("er"))).groupBy(*groups, "fr").agg(F.min("er").alias("er"))
    before = W.partitionBy(*groups).orderBy("fr").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("best", F.min("er").over(before))
    return rows.where(F.col("best").isNull() | (F.col("er") < F.col("best") - TOLERANCE)).select(*groups, "fr", "er")


def dominance_front(points: DataFrame, groups: list[str]) -> DataFrame:
    """All points that no other point of the group dominates; exact duplicates stay."""
    best = front(points, groups).withColumnRenamed("fr", "f0").withColumnRenamed("er", "e0")
    # A point is dominated if one of the front is as good in both and better in one: the last front point not right of it.
    steps = best.withColumn("next", F.lead("f0").over(W.partitionBy(*groups).orderBy("f0")))
    rows = points.where(is_finite(F.col("fr")) & is_finite(F.col("er"))).join(steps, groups)
    rows = rows.where((F.col("fr") >= F.col("f0")) & (F.col("next").isNull() | (F.col("fr") < F.col("next"))))
    return rows.where((F.col("fr") == F.col("f0")) & (F.col("er") == F.col("e0"))).drop("f0", "e0", "next")


def hypervolume(points: DataFrame, groups: list[str], ref: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(groups, hv): area that the front dominates within the reference point; 0 for groups without such points."""
    f = front(points, groups)
    inside = f.where((F.col("fr") < ref[0]) & (F.col("er") < ref[1]))
    left = F.coalesce(F.lag("er").over(W.partitionBy(*groups).orderBy("fr")), F.lit(float(ref[1])))
    areas = inside.withColumn("a", (F.lit(float(ref[0])) - F.col("fr")) * (left - F.col("er"))).groupBy(*groups).agg(F.sum("a").alias("hv"))
    return points.select(*groups).distinct().join(areas, groups, "left").select(*groups, F.coalesce("hv", F.lit(0.0)).alias("hv"))


def igd(points: DataFrame, groups: list[str], reference: DataFrame, keys: list[str], p: float = 2.0) -> DataFrame:
    """(groups, igd): mean over the reference front of keys of the least p-norm distance to the group's front.

    Either front empty gives no row. Fronts have at most one point for each subset size.
    """
    own = front(points, groups)
    ref = reference.select(*keys, F.col("fr").alias("rf"), F.col("er").alias("re"))
    d = F.pow(F.pow(F.abs(F.col("fr") - F.col("rf")), F.lit(p)) + F.pow(F.abs(F.col("er") - F.col("re")), F.lit(p)), F.lit(1.0 / p))
    least = own.join(ref, keys).withColumn("d", d).groupBy(*groups, "rf", "re").agg(F.min("d").alias("d"))
    return least.groupBy(*groups).agg(F.avg("d").alias("igd"))


def median_run(hv: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, run, hv): the run whose hypervolume is nearest the group's median; the smallest run of ties."""
    mid = hv.groupBy(*groups).agg(F.percentile("hv", F.lit(0.5)).alias("mid"))
    rows = hv.join(mid, groups)
    best = F.min_by(F.struct("run", "hv"), F.struct(F.abs(F.col("hv") - F.col("mid")), F.col("run")))
    return rows.groupBy(*groups).agg(best.alias("b")).select(*groups, "b.run", "b.hv")


def _front_numbers(fr: list[float], er: list[float]) -> list[int]:
    """Front numbers from 1 of one population: one more than the largest of those that dominate a point."""
    least: list[float] = []  # of each front so far the least er; they increase
    out = [0] * len(fr)
    last: tuple = ()
    for i in sorted(range(len(fr)), key=lambda i: (fr[i], er[i])):
        if (fr[i], er[i]) == last[:2]:  # equal points share a front
            out[i] = last[2]
            continue
        k = bisect.bisect_right(least, er[i])
        if k == len(least):
            least.append(er[i])
        else:
            least[k] = er[i]
        out[i] = k + 1
        last = (fr[i], er[i], k + 1)
    return out


def ranks(points: DataFrame, groups: list[str], key: str) -> DataFrame:
    """(groups, key, fr, er, rank): front numbers from 1. A group is one search's population and small."""
    schema = points.select(*groups, key, "fr", "er").schema

    def run(frame):
        return frame.assign(rank=_front_numbers(frame["fr"].tolist(), frame["er"].tolist()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return points.select(*groups, key, "fr", "er").groupBy(*groups).applyInPandas(run, f"{fields}, rank int")


def crowding(ranked: DataFrame, groups: list[str], key: str, objectives: tuple[str, ...] = ("fr", "er")) -> DataFrame:
    """(groups, key, rank, crowd): per front the sum of scaled gaps between neighbours; ends, and fronts without a range, are infinite."""
    rows, total = ranked, F.lit(0.0)
    for f in objectives:
        w = W.partitionBy(*groups, "rank").orderBy(f, key)
        all_ = W.partitionBy(*groups, "rank")
        span = F.max(f).over(all_) - F.min(f).over(all_)
        gap = F.lead(f).over(w) - F.lag(f).over(w)
        total = total + F.when((span > 0) & gap.isNotNull(), gap / span).otherwise(float("inf"))
    return rows.withColumn("crowd", total).select(*groups, key, "rank", "crowd")

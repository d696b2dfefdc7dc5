"""Maximal runs of ids, as rows (start, stop), both ends in."""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rank import with_rank

#: Last address of the space.
LAST = (1 << 48) - 2


def islands(a: DataFrame) -> DataFrame:
    """An id less its global rank is the same all along a run, across blocks too."""
    runs = with_rank(a).groupBy((F.col("id") - F.col("rank")).alias("g"))
    return runs.agg(F.min("id").alias("start"), F.max("id").alias("stop")).select("start", "stop")


def expand(runs: DataFrame) -> DataFrame:
    return runs.select(F.explode(F.sequence("start", "stop")).alias("id")).distinct()


def go_to(a: DataFrame, pos: int, extend: bool = True) -> DataFrame:
    """The run at or after pos; unless extended its start is cut to pos."""
    at = islands(a).filter(F.col("stop") >= pos).orderBy("start").limit(1)
    return at if extend else at.select(F.greatest("start", F.lit(pos).cast("long")).alias("start"), "stop")


def is_interval(a: DataFrame, left: int, right: int) -> DataFrame:
    """One row: is [left, right] exactly a run?"""
    left, right = (left, right) if left <= right else (right, left)
    return islands(a).filter((F.col("start") == left) & (F.col("stop") == right)).agg((F.count("*") > 0).alias("is_interval"))


def around(a: DataFrame, pos: int) -> DataFrame:
    """The run that holds pos, no row if none: interval start and end search."""
    return islands(a).filter((F.col("start") <= pos) & (F.col("stop") >= pos))


def around_many(a: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe, start, stop) for the probes that are members; a probe's run is found by its id and its global rank."""
    ranked = with_rank(a).withColumn("g", F.col("id") - F.col("rank"))
    runs = ranked.groupBy("g").agg(F.min("id").alias("start"), F.max("id").alias("stop"))
    hits = ranked.join(probes.select(F.col("id").alias("probe")).distinct(), F.col("id") == F.col("probe")).select("probe", "g")
    return hits.join(runs, "g").select("probe", "start", "stop")


class Plane:
    """Runs of one plane. Proper ones overlap nothing, so their starts and stops ascend together; odd ones (a NULL end, stop before start) are looked at one by one."""

    __slots__ = ("starts", "stops", "odd")

    def __init__(self):
        self.starts, self.stops, self.odd = [], [], []

    def free(self, s, e) -> bool:
        at = bisect_right(self.starts, e)
        return (not at or self.stops[at - 1] < s) and all(e < x or s > y for x, y in self.odd)

    def free_of_all(self, s, e) -> bool:
        """The same for an odd run."""
        return all(e < x or s > y for x, y in zip(self.starts, self.stops)) and all(e < x or s > y for x, y in self.odd)

    def put(self, s, e, odd: bool) -> None:
        if odd:
            self.odd.append((s, e))
        else:
            at = bisect_right(self.starts, s)
            self.starts.insert(at, s)
            self.stops.insert(at, e)


#: Stands for a NULL end: neither below nor above anything.
NO_END = float("nan")


def lay_out(runs: DataFrame, group: str) -> DataFrame:
    """First-fit layout inside each group, in order of `ord`: the first plane where (start, stop) overlaps nothing.

    Each placement depends on those before it, so a group is placed in one task. A task's groups come as one sorted
    stream and only the planes of the group at hand are held. A NULL end is never beyond or before another run's end; NULL
    `ord`, start and stop come last.
    """

    def place(batches):
        last, planes = None, None
        for batch in batches:
            keys, starts, stops = (batch.column(k).to_pylist() for k in range(3))
            out = []
            for key, s, e in zip(keys, starts, stops):
                if planes is None or key != last and (key == key or last == last):  # a NaN is the same group as a NaN
                    last, planes = key, []
                odd = s is None or e is None or e < s
                if odd:
                    s, e = NO_END if s is None else s, NO_END if e is None else e
                for k, plane in enumerate(planes):
                    if plane.free_of_all(s, e) if odd else plane.free(s, e):
                        break
                else:
                    k, plane = len(planes), Plane()
                    planes.append(plane)
                plane.put(s, e, odd)
                out.append(k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [group, "start", "stop", "plane"])

    kind = runs.schema[group].dataType.simpleString()
    order = [group, *(F.col(c).asc_nulls_last() for c in ("ord", "start", "stop"))]
    rows = runs.select(group, "ord", "start", "stop").repartition(group).sortWithinPartitions(*order)
    return rows.select(group, F.col("start").cast("long"), F.col("stop").cast("long")).mapInArrow(place, f"{group} {kind}, start long, stop long, plane long")


def splice(layers: DataFrame, left: int, right: int) -> DataFrame:
    """Layered runs (plane, start, stop) that touch [left, right], whole, with empty planes closed up."""
    kept = layers.filter((F.col("start") <= right) & (F.col("stop") >= left))
    planes = kept.select("plane").distinct().withColumn("_new", F.row_number().over(Window.orderBy("plane")) - 1)
    return kept.join(planes, "plane").select(F.col("_new").cast("long").alias("plane"), "start", "stop")

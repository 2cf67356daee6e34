"""Spike-train analytics: inter-event intervals, coincidences and correlograms.

A train is a DataFrame with a unit column and an integer sample column ``idx``. Everything here is an equi-join or a
window keyed by unit; coincidence within a tolerance is an equi-join on buckets as wide as the tolerance, never a
comparison of all pairs.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxweave.operators.signal import halo


def intervals(train: DataFrame, unit: str = "unit") -> DataFrame:
    """``train`` with ``isi``, the distance to the event before in the unit (null for the first)."""
    order = Window.partitionBy(unit).orderBy("idx")
    return train.withColumn("isi", F.col("idx") - F.lag("idx").over(order))


def firing_rate(n: Column, first: Column, last: Column, fs: float) -> Column:
    """Events a second between the first and last event; 0 if these coincide."""
    return F.when(last > first, fs * n / (last - first)).otherwise(0.0)


def isi_report(train: DataFrame, fs: float, duplicate: int, refractory: int, unit: str = "unit") -> DataFrame:
    """One row a unit: n, firing_rate, n_duplicate, n_violation, violation_rate, fraction_mua.

    The violation rate is events closer than ``refractory`` but farther than ``duplicate``, by the time in which they
    could occur; null where that time is empty or no event is left. fraction_mua divides it by the firing rate.
    """
    isi = F.col("isi")
    counts = intervals(train, unit).groupBy(unit).agg(
        F.count("*").alias("n"),
        F.min("idx").alias("first"),
        F.max("idx").alias("last"),
        F.count_if(isi <= duplicate).alias("n_duplicate"),
        F.count_if(isi < refractory).alias("n_close"),
    )
    rate = firing_rate(F.col("n"), F.col("first"), F.col("last"), fs)
    left = F.col("n") - F.col("n_duplicate")
    span = (refractory - duplicate) / fs
    violations = F.col("n_close") - F.col("n_duplicate")
    violation_rate = F.when((left > 0) & F.lit(span > 0), violations / F.lit(span if span > 0 else 1.0) / left)
    return counts.select(
        unit, "n", rate.alias("firing_rate"), "n_duplicate", violations.alias("n_violation"), violation_rate.alias("violation_rate"),
        F.when(rate == 0, 0.0).otherwise(violation_rate / rate).alias("fraction_mua"),
    )


def isi_histogram(train: DataFrame, start: int, width: int, bins: int, unit: str = "unit") -> DataFrame:
    """(unit, bin, n) of intervals in [start, start + bins * width]; the last bin is closed on the right."""
    isi = F.col("isi")
    inside = intervals(train, unit).where((isi >= start) & (isi <= start + bins * width))
    place = F.least(F.floor((isi - start) / width), F.lit(bins - 1)).cast("int")
    return inside.groupBy(unit, place.alias("bin")).agg(F.count("*").alias("n"))


def mua_to_peak(train: DataFrame, duplicate: int, refractory: int, window: int, unit: str = "unit", silent: bool = True) -> DataFrame:
    """(unit, mua_to_peak): first bin over highest bin of the interval histogram; null if bins would be empty.

    A unit without any interval in the histogram has 0, or no row if not ``silent``.
    """
    width = refractory - duplicate
    units = train.select(unit).distinct()
    if width <= 0:
        return units.withColumn("mua_to_peak", F.lit(None).cast("double"))
    bins = max(1, (window - duplicate) // width)
    found = isi_histogram(train, duplicate, width, bins, unit).groupBy(unit).agg(F.max("n").alias("peak"), F.coalesce(F.max(F.when(F.col("bin") == 0, F.col("n"))), F.lit(0)).alias("low"))
    if not silent:
        return found.select(unit, F.try_divide("low", "peak").alias("mua_to_peak"))
    return units.join(found, unit, "left").select(unit, F.coalesce(F.try_divide("low", "peak"), F.lit(0.0)).alias("mua_to_peak"))


def bins(train: DataFrame, width: int, unit: str = "unit") -> DataFrame:
    """Distinct (unit, bin); bin = floor((idx + width / 2) / width)."""
    return train.select(unit, F.floor((F.col("idx") + width / 2) / width).alias("bin")).distinct()


def correlogram(left: DataFrame, right: DataFrame, window: int, width: int) -> DataFrame:
    """(lag, n): pairs of binary bins with right = left + lag, for every lag, zeros included."""
    span = int(window // width)
    a = left.select(F.floor((F.col("idx") + width / 2) / width).alias("bin")).distinct()
    b = right.select(F.floor((F.col("idx") + width / 2) / width).alias("bin")).distinct()
    lags = F.explode(F.sequence(F.lit(-span), F.lit(span)))
    hits = a.select("bin", lags.alias("lag")).select((F.col("bin") + F.col("lag")).alias("bin"), "lag").join(b, "bin").groupBy("lag").agg(F.count("*").alias("n"))
    axis = left.sparkSession.range(-span, span + 1).select(F.col("id").cast("int").alias("lag"))
    return axis.join(hits, "lag", "left").select("lag", F.coalesce("n", F.lit(0)).alias("n"))


def pair_correlograms(train: DataFrame, span: int, width: int, unit: str = "unit") -> DataFrame:
    """(unit_1, unit_2, lag, n) of all ordered pairs of different units, by one join on shifted bins; zeros are left out."""
    b = bins(train, width, unit)
    shifted = b.select(F.col(unit).alias("unit_1"), "bin", F.explode(F.sequence(F.lit(-span), F.lit(span))).alias("lag")).withColumn("bin", F.col("bin") + F.col("lag"))
    return shifted.join(b.withColumnRenamed(unit, "unit_2"), "bin").where("unit_1 <> unit_2").groupBy("unit_1", "unit_2", "lag").agg(F.count("*").alias("n"))


def near_events(events: DataFrame, others: DataFrame, tolerance: int, anti: bool = False) -> DataFrame:
    """Rows of ``events`` with (``anti``: without) an event of ``others`` at most ``tolerance`` away.

    Both sides are dealt out by buckets of tolerance + 1 samples; ``others`` also go to the buckets beside their own.
    """
    width = tolerance + 1
    keyed = events.withColumn("__bucket", F.floor(F.col("idx") / width))
    near = others.select(F.col("idx").alias("__other"), F.explode(F.sequence(F.floor(F.col("idx") / width) - 1, F.floor(F.col("idx") / width) + 1)).alias("__b"))
    hit = (F.col("__bucket") == F.col("__b")) & (F.abs(F.col("idx") - F.col("__other")) <= tolerance)
    return keyed.join(near, hit, "left_anti" if anti else "left_semi").drop("__bucket")


def overlap_ratio(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """One row, overlap_ratio: within the common time, shared bins over bins, the higher of the two directions."""
    ends = left.agg(F.min("idx").alias("a0"), F.max("idx").alias("a1")).crossJoin(right.agg(F.min("idx").alias("b0"), F.max("idx").alias("b1")))
    common = ends.select(F.greatest("a0", "b0").alias("lo"), F.least("a1", "b1").alias("hi"))  # one row

    def binned(train, name):
        inside = train.join(F.broadcast(common), (F.col("idx") >= F.col("lo")) & (F.col("idx") <= F.col("hi")))
        return inside.select(F.floor((F.col("idx") - F.col("lo")) / width).alias("bin")).distinct().withColumn(name, F.lit(1))

    both = binned(left, "l").join(binned(right, "r"), "bin", "full_outer")
    n = both.agg(F.count("l").alias("nl"), F.count("r").alias("nr"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("hits"))
    return n.select(F.coalesce(F.greatest(F.try_divide("hits", "nl"), F.try_divide("hits", "nr")), F.lit(0.0)).alias("overlap_ratio"))


def expected_overlap(left: DataFrame, right: DataFrame, overlap_time: float, fs: float) -> DataFrame:
    """One row, expected: coincidences that independent trains would have in their common time."""
    ends = left.agg(F.min("idx").alias("a0"), F.max("idx").alias("a1")).crossJoin(right.agg(F.min("idx").alias("b0"), F.max("idx").alias("b1")))
    common = ends.select(F.greatest("a0", "b0").alias("lo"), F.least("a1", "b1").alias("hi"))

    def inside(train, name):
        rows = train.join(F.broadcast(common), (F.col("idx") >= F.col("lo")) & (F.col("idx") <= F.col("hi")))
        return rows.agg(F.greatest(F.count("*") - 1, F.lit(0)).alias(name))  # the end of the range is not counted

    counts = common.crossJoin(inside(left, "n1")).crossJoin(inside(right, "n2"))
    ms = (F.col("hi") - F.col("lo")) / fs * 1000
    return counts.select(F.when(ms > 0, overlap_time * 1000 * F.col("n1") * F.col("n2") / ms).otherwise(0.0).alias("expected"))


def ccg_overlap(left: DataFrame, right: DataFrame, overlap_time: float, fs: float) -> DataFrame:
    """One row: expected, actual, delta_max of the correlogram around lag 0, each by the smaller train's size."""
    width = max(1, round(2 * overlap_time * fs))
    c = correlogram(left, right, 10 * width, width).withColumn("before", F.lag("n").over(Window.orderBy("lag")))
    step = F.when(~F.col("lag").isin(0, 1), F.abs(F.col("n") - F.col("before")))
    got = c.agg(F.max(F.when(F.col("lag") == 0, F.col("n"))).alias("n0"), F.max(F.when(F.abs("lag") == 1, F.col("n"))).alias("n1"), F.max(step).alias("dmax"))
    sizes = left.agg(F.count("*").alias("nl")).crossJoin(right.agg(F.count("*").alias("nr"))).select(F.least("nl", "nr").alias("least"))
    d = F.col("least")
    return got.crossJoin(sizes).select(*[F.when(d > 0, F.col(c) / d).otherwise(0.0).alias(name) for c, name in (("n1", "expected"), ("n0", "actual"), ("dmax", "delta_max"))])


def fold_groups(rows: DataFrame, keys: list[str], order: list[str], step, schema) -> DataFrame:
    """``step`` on each group's rows in order: for rules in which each decision rests on the last kept row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return step(pdf.sort_values(order, kind="stable").reset_index(drop=True))

    return rows.groupBy(*keys).applyInPandas(run, schema)


def dead_time(events: DataFrame, skip: int, keys: list[str], at: str = "sample", size: int = 1 << 20) -> DataFrame:
    """Events at least ``skip`` after the last kept one.

    An event that far after the one before is kept in any case, so only runs of closer events are sequential. Runs are
    found by block, with a halo of ``skip`` and the last beginning of a run carried from block to block; the runs that
    begin in a block are one fold.
    """
    near = halo(events, skip, 0, size, at)
    order = Window.partitionBy(*keys, "block").orderBy(at, F.desc("own"))
    gap = F.col(at) - F.lag(at).over(order)
    marked = near.withColumn("__start", F.when(F.coalesce(gap >= skip, F.lit(True)), F.col(at))).where("own")
    inside = Window.partitionBy(*keys, "block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("__run", F.max("__start").over(inside))
    ahead = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    carried = marked.groupBy(*keys, "block").agg(F.max("__start").alias("__last")).withColumn("__carried", F.max("__last").over(ahead)).drop("__last")
    names, columns = [*keys, "block"], events.columns
    carried = carried.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(names)], "__carried")
    same = [F.col(k).eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(names)]
    runs = marked.join(carried, functools.reduce(lambda a, b: a & b, same)).withColumn("__run", F.coalesce("__run", "__carried"))
    runs = runs.withColumn("block", F.floor(F.col("__run") / size).cast("long"))

    def step(pdf):
        keep, last, run = [], None, None
        for k, (x, r) in enumerate(zip(pdf[at].tolist(), pdf["__run"].tolist(), strict=True)):
            if r != run or x - last >= skip:
                keep.append(k)
                last, run = x, r
        return pdf.iloc[keep][columns]

    return fold_groups(runs.select(*columns, "__run", *[c for c in ["block"] if c not in columns]), names, ["__run", at], step, events.schema)


def drop_duplicates_by_error(events: DataFrame, tolerance: int, keys: list[str], error: str = "sse") -> DataFrame:
    """Of events at most ``tolerance`` apart the one of lower error stays; ties keep the earlier. The survivor meets the next."""

    def step(pdf):
        at, sse = pdf["idx"].to_numpy(), pdf[error].to_numpy()
        keep, cur = [], 0
        for nxt in range(1, len(pdf)):
            if at[nxt] - at[cur] <= tolerance:
                cur = nxt if sse[nxt] < sse[cur] else cur
            else:
                keep.append(cur)
                cur = nxt
        return pdf.iloc[[*keep, cur] if len(pdf) else []]

    return fold_groups(events, keys, ["idx"], step, events.schema)


def prefer_second_pass(events: DataFrame, tolerance: int, keys: list[str], flag: str = "bp") -> DataFrame:
    """Of events at most ``tolerance`` apart one found by template matching stays before one found by clustering."""

    def step(pdf):
        at, late = pdf["idx"].to_numpy(), pdf[flag].to_numpy()
        keep, cur = [], 0
        for nxt in range(1, len(pdf)):
            if at[nxt] - at[cur] <= tolerance:
                cur = nxt if late[nxt] and not late[cur] else cur
            else:
                keep.append(cur)
                cur = nxt
        return pdf.iloc[[*keep, cur] if len(pdf) else []]

    return fold_groups(events, keys, ["idx"], step, events.schema)

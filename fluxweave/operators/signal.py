"""Detection on sampled voltage: thresholds, crossings, artifacts, noise masks, whitening sums, segments and clips.

Voltage is a table (channel, sample, v), optionally with a segment. What looks along a recording works on blocks of
samples with a halo as wide as it looks, so a channel of any length is dealt out by block as well; events meet the
voltage by block; what mixes channels takes a block of all channels as one matrix. Exact medians come from a sketch and a
count of the few values near it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the median of |x| of a standard normal variable.
MAD = 0.6745
#: Samples of a block.
SCAN = 1 << 16


def halo(rows: DataFrame, before: int, after: int, size: int | None = None, at: str = "sample") -> DataFrame:
    """``rows`` with ``block`` and ``own``: each row in its own block, and again in those that begin at most ``before``
    samples later or end at most ``after`` earlier."""
    size = size or SCAN
    first, last = (F.floor((F.col(at) + x) / size).cast("long") for x in (-after, before))
    return rows.withColumn("block", F.explode(F.sequence(first, last)) if before or after else first).withColumn("own", F.col("block") == F.floor(F.col(at) / size))


def exact_median(rows: DataFrame, value: Column, keys: tuple[str, ...], name: str = "median") -> DataFrame:
    """(keys, name): the median of each key's values, which are not null or NaN.

    A sketch of constant size brackets it; then the values below the bracket are counted and the few inside it, by value.
    """
    x = rows.select(*keys, value.cast("double").alias("x"))
    ends = x.groupBy(*keys).agg(F.percentile_approx("x", F.array(F.lit(0.499), F.lit(0.501)), F.lit(10_000)).alias("q"), F.count("*").alias("n"))
    near = x.join(ends.select(*keys, F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "n"), list(keys)).where("x <= hi")
    counts = near.groupBy(*keys, "n", F.when(F.col("x") >= F.col("lo"), F.col("x")).alias("x")).agg(F.count("*").alias("c"))
    upto = Window.partitionBy(*keys).orderBy(F.col("x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("upto", F.sum("c").over(upto)).where("x is not null")
    holds = lambda rank: (F.col("upto") >= rank) & (F.col("upto") - F.col("c") < rank)
    first, second = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    return placed.groupBy(*keys).agg(((F.max(F.when(holds(first), F.col("x"))) + F.max(F.when(holds(second), F.col("x")))) / 2).alias(name))


def time_window_samples(window: tuple[float, float], fs: float) -> tuple[int, int]:
    """Seconds to a half-open window of samples around an event; the start is never positive."""
    return min(-abs(round(window[0] * fs)), 0), max(round(window[1] * fs), 1) + 1


def thresholds(voltage: DataFrame, sigma: float, keys: tuple[str, ...] = ("channel",)) -> DataFrame:
    """(keys, threshold, n_over): sigma * median(|v|) / 0.6745 and how many samples pass it."""
    clean = voltage.where(F.col("v").isNotNull() & ~F.isnan("v"))
    thr = exact_median(clean, F.abs("v"), keys, "mid").select(*keys, (sigma * F.col("mid") / MAD).alias("threshold"))
    over = clean.join(thr, list(keys)).groupBy(*keys, "threshold").agg(F.count_if(F.abs("v") > F.col("threshold")).alias("n_over"))
    return over


def allocate_cores(over: DataFrame) -> DataFrame:
    """``over`` with cores: 2 for items with more than five times the median of samples over threshold, else 1."""
    mid = over.agg(F.median("n_over").alias("__mid"))  # one row
    return over.crossJoin(F.broadcast(mid)).withColumn("cores", F.when(F.col("n_over") > 5 * F.col("__mid"), 2).otherwise(1)).drop("__mid")


def crossings(voltage: DataFrame, thr: DataFrame, keys: tuple[str, ...] = ("channel",)) -> DataFrame:
    """(keys, sample): upward crossings of |v|; the first sample of a channel is none."""
    order = Window.partitionBy(*keys, "block").orderBy("sample")
    over = F.abs("v") > F.col("threshold")
    near = halo(voltage.select(*keys, "sample", "v"), 1, 0).join(thr.select(*keys, "threshold"), list(keys))
    return near.withColumn("__up", over & ~F.lag(over).over(order)).where("__up and own").select(*keys, "sample")


def _windows(voltage: DataFrame, events: DataFrame, before: int, after: int, keys: tuple[str, ...], cut, schema: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Events (keys, sample, extra) and the block of voltage around them, group by group: ``cut(samples, v, events) ->
    DataFrame``. A block comes with a halo as wide as a window, so each event meets its block alone."""
    rows = halo(voltage.select(*keys, "sample", F.col("v").cast("double").alias("v")), before, after)
    # Groups meet by the hashes of their keys, which differ between types.
    asked = events.select(*[F.col(k).cast(voltage.schema[k].dataType) for k in keys], *extra, "sample").withColumn("block", F.floor(F.col("sample") / SCAN).cast("long"))
    names = [*keys, "block"]
    # Blocks without an event need not be sorted or sent.
    rows = rows.join(asked.select(*names).distinct(), names, "left_semi")
    rows, asked = rows.toDF(*rows.columns), asked.toDF(*asked.columns)  # events come from the same voltage

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("sample", kind="stable")
        return cut(left["sample"].to_numpy(), left["v"].to_numpy(), right)

    return rows.groupBy(*names).cogroup(asked.groupBy(*names)).applyInPandas(run, schema)


def _kinds(df: DataFrame, names: tuple[str, ...]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in names)


def align_to_peak(voltage: DataFrame, events: DataFrame, before: int, after: int, keys: tuple[str, ...] = ("channel",)) -> DataFrame:
    """(keys, sample, peak): the extremum in [sample - before, sample + after), not past the last sample but one.

    The highest value counts if it exceeds the lowest in size, else the lowest; ties go to the earliest sample.
    """
    last = voltage.groupBy(*keys).agg((F.max("sample") - 1).alias("__last"))
    asked = events.select(*keys, "sample").distinct().join(last, list(keys))

    def cut(samples, v, asked):
        out = []
        for row in asked[[*keys, "sample", "__last"]].itertuples(index=False):
            event, end = row[-2], min(row[-2] + after, row[-1] + 1)
            lo, hi = np.searchsorted(samples, [event - before, end])
            if hi > lo:
                part = v[lo:hi]
                top, low = int(part.argmax()), int(part.argmin())
                out.append((*row[:-1], samples[lo + (top if part[top] > -part[low] else low)]))
        return pd.DataFrame(out, columns=[*keys, "sample", "peak"])

    return _windows(voltage, asked, before, after, keys, cut, f"{_kinds(asked, (*keys, 'sample'))}, peak long", ("__last",))


def artifact_samples(voltage: DataFrame, thr: DataFrame, tolerance: int, channels: float) -> DataFrame:
    """(sample, n): samples at which crossings, widened by ``tolerance``, stand on at least ``channels`` channels
    (a share of all if at most 1)."""
    wide = crossings(voltage, thr).select("channel", F.explode(F.sequence(F.col("sample") - tolerance, F.col("sample") + tolerance)).alias("sample")).distinct()
    total = voltage.select("channel").distinct().agg(F.count("*").alias("__all"))
    least = F.greatest(F.lit(1), F.ceil(channels * F.col("__all"))) if channels <= 1 else F.lit(int(channels))
    return wide.groupBy("sample").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).where(F.col("n") >= least).select("sample", "n")


def blank_artifacts(voltage: DataFrame, thr: DataFrame, cushion: tuple[int, int], tolerance: int, channels: float) -> DataFrame:
    """``voltage`` with v = 0 on all channels from each artifact's start less a cushion to its end and another.

    An artifact ends at the first later sample at which fewer than the needed channels stand over their thresholds.
    """
    total = voltage.select("channel").distinct().agg(F.count("*").alias("__all"))
    least = F.greatest(F.lit(1), F.ceil(channels * F.col("__all"))) if channels <= 1 else F.lit(int(channels))
    over = voltage.join(thr.select("channel", "threshold"), "channel").groupBy("sample").agg(F.count_if(F.abs("v") > F.col("threshold")).alias("n"))
    calm = over.crossJoin(F.broadcast(total)).withColumn("__calm", F.when(F.col("n") < least, F.col("sample")))
    # The next calm sample: within blocks of samples first, then over the blocks, of which there are few.
    calm = calm.withColumn("__block", F.floor(F.col("sample") / SCAN))
    later = Window.orderBy("__block").rowsBetween(1, Window.unboundedFollowing)
    beyond = calm.groupBy("__block").agg(F.min("__calm").alias("__first")).withColumn("__beyond", F.min("__first").over(later)).select("__block", "__beyond")
    inside = Window.partitionBy("__block").orderBy("sample").rowsBetween(0, Window.unboundedFollowing)
    ends = calm.withColumn("__inside", F.min("__calm").over(inside)).join(beyond, "__block").withColumn("__end", F.coalesce("__inside", "__beyond"))
    starts = artifact_samples(voltage, thr, tolerance, channels).select("sample")
    spans = ends.join(starts, "sample").select((F.col("sample") - cushion[0]).alias("s"), (F.coalesce("__end", "sample") + cushion[1]).alias("e"))
    blank = spans.select(F.explode(F.sequence("s", "e")).alias("sample")).distinct().withColumn("__blank", F.lit(True))
    return voltage.join(blank, "sample", "left").withColumn("v", F.when(F.col("__blank"), F.lit(0).cast(voltage.schema["v"].dataType)).otherwise(F.col("v"))).select(*voltage.columns)


def noise_mask(voltage: DataFrame, thr: DataFrame, cushion: int, share: float = 0.9, keys: tuple[str, ...] = ("channel",)) -> DataFrame:
    """``voltage`` with ``noise``: no sample within ``cushion`` passes ``share`` of the threshold."""
    near = Window.partitionBy(*keys, "block").orderBy("sample").rowsBetween(-cushion, cushion)
    loud = (F.abs("v") > share * F.col("threshold")).cast("int")
    rows = halo(voltage, cushion, cushion).join(thr.select(*keys, "threshold"), list(keys))
    return rows.withColumn("noise", F.max(loud).over(near) == 0).where("own").select(*voltage.columns, "noise")


def _grid(pdf: pd.DataFrame, names: list, column: str = "v") -> tuple[np.ndarray, int]:
    """(channels x samples, first sample) of a block's rows; NaN where there is no row."""
    first = int(pdf["sample"].min())
    out = np.full((len(names), int(pdf["sample"].max()) - first + 1), np.nan)
    place = {c: i for i, c in enumerate(names)}
    out[pdf["channel"].map(place).to_numpy(), pdf["sample"].to_numpy() - first] = pdf[column].to_numpy(dtype=np.float64)
    return out, first


def noise_products(masked: DataFrame) -> DataFrame:
    """(c1, c2, n, value), c1 <= c2: variance of a channel's noise; for two channels the uncentred mean product.

    Products of two channels are summed block by block, as one matrix product, and added up."""
    quiet = masked.where("noise").select("channel", "sample", F.col("v").cast("double").alias("v"))
    own = quiet.groupBy("channel").agg(F.count("*").alias("n"), F.var_samp("v").alias("value")).select(F.col("channel").alias("c1"), F.col("channel").alias("c2"), "n", "value")
    kind = masked.schema["channel"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(pdf["channel"].unique())
        grid, _ = _grid(pdf, names)
        there = ~np.isnan(grid)
        values = np.where(there, grid, 0.0)
        n, s = there.astype(np.float64) @ there.T, values @ values.T
        i, j = np.triu_indices(len(names), 1)
        names = np.array(names, dtype=object)
        out = pd.DataFrame({"c1": names[i], "c2": names[j], "n": n[i, j].astype(np.int64), "s": s[i, j]})
        return out[out["n"] > 0]

    blocks = halo(quiet, 0, 0).drop("own").groupBy("block").applyInPandas(run, f"c1 {kind}, c2 {kind}, n long, s double")
    cross = blocks.groupBy("c1", "c2").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return own.unionByName(cross.select("c1", "c2", "n", F.when(F.col("n") > 1, F.col("s") / (F.col("n") - 1)).alias("value")))


def apply_mixing(voltage: DataFrame, weights: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Channels mixed: v'(c, t) = sum over c' of weight(c, c') * v(c', t); ``weights`` (keys, channel, source, w) is N x N,
    so it goes to the driver and with the task. A block of all channels is one matrix product."""
    tables: dict[tuple, dict] = {}
    for r in weights.collect():
        tables.setdefault(tuple(r[k] for k in keys), {})[r["channel"], r["source"]] = r["w"]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        table = tables.get(tuple(key[:-1]), {})
        sources = sorted({b for _, b in table} & set(pdf["channel"]))
        names = sorted({a for a, b in table if b in sources})
        pdf = pdf[pdf["channel"].isin(sources)]
        if not len(pdf) or not names:
            return pd.DataFrame(columns=[*keys, "channel", "sample", "v"])
        grid, first = _grid(pdf, sources)
        there = ~np.isnan(grid)
        w = np.array([[table.get((a, b), 0.0) for b in sources] for a in names])
        at = np.flatnonzero(there.any(axis=0))
        mixed = (w @ np.where(there, grid, 0.0))[:, at]
        out = {"channel": np.repeat(np.array(names, dtype=object), len(at)), "sample": np.tile(at + first, len(names)), "v": mixed.ravel()}
        return pd.DataFrame({**{k: [x] * mixed.size for k, x in zip(keys, key[:-1], strict=True)}, **out})

    rows = halo(voltage.select(*keys, "channel", "sample", F.col("v").cast("double").alias("v")), 0, 0).drop("own")
    return rows.groupBy(*keys, "block").applyInPandas(run, f"{_kinds(voltage, (*keys, 'channel', 'sample'))}, v double")


def plan_segments(n_samples: int, duration: int, overlap: int) -> list[tuple[int, int]]:
    """Equal overlapping half-open windows that cover all samples; the duration grows until they do."""
    if duration >= n_samples:
        return [(0, n_samples)]
    overlap = max(0, min(overlap, duration - 1))
    count = math.floor((n_samples - duration) / (duration - overlap))
    duration = math.ceil((n_samples + count * overlap) / (count + 1))
    step, out, start = duration - overlap, [], 0
    while True:
        out.append((start, min(n_samples, start + duration)))
        if start + duration >= n_samples:
            return out
        start += step


def assign_segments(rows: DataFrame, duration: int, step: int, n_segments: int, at: str = "sample") -> DataFrame:
    """Each row once for every segment it lies in: segments follow from arithmetic, not from a range join."""
    low = F.greatest(F.lit(0), F.floor((F.col(at) - duration) / step) + 1)
    high = F.least(F.lit(n_segments - 1), F.floor(F.col(at) / step))
    return rows.withColumn("seg", F.explode(F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))))


def work_items(thr: DataFrame, segments: DataFrame, neighbors: DataFrame) -> DataFrame:
    """(seg, channel, neighbors, threshold): one row a unit of work."""
    near = neighbors.groupBy("channel").agg(F.array_sort(F.collect_list("neighbor")).alias("neighbors"))
    return segments.select("seg").crossJoin(F.broadcast(thr)).join(near, "channel")


def clips(voltage: DataFrame, events: DataFrame, before: int, after: int, keys: tuple[str, ...] = ("channel",)) -> DataFrame:
    """(keys, event, clip): the values in [event - before, event + after) of each event whose window is whole."""

    def cut(samples, v, asked):
        out = []
        for row in asked[[*keys, "sample"]].itertuples(index=False):
            lo, hi = np.searchsorted(samples, [row[-1] - before, row[-1] + after])
            if hi - lo == before + after:
                out.append((*row, v[lo:hi]))
        return pd.DataFrame(out, columns=[*keys, "event", "clip"])

    asked = events.select(*keys, "sample").distinct()
    return _windows(voltage, asked, before, after, keys, cut, f"{_kinds(asked, keys)}, event long, clip array<double>")


def neighborhood_clips(voltage: DataFrame, events: DataFrame, neighbors: DataFrame, before: int, after: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, channel, event, clip): windows of all neighbors (channel, neighbor, pos), joined in their order; a channel's
    part that is not whole is left out with its event."""
    near = events.select(*keys, "channel", "sample").distinct().join(F.broadcast(neighbors.select("channel", "neighbor", "pos")), "channel")
    near = near.select(*keys, F.col("neighbor").alias("channel"), "sample", F.struct("channel", "pos").alias("of"))
    asked = near.groupBy(*keys, "channel", "sample").agg(F.collect_list("of").alias("of"))  # as many as a channel has neighbors
    parts = clips(voltage, asked, before, after, (*keys, "channel")).withColumnRenamed("event", "sample").join(asked, [*keys, "channel", "sample"])
    parts = parts.select(*keys, "sample", F.explode("of").alias("of"), "clip")
    ordered = F.array_sort(F.collect_list(F.struct(F.col("of.pos").alias("pos"), F.col("clip").alias("clip"))))
    whole = parts.groupBy(*keys, F.col("of.channel").alias("channel"), F.col("sample").alias("event")).agg(ordered.alias("x"))
    sizes = neighbors.groupBy("channel").agg(F.count("*").alias("__n"))
    whole = whole.join(F.broadcast(sizes), "channel").where(F.size("x") == F.col("__n"))
    return whole.select(*keys, "channel", "event", F.flatten(F.transform("x", lambda p: p["clip"])).alias("clip"))


def histogram(values: DataFrame, column: str, n_bins: int, keys: tuple[str, ...]) -> DataFrame:
    """(keys, bin, n): counts on a mesh of ``n_bins`` points from the lowest to the highest value of each key."""
    ends = values.groupBy(*keys).agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    place = F.when(F.col("__hi") > F.col("__lo"), F.floor((F.col(column) - F.col("__lo")) / ((F.col("__hi") - F.col("__lo")) / (n_bins - 1)))).otherwise(0)
    return values.join(ends, list(keys)).groupBy(*keys, place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def moving_average(order: Window, half: int, column: str = "v") -> Column:
    """Box smoothing whose window shrinks at the edges."""
    return F.avg(column).over(order.rowsBetween(-half, half))

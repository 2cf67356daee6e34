"""Relational rules on finished units: filters, labels, redundancy, links and chains, export."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxweave.functions import consolidation
from fluxweave.sources.stages import staged


def filter_snr_mua(units: DataFrame, snr: float = 2.0, mua: float = 0.1, operator: str = "and") -> DataFrame:
    """'and' drops units with mua >= limit and snr <= limit, 'or' those with mua > limit or snr < limit.

    A unit whose mua is null or NaN is judged by its snr alone."""
    unknown = F.col("mua").isNull() | F.isnan("mua")
    if operator == "and":
        drop = F.when(unknown, F.col("snr") <= snr).otherwise((F.col("mua") >= mua) & (F.col("snr") <= snr))
    elif operator == "or":
        drop = F.when(unknown, F.col("snr") < snr).otherwise((F.col("mua") > mua) | (F.col("snr") < snr))
    else:
        raise ValueError("operator must be 'and' or 'or'")
    return units.where(~F.coalesce(drop, F.lit(False)))


def filter_least(units: DataFrame, column: str, least: float) -> DataFrame:
    """Units whose value is not below ``least`` (duration, firing rate)."""
    return units.where(F.col(column) >= least)


def dense_labels(rows: DataFrame, label: str = "unit", keys: tuple[str, ...] = ()) -> DataFrame:
    """Labels 0..n-1 in the order of the old ones, within the keys."""
    order = Window.partitionBy(*keys).orderBy(label)
    distinct = rows.select(*keys, label).distinct().withColumn("__new", F.dense_rank().over(order) - 1)
    return rows.join(distinct, [*keys, label]).withColumn(label, F.col("__new").cast("long")).drop("__new")


def segment_label_offsets(rows: DataFrame, label: str = "unit", keys: tuple[str, ...] = ("channel",)) -> DataFrame:
    """(keys, seg, offset): what to add to a segment's labels so that no two segments share one."""
    top = rows.groupBy(*keys, "seg").agg((F.max(label) + 1).alias("n"))
    before = Window.partitionBy(*keys).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    return top.select(*keys, "seg", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))


def quality_score(units: DataFrame) -> DataFrame:
    return units.withColumn("quality", F.col("snr") * (1 - F.coalesce(F.nanvl("mua", F.lit(0.0)), F.lit(0.0))) * F.col("n"))


def redundant_pairs(pairs: DataFrame, limit: float = 5.0) -> DataFrame:
    """Pairs (unit_1, unit_2, expected, actual, delta_max) that coincide beyond chance."""
    return pairs.where(F.col("actual") >= limit * F.col("delta_max") + F.col("expected"))


def union_mua(first: DataFrame, second: DataFrame, tolerance: int) -> DataFrame:
    """Events of the second train and those of the first that are not near any of them, for the mixture test."""
    from fluxweave.operators.trains import near_events

    return near_events(first, second, tolerance, anti=True).unionByName(second)


def drop_redundant(units: DataFrame, pairs: DataFrame, keys: tuple[str, ...] = ("seg",)) -> DataFrame:
    """(keys, unit) of units to delete. ``units`` (keys, unit, mua, snr, n), ``pairs`` (keys, unit_1, unit_2, ratio, delta_max, union_mua).

    Sequential: the pair of highest ratio among the units left is settled first. Of two units without a known mua the
    one of larger snr * n stays; a lone unknown goes. Else each unit's best partner that the other does not share
    tells what would be lost: the unit whose place a better partner takes goes; on a tie the one of lower quality,
    unless it has fewer partners and the better snr; if the union's intervals are dirtier than either unit by the
    change expected of chance, the cleaner unit stays.
    """

    def settle(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("unit")
        names = left["unit"].to_numpy(np.int64)
        mua, snr, n = (left[c].to_numpy(np.float64) for c in ("mua", "snr", "n"))
        quality = np.where(np.isnan(mua), 0.0, 1 - mua) * snr * n
        if not all(right[c].isin(names).all() for c in ("unit_1", "unit_2")):
            raise ValueError("a pair has a unit that is not there")
        first, second = (np.searchsorted(names, right[c].to_numpy(np.int64)).astype(np.int32) for c in ("unit_1", "unit_2"))
        ends = np.concatenate([first, second])[np.argsort(np.concatenate([second, first]), kind="stable")]
        starts = np.searchsorted(np.sort(np.concatenate([second, first])), np.arange(len(names) + 1))
        there = np.ones(len(names), dtype=bool)

        def partners(x: int) -> np.ndarray:
            """Those left of x and the units it is paired with."""
            found = ends[starts[x] : starts[x + 1]]
            return np.append(np.unique(found[there[found] & (found != x)]), x)

        def pairs_left():
            """Places of the pairs in the order of the rule, without those whose unit is gone by the time."""
            order = np.lexsort((second, first, -ratios))
            order = order[~(ratios[order] <= 0)]
            for at in range(0, len(order), 1 << 14):
                part = order[at : at + (1 << 14)]
                for k in part[there[first[part]] & there[second[part]]].tolist():
                    if there[first[k]] and there[second[k]]:
                        yield k

        gone: list[int] = []
        ratios, deltas, unions = (right[c].to_numpy(np.float64) for c in ("ratio", "delta_max", "union_mua"))
        for k in pairs_left():
            a, b = int(first[k]), int(second[k])
            by = {}

            def lost(a=a, b=b, by=by) -> tuple:
                by |= {a: partners(a), b: partners(b)}
                own = [quality[by[x][np.isin(by[x], by[y], invert=True)]] for x, y in ((a, b), (b, a))]
                return tuple((q.max() if len(q) else quality[x]) - quality[x] for x, q in zip((a, b), own, strict=True))

            mixed = lambda a=a, b=b, k=k: not np.isnan(unions[k]) and unions[k] > min(mua[a], mua[b]) + deltas[k] and unions[k] > max(mua[a], mua[b])
            worse = consolidation.worse_of(a, b, mua, snr, n, lost, lambda x, by=by: len(by[x]), mixed)
            there[worse] = False
            gone.append(int(names[worse]))
        return pd.DataFrame({**{k: [v] * len(gone) for k, v in zip(keys, key, strict=True)}, "unit": gone})

    kinds = ", ".join([*(f"{k} {units.schema[k].dataType.simpleString()}" for k in keys), "unit long"])
    return units.groupBy(*keys).cogroup(pairs.groupBy(*keys)).applyInPandas(settle, kinds)


def overlap_links(ratios: DataFrame, least: float = 0.75) -> DataFrame:
    """(seg, unit_1, unit_2): greedy best links between units of a segment and the next; ``ratios`` (seg, unit_1, unit_2, ratio)."""

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, out = set(), set(), []
        for r in pdf.sort_values(["ratio", "unit_1", "unit_2"], ascending=[False, True, True]).itertuples():
            if r.ratio >= least and r.unit_1 not in left and r.unit_2 not in right:
                left.add(r.unit_1)
                right.add(r.unit_2)
                out.append((r.seg, r.unit_1, r.unit_2))
        return pd.DataFrame(out, columns=["seg", "unit_1", "unit_2"])

    return ratios.groupBy("seg").applyInPandas(match, "seg int, unit_1 long, unit_2 long")


def chains(units: DataFrame, links: DataFrame, n_segments: int) -> DataFrame:
    """(seg, unit, root_seg, root_unit): units followed over links from each segment to the next.

    Pointers are doubled, so log2(n_segments) joins at most settle every chain. Each round is written, so that plans stay
    small, and takes only the units whose pointer may not be at its root yet. Links of units that are not there are none.
    """
    there = units.select("seg", "unit").distinct()
    known = links.join(there.withColumnRenamed("unit", "unit_1"), ["seg", "unit_1"], "left_semi")
    back = known.select((F.col("seg") + 1).alias("seg"), F.col("unit_2").alias("unit"), F.col("seg").alias("p_seg"), F.col("unit_1").alias("p_unit"))
    at = staged(there.join(back, ["seg", "unit"], "left"), "chains")
    settled = at.where("p_seg is null").select("seg", "unit", F.col("seg").alias("p_seg"), F.col("unit").alias("p_unit"))
    late = at.where("p_seg is not null").withColumn("done", F.lit(False))  # all that have a pointer, as it is by now
    left = late
    for _ in range((n_segments - 1).bit_length() + 1):
        if left.isEmpty():
            break
        up = late.select(F.col("seg").alias("p_seg"), F.col("unit").alias("p_unit"), F.col("p_seg").alias("g_seg"), F.col("p_unit").alias("g_unit"), F.col("done").alias("g_done"))
        moved = left.drop("done").join(up, ["p_seg", "p_unit"], "left")  # a pointer without a pointer of its own is at a root
        root = F.col("g_done").isNull()
        moved = moved.select("seg", "unit", F.when(root, F.col("p_seg")).otherwise(F.col("g_seg")).alias("p_seg"), F.when(root, F.col("p_unit")).otherwise(F.col("g_unit")).alias("p_unit"), F.coalesce("g_done", F.lit(True)).alias("done"))
        moved = staged(moved, "chains")
        late = late.where("done").unionByName(moved)
        left = moved.where("not done")
    return settled.unionByName(late.drop("done")).select("seg", "unit", F.col("p_seg").alias("root_seg"), F.col("p_unit").alias("root_unit"))


def confusion_by_neuron(confusion: DataFrame, neuron_of: DataFrame) -> DataFrame:
    """(id, other_id, max_confusion): unit-level confusion (unit, other, p) as means over neurons."""
    a = confusion.join(neuron_of.select("unit", "id"), "unit")
    b = a.join(neuron_of.select(F.col("unit").alias("other"), F.col("id").alias("other_id")), "other")
    return b.where(~F.isnan("p")).groupBy("id", "other_id").agg(F.avg("p").alias("max_confusion"))


def viz_export(neurons: DataFrame) -> DataFrame:
    """Rows for a viewer that counts samples and channels from one; the first channel stands for the unit."""
    return neurons.select(
        F.col("id"),
        (F.element_at("channel", 1) + 1).alias("channel"),
        F.transform("samples", lambda s: s + 1).alias("spike_indices"),
        F.col("template"),
        F.transform("neighbors", lambda c: c + 1).alias("neighbors"),
        F.col("snr"),
    )

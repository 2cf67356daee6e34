"""From sorted segments to neurons: checks, deletions, stitching of segments, redundancy, summaries.

Events are (seg, channel, unit, sample), with ``clip`` on all channels where a step compares waveforms.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxweave.functions import consolidation
from fluxweave.operators import neurons, trains, units
from fluxweave.sources.stages import staged


def check_items(items: DataFrame, events: DataFrame, has_voltage: bool = False) -> DataFrame:
    """The events (item, sample, unit, clip) of items (id, ..) that are complete.

    Events of an unknown item are an error, as are repeated items, and missing clips where there is no voltage to cut
    them from. An item in which any event lacks its sample or label is dropped with all of its events.
    """
    repeated = items.groupBy("id").count().where("count > 1").select("id").limit(1).collect()
    if repeated:
        raise ValueError(f"item {repeated[0].id} stands twice")
    unknown = events.join(items.select(F.col("id").alias("item")), "item", "left_anti").select("item").limit(1).collect()
    if unknown:
        raise ValueError(f"events of item {unknown[0].item}, which is no work item")
    bare = F.col("clip").isNull() | (F.size("clip") == 0)
    partial = events.groupBy("item").agg(F.bool_or(F.col("sample").isNull() | F.col("unit").isNull()).alias("bad"), F.bool_or(bare).alias("bare"), F.count("*").alias("n"))
    if not has_voltage and partial.where("bare and not bad and n > 1").limit(1).collect():
        raise ValueError("clips are missing and there is no voltage to cut them from")
    return events.join(partial.where("bad").select("item"), "item", "left_anti")


def delete_label(events: DataFrame, channel: int, seg: int, label: int) -> DataFrame:
    return events.where(~((F.col("channel") == channel) & (F.col("seg") == seg) & (F.col("unit") == label)))


def delete_bad_units(events: DataFrame, quality: DataFrame, most_mua: float = 0.2, least_snr: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """(events, removed): events without the units (seg, channel, unit, mua, snr) of too much contamination or too little
    SNR, and those units with ``why`` ('mua' is looked at first)."""
    why = F.when(F.col("mua") > most_mua, "mua").when(F.col("snr") < least_snr, "snr")
    removed = quality.withColumn("why", why).where(F.col("why").isNotNull())
    return events.join(removed.select("seg", "channel", "unit"), ["seg", "channel", "unit"], "left_anti"), removed


def nearest_removed(removed: DataFrame) -> DataFrame:
    """The removed unit that came closest to staying, for each reason: least contamination, highest SNR."""
    close = F.when(F.col("why") == "mua", F.col("mua")).otherwise(-F.col("snr"))
    order = Window.partitionBy("why").orderBy(close, "seg", "channel", "unit")
    return removed.withColumn("r", F.row_number().over(order)).where("r = 1").select("why", "seg", "channel", "unit", "mua", "snr")


def segment_links(clips: DataFrame, segments: list[tuple[int, int]], channels: int, most: int, p_cut: float = 0.01, overlap_only: bool = True, components: int | None = 5, seed: int = 0, **options) -> DataFrame:
    """(seg, channel, unit_1, unit_2): units of a channel in neighboring segments that the cut test on their clips takes
    for one, nearest pairs first. Each pair of segments and channel is one group."""
    last, starts = len(segments) - 1, [a for a, _ in segments]
    if not last:
        return clips.sparkSession.createDataFrame([], "seg int, channel int, unit_1 long, unit_2 long")
    bound = lambda values, at: F.element_at(F.array(*[F.lit(int(x)) for x in values]), at)
    first = clips.where(F.col("seg") < last).select(F.col("seg").alias("pair"), "seg", "channel", "unit", "sample", "clip")
    second = clips.where(F.col("seg") > 0).select((F.col("seg") - 1).alias("pair"), "seg", "channel", "unit", "sample", "clip")
    both = first.unionByName(second)
    if overlap_only:
        lo, hi = bound(starts[1:], F.col("pair") + 1), bound([b for _, b in segments[:-1]], F.col("pair") + 1)
        both = both.where((F.col("sample") >= lo) & (F.col("sample") <= hi))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pair, channel = int(key[0]), int(key[1])
        sides = [{int(u): np.stack(x["clip"].to_list()) for u, x in pdf[pdf["seg"] == pair + k].groupby("unit")} for k in (0, 1)]
        links = consolidation.stitch_pair(*sides, channels, channel, most, p_cut, components, seed, **options) if all(sides) else []
        return pd.DataFrame([(pair, channel, a, b) for a, b in links], columns=["seg", "channel", "unit_1", "unit_2"])

    return both.groupBy("pair", "channel").applyInPandas(run, "seg int, channel int, unit_1 long, unit_2 long")


def stitch_segments(events: DataFrame, links: DataFrame, n_segments: int) -> DataFrame:
    """``events`` with ``label``: the same on a channel for units that are linked from segment to segment."""
    named = events.select("seg", F.struct("channel", "unit").alias("unit"))
    pairs = links.select("seg", F.struct("channel", F.col("unit_1").alias("unit")).alias("unit_1"), F.struct("channel", F.col("unit_2").alias("unit")).alias("unit_2"))
    rooted = units.chains(named, pairs, n_segments).select("seg", F.col("unit.channel").alias("channel"), F.col("unit.unit").alias("unit"), F.struct(F.col("root_seg").alias("s"), F.col("root_unit.unit").alias("u")).alias("root"))
    labels = rooted.select("channel", "root").distinct().withColumn("label", (F.row_number().over(Window.partitionBy("channel").orderBy("root")) - 1).cast("long"))
    return events.join(rooted.join(labels, ["channel", "root"]).drop("root"), ["seg", "channel", "unit"])


def coincidences(events: DataFrame, overlap_samples: int, neighbors: DataFrame | None = None, limit: float | None = None) -> DataFrame:
    """(seg, unit_1, unit_2, expected, actual, delta_max): of units (numbered through a segment) on different channels,
    shares of coincident bins at lag zero and one, and the largest step of the correlogram. With ``limit`` only the pairs
    that coincide beyond chance (``units.redundant_pairs``) are given out.

    Units go into blocks of bounded numbers of units and events; two blocks of a segment meet in one group, where one
    matrix product counts all of their pairs. A unit's bins are packed, in sections, before they are dealt out.
    """
    width = max(1, 2 * overlap_samples)
    named = events.select(F.struct("seg", "channel", "unit").alias("unit"), F.col("sample").alias("idx"))
    sizes = named.groupBy("unit").agg(F.count("*").alias("n")).withColumn("id", F.row_number().over(Window.orderBy("unit")))  # one row a unit
    whole = Window.partitionBy("unit.seg")
    before = F.sum("n").over(whole.orderBy("id")) - F.col("n")
    per = F.least(F.greatest(F.ceil(F.count("*").over(whole) / 8), F.lit(64)), F.lit(2048))
    sizes = sizes.select("unit", "id", "n", F.floor((F.row_number().over(whole.orderBy("id")) - 1) / per).alias("p"), F.floor(before / (1 << 22)).alias("q"))
    sizes = sizes.select("unit", "id", "n", (F.dense_rank().over(whole.orderBy("p", "q")) - 1).alias("block"))
    sizes = staged(sizes.withColumn("blocks", F.max("block").over(whole) + 1), "sizes")
    groups = sizes.groupBy("unit.seg").agg(F.max("blocks").alias("b")).agg(F.sum(F.col("b") * (F.col("b") + 1) / 2)).first()[0]
    named_ids = sizes.where("unit.seg is not null and unit.channel is not null")
    bins = trains.bins(named.where("idx is not null"), width).join(named_ids, "unit")
    packed = bins.groupBy("unit.seg", "unit.channel", "id", "n", "block", "blocks", F.shiftright("bin", 20).alias("section")).agg(F.collect_list(F.col("bin").bitwiseAND((1 << 20) - 1).cast("int")).alias("bins"))
    other = F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("other")
    dealt = packed.select("seg", "channel", "id", "n", "block", "section", "bins", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")
    tasks = int(min(max(groups or 1, 1), 4096))

    def side(pdf: pd.DataFrame) -> tuple:
        named = pdf.drop_duplicates("id").sort_values("id")
        ids = named["id"].to_numpy(np.int64)
        unit = np.repeat(np.searchsorted(ids, pdf["id"].to_numpy()), pdf["bins"].map(len).to_numpy())
        at = np.concatenate([(int(s) << 20) + np.asarray(x, dtype=np.int64) for s, x in zip(pdf["section"], pdf["bins"], strict=True)])
        order = np.argsort(at, kind="stable")
        return ids, named["channel"].to_numpy(), named["n"].to_numpy(), unit[order], at[order]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [pdf[pdf["block"] == key[k]] for k in (1, 2)]
        found = consolidation.coincident_pairs(*map(side, sides), 10, limit) if all(map(len, sides)) else [[]] * 5
        return pd.DataFrame(dict(zip(("a", "b", "expected", "actual", "delta_max"), found, strict=True)))

    out = dealt.repartition(tasks, "seg", "i", "j").groupBy("seg", "i", "j").applyInPandas(run, "a long, b long, expected double, actual double, delta_max double")
    names = lambda k: sizes.select(F.col("id").cast("long").alias(k), F.col("unit").alias(f"u{k}"))
    out = out.join(names("a"), "a").join(names("b"), "b")
    if neighbors is not None:
        near = neighbors.select(F.col("channel").alias("c1"), F.col("neighbor").alias("c2"))
        out = out.join(F.broadcast(near), (F.col("ua.channel") == F.col("c1")) & (F.col("ub.channel") == F.col("c2")), "left_semi")
    return out.select(F.col("ua.seg").alias("seg"), F.struct("ua.channel", "ua.unit").alias("unit_1"), F.struct("ub.channel", "ub.unit").alias("unit_2"), "expected", "actual", "delta_max")


def union_contamination(events: DataFrame, pairs: DataFrame, fs: float, tolerance: int, refractory: int) -> DataFrame:
    """``pairs`` (seg, unit_1, unit_2, ..) with ``union_mua``, the contamination that the two units' events would have as
    one train: all of the second, and those of the first that are not near one of them. Buckets meet by an equi-join."""
    names = ["seg", "unit_1", "unit_2"]
    e = events.select("seg", F.struct("channel", "unit").alias("u"), F.col("sample").alias("idx"))
    asked = pairs.select(*names)
    first, second = (asked.join(e.withColumnRenamed("u", k), ["seg", k]).select(*names, "idx") for k in ("unit_1", "unit_2"))
    w = tolerance + 1
    left = first.withColumn("b", F.floor(F.col("idx") / w))
    near = second.select(*names, F.col("idx").alias("other"), F.explode(F.array(*[F.floor(F.col("idx") / w) + d for d in (-1, 0, 1)])).alias("b"))
    pair = F.col("left.seg") == F.col("near.seg")
    for k in ("unit_1", "unit_2", "b"):
        pair &= F.col(f"left.{k}") == F.col(f"near.{k}")
    alone = left.alias("left").join(near.alias("near"), pair & (F.abs(F.col("left.idx") - F.col("near.other")) <= tolerance), "left_anti").select(*names, "idx")
    train = alone.unionByName(second).select(F.struct(*names).alias("unit"), "idx")
    report = trains.isi_report(train, fs, tolerance, refractory).select("unit.seg", "unit.unit_1", "unit.unit_2", F.col("fraction_mua").alias("union_mua"))
    return pairs.join(report, names, "left")


def redundant_by_segment(events: DataFrame, quality: DataFrame, pairs: DataFrame, limit: float = 5.0, union: tuple[float, int, int] | None = None) -> DataFrame:
    """(seg, channel, unit) of the units of a segment that repeat a better one. ``quality`` has (seg, channel, unit, mua,
    snr, n), ``pairs`` comes from ``coincidences``; with ``union`` (rate, tolerance, refractory samples) a pair that is
    cleaner apart than together is told by its joined train."""
    numbered = quality.withColumn("id", (F.row_number().over(Window.partitionBy("seg").orderBy("channel", "unit")) - 1).cast("long"))
    ids = numbered.select("seg", F.struct("channel", "unit").alias("u"), "id")
    bad = units.redundant_pairs(pairs, limit)
    bad = bad.withColumn("union_mua", F.lit(float("nan"))) if union is None else union_contamination(events, staged(bad, "pairs"), *union)
    bad = bad.join(ids.select("seg", F.col("u").alias("unit_1"), F.col("id").alias("id_1")), ["seg", "unit_1"]).join(ids.select("seg", F.col("u").alias("unit_2"), F.col("id").alias("id_2")), ["seg", "unit_2"])
    bad = bad.select("seg", F.col("id_1").alias("unit_1"), F.col("id_2").alias("unit_2"), F.col("actual").alias("ratio"), "delta_max", F.coalesce("union_mua", F.lit(float("nan"))).alias("union_mua"))
    lean = numbered.select("seg", F.col("id").alias("unit"), F.coalesce(F.col("mua").cast("double"), F.lit(float("nan"))).alias("mua"), F.col("snr").cast("double").alias("snr"), F.col("n").cast("long").alias("n"))
    gone = units.drop_redundant(lean, bad)
    return numbered.join(gone.withColumnRenamed("unit", "id"), ["seg", "id"]).select("seg", "channel", "unit")


#: Bytes of the bits of a segment's trains up to which it is settled by rounds; pairs that a round writes for a unit, and
#: for a segment; trains from which on a round takes only pairs of high ratio; trains of the sample that tells how high.
MOST_BITS, WANTED, MOST_PAIRS, FEW_TRAINS, SAMPLE = 1 << 28, 16, 1 << 22, 4096, 1024


def redundant_by_rounds(events: DataFrame, quality: DataFrame, overlap_samples: int, limit: float = 5.0) -> DataFrame:
    """``redundant_by_segment`` of all ``coincidences`` and without ``union``, with no table of all pairs.

    Pairs are settled from the highest ratio on, and each one settled takes a unit. So a round finds the pairs of a
    ratio above some floor by products of blocks of bits, settles them in one task a segment, which looks up the partners
    of a pair's units when it comes to it, and leaves few units to the next round; the last one has no floor. A sample of
    trains tells the floor, which bears on the number of rounds, not on what they return. Equal trains are one kind: kinds
    are paired, not their units. Segments of long trains, beyond ``MOST_BITS``, take the table of pairs.
    """
    if limit <= 0:
        return redundant_by_segment(events, quality, coincidences(events, overlap_samples, limit=limit), limit)
    names, span = ["seg", "channel", "unit"], 10
    number = F.col("mua").cast("double")
    order = Window.partitionBy("seg").orderBy("channel", "unit")
    judged = quality.where("seg is not null and channel is not null").select(*names, F.coalesce(number, F.lit(float("nan"))).alias("mua"), F.col("snr").cast("double").alias("snr"), F.col("n").cast("long").alias("n"))
    judged = judged.withColumn("id", (F.row_number().over(order) - 1).cast("long")).withColumn("place", F.dense_rank().over(Window.partitionBy("seg").orderBy("channel")).cast("long"))
    named = events.where("seg is not null and channel is not null").select(F.struct(*names).alias("unit"), F.col("sample").alias("idx"))
    sizes = named.groupBy("unit").agg(F.count("*").alias("size"))
    seen = trains.bins(named.where("idx is not null"), max(1, 2 * overlap_samples)).groupBy("unit").agg(F.array_sort(F.collect_list("bin")).alias("bins"))
    seen = seen.join(sizes, "unit").select(F.col("unit.seg").alias("seg"), F.col("unit.channel").alias("channel"), F.col("unit.unit").alias("unit"), "size", "bins")
    same = functools.reduce(lambda a, b: a & b, [F.col(f"s.{k}").eqNullSafe(F.col(f"q.{k}")) for k in names])
    table = seen.alias("s").join(judged.alias("q"), same).select("s.seg", "q.id", "q.channel", "q.unit", "place", "size", "bins", "mua", "snr", "n")
    table = staged(table, "trains")
    ends = table.groupBy("seg").agg(F.min(F.col("bins")[0]).alias("lo"), F.max(F.element_at("bins", -1)).alias("hi"), F.count("*").alias("trains"))
    ends = staged(ends.withColumn("words", F.ceil((F.col("hi") - F.col("lo") + 2 * span + 1) / 64)), "ends")  # one row a segment
    if not ends.where(F.col("trains") * F.col("words") * 8 > MOST_BITS).isEmpty():
        return redundant_by_segment(events, quality, coincidences(events, overlap_samples, limit=limit), limit)

    def pack(batches):
        for pdf in batches:
            bits = []
            for at, (bins, lo, words) in enumerate(zip(pdf["bins"], pdf["lo"], pdf["words"], strict=True)):
                bits.append(consolidation.packed_bins([bins], int(lo), int(words), span).tobytes())
            yield pdf.drop(columns=["bins", "lo"]).assign(bits=bits)

    kinds = f"seg {table.schema['seg'].dataType.simpleString()}, id long, place long, size long, mua double, snr double, n long, words long, bits binary"
    packed = table.join(ends.select("seg", "lo", "words"), "seg").select("seg", "id", "place", "size", "mua", "snr", "n", "words", "bins", "lo").mapInPandas(pack, kinds)
    alike = lambda rows: rows.withColumn("lead", F.min("id").over(Window.partitionBy("seg", "kind"))).withColumn("units", F.count("*").over(Window.partitionBy("seg", "kind")))
    left = staged(alike(packed.withColumn("kind", F.min("id").over(Window.partitionBy("seg", "size", "bits")))), "packed")
    seg = f"seg {table.schema['seg'].dataType.simpleString()}"
    trains_of = lambda pdf: (pdf["size"].to_numpy(np.int64), np.frombuffer(b"".join(pdf["bits"]), dtype=np.uint64).reshape(len(pdf), -1))

    def floor_of(factor: int):
        def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
            all_of = int(pdf["trains"].iloc[0])
            if all_of <= FEW_TRAINS:
                return pd.DataFrame({"seg": [key[0]], "floor": [0.0]})
            some = trains_of(pdf)
            ratio = consolidation.highest_pairs(some, some, limit, 0.0, None, np.zeros(len(pdf), dtype=bool))[2]
            scale, wanted = (all_of / len(pdf)) ** 2, WANTED * factor * all_of
            few = len(ratio) * scale <= min(wanted, MOST_PAIRS)
            return pd.DataFrame({"seg": [key[0]], "floor": [0.0 if few else float(np.sort(ratio)[-min(len(ratio), max(1, int(min(wanted, MOST_PAIRS) / scale)))])]})

        return run

    def block(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("kind")
        one = pdf.iloc[:1][["seg", "block", "blocks", "words", "floor"]]
        return one.assign(kinds=pdf["kind"].to_numpy(np.int64).tobytes(), sizes=pdf["size"].to_numpy(np.int64).tobytes(), many=(pdf["units"] > 1).to_numpy().tobytes(), bits=b"".join(pdf["bits"]))

    def pair(key, pdf: pd.DataFrame) -> pd.DataFrame:
        first, second = (pdf[pdf["block"] == key[k]].iloc[0] for k in (1, 2))
        read = lambda r: (np.frombuffer(r["sizes"], dtype=np.int64), np.frombuffer(r["bits"], dtype=np.uint64).reshape(-1, int(r["words"])))
        groups, same = int(first["blocks"] * (first["blocks"] + 1) // 2), np.frombuffer(first["many"], dtype=bool) if key[1] == key[2] else None
        i, j, ratio, floor = consolidation.highest_pairs(read(first), read(second), limit, float(first["floor"]), int(first["factor"]) * max(1 << 12, 2 * MOST_PAIRS // groups), same)
        a, z = (np.frombuffer(r["kinds"], dtype=np.int64)[at] for r, at in ((first, i), (second, j)))
        return pd.DataFrame({"seg": [key[0]], "a": [a.tobytes()], "b": [z.tobytes()], "ratio": [ratio.tobytes()], "floor": [floor]})

    def settle(key, units_: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        units_ = units_.sort_values("id")
        a, b = (np.frombuffer(b"".join(found[k]), dtype=np.int64) for k in ("a", "b"))
        ratio = np.frombuffer(b"".join(found["ratio"]), dtype=np.float64)
        whole = ratio >= found["floor"].max() if len(found) else slice(0, 0)
        column = lambda k: units_[k].to_numpy()
        size, bits = trains_of(units_)
        gone = consolidation.settle_highest(column("kind"), column("place"), size, bits, column("mua"), column("snr"), column("n").astype(np.float64), (a[whole], b[whole], ratio[whole]), limit)
        return pd.DataFrame({"seg": [key[0]] * len(gone), "id": column("id")[gone]})

    rounds, factor = [], 1
    while True:
        whole = Window.partitionBy("seg")
        one = left.where("id = lead").select("seg", "kind", "size", "words", "bits", "units", F.row_number().over(whole.orderBy("kind")).alias("r"), F.count("*").over(whole).alias("trains"))
        step = F.when(F.col("trains") > FEW_TRAINS, F.greatest(F.floor(F.col("trains") / SAMPLE), F.lit(1))).otherwise(F.col("trains"))
        floors = one.where(F.col("r") % step == 0)
        floors = staged(floors.groupBy("seg").applyInPandas(floor_of(factor), f"{seg}, floor double"), "floors")
        per = F.least(F.greatest(F.ceil(F.col("trains") / 8), F.lit(64)), F.lit(2048), F.greatest(F.floor(F.lit(1 << 19) / F.col("words")), F.lit(1)))
        one = one.join(floors, "seg").withColumn("block", F.floor((F.col("r") - 1) / per)).withColumn("blocks", F.ceil(F.col("trains") / per))
        blocks = one.groupBy("seg", "block").applyInPandas(block, f"{seg}, block long, blocks long, words long, floor double, kinds binary, sizes binary, many binary, bits binary")
        blocks = staged(blocks, "blocks")
        groups = blocks.groupBy("seg").agg(F.count("*").alias("b")).agg(F.sum(F.col("b") * (F.col("b") + 1) / 2)).first()[0]
        other = F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("other")
        dealt = blocks.select("*", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")
        dealt = dealt.withColumn("factor", F.lit(factor)).repartition(int(min(max(groups or 1, 1), 192)), "seg", "i", "j")
        found = staged(dealt.groupBy("seg", "i", "j").applyInPandas(pair, f"{seg}, a binary, b binary, ratio binary, floor double"), "pairs")
        gone = staged(left.groupBy("seg").cogroup(found.groupBy("seg")).applyInPandas(settle, f"{seg}, id long"), "gone")
        rounds.append(gone)
        if found.where("floor > 0").isEmpty():
            break
        before = left.count()
        left = staged(alike(left.drop("lead", "units").join(gone, ["seg", "id"], "left_anti")), "left")
        factor = factor if 4 * left.count() < 3 * before else 4 * factor
    gone = functools.reduce(DataFrame.unionByName, rounds)
    return table.join(gone, ["seg", "id"]).select(*names)


def unlinked_overlaps(events: DataFrame, links: DataFrame, segments: list[tuple[int, int]], tolerance: int, neighbors: DataFrame | None = None, least: float = 0.75) -> DataFrame:
    """(seg, unit_1, unit_2), units as structs (channel, unit): links by coincident events in the time that two segments
    share, of units that ``links`` (same form) leave free and whose channels are neighbors."""
    last = len(segments) - 1
    bound = lambda values: F.element_at(F.array(*[F.lit(int(x)) for x in values]), F.col("seg") + 1)
    e = events.select("seg", F.struct("channel", "unit").alias("u"), "sample")
    lo, hi = bound([a for a, _ in segments[1:]]), bound([b for _, b in segments[:-1]])
    shared = lambda rows: rows.where((F.col("seg") >= 0) & (F.col("seg") < last)).where((F.col("sample") >= lo) & (F.col("sample") < hi))
    early = shared(e).select("seg", F.col("u").alias("unit_1"), "sample").join(links.select("seg", "unit_1"), ["seg", "unit_1"], "left_anti")
    late = shared(e.withColumn("seg", F.col("seg") - 1)).select("seg", F.col("u").alias("unit_2"), F.col("sample").alias("s2")).join(links.select("seg", "unit_2"), ["seg", "unit_2"], "left_anti")
    w = tolerance + 1
    left = early.withColumn("b", F.explode(F.array(*[F.floor(F.col("sample") / w) + d for d in (-1, 0, 1)])))
    hits = left.join(late.withColumn("b", F.floor(F.col("s2") / w)), ["seg", "b"]).where(F.abs(F.col("sample") - F.col("s2")) <= tolerance)
    if neighbors is not None:
        near = F.broadcast(neighbors.select(F.col("neighbor").alias("c1"), F.col("channel").alias("c2")))
        hits = hits.join(near, (F.col("unit_1.channel") == F.col("c1")) & (F.col("unit_2.channel") == F.col("c2")), "left_semi")
    hits = hits.groupBy("seg", "unit_1", "unit_2").agg(F.greatest(F.countDistinct("sample"), F.countDistinct("s2")).alias("hits"))
    n1, n2 = (x.groupBy("seg", k).agg(F.count("*").alias(f"n_{k}")) for x, k in ((early, "unit_1"), (late, "unit_2")))
    ratios = hits.join(n1, ["seg", "unit_1"]).join(n2, ["seg", "unit_2"]).withColumn("ratio", F.col("hits") / F.least("n_unit_1", "n_unit_2"))
    place = F.dense_rank().over(Window.partitionBy("seg").orderBy("u"))
    ratios = staged(ratios, "ratios")
    ids = ratios.select("seg", F.explode(F.array("unit_1", "unit_2")).alias("u")).distinct().withColumn("id", place.cast("long"))
    lean = ratios.join(ids.select("seg", F.col("u").alias("unit_1"), F.col("id").alias("i")), ["seg", "unit_1"]).join(ids.select("seg", F.col("u").alias("unit_2"), F.col("id").alias("j")), ["seg", "unit_2"])
    found = units.overlap_links(lean.select("seg", F.col("i").alias("unit_1"), F.col("j").alias("unit_2"), "ratio"), least)
    back = ids.select("seg", "u", "id")
    found = found.join(back.select("seg", F.col("id").alias("unit_1"), F.col("u").alias("a")), ["seg", "unit_1"]).join(back.select("seg", F.col("id").alias("unit_2"), F.col("u").alias("b")), ["seg", "unit_2"])
    return found.select("seg", F.col("a").alias("unit_1"), F.col("b").alias("unit_2"))


def _joined(events: DataFrame, links: DataFrame, n_segments: int, fs: float, tolerance: int, refractory: int, least_segments: int, kind: str) -> tuple[DataFrame, DataFrame]:
    named = events.withColumn("u", F.struct("channel", "unit"))
    rooted = staged(units.chains(staged(named.select("seg", F.col("u").alias("unit")).distinct(), "units"), staged(links, "links"), n_segments), "chains")
    kept = neurons.keep_seen_often(rooted, least_segments)
    roots = kept.select("root_seg", "root_unit").distinct().withColumn("id", (F.row_number().over(Window.orderBy("root_seg", "root_unit")) - 1).cast("long"))  # one row a neuron
    kept = kept.join(roots, ["root_seg", "root_unit"]).select("seg", F.col("unit").alias("u"), "id")
    rows = staged(named.join(kept, ["seg", "u"]).select("id", "seg", "channel", F.col("sample").alias("idx"), "sse", "snr"), "rows")
    table = neurons.join_neurons(rows, fs, tolerance, refractory).withColumn("summary_type", F.lit(kind))
    return table, trains.drop_duplicates_by_error(rows, tolerance, ["id"])


def within_channel(events: DataFrame, links: DataFrame, segments: list[tuple[int, int]], fs: float, tolerance: int, refractory: int, least_segments: int = 1) -> tuple[DataFrame, DataFrame]:
    """(neurons, events): units followed over ``links`` (seg, channel, unit_1, unit_2) on their own channel. ``events`` have
    (seg, channel, unit, sample, sse, snr)."""
    pairs = links.select("seg", F.struct("channel", F.col("unit_1").alias("unit")).alias("unit_1"), F.struct("channel", F.col("unit_2").alias("unit")).alias("unit_2"))
    return _joined(events, pairs, len(segments), fs, tolerance, refractory, least_segments, "within_channel")


def across_channels(events: DataFrame, quality: DataFrame, links: DataFrame, segments: list[tuple[int, int]], fs: float, half_clip: int, refractory: int, neighbors: DataFrame | None = None, limit: float = 5.0, least_segments: int = 1, least_overlap: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(neurons, events): redundant units of each segment dropped across channels, the others followed over ``links`` and,
    where these leave them free, over coincident events in the time that neighboring segments share."""
    if len(segments) > 1 and segments[1][0] >= segments[0][1]:
        raise ValueError("segments must share time to be joined across channels")
    gone = redundant_by_segment(events, quality, coincidences(events, half_clip, limit=limit), limit, (fs, min(half_clip, refractory - 1), refractory))
    kept = staged(events.join(staged(gone, "gone"), ["seg", "channel", "unit"], "left_anti"), "kept")
    there = kept.select("seg", "channel", "unit").distinct()
    alive = links.join(there.withColumnRenamed("unit", "unit_1"), ["seg", "channel", "unit_1"], "left_semi")
    alive = alive.withColumn("seg", F.col("seg") + 1).join(there.withColumnRenamed("unit", "unit_2"), ["seg", "channel", "unit_2"], "left_semi").withColumn("seg", F.col("seg") - 1)
    pairs = alive.select("seg", F.struct("channel", F.col("unit_1").alias("unit")).alias("unit_1"), F.struct("channel", F.col("unit_2").alias("unit")).alias("unit_2"))
    pairs = staged(pairs, "links")
    if len(segments) > 1:
        pairs = pairs.unionByName(unlinked_overlaps(kept, pairs, segments, 2 * half_clip, neighbors, least_overlap))
    return _joined(kept, pairs, len(segments), fs, 2 * half_clip, refractory, least_segments, "across_channels")

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fluxweave.operators import probes, signal, trains, units, vectors
from fluxweave.sources import recording
from fluxweave.streaming import detector


def ids(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_voltage_files(spark, tmp_path):
    v = np.arange(24, dtype=np.float32).reshape(3, 8)
    np.save(tmp_path / "v.npy", v)
    v.tofile(tmp_path / "v.bin")
    want = [(c, s, float(v[c, s])) for c in range(3) for s in range(8)]
    assert ids(recording.read_voltage(spark, str(tmp_path / "v.npy"), "r"), "channel", "sample", "v") == want
    raw = recording.read_voltage(spark, str(tmp_path / "v.bin"), "r", 3, "float32")
    assert ids(raw, "channel", "sample", "v") == want
    assert ids(recording.get_voltage(raw, [1], 2, 4), "sample", "v") == [(2, 10.0), (3, 11.0)]
    over = spark.createDataFrame([(1, 2, 0.5)], "channel int, sample long, v double")
    assert ids(recording.get_voltage(recording.set_voltage(raw, over), [1], 2, 4), "sample", "v") == [(2, 0.5), (3, 11.0)]
    with pytest.raises(ValueError):
        recording.read_voltage(spark, str(tmp_path / "v.txt"), "r")
    with pytest.raises(ValueError):
        recording.read_voltage(spark, str(tmp_path / "v.bin"), "r")


def test_probe_neighbors(spark):
    assert len(ids(probes.tetrode(spark), "channel", "neighbor")) == 16
    assert ids(probes.linear(spark, 3), "channel", "neighbor", "pos") == [(0, 0, 0), (0, 1, 1), (1, 0, 0), (1, 1, 1), (1, 2, 2), (2, 1, 0), (2, 2, 1)]
    assert [b for a, b in ids(probes.stereo(spark, 16), "channel", "neighbor") if a == 5] == [2, 3, 4, 5, 6, 7]


def test_dead_time_rests_on_the_last_kept_event(spark):
    e = spark.createDataFrame([("a", s) for s in (0, 3, 6, 9, 20)], "channel string, sample long")
    assert [s for (s,) in ids(trains.dead_time(e, 5, ["channel"]), "sample")] == [0, 6, 20]


def test_duplicates_by_error(spark):
    e = spark.createDataFrame([("a", 0, 2.0), ("a", 1, 1.0), ("a", 2, 1.0), ("a", 9, 5.0)], "unit string, idx long, sse double")
    assert [i for (i,) in ids(trains.drop_duplicates_by_error(e, 2, ["unit"]), "idx")] == [1, 9]


def test_second_pass_events_are_preferred(spark):
    e = spark.createDataFrame([("a", 0, False), ("a", 1, True), ("a", 2, False), ("a", 9, False)], "unit string, idx long, bp boolean")
    assert [i for (i,) in ids(trains.prefer_second_pass(e, 2, ["unit"]), "idx")] == [1, 9]


def test_near_events_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(-500, 500, 200), rng.integers(-500, 500, 80)
    frame = lambda x: spark.createDataFrame(pd.DataFrame({"idx": x}))
    for tol in (0, 3):
        want = sorted(int(x) for x in a if np.abs(b - x).min() <= tol)
        assert [i for (i,) in ids(trains.near_events(frame(a), frame(b), tol), "idx")] == want


def test_empty_trains(spark):
    none = spark.createDataFrame([], "unit string, idx long")
    some = spark.createDataFrame([("u", 5)], "unit string, idx long")
    assert trains.isi_report(none, 1.0, 1, 2).count() == 0
    assert trains.isi_report(some, 1.0, 1, 2).first().firing_rate == 0
    assert [r.n for r in trains.correlogram(none, some, 4, 2).collect()] == [0] * 5
    assert trains.overlap_ratio(none, some, 5).first()[0] == 0


def test_filters_judge_unknown_mua_by_snr(spark):
    u = spark.createDataFrame([(1, 0.5, 1.0), (2, None, 1.0), (3, float("nan"), 3.0), (4, 0.05, 1.0), (5, 0.5, 3.0)], "unit long, mua double, snr double")
    assert [i for (i,) in ids(units.filter_snr_mua(u), "unit")] == [3, 4, 5]
    assert [i for (i,) in ids(units.filter_snr_mua(u, operator="or"), "unit")] == [3]
    with pytest.raises(ValueError):
        units.filter_snr_mua(u, operator="xor")


def test_redundant_units_and_chains(spark):
    nan = float("nan")
    u = spark.createDataFrame([(0, 1, 0.1, 2.0, 100), (0, 2, 0.0, 3.0, 100), (0, 3, nan, 9.0, 100)], "seg int, unit long, mua double, snr double, n long")
    p = spark.createDataFrame([(0, 1, 2, 0.9, 0.1, nan), (0, 2, 3, 0.5, 0.1, nan)], "seg int, unit_1 long, unit_2 long, ratio double, delta_max double, union_mua double")
    assert ids(units.drop_redundant(u, p), "unit") == [(1,), (3,)]
    k = spark.createDataFrame([(s, 7) for s in range(6)] + [(3, 8)], "seg int, unit long")
    links = spark.createDataFrame([(s, 7, 7) for s in range(5) if s != 2], "seg int, unit_1 long, unit_2 long")
    assert ids(units.chains(k, links, 6).where("unit = 7"), "seg", "root_seg") == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 3)]


def test_redundant_units_by_plain_sets(spark):
    """Many pairs of equal ratio, against the rule written with sets."""
    rng = np.random.default_rng(5)
    info = {u: (float("nan") if u % 9 == 0 else int(rng.integers(0, 3)) / 10, int(rng.integers(1, 4)) / 2, int(rng.integers(1, 4))) for u in range(3, 63)}
    links = [(int(a), int(b), int(rng.integers(0, 5)) / 4, 0.05, float(rng.choice([np.nan, 0.05, 0.4]))) for a in info for b in info if a < b and rng.random() < 0.2]
    clean = {u: (0.0 if np.isnan(m) else 1 - m) * s for u, (m, s, _) in info.items()}
    quality = {u: clean[u] * info[u][2] for u in info}
    partners = {u: {u} | {b for a, b, *_ in links if a == u} | {a for a, b, *_ in links if b == u} for u in info}
    gone = set()
    for a, b, ratio, delta, union in sorted(links, key=lambda x: (-x[2], x[0], x[1])):
        if ratio <= 0 or gone & {a, b}:
            continue
        (ma, sa, na), (mb, sb, nb) = info[a], info[b]
        if np.isnan(ma) or np.isnan(mb):
            worse = (b if sa * na > sb * nb else a) if np.isnan(ma) and np.isnan(mb) else a if np.isnan(ma) else b
        else:
            lose = {x: max((quality[p] for p in partners[x] - partners[y]), default=quality[x]) - quality[x] for x, y in ((a, b), (b, a))}
            worse = (a if lose[a] > lose[b] else b) if lose[a] != lose[b] else b if quality[a] > quality[b] else a
            other = a if worse == b else b
            if lose[a] == lose[b] and clean[worse] > clean[other]:
                if len(partners[worse]) < len(partners[other]) or union > min(ma, mb) + delta and union > max(ma, mb):
                    worse = other
        gone.add(worse)
        for p in partners[worse] - {worse}:
            partners[p].discard(worse)
    u = spark.createDataFrame([(0, k, *v) for k, v in info.items()], "seg int, unit long, mua double, snr double, n long")
    p = spark.createDataFrame([(0, *x) for x in links], "seg int, unit_1 long, unit_2 long, ratio double, delta_max double, union_mua double")
    assert [k for (k,) in ids(units.drop_redundant(u, p), "unit")] == sorted(gone)


def test_plans_of_chains_stay_small(spark):
    """One unit in all of 64 segments, one with gaps, one that changes its name: no plan that doubles with each join."""
    k = [(s, 1) for s in range(64)] + [(s, 2) for s in range(64) if s % 10] + [(s, 100 + s) for s in range(64)]
    links = [(s, 1, 1) for s in range(63)] + [(s, 2, 2) for s in range(63) if s % 10 and (s + 1) % 10] + [(s, 100 + s, 101 + s) for s in range(63)]
    found = units.chains(spark.createDataFrame(k, "seg int, unit long"), spark.createDataFrame(links, "seg int, unit_1 long, unit_2 long"), 64)
    want = [(s, 1, 0, 1) for s in range(64)] + [(s, 2, s // 10 * 10 + 1, 2) for s in range(64) if s % 10] + [(s, 100 + s, 0, 100) for s in range(64)]
    assert ids(found, "seg", "unit", "root_seg", "root_unit") == sorted(want)
    assert found._jdf.queryExecution().optimizedPlan().collectLeaves().size() < 20


def test_templates(spark):
    rows = [(1, 0, [1.0, 5.0, 2.0, 0.0]), (1, 1, [3.0, 7.0, 2.0, 0.0]), (2, 2, [0.0, 0.0, 0.0, 9.0])]
    clips = spark.createDataFrame(rows, "unit long, event long, clip array<double>")
    t = {r.unit: r.template for r in vectors.mean_template(clips).collect()}
    assert t == {1: [2.0, 6.0, 2.0, 0.0], 2: [0.0, 0.0, 0.0, 9.0]}
    assert ids(vectors.keep_peak_on_channel(clips, 1, 2), "event") == [(2,)]
    a, b = F.array(*map(F.lit, [1.0, 2.0, 3.0, 4.0])), F.array(*map(F.lit, [5.0, 6.0, 7.0, 8.0]))
    out = spark.range(1).select(vectors.merge_templates(a, F.lit(1.0), b, F.lit(3.0), 2, 2, 1).alias("m")).first().m
    assert out == [(1 + 18) / 4, 2.0, (3 + 24) / 4, 4.0]


def test_clips_at_the_edges(spark):
    v = spark.createDataFrame([(0, s, float(s)) for s in range(10)], "channel int, sample long, v double")
    e = spark.createDataFrame([(0, 1), (0, 5), (0, 9)], "channel int, sample long")
    assert ids(signal.clips(v, e, 2, 3), "event", "clip") == [(5, [3.0, 4.0, 5.0, 6.0, 7.0])]
    near = probes.single(spark)
    assert ids(signal.neighborhood_clips(v, e, near, 2, 3), "event", "clip") == [(5, [3.0, 4.0, 5.0, 6.0, 7.0])]


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    v = rng.normal(size=400)
    order = np.abs(v) > 1.5
    want, last = [], None
    for i in range(1, 400):
        if order[i] and not order[i - 1] and (last is None or i - last >= 7):
            want.append(i)
            last = i
    source = tmp_path / "in"
    schema = "channel int, start long, v array<double>"
    starts = [0, 200, 100, 300]  # the second and third come out of order
    for k, s in enumerate(starts):
        spark.createDataFrame([(0, s, v[s : s + 100].tolist())], schema).coalesce(1).write.mode("append").parquet(str(source))
    blocks = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = detector.detect(blocks, 1.5, 7).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [s for (s,) in ids(spark.table("found"), "sample")] == want
    assert os.path.isdir(source)

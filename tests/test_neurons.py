import numpy as np
from pyspark.sql import functions as F

from fluxweave.functions import synthetic
from fluxweave.operators import alignment, neurons, vectors


def ids(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_events_move_to_their_template(spark):
    t = synthetic.waveform(20).tolist()
    rng = np.random.default_rng(0)
    rows = []
    for k, shift in enumerate((0, 3, -4)):
        wide = rng.normal(0, 0.01, 40)
        wide[10 + shift : 30 + shift] += t
        rows.append((1, 100 * k, wide.tolist()))
    clips = spark.createDataFrame(rows, "unit long, sample long, wide array<double>")
    templates = spark.createDataFrame([(1, t)], "unit long, template array<double>")
    assert [s for (s,) in ids(alignment.align_to_template(clips, templates), "sample")] == [0, 103, 196]
    peak = int(np.abs(t).argmax())
    shifts = alignment.centre_templates(templates, 5)
    assert ids(shifts, "shift") == [(peak - 5,)]
    assert ids(alignment.apply_shifts(clips, shifts), "sample")[0] == (peak - 5,)


def test_wavelets_centre_events(spark):
    rows = []
    for k, shift in enumerate((0, 4, -5)):
        clip = np.zeros(81)
        clip[40 + shift - 12 : 40 + shift + 13] = -np.hanning(25)
        rows.append((0, 1000 * k, clip.tolist()))
    clips = spark.createDataFrame(rows, "channel int, event long, clip array<double>")
    found = ids(alignment.wavelet_align(clips, 20_000, (300, 3000), 40), "event", "sample")
    assert all(abs(s - e - w) <= 1 for (e, s), w in zip(found, (0, 4, -5), strict=True))
    assert alignment.pursuit_clip_width(clips, 1.0, 20, 21) == (20, 21)


def test_boundaries():
    assert neurons.equal_variance_boundary(2.0, 0.0, 1.0) == 1.0
    x = neurons.boundary(0.0, 4.0, 1.0, 4.0)
    f = lambda x, m, v: np.exp(-((x - m) ** 2) / (2 * v)) / np.sqrt(v)
    assert abs(f(x, 0, 1) - f(x, 4, 4)) < 1e-9 and 0 < x < 4


def test_confusion(spark):
    a, b = np.r_[synthetic.waveform(16), np.zeros(16)], np.r_[np.zeros(16), synthetic.waveform(16, 1)]
    templates = spark.createDataFrame([(1, (3 * a).tolist()), (2, (3 * b).tolist())], "unit long, template array<double>")
    stats = templates.select("unit", vectors.sum_squares("template").alias("ss")).withColumn("variance", 0.04 * F.col("ss"))
    stats = vectors.separability(stats, 2.0, None)
    m = {(x, y): p for x, y, p in ids(neurons.pairwise_confusion(stats, templates, 2, 16), "unit_1", "unit_2", "p")}
    assert m[1, 1] > 0.99 and m[2, 2] > 0.99 and m[1, 2] < 0.01 and m[2, 1] < 0.01
    s = ids(neurons.separability_matrix(neurons.pairwise_confusion(stats, templates, 2, 16)), "unit", "misses", "contamination")
    assert len(s) == 2 and all(x[1] < 0.01 and x[2] < 0.01 for x in s)


def test_merge_join_and_links(spark):
    e = spark.createDataFrame([(1, 0, 0, 10, 1.0, 4.0), (2, 0, 1, 11, 0.5, 6.0), (2, 1, 1, 50, 0.5, 6.0), (3, 1, 2, 70, 0.1, 2.0)], "id long, seg int, channel int, idx long, sse double, snr double")
    merged = neurons.merge_units(e, 1, 2, 3, "id")
    assert ids(merged, "id", "idx") == [(1, 11), (1, 50), (3, 70)]
    n = {r.id: r for r in neurons.join_neurons(merged, 10.0, 1, 3).collect()}
    assert n[1].n_spikes == 2 and n[1].duration_s == 3.9 and n[1].channel == [1] and n[1].snr == 6.0 and n[3].firing_rate == 0
    u = spark.createDataFrame([(0, 5, 1, 10), (1, 5, 1, 20), (1, 6, 1, 21), (2, 5, 1, 30)], "seg int, channel int, label int, unit long")
    assert ids(neurons.link_by_label(u), "seg", "unit_1", "unit_2") == [(0, 10, 20), (1, 20, 30)]
    c = spark.createDataFrame([(0, 1, 0, 1), (1, 1, 0, 1), (1, 9, 1, 9)], "seg int, unit long, root_seg int, root_unit long")
    assert ids(neurons.keep_seen_often(c, 2), "seg", "unit") == [(0, 1), (1, 1)]

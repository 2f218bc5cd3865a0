"""Paths that only large inputs take, forced on small ones: they must give what the short ones give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import calibrate, etl, evaluate, lookup


def plain_rising(x, y, w):
    order = np.argsort(x)
    out = []
    for k in order:
        out.append([y[k], w[k], x[k] * w[k], x[k], x[k]])
        while len(out) > 1 and out[-2][0] >= out[-1][0] - 1e-12:
            b, a = out.pop(), out.pop()
            out.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2], a[3], b[4]])
    return out


@pytest.mark.parametrize("kind", ["rising", "noisy", "binary", "falling"])
@pytest.mark.parametrize("limit", [50_000, 20])
def test_isotonic_fit_in_segments(spark, monkeypatch, kind, limit):
    monkeypatch.setattr(calibrate, "MERGED", limit)
    rng = np.random.default_rng(3)
    x = rng.permutation(600) / 7.0
    y = {"rising": x / 90, "noisy": x / 90 + rng.normal(size=600) * 0.2, "binary": (rng.random(600) < x / 90).astype(float), "falling": -x}[kind]
    w = rng.integers(1, 4, 600)
    cells = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(x, y, w)], "x double, y double, w long")
    got = sorted(map(tuple, calibrate.rising_fit(cells).select("mean", "weight", "xw", "first", "last").collect()), key=lambda r: r[3])
    want = plain_rising(x, y, w)
    assert len(got) == len(want) and np.allclose(np.array(got), np.array(want), atol=1e-9)


@pytest.mark.parametrize("limit", [200_000, 0])
def test_curves_that_are_not_broadcast(spark, monkeypatch, limit):
    monkeypatch.setattr(calibrate, "BROADCAST_POINTS", limit)
    monkeypatch.setattr(lookup, "LEAST_HOT", 60)
    rng = np.random.default_rng(4)
    px = np.sort(rng.normal(size=90).round(2))
    px = np.unique(px)
    py = np.cumsum(rng.random(len(px)))
    points = spark.createDataFrame([(float(a), float(b)) for a, b in zip(px, py)], "px double, py double").repartition(3)
    q = [*rng.normal(size=200).tolist(), *px[::5].tolist(), *([0.123] * 120), -99.0, 99.0, None]
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in enumerate(q)], "id long, v double")
    got = {r.id: r.fit for r in calibrate.along_curve(df, "v", points, "fit").collect()}
    assert len(got) == len(q) and got[len(q) - 1] is None
    assert all(got[k] == pytest.approx(float(np.interp(v, px, py)), abs=1e-12) for k, v in enumerate(q) if v is not None)
    assert {r.fit for r in calibrate.along_curve(df, "v", points.where("false"), "fit").collect()} == {None}


def test_isotonic_by_either_path(spark, monkeypatch):
    rng = np.random.default_rng(5)
    ue = rng.normal(size=300).round(2)
    rows = [(k, float(u), float(np.clip(0.5 - u / 3 + rng.normal() * 0.2, -0.3, 1.3))) for k, u in enumerate(ue)]
    df = spark.createDataFrame(rows, "unit long, ue double, target double")
    read = lambda: {r.unit: r.confidence for r in calibrate.isotonic(df.where("unit < 200"), df).collect()}
    scores = lambda: {r.unit: r.ue for r in calibrate.isotonic_scores(df).collect()}
    want, want_scores = read(), scores()
    cells = {}
    for _, u, t in rows[:200]:
        cells.setdefault(-u, []).append(t)
    xs = np.array(sorted(cells))
    px, py = calibrate.centered_isotonic(xs, np.array([np.mean(cells[v]) for v in xs]), np.array([len(cells[v]) for v in xs], float))
    monkeypatch.setattr(calibrate, "MERGED", 10)
    monkeypatch.setattr(calibrate, "BROADCAST_POINTS", 0)
    assert read() == pytest.approx(want, abs=1e-9) and scores() == pytest.approx(want_scores, abs=1e-9)
    assert all(0 <= v <= 1 for v in want.values())


def test_pairs_of_hot_values(spark):
    """One score holds most rows with distinct targets, one target with distinct scores."""
    rng = np.random.default_rng(6)
    ue = np.concatenate([np.full(300, 0.5), rng.random(200).round(2), rng.random(150)])
    target = np.concatenate([rng.random(300), rng.integers(0, 4, 200) / 4, np.full(150, 0.25)])
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(ue, target))], "unit long, ue double, target double")
    r = evaluate.pair_counts(df, []).first()
    du, dt = np.sign(ue[:, None] - ue[None, :]), np.sign(target[:, None] - target[None, :])
    up = np.triu(np.ones_like(du), 1) > 0
    assert (r.n, r.concordant, r.discordant) == (650, int(((du * dt > 0) & up).sum()), int(((du * dt < 0) & up).sum()))
    assert (r.tied_ue, r.tied_target) == (int(((du == 0) & up).sum()), int(((dt == 0) & up).sum()))
    by = {x.g: x for x in evaluate.pair_counts(df.withColumn("g", F.col("unit") % 3), ["g"]).collect()}
    for g in range(3):
        k = np.arange(650) % 3 == g
        sub = up & k[:, None] & k[None, :]
        assert (by[g].n, by[g].concordant, by[g].tied_ue) == (int(k.sum()), int(((du * dt > 0) & sub).sum()), int(((du == 0) & sub).sum()))


def test_hash_order_of_many_keys(spark):
    """Beyond a million, a share of the ids is no residue class, and ids below keep their places."""
    h = etl.hash_order(F.col("id"), 42)
    small = spark.range(0, 1_000_003, 9973).select("id", h.alias("h")).collect()
    assert all(r.h == (r.id * 2654435761 + 42 * 40503) % 1000003 for r in small)
    picked = spark.range(0, 40_000_000).where(h < 50).select("id", (F.col("id") % 1000003).alias("m"))
    rows = picked.collect()
    assert 1500 < len(rows) < 2500 and len({r.m for r in rows}) > 0.9 * len(rows)

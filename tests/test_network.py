"""The network under the nnPU risk: forward, gradients, early stop, scoring."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.learning import models, network
from vitrine.learning.nnpu import fit_nnpu
from vitrine.operators.metrics import weighted_auc


def plain_risk(net, x, y, pi):
    """Risk of one batch, as the formulas say."""
    for l in net.layers:
        z = x @ l.w
        x = np.maximum(l.gain * (z - z.mean(axis=0)) / np.sqrt(z.var(axis=0) + network.EPS) + l.shift, 0)
    s = x @ net.w + net.b
    mean = lambda v, m: np.logaddexp(0, v[m]).mean()
    if not (y == 1).any():
        return mean(s, y == 0)
    if not (y == 0).any():
        return pi * mean(-s, y == 1)
    return pi * mean(-s, y == 1) + max(0, mean(s, y == 0) - pi * mean(s, y == 1))


def frame(spark, x, y, parts=3):
    rows = [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "item_id long, vec array<double>, y int").withColumn("key", F.xxhash64("item_id")).repartition(parts)


def wiggled(sizes, rng):
    net = network.Network.start(sizes, 3)
    theta = net.flat()
    return net.like(theta + rng.normal(0, 0.3, len(theta)))


@pytest.mark.parametrize("hidden", [[], [5], [5, 4]])
@pytest.mark.parametrize("share", [0.0, 0.3, 1.0])
def test_risk_over_tasks_equals_one_batch(spark, hidden, share):
    rng = np.random.default_rng(1)
    x, y = rng.normal(2, 3, (60, 6)), (rng.random(60) < share).astype(int)
    net = wiggled([6, *hidden], rng)
    rows = frame(spark, x, y).persist()
    for pi in (0.2, 0.9):
        assert network.risk_gradient(rows, net, pi)[0] == pytest.approx(plain_risk(net, x, y, pi), abs=1e-9)
    _, g, known = network.risk_gradient(rows, net, 0.4)
    theta = net.flat()
    for i in range(len(theta)):
        e = np.zeros(len(theta))
        e[i] = 1e-6
        slope = (plain_risk(net.like(theta + e), x, y, 0.4) - plain_risk(net.like(theta - e), x, y, 0.4)) / 2e-6
        assert g[i] == pytest.approx(slope, abs=2e-6)
    # moments found near other moments are the same
    again = network.risk_gradient(rows, net, 0.4, near=[(m + 1, v) for m, v in known])[2]
    assert all(np.allclose(a, b) for p, q in zip(known, again, strict=True) for a, b in zip(p, q, strict=True))
    rows.unpersist()


def test_gradient_with_dropout_and_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(network, "DIRECT", 2)
    rng = np.random.default_rng(2)
    rows = frame(spark, rng.normal(size=(50, 4)), np.arange(50) % 2, 4).persist()
    net = wiggled([4, 6, 3], rng)
    theta = net.flat()
    risk = lambda t: network.risk_gradient(rows, net.like(t), 0.4, turn=5, seed=1, drop=0.3)
    g = risk(theta)[1]
    for i in rng.choice(len(theta), 5, replace=False):
        e = np.zeros(len(theta))
        e[i] = 1e-5
        assert g[i] == pytest.approx((risk(theta + e)[0] - risk(theta - e)[0]) / 2e-5, abs=1e-6)
    rows.unpersist()


def test_dropout_keeps_its_share_and_differs_between_steps():
    keys = np.random.default_rng(0).integers(-(2**62), 2**62, 4000)
    a, b = (network.kept(keys, 16, 0, turn, 1, 0.3) for turn in (1, 2))
    assert a.mean() == pytest.approx(1.0, abs=0.02) and (a != b).mean() > 0.3
    assert (network.kept(keys[::-1], 16, 0, 1, 1, 0.3)[::-1] == a).all()


def test_early_stop_keeps_the_best_and_the_first_of_equals(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = frame(spark, rng.normal(size=(30, 3)), np.arange(30) % 3 == 0)
    seen, told = [], iter([0.5, 0.7, 0.7, 0.6, 0.6, 0.9])
    monkeypatch.setattr(network, "_auc", lambda model, _: (seen.append(model), next(told))[1])
    best = network.fit_nnpu_network(rows, rows, 0.4, hidden=[4], epochs=9, patience=3)
    assert len(seen) == 5 and best is seen[1] and best is not seen[2]


def test_patience_counts_checks_not_epochs(spark, monkeypatch):
    from vitrine.learning import nnpu

    rng = np.random.default_rng(3)
    rows = frame(spark, rng.normal(size=(30, 3)), np.arange(30) % 3 == 0)
    for module, fit, names in ((nnpu, nnpu.fit_nnpu, {}), (network, network.fit_nnpu_network, {"hidden": [4]})):
        seen, told = [], iter([0.7, 0.6, 0.6, 0.9, 0.5])
        monkeypatch.setattr(module, "_auc", lambda model, _: (seen.append(model), next(told))[1])
        best = fit(rows, rows, 0.4, epochs=10, check=2, patience=3, **names)
        assert len(seen) == 5 and best is seen[3]


def test_matrix_joins_its_rows_once(spark, monkeypatch):
    from vitrine.learning import fit

    rng = np.random.default_rng(5)
    ids = spark.createDataFrame([(i, "pos" if i % 3 else "unlabeled", "val" if i % 4 == 0 else "train") for i in range(60)], "item_id long, label string, split string")
    store = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=3)]) for i in range(60)], "item_id long, vec array<float>")
    plans, real = [], fit.evaluate_model
    monkeypatch.setattr(fit, "evaluate_model", lambda model, rows: (plans.append(rows._jdf.queryExecution().toString()), real(model, rows))[1])
    fit.train_matrix(ids, {"f": (store, 3)}, ["pos"], ["elkan_noto"])
    assert plans and "Join" not in plans[0]


def test_half_space_is_told_apart_by_nnpu(spark):
    from vitrine.plans.q_learning import R

    assert R.queries["k7_fit_nnpu_half_space"](spark, "/root/testdata/sf0.01").first()["told_apart"]


def test_scoring_equals_the_chain_it_folds(spark, tmp_path):
    rng = np.random.default_rng(4)
    net = wiggled([5, 4, 3], rng)
    known = [(rng.normal(size=h), rng.random(h) + 0.1) for h in (4, 3)]
    mean, std = rng.normal(size=5), np.array([1.0, 2.0, 0.0, 0.5, 3.0])
    model = network.folded(net, known, mean, std, name="a.b", feature="eva02", method="nnpu")
    x = rng.normal(size=(20, 5))
    a = np.divide(x - mean, std, out=np.zeros_like(x), where=std > 0)
    for l, (m, v) in zip(net.layers, known, strict=True):
        a = np.maximum(l.gain * (a @ l.w - m) / np.sqrt(v + network.EPS) + l.shift, 0)
    want = 1 / (1 + np.exp(-(a @ net.w + net.b)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(20, None)], "item_id long, vec array<double>")
    models.save_models(spark, [model, models.LinearScorer("c", "eva02", "x", [models.Member([1.0] * 5, 0.0)])], str(tmp_path / "m"))
    loaded = models.load_models(spark, str(tmp_path / "m"))
    assert model in loaded
    got = {r.item_id: r.inferences for r in models.score_batch(df, loaded, {"eva02": "vec"}).collect()}
    assert [got[i]["a_b"]["score"] for i in range(20)] == pytest.approx(want.tolist()) and set(got[0]) == {"a_b", "c"}
    assert got[20]["a_b"]["score"] is None


def test_network_learns_what_no_plane_divides(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 2))
    truth = x[:, 0] * x[:, 1] > 0
    y = (truth & (rng.random(1500) < 0.6)).astype(int)
    rows = frame(spark, x, y).persist()

    def auc(model):
        scored = rows.select("item_id", model.score(F.col("vec")).alias("score"), F.lit(1.0).alias("weight"))
        known = spark.createDataFrame([(i, int(t)) for i, t in enumerate(truth)], "item_id long, y int")
        return weighted_auc(scored.join(known, "item_id"), []).first()["auc"]

    net = network.fit_nnpu_network(rows, rows, 0.3, hidden=[16], epochs=40, rate=0.05, check=10, parts=2, drop=0.0)
    assert auc(net) > 0.95 and auc(fit_nnpu(rows, rows, 0.3, epochs=20)) < 0.65
    with pytest.raises(ValueError):
        network.fit_nnpu_network(rows.where("y > 5"), rows, 0.3)

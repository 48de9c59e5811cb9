"""Decompositions with known results, invariants and edge cases."""

import pickle
from functools import reduce

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lagweave.operators import coupling, info, learned, posterior, resampled, series, whole
from lagweave.plans import registry
from lagweave.sources.synthetic import causal_series

BIT = np.log(2)


def gate(f, inputs=((0, 0), (0, 1), (1, 0), (1, 1))):
    p = np.zeros((1, max(f(a, b) for a, b in inputs) + 1, 2, 2))
    for a, b in inputs:
        p[0, f(a, b), a, b] += 1 / len(inputs)
    return p


@pytest.mark.parametrize(
    ("p", "want"),
    [
        (gate(lambda a, b: a & b), (0.3113, 0, 0, 0.5)),
        (gate(lambda a, b: a ^ b), (0, 0, 0, 1)),
        (gate(lambda a, b: a, ((0, 0), (1, 1))), (1, 0, 0, 0)),
        (gate(lambda a, b: 2 * a + b), (0, 1, 1, 0)),
    ],
)
def test_gates(p, want):
    d = info.decompose(p)
    assert np.allclose([d[t][0] / BIT for t in ("R", "U1", "U2", "S")], want, atol=5e-5)


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 10**6))
def test_invariants(seed):
    rng = np.random.default_rng(seed)
    p = rng.multinomial(60, np.ones(36) / 36, 3).reshape(3, 4, 3, 3) / 60
    q, _, gap = coupling.coupling(p)
    assert np.abs(q.sum(3) - p.sum(3)).max() < 1e-9 and np.abs(q.sum(2) - p.sum(2)).max() < 1e-9 and gap.max() < 1e-7
    d, swapped = info.decompose(p), info.decompose(np.swapaxes(p, 2, 3))
    relabelled = info.decompose(p[:, ::-1, ::-1, :])
    assert np.allclose(d["U1"], swapped["U2"], atol=2e-8) and np.allclose(d["S"], relabelled["S"], atol=2e-8)
    assert np.allclose(d["R"] + d["U1"] + d["U2"] + d["S"], d["MI"]) and (d["S"] > -1e-8).all()


def test_planted_lags(spark):
    s = causal_series(spark.range(6000), "id", 300)
    h = info.joint_hist_multilag(s, ["subject"], [("x1", "x2")], "y", 4, 3).groupBy("lag", "b1", "b2", "yb").agg(F.sum("n").alias("n"))
    got = {r["lag"]: r for r in info.information(h, ["lag"]).collect()}
    assert max(got, key=lambda k: got[k]["i1"]) == 1 and max(got, key=lambda k: got[k]["i2"]) == 2


def frame(spark, rows):
    df = spark.createDataFrame(rows, "subject long, ts long, x1 double, x2 double, y long")
    return series.series_index(df, ["subject"], ["ts"])


def test_constant_columns_and_short_series(spark):
    rows = [(1, k, 5.0, float(k), k % 2) for k in range(20)] + [(2, 0, 1.0, 1.0, 0)] + [(3, k, None, 1.0, 0) for k in range(5)]
    h = info.joint_hist_multilag(frame(spark, rows), ["subject"], [("x1", "x2")], "y", 3, 4)
    assert {r["b1"] for r in h.where("subject = 1").select("b1").collect()} == {3}
    assert [r["lag"] for r in h.where("subject = 2").collect()] == [0] and h.where("subject = 3").count() == 0
    p = {(r["subject"], r["lag"]): r for r in info.pid(h, ["subject", "lag"]).collect()}
    assert abs(p[1, 0]["U1"]) < 1e-6 and p[2, 0]["MI"] == 0
    assert info.pid(h.where("false"), ["subject", "lag"]).count() == 0


def test_order_of_rows_does_not_matter(spark):
    rng = np.random.default_rng(3)
    rows = [(1, k, float(rng.normal()), float(rng.normal()), int(rng.integers(3))) for k in range(80)]
    one, two = (info.information(info.joint_hist_multilag(frame(spark, r), ["subject"], [("x1", "x2")], "y", 1), ["subject", "lag"]).collect() for r in (rows, rows[::-1]))
    key = lambda r: (r["subject"], r["lag"])
    for a, b in zip(sorted(one, key=key), sorted(two, key=key), strict=True):
        assert np.allclose(a[2:], b[2:])


def test_histograms_count_before_the_shuffle(spark):
    h = info.joint_hist_multilag(frame(spark, [(1, k, 1.0 * k, 2.0, 0) for k in range(9)]), ["subject"], [("x1", "x2")], "y", 2)
    plan = h._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "BroadcastNestedLoopJoin" not in plan


def plain_rounds(p, rounds):
    """The slow way: scale the pooled joint to both margins, class by class, and pool again."""
    rows, columns = p.sum(3), p.sum(2)
    q = coupling.over(rows[..., :, None] * columns[..., None, :], p.sum((2, 3))[..., None, None])
    for _ in range(rounds):
        q = coupling.scaled(np.broadcast_to(q.sum(1, keepdims=True), q.shape), rows, columns, 10)
    return coupling.joint_information(q)


def test_coupling_against_plain_rounds():
    """20 000 plain rounds come to the solver's value, most of them to 1e-6, and no lower, but for what their margins are off."""
    rng = np.random.default_rng(7)
    p = np.concatenate([rng.dirichlet(np.ones(80), 6), rng.multinomial(300, np.ones(80) / 80, 6) / 300]).reshape(-1, 5, 4, 4)
    q, rounds, gap = coupling.coupling(p)
    slow, fast = plain_rounds(p, 20_000), coupling.joint_information(q)
    assert gap.max() < 1e-8 and rounds.max() < 60 and (fast <= slow + 5e-7).all()
    assert np.abs(fast - slow).max() < 5e-5 and np.median(np.abs(fast - slow)) < 1e-6


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6))
def test_coupling_proves_itself(seed):
    """Sparse counts of all sizes: margins kept, dual feasible, gap closed."""
    rng = np.random.default_rng(seed)
    k, m, n = rng.integers(1, 6, 3)
    p = rng.multinomial(rng.integers(1, 80), rng.dirichlet(np.ones(k * m * n) * 0.4), 4).reshape(4, k, m, n).astype("f8")
    p /= p.sum((1, 2, 3), keepdims=True)
    q, _, gap, a, b = coupling.certified(p)
    r, c = p.sum(3), p.sum(2)
    assert np.abs(q.sum(3) - r).max() < 1e-9 and np.abs(q.sum(2) - c).max() < 1e-9 and gap.max() < 1e-7
    there = (r[..., None] > 0) & (c[:, :, None] > 0)
    assert np.where(there, np.exp(a[..., None] + b[:, :, None]), 0).sum(1).max() < 1 + 1e-9
    assert np.allclose((a * r).sum((1, 2)) + (b * c).sum((1, 2)) + gap, coupling.objective(q), atol=1e-9)


def brute(p):
    """Least information about y over the couplings of p[y, 2, 2] for two classes: one free cell a class, on a grid."""
    cells = []
    for k, m in enumerate(p):
        r, c = m.sum(1)[0], m.sum(0)[0]
        t = np.linspace(max(0, r + c - m.sum()), min(r, c), 401).reshape((-1, 1) if k == 0 else (1, -1))
        cells.append([t, r - t, c - t, m.sum() - r - c + t])
    plogp = lambda x: np.where(x > 1e-15, x * np.log(np.maximum(x, 1e-15)), 0)
    both = sum(plogp(a) + plogp(b) - plogp(a + b) for a, b in zip(*cells, strict=True))
    return float((both - sum(plogp(m.sum()) for m in p)).min())


@pytest.mark.parametrize("seed", range(4))
def test_terms_of_a_brute_force_coupling(seed):
    p = np.random.default_rng(seed).dirichlet(np.ones(8)).reshape(2, 2, 2)
    i1, i2, i12 = (float(coupling.joint_information(x[None])[0]) for x in (p.sum(2)[:, :, None], p.sum(1)[:, None, :], p))
    d, iq = info.decompose(p[None]), brute(p)
    want = {"R": i1 + i2 - iq, "U1": iq - i2, "U2": iq - i1, "S": i12 - iq, "MI": i12}
    assert all(abs(float(d[k][0]) - v) < 2e-3 for k, v in want.items())


def test_minibatch_coupling_against_brute_force(spark):
    rows = [(0, [0.9, 0.1], [0.7, 0.3]), (0, [0.2, 0.8], [0.4, 0.6]), (1, [0.55, 0.45], [0.1, 0.9]), (1, [0.95, 0.05], [0.8, 0.2])]
    df = spark.createDataFrame(rows, "batch_id long, p1 array<double>, p2 array<double>")
    got = {r["batch_id"]: r["i_q"] for r in learned.batch_couplings(df, []).collect()}
    for k in (0, 1):
        p = learned.batch_joint(*(np.array([r[c] for r in rows if r[0] == k]) for c in (1, 2)))
        assert abs(got[k] - brute(p)) < 2e-3


def test_equal_posteriors_are_one_row():
    """A batch with repeated posteriors against the same batch with rows that differ by a hair."""
    rng = np.random.default_rng(4)
    states = rng.dirichlet(np.ones(3), 4)
    rows = [states[rng.integers(4, size=24)] for _ in range(2)]
    apart = [r + 1e-9 * rng.normal(size=r.shape) for r in rows]
    one, many = learned.solved([learned.batch_joint(*rows)]), learned.solved([learned.batch_joint(*apart)])
    both = learned.solved([learned.batch_joint(*rows), learned.batch_joint(*apart)])
    assert learned.batch_joint(*rows).shape[1] <= 4 and np.allclose(one[["i_start", "i_q"]], many[["i_start", "i_q"]], atol=1e-6)
    assert np.allclose(both["i_q"], [one["i_q"][0], many["i_q"][0]], atol=1e-6)


@pytest.mark.parametrize("name", ["multi_lag_pid_terms", "temporal_pid_batch_terms", "pid_multi_sequence_terms"])
def test_registered_terms(spark, name):
    got = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert {"R", "U1", "U2", "S", "MI"} <= set(got.columns) and name not in registry.ORACLES and got.count() > 0


def test_zscored_is_numpy_s(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(3, 5, (40, 3))
    v[:, 2] = 7
    df = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(v)], "k long, v array<double>")
    got = np.array([r["v"] for r in resampled.zscored(df, ["v"]).orderBy("k").collect()])
    assert np.allclose(got, (v - v.mean(0)) / (v.std(0) + 1e-8))
    assert resampled.zscored(df.where("false"), ["v"]).count() == 0


def signals(spark, n):
    """y tells the first signal's sign one step before, the second signal nothing."""
    rng = np.random.default_rng(2)
    a, b = rng.choice([-1, 1], n) * rng.uniform(1, 1.5, n), rng.normal(size=n)  # a gap between the signs, so a fitted posterior is sure
    y = np.concatenate([[0], (a[:-1] > 0).astype(int)])
    return series.series_index(spark.createDataFrame([(1, k, [float(p)], [float(q)], int(c)) for k, (p, q, c) in enumerate(zip(a, b, y, strict=True))], "s long, k long, a array<double>, b array<double>, y long"), ["s"], ["k"])


def test_resampled_terms_on_held_out_rows(spark):
    got = {r["lag"]: r for r in resampled.temporal_batch(signals(spark, 500), ["s"], "k", [("a", "b")], "y", [0, 1, 499, 700], 2, size=16, resamples=2).collect()}
    assert got[1]["U1"] > 0.8 and max(got[1]["R"], got[1]["U2"], got[1]["S"]) < 0.1 and got[0]["MI"] < 0.2 and got[1]["gap"] < 2e-7
    assert [(got[k]["train_rows"], got[k]["test_rows"], got[k]["method"]) for k in (0, 1, 499, 700)] == [(400, 100, "batch"), (399, 100, "batch"), (0, 1, "failed"), (0, 0, "failed")]
    assert np.isnan(got[499]["MI"]) and np.isnan(got[700]["MI"])


def labelled(spark, n, label):
    """Three signals of normal numbers and a label of the first two; the third has no numbers in every other row."""
    x = np.random.default_rng(5).normal(size=(n, 3))
    rows = [(k % 3, k, [float(a)], [float(b)], [float(c)] if k % 2 else None, int(label(a, b))) for k, (a, b, c) in enumerate(x)]
    return series.series_index(spark.createDataFrame(rows, "who long, k long, a array<double>, b array<double>, c array<double>, y long"), ["who"], ["k"])


def test_synergy_of_a_nonlinear_label(spark):
    """An exclusive or of signs is synergy, which a posterior that is linear in both signals can't see; a label by chance is nothing."""
    pairs = [("a", "b"), ("a", "c")]
    got = {(r["mod1"], r["mod2"]): r for r in resampled.temporal_batch(labelled(spark, 6000, lambda a, b: (a > 0) ^ (b > 0)), ["who"], "k", pairs, "y", [0], 2, resamples=2).collect()}
    one = got["a", "b"]
    assert one["S"] > 0.8 and max(one["R"], one["U1"], one["U2"]) < 0.05 and one["lost"] < 0.02 and one["test_rows"] == 1200
    assert got["a", "c"]["MI"] < 0.05 and got["a", "c"]["method"] == "batch"
    rng = np.random.default_rng(6)
    assert resampled.temporal_batch(labelled(spark, 6000, lambda a, b: rng.integers(2)), ["who"], "k", [("a", "b")], "y", [0], 2, resamples=2).first()["MI"] < 0.05


def all_models(spark, monkeypatch, rows, lags, **options):
    """The fitted rows and the models, by what was fitted, of three modalities' posteriors."""
    kept, real = [], resampled.scored
    monkeypatch.setattr(resampled, "scored", lambda base, models, *more: kept.append((base, models)) or real(base, models, *more))
    got = resampled.temporal_batch(rows, ["who"], "k", [("a", "b"), ("a", "c")], "y", lags, 2, **options).collect()
    base, models = kept[0]
    return got, base.where("_train").toPandas(), {(r["_fit"], r.asDict().get("lag")): pickle.loads(r["model"]) for r in models.collect()}


@pytest.mark.parametrize("few", [True, False])
def test_fits_see_all_training_rows(spark, monkeypatch, few):
    """Standardised by all rows and at the least of all rows' loss, whether or not the models are broadcast; a sample's model is neither."""
    monkeypatch.setattr(whole, "BROADCAST", whole.BROADCAST if few else 0)
    monkeypatch.setattr(resampled, "PACK", 200)
    rng = np.random.default_rng(3)
    got, train, models = all_models(spark, monkeypatch, labelled(spark, 6000, lambda a, b: a + b + rng.normal() > 0), [0, 1])
    assert len(got) == 4 and {r["train_rows"] for r in got} == {4800, 4797} and len(models) == 2 * 5
    for (f, lag), (model, states) in models.items():
        names = resampled.fits_of([("a", "b"), ("a", "c")])[f]
        there, x = resampled.inputs(train[train["lag"] == lag], names)
        y = train[train["lag"] == lag]["y"].to_numpy()[there]
        raw, w = model.features(x)[:, 1:], model.weights[1:]
        assert np.abs(model.mean - x.mean(0)).max() < 1e-12 and np.abs(model.scale * x.std(0) - 1).max() < 1e-9
        slope = (raw - raw.mean(0)).T @ (model.predict(x) - np.eye(2)[y]) / len(x) + (model.ridge * w if w.any() else 0)
        assert not w.any() or np.abs(slope).max() < 1e-3
        assert (states is None) == (len(names) == 2) and (states is None or posterior.divergences(model.predict(x), states).min(1).mean() < 1e-3)
    assert sum(m.weights[1:].any() for m, _ in models.values()) >= 5


def test_whole_fits_by_blocks_and_weights():
    """Blocks add up, whatever their number, and a row of weight 2 is two rows; a modality without rows in a block is no hindrance."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 2))
    y, share, held = np.digitize(x[:, 0] * x[:, 1], [-0.3, 0.3]), rng.integers(1, 3, 3000), rng.random(3000) < 0.2

    def model(parts, times):
        i = np.repeat(np.arange(3000), share if times else 1)
        blocks = [({"a": np.ones(len(k), bool)}, {"a": x[k]}, np.zeros((len(k), 0)), y[k], (np.ones(len(k)) if times else share[k].astype(float)), held[k]) for k in np.array_split(i, parts)]
        blocks.append(({"a": np.zeros(1, bool)}, {"a": None}, np.zeros((1, 0)), y[:1], np.ones(1), held[:1]))
        fit = whole.Fit(True, 3, 1, 96, 0)
        while fit.kind:
            sums = [whole.asked_of(b, ("a",), 3, *fit.asks()) for b in blocks]
            fit.take(reduce(lambda a, b: whole.added(fit.kind, a, b), [s for s in sums if s is not None]))
        return fit

    one, many, twice = model(1, False), model(7, False), model(3, True)
    p = one.model.predict(x)
    assert np.abs(many.model.predict(x) - p).max() < 1e-3 and np.abs(twice.model.predict(x) - p).max() < 1e-3
    assert np.isfinite(one.model.ridge) and (p.argmax(1) == y).mean() > 0.9 and 3 < len(one.states) <= posterior.STATES
    cells = whole.cells_of(p, share.astype(float), 8)
    halves = whole.added("states", whole.cells_of(p[:1000], share[:1000].astype(float), 8), whole.cells_of(p[1000:], share[1000:].astype(float), 16))
    assert (cells[0] == halves[0]).all() and np.allclose(cells[1], halves[1]) and abs(cells[1][:, -1].sum() - share.sum()) < 1e-6


def test_posteriors_by_themselves():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 2))
    y = np.digitize(x[:, 0] * x[:, 1], [-0.3, 0.3])
    model = posterior.fit(x[:1500], y[:1500], 3)
    p = model.predict(x[1500:])
    assert np.allclose(p.sum(1), 1) and (p.argmax(1) == y[1500:]).mean() > 0.85
    states = posterior.codebook(p)
    near = posterior.divergences(p, states)
    assert len(states) <= posterior.STATES and near.min() > -1e-9 and near.min(1).mean() < 0.02
    for x, y in ((np.zeros((20, 2)), np.arange(20) % 2), (rng.normal(size=(20, 2)), np.zeros(20, "i8")), (rng.normal(size=(1, 3)), np.array([1]))):
        p = posterior.fit(x, y, 2).predict(x)  # nothing to learn: the class shares
        assert np.isfinite(p).all() and np.allclose(p, p[0]) and (abs(p[0].sum() - 1) < 1e-9)


def test_groups_and_pairs_are_one_job(spark):
    """Subjects' own posteriors, all pairs and lags: as many Spark jobs as for one."""
    s = labelled(spark, 900, lambda a, b: a > 0)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("grouped-fits", "")
    got = resampled.temporal_batch(s, ["who"], "k", [("a", "b"), ("a", "c"), ("b", "c")], "y", [0, 1], 2, by=["who"], size=8, resamples=3).collect()
    jobs = len(tracker.getJobIdsForGroup("grouped-fits"))
    spark.sparkContext._jsc.clearJobGroup()
    assert jobs < 20, jobs  # of 9 groups of fits and 81 models
    by = {(r["who"], r["mod1"], r["mod2"], r["lag"]): r for r in got}
    assert len(got) == len(by) == 18 and all(by[k, "a", "b", 0]["U1"] > 0.5 and by[k, "a", "b", 1]["MI"] < 0.4 for k in range(3))


def test_one_model_for_all_lags_finds_the_planted_one(spark):
    s = causal_series(spark.range(9000), "id", 300).withColumns({c: F.array(c) for c in ("x1", "x2")} | {"y": (F.col("y") > 0).cast("long")})
    s = s.withColumn("key", F.col("subject") * 1000 + F.col("i"))
    got = {r["lag"]: r for r in resampled.temporal_batch(s, ["subject"], "key", [("x1", "x2")], "y", range(5), 2, weights=[1, 1, 1, 0.5, 0.5], resamples=2).collect()}
    assert max(got, key=lambda k: got[k]["i1"]) == 1 and max(got, key=lambda k: got[k]["i2"]) == 2
    assert min(got, key=lambda k: got[k]["loss"]) in (1, 2) and got[1]["i1"] > 3 * got[4]["i1"]


def test_one_model_for_all_lags_sees_all_rows_by_weight(spark, monkeypatch):
    rng = np.random.default_rng(7)
    weights = [0.6, 0.3, 0.1]
    got, train, models = all_models(spark, monkeypatch, labelled(spark, 3000, lambda a, b: a + b + rng.normal() > 0), [0, 1, 2], weights=weights)
    assert len(got) == 6 and len(models) == 5
    for (f, _), (model, _) in models.items():
        names = resampled.fits_of([("a", "b"), ("a", "c")])[f]
        means = [[np.stack(train[m][train[m].notna() & (train["lag"] == k)].to_numpy()).mean(0) for m in names] for k in range(3)]
        if "c" not in names:  # whose rows are as many at each lag
            assert np.abs(model.mean[: len(names)] - np.average([np.concatenate(m) for m in means], axis=0, weights=weights)).max() < 1e-12
            assert np.abs(model.mean[len(names) :] - weights).max() < 1e-12


def test_fit_posterior(spark):
    df = labelled(spark, 2000, lambda a, b: (a > 0) ^ (b > 0)).withColumn("f", F.concat("a", "b"))
    train = F.col("i") < 400
    got = learned.fit_posterior(df, "f", "y", 2, train=train).where(~train).select("y", "posterior").collect()
    assert np.mean([r["posterior"][r["y"]] > 0.5 for r in got]) > 0.9 and all(abs(sum(r["posterior"]) - 1) < 1e-9 for r in got)
    holes = df.withColumn("f", F.when(F.col("i") % 2 == 0, F.col("f")))
    assert learned.fit_posterior(holes, "f", "y", 2).where("posterior is null").count() == holes.where("f is null").count()
    assert learned.fit_posterior(df.where("false"), "f", "y", 2).count() == 0


def test_method_by_width(spark):
    assert [resampled.choose_method(w) for w in (2, 10, 50, 51)] == ["joint", "joint", "joint", "batch"]
    s = signals(spark, 300).withColumnRenamed("s", "who")
    one = resampled.vector_terms(s, ["who"], "k", [("a", "b")], "y", 2, lags=[1, 400], bins=4, by=["who"]).orderBy("lag").collect()
    assert one[0]["method"] == "joint" and one[0]["U1"] + one[0]["R"] > 0.5 and one[0]["U2"] < 0.1
    assert one[1]["method"] == "failed" and np.isnan(one[1]["R"])
    with pytest.raises(ValueError):
        resampled.vector_terms(s, ["who"], "k", [("a", "b")], "y", 2, method="other")
    with pytest.raises(ValueError):
        resampled.sequence_batch(s, "who", [("a", "b")], "y", [0], 2, pooling="other")


def test_lags_without_rows_are_failed(spark):
    found = spark.createDataFrame([(1, 0, 0.5, 0.5), (1, 1, float("nan"), float("nan"))], "s long, lag long, R double, MI double")
    groups = spark.createDataFrame([(1,), (1,), (2,)], "s long")
    got = {(r["s"], r["lag"]): r for r in info.with_failed_lags(found, groups, ["s"], range(2)).collect()}
    assert len(got) == 4 and got[1, 0]["method"] == "joint" and got[1, 0]["R"] == 0.5
    assert all(np.isnan(got[k]["R"]) and got[k]["method"] == "failed" for k in ((1, 1), (2, 0), (2, 1)))


def test_reduced_states(spark):
    assert [learned.reduction(w) for w in (10, 11, 20, 21)] == ["none", "pca", "pca", "cluster"]
    rng = np.random.default_rng(9)
    kind = rng.integers(0, 3, 300)
    wide = rng.normal(size=(300, 12)) * 0.1 + kind[:, None] * 5.0  # three clouds; y is the cloud one step before
    rows = [(1, k, [float(x) for x in v], [float(rng.normal())], int(kind[k - 1]) if k else 0) for k, v in enumerate(wide)]
    s = series.series_index(spark.createDataFrame(rows, "s long, k long, a array<double>, b array<double>, y long"), ["s"], ["k"])
    for method in ("auto", "cluster", "none"):
        h = learned.reduced_hist(s, ["s"], "a", "b", "y", 1, method, k=3)
        got = {r["lag"]: r for r in info.information(h, ["lag"]).collect()}
        assert got[1]["i1"] > 0.95 * np.log(3) > 5 * got[0]["i1"] and h.first()["method"] == {"auto": "pca"}.get(method, method)
    assert h.agg(F.countDistinct("b2")).first()[0] > 3  # one number isn't clustered, but binned
    with pytest.raises(ValueError):
        learned.reduction(5, "other")


def test_no_minibatch_tells_more_than_its_start():
    """Posteriors that tell next to nothing: the start is the least within rounding, and a step must not be kept for less than that."""
    rng = np.random.default_rng(0)
    one, two = rng.dirichlet(np.full(5, 200), 4), rng.dirichlet(np.full(5, 2000), 4)
    joints = [learned.batch_joint(one[rng.choice(4, 64, p=(0.9, 0.08, 0.015, 0.005))], two[rng.integers(4, size=64)]) for _ in range(600)]
    found = learned.solved(joints)
    assert (found["i_q"] <= found["i_start"]).all() and found["gap"].max() < 1e-7 and found["off"].max() < 1e-12


def test_pooled_counts_leave_the_series_out_of_the_shuffle(spark):
    rng = np.random.default_rng(5)
    rows = [(s, k, float(rng.normal()), float(rng.integers(9)), int(rng.integers(3))) for s in range(6) for k in range(30)]
    s = frame(spark, rows).withColumn("cohort", F.col("subject") % 2)
    h = info.joint_hist_multilag(s, ["cohort", "subject"], [("x1", "x2")], "y", 3, 4, by=["cohort"])
    plan = h._jdf.queryExecution().executedPlan().toString()
    want = info.joint_hist_multilag(s, ["cohort", "subject"], [("x1", "x2")], "y", 3, 4).groupBy(*h.columns[:-1]).agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, h.collect())) == sorted(map(tuple, want.collect()))
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "mod1" in line]
    assert "Join" not in plan and len(dealt) == 1 and "subject" not in dealt[0], plan


def test_ranks_and_edges_of_series_need_no_join(spark):
    s = frame(spark, [(1, k, float(k % 3), None if k == 4 else float(k % 2), k % 2) for k in range(9)])
    for df in (info.joint_hist_multilag(s, ["subject"], [("x1", "x2")], "y", 2, 4, "auto"), info.transfer_entropies(s, ["subject"], [("x1", "x2")], [1, 2])):
        assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    h = info.joint_hist_multilag(s, ["subject"], [("x1", "x2")], "y", 0, 4, "auto")
    assert {r["b2"] for r in h.collect()} == {0, 1} and h.agg(F.sum("n")).first()[0] == 8


def test_parts_follow_the_rows(spark):
    df = spark.range(1000).withColumn("subject", F.col("id") % 200)
    assert series.spread(df, ["subject"], 1000, 100).rdd.getNumPartitions() == 10
    assert series.spread(df, ["subject"], 1000, 10_000) is df
    many = spark.range(100_000).select((F.col("id") % 50_000).alias("g"), (F.col("id") % 2).alias("b1"), F.lit(0).alias("b2"), (F.col("id") % 3).alias("yb"), F.lit(1).alias("n"))
    assert info.gathered(many, ["g"]).rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism


def test_scores_come_in_blocks():
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(700, 8)), rng.integers(0, 3, 700)
    model = posterior.fit(x, y, 3, 1, 32, 2)
    model.weights = rng.normal(size=model.weights.shape)
    assert np.abs(model.predict(x) - posterior.softmax(model.features(x) @ model.weights)).max() < 1e-12


def test_equal_inputs_are_scored_once():
    rng = np.random.default_rng(9)
    x, y = rng.integers(0, 3, (500, 2)).astype(float), rng.integers(0, 4, 500)
    one, counts = resampled.weighed(x, y, 4)
    assert len(one) == 9 and counts.sum() == 500
    for row, c in zip(one, counts, strict=True):
        assert (np.bincount(y[(x == row).all(1)], minlength=4) == c).all()
    z = rng.normal(size=(50, 2))
    assert resampled.weighed(z, y[:50], 4)[0] is z

"""Boosted trees and ridge against brute force and closed forms, and the grid over them."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from shelfcast.operators import boosting as B
from shelfcast.operators import ridge as RG
from shelfcast.plans import model as MD
from shelfcast.session import new_output_path

N = 400


def sample(seed=0):
    """Flags, a negative flag, few and many values, a constant, a copy of a flag."""
    rng = np.random.default_rng(seed)
    flag = rng.integers(0, 2, N)
    x = np.column_stack([
        flag, -0.7 * rng.integers(0, 2, N), rng.normal(size=N), rng.integers(0, 9, N), np.zeros(N), rng.normal(size=N), flag,
    ])
    return x, 2 * x[:, 2] + x[:, 0] * x[:, 5] - x[:, 1] + rng.normal(size=N) * 0.1 + 3


def frame(spark, x, y, parts=5):
    return spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], ["features", "label"]).repartition(parts)


def brute_boosting(x, y, ensemble, bins):
    """Every cut of every slot of every node by direct sums."""
    margin = np.full(len(y), round(float(y.mean()), 6))
    cuts = {s: c for s, c in zip(bins.many, bins.cuts)} | {s: [v / 2] for s, v in zip(bins.single, bins.values)}
    for _ in range(ensemble.trees):
        gradient = np.rint((margin - y) / B.GRADIENT_STEP) * B.GRADIENT_STEP

        def grow(rows, level):
            total, best, found = gradient[rows].sum(), B.LEAST_GAIN, None
            for slot in [*bins.many, *bins.single] if level < ensemble.depth else []:
                for cut in cuts[slot]:
                    left, right = rows[x[rows, slot] <= cut], rows[x[rows, slot] > cut]
                    if len(left) and len(right):
                        gain = sum(gradient[r].sum() ** 2 / (len(r) + B.L2) for r in (left, right)) - total**2 / (len(rows) + B.L2)
                        if gain > best + 1e-12:
                            best, found = gain, (left, right)
            if found is None:
                margin[rows] -= ensemble.rate * total / (len(rows) + B.L2)
            else:
                for part in found:
                    grow(part, level + 1)

        grow(np.arange(len(y)), 0)
    return margin


ENSEMBLES = [B.Ensemble(3, 0.3, 4), B.Ensemble(2, 0.1, 7)]


@pytest.mark.parametrize("task_bytes", [32 << 20, 0])
def test_boosting_equals_brute_force(spark, monkeypatch, task_bytes):
    """Both as a task an ensemble and as passes over the blocks, rewritten on the way."""
    monkeypatch.setattr(B, "TASK_BYTES", task_bytes)
    monkeypatch.setattr(B, "REWRITE", 2)
    x, y = sample()
    df = frame(spark, x, y)
    bins = B.find_bins(df)
    assert bins.many == [2, 3, 5] and bins.single == [0, 1, 6] and len(bins.cuts[0]) == B.MAX_BINS - 1
    for ensemble, (model, seconds) in zip(ENSEMBLES, B.fit_ensembles(df, ENSEMBLES)):
        expected = brute_boosting(x, y, ensemble, bins)
        assert np.abs(model.staged([ensemble.trees])(x)[0] - expected).max() < 1e-12
        assert len(seconds) == ensemble.trees and seconds == sorted(seconds)


def test_passes_of_many_partitions_give_the_same_trees(spark, monkeypatch):
    x, y = sample(3)
    whole = B.fit_ensembles(frame(spark, x, y, 1), ENSEMBLES[:1])[0][0]
    monkeypatch.setattr(B, "TASK_BYTES", 0)
    monkeypatch.setattr(B, "BLOCK_ROWS", 7)
    monkeypatch.setattr(B, "PARTITION_BYTES", 40)
    monkeypatch.setattr(B, "DRIVER_PARTS", 4)
    dealt = B.fit_ensembles(frame(spark, x, y, 9), ENSEMBLES[:1])[0][0]
    assert all(np.array_equal(a, b) for a, b in zip(whole.arrays(), dealt.arrays()))


def one_hot_sample():
    """A store and its city one-hot, a day with its month and price, a flag: slots that depend on each other."""
    rng = np.random.default_rng(5)
    store, day, flag = rng.integers(0, 12, N), rng.integers(0, 40, N), rng.integers(0, 2, N)
    price = rng.normal(size=40)[day]
    x = np.column_stack([np.eye(12)[store], np.eye(4)[store // 3], day // 10, price, flag, rng.normal(size=N)])
    return x, price * (store % 3) + flag + rng.normal(size=N) * 0.1


def test_slots_counted_together_give_the_same_trees(spark, monkeypatch):
    """A task counts the 20 slots as fewer columns, and a block holds one-hot slots in few bytes."""
    x, y = one_hot_sample()
    df = frame(spark, x, y, 3)
    together = B.fit_ensembles(df, ENSEMBLES)
    bins = B.find_bins(df)
    for ensemble, (model, _) in zip(ENSEMBLES, together):
        assert np.abs(model.staged([ensemble.trees])(x)[0] - brute_boosting(x, y, ensemble, bins)).max() < 1e-12
    batch = pa.RecordBatch.from_arrays([pa.array(x.tolist()), pa.array(y)], names=["x", "label"])
    blocks = pa.Table.from_batches(B._blocks(bins, 0.0, 1)([batch]))
    assert sum(len(blocks.column(c)[0].as_py()) for c in ("ones", "one_slot")) <= N * 8
    columns, label, _ = B._columns(blocks, bins)
    assert len(columns) <= 5 and np.array_equal(label, y)
    assert sorted(s for c in columns for own in c.slots for s in own) == list(range(20))
    monkeypatch.setattr(B, "TASK_BYTES", 0)
    for (a, _), (b, _) in zip(together, B.fit_ensembles(df, ENSEMBLES)):
        assert all(np.array_equal(p, q) for p, q in zip(a.arrays(), b.arrays()))


def test_a_prefix_is_a_fit_with_fewer_trees(spark):
    x, y = sample(1)
    df = frame(spark, x, y)
    long = B.fit_ensembles(df, [B.Ensemble(4, 0.1, 12)])[0][0]
    short = B.fit_ensembles(df, [B.Ensemble(4, 0.1, 5)])[0][0]
    assert all(np.array_equal(a, b) for a, b in zip(long.prefix(5).arrays(), short.arrays()))
    stages = long.staged([0, 5, 12])(x)
    assert np.array_equal(stages[1], short.staged([5])(x)[0]) and np.allclose(stages[0], y.mean(), atol=1e-6)


def test_root_histogram_adds_up(spark):
    x, y = sample()
    rows = B.root_histogram(frame(spark, x, y)).collect()
    gradient = np.rint((round(float(y.mean()), 6) - y) / B.GRADIENT_STEP).astype(int)
    for slot in (0, 1, 2, 3, 5, 6):
        of_slot = [r for r in rows if r.slot == slot]
        assert sum(r["rows"] for r in of_slot) == N and sum(r.gradient for r in of_slot) == gradient.sum()
        assert [r.gain is None for r in sorted(of_slot)] == [False] * (len(of_slot) - 1) + [True]
    assert not [r for r in rows if r.slot == 4]


def test_learners_refuse_or_define_what_has_no_fit(spark):
    none = spark.createDataFrame([(Vectors.dense([1.0]), 1.0)], ["features", "label"]).where("label > 1")
    with pytest.raises(ValueError, match="no training rows"):
        B.fit_ensembles(none, ENSEMBLES)
    constant = frame(spark, np.ones((20, 2)), np.full(20, 4.0))
    assert B.fit_ensembles(constant, ENSEMBLES[:1])[0][0].staged([4])(np.ones((2, 2)))[0].tolist() == [4.0, 4.0]
    fit = RG.fit_ridge(constant, [1.0])[0]
    assert fit.coefficients.tolist() == [0.0, 0.0] and fit.intercept == pytest.approx(4.0)
    assert RG.fit_ridge(none, [1.0])[0].intercept == 0.0


@pytest.mark.parametrize("seed", [0, 1])
def test_ridge_solves_the_normal_equations(spark, seed):
    """With columns that depend on each other, and all alphas from one run."""
    x, y = sample(seed)
    x = np.column_stack([x, 1 - x[:, 0], 1000 + 5 * x[:, 2]])
    df = frame(spark, x, y)
    centred = x - x.mean(axis=0)
    for fit in RG.fit_ridge(df, [0.1, 1.0, 10.0, 0.001]):
        exact = np.linalg.solve(centred.T @ centred + fit.alpha * np.eye(x.shape[1]), centred.T @ (y - y.mean()))
        assert np.abs(fit.coefficients - exact).max() < 1e-6
        assert fit.intercept == pytest.approx(y.mean() - x.mean(axis=0) @ exact, abs=1e-3)
        equations = RG.normal_equations(df, fit)
        assert equations.where("abs(residual) > 1e-6 * scale").count() == 0 and equations.count() == x.shape[1] + 1
    # An equation is not solved by another alpha's fit.
    wrong = RG.fit_ridge(df, [10.0])[0]._replace(alpha=0.1)
    assert RG.normal_equations(df, wrong).where("abs(residual) > 1e-6 * scale").count() > 0


def test_models_save_load_and_score(spark):
    x, y = sample(2)
    df = frame(spark, x, y, 2)
    boosted = B.BoostedTrees(6, 3, 0.2).fit(df)
    linear = RG.Ridge(1.0).fit(df)
    for model in (boosted, linear):
        path = new_output_path(spark, "learner")
        PipelineModel(stages=[model]).save(path)
        again = PipelineModel.load(path)
        before, after = (sorted(r.prediction for r in m.transform(df).collect()) for m in (model, again))
        assert before == after and len(before) == N and again.stages[0].numFeatures == x.shape[1]


def test_grid_is_scored_as_each_model_alone(spark):
    x, y = sample(4)
    df = frame(spark, x, y).withColumn("sales", F.expm1("label"))
    configs = MD.expand_grid({
        "Ridge Regression": {"alpha": [0.1, 10.0]},
        "Boosted Trees": {"n_estimators": [2, 5], "max_depth": [2, 3], "learning_rate": [0.3]},
    })
    fitted = MD.fit_grid(df, configs)
    assert len(fitted) == 6 and [m.trees for m, _ in fitted[2:]] == [2, 2, 5, 5]
    scored = MD.grid_predictions([m for m, _ in fitted], df, "label")
    for run, ((method, p), _) in enumerate(zip(configs, fitted)):
        alone = MD.predictions(MD.build_estimator(method, p).fit(df), df)
        expected = sorted(r.predicted_sales for r in alone.collect())
        got = sorted(r.predicted_sales for r in scored.where(F.col("run_id") == run).collect())
        assert np.allclose(got, expected, rtol=1e-9)


def test_whole_grid_and_its_winner(spark):
    configs = MD.expand_grid(MD.MODEL_GRIDS)
    assert len(configs) == 30 and len({(m, str(p)) for m, p in configs}) == 30
    winner = {"n_estimators": 500, "max_depth": 8, "learning_rate": 0.05}
    rows = [(k, m, str(sorted(p.items())), 0.4 if p == winner else 0.5, 13.0) for k, (m, p) in enumerate(configs)]
    board = spark.createDataFrame(rows, "run_id int, method string, parameters string, rmsle double, wape_pct double")
    assert MD.select_model(board).first().parameters == str(sorted(winner.items()))

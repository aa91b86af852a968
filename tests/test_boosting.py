"""Penalised boosted trees against a plain version with lists."""

import math
import random

import pytest
from conftest import day
from pyspark.sql import functions as F

from eventlab.operators import boosting as B
from eventlab.operators import models as MO

X = ["a", "b", "c"]
EDGES = {"a": [-1.0, -0.5, 0.0, 0.5, 1.0], "b": [-0.7, 0.0, 0.7], "c": [0.0]}
SCHEMA = "symbol string, date date, a double, b double, c double, y int, is_validation boolean"
PENALISED = {"n_estimators": 3, "max_depth": 3, "reg_alpha": 0.4, "reg_lambda": 1.5, "min_child_weight": 2, "min_split_loss": 0.2, "scale_pos_weight": 2.5}


def made_rows(n=400, seed=4):
    r = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = r.gauss(0, 1), r.gauss(0, 1), r.gauss(0, 1)
        y = int(a * b > 0.1 or c + r.gauss(0, 0.3) > 1)
        out.append((f"s{i % 17}", day("2020-01-01").replace(day=1 + i % 28, month=1 + i // 28 % 12), a, None if i % 19 == 0 else b, c, y, i % 4 == 0))
    return out


@pytest.fixture(scope="module")
def rows():
    return made_rows()


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).cache()


def rint(x):
    return int(round(x))  # halves to even, as NumPy


def shrunk(g, alpha):
    return max(abs(g) - alpha, 0)


def plain_trees(rows, config, edges):
    """Nested tuples (feature, threshold, left, right) or leaf values."""
    c = B.BoostConfig.of(config)
    data = [([r[2], r[3], r[4]], r[5], c.scale_pos_weight if r[5] else 1.0) for r in rows]
    margins = [0.0] * len(data)
    gains = lambda g, h: shrunk(g / B.UNIT, c.reg_alpha) ** 2 / (h / B.UNIT + c.reg_lambda)

    def bin_of(x, f):
        return 0 if x is None else 1 + sum(e < x for e in edges[X[f]])

    def leaf(g, h):
        return -math.copysign(shrunk(g / B.UNIT, c.reg_alpha), g) / (h / B.UNIT + c.reg_lambda) * c.learning_rate

    def build(members, grads, depth):
        g, h = (sum(grads[i][k] for i in members) for k in (0, 1))
        best = None
        for f in range(3):
            for cut in range(len(edges[X[f]]) + 2):
                left = [i for i in members if bin_of(data[i][0][f], f) <= cut]
                gl, hl = (sum(grads[i][k] for i in left) for k in (0, 1))
                least = c.min_child_weight * B.UNIT
                if not left or len(left) == len(members) or hl < least or h - hl < least:
                    continue
                if not any(bin_of(data[i][0][f], f) == cut for i in members):
                    continue
                gain = gains(gl, hl) + gains(g - gl, h - hl) - gains(g, h)
                if gain > c.min_split_loss and (best is None or gain > best[0]):
                    best = (gain, f, cut, set(left))
        if depth == c.max_depth or best is None:
            return leaf(g, h)
        _, f, cut, left = best
        threshold = edges[X[f]][cut - 1] if cut else -math.inf
        return (f, threshold, build(sorted(left), grads, depth + 1), build([i for i in members if i not in left], grads, depth + 1))

    def value(tree, x):
        while isinstance(tree, tuple):
            f, threshold, left, right = tree
            tree = left if x[f] is None or x[f] <= threshold else right
        return tree

    trees = []
    for _ in range(c.n_estimators):
        p = [1 / (1 + math.exp(-m)) for m in margins]
        grads = [(rint(w * (q - y) * B.UNIT), rint(w * q * (1 - q) * B.UNIT)) for (_, y, w), q in zip(data, p, strict=True)]
        tree = build(list(range(len(data))), grads, 0)
        trees.append(tree)
        margins = [m + value(tree, x) for m, (x, _, _) in zip(margins, data, strict=True)]
    return trees, margins


def nested(tree, node=0):
    if tree.feature[node] < 0:
        return pytest.approx(tree.value[node], abs=1e-9)
    return (tree.feature[node], tree.threshold[node], nested(tree, tree.left[node]), nested(tree, tree.right[node]))


@pytest.mark.parametrize("config", [PENALISED, {"n_estimators": 2, "max_depth": 2}])
def test_trees_equal_the_plain_version(frame, rows, config):
    model = B.fit_boosted(frame, config, X, "y", edges=EDGES)
    trees, margins = plain_trees(rows, config, EDGES)
    assert [nested(t) for t in model.trees] == trees
    scored = {(r["symbol"], r["a"]): r["y_pred_proba"] for r in MO.score(model, frame).collect()}
    for r, m in zip(rows, margins, strict=True):
        assert scored[r[0], r[2]] == pytest.approx(1 / (1 + math.exp(-m)))


def test_penalties_shrink_leaves(frame):
    sizes = {}
    for name, config in {"none": {"reg_lambda": 0.0}, "l2": {"reg_lambda": 50.0}, "l1": {"reg_lambda": 0.0, "reg_alpha": 30.0}}.items():
        tree = B.fit_boosted(frame, {"n_estimators": 1, "max_depth": 2, **config}, X, "y", edges=EDGES).trees[0]
        sizes[name] = max(abs(v) for v, f in zip(tree.value, tree.feature, strict=True) if f < 0)
    assert sizes["l2"] < sizes["none"] and sizes["l1"] < sizes["none"]
    assert B.leaf_weight(0.3, 2.0, 0.5, 1.0) == 0 and B.leaf_weight(-2.0, 3.0, 0.5, 1.0) == pytest.approx(1.5 / 4)


def test_the_same_for_any_partitioning(frame):
    config = {**PENALISED, "subsample": 0.6, "colsample_bytree": 0.7, "n_estimators": 4}
    a, b = (B.fit_boosted(df, config, X, "y", edges=EDGES) for df in (frame, frame.repartition(7)))
    assert a.to_json() == b.to_json()
    assert len({tuple(B._columns_of(t, 3, B.BoostConfig.of(config))) for t in range(9)}) > 1
    other = B.fit_boosted(frame, {**config, "seed": 7}, X, "y", edges=EDGES)
    assert other.to_json() != a.to_json()


def test_margins_are_carried_on(frame, monkeypatch):
    config = {**PENALISED, "n_estimators": 5}
    at_once = B.fit_boosted(frame, config, X, "y", edges=EDGES)
    monkeypatch.setattr(B, "STORE_EVERY", 2)
    assert B.fit_boosted(frame, config, X, "y", edges=EDGES).to_json() == at_once.to_json()


def test_fits_grow_in_the_same_jobs(spark, frame, monkeypatch):
    stopping = {"n_estimators": 30, "max_depth": 3, "learning_rate": 0.8, "reg_lambda": 0.1, "early_stopping_rounds": 3}
    configs = [PENALISED, {**PENALISED, "subsample": 0.6, "scale_pos_weight": "balanced", "n_estimators": 5}, stopping]
    alone = [B.fit_boosted(frame, config, X, "y", edges=EDGES) for config in configs]
    levels, cuts = [], B.best_cuts
    monkeypatch.setattr(B, "best_cuts", lambda *a: levels.append(len(a[1])) or cuts(*a))
    together = B.fit_boosted_each([(frame, config) for config in configs], X, "y", edges=EDGES)
    assert [m.to_json() for m in together] == [m.to_json() for m in alone]
    longest = max(len(alone[1].trees), len(alone[2].losses))
    assert len(levels) <= 3 * longest and levels[0] == 3  # one job a level serves all fits


def test_a_job_adds_no_earlier_trees(frame, monkeypatch):
    added, move = [], B._with_margins
    monkeypatch.setattr(B, "_with_margins", lambda rows, trees: added.append(len(trees)) or move(rows, trees))
    B.fit_boosted(frame, {**PENALISED, "n_estimators": 4}, X, "y", edges=EDGES)
    assert added == [1, 1, 1]


def test_early_stopping_is_one_fit(frame, rows, monkeypatch):
    jobs = []
    grow = B.grow
    monkeypatch.setattr(B, "grow", lambda *a: jobs.append(a[3]) or grow(*a))
    config = {"n_estimators": 60, "max_depth": 3, "learning_rate": 0.8, "reg_lambda": 0.1, "early_stopping_rounds": 3}
    model = B.fit_boosted(frame, config, X, "y", edges=EDGES)
    assert jobs == list(range(len(jobs))) and len(jobs) < 60  # no tree is fitted twice
    best = min(range(len(model.losses)), key=model.losses.__getitem__)
    assert len(model.trees) == best and len(model.losses) == best + 4
    held = [r for r in rows if r[6]]
    assert model.losses[0] == pytest.approx(math.log(2), abs=1e-6)
    scored = {(r["symbol"], r["a"]): r["y_pred_proba"] for r in MO.score(model, frame).collect()}
    loss = -sum(math.log(scored[r[0], r[2]] if r[5] else 1 - scored[r[0], r[2]]) for r in held) / len(held)
    assert model.losses[best] == pytest.approx(loss, abs=1e-5)
    # Held-out rows play no part in the trees.
    flipped = frame.withColumn("y", F.when(F.col("is_validation"), 1 - F.col("y")).otherwise(F.col("y")))
    again = B.fit_boosted(flipped, {**config, "n_estimators": 1}, X, "y", edges=EDGES)
    assert again.trees[0] == model.trees[0]


def test_quantile_bins_learn(frame):
    model = MO.fit("boosted", frame, {"n_estimators": 12, "scale_pos_weight": "balanced", "max_bin": 32}, X, "y")
    assert all(len(e) <= 31 for e in model.edges)
    hits = MO.score(model, frame).agg(F.avg((F.col("y") == F.col("y_pred")).cast("double"))).first()[0]
    assert hits > 0.9


def test_odd_inputs(spark, frame, tmp_path):
    empty = B.fit_boosted(frame.limit(0), {"n_estimators": 2}, X, "y")
    assert empty.trees == [] and MO.score(empty, frame).agg(F.max("y_pred_proba")).first()[0] == 0.5
    one_class = B.fit_boosted(frame.where("y = 1"), {"n_estimators": 2}, X, "y", edges=EDGES)
    assert all(t.feature == [-1] for t in one_class.trees)
    assert MO.score(one_class, frame).agg(F.min("y_pred_proba")).first()[0] > 0.5
    with pytest.raises(ValueError, match="depth"):
        B.BoostConfig.of({"depth": 3})
    model = B.fit_boosted(frame, PENALISED, X, "y", edges=EDGES)
    MO.save_bundle(model, str(tmp_path / "m"), {"features": X}, spark)
    loaded, metadata = MO.load_bundle(str(tmp_path / "m"), spark)
    assert loaded == model and metadata["model_kind"] == "BoostedModel"


def test_levels_are_small_jobs_without_a_plan(spark, frame, monkeypatch):
    """A level has one stage while its sums are few; many sums meet in tasks, with the same trees."""
    config = {**PENALISED, "n_estimators": 4, "subsample": 0.6}
    shared, grow = [], B.grow
    monkeypatch.setattr(B, "grow", lambda *a: shared.append(type(a[0])) or grow(*a))
    direct = B.fit_boosted(frame.repartition(5), config, X, "y", edges=EDGES)
    assert not any(issubclass(kind, type(frame)) for kind in shared)
    monkeypatch.setattr(B, "DIRECT_SUMS", 0)
    monkeypatch.setattr(B, "SUMS_A_TASK", 2)
    assert B.fit_boosted(frame.repartition(5), config, X, "y", edges=EDGES).to_json() == direct.to_json()


def test_fits_on_the_same_rows_are_prepared_once(spark, frame, monkeypatch):
    stopping = {**PENALISED, "early_stopping_rounds": 2}
    configs = [PENALISED, {**PENALISED, "scale_pos_weight": "balanced"}, stopping, {**PENALISED, "subsample": 0.6}, {**PENALISED, "max_bin": 400}]
    alone = [B.fit_boosted(frame, config, X, "y") for config in configs]
    made, binned = [], B.binned
    monkeypatch.setattr(B, "binned", lambda *a: made.append(a[-1]) or binned(*a))
    runs = [(frame.where(F.col("a").isNotNull()), config) for config in configs]
    together = B.fit_boosted_each(runs, X, "y")
    assert sorted(made) == [0, 2, 4]  # held-out rows and other cuts have bins of their own
    assert [m.to_json() for m in together] == [m.to_json() for m in alone]


def test_every_task_has_blocks_of_the_last_fit(spark, frame, monkeypatch):
    """A fit that goes on alone keeps as many tasks as all fits had, whatever partitions its rows came in."""
    monkeypatch.setattr(B, "BLOCK_ROWS", 8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 8)
    held, grow = [], B.grow
    monkeypatch.setattr(B, "grow", lambda rows, *a: held.append(rows.map(lambda x: x[0]).glom().collect()) or grow(rows, *a))
    stopping = {**PENALISED, "n_estimators": 1, "early_stopping_rounds": 2}
    B.fit_boosted_each([(frame.coalesce(1), c) for c in (PENALISED, stopping)], X, "y", edges=EDGES)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    tasks = spark.sparkContext.defaultParallelism
    assert sum(1 in found for found in held[0]) == tasks and sum(0 in found for found in held[0]) == tasks

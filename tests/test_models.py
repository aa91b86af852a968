import datetime as dt
import random

import numpy as np
import pytest
from conftest import day, rows
from pyspark.sql import functions as F

from catalog import models as CM
from eventlab.operators import metrics as M
from eventlab.operators import models as MO
from eventlab.operators import serving as S
from eventlab.operators import splits as SP

X = ["x1", "x2", "noise"]
SMALL = {"n_estimators": 5, "max_depth": 2}


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(0)
    out = []
    for i in range(600):
        x1, x2, noise = rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)
        y = int(2 * x1 - x2 + rng.gauss(0, 0.5) > 0.8)
        out.append((f"s{i % 30:02d}", day("2021-01-01") + dt.timedelta(i), x1, x2, noise, y))
    frame = spark.createDataFrame(out, "symbol string, date date, x1 double, x2 double, noise double, y int")
    return SP.chrono_split(frame, day("2022-04-01"), X, "y").cache()


def test_split_and_validation(spark):
    days = ["2030-04-01", "2030-08-08", "2030-08-09", "2030-12-31", "2031-05-05", "2031-05-06", "2031-09-09"]
    frame = spark.createDataFrame([(day(d), None if i == 3 else 0.5 * i, i % 2) for i, d in enumerate(days)], "date date, f double, y int")
    split = SP.chrono_split(frame, day("2031-05-05"), ["f"], "y")
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 3, "test": 3}
    marked = SP.validation_slice(split.where("split = 'train'"), day("2030-08-09"))
    assert sorted(r["is_validation"] for r in marked.collect()) == [False, False, True]
    assert SP.chrono_split(frame, day("2031-05-05"), ["f"], "y", embargo_days=269).where("split = 'train'").count() == 2


def fold_frame(spark, dates):
    return spark.createDataFrame([(day(d),) for d in dates], "date date")


def test_folds_are_contiguous_and_skip_empty_windows(spark):
    frame = fold_frame(spark, ["2030-11-30", "2031-02-03", "2031-02-28", "2031-05-31", "2031-06-01", "2032-01-15"])
    got = rows(SP.walk_forward_folds(frame, day("2031-03-01"), 3), "fold")
    assert got == [
        (1, day("2031-03-01"), day("2031-06-01"), 3, 1),
        (2, day("2031-06-01"), day("2031-09-01"), 4, 1),
        (3, day("2031-12-01"), day("2032-03-01"), 5, 1),
    ]
    assert SP.walk_forward_folds(frame, day("2033-03-01")).count() == 0
    with pytest.raises(ValueError):
        SP.walk_forward_folds(frame, day("2031-03-31"))


def test_fold_boundaries_inside_a_month(spark):
    frame = fold_frame(spark, ["2023-03-14", "2023-03-15", "2023-09-14", "2023-09-15"])
    folds = SP.walk_forward_folds(frame, day("2023-03-15"), 6)
    got = rows(SP.fold_assign(frame, folds, day("2023-03-15"), 6).select("date", "fold"), "date")
    assert got == [(day("2023-03-15"), 1), (day("2023-09-14"), 1), (day("2023-09-15"), 2)]


def test_calibration_curve(spark):
    frame = spark.createDataFrame([(1, 0.02), (0, 0.13), (0, 0.24), (1, 0.4), (1, 0.45), (0, 0.98)], "y int, p double")
    got = rows(M.calibration_curve(frame, 4, label="y", score="p"), "bin_low")
    assert [(r[2], r[3], r[4]) for r in got] == [(pytest.approx(0.13), pytest.approx(1 / 3), 3), (pytest.approx(0.425), 1.0, 2), (pytest.approx(0.98), 0.0, 1)]
    errors = [0.98, 0.13, 0.24, 0.6, 0.55, 0.98]
    assert M.brier_score(frame, label="y", score="p").first()[0] == pytest.approx(sum(e * e for e in errors) / 6)


def test_precision_without_positive_predictions(spark):
    frame = spark.createDataFrame([(0, 0), (1, 0)], "y int, y_pred int")
    assert tuple(M.classification_metrics(frame, label="y").first()) == (0.5, 0.0, 2)


def test_class_weight_and_spike_rate(spark):
    frame = spark.createDataFrame([(1, 0.08), (0, 0.05), (0, 0.03), (0, None)], "y int, target_t1_high_ret double")
    assert tuple(M.class_weight(frame, label="y").first()) == (1, 3, 3.0)
    got = rows(M.spike_rate(frame, [0.02, 0.05]), "threshold")
    assert got == [(0.02, 4, 3, 0.75), (0.05, 4, 1, 0.25)]


def test_gbt_learns_and_is_deterministic(data):
    model, scored, metrics = MO.train_event_model(data, "gbt", SMALL, X, "y")
    by_split = {r["split"]: r for r in metrics.collect()}
    assert by_split["test"]["accuracy"] > 0.8
    again = MO.score(MO.fit_gbt(data.where("split = 'train'"), SMALL, X, "y"), data)
    assert scored.select("symbol", "date", "y_pred_proba").exceptAll(again.select("symbol", "date", "y_pred_proba")).count() == 0
    assert scored.where((F.col("y_pred") == 1) != (F.col("y_pred_proba") > 0.5)).count() == 0


def test_unknown_parameters_are_refused(data):
    with pytest.raises(ValueError, match="reg_alpha"):
        MO.gbt_classifier({"reg_alpha": 0.1})
    with pytest.raises(ValueError, match="penalty"):
        MO.fit_logistic(data, {"penalty": "l1"}, X, "y")
    with pytest.raises(ValueError):
        MO.fit("forest", data, None, X, "y")


def test_gbt_parameters(spark):
    gbt = MO.gbt_classifier(
        {"max_depth": 3, "n_estimators": 7, "learning_rate": 0.1, "subsample": 0.7, "colsample_bytree": 0.7, "min_child_weight": 5, "scale_pos_weight": 2.0, "early_stopping_rounds": 20}
    )
    assert (gbt.getMaxDepth(), gbt.getMaxIter(), gbt.getStepSize(), gbt.getSubsamplingRate()) == (3, 7, 0.1, 0.7)
    assert (gbt.getFeatureSubsetStrategy(), gbt.getMinInstancesPerNode()) == ("0.7", 5)
    assert gbt.getWeightCol() == "_weight"


def test_early_stopping_uses_the_validation_rows(data):
    train = SP.validation_slice(data, day("2022-01-01"))
    marked = train.withColumn("is_validation", F.col("is_validation") & (F.col("split") == "train"))
    model, scored, _ = MO.train_event_model(marked, "gbt", {**SMALL, "n_estimators": 40, "early_stopping_rounds": 5}, X, "y")
    trees = model.stages[-1].getNumTrees
    assert 1 <= trees < 40
    patient = MO.fit_gbt(marked.where("split = 'train'"), {**SMALL, "n_estimators": 40, "early_stopping_rounds": 39}, X, "y")
    assert patient.stages[-1].getNumTrees >= trees
    assert scored.where("split = 'train' and is_validation").count() == 0


def test_patience():
    losses = [5, 4, 4, 3, 6, 6, 2, 9]
    assert [MO.best_round(losses, p) for p in (1, 2, 3, 9)] == [1, 3, 6, 6]
    assert MO.best_round([1.0], 3) == 0


def test_balanced_weight_raises_recall(data):
    train = data.where("split = 'train'")
    plain = MO.score(MO.fit_gbt(train, SMALL, X, "y"), data).where("y_pred = 1").count()
    balanced = MO.score(MO.fit_gbt(train, {**SMALL, "scale_pos_weight": "balanced"}, X, "y"), data).where("y_pred = 1").count()
    assert balanced > plain


def test_logistic_matches_closed_form_scores(data):
    model = MO.fit_logistic(data.where("split = 'train'"), None, X, "y")
    pdf = MO.score(model, data.where("split = 'test'")).toPandas()
    scaler, logistic = model.stages[1], model.stages[2]
    z = (pdf[X].to_numpy() - scaler.mean.toArray()) / scaler.std.toArray()
    expected = 1 / (1 + np.exp(-(z @ logistic.coefficients.toArray() + logistic.intercept)))
    assert np.allclose(pdf["y_pred_proba"], expected)


@pytest.mark.parametrize("method", ["sigmoid", "isotonic"])
def test_calibration_round_trip(spark, data, method, tmp_path):
    train, test = data.where("split = 'train'"), data.where("split = 'test'")
    model = MO.fit_calibrated(train, method, 2, SMALL, X, "y")
    scored = MO.score(model, test)
    low, high = scored.agg(F.min("y_pred_proba"), F.max("y_pred_proba")).first()
    assert 0 <= low < high <= 1
    MO.save_bundle(model, str(tmp_path / "m"), {"features": X}, spark)
    loaded, metadata = MO.load_bundle(str(tmp_path / "m"), spark)
    assert metadata["features"] == X
    assert MO.score(loaded, test).exceptAll(scored).count() == 0
    with pytest.raises(ValueError):
        MO.fit_calibrated(train, "platt", 2, SMALL, X, "y")


def test_folds_have_their_share_of_each_class(data):
    rows = data.where("split = 'train'").withColumn("y", F.col("y").cast("double"))
    folds = MO.stratified_folds(rows, 4, "y")
    sizes = {}
    for r in folds.groupBy("y", "_fold").count().collect():
        sizes.setdefault(r["y"], []).append(r["count"])
    assert set(folds.columns) == {*rows.columns, "_fold"} and folds.count() == rows.count()
    assert all(len(n) == 4 and max(n) - min(n) <= 1 for n in sizes.values())
    again = MO.stratified_folds(rows.repartition(5), 4, "y")
    assert folds.select("symbol", "date", "_fold").exceptAll(again.select("symbol", "date", "_fold")).count() == 0


def plain_sigmoid(margins, labels):
    """Slope and intercept for smoothed targets, by Newton steps."""
    p, n = sum(labels), len(labels) - sum(labels)
    x = np.column_stack([margins, np.ones(len(margins))])
    t = np.where(np.array(labels) == 1, (p + 1) / (p + 2), 1 / (n + 2))
    beta = np.zeros(2)
    for _ in range(60):
        q = 1 / (1 + np.exp(-x @ beta))
        beta -= np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x, x.T @ (q - t))
    return beta


def test_sigmoid_fits_smoothed_targets(data):
    """Every fold's map, and the mean of both, against plain Newton steps on the margins of its held-out rows."""
    from pyspark.ml.functions import vector_to_array

    train = data.where("split = 'train'")
    model = MO.fit_calibrated(train, "sigmoid", 2, SMALL, X, "y")
    folds = MO.stratified_folds(train.withColumn("y", F.col("y").cast("double")), 2, "y")
    test = data.where("split = 'test'").orderBy("date", "symbol")
    expected = 0
    for k, (base, calibrator) in enumerate(model.folds):
        margin = vector_to_array("rawPrediction")[1].alias("m")
        held = base.transform(folds.where(F.col("_fold") == k)).select(margin, "y").collect()
        slope, intercept = plain_sigmoid([r["m"] for r in held], [r["y"] for r in held])
        assert calibrator.coefficients[0] == pytest.approx(slope, abs=1e-3) and calibrator.intercept == pytest.approx(intercept, abs=1e-3)
        m = np.array([r["m"] for r in base.transform(test).select(margin).collect()])
        expected = expected + 1 / (1 + np.exp(-(slope * m + intercept))) / 2
    assert np.allclose([r["y_pred_proba"] for r in MO.score(model, test).collect()], expected, atol=1e-3)


def test_isotonic_equals_pooled_blocks(data):
    """The isotonic map of a fold at its own margins is what pooling adjacent violators gives."""
    from pyspark.ml.functions import vector_to_array

    train = data.where("split = 'train'")
    model = MO.fit_calibrated(train, "isotonic", 2, SMALL, X, "y")
    folds = MO.stratified_folds(train.withColumn("y", F.col("y").cast("double")), 2, "y")
    base, calibrator = model.folds[0]
    held = MO._with_margin(base.transform(folds.where("_fold = 0")), "_margin")
    rows = sorted((r["m"], r["y"], r["_calibrated"]) for r in calibrator.transform(held).select(vector_to_array("_margin")[0].alias("m"), "y", "_calibrated").collect())
    ties = {}
    for m, y, _ in rows:
        total, n = ties.get(m, (0, 0))
        ties[m] = (total + y, n + 1)
    blocks = []
    for block in ties.values():
        while blocks and blocks[-1][0] / blocks[-1][1] >= block[0] / block[1]:
            total, n = blocks.pop()
            block = (total + block[0], n + block[1])
        blocks.append(block)
    values = [total / n for total, n in blocks for _ in range(n)]
    assert [c for _, _, c in rows] == pytest.approx(values)


def test_bundle_of_a_missing_model(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="save_bundle"):
        MO.load_bundle(str(tmp_path / "none"), spark)


def expected_prediction(tree, known, x, node=0):
    """Plain recursion: an unknown feature counts both branches by their rows."""
    feature, threshold, left, right, prediction, _ = tree[node]
    if left < 0:
        return prediction
    yes, no = (expected_prediction(tree, known, x, int(n)) for n in (left, right))
    if int(feature) in known:
        return yes if x[int(feature)] <= threshold else no
    share = tree[int(left)][5] / tree[node][5]
    return share * yes + (1 - share) * no


def test_attribution_adds_up_and_finds_the_driver(spark, data):
    from itertools import permutations

    from pyspark.ml.functions import vector_to_array

    train = data.where("split = 'train'")
    model = MO.fit_gbt(train, {"n_estimators": 8, "max_depth": 3}, X, "y")
    some = data.where("split = 'test'").orderBy("date").limit(6).cache()
    told = S.feature_attribution(some, model, train, X)
    margin = 2 * vector_to_array("rawPrediction")[1]
    own = {r["symbol"]: r for r in model.transform(some).select("symbol", *X, margin.alias("m")).collect()}
    trees = S.tree_nodes(model.stages[-1], spark)
    total = dict.fromkeys(X, 0.0)
    for r in told.collect():
        x = [own[r["symbol"]][f] for f in X]
        worth = lambda known: sum(2 * w * expected_prediction(t, known, x) for w, t in trees)  # noqa: E731, B023
        assert r["base"] == pytest.approx(worth(()))
        assert sum(r["attribution"].values()) + r["base"] == pytest.approx(own[r["symbol"]]["m"])
        for i, f in enumerate(X):
            joined = [worth(order[: order.index(i) + 1]) - worth(order[: order.index(i)]) for order in permutations(range(3))]
            assert r["attribution"][f] == pytest.approx(sum(joined) / 6)
            total[f] += abs(r["attribution"][f])
    assert max(total, key=total.get) == "x1"
    assert S.attribution_rank(told).where("place = 1").count() == 6


def test_rule_values_equal_all_sets():
    """The polynomial against the sum over sets of known features, missing values and repeated cuts on a feature included."""
    from itertools import combinations
    from math import factorial

    r = random.Random(4)
    k = 5
    for _ in range(20):
        tree = []

        def grow(depth, rows, tree=tree):
            at = len(tree)
            tree.append(None)
            if depth == 0 or rows < 2:
                tree[at] = [-1, 0, -1, -1, r.gauss(0, 1), rows]
            else:
                taken = r.randrange(1, rows)
                left, right = grow(depth - 1, taken), grow(depth - 1, rows - taken)
                tree[at] = [r.randrange(k), r.gauss(0, 1), left, right, 0.0, rows]
            return at

        grow(4, 60)
        nodes = np.array(tree, float)
        x = np.array([[r.gauss(0, 1) if r.random() > 0.1 else np.nan for _ in range(k)] for _ in range(6)])
        found = np.zeros((6, k))
        for rule in S.leaf_rules(1.0, nodes):
            if rule.features:
                found[:, rule.features] += rule.value * S.rule_shares(rule.holds(x).astype(float), rule.shares)
        for row in range(6):
            worth = lambda known: expected_prediction(nodes, known, x[row])  # noqa: E731, B023
            for f in range(k):
                others = [o for o in range(k) if o != f]
                value = sum(factorial(n) * factorial(k - n - 1) / factorial(k) * (worth((*c, f)) - worth(c)) for n in range(k) for c in combinations(others, n))
                assert found[row, f] == pytest.approx(value, abs=1e-9)


def test_attribution_of_forty_features(spark):
    r = random.Random(6)
    names = [f"f{i:02d}" for i in range(40)]
    rows = [(f"s{i}", day("2021-01-01") + dt.timedelta(i), *(x := [r.gauss(0, 1) for _ in names]), int(x[7] + 0.5 * x[31] > 0)) for i in range(300)]
    frame = spark.createDataFrame(rows, "symbol string, date date, " + ", ".join(f"{n} double" for n in names) + ", y int").cache()
    model = MO.fit_gbt(frame, {"n_estimators": 10, "max_depth": 5}, names, "y")
    some = frame.limit(40).cache()
    told = {t["symbol"]: t for t in S.feature_attribution(some, model, frame, names).collect()}
    odds = F.ln(F.col("y_pred_proba") / (1 - F.col("y_pred_proba")))
    for t in MO.score(model, some).select("symbol", odds.alias("m")).collect():
        parts = told[t["symbol"]]["attribution"]
        assert len(parts) == 40 and sum(parts.values()) + told[t["symbol"]]["base"] == pytest.approx(t["m"], abs=1e-6)
    total = {n: sum(abs(t["attribution"][n]) for t in told.values()) for n in names}
    assert sorted(total, key=total.get)[-2:] == ["f31", "f07"]


@pytest.mark.parametrize("kind", ["logistic", "calibrated"])
def test_attribution_of_other_models(spark, data, kind):
    train = data.where("split = 'train'")
    model = MO.fit(kind, train, {"cv": 2, "base_config": SMALL} if kind == "calibrated" else None, X, "y")
    some = data.where("split = 'test'").limit(5).cache()
    told = {(r["symbol"], r["date"]): sum(r["attribution"].values()) + r["base"] for r in S.feature_attribution(some, model, train, X).collect()}
    if kind == "logistic":
        odds = F.ln(F.col("y_pred_proba") / (1 - F.col("y_pred_proba")))
        expected = {(r["symbol"], r["date"]): r["m"] for r in MO.score(model, some).select("symbol", "date", odds.alias("m")).collect()}
        assert told == pytest.approx(expected)
    assert len(told) == 5


def test_linear_attribution(spark):
    frame = spark.createDataFrame([("a", day("2024-01-01"), 3.0, 1.0)], "symbol string, date date, u double, v double")
    got = S.linear_attribution(frame, {"u": 2.0, "v": -1.0}, {"u": 1.0, "v": 0.0}).first()["attribution"]
    assert got == {"u": 4.0, "v": -1.0}


def test_recommendation_keeps_outcome_apart(spark, data):
    model = MO.fit_gbt(data.where("split = 'train'"), SMALL, X, "y")
    features = data.withColumns(
        {"sector": F.lit("tech"), "target_t1_close_ret": F.lit(None).cast("double"), "target_t1_high_ret": F.lit(0.1)}
    )
    got = S.recommendation(features, model, X, 0.07)
    row = got.orderBy("ticker").first()
    assert got.count() == 30
    assert row["predicted_label"] in ("Spike", "No Spike") and row["confidence"] >= 0.5
    assert set(row["feature_values"]) == set(X)
    assert row["historical_outcome"]["close_ret"] is None


def test_train_event_model_query_fits_default_trees(spark, small_dir, monkeypatch):
    asked, fit = [], MO.fit

    def recorded(kind, train, config, *more):
        asked.append((kind, config))
        return fit(kind, train, SMALL if kind == "gbt" else config, *more)

    monkeypatch.setattr(MO, "fit", recorded)
    found = CM.train_event_model(spark, small_dir).collect()
    assert asked == [("gbt", {})]
    assert sorted(r["split"] for r in found) == ["test", "train"]
    assert all(0 <= r["accuracy"] <= 1 and 0 <= r["precision"] <= 1 for r in found)

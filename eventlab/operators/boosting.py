"""Second-order boosted trees with penalised leaves, fitted by histograms.

Features are cut into bins once, and rows are kept in blocks of NumPy columns, an RDD that is cached. A level of a tree is
one small job without a query plan: every task adds up the gradients and Hessians of its rows by node, feature and bin,
and the best cut follows from running sums over the bins. A few sums (`DIRECT_SUMS`) meet at the driver, more meet in
tasks by node and feature, and the driver sees one candidate for each. A
leaf of gradient G and Hessian H weighs ``-sign(G) * max(|G| - alpha, 0) / (H + lambda)``.

Several fits grow side by side: a job serves the level of all of them, so a study of many configurations has as
many jobs as its longest fit. Fits on the same rows share their cuts and bins, and every task has blocks of all fits, so the
last fit to go on still has all tasks. The margin of every row is a column that goes on by one tree at a time and is cached; it is
written to storage after every `STORE_EVERY` trees, which cuts the lineage. So a job adds no earlier trees, the number of
jobs is linear in the trees, and early stopping needs one fit: the loss of the held-out rows comes with the next tree's
first level.

Gradients are rounded to multiples of 1 / `UNIT`, and sums are whole numbers: the trees do not depend on
how rows are partitioned. Row samples follow from a hash of the row's key.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, fields
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.scalars import hash_int
from ..schemas import FEATURES, LABEL
from ..storage import scratch, stored
from .metrics import class_weight

UNIT = 1 << 22
#: Trees after which the margins are stored again.
STORE_EVERY = 16
#: Rows of a block.
BLOCK_ROWS = 16384
#: Fits that are prepared at the same time.
SIDE_BY_SIDE = 4
#: A cut must gain more than this, whatever the rounding of the sums.
LEAST_GAIN = 1e-6
#: A task's sums of a node and feature are one array. Up to this many of a level are added up at the driver.
DIRECT_SUMS = 2048
#: Nodes and features that a task adds up, if there are more.
SUMS_A_TASK = 64
CUTS = "fit int, node int, feature int, g bigint, h bigint, n bigint, bin int, gain double, gl bigint, hl bigint"
CUT = Row(*[c.split()[0] for c in CUTS.split(", ")])
#: A row is a block of one fit's rows: what a positive row weighs, the bytes of each column, and of the bins feature by feature.
BLOCKS = "fit int, w double, key binary, y binary, v binary, b binary"
KINDS = {"key": np.int64, "y": np.float64, "v": np.bool_, "b": np.int16}
#: Node of the histogram's row that holds the held-out rows' loss (g) and number (n).
HELD_OUT = -1


@dataclass(frozen=True)
class BoostConfig:
    """Parameters under the names that users of boosted trees know.

    ``min_child_weight`` is the least sum of Hessians in a child, ``min_split_loss`` the least gain of a cut.
    ``scale_pos_weight`` weighs positive rows, ``"balanced"`` by negatives per positive.
    """

    n_estimators: int = 100
    max_depth: int = 6
    learning_rate: float = 0.3
    reg_alpha: float = 0.0
    reg_lambda: float = 1.0
    min_child_weight: float = 1.0
    min_split_loss: float = 0.0
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    scale_pos_weight: float | str = 1.0
    max_bin: int = 256
    early_stopping_rounds: int | None = None
    seed: int = 42

    @classmethod
    def of(cls, config: Mapping[str, object] | None) -> BoostConfig:
        config = dict(config or {})
        unknown = set(config) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unsupported model parameters: {sorted(unknown)}")
        return cls(**config)


@dataclass
class Tree:
    """Nodes in lists; a leaf has feature -1. A row goes left if its bin is at most the node's, its value at most the threshold."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, bin_: int, threshold: float, values: tuple[float, float]) -> tuple[int, int]:
        left = len(self.feature)
        self.feature[node], self.bin[node], self.threshold[node] = feature, bin_, threshold
        self.left[node], self.right[node] = left, left + 1
        for v in values:
            self.feature.append(-1)
            self.bin.append(0)
            self.threshold.append(0.0)
            self.left.append(-1)
            self.right.append(-1)
            self.value.append(v)
        return left, left + 1

    def leaves(self, x: np.ndarray, cuts: Sequence[float]) -> np.ndarray:
        """The leaf of each row of ``x``, which has a row per feature. Left goes what is not above the cut."""
        n = x.shape[1]
        feature, cut = np.maximum(self.feature, 0), np.array(cuts)
        # A leaf is its own child, so all rows take as many steps as the tree is deep.
        own = np.arange(len(feature))
        below = np.stack([np.where(np.array(side) < 0, own, side) for side in (self.left, self.right)], 1).ravel()
        depth = [0] * len(feature)
        for i, f in enumerate(self.feature):
            if f >= 0:
                depth[self.left[i]] = depth[self.right[i]] = depth[i] + 1
        if not max(depth):
            return np.zeros(n, np.int64)
        node, rows, values = below.take((x[feature[0]] > cut[0]).astype(np.int64)), np.arange(n), np.ascontiguousarray(x).ravel()
        for _ in range(max(depth) - 1):
            node = below.take(2 * node + (values.take(feature.take(node) * n + rows) > cut.take(node)))
        return node

    def leaves_of_bins(self, bins: np.ndarray, lowest: int = 0) -> np.ndarray:
        """``bins`` are counted from ``lowest``."""
        return self.leaves(bins, np.array(self.bin) - lowest)

    def leaves_of_values(self, x: np.ndarray) -> np.ndarray:
        """A missing value goes left."""
        return self.leaves(x, self.threshold)


@dataclass
class BoostedModel:
    """Trees over features, the bins' edges, and the held-out loss after each number of trees."""

    features: list[str]
    trees: list[Tree]
    edges: list[list[float]]
    label: str = LABEL
    losses: list[float] = field(default_factory=list)

    def margin(self) -> Column:
        """The log-odds of a row, its features taken as one vectorised call."""
        trees = self.trees

        @F.pandas_udf("double")
        def total(*columns: pd.Series) -> pd.Series:
            x = np.stack([c.to_numpy(np.float64, na_value=np.nan) for c in columns])
            out = np.zeros(x.shape[1])
            for tree in trees:
                out += np.array(tree.value)[tree.leaves_of_values(x)]
            return pd.Series(out)

        return total(*[F.col(f).cast("double") for f in self.features])

    def transform(self, df: DataFrame) -> DataFrame:
        scored = df.withColumn("_margin", self.margin())
        return scored.withColumn("y_pred_proba", 1 / (1 + F.exp(-F.col("_margin")))).drop("_margin")

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "label": self.label, "edges": self.edges, "losses": self.losses, "trees": [asdict(t) for t in self.trees]})

    @classmethod
    def from_json(cls, text: str) -> BoostedModel:
        d = json.loads(text)
        return cls(d["features"], [Tree(**t) for t in d["trees"]], d["edges"], d["label"], d["losses"])


def leaf_weight(g: float, h: float, alpha: float, lam: float) -> float:
    """The best value of a leaf: shrunk towards zero by alpha, damped by lambda."""
    shrunk = math.copysign(max(abs(g) - alpha, 0.0), g)
    return -shrunk / (h + lam) if h + lam > 0 else 0.0


def quantile_edges(rows: DataFrame, features: Sequence[str], max_bin: int) -> list[list[float]]:
    """At most ``max_bin - 1`` cuts per feature, by mergeable quantile sketches; bounded by the parameter."""
    shares = F.lit([i / max_bin for i in range(1, max_bin)])
    found = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), shares, 100 * max_bin).alias(f"q{i}") for i, f in enumerate(features)]).first()
    return [sorted({float(x) for x in q or [] if math.isfinite(x)}) for q in found]


def binned(
    rows: DataFrame, features: Sequence[str], label: str, edges: Sequence[Sequence[float]], positive: float, key: Column, held_out: Column, fit: int = 0
) -> DataFrame:
    """Blocks of ``key, y, v`` and the bins of the features. Bin 0 is a missing value; bin b lies above b - 1 edges."""
    cuts = [np.array(e) for e in edges]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[dict[str, np.ndarray]] = []
        for batch in batches:
            part = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(KINDS[c]) for c in ("key", "y", "v")}
            bins = np.zeros((len(cuts), batch.num_rows), np.int16)
            for i, cut in enumerate(cuts):
                x = batch.column(f"x{i}").to_numpy(zero_copy_only=False).astype(np.float64)
                bins[i] = np.where(np.isnan(x), 0, 1 + np.searchsorted(cut, x, "left"))
            waiting.append({**part, "b": bins})
            if sum(len(w["y"]) for w in waiting) >= BLOCK_ROWS:
                yield _block(fit, positive, waiting)
                waiting = []
        if waiting:
            yield _block(fit, positive, waiting)

    slim = rows.select(
        key.cast("bigint").alias("key"), F.col(label).cast("double").alias("y"),
        held_out.alias("v"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)],
    )
    return slim.where("y IS NOT NULL").mapInArrow(run, BLOCKS)


def _block(fit: int, positive: float, parts: Sequence[dict[str, np.ndarray]]) -> pa.RecordBatch:
    whole = [np.concatenate([p[c] for p in parts], -1).tobytes() for c in KINDS]
    columns = [pa.array([fit], pa.int32()), pa.array([positive], pa.float64()), *[pa.array([x], pa.binary()) for x in whole]]
    return pa.RecordBatch.from_arrays(columns, names=["fit", "w", *KINDS])


def blocks(rows: DataFrame, sharing: Mapping[int, Mapping[int, tuple[float, bool]]] | None = None) -> RDD:
    """The blocks as (fit, columns by name), with margins ``m`` of 0; the bins have a row per feature, counted from ``lowest``.

    ``sharing`` names for each fit of the blocks the fits that share its rows, what a positive row weighs in each, and
    whether it draws rows by their key. Columns are as narrow as their values, and those without use are None.
    """

    def read(row: Row) -> Iterator[tuple[int, dict[str, object]]]:
        key, y, v, b = (np.frombuffer(row[c], kind) for c, kind in KINDS.items())
        lowest = int(b.min()) if len(b) else 0
        b = (b - lowest).reshape(-1, len(y))
        shared = {
            "y": y.astype(np.int8) if np.isin(y, (0.0, 1.0)).all() else y,
            "v": v if v.any() else None,
            "m": np.zeros(len(y)),
            "b": b.astype(np.uint8) if b.max(initial=0) < 256 else b,
            "lowest": lowest,
        }
        for fit, (positive, drawn) in sharing[row["fit"]].items() if sharing else [(row["fit"], (row["w"], True))]:
            yield fit, {**shared, "w": float(positive), "key": key if drawn else None}

    return rows.rdd.flatMap(read)


def _uniform(key: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) from the key and the seed."""
    with np.errstate(over="ignore"):
        x = key.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)) / float(1 << 53)


@dataclass
class Growth:
    """A growing tree of one fit: its open nodes, the features it may use and the share and seed of its row sample."""

    bins: int
    tree: Tree
    nodes: Sequence[int]
    columns: Sequence[int]
    sample: tuple[float, int] = (1.0, 0)

    @property
    def sums(self) -> int:
        """The most arrays of sums that a task makes: by node and feature, and one for the held-out rows."""
        return len(self.nodes) * len(self.columns) + 1


def gradient_histogram(rows: RDD, growing: Mapping[int, Growth]) -> RDD:
    """Every task's sums for the open nodes of growing trees: ``(fit, node, feature)`` and an array of g, h and n by bin.

    Sums are in units of 1 / `UNIT`; those of several tasks are not added yet. A root's histogram also has the loss of the
    held-out rows.
    """
    growing = dict(growing)

    def run(parts: Iterator[tuple[int, dict[str, object]]]) -> Iterator[tuple[tuple[int, int, int], np.ndarray]]:
        sums = {fit: np.zeros((3, len(g.columns), len(g.nodes) * g.bins), np.int64) for fit, g in growing.items()}
        held = {fit: [0, 0] for fit in growing}
        for fit, block in parts:
            if fit not in growing:
                continue
            to = growing[fit]
            y, v, m = block["y"], block["v"], block["m"]
            if 0 in to.nodes and v is not None:
                p = 1 / (1 + np.exp(-m[v]))
                right = np.clip(np.where(y[v] > 0, p, 1 - p), 1e-16, 1)
                held[fit][0] += int(np.rint(-np.log(right) * UNIT).sum())
                held[fit][1] += int(v.sum())
            slot_of = np.full(len(to.tree.feature), -1)
            slot_of[list(to.nodes)] = np.arange(len(to.nodes))
            slot = slot_of.take(to.tree.leaves_of_bins(block["b"], block["lowest"]))
            used = slot >= 0
            if v is not None:
                used &= ~v
            share, seed = to.sample
            if share < 1:
                used &= _uniform(block["key"], seed) < share
            at = np.flatnonzero(used)
            whole = len(at) == len(y)
            taken = (lambda x: x) if whole else (lambda x: x.take(at))
            y, p = taken(y), 1 / (1 + np.exp(-taken(m)))
            w = 1.0 if block["w"] == 1 else np.where(y > 0, block["w"], 1.0)
            g, h = np.rint(w * (p - y) * UNIT), np.rint(w * p * (1 - p) * UNIT)
            first = taken(slot) * to.bins + block["lowest"]
            size = sums[fit].shape[2]
            for j, f in enumerate(to.columns):
                cell = first + taken(block["b"][f])
                for i, weights in enumerate((g, h, None)):
                    # Sums of a block are whole numbers below 2 ** 53.
                    sums[fit][i, j] += np.bincount(cell, weights, size).astype(np.int64)
        for fit, to in growing.items():
            for slot, node in enumerate(to.nodes):
                for j, feature in enumerate(to.columns):
                    own = sums[fit][:, j, slot * to.bins : (slot + 1) * to.bins]
                    if own[2].any():
                        yield (fit, int(node), int(feature)), own.copy()
            if held[fit][1]:
                yield (fit, HELD_OUT, -1), np.array([[held[fit][0]], [0], [held[fit][1]]], np.int64)

    return rows.mapPartitions(run)


def best_cuts(histogram: RDD, configs: Mapping[int, BoostConfig], sums: int) -> list[Row]:
    """Per (fit, node, feature) the sums of the node, and the cut of the largest gain with its left side's sums.

    Fields ``fit, node, feature, g, h, n, bin, gain, gl, hl``; the last four are null if no cut is allowed or
    gains enough. Equal gains go to the lower bin. A task has at most ``sums`` arrays of sums.
    """
    configs = dict(configs)

    def score(g: np.ndarray, h: np.ndarray, config: BoostConfig) -> np.ndarray:
        shrunk = np.maximum(np.abs(g) / UNIT - config.reg_alpha, 0.0)
        room = h / UNIT + config.reg_lambda
        return np.divide(shrunk * shrunk, room, out=np.zeros(len(room)), where=room > 0)

    def best(found: tuple[tuple[int, int, int], np.ndarray]) -> tuple:
        place, by_bin = found
        config, bins = configs[place[0]], np.flatnonzero(by_bin[2])
        total = np.cumsum(by_bin[:, bins], 1)
        g, h, n = total[:, -1]
        gl, hl, nl = total
        gain = score(gl, hl, config) + score(g - gl, h - hl, config) - score(total[0, -1:], total[1, -1:], config)
        least = config.min_child_weight * UNIT
        allowed = (nl < n) & (hl >= least) & (h - hl >= least) & (gain > max(config.min_split_loss, LEAST_GAIN))
        if not allowed.any():
            return *place, int(g), int(h), int(n), None, None, None, None
        at = int(np.where(allowed, gain, -np.inf).argmax())
        return *place, int(g), int(h), int(n), int(bins[at]), float(gain[at]), int(gl[at]), int(hl[at])

    tasks = histogram.getNumPartitions()
    if tasks * sums <= DIRECT_SUMS:
        whole: dict[tuple[int, int, int], np.ndarray] = {}
        for place, own in histogram.collect():
            whole[place] = whole[place] + own if place in whole else own
        cuts = [best(found) for found in whole.items()]
    else:
        cuts = histogram.reduceByKey(np.add, min(tasks, -(-sums // SUMS_A_TASK))).map(best).collect()
    return [CUT(*cut) for cut in cuts]


def _columns_of(tree: int, k: int, config: BoostConfig) -> list[int]:
    """The features that a tree may use, by a hash of seed and tree."""
    wanted = max(1, math.floor(config.colsample_bytree * k + 0.5))
    draw = _uniform(np.arange(k) + (tree << 20), config.seed + 1)
    return sorted(np.argsort(draw, kind="stable")[:wanted].tolist())


def split_nodes(tree: Tree, found: Sequence[Row], edges: Sequence[Sequence[float]], config: BoostConfig) -> list[int]:
    """Split every node at its best cut, the first feature among equals; returns the new nodes."""
    best: dict[int, Row] = {}
    for r in sorted((r for r in found if r["bin"] is not None and r["node"] >= 0), key=lambda r: r["feature"]):
        if r["node"] not in best or r["gain"] > best[r["node"]]["gain"]:
            best[r["node"]] = r
    made = []
    for node, r in sorted(best.items()):
        sides = ((r["gl"], r["hl"]), (r["g"] - r["gl"], r["h"] - r["hl"]))
        values = tuple(config.learning_rate * leaf_weight(g / UNIT, h / UNIT, config.reg_alpha, config.reg_lambda) for g, h in sides)
        # Bin b ends at edge b - 1; a cut after the bin of missing values lets nothing else go left.
        threshold = edges[r["feature"]][r["bin"] - 1] if r["bin"] else -math.inf
        made += tree.split(node, r["feature"], r["bin"], threshold, values)
    return made


@dataclass
class Fit:
    """One of several fits that grow together: its parameters and cuts, what a positive row weighs, and what it has so far."""

    config: BoostConfig
    edges: list[list[float]]
    positive: float = 1.0
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    @property
    def best(self) -> int:
        return min(range(len(self.losses)), key=self.losses.__getitem__)

    def growth(self, tree: Tree, nodes: Sequence[int], number: int) -> Growth:
        bins = 2 + max(map(len, self.edges), default=0)
        columns = _columns_of(number, len(self.edges), self.config)
        return Growth(bins, tree, nodes, columns, (self.config.subsample, self.config.seed + 2 + number))

    def add(self, tree: Tree | None, loss: float | None, number: int) -> bool:
        """Take the next tree, and the loss before it; whether to go on."""
        patience = self.config.early_stopping_rounds
        if loss is not None:
            self.losses.append(loss)
            if patience and len(self.losses) - 1 - self.best >= patience:
                return False
        if tree is None or number == self.config.n_estimators:
            return False
        self.trees.append(tree)
        return number + 1 < self.config.n_estimators + (1 if patience else 0)


def grow(rows: RDD, fits: Mapping[int, Fit], going: Sequence[int], number: int) -> dict[int, tuple[Tree | None, float | None]]:
    """The next tree of each fit, and the held-out loss before it. No tree if there is nothing to fit."""
    trees: dict[int, Tree | None] = {fit: Tree() for fit in going}
    losses: dict[int, float | None] = dict.fromkeys(going)
    nodes = {fit: [0] for fit in going}
    depth = 0
    while nodes:
        growing = {fit: fits[fit].growth(trees[fit], open_nodes, number) for fit, open_nodes in nodes.items()}
        cuts = best_cuts(gradient_histogram(rows, growing), {fit: fits[fit].config for fit in growing}, sum(g.sums for g in growing.values()))
        found: dict[int, list[Row]] = {fit: [] for fit in growing}
        for r in cuts:  # one row per fit, open node and feature
            found[r["fit"]].append(r)
        depth += 1
        for fit, own in found.items():
            config, tree = fits[fit].config, trees[fit]
            if depth == 1:
                held = next((r for r in own if r["node"] == HELD_OUT), None)
                losses[fit] = held["g"] / UNIT / held["n"] if held else None
                root = next((r for r in own if r["node"] == 0), None)
                if root is None:
                    trees[fit] = None
                    del nodes[fit]
                    continue
                tree.value[0] = config.learning_rate * leaf_weight(root["g"] / UNIT, root["h"] / UNIT, config.reg_alpha, config.reg_lambda)
            nodes[fit] = split_nodes(tree, own, fits[fit].edges, config) if config.max_depth >= 1 else []
            if depth >= config.max_depth or not nodes[fit]:
                del nodes[fit]
    return {fit: (trees[fit], losses[fit]) for fit in going}


def _with_margins(rows: RDD, trees: Mapping[int, Tree]) -> RDD:
    """The blocks of the fits that go on, their margins one tree further."""
    trees = dict(trees)

    def move(found: tuple[int, dict[str, object]]) -> tuple[int, dict[str, object]]:
        fit, block = found
        tree = trees[fit]
        return fit, {**block, "m": block["m"] + np.array(tree.value).take(tree.leaves_of_bins(block["b"], block["lowest"]))}

    return rows.filter(lambda found: found[0] in trees).map(move)


def _stored_blocks(rows: RDD, path: str) -> RDD:
    """The blocks, written to the path and read again: the lineage ends there."""
    rows.saveAsPickleFile(path)
    return rows.context.pickleFile(path, 1)


def _alike(a: tuple[DataFrame, BoostConfig], b: tuple[DataFrame, BoostConfig]) -> bool:
    """Whether two fits have the same rows, held-out ones included, cuts and keys."""
    same = [(c.seed, c.max_bin, bool(c.early_stopping_rounds)) for _, c in (a, b)]
    return same[0] == same[1] and (a[0] is b[0] or a[0].sameSemantics(b[0]))


def _prepared(train: DataFrame, configs: Mapping[int, BoostConfig], features: Sequence[str], label: str, key: Sequence[str], edges: Mapping[str, Sequence[float]] | None) -> tuple[dict[int, Fit], DataFrame]:
    """Fits that are alike, and their blocks under the number of the first."""
    number, config = next(iter(configs.items()))
    held_out = F.coalesce(F.col("is_validation"), F.lit(False)) if config.early_stopping_rounds else F.lit(False)
    fitted_on = train.where(~held_out & F.col(label).isNotNull())
    balanced = 1.0
    if any(c.scale_pos_weight == "balanced" for c in configs.values()):
        balanced = class_weight(fitted_on, label=label).first()["scale_pos_weight"] or 1.0
    cuts = [sorted(map(float, edges[f])) for f in features] if edges else quantile_edges(fitted_on, features, config.max_bin)
    fits = {i: Fit(c, cuts, float(balanced if c.scale_pos_weight == "balanced" else c.scale_pos_weight)) for i, c in configs.items()}
    known = [F.col(c).cast("string") for c in (key if set(key) <= set(train.columns) else features)]
    drawn = any(c.subsample < 1 for c in configs.values())
    place = hash_int(F.lit(config.seed), *known) if drawn else F.lit(0)
    return fits, binned(train, features, label, cuts, fits[number].positive, place, held_out, number)


def fit_boosted_each(
    runs: Sequence[tuple[DataFrame, Mapping[str, object] | BoostConfig | None]],
    features: Sequence[str] = FEATURES,
    label: str = LABEL,
    key: Sequence[str] = ("symbol", "date"),
    edges: Mapping[str, Sequence[float]] | None = None,
) -> list[BoostedModel]:
    """`fit_boosted` of several (training rows, parameters), grown in the same jobs."""
    features = list(features)
    known = [(rows, c if isinstance(c, BoostConfig) else BoostConfig.of(c)) for rows, c in runs]
    groups: list[list[int]] = []
    for i, run in enumerate(known):
        group = next((g for g in groups if _alike(known[g[0]], run)), None)
        groups.append([i]) if group is None else group.append(i)
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        made = list(pool.map(lambda g: _prepared(known[g[0]][0], {i: known[i][1] for i in g}, features, label, key, edges), groups))
    fits = {i: f for group, _ in made for i, f in sorted(group.items())}
    sharing = {g[0]: {i: (fits[i].positive, fits[i].config.subsample < 1) for i in g} for g in groups}
    every = reduce(DataFrame.unionAll, [found for _, found in made])
    # Blocks are dealt in turn: a task of a level has as many of each fit as another.
    binned_rows = stored(every.repartition(every.sparkSession.sparkContext.defaultParallelism), "binned")
    rows = blocks(binned_rows, sharing).persist(StorageLevel.MEMORY_AND_DISK_DESER)
    going = [i for i, f in fits.items() if f.config.n_estimators + bool(f.config.early_stopping_rounds) > 0]
    number = 0
    while going:
        before = rows
        if number:
            moved = _with_margins(rows, {i: fits[i].trees[-1] for i in going})
            kept = _stored_blocks(moved, scratch(binned_rows.sparkSession, "margins")) if number % STORE_EVERY == 0 else moved
            rows = kept.persist(StorageLevel.MEMORY_AND_DISK_DESER)
        grown = grow(rows, fits, going, number)  # its first level fills the cache
        if before is not rows:
            before.unpersist()
        going = [i for i in going if fits[i].add(*grown[i], number)]
        number += 1
    rows.unpersist()
    for f in fits.values():
        if f.config.early_stopping_rounds and f.losses:
            f.trees = f.trees[: max(1, f.best)]
    return [BoostedModel(features, f.trees, f.edges, label, f.losses) for _, f in sorted(fits.items())]


def fit_boosted(
    train: DataFrame,
    config: Mapping[str, object] | BoostConfig | None = None,
    features: Sequence[str] = FEATURES,
    label: str = LABEL,
    key: Sequence[str] = ("symbol", "date"),
    edges: Mapping[str, Sequence[float]] | None = None,
) -> BoostedModel:
    """Fit boosted trees on a binary label.

    With ``early_stopping_rounds``, rows marked ``is_validation`` are held out, and boosting ends when that many
    trees in a row brought no lower loss on them; the model has the trees of the lowest. Without it all
    rows are fitted on. Rows without a label are left out, and a missing feature goes left. ``key`` names the columns
    whose hash draws row samples, ``edges`` the cuts to use in place of quantiles.
    """
    return fit_boosted_each([(train, config)], features, label, key, edges)[0]

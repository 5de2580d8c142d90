"""Histogram gradient boosting of many models at once.

Features are cut into quantile bins once per model. Rows then lie in blocks of
one model each, as bytes. Every level of a round is one job for all models
together: a task sums gradients, hessians and rows by (model, node, feature,
bin) over its blocks, and the driver holds these sums only, however many rows
there are. Only the smaller child of a split is summed; its sibling is the
difference. Trees grow best split first up to MAX_LEAVES.

Gradients are rounded to whole numbers of a small unit, so sums are exact: the
trees do not depend on how rows are dealt, or on tasks that ran twice. A model
whose rows fill one block only therefore needs no exchange: it is boosted by the
same code, to the same trees, in the task that holds the block."""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from marketloom.session import cut_lineage, scratch_root

BINS, MIN_LEAF, MAX_LEAVES, MIN_HESSIAN = 255, 20, 31, 1e-3
#: Rows of a block; partitions whose sums the driver adds itself; rounds between two checkpoints.
BLOCK_ROWS, DIRECT_PARTS, CHECKPOINT_ROUNDS = 1 << 16, 64, 25
#: Bits of a rounded gradient. Sums of a block stay below 2^53 in doubles.
UNIT_BITS = 30


@dataclass(frozen=True)
class Loss:
    """`log` for 0/1 labels, else squared error."""
    log: bool

    def start(self, n: float, total: float) -> float:
        """The margin before the first tree, given the weight of all rows and the weighted sum of their labels."""
        mean = total / n
        return math.log(mean / (1 - mean)) if self.log else mean

    def slopes(self, y: np.ndarray, weight: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Gradient and hessian; no hessian means one for each row."""
        if not self.log:
            return margin - y, None
        p = 1 / (1 + np.exp(-margin))
        return (p - y) * weight, p * (1 - p) * weight


@dataclass
class Tree:
    """A binary tree in heap order: the children of node i are 2 i + 1 and 2 i + 2.
    A node without a split has feature -1; `cover` counts training rows."""
    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = (2 << depth) - 1
        return cls(np.full(n, -1, np.int16), np.zeros(n, np.int16), np.zeros(n), np.zeros(n, np.int64), np.zeros(n))

    def place(self, codes: np.ndarray, depth: int) -> np.ndarray:
        """The node each row of bin codes stops at, at most `depth` levels down."""
        node, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
        for _ in range(depth):
            f = self.feature[node]
            node = np.where(f >= 0, 2 * node + 1 + (codes[rows, f] > self.bin[node]), node)
        return node


def sums(codes: np.ndarray, gradient: np.ndarray, hessian: np.ndarray | None, node: np.ndarray, built: list[int], bins: int) -> np.ndarray:
    """(node, feature, bin, quantity): rows, gradients and, if there are any, hessians."""
    slot = np.full(int(node.max(initial=0)) + 1 if len(node) else 1, -1)
    inside = [i for i, b in enumerate(built) if b < len(slot)]
    slot[[built[i] for i in inside]] = inside
    at = slot[node] if len(node) else node
    kept = np.flatnonzero(at >= 0)
    at, gradient = at[kept] * bins, gradient[kept]
    out = np.zeros((len(built), codes.shape[1], bins, 2 if hessian is None else 3), np.int64)
    for f in range(codes.shape[1]):
        key = at + codes[kept, f]
        out[:, f, :, 0] = np.bincount(key, minlength=len(built) * bins).reshape(len(built), bins)
        out[:, f, :, 1] = np.bincount(key, gradient, len(built) * bins).reshape(len(built), bins)
        if hessian is not None:
            out[:, f, :, 2] = np.bincount(key, hessian[kept], len(built) * bins).reshape(len(built), bins)
    return out


@dataclass
class Grower:
    """Grows one tree from the sums of its levels."""
    depth: int
    unit: float
    allowed: np.ndarray
    rate: float
    tree: Tree = field(init=False)
    open: dict[int, np.ndarray] = field(init=False, default_factory=dict)
    built: list[int] = field(init=False, default_factory=lambda: [0])

    def __post_init__(self) -> None:
        self.tree = Tree.empty(self.depth)

    def learn(self, level: int, found: np.ndarray) -> None:
        """Take the sums of the built nodes, complete their siblings and split."""
        here = dict(zip(self.built, found))
        if level:
            for node in list(here):
                sibling = node + 1 if node % 2 else node - 1
                here[sibling] = self.open[(node - 1) // 2] - here[node]
        nodes = sorted(here)
        stack = np.stack([here[n] for n in nodes])
        rows, g = stack[..., 0].cumsum(2), stack[..., 1].cumsum(2) * self.unit
        h = stack[..., 2].cumsum(2) * self.unit if stack.shape[-1] == 3 else rows.astype(float)
        n, total_g, total_h = rows[:, :, -1:], g[:, :, -1:], h[:, :, -1:]
        fits = (rows >= MIN_LEAF) & (n - rows >= MIN_LEAF) & (h >= MIN_HESSIAN) & (total_h - h >= MIN_HESSIAN) & self.allowed[None, :, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = g * g / h + (total_g - g) ** 2 / (total_h - h) - total_g**2 / total_h
        gain = np.where(fits, gain, -np.inf).reshape(len(nodes), -1)
        best = gain.argmax(1)
        self.open, self.built = {}, []
        for i, node in enumerate(nodes):
            t = self.tree
            t.cover[node], t.value[node] = n[i, 0, 0], -self.rate * total_g[i, 0, 0] / total_h[i, 0, 0] if total_h[i, 0, 0] > 0 else 0.0
            if gain[i, best[i]] > 1e-12 * (1 + abs(total_g[i, 0, 0])):
                f, b = divmod(int(best[i]), stack.shape[2])
                t.feature[node], t.bin[node], t.gain[node] = f, b, gain[i, best[i]]
                self.open[node] = here[node]
                left = 2 * node + 1
                for child, rows_, g_, h_ in ((left, rows[i, f, b], g[i, f, b], h[i, f, b]),
                                             (left + 1, n[i, 0, 0] - rows[i, f, b], total_g[i, 0, 0] - g[i, f, b], total_h[i, 0, 0] - h[i, f, b])):
                    t.cover[child], t.value[child] = rows_, -self.rate * g_ / h_
                self.built.append(left if 2 * rows[i, f, b] <= n[i, 0, 0] else left + 1)

    def finished(self) -> Tree:
        """The tree with the splits that come first by gain, up to MAX_LEAVES leaves."""
        t, keep, queue = self.tree, set(), [(-self.tree.gain[0], 0)] if self.tree.feature[0] >= 0 else []
        while queue and len(keep) < MAX_LEAVES - 1:
            _, node = heapq.heappop(queue)
            keep.add(node)
            for child in (2 * node + 1, 2 * node + 2):
                if child < len(t.feature) and t.feature[child] >= 0:
                    heapq.heappush(queue, (-t.gain[child], child))
        t.feature = np.where(np.isin(np.arange(len(t.feature)), list(keep)), t.feature, -1).astype(np.int16)
        return t


@dataclass
class Ensemble:
    """One fitted model: its margin is `start` plus the values of its trees."""
    start: float
    edges: list[np.ndarray]
    trees: list[Tree]
    depth: int

    def codes(self, x: np.ndarray) -> np.ndarray:
        return binned(x, self.edges)

    def margin(self, x: np.ndarray) -> np.ndarray:
        codes, out = self.codes(x), np.full(len(x), self.start)
        for t in self.trees:
            out += t.value[t.place(codes, self.depth)]
        return out


def narrowed(model: Ensemble, columns: list[int]) -> Ensemble:
    """The same model over these columns only; it must not split on others."""
    place = np.full(len(model.edges) + 1, -1, np.int16)  # the last is for -1, no split
    place[columns] = np.arange(len(columns))
    trees = [Tree(place[t.feature], t.bin, t.value, t.cover, t.gain) for t in model.trees]
    return Ensemble(model.start, [model.edges[c] for c in columns], trees, model.depth)


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin codes of the columns of x: values up to the first edge are 0."""
    return np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)], 1).astype(np.uint8) if len(edges) else np.zeros((len(x), 0), np.uint8)


def unit_of(largest: float) -> float:
    """The unit of gradients whose absolute value stays below `largest`."""
    return 2.0 ** (math.ceil(math.log2(max(largest, 1e-300))) + 2 - UNIT_BITS)


def _whole(values: np.ndarray | None, unit: float) -> np.ndarray | None:
    return None if values is None else np.rint(values / unit)


@dataclass(frozen=True)
class Plan:
    """How to boost: rounds of trees of `depth` levels at a learning rate."""
    loss: Loss
    rounds: int
    depth: int
    rate: float = 0.1


def grow(plan: Plan, units: dict[int, float], allowed: dict[int, np.ndarray],
         level_sums: Callable[[dict[int, tuple[Tree, list[int], int]]], dict[int, np.ndarray]],
         advance: Callable[[dict[int, Tree]], None]) -> dict[int, list[Tree]]:
    """Trees by model. `level_sums` answers for (tree so far, nodes to sum,
    level) of each model; `advance` adds finished trees to the margins."""
    forests: dict[int, list[Tree]] = {m: [] for m in units}
    for _ in range(plan.rounds):
        growers = {m: Grower(plan.depth, units[m], allowed[m], plan.rate) for m in units}
        for level in range(plan.depth):
            asked = {m: (g.tree, g.built, level) for m, g in growers.items() if g.built}
            if not asked:
                break
            found = level_sums(asked)
            for m in asked:
                growers[m].learn(level, found[m])
        trees = {m: g.finished() for m, g in growers.items()}
        for m, t in trees.items():
            forests[m].append(t)
        advance(trees)
    return forests


# --- one task holds the rows ---------------------------------------------------------------


def quantile_edges(x: np.ndarray) -> list[np.ndarray]:
    """Up to BINS - 1 edges for each column: values of the column at equal steps of rank."""
    steps = np.arange(1, BINS) / BINS
    return [np.unique(np.sort(c)[np.ceil(steps * len(c)).astype(int) - 1]) if len(c) else np.empty(0) for c in x.T]


def balance(y: np.ndarray) -> np.ndarray:
    """Weight n / (2 n_class) of each 0/1 label."""
    up = y.sum()
    return np.where(y == 1, len(y) / (2 * max(up, 1)), len(y) / (2 * max(len(y) - up, 1)))


def fit_here(plan: Plan, x: np.ndarray, y: np.ndarray, edges: list[np.ndarray] | None = None, allowed: np.ndarray | None = None,
             start: float | None = None) -> Ensemble:
    """Boost one model over rows in memory; 0/1 labels are balanced."""
    weight = balance(y) if plan.loss.log else np.ones(len(y))
    if start is None:
        start = plan.loss.start(1, 0.5) if plan.loss.log else plan.loss.start(len(y), math.fsum(y))
    edges = quantile_edges(x) if edges is None else edges
    codes, margin = binned(x, edges), np.full(len(y), start)
    bins = 1 + max((len(e) for e in edges), default=0)
    unit = unit_of(weight.max() if plan.loss.log else max(y.max() - start, start - y.min()))
    slopes: list[np.ndarray | None] = [None, None]

    def look() -> None:
        slopes[:] = [_whole(s, unit) for s in plan.loss.slopes(y, weight, margin)]

    def level_sums(asked):
        tree, built, level = asked[0]
        return {0: sums(codes, slopes[0], slopes[1], tree.place(codes, level), built, bins)}

    def advance(trees):
        margin[:] += trees[0].value[trees[0].place(codes, plan.depth)]
        look()

    look()
    forest = grow(plan, {0: unit}, {0: np.ones(x.shape[1], bool) if allowed is None else allowed}, level_sums, advance)
    return Ensemble(start, edges, forest[0], plan.depth)


def fit_predict_groups(plan: Plan, rows: DataFrame, by: list[str], keys: list[str], min_train: int = 1) -> DataFrame:
    """(by, keys, margin) for the rows with `is_test`, each scored by a model of
    its own group, fitted on the rows without. `rows` holds x array<double>,
    label double and is_test boolean.

    A group is one model's rows, such as those of one asset, which the calendar
    bounds, and lies in one task; groups with fewer than `min_train` training
    rows, or with one class, give nothing."""
    groups = rows.select(*by).distinct().count()
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    names = [*by, *keys]

    def one(part: pd.DataFrame) -> pd.DataFrame:
        held = part["is_test"].to_numpy(bool)
        y = part["label"].to_numpy(float)[~held]
        if len(y) < min_train or not held.any() or (plan.loss.log and len(np.unique(y)) < 2):
            return pd.DataFrame({c: part[c].iloc[:0] for c in names} | {"margin": np.empty(0)})
        x = np.stack(part["x"].to_numpy())
        return part.loc[held, names].assign(margin=fit_here(plan, x[~held], y).margin(x[held]))

    # a task for each group, by ranges, which serve the grouping as they are
    return rows.repartitionByRange(max(1, groups), *by).groupBy(*by).applyInPandas(one, ", ".join(f"`{c}` {fields[c]}" for c in names) + ", margin double")


# --- many tasks hold the rows --------------------------------------------------------------


def _edges_of(rows: DataFrame, features: int) -> tuple[dict[int, list[np.ndarray]], dict[int, tuple]]:
    """By model: bin edges, and (rows, labels' sum, smallest, largest label)."""
    steps = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    quantiles = [F.percentile_approx(F.col("x")[i], steps, F.lit(10_000)).alias(f"q{i}") for i in range(features)]
    found = rows.groupBy("model").agg(F.count("*").alias("n"), F.sum("label").alias("total"), F.min("label").alias("low"),
                                      F.max("label").alias("high"), *quantiles).collect()  # one row a model
    edges = {r["model"]: [np.unique(np.array(r[f"q{i}"], float)) for i in range(features)] for r in found}
    return edges, {r["model"]: (r["n"], r["total"], r["low"], r["high"]) for r in found}


def _blocks(edges: dict[int, list[np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows as blocks of one model: bin codes and labels as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def packed(model: int) -> pa.RecordBatch:
            parts = held.pop(model)
            codes, y = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            return pa.RecordBatch.from_arrays([pa.array([model], pa.int32()), pa.array([codes.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())],
                                              ["model", "codes", "labels"])

        for batch in batches:
            models, y = batch.column("model").to_numpy(), batch.column("label").to_numpy()
            x = batch.column("x").flatten().to_numpy().reshape(len(y), -1)
            for m in np.unique(models):
                own = models == m
                held.setdefault(int(m), []).append((binned(x[own], edges[int(m)]), y[own]))
                if sum(len(p[1]) for p in held[int(m)]) >= BLOCK_ROWS:
                    yield packed(int(m))
        for m in list(held):
            yield packed(m)
    return run


def _merged(a: dict, b: dict) -> dict:
    for m, s in b.items():
        a[m] = a[m] + s if m in a else s
    return a


def _total(parts: RDD) -> dict[int, np.ndarray]:
    n = parts.getNumPartitions()
    if n > DIRECT_PARTS:
        return parts.treeReduce(_merged, 3)
    out: dict[int, np.ndarray] = {}
    for p in parts.collect():
        _merged(out, p)
    return out


def _boosted_in_task(plan: Plan, edges: dict, allowed: dict, starts: dict) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def one(part: pd.DataFrame) -> pd.DataFrame:
        m = int(part["model"].iloc[0])
        fitted = fit_here(plan, np.stack(part["x"].to_numpy()), part["label"].to_numpy(float), edges[m], allowed[m], starts[m])
        return pd.DataFrame({"model": [m], "trees": [pickle.dumps(fitted.trees)]})
    return one


def fit_many(plan: Plan, rows: DataFrame, features: list[str], subsets: dict[int, list[str]] | None = None) -> dict[int, Ensemble]:
    """Boost a model for each value of `model`, over rows (model int, label
    double, x array<double> in the order of `features`); 0/1 labels are
    balanced. `subsets` names the features that a model may split on, all if it
    is not named. Models whose labels are all equal get no tree.

    The driver holds bin edges, trees and the sums of one level. Models of up to
    BLOCK_ROWS rows are boosted in one task each, larger ones by `_exchanged`."""
    rows = cut_lineage(rows.select("model", "label", "x"), "boost-rows")
    edges, facts = _edges_of(rows, len(features))
    log = plan.loss.log
    mixed = [m for m, (*_, low, high) in facts.items() if low < high]
    starts = {m: plan.loss.start(1, 0.5) if log else total / n for m, (n, total, *_) in facts.items()}
    starts |= {m: (30.0 if facts[m][2] else -30.0) for m in facts if log and m not in mixed}
    allowed = {m: np.array([f in subsets[m] for f in features]) if subsets and m in subsets else np.ones(len(features), bool) for m in mixed}
    small = [m for m in mixed if facts[m][0] <= BLOCK_ROWS]
    large = [m for m in mixed if facts[m][0] > BLOCK_ROWS]
    forests: dict[int, list[Tree]] = {}
    if small:
        dealt = rows.where(F.col("model").isin(small)).repartitionByRange(len(small), "model")
        fitted = dealt.groupBy("model").applyInPandas(_boosted_in_task(plan, edges, allowed, starts), "model int, trees binary")
        forests |= {r["model"]: pickle.loads(r["trees"]) for r in fitted.collect()}
    if large:
        forests |= _exchanged(plan, rows.where(F.col("model").isin(large)), {m: facts[m] for m in large}, edges, allowed, starts)
    return {m: Ensemble(starts[m], edges[m], forests.get(m, []), plan.depth) for m in facts}


def _exchanged(plan: Plan, rows: DataFrame, facts: dict[int, tuple], edges: dict[int, list[np.ndarray]],
               allowed: dict[int, np.ndarray], starts: dict[int, float]) -> dict[int, list[Tree]]:
    """Boost models whose rows lie in many tasks, one job a level. Margins are
    kept between rounds as a persisted table of blocks; a lost executor costs
    the rounds since the last checkpoint, for its blocks."""
    spark, log = rows.sparkSession, plan.loss.log
    weights = {m: (n / (2 * max(total, 1)), n / (2 * max(n - total, 1))) if log else (1.0, 1.0) for m, (n, total, *_) in facts.items()}
    units = {m: unit_of(max(weights[m]) if log else max(facts[m][3] - starts[m], starts[m] - facts[m][2])) for m in facts}
    bins = {m: 1 + max(len(e) for e in edges[m]) for m in facts}
    width = len(next(iter(edges.values())))
    parts = max(1, math.ceil(sum(n for n, *_ in facts.values()) / BLOCK_ROWS))
    dealt = rows.repartitionByRange(parts, "model", F.xxhash64("x", "label")).mapInArrow(_blocks(edges), "model int, codes binary, labels binary")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(scratch_root(spark))

    def opened(row) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        y = np.frombuffer(row["labels"])
        return row["model"], np.frombuffer(row["codes"], np.uint8).reshape(len(y), width), y, np.full(len(y), starts[row["model"]])

    state = {"blocks": cut_lineage(dealt, "boost-blocks").rdd.map(opened).persist(StorageLevel.MEMORY_AND_DISK), "old": None, "round": 0}
    loss, depth = plan.loss, plan.depth

    def level_sums(asked):
        def part(blocks):
            out: dict[int, np.ndarray] = {}
            for m, codes, y, margin in blocks:
                if m in asked:
                    tree, built, level = asked[m]
                    g, h = loss.slopes(y, np.where(y == 1, *weights[m]), margin)
                    _merged(out, {m: sums(codes, _whole(g, units[m]), _whole(h, units[m]), tree.place(codes, level), built, bins[m])})
            yield out

        found = _total(state["blocks"].mapPartitions(part))
        if state["old"] is not None:  # the new margins have been computed by now
            state["old"].unpersist()
            state["old"] = None
        return found

    def advance(trees):
        def moved(block):
            m, codes, y, margin = block
            return m, codes, y, margin + trees[m].value[trees[m].place(codes, depth)]

        state["old"], state["blocks"] = state["blocks"], state["blocks"].map(moved, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
        state["round"] += 1
        if state["round"] % CHECKPOINT_ROUNDS == 0:
            state["blocks"].checkpoint()

    forests = grow(plan, units, allowed, level_sums, advance)
    state["blocks"].unpersist()
    return forests


def margins(models: dict[int, Ensemble], model: str | Column, x: str | Column) -> Column:
    """The margin of a row by the model it names; null for other models."""
    @F.pandas_udf("double")
    def scored(which: pd.Series, values: pd.Series) -> pd.Series:
        out = np.full(len(which), np.nan)
        for m, ensemble in models.items():
            own = (which == m).to_numpy()
            if own.any():
                out[own] = ensemble.margin(np.stack(values[own].to_numpy()))
        return pd.Series(out)

    return F.nanvl(scored(model, x), F.lit(None).cast("double"))


# --- exact attribution ---------------------------------------------------------------------


@dataclass
class _Leaf:
    """A leaf's path: its features, the bins that lead there, and by pattern of
    features whose value leads there, the contribution of each feature."""
    features: list[int]
    low: list[int]
    high: list[int]
    table: np.ndarray


def _shares(k: int) -> np.ndarray:
    """Shapley weight of a set of s of the other k - 1 features."""
    return np.array([math.factorial(s) * math.factorial(k - s - 1) / math.factorial(k) for s in range(k)])


def _leaves(tree: Tree) -> Iterator[_Leaf]:
    """Every leaf below a split, with its features merged along the path: a
    feature that is unknown goes to a child in proportion to its cover."""
    stack = [(0, {})] if tree.feature[0] >= 0 else []
    while stack:
        node, path = stack.pop()
        f = int(tree.feature[node])
        if f >= 0:
            for child in (2 * node + 1, 2 * node + 2):
                low, high, share = path.get(f, (0, BINS, 1.0))
                b = int(tree.bin[node])
                low, high = (low, min(high, b)) if child % 2 else (max(low, b + 1), high)
                stack.append((child, {**path, f: (low, high, share * tree.cover[child] / tree.cover[node])}))
            continue
        k = len(path)
        known = (np.arange(1 << k)[:, None] >> np.arange(k)) & 1
        share, weights = np.array([p[2] for p in path.values()]), _shares(k)
        table = np.zeros((1 << k, k))
        for i in range(k):
            # coefficient s: the sum over sets of s known features of what the rest lets through
            sets = np.zeros((1 << k, k))
            sets[:, 0] = 1.0
            for j in set(range(k)) - {i}:
                sets[:, 1:] = sets[:, 1:] * share[j] + sets[:, :-1] * known[:, j:j + 1]
                sets[:, 0] *= share[j]
            table[:, i] = tree.value[node] * (sets @ weights) * (known[:, i] - share[i])
        yield _Leaf(list(path), [p[0] for p in path.values()], [p[1] for p in path.values()], table)


def expected(model: Ensemble) -> float:
    """The margin when no feature is known."""
    total = model.start
    for t in model.trees:
        stack = [(0, 1.0)]
        while stack:
            node, share = stack.pop()
            if t.feature[node] < 0:
                total += share * t.value[node]
            else:
                stack += [(c, share * t.cover[c] / t.cover[node]) for c in (2 * node + 1, 2 * node + 2)]
    return total


def contributions(model: Ensemble, x: np.ndarray) -> np.ndarray:
    """Exact Shapley values of the margin, rows by features. Unknown features
    follow the training rows through each tree. Rows sum to the margin less
    `expected`. A leaf's share depends only on which of its few features lead to
    it, so it is worked out once for every pattern and looked up by row."""
    codes, out = model.codes(x), np.zeros((len(x), len(model.edges)))
    for tree in model.trees:
        for leaf in _leaves(tree):
            pattern = np.zeros(len(x), np.int64)
            for i, (f, low, high) in enumerate(zip(leaf.features, leaf.low, leaf.high)):
                pattern |= ((codes[:, f] >= low) & (codes[:, f] <= high)).astype(np.int64) << i
            out[:, leaf.features] += leaf.table[pattern]
    return out


def attribution(model: Ensemble, x: str | Column) -> Column:
    """`contributions` of a row's features, as an array in their order."""
    @F.pandas_udf("array<double>")
    def split(values: pd.Series) -> pd.Series:
        return pd.Series(list(contributions(model, np.stack(values.to_numpy()))) if len(values) else [])

    return split(x)

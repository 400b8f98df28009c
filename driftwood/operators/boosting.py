"""Regularised gradient boosting of trees on binned columns.

Rows are binned once: every column at its own quantiles, a missing value in a
bin of its own.  A level of a tree is one job: each task sums gradients and
Hessians of the logistic loss per (node, column, bin) and hands on one array;
arrays are summed in the order of the tasks.  Only these tables (nodes x columns
x bins) reach the driver, which picks the splits:

* the score of a node with gradient G and Hessian H is ``T(G)^2 / (H + lambda)``,
  ``T`` shrinking G towards 0 by ``alpha``; a split gains half of what its
  children score beyond the node, less ``gamma``, and is made if that is above 0;
* both children need a Hessian of ``min_child_weight``;
* missing values go to the side that gains more (with none in the node: to the
  larger one);
* a leaf adds ``-learning_rate T(G) / (H + lambda)`` to the log odds.

``subsample`` keeps a row in a tree by a hash of its key and the tree's number,
``colsample`` draws columns per tree from the seed: the same rows give the same
trees wherever they lie.  ``scale_pos_weight`` weighs the positives.

Margins are kept with the rows and renewed in the shared checkpoint folder after
every ``RENEW`` trees, so a pass evaluates at most that many trees and a lost
executor costs no more than the last ones.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwood.operators.newton import ordered_sums
from driftwood.session import cut_lineage, ship_package

BINS, RENEW = 64, 16


@dataclass(frozen=True)
class Parameters:
    n_estimators: int = 50
    max_depth: int = 5
    learning_rate: float = 0.1
    reg_lambda: float = 1.0
    reg_alpha: float = 0.0
    gamma: float = 0.0
    min_child_weight: float = 2.0
    subsample: float = 1.0
    colsample: float = 1.0
    scale_pos_weight: float = 1.0
    max_bins: int = BINS
    seed: int = 42

    def __post_init__(self):
        if self.n_estimators < 1 or self.max_depth < 1 or not 2 <= self.max_bins <= 255:
            raise ValueError("n_estimators and max_depth are 1 or more, max_bins from 2 to 255")
        if min(self.reg_lambda, self.reg_alpha, self.gamma, self.min_child_weight) < 0:
            raise ValueError("penalties can't be negative")
        if not (0 < self.subsample <= 1 and 0 < self.colsample <= 1):
            raise ValueError("subsample and colsample are above 0 and at most 1")


@dataclass
class Tree:
    """Nodes by number, children of i at 2i + 1 and 2i + 2: splits are (column,
    last bin to the left, missing to the left, gain), leaves are values."""

    splits: dict = field(default_factory=dict)
    leaves: dict = field(default_factory=dict)

    def places(self, bins: np.ndarray, missing: int) -> np.ndarray:
        """The leaf (or still open node) of every row."""
        ids, at = self._walk(bins, missing)
        return ids[at]

    def values(self, bins: np.ndarray, missing: int) -> np.ndarray:
        ids, at = self._walk(bins, missing)
        return np.array([self.leaves.get(int(i), 0.0) for i in ids], float)[at]

    def _walk(self, bins: np.ndarray, missing: int) -> tuple[np.ndarray, np.ndarray]:
        """The tree's nodes, and where in them every row ends: all rows go down a
        level at a time."""
        ids = sorted({0, *(c for n in self.splits for c in (2 * n + 1, 2 * n + 2))})
        place = {n: i for i, n in enumerate(ids)}
        table = np.zeros((len(ids), 5), np.int64)  # column, last bin, missing left, children
        split = np.zeros(len(ids), bool)
        for n, (c, b, left, _) in self.splits.items():
            table[place[n]], split[place[n]] = (c, b, left, place[2 * n + 1], place[2 * n + 2]), True
        column, last, left, yes, no = table.T
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(bins) and (going := split[at]).any():
            b = bins[rows, column[at]]
            down = np.where(np.where(b == missing, left[at] == 1, b <= last[at]), yes[at], no[at])
            at = np.where(going, down, at)
        return np.array(ids, np.int64), at


@dataclass
class Boosted:
    """A fitted model: column names, the bins' upper edges per column, the log
    odds that it starts from, and the trees."""

    columns: list[str]
    edges: list[list[float]]
    start: float
    trees: list[Tree]
    missing: int

    def bins_of(self, columns) -> np.ndarray:
        out = np.empty((len(columns[0]), len(self.columns)), np.uint8)
        for i, (c, edges) in enumerate(zip(columns, self.edges)):
            x = np.asarray(c, float)
            out[:, i] = np.where(np.isnan(x), self.missing, np.searchsorted(edges, x, side="left"))
        return out

    def importance(self) -> dict[str, float]:
        """Summed gain per column."""
        out = dict.fromkeys(self.columns, 0.0)
        for t in self.trees:
            for column, _, _, gain in t.splits.values():
                out[self.columns[column]] += gain
        return out

    def table(self, spark) -> DataFrame:
        """A row per node: tree, node, feature, threshold (values up to it go
        left), missing_left, gain and value."""
        rows = []
        for k, t in enumerate(self.trees):
            rows += [(k, n, self.columns[c], float(self.edges[c][b]) if b < len(self.edges[c]) else math.inf, bool(m),
                      float(g), None) for n, (c, b, m, g) in t.splits.items()]
            rows += [(k, n, None, None, None, None, float(v)) for n, v in t.leaves.items()]
        return spark.createDataFrame(sorted(rows, key=lambda r: r[:2]), "tree int, node int, feature string, threshold double, "
                                     "missing_left boolean, gain double, value double")


def column_edges(df: DataFrame, columns: list[str], max_bins: int) -> list[list[float]]:
    """Upper edges of the bins: all values if there are few enough, else
    approximate quantiles; the largest value needs none."""
    x = lambda c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))
    ranks = [i / max_bins for i in range(1, max_bins)]
    row = df.agg(*[F.percentile_approx(x(c), ranks, 100 * max_bins).alias(f"q{i}") for i, c in enumerate(columns)],
                 *[F.max(x(c)).alias(f"m{i}") for i, c in enumerate(columns)],
                 *[F.approx_count_distinct(x(c)).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    few = [c for i, c in enumerate(columns) if row[f"d{i}"] <= max_bins]
    exact = df.agg(*[F.collect_set(x(c)).alias(f"v{i}") for i, c in enumerate(few)]).first() if few else None
    # about max_bins values each
    out = []
    for i, c in enumerate(columns):
        values = exact[f"v{few.index(c)}"] if c in few else row[f"q{i}"] or []
        if len(set(values)) > max_bins:
            values = row[f"q{i}"] or []
        out.append([v for v in sorted(set(values)) if v < row[f"m{i}"]])
    return out


def _shrink(g, alpha: float):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def best_split(sums: np.ndarray, allowed: list[int], p: Parameters) -> tuple | None:
    """(column, last left bin, missing left, gain, left G and H, right G and H)
    of a node's (column, bin, [G, H, rows]) sums; the last bin is the missing
    one.  Ties go to the earlier column and bin, and missing values to the
    left."""
    score = lambda g, h: _shrink(g, p.reg_alpha) ** 2 / np.maximum(h + p.reg_lambda, 1e-300)
    total = sums[allowed[0]].sum(axis=0)
    best = None
    for c in allowed:
        known, lost = sums[c, :-1], sums[c, -1]
        run = np.cumsum(known, axis=0)
        for to_left in ((True, False) if lost[2] else (None,)):
            left = run + lost if to_left else run
            right = total - left
            ok = (left[:, 2] > 0) & (right[:, 2] > 0) & (left[:, 1] >= p.min_child_weight) & (right[:, 1] >= p.min_child_weight)
            if not ok.any():
                continue
            gain = 0.5 * (score(left[:, 0], left[:, 1]) + score(right[:, 0], right[:, 1])
                          - score(total[0], total[1])) - p.gamma
            gain = np.round(np.where(ok, gain, -np.inf), 10)
            b = int(gain.argmax())
            if gain[b] > 0 and (best is None or gain[b] > best[3]):
                side = bool(left[b, 1] >= right[b, 1]) if to_left is None else to_left
                best = (c, b, side, float(gain[b]), left[b], right[b])
    return best


def fit(df: DataFrame, label: str, key: str, columns: list[str], parameters: Parameters = Parameters()) -> Boosted:
    """Fit on the rows that have a label (0 or 1).  ``key`` decides the
    subsamples only."""
    p, spark = parameters, df.sparkSession
    ship_package(spark)
    missing = p.max_bins
    model = Boosted(list(columns), column_edges(df, columns, p.max_bins), 0.0, [], missing)
    src = df.select(F.col(f"`{label}`").cast("double").alias("y"), F.xxhash64(F.col(f"`{key}`")).alias("key"),
                    *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)]) \
        .where("y is not null and not isnan(y)")
    shared = spark.sparkContext.broadcast(model)

    def binned(batches):
        m = shared.value
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[2:]]
            bins = m.bins_of(cols)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([r.tobytes() for r in bins], pa.binary()),
                 pa.array(np.zeros(len(bins)))], names=["y", "key", "bins", "margin"])

    schema = "y double, key long, bins binary, margin double"
    rows = cut_lineage(src.mapInArrow(binned, schema))
    n, positives = rows.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not n or not 0 < positives < n:
        raise ValueError("both classes are needed")
    model.start = math.log(p.scale_pos_weight * positives / (n - positives))
    rnd, done = random.Random(p.seed), 0  # done: trees that the margins include
    for k in range(p.n_estimators):
        width = max(1, round(p.colsample * len(columns)))
        allowed = sorted(rnd.sample(range(len(columns)), width))
        tree = Tree()
        model.trees.append(tree)
        open_nodes = [0]
        for depth in range(p.max_depth):
            sums = _level(rows, model, done, open_nodes, p, sorted({0, *allowed}))
            grown = []
            for node in open_nodes:
                if node not in sums:
                    tree.leaves[node] = 0.0
                    continue
                found = best_split(sums[node], allowed, p)
                if found is None:
                    total = sums[node][0].sum(axis=0)
                    tree.leaves[node] = _leaf(total, p)
                    continue
                c, b, left, gain, gl, gr = found
                tree.splits[node] = (c, b, left, gain)
                if depth + 1 == p.max_depth:
                    tree.leaves[2 * node + 1], tree.leaves[2 * node + 2] = _leaf(gl, p), _leaf(gr, p)
                else:
                    grown += [2 * node + 1, 2 * node + 2]
            open_nodes = grown
            if not open_nodes:
                break
        if (k + 1) % RENEW == 0 and k + 1 < p.n_estimators:
            rows, done = cut_lineage(_renewed(rows, model, done)), k + 1
    return model


def _leaf(total: np.ndarray, p: Parameters) -> float:
    return float(-p.learning_rate * _shrink(total[0], p.reg_alpha) / max(total[1] + p.reg_lambda, 1e-300))


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(pa.concat_arrays([batch.column(2).cast(pa.binary(width))]).buffers()[1], np.uint8,
                         batch.num_rows * width).reshape(-1, width)


def _renewed(rows: DataFrame, model: Boosted, done: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((len(model.columns), model.missing, model.trees[done:]))

    def run(batches):
        width, missing, trees = shared.value
        for batch in batches:
            if batch.num_rows:
                bins = _matrix(batch, width)
                margin = batch.column(3).to_numpy(zero_copy_only=False) + sum(t.values(bins, missing) for t in trees)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(margin)], names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def _level(rows: DataFrame, model: Boosted, done: int, nodes: list[int], p: Parameters,
           wanted: list[int]) -> dict[int, np.ndarray]:
    """(column, bin, [G, H, rows]) sums of the open nodes of the last tree; those
    of columns that the tree doesn't use stay 0."""
    number = len(model.trees) - 1
    width, depth_bins = len(model.columns), model.missing + 1
    shared = rows.sparkSession.sparkContext.broadcast((model, done, nodes, p, number, wanted))

    def arrays(batches):
        model, done, nodes, p, number, wanted = shared.value
        place = {n: i for i, n in enumerate(nodes)}
        known = np.array(sorted(nodes), np.int64)
        number_of = np.array([place[n] for n in known])
        total = np.zeros((len(nodes), width, depth_bins, 3))
        seen = False
        for batch in batches:
            if not batch.num_rows:
                continue
            y, key, margin = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 3))
            bins = _matrix(batch, width)
            keep = np.ones(len(y), bool)
            if p.subsample < 1:
                mixed = (key.view(np.uint64) ^ np.uint64((number + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
                mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                keep = (mixed >> np.uint64(11)) / float(1 << 53) < p.subsample
            at = model.trees[-1].places(bins, model.missing)
            found = np.minimum(np.searchsorted(known, at), len(known) - 1)
            node = np.where(known[found] == at, number_of[found], -1)
            keep &= node >= 0
            if not keep.any():
                continue
            seen = True
            bins, y, node = bins[keep], y[keep], node[keep]
            margin = margin[keep] + model.start + sum(
                (t.values(bins, model.missing) for t in model.trees[done:-1]), np.zeros(len(y)))
            prob = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
            weight = np.where(y > 0.5, p.scale_pos_weight, 1.0)
            g, h = weight * (prob - y), weight * prob * (1 - prob)
            for c in wanted:
                flat = node * depth_bins + bins[:, c]
                for j, v in enumerate((g, h, None)):
                    total[:, c, :, j] += np.bincount(flat, v, minlength=len(nodes) * depth_bins).reshape(len(nodes), depth_bins)
        if seen:
            for n, i in place.items():
                if total[i, 0, :, 2].any():
                    yield n, total[i].ravel()

    found = ordered_sums(rows, arrays)
    return {n: s.reshape(width, depth_bins, 3) for n, s in found.items()}


def predict(df: DataFrame, model: Boosted, key: str, keep: list[str] = ()) -> DataFrame:
    """(key, kept columns, probability) of every row."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    head = [key, *keep]
    src = df.select(*[F.col(f"`{c}`") for c in head], *[F.col(f"`{c}`").cast("double").alias(f"__x{i}") for i, c in enumerate(model.columns)])

    def run(batches):
        m = shared.value
        for batch in batches:
            if batch.num_rows:
                bins = m.bins_of([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[len(head):]])
                margin = m.start + sum((t.values(bins, m.missing) for t in m.trees), np.zeros(len(bins)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:len(head)], pa.array(1 / (1 + np.exp(-margin)))],
                                                 names=[*head, "probability"])

    fields = [src.schema[c] for c in head] + [T.StructField("probability", T.DoubleType())]
    return src.mapInArrow(run, T.StructType(fields))

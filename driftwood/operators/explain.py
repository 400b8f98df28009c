"""Per-row tree attributions (path-dependent TreeSHAP) and the tables
behind global importance, beeswarm, waterfall and dependence views.

Trees are read from the model's own persisted form (Spark ML ``save`` into
the shared checkpoint folder, then the ``data`` table: per node the split
feature, threshold, children, prediction and weighted cover).  The node
arrays are broadcast (size bounded by the model: trees x nodes) and each
partition computes attributions in ``mapInPandas``; no row leaves its task.

Path-dependent TreeSHAP (Lundberg, Erion & Lee 2018, "Consistent
Individualized Feature Attribution for Tree Ensembles").  A leaf's
contribution depends on a row only through which of the distinct features on
the leaf's path the row satisfies.  Per Arrow batch and leaf the patterns
that occur are told apart, their contributions are worked out from the
path's polynomial in one vectorised pass, and every row gathers its own: no
row loop, and no table that grows with the depth.  The per-row recursion of
the paper (Algorithm 2) is kept as ``method='recursive'`` for the tests.
For boosted trees attributions are in margin space: base_value + sum(shap)
equals the model's margin (sum of weighted tree outputs).
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.session import cut_lineage, ensure_checkpoint_dir, ship_package


_EXPORTED: dict = {}


def export_trees(model, spark=None) -> dict:
    """Node arrays of a GBT / random-forest model (one entry per tree);
    memoised per model within an application (fitted models inherit their
    estimator's uid, so the key also carries a digest of the trees)."""
    import hashlib

    spark = spark or _spark()
    digest = hashlib.sha1(model.toDebugString.encode()).hexdigest()
    memo = (spark.sparkContext.applicationId, model.uid, digest)
    if memo in _EXPORTED:
        return _EXPORTED[memo]
    _EXPORTED[memo] = out = _export_trees(spark, model)
    return out


def _export_trees(spark, model) -> dict:
    root = ensure_checkpoint_dir(spark)
    path = f"{root.rstrip('/')}/driftwood-model-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    nodes = data.select("treeID", "nodeData.id", "nodeData.prediction",
                        F.col("nodeData.impurityStats").alias("stats"),
                        "nodeData.leftChild", "nodeData.rightChild",
                        F.col("nodeData.split.featureIndex").alias("feature"),
                        F.col("nodeData.split.leftCategoriesOrThreshold").alias("thr"),
                        F.col("nodeData.split.numCategories").alias("ncat")).toPandas()
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    is_forest = not hasattr(model, "getStepSize")
    weights = list(model.treeWeights)
    if is_forest:
        weights = [1.0 / len(weights)] * len(weights)
    trees = []
    for tid, g in nodes.groupby("treeID"):
        g = g.sort_values("id")
        n = int(g["id"].max()) + 1
        left = np.full(n, -1, np.int64)
        right = np.full(n, -1, np.int64)
        feat = np.full(n, -1, np.int64)
        thr = np.zeros(n)
        value = np.zeros(n)
        cover = np.zeros(n)
        for r in g.itertuples(index=False):
            i = int(r.id)
            left[i], right[i], feat[i] = r.leftChild, r.rightChild, r.feature
            if r.ncat != -1 and r.feature >= 0:
                raise ValueError("categorical splits are not supported")
            thr[i] = r.thr[0] if len(r.thr) else 0.0
            stats = np.asarray(r.stats, dtype=float)
            if is_forest:  # class counts -> probability of class 1
                cover[i] = stats.sum()
                value[i] = stats[1] / stats.sum() if stats.sum() > 0 and len(stats) > 1 else 0.0
            else:          # variance stats: [weighted count, sum, sum of squares]
                cover[i] = stats[0]
                value[i] = r.prediction
        trees.append({"left": left, "right": right, "feature": feat, "thr": thr,
                      "value": value, "cover": cover, "weight": weights[int(tid)]})
    return {"trees": trees, "n_features": model.numFeatures}


def _expected(t: dict) -> float:
    leaves = t["left"] < 0
    return float((t["value"][leaves] * t["cover"][leaves]).sum() / t["cover"][0])


def _tree_shap(x: np.ndarray, t: dict, phi: np.ndarray) -> None:
    """Add one tree's attributions for row ``x`` into ``phi``."""
    left, right, feat, thr, value, cover = (t["left"], t["right"], t["feature"], t["thr"],
                                            t["value"], t["cover"])

    def extend(d, z, o, w, l, pz, po, pi):
        d[l], z[l], o[l], w[l] = pi, pz, po, (1.0 if l == 0 else 0.0)
        for i in range(l - 1, -1, -1):
            w[i + 1] += po * w[i] * (i + 1) / (l + 1)
            w[i] = pz * w[i] * (l - i) / (l + 1)

    def unwound_sum(z, o, w, l, i):
        total = 0.0
        n = w[l]
        for j in range(l - 1, -1, -1):
            if o[i] != 0:
                tmp = n * (l + 1) / ((j + 1) * o[i])
                total += tmp
                n = w[j] - tmp * z[i] * (l - j) / (l + 1)
            else:
                total += (w[j] / z[i]) / ((l - j) / (l + 1))
        return total

    def unwind(d, z, o, w, l, i):
        n = w[l]
        for j in range(l - 1, -1, -1):
            if o[i] != 0:
                tmp = w[j]
                w[j] = n * (l + 1) / ((j + 1) * o[i])
                n = tmp - w[j] * z[i] * (l - j) / (l + 1)
            else:
                w[j] = (w[j] * (l + 1)) / (z[i] * (l - j))
        for j in range(i, l):
            d[j], z[j], o[j] = d[j + 1], z[j + 1], o[j + 1]

    depth_cap = 64

    def recurse(node, d, z, o, w, l, pz, po, pi):
        d, z, o, w = d.copy(), z.copy(), o.copy(), w.copy()
        extend(d, z, o, w, l, pz, po, pi)
        if left[node] < 0:
            for i in range(1, l + 1):
                s = unwound_sum(z, o, w, l, i)
                phi[d[i]] += s * (o[i] - z[i]) * value[node]
            return
        f = feat[node]
        xv = x[f]
        go_left = xv <= thr[node]  # NaN goes right
        hot, cold = (left[node], right[node]) if go_left else (right[node], left[node])
        iz = io = 1.0
        k = -1
        for j in range(1, l + 1):
            if d[j] == f:
                k = j
                break
        if k > 0:
            iz, io = z[k], o[k]
            unwind(d, z, o, w, l, k)
            l -= 1
        rc = cover[node]
        recurse(hot, d, z, o, w, l + 1, iz * cover[hot] / rc, io, f)
        recurse(cold, d, z, o, w, l + 1, iz * cover[cold] / rc, 0.0, f)

    size = depth_cap + 2
    d = np.zeros(size, np.int64)
    z = np.zeros(size)
    o = np.zeros(size)
    w = np.zeros(size)
    recurse(0, d, z, o, w, 0, 1.0, 1.0, -1)


def leaf_paths(t: dict) -> list[tuple]:
    """Per leaf: distinct features on its path, per feature the conditions
    (threshold, goes left) and the product of cover fractions, leaf value."""
    left, right, feat, thr, cover = t["left"], t["right"], t["feature"], t["thr"], t["cover"]
    out, stack = [], [(0, {})]
    while stack:
        node, path = stack.pop()
        if left[node] < 0:
            out.append((np.array(list(path), dtype=np.int64), [c for c, _ in path.values()],
                        np.array([z for _, z in path.values()]), t["value"][node]))
            continue
        f = feat[node]
        conds, z = path.get(f, ((), 1.0))
        for child, goes_left in ((left[node], True), (right[node], False)):
            stack.append((child, {**path, f: (conds + ((thr[node], goes_left),),
                                              z * cover[child] / cover[node])}))
    return out


def path_contributions(o: np.ndarray, z: np.ndarray, value: float) -> np.ndarray:
    """Contribution of every path feature for 0/1 patterns ``o`` (n, d).

    Feature i gets value (o_i - z_i) sum_s w(s) [X^s] prod_{j != i} (z_j + o_j X)
    with w(s) = s! (d - s - 1)! / d!.  The product over all features is built
    once; a factor is taken out again by synthetic division (o_i = 1) or by
    dividing by z_i (o_i = 0); z_i = 0 rebuilds the product without it."""
    from math import comb
    n, d = o.shape

    def product(cols):
        coeff = np.zeros((n, len(cols) + 1))
        coeff[:, 0] = 1.0
        for k, j in enumerate(cols):
            coeff[:, 1:k + 2] = coeff[:, 1:k + 2] * z[j] + coeff[:, :k + 1] * o[:, [j]]
            coeff[:, 0] *= z[j]
        return coeff

    full = product(range(d))
    w = np.array([1.0 / (d * comb(d - 1, s)) for s in range(d)])
    out = np.zeros((n, d))
    for i in range(d):
        if z[i] > 0:
            divided = np.zeros((n, d))
            divided[:, d - 1] = full[:, d]
            for k in range(d - 1, 0, -1):
                divided[:, k - 1] = full[:, k] - z[i] * divided[:, k]
            rest = np.where(o[:, [i]] > 0, divided, full[:, :d] / z[i])
        else:
            rest = product([j for j in range(d) if j != i])
        out[:, i] = value * (o[:, i] - z[i]) * (rest @ w)
    return out


def _batch_shap(X: np.ndarray, paths: list[tuple], weight: float, phi: np.ndarray) -> None:
    """Add one tree's attributions for all rows of X (n, m) into phi (n, m)."""
    for feats, conds, z, value in paths:
        if not len(feats):
            continue  # a tree that is one leaf attributes nothing
        met = np.ones((X.shape[0], len(feats)), dtype=bool)
        for k, (f, cl) in enumerate(zip(feats, conds)):
            for th, goes_left in cl:
                le = X[:, f] <= th  # NaN compares False: goes right
                met[:, k] &= le if goes_left else ~le
        packed = np.packbits(met, axis=1)
        code = packed.view([("", packed.dtype)] * packed.shape[1]).ravel()
        _, first, mine = np.unique(code, return_index=True, return_inverse=True)
        phi[:, feats] += weight * path_contributions(met[first].astype(float), z, value)[mine]


def _batch_predict(X: np.ndarray, t: dict) -> np.ndarray:
    node = np.zeros(X.shape[0], dtype=np.int64)
    for _ in range(64):
        inner = t["left"][node] >= 0
        if not inner.any():
            break
        f = t["feature"][node]
        go_left = X[np.arange(X.shape[0]), np.where(inner, f, 0)] <= t["thr"][node]
        nxt = np.where(go_left, t["left"][node], t["right"][node])
        node = np.where(inner, nxt, node)
    return t["value"][node]


def shap_values(model, df: DataFrame, key: str, feature_names: list[str],
                features_col: str = "features", method: str = "paths") -> DataFrame:
    """Long table (key, feature, value, shap, base_value, margin) for every
    row of ``df`` (which must carry ``features_col``).

    method 'paths' (default): vectorised over each Arrow batch; 'recursive':
    the per-row recursion (for tests).  The node arrays are broadcast: their
    size is that of the model."""
    if method not in ("paths", "recursive"):
        raise ValueError("method must be 'paths' or 'recursive'")
    spark = df.sparkSession
    ship_package(spark)  # the batch function runs in Python workers
    trees = export_trees(model, spark)["trees"]
    base = sum(t["weight"] * _expected(t) for t in trees)
    bc = spark.sparkContext.broadcast(trees)
    names = list(feature_names)
    m = len(names)
    key_type = df.schema[key].dataType.simpleString()

    def run(batches):
        ts = bc.value
        paths = [leaf_paths(t) if method == "paths" else None for t in ts]
        for pdf in batches:
            if len(pdf) == 0:
                continue
            keys = pdf[key].to_numpy()
            X = np.vstack([np.asarray(v, dtype=float) for v in pdf["_x"].to_numpy()])
            n = X.shape[0]
            phi = np.zeros((n, max(m, X.shape[1]) + 1))
            margin = np.zeros(n)
            for t, leaves in zip(ts, paths):
                margin += t["weight"] * _batch_predict(X, t)
                if leaves is not None:
                    _batch_shap(X, leaves, t["weight"], phi)
                else:
                    for r in range(n):
                        part = np.zeros(phi.shape[1])
                        _tree_shap(X[r], t, part)
                        phi[r] += t["weight"] * part
            yield pd.DataFrame({key: np.repeat(keys, m), "feature": np.tile(names, n),
                                "value": X[:, :m].reshape(-1), "shap": phi[:, :m].reshape(-1),
                                "base_value": base, "margin": np.repeat(margin, m)})

    vec = df.select(key, vector_to_array(features_col).alias("_x"))
    schema = (f"`{key}` {key_type}, feature string, value double, shap double, "
              "base_value double, margin double")
    return vec.mapInPandas(run, schema)


def global_importance(shap: DataFrame, top: int = 20) -> DataFrame:
    """Mean |shap| per feature, top ``top`` (one row per feature)."""
    return (shap.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap"))
            .orderBy(F.desc("mean_abs_shap"), "feature").limit(top))


def beeswarm(shap: DataFrame, top: int = 20) -> DataFrame:
    """(key, feature, value, shap) rows of the ``top`` features.  The
    attributions are read twice, so they are written once to the shared
    checkpoint folder rather than computed twice."""
    shap = cut_lineage(shap)
    best = global_importance(shap, top).select("feature")
    return shap.join(F.broadcast(best), "feature", "left_semi")  # at most ``top`` rows


def waterfall(shap: DataFrame, key: str, key_value, top: int = 15) -> DataFrame:
    """One row's attributions: the ``top`` largest by |shap|, the rest summed
    into one 'other features' row.  Attribute only the wanted row: a filter
    on the result can't be pushed below the attribution itself."""
    ranked = shap.where(F.col(key) == F.lit(key_value)).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(
        (-F.abs("shap")).alias("by"), "feature", "value", "shap"))).alias("all"))  # one entry per feature
    rest = F.slice("all", top + 1, F.greatest(F.size("all") - top, F.lit(0)))
    other = F.struct(F.lit("other features").alias("feature"), F.lit(None).cast("double").alias("value"),
                     F.aggregate(rest, F.lit(0.0), lambda a, x: a + x["shap"]).alias("shap"))
    head = F.transform(F.slice("all", 1, top), lambda x: F.struct(x["feature"], x["value"], x["shap"]))
    shown = F.concat(head, F.when(F.size("all") > top, F.array(other)).otherwise(F.slice(F.array(other), 1, 0)))
    return ranked.select(key, F.posexplode(shown).alias("_p", "_s")).select(
        key, "_s.feature", "_s.value", "_s.shap", (F.col("_p") + 1).alias("position"))


def dependence(shap: DataFrame, feature: str) -> DataFrame:
    """(key, value, shap) of one feature."""
    return shap.where(F.col("feature") == feature).drop("feature")


def _spark():
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()

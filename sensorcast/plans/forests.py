"""Random forests over many rows: Spark ML's models, grown and applied with arrays.

Spark ML adds every row to the sums of all trees in turn, so that with deep trees nearly every sum lies outside the
processor's caches, and scores row by row through the nodes of all trees. Here a block of rows is taken through one tree after
the other. The trees are those of Spark ML: bootstrapped rows, bins at quantiles, a third of the features at each node, variance;
only the random draws differ. Models are stored in Spark ML's format and are its own classes.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from multiprocessing.pool import ThreadPool
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorcast.staging import scratch_path, stage

# What ``fit`` knows; a forest that sets anything else is Spark ML's to fit.
_KNOWN = {"featuresCol", "labelCol", "seed", "numTrees", "maxDepth", "maxBins", "minInstancesPerNode", "bootstrap"}
# Rows of a block: its columns and the sums of a tree's deepest nodes stay in a processor's cache. Below 65,536, so that
# a row's place fits 16 bits.
_BLOCK = 65_000
_TASK = 1_000_000


def can_fit(estimator) -> bool:
    if not isinstance(estimator, RandomForestRegressor):
        return False
    given = {p.name for p in estimator.params if estimator.isSet(p)}
    return given <= _KNOWN and estimator.getMaxDepth() <= 16 and estimator.getMaxBins() <= 256


# Bins and blocks


def _thresholds(values: np.ndarray, bins: int) -> np.ndarray:
    """Where a feature may be split, as Spark ML finds it: between all distinct values, or at equal shares of the rows."""
    distinct, counts = np.unique(values, return_counts=True)
    middle = distinct[:-1] / 2 + distinct[1:] / 2
    if len(middle) < bins:
        return middle
    stride = len(values) / bins
    found, target, total = [], stride, counts[0]
    for i in range(1, len(distinct)):
        before, total = total, total + counts[i]
        if abs(before - target) < abs(total - target):
            found.append(middle[i - 1])
            target += stride
    return np.array(found)


def prepare(rows: DataFrame, features: Sequence[str], labels: Sequence[str], bins: int, seed: int, count: int) -> tuple[DataFrame, list]:
    """The rows in blocks, features by their bins, and the bins' bounds. A label is null where the row is not for its fit.
    Bounds come from as many of the ``count`` rows as Spark ML takes for them."""
    share = max(bins * bins, 10_000) / count
    some = rows.select(*features) if share >= 1 else rows.select(*features).sample(share, seed=seed)
    sampled = some.toPandas()
    bounds = [_thresholds(sampled[f].to_numpy(float), min(bins, count)) for f in features]

    def block(n: int, columns: list[np.ndarray]) -> pa.RecordBatch:
        x = np.stack([np.searchsorted(b, c).astype(np.uint8) for b, c in zip(bounds, columns)])
        arrays = [pa.array([n]), pa.array([x.tobytes()], pa.binary())]
        arrays += [pa.array([y.tobytes()], pa.binary()) for y in columns[len(features) :]]
        return pa.RecordBatch.from_arrays(arrays, names=["block", "x", *labels])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, held, rows_held = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]
            for c, values in zip(batch.columns, columns):
                if not np.isfinite(values).sum() == len(values) - c.null_count:
                    raise ValueError("features and labels must not be NaN or infinite")
            held.append(columns)
            rows_held += len(columns[0])
            while rows_held >= _BLOCK:
                whole = [np.concatenate(parts) for parts in zip(*held)]
                yield block(n, [c[:_BLOCK] for c in whole])
                n, held, rows_held = n + 1, [[c[_BLOCK:] for c in whole]], rows_held - _BLOCK
        if rows_held:
            yield block(n, [np.concatenate(parts) for parts in zip(*held)])

    schema = ", ".join(["block long", "x binary", *[f"`{label}` binary" for label in labels]])
    numbers = rows.select(*[F.col(c).cast("double") for c in (*features, *labels)])
    return stage(numbers.mapInArrow(blocks, schema), "forest-blocks"), bounds


# Growing


def _begin(row, features: int, trees: int, seed: int, bootstrap: bool):
    """A block with, for each tree, the places of the rows it draws, their node and how often they were drawn."""
    y = np.frombuffer(row[2])
    x = np.frombuffer(row[1], np.uint8).reshape(features, len(y))
    random = np.random.default_rng([seed & (2**63 - 1), row[0]])
    drawn = []
    for _ in range(trees):
        weight = random.poisson(1.0, len(y)) if bootstrap else np.ones(len(y), int)
        at = np.flatnonzero((weight > 0) & ~np.isnan(y))
        drawn.append((at.astype(np.uint16), np.zeros(len(at), np.uint16), weight[at].astype(np.uint8)))
    return x, y, drawn


def _descend(block, splits: list):
    """Rows go on to the children of their nodes; those in leaves are done."""
    x, y, drawn = block
    flat, n, out = x.ravel(), x.shape[1], []
    for (at, node, weight), (feature, cut, child) in zip(drawn, splits):
        below = child.take(node)
        on = below >= 0
        if not on.all():
            at, node, weight, below = at[on], node[on], weight[on], below[on]
        value = flat.take((feature * n).take(node) + at)
        out.append((at, (below + (value > cut.take(node))).astype(np.uint16), weight))
    return x, y, out


def _sums(blocks: Iterator, nodes: list[int], chosen: list, bins: int) -> Iterator:
    """Per tree the sums of its nodes (rows, label, label squared) and, by chosen feature and bin, of rows and label."""
    totals = {}
    for x, y, drawn in blocks:
        flat, n = x.ravel(), x.shape[1]
        for t, (at, node, weight) in enumerate(drawn):
            if not len(at):
                continue
            if t not in totals:
                picks = chosen[t].shape[1]
                totals[t] = [np.zeros((3, nodes[t])), np.zeros((picks, nodes[t] * bins)), np.zeros((picks, nodes[t] * bins))]
            whole, rows, sums = totals[t]
            node, at, times = node.astype(np.intp), at.astype(np.intp), weight.astype(float)
            value = y.take(at)
            weighted = times * value
            whole[0] += np.bincount(node, times, nodes[t])
            whole[1] += np.bincount(node, weighted, nodes[t])
            whole[2] += np.bincount(node, weighted * value, nodes[t])
            first = node * bins
            for k in range(chosen[t].shape[1]):
                key = (chosen[t][:, k] * n).take(node)
                key += at
                key = flat.take(key) + first
                rows[k] += np.bincount(key, times, nodes[t] * bins)
                sums[k] += np.bincount(key, weighted, nodes[t] * bins)
    yield from totals.items()


def _added(a: list, b: list) -> list:
    return [x + y for x, y in zip(a, b)]


def _best(found, chosen: list, bins: int, cuts: np.ndarray, least: int):
    """Per node of a tree its sums and its best split: feature, bin and gain, which is 0 where there is none."""
    t, (whole, rows, sums) = found
    nodes, picks = whole.shape[1], len(rows)
    rest = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64), np.zeros(nodes)
    if not picks or bins < 2:
        return t, (whole, *rest)
    count, total, squares = whole
    place = lambda a: np.cumsum(a.reshape(picks, nodes, bins).transpose(1, 0, 2), 2)[:, :, :-1]
    left, below = place(rows), place(sums)
    right, above = count[:, None, None] - left, total[:, None, None] - below
    able = (left >= least) & (right >= least) & (np.arange(bins - 1) < cuts[chosen[t]][:, :, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(able, below**2 / left + above**2 / right, -np.inf).reshape(nodes, -1)
        best = score.argmax(1)
        gain = (score[np.arange(nodes), best] - total**2 / count) / count
        impurity = squares / count - (total / count) ** 2
    # Sums that only differ by rounding part nothing.
    gain = np.where(np.isfinite(gain) & (gain > 1e-12 * np.maximum(squares / count, 1e-300)) & (impurity > 0), gain, 0.0)
    return t, (whole, chosen[t][np.arange(nodes), best // (bins - 1)], best % (bins - 1), gain)


def fit(blocks: DataFrame, bounds: list, label: str, estimator: RandomForestRegressor, count: int) -> RandomForestRegressionModel:
    """The forest of one label, a pass over the blocks for each depth of all its trees. Each pass adds up per task and tree,
    and finds the best splits where the sums of a tree meet."""
    trees, depth, seed = estimator.getNumTrees(), estimator.getMaxDepth(), estimator.getSeed()
    least, features = estimator.getMinInstancesPerNode(), len(bounds)
    cuts = np.array([len(b) for b in bounds])
    bins, picks = int(cuts.max()) + 1, features if trees == 1 else -(-features // 3)
    tasks = max(blocks.sparkSession.sparkContext.defaultParallelism, -(-count // _TASK))
    random = np.random.default_rng([seed & (2**63 - 1)])
    bootstrap = estimator.getBootstrap()
    state = blocks.select("block", "x", label).repartition(tasks).rdd.map(lambda row: _begin(row, features, trees, seed, bootstrap))
    state = state.persist(StorageLevel.DISK_ONLY)
    grown, nodes = [[] for _ in range(trees)], [1] * trees
    for level in range(depth + 1):
        wanted = picks if level < depth else 0
        chosen = [np.argsort(random.random((m, features)), axis=1)[:, :wanted] for m in nodes]
        added = state.mapPartitions(lambda b, m=nodes, c=chosen: _sums(b, m, c, bins)).reduceByKey(_added, min(tasks, trees))
        found = dict(added.map(lambda f, c=chosen: _best(f, c, bins, cuts, least)).collect())
        splits, further = [], []
        for t in range(trees):
            if t not in found:
                splits.append((np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, -1)))
                further.append(0)
                continue
            whole, feature, cut, gain = found[t]
            parts = gain > 0
            child = np.where(parts, 2 * (np.cumsum(parts) - 1), -1)
            grown[t].append((whole, feature, cut, gain, child))
            splits.append((feature, cut, child))
            further.append(2 * int(parts.sum()))
        if not any(further):
            break
        nodes, last = further, state
        state = last.map(lambda b, s=splits: _descend(b, s)).persist(StorageLevel.DISK_ONLY)
        if level:
            before.unpersist()
        before = last
    for held in (state, *([before] if level else [])):
        held.unpersist()
    return _model(blocks.sparkSession, [_nodes(levels, bounds) for levels in grown], estimator, features)


def _nodes(levels: list, bounds: list) -> dict[str, np.ndarray]:
    """A tree's nodes by depth, as columns of Spark ML's table."""
    out, start = [], 0
    for whole, feature, cut, gain, child in levels:
        count, total, squares = whole
        nodes, parts = len(count), child >= 0
        mean = total / count
        threshold = np.array([bounds[f][c] if p else np.nan for f, c, p in zip(feature, cut, parts)])
        down = np.where(parts, start + nodes + child, -1)
        out.append((np.arange(nodes) + start, mean, np.maximum(squares / count - mean**2, 0), *whole, np.where(parts, gain, -1.0), down, np.where(parts, feature, -1), threshold))
        start += nodes
    names = ("id", "prediction", "impurity", "count", "total", "squares", "gain", "left", "feature", "threshold")
    return {n: np.concatenate(c) for n, c in zip(names, zip(*out))}


def _model(spark: SparkSession, trees: list[dict], estimator: RandomForestRegressor, features: int) -> RandomForestRegressionModel:
    """Spark ML's model with these trees: that of a row without features' worth, stored, its nodes exchanged and loaded."""
    path = scratch_path(spark, "forest")
    vector, label = estimator.getFeaturesCol(), estimator.getLabelCol()
    blank = spark.createDataFrame([(Vectors.dense([0.0] * features), 0.0)], [vector, label])
    estimator.fit(blank).write().save(path)
    schema = spark.read.parquet(f"{path}/data").schema
    parts = []
    for t, tree in enumerate(trees):
        inner = tree["left"] >= 0
        stats = np.stack([tree["count"], tree["total"], tree["squares"]], 1).ravel()
        ends = np.concatenate([[0], np.cumsum(inner)])
        split = pa.StructArray.from_arrays(
            [
                pa.array(tree["feature"], pa.int32()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tree["threshold"][inner])),
                pa.array(np.full(len(inner), -1), pa.int32()),
            ],
            names=["featureIndex", "leftCategoriesOrThreshold", "numCategories"],
        )
        columns = {
            "id": pa.array(tree["id"], pa.int32()),
            "prediction": pa.array(tree["prediction"]),
            "impurity": pa.array(tree["impurity"]),
            "impurityStats": pa.ListArray.from_arrays(pa.array(np.arange(len(inner) + 1) * 3, pa.int32()), pa.array(stats)),
            "rawCount": pa.array(tree["count"].astype(np.int64)),
            "gain": pa.array(tree["gain"]),
            "leftChild": pa.array(tree["left"], pa.int32()),
            "rightChild": pa.array(np.where(inner, tree["left"] + 1, -1), pa.int32()),
            "split": split,
        }
        data = pa.StructArray.from_arrays(list(columns.values()), names=list(columns))
        parts.append(pa.table({"treeID": pa.array(np.full(len(inner), t), pa.int32()), "nodeData": data}))
    nodes = spark.createDataFrame(pa.concat_tables(parts)).to(schema)
    nodes.coalesce(1).write.mode("overwrite").parquet(f"{path}/data")
    return RandomForestRegressionModel.load(path)


# Scoring


def can_score(model: PipelineModel) -> bool:
    return isinstance(model.stages[-1], RandomForestRegressionModel)


def _arrays(spark: SparkSession, model: RandomForestRegressionModel) -> list[tuple]:
    """Each tree as (features, thresholds, children by side, values, depth); a leaf is its own child."""
    path = scratch_path(spark, "forest")
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data").select(
        "treeID",
        *[F.col(f"nodeData.{c}").alias(c) for c in ("id", "prediction", "leftChild", "rightChild")],
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
    )
    out = []
    for _, tree in sorted(data.toPandas().groupby("treeID"), key=itemgetter(0)):
        tree = tree.sort_values("id")
        leaf = tree["leftChild"].to_numpy() < 0
        sides = tree[["leftChild", "rightChild"]].to_numpy(np.int64)
        child = np.where(leaf[:, None], tree["id"].to_numpy(np.int64)[:, None], sides)
        level, depth = np.zeros(1, np.int64), 0
        while len(level := level[~leaf[level]]):
            level, depth = child[level].ravel(), depth + 1
        feature = np.where(leaf, 0, tree["feature"].to_numpy(np.int64))
        out.append((feature, np.where(leaf, np.inf, tree["threshold"].to_numpy(float)), child.ravel(), tree["prediction"].to_numpy(float), depth))
    return out


def _predicted(x: np.ndarray, trees: list[tuple]) -> np.ndarray:
    """What Spark ML's model gives, trees added up in the same order."""
    n, flat, row = x.shape[1], x.ravel(), np.arange(x.shape[1])
    total = np.zeros(n)
    for feature, threshold, child, value, depth in trees:
        node, place = np.zeros(n, np.int64), feature * n
        for _ in range(depth):
            right = flat.take(place.take(node) + row) > threshold.take(node)
            node = child.take(2 * node + right)
        total += value.take(node)
    return total / len(trees)


def predict(rows: DataFrame, features: Sequence[str], models: Mapping[str, RandomForestRegressionModel]) -> DataFrame:
    """``rows`` with a column of each model's predictions, by its name."""
    spark = rows.sparkSession
    names = [f"p{i}" for i in range(len(models))]
    with ThreadPool(min(8, len(models))) as pool:
        arrays = pool.map(lambda m: _arrays(spark, m), list(models.values()), chunksize=1)
    shared = spark.sparkContext.broadcast(arrays)

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def forecast(*columns: pd.Series) -> pd.DataFrame:
        x = np.stack([c.to_numpy(float) for c in columns])
        if np.isnan(x).any():
            raise ValueError("features to be scored must not be null or NaN")
        return pd.DataFrame({n: _predicted(x, trees) for n, trees in zip(names, shared.value)})

    scored = rows.withColumn("_forecast", forecast(*[F.col(f).cast("double") for f in features]))
    return scored.withColumns({c: F.col("_forecast")[n] for c, n in zip(models, names)}).drop("_forecast")

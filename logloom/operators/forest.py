"""Isolation forest: bounded per-tree samples, trees built in parallel, vectorised scoring."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.labels import model_severity_name
from logloom.operators.anomaly import anomaly_type, contributing_factors
from logloom.scale import exact_quantiles, top_n
from logloom.session import materialize

EULER = 0.5772156649
NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, size int, depth int")


def _c(n, standard: bool = False):
    """Mean path length of an unsuccessful search among n rows; `standard` takes 1 for two rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2)
    mean = 2 * (np.log(safe - 1) + EULER) - 2 * (safe - 1) / safe
    return np.where(n <= 1, 0.0, np.where((n == 2) & standard, 1.0, mean))


class ForestModel:
    """Node table plus scaling values. The node table has at most n_trees * (2 * sample - 1) rows."""

    def __init__(self, nodes: pd.DataFrame, columns, means, stds, sample_size, threshold=None, standard=False):
        self.nodes, self.columns, self.means, self.stds = nodes, list(columns), means, stds
        self.sample_size, self.threshold, self.standard = sample_size, threshold, standard


def _build(sample: np.ndarray, max_depth: int, rng, standard: bool = False) -> list[tuple]:
    """Nodes of one tree, grown level by level from a work list. A node whose feature does not vary in it is a leaf;
    with `standard` the feature is drawn among those that vary."""
    nodes, work = [None], [(0, np.arange(len(sample)), 0)]
    while work:
        node, idx, depth = work.pop()
        rows = sample[idx]
        varied = np.flatnonzero(rows.min(axis=0) < rows.max(axis=0)) if standard and len(idx) else ()
        feature = int(varied[rng.integers(len(varied))]) if len(varied) else int(rng.integers(sample.shape[1]))
        low, high = (rows[:, feature].min(), rows[:, feature].max()) if len(idx) else (0.0, 0.0)
        if len(idx) <= 1 or depth >= max_depth or low == high:
            nodes[node] = (-1, 0.0, -1, -1, len(idx), depth)
            continue
        cut = float(rng.uniform(low, high))
        goes_left = rows[:, feature] < cut
        left, right = len(nodes), len(nodes) + 1
        nodes += [None, None]
        nodes[node] = (feature, cut, left, right, len(idx), depth)
        work += [(left, idx[goes_left], depth + 1), (right, idx[~goes_left], depth + 1)]
    return nodes


def forest_grow(df: DataFrame, columns: list[str], key: str = "id", n_trees: int = 100, sample_size: int = 256,
                seed: int = 42, standard: bool = False) -> ForestModel:
    """A model without a threshold. Trees grow on hash-chosen samples, so the result does not depend on partitioning. Rows first pass
    one coarse hash filter; every tree then takes the `sample_size` rows lowest by its own hash. `standard` grows the trees of the
    usual library form: to the depth that the sample needs (not all rows), on features that vary in the node."""
    stats = df.agg(F.count(F.lit(1)).alias("n"), *[x for c in columns for x in (
        F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    n = stats["n"]
    if n == 0:
        raise ValueError("no rows to fit")
    means = np.array([stats[f"m_{c}"] for c in columns], dtype=float)
    stds = np.array([stats[f"s_{c}"] for c in columns], dtype=float) + 1e-8
    size = min(sample_size, n)
    share = min(1.0, 128.0 * sample_size / n)
    scaled = [((F.col(c).cast("double") - float(m)) / float(s)) for c, m, s in zip(columns, means, stds)]
    pool = df.select(F.col(key).alias("_key"), F.array(*scaled).alias("x")).filter(
        F.pmod(F.xxhash64("_key", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    drawn = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1)))).withColumn(
        "_h", F.xxhash64("_key", "tree", F.lit(seed)))
    samples = top_n(drawn, ["tree"], [F.col("_h"), F.col("_key")], size).select("tree", "rn", "x")
    depth = math.ceil(math.log2(max(size if standard else n, 2)))

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        rows = np.array(group.sort_values("rn")["x"].tolist(), dtype=float)
        nodes = _build(rows, depth, np.random.default_rng([seed, tree]), standard)
        out = pd.DataFrame(nodes, columns=["feature", "threshold", "left", "right", "size", "depth"])
        out.insert(0, "node", range(len(out)))
        out.insert(0, "tree", tree)
        return out

    nodes = samples.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()  # bounded by the tree sizes
    return ForestModel(nodes, columns, means, stds, size, standard=standard)


def forest_fit_score(df: DataFrame, columns: list[str], key: str = "id", n_trees: int = 100, sample_size: int = 256,
                     contamination: float = 0.1, seed: int = 42, standard: bool = False) -> tuple[ForestModel, DataFrame]:
    """The model with the threshold that calls the share `contamination` of the rows anomalies, and the scored rows
    that the threshold was taken from: each row is scored once. With `standard` the threshold is the exact quantile."""
    model = forest_grow(df, columns, key, n_trees, sample_size, seed, standard)
    scored = materialize(forest_score(df, model), "forest-scores")
    if standard:
        model.threshold = exact_quantiles(scored, [], "anomaly_score", [1 - contamination]).first()["q_0"]
    else:
        model.threshold = scored.agg(F.percentile_approx("anomaly_score", 1 - contamination, 10_000)).first()[0]
    return model, scored.withColumn("is_anomaly", F.col("anomaly_score") > model.threshold)


def forest_fit(df: DataFrame, columns: list[str], key: str = "id", n_trees: int = 100, sample_size: int = 256,
               contamination: float = 0.1, seed: int = 42, standard: bool = False) -> ForestModel:
    """forest_fit_score without the scored rows."""
    return forest_fit_score(df.select(key, *columns), columns, key, n_trees, sample_size, contamination, seed, standard)[0]


def forest_score(df: DataFrame, model: ForestModel, strict: bool = False) -> DataFrame:
    """Adds anomaly_score in (0, 1] and, with a threshold, is_anomaly. `strict` normalises by 256
    rows even when the trees saw fewer."""
    trees = [g.sort_values("node") for _, g in model.nodes.groupby("tree")]
    packed = []
    for g in trees:  # a leaf leads to itself
        feature, cut, left, right, size, depth = (g[c].to_numpy() for c in ("feature", "threshold", "left", "right", "size", "depth"))
        leaf, own = feature < 0, np.arange(len(g))
        packed.append((np.where(leaf, 0, feature), cut, np.stack([np.where(leaf, own, right), np.where(leaf, own, left)], axis=1).ravel(),
                       depth + _c(size, model.standard), int(depth.max())))
    norm = float(_c(256 if strict else max(model.sample_size, 2), model.standard))
    means, stds = model.means, model.stds

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        x = (np.column_stack([c.to_numpy(dtype=float) for c in cols]) - means) / stds
        cells, total = x.ravel(), np.zeros(len(x))
        rows = np.arange(len(x)) * x.shape[1]
        for feature, cut, child, length, deepest in packed:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(deepest):
                at = child.take(2 * at + (cells.take(rows + feature.take(at)) < cut.take(at)))
            total += length.take(at)
        return pd.Series(2.0 ** (-(total / len(packed)) / norm))

    out = df.withColumn("anomaly_score", score(*[F.col(c).cast("double") for c in model.columns]))
    if model.threshold is not None:
        out = out.withColumn("is_anomaly", F.col("anomaly_score") > model.threshold)
    return out


def detect_anomalies(logs: DataFrame, features: DataFrame, model: ForestModel, key: str = "id") -> DataFrame:
    """Log rows with score, flag, type, confidence, explanation code and contributing factors."""
    return explained(logs, forest_score(features, model), key)


def explained(logs: DataFrame, scored: DataFrame, key: str = "id") -> DataFrame:
    """detect_anomalies for rows that are scored already (key, anomaly_score, is_anomaly)."""
    scored = scored.select(key, "anomaly_score", "is_anomaly")
    name = model_severity_name(F.col("severity"))
    rows = logs.join(scored, key)
    kind = anomaly_type(name, F.col("body_raw"))
    hit, s = F.col("is_anomaly"), F.col("anomaly_score")
    return (rows.withColumn("anomaly_type", F.when(hit, kind).otherwise("normal"))
            .withColumn("anomaly_confidence", F.when(hit, F.least(s * 1.5, F.lit(1.0))).otherwise(1 - s))
            .withColumn("explanation", F.when(hit, F.concat(F.lit("unusual_"), kind)).otherwise("normal"))
            .withColumn("factors", F.when(hit, contributing_factors(name, F.col("body_raw"), F.col("template_text")))
                        .otherwise(F.expr("cast(array() as array<struct<factor:string,value:string,contribution:double>>)"))))

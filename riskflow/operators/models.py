"""Isolation forest, the supervised model, its calibration and evaluation."""

from __future__ import annotations

import hashlib
import json
import math

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.ml.regression import IsotonicRegression
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config
from ..sources.shared import written
from .ranks import running_totals

SAMPLE = 256


def path_bound(n: float) -> float:
    """Mean path length of an unsuccessful search among n."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def drawing_trees(key: Column, n_rows: int, trees: int, sample: int, seed: int) -> Column:
    """The trees for which a row is drawn: each draws it by itself with a chance of twice ``sample`` in ``n_rows``.

    The gaps between such trees have a geometric distribution, so they are drawn in place of the trees: a row that no tree
    draws, as almost all in a large table, costs one hash. The chance is a double and the hashes have 53 bits, which
    holds beyond 10^12 rows.
    """
    every = F.sequence(F.lit(0), F.lit(trees - 1))
    chance = 2 * sample / max(1, n_rows)
    if chance >= 1:
        return every
    unit = lambda k: (F.shiftrightunsigned(F.xxhash64(key, k, F.lit(seed)), 11) + 1).cast("double") * 2.0**-53
    gap = lambda k: F.floor(F.log(unit(k)) / math.log1p(-chance)).cast("long")
    none = F.array().cast("array<int>")
    start = F.struct(gap(F.lit(-1)).alias("at"), none.alias("drawn"))
    step = lambda s, k: F.when(s["at"] < trees, F.struct((s["at"] + 1 + gap(k)).alias("at"), F.concat(s["drawn"], F.array(s["at"].cast("int"))).alias("drawn"))).otherwise(s)
    return F.when(gap(F.lit(-1)) < trees, F.aggregate(every, start, step, lambda s: s["drawn"])).otherwise(none)


def isolation_forest(rows: DataFrame, key: str, names: list[str], trees: int = 200, seed: int = 42, sample: int = SAMPLE) -> DataFrame:
    """key, isolation: 1 where the mean path of a row is shorter than chance would have it, by the trees that did not draw the row.

    A tree grows from ``sample`` rows, or from two thirds of a small table, so that every row is left out of some trees; trees and
    the drawn rows' keys, at most ``trees`` times ``sample``, travel to the rows. Missing values count as 0; keys are to be
    distinct. With fewer than LEAST_COHORT other rows isolation is null.
    """
    filled = rows.select(F.col(key).cast("string").alias("_key"), *(F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names))
    n_rows = filled.count()
    kind = rows.schema[key].dataType
    if n_rows <= config.LEAST_COHORT:
        return filled.select(F.col("_key").cast(kind).alias(key), F.lit(None).cast("double").alias("isolation"))
    size = min(sample, 2 * n_rows // 3)
    picks = filled.withColumn("tree", F.explode(drawing_trees(F.col("_key"), n_rows, trees, size, seed)))
    w = Window.partitionBy("tree").orderBy(F.xxhash64("_key", "tree"), "_key")
    drawn = written(picks.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= size), "drawn")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        x, t = pdf[names].to_numpy(), int(pdf.tree.iloc[0])
        rng, limit, out = np.random.default_rng(seed * 1_000_003 + t), math.ceil(math.log2(max(2, len(pdf)))), []

        def node(at: np.ndarray, depth: int) -> int:
            me = len(out)
            out.append(None)
            spread = np.flatnonzero(x[at].max(0) > x[at].min(0)) if len(at) > 1 else []
            if depth >= limit or not len(spread):
                out[me] = (t, me, -1, 0.0, -1, -1, depth + path_bound(len(at)))
                return me
            f = int(rng.choice(spread))
            cut = float(rng.uniform(x[at, f].min(), x[at, f].max()))
            left = x[at, f] < cut
            out[me] = (t, me, f, cut, node(at[left], depth + 1), node(at[~left], depth + 1), 0.0)
            return me

        node(np.arange(len(x)), 0)
        return pd.DataFrame(out, columns=["tree", "node", "f", "cut", "low", "high", "path"])

    grown_in_order = lambda pdf: grow(pdf.sort_values("_r"))
    forest = drawn.groupBy("tree").applyInPandas(grown_in_order, "tree int, node int, f int, cut double, low int, high int, path double").toPandas()  # at most 2 * sample nodes a tree
    grown = {t: g.sort_values("node")[["f", "cut", "low", "high", "path"]].to_numpy() for t, g in forest.groupby("tree")}
    chance = path_bound(size)

    def score(batches):
        for pdf in batches:
            x, total, n = pdf[names].to_numpy(), np.zeros(len(pdf)), np.zeros(len(pdf))
            inside = [set(d) if d is not None else set() for d in pdf["_drawn"]]
            for t, g in grown.items():
                out = np.array([t not in d for d in inside]) if len(inside) else np.zeros(0, bool)
                at = np.zeros(len(x), int)
                while (inner := g[at, 0] >= 0).any():
                    k = np.flatnonzero(inner)
                    go = x[k, g[at[k], 0].astype(int)] < g[at[k], 1]
                    at[k] = np.where(go, g[at[k], 2], g[at[k], 3]).astype(int)
                total += np.where(out, g[at, 4], 0.0)
                n += out
            s = 2 ** (-(total / np.maximum(1, n)) / max(chance, 1e-9))
            yield pd.DataFrame({key: pdf["_key"], "isolation": ((s > 0.5) & (n > 0)).astype(float)})

    members = drawn.groupBy("_key").agg(F.collect_list("tree").alias("_drawn"))  # at most trees * sample rows
    scored = filled.join(F.broadcast(members), "_key", "left").mapInPandas(score, f"{key} string, isolation double")
    return scored.withColumn(key, F.col(key).cast(kind))


def train_classifier(rows: DataFrame, names: list[str], label: str, trees: int = 20, seed: int = 42) -> PipelineModel:
    """Boosted trees with weights that balance the labels."""
    size = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    total = sum(size.values())
    weighted = rows.withColumn("_w", F.when(F.col(label) == 1, total / (2 * max(1, size.get(1, 0)))).otherwise(total / (2 * max(1, size.get(0, 0))))).withColumn("_y", F.col(label).cast("double"))
    filled = [f"_{n}" for n in names]
    stages = [Imputer(inputCols=names, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_x"), GBTClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", maxIter=trees, stepSize=0.1, seed=seed)]
    return Pipeline(stages=stages).fit(weighted)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    keep = rows.columns
    return model.transform(rows).select(*keep, vector_to_array("probability")[1].alias("probability"))


def split(rows: DataFrame, key: str, label: str, test: float = 0.25, seed: int = 42) -> DataFrame:
    """``rows`` with ``is_test``: exactly the share ``test`` (rounded to the nearest row) of each label's rows, those of the smallest digests of their keys."""
    order = [F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed))), F.col(key)]
    placed = running_totals(rows.withColumn("_one", F.lit(1)), order, ["_one"], (label,))
    return placed.withColumn("is_test", F.col("_one_before") < F.floor(F.col("_one_all") * test + 0.5)).select(*rows.columns, "is_test")


#: What a model's manifest has to name before its scores count (fixed values).
MANIFEST = ("model_version", "feature_semantics_version", "feature_schema_hash", "training_provenance", "metrics", "library_versions", "artifact_hashes")


def schema_hash(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()


def save_model(model: PipelineModel, path: str, names: list[str], manifest: dict) -> None:
    """Write a model and its manifest to the shared folder, the manifest last: without it the gate stays shut."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    full = {**manifest, "feature_schema_hash": schema_hash(names)}
    spark.createDataFrame([(json.dumps(full),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def gate(spark: SparkSession, path: str, names: list[str], enabled: bool) -> str | None:
    """Why a model may not score, or None: it is to be enabled, saved, have all fields of MANIFEST, and be of these features."""
    if not enabled:
        return "disabled_by_configuration"
    try:
        manifest = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/manifest").collect()))  # one line
    except (AnalysisException, ValueError):
        return "provenance_manifest_missing"
    missing = sorted(set(MANIFEST) - set(manifest))
    if missing:
        return f"provenance_manifest_incomplete: {', '.join(missing)}"
    return None if manifest["feature_schema_hash"] == schema_hash(names) else "feature_schema_differs"


def predict_supervised(rows: DataFrame, path: str, names: list[str], enabled: bool) -> DataFrame:
    """``rows`` with probability and unavailable_reason; probability is null for all while the gate is shut."""
    reason = gate(rows.sparkSession, path, names, enabled)
    if reason:
        return rows.withColumns({"probability": F.lit(None).cast("double"), "unavailable_reason": F.lit(reason)})
    return predict(PipelineModel.load(f"{path}/model"), rows).withColumn("unavailable_reason", F.lit(None).cast("string"))


def calibrate(fitted: DataFrame, rows: DataFrame, label: str, score: str = "probability") -> DataFrame:
    """``rows`` with ``calibrated``: isotonic or logistic, whichever has the smaller squared error on ``fitted``, whose scores and labels it is fitted to.

    The score itself, where ``fitted`` has fewer than ten rows or one label.
    """
    size = {r[label]: r["count"] for r in fitted.groupBy(label).count().collect()}
    if sum(size.values()) < 10 or len(size) < 2:
        return rows.withColumn("calibrated", F.col(score))
    vector = VectorAssembler(inputCols=[score], outputCol="_s")
    x = vector.transform(fitted.withColumn("_y", F.col(label).cast("double")))
    curve = IsotonicRegression(featuresCol=score, labelCol="_y", predictionCol="_iso").fit(x)
    line = LogisticRegression(featuresCol="_s", labelCol="_y", probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_pred").fit(x)
    both = lambda df: line.transform(curve.transform(df)).withColumn("_platt", vector_to_array("_p")[1])
    error = both(x).agg(*(F.avg(F.pow(F.col(c) - F.col("_y"), 2)).alias(c) for c in ("_iso", "_platt"))).first()
    best = "_iso" if error["_iso"] <= error["_platt"] else "_platt"
    return both(vector.transform(rows)).select(*rows.columns, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(best))).alias("calibrated"))


def pr_curve(rows: DataFrame, score: str, label: str) -> DataFrame:
    """score, precision, recall and the gain in recall at every distinct score, from counts per score."""
    by = running_totals(rows.groupBy(score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("y")), [F.desc(score)], ["n", "y"])
    n, y = F.col("n_before") + F.col("n"), F.col("y_before") + F.col("y")
    whole = F.nullif(F.col("y_all"), F.lit(0))
    return by.select(score, (y / n).alias("precision"), (y / whole).alias("recall"), (F.col("y") / whole).alias("gain"))


def eval_metrics(rows: DataFrame, score: str, label: str, calibrated: str | None = None) -> DataFrame:
    """PR-AUC, squared errors (raw, ``calibrated``, of the base rate), and recall and threshold at precisions .5, .7 and .9, in one row.

    The area is the sum over falling distinct scores of the gain in recall times the precision, so ties count as one step.
    """
    curve = pr_curve(rows, score, label)
    best = [f for p in (5, 7, 9) for f in (F.coalesce(F.max(F.when(F.col("precision") >= p / 10, F.col("recall"))), F.lit(0.0)).alias(f"recall_{p}"), F.min(F.when(F.col("precision") >= p / 10, F.col(score))).alias(f"threshold_{p}"))]
    at = curve.agg(F.coalesce(F.sum(F.col("precision") * F.col("gain")), F.lit(0.0)).alias("pr_auc"), *best)
    y = F.col(label).cast("double")
    error = lambda c: F.avg(F.pow(F.col(c) - y, 2))
    base = rows.agg(error(score).alias("brier"), error(calibrated or score).alias("brier_calibrated"), F.avg(y).alias("base_rate"), (F.avg(y) * (1 - F.avg(y))).alias("brier_base_rate"))
    return base.crossJoin(F.broadcast(at))  # one row each

"""Models that choose a transform and codec from a segment's features."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import encoding
from .profile import VECTOR, flatten, profile
from .series import SEGMENT, packed

LABELS = {"ranged": len(encoding.RANGED), "scale": len(encoding.SCALED), "del": len(encoding.DELTAS), "algo": len(encoding.CHOICE)}
SEED, TEST_SHARE = 42, 0.15


def segment_features(series: DataFrame, size: int = SEGMENT) -> DataFrame:
    """series_id, segment_id, features of whole segments, each profiled as a series of its own."""
    rows = series.withColumn("segment_id", F.floor(F.col("pos") / size))
    each = rows.select(F.to_json(F.struct("series_id", "segment_id")).alias("series_id"), (F.col("pos") % size).alias("pos"), "value")
    out = flatten(profile(each).where(F.col("n") == size))
    key = F.from_json("series_id", "series_id string, segment_id long")
    return out.select(key["series_id"].alias("series_id"), key["segment_id"].alias("segment_id"), "features")


def training_set(series: DataFrame, size: int = SEGMENT) -> DataFrame:
    """series_id, segment_id, features and the labels of the best combination, of whole segments."""
    best = encoding.best_combo(packed(series, size, keep_rest=False))
    return segment_features(series, size).join(best, ["series_id", "segment_id"]).select("series_id", "segment_id", "features", *LABELS)


def label_counts(training: DataFrame) -> DataFrame:
    """label, value, c."""
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("label"), F.col(name).cast("int").alias("value")) for name in LABELS])).alias("p")
    return training.select(pairs).groupBy("p.label", "p.value").agg(F.count(F.lit(1)).alias("c"))


def split(training: DataFrame, test_share: float = TEST_SHARE, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Train and test by a hash of the segment: the same split however the rows are partitioned."""
    draw = F.pmod(F.xxhash64(F.lit(seed), "series_id", "segment_id"), F.lit(10_000)) < test_share * 10_000
    return training.where(~draw), training.where(draw)


def _columns(training: DataFrame) -> DataFrame:
    return training.select("*", *[F.col("features")[k].alias(f"f{k}") for k in range(len(VECTOR))])


def _balanced(training: DataFrame, label: str) -> DataFrame:
    """weight: rows / (kinds * rows of the label)."""
    counts = training.groupBy(label).agg(F.count(F.lit(1)).alias("c"))
    total, kinds = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    return training.join(F.broadcast(counts), label).withColumn("weight", F.lit(float(total or 0)) / (kinds * F.col("c"))).drop("c")


def train_forest(training: DataFrame, label: str, trees: int = 200, depth: int = 15) -> PipelineModel:
    """Median imputing, scaling, and a random forest with balanced classes for one label."""
    names = [f"f{k}" for k in range(len(VECTOR))]
    stages = [
        Imputer(strategy="median", inputCols=names, outputCols=names),
        VectorAssembler(inputCols=names, outputCol="assembled"),
        StandardScaler(withMean=True, inputCol="assembled", outputCol="scaled"),
        RandomForestClassifier(labelCol=label, featuresCol="scaled", weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=2, featureSubsetStrategy="sqrt", seed=SEED, predictionCol=f"pred_{label}", rawPredictionCol=f"raw_{label}", probabilityCol=f"prob_{label}"),
    ]
    return Pipeline(stages=stages).fit(_balanced(_columns(training), label))


def train_network(training: DataFrame, label: str, layers: tuple[int, ...] = (256, 128, 64, 32), rounds: int = 500) -> PipelineModel:
    """Scaling and a multilayer perceptron for one label."""
    rows = training.withColumn("assembled", array_to_vector("features"))
    stages = [
        StandardScaler(withMean=True, inputCol="assembled", outputCol="scaled"),
        MultilayerPerceptronClassifier(labelCol=label, featuresCol="scaled", layers=[len(VECTOR), *layers, max(2, LABELS[label])], maxIter=rounds, seed=SEED, predictionCol=f"pred_{label}", rawPredictionCol=f"raw_{label}", probabilityCol=f"prob_{label}"),
    ]
    return Pipeline(stages=stages).fit(rows)


def predict(features: DataFrame, models: dict[str, PipelineModel]) -> DataFrame:
    """series_id, segment_id and a label a model, clipped to its table; labels without a model are 0."""
    rows = _columns(features).withColumn("assembled", array_to_vector("features"))
    out = None
    for label, model in models.items():
        # the network reads the assembled vector; the forest assembles it itself
        given = rows.drop("assembled") if any(isinstance(s, VectorAssembler) for s in model.stages) else rows
        told = model.transform(given)
        code = F.least(F.greatest(F.round(f"pred_{label}").cast("int"), F.lit(0)), F.lit(LABELS[label] - 1))
        told = told.select("series_id", "segment_id", code.alias(label))
        out = told if out is None else out.join(told, ["series_id", "segment_id"])
    out = features.select("series_id", "segment_id") if out is None else out
    return out.select("series_id", "segment_id", *[F.col(c) if c in models else F.lit(0).alias(c) for c in LABELS])


def evaluate(predicted: DataFrame, label: str) -> dict[str, float]:
    """accuracy, f1, weighted precision and recall, mse, mae, r2 of pred_<label> against <label>."""
    rows = predicted.select(F.col(label).cast("double").alias("label"), F.col(f"pred_{label}").cast("double").alias("prediction"))
    kinds = ["accuracy", "f1", "weightedPrecision", "weightedRecall"]
    out = {kind: MulticlassClassificationEvaluator(metricName=kind).evaluate(rows) for kind in kinds}
    gap = F.col("label") - F.col("prediction")
    mse, mae, var = rows.agg(F.avg(gap * gap), F.avg(F.abs(gap)), F.var_pop("label")).first()
    return out | {"mse": mse, "mae": mae, "r2": 1 - mse / var if var else 0.0}

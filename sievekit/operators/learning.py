"""Learners over feature arrays, by pyspark.ml, fitted to the rows of one split only."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.operators.forests import forest
from sievekit.operators.metrics import class_weights, detection, ranking
from sievekit.operators.resampling import ranked
from sievekit.operators.splitting import assign_splits
from sievekit.sources.shared import drop, stored


def as_vectors(df: DataFrame, features: str) -> DataFrame:
    return df.withColumn("vector", array_to_vector(F.col(features).cast("array<double>")))


def weighted(df: DataFrame, label: str) -> DataFrame:
    """Adds `weight`, which balances the classes."""
    return df.join(class_weights(df, label).select(F.col("class").alias(label), "weight"), label)


def fit_linear_svm(train: DataFrame, label: str) -> PipelineModel:
    """Scaled linear SVM over `vector` with balanced weights; its score is the margin."""
    scaler = StandardScaler(inputCol="vector", outputCol="scaled", withMean=True, withStd=True)
    svm = LinearSVC(featuresCol="scaled", labelCol=label, weightCol="weight", maxIter=50, regParam=1e-3)
    return Pipeline(stages=[scaler, svm]).fit(weighted(train, label))


def margins(model: PipelineModel, df: DataFrame) -> DataFrame:
    scored = model.transform(df)
    margin = vector_to_array("rawPrediction")[1]
    return scored.withColumns({"score": margin, "pred": (margin >= 0).cast("int")}).drop("vector", "scaled", "rawPrediction", "prediction")


def probe_importances(df: DataFrame, columns: list[str], label: str, trees: int = 300, seed: int = 42) -> DataFrame:
    """(feature, importance) of a random forest that tells the labels apart by metadata alone."""
    rows = stored(df.dropna(subset=[*columns, label]).select(*columns, label), "probe-rows")
    gains, _ = forest(rows, columns, label, trees, seed)
    drop(rows)
    return df.sparkSession.createDataFrame(list(zip(columns, map(float, gains))), "feature string, importance double")


def permuted(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """For each column, all rows with its values dealt anew: `permuted` names the column.

    A row takes the value of the row that has its rank when rows are ordered by
    another hash of the key, so each copy is a permutation that every run repeats.
    """
    rows = df.select(key, *[c for c in df.columns if c != key])
    by_key = ranked(rows.withColumn("__all", F.lit(1)).withColumn("__order", F.col(key).cast("string")), "__all", "__order").drop("__n")
    out = None
    for c in columns:
        other = ranked(rows.select(F.lit(1).alias("__all"), F.concat_ws(":", F.lit(c), F.col(key).cast("string")).alias("__order"), F.col(c).alias("__dealt")), "__all", "__order").select("__i", "__dealt")
        one = by_key.join(other, "__i").withColumn(c, F.col("__dealt")).select(*rows.columns, F.lit(c).alias("permuted"))
        out = one if out is None else out.unionByName(one)
    return out


def held_out_probe(df: DataFrame, columns: list[str], label: str, key: str, source: str, test: float = 0.2, trees: int = 300, seed: int = 42) -> DataFrame:
    """(kind, name, n, value): how well a random forest tells the labels 0 and 1 apart by metadata alone, on rows that it hasn't seen.

    kind metric: balanced accuracy and AUROC over n test rows; importance: the
    share of each column in the forest's splits; permutation: the balanced
    accuracy lost when the column's values are dealt anew among the test rows;
    source: each source's test rows and the part of them that is called 1. A real
    source with a high part is told apart by its form, not its content. Rows
    with a null label or feature don't count.
    """
    rows = df.dropna(subset=[*columns, label]).select(key, source, F.col(label).cast("int").alias(label), *[F.col(c).cast("double").alias(c) for c in columns])
    rows = stored(assign_splits(rows, key, label, test=test, val=0.0, seed=seed), "probe-rows")
    held = rows.where("split = 'test'").drop("split")
    whole = stored(held.withColumn("permuted", F.lit("")).unionByName(permuted(held, columns, key)), "probe-permuted")
    gains, scored = forest(rows.where("split = 'train'"), columns, label, trees, seed, whole)
    scored = scored.select(key, source, "permuted", F.col(label).alias("y_true"), F.col("chance").alias("score"), (F.col("chance") >= 0.5).cast("int").alias("pred"))
    scored = stored(scored, "probe-scores")
    plain = scored.where("permuted = ''")
    accuracy = detection(scored, by=["permuted"]).select("permuted", "n", "balanced_accuracy")
    own = accuracy.where("permuted = ''")
    made = {
        "metric": own.select(F.lit("balanced_accuracy").alias("name"), "n", F.col("balanced_accuracy").alias("value")),
        "auroc": ranking(plain).select(F.lit("auroc").alias("name"), (F.col("n_pos") + F.col("n_neg")).alias("n"), F.col("auroc").alias("value")),
        "permutation": accuracy.where("permuted <> ''").crossJoin(F.broadcast(own.select(F.col("balanced_accuracy").alias("whole")))).select(F.col("permuted").alias("name"), "n", (F.col("whole") - F.col("balanced_accuracy")).alias("value")),  # one row
        "source": plain.groupBy(F.col(source).cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("pred").cast("double")).alias("value")),
        "importance": df.sparkSession.createDataFrame(list(zip(columns, [0] * len(columns), map(float, gains))), "name string, n long, value double"),
    }
    out = None
    for kind, part in made.items():
        one = part.select(F.lit("metric" if kind == "auroc" else kind).alias("kind"), "name", F.col("n").cast("long"), F.col("value").cast("double"))
        out = one if out is None else out.unionByName(one)
    return out


def fit_components(train: DataFrame, want: int) -> PipelineModel:
    """Scaler and PCA over `vector`; the rank is at most rows - 1 and the dimension."""
    first = train.select("vector").first()
    rank = max(1, min(want, train.count() - 1, len(first.vector) if first else 1))
    return Pipeline(stages=[StandardScaler(inputCol="vector", outputCol="scaled", withMean=True, withStd=True), PCA(k=rank, inputCol="scaled", outputCol="components")]).fit(train)


def fit_channels(train: DataFrame, channels: dict[str, int]) -> dict[str, PipelineModel]:
    """A scaler and PCA of its own for each array column, with the wanted ranks, all fitted to the same rows."""
    return {c: fit_components(as_vectors(train, c), want) for c, want in channels.items()}


def fused(models: dict[str, PipelineModel], df: DataFrame, into: str = "components") -> DataFrame:
    """Adds the channels' components, one channel after the other, as one array."""
    for i, (column, model) in enumerate(models.items()):
        made = model.transform(as_vectors(df, column)).withColumn(f"__c{i}", vector_to_array("components"))
        df = made.drop("vector", "scaled", "components")
    parts = [f"__c{i}" for i in range(len(models))]
    return df.withColumn(into, F.concat(*parts)).drop(*parts)


def centroids(train: DataFrame, label: str, features: str) -> DataFrame:
    """(class, centroid): the mean of each component, as an array."""
    parts = train.select(F.col(label).alias("class"), F.posexplode(features).alias("i", "x")).groupBy("class", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy("class").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def nearest_centroid(df: DataFrame, heads: DataFrame, key: str, features: str) -> DataFrame:
    """Adds pred_class, confidence and entropy: a softmax over the products with the centroids; the first of equal classes wins.

    One array holds all classes' products, so a row is never multiplied.
    """
    # one row with as many entries as classes
    table = heads.agg(F.sort_array(F.collect_list(F.struct("class", "centroid"))).alias("heads"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
    rows = df.crossJoin(F.broadcast(table))
    rows = rows.withColumn("scores", F.transform("heads", lambda h: dot(F.col(features), h["centroid"]))).withColumn("classes", F.transform("heads", lambda h: h["class"])).drop("heads")
    rows = rows.withColumn("total", F.aggregate("scores", F.lit(0.0), lambda s, v: s + F.exp(v)))
    probabilities = F.transform("scores", lambda v: F.exp(v) / F.col("total"))
    best = F.array_position("scores", F.array_max("scores"))
    return rows.withColumns({"pred_class": F.get("classes", (best - 1).cast("int")), "probabilities": probabilities}).withColumn("confidence", F.array_max("probabilities")).drop("scores", "classes", "total")



"""Metrics as aggregates: detection, ranking, attribution, cascade, robustness, resampling.

Inputs may be of any size: ranking metrics first reduce rows to one for each
distinct score, and everything else is a grouped sum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_fake_label(label: Column) -> Column:
    """True for 'fake' in any case; null counts as not fake."""
    return F.coalesce(F.lower(label) == "fake", F.lit(False))


def is_fake_prediction(df: DataFrame, column: str) -> Column:
    """Reads a prediction column as a whole: numbers if any value is one (1 is fake), else names."""
    number = F.expr(f"try_cast(`{column}` as double)")
    numeric = df.agg(F.coalesce(F.max(number.isNotNull()), F.lit(False))).first()[0]
    return F.coalesce(number == 1, F.lit(False)) if numeric else is_fake_label(F.col(column).cast("string"))


def drop_errors(df: DataFrame, column: str) -> DataFrame:
    """Drops rows whose prediction is the error mark -1; nulls and text stay."""
    return df.where(~F.expr(f"try_cast(`{column}` as double)").eqNullSafe(F.lit(-1.0)))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def _count(condition: Column, weight: str | None = None) -> Column:
    return F.coalesce(F.sum(condition.cast("long") * F.col(weight) if weight else condition.cast("long")), F.lit(0))


def detection(df: DataFrame, truth: str = "y_true", prediction: str = "pred", by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """accuracy, balanced accuracy, precision, recall, macro F1 and n of 0/1 columns, for each group; with weight, rows count as often as it says."""
    t, p = F.col(truth) == 1, F.col(prediction) == 1
    counts = df.groupBy(*(by or [])).agg(*[_count(c, weight).alias(n) for n, c in (("tp", t & p), ("fp", ~t & p), ("tn", ~t & ~p), ("fn", t & ~p))])
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    f1_fake, f1_real = _share(2 * tp, 2 * tp + fp + fn), _share(2 * tn, 2 * tn + fp + fn)
    # macro F1 runs over the labels that occur in the truth or in the predictions
    has_fake, has_real = (tp + fp + fn > 0).cast("int"), (tn + fp + fn > 0).cast("int")
    pos, neg = (tp + fn > 0).cast("int"), (tn + fp > 0).cast("int")
    return counts.select(
        *(by or []),
        (tp + fp + tn + fn).alias("n"),
        *("tp", "fp", "tn", "fn"),
        _share(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        _share(_share(tp, tp + fn) * pos + _share(tn, tn + fp) * neg, pos + neg).alias("balanced_accuracy"),
        _share(tp, tp + fp).alias("precision"),
        _share(tp, tp + fn).alias("recall"),
        _share(f1_fake * has_fake + f1_real * has_real, has_fake + has_real).alias("macro_f1"),
    )


#: Ranges of scores that a sweep sums inside before it adds up the ranges.
RANGES = 256


def sweep(df: DataFrame, truth: str = "y_true", score: str = "score", by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """One row for each distinct score, descending: positives and negatives there, and running tp and fp.

    No task orders all scores of a group: distinct scores are dealt to RANGES
    ranges by approximate quantiles, running sums are taken inside a range, and
    the sums of the higher ranges, of which there are few, are added. With
    weight, rows count as often as it says.
    """
    by = by or []
    one = F.col(weight) if weight else F.lit(1)
    rows = df.where(F.col(score).isNotNull())
    positive = F.coalesce(F.col(truth) == 1, F.lit(False))
    sums = [F.sum(F.when(c, one).otherwise(0)).cast("long").alias(n) for n, c in (("p", positive), ("n", ~positive))]
    steps = rows.groupBy(*by, F.col(score).alias("score")).agg(*sums)
    cuts = steps.groupBy(*by).agg(F.percentile_approx("score", F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)]), F.lit(4 * RANGES)).alias("__cuts"))
    keyed = steps.join(cuts.select(*[F.col(c).alias(f"__{c}") for c in by], "__cuts"), [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]) if by else steps.crossJoin(F.broadcast(cuts))  # one row
    keyed = keyed.withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col("score")))).select(*by, "score", "p", "n", "__range")
    totals = keyed.groupBy(*by, "__range").agg(F.sum("p").alias("__p"), F.sum("n").alias("__n"))
    whole = Window.partitionBy(*by)
    above = whole.orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    # at most RANGES rows a group
    offsets = totals.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__range").alias("__r"), zero(F.sum("__p").over(above)).alias("__tp"), zero(F.sum("__n").over(above)).alias("__fp"), F.sum("__p").over(whole).alias("pos"), F.sum("__n").over(whole).alias("neg"))
    same = F.col("__range") == F.col("__r")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    inside = Window.partitionBy(*by, "__range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = keyed.select(*by, "score", "p", "n", "__range", F.sum("p").over(inside).alias("__rp"), F.sum("n").over(inside).alias("__rn"))
    return running.join(offsets, same).select(*by, "score", "p", "n", (F.col("__rp") + F.col("__tp")).alias("tp"), (F.col("__rn") + F.col("__fp")).alias("fp"), "pos", "neg")


def ranking(df: DataFrame, truth: str = "y_true", score: str = "score", by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """auroc (ties count half) and auprc (sum of recall steps times precision, no interpolation); null with one class only."""
    by = by or []
    rows = sweep(df, truth, score, by, weight)
    return rows.groupBy(*by).agg(
        F.when((F.max("pos") > 0) & (F.max("neg") > 0), F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2.0)) / F.max(F.col("pos") * F.col("neg"))).alias("auroc"),
        F.when((F.max("pos") > 0) & (F.max("neg") > 0), F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.max("pos")).alias("auprc"),
        F.max("pos").alias("n_pos"),
        F.max("neg").alias("n_neg"),
    )


def youden(df: DataFrame, truth: str = "y_true", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """The threshold with the largest tpr - fpr; of several, the highest."""
    by = by or []
    rows = sweep(df, truth, score, by).where("pos > 0 and neg > 0")
    gain = F.col("tp") / F.col("pos") - F.col("fp") / F.col("neg")
    best = rows.groupBy(*by).agg(F.max(F.struct(gain.alias("youden"), "score")).alias("best"))
    return best.where("best is not null").select(*by, F.col("best.score").alias("threshold"), F.col("best.youden").alias("youden"))


def confusion(df: DataFrame, truth: str = "true_class", prediction: str = "pred_class", labels: list | None = None) -> DataFrame:
    """(true, pred, n, share): cells that occur, with their share of the true class' row; pairs outside labels are dropped."""
    rows = df if labels is None else df.where(F.col(truth).isin(labels) & F.col(prediction).isin(labels))
    cells = rows.groupBy(F.col(truth).alias("true_class"), F.col(prediction).alias("pred_class")).agg(F.count(F.lit(1)).alias("n"))
    return cells.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("true_class")))


def per_class(df: DataFrame, truth: str = "true_class", prediction: str = "pred_class") -> DataFrame:
    """(class, support, predicted, hits, recall, precision, f1) of the classes that occur in the truth."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(prediction).alias("q")).agg(F.count(F.lit(1)).alias("n"))
    ends = cells.select(F.explode(F.array(F.struct(F.col("t").alias("class"), F.col("n").alias("s"), F.lit(0).cast("long").alias("q"), F.when(F.col("t") == F.col("q"), F.col("n")).otherwise(0).alias("h")), F.struct(F.col("q").alias("class"), F.lit(0).cast("long").alias("s"), F.col("n").alias("q"), F.lit(0).cast("long").alias("h")))).alias("e"))
    sums = ends.groupBy("e.class").agg(F.sum("e.s").alias("support"), F.sum("e.q").alias("predicted"), F.sum("e.h").alias("hits")).where("support > 0")
    return sums.select("class", "support", "predicted", "hits", (F.col("hits") / F.col("support")).alias("recall"), _share(F.col("hits"), F.col("predicted")).alias("precision"), _share(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"))


def attribution(df: DataFrame, truth: str = "true_class", prediction: str = "pred_class") -> DataFrame:
    """n, top-1, macro F1 over the classes of the truth and balanced accuracy; zeros for no rows."""
    return per_class(df, truth, prediction).agg(
        F.coalesce(F.sum("support"), F.lit(0)).alias("n"),
        F.coalesce(F.sum("hits") / F.sum("support"), F.lit(0.0)).alias("top1"),
        F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"),
        F.coalesce(F.avg("recall"), F.lit(0.0)).alias("balanced_accuracy"),
    )


def slice_fold(df: DataFrame, classes: list, truth: str = "true_class", prediction: str = "pred_class", other: str = "__other__") -> DataFrame:
    """Rows whose truth is in the slice; predictions outside it become one bucket, so they still count as errors."""
    inside = F.when(F.col(prediction).isin(classes), F.col(prediction).cast("string")).otherwise(other)
    return df.where(F.col(truth).isin(classes)).withColumn(prediction, inside).withColumn(truth, F.col(truth).cast("string"))


def comparison(methods: dict[str, tuple[DataFrame, list]], real: list, slices: dict[str, list] | None = None, external: dict[str, tuple[DataFrame, list | None]] | None = None) -> DataFrame:
    """One row for each method, each of its slices and each external detector: attribution, detection, and the classes that it was trained on.

    methods: name -> (rows of true_class and pred_class, classes). A slice's row is
    named method__slice; predictions outside the slice count as errors, and it
    has no detection. external: name -> (rows of y_true and pred, classes or
    None where unknown); a detector's accuracy stands for top-1. Rows compare
    fairly only where their classes are equal.
    """
    text = lambda classes: F.lit(None if classes is None else ",".join(map(str, classes))).cast("string")
    count = lambda classes: F.lit(None if classes is None else len(classes)).cast("long")
    nothing = F.lit(None).cast("double")
    out = None
    for name, (rows, classes) in methods.items():
        folded = rows.select((~F.col("true_class").isin(real)).cast("int").alias("y_true"), (~F.col("pred_class").isin(real)).cast("int").alias("pred"))
        judged = detection(folded).select(F.col("balanced_accuracy").alias("detection_balanced_accuracy"))
        parts = [attribution(rows).withColumn("method", F.lit(name)).crossJoin(F.broadcast(judged))]  # one row each
        parts += [attribution(slice_fold(rows, wanted)).withColumns({"method": F.lit(f"{name}__{s}"), "detection_balanced_accuracy": nothing}) for s, wanted in (slices or {}).items()]
        for part in parts:
            one = part.withColumns({"classes": text(classes), "n_classes": count(classes)})
            out = one if out is None else out.unionByName(one)
    for name, (rows, classes) in (external or {}).items():
        one = detection(rows).select("n", F.col("accuracy").alias("top1"), "macro_f1", "balanced_accuracy", F.lit(name).alias("method"), F.col("balanced_accuracy").alias("detection_balanced_accuracy"), text(classes).alias("classes"), count(classes).alias("n_classes"))
        out = one if out is None else out.unionByName(one)
    return out.select("method", "n", "top1", "macro_f1", "balanced_accuracy", "detection_balanced_accuracy", "classes", "n_classes")


def entropy(probabilities: Column) -> Column:
    """-sum p ln p, each p clipped to [1e-12, 1]."""
    clipped = F.transform(probabilities, lambda p: F.least(F.greatest(p, F.lit(1e-12)), F.lit(1.0)))
    return F.aggregate(clipped, F.lit(0.0), lambda a, p: a - p * F.ln(p))


def false_known_rates(confidence: Column, thresholds: tuple[float, ...] = (0.5, 0.7, 0.9)) -> list[Column]:
    return [F.coalesce(F.avg((confidence >= t).cast("double")), F.lit(0.0)).alias(f"fkr_{int(t * 100)}") for t in thresholds]


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """(bin, n, density) over [0, 1] in equal bins; 1 belongs to the last one."""
    where = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(value).between(0, 1)).groupBy(where.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # at most `bins` rows
    return counts.crossJoin(F.broadcast(total)).select("bin", "n", (F.col("n") * bins / F.col("total")).alias("density"))


def robustness(clean: DataFrame, perturbed: DataFrame, key: str, source: str) -> DataFrame:
    """Label flips, accuracies, their drop and the mean confidence drop of perturbed rows against their clean sources.

    clean: key, truth, pred, confidence; perturbed: source, pred, confidence.
    """
    both = clean.join(perturbed.select(F.col(source).alias(key), F.col("pred").alias("pred_pert"), F.col("confidence").alias("conf_pert")), key)
    right = (F.col("pred") == F.col("truth")).cast("double")
    right_pert = (F.col("pred_pert") == F.col("truth")).cast("double")
    flips = (~F.col("pred").cast("string").eqNullSafe(F.col("pred_pert").cast("string"))).cast("double")
    return both.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.avg(flips), F.lit(0.0)).alias("flip_rate"),
        F.coalesce(F.avg(right), F.lit(0.0)).alias("accuracy_clean"),
        F.coalesce(F.avg(right_pert), F.lit(0.0)).alias("accuracy_perturbed"),
        F.coalesce(F.avg(right) - F.avg(right_pert), F.lit(0.0)).alias("accuracy_drop"),
        F.coalesce(F.avg(F.col("confidence") - F.col("conf_pert")), F.lit(0.0)).alias("confidence_drop"),
    )


NOT_DETECTED = "__not_detected__"


def cascade(detector: DataFrame, attributor: DataFrame, key: str, known: list, real: str) -> DataFrame:
    """Two-stage rows: the attributor's class where the detector says fake, else NOT_DETECTED.

    detector: key, true_class, detected; attributor: key, pred_class. Both must
    hold each key once and the same keys; anything else raises.
    """
    for name, side in (("detector", detector), ("attributor", attributor)):
        if side.groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError(f"{name}: repeated keys")
    alone = detector.select(key, F.lit(1).alias("d")).join(attributor.select(key, F.lit(1).alias("a")), key, "full").where("d is null or a is null")
    if n := alone.count():
        raise ValueError(f"{n} keys are in one table only")
    rows = detector.join(attributor, key)
    fake = F.col("detected") == 1
    final = F.when(fake, F.col("pred_class").cast("string")).otherwise(NOT_DETECTED)
    truth = F.col("true_class").cast("string")
    return rows.select(
        key,
        "true_class",
        "pred_class",
        "detected",
        final.alias("pipeline_class"),
        truth.isin(known).alias("known_fake"),
        (~truth.isin(known) & (truth != real)).alias("out_of_set_fake"),
        (truth.isin(known) & (final == truth)).alias("end_to_end_correct"),
    )


def _log_factorial(n: Column) -> Column:
    """ln n! for whole n: Stirling's series from 16 on, the product below."""
    x = F.greatest(n, F.lit(16)).cast("double")
    series = (x + 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5)) - 1 / (1680 * F.pow(x, 7))
    small = F.element_at(F.array(*[F.lit(math.lgamma(k + 1)) for k in range(16)]), (F.least(n, F.lit(15)) + 1).cast("int"))
    return F.when(n >= 16, series).otherwise(small)


def mcnemar(n01: Column, n10: Column) -> Column:
    """Exact two-sided p: min(1, 2 * sum of C(n, i) / 2**n for i up to the smaller count); 1 without discordant rows.

    The sum goes down from its largest term, each next one by a ratio, and ends
    where a term can't change it any more: after some 20 square roots of n.
    """
    n, k = (n01 + n10).cast("long"), F.least(n01, n10).cast("long")
    first = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) - n * F.lit(math.log(2.0))
    terms = F.least(k, (F.sqrt(n.cast("double")) * 20 + 100).cast("long"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(state: Column, j: Column) -> Column:
        term = state["term"] * (k - j + 1) / (n - k + j)
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    total = F.aggregate(F.when(terms >= 1, F.sequence(F.lit(1).cast("long"), terms)).otherwise(F.array().cast("array<bigint>")), start, step, lambda s: s["total"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.exp(first) * total))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(class, n, weight): total / (classes * n)."""
    counts = df.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("class", "n", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))


def summary(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """mean, sample deviation (0 for one value), standard error, mean +- 1.96 errors, min, max and n; nulls don't count."""
    rows = df.groupBy(*(by or [])).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    error = F.col("std") / F.sqrt(F.col("n"))
    return rows.withColumns({"sem": error, "low": F.col("mean") - 1.96 * error, "high": F.col("mean") + 1.96 * error})

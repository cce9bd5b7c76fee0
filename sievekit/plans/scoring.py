"""Queries: detection, ranking, attribution, cascade, robustness and uncertainty.

Stand-ins: `labels.toxic` is the detector's truth, and scores are hash fractions
blended with it (rounded, so that ties occur); an embedding's class prediction
is its label for seven in ten vectors, else a hashed one. Both sides compute them
from the same digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievekit.functions.hashing import hash_fraction
from sievekit.operators import metrics, resampling, splitting
from sievekit.sources.tables import table

KNOWN = [0, 1, 2, 3, 4, 5]
REPS = 2000


def _rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def scored(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, lang, source, y_true, score, score_b, pred (-1: error), pred_b."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    labels = table(spark, d, "labels").select("doc_id", F.col("toxic").alias("y_true"))
    rows = docs.join(labels, "doc_id")
    h = lambda seed: hash_fraction(seed, F.col("doc_id"))
    rows = rows.withColumns({"score": F.round(h(1) * 0.6 + F.col("y_true") * h(2) * 0.4, 2), "score_b": F.round(h(3) * 0.7 + F.col("y_true") * h(4) * 0.3, 2)})
    error = h(5) < 0.02
    return rows.withColumns({"pred": F.when(error, -1).otherwise((F.col("score") >= 0.5).cast("int")), "pred_b": (F.col("score_b") >= 0.5).cast("int")})


def predicted(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, true_class, pred_class, confidence, and four probabilities that add up to one."""
    h = lambda seed: hash_fraction(seed, F.col("vec_id"))
    rows = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("true_class"), h(1).alias("h1"), h(2).alias("h2"), h(3).alias("h3"))
    conf = 0.3 + 0.7 * F.col("h3")
    return rows.select(
        "vec_id",
        "true_class",
        F.when(F.col("h1") < 0.7, F.col("true_class")).otherwise(F.floor(F.col("h2") * 10).cast("int")).alias("pred_class"),
        F.round(conf, 6).alias("confidence"),
        F.array(conf, *[(1 - conf) * w for w in (0.5, 0.3, 0.2)]).alias("probabilities"),
        F.when(F.col("vec_id") % 4 == 0, F.concat(F.lit("g"), F.col("vec_id") % 24)).otherwise(F.col("vec_id").cast("string")).alias("grp"),
    )


def detection_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.drop_errors(scored(spark, d), "pred")
    return _rounded(metrics.detection(rows, by=["lang"]))


def group_summary_sets(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.drop_errors(scored(spark, d), "pred")
    sums = rows.groupingSets([[], ["lang"], ["source"]], "lang", "source").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("y_true").alias("n_classes"),
        F.sum((F.col("pred") == F.col("y_true")).cast("long")).alias("n_correct"),
        F.avg(F.when(F.col("y_true") == 0, F.col("pred").cast("double"))).alias("fpr"),
        F.avg(F.when(F.col("y_true") == 1, 1.0 - F.col("pred"))).alias("miss_rate"),
    )
    return _rounded(sums)


def auroc_auprc_ties(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.ranking(scored(spark, d), by=["lang"]))


def youden_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.youden(scored(spark, d), by=["lang"]))


def operating_points(spark: SparkSession, d: str) -> DataFrame:
    """Balanced accuracy at 0.5, at the threshold that a validation part selects, and at the best one of the scored rows."""
    rows = splitting.assign_splits(scored(spark, d), "doc_id", "y_true", test=0.5, val=0.5, seed=7)
    chosen = metrics.youden(rows.where("split = 'val'")).select(F.lit("validation").alias("point"), "threshold")
    best = metrics.youden(rows.where("split = 'test'")).select(F.lit("oracle").alias("point"), "threshold")
    points = spark.createDataFrame([("fixed", 0.5)], "point string, threshold double").union(chosen).union(best)
    test = rows.where("split = 'test'").select("y_true", "score").crossJoin(F.broadcast(points))  # three points
    judged = test.withColumn("pred", (F.col("score") >= F.col("threshold")).cast("int"))
    return _rounded(metrics.detection(judged, by=["point", "threshold"])).select("point", "threshold", "n", "accuracy", "balanced_accuracy")


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.confusion(predicted(spark, d)))


def attribution_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.attribution(predicted(spark, d)))


def attribution_per_class(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.per_class(predicted(spark, d)))


def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.class_weights(predicted(spark, d), "true_class"))


def attribution_slice(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.attribution(metrics.slice_fold(predicted(spark, d), [1, 3, 5])))


def binary_fold(spark: SparkSession, d: str) -> DataFrame:
    """Classes 0 and 1 are real, all others fake."""
    rows = predicted(spark, d).select((F.col("true_class") > 1).cast("int").alias("y_true"), (F.col("pred_class") > 1).cast("int").alias("pred"))
    return _rounded(metrics.detection(rows))


def entropy_fkr(spark: SparkSession, d: str) -> DataFrame:
    rows = predicted(spark, d).withColumn("in_set", F.col("true_class").isin(KNOWN)).withColumn("entropy", metrics.entropy(F.col("probabilities")))
    return _rounded(rows.groupBy("in_set").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"), F.avg("entropy").alias("entropy"), *metrics.false_known_rates(F.col("confidence"))))


def confidence_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.histogram(predicted(spark, d), "confidence"))


def robustness_score(spark: SparkSession, d: str) -> DataFrame:
    rows = predicted(spark, d)
    clean = rows.select(F.col("vec_id").alias("path"), F.col("true_class").alias("truth"), F.col("pred_class").alias("pred"), "confidence")
    h = hash_fraction(9, F.col("vec_id"))
    perturbed = rows.select(F.col("vec_id").alias("source_path"), F.when(h < 0.8, F.col("pred_class")).otherwise(F.floor(h * 10).cast("int")).alias("pred"), F.round(F.col("confidence") * h, 6).alias("confidence"))
    return _rounded(metrics.robustness(clean, perturbed, "path", "source_path"))


def _cascade(spark: SparkSession, d: str) -> DataFrame:
    rows = predicted(spark, d)
    detected = (hash_fraction(11, F.col("vec_id")) < F.when(F.col("true_class") == 0, 0.2).otherwise(0.85)).cast("int")
    return metrics.cascade(rows.select("vec_id", "true_class", detected.alias("detected")), rows.select("vec_id", "pred_class"), "vec_id", [str(c) for c in KNOWN[1:]], "0")


def cascade(spark: SparkSession, d: str) -> DataFrame:
    rows = _cascade(spark, d).where("known_fake")
    hit = F.col("detected") == 1
    right = (F.col("pred_class") == F.col("true_class")).cast("double")
    return _rounded(
        rows.groupBy("true_class").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("detected").cast("double")).alias("detection_recall"), F.avg(F.when(hit, right)).alias("conditional_accuracy"), F.avg(F.col("end_to_end_correct").cast("double")).alias("end_to_end_recall"))
    )


def cascade_forced(spark: SparkSession, d: str) -> DataFrame:
    """What the pipeline makes of real samples and of fakes outside the known classes."""
    rows = _cascade(spark, d).where("not known_fake")
    return rows.groupBy("out_of_set_fake", "pipeline_class").agg(F.count(F.lit(1)).alias("n"))


def in_set_populations(spark: SparkSession, d: str) -> DataFrame:
    rows = predicted(spark, d)
    known = F.col("true_class").isin(KNOWN)
    names = F.array_compact(F.array(F.lit("all_in_scope"), F.when(F.col("true_class") > 0, F.lit("all_fakes")), F.when(known, F.lit("in_set")), F.when(~known, F.lit("out_of_set"))))
    many = rows.select(F.explode(names).alias("population"), "true_class", "pred_class", "confidence")
    right = (F.col("pred_class") == F.col("true_class")).cast("double")
    return _rounded(many.groupBy("population").agg(F.count(F.lit(1)).alias("n"), F.avg(right).alias("top1"), F.avg("confidence").alias("confidence")))


def _recalls(reps: DataFrame) -> DataFrame:
    per = reps.groupBy("rep", "true_class").agg(resampling.share(F.col("hit")).alias("recall"))
    return per.groupBy("rep").agg(F.avg("recall").alias("balanced_accuracy"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return predicted(spark, d).select("vec_id", "true_class", "grp", (F.col("pred_class") == F.col("true_class")).alias("hit"))


def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    reps = resampling.replicates(_hits(spark, d), F.col("vec_id"), ["true_class", "hit"], REPS)
    return _rounded(resampling.interval(_recalls(reps), "balanced_accuracy"))


def bootstrap_class_ci(spark: SparkSession, d: str) -> DataFrame:
    reps = resampling.replicates(_hits(spark, d), F.col("vec_id"), ["true_class", "hit"], REPS)
    per = reps.groupBy("true_class", "rep").agg(resampling.share(F.col("hit")).alias("recall"))
    return _rounded(resampling.interval(per, "recall", ["true_class"]))


def bootstrap_cluster_ci(spark: SparkSession, d: str) -> DataFrame:
    reps = resampling.replicates(_hits(spark, d), F.col("grp"), ["true_class", "hit"], REPS)
    return _rounded(resampling.interval(_recalls(reps), "balanced_accuracy"))


def _supports(per: DataFrame, size: Column) -> DataFrame:
    """Smallest and largest number of units that a replicate draws: one number, where draws keep the classes' sizes."""
    return per.groupBy("rep").agg(F.sum(size).alias("n")).agg(F.min("n").alias("least_drawn"), F.max("n").alias("most_drawn"))  # one row


def bootstrap_stratified_ci(spark: SparkSession, d: str) -> DataFrame:
    """Balanced accuracy over draws that keep the size of each class."""
    reps = resampling.multinomial_cells(_hits(spark, d), "true_class", ["hit"], REPS)
    return _rounded(resampling.interval(_recalls(reps), "balanced_accuracy")).crossJoin(F.broadcast(_supports(reps, F.col("n"))))


def bootstrap_stratified_cluster_ci(spark: SparkSession, d: str) -> DataFrame:
    """The same over groups, of which each class draws as many as it has; groups with equal hits and sizes are one cell."""
    groups = _hits(spark, d).groupBy("true_class", "grp").agg(F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("size"))
    reps = resampling.multinomial_cells(groups, "true_class", ["hits", "size"], REPS)
    per = reps.groupBy("rep", "true_class").agg((F.sum(F.col("n") * F.col("hits")) / F.sum(F.col("n") * F.col("size"))).alias("recall"))
    balanced = per.groupBy("rep").agg(F.avg("recall").alias("balanced_accuracy"))
    return _rounded(resampling.interval(balanced, "balanced_accuracy")).crossJoin(F.broadcast(_supports(reps, F.col("n"))))


def continuous(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, y_true and two scores that aren't rounded, so that hardly any are tied."""
    labels = table(spark, d, "labels").select("doc_id", F.col("toxic").alias("y_true"))
    h = lambda seed: hash_fraction(seed, F.col("doc_id"))
    return labels.withColumns({"score": h(1) * 0.6 + F.col("y_true") * h(2) * 0.4, "score_b": h(3) * 0.7 + F.col("y_true") * h(4) * 0.3})


def auroc_ci(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the AUROC of continuous scores."""
    return _rounded(resampling.interval(resampling.auroc_replicates(continuous(spark, d), "doc_id", "y_true", "score", REPS), "auroc"))


def paired_auroc_continuous(spark: SparkSession, d: str) -> DataFrame:
    """Difference of the AUROCs of two continuous scores over shared draws, with a two-sided p."""
    rows = continuous(spark, d)
    a, b = (resampling.auroc_replicates(rows, "doc_id", "y_true", s, REPS).withColumnRenamed("auroc", s) for s in ("score", "score_b"))
    return _difference(a.join(b, "rep").select((F.col("score") - F.col("score_b")).alias("d")))


def bootstrap_detection_ci(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of the detector's accuracy, macro F1, AUROC and AUPRC."""
    rows = metrics.drop_errors(scored(spark, d), "pred")
    reps = resampling.replicates(rows, F.col("doc_id"), ["y_true", "pred", "score"], REPS)
    both = metrics.detection(reps, by=["rep"], weight="n").select("rep", "accuracy", "macro_f1").join(metrics.ranking(reps, by=["rep"], weight="n").select("rep", "auroc", "auprc"), "rep")
    return _rounded(resampling.interval(both.unpivot(["rep"], ["accuracy", "macro_f1", "auroc", "auprc"], "metric", "value"), "value", ["metric"]))


def bootstrap_group_ci(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of the detection rate of each language's fakes."""
    fakes = metrics.drop_errors(scored(spark, d), "pred").where("y_true = 1")
    reps = resampling.replicates(fakes, F.col("doc_id"), ["lang", "pred"], REPS)
    per = reps.groupBy("lang", "rep").agg(resampling.share(F.col("pred") == 1).alias("rate"))
    return _rounded(resampling.interval(per, "rate", ["lang"]))


def _paired(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.drop_errors(scored(spark, d), "pred")
    return rows.select("doc_id", "lang", "y_true", (F.col("pred") == F.col("y_true")).alias("a"), (F.col("pred_b") == F.col("y_true")).alias("b"))


def mcnemar(spark: SparkSession, d: str) -> DataFrame:
    rows = _paired(spark, d).groupBy("lang").agg(F.sum((F.col("a") & ~F.col("b")).cast("long")).alias("n10"), F.sum((~F.col("a") & F.col("b")).cast("long")).alias("n01"))
    return rows.select("lang", "n10", "n01", F.round(metrics.mcnemar(F.col("n01"), F.col("n10")), 9).alias("p"))


def _difference(diff: DataFrame) -> DataFrame:
    """Mean, interval and two-sided p of d."""
    diff = diff.withColumn("d", F.round("d", 12))
    down, up = F.avg((F.col("d") <= 0).cast("double")), F.avg((F.col("d") >= 0).cast("double"))
    return _rounded(diff.agg(F.avg("d").alias("mean"), F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"), F.least(F.lit(1.0), 2 * F.least(down, up)).alias("p")))


def paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Difference of the two models' balanced accuracies over shared draws, with a two-sided p."""
    reps = resampling.replicates(_paired(spark, d), F.col("doc_id"), ["y_true", "a", "b"], REPS)
    per = reps.groupBy("rep", "y_true").agg((resampling.share(F.col("a")) - resampling.share(F.col("b"))).alias("d"))
    return _difference(per.groupBy("rep").agg(F.avg("d").alias("d")))


def paired_auroc(spark: SparkSession, d: str) -> DataFrame:
    """Difference of the two models' AUROCs over shared draws, with a two-sided p."""
    rows = metrics.drop_errors(scored(spark, d), "pred")
    reps = resampling.replicates(rows, F.col("doc_id"), ["y_true", "score", "score_b"], REPS)
    both = reps.select("rep", "y_true", "n", F.explode(F.array(F.struct(F.lit(1).alias("sign"), "score"), F.struct(F.lit(-1).alias("sign"), F.col("score_b").alias("score")))).alias("m")).select("rep", "y_true", "n", "m.sign", "m.score")
    each = metrics.ranking(both, by=["rep", "sign"], weight="n").where("auroc is not null")
    return _difference(each.groupBy("rep").agg(F.sum(F.col("sign") * F.col("auroc")).alias("d")))


def method_comparison(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.drop_errors(scored(spark, d), "pred")
    first = metrics.detection(rows).withColumn("method", F.lit("a"))
    second = metrics.detection(rows, prediction="pred_b").withColumn("method", F.lit("b"))
    return _rounded(first.unionByName(second)).select("method", "n", "accuracy", "balanced_accuracy", "macro_f1")


def attribution_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Two attributors with the slice of odd classes, and a detector from outside whose classes aren't known; class 0 is real."""
    a = predicted(spark, d).select("vec_id", "true_class", "pred_class")
    h = lambda seed: hash_fraction(seed, F.col("vec_id"))
    b = a.withColumn("pred_class", F.when(h(21) < 0.6, F.col("true_class")).otherwise(F.floor(h(22) * len(KNOWN)).cast("int")))
    detected = (h(11) < F.when(F.col("true_class") == 0, 0.2).otherwise(0.85)).cast("int")
    outside = a.select((F.col("true_class") > 0).cast("int").alias("y_true"), detected.alias("pred"))
    return _rounded(metrics.comparison({"a": (a, list(range(10))), "b": (b, KNOWN)}, [0], {"odd": [1, 3, 5]}, {"outside": (outside, None)}))


def report_rollup(spark: SparkSession, d: str) -> DataFrame:
    """One row for each method and metric, ordered inside the metric by value."""
    rows = method_comparison(spark, d).unpivot(["method"], ["accuracy", "balanced_accuracy", "macro_f1"], "metric", "value")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("value"), "method")).cast("long"))


def seed_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Test accuracy of each language over five seeds of the split, summarised."""
    many = splitting.multi_seed(metrics.drop_errors(scored(spark, d), "pred"), [1, 2, 3, 4, 5], key="doc_id", stratum="lang")
    right = (F.col("pred") == F.col("y_true")).cast("double")
    per = many.where("split = 'test'").groupBy("lang", "seed").agg(F.avg(right).alias("accuracy"))
    return _rounded(metrics.summary(per, "accuracy", ["lang"]))


QUERIES = {
    f.__name__: f
    for f in (
        detection_metrics,
        group_summary_sets,
        auroc_auprc_ties,
        youden_threshold,
        operating_points,
        confusion_matrix,
        attribution_metrics,
        attribution_per_class,
        class_weights,
        attribution_slice,
        binary_fold,
        entropy_fkr,
        confidence_histogram,
        robustness_score,
        cascade,
        cascade_forced,
        in_set_populations,
        bootstrap_ci,
        bootstrap_class_ci,
        bootstrap_cluster_ci,
        bootstrap_stratified_ci,
        bootstrap_stratified_cluster_ci,
        auroc_ci,
        paired_auroc_continuous,
        bootstrap_detection_ci,
        bootstrap_group_ci,
        mcnemar,
        paired_bootstrap,
        paired_auroc,
        method_comparison,
        attribution_comparison,
        report_rollup,
        seed_sweep,
    )
}


def _h(seed: int, key: str) -> str:
    return f"(cast('0x' || substr(sha256('{seed}:' || cast({key} as varchar)), 1, 16) as ubigint)::double / 18446744073709551616.0::double)"


_S = f"""
sc as (select d.doc_id, lang, source, toxic y_true, round({_h(1, 'd.doc_id')} * 0.6::double + toxic * {_h(2, 'd.doc_id')} * 0.4::double, 2) score,
  round({_h(3, 'd.doc_id')} * 0.7::double + toxic * {_h(4, 'd.doc_id')} * 0.3::double, 2) score_b, {_h(5, 'd.doc_id')} < 0.02::double bad
  from documents d join labels l on l.doc_id = d.doc_id),
s0 as (select *, case when bad then -1 else (score >= 0.5)::int end pred, (score_b >= 0.5)::int pred_b from sc), s1 as (select * from s0 where pred <> -1)"""
_P = f"""
p0 as (select vec_id, label true_class, {_h(1, 'vec_id')} h1, {_h(2, 'vec_id')} h2, 0.3::double + 0.7::double * {_h(3, 'vec_id')} conf from embeddings),
p as (select vec_id, true_class, case when h1 < 0.7 then true_class else floor(h2 * 10)::int end pred_class, round(conf, 6) confidence, conf,
  case when vec_id % 4 = 0 then 'g' || (vec_id % 24) else cast(vec_id as varchar) end grp from p0)"""


def _detection(rows: str, by: str, pred: str = "pred") -> str:
    """A select of the detection metrics over rows."""
    group = f"group by {by}" if by else ""
    head = f"{by}, " if by else ""
    return f"""
select {head}tp + fp + tn + fn n, tp, fp, tn, fn, round((tp + tn)::double / (tp + fp + tn + fn), 9) accuracy,
  round((case when tp + fn > 0 then tp::double / (tp + fn) else 0 end + case when tn + fp > 0 then tn::double / (tn + fp) else 0 end) / ((tp + fn > 0)::int + (tn + fp > 0)::int), 9) balanced_accuracy,
  round(case when tp + fp > 0 then tp::double / (tp + fp) else 0 end, 9) as precision, round(case when tp + fn > 0 then tp::double / (tp + fn) else 0 end, 9) recall,
  round((case when tp + fp + fn > 0 then 2.0::double * tp / (2 * tp + fp + fn) else 0 end + case when tn + fp + fn > 0 then 2.0::double * tn / (2 * tn + fp + fn) else 0 end) / ((tp + fp + fn > 0)::int + (tn + fp + fn > 0)::int), 9) macro_f1
from (select {head}sum((y_true = 1 and {pred} = 1)::bigint)::bigint tp, sum((y_true <> 1 and {pred} = 1)::bigint)::bigint fp, sum((y_true <> 1 and {pred} <> 1)::bigint)::bigint tn, sum((y_true = 1 and {pred} <> 1)::bigint)::bigint fn from {rows} {group})"""


_SWEEP = """
st as (select {by}score, sum((y_true = 1)::int)::bigint p, sum((y_true <> 1)::int)::bigint n from {rows} group by {by}score),
sw as (select *, sum(p) over ({part} order by score desc rows unbounded preceding)::bigint tp, sum(n) over ({part} order by score desc rows unbounded preceding)::bigint fp, sum(p) over ({part})::bigint pos, sum(n) over ({part})::bigint neg from st)"""
_BY_LANG = _SWEEP.format(by="lang, ", part="partition by lang", rows="s0")


def _per_class(rows: str) -> str:
    return f"""
c as (select k as class, sum(s)::bigint support, sum(q)::bigint predicted, sum(h)::bigint hits from (
  select true_class k, 1 s, 0 q, (true_class = pred_class)::int h from {rows} union all select pred_class, 0, 1, 0 from {rows}) group by k having sum(s) > 0),
m as (select *, hits::double / support recall, case when predicted > 0 then hits::double / predicted else 0 end as precision, 2.0::double * hits / (support + predicted) f1 from c)"""


_ATTRIBUTION = "select coalesce(sum(support), 0)::bigint n, round(coalesce(sum(hits)::double / sum(support), 0), 9) top1, round(coalesce(avg(f1), 0), 9) macro_f1, round(coalesce(avg(recall), 0), 9) balanced_accuracy from m"


def _draws(rows: str, key: str, cells: str) -> str:
    weight = " + ".join(f"(d >= '{limit}')::int" for limit in resampling.poisson_limits())
    return f"""
bh as (select {cells}, block, sha256(block || ':' || {key}) h from {rows}, range({REPS // resampling.DRAWS}) t(block)),
bd as (select {cells}, {resampling.DRAWS} * block + unnest([0, 1, 2, 3]) rep, unnest([substr(h, 1, 16), substr(h, 17, 16), substr(h, 33, 16), substr(h, 49, 16)]) d from bh),
bs as (select {cells}, rep, sum({weight})::bigint n from bd group by all having sum({weight}) > 0)"""


_BALANCED = "ba as (select rep, avg(recall) v from (select rep, true_class, sum(case when hit then n else 0 end)::double / sum(n) recall from bs group by rep, true_class) group by rep)"
_HITS = f"{_P}, ph as (select *, pred_class = true_class hit from p)"
_AREAS = """
st as (select {by}, score, sum(case when y_true = 1 then n else 0 end)::bigint p, sum(case when y_true <> 1 then n else 0 end)::bigint q from {rows} group by {by}, score),
sw as (select *, sum(p) over (partition by {by} order by score desc rows unbounded preceding)::bigint tp, sum(q) over (partition by {by} order by score desc rows unbounded preceding)::bigint fp, sum(p) over (partition by {by})::bigint pos, sum(q) over (partition by {by})::bigint neg from st),
ar as (select {by}, sum(q * (tp - p / 2.0::double)) / max(pos * neg) auroc, sum(p * tp::double / (tp + fp)) / max(pos) auprc from sw where pos > 0 and neg > 0 group by {by})"""
_DIFFERENCE = "select round(avg(v), 9) mean, round(quantile_cont(v, 0.025), 9) low, round(quantile_cont(v, 0.975), 9) high, round(least(1, 2 * least(avg((v <= 0)::int::double), avg((v >= 0)::int::double))), 9) p from df"
_INTERVAL = "round(avg(v), 9) mean, round(stddev_samp(v), 9) std, round(quantile_cont(v, 0.025), 9) low, round(quantile_cont(v, 0.975), 9) high, count(v) n_reps"
_C = f"""{_P}, c0 as (select *, ({_h(11, 'vec_id')} < case when true_class = 0 then 0.2 else 0.85 end)::int detected, true_class in (1, 2, 3, 4, 5) known_fake from p),
c1 as (select *, case when detected = 1 then cast(pred_class as varchar) else '__not_detected__' end pipeline_class, not known_fake and true_class <> 0 out_of_set_fake from c0)"""
_PAIRED = f"{_S}, pr as (select doc_id, lang, y_true, pred = y_true a, pred_b = y_true b from s1)"
_METHODS = f"""{_S}, mc as (select 'a' as method, n, accuracy, balanced_accuracy, macro_f1 from ({_detection('s1', '')}) union all select 'b', n, accuracy, balanced_accuracy, macro_f1 from ({_detection('s1', '', 'pred_b')}))"""
_T = f"""{_S}, o1 as (select *, substr(sha256('7:' || doc_id), 1, 16) k from s0),
o2 as (select *, row_number() over (partition by y_true order by k, doc_id) r, count(*) over (partition by y_true) c from o1),
o3 as (select *, case when r <= round_even(c * 0.5::double, 0) then 'test' when r <= 2 * round_even(c * 0.5::double, 0) then 'val' else 'train' end split from o2)"""


def _best(split: str) -> str:
    sweep = _SWEEP.format(by="", part="", rows=f"(select * from o3 where split = '{split}')")
    return f"(with {sweep} select score threshold from sw where pos > 0 and neg > 0 order by tp::double / pos - fp::double / neg desc, score desc limit 1)"


def _multinomial(rows: str, stratum: str, cells: str, levels: int) -> str:
    """CTEs that end in mn(rep, stratum, cells, n): draws that keep the size of each stratum, for up to 2**levels cells of one."""
    ctes = [
        f"lv as (select {stratum}, {cells}, count(*)::bigint sz, row_number() over (partition by {stratum} order by {cells}) - 1 place from {rows} group by {stratum}, {cells})",
        f"d0 as (select {stratum}, rep, 0::bigint node, sum(sz)::bigint n from lv, range({REPS}) t(rep) group by {stratum}, rep)",
    ]
    for level in range(levels):
        height = levels - level
        ctes.append(f"""
n{level} as (select {stratum}, place >> {height} node, sum(sz)::double al, sum(case when (place >> {height - 1}) % 2 = 0 then sz else 0 end)::double lf from lv group by 1, 2),
e{level} as (select {stratum}, rep, node, n, lf / al p, cast('0x' || substr(sha256(rep || ':' || {stratum} || ':{height}:' || node), 1, 13) as bigint)::double / 4503599627370496.0::double u from d{level} join n{level} using ({stratum}, node)),
j{level} as (select *, unnest(range(0, n)) j from e{level} where p < 1),
f{level} as (select {stratum}, rep, node, u, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(p) + (n - j) * ln(1 - p))) over (partition by {stratum}, rep, node order by j) cdf from j{level}),
k{level} as (select {stratum}, rep, node, count(*) k from f{level} where cdf <= u group by all),
b{level} as (select {stratum}, rep, node, n, case when p >= 1 then n else coalesce(k, 0) end k from e{level} left join k{level} using ({stratum}, rep, node)),
d{level + 1} as (select {stratum}, rep, 2 * node node, k::bigint n from b{level} where k > 0 union all select {stratum}, rep, 2 * node + 1, (n - k)::bigint from b{level} where n > k)""")
    return ", ".join(ctes) + f", mn as (select rep, lv.*, d.n from d{levels} d join lv on lv.{stratum} = d.{stratum} and lv.place = d.node)"


_SUPPORTS = "sp as (select min(n) least_drawn, max(n) most_drawn from (select rep, sum(n)::bigint n from mn group by rep))"
_CONTINUOUS = f"sc as (select doc_id, toxic y_true, {_h(1, 'doc_id')} * 0.6::double + toxic * {_h(2, 'doc_id')} * 0.4::double score, {_h(3, 'doc_id')} * 0.7::double + toxic * {_h(4, 'doc_id')} * 0.3::double score_b from labels)"

def _attributed(rows: str, name: str, classes: str, n: int) -> str:
    """Selects of a method's row and of that of its slice."""
    folded = f"(select (true_class > 0)::int y_true, (pred_class > 0)::int pred from {rows})"
    part = f"(select true_class::varchar true_class, case when pred_class in (1, 3, 5) then pred_class::varchar else '__other__' end pred_class from {rows} where true_class in (1, 3, 5))"
    return f"""select '{name}' as method, n, top1, macro_f1, balanced_accuracy, (select balanced_accuracy from ({_detection(folded, '')})) detection_balanced_accuracy, '{classes}' classes, {n}::bigint n_classes from (with {_per_class(rows)} {_ATTRIBUTION})
union all select '{name}__odd', n, top1, macro_f1, balanced_accuracy, null, '{classes}', {n}::bigint from (with {_per_class(part)} {_ATTRIBUTION})"""


ORACLES = {
    "attribution_comparison": f"""with {_P}, pb as (select true_class, case when {_h(21, 'vec_id')} < 0.6 then true_class else floor({_h(22, 'vec_id')} * 6)::int end pred_class from p),
po as (select (true_class > 0)::int y_true, ({_h(11, 'vec_id')} < case when true_class = 0 then 0.2 else 0.85 end)::int pred from p)
{_attributed('p', 'a', '0,1,2,3,4,5,6,7,8,9', 10)} union all {_attributed('pb', 'b', '0,1,2,3,4,5', 6)}
union all select 'outside', n, accuracy, macro_f1, balanced_accuracy, balanced_accuracy, null, null from ({_detection('po', '')})""",
    "bootstrap_stratified_ci": f"with {_HITS}, {_multinomial('ph', 'true_class', 'hit', 1)}, {_SUPPORTS}, {_BALANCED.replace('from bs', 'from mn')} select * from (select {_INTERVAL} from ba), sp",
    "bootstrap_stratified_cluster_ci": f"""with {_HITS}, gr as (select true_class, grp, sum(hit::int)::bigint hits, count(*)::bigint size from ph group by true_class, grp), {_multinomial('gr', 'true_class', 'hits, size', 5)}, {_SUPPORTS},
ba as (select rep, avg(recall) v from (select rep, true_class, sum(n * hits)::double / sum(n * size) recall from mn group by rep, true_class) group by rep) select * from (select {_INTERVAL} from ba), sp""",
    "auroc_ci": f"with {_CONTINUOUS}, {_draws('sc', 'doc_id', 'y_true, score')}, {_AREAS.format(by='rep', rows='bs')}, u as (select auroc v from ar) select {_INTERVAL} from u",
    "paired_auroc_continuous": f"""with {_CONTINUOUS}, {_draws('sc', 'doc_id', 'y_true, score, score_b')}, ms as (select rep, 1 sign, y_true, score, n from bs union all select rep, -1, y_true, score_b, n from bs),
{_AREAS.format(by='rep, sign', rows='ms')}, df as (select rep, round(sum(sign * auroc), 12) v from ar group by rep having count(*) = 2) {_DIFFERENCE}""",
    "detection_metrics": f"with {_S} {_detection('s1', 'lang')}",
    "group_summary_sets": f"with {_S} select lang, source, count(*) n, count(distinct y_true) n_classes, sum((pred = y_true)::int)::bigint n_correct, round(avg(case when y_true = 0 then pred::double end), 9) fpr, round(avg(case when y_true = 1 then 1.0::double - pred end), 9) miss_rate from s1 group by grouping sets ((), (lang), (source))",
    "auroc_auprc_ties": f"with {_S}, {_BY_LANG} select lang, case when max(pos) > 0 and max(neg) > 0 then round(sum(n * (tp - p / 2.0::double)) / max(pos * neg), 9) end auroc, case when max(pos) > 0 and max(neg) > 0 then round(sum(p * tp::double / (tp + fp)) / max(pos), 9) end auprc, max(pos) n_pos, max(neg) n_neg from sw group by lang",
    "youden_threshold": f"with {_S}, {_BY_LANG}, g as (select *, tp::double / pos - fp::double / neg youden from sw where pos > 0 and neg > 0), o as (select *, row_number() over (partition by lang order by youden desc, score desc) r from g) select lang, score threshold, round(youden, 9) youden from o where r = 1",
    "operating_points": f"with {_T}, pt as (select 'fixed' point, 0.5::double threshold union all select 'validation', threshold from {_best('val')} union all select 'oracle', threshold from {_best('test')}), j as (select point, threshold, y_true, (score >= threshold)::int pred from o3, pt where split = 'test') select point, threshold, n, accuracy, balanced_accuracy from ({_detection('j', 'point, threshold')})",
    "confusion_matrix": f"with {_P} select true_class, pred_class, count(*) n, round(count(*)::double / sum(count(*)) over (partition by true_class), 9) share from p group by true_class, pred_class",
    "attribution_metrics": f"with {_P}, {_per_class('p')} {_ATTRIBUTION}",
    "attribution_per_class": f"with {_P}, {_per_class('p')} select class, support, predicted, hits, round(recall, 9) recall, round(precision, 9) as precision, round(f1, 9) f1 from m",
    "class_weights": f"with {_P}, k as (select true_class as class, count(*) n from p group by true_class) select class, n, round((select sum(n) from k)::double / ((select count(*) from k) * n), 9) weight from k",
    "attribution_slice": f"with {_P}, sl as (select cast(true_class as varchar) true_class, case when pred_class in (1, 3, 5) then cast(pred_class as varchar) else '__other__' end pred_class from p where true_class in (1, 3, 5)), {_per_class('sl')} {_ATTRIBUTION}",
    "binary_fold": f"with {_P}, b as (select (true_class > 1)::int y_true, (pred_class > 1)::int pred from p) {_detection('b', '')}",
    "entropy_fkr": f"with {_P}, e as (select *, true_class in (0, 1, 2, 3, 4, 5) in_set, -(conf * ln(conf) + list_sum(list_transform([0.5::double, 0.3::double, 0.2::double], lambda w: (1 - conf) * w * ln(greatest((1 - conf) * w, 1e-12::double))))) entropy from p) select in_set, count(*) n, round(avg(confidence), 9) confidence, round(avg(entropy), 9) entropy, round(avg((confidence >= 0.5)::int::double), 9) fkr_50, round(avg((confidence >= 0.7)::int::double), 9) fkr_70, round(avg((confidence >= 0.9)::int::double), 9) fkr_90 from e group by in_set",
    "confidence_histogram": f"with {_P} select least(floor(confidence * 20), 19)::int bin, count(*) n, round(count(*) * 20.0::double / sum(count(*)) over (), 9) density from p where confidence between 0 and 1 group by 1",
    "robustness_score": f"with {_P}, r as (select true_class, pred_class, confidence, case when {_h(9, 'vec_id')} < 0.8 then pred_class else floor({_h(9, 'vec_id')} * 10)::int end pp, round(confidence * {_h(9, 'vec_id')}, 6) cp from p) select count(*) n, round(avg((pred_class <> pp)::int::double), 9) flip_rate, round(avg((pred_class = true_class)::int::double), 9) accuracy_clean, round(avg((pp = true_class)::int::double), 9) accuracy_perturbed, round(avg((pred_class = true_class)::int::double) - avg((pp = true_class)::int::double), 9) accuracy_drop, round(avg(confidence - cp), 9) confidence_drop from r",
    "cascade": f"with {_C} select true_class, count(*) n, round(avg(detected::double), 9) detection_recall, round(avg(case when detected = 1 then (pred_class = true_class)::int::double end), 9) conditional_accuracy, round(avg((pipeline_class = cast(true_class as varchar))::int::double), 9) end_to_end_recall from c1 where known_fake group by true_class",
    "cascade_forced": f"with {_C} select out_of_set_fake, pipeline_class, count(*) n from c1 where not known_fake group by 1, 2",
    "in_set_populations": f"with {_P}, q as (select unnest(list_filter(['all_in_scope', case when true_class > 0 then 'all_fakes' end, case when true_class in (0, 1, 2, 3, 4, 5) then 'in_set' else 'out_of_set' end], lambda x: x is not null)) population, true_class, pred_class, confidence from p) select population, count(*) n, round(avg((pred_class = true_class)::int::double), 9) top1, round(avg(confidence), 9) confidence from q group by population",
    "bootstrap_ci": f"with {_HITS}, {_draws('ph', 'vec_id', 'true_class, hit')}, {_BALANCED} select {_INTERVAL} from ba",
    "bootstrap_class_ci": f"with {_HITS}, {_draws('ph', 'vec_id', 'true_class, hit')}, ba as (select true_class, rep, sum(case when hit then n else 0 end)::double / sum(n) v from bs group by true_class, rep) select true_class, {_INTERVAL} from ba group by true_class",
    "bootstrap_cluster_ci": f"with {_HITS}, {_draws('ph', 'grp', 'true_class, hit')}, {_BALANCED} select {_INTERVAL} from ba",
    "bootstrap_detection_ci": f"""with {_S}, {_draws('s1', 'doc_id', 'y_true, pred, score')}, {_AREAS.format(by='rep', rows='bs')},
k as (select rep, sum(case when y_true = 1 and pred = 1 then n else 0 end) tp, sum(case when y_true <> 1 and pred = 1 then n else 0 end) fp, sum(case when y_true <> 1 and pred <> 1 then n else 0 end) tn, sum(case when y_true = 1 and pred <> 1 then n else 0 end) fn from bs group by rep),
u as (select 'accuracy' metric, (tp + tn)::double / (tp + fp + tn + fn) v from k
  union all select 'macro_f1', (case when tp + fp + fn > 0 then 2.0::double * tp / (2 * tp + fp + fn) else 0 end + case when tn + fp + fn > 0 then 2.0::double * tn / (2 * tn + fp + fn) else 0 end) / ((tp + fp + fn > 0)::int + (tn + fp + fn > 0)::int) from k
  union all select 'auroc', auroc from ar union all select 'auprc', auprc from ar)
select metric, {_INTERVAL} from u group by metric""",
    "bootstrap_group_ci": f"with {_S}, sf as (select * from s1 where y_true = 1), {_draws('sf', 'doc_id', 'lang, pred')}, ba as (select lang, rep, sum(case when pred = 1 then n else 0 end)::double / sum(n) v from bs group by lang, rep) select lang, {_INTERVAL} from ba group by lang",
    "mcnemar": f"""with {_PAIRED}, k as (select lang, sum((a and not b)::int)::bigint n10, sum((not a and b)::int)::bigint n01 from pr group by lang),
t as (select lang, n10, n01, unnest(range(0, least(n10, n01) + 1)) i from k), g as (select lang, n10, n01, sum(exp(lgamma(n10 + n01 + 1) - lgamma(i + 1) - lgamma(n10 + n01 - i + 1) - (n10 + n01) * ln(2))) s from t group by lang, n10, n01)
select lang, n10, n01, round(case when n10 + n01 = 0 then 1 else least(1, 2 * s) end, 9) p from g""",
    "paired_bootstrap": f"with {_PAIRED}, {_draws('pr', 'doc_id', 'y_true, a, b')}, df as (select rep, round(avg(d), 12) v from (select rep, y_true, sum(case when a then n else 0 end)::double / sum(n) - sum(case when b then n else 0 end)::double / sum(n) d from bs group by rep, y_true) group by rep) {_DIFFERENCE}",
    "paired_auroc": f"""with {_S}, {_draws('s1', 'doc_id', 'y_true, score, score_b')}, bm as (select rep, y_true, n, unnest([1, -1]) sign, unnest([score, score_b]) score from bs),
{_AREAS.format(by='rep, sign', rows='bm')}, df as (select rep, round(sum(sign * auroc), 12) v from ar group by rep) {_DIFFERENCE}""",
    "method_comparison": f"with {_METHODS} select * from mc",
    "report_rollup": f"with {_METHODS}, u as (select method, 'accuracy' metric, accuracy as value from mc union all select method, 'balanced_accuracy', balanced_accuracy from mc union all select method, 'macro_f1', macro_f1 from mc) select method, metric, value, row_number() over (partition by metric order by value desc, method) place from u",
    "seed_sweep": f"""with {_S}, w as (select s1.*, seed, substr(sha256(seed || ':' || doc_id), 1, 16) k from s1, range(1, 6) t(seed)),
r as (select *, row_number() over (partition by lang, seed order by k, doc_id) r, count(*) over (partition by lang, seed) c from w),
a as (select lang, seed, avg((pred = y_true)::int::double) v from r where r <= round_even(c * 0.2::double, 0) group by lang, seed),
z as (select lang, count(v) n, avg(v) mean, coalesce(stddev_samp(v), 0) std, min(v) lo, max(v) hi from a group by lang)
select lang, n, round(mean, 9) mean, round(std, 9) std, round(lo, 9) min, round(hi, 9) max, round(std / sqrt(n), 9) sem, round(mean - 1.96::double * (std / sqrt(n)), 9) low, round(mean + 1.96::double * (std / sqrt(n)), 9) high from z""",
}

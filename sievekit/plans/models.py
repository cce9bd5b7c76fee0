"""Queries: learners and numeric kernels over embeddings and document metadata."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.functions import kernels
from sievekit.operators import heads, learning, margins, splitting
from sievekit.plans.splits import _hex
from sievekit.sources.tables import table


def _split(spark: SparkSession, d: str) -> DataFrame:
    return splitting.assign_splits(table(spark, d, "embeddings"), "vec_id", "label")


def centroid_head(spark: SparkSession, d: str) -> DataFrame:
    rows = _split(spark, d)
    heads = learning.centroids(rows.where("split = 'train'"), "label", "embedding")
    got = learning.nearest_centroid(rows, heads, "vec_id", "embedding")
    return got.select("vec_id", "label", "split", "pred_class", F.round("confidence", 6).alias("confidence"))


def linear_svm(spark: SparkSession, d: str) -> DataFrame:
    """Margins of the test rows under the squared-hinge classifier of the training rows, with balanced costs."""
    rows = _split(spark, d).withColumn("y_true", (F.col("label") >= 5).cast("int"))
    model = margins.fit_squared_hinge(rows.where("split = 'train'"), "y_true", "embedding")
    scored = rows.where("split = 'test'").select("vec_id", "y_true", model.margin("embedding").alias("score"))
    return scored.withColumn("pred", (F.col("score") >= 0).cast("int"))


def _metadata(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", F.ln(F.greatest(F.length("text"), F.lit(1))).alias("log_size"), F.size(F.split("text", "\n")).cast("double").alias("lines"), F.regexp_count("text", F.lit("[0-9]")).cast("double").alias("digits"))
    return docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


def rf_probe(spark: SparkSession, d: str) -> DataFrame:
    return learning.probe_importances(_metadata(spark, d), ["log_size", "lines", "digits"], "quality")


def metadata_probe(spark: SparkSession, d: str) -> DataFrame:
    """What a forest over the form of documents says of rows that it hasn't seen."""
    return learning.held_out_probe(_metadata(spark, d), ["log_size", "lines", "digits"], "quality", "doc_id", "source", trees=100)


def pca_train_only(spark: SparkSession, d: str) -> DataFrame:
    rows = learning.as_vectors(_split(spark, d), "embedding")
    model = learning.fit_components(rows.where("split = 'train'"), 16)
    return model.transform(rows).select("vec_id", "split", learning.vector_to_array("components").alias("components"))


def pca_two_channels(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprint and cosine channels, each scaled and projected by what the training rows show."""
    rows = _split(spark, d).withColumns({"print": kernels.over_array(lambda g: kernels.fingerprint(g, 8), 8, 8, F.col("embedding")), "cosine": kernels.over_array(kernels.log_dct, 8, 8, F.col("embedding"))})
    models = learning.fit_channels(rows.where("split = 'train'"), {"print": 16, "cosine": 8})
    return learning.fused(models, rows).select("vec_id", "split", "components")


#: Classes that the heads don't see, so that their rows are forced into others.
UNSEEN = [8, 9]


def mlp_head(spark: SparkSession, d: str) -> DataFrame:
    """A head fitted to eight classes scores the test rows of all ten."""
    rows = _split(spark, d)
    known = rows.where(~F.col("label").isin(UNSEEN))
    head = heads.fit_head(known.where("split = 'train'"), known.where("split = 'val'"), "label", "embedding", rounds=10, rate=3e-3)
    test = rows.where("split = 'test'").select("vec_id", "label", "embedding")
    return heads.scored(test, head, "embedding").select("vec_id", "label", (~F.col("label").isin(UNSEEN)).alias("in_set"), "pred_class", "confidence", "entropy")


def fingerprint_head(spark: SparkSession, d: str) -> DataFrame:
    """A head over fused fingerprint and cosine components."""
    rows = pca_two_channels(spark, d).join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id").where(~F.col("label").isin(UNSEEN))
    head = heads.fit_head(rows.where("split = 'train'"), rows.where("split = 'val'"), "label", "components", rounds=10, rate=3e-3)
    return heads.scored(rows.where("split = 'test'"), head, "components").select("vec_id", "label", "pred_class", "confidence")


def _long(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each value, rounded; places count from 0."""
    return rows.select(*keys, F.posexplode("values").alias("place", "value")).withColumn("value", F.round("value", 6))


def _kernel(kernel):
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = table(spark, d, "embeddings").select("vec_id", kernels.over_array(kernel, 8, 8, F.col("embedding")).alias("values"))
        return _long(rows, "vec_id")

    return query


def _fan_out(spark: SparkSession, d: str, named: dict, name: str) -> DataFrame:
    """All named kernels of each image from one scan; images without a readable array give no rows."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("source_path"), F.explode(kernels.each_over_array(named, 8, 8, F.col("embedding"))).alias("made"))
    return rows.where("made.values is not null").select(F.concat_ws("/", "made.name", "source_path").alias("full_path"), "source_path", F.col("made.name").alias(name), F.col("made.values").alias("values"))


def variant_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """Three normalised variants of each image and their lineage."""
    return _long(_fan_out(spark, d, kernels.VARIANTS, "variant"), "full_path", "source_path", "variant")


def perturbation_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """Eight perturbations of each image and their lineage."""
    return _long(_fan_out(spark, d, kernels.PERTURBATIONS, "perturbation"), "full_path", "source_path", "perturbation")


def _fingerprint(mode: str):
    return _kernel(lambda g: kernels.fingerprint(g, 8, mode))


QUERIES = {
    "centroid_head": centroid_head,
    "linear_svm": linear_svm,
    "rf_probe": rf_probe,
    "metadata_probe": metadata_probe,
    "pca_train_only": pca_train_only,
    "pca_two_channels": pca_two_channels,
    "mlp_head": mlp_head,
    "fingerprint_head": fingerprint_head,
    "dct2": _kernel(kernels.log_dct),
    "fft_spectrum": _kernel(kernels.spectrum),
    "srm_response": _kernel(lambda g: kernels.high_pass_response(g, extremes=True)),
    "fingerprint_vector": _fingerprint("both"),
    "fingerprint_residual": _fingerprint("residual"),
    "fingerprint_spectrum": _fingerprint("spectrum"),
    "tile_energy": _kernel(kernels.tile_energy),
    "variant_fan_out": variant_fan_out,
    "perturbation_fan_out": perturbation_fan_out,
}

# In SQL, an image is a table of pixels (y, x, v); all sums are written out from the definitions.
_IMAGE = "im as (select vec_id, unnest(range(0, 64)) // 8 y, unnest(range(0, 64)) % 8 x, unnest(embedding)::double v from embeddings)"
_EIGHT = "e as (select unnest(range(0, 8)) i)"


def _cosine(k: str, x: str, n: int) -> str:
    return f"(cos(pi() * (2 * {x} + 1) * {k} / {2 * n}.0::double) * case when {k} = 0 then sqrt({1 / n}::double) else sqrt({2 / n}::double) end)"


def _cubic(old: int, new: int) -> str:
    """A select of (i, j, w): the weight of old pixel j in new pixel i."""
    wide = max(old / new, 1.0)
    return f"""(select i, j, w / sum(w) over (partition by i) w from (select i, j, case when t < 1 then 1.5::double * t * t * t - 2.5::double * t * t + 1 when t < 2 then -0.5::double * t * t * t + 2.5::double * t * t - 4 * t + 2 else 0::double end w
  from (select i, j, abs((j + 0.5::double - (i + 0.5::double) * {old / new}::double) / {wide}::double) t from range(0, {new}) a(i), range(0, {old}) b(j))))"""


def _resized(rows: str, old: int, new: int) -> str:
    """rows (vec_id, y, x, v), square, at another size."""
    return f"""(select h.vec_id, r.i y, h.x, sum(r.w * h.v) v from {_cubic(old, new)} r join (select p.vec_id, p.y, c.i x, sum(c.w * p.v) v from {_cubic(old, new)} c join {rows} p on p.x = c.j group by 1, 2, 3) h on h.y = r.j group by 1, 2, 3)"""


def _blurred(rows: str, sigma: float) -> str:
    r = max(1, int(4 * sigma + 0.5))
    weight = f"(select d, exp(-d * d / {2 * sigma * sigma}::double) / sum(exp(-d * d / {2 * sigma * sigma}::double)) over () w from range({-r}, {r + 1}) t(d))"
    return f"""(select a.vec_id, a.y, a.x, sum(g.w * k.w * b.v) v from {rows} a cross join {weight} g cross join {weight} k join {rows} b on b.vec_id = a.vec_id and b.y = least(greatest(a.y + g.d, 0), 7) and b.x = least(greatest(a.x + k.d, 0), 7) group by 1, 2, 3)"""


_RESIDUAL = f"(select a.vec_id, a.y, a.x, a.v - b.v v from im a join {_blurred('im', 1.0)} b using (vec_id, y, x))"
_SPECTRUM = f"""(select vec_id, (k + 4) % 8 y, (l + 4) % 8 x, ln(1 + sqrt(re * re + ie * ie)) v from (
  select vec_id, f.i k, g.i l, sum(v * cos(2 * pi() * (f.i * y + g.i * x) / 8)) re, sum(v * sin(2 * pi() * (f.i * y + g.i * x) / 8)) ie from im, e f, e g group by 1, 2, 3))"""


def _fingerprint_sql(parts: list[str]) -> str:
    both = " union all ".join(f"select vec_id, {64 * k} + 8 * y + x place, v from {part}" for k, part in enumerate(parts))
    return f"with {_IMAGE}, {_EIGHT}, b as ({both}) select vec_id, place::integer place, round(v / greatest(sqrt(sum(v * v) over (partition by vec_id)), 1e-12::double), 6) as value from b"


def _jpeg(quality: int) -> str:
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    steps = ", ".join(f"({k // 8}, {k % 8}, {s}::double)" for k, s in enumerate(kernels.JPEG_LUMINANCE.ravel()))
    return f"""(with q as (select u, w, least(greatest(floor((s * {scale}::double + 50) / 100), 1), 255) s from (values {steps}) t(u, w, s)),
  g as (select vec_id, y, x, floor(least(greatest((v + 1) / 2, 0), 1) * 255 + 0.5000001::double) - 128 v from im),
  c as (select vec_id, f.i u, h.i w, sum({_cosine("f.i", "y", 8)} * {_cosine("h.i", "x", 8)} * v) v from g, e f, e h group by 1, 2, 3),
  z as (select vec_id, c.u, c.w, floor(v / s + 0.5000001::double) * s v from c join q on q.u = c.u and q.w = c.w)
  select vec_id, f.i y, h.i x, -1 + least(greatest(floor(sum({_cosine("u", "f.i", 8)} * {_cosine("w", "h.i", 8)} * v) + 128.5000001::double), 0), 255) / 255 * 2 v from z, e f, e h group by 1, 2, 3)"""


def _fan_out_sql(made: dict[str, str], name: str) -> str:
    parts = " union all ".join(f"select '{k}/' || vec_id full_path, vec_id source_path, '{k}' as {name}, (8 * y + x)::integer place, round(v, 6) as value from {rows}" for k, rows in made.items())
    return f"with {_IMAGE}, {_EIGHT} {parts}"


_BANK = ", ".join(f"({n}, {y - 2}, {x - 2}, {w}::double)" for n, k in enumerate(kernels.high_pass_bank()) for (y, x), w in np.ndenumerate(k) if w)
_PAIRS = ", ".join(f"({30 + 2 * n}, {i}, {j})" for n, (i, j) in enumerate(kernels.EXTREMES))
_TEST, _VAL = "round_even(n * 0.2::double, 0)", "round_even(n * 0.1::double, 0)"
ORACLES = {
    "dct2": f"""with {_IMAGE}, {_EIGHT}, c as (select vec_id, f.i k, g.i l, sum({_cosine('f.i', 'y', 8)} * {_cosine('g.i', 'x', 8)} * v) v from im, e f, e g group by 1, 2, 3)
select vec_id, (8 * k + l)::integer place, round(ln(abs(v) + 1e-8::double), 6) as value from c""",
    "fft_spectrum": f"with {_IMAGE}, {_EIGHT} select vec_id, (8 * y + x)::integer place, round(v, 6) as value from {_SPECTRUM}",
    "fingerprint_vector": _fingerprint_sql([_resized(_RESIDUAL, 8, 8), _resized(_SPECTRUM, 8, 8)]),
    "fingerprint_residual": _fingerprint_sql([_resized(_RESIDUAL, 8, 8)]),
    "fingerprint_spectrum": _fingerprint_sql([_resized(_SPECTRUM, 8, 8)]),
    "tile_energy": f"""with {_IMAGE}, {_EIGHT}, t as (select vec_id, y // 2 ty, x // 2 tx, sum(v * case when y % 2 = 0 and x % 2 = 0 then 1 else 0 end) a, sum(v * case when y % 2 = 0 and x % 2 = 1 then 1 else 0 end) b, sum(v * case when y % 2 = 1 and x % 2 = 0 then 1 else 0 end) c, sum(v * case when y % 2 = 1 and x % 2 = 1 then 1 else 0 end) d
  from {_resized('im', 8, 16)} group by 1, 2, 3)
select vec_id, (8 * ty + tx)::integer place, round((abs(a - b + c - d) + abs(a + b - c - d) + abs(a - b - c + d)) / 6, 6) as value from t""",
    "srm_response": f"""with {_IMAGE}, r as (select a.vec_id, a.y, a.x, n, sum(w * b.v) v from im a cross join (values {_BANK}) t(n, dy, dx, w) join im b on b.vec_id = a.vec_id and b.y = least(greatest(a.y + dy, 0), 7) and b.x = least(greatest(a.x + dx, 0), 7) group by 1, 2, 3, 4),
m as (select vec_id, n, v from r union all select a.vec_id, unnest([p.n, p.n + 1]), unnest([least(a.v, b.v), greatest(a.v, b.v)]) from (values {_PAIRS}) p(n, i, j) join r a on a.n = p.i join r b on b.n = p.j and b.vec_id = a.vec_id and b.y = a.y and b.x = a.x)
select vec_id, n::integer place, round(avg(abs(v)), 6) as value from m group by 1, 2""",
    "variant_fan_out": _fan_out_sql({"scaled": _resized("im", 8, 8), "cropped": "im", "aspect": _resized("im", 8, 8)}, "variant"),
    "perturbation_fan_out": _fan_out_sql(
        {
            **{f"jpeg{q}": _jpeg(q) for q in (30, 50, 70)},
            "blur1": _blurred("im", 1.0),
            "blur2": _blurred("im", 2.0),
            "resize75": _resized(_resized("im", 8, 6), 6, 8),
            "resize50": _resized(_resized("im", 8, 4), 4, 8),
            "sharpen": f"(select a.vec_id, a.y, a.x, 2 * a.v - b.v v from im a join {_blurred('im', 1.0)} b using (vec_id, y, x))",
        },
        "perturbation",
    ),
    "centroid_head": f"""
with h as (select vec_id, label, embedding, {_hex("'42'", "cast(vec_id as varchar)")} k from embeddings),
r as (select *, row_number() over (partition by label order by k, vec_id) r, count(*) over (partition by label) n from h),
s as (select *, case when r <= {_TEST} then 'test' when r <= {_TEST} + {_VAL} then 'val' else 'train' end split from r),
x as (select vec_id, label, split, unnest(range(1, len(embedding) + 1)) i, unnest(embedding)::double v from s),
c as (select label as class, i, avg(v) m from x where split = 'train' group by label, i),
d as (select x.vec_id, x.label, x.split, class, sum(v * m) score from x join c on c.i = x.i group by x.vec_id, x.label, x.split, class),
e as (select *, row_number() over (partition by vec_id order by score desc, class) best, exp(score) / sum(exp(score)) over (partition by vec_id) p from d)
select vec_id, label, split, class as pred_class, round(p, 6) confidence from e where best = 1""",
}

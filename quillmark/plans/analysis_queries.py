"""Contrasts, curves, memberships and smaller operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import hashing as fh
from quillmark.functions import scalars as fs
from quillmark.operators import analysis, metrics, sampling
from quillmark.plans.metric_queries import _AUC
from quillmark.plans.registry import query, rounded
from quillmark.plans.views import branch, grid, manifest, table

SEED = fh.SEED
_ARMS = ", long AS (SELECT is_distorted, source, label, 'a' AS arm, a AS s FROM branch UNION ALL SELECT is_distorted, source, label, 'b', b FROM branch UNION ALL SELECT is_distorted, source, label, 'c', c FROM branch)"


@query("R06_telescoping_contrast", _ARMS + ", u AS (" + _AUC.format("source, arm", "long", "label", "s") + ") SELECT source, round(max(CASE WHEN arm='a' THEN auc END)-max(CASE WHEN arm='c' THEN auc END),9) AS t, round(max(CASE WHEN arm='a' THEN auc END)-max(CASE WHEN arm='b' THEN auc END),9) AS v, round(max(CASE WHEN arm='b' THEN auc END)-max(CASE WHEN arm='c' THEN auc END),9) AS e FROM u GROUP BY 1")
def _(spark, sf):
    u = analysis.arm_aucs(branch(spark, sf), ["a", "b", "c"], ["source"])
    out = [analysis.contrast(u, ["source"], t, n) for t, n in (({"a": 1.0, "c": -1.0}, "t"), ({"a": 1.0, "b": -1.0}, "v"), ({"b": 1.0, "c": -1.0}, "e"))]
    return rounded(out[0].join(out[1], "source").join(out[2], "source"), "t", "v", "e")


@query("R03_R04_factorial_effects", """, cells AS (SELECT CAST(k>=2 AS INTEGER) AS f, CAST(image_idx%2 AS INTEGER) AS g, avg(score) AS v FROM grid GROUP BY 1,2), w AS (SELECT max(CASE WHEN f=0 AND g=0 THEN v END) AS v00, max(CASE WHEN f=0 AND g=1 THEN v END) AS v01, max(CASE WHEN f=1 AND g=0 THEN v END) AS v10, max(CASE WHEN f=1 AND g=1 THEN v END) AS v11 FROM cells)
  SELECT round((v10+v11-v00-v01)*5e-1,9) AS effect_f, round((v01+v11-v00-v10)*5e-1,9) AS effect_g, round(v11-v10-v01+v00,9) AS interaction FROM w""")  # fmt: skip
def _(spark, sf):
    cells = grid(spark, sf).groupBy((F.col("k") >= 2).cast("int").alias("f"), (F.col("image_idx") % 2).cast("int").alias("g")).agg(F.avg("score").alias("v"))
    return rounded(analysis.factorial_effects(cells, "f", "g", "v"), "effect_f", "effect_g", "interaction")


@query("R02_level_shape", """, c AS (SELECT source, k, round(avg(CASE WHEN label=1 THEN score END)-avg(CASE WHEN label=0 THEN score END)-3e-1,6) AS v FROM grid GROUP BY 1,2), d AS (SELECT *, v-lag(v) OVER (PARTITION BY source ORDER BY k) AS d FROM c)
  SELECT source, coalesce(min(d)>=0, TRUE) AS non_decreasing, min(v)<0 AND max(v)>0 AS changes_sign FROM d GROUP BY 1""")  # fmt: skip
def _(spark, sf):
    gap = F.avg(F.when(F.col("label") == 1, F.col("score"))) - F.avg(F.when(F.col("label") == 0, F.col("score"))) - F.lit(0.3)
    curve = grid(spark, sf).groupBy("source", "k").agg(F.round(gap, 6).alias("v"))
    return analysis.level_shape(curve, ["source"], "k", "v")


@query("R09_A41_retained_share", "SELECT source, round(avg(CASE WHEN is_distorted=1 THEN a END)/nullif(avg(CASE WHEN is_distorted=0 THEN a END),0),9) AS q FROM branch GROUP BY 1")
def _(spark, sf):
    means = branch(spark, sf).groupBy("source").agg(F.avg(F.when(F.col("is_distorted") == 1, F.col("a"))).alias("x"), F.avg(F.when(F.col("is_distorted") == 0, F.col("a"))).alias("y"))
    return means.select("source", F.round(analysis.retained_share(F.col("x"), F.col("y")), 9).alias("q"))


@query("R11_reproduction", "SELECT CAST(count_if(row_id%100<>0) AS BIGINT) AS matched, CAST(count_if(row_id%100=0) AS BIGINT) AS unmatched, 0e0 AS max_diff FROM branch")
def _(spark, sf):
    b = branch(spark, sf)
    return analysis.reproduction(b, b.filter("row_id % 100 <> 0"), "path", "a")


@query("R14_best_arm", _ARMS + ", u AS (SELECT arm, round(auc,9) AS auc FROM (" + _AUC.format("arm", "long", "label", "s") + ")) SELECT arm, auc FROM u ORDER BY auc DESC, arm LIMIT 1")
def _(spark, sf):
    u = rounded(analysis.arm_aucs(branch(spark, sf), ["a", "b", "c"], []), "auc").withColumn("o", F.ascii("arm"))
    return analysis.best_arm(u, "arm", "auc", "o")


@query("R12_size_bucket", "SELECT row_id, CASE WHEN least(width,height) BETWEEN 100 AND 299 THEN '100-299' WHEN least(width,height) BETWEEN 300 AND 599 THEN '300-599' END AS bucket FROM manifest")
def _(spark, sf):
    return manifest(spark, sf).select("row_id", fs.disjoint_bucket(F.least("width", "height"), [(100, 299), (300, 599)]).alias("bucket"))


@query("R17_label_by_distortion", "SELECT label, CAST(count_if(is_distorted=0) AS BIGINT) AS clean, CAST(count_if(is_distorted=1) AS BIGINT) AS distorted FROM manifest GROUP BY 1")
def _(spark, sf):
    return manifest(spark, sf).groupBy("label").agg(F.count_if(F.col("is_distorted") == 0).alias("clean"), F.count_if(F.col("is_distorted") == 1).alias("distorted"))


@query("A40_R15_seed_verdict", """SELECT condition, round(avg(d),9) AS mean_diff, CAST(count_if(lo>0) AS BIGINT) AS ci_above, avg(d)>2e-1 AND count_if(lo>0)>=2 AS passes FROM (SELECT condition, image_idx%3 AS seed, round(avg(CASE WHEN label=1 THEN score END)-avg(CASE WHEN label=0 THEN score END),9) AS d,
  round(avg(CASE WHEN label=1 THEN score END)-avg(CASE WHEN label=0 THEN score END)-2e-1,9) AS lo FROM grid GROUP BY 1,2) GROUP BY 1""")  # fmt: skip
def _(spark, sf):
    gap = F.avg(F.when(F.col("label") == 1, F.col("score"))) - F.avg(F.when(F.col("label") == 0, F.col("score")))
    seeds = grid(spark, sf).groupBy("condition", (F.col("image_idx") % 3).alias("seed")).agg(F.round(gap, 9).alias("d"), F.round(gap - F.lit(0.2), 9).alias("lo"))
    return rounded(analysis.seed_verdict(seeds, ["condition"], "d", "lo", 0.2, 2), "mean_diff")


@query("A42_memberships", """, t AS (SELECT path, label, CASE row_id%4 WHEN 0 THEN [] WHEN 1 THEN ['jpeg'] WHEN 2 THEN ['jpeg','blur','jpeg'] ELSE ['noise'] END AS f FROM branch)
  SELECT family, CAST(count(*) AS BIGINT) AS n FROM (SELECT path, unnest(list_distinct(f)) AS family FROM t) GROUP BY 1""")  # fmt: skip
def _(spark, sf):
    f = F.when(F.col("row_id") % 4 == 0, F.array().cast("array<string>")).when(F.col("row_id") % 4 == 1, F.array(F.lit("jpeg"))).when(F.col("row_id") % 4 == 2, F.array(F.lit("jpeg"), F.lit("blur"), F.lit("jpeg"))).otherwise(F.array(F.lit("noise")))
    return analysis.memberships(branch(spark, sf).withColumn("f", f), "f").groupBy("family").agg(F.count("*").alias("n"))


@query("A35_ensemble_metrics", "SELECT round(corr(1e0/(1e0+exp(-a)),1e0/(1e0+exp(-b))),6) AS corr, round(avg(CASE WHEN CAST((1e0/(1e0+exp(-a))+1e0/(1e0+exp(-b)))/2e0>=5e-1 AS INTEGER)=label THEN 1e0 ELSE 0e0 END),9) AS accuracy FROM branch")
def _(spark, sf):
    pa, pb = fs.sigmoid(F.col("a")), fs.sigmoid(F.col("b"))
    return branch(spark, sf).agg(F.round(F.corr(pa, pb), 6).alias("corr"), F.round(metrics.accuracy_at(F.col("label"), (pa + pb) / 2.0, F.lit(0.5)), 9).alias("accuracy"))


@query("A46_novelty_auc", "SELECT condition, round(auc,9) AS auc FROM (" + _AUC.format("condition", "(SELECT condition, score, CAST(split='heldout_generator' AS INTEGER) AS held FROM grid WHERE label=1 AND split IN ('heldout_generator','val_internal'))", "held", "score") + ")")
def _(spark, sf):
    g = grid(spark, sf).filter("label = 1 and split in ('heldout_generator', 'val_internal')").withColumn("held", (F.col("split") == "heldout_generator").cast("int"))
    return rounded(metrics.roc_auc(g, ["condition"], "held"), "auc")


@query("A47_collinearity")
def _(spark, sf):
    rank, condition = analysis.collinearity(branch(spark, sf), ["a", "b", "c"])
    return spark.createDataFrame([(rank, round(condition, 6))], "rank int, condition double")


@query("K04_leaderboard", ", u AS (SELECT condition, source, round(auc,9) AS auc FROM (" + _AUC.format("condition, source", "grid", "label", "score") + ")) SELECT condition, source, auc, CAST(row_number() OVER (PARTITION BY condition ORDER BY auc DESC, source) AS INTEGER) AS rank FROM u QUALIFY rank<=2")
def _(spark, sf):
    u = rounded(metrics.roc_auc(grid(spark, sf), ["condition", "source"]), "auc")
    return analysis.leaderboard(u, "condition", "auc", "source", 2).select("condition", "source", "auc", "rank")


@query("W13_evenly_spaced", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT CAST(floor(i*(SELECT count(*) FROM documents)/37) AS BIGINT) FROM range(37) r(i))")
def _(spark, sf):
    return analysis.evenly_spaced(table(spark, sf, "documents").select("doc_id"), "doc_id", 37)


@query("W08_head_per_group", "SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn)<=2")
def _(spark, sf):
    from pyspark.sql import Window as W

    rn = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf, "conversations").withColumn("rn", rn).filter("rn <= 2").select("conv_id", "turn")


@query("M09_disagreement_score", "SELECT path, round(abs(a-b),9) AS d FROM branch")
def _(spark, sf):
    return branch(spark, sf).select("path", F.round(analysis.disagreement(F.col("a"), F.col("b")), 9).alias("d"))


@query("M10_routed_fusion", "SELECT path, round(CASE WHEN is_distorted=1 THEN a ELSE 7e-1*a+3e-1*b END,9) AS s FROM branch")
def _(spark, sf):
    from quillmark.operators.fusion import routed

    return branch(spark, sf).select("path", F.round(routed(F.col("is_distorted") == 1, F.col("a"), F.col("a"), F.col("b"), 0.7), 9).alias("s"))


@query("P27_covariates", "SELECT path, round((2*label-1)*(a-b),9) AS gain FROM branch")
def _(spark, sf):
    return branch(spark, sf).select("path", F.round((F.col("label") * 2 - 1) * (F.col("a") - F.col("b")), 9).alias("gain"))


@query("T06_balance_authentic")
def _(spark, sf):
    m = manifest(spark, sf).withColumn("split", F.when((F.col("label") == 1) & (F.col("row_id") % 3 == 0), "val").when(F.col("label") == 1, "train").otherwise(""))
    return analysis.balance_authentic(m.select("row_id", "path", "label", "split", "source"), "label", "split", "source", "path", SEED, ["val"]).select("row_id", "split", "label")


@query("T17_relabel_population", "SELECT image_idx, condition, CASE WHEN split='train' AND generator IN ('g2','g3') THEN 'heldout_generator' WHEN split='heldout_generator' THEN 'unused' ELSE split END AS split FROM grid")
def _(spark, sf):
    new = F.when((F.col("split") == "train") & F.col("generator").isin("g2", "g3"), "heldout_generator").when(F.col("split") == "heldout_generator", "unused").otherwise(F.col("split"))
    return grid(spark, sf).select("image_idx", "condition", new.alias("split"))


@query("T20_equal_limit", f"SELECT path FROM (SELECT path, row_number() OVER (PARTITION BY source,label ORDER BY sha256('{SEED}|'||path), path) AS rn FROM manifest) WHERE rn<=3")
def _(spark, sf):
    return sampling.ranked(manifest(spark, sf), ["source", "label"], "path").filter("rn <= 3").select("path")


@query("J05_aligned_grids", ", m AS MATERIALIZED (SELECT condition, image_idx, k, score FROM grid) SELECT g.condition, g.image_idx, round(g.score+h.score,9) AS s FROM m g JOIN m h ON g.image_idx=h.image_idx AND g.condition=h.condition WHERE g.k>=2")
def _(spark, sf):
    g = grid(spark, sf)
    other = g.select("condition", "image_idx", F.col("score").alias("other"))
    return g.filter("k >= 2").join(other, ["condition", "image_idx"]).select("condition", "image_idx", F.round(F.col("score") + F.col("other"), 9).alias("s"))


@query("M14_evidence_quality")
def _(spark, sf):
    from quillmark.operators.models import evidence_quality

    b = branch(spark, sf).withColumn("ok", ((F.col("a") >= 0) == (F.col("label") == 1)).cast("int")).withColumn("m", F.abs("a"))
    return evidence_quality(b.filter("row_id % 4 = 0"), b, ["m", "b", "is_distorted"], "ok").select("path", F.round("eqi", 6).alias("eqi"))


@query("M19_R23_content_blind")
def _(spark, sf):
    from quillmark.operators.models import confound_gate, content_blind_auc

    m = manifest(spark, sf).withColumn("log_area", F.log2(F.col("width").cast("double") * F.col("height")))
    return confound_gate(content_blind_auc(m, ["width", "height", "log_area"], "label", "path"), 0.6, 0.75)


@query("M20_resolution_tree")
def _(spark, sf):
    from quillmark.operators.models import resolution_leak

    m = manifest(spark, sf)
    return resolution_leak(m.filter("row_id % 2 = 0"), m.filter("row_id % 2 = 1"), ["width", "height"], "label")


@query("M22_confound_removal")
def _(spark, sf):
    from quillmark.operators.models import probe_auc, remove_direction

    e = table(spark, sf, "embeddings").withColumn("c", (F.col("label") == 3).cast("int"))
    return probe_auc(remove_direction(e, "embedding", "c", 2, 64), "embedding", "c", 64)

"""Score metrics over the grid and branch relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import scalars as fs
from quillmark.operators import bootstrap, controls, extra, fusion, metrics, report, vectors
from quillmark.plans.registry import query, rounded
from quillmark.plans.views import CONDITIONS, branch, grid, manifest, table

#: AUC by group as SQL: {0} group columns, {1} relation, {2} label, {3} score.
_AUC = """SELECT {0}, CASE WHEN sum({2})>0 AND sum(1-{2})>0 THEN
  (sum(CASE WHEN {2}=1 THEN r ELSE 0 END) - CAST(sum({2}) AS DOUBLE)*(sum({2})+1)/2e0) / (CAST(sum({2}) AS DOUBLE)*sum(1-{2})) END AS auc
  FROM (SELECT *, rank() OVER (PARTITION BY {0} ORDER BY {3}) + (count(*) OVER (PARTITION BY {0}, {3})-1)/2e0 AS r FROM {1}) GROUP BY {0}"""
_ROC = """points AS (SELECT condition, s, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY condition) AS np, sum(n) OVER (PARTITION BY condition) AS nn
  FROM (SELECT condition, score AS s, sum(label) AS p, sum(1-label) AS n FROM grid GROUP BY 1,2) WINDOW w AS (PARTITION BY condition ORDER BY s DESC))"""


@query("A01_split_report", "SELECT split, label, CAST(count(*) AS BIGINT) AS n FROM grid GROUP BY 1,2")
def _(spark, sf):
    return controls.grouped_counts(grid(spark, sf), ["split", "label"])


@query("A04_fp_rate_by_source", "SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(count_if(label=0 AND score>=8e-1) AS DOUBLE)/nullif(count_if(label=0),0) AS fp_rate FROM grid GROUP BY 1")
def _(spark, sf):
    return report.fp_rate_by_source(grid(spark, sf), 0.8)


@query("A06_roc_auc", f"SELECT condition, round(auc,9) AS auc FROM ({_AUC.format('condition', 'grid', 'label', 'score')})")
def _(spark, sf):
    return rounded(metrics.roc_auc(grid(spark, sf), ["condition"]), "auc")


@query(
    "A07_leak_auc",
    "SELECT lang, round(greatest(auc,1-auc),9) AS auc FROM (" + _AUC.format("lang", "(SELECT *, CAST(width AS DOUBLE) AS wd FROM manifest)", "label", "wd") + ")",
)
def _(spark, sf):
    return rounded(metrics.leak_auc(manifest(spark, sf).withColumn("wd", F.col("width").cast("double")), ["lang"], "label", "wd"), "auc")


@query("A08_A09_tpr_at_fpr", ", " + _ROC + " SELECT condition, coalesce(min(CASE WHEN fp<=1e-2*nn THEN s END), max(s)+1) AS threshold, coalesce(max(CASE WHEN fp<=1e-2*nn THEN tp END),0)/CAST(max(np) AS DOUBLE) AS tpr FROM points GROUP BY 1")
def _(spark, sf):
    return metrics.tpr_at_fpr(grid(spark, sf), ["condition"])


@query(
    "A10_tpr_neg_quantile",
    """, neg AS (SELECT condition, score, row_number() OVER (PARTITION BY condition ORDER BY score)-1 AS i, count(*) OVER (PARTITION BY condition) AS m FROM grid WHERE label=0),
  thr AS (SELECT condition, score AS threshold FROM neg WHERE i=least(m-1, CAST(ceil(99e-2*m) AS BIGINT)))
  SELECT g.condition, max(threshold) AS threshold, round(avg(CASE WHEN score>threshold THEN 1e0 ELSE 0e0 END),9) AS tpr FROM grid g JOIN thr USING (condition) WHERE label=1 GROUP BY 1""",
)
def _(spark, sf):
    return rounded(metrics.tpr_neg_quantile(grid(spark, sf), ["condition"]), "tpr")


@query(
    "R08_tpr_guarded",
    """, thr AS (SELECT condition, quantile_cont(score,99e-2) AS t, CAST(count(*) AS BIGINT) AS reals FROM grid WHERE label=0 GROUP BY 1)
  SELECT g.condition, round(max(t),9) AS threshold, round(avg(CASE WHEN score>t THEN 1e0 ELSE 0e0 END),9) AS tpr, max(reals) AS reals FROM grid g JOIN thr USING (condition) WHERE label=1 GROUP BY 1""",
)
def _(spark, sf):
    return rounded(metrics.tpr_guarded(grid(spark, sf), ["condition"]), "threshold", "tpr")


@query("A11_accuracy_at_threshold", "SELECT condition, round(avg(CASE WHEN CAST(score>=75e-2 AS INTEGER)=label THEN 1e0 ELSE 0e0 END),9) AS accuracy FROM grid GROUP BY 1")
def _(spark, sf):
    return rounded(grid(spark, sf).groupBy("condition").agg(metrics.accuracy_at(F.col("label"), F.col("score"), F.lit(0.75)).alias("accuracy")), "accuracy")


@query(
    "A12_best_accuracy",
    ", " + _ROC + """, each AS (SELECT condition, s, tp+nn-fp AS ok, np+nn AS m FROM points UNION ALL SELECT condition, max(s)+1, max(nn), max(np+nn) FROM points GROUP BY 1)
  SELECT condition, s AS threshold, CAST(ok AS DOUBLE)/m AS accuracy FROM each QUALIFY row_number() OVER (PARTITION BY condition ORDER BY ok DESC, s)=1""",
)
def _(spark, sf):
    return metrics.best_accuracy(grid(spark, sf), ["condition"])


@query(
    "A13_ece",
    """SELECT condition, round(sum(m*abs(h-q))/sum(m),9) AS ece FROM (SELECT condition, least(floor(p*15),14) AS bin, count(*) AS m, avg(CAST(label AS DOUBLE)) AS h, avg(p) AS q
  FROM (SELECT condition, label, score/2e0 AS p FROM grid) GROUP BY 1,2) GROUP BY 1""",
)
def _(spark, sf):
    return rounded(metrics.ece(grid(spark, sf).withColumn("p", F.col("score") / 2.0), ["condition"]), "ece")


@query("A14_brier", "SELECT condition, round(avg((score/2e0-label)*(score/2e0-label)),9) AS brier FROM grid GROUP BY 1")
def _(spark, sf):
    return rounded(grid(spark, sf).groupBy("condition").agg(metrics.brier(F.col("label"), F.col("score") / 2.0).alias("brier")), "brier")


@query(
    "A15_W12_aurc",
    """, curve AS (SELECT is_distorted, row_number() OVER o/CAST(count(*) OVER (PARTITION BY is_distorted) AS DOUBLE) AS x, sum(1-ok) OVER (PARTITION BY is_distorted ORDER BY conf DESC, row_id ROWS UNBOUNDED PRECEDING)/CAST(row_number() OVER o AS DOUBLE) AS y
  FROM (SELECT is_distorted, row_id, abs(a) AS conf, CAST((a>=0)=(label=1) AS INTEGER) AS ok FROM branch) WINDOW o AS (PARTITION BY is_distorted ORDER BY conf DESC, row_id))
  SELECT is_distorted, round(sum(strip),9) AS aurc FROM (SELECT is_distorted, (y+lag(y) OVER v)*5e-1*(x-lag(x) OVER v) AS strip FROM curve WINDOW v AS (PARTITION BY is_distorted ORDER BY x)) GROUP BY 1""",
)
def _(spark, sf):
    rows = branch(spark, sf).select("is_distorted", "row_id", F.abs("a").alias("conf"), ((F.col("a") >= 0) == (F.col("label") == 1)).cast("int").alias("ok"))
    return rounded(metrics.aurc(metrics.risk_coverage(rows, ["is_distorted"], "ok", "conf", "row_id"), ["is_distorted"], "row_id"), "aurc")


@query("A16_bootstrap_auc")
def _(spark, sf):
    return bootstrap.interval(extra.auc_draws(extra.stacked(branch(spark, sf), ["a"], "label", "path"), 1000), ["arm"], "auc")


@query("A17_paired_bootstrap")
def _(spark, sf):
    return bootstrap.paired_difference(extra.auc_draws(extra.stacked(branch(spark, sf), ["a", "b", "c"], "label", "path"), 2000), "a")


@query(
    "A19_condition_metrics",
    """SELECT lang, n, n_pos, acc_fixed, round(auc,9) AS auc FROM (SELECT lang, CAST(count(*) AS BIGINT) AS n, CAST(sum(label) AS BIGINT) AS n_pos, round(avg(CASE WHEN CAST(width>=2000 AS INTEGER)=label THEN 1e0 ELSE 0e0 END),9) AS acc_fixed FROM manifest GROUP BY 1) JOIN ("""
    + _AUC.format("lang", "(SELECT *, CAST(width AS DOUBLE) AS wd FROM manifest)", "label", "wd") + ") USING (lang)",
)
def condition_metrics(spark, sf):
    rows = manifest(spark, sf).withColumn("wd", F.col("width").cast("double"))
    return rounded(report.condition_metrics(rows, ["lang"], s="wd", threshold=2000.0).select("lang", "n", "n_pos", "acc_fixed", "auc"), "acc_fixed", "auc").orderBy("lang")


@query(
    "A21_F08_robust_tpr",
    """, sel AS (SELECT condition, score, label FROM grid WHERE condition<>'clean' AND ((split='val_internal' AND label=0) OR (split='heldout_generator' AND label=1))),
  points AS (SELECT condition, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY condition) AS np, sum(n) OVER (PARTITION BY condition) AS nn
  FROM (SELECT condition, score AS s, sum(label) AS p, sum(1-label) AS n FROM sel GROUP BY 1,2) WINDOW w AS (PARTITION BY condition ORDER BY s DESC))
  SELECT round(avg(tpr),9) AS robust_tpr FROM (SELECT condition, coalesce(max(CASE WHEN fp<=1e-2*nn THEN tp END),0)/CAST(max(np) AS DOUBLE) AS tpr FROM points GROUP BY 1)""",
)
def _(spark, sf):
    g = grid(spark, sf)
    return rounded(report.robust_tpr(g.filter(report.selection_population(F.col("split"), F.col("label"), F.col("condition")))), "robust_tpr")


@query(
    "A23_per_generator_tpr",
    """, p AS (SELECT s, sum(n) OVER (ORDER BY s DESC) AS fp, sum(n) OVER () AS nn FROM (SELECT score AS s, sum(1-label) AS n FROM grid WHERE condition='blur' GROUP BY 1)), t AS (SELECT min(s) AS thr FROM p WHERE fp<=1e-2*nn)
  SELECT generator, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN score>=thr THEN 1e0 ELSE 0e0 END),9) AS tpr FROM grid, t WHERE condition='blur' AND label=1 GROUP BY 1""",
)
def _(spark, sf):
    return rounded(report.per_generator_tpr(grid(spark, sf).filter("condition = 'blur'")), "tpr")


@query("A24_branch_metrics", f"SELECT is_distorted, round(auc,9) AS auc FROM ({_AUC.format('is_distorted', 'branch', 'label', 'a')})")
def _(spark, sf):
    return rounded(metrics.roc_auc(branch(spark, sf), ["is_distorted"], s="a"), "auc")


_TOKENS = """, t AS (SELECT *, CASE row_id%4 WHEN 0 THEN [] WHEN 1 THEN ['jpeg'] WHEN 2 THEN ['jpeg','blur'] ELSE ['noise'] END AS tokens FROM branch),
  long AS (SELECT unnest(tokens) AS token, label, a FROM t UNION ALL SELECT k.token, label, a FROM t, (VALUES ('jpeg'),('blur'),('noise')) k(token) WHERE len(tokens)=0)"""


@query("A25_P16_token_metrics", _TOKENS + f" SELECT token, round(auc,9) AS auc, n FROM ({_AUC.format('token', 'long', 'label', 'a')}) JOIN (SELECT token, CAST(count(*) AS BIGINT) AS n FROM long GROUP BY 1) USING (token)")
def _(spark, sf):
    text = F.when(F.col("row_id") % 4 == 0, "[]").when(F.col("row_id") % 4 == 1, "['jpeg']").when(F.col("row_id") % 4 == 2, "['jpeg', 'blur']").otherwise("['noise']")
    rows = branch(spark, sf).withColumn("tokens", fs.list_literal(text))
    return rounded(report.token_metrics(rows, "tokens", "label", "a"), "auc")


@query(
    "A26_F15_stratified_auc",
    """, st AS (SELECT *, row_id%7 AS stratum FROM branch WHERE row_id%7<>3 OR label=1), each AS (SELECT * FROM (""" + _AUC.format("stratum", "st", "label", "a")
    + """) JOIN (SELECT stratum, count(*) AS n FROM st GROUP BY 1) USING (stratum))
  SELECT round(sum(CASE WHEN auc IS NOT NULL AND n>=50 THEN auc*n END)/sum(CASE WHEN auc IS NOT NULL AND n>=50 THEN n END),9) AS auc, CAST(count_if(auc IS NOT NULL AND n>=50) AS BIGINT) AS strata_used,
  CAST(coalesce(sum(CASE WHEN auc IS NULL OR n<50 THEN n END),0) AS BIGINT) AS rows_excluded FROM each""",
)
def _(spark, sf):
    rows = branch(spark, sf).withColumn("stratum", F.col("row_id") % 7).filter("stratum <> 3 or label = 1")
    return rounded(controls.stratified_auc(rows, "stratum", "label", "a", 50), "auc")


@query(
    "A27_shared_threshold_rates",
    """, t AS (SELECT quantile_cont(score,99e-2) AS thr FROM grid WHERE label=0 AND condition='jpeg')
  SELECT source AS grp, round(avg(CASE WHEN score>thr THEN 1e0 ELSE 0e0 END),9) AS rate, CAST(count(*) AS BIGINT) AS n, 'fpr' AS kind FROM grid, t WHERE label=0 AND condition='jpeg' GROUP BY 1
  UNION ALL SELECT generator, round(avg(CASE WHEN score>thr THEN 1e0 ELSE 0e0 END),9), CAST(count(*) AS BIGINT), 'tpr' FROM grid, t WHERE label=1 AND condition='jpeg' GROUP BY 1""",
)
def _(spark, sf):
    return rounded(report.shared_threshold_rates(grid(spark, sf).filter("condition = 'jpeg'")), "rate")


@query(
    "A28_K05_confounds",
    """, long AS (SELECT lang AS grp, label, 'width' AS proxy, CAST(width AS DOUBLE) AS v FROM manifest UNION ALL SELECT lang, label, 'height', CAST(height AS DOUBLE) FROM manifest),
  both_ AS (SELECT * FROM long UNION ALL SELECT 'POOLED', label, proxy, v FROM long)
  SELECT grp, proxy, round(greatest(auc,1-auc),9) AS auc, n, n_real, n_fake FROM (""" + _AUC.format("grp, proxy", "both_", "label", "v") + """) JOIN (SELECT grp, proxy, CAST(count(*) AS BIGINT) AS n,
  CAST(count_if(label=0) AS BIGINT) AS n_real, CAST(count_if(label=1) AS BIGINT) AS n_fake FROM both_ GROUP BY 1,2) USING (grp, proxy)""",
)
def _(spark, sf):
    return rounded(controls.confound_table(manifest(spark, sf), ["width", "height"], "lang"), "auc")


@query(
    "A29_M01_zscore_fusion",
    """, st AS (SELECT is_distorted, avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM branch WHERE row_id%4=0 GROUP BY 1)
  SELECT path, round(6e-1*((a-ma)/sa)+4e-1*((b-mb)/sb),6) AS fused, 'val_internal' AS population FROM branch JOIN st USING (is_distorted)""",
)
def _(spark, sf):
    fit = F.col("row_id") % 4 == 0
    z = fusion.zscore(fusion.zscore(branch(spark, sf), "a", ["is_distorted"], fit, "za"), "b", ["is_distorted"], fit, "zb")
    return rounded(fusion.fuse(z, ["za", "zb"], [0.6, 0.4], "val_internal").select("path", "fused", "population"), "fused", digits=6)


@query("A31_challenge_score", f"SELECT round(5e-1*avg(CASE WHEN condition='clean' THEN auc END)+5e-1*avg(CASE WHEN condition<>'clean' THEN auc END),9) AS challenge FROM ({_AUC.format('condition', 'grid', 'label', 'score')})")
def _(spark, sf):
    return rounded(report.challenge_score(metrics.roc_auc(grid(spark, sf), ["condition"])), "challenge")


@query(
    "A32_robustness_table",
    "SELECT rung, " + ", ".join(f"round(max(CASE WHEN condition='{c}' THEN auc END),9) AS {c}" for c in CONDITIONS) + ", round(avg(CASE WHEN condition<>'clean' THEN auc END),9) AS robust_mean FROM ("
    + _AUC.format("rung, condition", "(SELECT *, 'r'||CAST(image_idx%3 AS VARCHAR) AS rung FROM grid)", "label", "score") + ") GROUP BY 1",
)
def _(spark, sf):
    rows = grid(spark, sf).withColumn("rung", F.concat(F.lit("r"), (F.col("image_idx") % 3).cast("string")))
    return rounded(report.robustness_table(metrics.roc_auc(rows, ["rung", "condition"]), "rung", "condition", CONDITIONS), *CONDITIONS, "robust_mean")


@query(
    "A33_spearman",
    """SELECT is_distorted, round(corr(ra,rb),6) AS spearman FROM (SELECT is_distorted, rank() OVER (PARTITION BY is_distorted ORDER BY a)+(count(*) OVER (PARTITION BY is_distorted,a)-1)/2e0 AS ra,
  rank() OVER (PARTITION BY is_distorted ORDER BY b)+(count(*) OVER (PARTITION BY is_distorted,b)-1)/2e0 AS rb FROM branch) GROUP BY 1""",
)
def _(spark, sf):
    return rounded(metrics.spearman(branch(spark, sf), ["is_distorted"], "a", "b"), "spearman", digits=6)


@query(
    "A34_complementarity",
    """SELECT is_distorted, round(avg(CASE WHEN a>1 OR b>1 THEN 1e0 ELSE 0e0 END),9) AS either, round(avg(CASE WHEN a>1 AND b>1 THEN 1e0 ELSE 0e0 END),9) AS both_,
  round(avg(CASE WHEN a<=1 THEN CASE WHEN b>1 THEN 1e0 ELSE 0e0 END END),9) AS b_on_misses, round(corr(a,b),6) AS pearson FROM branch WHERE label=1 GROUP BY 1""",
)
def _(spark, sf):
    ha, hb = F.col("a") > 1, F.col("b") > 1
    out = branch(spark, sf).filter("label = 1").groupBy("is_distorted").agg(
        F.avg((ha | hb).cast("double")).alias("either"), F.avg((ha & hb).cast("double")).alias("both_"),
        F.avg(F.when(~ha, hb.cast("double"))).alias("b_on_misses"), F.round(F.corr("a", "b"), 6).alias("pearson"),
    )
    return rounded(out, "either", "both_", "b_on_misses")


@query(
    "A37_cluster_agreement",
    """, cells AS (SELECT lang AS x, source AS y, count(*) AS n FROM documents GROUP BY 1,2), s AS (SELECT sum(n*(n-1)/2e0) AS s, sum(n) AS n FROM cells),
  sa AS (SELECT sum(m*(m-1)/2e0) AS sa, sum(top) AS top FROM (SELECT sum(n) AS m, max(n) AS top FROM cells GROUP BY x)), sb AS (SELECT sum(m*(m-1)/2e0) AS sb FROM (SELECT sum(n) AS m FROM cells GROUP BY y))
  SELECT round((s-sa*sb/(n*(n-1)/2e0))/((sa+sb)/2e0-sa*sb/(n*(n-1)/2e0)),9) AS ari, round(CAST(top AS DOUBLE)/n,9) AS purity FROM s,sa,sb""",
)
def _(spark, sf):
    return rounded(vectors.cluster_agreement(table(spark, sf, "documents"), "lang", "source"), "ari", "purity")


@query(
    "A39_average_precision",
    ", " + _ROC + " SELECT condition, round(sum((tp-coalesce(ltp,0))/CAST(np AS DOUBLE)*tp/CAST(tp+fp AS DOUBLE)),9) AS ap FROM (SELECT *, lag(tp) OVER (PARTITION BY condition ORDER BY s DESC) AS ltp FROM points) GROUP BY 1",
)
def _(spark, sf):
    return rounded(metrics.average_precision(grid(spark, sf), ["condition"]), "ap")


@query("W02_percent_rank", "SELECT path, round((rank() OVER (PARTITION BY is_distorted ORDER BY a)+(count(*) OVER (PARTITION BY is_distorted,a)-1)/2e0)/count(*) OVER (PARTITION BY is_distorted),9) AS pr FROM branch")
def _(spark, sf):
    return rounded(metrics.mean_rank(branch(spark, sf), ["is_distorted"], "a", "pr", percent=True).select("path", "pr"), "pr")


@query("K01_top_errors", "SELECT condition, image_idx, score FROM grid WHERE label=0 ORDER BY score DESC, condition, image_idx LIMIT 25")
def _(spark, sf):
    return report.top_errors(grid(spark, sf), 25, "fp", ["condition", "image_idx"]).select("condition", "image_idx", "score")


@query(
    "K02_headline",
    """, r AS (SELECT condition AS name, round(auc,9) AS auc, condition<>'clean' AS ok FROM (""" + _AUC.format("condition", "grid", "label", "score") + """)), b AS (SELECT name AS best, auc AS best_value FROM r WHERE ok ORDER BY auc DESC, name LIMIT 1)
  SELECT best, best_value, CAST(count_if(NOT ok AND auc>best_value) AS BIGINT) AS ineligible_better FROM r, b GROUP BY 1,2""",
)
def _(spark, sf):
    r = rounded(metrics.roc_auc(grid(spark, sf), ["condition"]), "auc").select(F.col("condition").alias("name"), "auc")
    return report.headline(r, "name", "auc", "name <> 'clean'")


_SWEEP = """, rows_ AS (SELECT w, is_distorted, label, w*a+(1e0-w)*b AS f FROM branch, (SELECT range/2e1 AS w FROM range(21)) q),
  sweep AS (SELECT w AS weight, round(avg(auc),9) AS objective FROM (""" + _AUC.format("w, is_distorted", "rows_", "label", "f") + ") GROUP BY 1)"  # fmt: skip


@query("M02_weight_sweep", _SWEEP + " SELECT weight, objective FROM sweep")
def _(spark, sf):
    return rounded(fusion.weight_sweep(branch(spark, sf), "a", "b", "label", ["is_distorted"]), "objective")


@query("K03_M03_best_weight", _SWEEP + " SELECT weight, objective FROM sweep ORDER BY objective DESC, abs(weight-5e-1), weight LIMIT 1")
def _(spark, sf):
    return fusion.best_weight(rounded(fusion.weight_sweep(branch(spark, sf), "a", "b", "label", ["is_distorted"]), "objective"))


@query(
    "M05_U07_fusion_lattice",
    """, plan AS (SELECT * FROM (VALUES ('a',1,1e0,0e0,0e0),('b',1,0e0,1e0,0e0),('c',1,0e0,0e0,1e0),('a,b',2,5e-1,5e-1,0e0),('a,c',2,5e-1,0e0,5e-1),('b,c',2,0e0,5e-1,5e-1),('a,b,c',3,1e0/3e0,1e0/3e0,1e0/3e0)) t(arms,arity,wa,wb,wc)),
  rows_ AS (SELECT arms, arity, arms<>'b,c' AS legal, label, 0e0+a*wa+b*wb+c*wc AS f FROM branch, plan)
  SELECT arms, arity, legal, round(auc,9) AS auc FROM (""" + _AUC.format("arms, arity, legal", "rows_", "label", "f") + ")",
)
def _(spark, sf):
    return rounded(fusion.subsets(branch(spark, sf), ["a", "b", "c"], "label", [], frozenset({frozenset({"b", "c"})})), "auc")


@query(
    "M06_Z06_combination_rules",
    """, z AS (SELECT path, a, b, c, 1e0/(1e0+exp(-a)) AS pa, 1e0/(1e0+exp(-b)) AS pb, 1e0/(1e0+exp(-c)) AS pc, (a+b+c)/3e0 AS m FROM branch)
  SELECT path, round(m,6) AS mean, round(a+b+c-greatest(a,b,c)-least(a,b,c),6) AS median, greatest(a,b,c) AS max, least(a,b,c) AS min, round(greatest(a,b,c)-least(a,b,c),6) AS range,
  round(sqrt(((a-m)*(a-m)+(b-m)*(b-m)+(c-m)*(c-m))/3e0),6) AS std, round(1e0-(1e0-pa)*(1e0-pb)*(1e0-pc),6) AS noisy_or, round(pa*pb*pc,6) AS noisy_and FROM z""",
)
def _(spark, sf):
    z = F.array("a", "b", "c")
    p = F.transform(z, lambda x: fs.sigmoid(x))
    r = fusion.rules(z, p, p)
    names = ["mean", "median", "max", "min", "range", "std", "noisy_or", "noisy_and"]
    return rounded(branch(spark, sf).select("path", *[r[n].alias(n) for n in names]), "mean", "median", "range", "std", "noisy_or", "noisy_and", digits=6)


@query("R01_paired_auc_difference", ", d AS (" + _AUC.format("is_distorted, source", "branch", "label", "a") + "), e AS (" + _AUC.format("is_distorted, source", "branch", "label", "b") + ") SELECT is_distorted, source, round(d.auc-e.auc,9) AS diff FROM d JOIN e USING (is_distorted, source)")
def _(spark, sf):
    by = ["is_distorted", "source"]
    x, y = metrics.roc_auc(branch(spark, sf), by, s="a", name="x"), metrics.roc_auc(branch(spark, sf), by, s="b", name="y")
    return x.join(y, by).select(*by, F.round(F.col("x") - F.col("y"), 9).alias("diff"))


@query("R13_quantiles", "SELECT source, round(quantile_cont(a,5e-2),9) AS q05, round(quantile_cont(a,25e-2),9) AS q25, round(quantile_cont(a,5e-1),9) AS q50, round(quantile_cont(a,75e-2),9) AS q75, round(quantile_cont(a,95e-2),9) AS q95 FROM branch GROUP BY 1")
def _(spark, sf):
    q = metrics.quantiles(branch(spark, sf), ["source"], "a", [0.05, 0.25, 0.5, 0.75, 0.95])
    return q.select("source", *[F.round(F.col("q")[i], 9).alias(n) for i, n in enumerate(["q05", "q25", "q50", "q75", "q95"])])

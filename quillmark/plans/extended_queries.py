"""Readers, banks, guards, matched comparisons, recipes and registered analyses."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quillmark.functions import scalars as fs
from quillmark.operators import calibration, extra, fusion, joins, metrics, registry as reg, report, sampling, vectors
from quillmark.plans.metric_queries import _AUC
from quillmark.plans.registry import query, rounded
from quillmark.plans.views import CONDITIONS, branch, grid, manifest, table
from quillmark.sources import datasets as ds
from quillmark.sources import manifests

_TPR = """(SELECT {0}, coalesce(max(CASE WHEN fp<=1e-2*nn THEN tp END),0)/CAST(max(np) AS DOUBLE) AS tpr, coalesce(min(CASE WHEN fp<=1e-2*nn THEN s END), max(s)+1) AS threshold FROM
  (SELECT {0}, s, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY {0}) AS np, sum(n) OVER (PARTITION BY {0}) AS nn
   FROM (SELECT {0}, {2} AS s, sum(label) AS p, sum(1-label) AS n FROM {1} GROUP BY ALL) WINDOW w AS (PARTITION BY {0} ORDER BY s DESC)) GROUP BY {0})"""


# readers and writers: what is written goes to the shared folder and is read back


@query("S01_S02_scan_tree", "SELECT * FROM (VALUES ('benchmark.parquet'),('conversations.parquet'),('customer.parquet'),('documents.parquet'),('embeddings.parquet'),('events.parquet'),('labels.parquet'),('lineitem.parquet'),('nation.parquet'),('orders.parquet'),('pages.parquet'),('part.parquet'),('region.parquet'),('supplier.parquet')) t(name)")
def _(spark, sf):
    return ds.list_files(spark, sf, (".parquet",)).select("name")


@query("S03_S04_S25_frozen_manifest", "SELECT '/mnt/r/'||substr(path,7) AS path, label, generator, source FROM manifest")
def _(spark, sf):
    m = manifest(spark, sf).withColumn("rel_path", fs.relative_path(F.col("path"), "/data"))
    path = ds.scratch(spark, "manifest")
    manifests.write_manifest(manifests.conform(m).withColumn("rel_path", fs.relative_path(F.col("path"), "/data")), path)
    return manifests.read_manifest(spark, path, root="/mnt/r").select("path", "label", "generator", "source")


@query("S05_label_list", "SELECT path, label FROM manifest")
def _(spark, sf):
    path = ds.scratch(spark, "labels")
    manifest(spark, sf).select("path", "label").write.csv(path, header=True)
    return manifests.read_labels_csv(spark, path, "path string, label int", "/data/", [0, 1])


@query("S06_licence_map", "SELECT n_name AS name, 'L'||CAST(max(n_regionkey) AS VARCHAR) AS licence FROM nation GROUP BY 1")
def _(spark, sf):
    path = ds.scratch(spark, "licences")
    lines = table(spark, sf, "nation").select(F.to_json(F.create_map("n_name", F.concat(F.lit("L"), F.col("n_regionkey").cast("string")))).alias("value"))
    lines.coalesce(1).write.text(path)
    return manifests.read_licences(spark, path)


_TOKENS = "CASE row_id%3 WHEN 0 THEN [] WHEN 1 THEN ['jpeg'] ELSE ['jpeg','blur'] END"


@query("S08_distorted_sets", f"SELECT path AS image, label, CAST(row_id%3<>0 AS INTEGER) AS is_distorted, array_to_string({_TOKENS}, '|') AS tokens FROM manifest")
def _(spark, sf):
    path = ds.scratch(spark, "distorted")
    third = F.col("row_id") % 3
    text = F.when(third == 0, "[]").when(third == 1, "['jpeg']").otherwise("['jpeg', 'blur']")
    manifest(spark, sf).select(F.col("path").alias("image"), "label", (third != 0).cast("int").alias("is_distorted"), text.alias("distortions")).write.csv(path, header=True, escape='"')
    return ds.read_distorted_sets(spark, path).select("image", "label", "is_distorted", F.array_join("distortions", "|").alias("tokens"))


@query("S09_vendor_pairs", "SELECT '/r/'||(o_custkey%50) AS path, 0 AS label, '' AS generator, 'vendor' AS source FROM orders GROUP BY 1 UNION ALL SELECT '/f/'||o_orderkey, 1, 'g'||(o_custkey%6), 'vendor' FROM orders")
def _(spark, sf):
    path = ds.scratch(spark, "pairs")
    k = F.col("o_custkey")
    table(spark, sf, "orders").select(
        F.concat(F.lit("/r/"), (k % 50).cast("string")).alias("real"), F.concat(F.lit("/f/"), F.col("o_orderkey").cast("string")).alias("fake"), F.concat(F.lit("g"), (k % 6).cast("string")).alias("model")
    ).write.csv(path, header=True)
    return ds.read_vendor_pairs(spark, path, "vendor")


@query("S10_benchmark_layouts", "SELECT '/x/'||source||'/'||CASE WHEN label=1 THEN '1_fake' ELSE '0_real' END||'/'||row_id AS path, label, CASE WHEN label=1 THEN source ELSE '' END AS generator FROM manifest UNION ALL SELECT '/y/'||CASE WHEN label=1 THEN lang ELSE 'RAISE' END||'/'||row_id, label, CASE WHEN label=1 THEN lang ELSE '' END FROM manifest")
def _(spark, sf):
    m, one = manifest(spark, sf), F.col("label") == 1
    binary = m.select(F.concat_ws("/", F.lit("/x"), "source", F.when(one, "1_fake").otherwise("0_real"), F.col("row_id").cast("string")).alias("path"))
    named = m.select(F.concat_ws("/", F.lit("/y"), F.when(one, F.col("lang")).otherwise("RAISE"), F.col("row_id").cast("string")).alias("path"))
    return ds.benchmark_rows(binary, "binary").union(ds.benchmark_rows(named, "by_generator", real_folder="RAISE"))


@query("S11_expected_count", "SELECT n_name, n_regionkey FROM nation")
def _(spark, sf):
    return ds.with_expected_count(table(spark, sf, "nation").select("n_name", "n_regionkey"), 25)


@query("S12_shard_sidecars", "SELECT 'shard_'||(row_id%3) AS shard, label, CAST(count(*) AS BIGINT) AS n FROM manifest GROUP BY 1,2")
def _(spark, sf):
    base = ds.scratch(spark, "sidecars")
    m = manifest(spark, sf).select("row_id", "label")
    paths = [f"{base}/shard_{i}" for i in range(3)]
    for i, p in enumerate(paths):
        m.filter(F.col("row_id") % 3 == i).write.parquet(p)
    return ds.read_sidecars(spark, paths).groupBy("shard", "label").agg(F.count("*").alias("n"))


@query("S13_restaged_paths", "SELECT row_id, '/tree/'||source||'/'||row_id||'.png' AS target FROM manifest")
def _(spark, sf):
    return ds.restaged(manifest(spark, sf), "/tree", bucket="source").select("row_id", "target")


_BANK = {"manifest": "m1", "conditions": CONDITIONS, "dim": 64}


@query("S14_S15_feature_bank", "SELECT CAST(vec_id AS BIGINT) AS row_id, label FROM embeddings")
def _(spark, sf):
    path = ds.scratch(spark, "bank")
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").cast("long").alias("row_id"), "label", "embedding")
    ds.write_bank(rows.filter("row_id % 2 = 0"), path, _BANK)
    ds.write_bank(rows, path, _BANK)  # taken up again: appends what is missing
    return ds.read_bank(spark, path).select("row_id", "label")


@query("S16_merge_banks", "SELECT CAST(vec_id AS BIGINT) AS row_id, label FROM embeddings")
def _(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").cast("long").alias("row_id"), "label")
    paths = [ds.scratch(spark, "bank") for _ in range(2)]
    for i, p in enumerate(paths):
        ds.write_bank(rows.filter(F.col("row_id") % 2 == i), p, _BANK)
    return ds.merge_banks(spark, paths)


@query("S19_metrics_directory", "SELECT 'run_'||lower(substr(n_name,1,1)) AS run, CAST(n_nationkey AS INTEGER) AS epoch, CAST(n_regionkey AS DOUBLE)/8e0 AS auc FROM nation WHERE n_regionkey=0")
def _(spark, sf):
    base = ds.scratch(spark, "metrics")
    rows = table(spark, sf, "nation").filter("n_regionkey = 0").select("n_name", "n_nationkey", (F.col("n_regionkey").cast("double") / 8).alias("auc")).collect()  # a handful of result files
    hadoop, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    for r in rows:
        target = path(f"{base}/run_{r['n_name'][0].lower()}_ep{r['n_nationkey']}.json")
        out = target.getFileSystem(hadoop).create(target)
        out.write(bytearray(json.dumps({"auc": r["auc"]}, indent=1).encode()))
        out.close()
    return ds.read_metrics(spark, base, "auc double")


@query("S21_probe_registry", ", reg(region, family) AS (VALUES (0,'vit'),(1,'cnn'),(2,'vit')) SELECT n_nationkey AS id, family, greatest(CAST(n_nationkey%7 AS INTEGER), CAST(n_nationkey%5 AS INTEGER)) AS best, CASE WHEN n_nationkey%7>=n_nationkey%5 THEN 'r1' ELSE 'r2' END AS best_rung FROM nation LEFT JOIN reg ON n_regionkey=region")
def _(spark, sf):
    r = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").cast("int").alias("region"), (F.col("n_nationkey") % 7).cast("int").alias("r1"), (F.col("n_nationkey") % 5).cast("int").alias("r2"))
    known = spark.createDataFrame([(0, "vit"), (1, "cnn"), (2, "vit")], "region int, family string")
    return ds.probe_table(r, known, "region", ["r1", "r2"]).select("id", "family", "best", "best_rung")


@query("S22_markdown_lines", "SELECT '| '||n_name||' | '||n_regionkey||' |' AS line FROM nation UNION ALL SELECT '| n_name | n_regionkey |' UNION ALL SELECT '| - | - |'")
def _(spark, sf):
    text = report.to_markdown(table(spark, sf, "nation").select("n_name", "n_regionkey"))
    return spark.createDataFrame([(x,) for x in text.splitlines()], "line string")


@query("S23_heatmap_cells", "SELECT generator, " + ", ".join(f"round(avg(CASE WHEN condition='{c}' THEN score END),9) AS {c}" for c in CONDITIONS) + " FROM grid WHERE label=1 GROUP BY 1")
def _(spark, sf):
    g = grid(spark, sf).filter("label = 1")
    return rounded(g.groupBy("generator").pivot("condition", CONDITIONS).agg(F.avg("score")), *CONDITIONS)


@query("S24_predictions", "SELECT path AS image_path, round(1e0/(1e0+exp(-a)),6) AS pred FROM branch")
def _(spark, sf):
    path = ds.scratch(spark, "predictions")
    branch(spark, sf).select(F.col("path").alias("image_path"), F.round(fs.sigmoid(F.col("a")), 6).alias("pred")).write.json(path)
    return spark.read.schema("image_path string, pred double").json(path)


@query("S27_metadata_bank", "SELECT vec_id, label FROM embeddings")
def _(spark, sf):
    return table(spark, sf, "embeddings").drop("embedding")


@query("S28_provenance", """SELECT '{"source":"'||source||'","label":'||label||',"n":'||count(*)||'}' AS record FROM manifest GROUP BY source, label""")
def _(spark, sf):
    return ds.provenance(manifest(spark, sf), ["source", "label"])


# names, identities, recipes


@query("P03_safe_names", r"SELECT page_id, NOT regexp_matches(url, '[/\\]') AND NOT regexp_matches(url, '^\.*$') AS safe FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", fs.safe_name(F.col("url")).alias("safe"))


@query("P07_content_identity", "SELECT doc_id, sha256(text) AS digest, octet_length(encode(text)) AS size FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("size"))


@query("P10_aliases", "SELECT n_nationkey, CASE n_regionkey%2 WHEN 0 THEN 'sd_xl' ELSE 'mj_v5' END AS subset FROM nation")
def _(spark, sf):
    even = F.col("n_regionkey") % 2 == 0
    names = table(spark, sf, "nation").select("n_nationkey", F.when(even, F.when(F.col("n_nationkey") % 3 == 0, "SDXL.csv").otherwise("Sd-XL")).otherwise(" MidJourney-5 ").alias("name"))
    aliases = spark.createDataFrame([("sd_xl", ["sdxl"]), ("mj_v5", ["midjourney_5", "mjv5"])], "subset string, aliases array<string>")
    return extra.resolve_aliases(names, aliases).select("n_nationkey", "subset")


def _ops():
    """Chain of a document: jpeg, sometimes blur, jpeg again and noise."""
    k = F.col("row_id")
    one = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("double").alias("value"))
    ops = F.array(one("jpeg", 100 - k % 90), F.when(k % 2 == 0, one("blur", (k % 30) / 10)), F.when(k % 3 == 0, one("jpeg", 90 - k % 80)), F.when(k % 5 == 0, one("noise", (k % 20) / 100)))
    return F.filter(ops, lambda o: o.isNotNull())


_SEV = "greatest(0e0, least(1e0, {}))"


@query("P17_recipe_labels", f"""SELECT row_id, 1 AS jpeg, CAST(row_id%2=0 AS INTEGER) AS blur, CAST(row_id%5=0 AS INTEGER) AS noise,
  round(greatest({_SEV.format('(row_id%90)/70e0')}, CASE WHEN row_id%3=0 THEN {_SEV.format('(10+row_id%80)/70e0')} ELSE 0e0 END),9) AS jpeg_sev,
  round(CASE WHEN row_id%2=0 THEN {_SEV.format('(row_id%30)/20e0')} ELSE 0e0 END,9) AS blur_sev, round(CASE WHEN row_id%5=0 THEN {_SEV.format('(row_id%20)/10e0')} ELSE 0e0 END,9) AS noise_sev FROM manifest""")
def _(spark, sf):
    out = manifest(spark, sf).select("row_id", extra.recipe_labels(_ops()).alias("x"))
    p, s = F.col("x.presence"), F.col("x.severity")
    return rounded(out.select("row_id", p[0].alias("jpeg"), p[1].alias("blur"), p[3].alias("noise"), s[0].alias("jpeg_sev"), s[1].alias("blur_sev"), s[3].alias("noise_sev")), "jpeg_sev", "blur_sev", "noise_sev")


@query("P18_recipe_json", "SELECT row_id, CAST(1+CAST(row_id%2=0 AS INTEGER)+CAST(row_id%3=0 AS INTEGER)+CAST(row_id%5=0 AS INTEGER) AS INTEGER) AS n, CAST(1+CAST(row_id%3=0 AS INTEGER) AS INTEGER) AS n_jpeg FROM manifest")
def _(spark, sf):
    text = manifest(spark, sf).select("row_id", F.to_json(_ops()).alias("recipe"))
    back = text.select("row_id", F.from_json("recipe", "array<struct<name:string,value:double>>").alias("ops"))
    return back.select("row_id", F.size("ops").alias("n"), F.size(F.filter("ops", lambda o: o["name"] == "jpeg")).alias("n_jpeg"))


@query("P24_operating_point_names", "SELECT * FROM (VALUES (1e-2,'1%','tpr_at_1pct'),(5e-3,'0.5%','tpr_at_0.5pct'),(1e-1,'10%','tpr_at_10pct')) t(fpr, label, col)")
def _(spark, sf):
    return spark.createDataFrame([(f, extra.fpr_label(f), extra.tpr_column(f)) for f in (0.01, 0.005, 0.1)], "fpr double, label string, col string")


@query("F06_heldout_eligible", "SELECT row_id, generator<>'' AND generator NOT IN ('de') AS eligible FROM manifest")
def _(spark, sf):
    return manifest(spark, sf).select("row_id", ((F.col("generator") != "") & ~F.col("generator").isin("de")).alias("eligible"))


@query("F07_unreadable_rows", "SELECT 'row' AS kind, CAST(count(*) AS BIGINT) AS n FROM manifest WHERE row_id%7<>0 UNION ALL SELECT 'reject', CAST(count(*) AS BIGINT) FROM manifest WHERE row_id%7=0")
def _(spark, sf):
    path = ds.scratch(spark, "lines")
    good = F.to_json(F.struct("row_id", "label"))
    manifest(spark, sf).select(F.when(F.col("row_id") % 7 == 0, F.concat(F.lit("{broken "), "row_id")).otherwise(good).alias("value")).write.text(path)
    rows, rejects = ds.read_rejecting(spark, path, "row_id long, label int")
    return rows.agg(F.lit("row").alias("kind"), F.count("*").alias("n")).union(rejects.agg(F.lit("reject").alias("kind"), F.count("*").alias("n")))


@query("F10_reproducible_encoder", "SELECT o_orderkey, o_custkey%9<>0 AND o_orderkey%5<>0 AND o_custkey%4<3 AS ok FROM orders")
def _(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    enc = extra.reproducible(F.when(c % 9 == 0, "L").otherwise("RGB"), F.when(k % 5 == 0, 1).otherwise(2), F.when(c % 4 < 3, (c % 4).cast("int")).otherwise(-1))
    return table(spark, sf, "orders").select("o_orderkey", enc.alias("ok"))


@query("F12_Z05_view_rows", "SELECT row_id, v.i AS view_idx, v.name AS view FROM manifest CROSS JOIN (VALUES (0,'identity'),(1,'hflip'),(2,'rot90')) v(i, name)")
def _(spark, sf):
    extra.check_views({"hflip": [], "soft": [("jpeg", 96.0)]}, {"jpeg": (65.0, 75.0), "blur": (0.9, 1.1)})
    return extra.views(manifest(spark, sf).select("row_id"), ["identity", "hflip", "rot90"])


@query("F14_drop_generators", "SELECT row_id FROM manifest WHERE generator NOT IN ('de')")
def _(spark, sf):
    return extra.without_generators(manifest(spark, sf), ["de"]).select("row_id")


@query("F16_download_budget", "SELECT n_regionkey AS subset, CASE WHEN n_regionkey=3 THEN NULL ELSE sum(n_nationkey*1e0) END AS gb, n_regionkey<>3 AND sum(n_nationkey)>55 AS refused FROM nation GROUP BY 1")
def _(spark, sf):
    sizes = table(spark, sf, "nation").select(F.col("n_regionkey").alias("subset"), F.when((F.col("n_regionkey") != 3) | (F.col("n_nationkey") % 2 == 0), F.col("n_nationkey").cast("double")).alias("gb"))
    return extra.over_budget(sizes, "subset", "gb", 55.0)


@query("J03_positional_join", "SELECT row_id, label, a, b FROM branch")
def _(spark, sf):
    x = branch(spark, sf)
    return extra.positional(x.select("row_id", "label", "a"), x.select("row_id", "label", "b"), "row_id", ["label"]).select("row_id", "label", "a", "b")


@query("J07_split_lookup", "SELECT condition, split, CAST(count(*) AS BIGINT) AS n FROM grid GROUP BY 1,2")
def _(spark, sf):
    g = grid(spark, sf)
    table_ = g.filter("k = 0").select(F.col("image_idx").alias("position"), "split")
    return extra.split_of(g.drop("split"), table_, "image_idx", "split").groupBy("condition", "split").agg(F.count("*").alias("n"))


@query("J18_R20_comparable_banks", "SELECT * FROM (VALUES ('manifest'),('dim')) t(field)")
def _(spark, sf):
    configs = [_BANK, _BANK | {"manifest": "m2", "dim": 32, "backbone": "b"}]
    return spark.createDataFrame([(x,) for x in ds.comparable(configs, ["manifest", "conditions", "dim", "backbone"], allow={"backbone"})], "field string")


@query("J19_mirrored_pairs", "SELECT image_id, 'o_orderpriority' AS d FROM (SELECT o_custkey%1000 AS image_id, max(CASE WHEN o_orderkey%2=0 THEN o_orderpriority END) AS r, max(CASE WHEN o_orderkey%2=1 THEN o_orderpriority END) AS f FROM orders GROUP BY 1) WHERE r<>f")
def _(spark, sf):
    o = table(spark, sf, "orders")
    pairs = o.select((F.col("o_custkey") % 1000).alias("image_id"), (F.col("o_orderkey") % 2).cast("int").alias("label"), "o_orderpriority")
    return extra.parity(pairs, "image_id", "label", ["o_orderpriority"]).select("image_id", F.array_join("differs", "|").alias("d"))


# metrics


@query("A18_image_bootstrap")
def _(spark, sf):
    from quillmark.operators import bootstrap

    draws = extra.auc_draws(extra.stacked(branch(spark, sf), ["a", "b", "c"], "label", "path"), 1000)
    panel = bootstrap.paired_difference(draws, "a")
    better = draws.join(draws.filter("arm = 'a'").select("replicate", F.col("auc").alias("base")), "replicate").filter("arm <> 'a'").groupBy("arm").agg(F.avg((F.col("auc") > F.col("base")).cast("double")).alias("p_better"))
    return panel.join(better, "arm")


@query("A20_clean_threshold", f"SELECT 'clean' AS condition, threshold FROM (SELECT s AS threshold FROM (SELECT s, tp+nn-fp AS ok FROM (SELECT s, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(n) OVER () AS nn FROM (SELECT score AS s, sum(label) AS p, sum(1-label) AS n FROM grid WHERE condition='clean' GROUP BY 1) WINDOW w AS (ORDER BY s DESC)) UNION ALL SELECT max(score)+1, sum(1-label) FROM grid WHERE condition='clean') ORDER BY ok DESC, s LIMIT 1)")
def _(spark, sf):
    return spark.createDataFrame([("clean", report.clean_threshold(grid(spark, sf)))], "condition string, threshold double")


@query("A22_validation_tpr", "SELECT round(avg(tpr),9) AS objective FROM " + _TPR.format("condition", "(SELECT * FROM grid WHERE condition<>'clean' AND split='val_internal')", "score"))
def _(spark, sf):
    return rounded(extra.validation_tpr(grid(spark, sf)), "objective")


@query("A30_zscore_fit", "SELECT round(avg(a),9) AS mean, round(stddev_pop(a),9) AS sd FROM branch")
def _(spark, sf):
    return rounded(branch(spark, sf).agg(F.avg("a").alias("mean"), F.stddev_pop("a").alias("sd")), "mean", "sd")


_DECILE = """, e AS (SELECT list_distinct([""" + ",".join(f"quantile_cont(CAST(least(width,height) AS DOUBLE),{i}e-1)" for i in range(11)) + """]) AS e FROM manifest),
  d AS (SELECT m.label, CAST(width AS DOUBLE) AS wd, len(list_filter((list_sort(e))[2:len(e)-1], lambda x: x<=least(width,height))) AS decile FROM manifest m CROSS JOIN e),
  a AS (""" + _AUC.format("decile", "d", "label", "wd") + """), n AS (SELECT decile, count(*) AS n FROM d GROUP BY 1)
  SELECT CAST(sum(n) AS BIGINT) AS n_used, CAST(count(*) AS BIGINT) AS deciles, round(sum(auc*n)/sum(n),9) AS auc FROM a JOIN n USING (decile) WHERE auc IS NOT NULL"""


@query("A43_within_decile_auc", _DECILE)
def _(spark, sf):
    m = manifest(spark, sf).withColumn("short", F.least("width", "height").cast("double")).withColumn("wd", F.col("width").cast("double"))
    return rounded(extra.decile_auc(m, "short", "label", "wd"), "auc")


@query("W01_average_rank", "SELECT path, rank() OVER (PARTITION BY is_distorted ORDER BY a)+(count(*) OVER (PARTITION BY is_distorted, a)-1)/2e0 AS rank FROM branch")
def _(spark, sf):
    return metrics.mean_rank(branch(spark, sf), ["is_distorted"], "a").select("path", "rank")


@query("W03_cumulative_counts", "SELECT condition, s, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp FROM (SELECT condition, score AS s, sum(label) AS p, sum(1-label) AS n FROM grid GROUP BY 1,2) WINDOW w AS (PARTITION BY condition ORDER BY s DESC)")
def _(spark, sf):
    return extra.cumulative(grid(spark, sf), ["condition"], "label", "score")


@query("W04_group_zscore", "SELECT g.condition, image_idx, round((score-m)/s,6) AS z FROM grid g JOIN (SELECT condition, avg(score) AS m, stddev_pop(score) AS s FROM grid GROUP BY 1) t ON g.condition=t.condition")
def _(spark, sf):
    return fusion.zscore(grid(spark, sf), "score", ["condition"], F.lit(True)).select("condition", "image_idx", F.round("z", 6).alias("z"))


_KEY = "sha256('20260827|'||CAST(path AS VARCHAR))"


@query("W05_stratum_capacity", f"SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY source, label ORDER BY {_KEY}, path) AS rn FROM manifest) WHERE rn<=20")
def _(spark, sf):
    return sampling.ranked(manifest(spark, sf), ["source", "label"], "path").filter("rn <= 20").select("row_id")


@query("W11_first_seen_order", "SELECT condition, CAST(row_number() OVER (ORDER BY f) AS INTEGER) AS position FROM (SELECT condition, min(image_idx*10+(k*3)%5) AS f FROM grid GROUP BY 1)")
def _(spark, sf):
    from pyspark.sql import Window as W

    seen = grid(spark, sf).groupBy("condition").agg(F.min(F.col("image_idx") * 10 + (F.col("k") * 3) % 5).alias("f"))
    return seen.select("condition", F.row_number().over(W.orderBy("f")).alias("position"))  # one row a condition


@query("K06_numeric_strata", "SELECT key, CAST(row_number() OVER (ORDER BY TRY_CAST(key AS DOUBLE) IS NULL, TRY_CAST(key AS DOUBLE), key) AS INTEGER) AS position FROM (SELECT DISTINCT CASE WHEN n_regionkey=4 THEN n_name ELSE CAST(n_nationkey*37 AS VARCHAR) END AS key FROM nation)")
def _(spark, sf):
    from pyspark.sql import Window as W

    keys = table(spark, sf, "nation").select(F.when(F.col("n_regionkey") == 4, F.col("n_name")).otherwise((F.col("n_nationkey") * 37).cast("string")).alias("key")).distinct()
    return keys.select("key", F.row_number().over(W.orderBy(*extra.numeric_order(F.col("key")))).alias("position"))  # one row a stratum


@query("K07_identity_order", "SELECT min(CAST(row_id AS VARCHAR)) AS first, max(CAST(row_id AS VARCHAR)) AS last, 'row_id' AS by_column FROM manifest")
def _(spark, sf):
    m = manifest(spark, sf)
    name = extra.identity_column(m)
    key = F.col(name).cast("string")
    return m.agg(F.min(key).alias("first"), F.max(key).alias("last"), F.lit(name).alias("by_column"))


@query("T13_apportion", "SELECT * FROM (VALUES ('a',5),('b',3),('c',1),('d',1)) t(family, n)")
def _(spark, sf):
    got = sampling.apportion(10, {"a": 0.5, "b": 0.34, "c": 0.14, "d": 0.02})
    return spark.createDataFrame(sorted(got.items()), "family string, n int")


# fusion, calibration, baselines


def _lattice(steps: int) -> str:
    points = fusion.simplex(3, steps)
    return ", ".join("('" + ",".join(f"{x:g}" for x in w) + "'," + ",".join(f"{x!r}e0" for x in w) + ")" for w in points)


@query("M04_simplex_sweep", f""", l(weights, wa, wb, wc) AS (VALUES {_lattice(4)}), f AS (SELECT weights, label, a*wa+b*wb+c*wc AS s FROM branch CROSS JOIN l), sweep AS ({_AUC.format('weights', 'f', 'label', 's')})
  SELECT round(max(auc),6) AS best, CAST(count_if(auc>=(SELECT max(auc) FROM sweep)-1e-2) AS BIGINT) AS n_near, CAST(count(*) AS BIGINT) AS n FROM sweep""")
def _(spark, sf):
    sweep = extra.simplex_sweep(branch(spark, sf), ["a", "b", "c"], "label", fusion.simplex(3, 4))
    return rounded(extra.flatness(sweep, "auc", 0.01), "best", digits=6)


@query("M08_probability_ensemble", """, p AS (SELECT label, 1e0/(1e0+exp(-a)) AS pa, 1e0/(1e0+exp(-b)) AS pb FROM branch), w AS (SELECT CAST(i AS DOUBLE)/20e0 AS w FROM range(21) t(i)),
  f AS (SELECT w, label, w*pa+(1e0-w)*pb AS s FROM p CROSS JOIN w) SELECT w AS weight, round(avg(CASE WHEN CAST(s>=5e-1 AS INTEGER)=label THEN 1e0 ELSE 0e0 END),9) AS accuracy FROM f GROUP BY 1""")
def _(spark, sf):
    w = F.explode(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: i / F.lit(20.0)))
    rows = branch(spark, sf).select("label", fs.sigmoid(F.col("a")).alias("pa"), fs.sigmoid(F.col("b")).alias("pb"), w.alias("weight"))
    s = F.col("weight") * F.col("pa") + (F.lit(1.0) - F.col("weight")) * F.col("pb")
    return rounded(rows.withColumn("s", s).groupBy("weight").agg(metrics.accuracy_at(F.col("label"), F.col("s"), F.lit(0.5)).alias("accuracy")), "accuracy")


@query("M11_fused_identity", "SELECT 'fused' AS kind, CAST(2 AS BIGINT) AS parents, 25e-2 AS w")
def _(spark, sf):
    got = ds.fused_identity([_BANK, _BANK | {"backbone": "b"}], [1.0, 3.0])
    return spark.createDataFrame([(got["kind"], len(set(got["parents"])), got["weights"][0])], "kind string, parents long, w double")


@query("M13_conditional_temperature", """, t AS (SELECT path, a, 5e-1*b-25e-2*is_distorted+3e-1 AS u FROM branch)
  SELECT path, round(a/greatest(least(ln(1e0+exp(-abs(u)))+greatest(u,0e0)+1e-2, 2e0), 5e-1),6) AS z FROM t""")
def _(spark, sf):
    t = calibration.conditional_temperature([F.col("b"), F.col("is_distorted")], [0.5, -0.25], 0.3, 0.01, 0.5, 2.0)
    return branch(spark, sf).select("path", F.round(F.col("a") / t, 6).alias("z"))


@query("M18_fit_split_hygiene", "SELECT split, CAST(count(*) AS BIGINT) AS n FROM grid WHERE split='val_internal' GROUP BY 1")
def _(spark, sf):
    fit = grid(spark, sf).filter("split = 'val_internal'")
    calibration.check_fit_split(fit)
    return fit.groupBy("split").agg(F.count("*").alias("n"))


_MEANS = "m AS (SELECT i, avg(CASE WHEN label=1 THEN x END)-avg(CASE WHEN label=0 THEN x END) AS w FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding,1) AS i FROM embeddings) GROUP BY 1)"


@query("M23_closed_form_readout", f", {_MEANS}, x AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding,1) AS i FROM embeddings) SELECT vec_id, round(sum(x*w),5) AS score FROM x JOIN m USING (i) GROUP BY 1")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    stats = vectors.component_stats(e.filter("label in (0, 1)"), "label", "embedding").groupBy("pos").agg((F.max(F.when(F.col("label") == 1, F.col("mean"))) - F.max(F.when(F.col("label") == 0, F.col("mean")))).alias("w"))
    weights = stats.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]).alias("w"))  # one number a component
    dot = F.aggregate(F.zip_with("embedding", "w", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    return e.crossJoin(F.broadcast(weights)).select("vec_id", F.round(dot, 5).alias("score"))


@query("M26_monotone_rescale", "SELECT condition, true AS same FROM grid GROUP BY 1")
def _(spark, sf):
    g = grid(spark, sf)
    one = metrics.tpr_at_fpr(g, ["condition"]).select("condition", F.col("tpr").alias("x"))
    two = metrics.tpr_at_fpr(g.withColumn("score", F.col("score") * 8 - 2), ["condition"]).select("condition", F.col("tpr").alias("y"))
    return one.join(two, "condition").select("condition", (F.col("x") == F.col("y")).alias("same"))


@query("M28_negated_column", "SELECT vec_id, -CAST(embedding[3] AS DOUBLE) AS score FROM embeddings")
def _(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", (-F.get("embedding", F.lit(2)).cast("double")).alias("score"))


# conditions and views


@query("I16_composite_grid", "SELECT row_id, c.condition, c.n AS n_ops FROM manifest CROSS JOIN (VALUES ('social_repost',2),('messaging_app',2),('screenshot',3),('filtered_upload',2),('low_light_share',2)) c(condition, n)")
def _(spark, sf):
    return extra.composite_conditions(manifest(spark, sf).select("row_id")).select("row_id", "condition", F.size("ops").alias("n_ops"))


@query("X04_replayed_views", "SELECT row_id, CAST(count(*) AS BIGINT) AS n_views, max(v.i)-min(v.i)+1=count(*) AS contiguous FROM manifest CROSS JOIN (VALUES (0),(1),(2)) v(i) GROUP BY 1")
def _(spark, sf):
    v = extra.views(manifest(spark, sf).select("row_id", "width"), ["identity", "hflip", "rot90"])
    block = v.select("row_id", "view_idx", (F.col("width") * F.col("view_idx")).alias("aux"))
    both = v.join(block, ["row_id", "view_idx"])
    return both.groupBy("row_id").agg(F.count("aux").alias("n_views"), (F.max("view_idx") - F.min("view_idx") + 1 == F.count("*")).alias("contiguous"))


@query("X07_row_losses", """, p AS (SELECT path, CAST(label AS DOUBLE) AS y, greatest(1e-7,least(1e0-1e-7,1e0/(1e0+exp(-a)))) AS q, greatest(1e-7,least(1e0-1e-7,1e0/(1e0+exp(-b)))) AS t FROM branch)
  SELECT path, round(-(y*ln(q)+(1e0-y)*ln(1e0-q)),6) AS bce, round(t*ln(t/q)+(1e0-t)*ln((1e0-t)/(1e0-q)),6) AS kl, round((q-t)*(q-t),6) AS mse FROM p""")
def _(spark, sf):
    losses = extra.row_losses(fs.sigmoid(F.col("a")), F.col("label").cast("double"), fs.sigmoid(F.col("b")))
    return branch(spark, sf).select("path", *[F.round(c, 6).alias(n) for n, c in losses.items()])


@query("X08_per_view_auc", f"SELECT k, round(auc,9) AS auc FROM ({_AUC.format('k', 'grid', 'label', 'score')})")
def _(spark, sf):
    return rounded(metrics.roc_auc(grid(spark, sf), ["k"]), "auc")


@query("Z01_named_metric", f"SELECT condition, 'auc' AS metric, round(auc,9) AS value FROM ({_AUC.format('condition', 'grid', 'label', 'score')}) UNION ALL SELECT condition, 'tpr_at_fpr', round(tpr,9) FROM {_TPR.format('condition', 'grid', 'score')}")
def _(spark, sf):
    g = grid(spark, sf)
    parts = [metrics.METRICS[n](g, ["condition"]).select("condition", F.lit(n).alias("metric"), F.round(c, 9).alias("value")) for n, c in (("auc", "auc"), ("tpr_at_fpr", "tpr"))]
    return parts[0].union(parts[1])


STRATA = {
    "exact_short_side": lambda w, h: fs.short_side(w, h).cast("string"),
    "exact_dimensions": lambda w, h: fs.dimensions(w, h),
    "binned_short_side": lambda w, h: fs.binned(fs.short_side(w, h), [256, 512, 1024]),
}


@query("Z02_stratum_strategies", "SELECT 'exact_short_side' AS strategy, CAST(count(DISTINCT least(width,height)) AS BIGINT) AS strata FROM manifest UNION ALL SELECT 'exact_dimensions', CAST(count(DISTINCT width||'x'||height) AS BIGINT) FROM manifest UNION ALL SELECT 'binned_short_side', CAST(count(DISTINCT CASE WHEN least(width,height)<256 THEN 0 WHEN least(width,height)<512 THEN 1 WHEN least(width,height)<1024 THEN 2 ELSE 3 END) AS BIGINT) FROM manifest")
def _(spark, sf):
    keyed = [manifest(spark, sf).select(F.lit(n).alias("strategy"), f(F.col("width"), F.col("height")).alias("key")) for n, f in STRATA.items()]
    rows = keyed[0].union(keyed[1]).union(keyed[2])
    return rows.distinct().groupBy("strategy").agg(F.count("*").alias("strata"))


@query("Z07_calibrators", "SELECT path, round(a/2e0,9) AS plain, round(a/(1e0+is_distorted),9) AS conditional FROM branch")
def _(spark, sf):
    calibrators = {"plain": (lambda x: x / 2.0, ()), "conditional": (lambda x, c: x / (c + 1.0), ("is_distorted",))}
    cols = [F.round(f(F.col("a"), *[F.col(c) for c in needs]), 9).alias(n) for n, (f, needs) in calibrators.items()]
    return branch(spark, sf).select("path", *cols)


# registered analyses


_SIGN = "CASE WHEN condition IN ('jpeg','blur') THEN 1 ELSE 0 END"


@query("R05_reduction_verdict", "SELECT * FROM (VALUES ('a','STRONG-ONLY'),('b','UNRESOLVED'),('c','EVERYWHERE'),('d','NONE'),('e','UNRESOLVED')) t(scope, verdict)")
def _(spark, sf):
    cases = [("a", -0.004, 0.006, 0.01, 0.005, 0.02), ("b", -0.004, 0.012, 0.01, 0.005, 0.02), ("c", 0.002, 0.008, 0.01, 0.005, 0.02), ("d", -0.004, 0.006, -0.003, -0.002, 0.003), ("e", -0.004, 0.006, 0.001, -0.002, 0.003)]
    df = spark.createDataFrame(cases, "scope string, low2 double, high2 double, low4 double, rise_low double, rise_high double")
    return df.select("scope", extra.verdict(F.col("low2"), F.col("high2"), F.col("rise_low"), F.col("rise_high"), [F.col("low2"), F.col("low4")], 0.01).alias("verdict"))


@query("R07_groups_against_reals", """, r AS (SELECT score FROM grid WHERE k=0 AND label=0), d AS (SELECT score, count(*) AS n FROM r GROUP BY 1),
  f AS (SELECT generator, score FROM grid WHERE k=0 AND label=1), u AS (SELECT DISTINCT score FROM f),
  w AS (SELECT u.score, (SELECT count(*) FROM r WHERE r.score<u.score)+(SELECT count(*) FROM r WHERE r.score=u.score)/2e0 AS won FROM u)
  SELECT generator AS grp, CAST(count(*) AS BIGINT) AS n_fake, CAST((SELECT count(*) FROM r) AS BIGINT) AS n_real, round(avg(won/(SELECT count(*) FROM r)),9) AS auc FROM f JOIN w USING (score) GROUP BY 1""")
def _(spark, sf):
    return rounded(extra.per_group_against_all_reals(grid(spark, sf).filter("k = 0"), F.col("generator"), "label", "score"), "auc")


@query("R10_R16_masked_arms", f"SELECT is_distorted, round(x.auc-y.auc,9) AS d FROM ({_AUC.format('is_distorted', 'branch', 'label', 'a')}) x JOIN ({_AUC.format('is_distorted', 'branch', 'label', 'b')}) y USING (is_distorted)")
def _(spark, sf):
    b = branch(spark, sf)
    centre, rim = (metrics.roc_auc(b, ["is_distorted"], "label", c, n) for c, n in (("a", "x"), ("b", "y")))
    return centre.join(rim, "is_distorted").select("is_distorted", F.round(F.col("x") - F.col("y"), 9).alias("d"))


@query("R18_contaminated_reals", "SELECT row_id, CASE WHEN label=0 AND content_sha256 IN (SELECT sha256(text) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) THEN 'contaminated' WHEN label=0 THEN 'real' ELSE 'fake' END AS population FROM manifest")
def _(spark, sf):
    m = manifest(spark, sf)
    outside = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").select(F.sha2("text", 256).alias("content_sha256")).distinct().withColumn("hit", F.lit(True))
    kind = F.when((F.col("label") == 0) & F.col("hit"), "contaminated").when(F.col("label") == 0, "real").otherwise("fake")
    return m.join(outside, "content_sha256", "left").select("row_id", kind.alias("population"))


@query("R22_capacity_deltas", "SELECT condition, round(avg(score)-(SELECT avg(score) FROM grid WHERE condition='clean'),9) AS delta FROM grid WHERE condition<>'clean' GROUP BY 1")
def _(spark, sf):
    means = grid(spark, sf).groupBy("condition").agg(F.avg("score").alias("m"))
    base = means.filter("condition = 'clean'").select(F.col("m").alias("base"))
    return means.filter("condition <> 'clean'").crossJoin(F.broadcast(base)).select("condition", F.round(F.col("m") - F.col("base"), 9).alias("delta"))  # one row


@query("R24_psnr", ", q AS (SELECT vec_id, len(embedding) AS n, list_sum(list_transform(embedding, lambda x: (CAST(x AS DOUBLE)-floor(CAST(x AS DOUBLE)*8e0)/8e0)*(CAST(x AS DOUBLE)-floor(CAST(x AS DOUBLE)*8e0)/8e0)))/len(embedding) AS mse FROM embeddings) SELECT vec_id, round(CASE WHEN mse>0 THEN 1e1*log10(1e0/mse) END,6) AS psnr FROM q")
def _(spark, sf):
    x = F.transform("embedding", lambda v: v.cast("double"))
    quantised = F.transform("embedding", lambda v: F.floor(v.cast("double") * 8) / F.lit(8.0))
    return table(spark, sf, "embeddings").select("vec_id", F.round(extra.psnr(x, quantised, 1.0), 6).alias("psnr"))


@query("R25_condition_vectors", "SELECT g.condition, image_idx, round(score,9) AS score, CAST(k AS DOUBLE)/4e0 AS severity FROM grid g")
def _(spark, sf):
    g = grid(spark, sf)
    vector = g.select("condition", "k").distinct().select("condition", F.array(F.col("k") / F.lit(4.0), F.lit(0.0)).alias("v"))
    return g.join(F.broadcast(vector), "condition").select("condition", "image_idx", F.round("score", 9).alias("score"), F.col("v")[0].alias("severity"))


@query("R26_pass_rules", f"SELECT condition, auc>=75e-2 AS passed FROM ({_AUC.format('condition', 'grid', 'label', 'score')})")
def _(spark, sf):
    return metrics.roc_auc(grid(spark, sf), ["condition"]).select("condition", (F.col("auc") >= 0.75).alias("passed"))


@query("R27_metadata_harvest", "SELECT row_id FROM manifest WHERE source='src1' AND height>width AND path<>''")
def _(spark, sf):
    return manifest(spark, sf).filter((F.col("source") == "src1") & (F.col("height") > F.col("width")) & (F.col("path") != "")).select("row_id")


@query("R28_normalised_sidecar", "SELECT row_id, label, CAST(round_even(width*least(1e0,512e0/least(width,height)),0) AS INTEGER) AS w, content_sha256 AS digest FROM manifest")
def _(spark, sf):
    return manifest(spark, sf).select("row_id", "label", fs.capped_dims(F.col("width"), F.col("height"))["w"].alias("w"), F.col("content_sha256").alias("digest"))


@query("R29_unused_ids", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id")

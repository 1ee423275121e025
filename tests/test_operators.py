"""Answer-known fixtures: ties, one-class groups, refusals, caps and splits."""

import random

import pytest
from pyspark.sql import functions as F

from quillmark.functions import scalars as fs
from quillmark.functions.hashing import drawn, threshold
from quillmark.operators import bootstrap, calibration, controls, fusion, joins, metrics, registry, report, sampling, vectors
from quillmark.sources import manifests


def scores(spark, y, s):
    return spark.createDataFrame(list(zip(y, map(float, s), strict=True)), "label int, score double")


def one(df):
    return tuple(df.first())


def test_auc_with_ties_and_classes(spark):
    assert one(metrics.roc_auc(scores(spark, [0, 1, 0, 1], [1, 1, 1, 1]), []))[0] == 0.5
    assert one(metrics.roc_auc(scores(spark, [0, 0, 1, 1], [1, 2, 2, 3]), []))[0] == pytest.approx(0.875)
    assert one(metrics.roc_auc(scores(spark, [1, 1], [1, 2]), []))[0] is None
    r = random.Random(1)
    y, s = [r.randrange(2) for _ in range(300)], [r.randrange(20) for _ in range(300)]
    won = sum((a > b) + 0.5 * (a == b) for a, p in zip(s, y, strict=True) for b, q in zip(s, y, strict=True) if p and not q)
    assert one(metrics.roc_auc(scores(spark, y, s), []))[0] == pytest.approx(won / (sum(y) * (300 - sum(y))))
    assert one(metrics.roc_auc(scores(spark, y, [x**3 for x in s]), []))[0] == pytest.approx(won / (sum(y) * (300 - sum(y))))


def test_threshold_at_fpr(spark):
    df = scores(spark, [0, 1, 0, 0], [0.6, 0.9, 0.3, 0.5])
    assert one(metrics.tpr_at_fpr(df, [], fpr=1 / 3)) == (0.6, 1.0)
    assert one(metrics.tpr_at_fpr(scores(spark, [0, 1], [2, 1]), [], fpr=0.0)) == (3.0, 0.0)


def test_two_tpr_definitions_differ(spark):
    y, s = [0] * 10 + [1] * 4, [1] * 5 + [5] * 5 + [5, 5, 5, 6]
    df = scores(spark, y, s)
    assert one(metrics.tpr_at_fpr(df, [], fpr=0.5))[1] == 1.0
    assert one(metrics.tpr_neg_quantile(df, [], fpr=0.5))[1] == 0.25


def test_best_accuracy_takes_the_lowest_threshold(spark):
    assert one(metrics.best_accuracy(scores(spark, [0, 1], [2, 1]), [])) == (1.0, 0.5)
    assert one(metrics.best_accuracy(scores(spark, [0, 0, 1, 1], [1, 2, 3, 4]), [])) == (3.0, 1.0)


def test_calibration_and_risk(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 1.0), (1, 0.5), (0, 0.5)], "label int, p double")
    assert one(metrics.ece(df, []))[0] == pytest.approx(0.0)
    assert df.agg(metrics.brier(F.col("label"), F.col("p"))).first()[0] == pytest.approx(0.125)
    rows = spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.8), (3, 1, 0.7)], "row_id int, ok int, conf double")
    curve = [(r.row_id, round(r.coverage, 3), round(r.risk, 3)) for r in metrics.risk_coverage(rows, [], "ok", "conf", "row_id").orderBy("coverage").collect()]
    assert curve == [(1, 0.333, 0.0), (2, 0.667, 0.5), (3, 1.0, 0.333)]


def test_join_refusals(spark):
    a = spark.createDataFrame([("x", 0, 1.0), ("y", 1, 2.0)], "path string, label int, s double")
    ok = joins.join_scored([a, a], ["a", "b"], "path", "s", ["label"])
    assert sorted(map(tuple, ok.collect())) == [("x", 0, 1.0, 1.0), ("y", 1, 2.0, 2.0)]
    for bad, why in ((a.limit(1), "missing"), (a.union(a), "duplicate"), (a.withColumn("label", F.lit(1)), "disagreeing")):
        with pytest.raises(joins.Refused, match=why):
            joins.join_scored([a, bad], ["a", "b"], "path", "s", ["label"])


def test_banded_hamming_equals_exact(spark):
    r = random.Random(3)
    base = [r.getrandbits(63) for _ in range(30)]
    cands = [(i, base[i % 30] ^ sum(1 << b for b in r.sample(range(63), r.randrange(8)))) for i in range(120)]
    c = spark.createDataFrame(cands, "cand long, hash long")
    d = spark.createDataFrame(list(enumerate(base)), "demo long, demo_hash long")
    for k in (0, 4, 5):
        exact = sorted((x.cand, x.demo) for x in joins.hamming_exact(c, d, k).collect())
        assert sorted((x.cand, x.demo) for x in joins.hamming_join(c, d, k).collect()) == exact
        assert exact == sorted((i, j) for i, h in cands for j, g in enumerate(base) if bin(h ^ g).count("1") <= k)


def test_caps(spark):
    df = spark.createDataFrame([(f"{g}{i}", g) for g, n in (("a", 9), ("b", 5), ("c", 2)) for i in range(n)], "path string, generator string")
    got = {r[0]: r[1] for r in sampling.cap_by_map(df, "generator", {"*": 3, "a": 0}, "path").groupBy("generator").count().collect()}
    assert got == {"a": 9, "b": 3, "c": 2}
    with pytest.raises(ValueError, match="unknown"):
        sampling.cap_by_map(df, "generator", {"zz": 1}, "path")


def test_group_split_never_straddles(spark):
    rows = [(i, f"p{i // 2}", "held" if i % 40 == 0 else "g") for i in range(400)]
    df = sampling.assign_splits(spark.createDataFrame(rows, "row_id int, image string, generator string"), ["held"], 0.2, "image")
    assert controls.straddling(df, "image").count() == 0
    assert df.filter("generator = 'held' and split <> 'heldout_generator'").count() == 0
    assert 0.1 < df.filter("split = 'val_internal'").count() / 400 < 0.3


def test_matched_strata(spark):
    sizes = {100: (7, 3), 200: (2, 9), 300: (5, 5), 400: (11, 0), 500: (0, 6)}
    rows = [(f"{s}-{y}-{i}", y, s) for s, n in sizes.items() for y in (0, 1) for i in range(n[y])]
    out = sampling.balance_within(spark.createDataFrame(rows, "path string, label int, short int"), ["short"], "label", "path")
    assert out.count() == 20 and out.filter("label = 1").count() == 10


def test_allocation_and_shards(spark):
    assert sampling.water_fill({"a": 2, "b": 10, "c": 10}, 12) == {"a": 2, "b": 5, "c": 5}
    assert sampling.apportion(10, {"x": 1, "y": 1, "z": 1}) == {"x": 4, "y": 3, "z": 3}
    got = [r[1] for r in sampling.shards(spark.range(10).withColumnRenamed("id", "row_id"), 3).groupBy("shard").count().orderBy("shard").collect()]
    assert got == [4, 3, 3]


def test_fusion_guards(spark):
    df = spark.createDataFrame([("c", 1.0), ("c", 1.0), ("d", 2.0), ("d", 4.0)], "condition string, score double")
    z = fusion.zscore(df, "score", ["condition"], F.lit(True)).orderBy("condition", "z").collect()
    assert [r.z for r in z] == [0.0, 0.0, -1.0, 1.0]
    with pytest.raises(joins.Refused, match="population"):
        fusion.fuse(df, ["score"], [1.0], None)
    with pytest.raises(joins.Refused, match="fit population"):
        fusion.zscore(df, "score", ["condition"], F.col("condition") == "c")
    assert len(fusion.simplex(3, 10)) == 66


def test_rules(spark):
    z = F.array(F.lit(1.0), F.lit(-3.0), F.lit(2.0))
    p = F.array(F.lit(0.5), F.lit(0.5), F.lit(0.5))
    r = spark.range(1).select(*[c.alias(n) for n, c in fusion.rules(z, p, p).items()]).first()
    assert (r["median"], r["max"], r["min"], r["most_confident"], r["noisy_or"], r["trimmed_mean"]) == (1.0, 2.0, -3.0, -3.0, 0.875, 1.0)


def test_temperature(spark):
    r = random.Random(2)
    rows = []
    for _ in range(4000):
        x = r.gauss(0, 2)
        rows.append((int(r.random() < 1 / (1 + pow(2.718281828, -x))), 3.0 * x))
    assert calibration.global_temperature(spark.createDataFrame(rows, "label int, logit double")) == pytest.approx(3.0, rel=0.15)
    with pytest.raises(joins.Refused):
        calibration.check_fit_split(spark.createDataFrame([("train",)], "split string"))


def test_bootstrap_interval_covers(spark):
    r = random.Random(6)
    rows = [(str(i), i % 2, r.gauss(i % 2, 1), r.gauss(0, 1)) for i in range(600)]
    reps = bootstrap.auc_replicates(spark.createDataFrame(rows, "path string, label int, a double, b double"), ["a", "b"], "label", "path", 60).cache()
    ci = {x.arm: (x.lo, x.hi) for x in bootstrap.interval(reps, ["arm"], "auc").collect()}
    assert ci["a"][0] < 0.76 < ci["a"][1] and ci["b"][0] < 0.5 < ci["b"][1]
    d = bootstrap.paired_difference(reps, "a").first()
    assert d.excludes_zero and d["diff"] < 0


def test_mahalanobis(spark):
    import numpy as np

    g = np.random.default_rng(0)
    x = np.concatenate([g.normal(0, 1, (60, 3)), g.normal(4, 1, (60, 3))])
    df = spark.createDataFrame([(i // 60, [float(v) for v in row]) for i, row in enumerate(x)], "label int, v array<double>")
    groups, means, white = vectors.gaussian_fit(df, "label", "v", 3, ridge=0.0)
    assert groups == [0, 1] and np.allclose(means, [x[:60].mean(0), x[60:].mean(0)])
    within = sum((x[k : k + 60] - x[k : k + 60].mean(0)).T @ (x[k : k + 60] - x[k : k + 60].mean(0)) for k in (0, 60)) / 120
    want = min((x[0] - m) @ np.linalg.inv(within) @ (x[0] - m) for m in means)
    got = vectors.mahalanobis(df.withColumn("i", F.monotonically_increasing_id()), "v", means, white, ["i"])
    assert got.orderBy("i").first().distance == pytest.approx(want)


def test_confound_directions_leave_nothing(spark):
    import numpy as np

    from quillmark.operators.models import remove_direction

    g = np.random.default_rng(4)
    y = g.integers(0, 2, 300)
    x = g.normal(size=(300, 4)) + y[:, None] * np.array([2.0, 0.0, 1.0, 0.0])
    df = spark.createDataFrame([(int(a), [float(v) for v in row]) for a, row in zip(y, x, strict=True)], "c int, v array<double>")
    out = np.array([r.v for r in remove_direction(df, "v", "c", 2, 4).collect()])
    assert np.linalg.matrix_rank(out, tol=1e-8) == 2
    gap = lambda z: np.abs(z[y == 1].mean(0) - z[y == 0].mean(0)).max()
    assert gap(out) < 0.1 * gap(x)


def test_running_sums_over_blocks(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), round(r.random(), r.choice([1, 4])), r.randint(0, 3)) for _ in range(3000)]
    cells = spark.createDataFrame(rows, "g string, s double, n int").groupBy("g", "s").agg(F.sum("n").alias("n"))
    for x in metrics.running(cells, ["g"], "s", ["n"]).collect():
        own = [c for g, s, c in rows if g == x.g and s < x.s]
        assert x.n_below == sum(own) and x.n_all == sum(c for g, _, c in rows if g == x.g)


def test_bootstrap_draws_equal_brute_force(spark):
    import numpy as np

    from quillmark.operators import extra

    r = random.Random(6)
    rows = [(f"p{i}", r.randrange(2), r.randrange(12) / 4, r.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "path string, label int, a double, b double")
    got = {(x.arm, x.replicate): x.auc for x in extra.auc_draws(extra.stacked(df, ["a", "b"], "label", "path"), 20).collect()}
    keys = [x.k for x in df.select(F.xxhash64("path").alias("k"), "path").orderBy(F.expr("cast(substr(path, 2) as int)")).collect()]
    w = extra._weights(np.array(keys), 20)
    for arm in (2, 3):
        s, y = np.array([x[arm] for x in rows]), np.array([x[1] for x in rows])
        for rep in range(20):
            p, n = w[:, rep] * (y == 1), w[:, rep] * (y == 0)
            won = sum(pi * (n[s < si].sum() + 0.5 * n[s == si].sum()) for pi, si in zip(p, s, strict=True) if pi)
            assert got["ab"[arm - 2], rep + 1] == pytest.approx(won / p.sum() / n.sum())
    assert abs(w.mean() - 1) < 0.05 and abs(w.var() - 1) < 0.1


def test_extra_guards_and_labels(spark):
    from quillmark.operators import extra

    assert (extra.fpr_label(0.005), extra.tpr_column(0.01)) == ("0.5%", "tpr_at_1pct")
    with pytest.raises(joins.Refused):
        extra.check_views({"v": [("jpeg", 70.0)]}, {"jpeg": (65.0, 75.0)})
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("", 0)], "generator string, label int")
    assert extra.without_generators(rows, ["a"]).count() == 2
    for names in (["zz"], ["a", "b"]):
        with pytest.raises(joins.Refused):
            extra.without_generators(rows, names)
    a = spark.createDataFrame([(1, 0), (2, 1)], "row_id int, label int")
    with pytest.raises(joins.Refused):
        extra.positional(a, a.withColumn("label", F.lit(1)).withColumn("s", F.lit(0.5)), "row_id", ["label"])
    with pytest.raises(joins.Refused):
        extra.positional(a, a.limit(1).withColumn("s", F.lit(0.5)), "row_id", ["label"])
    names = spark.createDataFrame([("Sd-XL.csv",), ("nope",)], "name string")
    aliases = spark.createDataFrame([("sd_xl", ["sdxl"])], "subset string, aliases array<string>")
    with pytest.raises(joins.Refused):
        extra.resolve_aliases(names, aliases)
    assert extra.resolve_aliases(names.limit(1), aliases).first().subset == "sd_xl"
    keys = spark.createDataFrame([("1024",), ("x",), ("128",), ("200",)], "k string")
    assert [x.k for x in keys.orderBy(*extra.numeric_order(F.col("k"))).collect()] == ["128", "200", "1024", "x"]
    assert extra.identity_column(a.withColumn("path", F.lit("p"))) == "row_id" and extra.identity_column(a.select(F.lit("p").alias("path"))) is None


def test_banks(spark, tmp_path):
    from quillmark.sources import datasets as ds

    rows = spark.range(10).select(F.col("id").alias("row_id"), F.array(F.col("id").cast("double")).alias("v"))
    one, two = f"file://{tmp_path}/one", f"file://{tmp_path}/two"
    ds.write_bank(rows.filter("row_id < 4"), one, {"dim": 1})
    ds.write_bank(rows, one, {"dim": 1})
    assert sorted(r.row_id for r in ds.read_bank(spark, one).collect()) == list(range(10))
    assert sum(ds.read_bank(spark, one, s).count() for s in range(16)) == 10
    with pytest.raises(joins.Refused):
        ds.write_bank(rows, one, {"dim": 2})
    ds.write_bank(rows.filter("row_id > 7"), two, {"dim": 1})
    with pytest.raises(joins.Refused):
        ds.merge_banks(spark, [one, two])
    assert ds.comparable([{"a": 1, "b": 2}, {"a": 1, "b": 3}], ["a", "b"]) == ["b"]
    with pytest.raises(joins.Refused):
        ds.fused_identity([{"manifest": 1}, {"manifest": 2}], [1.0, 1.0])


def test_manifest_problems(spark):
    rows = [("/a", 0, "", "train", ""), ("/a", 2, "g", "nope", "zz"), ("b", 1, "", "train", "0" * 64)]
    got = controls.manifest_problems(spark.createDataFrame(rows, "path string, label int, generator string, split string, content_sha256 string"), ["train"]).first().asDict()
    assert got == dict(bad_label=1, bad_split=1, relative_path=1, fake_without_generator=1, real_with_generator=0, bad_digest=1, digest_missing=1, duplicate_path=1)


def test_scalars(spark):
    df = spark.createDataFrame([("['jpeg', 'blur']", "<s> The image shows a  red cat"), ("[]", "x"), ("oops", "")], "d string, t string")
    got = df.select(fs.list_literal(F.col("d")).alias("l"), fs.clean_caption(F.col("t")).alias("c"), fs.token_group(fs.list_literal(F.col("d")), ["blur", "jpeg"]).alias("g")).collect()
    assert [(r.l, r.c, r.g) for r in got] == [(["jpeg", "blur"], "A red cat", "blur"), ([], "X", "clean"), (None, "", "clean")]
    assert threshold(0.5) == "80000000"
    n = spark.range(2000).filter(drawn(0.25, 1, F.col("id"))).count()
    assert 400 < n < 600
    with pytest.raises(Exception, match="outside"):
        df.select(fs.relative_path(F.lit("/x/y"), "/z")).collect()


def test_registry_refuses(spark):
    df = spark.createDataFrame([("nowhere", "en")], "source string, lang string")
    with pytest.raises(Exception, match="unknown source"):
        registry.classify(df, registry.demo_registry(spark), "source", "lang").select("label").collect()
    with pytest.raises(joins.Refused):
        registry.without_prefixes(df, "source", ["/none/"])
    with pytest.raises(joins.Refused):
        registry.select_splits(df.withColumn("split", F.lit("a")), ["b"])


def test_sources(spark, tmp_path):
    m = manifests.conform(spark.createDataFrame([("/a", 1)], "path string, label int"))
    assert m.columns == [f.name for f in manifests.MANIFEST]
    manifests.write_manifest(m, str(tmp_path / "m"))
    with pytest.raises(Exception, match="exists"):
        manifests.write_manifest(m, str(tmp_path / "m"))
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.PNG").write_bytes(b"x")
    (tmp_path / "img" / "b.txt").write_bytes(b"x")
    assert manifests.scan_images(spark, str(tmp_path / "img")).count() == 1
    (tmp_path / "l.jsonl").write_text('{"a": "by"}\n{"a": "cc0", "b": "by"}\n')
    assert {r.name: r.licence for r in manifests.read_licences(spark, str(tmp_path / "l.jsonl")).collect()} == {"a": "cc0", "b": "by"}
    with pytest.raises(joins.Refused):
        manifests.merge_shards([m, m], "path")


def test_streaming_append_is_idempotent(spark, tmp_path):
    from quillmark.streaming.resume import append_new

    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.range(5).write.parquet(src)
    for k in range(2):
        append_new(spark.readStream.schema("id long").parquet(src), out, "id", str(tmp_path / f"cp{k}")).awaitTermination()
    assert spark.read.parquet(out).count() == 5


def test_selection_and_errors(spark):
    g = spark.createDataFrame([("clean", 0, 0.1, "s"), ("clean", 1, 0.9, "s"), ("jpeg", 0, 0.8, "t"), ("jpeg", 1, 0.2, "t")], "condition string, label int, score double, source string")
    assert report.clean_threshold(g) == 0.9
    assert report.top_errors(g, 1, "fp", ["condition"]).first().score == 0.8
    assert {r.source: r.fp_rate for r in report.fp_rate_by_source(g, 0.5).collect()} == {"s": 0.0, "t": 1.0}
    with pytest.raises(ValueError):
        report.top_errors(g, 1, "xx", [])
    assert report.to_markdown(g.limit(1)).count("|") == 15


def test_captions_of_pages_equal_their_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as e

    letters = [*range(0x20, 0x600), *range(0x1C80, 0x2100), *range(0xA640, 0xA7FF), *range(0xFB00, 0xFB20), *range(0x10D40, 0x10D90)]
    html = [f"<b>{chr(c)}</b>{chr(c)}tail {chr(c)} " for c in letters] + ["<p> In this image a ", "The image shows x", "\u00a0\u3000nbsp\u2003", "", "<a>\n</a>", None]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = dict(con.execute(e.oracle_sql()["P23_clean_caption"]).fetchall())
    got = {r.page_id: r.caption for r in e.queries()["P23_clean_caption"](spark, str(tmp_path)).collect()}
    assert {k: (got.get(k), v) for k, v in want.items() if got.get(k) != v} == {} and len(got) == len(html)


def test_list_files_takes_a_table_of_parts_as_one_entry(spark, tmp_path):
    from quillmark.sources import datasets as ds

    root = tmp_path / "raw data"
    for p in ("a.parquet", "b.parquet/part-0.parquet", "b.parquet/part-1.parquet", "sub/c.parquet/k=1/part-0.parquet", "sub/d.PARQUET", "sub/e.txt", "b.parquet/notes.txt"):
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text("x")
    got = [(r.path.split("raw data/")[1], r.name) for r in ds.list_files(spark, str(root), (".parquet",)).collect()]
    assert got == [("a.parquet", "a.parquet"), ("b.parquet", "b.parquet"), ("sub/c.parquet", "c.parquet"), ("sub/d.PARQUET", "d.PARQUET")]
    assert [r.name for r in ds.list_files(spark, f"{root}/b.parquet/", (".parquet",)).collect()] == ["part-0.parquet", "part-1.parquet"]

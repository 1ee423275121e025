"""Image kernels on 8 x 8 grey images made of the embeddings, against cell formulas in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import kernels
from quillmark.plans.registry import query
from quillmark.plans.views import table

_IMG = ", img AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(least(255, greatest(0, floor(CAST(x AS DOUBLE)*64)+128)) AS INTEGER)) AS v FROM embeddings)"


def images(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, pixels, height, width): component i is the grey pixel of row i / 8."""
    level = F.transform("embedding", lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(x.cast("double") * 64) + 128)).cast("int"))
    text = F.array_join(F.transform(level, lambda v: F.repeat(F.lpad(F.hex(v), 2, "0"), 3)), "")
    return table(spark, sf, "embeddings").select("vec_id", F.unhex(text).alias("pixels"), F.lit(8).alias("height"), F.lit(8).alias("width"))


def levels(df: DataFrame) -> DataFrame:
    """(vec_id, pix): the first channel as text."""
    text = F.hex("pixels")
    one = F.transform(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1), lambda i: F.conv(F.substring(text, i * 6 + 1, F.lit(2)), 16, 10))
    return df.select("vec_id", F.array_join(one, ",").alias("pix"))


def _cells(expression: str) -> str:
    return f"{_IMG} SELECT vec_id, array_to_string(list_transform(range(64), lambda i: CAST({expression} AS INTEGER)), ',') AS pix FROM img"


def _kernel(name: str, ops: list[tuple[str, dict]], expression: str) -> None:
    @query(name, _cells(expression))
    def _(spark, sf):
        return levels(kernels.apply_ops(images(spark, sf), "vec_id", ops))


_BRIGHT = "least(255, round_even(v[i+1]*125e-2, 0))"
_SMALL = "round_even((v[1+(i//16)*16+((i%8)//2)*2]+v[2+(i//16)*16+((i%8)//2)*2]+v[9+(i//16)*16+((i%8)//2)*2]+v[10+(i//16)*16+((i%8)//2)*2])/4e0, 0)"
_LEFT, _RIGHT = "v[1+(i//8)*8+greatest(i%8-1,0)]", "v[1+(i//8)*8+least(i%8+1,7)]"
_TAPS = {-1: "(exp(-8e0)/(1e0+2e0*exp(-8e0)))", 0: "(1e0/(1e0+2e0*exp(-8e0)))", 1: "(exp(-8e0)/(1e0+2e0*exp(-8e0)))"}
_BLUR = "round_even(" + "+".join(f"v[1+least(greatest(i//8+({y}),0),7)*8+least(greatest(i%8+({x}),0),7)]*{_TAPS[y]}*{_TAPS[x]}" for y in _TAPS for x in _TAPS) + ", 0)"

_kernel("I02_gaussian_blur", [("blur", {"sigma": 0.25})], _BLUR)
_kernel("I05_jitter", [("jitter", {"b": 1.25, "c": 1.0, "s": 0.5})], _BRIGHT)
_kernel("I06_center_crop", [("center_crop", {"share": 0.5})], "v[1+(2+i//16)*8+2+(i%8)//2]")
_kernel("I08_motion_blur", [("motion_blur", {"length": 3, "angle": 0.0})], f"round_even(({_LEFT}+v[i+1]+{_RIGHT})/3e0, 0)")
_kernel("I09_pixelate", [("pixelate", {"block": 2})], _SMALL)
_kernel("I11_tone_curve", [("tone_curve", {"low": 0.25, "high": 0.75})], "v[i+1]")
_kernel("I12_brightness", [("brightness", {"factor": 1.25})], _BRIGHT)
_kernel("I12_quantize", [("quantize", {"bits": 3})], "v[i+1]-v[i+1]%32")
_kernel("I15_Z04_recipe", [("quantize", {"bits": 3}), ("dihedral", {"k": 4})], "v[1+(i//8)*8+7-i%8]-v[1+(i//8)*8+7-i%8]%32")
_kernel("I18_mirrored", [("dihedral", {"k": 4})], "v[1+(i//8)*8+7-i%8]")
_kernel("I18_turned", [("dihedral", {"k": 1})], "v[1+(i%8)*8+7-i//8]")


@query("I04_I10_seeded_noise", _IMG + " SELECT vec_id, true AS same, true AS within FROM img")
def _(spark, sf):
    """Noise depends on the row's key alone: two runs over other partitions agree."""
    i = images(spark, sf)
    ops = [("noise", {"sigma": 4.0}), ("impulse", {"share": 0.1})]
    one, two = levels(kernels.apply_ops(i, "vec_id", ops)), levels(kernels.apply_ops(i.repartition(5), "vec_id", ops)).withColumnRenamed("pix", "again")
    parts = F.split("pix", ",")
    return one.join(two, "vec_id").select("vec_id", (F.col("pix") == F.col("again")).alias("same"), F.forall(parts, lambda x: x.cast("int").between(0, 255)).alias("within"))


@query("I21_laplacian_variance", _IMG + """, l AS (SELECT vec_id, list_transform(range(36), lambda j: 1e0*(v[1+(j//6)*8+j%6+1]+v[1+(j//6+2)*8+j%6+1]+v[1+(j//6+1)*8+j%6]+v[1+(j//6+1)*8+j%6+2]-4*v[1+(j//6+1)*8+j%6+1])) AS l FROM img)
  SELECT vec_id, round(list_sum(list_transform(l, lambda x: x*x))/36e0-(list_sum(l)/36e0)*(list_sum(l)/36e0), 4) AS value FROM l""")
def _(spark, sf):
    return kernels.features(images(spark, sf), "vec_id").select("vec_id", F.round("laplacian_variance", 4).alias("value"))


@query("I22_neighbour_residual", _IMG + " SELECT vec_id, round(list_sum(list_transform(range(32), lambda j: 1e0*abs(v[2+(j//4)*8+(j%4)*2]-v[1+(j//4)*8+(j%4)*2])))/32e0, 6) AS value FROM img")
def _(spark, sf):
    return kernels.features(images(spark, sf), "vec_id").select("vec_id", F.round(F.col("residuals")[0], 6).alias("value"))


@query("I24_thumbnail", _IMG + " SELECT vec_id, CAST(768 AS INTEGER) AS size, round(12e0*list_sum(v)/255e0, 6) AS total FROM img")
def _(spark, sf):
    f = kernels.features(images(spark, sf), "vec_id")
    return f.select("vec_id", F.size("thumbnail").alias("size"), F.round(F.aggregate("thumbnail", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("I19_perceptual_hash", _IMG + " SELECT vec_id, true AS stable FROM img")
def _(spark, sf):
    """Equal images have equal hashes, whatever the partitioning."""
    i = images(spark, sf)
    a, b = kernels.features(i, "vec_id").select("vec_id", "phash"), kernels.features(i.repartition(3), "vec_id").select("vec_id", F.col("phash").alias("again"))
    return a.join(b, "vec_id").select("vec_id", (F.col("phash") == F.col("again")).alias("stable"))


@query("I26_windows", "SELECT row_id, w.i AS cell, CAST((w.i%3)*(width//3) AS INTEGER) AS l, CAST((w.i//3)*(height//3) AS INTEGER) AS t FROM (SELECT d.doc_id AS row_id, CAST(d.n_chars AS INTEGER) AS width, CAST(d.n_chars%977+64 AS INTEGER) AS height FROM documents d JOIN labels USING (doc_id)) m CROSS JOIN (SELECT CAST(unnest(range(9)) AS INTEGER) AS i) w")
def _(spark, sf):
    from quillmark.plans.views import manifest

    m = manifest(spark, sf).select("row_id", "width", "height", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("cell"))
    return m.select("row_id", "cell", ((F.col("cell") % 3) * F.floor(F.col("width") / 3)).cast("int").alias("l"), (F.floor(F.col("cell") / 3) * F.floor(F.col("height") / 3)).cast("int").alias("t"))

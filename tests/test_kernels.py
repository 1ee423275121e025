"""Image kernels on synthetic images."""

import numpy as np
import pytest

from quillmark.functions import kernels as k


def image(seed, h=48, w=64):
    r = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    base = np.stack([128 + 80 * np.sin(x / r.uniform(4, 12) + c) * np.cos(y / r.uniform(4, 12)) for c in range(3)], axis=2)
    return np.clip(base, 0, 255).astype(np.uint8)


def test_shapes_and_bounds():
    img = image(1)
    params = {"blur": {"sigma": 1.2}, "motion_blur": {"length": 5, "angle": 30.0}, "noise": {"sigma": 9.0}, "impulse": {"share": 0.1}, "brightness": {"factor": 1.4}, "contrast": {"factor": 0.5}, "saturation": {"factor": 0.0}, "jitter": {"b": 1.1, "c": 0.9, "s": 1.2}, "quantize": {"bits": 3}, "tone_curve": {"low": 0.1, "high": 0.9}, "pixelate": {"block": 8}, "resize_roundtrip": {"scale": 0.5}, "center_crop": {"share": 0.6}, "dihedral": {"k": 4}}
    assert set(params) == set(k.OPS)
    for name, (f, random) in k.OPS.items():
        out = f(img, **params[name], rng=np.random.default_rng(3)) if random else f(img, **params[name])
        assert out.dtype == np.uint8 and out.shape == img.shape


def test_known_answers():
    flat = np.full((20, 20, 3), 77, np.uint8)
    assert (k.blur(flat, 2.0) == 77).all() and k.laplacian_variance(flat) == 0 and k.noise_floor(flat) == 0
    img = image(2)
    assert (k.dihedral(k.dihedral(img, 1), 3) == img).all() and (k.dihedral(k.dihedral(img, 4), 4) == img).all()
    assert len({k.dihedral(img[:48, :48], i).tobytes() for i in range(8)}) == 8
    assert k.laplacian_variance(k.blur(img, 2)) < k.laplacian_variance(img)
    assert (k.resize(img, *img.shape[:2]) == img).all() and set(np.unique(k.quantize(img, 1))) <= {0, 128}
    assert (k.tone_curve(img, 0.25, 0.75) == img).all()
    dot = np.zeros((21, 21, 3), np.uint8)
    dot[10, 10] = 250
    assert (k.motion_blur(dot, 5, 0.0)[10, 8:13] == 50).all() and (k.motion_blur(dot, 5, 90.0)[8:13, 10] == 50).all()
    noisy = np.clip(128 + 10 * np.random.default_rng(0).normal(size=(200, 200, 1)).repeat(3, axis=2), 0, 255).astype(np.uint8)
    assert 7 < k.noise_floor(noisy) < 11
    assert np.ptp(k.saturation(img, 0.0).astype(int), axis=2).max() == 0


@pytest.mark.parametrize("seed", range(8))
def test_phash_is_stable_under_small_changes(seed):
    img = image(seed)
    h = k.phash(img)
    near = bin((h ^ k.phash(k.noise(img, 2.0, np.random.default_rng(0)))) & (2**64 - 1)).count("1")
    far = bin((h ^ k.phash(image(seed + 100))) & (2**64 - 1)).count("1")
    assert near <= 8 < far


def test_on_spark(spark):
    rows = [(i, image(i).tobytes(), 48, 64) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, pixels binary, height int, width int")
    a = {r.id: bytes(r.pixels) for r in k.apply_ops(df, "id", [("noise", {"sigma": 5.0}), ("blur", {"sigma": 1.0})]).collect()}
    b = {r.id: bytes(r.pixels) for r in k.apply_ops(df.repartition(3), "id", [("noise", {"sigma": 5.0}), ("blur", {"sigma": 1.0})]).collect()}
    assert a == b and len(a) == 6
    f = k.features(df, "id").collect()
    assert {r.id: r.phash for r in f} == {i: k.phash(image(i)) for i in range(6)} and len(f[0].thumbnail) == 768

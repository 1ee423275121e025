"""Column functions over paths, sizes, tokens, captions and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Short sides that image pipelines produce on purpose.
CANONICAL_SIDES = (224, 256, 299, 320, 336, 384, 392, 448, 512, 518, 600, 640, 768, 800, 1024, 2048)
#: Openers that captioning models put before a description.
CAPTION_OPENERS = ("The image shows ", "The image is ", "The image depicts ", "This image shows ", "In this image ")
#: Letters whose upper case is several characters, and the single capital of those that have one.
_SINGLE_CAPITALS = ("ßᾀᾁᾂᾃᾄᾅᾆᾇᾐᾑᾒᾓᾔᾕᾖᾗᾠᾡᾢᾣᾤᾥᾦᾧᾳῃῳ", "ẞᾈᾉᾊᾋᾌᾍᾎᾏᾘᾙᾚᾛᾜᾝᾞᾟᾨᾩᾪᾫᾬᾭᾮᾯᾼῌῼ")
#: Letters that got a capital with Unicode 16; engines disagree on them, so they stay.
_NEW_PAIRS = ("\u019b", "\u0264", "\u1c8a", "\ua7cd", "\ua7db", *map(chr, range(0x10D70, 0x10D86)))


def segments(path: Column) -> Column:
    """Path segments without empty ones and dots."""
    return F.filter(F.split(path, r"[/\\]+"), lambda s: ~s.isin("", "."))


def tail_key(path: Column, n: int = 3) -> Column:
    """The last ``n`` segments, lower-cased and joined."""
    s = segments(path)
    return F.lower(F.array_join(F.slice(s, F.greatest(F.size(s) - n + 1, F.lit(1)), F.lit(n)), "/"))


def contains_marker(path: Column, marker: str) -> Column:
    """Whether ``marker`` occurs as whole segments of the path."""
    return F.locate(f"/{marker.lower()}/", F.concat(F.lit("/"), F.lower(F.array_join(segments(path), "/")), F.lit("/"))) > 0


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root``; an error for a path outside it."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 30)).otherwise(F.raise_error(F.concat(F.lit(f"outside {base}: "), path)).cast("string"))


def dest_filename(path: Column) -> Column:
    """Stable file name: the first 16 hex digits of the path's SHA-1, and its suffix."""
    return F.concat(F.substring(F.sha1(path), 1, 16), F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)))


def safe_name(name: Column) -> Column:
    """Whether an untrusted name can be a path segment."""
    return ~name.rlike(r"[/\\]") & ~name.rlike(r"^\.*$")


def replace_prefix(path: Column, old: str, new: str) -> Column:
    return F.when(path.startswith(old), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 30))).otherwise(path)


def short_side(w: Column, h: Column) -> Column:
    return F.least(w, h)


def dimensions(w: Column, h: Column) -> Column:
    return F.concat_ws("x", w.cast("string"), h.cast("string"))


def binned(value: Column, edges: list[int]) -> Column:
    """Label of the half-open bin [lo, hi) that holds the value."""
    out = F.when(value < edges[0], F.lit(f"<{edges[0]}"))
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        out = out.when(value < hi, F.lit(f"[{lo},{hi})"))
    return out.otherwise(F.lit(f">={edges[-1]}"))


def disjoint_bucket(value: Column, ranges: list[tuple[int, int]]) -> Column:
    """Name of the closed range that holds the value; null outside all of them."""
    return F.coalesce(*[F.when(value.between(lo, hi), F.lit(f"{lo}-{hi}")) for lo, hi in ranges])


def resolution_features(w: Column, h: Column) -> list[Column]:
    """log2 of width, height, short and long side and area, aspect, canonical flag."""
    lo, hi = F.least(w, h), F.greatest(w, h)
    return [
        F.log2(w).alias("log2_w"), F.log2(h).alias("log2_h"), F.log2(lo).alias("log2_short"), F.log2(hi).alias("log2_long"),
        F.log2(w.cast("double") * h).alias("log2_area"), (hi.cast("double") / lo).alias("aspect"), lo.isin(*CANONICAL_SIDES).cast("int").alias("canonical_side"),
    ]


def crop_box(w: Column, h: Column, mcu: int, max_side: int) -> Column:
    """Centred crop (l, t, r, b), its corner on the MCU grid, sides multiples of it."""

    def span(size: Column) -> tuple[Column, Column]:
        side = F.least(size, F.lit(max_side))
        side = (side - F.pmod(side, F.lit(mcu))).cast("int")
        start = F.floor((size - side) / 2).cast("int")
        return (start - F.pmod(start, F.lit(mcu))).cast("int"), side

    (l, cw), (t, ch) = span(w), span(h)
    return F.struct(l.alias("l"), t.alias("t"), (l + cw).alias("r"), (t + ch).alias("b"))


def capped_dims(w: Column, h: Column, cap: int = 512) -> Column:
    """Size after the short side is brought down to ``cap``; never enlarged."""
    scale = F.least(F.lit(1.0), F.lit(float(cap)) / F.least(w, h))
    return F.struct(F.rint(w * scale).cast("int").alias("w"), F.rint(h * scale).cast("int").alias("h"))


def list_literal(text: Column) -> Column:
    """Array of the tokens in a text such as "['jpeg', 'blur']"; null if malformed."""
    return F.from_json(F.regexp_replace(text, "'", '"'), "array<string>")


def token_group(tokens: Column, order: list[str], other: str = "other") -> Column:
    """The first of ``order`` among the tokens; 'clean' if there are none."""
    out = F.when(F.coalesce(F.size(tokens), F.lit(0)) <= 0, F.lit("clean"))
    for name in order:
        out = out.when(F.array_contains(tokens, name), F.lit(name))
    return out.otherwise(F.lit(other))


def upper_letter(letter: Column) -> Column:
    """Upper case of one character as one character: ß gives ẞ, and ŉ stays."""
    upper = F.upper(letter)
    return F.when((F.length(upper) == 1) & ~letter.isin(*_NEW_PAIRS), upper).otherwise(F.translate(letter, *_SINGLE_CAPITALS))


def clean_caption(text: Column, openers: tuple[str, ...] = CAPTION_OPENERS) -> Column:
    """Without tags and an opener, white space collapsed, first letter upper case."""
    trimmed = lambda c: F.regexp_replace(c, r"^\p{Zs}+|\p{Zs}+\z", "")
    body = trimmed(F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", ""), r"\s+", " "))
    if openers:
        body = trimmed(F.regexp_replace(body, "^(" + "|".join(openers) + ")", ""))
    return F.concat(upper_letter(F.substring(body, 1, 1)), F.substring(body, 2, 1 << 30))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(x, F.lit(30.0)), F.lit(-30.0))))


def logit(p: Column, eps: float = 1e-12) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return F.ln(q / (F.lit(1.0) - q))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sign_hash(vector: Column) -> Column:
    """64 sign bits of a vector as one long (bit i: component i above 0)."""
    return F.aggregate(
        F.zip_with(vector, F.sequence(F.lit(0), F.size(vector) - 1), lambda v, i: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"),
        lambda acc, x: acc.bitwiseOR(x),
    )


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)

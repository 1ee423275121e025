"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word there is exactly one token that can end its encoding. A
matching automaton yields, at each position, the tokens that are suffixes of the
prefix read so far; a token fits if it may follow the last token of the prefix before
it, which a pair test decides from the merge ranks alone. The chain of last tokens,
followed back from the end, is the encoding that greedy merging would give, found in
time linear in the word and without a merge queue, however long the word is.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillmark.llm.io import lean, ship

#: White space as the tokenizer's regular expressions have it.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The pieces of a word tokenizer's split pattern.
_PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^" + _WS + "\\p{L}\\p{N}]+"
#: Shift that marks a symbol as the last of its word.
_END = 0x1000
#: Entries of one generation of a lookup table; two generations are held.
_CACHE_LIMIT = 100_000
_PAIR_LIMIT = 200_000
#: Rows that are encoded at a time.
_ROWS = 128


def byte_symbols() -> dict[int, str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


Newer = tuple[str, dict[str, str]]


def newer_characters(raw: bytes) -> Newer:
    """Where the tokenizers library's character tables differ from ours: code points that
    the regex module calls letters or digits and the library doesn't, and the lower case
    of those that only the library lowers.

    Asked are code points that Python's own tables hold unassigned; all others agree.
    """
    key = hashlib.sha256(raw).hexdigest()
    if key not in _NEWER:
        import regex
        from tokenizers import Tokenizer

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        asked = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
        library = Tokenizer.from_str(raw.decode())
        # among marks a mark forms one piece with them, anything else a piece of its own
        pieces = library.pre_tokenizer.pre_tokenize_str("".join(f"!{c}! " for c in asked)) if asked and library.pre_tokenizer else []
        lowered = library.normalizer.normalize_str("!".join(asked)).split("!") if asked and library.normalizer else asked
        _NEWER[key] = "".join(asked[a // 4] for _, (a, b) in pieces if b - a == 3), {c: x for c, x in zip(asked, lowered, strict=True) if c != x}
    return _NEWER[key]


_NEWER: dict[str, Newer] = {}


class PrefixBPE:
    """A BPE vocabulary with merges, as a prefix-DP encoder.

    ``spec`` is the parsed JSON of a tokenizers file: BPE model with an
    end-of-word suffix, byte-level symbols, and NFC + white space + lower-case
    normalisation, or the parts of these that the file asks for. ``newer``: see
    :func:`newer_characters`.
    """

    def __init__(self, spec: dict, newer: Newer = ("", {})):
        import ahocorasick
        import regex

        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        size = max([*vocab.values(), *(a["id"] for a in spec.get("added_tokens", []))]) + 1
        self.tokens = [""] * size
        for text, i in vocab.items():
            self.tokens[i] = text
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.merged: dict[int, int] = {}
        symbols = [""] * size
        self.table = byte_symbols()
        for c in self.table.values():
            if c in vocab:
                symbols[vocab[c]] = c
            if suffix and c + suffix in vocab:
                symbols[vocab[c + suffix]] = chr(ord(c) + _END)
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            ia, ib, out = vocab[a], vocab[b], vocab[a + b]
            self.merged.setdefault(ia << 20 | ib, r)
            if not symbols[out]:
                self.rank[out], self.left[out], self.right[out] = r, ia, ib
                symbols[out] = symbols[ia] + symbols[ib]
        self.length = [len(s) for s in symbols]
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        alone = [False] * size
        for i in sorted(range(size), key=lambda i: self.rank[i]):
            if symbols[i]:
                alone[i] = self.rank[i] < 0 or (
                    alone[self.left[i]] and alone[self.right[i]] and self._fits(self.left[i], self.right[i], self.rank[i])
                )
                if alone[i]:
                    self.automaton.add_word(symbols[i], i)
        self.automaton.make_automaton()
        self.latin = {b: ord(c) for b, c in self.table.items()}
        self.end_shift = _END if suffix else 0
        steps = json.dumps(spec.get("normalizer") or {})
        self.nfc, self.lower = '"NFC"' in steps, "Lowercase" in steps
        self.pieces = regex.compile(_PIECES)
        marks, self.newer_lower = newer
        self.newer = None
        if marks or self.newer_lower:
            self.newer = frozenset(marks).union(self.newer_lower)  # a pattern of all of them takes 0.1 ms a word
            odd = "[" + regex.escape(marks or "!", special_only=False) + "]"
            own = _PIECES.replace("[\\p{L}]", f"[\\p{{L}}--{odd}]").replace("[\\p{N}]", f"[\\p{{N}}--{odd}]")
            head, rest = own.rsplit("|", 1)
            self.newer_pieces = regex.compile(f"{head}|(?:{rest[:-1]}|{odd})+", regex.V1)
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        for text, i in self.special.items():
            self.tokens[i] = text
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words: dict[str, tuple[int, ...]] = {}
        self.old_words: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[str, int, str]] = {}
        self.old_chunks: dict[str, tuple[str, int, str]] = {}

    def _fits(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge of rank below ``limit`` would cross the border of a and b."""
        rank, merged = self.rank, self.merged
        while True:
            r = merged.get(a << 20 | b)
            if r is not None and r < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # undo the later merge; what crosses must have come before it
                limit, a = ra, self.right[a]
            else:  # at equal rank the merge further left goes first
                limit, b = rb + 1, self.left[b]

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of one word (without white space, normalised)."""
        s = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.latin)
        if not s:
            return ()
        if self.end_shift:
            s = s[:-1] + chr(ord(s[-1]) + self.end_shift)
        last = [-1] * (len(s) + 1)
        pairs, length = self.pairs, self.length
        if len(pairs) > _PAIR_LIMIT:
            pairs.clear()
        for at, token in self.automaton.iter(s):  # the longest suffix first
            at += 1
            if last[at] >= 0:
                continue
            start = at - length[token]
            if start == 0:
                last[at] = token
            else:
                before = last[start]
                if before >= 0:
                    key = before << 20 | token
                    ok = pairs.get(key)
                    if ok is None:
                        ok = pairs[key] = self._fits(before, token, 1 << 40)
                    if ok:
                        last[at] = token
        out = []
        at = len(s)
        while at:
            out.append(last[at])
            at -= length[last[at]]
        return tuple(out[::-1])

    def encode_plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens in it."""
        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            # one character at a time: no final-sigma rule
            text = text.lower() if text.isascii() or "Σ" not in text else text.replace("Σ", "σ").lower()
        out: list[int] = []
        pieces = self.pieces
        if self.newer is not None and not text.isascii() and not self.newer.isdisjoint(text):
            pieces = self.newer_pieces
            text = text.translate(str.maketrans(self.newer_lower))
        for piece in pieces.findall(text):
            ids = self.words.get(piece)
            if ids is None:
                if len(self.words) > _CACHE_LIMIT:
                    self.words, self.old_words = {}, self.words
                ids = self.old_words.get(piece)
                if ids is None:
                    ids = self.encode_word(piece)
                if len(piece) < 64:
                    self.words[piece] = ids
            out.extend(ids)
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a text; special tokens written in it are taken as such."""
        if self.special_at is None:
            return self.encode_plain(text)
        out: list[int] = []
        for k, part in enumerate(self.special_at.split(text)):
            if k % 2:
                out.append(self.special[part])
            elif part:
                out.extend(self.encode_plain(part))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids for a file without a decoder: token strings joined by a space."""
        return " ".join(map(self.tokens.__getitem__, ids))

    def _chunk(self, chunk: str) -> tuple[str, int, str]:
        """Of a part without spaces: its ids and tokens, each with a space before it."""
        out = self.old_chunks.get(chunk)
        if out is None:
            ids = self.encode(chunk)
            tokens = self.tokens
            out = ("".join([f" {i}" for i in ids]), len(ids), "".join([" " + tokens[i] for i in ids]))
        if len(chunk) < 64:
            self.chunks[chunk] = out
        return out

    def forget(self) -> None:
        """Drop what was looked up; the vocabulary stays."""
        for table in (self.words, self.old_words, self.chunks, self.old_chunks, self.pairs):
            table.clear()

    def encode_decode(self, text: str) -> tuple[str, int, str]:
        """(ids in decimal joined by spaces, their number, decoded text) of a whole text.

        White space ends every piece, so parts between spaces are independent and
        those that recur are looked up.
        """
        if len(self.chunks) > _CACHE_LIMIT:
            self.chunks, self.old_chunks = {}, self.chunks
        get, make = self.chunks.get, self._chunk
        ids, counts, tokens = zip(*[get(c) or make(c) for c in text.split(" ")])
        return "".join(ids)[1:], sum(counts), "".join(tokens)[1:]


_LOADED: dict[str, PrefixBPE] = {}


def load(raw: bytes, newer: Newer = ("", {})) -> PrefixBPE:
    """One encoder per vocabulary and Python process."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = PrefixBPE(json.loads(raw), newer)
    return _LOADED[key]


Finish = Callable[[str, int, str], tuple]


def as_outputs(ids: str, n: int, decoded: str) -> tuple:
    return ([int(x) for x in ids.split()], decoded)


OUTPUTS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])


def encode_decode(
    spark: SparkSession,
    docs: DataFrame,
    vocab_path: str,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    finish: Finish = as_outputs,
    outputs: T.StructType = OUTPUTS,
) -> DataFrame:
    """Encode every whole text and decode its ids again; one row per input row.

    ``finish`` turns (ids in decimal, their number, decoded text) into the values of
    ``outputs``; by default the ids and the decoded text themselves. A null or empty
    text gives no ids and an empty decoded text. Rows that repeat give rows that
    repeat; other columns than ``keep`` are dropped, so clashing names can't arise.
    The vocabulary (a file of fixed size) is read once by the driver and broadcast.
    """
    ship(spark)
    with open(vocab_path, "rb") as f:
        raw = f.read()
    shared = spark.sparkContext.broadcast((raw, newer_characters(raw)))
    kept = list(keep)
    schema = T.StructType([docs.schema[k] for k in kept] + outputs.fields)
    n_kept = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        bpe = load(*shared.value)
        arrow = to_arrow_schema(outputs)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                rows = [finish(*bpe.encode_decode(x or "")) for x in part.column(n_kept).to_pylist()]
                cols = [pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(n_kept)), *cols], names=[*kept, *arrow.names])
        bpe.forget()  # an idle worker would hold it

    return docs.select(*kept, text).mapInArrow(lean(run), schema)


DIGESTS = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


def as_digests(ids: str, n: int, decoded: str) -> tuple:
    sha = hashlib.sha256
    return n, sha(ids.encode()).hexdigest(), sha(decoded.encode("utf-8", "surrogatepass")).hexdigest()

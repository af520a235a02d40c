"""Encoding a corpus with a public byte-level BPE, run by a sentencepiece model built from its ranks.

The model is serialised directly: piece i is the token of rank i with its bytes mapped to printable
characters, its score is ``-i``, normalisation is the identity. Merging by best score is then
merging by lowest rank. Texts are cut into pre-tokens by the vocabulary's pattern first, and the
pre-tokens of a batch that were not met before go through the model together.

Defined results: null and empty texts have the empty list; what looks like a special token is
ordinary text; a lone surrogate, which a Spark string can't hold, counts as '?'.
"""

from __future__ import annotations

import base64
import os
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public vocabularies lie, unless a caller or the environment says otherwise.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts text for this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary_path(path: str | None = None) -> str:
    return path or os.path.join(os.environ.get("GLEANWORK_TOKENIZERS", "/opt/tokenizers"), VOCABULARY)


def read_ranks(path: str | None = None) -> list[bytes]:
    """Tokens by rank; the ranks must run from 0 without a gap."""
    with open(vocabulary_path(path), "rb") as f:
        found = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks have gaps")
    return [found[i] for i in range(len(found))]


def byte_characters() -> dict[int, str]:
    """Byte -> printable character: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protobuf field: varint, 32-bit float or length-delimited."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose ids are the ranks; the unknown piece takes the next id."""
    to_char = byte_characters()
    pieces = [_field(1, _field(1, "".join(map(to_char.get, t)).encode()) + _field(2, float(-i))) for i, t in enumerate(tokens)]
    unknown = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normal = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join([*pieces, unknown, _field(2, trainer), _field(3, normal)])


def ascii_pattern(pattern: str) -> str:
    """``pattern`` for texts of ASCII only, which the faster engine of the standard library can run."""
    return pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")


class Encoder:
    """Pre-tokens to ids through the model, with a memory of encoded pre-tokens bounded by their characters."""

    def __init__(self, model: bytes, pattern: str = PATTERN, remember: int = 16_000_000):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cut = regex.compile(pattern).findall
        self.cut_ascii = re.compile(ascii_pattern(pattern), re.ASCII).findall if "p{" not in ascii_pattern(pattern) else self.cut
        self.chars = str.maketrans({b: c for b, c in byte_characters().items()})
        self.bytes = str.maketrans({c: chr(b) for b, c in byte_characters().items()})
        self.known: dict[str, list[int]] = {}
        self.remember, self.held = remember, 0

    def parts(self, texts: Iterable[str | None]) -> list[list[str]]:
        """The pre-tokens of each text, all of them in ``known``: what is new among them goes through the model in one call."""
        parts = [(self.cut_ascii if x.isascii() else self.cut)(x) if x else [] for x in texts]
        if self.held > self.remember:
            self.known.clear()
            self.held = 0
        new = list(set(chain.from_iterable(parts)).difference(self.known))
        if new:
            mapped = [x.encode("utf-8", "replace").decode("latin-1").translate(self.chars) for x in new]
            self.known.update(zip(new, self.sp.encode(mapped, out_type=int, num_threads=1), strict=True))
            self.held += sum(map(len, mapped)) + 64 * len(mapped)
        return parts

    def encode(self, texts: Iterable[str | None]) -> list[list[int]]:
        parts, ids = self.parts(texts), self.known.__getitem__
        return [list(chain.from_iterable(map(ids, x))) for x in parts]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, by the inverse byte mapping."""
        return "".join(map(self.sp.id_to_piece, map(int, ids))).translate(self.bytes).encode("latin-1").decode("utf-8", "replace")


def portions(texts: pa.Array, size: int = 4_000_000) -> Iterator[list[str | None]]:
    """The texts of a batch, about ``size`` characters at a time; a longer text stands alone."""
    some, n = [], 0
    for x in texts:
        some.append(x.as_py())
        n += len(some[-1] or "")
        if n >= size:
            yield some
            some, n = [], 0
    if some:
        yield some


_ENCODERS: dict[tuple[int, str], Encoder] = {}


def _encoder(shared, pattern: str) -> Encoder:
    """One encoder per Python worker and model."""
    key = (hash(shared.value), pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(shared.value, pattern)
    return _ENCODERS[key]


def _shared_model(spark: SparkSession, path: str | None):
    # About a megabyte, fixed by the vocabulary and not by the data.
    return spark.sparkContext.broadcast(sentencepiece_model(read_ranks(path)))


def ids_of(spark: SparkSession, text: str | Column, path: str | None = None, pattern: str = PATTERN) -> Column:
    """A column of the ids of ``text``, an ``array<int>`` that is never null."""
    model = _shared_model(spark, path)

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        e, flat, ends = _encoder(model, pattern), array("i"), [0]
        for some in portions(texts):
            for parts in e.parts(some):
                flat.extend(chain.from_iterable(map(e.known.__getitem__, parts)))
                ends.append(len(flat))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)]))

    return encode(F.col(text) if isinstance(text, str) else text)


def token_count(spark: SparkSession, text: str | Column, path: str | None = None, pattern: str = PATTERN) -> Column:
    """How many ids ``text`` has, without moving them to the JVM."""
    model = _shared_model(spark, path)

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        e, out = _encoder(model, pattern), []
        for some in portions(texts):
            out += [sum(map(len, map(e.known.__getitem__, parts))) for parts in e.parts(some)]
        return pa.array(out, pa.int64())

    return count(F.col(text) if isinstance(text, str) else text)


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids) of every row; a scan and one Python stage, no shuffle."""
    return df.select(id_col, ids_of(df.sparkSession, text_col, path).alias("ids"))

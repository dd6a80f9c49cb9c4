"""Byte-level BPE through a sentencepiece model that is written directly from a rank file.

Each byte becomes one printable character, so every token of the vocabulary is a piece; the score
of a piece is its negative rank, hence the best-scored merge is the one of lowest rank, and the
normaliser is the identity. Texts are cut into pre-tokens by a pattern; a pre-token that is itself
in the vocabulary is that token, every other one is merged by the model. Decoding maps ids to
pieces and pieces back to bytes.

Defined cases: null text counts as empty; an empty text has no tokens; repeated rows and any extra
columns pass through (new columns replace columns of the same name); very long pre-tokens are
encoded like any other. The vocabulary is checked to be below ``MAX_VOCABULARY_BYTES`` before it is
sent to the executors.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import bound_batches

MAX_VOCABULARY_BYTES = 64 << 20
#: Pre-tokens kept with their ids in a worker; beyond it the memory starts anew.
CACHE_ENTRIES = 300_000
CACHE_LENGTH = 48


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes by rank file: lines of base64 token and rank."""
    with open(path, "rb") as lines:
        raw = lines.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"the vocabulary exceeds {MAX_VOCABULARY_BYTES} bytes")
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) }


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protocol-buffer field: varint, 32-bit float or length-delimited."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece i + 1 is the i-th token by rank; piece 0 is the unknown piece."""
    shown = byte_characters()
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        text = "".join(shown[b] for b in token)
        pieces.append(_field(1, text.encode()) + _field(2, float(-rank)) + _field(3, normal))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, 0) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class _Known(dict):
    """Packed ids by pre-token, bounded in entries and in their length."""

    def __init__(self, make):
        self._make = make

    def __missing__(self, word: str) -> bytes:
        found = self._make(word)
        if len(word) <= CACHE_LENGTH:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = found
        return found


class ByteBpe:
    """Encoder and decoder of one model; ids are ranks."""

    def __init__(self, model: bytes, ranks: list[int], pattern: str):
        import regex
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self._find = regex.compile(pattern).findall
        self._ranks = np.array([0, *ranks], np.uint32)
        self._shown = {b: c for b, c in enumerate(byte_characters())}
        back = {ord(c): b for b, c in self._shown.items()}
        pieces = [bytes(map(back.__getitem__, map(ord, self._model.id_to_piece(i + 1)))) for i in range(len(ranks))]
        self._bytes = dict(zip(ranks, pieces, strict=True))
        self._own = {piece: struct.pack("<I", rank) for rank, piece in self._bytes.items()}
        self._known = _Known(self._packed)

    def _packed(self, word: str) -> bytes:
        raw = word.encode()
        found = self._own.get(raw)
        if found is None:
            found = self._ranks[self._model.encode(raw.decode("latin-1").translate(self._shown))].tobytes()
        return found

    def encode_packed(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self._known.__getitem__, self._find(text)))

    def decode_packed(self, packed: bytes) -> bytes:
        return b"".join(map(self._bytes.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def encode_decode(docs: DataFrame, *, vocabulary: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens (long), ids (binary: little-endian unsigned 32-bit) and decoded (binary).

    vocabulary: path of a rank file, read on the driver and sent to the executors as a model.
    """
    bound_batches(docs.sparkSession)
    ranks = read_ranks(vocabulary)
    order = sorted(ranks.values())
    shared = docs.sparkSession.sparkContext.broadcast((serialise_model(ranks), order))
    added = ("n_tokens", "ids", "decoded")
    kept = [c for c in docs.columns if c not in added]
    last = "_" * (1 + max(map(len, docs.columns)))  # no column has this name

    def run(batches):
        bpe = ByteBpe(*shared.value, pattern)
        for batch in batches:
            packed, decoded = [], []
            for text in batch.column(batch.num_columns - 1):
                text = text.as_py()
                packed.append(bpe.encode_packed(text) if text else b"")
                decoded.append(bpe.decode_packed(packed[-1]))
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array(packed, pa.binary()), pa.array(decoded, pa.binary())], names=[*kept, *added])

    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
    return docs.select(*(F.col(f"`{c}`") for c in kept), F.col(text_col).cast("string").alias(last)).mapInArrow(run, schema)

"""Byte-level BPE by a sentencepiece model that is written straight from a rank file.

No model is trained: the ModelProto is serialised by hand. Each rank's byte string becomes a piece of printable
characters (one per byte), its score is the negative rank, normalisation is the identity, and no space is added or
removed. A BPE model merges the adjacent pair of the highest score, leftmost first, which is the merge order of the rank
file. Pre-tokens (matches of the pattern) are encoded apart; ids are the ranks. Decoding maps ids to the model's pieces
and their characters back to bytes.

A pre-token that is itself in the vocabulary is that id, as in tiktoken, whether or not merges lead there: the model
encodes its own vocabulary once, and the few entries that it doesn't merge to their own rank are exceptions.

Defined cases: a null text is empty, an empty text has no ids; repeated rows and ids give a row each; an empty table
gives no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from arrayloom.llm.chunks import ChunkEncoder, id_type, spelled, unspelled
from arrayloom.llm.common import binaries, slices


def read_ranks(data: bytes) -> list[bytes]:
    """Byte strings in order of rank from a rank file: base64, space, rank on each line."""
    ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, data.splitlines())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0 to n - 1")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes | str) -> bytes:
    """One field of a protobuf message: bool and int as varint, float as 32 bits, bytes and str with a length."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(int(value))
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    data = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose ids are the ranks; the unknown piece, never used, comes last."""
    pieces = b"".join(_field(1, _field(1, spelled(t)) + _field(2, -float(rank)) + _field(3, 1)) for rank, t in enumerate(tokens))
    pieces += _field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + b"".join(_varint(n << 3) + _varint(2**64 - 1) for n in (41, 42, 43))
    normaliser = _field(1, "identity") + _field(3, False) + _field(4, False) + _field(5, False)
    return pieces + _field(2, trainer) + _field(3, normaliser)


class ByteBpe:
    """Encode and decode in one process."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        import regex
        import sentencepiece

        self.tokens = read_ranks(ranks)
        self.kind = id_type(len(self.tokens))
        self.split = regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.tokens))
        self.chunks = ChunkEncoder(self._encode_chunks, self.kind)
        self.pieces = [unspelled(self.model.id_to_piece(i)) for i in range(len(self.tokens))]
        merged = self.model.encode([spelled(t) for t in self.tokens], num_threads=1)
        self.exceptions = {t: [i] for i, (t, ids) in enumerate(zip(self.tokens, merged, strict=True)) if ids != [i]}

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        cut = [[x.encode() for x in self.split.findall(c)] for c in chunks]
        new = list({x for c in cut for x in c})
        ids = dict(zip(new, self.model.encode([spelled(x) for x in new], num_threads=1), strict=True)) if new else {}
        ids |= self.exceptions
        return [np.array([i for x in c for i in ids[x]], self.kind).tobytes() for c in cut]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each begins and the last ends."""
        return self.chunks(column)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


_models: dict[tuple, ByteBpe] = {}


def model(ranks: bytes, pattern: str) -> ByteBpe:
    key = (ranks, pattern)
    if key not in _models:
        _models.clear()
        _models[key] = ByteBpe(ranks, pattern)
    return _models[key]


def _mapped(spark, ranks_path: str, pattern: str, fn, df: DataFrame, schema: str) -> DataFrame:
    with open(ranks_path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())  # a vocabulary file: its size doesn't depend on the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(ranks.value, pattern)
        for batch in batches:
            yield from fn(bpe, batch)

    return df.mapInArrow(run, schema)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) of each row of docs (doc_id, text)."""

    def fn(bpe: ByteBpe, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b in slices(batch.column(1)):
            ids, ends = bpe.encode(batch.column(1).slice(a, b - a))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return _mapped(docs.sparkSession, ranks_path, pattern, fn, docs.select("doc_id", "text"), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, data (the bytes) of each row of encoded (doc_id, ids); null ids are none."""

    def fn(bpe: ByteBpe, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data = [bpe.decode(np.array(x if x is not None else [], np.int64)) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), binaries(data)], names=["doc_id", "data"])

    return _mapped(encoded.sparkSession, ranks_path, pattern, fn, encoded.select("doc_id", "ids"), "doc_id long, data binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers), decoded_sha256."""

    def fn(bpe: ByteBpe, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, made, back = [], [], []
        for a, b in slices(batch.column(1)):
            flat, ends = bpe.encode(batch.column(1).slice(a, b - a))
            for start, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                ids = flat[start:end]
                n.append(len(ids))
                made.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(made, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _mapped(docs.sparkSession, ranks_path, pattern, fn, docs.select("doc_id", "text"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

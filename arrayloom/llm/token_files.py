"""Token ids in a compact binary format: static range asymmetric numeral system (rANS) over one shared frequency table.

A shard holds consecutive documents in order of doc_id as a run of blocks; a block holds whole documents and is decoded
on its own. Within a block, token t belongs to lane t mod LANES; lanes have a 64-bit state each and put 32-bit words into
one interleaved stream. Checkpoints keep all lanes' states and the place in the stream every so many steps, so that
parts of a block can be decoded in parallel too. The table of frequencies, of all ids of the corpus, is scaled to 2^20
and stored once. The header has checksums of the payload and of the ids; a reader that finds another one raises.

Block layout, little-endian: magic "LRNS", u32 version, u32 lanes, u32 tokens, u32 documents, u32 words, u32 checkpoints,
u32 steps between checkpoints, u32 crc32 of the ids as u32, u32 crc32 of the rest; then i64 doc_ids (those of null are 0),
u8 of each whether it is null, u32 ids of each document; then u32 place and u64 states for each checkpoint (the
first at step 0); then the words.

Blocks lie in a Parquet container (shard, block, documents, tokens, payload), which any Hadoop store takes and splits.

Defined cases: a null text is empty and has its end id; null doc_ids come first; repeated rows and equal doc_ids are
documents each; an empty table gives no blocks and no rows; other columns are ignored; a long document makes a large
block.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arrayloom.llm.common import binaries, dropped, new_path, released, staged
from arrayloom.llm.token_table import tokenised

LANES, SCALE, EVERY, BLOCK = 1024, 20, 128, 1 << 18
_HEAD = struct.Struct("<4s9I")
_LOW, U = np.uint64(1 << 31), np.uint64
BLOCKS = "shard int, block long, documents long, tokens long, payload binary"


class Frequencies:
    """Counts scaled to 2^SCALE in all, at least 1 for each id that occurs."""

    def __init__(self, counts: np.ndarray) -> None:
        total = 1 << SCALE
        counts = np.asarray(counts, np.float64)
        if (counts > 0).sum() > total:
            raise ValueError("too many different ids for the scale")
        f = np.where(counts > 0, np.maximum(1, np.floor(counts * (total / max(1.0, counts.sum())))), 0).astype(np.int64)
        order = np.argsort(-f, kind="stable")
        over = int(f.sum()) - total
        if over < 0 and f.any():
            f[order[0]] -= over
        for i in order if over > 0 else ():
            back = min(over, int(f[i]) - 1)
            f[i] -= back
            over -= back
            if not over:
                break
        self.f = f.astype(U)
        self.start = (np.cumsum(f) - f).astype(U)
        self._symbol: np.ndarray | None = None

    @property
    def symbol(self) -> np.ndarray:
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.f), dtype=np.int32), self.f.astype(np.int64))
        return self._symbol


def encode_ids(ids: np.ndarray, freq: Frequencies) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """Checkpoints (place, states) in order and the words of a block."""
    steps = -(-len(ids) // LANES)
    state = np.full(LANES, _LOW)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    behind = 0
    f_all, s_all = freq.f[ids], freq.start[ids]
    for step in range(steps - 1, -1, -1):
        f, start = f_all[step * LANES : (step + 1) * LANES], s_all[step * LANES : (step + 1) * LANES]
        x = state[: len(f)]
        full = x >= (f << U(63 - SCALE))
        if full.any():
            out = x[full]
            words.append(out.astype(np.uint32))
            behind += len(out)
            x = np.where(full, x >> U(32), x)
        q, r = np.divmod(x, f)
        state[: len(f)] = (q << U(SCALE)) + r + start
        if step % EVERY == 0:
            marks.append((behind, state.copy()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    return [(behind - place, states) for place, states in marks[::-1]], stream


def decode_ids(n: int, place: int, state: np.ndarray, words: np.ndarray, freq: Frequencies) -> np.ndarray:
    """n ids from a checkpoint on."""
    out = np.empty(n, np.int32)
    state, symbol, mask = state.copy(), freq.symbol, U((1 << SCALE) - 1)
    for a in range(0, n, LANES):
        x = state[: min(LANES, n - a)]
        slot = x & mask
        ids = symbol[slot]
        out[a : a + len(x)] = ids
        x = freq.f[ids] * (x >> U(SCALE)) + slot - freq.start[ids]
        low = np.flatnonzero(x < _LOW)
        if len(low):
            x[low] = (x[low] << U(32)) | words[place : place + len(low)]
            place += len(low)
        state[: len(x)] = x
    return out


def write_block(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, freq: Frequencies) -> bytes:
    marks, words = encode_ids(ids, freq)
    body = [np.array([x or 0 for x in doc_ids], "<i8").tobytes(), bytes(x is None for x in doc_ids), np.array(lengths, "<u4").tobytes()]
    body += [struct.pack("<I", place) + states.astype("<u8").tobytes() for place, states in marks]
    body.append(words.astype("<u4").tobytes())
    rest = b"".join(body)
    return _HEAD.pack(b"LRNS", 1, LANES, len(ids), len(doc_ids), len(words), len(marks), EVERY, zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(rest)) + rest


def read_block(data: bytes, freq: Frequencies) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, ids of each document, all ids; raises ValueError if a checksum is another."""
    magic, version, lanes, n, docs, n_words, n_marks, every, ids_crc, rest_crc = _HEAD.unpack_from(data)
    if magic != b"LRNS" or version != 1 or lanes != LANES or zlib.crc32(memoryview(data)[_HEAD.size :]) != rest_crc:
        raise ValueError("a block is damaged")
    at = _HEAD.size
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    null = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
    lengths = np.frombuffer(data, "<u4", docs, at + 9 * docs).astype(np.int64)
    at += 13 * docs
    marks = []
    for _ in range(n_marks):
        marks.append((struct.unpack_from("<I", data, at)[0], np.frombuffer(data, "<u8", LANES, at + 4).astype(U)))
        at += 4 + 8 * LANES
    words = np.frombuffer(data, "<u4", n_words, at).astype(U)
    parts = [decode_ids(min(n - k * every * LANES, every * LANES), place, states, words, freq) for k, (place, states) in enumerate(marks)]
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("ids of a block don't match their checksum")
    return [None if x else int(d) for d, x in zip(doc_ids, null, strict=True)], lengths, ids


def _histogram(kind: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            counts += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind), minlength=size)
        ids = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts[ids])], names=["id", "n"])

    return run


def _encode(kind: str, freq):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = freq.value
        shard, block = None, 0
        docs: list = []
        lengths: list[int] = []
        parts: list[bytes] = []
        held = first = 0

        def made() -> pa.RecordBatch:
            payload = write_block(docs, lengths, np.frombuffer(b"".join(parts), kind), shared)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([first], pa.int64()), pa.array([len(docs)], pa.int64()), pa.array([held], pa.int64()), binaries([payload])], names=["shard", "block", "documents", "tokens", "payload"])

        for batch in batches:
            for pid, seq, doc_id, n, data in zip(*(batch.column(c).to_pylist() for c in ("pid", "seq", "doc_id", "n", "ids")), strict=True):
                if docs and (pid != shard or held + n > BLOCK or seq != block):
                    yield made()
                    docs, lengths, parts, held = [], [], [], 0
                if not docs:
                    shard, first = pid, seq
                docs.append(doc_id)
                lengths.append(n)
                parts.append(data)
                held += n
                block = seq + 1
        if docs:
            yield made()

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 0) -> np.ndarray:
    """Write all documents as blocks to path/blocks and the frequency table to path/frequencies; returns the counts of ids."""
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = docs.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    tokens, kind = tokenised(ordered.select("doc_id", "text"), tokenizer_path, end_id)
    tokens, at = staged(tokens, "tokens")
    del ordered
    released(spark)
    size = 1 << 16 if kind == "<u2" else 1 << 20
    counts = tokens.select("ids").mapInArrow(_histogram(kind, size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts.coalesce(1).write.parquet(f"{path}/frequencies")
    table = read_frequencies(spark, path)
    freq = spark.sparkContext.broadcast(Frequencies(table))  # a row per id of the vocabulary
    tokens.select("pid", "seq", "doc_id", "n", "ids").mapInArrow(_encode(kind, freq), BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    dropped(spark, at)
    return table


def read_frequencies(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.schema("id long, n long").parquet(f"{path}/frequencies").toPandas()
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, np.int64)
    counts[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts


def _read(spark: SparkSession, path: str, schema: str, digest) -> DataFrame:
    """A row per document, by digest(ids), after its block's shard, number and place in it; start counts ids before it."""
    freq = spark.sparkContext.broadcast(Frequencies(read_frequencies(spark, path)))
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, block, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "block", "payload")), strict=True):
                doc_ids, lengths, ids = read_block(data, freq.value)
                ends = np.cumsum(lengths)
                ids = ids.astype("<u4")
                made = [digest(ids[e - n : e]) for e, n in zip(ends, lengths, strict=True)]
                rows = len(doc_ids)
                kind = pa.int64() if not made or isinstance(made[0], int) else pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, shard, np.int32)), pa.array(np.full(rows, block, np.int64)), pa.array(doc_ids, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(made, kind)], names=["shard", "block", "doc_id", "inside", "n_tokens", "made"])

    docs = blocks.select("shard", "block", "payload").mapInArrow(run, f"shard int, block long, doc_id long, inside long, n_tokens long, made {schema}")
    shards = blocks.groupBy("shard").agg(F.sum("tokens").alias("tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    shards = shards.select("shard", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("shard", "block", F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias("block_start")).join(shards, "shard")
    return docs.join(starts, ["shard", "block"]).select("doc_id", (F.col("shard_start") + F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", "made")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids."""
    return _read(spark, path, "array<int>", lambda ids: ids.astype(np.int32)).withColumnRenamed("made", "ids")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    return _read(spark, path, "long", lambda ids: zlib.crc32(ids.tobytes())).withColumnRenamed("made", "ids_crc32")


def written(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> str:
    path = new_path(docs.sparkSession, "token_files")
    write_tokens(docs, tokenizer_path, path, end_id)
    return path


__all__ = ["Frequencies", "decode_ids", "encode_ids", "read_block", "read_digests", "read_tokens", "write_block", "write_tokens", "written"]

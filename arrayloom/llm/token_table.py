"""Documents as token ids, encoded once by a tokenizer of the tokenizers library; packing and binary output start here."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrayloom.llm.chunks import id_type, tokenizer_encoder, vocabulary_size
from arrayloom.llm.common import binaries, bounded, slices

SCHEMA = "pid int, seq long, doc_id long, source string, n long, base long, ids binary"


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int) -> tuple[DataFrame, str]:
    """A row per document, in the order of docs within a partition, and the type of an id in `ids`.

    pid and seq: the partition and the place in it. n: ids with the end id. base: ids of earlier documents of that
    source in the partition. Null texts and sources are empty ones. A retried task makes the same rows.
    """
    kind = id_type(max(vocabulary_size(tokenizer_path), end_id + 1))
    with open(tokenizer_path, "rb") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: its size doesn't depend on the data
    end = np.array([end_id], kind).tobytes()
    width = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer_encoder(definition.value, kind)
        pid, seq, bases = TaskContext.get().partitionId(), 0, {}
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                flat, ends = encoder(part.column(1))
                data, ends = flat.tobytes(), (ends * width).tolist()
                ids = [data[i:j] + end for i, j in zip(ends[:-1], ends[1:], strict=True)]
                n = [len(x) // width for x in ids]
                base = []
                for source, k in zip(part.column(2).to_pylist(), n, strict=True):
                    base.append(bases.get(source, 0))
                    bases[source] = base[-1] + k
                rows = b - a
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(rows, pid, np.int32)), pa.array(np.arange(seq, seq + rows)), part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(base, pa.int64()), binaries(ids)],
                    names=["pid", "seq", "doc_id", "source", "n", "base", "ids"],
                )
                seq += rows

    source = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    return bounded(docs).select("doc_id", "text", source.alias("source")).mapInArrow(run, SCHEMA), kind

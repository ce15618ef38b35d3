"""Pack documents into fixed windows with a controlled mixture of sources.

Each source is a queue of documents. A window (sequence) takes tokens from every queue by deficit round-robin: a queue's
deficit grows by its share of the window, whole tokens are sent, the largest deficit first, and what is left over is
carried into the next window, so that every window holds the target proportions to within a token of each queue and the
whole corpus follows them. Documents are cut freely. A queue that ends leaves its share to the others.

Deficits have a closed form, which is what lets parallel tasks carry them. Token j of a queue of weight w is served at the
virtual time (j + 1/2) / w; at virtual time x a queue that still has tokens has earned w x tokens, and its deficit is
w x - sent. Any cut of the whole sequence of tokens, be it between windows, chunks of windows or partitions, is the
virtual time by which as many tokens are served, so a task finds all deficits at its first window from the queues' totals
and weights alone: they are those that the windows before it, in other tasks, left. Tokens move once, in a shuffle by
chunk of `per_chunk` windows; chunks have equal sizes whatever the sources' sizes are.

The target weights are given, or a power of the sources' tokens: 1 is the corpus's own mixture, below 1 favours small
sources as long as they last. Sources that hold less than LEAST_SHARE of all tokens share a queue, so the number of
queues is bounded whatever a source is (a host, a url).

The rest that doesn't fill a window is cut into sequences whose sizes are powers of two: nothing is padded.

Defined cases: a null text is empty and still has its end id; null sources are the empty source; a null doc_id stays
null; repeated rows are packed each; an empty table gives no rows; other columns are ignored. The order in a queue is
the order in which Spark reads the table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arrayloom.llm.common import binaries, small, staged
from arrayloom.llm.token_table import tokenised

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string"
#: Sources that hold less of all tokens share the queue REST.
LEAST_SHARE, REST = 1 / 4096, "\u0000rest"
_SLICES = "chunk long, source_no int, at long, doc_id long, start long, length long, doc_tokens long, ids binary"


class Mixture:
    """Where windows and chunks cut the queues; pure arithmetic on the sources' totals and weights."""

    def __init__(self, totals: dict[str, int], weights: dict[str, float] | None = None, window: int = 1024, per_chunk: int = 1024) -> None:
        self.sources = sorted(totals)
        self.totals = np.array([totals[s] for s in self.sources], np.int64)
        self.weights = np.array([float((weights or totals).get(s, 0)) for s in self.sources])
        if (self.weights[self.totals > 0] <= 0).any():
            raise ValueError("every source that has documents needs a weight above 0")
        self.window, self.per_chunk = window, per_chunk
        self.total = int(self.totals.sum())
        self._bounds: dict[int, np.ndarray] = {}

    def sent(self, x: float | np.ndarray) -> np.ndarray:
        """Tokens of each queue that are served by the virtual time x."""
        return np.clip(np.floor(np.asarray(x)[..., None] * self.weights + 0.5), 0, self.totals).astype(np.int64)

    def split(self, targets: np.ndarray) -> np.ndarray:
        """How many tokens of each queue are among the first targets[i] tokens: a row for each of the targets."""
        targets = np.minimum(np.asarray(targets, np.int64), self.total)
        low = np.zeros(len(targets))
        high = np.full(len(targets), float((self.totals / self.weights).max()) + 1)
        while True:
            middle = (low + high) / 2
            inside = (low < middle) & (middle < high)
            if not inside.any():
                break
            early = self.sent(middle).sum(axis=1) <= targets
            low, high = np.where(inside & early, middle, low), np.where(inside & ~early, middle, high)
        at = self.sent(low)
        jump = self.sent(high) - at  # served at one virtual time: in the order of the sources
        before = np.cumsum(jump, axis=1) - jump
        out = at + np.clip((targets - at.sum(axis=1))[:, None] - before, 0, jump)
        return np.where((targets >= self.total)[:, None], self.totals, out)

    def deficits(self, sent: np.ndarray) -> np.ndarray:
        """What each queue has earned but not sent, when these numbers of tokens are sent; 0 of queues that ended."""
        live = sent < self.totals
        if not live.any():
            return np.zeros(len(sent))
        return np.where(live, self.weights * (sent[live].sum() / self.weights[live].sum()) - sent, 0.0)

    def bound(self, chunk: int) -> np.ndarray:
        """Where a chunk starts in each queue."""
        if chunk not in self._bounds:
            if len(self._bounds) > 4096:
                self._bounds.clear()
            first = chunk // 64 * 64
            self._bounds |= zip(range(first, first + 64), self.split(np.arange(first, first + 64) * (self.per_chunk * self.window)))
        return self._bounds[chunk]

    def chunks_of(self, source: int, start: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(chunk, from, to) of the tokens start to end of a queue."""
        rank = int(self.sent((start + 0.5) / self.weights[source]).sum())  # about the token's place among all
        chunk = max(0, rank // (self.window * self.per_chunk) - 1)
        while chunk and self.bound(chunk)[source] > start:
            chunk -= 1
        while start < end:
            while (to := int(self.bound(chunk + 1)[source])) <= start:
                chunk += 1
            yield chunk, start, min(end, to)
            start = min(end, to)

    def sizes(self, tokens: int) -> list[int]:
        """Windows of a chunk: full ones, then powers of two."""
        full, rest = divmod(tokens, self.window)
        return [self.window] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]

    def plan(self, chunk: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Where the chunk starts in each queue, the tokens that each window takes from each queue, and the windows' sizes."""
        begun = chunk * self.per_chunk * self.window
        sizes = self.sizes(min(self.total - begun, self.per_chunk * self.window))
        at = self.split(begun + np.append(0, np.cumsum(sizes)))
        return at[0], np.diff(at, axis=0), sizes


def _slice_tokens(mixture: Mixture, kind: str):
    number = {s: i for i, s in enumerate(mixture.sources)}
    width = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, ids = [], []
            cols: list[list[int]] = [[], [], [], [], [], []]
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "queue", "n", "at", "ids")), strict=True)
            for doc_id, source, n, at, data in rows:
                s = number[source]  # the queue's name
                for chunk, a, b in mixture.chunks_of(s, at, at + n):
                    doc.append(doc_id)
                    for c, v in zip(cols, (chunk, s, a, a - at, b - a, n), strict=True):
                        c.append(v)
                    ids.append(data[(a - at) * width : (b - at) * width])
            chunk, s, a, start, length, n = cols
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunk, pa.int64()), pa.array(s, pa.int32()), pa.array(a, pa.int64()), pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(n, pa.int64()), binaries(ids)],
                names=["chunk", "source_no", "at", "doc_id", "start", "length", "doc_tokens", "ids"],
            )

    return run


def _fill_windows(mixture: Mixture, kind: str):
    def run(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        table = table.sort_by([("source_no", "ascending"), ("at", "ascending")]).combine_chunks()
        first, sends, _ = mixture.plan(chunk)
        cuts = first + np.cumsum(sends, axis=0) - sends
        before = np.cumsum(sends, axis=1) - sends
        numbers = table.column("source_no").to_numpy()
        at, start, n = (table.column(c).to_numpy() for c in ("at", "start", "doc_tokens"))
        ids = table.column("ids").combine_chunks()
        rows, cols = [], {"start": [], "length": [], "sequence_id": [], "offset": [], "crc": []}
        for s in np.unique(numbers):
            a, b = np.searchsorted(numbers, [s, s + 1])
            q, cut = at[a:b], cuts[:, s]
            end = int(q[-1] + table.column("length")[b - 1].as_py())
            begins = np.union1d(q, cut[sends[:, s] > 0])
            lengths = np.diff(np.append(begins, end))
            doc = np.searchsorted(q, begins, "right") - 1
            window = np.searchsorted(cut, begins, "right") - 1
            data = np.frombuffer(b"".join(ids.slice(a, b - a).to_pylist()), kind).astype("<u4")
            data = memoryview(data).cast("B")
            where = (begins - q[0]) * 4
            cols["crc"].append(np.fromiter((zlib.crc32(data[i : i + k]) for i, k in zip(where.tolist(), (lengths * 4).tolist(), strict=True)), np.int64, len(begins)))
            rows.append(doc + a)
            cols["start"].append(start[a:b][doc] + begins - q[doc])
            cols["length"].append(lengths)
            cols["sequence_id"].append(chunk * mixture.per_chunk + window)
            cols["offset"].append(before[window, s] + begins - cut[window])
        rows = np.concatenate(rows)
        out = {k: np.concatenate(v) for k, v in cols.items()}
        names = pa.array(mixture.sources, pa.string()).take(pa.array(numbers[rows]))
        return pa.table([table.column("doc_id").take(pa.array(rows)), out["start"], out["length"], out["crc"], pa.array(n[rows]), out["sequence_id"], out["offset"], names], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, window: int = 1024, weights: dict[str, float] | None = None, power: float = 1.0, per_chunk: int = 1024) -> DataFrame:
    """A row per piece (PIECES): the ids start to start + length of a document lie at offset in sequence sequence_id.

    weights: target share of tokens by source; default, the sources' own tokens to the given power. docs: doc_id, text
    and maybe source.
    """
    spark = docs.sparkSession
    tokens, kind = tokenised(docs, tokenizer_path, end_id)
    tokens, _ = staged(tokens, "tokens")
    sums = tokens.groupBy("pid", "source").agg(F.sum("n").alias("n"))
    of_source = sums.groupBy("source").agg(F.sum("n").alias("n"))
    total = of_source.agg(F.sum("n")).first()[0]
    if not total:
        return spark.createDataFrame([], PIECES)
    if weights is None:
        held = of_source.where(F.col("n") >= F.lit(max(1, int(total * LEAST_SHARE))))  # 1 / LEAST_SHARE rows at most
    else:
        if of_source.where(~F.col("source").isin(list(weights))).limit(1).count():
            raise ValueError("every source that has documents needs a weight above 0")
        held = of_source.where(F.col("source").isin(list(weights)))  # as many rows as weights
    totals = {r.source: r.n for r in held.collect()}
    if (rest := total - sum(totals.values())) > 0:
        totals[REST] = rest
    if weights is None:
        weights = {s: n**power for s, n in totals.items()}
    mixture = Mixture(totals, weights, window, per_chunk)
    queue = F.when(F.col("source").isin([s for s in totals if s != REST]), F.col("source")).otherwise(REST)
    before = Window.partitionBy("queue").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("queue", "pid").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    named = sums.withColumn("queue", queue)
    by_partition = named.groupBy("queue", "pid").agg(F.sum("n").alias("n"))  # a row per queue and partition
    by_partition = by_partition.select("queue", "pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = named.select("queue", "pid", "source", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("within"))
    offsets = within.join(small(by_partition), ["queue", "pid"]).select("pid", "source", "queue", (F.col("before") + F.col("within")).alias("offset"))
    placed = tokens.join(small(offsets), ["pid", "source"]).select("doc_id", "queue", "n", (F.col("base") + F.col("offset")).alias("at"), "ids")
    return placed.mapInArrow(_slice_tokens(mixture, kind), _SLICES).groupBy("chunk").applyInArrow(_fill_windows(mixture, kind), PIECES)

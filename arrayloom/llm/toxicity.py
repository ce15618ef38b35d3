"""Toxicity by subword-bag embeddings averaged into a linear softmax; embeddings and softmax are trained jointly in numpy.

A word is the mean of the embeddings of its character 3- to 5-grams (with marks for its start and end, hashed into a
fixed number of buckets), so an unseen misspelling shares most of its vector with the word it hides. A window of WINDOW
words is the mean of its distinct words, so that repetition adds nothing; where words are missing, the mean of clean
windows stands for them. A linear softmax over that mean gives the window's logit. Toxic wording is rare even in toxic
documents, so windows of toxic documents are noisy examples; a document's score comes from its highest window: a
two-parameter logistic curve over that logit, fitted on the training documents.

Since the softmax is linear in the mean, a trained model comes down to one number per bucket; scoring adds numbers up.

Training uses all windows of at most `per_class` labelled documents of either class (those with the smallest hashes of
their ids) and at most `most_bytes` of their texts; both bounds are parameters. It runs in one task on an executor, in
memory that the bounds limit. Scoring covers all words of all texts.

Defined cases: a null or empty text scores as a window without words; null or other labels than 0 and 1 and
null ids aren't trained on; without labels of both classes every score is 0; repeated rows and ids get a score each;
repeated labels of an id count once, and ids with both labels are left out; of texts with one id the least is trained on;
an empty table gives no rows; other columns are ignored (the filter keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arrayloom.llm.common import binaries, bounded, slices, text_buffer
from arrayloom.llm.words import U, distinct, mix, spans

BITS, WINDOW, SIZES = 17, 16, (3, 4, 5)


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word, one after the other, and where each word's begin."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    text = (b" " + b" ".join(words) + b" ").decode("utf-8", "replace").lower()
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(U)
    marks = np.flatnonzero(code == 0x20)
    n = len(code)
    word = np.cumsum(code == 0x20) - 1
    end = np.append(marks, n)[np.minimum(word + 1, len(marks))]
    at = np.arange(n)
    inside, buckets = [], []
    h = np.zeros(n, U)
    for k in range(max(SIZES)):
        if k < n:
            h[: n - k] = h[: n - k] * U(0x100000001B3) + code[k:]
        if k + 1 in SIZES:
            inside.append((at + k <= end) & (at < marks[-1]))
            buckets.append((mix(h + U(k)) >> U(64 - BITS)).astype(np.int32))
    inside, buckets = np.array(inside).T, np.array(buckets).T  # by place, then by size
    counts = np.add.reduceat(inside.sum(axis=1), marks[:-1])
    return buckets[inside], np.cumsum(counts) - counts


@dataclass
class Words:
    """Words of a few texts: which distinct word stands at each place, and the place where each text begins."""

    distinct: list[bytes]
    which: np.ndarray
    bounds: np.ndarray


def words_of(column: pa.Array) -> Words:
    buf, offsets = text_buffer(column)
    starts, ends, bounds = spans(buf, offsets)
    _, first, which = distinct(buf, starts, ends)
    data = buf.tobytes()
    return Words([data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], which, bounds)


def windows_of(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where windows begin and end, and the text of each; the last of a text is its last WINDOW words, or all it has."""
    lengths = np.diff(bounds)
    n = -(-lengths // WINDOW)
    text = np.repeat(np.arange(len(lengths)), n)
    inside = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    start = np.minimum(inside * WINDOW, np.maximum(lengths - WINDOW, 0)[text])
    start += bounds[:-1][text]
    return start, np.minimum(start + WINDOW, bounds[1:][text]), text


def _means(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    n = np.diff(np.append(starts, len(values)))
    return np.add.reduceat(values, starts, axis=0) / (n[:, None] if values.ndim > 1 else n)


def spread(which: np.ndarray, text: np.ndarray, word_of: np.ndarray, bucket: np.ndarray, words: int, buckets: int) -> np.ndarray:
    """In how many texts each bucket occurs; a text counts once for each of its words that has the bucket."""
    pairs = np.unique(text.astype(np.int64) * np.int64(words) + which)
    return np.bincount(bucket, np.bincount(pairs % words, minlength=words)[word_of], buckets)


@dataclass
class Model:
    weights: np.ndarray  # by bucket: the logit that an n-gram adds
    bias: float
    slope: float
    shift: float
    trained: bool = True
    fill: float = 0.0  # the logit that stands for a word where a window has none: the mean of clean windows

    def highest(self, column: pa.Array) -> np.ndarray:
        """The highest window's logit of each text."""
        w = words_of(column)
        out = np.full(len(column), self.bias + self.fill)
        if len(w.which):
            buckets, starts = subwords(w.distinct)
            per_word = _means(self.weights[buckets], starts)
            at, ends, text = windows_of(w.bounds)
            place = at[:, None] + np.arange(WINDOW)
            ids = np.where(place < ends[:, None], w.which[np.minimum(place, len(w.which) - 1)], -1)
            ids.sort(axis=1)
            once = ids >= 0
            once[:, 1:] &= ids[:, 1:] != ids[:, :-1]
            logits = np.where(once, per_word[ids], self.fill).sum(axis=1, dtype=np.float64) / WINDOW + self.bias
            first = np.flatnonzero(np.diff(text, prepend=-1))
            out[text[first]] = np.maximum.reduceat(logits, first)
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(column))
        return 1 / (1 + np.exp(-np.clip(self.slope * self.highest(column) + self.shift, -40, 40)))


def _balanced(y: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Weights of examples: half for either class."""
    n = [max(1, int((used & (y == k)).sum())) for k in (0, 1)]
    return np.where(used, np.where(y == 1, 0.5 / n[1], 0.5 / n[0]), 0)


def _highest(logit: np.ndarray, text: np.ndarray, share: float) -> np.ndarray:
    """The windows among the highest `share` of each text, at least one."""
    order = np.lexsort((-logit, text))
    n = np.bincount(text)
    rank = np.empty(len(text), np.int64)
    rank[order] = np.arange(len(text)) - (np.cumsum(n) - n)[text[order]]
    return rank < np.maximum(1, np.ceil(n * share))[text]


def train(texts: list[str], labels: np.ndarray, prevalence: float = 0.1, dim: int = 8, steps: int = 100, rate: float = 1.0, out_rate: float = 0.5, min_docs: int | None = None, again: int = 25, shares: tuple[float, ...] = (0.3, 0.2, 0.1), decay: float = 5e-3, seed: int = 1) -> Model:
    """Fit embeddings and softmax on all windows by gradient descent with momentum over the whole sample, then the curve.

    A bucket's step is scaled by one over the root of its occurrences, so that what exceeds chance counts; buckets in
    fewer than min_docs documents (by default a hundredth of the toxic ones, 2 to 20) aren't used. Every `again` steps a
    toxic document's examples become the next of `shares` of its windows with the highest logits.

    With two classes the softmax depends on the difference of its logits alone, and that is the window's mean of
    emb @ (out[1] - out[0]): a step adds up one number per n-gram there and one back, whatever `dim` is.
    """
    labels = np.asarray(labels)
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 0.0, 0.0, False)
    if min_docs is None:
        min_docs = int(np.clip(labels.sum() // 100, 2, 20))
    column = pa.array(texts, pa.large_string())
    w = words_of(column)
    at, ends, text = windows_of(w.bounds)
    lengths = ends - at
    window_of = np.repeat(np.arange(len(at)), lengths)
    key = np.unique(window_of * np.int64(len(w.distinct)) + w.which[np.repeat(at - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))])  # a word counts once in a window
    window_of, which = (key // len(w.distinct)).astype(np.int32), (key % len(w.distinct)).astype(np.int32)
    begins = np.searchsorted(window_of, np.arange(len(at)))
    buckets, starts = subwords(w.distinct)
    known, bucket_no = np.unique(buckets, return_inverse=True)
    n_grams = np.diff(np.append(starts, len(buckets)))
    bucket_no = bucket_no.astype(np.int32)
    word_of = np.repeat(np.arange(len(w.distinct), dtype=np.int32), n_grams)
    del buckets, key
    common = spread(which, text[window_of], word_of, bucket_no, len(w.distinct), len(known)) >= min_docs
    seen = np.bincount(bucket_no, np.bincount(which, minlength=len(w.distinct))[word_of], len(known))
    used = common[bucket_no]  # the others stay 0
    word_of, bucket_no = word_of[used], bucket_no[used]
    scale = np.where(common, 1 / np.sqrt(np.maximum(seen, 1)), 0)  # a gradient beyond chance counts
    y = labels[text].astype(np.float64)
    weight = _balanced(y, np.ones(len(y), bool))
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (len(known), dim)).astype(np.float32).astype(np.float64)
    emb[~common] = 0
    out = rng.normal(0, 0.5, (dim, 2)).astype(np.float32).astype(np.float64)
    bias = np.zeros(2)
    move_e, move_o, move_b = np.zeros_like(emb), np.zeros_like(out), np.zeros_like(bias)
    unit = 0.0
    for t in range(1, steps + 1):
        if t > 1 and t % again == 1:  # from now on a toxic document's highest windows are the examples
            weight = _balanced(y, (y == 0) | _highest(z, text, shares[min(len(shares), t // again) - 1]))
        turn = out[:, 1] - out[:, 0]
        word = np.bincount(word_of, (emb @ turn)[bucket_no], len(w.distinct)) / n_grams
        z = np.add.reduceat(word[which], begins) / WINDOW + bias[1] - bias[0]
        miss = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight  # of class 1; that of class 0 is its negative
        back = np.bincount(which, (miss / WINDOW)[window_of], len(w.distinct)) / n_grams
        pull = np.bincount(bucket_no, back[word_of], len(known))
        g_out, g_bias = emb.T @ np.stack([-pull, pull], axis=1), np.array([-miss.sum(), miss.sum()])
        pull *= scale
        size = float(np.abs(pull).max() * np.sqrt(turn @ turn))
        unit = unit or size
        move_e = 0.9 * move_e - rate / max(unit, size, 1e-300) * pull[:, None] * turn[None, :]  # no step is longer than the first one
        emb += move_e - decay * emb
        slow = out_rate * min(1.0, unit / max(size, 1e-12))
        move_o = 0.9 * move_o - slow * g_out / max(1.0, float(np.abs(g_out).max()))
        out += move_o
        move_b = 0.9 * move_b - slow * g_bias
        bias += move_b
    weights = np.zeros(1 << BITS, np.float32)
    weights[known] = emb @ (out[:, 1] - out[:, 0])
    model = Model(weights, float(bias[1] - bias[0]), 1.0, 0.0)
    clean = (y == 0)[window_of]
    word = np.bincount(word_of, weights[known].astype(np.float64)[bucket_no], len(w.distinct)) / n_grams
    model.fill = float(word[which[clean]].mean()) if clean.any() else 0.0
    top = np.concatenate([model.highest(column.slice(a, b - a)) for a, b in slices(column, 2 << 20)])
    return _curve(model, top, labels, prevalence)


def _curve(model: Model, top: np.ndarray, labels: np.ndarray, prevalence: float) -> Model:
    """Newton's method for the logistic curve, classes weighted as they occur, slightly ridged."""
    centre, scale = float(top.mean()), float(top.std()) or 1.0
    x = np.stack([(top - centre) / scale, np.ones(len(top))], axis=1)
    weight = np.where(labels == 1, prevalence / (labels == 1).mean(), (1 - prevalence) / (labels == 0).mean())
    b = np.zeros(2)
    ridge = np.diag([3e-4, 1e-6]) * len(top)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (labels - p)) - ridge @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.shift = float(b[0] / scale), float(b[1] - b[0] * centre / scale)
    return model


def fold(doc_id: str = "doc_id", of: int = 4):
    """crc32 of the id as text, modulo `of`."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % of


def training_sample(docs: DataFrame, labels: DataFrame, held_out: int = 2, per_class: int = 2000, most_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, text, label, prevalence (the share of toxic labels): whole texts, none of the held-out fold.

    Of either class at most per_class documents, in order of the hashes of their ids, and of these the texts that fit
    into most_bytes together. Of rows with one id the least text stands for it.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold() != held_out)).groupBy("doc_id").agg(F.min("toxic").alias("low"), F.max("toxic").alias("high"))
    known = known.where("low = high").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("low").cast("long").alias("label"), F.xxhash64("doc_id").alias("order"))
    chosen = [known.where(F.col("label") == k).orderBy("order", "doc_id").limit(per_class) for k in (0, 1)]
    chosen = F.broadcast(chosen[0].unionAll(chosen[1]))  # at most 2 * per_class rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id").groupBy("doc_id", "label", "order").agg(F.min("text").alias("text"))
    upto = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).over(Window.partitionBy("label").orderBy("order", "doc_id"))
    prevalence = known.agg(F.avg("label")).first()[0]
    return rows.withColumn("upto", upto).where(F.col("upto") <= most_bytes).select("doc_id", "text", "label", F.lit(prevalence).cast("double").alias("prevalence"))


def fit(docs: DataFrame, labels: DataFrame, held_out: int = 2, per_class: int = 2000, most_bytes: int = 16 << 20, **more) -> Model:
    """Train on training_sample, in one task of an executor; the driver gets the model alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "label", "prevalence")), strict=True)]
        rows.sort(key=lambda r: r[0])
        m = train([r[1] or "" for r in rows], np.array([r[2] for r in rows], np.int64), rows[0][3] if rows else 0.0, **more)
        values = [binaries([m.weights.tobytes()]), *(pa.array([x]) for x in (m.bias, m.slope, m.shift, m.trained, m.fill))]
        yield pa.RecordBatch.from_arrays(values, names=["weights", "bias", "slope", "shift", "trained", "fill"])

    sample = training_sample(docs, labels, held_out, per_class, most_bytes).repartition(1)
    row = sample.mapInArrow(run, "weights binary, bias double, slope double, shift double, trained boolean, fill double").first()
    if row is None:
        return train([], np.zeros(0, np.int64))
    return Model(np.frombuffer(row.weights, np.float32), row.bias, row.slope, row.shift, row.trained, row.fill)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a number per bucket: its size doesn't depend on the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(shared.value.scores(batch.column(1).slice(a, b - a)))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def rejected_removed(docs: DataFrame, model: Model, limit: float = 0.3) -> DataFrame:
    """The rows of docs whose score is below the limit, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(text)):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(shared.value.scores(part.column(text)) < limit))

    return bounded(docs).mapInArrow(run, docs.schema)


__all__ = ["Model", "fit", "fold", "rejected_removed", "score", "subwords", "train", "training_sample"]

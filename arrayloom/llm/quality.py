"""Quality rules with compression bands.

Base counts: code points in words, symbol characters, repeated lines, words inside repeated 5-word windows. Compression
bands: the zstandard ratio (compressed bytes over bytes) of the whole text, and of its consecutive chunks of CHUNK bytes
(the last one ends with the text and overlaps the one before), must lie between a lower limit (below: repetitive) and an
upper one (above: incompressible) that depend on the length. A text of up to CHUNK bytes is a chunk of its own, which the
band of the whole judges. A text is rejected if its whole ratio leaves its band, or if more than a quarter of its chunks leave theirs.

Prose of the four languages at hand lies well within the bands (for 1 to 2 KB, ratios of 0.47 to 0.60 in 99 % of texts
marked good; repeated lines lie below 0.2, base64 and random letters above 0.75). Texts under 128 bytes compress too
irregularly to be judged.

Defined cases: a null text has no words; a text of fewer than 10 words fails the base rule; a line is what stands
between line feeds, counted if it has a word; repeated rows are judged each; an empty table gives no rows; other columns
are ignored (the filter keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from arrayloom.llm.common import bounded, slices, text_buffer
from arrayloom.llm.words import U, distinct, grams, hashes, mix, same, spans

#: From so many bytes on, the lowest and the highest ratio that is kept.
BANDS = [(0, 0.0, 9.0), (128, 0.36, 1.05), (256, 0.36, 0.92), (512, 0.34, 0.82), (1024, 0.32, 0.74), (2048, 0.30, 0.70), (4096, 0.28, 0.66), (16384, 0.26, 0.64)]
CHUNK, CHUNK_BAND, BAD_SHARE = 4096, (0.20, 0.68), 0.25
LEVEL = 3
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_BLANK = " \t\n\v\f\r"


def repeated_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, k: int = 5) -> np.ndarray:
    """Of each text, the words that lie in a k-word window found twice or more in that text.

    Windows are sorted by a hash; neighbours with equal hashes are compared byte by byte.
    """
    n = len(starts)
    covered = np.zeros(n + 1, np.int64)
    if n >= k:
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        at = np.flatnonzero(text[: n - k + 1] == text[k - 1 :])
        keys = mix(grams(hashes(buf, starts, ends, "exact"), k)[at] ^ mix(text[at].astype(U) + U(1)))
        order = np.argsort(keys, kind="stable")
        alike = np.flatnonzero(keys[order][1:] == keys[order][:-1])
        i, j = at[order[alike]], at[order[alike + 1]]
        if not ((text[i] == text[j]).all() and all(same(buf, starts, ends, i + d, j + d).all() for d in range(k))):
            _, _, word = distinct(buf, starts, ends, "exact")
            _, keys = np.unique(np.stack([text[at], *(word[at + d] for d in range(k))], axis=1), axis=0, return_inverse=True)
            order = np.argsort(keys, kind="stable")
            alike = np.flatnonzero(keys[order][1:] == keys[order][:-1])
        hit = at[order[np.union1d(alike, alike + 1)]]
        if len(hit):
            step = np.zeros(n + 1, np.int64)
            np.add.at(step, hit, 1)
            np.add.at(step, hit + k, -1)
            covered[1:] = np.cumsum(np.cumsum(step[:n]) > 0)
    return covered[bounds[1:]] - covered[bounds[:-1]]


def sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(flags, dtype=np.int64))
    return total[offsets[1:]] - total[offsets[:-1]]


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    return len(lines) - len(set(lines))


def band_ok(ratio: float, size: int) -> bool:
    _, low, high = next(b for b in reversed(BANDS) if size >= b[0])
    return low <= ratio <= high


def compression(data: bytes, press: zstandard.ZstdCompressor) -> tuple[float, int, bool]:
    """Ratio of the whole (1 for an empty text), chunks outside their band, and whether the text stays."""
    if not data:
        return 1.0, 0, True
    whole = len(press.compress(data)) / len(data)
    starts = [*range(0, len(data) - CHUNK, CHUNK), len(data) - CHUNK] if len(data) > CHUNK else []
    bad = sum(not CHUNK_BAND[0] <= len(press.compress(data[i : i + CHUNK])) / CHUNK <= CHUNK_BAND[1] for i in starts)
    return whole, bad, band_ok(whole, len(data)) and bad <= BAD_SHARE * len(starts)


def measures(column: pa.Array) -> dict[str, np.ndarray]:
    """All counts and verdicts of the texts of a column."""
    buf, offsets = text_buffer(column)
    starts, ends, bounds = spans(buf, offsets)
    n_words = np.diff(bounds)
    first_byte = (buf & 0xC0) != 0x80
    points = np.append(0, np.cumsum(first_byte, dtype=np.int64))
    in_words = np.append(0, np.cumsum(points[ends] - points[starts]))
    data = buf.tobytes()
    press = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)
    parts = [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    pressed = [compression(x, press) for x in parts]
    repeats = repeated_words(buf, starts, ends, bounds)
    failed = (n_words < 10) | (100 * repeats > 20 * n_words)
    return {
        "n_words": n_words,
        "word_chars": in_words[bounds[1:]] - in_words[bounds[:-1]],
        "n_symbols": sums(_SYMBOLS[buf], offsets),
        "n_dup_lines": np.array([duplicate_lines(x.decode()) for x in parts], np.int64),
        "n_repeat_words": repeats,
        "base_failed": failed,
        "ratio": np.array([x[0] for x in pressed], np.float64),
        "bad_chunks": np.array([x[1] for x in pressed], np.int64),
        "kept": ~failed & np.array([x[2] for x in pressed], bool),
    }


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, bad_chunks long, kept boolean"


def judge(docs: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id, text): SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                out = measures(batch.column(1).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *map(pa.array, out.values())], names=["doc_id", *out])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def rejected_removed(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(text)):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(measures(part.column(text))["kept"]))

    return bounded(docs).mapInArrow(run, docs.schema)

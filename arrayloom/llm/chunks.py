"""Tokenise by remembered chunks.

The pattern that splits a text before the merges lets a space stand only at the start of a pre-token, so a pre-token
always ends between a character that isn't white space and a space. Texts are cut there, and each distinct chunk is
encoded once; the ids of a text are gathered from those of its chunks. Chunks are looked up by a hash and then compared
byte by byte. A space after other white space, or after a character that may be white space beyond ASCII, is no cut. What
is remembered is bounded by a number of chunks and the length of each.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from arrayloom.llm.common import text_buffer
from arrayloom.llm.words import distinct

_BLANK = np.zeros(256, bool)
_BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True


def chunk_starts(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks begin, and bounds: text d has the chunks bounds[d] to bounds[d + 1]."""
    cut = np.zeros(len(buf), bool)
    if len(buf) > 1:
        cut[1:] = (buf[1:] == 0x20) & ~_BLANK[buf[:-1]]
        at = np.flatnonzero(cut)
        last, two, three = buf[at - 1], buf[np.maximum(at - 2, 0)], buf[np.maximum(at - 3, 0)]
        unsure = (last >= 0x80) & ((two == 0xC2) & ((last == 0x85) | (last == 0xA0)) | (three >= 0xE1) & (three <= 0xE3))
        cut[at[unsure]] = False
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(cut)
    return starts, np.searchsorted(starts, offsets)


class ChunkEncoder:
    """encode: list of strings to a list of bytes, the ids (of type `kind`) of each.

    The chunks met first stay known; beyond `most` of them, later ones are known until they are a quarter as many. A
    chunk of more than `longest` bytes, or one whose hash a different known chunk has, is encoded each time.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], kind: str, most: int = 1_200_000, longest: int = 256) -> None:
        self.encode, self.kind, self.most, self.longest = encode, kind, most, longest
        self.keys = np.zeros(0, np.uint64)  # sorted hashes of known chunks
        self.start, self.at = np.zeros(0, np.int64), np.zeros(0, np.int64)  # where their ids and their bytes begin
        self.size, self.length = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat, self.bytes = np.zeros(1 << 16, kind), np.zeros(1 << 16, np.uint8)
        self.used = self.filled = 0
        self.kept: tuple[int, int] | None = None

    def _made(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        made = self.encode([data[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        return np.frombuffer(b"".join(made), self.kind), np.fromiter(map(len, made), np.int64, len(made)) // self.flat.itemsize

    def _learn(self, keys: np.ndarray, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """keys: sorted, different, none of them known."""
        first = np.cumsum(lengths) - lengths
        self.flat, self.bytes = _room(self.flat, self.used + len(ids)), _room(self.bytes, self.filled + int(lengths.sum()))
        self.flat[self.used : self.used + len(ids)] = ids
        self.bytes[self.filled : self.filled + int(lengths.sum())] = buf[np.repeat(starts - first, lengths) + np.arange(int(lengths.sum()))]
        at = np.searchsorted(self.keys, keys)
        self.start, self.size = np.insert(self.start, at, self.used + np.cumsum(sizes) - sizes), np.insert(self.size, at, sizes.astype(np.int32))
        self.at, self.length = np.insert(self.at, at, self.filled + first), np.insert(self.length, at, lengths.astype(np.int32))
        self.keys = np.insert(self.keys, at, keys)
        self.used += len(ids)
        self.filled += int(lengths.sum())

    def _forget(self) -> None:
        """Drop what was learnt after the first `most` chunks."""
        if self.kept is None and len(self.keys) >= self.most:
            self.kept = self.used, self.filled
        if self.kept and len(self.keys) > self.most * 5 // 4:
            stay = self.at < self.kept[1]
            self.keys, self.start, self.size, self.at, self.length = (x[stay] for x in (self.keys, self.start, self.size, self.at, self.length))
            self.used, self.filled = self.kept

    def _find(self, keys: np.ndarray, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each chunk's hash is among the known ones (or -1), and whether it is the known chunk, byte by byte."""
        at = np.searchsorted(self.keys, keys)
        if not len(self.keys):
            return np.full(len(keys), -1), np.zeros(len(keys), bool)
        at = np.minimum(at, len(self.keys) - 1)
        at[self.keys[at] != keys] = -1
        right = (at >= 0) & (self.length[at] == lengths)
        hit = np.flatnonzero(right)
        if len(hit):
            n = lengths[hit]
            first = np.cumsum(n) - n
            step = np.arange(int(n.sum())) - np.repeat(first, n)
            right[hit] = np.logical_and.reduceat(buf[np.repeat(starts[hit], n) + step] == self.bytes[np.repeat(self.at[at[hit]], n) + step], first)
        return at, right

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column one after the other, and len + 1 offsets; null is empty."""
        self._forget()
        buf, offsets = text_buffer(column)
        starts, bounds = chunk_starts(buf, offsets)
        keys, first, which = distinct(buf, starts, np.append(starts[1:], len(buf)), "raw")
        begin = starts[first]
        length = np.append(starts[1:], len(buf))[first] - begin
        at, right = self._find(keys, buf, begin, length)
        new = np.flatnonzero(~right)
        size, where = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        flat = self.flat
        if len(new):
            ids, sizes = self._made(buf.tobytes(), begin[new], begin[new] + length[new])
            fit = (at[new] < 0) & (length[new] <= self.longest) & np.append(True, keys[new][1:] != keys[new][:-1])
            size[new], where[new] = sizes, np.cumsum(sizes) - sizes + self.used
            flat = np.concatenate([self.flat[: self.used], ids])
        size[right], where[right] = self.size[at[right]], self.start[at[right]]
        size, where = size[which], where[which]
        ends = np.cumsum(size)
        out = flat[np.repeat(where - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        if len(new) and fit.any():
            own = np.repeat(fit, sizes)
            self._learn(keys[new[fit]], buf, begin[new[fit]], length[new[fit]], ids[own], sizes[fit])
        return out, np.append(0, ends)[bounds]


def _room(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, len(x) * 3 // 2) - len(x), x.dtype)])


_kept: dict[tuple, ChunkEncoder] = {}


def id_type(vocabulary: int) -> str:
    """The narrowest of the two little-endian types that holds every id."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 has one, else the next from U+0100 on."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


LETTERS = byte_letters()
_TO_LETTERS = dict(enumerate(LETTERS))


def spelled(data: bytes) -> str:
    """Bytes as a byte-level vocabulary spells them."""
    return data.decode("latin-1").translate(_TO_LETTERS)


_TO_BYTES = {ord(x): i for i, x in enumerate(LETTERS)}


def unspelled(piece: str) -> bytes:
    """The bytes that a piece of a byte-level vocabulary stands for."""
    return bytes(_TO_BYTES[ord(x)] for x in piece)


def _plain_byte_level(definition: dict) -> bool:
    """Whether a tokenizer is byte-level BPE that splits by the usual pattern and does nothing else to a text."""
    cut = definition.get("pre_tokenizer") or {}
    same = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    return bool(same and definition["model"]["type"] == "BPE" and not definition.get("normalizer"))


def tokenizer_encoder(definition: bytes, kind: str) -> ChunkEncoder:
    """An encoder by the tokenizers library, one per worker process, from the bytes of a tokenizer's JSON file.

    The library's model encodes each distinct pre-token of a call once; a chunk with an added token's string goes
    through the library's whole tokenizer.
    """
    key = (definition, kind)
    if key not in _kept:
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        tok, says = Tokenizer.from_str(definition.decode()), json.loads(definition)
        if not _plain_byte_level(says):
            raise ValueError("the tokenizer isn't plain byte-level BPE")
        added = [x["content"] for x in says.get("added_tokens", [])]
        special = re.compile("|".join(map(re.escape, added))) if added else None
        cut, model = regex.compile(public_tokenizers.PATTERN), tok.model

        def whole(text: str) -> bytes:
            return np.array(tok.encode(text, add_special_tokens=False).ids, kind).tobytes()

        def encode(texts: list[str]) -> list[bytes]:
            odd = {i for i, x in enumerate(texts) if special.search(x)} if special and any(map("\n".join(texts).__contains__, added)) else ()
            parts = [cut.findall(x) for x in texts]
            new = {y for x in parts for y in x}
            ids = {x: np.array([t.id for t in model.tokenize(spelled(x.encode()))], kind).tobytes() for x in new}
            return [whole(t) if i in odd else b"".join(map(ids.__getitem__, x)) for i, (t, x) in enumerate(zip(texts, parts, strict=True))]

        _kept.clear()
        _kept[key] = ChunkEncoder(encode, kind)
    return _kept[key]


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)

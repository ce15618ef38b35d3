"""Encoding, packing and binary output against the libraries they stand for."""

import base64
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest

from arrayloom.llm import byte_bpe, chunks, common, packing, token_files, words

TOKENIZER, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " ", "  ", "a", " a", "a  b\n c", "\n \n", "x" * 3000, "Hello <|endoftext|> there<|endoftext|>", "it's  we'll you　no", "é à\u0085 b", "1234 5678", "tab\tand\x0bmore \x1c z", "日本語 の テスト", "😀 😀😀"]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    blank = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x180E, 0x2000, 0x200B, 0x3000]
    letters = [97, 39, 115, 49, 46, 233, 0x4E00, 0x1F600, 0x0301, 0x3042, 0xE000]
    return ["".join(chr(rng.choice(blank if rng.random() < 0.35 else letters)) for _ in range(rng.randint(0, 15))) for _ in range(n)]


def docs(spark, texts, extra=True):
    rows = [(i, t, f"src{i % 3}", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ("ids long" if extra else "n_chars long"))


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_chunks_equal_the_tokenizer(tokenizer):
    encoder = chunks.tokenizer_encoder(open(TOKENIZER, "rb").read(), "<u2")
    texts = [t for t in ODD if t] + random_texts(1500)
    ids, ends = encoder(pa.array(texts))
    for t, a, b in zip(texts, ends[:-1], ends[1:], strict=True):
        assert ids[a:b].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_known_chunks_are_bounded():
    encoder = chunks.ChunkEncoder(lambda xs: [np.array([len(x)], "<u2").tobytes() for x in xs], "<u2", most=10)
    for k in range(20):
        texts = [f"{k}w{i} v{i} u{k}" for i in range(5)]
        ids, ends = encoder(pa.array(texts))
        assert ids.tolist() == [n for t in texts for n in (len(t.split(" ")[0]), len(t.split(" ")[1]) + 1, len(t.split(" ")[2]) + 1)]
    assert len(encoder.keys) < 60 and encoder.used <= len(encoder.flat)


def test_every_rank_is_reached(reference):
    bpe = byte_bpe.ByteBpe(open(RANKS, "rb").read(), P.PATTERN)
    texts = [t or "" for t in ODD] + random_texts(1500, 2)
    ids, ends = bpe.encode(pa.array(texts))
    for t, a, b in zip(texts, ends[:-1], ends[1:], strict=True):
        assert ids[a:b].tolist() == reference.encode_ordinary(t), repr(t)
        assert bpe.decode(ids[a:b]) == t.encode()


def test_encode_and_decode_frames(spark):
    df = docs(spark, ODD)
    encoded = byte_bpe.encode_documents(df, RANKS, P.PATTERN)
    back = {r.doc_id: bytes(r.data).decode() for r in byte_bpe.decode_documents(encoded, RANKS, P.PATTERN).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}
    assert byte_bpe.round_trip(df.limit(0), RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("weights", [None, {"src0": 1.0, "src1": 5.0, "src2": 0.2}])
def test_packing(spark, tokenizer, weights):
    rng = random.Random(5)
    texts = ODD + [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.choice([1, 30, 400, 3000]))) for _ in range(60)]
    df = docs(spark, texts).unionByName(docs(spark, texts).limit(2))
    out = packing.pack(df.repartition(5), TOKENIZER, weights=weights, per_chunk=4).toPandas()
    repeated = {r.doc_id for r in docs(spark, texts).limit(2).collect()}
    for doc_id, pieces in out.groupby("doc_id"):
        ids = np.array([*tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        assert pieces.length.sum() == len(ids) * (2 if doc_id in repeated else 1)
        for r in pieces.itertuples():
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    filled = out.sort_values(["sequence_id", "offset"])
    before = filled.groupby("sequence_id").length.cumsum() - filled.length
    assert (filled.offset == before).all()
    sizes = filled.groupby("sequence_id").length.sum()
    assert sorted(sizes.index) == list(range(len(sizes))) and all(n == 1024 or n & (n - 1) == 0 for n in sizes) and (sizes < 1024).sum() <= 10
    if weights is None:
        share = out.groupby(["sequence_id", "queue"]).length.sum().unstack().fillna(0)[sizes == 1024]
        target = out.groupby("queue").length.sum() / out.length.sum() * 1024
        assert (share - target).abs().max().max() < 2
    assert packing.pack(df.limit(0), TOKENIZER).count() == 0


def test_mixture_plans_are_whole():
    mix = packing.Mixture({"a": 100_001, "b": 7, "c": 33_333}, per_chunk=8)
    taken = np.zeros(3, np.int64)
    for chunk in range(-(-mix.total // (8 * 1024))):
        first, sends, sizes = mix.plan(chunk)
        assert (first == taken).all() and (sends >= 0).all() and sends.sum(axis=1).tolist() == sizes
        taken += sends.sum(axis=0)
    assert (taken == mix.totals).all()
    with pytest.raises(ValueError):
        packing.Mixture({"a": 5, "b": 5}, {"a": 1.0})


def test_deficits_are_carried_where_queues_end():
    """Token by token: the queue whose next token is due first is served; chunks planned apart say the same."""
    mix = packing.Mixture({"a": 900, "b": 5000, "c": 40, "d": 2600}, {"a": 1.0, "b": 1.0, "c": 0.3, "d": 2.0}, window=64, per_chunk=4)
    sent, served = np.zeros(4, np.int64), []
    for _ in range(mix.total):
        due = np.where(sent < mix.totals, (sent + 0.5) / mix.weights, np.inf)
        s = int(np.argmin(due))
        sent[s] += 1
        served.append(s)
    at = 0
    for chunk in range(-(-mix.total // 256)):
        first, sends, sizes = mix.plan(chunk)
        assert first.tolist() == np.bincount(served[:at], minlength=4).tolist()
        for size, send in zip(sizes, sends, strict=True):
            assert send.tolist() == np.bincount(served[at : at + size], minlength=4).tolist()
            at += size
            done = np.bincount(served[:at], minlength=4)
            deficits = mix.deficits(done)
            assert (np.abs(deficits) <= 1.5).all() and (deficits[done == mix.totals] == 0).all()
    assert at == mix.total


def test_sources_with_little_share_a_queue(spark, monkeypatch):
    monkeypatch.setattr(packing, "LEAST_SHARE", 0.1)
    rows = [(i, "word " * (300 if i < 4 else 3), "big" if i < 4 else f"host{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = packing.pack(df, TOKENIZER, power=0.5).toPandas()
    assert set(out.queue) == {"big", packing.REST} and out.groupby("doc_id").length.sum().equals(out.groupby("doc_id").doc_tokens.first())
    for _, pieces in out.sort_values("start").groupby("doc_id"):
        assert (pieces.start.to_numpy() == np.append(0, np.cumsum(pieces.length.to_numpy())[:-1])).all()


def test_range_coder_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 1023, 1024, 1025, 150_000):
        ids = np.minimum(rng.geometric(0.01, n), 4000).astype(np.uint16)
        freq = token_files.Frequencies(np.bincount(ids, minlength=5000) if n else np.zeros(5000))
        cuts = sorted(rng.integers(0, n + 1, 3)) if n else []
        lengths = np.diff([0, *cuts, n]).tolist()
        data = token_files.write_block([None, *range(len(lengths) - 1)], lengths, ids, freq)
        doc_ids, got_lengths, got = token_files.read_block(data, freq)
        assert got.tolist() == ids.tolist() and got_lengths.tolist() == lengths and doc_ids == [None, *range(len(lengths) - 1)]
        if n > 1000:
            assert len(data) < n * 2 + 40_000
            broken = bytearray(data)
            broken[-3] ^= 1
            with pytest.raises(ValueError):
                token_files.read_block(bytes(broken), freq)


def test_frequencies_sum_up():
    for counts in ([0, 1, 10**12], [1] * 50_257, [5], [0, 0]):
        f = token_files.Frequencies(np.array(counts)).f.astype(np.int64)
        assert f.sum() == ((1 << token_files.SCALE) if any(counts) else 0) and ((f > 0) == (np.array(counts) > 0)).all()


def test_token_files(spark, tokenizer):
    texts = ODD + ["word " * n for n in (10, 5000, 90_000)]
    rows = [(i * 7 % 23 if i else None, t, "s") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, payload string").repartition(4)
    path = token_files.written(df, TOKENIZER)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_digests(spark, path).collect()))
    at, order = 0, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for (start, doc_id, n, crc), (want, t, _) in zip(got, order, strict=True):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (start, doc_id, n, crc) == (at, want, len(ids), zlib.crc32(ids.tobytes()))
        at += n
    full = {r.doc_id: r.ids for r in token_files.read_tokens(spark, path).collect()}
    assert full[7] == [*tokenizer.encode(texts[1], add_special_tokens=False).ids, 0]
    assert token_files.read_digests(spark, token_files.written(df.limit(0), TOKENIZER)).count() == 0


def test_word_hashes():
    texts = ["Ab cD  ab\nCD", "", "ab", "x" * 2_000_000 + " ab", "éè éè"]
    buf, offsets = common.text_buffer(pa.array(texts))
    starts, ends, bounds = words.spans(buf, offsets)
    h = words.hashes(buf, starts, ends)
    assert np.diff(bounds).tolist() == [4, 0, 1, 2, 2]
    assert h[0] == h[2] == h[4] == h[6] and h[1] == h[3] and h[7] == h[8] and len(set(h.tolist())) == 4
    assert words.hashes(buf, starts, ends, "exact")[0] != h[4] and (words.hashes(buf, starts, ends, lane=1) != h).all()
    _, first, which = words.distinct(buf, starts, ends)
    assert len(first) == 4 and (which[[0, 2, 4, 6]] == which[0]).all()
    assert words.same(buf, starts, ends, np.array([0, 0, 1]), np.array([2, 1, 3]), lower=True).tolist() == [True, False, True]


def thue_morse(n, a="a", b="b"):
    """A word of n characters and its complement: sums of powers modulo 2^64 can't tell them apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(b if x else a for x in bits), "".join(a if x else b for x in bits)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_that_polynomials_confuse(n, tokenizer, reference):
    x, y = thue_morse(n)
    buf, offsets = common.text_buffer(pa.array([x, y]))
    for kind in ("lower", "exact", "raw"):
        starts, ends, _ = words.spans(buf, offsets)
        h = words.hashes(buf, starts, ends, kind)
        assert h[0] != h[1]
    encoder = chunks.tokenizer_encoder(open(TOKENIZER, "rb").read(), "<u2")
    bpe = byte_bpe.ByteBpe(open(RANKS, "rb").read(), P.PATTERN)
    for texts in ([x, y], [y, x, x + " " + y]):
        ids, ends = encoder(pa.array(texts))
        more, stops = bpe.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[ends[i] : ends[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids
            assert more[stops[i] : stops[i + 1]].tolist() == reference.encode_ordinary(t) and bpe.decode(more[stops[i] : stops[i + 1]]) == t.encode()


def test_chunks_whose_hashes_are_equal(monkeypatch):
    """With a hash that is the same for all, bytes still tell chunks apart."""
    monkeypatch.setattr(words, "hashes", lambda buf, starts, ends, kind="lower", lane=0: np.zeros(len(starts), np.uint64))
    encoder = chunks.ChunkEncoder(lambda xs: [np.frombuffer(x.encode(), np.uint8).astype("<u2").tobytes() for x in xs], "<u2")
    for texts in (["ab cd ab", "cd", "ef ab"], ["cd ef", "", "ab"]):
        ids, ends = encoder(pa.array(texts))
        assert [bytes(ids[a:b].astype(np.uint8)).decode() for a, b in zip(ends[:-1], ends[1:], strict=True)] == texts

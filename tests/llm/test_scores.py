"""Quality, neighbours, toxicity and language models against brute force and held-out labels."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from arrayloom.llm import brown, nearest, quality, toxicity

TEXTS = [None, "", " \n", "one", "a b c d e " * 30, "é # $ x | y\né # $ x | y\n\n \nz", "ab\x0bcd\x0cef", "word\n" * 3, " ".join(f"w{i}" for i in range(5000)), "é" * 20_000]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_base_counts(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "x", 2), (1, "", 1)], "doc_id long, text string, n_words int")
    rows = quality.judge(df).collect()
    assert len(rows) == len(TEXTS) + 2 and quality.judge(df.limit(0)).count() == 0
    for r in rows[: len(TEXTS)]:
        t, w = TEXTS[r.doc_id] or "", words(TEXTS[r.doc_id])
        lines = [x for x in t.split("\n") if words(x)]
        count = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))


def prose(rng, n):
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.choice([1, 1, 2, 3]))) for _ in range(n))


def test_compression_bands():
    rng = random.Random(1)
    noise = lambda n: "".join(chr(rng.randrange(33, 127)) if rng.random() < 0.85 else " " for _ in range(n))
    varied = " ".join(f"{'ab' * 40} {i}" for i in range(400))
    texts = [prose(rng, n) for n in (60, 200, 1000, 6000)] + [noise(3000), noise(40_000), varied]
    kept = quality.measures(pa.array(texts))["kept"].tolist()
    assert kept == [True] * 4 + [False] * 3


def test_verdicts_against_brute_force(spark):
    """Ratios and bands computed again, text by text."""
    import zstandard

    rng = random.Random(12)
    noise = lambda n: "".join(chr(rng.randrange(33, 127)) for _ in range(n))
    x, y = ("".join("ab"[bin(i).count("1") % 2 ^ k] for i in range(1024)) for k in (0, 1))
    texts = [prose(rng, rng.choice([5, 40, 300, 2500])) + (" " + noise(rng.choice([1, 300, 5000]))) * rng.randrange(2) + " again" * rng.choice([0, 0, 30, 900]) for _ in range(150)]
    texts += [f"{x} a b c d {y} a b c d", " ".join([x, y, x, y, y, x, y, x, x, y, x, y]), None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    press = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False)
    ratio = lambda data: len(press.compress(data)) / len(data)
    for r in quality.judge(df).collect():
        data = (texts[r.doc_id] or "").encode()
        w = words(texts[r.doc_id])
        seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        low, high = next((b[1], b[2]) for b in quality.BANDS[::-1] if len(data) >= b[0])
        parts = [data[i : i + 4096] for i in range(0, len(data) - 4095, 4096)] + ([data[-4096:]] if len(data) > 4096 and len(data) % 4096 else [])
        bad = sum(not 0.20 <= ratio(p) <= 0.68 for p in parts) if len(data) > 4096 else 0
        good = not data or (low <= ratio(data) <= high and bad <= 0.25 * len(parts))
        assert (r.n_repeat_words, r.base_failed, r.kept) == (len(covered), failed, not failed and good), r.doc_id


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 16)).astype(np.float32)
    base[50:90] = base[50]
    rows = [(i, [float(x) for x in v], "x") for i, v in enumerate(base)]
    rows += [(1000, None, "x"), (1001, [0.0] * 16, "x"), (1002, [math.nan] + [1.0] * 15, "x"), (1003, [None] + [1.0] * 15, "x"), (1004, [1.0, 2.0], "x"), (None, [1.0] * 16, "x"), (1050, [], "x"), (1100, [math.inf] * 16, "x"), (50, rows[50][1], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = collections.defaultdict(list)
    for r in sorted(nearest.search(df, df.where("vec_id % 50 = 0"), 5).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    good = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and i < 400]
    assert sorted(got) == list(range(0, 400, 50))
    for q in got:
        a = dict(good)[q]
        best = sorted((-round(float(a @ v / np.sqrt((a @ a) * (v @ v))), 12), i) for i, v in good if i != q)[:5]
        assert [x[1] for x in got[q]] == [i for _, i in best] and [x[0] for x in got[q]] == [1, 2, 3, 4, 5]
        assert all(abs(x[2] + s) < 1e-9 for x, (s, _) in zip(got[q], best))
    few = df.where("vec_id IN (100, 101, 102)")
    assert nearest.search(few, few.where("vec_id = 100")).count() == 2 and nearest.search(df.limit(0), df.limit(0)).count() == 0
    assert nearest.search(df, df.where("vec_id = 1001")).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 24)) * 10.0 ** rng.integers(-8, 8, (300, 1))
    whole, scale, error = nearest.rounded(v)
    unit = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    near = (whole.astype(float) @ whole.T.astype(float)) * scale[:, None] * scale[None, :]
    assert (np.abs(unit @ unit.T - near) <= error[:, None] * (1 + error[None, :]) + error[None, :]).all()


def test_bounds_hold_in_many_dimensions(spark):
    """Flat vectors of 4096 components, whose int8 products are as large as they get."""
    rng = np.random.default_rng(8)
    base = np.sign(rng.normal(size=4096)).astype(np.float32)
    v = np.tile(base, (120, 1))
    for i in range(120):
        v[i, rng.integers(0, 4096, i % 7)] *= -1
    q8, scale, error = nearest.rounded(v.astype(float))
    near = nearest.products(q8, q8) * scale[:, None] * scale[None, :]
    unit = v / np.sqrt((v.astype(float) ** 2).sum(axis=1, keepdims=True))
    assert (np.abs(unit @ unit.T - near) <= error[:, None] * (1 + error[None, :]) + error[None, :] + 1e-12).all()
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in sorted(nearest.search(df, df.where("vec_id % 50 = 0"), 5).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r.vec_id)
    cos = unit.astype(float) @ unit.T.astype(float)
    assert {q: sorted((-round(cos[q, j], 12), j) for j in range(120) if j != q)[:5] for q in got} == {q: [(-round(cos[q, j], 12), j) for j in js] for q, js in got.items()} and sorted(got) == [0, 50, 100]


def toxic_corpus(n=900, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = prose(rng, rng.choice([30, 80, 200])).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(max(1, len(w) // 25)):
                w.insert(rng.randrange(len(w)), rng.choice(["grubblet", "vexnoid", "zorpish"]))
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t, "zz") for i, t, _ in rows] + [(5000, None, "zz"), (5001, "", "zz"), (None, "some text", "zz"), (3, rows[3][1], "zz"), (7, "another text of this id", "zz"), (5002, "the an " * 100_000, "zz")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, b) for i, _, b in rows] + [(0, 1, 1), (8, 1, 0), (None, 1, 1), (12, 1, None), (16, 1, 7)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, steps=60, again=20)
    scored = toxicity.score(docs, model).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    truth = {i: b for i, _, b in rows}
    out = [(r.score >= 0.3, truth[r.doc_id]) for r in scored if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(out) > 150
    assert np.mean([p for p, b in out if b]) > 0.95 and np.mean([p for p, b in out if not b]) < 0.05
    misspelt = pa.array(["the on in grubblets there at it an of or", "the on in gruubblet there at it an of or", "the on in there at it an of or"])
    a, b, c = model.scores(misspelt)
    assert a > c and b > c
    kept = toxicity.rejected_removed(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {5000, 5001}
    assert toxicity.score(docs.limit(0), model).count() == 0
    untrained = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, untrained).collect()} == {0.0}


def test_subwords_are_bounded_by_words():
    flat, starts = toxicity.subwords([b"ab", b"abc", "é".encode()])
    counts = np.diff(np.append(starts, len(flat))).tolist()
    assert counts == [3, 6, 1]  # " ab " has 2 + 1, " abc " 3 + 2 + 1, " é " 1
    assert not len(toxicity.subwords([b"a"])[0]) - 1
    again, _ = toxicity.subwords([b"abc"])
    assert again.tolist() == flat[3:9].tolist()


@pytest.mark.parametrize("known", [1 << 18, 20])
def test_language_model(spark, known):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        side = ["red", "green", "blue"] if i % 2 else ["ein", "zwei", "drei"]
        rows.append((i, " ".join(rng.choice(side) + rng.choice(["", "s", "Ed", f"{rng.randrange(30)}"]) for _ in range(rng.randrange(30)))))
    x, y = ("".join("ab"[bin(i).count("1") % 2 ^ k] for i in range(1024)) for k in (0, 1))
    rows += [(500, None), (501, ""), (None, "red green"), (1, rows[1][1]), (502, x), (504, y), (505, f"{y} {y}"), (506, "wort " * 20_000)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, row int")
    got = brown.score(df, known=known).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = lambda t: [*words((t or "").translate(lower)), 0]
    count = collections.Counter(x for i, t in rows if not held(i) for x in tokens(t))
    total, distinct = sum(count.values()), len(count)
    want = sorted((i is None, i or 0, held(i), len(tokens(t)), sum(x in count for x in tokens(t)), total, round(sum(math.log10((count[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in tokens(t)), 6)) for i, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert brown.score(df.limit(0)).count() == 0
    ids = [i for i in range(500) if held(i)][:4]
    untrained = brown.score(spark.createDataFrame([(i, "some words " * i) for i in ids], "doc_id long, text string")).collect()
    assert {(r.held_out, r.n_known, r.train_tokens) for r in untrained} == {(True, 0, 0)} and all(math.isfinite(r.score) for r in untrained)


def test_scores_against_brute_force(spark):
    """Class bigrams counted again in Python with the model's classes."""
    rng = random.Random(16)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.choice([1, 1, 2, 3]) + rng.choice(["", "", f"{rng.randrange(9)}"]) for _ in range(rng.randrange(40)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    parameters = {"classes": 7, "head": 10, "known": 40}
    vocab = brown.vocabulary(df).cache()
    top = brown.most_frequent(vocab, 40).collect()
    assert 0 < len(top) <= 40 and min(r.n for r in top) > max((r.n for r in vocab.collect() if r.word not in {t.word for t in top}), default=0)
    m = brown.fit(df, vocab, **parameters)
    column = pa.array([t for _, t in rows])
    t = brown.tokens_of(column)
    label = m.classes.label(t, m.classes.known.of(t.word, t.other)).tolist()
    texts = [label[a:b] for a, b in zip(t.bounds[:-1], t.bounds[1:], strict=True)]
    tokens = [[*words(x), 0] for _, x in rows]
    count = collections.Counter(w for x in tokens for w in x)
    class_of = {w: c for x, ys in zip(tokens, texts, strict=True) for w, c in zip(x, ys, strict=True)}
    assert all(class_of[w] == c for x, ys in zip(tokens, texts, strict=True) for w, c in zip(x, ys, strict=True)) and class_of[0] == 0
    pairs, sizes = collections.Counter(), collections.Counter()
    for ys in texts:
        pairs.update(zip([0, *ys[:-1]], ys))
        sizes.update(ys)
    members, total = collections.Counter(class_of.values()), sum(sizes.values())
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    got = {r.doc_id: r.score for r in brown.score(df, held_out=99, **parameters).collect()}

    def score(x, ys):
        out = 0.0
        for w, before, c in zip(x, [0, *ys[:-1]], ys):
            share = (sizes[c] + 1) / (total + 7)
            follow = (pairs[before, c] + brown.PRIOR * share) / (sum(n for (a, _), n in pairs.items() if a == before) + brown.PRIOR)
            out += math.log10(follow) + math.log10((count[w] + 0.1) / (sizes[c] + 0.1 * (members[c] + 1)))
        return out

    assert all(got[i] == pytest.approx(score(x, ys)) for (i, _), x, ys in zip(rows, tokens, texts, strict=True)) and held(10) in (True, False)


def test_class_probabilities_sum_to_one(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(i, " ".join(rng.choice("abcdefgh") for _ in range(20))) for i in range(40)], "doc_id long, text string")
    vocab = brown.vocabulary(df)
    m = brown.fit(df, vocab)
    assert np.allclose((10**m.transition).sum(axis=1), 1)
    for c in range(brown.CLASSES):
        members = m.counts[m.classes.of_known == c]
        assert sum((n + 0.1) / 10 ** m.spread[c] for n in members) + 0.1 / 10 ** m.spread[c] == pytest.approx(1)


def test_exchange_finds_two_languages():
    rng = np.random.default_rng(5)
    n = 21
    x = np.zeros((n, n))
    for _ in range(3000):
        lang = rng.integers(2)
        a, b = rng.integers(10, size=2) + 10 * lang
        x[a, b] += 1
    cls = brown.exchange(x, classes=3, sweeps=20)
    assert cls[-1] == 0 and len(set(cls[:10])) == 1 and len(set(cls[10:20])) == 1 and cls[0] != cls[10]


def test_the_end_of_a_text_is_judged():
    rng = random.Random(4)
    text = prose(rng, 3000)[:4500] + " " + " ".join(["again and"] * 400)
    text = text[:8191]
    assert len(text) < 8192 and quality.measures(pa.array([text]))["bad_chunks"].tolist() == [1]
    whole = prose(rng, 3000)[:8191]
    assert quality.measures(pa.array([whole, whole[:4096], whole[:4097]]))["bad_chunks"].tolist() == [0, 0, 0]

"""Near duplicates and repeated passages against brute force."""

import collections
import random
import time
import re

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from arrayloom.llm import components, near, passages

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def by_brute_force(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    return sorted((d is None, d or 0, len(sets[i]), (d if not sets[i] else ids.get(find(i)))) for i, (d, _) in enumerate(rows))


def corpus():
    rng = random.Random(2)
    voc = [f"w{i}" for i in range(400)]
    base = [[rng.choice(voc) for _ in range(rng.choice([3, 20, 60, 200]))] for _ in range(40)]
    rows = []
    for b in base + [base[3]] * 5:
        rows.append(" ".join(b))
        for _ in range(rng.choice([0, 1, 6])):
            c = list(b)
            for _ in range(rng.choice([1, 1, 2, 4])):
                c[rng.randrange(len(c))] = rng.choice(voc)
            rows.append((" ".join(c)).upper() if rng.random() < 0.3 else " ".join(c))
    rows += [None, "", " \n\t", "one", "ONE", "two words", "x y z", "x  y\nz"]
    rng.shuffle(rows)
    out = [(i * 3 + 1, t) for i, t in enumerate(rows)]
    return out + [(None, out[5][1]), (None, "nowhere else to be found at all"), out[7], (out[9][0], out[10][1])]


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, k):
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, node int, class string").repartition(3)
    got = near.near_duplicates(df, k, 80).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in got) == by_brute_force(rows, k, 80)
    assert all(r.kept == (r.component_id is None or r.doc_id == r.component_id) for r in got)


def test_one_large_group(spark):
    """Many near copies of one text, so that most pairs share their rarest coordinates."""
    rng = random.Random(7)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(160):
        c = list(base)
        for _ in range(rng.randrange(6)):
            c[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(c)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near.near_duplicates(df, 4, 80).collect()
    assert sorted((False, r.doc_id, r.n_shingles, r.component_id) for r in got) == by_brute_force(rows, 4, 80)


def test_removal_keeps_one_of_each(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "en") for d, t in rows], "doc_id long, text string, lang string")
    kept = near.duplicates_removed(df, 5, 80).collect()
    sets = [shingles(r.text, 5) for r in kept]
    assert not any(a and b and 100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert {r.text for r in kept} >= {None, "", " \n\t"} and near.near_duplicates(df.limit(0)).count() == 0
    assert df.columns == near.duplicates_removed(df, 5, 80).columns


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: {x} for e in edges for x in e if e[0] != e[1]}
    for a, b in edges:
        if a != b and want[a] is not want[b]:
            both = want[a] | want[b]
            for x in both:
                want[x] = both
    assert got == {x: min(s) for x, s in want.items()}


def test_chains_take_the_best_path():
    b, a = [0, 5, 10, 15, 12], [100, 105, 110, 115, 3]
    assert passages.chains(b, a)[0] == [0, 1, 2, 3]
    assert sorted(map(sorted, passages.chains([0, 100], [0, 100]))) == [[0], [1]]
    rng = np.random.default_rng(4)
    for _ in range(30):
        b, a = rng.integers(0, 60, 12).tolist(), rng.integers(0, 60, 12).tolist()
        best = {}
        for i in sorted(range(12), key=lambda i: (b[i], a[i])):
            best[i] = 5 + max([0.0] + [best[j] - 0.1 * (a[i] + b[i] - a[j] - b[j]) for j in best if b[j] < b[i] and a[j] < a[i]])
        chain = passages.chains(b, a)[0]
        score = 5 * len(chain) - 0.1 * (a[chain[-1]] + b[chain[-1]] - a[chain[0]] - b[chain[0]])
        assert score == pytest.approx(max(best.values()))
        assert all(b[x] < b[y] and a[x] < a[y] for x, y in zip(chain, chain[1:]))


def planted():
    rng = random.Random(9)
    word = lambda: f"v{rng.randrange(5000)}"
    passage = [word() for _ in range(70)]
    rows = [[word() for _ in range(300)] for _ in range(60)]
    holds = {}
    for i in range(0, 60, 4):
        copy = list(passage)
        if i:
            copy[rng.randrange(70)] = word()
            del copy[rng.randrange(70)]
        at = rng.randrange(200)
        rows[i][at:at] = copy
        holds[i] = at
    return rows, holds


def test_passages_are_found_and_cut(spark):
    rows, holds = planted()
    texts = [(i, " ".join(w), "en", len(" ".join(w)), 7) for i, w in enumerate(rows)]
    texts += [(100, None, "en", 0, 1), (101, "", "en", 0, 1), (102, "too short", "en", 9, 1), (None, texts[1][1], "en", 1, 1)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string, n_chars long, row int")
    found = passages.repeated_passages(df).collect()
    assert {r.doc_id for r in found} == set(holds) - {0} | {None}
    for r in found:
        if r.doc_id is not None:
            assert r.source_doc_id in holds and abs(r.start - holds[r.doc_id]) <= 3 and 60 <= r.end - r.start <= 76
    cut = {r.doc_id: r for r in passages.passages_removed(df).collect()}
    assert None not in cut and cut[0].text == texts[0][1] and cut[1].text == texts[1][1] and cut[100].text is None and cut[102].row == 1
    for i in set(holds) - {0}:
        assert 295 <= len(cut[i].text.split()) <= 310 and cut[i].n_chars == len(cut[i].text)
    assert passages.repeated_passages(df.limit(0)).count() == 0


def test_without_spans_keeps_the_rest():
    assert passages.without_spans("a  b\nc d é f ", [(1, 3), (4, 5)]) == "a  d f "
    assert passages.without_spans("a b", [(0, 9)]) == ""


def test_runs_of_one_word_match_place_by_place(spark):
    rows = [(1, "a start " + "same " * 300), (2, "x y z " + "same " * 200 + "end"), (3, " ".join(f"q{i}" for i in range(100)))]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.source_doc_id) for r in found} == {(2, 1)} and max(r.end - r.start for r in found) >= 195


def test_fuzzy_passages_down_to_eighty_percent(spark):
    """50 words of which 5 to 8 are replaced (84 to 90 % agreement), all in a document of their own."""
    rng = random.Random(21)
    word = lambda: f"z{rng.randrange(10**6)}"
    rows = []
    for i in range(120):
        passage = [word() for _ in range(50)]
        copy = list(passage)
        for j in rng.sample(range(5, 45), 5 + i % 4):
            copy[j] = word()
        for p in (passage, copy):
            rows.append((len(rows), " ".join([word() for _ in range(60)] + p + [word() for _ in range(60)])))
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.source_doc_id) for r in found} == {(i + 1, i) for i in range(0, 240, 2)}


@pytest.mark.parametrize("pieces", [[(0, 30), (30, 60)], [(0, 34), (26, 60)], [(0, 25), (18, 43), (36, 60)]])
def test_passages_whose_fragments_stand_in_earlier_documents(spark, pieces):
    rng = random.Random(5)
    word = lambda: f"f{rng.randrange(10**6)}"
    passage = [word() for _ in range(60)]
    parts = [passage[a:b] for a, b in pieces] + [passage]
    parts = parts + parts + [passage]  # fragments stand between the whole ones as well
    rows = [(i, " ".join([word() for _ in range(50)] + p + [word() for _ in range(50)])) for i, p in enumerate(parts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first, n = len(pieces), len(parts)
    whole = [2 * first + 1, n - 1]
    found = {(r.doc_id, r.source_doc_id): (r.start, r.end) for r in passages.repeated_passages(df).collect()}
    assert all((b, first) in found and found[b, first][0] <= 50 and found[b, first][1] >= 110 for b in whole)
    cut = {r.doc_id: r.text.split() for r in passages.passages_removed(df).collect()}
    assert all(not set(passage) & set(cut[b]) and len(cut[b]) == 100 for b in whole) and len(cut[first]) == 160


def test_removal_where_ids_repeat(spark):
    rng = random.Random(3)
    text = lambda: " ".join(f"r{rng.randrange(10**6)}" for _ in range(40))
    x, y, z = text(), text(), text()
    rows = [(1, x), (5, x), (5, y), (6, y), (7, z), (7, z + " end"), (8, ""), (8, ""), (9, "lone"), (9, "other")]
    kept = near.duplicates_removed(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    got = sorted((r.doc_id, r.text) for r in kept)
    assert [r for r in got if r[0] != 7] == [(1, x), (5, y), (8, ""), (8, ""), (9, "lone"), (9, "other")]
    assert sum(r.doc_id == 7 for r in kept) == 1


def test_sets_of_words_that_polynomials_confuse(spark):
    x, y = ("".join("ab"[bin(i).count("1") % 2 ^ k] for i in range(2048)) for k in (0, 1))
    rows = [(1, x), (2, y), (3, f"{x} {y} c d e"), (4, f"{y} {x} c d e"), (5, x.upper())]
    got = {r.doc_id: r.component_id for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_what_a_list_holds_outside_its_largest_component(spark, monkeypatch):
    """Two families that share coordinates, and small blocks: links beyond the typical class are found by collisions."""
    monkeypatch.setattr(near, "BLOCK", 16)
    monkeypatch.setattr(near, "PROBES", 8)
    rng = random.Random(12)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(90):  # a chain of drifting copies: the ends are far from the middle
        if i % 3 == 0:
            base[rng.randrange(150)] = f"d{i}"
        c = list(base)
        c[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(c)))
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()
    assert sorted((False, r.doc_id, r.n_shingles, r.component_id) for r in got) == by_brute_force(rows, 4, 80)


def test_removals_lose_no_text(spark):
    """Rows that repeat, ids with several texts, null ids, and columns with the names that the operators use."""
    rng = random.Random(40)
    text = lambda n: " ".join(f"u{rng.randrange(10**7)}" for _ in range(n))
    a, b, c, d, e, long = text(100), text(80), text(60), text(50), text(20), text(30_000)
    rows = [(3, b), (5, a), (5, b), (1, a), (1, a), (None, c), (None, c), (None, d), (7, d), (8, None), (8, None), (9, e), (9, e), (None, e), (10, b + " " + e), (11, long), (12, long + " end")]
    extra = "doc_id long, text string, id long, key string, cuts int, gone boolean, several int, row int, doc string, _cut_id int, class string, node int, n_chars long"
    df = spark.createDataFrame([(i, t, 1, "k", 2, True, 3, n, "x", 4, "c", 5, 0) for n, (i, t) in enumerate(rows)], extra).repartition(3)
    for kept in (near.duplicates_removed(df, 5, 80), passages.passages_removed(df)):
        assert kept.columns == df.columns
        found = kept.collect()
        assert all(r.key == "k" and r.cuts == 2 and r.gone is True and r.several == 3 and r._cut_id == 4 for r in found)
        left = " ".join(r.text or "" for r in found).split()
        assert set(left) == set(" ".join(t or "" for _, t in rows).split())
    once = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in near.duplicates_removed(df, 5, 80).collect())
    assert [x[:2] for x in once if x[2] in (a, b, c, d)] == [(False, 1), (False, 3), (False, 7), (True, 0)] and sum(x[2] == "" for x in once) == 2
    cut = [(r.doc_id, r.text) for r in passages.passages_removed(df).collect()]
    assert sorted(t for _, t in cut if t in (a, b, c, d)) == sorted([a, b, c, d]) and sum(t == e for _, t in cut) == 4 and (1, a) in cut and (3, b) in cut


def test_rough_passages_whose_seeds_stand_in_documents_before_and_between(spark):
    """The only earlier document that holds a passage, roughly, is neither first nor previous holder of any of its seeds."""
    rng = random.Random(15)
    word = lambda: f"m{rng.randrange(10**7)}"
    passage = [word() for _ in range(60)]
    rough = [word() if i % 8 == 7 else w for i, w in enumerate(passage)]
    runs = [passage[i : i + 7] for i in range(0, 60, 8)]
    apart = [[word() for _ in range(60)] + r + [word() for _ in range(60)] for r in runs if len(r) >= 5]
    docs = apart + [[word() for _ in range(50)] + rough + [word() for _ in range(50)]] + apart[::-1] + [[word() for _ in range(30)] + passage + [word() for _ in range(70)]]
    docs = [d + [word()] for d in docs]
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    found = {(r.doc_id, r.source_doc_id): (r.start, r.end) for r in passages.repeated_passages(df).collect()}
    b, a = len(docs) - 1, len(apart)
    assert (b, a) in found and found[b, a][0] <= 30 and found[b, a][1] >= 89
    cut = {r.doc_id: r.text.split() for r in passages.passages_removed(df).collect()}
    assert not set(passage[:59]) & set(cut[b]) and set(cut[a]) == set(docs[a])


def test_places_of_repeated_words_are_merged():
    """What is left covers the same words from the same source places, and a long run of one word needs few of its places."""
    rng = random.Random(8)
    for _ in range(600):
        pb, pa, x = [], [], rng.choice([0, 7, 100])
        for _ in range(rng.choice([1, 20, 300])):
            n, t = rng.choice([1, 1, 3, 10]), rng.choice([0, 0, 5])
            pb, pa, x = pb + list(range(x, x + n)), pa + list(range(t, t + n)), x + n + (rng.random() < 0.02) * rng.choice([3, 40, 100])
        b, a = np.array(pb), np.array(pa)
        keep = passages.needed(b, a, 40)
        assert {y for p in b[keep].tolist() for y in range(p, p + 40)} == {y for p in pb for y in range(p, p + 40)} and set(a[keep]) == set(pa)
    one = np.arange(900)
    assert passages.needed(one + 200, one * 0, 40).sum() < 130 and passages.needed(one, one + 7, 40).all()


def test_equal_words_beside_words_that_agree_by_half(spark):
    """40 equal words are a passage also where an alignment goes on into words of which only some agree."""
    rng = random.Random(6)
    word = lambda: f"h{rng.randrange(10**7)}"
    core, beside = [word() for _ in range(40)], [word() for _ in range(40)]
    other = [w if i % 5 not in (1, 3) else word() for i, w in enumerate(beside)]
    rows = [(1, " ".join(beside + core + beside)), (2, " ".join(other + core + other)), (3, " ".join(word() for _ in range(90)))]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.source_doc_id) for r in found} == {(2, 1)} and any(r.start <= 40 and r.end >= 80 for r in found)


def test_passages_against_brute_force(spark):
    """All pairs of some hundred documents: every run of 40 equal words of an earlier document is found, and what is found agrees."""
    rng = random.Random(77)
    word = lambda: f"p{rng.randrange(10**6)}"
    pool = [[word() for _ in range(rng.choice([50, 70, 90]))] for _ in range(25)]
    docs = []
    for i in range(240):
        w = [word() for _ in range(rng.choice([0, 20, 60]))]
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            p = rng.choice(pool)
            lo = rng.choice([0, 0, rng.randrange(len(p) // 2)])
            part = list(p[lo : lo + rng.choice([15, 25, 39, 40, 41, 90])])
            if rng.random() < 0.3:
                for _ in range(rng.choice([1, 3])):
                    part[rng.randrange(len(part))] = word()
            w += part + [word() for _ in range(rng.choice([0, 1, 30]))]
        docs.append(w)
    rows = [(i, " ".join(w)) for i, w in enumerate(docs)]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    covered = [set() for _ in docs]
    for r in found:
        b, a = docs[r.doc_id][r.start : r.end], docs[r.source_doc_id][r.source_start : r.source_end]
        assert r.source_doc_id < r.doc_id and min(len(a), len(b)) >= 40
        assert 100 * passages.common_subsequence(np.array(b), np.array(a)) >= 80 * max(len(a), len(b))
        covered[r.doc_id] |= set(range(r.start, r.end))
    first, missed = {}, 0
    for i, w in enumerate(docs):
        runs = [(tuple(w[j : j + 40]), j) for j in range(len(w) - 39)]
        for run, j in runs:
            if run in first and first[run] < i:
                missed += len(set(range(j, j + 40)) - covered[i])
        for run, _ in runs:
            first.setdefault(run, i)
    assert missed == 0 and sum(map(bool, covered)) > 60


def test_open_pairs_of_one_document_go_no_further():
    """Of pairs of seeds, those that no other document holds, or that are open nowhere, aren't marked; all others are."""
    rng = np.random.default_rng(7)
    phrases = rng.integers(0, 2**32, (200, 6), np.uint32)
    bits = lambda x: zstandard.ZstdCompressor().compress(np.packbits(x).tobytes())
    batches, holders, opened = [], collections.defaultdict(set), set()
    for number in range(4):
        docs = [np.concatenate([np.append(phrases[p], rng.integers(0, 2**32, 5, np.uint32)) for p in rng.integers(0, 200, 6)]) for _ in range(15)]
        docs[0][:30] = docs[0][30:60] if number else docs[0][:30]
        sizes = np.array([len(d) for d in docs], np.int32)
        this = passages.Batch(number, np.arange(15).tobytes(), sizes.tobytes(), np.concatenate(docs).astype("<u4").tobytes(), raw=True)
        repeats = np.tile([1, 1] + [0] * 9, 15 * 6).astype(bool)
        found = passages.Open(this, bits(repeats), bits(repeats & (np.arange(len(repeats)) % 66 < 33)), [], 40)
        x, y, key, is_open = (np.concatenate(v) for v in zip(*found.pairs(np.ones(len(found.at), bool)), strict=True))
        assert ((y - x >= found.shortest) & (y - x <= found.shortest + passages.NEAR)).all()
        for k, t, o in zip(key.tolist(), found.text[x].tolist(), is_open.tolist(), strict=True):
            holders[k].add((number, t))
            opened |= {k} if o else set()
        batches.append((number, key, is_open, passages.Filed(key, found.text[x], 1, 1, 0)))
    rows = []
    for number, _, is_open, filed in batches:
        flags = np.zeros(len(filed.key), bool)
        flags[filed.which[is_open]] = True
        rows.append({"bucket": 0, "batch": number, "prints": filed.blobs()[1][0], "opened": np.packbits(flags).tobytes()})
    answers = {r["batch"]: {0: r["bits"]} for r in passages._open_answers(pa.Table.from_pylist(rows)).to_pylist()}
    got, posted = set(), 0
    for number, key, is_open, filed in batches:
        filed.several &= np.bincount(filed.which, is_open, len(filed.key)) > 0
        at = filed.marked(answers.get(number, {}))
        got |= set(key[at].tolist())
        posted += len(at)
    assert got == {k for k in opened if len(holders[k]) > 1} and 0 < 5 * posted < sum(len(key) for _, key, _, _ in batches)


def test_open_pairs_go_further_only_from_documents_after_the_first():
    """A bucket asks for the pairs that are open in a document after the first one with them (in the same batch, or in another one by
    classes of doc_ids, where these tell), and for no others; crowds are those of the pairs that are open in several documents."""
    rng = np.random.default_rng(8)
    ids = rng.permutation(400).reshape(8, 50)
    edges = np.arange(20, 400, 20)
    holders, rows, keys = collections.defaultdict(list), [], {}
    for number in range(8):
        n = 3000
        text, key, is_open = rng.integers(0, 50, n), passages.mix(rng.integers(0, 6000, n).astype(np.uint64)), rng.random(n) < 0.2
        filed = passages.Filed(key, text, 1, 1, 0)
        for k, t, o in zip((key >> np.uint64(32)).tolist(), text.tolist(), is_open.tolist(), strict=True):
            holders[k].append((int(ids[number][t]), number, o))
        order = np.argsort(ids[number])
        rank = np.argsort(order).astype(np.int32)
        standing = filed.standing(rank[text], np.searchsorted(edges, ids[number][order], "right"), is_open)
        opened, places = np.zeros(len(filed.key), bool), np.bincount(filed.which).astype(np.uint8)
        opened[filed.which[is_open]] = True
        press = zstandard.ZstdCompressor()
        rows.append({"bucket": 0, "batch": number, "prints": filed.blobs()[1][0], "opened": np.packbits(opened).tobytes(), "places": press.compress(places.tobytes()), "standing": press.compress(standing.tobytes())})
        keys[number] = filed.key.tolist()
    marks = lambda r, c: {k for k, m in zip(keys[r["batch"]], np.unpackbits(np.frombuffer(r[c], np.uint8)).tolist(), strict=False) if m}
    answers = passages._open_answers(pa.Table.from_pylist(rows)).to_pylist()
    needed = {k for k, held in holders.items() if any(o and d > min(held)[0] for d, _, o in held)}
    unknown = {k for k, held in holders.items() if any(o and any(b != n and d // 20 == e // 20 for e, b, _ in held) for d, n, o in held)}
    shared = {k for k, held in holders.items() if any(o for *_, o in held) and len({d for d, *_ in held}) > 1}
    for r in answers:
        got = marks(r, "bits")
        assert needed & set(keys[r["batch"]]) <= got <= (needed | unknown)
        assert marks(r, "many") == {k for k in shared if len(holders[k]) > passages.MANY} & set(keys[r["batch"]])
    assert len(shared - needed - unknown) > 500
    without = [{c: v for c, v in r.items() if c != "standing"} for r in rows]
    marked = {k for r in passages._open_answers(pa.Table.from_pylist(without)).to_pylist() for k in marks(r, "bits")}
    assert marked == {k for k in shared if len({n for _, n, _ in holders[k]}) > 1}  # all, where the order isn't told


def test_documents_that_share_a_line_only_do_not_all_meet(spark, monkeypatch):
    """Many documents with one line make no chain of each two; those whose words beside it agree too are found among them."""
    rng = random.Random(31)
    word = lambda: f"l{rng.randrange(10**7)}"
    words = lambda n: [word() for _ in range(n)]
    line, after, before = words(20), words(28), words(30)
    rough = lambda part: [word() if i % 5 == 4 else w for i, w in enumerate(part)]
    docs = [words(60) + line + words(60) for _ in range(150)]
    docs[40] = words(60) + line + after + words(40)
    docs[120] = words(30) + line + rough(after) + words(50)
    docs[60] = words(40) + before + line + words(50)
    docs[140] = words(50) + rough(before[:20]) + [word()] + before[20:] + line + words(50)
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    made, aligned = [], passages._aligned

    def counted(batches, chains_, least, percent):
        made.append(chains_.count())
        return aligned(batches, chains_, least, percent)

    monkeypatch.setattr(passages, "_aligned", counted)
    found = {(r.doc_id, r.source_doc_id): (r.start, r.end) for r in passages.repeated_passages(df).collect()}
    assert set(found) == {(120, 40), (140, 60)}
    assert found[120, 40][0] == 30 and found[120, 40][1] >= 70 and found[140, 60][1] == 101
    assert sum(made) < 5 * len(docs)


def test_stretches_of_passages_are_possible():
    """Wherever a run of equal words and the words beside it align to a passage, the test that comes before says that they can."""
    rng = random.Random(12)
    word = lambda: rng.randrange(1, 2**32)
    passed = refused = 0
    for _ in range(1500):
        share = rng.choice([0.1, 0.2, 0.3, 0.6, 1.0])

        def noisy(part, share=share):
            out = []
            for w in part:
                kind = rng.random() / share
                out += [word()] if kind < 0.7 else [] if kind < 0.85 else [w, word()] if kind < 1 else [w]
            return out

        before, run, after = ([word() for _ in range(n)] for n in (rng.randrange(70), rng.randrange(14, 45), rng.randrange(70)))
        docs = [before + run + after]
        other = noisy(before)
        docs.append([word() for _ in range(rng.randrange(80))] + other + run + noisy(after) + [word() for _ in range(rng.randrange(80))])
        at = [len(before)]
        at.append(next(i for i in range(len(docs[1])) if docs[1][i : i + len(run)] == run))
        sizes = np.array([len(d) for d in docs], np.int32)
        number = 5 << 24
        this = passages.Batch(number, np.arange(2).tobytes(), sizes.tobytes(), np.array(docs[0] + docs[1], "<u4").tobytes(), raw=True)
        x, y = np.array(at), np.array(at) + len(run) - passages.K
        near_by = passages.Around([(number, *passages.Around.packed(this, np.arange(2), x, y))])
        side = lambda d: (this.rows[d : d + 1], x[d : d + 1], y[d : d + 1] + passages.K)
        possible = near_by.possible(side(1), side(0), 40, 80)[0]
        found = list(passages.agreeing(*(np.array(docs[d], "<u4") for d in (1, 0)), [x[1], y[1]], [x[0], y[0]], 40, 80))
        assert possible or not found
        passed, refused = passed + bool(found), refused + (not possible)
    assert passed > 300 and refused > 150


def crowded(docs, x, y, key):
    """A table of posted pairs: of each document the places (x, y), all of one key, all open, with the words around them."""
    sizes = np.array([len(d) for d in docs], np.int32)
    number, text = 5 << 24, np.repeat(np.arange(len(docs)), [len(v) for v in x])
    this = passages.Batch(number, np.arange(len(docs)).tobytes(), sizes.tobytes(), np.concatenate(docs).astype("<u4").tobytes(), raw=True)
    x, y = np.concatenate(x), np.concatenate(y)
    places = b"".join(passages._planes(v, n) for v, n in ((text, 2), (x, 4), (y - x, 1), (np.ones(len(x), np.int64), 1)))
    stretches, words = passages.Around.packed(this, text, x, y)
    row = {"batch": number, "seeds": passages._steps(np.full(len(x), key, np.uint64), 8), "places": zstandard.ZstdCompressor().compress(places)}
    return this, pa.Table.from_pylist([row | {"doc_ids": passages._split(np.unique(text)), "stretches": stretches, "words": words}])


def test_documents_with_a_passage_in_their_stretches_meet():
    """Wherever equal words and what is beside them align to a passage the two documents meet; runs of less than `least` words don't make them."""
    rng = random.Random(13)
    word = lambda: rng.randrange(1, 2**32)
    words = lambda n: [word() for _ in range(n)]
    passed = refused = 0
    for _ in range(600):
        before, run, after, share = words(rng.randrange(60)), words(rng.randrange(14, 45)), words(rng.randrange(60)), rng.choice([0.1, 0.2, 0.3, 0.6, 1.0])
        noisy = lambda part, share=share: [w for x in part for w in ([x] if rng.random() > share else rng.choice([[word()], [word()], [], [x, word()]]))]
        docs = [words(rng.randrange(80)) + before + run + after, words(rng.randrange(80)) + noisy(before) + run + noisy(after) + words(rng.randrange(80))]
        at = [next(i for i in range(len(d)) if d[i : i + len(run)] == run) for d in docs]
        last = len(run) - passages.K
        this, table = crowded(docs, [np.array([i]) for i in at], [np.array([i + last]) for i in at], 9)
        near_by = passages.Around([(5 << 24, table["stretches"][0].as_py(), table["words"][0].as_py())])
        meet = near_by.meeting(this.rows[1:], this.rows[:1], 40, 80)[0]
        found = list(passages.agreeing(*(np.array(docs[d], "<u4") for d in (1, 0)), [at[1], at[1] + last], [at[0], at[0] + last], 40, 80))
        assert meet or not found
        passed, refused = passed + bool(found), refused + (not meet)
    assert passed > 100 and refused > 50
    docs = [words(70) + [7] * n + words(70) for n in (60, 39, 60)]
    this, table = crowded(docs, [np.array([70])] * 3, [np.array([95])] * 3, 9)
    near_by = passages.Around([(5 << 24, table["stretches"][0].as_py(), table["words"][0].as_py())])
    assert near_by.meeting(this.rows[[1, 2, 2]], this.rows[[0, 0, 1]], 40, 80).tolist() == [False, True, False]


def test_pairs_in_many_places_of_a_document_meet_by_their_seeds():
    """Thirty documents of two runs, 676 pairs from the one to the other in each: 2 * 676 matches of two documents, not made from 676 * 676."""
    rng = random.Random(14)
    docs = [[rng.randrange(10, 2**32) for _ in range(60)] + [7] * 30 + [8] * 30 + [rng.randrange(10, 2**32) for _ in range(60)] for _ in range(30)]
    x, y = (v.ravel() for v in np.meshgrid(np.arange(60, 86), np.arange(90, 116), indexing="ij"))
    _, table = crowded(docs, [x] * 30, [y] * 30, 9)
    began = time.monotonic()
    found = pa.concat_tables(passages._all_holders(table, 40, 80))
    assert time.monotonic() - began < 20
    assert found.num_rows == 435 * 2 * 676
    m = found["m"].to_numpy()[:1352]
    assert {(int(v >> 32), int(v & 0xFFFFFFFF)) for v in m} == {(b, a) for v in (x, y) for b in v.tolist() for a in v.tolist()}


def test_tables_of_all_documents_are_not_broadcast(spark):
    """What batches unpack to, a row for each document, is larger than their files: Spark must not broadcast it by the size of these."""
    rng = random.Random(77)
    text = lambda n: " ".join(f"u{rng.randrange(10**7)}" for _ in range(n))
    long = [text(60) for _ in range(5)]
    df = spark.createDataFrame(list(enumerate([*long, *(x + " " + text(3) for x in long), *(text(3) for _ in range(200))])), "doc_id long, text string")
    out = passages.repeated_passages(df, every_holder=False)
    assert {(r.doc_id, r.source_doc_id) for r in out.collect()} == {(i + 5, i) for i in range(5)}
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_matches_leave_a_task_as_a_row_for_two_documents():
    """All places are kept, whether few or many, and take less than a quarter of the room where many are near each other."""
    places = [(b, a, (x << 32) | y) for b, a, n in ((7, 3, 60), (7, 4, 2), (9 << 40, 3, 9)) for x in range(n) for y in range(n)]
    table = pa.table([np.array(c) for c in zip(*places, strict=True)], names=["b", "a", "m"])
    packed = passages._packed_matches(table)
    assert packed.num_rows == 3 and 4 * packed.nbytes < table.nbytes
    assert [(r["b"], r["a"], m) for r in packed.to_pylist() for m in passages._unpacked_matches(r["m"]).tolist()] == places
    assert passages._packed_matches(table.slice(0, 0)).num_rows == 0


def test_query_meets_all_holders(spark, tmp_path):
    """The query finds the passage whose only earlier document is neither first nor previous holder of any of its seeds."""
    queries = pytest.importorskip("arrayloom.llm.queries")
    rng = random.Random(15)
    word = lambda: f"m{rng.randrange(10**7)}"
    passage = [word() for _ in range(60)]
    rough = [word() if i % 8 == 7 else w for i, w in enumerate(passage)]
    apart = [[word() for _ in range(60)] + passage[i : i + 7] + [word() for _ in range(60)] for i in range(0, 56, 8)]
    docs = apart + [[word() for _ in range(50)] + rough + [word() for _ in range(50)]] + apart[::-1] + [[word() for _ in range(30)] + passage + [word() for _ in range(70)]]
    docs = [d + [word()] for d in docs]
    spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.doc_id, r.source_doc_id) for r in queries.op5_chained_passages(spark, str(tmp_path)).collect()}
    assert (len(docs) - 1, len(apart)) in found

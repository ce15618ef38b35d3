"""The pipeline and the registered queries on the smallest tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers as P
import pytest

import __spark_entry__
import corpus_pipeline
from arrayloom.llm import common, near, packing, passages, quality, queries, toxicity

CONTRACT = {
    1: ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    2: ["doc_id", "n_shingles", "component_id", "kept"],
    3: ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    4: ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    5: ["doc_id", "source_doc_id"],
    6: ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    7: ["query_id", "rank", "vec_id", "score"],
    8: ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    9: ["doc_id", "held_out", "score", "predicted"],
    10: ["doc_id", "start", "n_tokens", "ids_crc32"],
}


def test_one_query_for_each_operator():
    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns(name, spark, sf_dir):
    df = queries.QUERIES[name](spark, sf_dir)
    assert set(CONTRACT[int(name[2:].split("_")[0])]) <= set(df.columns)
    assert df.count() > 0


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    ids = [set(seen)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, _ = common.staged(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == columns
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert ids[-1] <= ids[-2], name
    left = {r.doc_id: r.text for r in docs.collect()}
    assert ids[3] < ids[2] and 0.5 * len(seen) < len(left) < len(seen)
    assert all(len(left[i] or "") <= len(seen[i] or "") for i in left)
    tokenizer = __import__("tokenizers").Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).toPandas()
    assert set(packed.doc_id) == set(left)
    for doc_id, pieces in packed.groupby("doc_id"):
        want = np.array([*tokenizer.encode(left[doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        assert pieces.length.sum() == len(want)
        assert all(r.ids_crc32 == zlib.crc32(want[r.start : r.start + r.length].tobytes()) for r in pieces.itertuples())


def test_odd_rows_pass_every_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    odd = spark.createDataFrame([(None, None, None, None, None), (9001, "", "en", None, 0), (9002, "word " * 30_000, None, "s", 150_000), (9003, "x", "en", "s", 1), (9003, "x", "en", "s", 1)], docs.schema)
    every = docs.unionByName(odd).unionByName(docs.limit(1))
    for table in (every, every.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, sf_dir)
            out.count()
            table = out if "text" in out.columns else table


def test_training_sample_is_bounded_and_fixed(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    key = lambda r: r.doc_id
    rows = sorted(toxicity.training_sample(docs, labels, per_class=5).collect(), key=key)
    assert 2 < len(rows) <= 10 and 0 < rows[0].prevalence < 1 and all(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in rows)
    assert sorted(toxicity.training_sample(docs.repartition(7).unionByName(docs), labels, per_class=5).collect(), key=key) == rows
    few = toxicity.training_sample(docs, labels, per_class=50, most_bytes=5000).collect()
    assert 0 < sum(len(r.text.encode()) for r in few if r.label) <= 5000


def random_text(rng, n):
    return " ".join("".join(rng.choice("aeioubcdlmnprst") for _ in range(rng.choice([4, 5, 6, 7]))) for _ in range(n))


def pipeline_tables(path):
    """Documents of words of their own, but for near copies, exact copies, shared passages, poor texts and odd rows."""
    rng = random.Random(31)
    texts = [random_text(rng, rng.choice([60, 150, 400])) for _ in range(40)]
    near = texts[3].split()
    near[20] = "changed"
    shared = random_text(rng, 60)
    texts += [" ".join(near), texts[4], texts[4], "poor " * 50, "few words", None, ""]
    texts += [f"{random_text(rng, 80)} {shared} {random_text(rng, 70)}" for _ in range(4)]
    rows = [(3 * i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)] + [(None, texts[7], "en", None, 9), (3 * 5, texts[5], "en", "s1", 1), (3 * 6, random_text(rng, 90), "en", "s1", 1)]
    columns = list(zip(*rows, strict=True))
    names = [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]
    pq.write_table(pa.table([pa.array(c, t) for c, (_, t) in zip(columns, names, strict=True)], names=[n for n, _ in names]), f"{path}/documents.parquet")
    pq.write_table(pa.table([pa.array([0, 3], pa.int64()), pa.array([1, 1], pa.int32()), pa.array([0, 0], pa.int32())], names=["doc_id", "quality", "toxic"]), f"{path}/labels.parquet")
    return rows, shared.split()


def by_hand(rows, shared):
    """The pipeline's texts in plain Python; no label is toxic, so the classifier keeps all."""
    kept = [(d, t) for d, t, *_ in rows if quality.measures(pa.array([t]))["kept"][0]]
    sets = [{tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in kept]
    group = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    order = lambda i: (kept[i][0] is None, kept[i][0] or 0, hashlib.md5(kept[i][1].encode()).digest())
    stay = sorted(min((i for i in range(len(kept)) if group[i] == g), key=order) for g in set(group))
    out, met = [], False
    for d, t in sorted((kept[i] for i in stay), key=lambda r: (r[0] is None, r[0] or 0)):
        w = t.split()
        at = next((i for i in range(len(w)) if w[i : i + 60] == shared), None)
        if at is not None and met:
            t = " ".join(w[:at] + w[at + 60 :])
        met |= at is not None
        out.append((d, t))
    return out


def test_run_against_brute_force(spark, tmp_path):
    rows, shared = pipeline_tables(tmp_path)
    want = by_hand(rows, shared)
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    tokenizer = __import__("tokenizers").Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = sorted((d is None, d or 0, [*tokenizer.encode(t, add_special_tokens=False).ids, 0]) for d, t in want)
    assert len(ids) == 54 - 4 - 5 and got.length.sum() == sum(len(x) for *_, x in ids)
    for none, d, x in ids:
        pieces = got[got.doc_id.isna()] if none else got[got.doc_id == d]
        pieces = pieces[pieces.doc_tokens == len(x)].sort_values("start")
        assert pieces.length.sum() == len(x) and all(r.ids_crc32 == zlib.crc32(np.array(x[int(r.start) : int(r.start + r.length)], "<u4").tobytes()) for r in pieces.itertuples()), d


def test_run_on_empty_tables(spark, tmp_path):
    pipeline_tables(tmp_path)
    for name in ("documents", "labels"):
        pq.write_table(pq.read_table(f"{tmp_path}/{name}.parquet").slice(0, 0), f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("operator", ["toxicity", "quality", "near", "passages", "packing", "op1_mixture_packing", "op2_coordinate_join_near_duplicates"])
def test_workers_get_bounded_batches(operator, spark, sf_dir):
    """A batch has 4 MB and a row at most, whatever its number of rows; a session's own limit stays."""
    run = {
        "toxicity": lambda d: toxicity.rejected_removed(d, toxicity.train([], np.zeros(0, np.int64))),
        "quality": quality.rejected_removed,
        "near": near.duplicates_removed,
        "passages": passages.passages_removed,
        "packing": lambda d: packing.pack(d, queries.TOKENIZER),
        "op1_mixture_packing": lambda _: queries.op1_mixture_packing(spark, sf_dir).limit(1),
        "op2_coordinate_join_near_duplicates": lambda _: queries.op2_coordinate_join_near_duplicates(spark, sf_dir).limit(1),
    }[operator]
    few = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    large = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('x', 5000) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    measured = lambda: large.mapInArrow(sizes, "rows long, bytes long").collect()
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(limit)
    try:
        run(few).collect()
        got = measured()
        assert sum(r.rows for r in got) == 3000 and max(r.bytes for r in got) <= 4_000_000 + 5100
        spark.conf.set(limit, "1000000")
        run(few).collect()
        assert max(r.bytes for r in measured()) <= 1_000_000 + 5100
    finally:
        spark.conf.unset(limit)

"""WARC archives: write pages as records, and read archives back by boundary-chain verification.

Writing: one uncompressed WARC/1.1 file per partition, by Spark's text writer, whose line separator is the blank line
that ends a record; any Hadoop store will do. Of records with equal payloads of at least `least` bytes, the one with the
smallest page_id is a response with the payload; the others are revisits that name it and repeat length and digest.

Reading: files are split, and a split is read piece by piece, a piece being what stands between two places where a
record may begin (a blank line and "WARC/1."). A payload may hold such places too, so a task only emits candidates: where
each begins and, by its Content-Length, where its successor would. Chains within a split are followed locally; across
splits, pointer jumping from offset 0 of every file finds the candidates that the chain enters each split by, in a
number of rounds logarithmic in the number of splits. Candidates that no chain reaches lie inside payloads and are
dropped; the records that hold them are put together from their pieces and digested again.

Defined cases: null html is an empty payload; a null url becomes urn:page:<page_id>, line breaks in a url are escaped; a
null page_id stays null and, being larger than any, never is the response of a group that has another; rows with equal
page_id and payload are all responses; payloads below `least` bytes are all responses; an empty table gives no rows;
other columns are ignored. A chain that ends before its file does, or a digest that doesn't fit, raises an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arrayloom.llm.common import dropped, new_path, small, staged

END, MAGIC = b"\r\n\r\n", b"WARC/1."
BETWEEN = END + MAGIC
DATE = "2024-01-01T00:00:00Z"


def write_archives(pages: DataFrame, path: str, least: int = 100) -> None:
    """pages: page_id, url, html."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    groups = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("response_id"), F.count("*").alias("n")).where("n > 1 AND response_id IS NOT NULL")
    rows = rows.join(small(groups.select("digest", "response_id")), "digest", "left")
    again = F.col("response_id").isNotNull() & (F.col("bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    url = F.regexp_replace(F.regexp_replace(F.coalesce(F.col("url"), F.concat(F.lit("urn:page:"), page)), "\r", "%0D"), "\n", "%0A")

    def lines(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    head = lines("WARC/1.1\r\nWARC-Type: ", F.when(again, "revisit").otherwise("response"), "\r\nWARC-Record-ID: <urn:page:", page, f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: ", url, "\r\nWARC-Payload-Digest: sha256:", F.col("digest"), "\r\nX-Payload-Length: ", F.col("bytes").cast("string"), "\r\n")
    seen = lines("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:", F.col("response_id").cast("string"), ">\r\nContent-Length: 0\r\n\r\n")
    full = lines("Content-Type: text/html;charset=utf-8\r\nContent-Length: ", F.col("bytes").cast("string"), "\r\n\r\n", F.col("html"))
    rows.select(F.concat(head, F.when(again, seen).otherwise(full)).alias("value")).write.option("lineSep", END.decode()).text(path)


def parse_header(record: bytes) -> tuple[dict[str, str], int] | None:
    """Fields by lower-case name, and where the block begins; None if this is no record header.

    A header may end with its piece: then its block begins with the magic, after a blank line.
    """
    end = record.find(END)
    end = len(record) if end < 0 else end
    lines = record[:end].split(b"\r\n")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    return (fields, end + len(END)) if length.isascii() and length.isdigit() else None


CANDIDATES = "file string, block long, idx long, at long, next long, length long, type string, record_id string, refers string, said string, said_bytes long, uri string, body_at long, body long, digest string"


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", BETWEEN.decode()).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, int, bytes]]:
    """file, block, number and offset (from the split's first piece) of each piece, and its record with the magic."""
    here, idx, at = None, 0, 0
    for batch in batches:
        for file, block, value in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value")), strict=True):
            if (file, block) != here:
                here, idx, at = (file, block), 0, 0
            first = block == 0 and idx == 0
            yield file, block, idx, at if first else at - len(MAGIC), value if first else MAGIC + value
            idx += 1
            at += len(value) + len(BETWEEN)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    schema = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in CANDIDATES.split(", "))])

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    for file, block, idx, at, record in _numbered(batches):
        parsed = parse_header(record)
        if parsed is None:
            rows.append((file, block, idx, at, None, len(record), None, None, None, None, None, None, None, None, None))
        else:
            fields, body_at = parsed
            body = int(fields["content-length"])
            whole = len(record) - body_at >= body
            digest = hashlib.sha256(memoryview(record)[body_at : body_at + body]).hexdigest() if whole else None
            said_bytes = fields.get("x-payload-length", "")
            rows.append((file, block, idx, at, at + body_at + body + len(END), len(record), fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-refers-to"), fields.get("warc-payload-digest"), int(said_bytes) if said_bytes.isdigit() else None, fields.get("warc-target-uri"), body_at, body, digest))
        if len(rows) == 4096:
            yield made()
            rows = []
    if rows:
        yield made()


def _exits(pdf: pd.DataFrame) -> pd.DataFrame:
    """Where the chain from each candidate of a split leaves the split."""
    pdf = pdf.sort_values("at", ascending=False)
    out: dict[int, int] = {}
    for at, to in zip(pdf["at"].tolist(), pdf["next"].tolist(), strict=True):
        out[at] = -1 if to is None or to != to or to <= at else out.get(int(to), int(to))
    return pd.DataFrame({"split": pdf["split"], "file": pdf["file"], "at": pdf["at"], "exit": [out[x] for x in pdf["at"].tolist()]})


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a split that its entry reaches."""
    entry = pdf["entry"].dropna()
    to = dict(zip(pdf["at"].tolist(), pdf["next"].tolist(), strict=True))
    at, found = (int(entry.iloc[0]) if len(entry) else None), []
    while at in to:
        found.append(at)
        following = to[at]
        at = int(following) if following is not None and following == following and following > at else None
    return pd.DataFrame({"split": pdf["split"].iloc[:1].repeat(len(found)).to_numpy(), "at": found})


def _kept(rows: DataFrame, others: DataFrame, on: list[str]) -> DataFrame:
    """The rows that others have too, by a merge join: a staged table's size on disk says little of its size in memory."""
    return rows.join(others.hint("merge"), on, "left_semi")


def reached(candidates: DataFrame) -> DataFrame:
    """split, at of the candidates (split, file, at, next) that the chains from offset 0 of each file reach."""
    spark = candidates.sparkSession
    rows = candidates.select("split", "file", "at", "next")
    exits, exits_at = staged(rows.groupBy("split").applyInPandas(_exits, "split long, file long, at long, exit long"), "exits")
    entered = exits.select("file", F.col("exit").alias("at")).distinct()
    jump = _kept(exits, entered, ["file", "at"]).select("file", "at", F.col("exit").alias("to"))
    start = exits.where("at = 0").select("file", "at")
    jump, jump_at = staged(jump.unionByName(exits.where("at = 0").select("file", "at", F.col("exit").alias("to"))).distinct(), "jump")
    marked, n, marked_at = start, start.count(), None
    while jump.where("at > 0").limit(1).count():
        more = _kept(marked.join(jump.hint("merge"), ["file", "at"]).select("file", F.col("to").alias("at")), exits, ["file", "at"])
        after, after_at = staged(marked.unionByName(more).distinct(), "marked")
        if marked_at:
            dropped(spark, marked_at)
        marked, marked_at = after, after_at
        now = marked.count()
        if now == n:
            break
        n = now
        further = jump.select("file", F.col("at").alias("to"), F.col("to").alias("then"))
        after, after_at = staged(jump.join(further.hint("merge"), ["file", "to"]).select("file", "at", F.col("then").alias("to")), "jump")
        dropped(spark, jump_at)
        jump, jump_at = after, after_at
    entries = _kept(exits, marked, ["file", "at"]).groupBy("split").agg(F.min("at").alias("entry"))  # a row per split
    chain, _ = staged(rows.join(small(entries), "split", "left").groupBy("split").applyInPandas(_walk, "split long, at long"), "chain")
    for old in (exits_at, jump_at, *([marked_at] if marked_at else [])):
        dropped(spark, old)
    return chain


def _records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The records with the number of their file, and file, path, split, block of each split."""
    found, found_at = staged(_pieces(spark, path).mapInArrow(_candidates, CANDIDATES), "candidates")
    read = F.col("length") + F.when((F.col("block") == 0) & (F.col("idx") == 0), len(BETWEEN)).otherwise(len(END))  # the magic of later pieces is in their length
    sizes = found.groupBy(F.col("file").alias("path"), "block").agg(F.sum(read).alias("size"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("base", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    order = Window.orderBy("path", "block")  # a row per split
    splits, _ = staged(sizes.select("path", "block", "base", F.row_number().over(order).cast("long").alias("split"), F.dense_rank().over(Window.orderBy("path")).cast("long").alias("file")), "splits")
    placed = found.withColumnRenamed("file", "path").join(small(splits), ["path", "block"]).withColumns({"at": F.col("at") + F.col("base"), "next": F.col("next") + F.col("base")}).drop("base", "path", "block")
    placed, _ = staged(placed, "placed")
    dropped(spark, found_at)
    chain = reached(placed)
    records = _kept(placed, chain, ["split", "at"])
    ends = placed.groupBy("file").agg(F.max(F.col("at") + F.col("length")).alias("end"))  # a row per file
    broken = ends.join(records.groupBy("file").agg(F.max("next").alias("reached")), "file", "left").where("NOT reached <=> end").first()
    if broken is not None:
        name = splits.where(F.col("file") == broken.file).first().path
        raise ValueError(f"the records of {name} end at {broken.reached}, the file at {broken.end}")
    torn = records.where("digest IS NULL").select("file", "at")
    if torn.limit(1).count():
        whole = _torn_digests(spark, path, splits, placed, chain, torn)
        records = records.join(whole.hint("merge"), ["file", "at"], "left").withColumn("digest", F.coalesce("digest", "whole")).drop("whole")
    is_revisit = F.col("type") == "revisit"
    said = F.regexp_replace("said", "^sha256:", "")
    checked = F.when(~is_revisit & (said != F.col("digest")), F.raise_error(F.lit("a payload doesn't fit its digest")).cast("string")).when(is_revisit, said).otherwise(F.col("digest"))
    return records.select("file", "at", "type", "record_id", "refers", "uri", F.when(is_revisit, F.col("said_bytes")).otherwise(F.col("body")).alias("payload_bytes"), checked.alias("digest")), splits


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record: file, at, type, record_id, refers, uri, payload_bytes, digest (of the payload, bare hex)."""
    records, splits = _records(spark, path)
    names = splits.groupBy(F.col("file").alias("number")).agg(F.first("path").alias("file"))  # a row per file
    return records.withColumnRenamed("file", "number").join(small(names), "number").select("file", *(c for c in records.columns if c != "file"))


def _torn_digests(spark: SparkSession, path: str, splits: DataFrame, placed: DataFrame, chain: DataFrame, torn: DataFrame) -> DataFrame:
    """file, at, whole: digests of records whose payloads hold candidates, put together piece by piece."""
    owner = F.last(F.when(F.col("real"), F.col("at")), ignorenulls=True).over(Window.partitionBy("split").orderBy("at"))
    marked = placed.join(chain.withColumn("real", F.lit(True)).hint("merge"), ["split", "at"], "left").withColumn("real", F.coalesce("real", F.lit(False)))
    owned = marked.select("file", "split", "idx", F.col("at").alias("piece_at"), owner.alias("at"))
    last = marked.where("real").groupBy("file", "split").agg(F.max("at").alias("last"))  # a row per split; pieces before a split's first record are of an earlier split's
    held = splits.select("file", "split").join(last, ["file", "split"], "left")
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("split", F.last("last", ignorenulls=True).over(earlier).alias("open"))
    owned = owned.join(small(held), "split").withColumn("at", F.coalesce("at", "open")).drop("open")
    needed = _kept(owned, torn, ["file", "at"]).join(placed.select("file", "at", "body_at", "body").hint("merge"), ["file", "at"])
    needed, _ = staged(needed.join(small(splits.select("split", "path", "block")), "split").select("path", "block", "idx", "file", "at", "piece_at", "body_at", "body"), "needed")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, idx, _, record in _numbered(batches):
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([idx], pa.int64()), pa.array([record], pa.binary())], names=["path", "block", "idx", "record"])

    def digest(table: pa.Table) -> pa.Table:
        first = table.slice(0, 1).to_pylist()[0]
        parts = sorted(zip(table.column("piece_at").to_pylist(), table.column("record").to_pylist(), strict=True))
        skip, left, made = first["body_at"], first["body"], hashlib.sha256()
        for i, (_, part) in enumerate(parts):
            for data in (END, part) if i else (part,):
                piece = memoryview(data)[skip : skip + left]
                skip = max(0, skip - len(data))
                left -= len(piece)
                made.update(piece)
        return pa.table([pa.array([first["file"]], pa.int64()), pa.array([first["at"]], pa.int64()), pa.array([made.hexdigest()])], names=["file", "at", "whole"])

    pieces = _pieces(spark, path).mapInArrow(numbered, "path string, block long, idx long, record binary").join(small(needed), ["path", "block", "idx"])
    return pieces.groupBy("file", "at").applyInArrow(digest, "file long, at long, whole string")  # the pieces of one record


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of archives that write_archives wrote."""
    number = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(-?[0-9]*)>$", 1), F.lit("")).cast("long")
    return _records(spark, path)[0].select(number("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), number("refers").alias("refers_to"))


def round_trip(pages: DataFrame, least: int = 100) -> DataFrame:
    """Write pages as archives, read them back: page_records."""
    path = new_path(pages.sparkSession, "archives")
    write_archives(pages, path, least)
    return page_records(pages.sparkSession, path)

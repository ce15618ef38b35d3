"""Archives of payloads that look like archives."""

import hashlib
from collections import defaultdict

import pytest

from arrayloom.llm import warc
from arrayloom.llm.common import new_path

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:9>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
PAGES = [(i, f"http://x/{i}", f"<p>{i}</p>" * (i + 1)) for i in range(30)] + [
    (1000, "http://x\r\ny", None), (1001, None, ""), (1002, "u", "short"), (1003, "u", "short"), (1004, "u", "a" * 50 + FAKE * 3 + "tail"), (1005, "u", FAKE * 40), (1006, "u", "\r\n\r\n" + FAKE + "\r\n"),
    (1008, "u", "x" * 200), (1007, "u", "x" * 200), (1009, "u", "x" * 200), (None, "u", "x" * 200), (1010, "u", "y\r\n\r\nWARC/1.0" + "z" * 300 + "\r\n\r\n"), (1010, "u", "y\r\n\r\nWARC/1.0" + "z" * 300 + "\r\n\r\n"),
    (1011, "u", "é" * 3000 + "\r\n\r\nWARC/1.1\r\nContent-Length: 99999999\r\n\r\n"), (1012, "u", "\r\n"), (1013, "u", "q\r"), (1014, "u", "\r\n\r\nWARC/1." * 30),
]


def expected(pages):
    groups = defaultdict(list)
    for i, _, h in pages:
        groups[h or ""].append(i)
    out = []
    for i, _, h in pages:
        data = (h or "").encode()
        least = min((x for x in groups[h or ""] if x is not None), default=None)
        again = len(data) >= 100 and least is not None and i != least and len(groups[h or ""]) > 1
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", least if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", ["2000000", "5003"])
def test_round_trip(spark, split):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumnRenamed("digest", "digest").coalesce(2)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        assert sorted((tuple(r) for r in warc.round_trip(df).collect()), key=str) == expected(PAGES)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_empty_and_broken(spark, tmp_path):
    df = spark.createDataFrame(PAGES[:5], "page_id long, url string, html string")
    assert warc.round_trip(df.limit(0)).count() == 0
    path = new_path(spark, "broken")
    warc.write_archives(df.coalesce(1), path)
    rows = spark.read.text(path, wholetext=True).collect()
    text = next(r.value for r in rows if r.value)
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.warc").write_bytes(text[: len(text) // 2].encode())
    with pytest.raises(ValueError, match="end at"):
        warc.read_archives(spark, str(tmp_path / "cut")).collect()

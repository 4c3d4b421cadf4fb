"""WARC: the round trip, standard reading of whole files, ranges and edges."""

import glob
import gzip
import hashlib

from wordloom.llm import queries, warc


def brute(rows):
    first = {}
    data = [(r.page_id, (r.html or "").encode()) for r in rows]
    for page, p in data:
        if len(p) >= 100 and page is not None:
            first[p] = min(page, first.get(p, page))
    return sorted(((page, len(p), hashlib.sha256(p).hexdigest(), "revisit" if first.get(p, page) != page else "response", first[p] if first.get(p, page) != page else None) for page, p in data), key=str)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_query(spark, sf_dir):
    assert got(queries.op6_warc(spark, sf_dir)) == brute(spark.read.parquet(f"{sf_dir}/pages.parquet").collect())


def test_edges(spark):
    rows = [(i, f"http://x/{i}\r\nX-Page: 9", html, 1) for i, html in enumerate([None, "", "", "a" * 99, "a" * 99, "b" * 100, "b" * 100, "é" * 50, "é" * 50, "c\r\n\r\nd" * 60000])]
    df = spark.createDataFrame(rows + [rows[5], (None, None, "b" * 100, 2)], "page_id long, url string, html string, digest int")
    index, folder = warc.archive(df)
    back = warc.read(index, folder, payloads=True)
    assert got(back) == brute(df.collect())
    assert {r.page_id: bytes(r.payload).decode() for r in back.where("payload is not null").collect()}[9] == rows[9][2]
    whole = b"".join(gzip.open(f).read() for f in glob.glob(folder.removeprefix("file://") + "/*.warc.gz"))
    assert whole.count(b"WARC/1.1\r\n") == 12
    urls = {r.page_id: r.url for r in back.collect()}
    assert urls[None] is None and urls[3] == "http://x/3%0D%0AX-Page: 9"
    some = warc.read(index.where("page_id in (3, 9)"), folder)
    assert sorted(r.page_id for r in some.collect()) == [3, 9]
    index, folder = warc.archive(df.limit(0))
    assert warc.read(index, folder).count() == 0


def test_tasks(spark):
    """Many small records are read by as many tasks as their bytes ask for."""
    df = spark.range(400).selectExpr("id AS page_id", "concat('u', id) AS url", "repeat(sha2(cast(id as string), 256), 40) AS html")
    index, folder = warc.archive(df)
    back = warc.read(index, folder, task_bytes=20_000)
    assert back.rdd.getNumPartitions() > 4 and got(back) == brute(df.collect())


def test_ranges():
    out = warc.ranges([("a", 0, 10), ("a", 10, 5), ("a", 20 + warc.GAP, 5), ("b", 0, 3), ("b", 3, warc.READ)])
    assert out == [("a", 0, 15, [(0, 10), (10, 5)]), ("a", 20 + warc.GAP, 25 + warc.GAP, [(0, 5)]), ("b", 0, 3, [(0, 3)]), ("b", 3, 3 + warc.READ, [(0, warc.READ)])]

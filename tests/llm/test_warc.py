import hashlib

from pyspark.sql import functions as F

from lexmill.llm import warc
from lexmill.llm.common import scratch_path

LONG = "x" * 120
TRICK = "a WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nbroken " + "é" * 50


def rows_of(spark, pages, split=None):
    df = spark.createDataFrame(pages, "page_id long, url string, html string, value string")
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        return [r.asDict() for r in warc.round_trip(df).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def expected(pages):
    first = {}
    for p, _, h, _ in sorted((x for x in pages if x[0] is not None), key=lambda x: x[0]):
        first.setdefault(h or "", p)
    for p, _, h, _ in pages:
        b = (h or "").encode()
        again = p is not None and len(b) >= 100 and first[h or ""] != p
        yield p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None


def same(got, pages):
    key = lambda t: tuple((x is None, x) for x in t)
    cols = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[c] for c in cols) for r in got), key=key) == sorted(expected(pages), key=key)
    assert all(r["intact"] for r in got)


def test_round_trip_with_magic_ties_nulls_and_splits(spark):
    pages = [(i, f"http://h/{i} \r\nWARC/1.1\r\n", [LONG, None, "", "short", TRICK, LONG + "y", TRICK + str(i), "WARC/1.1\r\n", "\r\n\r\nWARC/1.1\r\n\r\n"][i % 9], "clash") for i in range(60)]
    pages += [(None, None, LONG, None), (3, "u", LONG, None), (0, "again", LONG, None), (99, "big", "z" * 300_000 + TRICK, None)]
    for split in (None, "700b", "5k"):
        got = rows_of(spark, pages, split)
        same(got, pages)
        texts = {(r["page_id"], r["payload"]) for r in got if r["record_type"] == "response"}
        assert texts <= {(p, h or "") for p, _, h, _ in pages}


def test_empty_table(spark):
    assert rows_of(spark, []) == []


def test_chain_follows_long_hops_and_stops_at_damage(spark):
    def rec(body):
        return f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"

    nested = rec("inner")
    file = "".join(rec(f"b{i}" + nested * (i % 3)) for i in range(40)) + "WARC/1.1\r\nno length\r\n\r\n" + rec("lost")
    path = scratch_path(spark, "warc-damaged")
    spark.createDataFrame([(file[:-1],)], "value string").coalesce(1).write.option("lineSep", "\n").text(path)
    got = sorted(r["block"] for r in warc.read(spark, path).select(F.col("block")).collect())
    assert got == sorted(f"b{i}" + nested * (i % 3) for i in range(40))

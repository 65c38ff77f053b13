import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from lexmill.llm import common, exact_dedup

SCHEMA = "doc_id long, text string, size int, sha string"


def rows_for(n):
    texts = ["a b", "ab", " a\tb\n", None, "", "\x0b\x0c", "unique", "A b", "x" * 50_000, "x" * 49_999 + " x", " "]
    return [(i, texts[i] if i < len(texts) else f"doc {i % 60}" + " " * (i % 4), i, "c") for i in range(n)] + [(None, "ab", 0, "c"), (3, None, 0, "c"), (3, None, 0, "c"), (None, "lone null", 1, None)]


def brute(rows):
    groups = {}
    for i, (d, t, *_) in enumerate(rows):
        t = t or ""
        groups.setdefault(hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t).encode()).hexdigest(), []).append((-len(t), d is None, d or 0, i))
    out = []
    for sha, members in groups.items():
        best = min(members)
        keep = None if best[1] else best[2]
        for m in members:
            out.append((None if m[1] else m[2], keep, len(members), sha))
    return sorted(map(str, out))


def test_assignments_match_brute_force(spark):
    rows = rows_for(300)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = exact_dedup.assignments(df).collect()
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == brute(rows)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    kept = {r.text_sha256: r.doc_id for r in got if r.kept}
    assert all(kept[r.text_sha256] == r.keep_id for r in got)
    left = exact_dedup.survivors(df)
    assert left.columns == df.columns
    ids = lambda rows: sorted(map(str, rows))
    assert ids(r.doc_id for r in left.collect()) == ids(kept.values())


def test_filter_has_no_false_negatives_and_few_alarms(spark):
    values = list(range(3000)) + list(range(500))
    df = spark.createDataFrame([(int(np.int64(np.uint64(v * 0x9E3779B97F4A7C15 % 2**64))),) for v in values], "h long").repartition(6)
    test = exact_dedup.maybe_repeated(exact_dedup.repeat_filter(df, len(values)))
    flagged = df.where(test("h")).count()
    assert 1000 <= flagged < 1200


def test_counting_over_many_parts_and_a_hot_hash(spark):
    n = 1_000_000  # four parts
    hot = spark.range(400_000).select(F.xxhash64(F.lit(7)).alias("h"))
    df = spark.range(n).select(F.xxhash64("id").alias("h")).unionByName(spark.range(0, n, 100).select(F.xxhash64("id").alias("h"))).unionByName(hot)
    flagged = {r.h for r in exact_dedup.possibly_repeated(df, n).collect()}
    repeated = {r.h for r in df.groupBy("h").count().where("count > 1").collect()}
    assert repeated <= flagged and len(flagged) < len(repeated) + 0.02 * n


def test_a_full_lookup_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(common, "MOST_BITS", 1 << common.SLICE)
    rows = rows_for(300)
    df = spark.createDataFrame(rows, SCHEMA)
    got = exact_dedup.assignments(df).collect()
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.assignments(df).count() == 0 and exact_dedup.survivors(df).count() == 0

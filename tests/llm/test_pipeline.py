"""Each stage of the pipeline against a brute-force version, on what the stage before it kept."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
from test_mixing import filled
from test_packing import check, one_by_one
from test_quality_rules import GOOD, brute, brute_scores
from test_simhash import brute_fp, brute_groups

from lexmill.llm import quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
OTHER = "river stone meadow lantern copper violet harbour window market garden winter summer bridge candle silver forest".split()


def documents():
    r = random.Random(11)
    texts = [" ".join(r.choices(GOOD + OTHER, k=r.choice([25, 40, 90, 400]))) for _ in range(60)]
    texts += [texts[i].replace(" ", "\n", 2) + " " * (i % 3) for i in range(0, 20, 2)]  # exact copies but for blanks
    for i in range(1, 30, 3):  # near copies
        words = texts[i].split(" ")
        words[r.randrange(len(words))] = "altered"
        texts.append(" ".join(words))
    texts += [" | ".join(f"Qz{(i * 31 + k) % 97}zz" for k in range(40)) for i in range(12)]  # junk
    texts += [None, "", " \n\t", "too short", "word " * 4000, " ".join(r.choices(GOOD + OTHER, k=6000)), texts[0], texts[0]]
    return [(1000 - i, t, "en", [None, "hot", "hot", "hot", "b", "c"][i % 6], len(t or "")) for i, t in enumerate(texts)]


def labels(rows):
    return [(d, int(not re.match("Qz|word word", t or "")), 0) for d, t, *_ in rows[::2]]


def kept_by_quality(rows, marks):
    out = []
    for row, score in zip(rows, brute_scores(rows, marks)):
        n, _, _, _, repeated = brute(row[1])
        if n >= 20 and 100 * repeated <= 30 * n and score >= quality_rules.THRESHOLD:
            out.append(row)
    return out


def one_of_equal(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", row[1] or "")].append(row)
    return [min(g, key=lambda x: (-len(x[1] or ""), x[0])) for g in groups.values()]


def one_of_near(rows):
    groups = defaultdict(list)
    for row, g in zip(rows, brute_groups([brute_fp(t) for _, t, *_ in rows])):
        groups[g].append(row)
    return [min(g) for g in groups.values()]


def drawn(rows):
    """Systematic sampling, document by document."""
    size = lambda row: len(re.findall(r"[^\x20\x09-\x0D]+", row[1] or ""))
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    groups = defaultdict(list)
    for row in rows:
        groups[row[3]].append(row)
    sizes = {k: sum(map(size, g)) for k, g in groups.items()}
    target, out = filled(sizes), []
    for key, group in groups.items():
        offset = int(md5("mix:7:" + ("1" if key is None else "0" + key))[:12], 16) / 2**48
        rate = target[key] / sizes[key]
        for rank, row in enumerate(sorted(group, key=lambda x: (size(x), md5(str(x[0])), x[0])), 1):
            out += [row] * min(3, math.floor(offset + rate * rank) - math.floor(offset + rate * (rank - 1)))
    return out


def test_stages_and_run_match_brute_force(spark, tmp_path):
    rows = documents()
    marks = labels(rows)
    sf_dir = str(tmp_path / "sf")
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    wanted = {"quality": lambda x: kept_by_quality(x, marks), "exact_dedup": one_of_equal, "near_dedup": one_of_near, "mixing": drawn}
    assert [name for name, _ in corpus_pipeline.STAGES] == [*wanted, "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        before, rows = len(rows), wanted[name](rows)
        assert Counter(map(tuple, docs.collect())) == Counter(rows), name
        assert rows and (len(rows) < before or name == "mixing"), name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    n = check(pieces, [row[:2] for row in rows], 1024)
    assert n <= one_by_one(Counter(p.length for p in pieces), 1024)
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).drop("sequence_id", "offset").collect())) == sorted(str(p) for p in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).drop("sequence_id", "offset").collect())


def test_empty_tables(spark, tmp_path):
    sf_dir = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    assert corpus_pipeline.run(spark, sf_dir).count() == 0

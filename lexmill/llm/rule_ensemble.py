"""Quality classifier: a sparse ensemble of rules over text statistics.

Trees are grown on statistics of a bounded sample of labelled documents (at most SAMPLED by smallest hash); every path
from a root to a node is a conjunctive rule; a lasso logistic model weighs the rules, most of them to zero; what is left
is compiled into one Spark column over the statistics. Growing and fitting run on Spark's own distributed learners.

Statistics come from whole texts. Defined results: null and empty texts have all statistics zero and are scored like
others; without labels every score is 0.5, with labels of one kind it is that kind; repeated rows score alike; an empty
table gives an empty result; extra columns are ignored. Labels that are null, or of null or unknown doc_ids, are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import materialize, quoted
from .kernels import A, Words, mix, pairs, repeated_lines, repeated_words, steps
from .langid import held_out

SAMPLED = 20_000
TREES, DEPTH, LASSO = 20, 3, 0.002
STATISTICS = ["log_words", "word_chars", "symbols", "upper", "digits", "marks", "foreign", "same_lines", "same_windows", "same_neighbours", "kinds", "kinds_of_pairs", "short_words", "line_words"]
_FLAGS = {
    "symbols": np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>{}[]\\^~=_@", np.uint8)),
    "upper": (np.arange(256) >= 65) & (np.arange(256) <= 90),
    "digits": (np.arange(256) >= 48) & (np.arange(256) <= 57),
    "marks": np.isin(np.arange(256), np.frombuffer(b"!?;:\"'()", np.uint8)),
    "foreign": np.arange(256) >= 0xC2,
}


BLOCK = 100  # words among which kinds are counted, so that long texts compare with short ones


def _distinct(words: Words, h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per text, how many different hashes its blocks of words have; at: which words h is of."""
    doc = words.doc[at]
    block = (at - (np.cumsum(words.n) - words.n)[doc]) // BLOCK
    key = mix(mix(h + doc.astype(np.uint64) * A) + block.astype(np.uint64))
    _, first = np.unique(key, return_index=True)
    return np.bincount(doc[first], minlength=len(words.n))


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of STATISTICS for each text; shares are of words or of characters in words."""
    words = Words(texts)
    h = words.hashes()
    n, chars = np.maximum(words.n, 1), np.maximum(words.chars(), 1)
    inside = words.doc[1:] == words.doc[:-1]
    lines = np.fromiter((t.count(b"\n") + 1 for t in texts), np.int64, len(texts))
    places = np.arange(len(h))
    found = {
        "log_words": np.log1p(words.n),
        "word_chars": words.chars() / n,
        **{k: words.per_text(f[words.buf]) / chars for k, f in _FLAGS.items()},
        "same_lines": np.fromiter(map(repeated_lines, texts), np.int64, len(texts)) / lines,
        "same_windows": repeated_words(words, h) / n,
        "same_neighbours": np.bincount(words.doc[1:][inside & (h[1:] == h[:-1])], minlength=len(texts)) / n,
        "kinds": _distinct(words, h, places) / n,
        "kinds_of_pairs": _distinct(words, pairs(h)[inside], places[:-1][inside]) / n,
        "short_words": np.bincount(words.doc[words.end - words.start <= 3], minlength=len(texts)) / n,
        "line_words": words.n / lines,
    }
    return np.stack([found[k] for k in STATISTICS], axis=1).astype(float)


def _measure(names: list[str]):
    def measure(batches):
        for b in batches:
            if b.num_rows:
                rows = np.concatenate([statistics(t) for t in steps(b.column(b.num_columns - 1).to_pylist())])
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *map(pa.array, np.ascontiguousarray(rows.T))], names)

    return measure


def with_statistics(docs: DataFrame, keep: list[Column], text: str = "text") -> DataFrame:
    """The columns keep and STATISTICS of each document; a kept column of a statistic's name gives way."""
    rows = docs.select(*keep, quoted(text).cast("string").alias("__text"))
    rows = rows.select(*(quoted(c) for c in rows.columns if c not in STATISTICS))
    schema = StructType([*rows.schema.fields[:-1], *(StructField(s, DoubleType()) for s in STATISTICS)])
    # Whatever the columns are called, they go by number to the tasks.
    return rows.toDF(*(f"c{i}" for i in range(len(rows.columns)))).mapInArrow(_measure(schema.names), schema)


Rule = tuple[tuple[str, str, float], ...]  # (statistic, <= or >, bound)


def rules_of(described: str) -> list[Rule]:
    """The distinct rules in a description of trees by Spark, shortest first."""
    found: dict[Rule, None] = {}
    path: list[tuple[int, tuple[str, str, float]]] = []
    for line in described.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-\d.E]+)\)", line)
        if not m:
            if line.lstrip().startswith("Tree "):
                path = []
            continue
        deep, test = len(m[1]), (STATISTICS[int(m[2])], m[3], float(m[4]))
        path = [p for p in path if p[0] < deep] + [(deep, test)]
        found[tuple(sorted(dict.fromkeys(t for _, t in path)))] = None
    return sorted(found, key=lambda r: (len(r), r))


def condition(rule: Rule) -> Column:
    out = F.lit(True)
    for name, sign, bound in rule:
        out = out & (F.col(name) <= bound if sign == "<=" else F.col(name) > bound)
    return out


class Ensemble:
    """Weighted rules; column() is the score of a document with the columns STATISTICS."""

    def __init__(self, bias: float, weights: dict[Rule, float]):
        self.bias, self.weights = bias, weights

    def column(self) -> Column:
        total = F.lit(self.bias)
        for rule, w in self.weights.items():
            total = total + F.when(condition(rule), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def labelled(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", most: int = SAMPLED) -> DataFrame:
    """Statistics and the column label of the sample to learn from."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out("doc_id"))
    rows = rows.groupBy("doc_id").agg(F.max("quality").cast("double").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).cast("string").alias("text"))
    return with_statistics(texts.join(F.broadcast(rows), "doc_id"), [F.col("label")])


def fit(sample: DataFrame) -> Ensemble:
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    sample = materialize(sample.repartition(4), "rules-sample")
    kinds = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(kinds) < 2:
        return Ensemble({1.0: 30.0, 0.0: -30.0}.get(next(iter(kinds), None), 0.0), {})
    rows = VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(sample)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=5, featureSubsetStrategy="onethird", seed=5).fit(rows)
    rules = rules_of(forest.toDebugString)
    if not rules:
        share = kinds[1.0] / sum(kinds.values())
        return Ensemble(float(np.log(share / (1 - share))), {})
    hits = sample.select("label", *[condition(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    hits = VectorAssembler(inputCols=hits.columns[1:], outputCol="features").transform(hits).select("label", "features")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60).fit(hits)
    weights = lasso.coefficients.toArray()
    return Ensemble(float(lasso.intercept), {r: float(w) for r, w in zip(rules, weights) if w})


def classify(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    ensemble = fit(labelled(docs, labels, text=text, doc_id=doc_id))
    rows = with_statistics(docs, [quoted(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out")], text)
    scored = rows.select("doc_id", "held_out", ensemble.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

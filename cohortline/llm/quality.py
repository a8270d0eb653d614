"""Quality classifier: a sparse ensemble of rules over text statistics.

A small forest is grown on a bounded sample of labelled rows. Every path from a root to a node is a
conjunctive rule; a logistic model with a lasso penalty weighs the rules, most of them with zero. The
rest are compiled into one Spark column expression over the statistics of each text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rolling
from .rules import _per_doc, _repeated_lines, _repeated_words
from .tables import stored
from .trees import Test, conjunctions

#: Labelled rows used for fitting, at most about this many, picked by hash.
SAMPLE = 20_000
TREES = 12
DEPTH = 3
#: Weight of the lasso penalty.
LASSO = 0.001
CUT = 0.7
STATISTICS = ["words", "word_size", "symbols", "upper", "digits", "stops", "marks", "pipes", "spaces",
              "line_words", "repeated_lines", "repeated_words", "echoed", "distinct", "long_words",
              "wide"]


def _byte_class(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_CLASSES = {
    "symbols": _byte_class(b"#*$%&<>~^_=@"), "upper": _byte_class(bytes(range(65, 91))),
    "digits": _byte_class(b"0123456789"), "stops": _byte_class(b".,;:"), "marks": _byte_class(b"!?"),
    "pipes": _byte_class(b"|"), "spaces": _byte_class(b" \t\r\n"),
}


def _distinct_words(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    value = words + rolling.mix((doc + 1).astype(np.uint64) * rolling.BASE)
    order = np.argsort(value)
    new = np.ones(len(value), bool)
    new[1:] = value[order][1:] != value[order][:-1]
    return np.bincount(doc[order][new], minlength=len(first) - 1)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, data, bounds in rolling.text_pieces(batch.column("text")):
            starts, ends, first = rolling.words_of(data, bounds)
            words = rolling.word_hashes(data, starts, ends)
            n = np.diff(first)
            size = np.maximum(np.diff(bounds), 1)
            some = np.maximum(n, 1)
            doc = np.repeat(np.arange(end - row), n)
            echoed = np.zeros(len(words), bool)
            echoed[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
            lines = _per_doc(data == 10, bounds) + 1
            out = {
                "words": n, "word_size": _per_doc(ends - starts, first) / some,
                **{k: _per_doc(v[data], bounds) / size for k, v in _CLASSES.items()},
                "line_words": n / lines, "repeated_lines": _repeated_lines(data, bounds, starts) / lines,
                "repeated_words": _repeated_words(words, first, 5) / some,
                "echoed": _per_doc(echoed, first) / some,
                "distinct": _distinct_words(words, first) / some,
                "long_words": _per_doc(ends - starts > 14, first) / some,
                "wide": _per_doc(data > 127, bounds) / size}
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(row, end - row),
                 *(pa.array(out[k].astype(np.float64)) for k in STATISTICS)],
                names=["doc_id", *STATISTICS])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, one column per statistic) of every whole text; null and empty texts are all zero."""
    schema = "doc_id long, " + ", ".join(f"{k} double" for k in STATISTICS)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")
                       ).mapInArrow(_statistics, schema)


def held_out(doc_id: Column) -> Column:
    """Rows that give no label: crc32 of the id as text leaves remainder 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _met(tests: tuple[Test, ...]) -> Column:
    return reduce(lambda a, b: a & b, (t.column(STATISTICS) for t in tests))


def fit_rules(labelled: DataFrame, sample: int = SAMPLE) -> tuple[float, list[tuple[tuple[Test, ...], float]]]:
    """(intercept, rules with their weights) from rows of statistics with a column label (0 or 1).

    With one label only, no rules and an intercept on its side; with none, an intercept of 0.
    """
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        return (4.0 if counts.get(1.0) else -4.0) if counts else 0.0, []
    share = min(1.0, sample / total)
    picked = stored(labelled.filter(
        F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)), "sample")
    if picked.agg(F.count_distinct("label")).first()[0] < 2:
        picked = labelled
    forest = RandomForestClassifier(
        featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, maxBins=24,
        featureSubsetStrategy="0.5", seed=1).fit(
        VectorAssembler(inputCols=STATISTICS, outputCol="x").transform(picked))
    rules = conjunctions(forest)
    if not rules:
        return float(np.log((counts[1.0] + 1) / (counts[0.0] + 1))), []
    marks = picked.select("label", array_to_vector(
        F.array(*(_met(r).cast("double") for r in rules))).alias("x"))
    model = LogisticRegression(featuresCol="x", labelCol="label", regParam=LASSO,
                               elasticNetParam=1.0, maxIter=60).fit(marks)
    return float(model.intercept), [
        (r, float(w)) for r, w in zip(rules, model.coefficients.toArray()) if w]


def compiled(intercept: float, rules: list[tuple[tuple[Test, ...], float]]) -> Column:
    """The ensemble as one column: 1 / (1 + exp(-(intercept + weights of the rules that hold)))."""
    total = reduce(lambda a, b: a + b,
                   (F.when(_met(r), w).otherwise(0.0) for r, w in rules), F.lit(intercept))
    return F.round(1 / (1 + F.exp(-total)), 9)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted, and the statistics), one row per input row.

    labels: id and label (0 or 1); rows with a null label, conflicting labels of one id included, are
    left out. Only labelled rows that are not held out teach; at most about `sample` of them.

    Null and empty texts have statistics of zero and are scored as such. Null ids stay null, are not
    held out and have no label. Repeated rows are scored alike, and each teaches. With one label only
    every score lies on its side; with none it is 0.5. An empty table gives an empty frame. Other
    columns are not read.
    """
    rows = stored(statistics(docs, id_col, text_col), "statistics")
    known = (labels.select(F.col(id_col).cast("long").alias("doc_id"),
                           F.col(label_col).cast("double").alias("label"))
             .filter("doc_id is not null and label in (0, 1)")
             .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("top"))
             .filter("label = top").drop("top"))
    labelled = rows.join(known, "doc_id").filter(~held_out(F.col("doc_id")))
    intercept, rules = fit_rules(labelled, sample)
    score = compiled(intercept, rules)
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"),
        (score >= CUT).cast("int").alias("predicted"), *STATISTICS)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality_scores(docs, labels).select("doc_id", "held_out", "score", "predicted")

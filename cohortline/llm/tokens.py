"""Token counts through a cache keyed by digests of the content and of the tokenizer's version."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chunks, rolling
from .tables import new_folder

LIMIT = 512
CACHE = "tokenizer string, digest binary, n_tokens long"


def same_content(text: Column) -> Column:
    """The normal form that a byte-level tokenizer cannot tell from the text: null is empty."""
    return F.coalesce(text, F.lit(""))


def tokenizer_digest(path: str) -> str:
    """Digest of the tokenizer's file and of the library's version: counts are kept under it."""
    import tokenizers

    with open(path, "rb") as file:
        content = file.read()
    return hashlib.sha256(tokenizers.__version__.encode() + b"\0" + content).hexdigest()


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunks.encoder(path)
        for batch in batches:
            for row, end, data, bounds in rolling.text_pieces(batch.column("text")):
                starts, ends, first = chunks.cut_spaces(data, bounds)
                _, count = encoder.ids(data, starts, ends)
                total = np.append(0, np.cumsum(count))[first]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("digest").slice(row, end - row),
                     pa.array(np.diff(total).astype(np.int64))], names=["digest", "n_tokens"])
    return run


def token_counts(docs: DataFrame, tokenizer_path: str, cache: str, id_col: str = "doc_id",
                 text_col: str = "text", normalise: Callable[[Column], Column] = same_content,
                 limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per input row.

    tokenizer_path: a byte-level tokenizer file of the tokenizers library, at the same path on every
    node. cache: a folder of counts, made if need be; the texts it lacks are encoded once each and
    appended. `normalise` may only fold what the tokenizer does not see. Counts are without begin,
    end or added special tokens; special strings inside a text are taken as the library takes them.

    Null texts are empty; empty texts have 0 bytes and tokens. Null ids stay null, repeated rows get
    equal rows. An empty table gives an empty frame. Other columns are not read.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    spark.createDataFrame([], CACHE).write.mode("append").partitionBy("tokenizer").parquet(cache)

    def kept() -> DataFrame:
        held = spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == version)
        # two runs may have appended the same text
        return held.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), normalise(F.col(text_col)).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    # copies of a text meet in the first aggregate, before the shuffle
    wanted = rows.groupBy("digest").agg(F.first("text").alias("text"))
    misses = wanted.join(kept(), "digest", "left_anti")
    (misses.mapInArrow(_encode(tokenizer_path), "digest binary, n_tokens long")
     .withColumn("tokenizer", F.lit(version))
     .write.mode("append").partitionBy("tokenizer").parquet(cache))
    return rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")).join(
        kept(), "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(docs: DataFrame) -> DataFrame:
    """With a cache of its own, so that every call encodes all distinct texts."""
    import public_tokenizers

    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"),
                        new_folder(docs.sparkSession, "token-counts"))

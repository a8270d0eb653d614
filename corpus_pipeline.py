"""From raw documents to packed training sequences, in five written stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of documents. Decisions are joined back by (doc_id, hash of text); the decided keys
are broadcast only behind a check of their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.llm import leaks, near, packing, pii, rules
from cohortline.llm.tables import read, sized, stored

# keys of rejected documents (16 bytes each) are broadcast up to this many, joined beyond
BROADCAST_KEYS = 500_000
# redacted spans (under 100 bytes each) are broadcast up to this many, joined beyond
BROADCAST_SPANS = 500_000
# words of a shingle in near_dedup; op7's contract of four binds its own query alone
STAGE_SHINGLE = 5


def _keyed_columns() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(near.LAST)).alias("did"),
            F.xxhash64("text").alias("th")]


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, did, th): the whole row beside its key, so that no column of documents can clash."""
    return docs.select(F.struct("*").alias("row"), *_keyed_columns())


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows whose key (did, th) is not rejected."""
    keys = sized(stored(rejected.select("did", "th").distinct(), "rejected"), BROADCAST_KEYS)
    return _keyed(docs).join(keys, ["did", "th"], "left_anti").select("row.*")


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    rest = F.struct(*(c for c in docs.columns if c != "text"), F.lit(0).alias("_one")).alias("_rest")
    judged = rules.quality_rules(
        docs.select("doc_id", "text", rest), rules.trusted_ids(read(spark, sf_dir, "labels")),
        carry=["_rest", "text"])
    return judged.filter("kept").select("_rest.*", "text").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of least id."""
    members = stored(near.near_members(docs, shingle=STAGE_SHINGLE), "members")
    left = _without(docs, members.filter("not kept"))
    again = members.filter("kept").groupBy("did", "th").agg(F.count("*").alias("n")).filter("n > 1")
    again = stored(again.select("did", "th"), "again")
    if again.isEmpty():
        return left
    # rows of one id and one text: nothing tells them apart, one stays
    keys, rows = sized(again, BROADCAST_KEYS), _keyed(left)
    once = (rows.join(keys, ["did", "th"], "left_semi")
            .groupBy("did", "th").agg(F.first("row").alias("row")))
    rest = rows.join(keys, ["did", "th"], "left_anti")
    return rest.select("row.*").unionByName(once.select("row.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = leaks.contaminated(docs, read(spark, sf_dir, "benchmark"))
    return _without(docs, found.select(
        F.coalesce("doc_id", F.lit(near.LAST)).alias("did"), F.col("text_hash").alias("th")))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the new text."""
    keys = docs.select("doc_id", "text", *_keyed_columns())
    found = stored(
        pii.personal_data(keys, keep=["did", "th"]).filter(F.size("spans") > 0)
        .select("carried.*", "spans").dropDuplicates(["did", "th"]), "found")
    spans = found.agg(F.sum(F.size("spans"))).first()[0] or 0
    if spans <= BROADCAST_SPANS:
        found = F.broadcast(found)
    hidden = pii.redact(F.col("row.text"), F.col("spans"))
    row = F.col("row").withField("text", hidden)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length(hidden).cast("long"))
    done = _keyed(docs).join(found, ["did", "th"], "left").select(
        F.when(F.col("spans").isNull(), F.col("row")).otherwise(row).alias("row"))
    return done.select("row.*").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its place in a sequence."""
    return packing.query(docs)


STAGES = [
    ("quality_rules", filter_quality),
    ("near_dedup", drop_near_copies),
    ("decontamination", decontaminate),
    ("personal_data", redact_personal_data),
    ("packing", pack),
]

#: SQL can express neither the tokenizer nor the trees: tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs

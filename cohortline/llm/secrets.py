"""Secret scans with the corpus-wide ownership of every candidate value.

Fixed patterns find credentials. A further generator takes long mixed tokens as candidates. All
values are counted over the whole corpus by distinct repositories and distinct owners: a value that
several owners hold is a copied example, and so is one that a single owner spreads over very many
repositories; one that few repositories of one or two owners hold looks live. Candidates of the
further generator become spans only if they look live; fixed findings stay and are marked either way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import bare, by_start, joined, of_kind, with_matches
from .tables import stored

KINDS = ["assign", "access", "hex"]
OTHER = "mixed"
#: A value that this many owners hold is a copied example, and so is one in so many repositories.
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 50
_WORDS = "password|passwd|secret|token|api_?key"
PATTERNS = {
    "assign": "(?i:" + _WORDS + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    # a run that is too short fails whole, so the least length may stand in the pattern
    "access": "AKIA[A-Z0-9]{14,}",
    "hex": "[0-9a-f]{16,}",
    OTHER: "[A-Za-z0-9+/_-]{20,}",
}


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            repository_col: str = "doc_id", owner_col: str = "source",
            copied_owners: int = COPIED_OWNERS,
            copied_repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """(doc_id, base, spans, held, n_live, n_copied), one row per input row.

    base: spans of the fixed patterns by start, then kind. spans: with those of the further
    generator that do not overlap them and that look live. held: every span and further candidate by
    start with the owners and repositories of its value and the verdict `copied`: owners reach
    copied_owners, or repositories copied_repositories. n_live and n_copied count them.

    Null and empty texts hold nothing. A null repository or owner counts as one of its own. Null ids
    stay null; repeated rows hold the same repository and owner and so add nothing to the counts.
    An empty table gives an empty frame. Other columns are not read.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.coalesce(F.col(repository_col).cast("string"), F.lit("")).alias("repository"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"))
    found = with_matches(rows, "text", PATTERNS, {"assign": 1})
    mixed = F.filter(OTHER, lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")
                     & s["value"].rlike("^(?=.*[a-z])(?=.*[A-Z])"))
    base = F.concat(F.filter("assign", lambda s: F.length(s["value"]) >= 12), "access", "hex")
    table = stored(
        found.select(
            F.monotonically_increasing_id().alias("uid"), "doc_id", "repository", "owner",
            by_start(bare(base), KINDS).alias("base"), bare(mixed).alias("mixed"))
        .withColumn("mixed", F.filter("mixed", lambda m: ~F.exists(
            "base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))), "scanned")
    held = table.select("uid", "repository", "owner", F.explode(F.concat("base", "mixed")).alias("s")
                        ).withColumn("digest", F.sha2("s.value", 256))
    # distinct before counting: a value copied over a third of all rows meets as few rows
    owners = (held.groupBy("digest", "owner", "repository").agg(F.lit(1).alias("one"))
              .groupBy("digest", "owner").agg(F.count("*").alias("repositories"))
              .groupBy("digest").agg(F.count("*").alias("owners"),
                                     F.sum("repositories").alias("repositories")))
    copied = (F.col("owners") >= copied_owners) | (F.col("repositories") >= copied_repositories)
    judged = (held.join(owners, "digest").groupBy("uid").agg(F.collect_list(F.struct(
        "s", "owners", "repositories", copied.alias("copied"))).alias("all")))
    live = F.filter("all", lambda x: ~x["copied"])
    extra = F.transform(F.filter(live, lambda x: x["s"]["kind"] == OTHER), lambda x: x["s"])
    none = F.array().cast("array<struct<s:struct<kind:string,start:int,end:int,value:string>,"
                          "owners:bigint,repositories:bigint,copied:boolean>>")
    flat = F.transform("all", lambda x: F.struct(
        x["s"]["start"].alias("start"), x["s"]["end"].alias("end"), x["s"]["kind"].alias("kind"),
        x["owners"].alias("owners"), x["repositories"].alias("repositories"), x["copied"].alias("copied")))
    return (table.join(judged, "uid", "left").withColumn("all", F.coalesce("all", none))
            .select("doc_id", "base", by_start(F.concat("base", extra), [*KINDS, OTHER]).alias("spans"),
                    F.array_sort(flat).alias("held"),
                    F.size(live).cast("long").alias("n_live"),
                    (F.size("all") - F.size(live)).cast("long").alias("n_copied")))


def query(docs: DataFrame) -> DataFrame:
    counts = (F.size(of_kind(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in KINDS)
    return secrets(docs).select(
        "doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"), "n_live", "n_copied")

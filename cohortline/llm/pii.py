"""Personal data: fixed patterns with validators, and boosted trees over further candidates.

High-recall generators propose candidate spans, which may overlap. Boosted trees score a candidate
by its format and by the words before it; they learn from a bounded sample of the corpus's own
candidates which of them a validated pattern covers. What a pattern does not cover is unlabelled, not
known to be harmless: the trees see none of what the validators look at (check digits, octets, the
at sign), so a candidate that is written and announced like covered ones scores like them. A threshold
calibrated on all other candidates picks the spans that are added to the fixed ones. All of it runs
in the JVM.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import bare, by_kind, joined, of_kind, with_matches
from .tables import stored
from .trees import ensemble_sum

KINDS = ["email", "ip", "card", "phone"]
#: Base patterns. Possessive loops match the same text and keep the matcher's stack flat on long runs;
#: a match may only start where a run starts, or where the last match ended.
BASE = {
    "email": "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[\\x20-]?[0-9]){12,}+",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
OCTET = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Generators of further candidates: mail-like, dotted and number-like stretches.
GENERATORS = {
    "mail_like": "[A-Za-z0-9._%+-]{1,64}+(?:@|\\x20?[\\[(]at[\\])]\\x20?)[A-Za-z0-9.-]{2,255}+",
    "dotted": "[0-9]{1,5}+(?:[.:][0-9]{1,5}+){3,7}+",
    "number_like": "[+(]?[0-9][\\x20().0-9-]{6,40}[0-9]",
}
#: Candidates that the trees are fitted on, at most about this many; all others calibrate the threshold.
SAMPLE = 20_000
#: Share of the candidates of a small corpus that the trees are fitted on.
FIT_SHARE = 0.75
#: Share of covered candidates among those that score as high, which calibration asks for.
PRECISION = 0.95
TREES = 8
DEPTH = 3
#: Candidates of a leaf at least, and their least share of the fitting part: what patterns miss is rare
#: and unlabelled, and no leaf may be cut out for it.
LEAF, LEAF_SHARE = 20, 0.005
#: Code points of context before a candidate, back to the previous one of its kind.
CONTEXT = 24
#: Words that announce personal data, in the languages of the corpus.
CUES = "(?i)mail|phone|call|tel|fax|mobile|contact|card|visa|account|ip|address|server|host"
FEATURES = ["size", "digits", "letters", "dots", "spaces", "dashes", "plus", "groups", "longest_group",
            "cue", "before_digit", "is_mail", "is_dotted"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid(frame: DataFrame) -> Column:
    """Base spans that pass their validators, by kind and start."""
    octets = f"^({OCTET}\\.){{3}}{OCTET}$"
    return F.concat(
        "email", F.filter("ip", lambda s: s["value"].rlike(octets)),
        F.filter("card", lambda s: F.length(_digits(s["value"])).between(13, 19)
                 & F.call_function("luhn_check", _digits(s["value"]))),
        F.filter("phone", lambda s: F.length(_digits(s["value"])).between(9, 15)))


def _count(value: str, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)).cast("double")


def features(rows: DataFrame) -> DataFrame:
    """Format and context of candidates with columns kind, value, before."""
    flag = lambda c: c.cast("double")
    groups = F.regexp_extract_all("value", F.lit("[0-9]+"), F.lit(0))
    return rows.withColumns({
        "size": F.length("value").cast("double"), "digits": _count("value", "[0-9]"),
        "letters": _count("value", "[A-Za-z]"), "dots": _count("value", "\\."),
        "spaces": _count("value", "\\x20"), "dashes": _count("value", "-"),
        "plus": flag(F.col("value").startswith("+")), "groups": F.size(groups).cast("double"),
        "longest_group": F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)).cast("double"),
        "cue": flag(F.col("before").rlike(CUES)), "before_digit": flag(F.col("before").rlike("[0-9]\\W*$")),
        "is_mail": flag(F.col("kind") == "mail_like"), "is_dotted": flag(F.col("kind") == "dotted")})


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def fitted(share: float) -> Column:
    """Candidates of the fitting part, by place and not by value: a hot value enters in proportion."""
    return F.pmod(F.xxhash64("uid", "kind", "start"), F.lit(1 << 40)) < int(share * (1 << 40))


def candidate_scorer(rows: DataFrame, sample: int = SAMPLE) -> tuple[Column, float] | None:
    """(score column over FEATURES, threshold): trees fitted on a sample of candidates with a label,
    the threshold counted over all others.

    None where the candidates show only one label or no threshold reaches the precision asked for.
    """
    n = rows.count()
    fit = fitted(min(FIT_SHARE, sample / max(n, 1)))
    picked = stored(rows.filter(fit).select(*FEATURES, "label"), "sample")
    size, labels = picked.agg(F.count("*"), F.count_distinct("label")).first()
    if labels < 2:
        return None
    train = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(picked)
    model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=TREES, maxDepth=DEPTH,
                          maxBins=16, stepSize=0.3, minInstancesPerNode=max(LEAF, int(LEAF_SHARE * size)),
                          seed=1).fit(train)
    score = 1 / (1 + F.exp(-2 * ensemble_sum(model, FEATURES)))
    # a table of 100 score steps: precision of all candidates outside the fitting part at or above each
    steps = (rows.filter(~fit).withColumn("step", F.floor(score * 100))
             .groupBy("step").agg(F.sum("label").alias("good"), F.count("*").alias("n"))
             .orderBy(F.desc("step")).collect())
    good = total = 0
    threshold = None
    for row, below in zip(steps, [r["step"] + 1 for r in steps[1:]] + [0]):
        good, total = good + row["good"], total + row["n"]
        if good >= PRECISION * total:  # half way to the next lower scores that occur
            threshold = (row["step"] + below) / 200
    return None if threshold is None else (score, threshold)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  sample: int = SAMPLE, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, base, spans, ...), one row per input row; `keep` names columns to carry along.

    base: validated spans by kind, then start. spans: with the candidates that the trees choose and
    that overlap no base span; their kinds follow the base kinds, in the order of GENERATORS. Where
    nothing can be learnt (one label only, no candidates) spans equals base.

    Null and empty texts hold nothing. Null ids stay null, repeated rows give equal rows. An empty
    table gives an empty frame. Columns outside `keep` are not read; names in it must not begin with
    an underscore.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.struct(*(F.col(k) for k in keep or [id_col])).alias("carried"))
    found = with_matches(rows, "text", BASE | GENERATORS, context=CONTEXT)
    table = stored(found.select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", "carried",
        bare(valid(found)).alias("base"), F.concat(*GENERATORS).alias("proposed")), "scanned")
    candidates = features(
        table.filter(F.size("proposed") > 0)
        .select("uid", "base", F.explode("proposed").alias("c"))
        .withColumn("label", F.exists("base", lambda b: _overlaps(b, F.col("c"))).cast("double"))
        .select("uid", "label", "c.*"))
    scorer = candidate_scorer(candidates, sample)
    if scorer is None:
        chosen = spark.createDataFrame(
            [], "uid long, more array<struct<kind:string,start:int,end:int,value:string>>")
    else:
        score, threshold = scorer
        chosen = (candidates.filter((F.col("label") == 0) & (score >= threshold))
                  .groupBy("uid").agg(F.collect_list(F.struct("kind", "start", "end", "value")).alias("more")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    return (table.join(chosen, "uid", "left").withColumn("more", F.coalesce("more", none))
            .select("doc_id", "carried", by_kind(F.col("base"), KINDS).alias("base"),
                    F.concat(by_kind(F.col("base"), KINDS),
                             by_kind(F.col("more"), list(GENERATORS))).alias("spans")))


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans merge."""
    order = F.array_sort(F.transform(
        spans, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("k"))))
    done = F.aggregate(
        order, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(
            s["a"] >= acc["at"], F.struct(
                s["b"].alias("at"),
                F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["a"] - acc["at"]),
                         F.lit("["), s["k"], F.lit("]")).alias("out")))
        .otherwise(F.struct(F.greatest(acc["at"], s["b"]).alias("at"), acc["out"].alias("out"))))
    return F.get(F.transform(F.array(done), lambda d: F.concat(
        d["out"], F.substring(text, d["at"] + 1, F.length(text)))), F.lit(0))


def query(docs: DataFrame) -> DataFrame:
    counts = (F.size(of_kind(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in KINDS)
    return personal_data(docs).select(
        "doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"))

"""What the profile of the whole history leaves on disk, and that passes give the rows of one pass."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from cohortline.constants import METRICS, PERIODS
from cohortline.operators import bounded, profile
from cohortline.plans import studies

HISTORY = ("matricula string, id_carrera int, id_grupo long, id_materia long, semestre int, periodo int, "
           + ", ".join(f"{m} double" for m in METRICS))


def history(spark, n, copies=0):
    rng = random.Random(5)
    periods = [p for p, _ in PERIODS]
    data = [(rng.choice([None, f"C{rng.randrange(n // 10)}", f"C{rng.randrange(n // 10)} "]),
             rng.choice([1, 2, None]), rng.randrange(n // 4), rng.randrange(n // 3), rng.choice([None, *range(1, 17)]),
             rng.choice([None, *periods]), *(rng.choice([-10.0, rng.randrange(51) / 5]) for _ in METRICS))
            for _ in range(n)]
    return spark.createDataFrame(data + data[:copies], HISTORY).repartition(6)


def files(top, start=""):
    return {os.path.join(d, f): os.lstat(os.path.join(d, f)).st_size
            for d, _, names in os.walk(top) for f in names if f.startswith(start)}


def ordered(df):
    return sorted(str([f"{v:.9g}" if isinstance(v, float) else v for v in r]) for r in df.collect())


def test_profile_keeps_one_compressed_table(spark, tmp_path):
    raw, kept = history(spark, 20_000), spark.conf.get("spark.checkpoint.dir")
    before = files(kept)
    studies.profile_study(raw, str(tmp_path / "profile"))
    new = sum(size for path, size in files(kept).items() if path not in before)
    assert new < 80 * 20_000  # the labels' key of 64 digits is in it


def test_profile_lets_its_shuffles_go(spark, tmp_path):
    environment = spark._jvm.org.apache.spark.SparkEnv.get()
    tops = [str(d) for d in environment.blockManager().diskBlockManager().localDirsString()]

    def shuffles():
        return {path: size for top in tops for path, size in files(top, "shuffle_").items()}

    raw = history(spark, 5_000)
    before = shuffles()
    tables = studies.profile_study(raw, str(tmp_path / "profile"))
    for _ in range(50):
        left = [path for path in shuffles() if path not in before]
        if not left:
            break
        time.sleep(0.2)
    assert not left and tables


@pytest.mark.parametrize("bound", [0, 10**9])
def test_passes_give_the_rows_of_one_pass(spark, tmp_path, monkeypatch, bound):
    raw = history(spark, 3_000, copies=300)
    plain = bounded.cut(studies.labelled_history(raw))
    monkeypatch.setattr(bounded, "ONE_PASS_ROWS", bound)
    monkeypatch.setattr(profile, "SMALL_ROWS", 20)
    tables = studies.profile_study(raw, str(tmp_path / "profile"))
    for name in ("overview", "duplicates", "text", "missing", "top_values", "head"):
        want = {"overview": profile.overview, "duplicates": profile.duplicates, "text": profile.text_summary,
                "missing": profile.missingness, "top_values": profile.top_text_values,
                "head": lambda df: df.orderBy(*df.columns).limit(5)}[name](plain)
        written = spark.read.parquet(str(tmp_path / "profile" / name))
        assert written.dtypes == want.dtypes
        assert ordered(written) == ordered(tables[name]) == ordered(want), name
    assert tables["duplicates"].count() > 100


def test_passes_of_nothing(spark):
    none = history(spark, 100).limit(0)
    out = bounded.in_passes(none, F.col("matricula"), studies.labelled_history)
    assert out.count() == 0 and out.dtypes == studies.labelled_history(none).dtypes


def test_whole_rows_are_not_shuffled_for_few_duplicates(spark):
    df = spark.createDataFrame([(i % 95, str(i % 95)) for i in range(100)], "a int, b string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        copies = profile.duplicates(df)
        assert "SortMergeJoin" not in copies._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["a"] for r in copies.collect()) == list(range(5))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)

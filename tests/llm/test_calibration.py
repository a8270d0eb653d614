"""The threshold of personal data covers all candidates outside the fitting part."""

from cohortline.llm import pii


def candidates(spark, rows):
    return pii.features(spark.createDataFrame(
        [(i, label, "mail_like" if "@" in value else "number_like", 0, len(value), value, before)
         for i, (label, value, before) in enumerate(rows)],
        "uid long, label double, kind string, start int, end int, value string, before string"))


def test_hot_value_counts_in_the_threshold(spark):
    rows = [(1.0, f"ab{i:04}@cd.org", "mail ") for i in range(2_000)]
    rows += [(0.0, f"{i:04} {i:04}", "order ") for i in range(1_000)]
    assert pii.candidate_scorer(candidates(spark, rows), 300) is not None
    # one value of a third of all candidates looks like the good ones: no threshold is precise
    for hot in ("zz0001@xy.org", "zz0002@xy.org", "zz0003@xy.org"):
        assert pii.candidate_scorer(
            candidates(spark, rows + [(0.0, hot, "mail ")] * 1_500), 300) is None


def test_threshold_is_counted_over_all_other_candidates(spark):
    rows = [(float(i % 50 > 0), f"ab{i:04}@cd.org", "mail ") for i in range(2_000)]
    rows += [(float(i % 3 == 0), f"{i:04} {i:04}", "order ") for i in range(1_000)]
    frame = candidates(spark, rows)
    score, threshold = pii.candidate_scorer(frame, 300)
    rest = frame.filter(~pii.fitted(300 / 3_000)).select("label", score.alias("score")).collect()
    assert len(rest) > 2_500
    good = [r.label for r in rest if r.score >= threshold]
    assert sum(good) >= pii.PRECISION * len(good)
    steps = sorted({int(r.score * 100) / 100 for r in rest if r.score < threshold})
    for step in steps:
        taken = [r.label for r in rest if r.score >= step]
        assert sum(taken) < pii.PRECISION * len(taken)

"""The near_dedup stage links by shingles of five words."""

import corpus_pipeline
from cohortline.llm import near

from .conftest import frame


def test_near_by_four_words_only_stays(spark):
    words = [f"w{i}" for i in range(125)]
    edited = [f"e{i}" if i in (30, 60, 90) else w for i, w in enumerate(words)]
    docs = frame(spark, [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(words[1:]))], clash=False)
    assert {r.doc_id for r in near.near_members(docs).filter("kept").collect()} == {1}
    left = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert {r.doc_id for r in left.collect()} == {1, 2}

"""Operators on repeats and near copies beside their plain versions."""

import random

import numpy as np
import pytest

from cohortline.llm import near, repeats, rolling, substrings, suffixes

from . import brute


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("width", [35, 3])
def test_repeated_words(docs, corpus, width):
    from pyspark.sql import functions as F
    got = substrings.remove_repeated_words(docs, width=width).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    assert rows(got) == sorted(brute.repeated_words(corpus, width), key=repr)


@pytest.mark.parametrize("heavy", [suffixes.HEAVY, 500])
def test_repeated_bytes(docs, corpus, heavy):
    from pyspark.sql import functions as F
    got = suffixes.remove_repeated_bytes(docs, heavy=heavy).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long"), F.sha2("kept", 256))
    assert rows(got) == sorted(brute.repeated_bytes(corpus), key=repr)


@pytest.mark.parametrize("block", [near.BLOCK, 3])
def test_components(docs, corpus, block):
    got = near.near_members(docs, block=block).select("doc_id", "n_shingles", "component_id", "kept")
    want = [(i, n, c, i == c) for i, n, c in brute.components(corpus)]
    assert rows(got) == sorted(want, key=repr)


def test_empty_tables(nothing):
    assert substrings.query(nothing).collect() == []
    assert suffixes.query(nothing).collect() == []
    assert near.query(nothing).collect() == []


def test_run_index_matches_a_plain_search():
    rng = random.Random(1)
    for _ in range(30):
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 40))) for _ in range(6)]
        index = suffixes.RunIndex(parts)
        got = index.matching_statistics()
        suffix = [p[i:] for p in parts for i in range(len(p))]
        place = [b + i for b, p in zip(index.begin, parts) for i in range(len(p))]
        for k, (at, s) in enumerate(zip(place, suffix)):
            best = max((sum(1 for _ in _common(s, t)) for j, t in enumerate(suffix) if j != k), default=0)
            assert max(got[at], 0) == best


def _common(a, b):
    for x, y in zip(a, b):
        if x != y:
            return
        yield x


def test_suffix_array():
    rng = random.Random(2)
    for _ in range(50):
        text = [rng.randrange(3) for _ in range(rng.randrange(1, 60))]
        assert list(suffixes.suffix_array(np.array(text))) == sorted(range(len(text)), key=lambda i: text[i:])


def test_sliding_min_and_merge():
    values = rolling.mix(np.arange(50, dtype=np.uint64))
    for width in (1, 7, 50):
        want = [min(values[i: i + width]) for i in range(51 - width)]
        assert list(rolling.sliding_min(values, width)) == want
    assert repeats.merged([(5, 7), (0, 3), (2, 4), (7, 9)]) == [(0, 4), (5, 9)]


def test_minmax_estimates_similarity():
    a, b = np.arange(1000, dtype=np.uint64), np.arange(100, 1100, dtype=np.uint64)
    values = rolling.mix(np.concatenate((a, b)) + np.uint64(1))
    signature = near.signatures(values, np.array([0, 1000, 2000]), 256)
    assert abs((signature[0] == signature[1]).mean() - 900 / 1100) < 0.06

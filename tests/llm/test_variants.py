"""Spelling variants beside pairs found by deleting symbols."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cohortline.llm import variants

from . import brute

SCHEMA = "doc_id long, text string"


def words_of(rows, typo=97):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(brute.LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % typo == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def near(words):
    holes, out = defaultdict(list), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[i, w[:i] + w[i + 1:]].append(w)
    for (_, rest), group in holes.items():
        for a in group:
            out[a] |= {b for b in group if b != a}
            if rest in words:
                out[a].add(rest)
                out[rest].add(a)
    return out


def grouped(n, factor=2):
    found, form = near(n), {}
    for w in n:
        if found[w]:
            best = min(found[w], key=lambda x: (-n[x], x))
            if n[best] >= factor * n[w]:
                form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(found[w]), n[form[w]] if w in form else None))
    return sorted(out)


@pytest.fixture(scope="module")
def odd_words():
    rng = random.Random(9)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(5, 9))) for _ in range(900)}
    words |= {"a" * k for k in range(5, 60)} | {"ab" * k for k in range(3, 30)}
    words |= {"long" * 200 + x for x in ("", "x", "y", "xy")} | {"ÿ" + "long" * 200, "z" + "long" * 200}
    return {w: rng.randrange(3, 4_000) for w in words}


@pytest.mark.parametrize("group", [variants.GROUP, 5])
def test_groups_are_cut_without_loss(spark, odd_words, group):
    """Groups cut once, and cut again until one position is left."""
    frame = spark.createDataFrame(list(odd_words.items()), "word string, n long")
    got = variants.spelling_variants(frame, group=group).collect()
    assert sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got) == grouped(odd_words)
    pairs = variants.near_words(frame, group)
    assert pairs.count() == pairs.select("word", "near").distinct().count()  # each pair is met once


def test_short_words(spark):
    n = {"": 1, "a": 2, "b": 3, "ab": 9, "ba": 2, "abc": 1}
    got = variants.near_words(spark.createDataFrame(
        [(w, k) for w, k in n.items() if len(w) > 1], "word string, n long")).collect()
    assert sorted((r.word, r.near) for r in got) == [("ab", "abc"), ("abc", "ab")]


def test_documents(spark, corpus):
    rng = random.Random(10)
    rows = corpus + [(3_000 + i, " ".join(rng.choice(
        ["Spelling"] * 9 + ["Spellin"] * 3 + ["spelin", "spellingx", "ÀÉÎÕÜ", "ÀÉÎÕ", "spéllinG", "x×y÷zÿé",
                            "naïve1naive_"]) for _ in range(9))) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("word", F.lit("?")).withColumn("run", F.lit("?"))
    got = variants.query(docs.repartition(4)).collect()
    assert sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got) == grouped(words_of(rows))
    assert any(r.root != r.form for r in got if r.form)
    assert variants.query(docs.limit(0)).collect() == []
    assert variants.query(spark.createDataFrame([(1, None), (None, ""), (2, "1 2")], SCHEMA)).collect() == []


def test_given_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = grouped(words_of([tuple(r) for r in docs.select("doc_id", "text").collect()]))
    got = variants.query(docs).collect()
    assert sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got) == want


def test_acceptor_is_minimal():
    words = sorted({a + b for a in ("ab", "cd", "ef") for b in ("", "x", "xyz")})
    acceptor = variants.Acceptor(words)
    assert sorted(acceptor.both_accept(0, 0)) == words
    ends = {end for arcs in acceptor.arcs for end in arcs.values()}
    forms = Counter((acceptor.final[s], *acceptor.arcs[s].items()) for s in ends)
    assert max(forms.values()) == 1  # no two reachable states accept the same rests

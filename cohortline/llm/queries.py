"""Registered queries of the training-data operators, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import (
    curriculum, leaks, near, packing, pii, plain_sql, quality, rules, secrets, substrings, suffixes, tokens,
    tries, variants)
from .tables import read


def _over(operator: Callable[..., DataFrame], *names: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: operator(*(read(spark, folder, name) for name in names))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": _over(quality.query, "documents", "labels"),
    "op2_substring_dedup": _over(substrings.query, "documents"),
    "op3_token_counts": _over(tokens.query, "documents"),
    "op4_decontamination": _over(leaks.query, "documents", "benchmark"),
    "op5_suffix_dedup": _over(suffixes.query, "documents"),
    "op6_best_fit_packing": _over(packing.query, "documents"),
    "op7_near_dedup": _over(near.query, "documents"),
    "op8_personal_data": _over(pii.query, "documents"),
    "op9_secrets": _over(secrets.query, "documents"),
    "op10_quality_rules": _over(rules.query, "documents", "labels"),
    "op11_conversation_trie": _over(tries.query, "conversations"),
    "op12_source_curriculum": _over(curriculum.query, "documents"),
    "op13_spelling_variants": _over(variants.query, "documents"),
    "pipeline": corpus_pipeline.run,
}

_WORDS = "'[^\\x20\\x09-\\x0D]+'"

#: Plain SQL where it can express the whole result; the other queries have brute-force tests.
ORACLE_SQL: dict[str, str] = plain_sql.ORACLE_SQL | {
    "op2_substring_dedup": f"""
with d as materialized (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) as w
  from documents),
windows as (
  select r, s, array_to_string(w[s:s + 34], ' ') as k
  from (select r, w, unnest(range(1, len(w) - 33)) as s from d)),
twice as (select k from windows group by k having count(*) > 1),
gone as (select distinct r, unnest(range(s, s + 35)) as i from windows where k in (from twice)),
words as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d),
kept as (
  select r, count(*) as n, string_agg(word, ' ' order by i) as text
  from words anti join gone using (r, i) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed,
       sha256(coalesce(text, '')) as kept_sha256
from d left join kept using (r)""",
    "op7_near_dedup": f"""
with recursive d as materialized (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) as w from documents),
sets as materialized (
  select distinct doc_id, array_to_string(w[i:i + 3], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from d where len(w) > 0)),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
links as materialized (
  select a.doc_id as a, b.doc_id as b
  from sets a join sets b on a.s = b.s and a.doc_id <> b.doc_id
  join sizes x on x.doc_id = a.doc_id join sizes y on y.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, x.n, y.n
  having 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach as (
  select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
least as (select a, min(b) as b from reach group by a)
select d.doc_id, coalesce(n, 0) as n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) as component_id,
       d.doc_id = least(d.doc_id, coalesce(l.b, d.doc_id)) as kept
from d left join sizes z on z.doc_id = d.doc_id left join least l on l.a = d.doc_id""",
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL

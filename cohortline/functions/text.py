"""Text normalisation and ordered rule classification as built-in expressions."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortline.constants import OTHER_CATEGORY, TAXONOMY

# What Python's str.strip() and \s take as white space; Spark's trim takes blanks only.
WHITE_SPACE = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Each non-ASCII character whose canonical decomposition is an ASCII letter or digit plus marks."""
    source, target = [], []
    for point in range(0x80, sys.maxunicode + 1):
        char = chr(point)
        if not unicodedata.decomposition(char):
            continue
        base = [c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn"]
        if len(base) == 1 and base[0].isascii() and base[0].isalnum() and base[0] == base[0].lower():
            source.append(char)
            target.append(base[0])
    return "".join(source), "".join(target)


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def normalize_text(text: str | Column) -> Column:
    """Lower case, accents removed, only ``a-z0-9`` and white space kept, ends stripped.

    A missing text becomes the empty string.  Combining marks of already decomposed input go
    with the other characters the pattern deletes.  Plain ASCII skips the accent table.
    """
    text = F.col(text) if isinstance(text, str) else text
    source, target = _accent_table()
    lower = F.lower(text)
    plain = F.when(_is_ascii(text), lower).otherwise(F.translate(lower, source, target))
    # the white space spelled out: matching it by property costs far more
    kept = F.regexp_replace(plain, f"[^a-z0-9{WHITE_SPACE}]++", "")
    return F.coalesce(strip(kept), F.lit(""))


@lru_cache(maxsize=8)
def _automaton(keywords: tuple[tuple[str, int], ...]) -> ahocorasick.Automaton:
    """One state machine over all keywords; a keyword of several ranks has the least."""
    machine = ahocorasick.Automaton()
    for word, rank in sorted(keywords, key=lambda k: -k[1]):
        machine.add_word(word, rank)
    machine.make_automaton()
    return machine


def keyword_rank(text: Column, keywords: tuple[tuple[str, int], ...]) -> Column:
    """Least rank of the keywords that occur anywhere in a text, null without one.

    One scan of the text reports all of them, also where they overlap, whatever their number.
    """
    best = min(rank for _, rank in keywords)

    def least(scanned: str) -> int | None:
        found = None
        for _, rank in _automaton(keywords).iter(scanned):
            if found is None or rank < found:
                found = rank
                if found == best:
                    break
        return found

    @F.pandas_udf("int")
    def scan(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else least(t) for t in texts], dtype="Int32")

    return scan(text)


def classify(text: str | Column, rules=TAXONOMY, default: str = OTHER_CATEGORY) -> Column:
    """Category of the first rule whose pattern occurs anywhere in the text.

    Patterns that are only literals joined by ``|`` share one scan; others are regular expressions.
    """
    text = F.col(text) if isinstance(text, str) else text
    keywords, ranks = [], []
    for rank, (_, pattern) in enumerate(rules):
        words = pattern.split("|")
        if all(re.fullmatch(r"[\w ]+", w) for w in words):
            keywords += [(w, rank) for w in words]
        else:
            ranks.append(F.when(text.rlike(pattern), rank))
    if keywords:
        ranks.append(keyword_rank(text, tuple(keywords)))
    if not ranks:
        return F.lit(default)
    first = F.least(*ranks, F.lit(None).cast("int"))
    return F.coalesce(F.get(F.array(*[F.lit(category) for category, _ in rules]), first), F.lit(default))

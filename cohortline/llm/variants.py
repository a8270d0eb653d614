"""Spelling variants: the vocabulary's acceptor composed with a one-edit transducer and itself.

An accepted pair of words is a path of the composition: both words read the same symbols, one edit
happens, then both read the same symbols to the end. The composition is cut into partitions by where it
starts. Halving a word's positions, the edit lies in one half and the other half is common, so pairs
whose edit comes late start in the state reached after the common first half; pairs whose edit comes
early are those of the reversed acceptor, in the state reached after the common second half. Each such
initial state is one group of Spark; its words' other halves make a minimised acceptor, composed there.

A group of too many words is cut again in the same way, its halves into quarters, until all groups are
within bounds: with one position left a group holds 90 + 90 * 90 words at most, as there are 90 symbols.
The edit is placed at the first difference, so every pair is met in one group and met once.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
MIN_LENGTH, MIN_COUNT = 5, 3
#: One in so many words of a document loses a symbol.
TYPO = 97
#: Words that a form must outnumber its variant by, as a factor.
FACTOR = 2
#: Groups of more words are cut again.
GROUP = 4_000
_KEY = ["least", "ends", "left", "right"]


class Acceptor:
    """Minimised acyclic acceptor of sorted, distinct words; state 0 is initial."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final = [False]
        known: dict[tuple, int] = {}
        path: list[tuple[int, str, int]] = []  # arcs of the last word whose ends may still grow

        def settle(depth: int) -> None:
            while len(path) > depth:
                state, symbol, end = path.pop()
                form = (self.final[end], *self.arcs[end].items())
                self.arcs[state][symbol] = known.setdefault(form, end)

        last = ""
        for word in words:
            depth = common_prefix(last, word)
            settle(depth)
            state = path[-1][2] if path else 0
            for symbol in word[depth:]:
                self.arcs.append({})
                self.final.append(False)
                end = len(self.arcs) - 1
                self.arcs[state][symbol] = end
                path.append((state, symbol, end))
                state = end
            self.final[state] = True
            last = word
        settle(0)

    def both_accept(self, a: int, b: int) -> Iterator[str]:
        """What leads from both states to acceptance."""
        todo = [(a, b, "")]
        while todo:
            a, b, read = todo.pop()
            if self.final[a] and self.final[b]:
                yield read
            left, right = self.arcs[a], self.arcs[b]
            for symbol, end in left.items():
                if symbol in right:
                    todo.append((end, right[symbol], read + symbol))

    def one_edit_apart(self) -> Iterator[tuple[str, str]]:
        """Pairs of accepted words with one replaced symbol, or one more in the second; each once.

        States before the edit read the same symbols twice, so both acceptors are in one state there.
        """
        todo = [(0, "")]
        while todo:
            state, read = todo.pop()
            arcs = list(self.arcs[state].items())
            for k, (symbol, end) in enumerate(arcs):
                todo.append((end, read + symbol))
                for other, other_end in arcs[k + 1:]:  # replace
                    for rest in self.both_accept(end, other_end):
                        yield read + symbol + rest, read + other + rest
                for rest in self.both_accept(state, end):  # insert, at the first difference
                    if not rest.startswith(symbol):
                        yield read + rest, read + symbol + rest


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words (both ways) of each group; rows come sorted by group and middle."""
    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(k).to_pylist() for k in (*_KEY, "middle", "n")))

    names = ["word", "near", "near_n"]
    out: list[tuple] = []

    def sent() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64()))], names=names)
        out.clear()
        return batch

    for (least, ends, left, right), group in itertools.groupby(rows(), key=lambda row: row[:4]):
        count = {row[4]: row[5] for row in group}
        if len(count) < 2:
            continue
        for a, b in Acceptor(sorted(count)).one_edit_apart():
            if min(len(a), len(b)) != least or (not ends and b[:-1] == a):
                continue  # met in another group
            x, y = left + a + right, left + b + right
            out += [(x, y, count[b]), (y, x, count[a])]
            if len(out) > 50_000:
                yield sent()
    if out:
        yield sent()


def _halves(least: Column, middle: Column, left: Column, right: Column, ends: Column) -> Column:
    """The two initial states of a middle whose shortest partner or itself has `least` symbols."""
    first = F.floor(least / 2).cast("int")
    second = (least - first).cast("int")
    size = F.length(middle)
    late = F.struct(
        second.alias("least"), ends.alias("ends"), F.concat(left, F.substring(middle, F.lit(1), first)).alias("left"),
        right.alias("right"), F.substring(middle, first + 1, size).alias("middle"))
    early = F.struct(
        first.alias("least"), F.lit(False).alias("ends"), left.alias("left"),
        F.concat(F.substring(middle, size - second + 1, second), right).alias("right"),
        F.substring(middle, F.lit(1), size - second).alias("middle"))
    return F.array(late, early)


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(word, near, near_n) for all pairs of words one edit apart, both ways, from distinct (word, n).

    An edit inserts, deletes or replaces one code point. Words take two code points or more.
    """
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    empty = F.lit("")
    size = F.length("word")
    starts = F.array(size, size - 1)  # a partner is as long or longer, or one symbol shorter
    rows = words.select("word", "n", F.explode(starts).alias("size")).filter("size > 1").select(
        "n", F.explode(_halves(F.col("size"), F.col("word"), empty, empty, F.lit(True))).alias("at")
    ).select("at.*", "n")
    found = None
    while True:
        rows = stored(rows, "states")
        sizes = rows.groupBy(*_KEY).agg(F.count("*").alias("size"))
        hot = stored(sizes.filter((F.col("size") > group) & (F.col("least") > 1)).select(*_KEY), "hot")
        last = hot.isEmpty()
        now = rows if last else rows.join(hot, _KEY, "left_anti")
        pairs = (now.repartition(parts, *_KEY).sortWithinPartitions(*_KEY)
                 .mapInArrow(_compose, "word string, near string, near_n long"))
        found = pairs if found is None else found.unionByName(pairs)
        if last:
            return found
        rows = rows.join(hot, _KEY, "left_semi").select("n", F.explode(_halves(
            *(F.col(k) for k in ("least", "middle", "left", "right", "ends")))).alias("at")).select("at.*", "n")


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, typo: int | None = TYPO) -> DataFrame:
    """(word, n): runs of letters, A to Z lower-cased, of enough symbols and occurrences.

    typo: a run whose crc32 of `id:run` it divides loses the symbol at that crc32 modulo its length, in
    all its occurrences in that document; None: no run does. Null texts have no runs; a null id counts
    as empty in the crc32.
    """
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(RUN), F.lit(0)))
        .alias("run")).filter(F.length("run") >= min_length)
    word = F.col("run")
    if typo:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        runs = runs.withColumn("h", h)
        at = (F.col("h") % F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        word = F.when(F.col("h") % typo == 0, cut).otherwise(F.col("run"))
    counted = runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter((F.length("word") >= min_length) & (F.col("n") >= min_count))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) by following (word, form) to its end; each round doubles the steps taken."""
    at = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(at.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return at


def spelling_variants(words: DataFrame, factor: int = FACTOR, group: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for distinct (word, n).

    form: the near word (one edit apart) of largest n, ties to the smallest in code-point order, if its n
    is at least factor times the word's; else null. root: the last form reached from a word, the word
    itself without one. factor is above 1, so forms never lead in a circle.

    Words of any length are compared whole. An empty table gives an empty frame.
    """
    words = stored(words.select("word", F.col("n").cast("long").alias("n")), "words")
    best = near_words(words, group).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct(-F.col("near_n"), F.col("near"))).alias("best"))
    best = best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.col1")).alias("near_n"))
    good = F.col("near_n") >= factor * F.col("n")
    named = stored(words.join(best, "word", "left").select(
        "word", F.when(good, F.col("near")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, F.col("near_n")).alias("form_n")), "forms")
    roots = _roots(named.filter("form is not null"))
    return named.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(docs: DataFrame) -> DataFrame:
    return spelling_variants(vocabulary(docs))

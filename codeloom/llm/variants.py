"""Spelling variants of words by pivotal grams (operator 12).

Every word has its bigrams with their places, rarest first, equal ones by place.  Its
prefix is the first three: one edit changes at most two, so near words share one of
them.  An edit moves a bigram by two at most among its equals, so in the index the prefix
goes on with the next two places of its last bigram; no word has more than seven.  Of the prefix two bigrams that do not
overlap are the pivots, chosen by dynamic programming for the least total frequency.
One edit touches at most one of them.  For two near words the
pivots of the one whose prefix ends first meet the prefix of the other, so
it is enough to look up all pivots in an index of all these prefixes.

Places limit the join: the edit lies behind the bigram it does not touch or before it, so
the place counted from the front or from the end is equal, and so are all letters on
that side.  Of the letters on the side of the edit, it spares the first half or the second.
Side, place, length, letters and half are the key of the join; the edit distance decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import save, share, held

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EDITS, GRAM = 1, 2


def word_counts(docs: DataFrame, least: int = 3, length: int = 5, every: int = 97) -> DataFrame:
    """(word, n) of the words of at least ``length`` letters that occur ``least`` times.

    Words are runs of letters with A-Z lower-cased; a run whose crc32 with its document's
    id is divisible by ``every`` loses the letter that the remainder by its length names.
    """
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(r"[A-Za-zÀ-ÿ]+"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode_outer(runs).alias("run"))
    rows = rows.filter(F.length("run") >= length).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = rows.select(F.when(h % every == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _grams(word: Column) -> Column:
    return F.regexp_extract_all(word, F.lit(f"(?=(.{{{GRAM}}}))"), F.lit(1))


def prefix(word: str, rank: dict[str, tuple[int, str]], more: int = 0) -> list[tuple[str, int]]:
    """The first ``EDITS * GRAM + 1`` (bigram, place) pairs, rarest first, and ``more`` places of the last one's bigram."""
    grams = sorted((rank[word[i : i + GRAM]], i) for i in range(len(word) - GRAM + 1))
    least = EDITS * GRAM + 1
    last = grams[least - 1][0]
    return [(r[1], i) for n, (r, i) in enumerate(grams[: least + more]) if n < least or r == last]


def pivots(grams: list[tuple[str, int]], rank: dict[str, tuple[int, str]]) -> list[tuple[str, int]]:
    """``EDITS + 1`` pairs of ``grams`` that do not overlap, of least total frequency.

    best[k] holds, for the pairs in order of place, the least cost of k pairs among those so
    far; a pair goes with the best k - 1 that end before it.
    """
    grams = sorted(grams, key=lambda g: g[1])
    none = (float("inf"), ())
    best: list[list[tuple[float, tuple]]] = [[(0, ())] * (len(grams) + 1)] + [[none] * (len(grams) + 1) for _ in range(EDITS + 1)]
    before = 0  # pairs that end before the current one
    for j, (gram, at) in enumerate(grams):
        while grams[before][1] + GRAM <= at:
            before += 1
        for k in range(1, EDITS + 2):
            cost, chosen = best[k - 1][before]
            best[k][j + 1] = min(best[k][j], (cost + rank[gram][0], (*chosen, j)))
    return [grams[j] for j in best[EDITS + 1][-1][1]]


def keys(word: str, at: int, length: int) -> Iterator[tuple]:
    """Keys under which a word with a bigram at ``at`` meets words of ``length`` letters that share the bigram.

    A key holds the side that is equal, its letters, and the half of the other side that the
    edit spares; the halves are those of the word of ``length``.
    """
    for side, same, rest in (("<", word[: at + GRAM], word[at + GRAM :]), (">", word[at:], word[:at])):
        there = length - len(same)
        near, far = there - there // 2, there // 2
        if 0 <= near <= len(rest):
            yield side, length, same, "first", rest[:near]
        if 0 <= far <= len(rest):
            yield side, length, same, "last", rest[len(rest) - far :]


def _hash(key: tuple) -> int:
    return int.from_bytes(hashlib.blake2b(" ".join(map(str, key)).encode(), digest_size=8).digest(), "little", signed=True)


def _keyed(shared):
    """Mapper: (word, index, probe), the hashed keys of a word's prefix and, for lengths up to one edit away, of its pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = {g: (f, g) for g, f in held(shared).items()}
        for batch in batches:
            index, probe = [], []
            for w in batch.column("word").to_pylist():
                first, wider = prefix(w, rank), prefix(w, rank, EDITS * GRAM)
                index.append(list({_hash(k) for _, at in wider for k in keys(w, at, len(w))}))
                probe.append(list({_hash(k) for _, at in pivots(first, rank) for d in range(-EDITS, EDITS + 1) for k in keys(w, at, len(w) + d)}))
            cols = [batch.column("word"), *(pa.array(x, pa.list_(pa.int64())) for x in (index, probe))]
            yield pa.RecordBatch.from_arrays(cols, names=["word", "index", "probe"])

    return run


def near_words(words: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs of ``words`` (word) that one edit turns into each other.

    Words are distinct and have four letters or more.  No pair is left out: the join has no caps.
    """
    # At most 90 letters, so at most 8,100 bigrams.
    counts = words.select(F.explode_outer(_grams(F.col("word"))).alias("gram")).groupBy("gram").count()
    shared = share(words.sparkSession, {r["gram"]: r["count"] for r in counts.collect()})
    table = save(words.select("word").mapInArrow(_keyed(shared), "word string, index array<long>, probe array<long>"), "keys")
    rows = lambda c, name: table.select(F.col("word").alias(name), F.explode_outer(c).alias("key"))
    found = rows("probe", "word").join(rows("index", "other"), "key").filter((F.col("word") != F.col("other")) & (F.levenshtein("word", "other", EDITS) == EDITS))
    return found.select(F.least("word", "other").alias("a"), F.greatest("word", "other").alias("b")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last of the chain word, form, form of the form ..., for the rows (word, form) with a form.

    A round doubles the steps of every row; forms rise in count by half at least, so chains end.
    """
    steps = save(forms.select("word", F.col("form").alias("root")), "steps")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = save(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "steps")
        if moved.filter("moved").isEmpty():
            return moved.drop("moved")
        steps = moved.drop("moved")


def spelling_variants(docs: DataFrame, least: int = 3, length: int = 5, every: int = 97, ratio: int = 2) -> DataFrame:
    """(word, n, form, form_n, root, n_near) of the words of ``docs`` (doc_id, text); see ``word_counts``.

    Two words are near if one inserted, deleted or replaced letter tells them apart;
    ``form`` is the near word of largest n (ties: the least in code-point order) if its n is
    ``ratio`` times the word's at least, else null.  Texts count in whole; null and empty
    ones have no words, a null doc_id counts as an empty one, rows that repeat an id or a
    text all count.  ``length`` is 4 or more.  Other columns are ignored; a table without
    words gives an empty result.
    """
    words = save(word_counts(docs, least, length, every), "words")
    sides = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other")), F.struct(F.col("b").alias("word"), F.col("a").alias("other")))
    both = near_words(words).select(F.explode_outer(sides).alias("p")).select("p.word", "p.other")
    both = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    out = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.other").alias("other"), (-F.col("best.m")).alias("m"))
    good = F.col("m") >= ratio * F.col("n")
    out = save(out.select("word", "n", "n_near", F.when(good, F.col("other")).alias("form"), F.when(good, F.col("m")).alias("form_n")), "forms")
    ends = roots(out.filter("form is not null"))
    return out.join(ends, "word", "left").select("word", "n", "form", "form_n", F.coalesce("root", "word").alias("root"), "n_near")

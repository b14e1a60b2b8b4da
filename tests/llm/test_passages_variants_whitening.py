"""Operators 11 to 13 against brute force, and their odd cases."""

import hashlib
import random
import re
import zlib
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import passages, variants, whiten
from codeloom.llm.queries import REGISTRY

NULL = -(1 << 62)


# Passages ------------------------------------------------------------------------------------


def brute_passages(rows, window=13):
    docs = [(NULL if d is None else d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in docs:
        for i in range(len(w) - window + 1):
            s = tuple(w[i : i + window])
            first[s] = min(first.get(s, d), d)
    out = []
    for d, w in docs:
        gone = {i + j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d for j in range(window)}
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out)


def passage_rows(df, **kw):
    return sorted((NULL if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in passages.remove_passages(df, **kw).collect())


@pytest.mark.parametrize("letters", [3, 8, 400])
def test_passages_equal_brute_force(spark, letters):
    rng = random.Random(letters)
    vocab = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(letters)]
    shared = [[rng.choice(vocab) for _ in range(rng.randint(5, 40))] for _ in range(20)]
    rows = []
    for d in range(200):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(shared) if rng.random() < 0.6 else [rng.choice(vocab) for _ in range(rng.randint(1, 20))]
        rows.append((d, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(1000, None), (1001, ""), (1002, " \x1c\x85 a"), (None, rows[5][1])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_passages(rows)
    assert sum(x[2] for x in want) > 100
    assert passage_rows(df) == want
    # Small tasks, seeds that are hot in a task, and seeds that are hot in all give the same.
    assert passage_rows(df, part=2000, hot=2, most=3) == want
    assert passage_rows(df, part=300, windows=64, hot=1000, most=2) == want


def test_passages_line_in_every_document(spark):
    """One line between unlike words in all documents: the line stays in the first only."""
    line = " ".join(f"licence{i}" for i in range(15))
    rows = [(d, f"a{d} b{d} c{d} {line} x{d} y{d} z{d}") for d in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = passage_rows(df, hot=4)
    assert got == brute_passages(rows)
    assert [x[2] for x in got] == [0] + [15] * 499


def test_passages_odd_tables(spark):
    text = " ".join(f"w{i}" for i in range(30))
    long = " ".join(f"v{i % 5003}" for i in range(150_000))  # about 1 MB, its own passages repeat in it
    rows = [(1, text, "x", 5), (1, text, "y", 5), (2, None, None, None), (3, "a " + text, "z", 1), (4, long, "", 0), (5, "b " + long, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")
    out = {(r.doc_id, r.n_words): r for r in passages.remove_passages(df).collect()}
    assert passages.remove_passages(df).count() == 6
    assert out[1, 30].n_removed == 0 and out[2, 0].kept == ""
    assert (out[3, 31].kept, out[3, 31].repeats[0].start, out[3, 31].repeats[0].end) == ("a", 1, 31)
    assert out[4, 150_000].n_removed == 0 and out[5, 150_001].kept == "b"
    assert passages.remove_passages(df.limit(0)).count() == 0
    # One id with two texts: two documents in order of a hash, so that one of them loses the passage.
    two = spark.createDataFrame([(7, "p " + text), (7, "q " + text)], "doc_id long, text string")
    assert sorted(r.n_removed for r in passages.remove_passages(two).collect()) == [0, 30]


# Spelling variants ---------------------------------------------------------------------------


def brute_variants(rows):
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = max(a, b, key=len), min(a, b, key=len)
        return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))

    others = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w in words:
        best = min(others[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, form[w], words[form[w]] if form[w] else None, root, len(others[w])))
    return sorted(out)


def variant_rows(df):
    return sorted(tuple(r) for r in variants.spelling_variants(df).select("word", "n", "form", "form_n", "root", "n_near").collect())


@pytest.mark.parametrize("letters", ["ab", "abé", "aAzÀÿ÷"])
def test_variants_equal_brute_force(spark, letters):
    """Few letters: nearly all words are near to others, bigrams repeat in words and tie in frequency."""
    rng = random.Random(len(letters))
    rows = [(d, " ".join("".join(rng.choice(letters) for _ in range(rng.choice([4, 5, 5, 6, 6, 7]))) for _ in range(rng.randint(0, 300)))) for d in range(40)]
    rows += [(None, "hello hello hello"), (7, None), (8, ""), (9, "Hello hellos hellos hellos 1hello2 hello")]
    rows += [(10, "vvvvv " * 40 + "vvvvw " * 15 + "vvvww " * 5)]  # a chain of forms
    want = brute_variants(rows)
    assert sum(x[5] for x in want) > 500 and any(x[4] != x[2] for x in want if x[2])
    assert variant_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == want


def test_variants_pivots_do_not_overlap_and_cost_least():
    rng = random.Random(3)
    for _ in range(300):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(5, 12)))
        rank = {a + b: (rng.randint(1, 9), a + b) for a in "abc" for b in "abc"}
        grams = variants.prefix(word, rank)
        assert len(grams) >= 3 and all(word[i : i + 2] == g for g, i in grams)
        got = variants.pivots(grams, rank)
        cost = lambda pair: sum(rank[g][0] for g, _ in pair)
        apart = [(x, y) for x in grams for y in grams if x[1] + 2 <= y[1]]
        assert got[0][1] + 2 <= got[1][1] and cost(got) == min(map(cost, apart))


def test_variants_odd_tables(spark):
    rows = [(1, "x" * 300_000 + " " + "y" * 5, 1, "r")] * 3 + [(2, "yyyyz " * 2, 1, "r"), (2, "yyyyz", 1, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, word int, root string")
    got = variant_rows(df)
    assert got == brute_variants([r[:2] for r in rows]) and len(got) == 3
    assert variants.spelling_variants(df.limit(0)).count() == 0
    assert variants.spelling_variants(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).count() == 0


# Whitening -----------------------------------------------------------------------------------


def brute_whitening(rows, k=8):
    ok = [(i, e) for i, e in rows if e and all(c is not None and np.isfinite(c) for c in e)]
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in e] for _, e in ok], object)
    n, total = len(x), x.sum(axis=0)
    deviation = ((x * n - total) ** 2).sum(axis=1)
    y = (x * n - total).astype(float) / n
    v = y.T @ y / n
    values, units = np.linalg.eigh(v)
    values, units = values[::-1][:k], units[:, ::-1][:, :k]
    units = units * np.where(units[np.abs(units).argmax(axis=0), np.arange(units.shape[1])] < 0, -1.0, 1.0)
    return [i for i, _ in ok], deviation, y @ units / np.sqrt(values), values / np.trace(v)


@pytest.mark.parametrize("dims, wide", [(12, 1024), (12, 5), (3, 1024)])
def test_whitening_equals_numpy(spark, dims, wide):
    """Also with blocks of fewer columns than dimensions, and with fewer dimensions than components."""
    rng = np.random.default_rng(dims)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(2500, dims)) * np.arange(1, dims + 1) @ rng.normal(size=(dims, dims)))]
    rows += [(5000, None), (5001, [None] * dims), (5002, [float("nan")] * dims), (5003, [float("inf")] + [0.0] * (dims - 1)), (5004, []), (5005, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    out = whiten.whiten(df, wide=wide).toPandas()
    ids, deviation, white, explained = brute_whitening([r for r in rows if r[0] != 5005])
    k = min(8, dims)
    assert len(out) == len(ids) * k == 2500 * k and set(out.n) == {2500}
    table = out.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    assert np.abs(table - white).max() < 1e-9
    assert np.allclose(out.groupby("component").explained.first(), explained, rtol=1e-9)
    assert out.identity_error.nunique() == 1 and out.identity_error[0] < 1e-9
    first = out[out.component == 1].set_index("vec_id").deviation
    assert all(first[i] == Decimal(int(d)) for i, d in zip(ids, deviation))


def test_whitening_odd_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whiten.whiten(empty).count() == 0
    # Repeated rows and ids, a null id, clashing names; the third dimension has no variance.
    rows = [(1, [0.0, 1.0, 2.0], "a"), (1, [0.0, 1.0, 2.0], "a"), (1, [3.0, 5.0, 2.0], "b"), (None, [-1.0, 0.5, 2.0], None)]
    out = whiten.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>, whitened string")).toPandas()
    assert len(out) == 12 and out[out.component == 3].whitened.isna().all() and out[out.component < 3].whitened.notna().all()
    assert out.identity_error.max() < 1e-9 and out.vec_id.isna().sum() == 3
    # One vector: no variance at all.
    one = whiten.whiten(spark.createDataFrame([(1, [0.5, 0.5])], "vec_id long, embedding array<double>")).collect()
    assert [(r.component, r.whitened, r.explained, r.deviation) for r in one] == [(1, None, 0.0, 0), (2, None, 0.0, 0)]
    # Entries too large for the integers are left out; large ones are exact.
    big = [(1, [1e300, 0.0]), (2, [1e12, 0.0]), (3, [0.0, 1.0])]
    got = {r.vec_id: r.deviation for r in whiten.whiten(spark.createDataFrame(big, "vec_id long, embedding array<double>")).filter("component = 1").collect()}
    ids, deviation, _, _ = brute_whitening(big[1:], 1)
    assert got == {i: Decimal(int(d)) for i, d in zip(ids, deviation)}


def test_whitening_query(spark, sf_small):
    out = REGISTRY["op13_whitening"](spark, sf_small)
    assert dict(out.dtypes)["deviation"] == "bigint"
    rows = spark.read.parquet(f"{sf_small}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, deviation, _, _ = brute_whitening([(r.vec_id, r.embedding) for r in rows])
    got = {r.vec_id: r.deviation for r in out.filter(F.col("component") == 1).collect()}
    assert got == {i: int(d) for i, d in zip(ids, deviation)}

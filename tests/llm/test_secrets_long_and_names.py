"""Secret scans on very long texts, against a plain reading, and columns named like results."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from codeloom.llm import exact, secrets

ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)


def brute_spans(text, table, nats=10.0, per_char=0.5):
    """(start, rank, end) of all spans, the added ones too."""
    text = text or ""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    out, covered = list(base), bytearray(len(text))
    for s, _, e in base:
        covered[s:e] = b"x" * (e - s)
    for m in re.finditer("[A-Za-z0-9+/_=]{16,}", text):
        codes = [secrets.ALPHABET.index(c) + 1 for c in m[0]]
        ratio = sum(table[a * secrets.SIZE + b] for a, b in zip(codes, codes[1:]))
        if ratio >= nats and ratio >= per_char * len(codes) and not any(covered[m.start() : m.end()]):
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def brute_cut(text, spans, mark):
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def line(spans):
    return ",".join(f"{secrets.KINDS[r]}:{s}:{e}" for s, r, e in spans)


def some_texts(count, most):
    rng = random.Random(5)
    key = lambda n: "".join(rng.choice(secrets.ALPHABET[:62]) for _ in range(n))
    parts = [
        lambda: "password=" + key(rng.choice([3, 7, 8, 30])), lambda: 'Api_Key" : "' + key(12), lambda: "AKIA" + key(16).upper(), lambda: key(rng.choice([15, 16, 24, 60])),
        lambda: "%032x" % rng.getrandbits(128), lambda: "token:secret=" + key(9) + "." + key(20), lambda: "é😀ß", lambda: "plain words here", lambda: "x" + "%040x" % rng.getrandbits(160) + key(20),
    ]
    return [rng.choice([" ", "", "\n"]).join(rng.choice(parts)() for _ in range(rng.randint(0, most))) for _ in range(count)]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)


def test_spans_and_cuts_equal_plain_reading(spark, monkeypatch):
    """Blocks of five entries, so that scans and cuts cross them; added spans and overlaps included."""
    monkeypatch.setattr(secrets, "BLOCK", 5)
    texts = [None, "", " "] + some_texts(150, 40)
    docs = frame(spark, texts)
    table = secrets.fit(docs)
    got = {r.doc_id: r.spans for r in secrets.scan_secrets(docs).collect()}
    want = {i: brute_spans(t, table) for i, t in enumerate(texts)}
    assert got == {i: line(s) for i, s in want.items()}
    kinds = [r for s in want.values() for _, r, _ in s]
    assert min(kinds.count(k) for k in range(4)) > 50
    red = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert red == {i: brute_cut(t, want[i], "[secret]") if want[i] else t for i, t in enumerate(texts)}


@pytest.mark.parametrize("which", ["one run", "many matches", "many runs"])
def test_long_texts_take_linear_time(spark, which):
    rng = random.Random(2)
    key = lambda n: "".join(rng.choice(secrets.ALPHABET[:62]) for _ in range(n))
    text = {"one run": lambda: "é " + key(1 << 20), "many matches": lambda: "é" + " password=longenough1" * 100_000, "many runs": lambda: " ".join(key(20) + " token=" + key(8) for _ in range(40_000))}[which]()
    docs = frame(spark, [text, "token=abcdefgh12 " + key(40)])
    table = secrets.fit(docs)
    start = time.time()
    got = {r.doc_id: r.spans for r in secrets.scan_secrets(docs).collect()}
    red = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    took = time.time() - start
    want = brute_spans(text, table)
    assert got[0] == line(want) and red[0] == brute_cut(text, want, "[secret]")
    assert got[0].count("assign") == {"one run": 0, "many matches": 100_000, "many runs": 40_000}[which]
    assert took < 60, took


def test_given_columns_pass_unchanged(spark):
    """Columns named like results or helpers, in any case."""
    names = ["spans", "Found", "kept", "__digest", "__at", "Keep_Id", "group_size", "base_sha256", "given_0", "__all", "a.b"]
    rows = [(i, t, *[f"{n}{i}" for n in names]) for i, t in enumerate(["a b", "a  b", "token=abcdefgh12 x", None, ""])]
    rows.append(rows[0])
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    red = secrets.redact(docs)
    assert red.columns == docs.columns
    assert sorted(map(tuple, red.collect()), key=str) == sorted([(r[0], "[secret] x" if r[0] == 2 else r[1], *r[2:]) for r in rows], key=str)
    left = exact.drop_copies(docs)
    assert left.columns == docs.columns and sorted(map(tuple, left.collect()), key=str) == sorted([rows[0], rows[2], rows[3]], key=str)
    for out, results in ((secrets.scan_secrets(docs), secrets.RESULTS), (exact.exact_dedup(docs), exact.RESULTS)):
        given = [c for c in docs.columns if c.lower() not in results]
        assert out.columns == [*given, *results]
        assert sorted(map(tuple, out.select(*[F.col(f"`{c}`") for c in given]).collect()), key=str) == sorted(map(tuple, docs.select(*[F.col(f"`{c}`") for c in given]).collect()), key=str)
    for empty in (docs.limit(0), docs.filter("false")):
        assert secrets.redact(empty).count() == 0 and exact.drop_copies(empty).count() == 0

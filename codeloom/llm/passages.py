"""Removal of passages that documents share, by words (operator 11): seed and extend.

A word goes if a window of ``window`` words that covers it also starts in a
document of smaller id.

1. Seeds.  Of the runs of ``SEED`` words inside a window the one of least hash is
   the window's anchor (winnowing), so equal windows have equal anchors at the
   same place.  A task names the windows of its own documents exactly, by pairs of
   names of halves, and settles those that one of its own smaller documents
   has; of a passage with very many copies it sends the first only.
2. Join.  Anchors are shuffled by hash; those that one document alone has go.
3. Extension.  The anchors left are given the words around them and meet by hash in
   order of documents.  Each is extended by every number of words to the left and right
   that its windows have; an extension that an earlier document has too is a match.
   Words are compared, not hashes.  Anchors with very many occurrences
   are dealt by their extensions, so that no task holds all of them.
4. Matches of a document that touch are its maximal repeats; they are cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import save
from codeloom.llm.suffix import numbered

SEED = 6
LEAST = -(1 << 63)
U = np.uint64
MARK, ANCHOR, HOT, MATCH = 0, 1, 2, 3  # seed known to be hot, anchor, anchor of a hot seed, match


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in order, and where each text's words end."""
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    real = pc.not_equal(words, "")
    ends = np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))][np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]
    return words.filter(real), ends


def _spaced(words: pa.Array) -> tuple[bytes, list[int]]:
    """All words, one space between two, and where each one begins and the next one would."""
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py().encode()
    return text, np.r_[0, np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False) + 1)].tolist()


def _names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs (a[i], b[i])."""
    return np.unique(a * (np.int64(b.max()) + 1) + b, return_inverse=True)[1].astype(np.int64)


def _window_names(codes: np.ndarray, window: int) -> np.ndarray:
    """Equal numbers for equal runs of ``window`` codes."""
    names, width = codes, 1
    while 2 * width <= window:
        names, width = _names(names[: len(names) - width], names[width:]), 2 * width
    return _names(names[: len(names) - (window - width)], names[window - width :]) if width < window else names


def _runs(k: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans in order of document and start, those that touch joined."""
    if not len(k):
        return k, start, end
    new = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (start[1:] > end[:-1])])
    return k[new], start[new], end[np.r_[new[1:] - 1, len(k) - 1]]


def _seeds(ids: np.ndarray, codes: np.ndarray, hashes: np.ndarray, doc: np.ndarray, begin: np.ndarray, ends: np.ndarray, lo: int, hi: int, window: int, hot: int) -> list[np.ndarray]:
    """Columns (kind, h, c, k, p) for the windows that start at the words lo to hi."""
    stop = min(hi + window - 1, len(codes))
    start = np.arange(lo, max(lo, stop - window + 1))
    start = start[start + window <= ends[doc[start]]]
    empty = [np.zeros(0, np.int64)] * 5
    if not len(start):
        return empty
    word = hashes[codes[lo:stop]]
    mult = _mix(np.arange(1, SEED + 1, dtype=U)) | U(1)
    m = len(word) - SEED + 1
    seed = word[:m] * mult[0]
    for j in range(1, SEED):
        seed = seed + word[j : j + m] * mult[j]
    seed = _mix(seed)
    low = (seed & ~U((1 << 24) - 1)) | np.arange(m, dtype=U)
    span, w = window - SEED + 1, 1
    while 2 * w <= span:
        low = np.minimum(low[: len(low) - w], low[w:])
        w *= 2
    low = np.minimum(low[: len(low) - (span - w)], low[span - w :]) if span > w else low

    s = start - lo
    at = (low[s] & U((1 << 24) - 1)).astype(np.int64)
    k = ids[doc[start]]
    name = _window_names(codes[lo:stop].astype(np.int64), window)[s]
    first = np.full(name.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, name, k)
    again = first[name] < k
    place = start - begin[doc[start]]
    mk, ms, me = _runs(k[again], place[again], place[again] + window)

    # One row for the windows side by side that have one anchor, if any of them is still open.
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (np.diff(start) != 1)])
    last = np.r_[new[1:] - 1, len(at) - 1]
    n_open = np.r_[0, np.cumsum(~again)]
    live = n_open[last + 1] > n_open[new]
    new, last = new[live], last[live]
    p, ak, ah = at[new] + lo - begin[doc[start[new]]], k[new], seed[at[new]].view(np.int64)
    p = p << 8 | (at[new] - s[new]) << 4 | (at[new] - s[last])
    order = np.lexsort((ak, ah))
    head = np.flatnonzero(np.r_[True, ah[order][1:] != ah[order][:-1]]) if len(order) else order
    other = np.r_[True, (ah[order][1:] != ah[order][:-1]) | (ak[order][1:] != ak[order][:-1])] if len(order) else np.zeros(0, bool)
    docs = np.add.reduceat(other.astype(np.int64), head) if len(order) else head
    many = np.zeros(len(order), bool)
    many[order] = np.repeat(docs >= hot, np.diff(np.r_[head, len(order)]))
    marks = ah[order][head][docs >= hot]
    zero = np.zeros(len(marks), np.int64)
    spread = lambda a, b: _mix(a.view(U) ^ _mix(b.astype(np.int64).view(U))).view(np.int64)
    parts = [
        [zero + MARK, marks, zero, zero + LEAST, zero],
        [np.full((~many).sum(), ANCHOR), ah[~many], np.zeros((~many).sum(), np.int64), ak[~many], p[~many]],
        [np.full(many.sum(), HOT), spread(ak[many], p[many]), ah[many], ak[many], p[many]],
        [np.full(len(mk), MATCH), spread(mk, ms), me, mk, ms],
    ]
    return [np.concatenate(x) for x in zip(*parts)]


def _parts(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
    """The rows, some megabytes of text at a time."""
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(size):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + part, side="right")))
            yield batch.slice(at, end - at)
            at = end


def _scan(window: int, part: int, windows: int, hot: int):
    """Mapper over (k, text): rows (kind, h, c, k, p) of some megabytes of documents at a time."""
    names = ["kind", "h", "c", "k", "p"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, part):
            words, ends = split_words(batch.column("text"))
            if not len(words):
                continue
            coded = words.dictionary_encode()
            codes = coded.indices.to_numpy()
            hashes = np.frombuffer(b"".join(hashlib.blake2b(w.encode(), digest_size=8).digest() for w in coded.dictionary.to_pylist()), "<u8")
            counts = np.diff(np.r_[0, ends])
            doc = np.repeat(np.arange(len(counts)), counts)
            for lo in range(0, len(codes), windows):
                cols = _seeds(batch.column("k").to_numpy(), codes, hashes, doc, ends - counts, ends, lo, min(lo + windows, len(codes)), window, hot)
                yield pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.int8)), *map(pa.array, cols[1:])], names=names)

    return run


def _shared(most: int):
    """Mapper over rows sorted by (h, kind, k, p): the anchors whose seed several documents have, and the matches.

    Anchors of seeds that are hot in a task of the scan or have over ``most`` rows come out as HOT.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "h", "c", "k", "p"]
        held: list[np.ndarray] | None = None  # rows of the last seed, which may go on
        hot: int | None = None  # a seed whose rows came out as hot already

        def out(kind: np.ndarray, h: np.ndarray, k: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int8)), pa.array(h), pa.array(np.zeros(len(h), np.int64)), pa.array(k), pa.array(p)], names=names)

        def settle(kind: np.ndarray, h: np.ndarray, k: np.ndarray, p: np.ndarray, count: np.ndarray, head: np.ndarray) -> pa.RecordBatch:
            end = head + count
            marked = kind[head] == MARK
            # Marks of several tasks come before the anchors of their seed.
            marks = np.add.reduceat((kind == MARK).astype(np.int64), head)
            one = k[np.minimum(head + marks, len(k) - 1)] == k[end - 1]
            wide = marked | (count > most) | (h[head] == hot if hot is not None else False)
            keep = np.repeat(wide | ~one, count) & (kind == ANCHOR)
            kinds = np.where(np.repeat(wide, count), HOT, ANCHOR)
            return out(kinds[keep], h[keep], k[keep], p[keep])

        for batch in batches:
            kind = batch.column("kind").to_numpy()
            done = kind >= HOT
            if done.any():
                rows = batch.filter(pa.array(done))
                swap = rows.column("kind").to_numpy() == HOT
                h = np.where(swap, rows.column("c").to_numpy(), 0)
                c = np.where(swap, 0, rows.column("c").to_numpy())
                yield pa.RecordBatch.from_arrays([rows.column("kind"), pa.array(h), pa.array(c), rows.column("k"), rows.column("p")], names=names)
            if done.all():
                continue
            cols = [batch.column(n).to_numpy()[~done] for n in ("kind", "h", "k", "p")]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            h = cols[1]
            head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            count = np.diff(np.r_[head, len(h)])
            whole = len(head) - (count[-1] <= most)
            cut = head[whole] if whole < len(head) else len(h)
            if whole:
                yield settle(*(x[:cut] for x in cols), count[:whole], head[:whole])
                hot = int(h[cut - 1]) if whole == len(head) or hot == h[cut - 1] else None
            held = [x[cut:] for x in cols] if cut < len(h) else None
            if held is not None and hot is not None and held[1][0] != hot:
                hot = None
        if held is not None:
            h = held[1]
            yield settle(*held, np.array([len(h)]), np.array([0]))

    return run


EXTEND = ["key", "k", "at", "lo", "hi", "words"]


def _around(window: int, part: int):
    """Mapper over (k, text, spots): the words around every anchor; those of hot seeds window by window."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int8(), pa.int8(), pa.binary()]

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=EXTEND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, part):
            words, ends = split_words(batch.column("text"))
            text, begins = _spaced(words)
            out: list[tuple] = []
            for i, (k, first) in enumerate(zip(batch.column("k").to_pylist(), [0, *ends.tolist()])):
                spots = batch.column("spots")[i].values
                for h, p, hot in zip(*(spots.field(f).to_pylist() for f in ("h", "p", "hot"))):
                    at, hi, lo = p >> 8, p >> 4 & 15, p & 15
                    here = first + at
                    if not hot:
                        out.append((h, k, at, lo, hi, text[begins[here - hi] : begins[here - lo + window] - 1]))
                        continue
                    for o in range(lo, hi + 1):
                        run_ = text[begins[here - o] : begins[here - o + window] - 1]
                        out.append((int.from_bytes(hashlib.blake2b(run_, digest_size=8).digest(), "little", signed=True), k, at, o, o, run_))
                if len(out) >= 20_000:
                    yield rows(out)
                    out = []
            if out:
                yield rows(out)

    return run


def _extend(window: int):
    """Mapper over EXTEND rows sorted by (key, k, at): matches (k, start, end) of anchors with earlier documents.

    The contexts of a key are kept apart from their windows until two of them differ.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: int | None = None
        contexts: dict[tuple, tuple[int, list[tuple[int, int]]]] = {}  # (words, lo, hi): first document, its matched offsets
        seen: dict[bytes, int] = {}  # windows of the contexts: first document
        plain: tuple | None = None  # the only context so far

        def grow(k: int, words: bytes, lo: int, hi: int) -> list[tuple[int, int]]:
            """Extends an anchor o words to the left and to ``window`` words in all; the runs of offsets an earlier document has."""
            begins = [0, *accumulate(len(w) + 1 for w in words.split(b" "))]
            runs: list[tuple[int, int]] = []
            for o in range(lo, hi + 1):
                if seen.setdefault(words[begins[hi - o] : begins[hi - o + window] - 1], k) < k:
                    if runs and runs[-1][1] == o - 1:
                        runs[-1] = runs[-1][0], o
                    else:
                        runs.append((o, o))
            return runs

        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for row_key, k, at, lo, hi, words in zip(*(batch.column(n).to_pylist() for n in EXTEND)):
                if row_key != key:
                    key, contexts, seen, plain = row_key, {}, {}, (k, words, lo, hi)
                    contexts[words, lo, hi] = k, []
                    continue
                found = contexts.get((words, lo, hi))
                if found is None:
                    if plain:
                        grow(*plain)
                        plain = None
                    runs = grow(k, words, lo, hi)
                    contexts[words, lo, hi] = k, runs
                else:
                    runs = [(lo, hi)] if found[0] < k else found[1]
                out.extend((k, at - b, at - a + window) for a, b in runs)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["k", "start", "end"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mapper over (doc_id, text, spans): the documents without their repeats."""
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "repeats"]
    kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    for batch in _parts(batches, 8 << 20):
        words, ends = split_words(batch.column("text"))
        text, begins = _spaced(words)
        out, first = [], 0
        for doc, spans, end in zip(batch.column("doc_id").to_pylist(), batch.column("spans").to_pylist(), ends.tolist()):
            repeats: list[dict[str, int]] = []
            for s, e in sorted((x["start"], x["end"]) for x in spans or []):
                if repeats and s <= repeats[-1]["end"]:
                    repeats[-1]["end"] = max(e, repeats[-1]["end"])
                else:
                    repeats.append({"start": s, "end": e})
            edges = [first, *(first + x for r in repeats for x in (r["start"], r["end"])), end]
            kept = [(a, b) for a, b in zip(edges[::2], edges[1::2]) if a < b]
            left = b" ".join(text[begins[a] : begins[b] - 1] for a, b in kept)
            n = sum(b - a for a, b in kept)
            out.append((doc, end - first, end - first - n, hashlib.sha256(left).hexdigest(), left.decode(), repeats))
            first = end
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 6, kinds)], names=names)


def remove_passages(docs: DataFrame, window: int = 13, part: int = 8 << 20, windows: int = 1 << 21, hot: int = 8, most: int = 1024) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept, repeats) of every document.

    Words are runs of bytes other than ASCII white space, unchanged; ``kept`` are the words left,
    joined by one space, ``repeats`` the maximal runs of removed words (from 0, end exclusive).
    ``window`` is 7 to 21 words.  A task names the windows of ``part`` bytes of text and of
    ``windows`` windows at a time; a seed that ``hot`` of its documents have, or that has over
    ``most`` rows in all, is dealt window by window, with the same result.
    Null and empty texts have no words, and texts shorter than a window keep all.  Earlier means
    smaller doc_id (null first).  Rows that repeat an id and its text get the same result; an id with
    several texts is taken as several documents in order of a hash of the text.  Other
    columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("k", F.coalesce("doc_id", F.lit(LEAST)))
    several = rows.groupBy("k").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b")).filter("a <> b")
    if not several.isEmpty():
        names = save(numbered(rows), "names")
        rows = rows.withColumn("d", F.xxhash64("text")).join(names, ["k", "d"]).select("doc_id", "text", F.col("n").alias("k"))
    schema = "kind byte, h long, c long, k long, p long"
    seeds = rows.select("k", "text").mapInArrow(_scan(window, part, windows, hot), schema)
    found = save(seeds.repartition("h").sortWithinPartitions("h", "kind", "k", "p").mapInArrow(_shared(most), schema), "seeds")
    spots = found.filter(F.col("kind") != MATCH).groupBy("k").agg(F.collect_set(F.struct("h", "p", (F.col("kind") == HOT).alias("hot"))).alias("spots"))
    around = rows.join(spots, "k").mapInArrow(_around(window, part), "key long, k long, at long, lo byte, hi byte, words binary")
    matches = around.repartition("key").sortWithinPartitions("key", "k", "at").mapInArrow(_extend(window), "k long, start long, end long")
    spans = found.filter(F.col("kind") == MATCH).select("k", F.col("p").alias("start"), F.col("c").alias("end")).union(matches)
    spans = spans.groupBy("k").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, repeats array<struct<start:long,end:long>>"
    return rows.join(spans, "k", "left").select("doc_id", "text", "spans").mapInArrow(_cut, out)

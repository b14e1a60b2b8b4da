"""Removal of repeated byte strings with suffix sorting (operator 3).

A byte goes if a string of ``length`` bytes that covers it also starts earlier.

1. Anchors.  Of the k-grams inside a window of ``length`` bytes the one of least
   hash is the window's anchor.  Equal windows have the same anchor at the same
   place, so only windows with equal anchors need comparing.  The windows of
   one anchor lie side by side; their bytes are the anchor's context.  Each task
   first merges equal contexts among its own documents: all but the
   earliest are repeats already, so that a passage or text with very many
   copies leaves a task once.
2. Equal contexts.  Anchors are shuffled by their hash and sorted; of equal
   contexts all but the earliest are repeats.  What is left are the first
   occurrences of different contexts with the same anchor: the edges of repeats.
3. Suffix sorting.  Their bytes are fetched, put end to end as one
   sequence of symbols, and suffix-sorted by grouping on Lyndon prefixes.  In this
   order the contexts that share a window's bytes from the anchor on are
   neighbours; those that also share the bytes before it have the same window.
   All but the earliest of them are repeats.  An anchor with more first contexts
   than one sort takes is not sorted: its windows are dealt by a 128-bit digest
   of their bytes, and all but the earliest of equal digests are repeats.

The repeats of a document are merged and cut out of its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import save

GRAM = 24
U = np.uint64
ODD = U(0x9E3779B97F4A7C15)
BACK = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def suffix_array(seq: list[int]) -> list[int]:
    """Start positions of the suffixes of ``seq`` in order; a proper prefix comes first.

    Phase 1 sorts suffixes into groups of equal Lyndon prefixes.  Groups are taken
    from the last to the first.  Every member finds, by pointers to previous smaller
    ones, the nearest earlier suffix of a lower group; those found go, by how
    many members found them, to new groups right behind their old ones.  Phase 2
    walks the suffixes in order and puts those that end where each one begins
    next in their groups.
    """
    n = len(seq) + 1
    values, symbols = np.unique(np.asarray(seq, dtype=np.int64), return_inverse=True)
    symbols = np.append(symbols + 1, 0)  # an end mark below all
    order = np.argsort(symbols, kind="stable")
    member = order.tolist()
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    place = place.tolist()
    first = np.cumsum(np.bincount(symbols, minlength=len(values) + 1))
    first = np.r_[0, first[:-1]]
    group = first[symbols].tolist()
    size = dict(zip(first.tolist(), np.bincount(symbols, minlength=len(values) + 1).tolist()))
    prev = [-1] * n
    end = n
    while end > 0:
        start = group[member[end - 1]]
        found: dict[int, int] = {}
        for i in sorted(member[start:end]) if end - start > 1 else member[start:end]:
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                found[j] = found.get(j, 0) + 1
        end = start
        if not found:
            continue
        parts: dict[tuple[int, int], list[int]] = {}
        for j, times in found.items():
            parts.setdefault((-times, group[j]), []).append(j)
        for (_, old), moved in sorted(parts.items()) if len(parts) > 1 else parts.items():
            whole = size[old]
            if len(moved) == whole:
                continue
            tail = old + whole
            for j in moved:
                tail -= 1
                at, other = place[j], member[tail]
                member[tail], member[at] = j, other
                place[j], place[other] = tail, at
            for j in moved:
                group[j] = tail
            size[old], size[tail] = whole - len(moved), len(moved)
    out = [-1] * n
    out[0] = n - 1
    put = bytearray(n)
    put[n - 1] = 1
    free = group  # the next free place of a group is kept at its start
    fill = [0] * n
    for r in range(n):
        j = out[r] - 1
        while j >= 0 and not put[j]:
            g = free[j]
            out[g + fill[g]] = j
            fill[g] += 1
            put[j] = 1
            j = prev[j]
    return out[1:]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def _anchors(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(hash, context hash, position, first window, last window) of the anchors of the windows at ``starts``.

    ``data`` are bytes of texts end to end; ``starts`` ascend, and every window lies in one text.
    """
    n = len(data)
    byte = _mix(np.arange(1, 257, dtype=U) * ODD)[data]
    grams, width = {1: byte}, 1
    mult = _mix(np.arange(1, 9, dtype=U))
    while width < GRAM // 2 and 2 * width <= GRAM:
        g = grams[width]
        grams[2 * width] = g[: n - 2 * width + 1] * (mult[width.bit_length()] | U(1)) + g[width : n - width + 1]
        width *= 2
    head, rest = grams[width], grams[GRAM - width]  # 16 + 8
    hashes = _mix(head[: n - GRAM + 1] * (mult[7] | U(1)) + rest[width : width + n - GRAM + 1])
    low = (hashes & ~U((1 << 24) - 1)) | np.arange(len(hashes), dtype=U)  # least hash, leftmost among equals
    span, w = length - GRAM + 1, 1
    while 2 * w <= span:
        low = np.minimum(low[: len(low) - w], low[w:])
        w *= 2
    low = np.minimum(low[: len(low) - (span - w)], low[span - w :]) if span > w else low
    at = (low[starts] & U((1 << 24) - 1)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (np.diff(starts) != 1)])
    pos, s, e = at[new], starts[new], starts[np.r_[new[1:] - 1, len(starts) - 1]]
    power = np.cumprod(np.full(n + 1, ODD), dtype=U)
    total = np.r_[U(0), np.cumsum(byte * power[:n], dtype=U)]
    inverse = np.cumprod(np.full(n + 1, BACK), dtype=U)
    context = (total[e + length] - total[s]) * inverse[s]
    context = _mix(context ^ _mix(((pos - s) * 256 + (pos - e)).astype(U)))
    return hashes[pos], context, pos, s, e


def _scan(ids: list[int], texts: list[bytes], length: int, limit: int = 1 << 19) -> Iterator[list[np.ndarray]]:
    """Columns (flag, h, c, k, pos, lo, hi) of the documents: anchors (0) and repeats among them (1)."""
    pieces: list[tuple[int, int, bytes]] = []  # id, offset in the text, bytes
    for k, t in zip(ids, texts):
        for at in range(0, max(1, len(t) - length + 1), limit):
            if len(t) - at >= length:
                pieces.append((k, at, t[at : at + limit + length - 1]))
    found = []
    at = 0
    while at < len(pieces):
        end, size = at, 0
        while end < len(pieces) and (end == at or size + len(pieces[end][2]) <= 2 * limit):
            size += len(pieces[end][2])
            end += 1
        some = pieces[at:end]
        at = end
        lens = np.array([len(p[2]) for p in some], np.int64)
        base = np.cumsum(lens) - lens
        runs = lens - length + 1
        starts = np.arange(runs.sum()) + np.repeat(base - (np.cumsum(runs) - runs), runs)
        h, c, pos, s, e = _anchors(np.frombuffer(b"".join(p[2] for p in some), np.uint8), starts, length)
        of = np.searchsorted(base, s, side="right") - 1
        shift = np.array([p[1] for p in some], np.int64)[of] - base[of]
        k = np.array([p[0] for p in some], np.int64)[of]
        found.append([h.view(np.int64), c.view(np.int64), k, pos + shift, pos - e, pos - s])
    if not found:
        return
    h, c, k, pos, lo, hi = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((pos, k, c, h))
    same = np.r_[False, (h[order][1:] == h[order][:-1]) & (c[order][1:] == c[order][:-1])]
    keep = order[~same]
    yield [np.zeros(len(keep), np.int8), h[keep], c[keep], k[keep], pos[keep], lo[keep], hi[keep]]
    first = np.empty(len(h), np.int64)
    first[order] = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    again = np.zeros(len(h), bool)
    again[order[same]] = True
    again &= (k != k[first]) | (pos != pos[first])  # a repeated row is no repeat of itself
    yield _merged(k[again], (pos - hi)[again], (pos - lo + length)[again])


def _merged(k: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Repeats as rows of flag 1 (start in pos, end in hi); those of one text that touch become one."""
    order = np.lexsort((start, k))
    k, start, end = k[order], start[order], end[order]
    new = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (start[1:] > end[:-1])]) if len(k) else np.zeros(0, np.int64)
    last = np.r_[new[1:] - 1, len(k) - 1] if len(k) else new
    k, start, end = k[new], start[new], end[last]
    zero = np.zeros(len(k), np.int64)
    return [np.ones(len(k), np.int8), _mix(k.view(U) ^ start.view(U)).view(np.int64), zero, k, start, zero, end]


def _packed(cols: list[np.ndarray]) -> list[np.ndarray]:
    """The columns as (h, c, k, p), half as wide for the shuffle: repeats have p < 0 and their end in c."""
    flag, h, c, k, pos, lo, hi = cols
    return [h, np.where(flag == 1, hi, c), k, np.where(flag == 1, -1 - pos, pos << 24 | (hi & 4095) << 12 | lo & 4095)]


def _unpacked(h: np.ndarray, c: np.ndarray, k: np.ndarray, p: np.ndarray) -> list[np.ndarray]:
    done = p < 0
    return [done.astype(np.int8), h, np.where(done, 0, c), k, np.where(done, -1 - p, p >> 24), np.where(done, 0, p & 4095), np.where(done, c, p >> 12 & 4095)]


NAMES = ["flag", "h", "c", "k", "pos", "lo", "hi"]
SCHEMA = "flag byte, h long, c long, k long, pos long, lo long, hi long"


def _firsts(length: int, most: int = 1 << 62):
    """Mapper over packed anchors sorted by (h, c, k, p): repeats (1), firsts of unlike contexts (2), anchors of over ``most`` of these (3)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # h, c, k, pos of the current context's first row
        waiting: list[np.ndarray] | None = None  # that row, while its anchor has one context
        many = 0  # contexts of the current anchor
        for batch in batches:
            cols = _unpacked(*(batch.column(n).to_numpy() for n in "hckp"))
            if len(cols[0]) == 0:
                continue
            done = cols[0] == 1
            if done.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[done]) for x in cols], names=NAMES)
                cols = [x[~done] for x in cols]
            if not len(cols[0]):
                continue
            _, h, c, k, pos, lo, hi = cols
            ph, pcx = np.r_[last[0] if last else ~h[0], h[:-1]], np.r_[last[1] if last else 0, c[:-1]]
            new_h = h != ph
            new = new_h | (c != pcx)
            at = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
            fk = np.where(at >= 0, k[at], last[2] if last else 0)
            fp = np.where(at >= 0, pos[at], last[3] if last else 0)
            again = ~new & ((k != fk) | (pos != fp))
            if again.any():
                m = _merged(k[again], (pos - hi)[again], (pos - lo + length)[again])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in m], names=NAMES)
            first = np.flatnonzero(new)
            if len(first):
                head = np.flatnonzero(np.r_[True, h[first][1:] != h[first][:-1]])
                total = np.diff(np.r_[head, len(first)])
                before = np.zeros(len(head), np.int64)
                before[0] = many if last and h[first[0]] == last[0] else 0
                many = int(before[-1] + total[-1])
                wide = h[first[head[(before <= most) & (before + total > most)]]]
                if len(wide):
                    none = np.zeros(len(wide), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(wide), 3, np.int8), wide, none, none, none, none, none)], names=NAMES)
            rows = [x[first] for x in (np.full(len(h), 2, np.int8), h, c, k, pos, lo, hi)]
            if waiting:
                rows = [np.concatenate([a, b]) for a, b in zip(waiting, rows)]
            if len(rows[0]):
                rh = rows[1]
                runs = np.r_[True, rh[1:] != rh[:-1]]
                run_id = np.cumsum(runs) - 1
                count = np.bincount(run_id)
                mixed = count[run_id] > 1
                if last and waiting is None:  # more contexts of an anchor already known as mixed
                    mixed |= rh == last[0]
                open_ = (run_id == run_id[-1]) & (rh == h[-1]) & ~mixed
                out = mixed & ~open_
                if out.any():
                    yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in rows], names=NAMES)
                waiting = [x[open_] for x in rows] if open_.any() else None
            last = (h[-1], c[-1], fk[-1], fp[-1])

    return run


def _windows(group: np.ndarray, rank: np.ndarray, back: list[bytes], ahead: list[bytes], lo: np.ndarray, hi: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(row, first offset, last offset): runs of windows, by their bytes before the anchor, that an earlier row has too.

    ``rank`` orders the rows by place in the corpus.
    """
    m = len(group)
    # One sequence: the anchor group, then the bytes from the anchor on, eight to a symbol, then an end mark.
    wide = -(-length // 8) * 8
    ahead_bytes = np.frombuffer(b"".join(a.ljust(wide, b"\0") for a in ahead), np.uint8).reshape(m, wide)
    chunks = ahead_bytes.reshape(m, wide // 8, 8).copy().view(">u8").reshape(m, wide // 8).astype(U)
    size = np.array([len(a) for a in ahead], np.int64)
    _, ranks = np.unique(chunks, return_inverse=True)
    ranks = ranks.reshape(chunks.shape) + 1 + m
    seq, at = [], np.empty(m, np.int64)
    for i, n in enumerate((-(-size // 8)).tolist()):
        at[i] = len(seq)
        seq.append(int(group[i]) + 1)
        seq.extend(ranks[i, :n].tolist())
        seq.append(0)
    order = np.array(suffix_array(seq), np.int64)
    row_at = np.full(len(seq), -1, np.int64)
    row_at[at] = np.arange(m)
    rows = row_at[order]
    rows = rows[rows >= 0]
    same = group[rows][1:] == group[rows][:-1]
    a, b = ahead_bytes[rows[1:]], ahead_bytes[rows[:-1]]
    differ = a != b
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
    common = np.minimum(common, np.minimum(size[rows[1:]], size[rows[:-1]]))
    common = np.r_[-1, np.where(same, common, -1)]
    most = int(hi.max()) if m else 0
    behind = np.zeros((m, most + 1), np.uint8)
    for i, x in enumerate(back):
        if x:
            behind[i, : len(x)] = np.frombuffer(x[::-1], np.uint8)
    behind = behind[rows]
    lo, hi, rank = lo[rows], hi[rows], rank[rows]
    seen = np.zeros(m, U)
    repeat = np.zeros((m, most + 2), bool)
    for o in range(most + 1):
        if o:
            seen = _mix(seen * ODD + behind[:, o - 1].astype(U) + U(1))
        act = np.flatnonzero((lo <= o) & (o <= hi))
        if len(act) < 2:
            continue
        klass = np.cumsum(common < length - o)[act]
        order = np.lexsort((rank[act], seen[act], klass))
        k, s = klass[order], seen[act][order]
        again = np.r_[False, (k[1:] == k[:-1]) & (s[1:] == s[:-1])]
        repeat[act[order[again]], o] = True
    edge = np.diff(np.c_[np.zeros(m, np.int8), repeat.astype(np.int8)], axis=1)
    i, first = np.nonzero(edge == 1)
    _, stop = np.nonzero(edge == -1)
    return list(zip(rows[i].tolist(), first.tolist(), (stop - 1).tolist()))


EDGES = ["h", "d", "k", "pos", "lo", "hi", "back", "ahead"]
WINDOW, DONE = -1, -2  # in ``lo``: a window (digest in h and d, start in pos), a repeat (start in pos, end in hi)


def _dealt(texts: list[bytes], spots: list[tuple[int, int, int]], length: int) -> list[np.ndarray]:
    """Columns (h, d, k, pos, lo, hi) of the windows at ``spots`` (k, first, last), whose bytes are ``texts``:
    the earliest of each digest as a window, the others as repeats."""
    size = [last - first + 1 for _, first, last in spots]
    digests = b"".join(hashlib.blake2b(t[s : s + length], digest_size=16).digest() for t, (_, first, last) in zip(texts, spots) for s in range(last - first + 1))
    h, d = np.frombuffer(digests, np.int64).reshape(-1, 2).T
    k = np.repeat(np.array([x[0] for x in spots], np.int64), size)
    start = np.concatenate([np.arange(first, last + 1) for _, first, last in spots])
    order = np.lexsort((start, k, d, h))
    h, d, k, start = h[order], d[order], k[order], start[order]
    again = np.r_[False, (h[1:] == h[:-1]) & (d[1:] == d[:-1])]
    _, mix, zero, mk, begin, _, end = _merged(k[again], start[again], start[again] + length)
    n = int((~again).sum())
    out = [(h[~again], mix), (d[~again], zero), (k[~again], mk), (start[~again], begin), (np.full(n, WINDOW), np.full(len(mk), DONE)), (np.zeros(n, np.int64), end)]
    return [np.concatenate(x) for x in out]


def _fetch(length: int, windows: int = 1 << 18):
    """Mapper over (k, text, spots): EDGES rows of each spot, of its windows if its anchor is wide."""
    kinds = [pa.int64()] * 6 + [pa.binary()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []  # bytes of spots of wide anchors that are not yet dealt
        wide: list[tuple[int, int, int]] = []
        n = 0

        def deal() -> pa.RecordBatch:
            nonlocal n
            cols = _dealt(texts, wide, length)
            texts.clear()
            wide.clear()
            n = 0
            empty = pa.array([b""] * len(cols[0]), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols] + [empty, empty], names=EDGES)

        for batch in batches:
            for k, text, spots in zip(*(batch.column(c).to_pylist() for c in ("k", "text", "spots"))):
                out = []
                for s in spots:
                    pos, lo, hi = s["pos"], s["lo"], s["hi"]
                    if not s["wide"]:
                        out.append((s["h"], 0, k, pos, lo, hi, text[pos - hi : pos], text[pos : pos + length]))
                        continue
                    texts.append(text[pos - hi : pos - lo + length])
                    wide.append((k, pos - hi, pos - lo))
                    n += hi - lo + 1
                    if n >= windows:
                        yield deal()
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=EDGES)
        if wide:
            yield deal()

    return run


def _compare(length: int, symbols: int = 400_000):
    """Mapper over EDGES rows sorted by (h, d, k, pos): repeats (k, start, end)."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        _, group = np.unique([r[0] for r in rows], return_inverse=True)
        k, pos, lo, hi = (np.array([r[x] for r in rows], np.int64) for x in (1, 2, 3, 4))
        rank = np.empty(len(rows), np.int64)
        order = np.lexsort((pos, k))
        step = np.r_[0, (k[order][1:] != k[order][:-1]) | (pos[order][1:] != pos[order][:-1])]
        rank[order] = np.cumsum(step)
        runs = _windows(group, rank, [r[5] for r in rows], [r[6] for r in rows], lo, hi, length)
        cols = [(int(k[i]), int(pos[i]) - last, int(pos[i]) - first + length) for i, first, last in runs]
        a, b, c = zip(*cols) if cols else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, c)], names=["k", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last: tuple | None = None  # digest of the last window
        for batch in batches:
            kind = batch.column("lo").to_numpy()
            if (kind < 0).any():
                h, d, k, pos, lo, hi = (batch.column(c).to_numpy()[kind < 0] for c in EDGES[:6])
                at = np.flatnonzero(lo == WINDOW)
                if len(at):
                    a, b = h[at], d[at]
                    again = np.r_[last == (a[0], b[0]), (a[1:] == a[:-1]) & (b[1:] == b[:-1])]
                    last = a[-1], b[-1]
                    hi = hi.copy()
                    hi[at] = pos[at] + length
                    lo = lo.copy()
                    lo[at[again]] = DONE
                done = lo == DONE
                yield pa.RecordBatch.from_arrays([pa.array(x[done]) for x in (k, pos, hi)], names=["k", "start", "end"])
                batch = batch.filter(pa.array(kind >= 0))
            for row in zip(*(batch.column(n).to_pylist() for n in ("h", "k", "pos", "lo", "hi", "back", "ahead"))):
                if len(held) * (length // 8 + 2) > symbols and held[-1][0] != row[0]:
                    yield flush(held)
                    held = []
                held.append(row)
        if held:
            yield flush(held)

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mapper over repeats (k, start, end) sorted by k and start: those that touch become one."""
    for batch in batches:
        cols = _merged(*(batch.column(c).to_numpy() for c in ("k", "start", "end")))
        yield pa.RecordBatch.from_arrays([pa.array(cols[i]) for i in (3, 4, 6)], names=["k", "start", "end"])


def numbered(rows: DataFrame) -> DataFrame:
    """(k, d, n) of every id and text hash; ``n`` rises in their order, from the partition and the place in it."""
    names = rows.select("k", F.xxhash64("text").alias("d")).distinct().orderBy("k", "d")
    return names.withColumn("n", F.monotonically_increasing_id())


def remove_repeats(docs: DataFrame, length: int = 100, part: int = 8 << 20, symbols: int = 400_000) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every document; ``kept`` are the bytes left.

    ``length`` is 32 to 4000; a task looks at ``part`` bytes of text at a time.
    A sort takes about ``symbols`` symbols, and anchors whose contexts have more
    go by the digests of their windows.
    Texts are UTF-8 bytes; null counts as empty; texts shorter than ``length``
    keep all.  Earlier means smaller doc_id (null first), or the same document and an
    earlier start.  Rows that repeat an id and its text are one document and get the
    same result; an id with several texts is taken as several documents in order
    of a hash of the text.  Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    least = -(1 << 63)
    rows = rows.withColumn("k", F.coalesce("doc_id", F.lit(least)))
    several = rows.groupBy("k").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b")).filter("a <> b")
    if not several.isEmpty():
        names = save(numbered(rows), "names")
        rows = rows.withColumn("d", F.xxhash64("text")).join(names, ["k", "d"]).select("doc_id", "text", F.col("n").alias("k"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("k").to_pylist(), batch.column("text")
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(ids):  # some megabytes at a time
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + part, side="right")))
                for cols in _scan(ids[at:end], texts[at:end].to_pylist(), length):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in _packed(cols)], names=list("hckp"))
                at = end

    anchors = rows.select("k", "text").mapInArrow(scan, "h long, c long, k long, p long")
    found = save(anchors.repartition("h").sortWithinPartitions("h", "c", "k", "p").mapInArrow(_firsts(length, max(1, symbols // (length // 8 + 2))), SCHEMA), "repeats")

    spots = found.filter("flag = 2").select("h", "k", "pos", "lo", "hi")
    wide = found.filter("flag = 3").select("h")
    split = not wide.isEmpty()
    # One row in ``symbols`` / (``length`` / 8 + 2) contexts at most.
    spots = spots.join(F.broadcast(wide.withColumn("wide", F.lit(True))), "h", "left") if split else spots.withColumn("wide", F.lit(False))
    spots = spots.groupBy("k").agg(F.collect_list(F.struct("h", "pos", "lo", "hi", F.coalesce("wide", F.lit(False)).alias("wide"))).alias("spots"))
    near = rows.select("k", "text").dropDuplicates(["k"])  # rows that repeat a document would give its edges again

    edges = near.join(spots, "k").mapInArrow(_fetch(length), "h long, d long, k long, pos long, lo long, hi long, back binary, ahead binary")
    edges = edges.repartition("h").sortWithinPartitions("h", "d", "k", "pos").mapInArrow(_compare(length, symbols), "k long, start long, end long")
    if split:
        edges = edges.repartition("k").sortWithinPartitions("k", "start").mapInArrow(_joined, "k long, start long, end long")
    spans = found.filter("flag = 1").select("k", F.col("pos").alias("start"), F.col("hi").alias("end")).union(edges)
    spans = spans.groupBy("k").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        for batch in batches:
            out = []
            for doc, text, spans in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "text", "spans"))):
                kept, n, at = [], 0, 0
                for s, e in sorted((x["start"], x["end"]) for x in spans or []):
                    if s > at or not n:
                        kept.append(text[at:s])
                        n += 1
                    at = max(at, e)
                kept.append(text[at:])
                left = b"".join(kept)
                out.append((doc, len(text), len(text) - len(left), n, hashlib.sha256(left).hexdigest(), left))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds], names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return rows.join(spans, "k", "left").select("doc_id", "text", "spans").mapInArrow(cut, schema)

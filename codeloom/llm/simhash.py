"""SimHash near-duplicates by a segment-popcount grid join (operator 5).

A fingerprint is mapped to the bit counts of its eight 8-bit segments.  The
Manhattan distance of two such vectors never exceeds the Hamming distance of
the fingerprints, so it is a lower bound to filter by.  Within d bits, one of
the two 32-bit halves differs in at most d // 2 bits, hence its four counts lie
within Manhattan distance d // 2.  Each half is a grid of unit cells in those
four counts (at most 9^4 cells), whose cells are joined with the cells in
reach; both sides of a joined row are bounded tiles of fingerprints.  Within a
pair of tiles the counts of all eight segments are held against distance d, and
only what passes is compared exactly with XOR and bit counts in numpy.

Equal fingerprints are collapsed first.  Cells are dealt into tiles of about
``tile`` fingerprints by hash, so a crowded cell becomes many joined tile
pairs rather than one task.  A tile pair emits a star per group of linked
fingerprints, never all of its pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import save, star
from codeloom.llm.components import components

SEGMENTS = 4  # 8-bit segments in each half


def _fingerprint(text: str | None, width: int, block: int = 1 << 16) -> int:
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n = max(1, len(words) - width + 1)
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    hash64, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, block):
        h = [hash64(joined[s:e], 42) for s, e in zip(starts[at : min(n, at + block)].tolist(), last[at : at + block].tolist())]
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of every whole text, as a signed long.

    Words are runs of non-white-space bytes after lower-casing A-Z; shingles are
    ``width`` words joined by a space, repeats included; fewer words give one
    shingle of all words, none (null or blank text) give fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [_fingerprint(t, width) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(fp, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _reach(bits: int) -> list[list[int]]:
    """Cell steps within Manhattan distance ``bits``; of a step and its opposite only one."""
    span = range(-bits, bits + 1)
    steps = [s for s in itertools.product(span, repeat=SEGMENTS) if sum(map(abs, s)) <= bits]
    return [list(s) for s in steps if s >= (0,) * SEGMENTS]


def _cells(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct bit counts of all segments; positions of fingerprints by them, each cell's start and size."""
    counts = np.bitwise_count(np.ascontiguousarray(fp).view(np.uint8)).reshape(-1, 2 * SEGMENTS)
    code = np.ascontiguousarray(counts[:, ::2] << 4 | counts[:, 1::2]).view(np.uint32).ravel()  # a count takes four bits
    order = np.argsort(code, kind="stable")
    code = code[order]
    start = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
    return counts[order[start]].astype(np.int8), order, start, np.diff(np.append(start, len(code)))


def _within(x: np.ndarray, y: np.ndarray, bits: int, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) in ``x`` and ``y`` whose bit counts in all segments lie within Manhattan distance ``bits``.

    They come about ``most`` at a time, so memory does not grow with their number.
    """
    (cx, at_x, start_x, size_x), (cy, at_y, start_y, size_y) = _cells(x), _cells(y)
    unlike = [s for s in range(2 * SEGMENTS) if len(cx) and ((cx[:, s] != cx[0, s]).any() or (cy[:, s] != cx[0, s]).any())]
    for lo in range(0, len(cx), 256):
        far = np.zeros((len(cx[lo : lo + 256]), len(cy)), np.int8)  # at most 64
        for s in unlike:
            far += np.abs(cx[lo : lo + 256, s, None] - cy[None, :, s])
        p, q = np.nonzero(far <= bits)
        p += lo
        ends = np.cumsum(size_x[p] * size_y[q])
        for at in range(0, int(ends[-1]) if len(ends) else 0, most):
            n = np.arange(at, min(at + most, ends[-1]))
            k = np.searchsorted(ends, n, side="right")
            n = n - (ends[k] - size_x[p[k]] * size_y[q[k]])
            wide = size_y[q[k]]
            yield at_x[start_x[p[k]] + n // wide], at_y[start_y[q[k]] + n % wide]


def fingerprint_links(prints: DataFrame, bits: int = 4, tile: int = 4096) -> DataFrame:
    """Links (a, b) that connect the rows of ``prints`` (node, fp; fp distinct) within ``bits``.

    The links span each group of linked fingerprints; they are not all pairs.
    """
    counts = F.array(*[F.bit_count(F.shiftrightunsigned("fp", 8 * s).bitwiseAND(F.lit(255))) for s in range(2 * SEGMENTS)])
    rows = prints.withColumn("__n", counts).select(
        "node", "fp", F.explode(F.array(*[F.struct(F.lit(h).alias("half"), F.slice("__n", 1 + h * SEGMENTS, SEGMENTS).alias("cell")) for h in (0, 1)])).alias("c")
    )
    rows = rows.select("node", "fp", "c.half", "c.cell")
    # At most 2 * 9^4 cells, whatever the input: a proven bound for this broadcast.
    tiles_of = rows.groupBy("half", "cell").agg(F.ceil(F.count("*") / tile).alias("tiles"))
    rows = rows.join(F.broadcast(tiles_of), ["half", "cell"]).withColumn("t", F.pmod(F.xxhash64("fp"), F.col("tiles")))
    tiles = save(rows.groupBy("half", "cell", "t").agg(F.collect_list("fp").alias("fp"), F.collect_list("node").alias("node")), "tiles")
    step = F.explode(F.array(*[F.array(*map(F.lit, s)) for s in _reach(bits // 2)])).alias("step")
    near = tiles.select("half", "cell", "t", "fp", "node", step)
    near = near.select(
        "half", F.zip_with("cell", "step", lambda c, s: c + s).alias("cell"), F.col("t").alias("t1"), F.col("fp").alias("fp1"), F.col("node").alias("node1"),
        F.exists("step", lambda s: s != 0).alias("other"),
    )
    pairs = near.join(tiles, ["half", "cell"]).filter("other or t1 <= t").select("fp1", "node1", "fp", "node")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                x, u, y, v = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("fp1", "node1", "fp", "node"))
                x, y = x.view(np.uint64), y.view(np.uint64)  # bit counts of signed values ignore the sign
                found = []
                for i, j in _within(x, y, bits):
                    i, j = (z[np.bitwise_count(x[i] ^ y[j]) <= bits] for z in (i, j))
                    apart = u[i] != v[j]
                    if apart.any():
                        found.append(star(u[i[apart]], v[j[apart]]))
                if found:
                    a, b = (np.concatenate(z) for z in zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array(z) for z in star(a, b)], names=["a", "b"])

    return pairs.mapInArrow(verify, "a long, b long")


def simhash_dedup(docs: DataFrame, width: int = 4, bits: int = 4, tile: int = 4096) -> DataFrame:
    """(doc_id, fp, component_id) of every document.

    component_id is the smallest doc_id reachable over links of fingerprints at
    ``bits`` or fewer differing bits.  Rows without words have fingerprint zero
    and link like any other.  Rows with null doc_id get a null component and
    link nothing.  Repeated rows give repeated rows.  Other columns are ignored.
    """
    prints = save(fingerprints(docs, width), "prints")
    nodes = save(prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    comps = components(fingerprint_links(nodes, bits, tile))
    label = nodes.join(comps, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    out = prints.join(label, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, width: int = 4, bits: int = 4) -> DataFrame:
    """``docs`` with one row of each component left: that of the smallest doc_id.

    Rows with null doc_id stay.  Of repeated rows of the smallest doc_id all stay,
    as they are one document to this operator; exact deduplication comes before.
    """
    found = simhash_dedup(docs.select("doc_id", "text"), width, bits)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)

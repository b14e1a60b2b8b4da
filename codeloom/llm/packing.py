"""Packing token pieces into windows by multiway differencing (operator 6).

A document's ids (its end id included) are cut into whole windows and one
remainder.  Whole windows stand alone without padding.  Remainders, cut to
``part`` ids at most, are packed ``windows`` windows at a time by the
Karmarkar-Karp method for many ways: every piece starts as a partition of its own with one filled window; the two
partitions of greatest imbalance are merged by putting the fullest windows of
the one with the emptiest of the other, until one partition is left, whose
windows are near equal.  The number of windows starts at total / capacity and
rises while the fullest window exceeds the capacity.

The last group of a task is packed alike into the windows it can fill, with its
pieces cut smaller until they fit.  The ids left, less than a window, are not padded: they are
cut into sequences of the powers of two that their number is made of.  A group is
bounded and lies within one input partition, so nothing is shuffled, a task
holds one group and one batch, and a lost task repeats the same result.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.bpe import SPACE, Model
from codeloom.llm.common import held, share

END_ID = 0

# Fixed value: the pre-tokeniser's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CUT = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")


class Ids:
    """Ids of texts by the tiktoken library over the vocabulary of a tokenizers file.

    The library merges by token rank, so ids must rise in the order of the merges.
    A text is cut in front of white space behind other characters, where a piece of
    the pre-tokeniser ends and no special token can lie.  A stretch of over two
    spans without such a place goes through the streaming encoder, whose ids are
    the same and whose memory is bounded.
    """

    SPAN = 1 << 14

    def __init__(self, model: Model):
        made = [new for _, new in sorted(model.merges.values())]
        if made != sorted(made):
            raise ValueError("token ids do not rise in the order of the merges")
        if any(re.search(f"[{SPACE}]", t) for t in model.special):
            raise ValueError("a special token holds white space")
        self.model, self.library = model, None

    def blocks(self, text: str | None) -> Iterator[bytes]:
        """The ids of ``text`` as little-endian unsigned 32-bit integers, a span at a time."""
        if self.library is None:
            import tiktoken

            special = self.model.special
            ranks = {t: i for i, t in enumerate(self.model.tokens) if t and i not in special.values()}
            self.library = tiktoken.Encoding("ids", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        text, at = text or "", 0
        while at < len(text):
            cut = CUT.search(text, at + self.SPAN)
            end = cut.start() if cut else len(text)
            if end - at > 2 * self.SPAN:
                yield from self.model.encoder().blocks(text[at:end])
            else:
                yield self.library.encode_to_numpy(text[at:end], allowed_special="all").astype("<u4").tobytes()
            at = end


def difference(sizes: list[int], ways: int) -> list[list[int]]:
    """Indices of ``sizes`` in ``ways`` groups of near-equal sums, by multiway differencing.

    Only filled windows of a partition are stored, fullest first; the others are
    empty.  Equal imbalances are taken in order of creation.
    """
    heap = [(-s, i, [s], [(i,)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        over = len(a) + len(b) - ways  # windows that must be shared
        if over <= 0:
            sums, kept = a + b, x + y
        else:
            # The emptiest windows of one with the fullest of the other: opposite ends meet.
            cut = len(a) - over
            sums = a[:cut] + [p + q for p, q in zip(a[cut:], reversed(b[len(b) - over :]))] + b[: len(b) - over]
            kept = x[:cut] + [(p, q) for p, q in zip(x[cut:], reversed(y[len(y) - over :]))] + y[: len(y) - over]
        order = sorted(range(len(sums)), key=lambda i: -sums[i])
        sums, kept = [sums[i] for i in order], [kept[i] for i in order]
        low = sums[-1] if len(sums) == ways else 0
        heapq.heappush(heap, (low - sums[0], made, sums, kept))
        made += 1
    groups = []
    for tree in heap[0][3] if heap else []:
        flat, todo = [], [tree]
        while todo:
            t = todo.pop()
            if isinstance(t, int):
                flat.append(t)
            else:
                todo.extend(reversed(t))
        groups.append(flat)
    return groups


def pack_group(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``; as few as differencing can fill, never fewer than the total needs."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        groups = difference(sizes, ways)
        if max((sum(sizes[i] for i in g) for g in groups), default=0) <= capacity:
            return groups
        ways += 1


def pack(docs: DataFrame, path: str, capacity: int = 1024, windows: int = 64, part: int = 256, slack: int = 16, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_to.

    A group closes at ``windows`` * (``capacity`` - ``slack``) ids, so that windows
    of near-equal sums fit; the piece that reaches this mark is cut there.

    Ids are those of the tokenizer file at ``path`` and ``end_id`` behind each
    document; null and empty texts have the end id alone.  ``capacity`` is a
    power of two.  A sequence of another length than a power of two is padded to
    ``capacity``.  sequence_id is unique, not dense.  Rows with equal or null
    doc_id are packed each on its own; other columns are ignored; an empty table
    gives an empty result.
    """
    ids_of = share(docs.sparkSession, Ids(Model(path)))  # the vocabulary: fixed size
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = held(ids_of).blocks
        sequence = TaskContext.get().partitionId() << 40
        rest: list[tuple[int, int, bytes, int]] = []  # doc_id, start, ids, doc_tokens
        out: list[tuple] = []
        mark, filled = windows * (capacity - slack), 0  # ids of a group; ids in rest

        def put(piece: tuple, offset: int, padded: int) -> None:
            doc, start, ids, total = piece
            out.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset, padded))

        def close(groups: list[list[int]]) -> None:
            nonlocal sequence
            for g in groups:
                length = sum(len(rest[i][2]) // 4 for i in g)
                offset = 0
                for i in g:
                    put(rest[i], offset, length if length & (length - 1) == 0 else capacity)
                    offset += len(rest[i][2]) // 4
                sequence += 1
            rest.clear()

        def last() -> None:
            """The last group: as many windows as its ids fill, without more windows for the sake of a fit."""
            ways = filled // (capacity - slack)
            left = ways * (capacity - slack)
            whole, over = [], []
            for doc, start, ids, total in rest:
                cut = min(left, len(ids) // 4)
                left -= cut
                whole += [(doc, start, ids[: 4 * cut], total)] if cut else []
                over += [(doc, start + cut, ids[4 * cut :], total)] if 4 * cut < len(ids) else []
            most = part
            while ways:
                rest[:] = [(doc, start + at, ids[4 * at : 4 * (at + most)], total) for doc, start, ids, total in whole for at in range(0, len(ids) // 4, most)]
                sizes = [len(p[2]) // 4 for p in rest]
                groups = difference(sizes, ways)
                if most == 1 or max(sum(sizes[i] for i in g) for g in groups) <= capacity:
                    close(groups)
                    break
                most //= 2
            rest[:] = over
            powers()

        def powers() -> None:
            """The rest in sequences whose lengths are powers of two, cutting where one is full."""
            nonlocal sequence
            left = sum(len(p[2]) // 4 for p in rest)
            room = offset = 0
            for doc, start, ids, total in rest:
                at = 0
                while at < len(ids) // 4:
                    if not room:
                        room = min(capacity, 1 << (left.bit_length() - 1))
                        full, offset = room, 0
                        left -= room
                    take = min(room, len(ids) // 4 - at)
                    put((doc, start + at, ids[4 * at : 4 * (at + take)], total), offset, full)
                    at, room, offset = at + take, room - take, offset + take
                    if not room:
                        sequence += 1
            rest.clear()

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = b"".join([*blocks(text), end])
                total = len(ids) // 4
                whole = total - total % capacity
                for at in range(0, whole, capacity):
                    put((doc, at, ids[4 * at : 4 * (at + capacity)], total), 0, capacity)
                    sequence += 1
                at = whole
                while at < total:
                    take = min(part, total - at, mark - filled)
                    rest.append((doc, at, ids[4 * at : 4 * (at + take)], total))
                    at, filled = at + take, filled + take
                    if filled == mark:
                        close(pack_group([len(p[2]) // 4 for p in rest], capacity))
                        filled = 0
                if len(out) > 50_000:
                    yield flush()
        last()
        yield flush()

    schema = ", ".join(f"`{n}` long" for n in names)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)

"""Byte-level BPE as a bounded-lookahead streaming transducer (operator 1).

Encoding.  Text is cut in front of white space that follows other characters,
where the pre-tokeniser always ends a piece.  A piece is a byte string; its
tokens depend on a bounded number of bytes to their right.  That lookahead
follows from the merge list.  Take merges in order of rank and let
need[t] be the bytes behind a token t that settle whether t stands there in the
face of all merges so far.  A merge (t, w) at rank k can take t away if w
follows, which |w| + need[w] bytes settle; the token t + w, when it is made, is
settled by what settles w.  One pass over the merges gives the largest need;
with the longest token it bounds how far an encoder must see to emit
a token.  Every piece is read window by window, many pieces side by side:
tokens that start at least that far from the window's end are emitted and
never change; a window that reaches the end of its piece, which is the first
one for nearly all, settles the rest.  Beside the text itself, memory is that
of a window, however long the piece, and of a cache of bounded size whose ids
come from the transducer.

Decoding.  Token bytes pass through an incremental UTF-8 state machine, which
carries an unfinished character from one token to the next.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import held, share

# Unicode's White_Space, and the pre-tokeniser's pattern.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^S\p{L}\p{N}]+|[S]+(?![^S])|[S]+".replace("S", SPACE)
UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


def _byte_of_symbol() -> dict[str, int]:
    """The vocabulary's printable stand-ins: visible Latin-1 characters are themselves, others follow from 256."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(other)}


class Model:
    """Merge ranks and token bytes of a tokenizers JSON file; read on the driver, sent to the executors."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbol = _byte_of_symbol()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for s, i in vocab.items():
            self.tokens[i] = bytes(symbol[c] for c in s) if s not in self.special else s.encode()
        for s, i in self.special.items():
            self.tokens[i] = s.encode()
        self.of_byte = [0] * 256
        for b, c in ((b, c) for c, b in symbol.items()):
            self.of_byte[b] = vocab[c]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.byte_ids = np.array(self.of_byte, np.int64)
        self._table()
        self.shared: Encoder | None = None
        self.lookahead = sufficient_lookahead(self.merges, self.tokens)
        self.hold = self.lookahead + max(map(len, self.tokens))

    BITS, NONE = 20, 1 << 40

    def _table(self) -> None:
        """Open-addressed arrays of merge ranks by token pair, for lookups of many pairs at once."""
        self.keys, self.rank = np.full(1 << self.BITS, -1, np.int64), np.full(1 << self.BITS, self.NONE, np.int64)
        self.made = np.zeros(max((r for r, _ in self.merges.values()), default=0) + 1, np.int64)
        self.probes = 1
        for (a, b), (r, new) in self.merges.items():
            key, self.made[r] = a << 32 | b, new
            at, probes = int(self._slot(np.array([key]))[0]), 1
            while self.keys[at] >= 0:
                at, probes = (at + 1) & ((1 << self.BITS) - 1), probes + 1
            self.keys[at], self.rank[at], self.probes = key, r, max(self.probes, probes)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at, out = self._slot(key), np.full(len(key), self.NONE, np.int64)
        for _ in range(self.probes):
            out = np.where(self.keys[at] == key, self.rank[at], out)
            at = (at + 1) & ((1 << self.BITS) - 1)
        return out

    def many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (little-endian 32-bit) of many short pieces; each round makes the next merge of every piece."""
        size = np.array([len(p) for p in pieces], np.int64)
        ids = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        of = np.repeat(np.arange(len(pieces)), size)
        rank = np.full(len(ids), self.NONE, np.int64)
        inner = np.flatnonzero(of[:-1] == of[1:])
        rank[inner] = self.ranks(ids[inner], ids[inner + 1])
        done_of, done_ids = [], []
        while len(ids):
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            low = np.minimum.reduceat(rank, starts)
            width = np.diff(np.r_[starts, len(ids)])
            open_ = np.repeat(low < self.NONE, width)
            if not open_.all():
                done_of.append(of[~open_])
                done_ids.append(ids[~open_])
                low, width = low[low < self.NONE], width[low < self.NONE]
                ids, of, rank = ids[open_], of[open_], rank[open_]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, width))
            hit = hit[np.r_[True, of[hit[1:]] != of[hit[:-1]]]]  # the leftmost of each piece
            ids[hit] = self.made[rank[hit]]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            ids, of, rank = ids[keep], of[keep], rank[keep]
            hit -= np.arange(len(hit))
            for at in (hit, hit[hit > 0] - 1):
                right = np.minimum(at + 1, len(ids) - 1)
                rank[at] = np.where((of[at] == of[right]) & (right > at), self.ranks(ids[at], ids[right]), self.NONE)
        of = np.concatenate(done_of) if done_of else np.zeros(0, np.int64)
        order = np.argsort(of, kind="stable")
        flat = (np.concatenate(done_ids)[order] if done_ids else of).astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(of, minlength=len(pieces)))).tolist()
        return [flat[s:e] for s, e in zip([0, *ends], ends)]

    def encoder(self) -> "Encoder":
        """An encoder that lives as long as this model does in a worker, so tasks share its cache."""
        if self.shared is None:
            self.shared = Encoder(self)
        return self.shared

    def window(self, data: bytes) -> list[int]:
        """Tokens of a byte string taken as a whole: least rank first, leftmost among equals."""
        ids = [self.of_byte[b] for b in data]
        get = self.merges.get
        n = len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if m := get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, new, ids[k], m[1]))
            if (h := prv[i]) >= 0 and (m := get((ids[h], new))):
                heapq.heappush(heap, (m[0], h, ids[h], new, m[1]))
        return [t for t in ids if t >= 0]

    def windows(self, data: list[bytes], small: int = 64) -> list[bytes]:
        """Ids (little-endian 32-bit) of many windows, each as ``window`` has them; small ones all at once."""
        few = [w for w in data if len(w) <= small]
        quick = iter(self.many(few) if few else [])
        return [next(quick) if len(w) <= small else np.array(self.window(w), "<u4").tobytes() for w in data]

    def emit(self, data: list[bytes], chunk: int = 4096) -> Iterator[list[tuple[int, bytes]]]:
        """The transducer over many pieces side by side: a round reads the next window of every open piece.

        A round gives (piece, its ids that are stable now).  A window that reaches
        the end of its piece settles all of it.
        """
        at = dict.fromkeys(range(len(data)), 0)
        while at:
            seen = {n: data[n][a : a + self.hold + chunk] for n, a in at.items()}
            done, moved = [], {}
            for (n, window), ids in zip(seen.items(), self.windows(list(seen.values()))):
                if at[n] + len(window) < len(data[n]):
                    end = count = 0
                    for t in np.frombuffer(ids, "<u4").tolist():
                        if end > chunk:
                            break
                        end += len(self.tokens[t])
                        count += 1
                    ids, moved[n] = ids[: 4 * count], at[n] + end
                done.append((n, ids))
            at = moved
            yield done

    def pieces(self, data: list[bytes]) -> list[bytes]:
        """Ids of each of many pieces, put together from what the transducer emits."""
        out: list[list[bytes]] = [[] for _ in data]
        for done in self.emit(data):
            for n, ids in done:
                out[n].append(ids)
        return [ids[0] if len(ids) == 1 else b"".join(ids) for ids in out]

    def piece(self, data: bytes, chunk: int = 4096) -> Iterator[list[int]]:
        """Tokens of one piece in order, emitted once they are stable."""
        for done in self.emit([data], chunk):
            yield from (np.frombuffer(ids, "<u4").tolist() for _, ids in done)


def sufficient_lookahead(merges: dict[tuple[int, int], tuple[int, int]], tokens: list[bytes]) -> int:
    """Bytes behind a token that settle it, over all tokens; see the module text."""
    need = [0] * len(tokens)
    for (a, b), (_, new) in sorted(merges.items(), key=lambda m: m[1]):
        reach = len(tokens[b]) + need[b]
        need[new] = max(need[new], need[b])
        need[a] = max(need[a], reach)
    return max(need, default=0)


class Encoder:
    """Encodes texts block by block; every piece goes through the transducer.

    The ids of units (white space and the run behind it) of up to ``KEEP``
    characters are cached, ``LIMIT`` of them.  Texts are taken ``SIZE`` characters
    at a time; a unit longer than that is streamed.
    """

    LIMIT, KEEP, SIZE = 1_600_000, 48, 1 << 20

    def __init__(self, model: Model):
        import regex

        self.model, self.units = model, {}
        self.split, self.cut = regex.compile(PIECE).findall, regex.compile(PIECE).finditer
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(model.special, key=len, reverse=True))) + ")") if model.special else None

    def _learn(self, units: set[str]) -> dict[str, bytes]:
        """Ids of new units; those not too long to keep also go to the cache."""
        # Letters behind one space are one piece.
        parts = {u: [u] if u[0] == " " and u[1:].isalpha() else self.split(u) for u in units}
        known = self._pieces({p for ps in parts.values() for p in ps})
        out = {u: known[u] if len(ps) == 1 else b"".join([known[p] for p in ps]) for u, ps in parts.items()}
        self.units.update(out if max(map(len, out)) <= self.KEEP else {u: x for u, x in out.items() if len(u) <= self.KEEP})
        return out

    def _pieces(self, pieces: set[str]) -> dict[str, bytes]:
        return dict(zip(pieces, self.model.pieces([p.encode("utf-8", "surrogatepass") for p in pieces])))

    def _stream(self, unit: str) -> Iterator[bytes]:
        """The ids of one long unit: short pieces together, those of a long piece as they become stable."""
        short, chars = [], 0
        for m in self.cut(unit):
            if len(m[0]) <= self.KEEP:
                short.append(m[0])
                chars += len(m[0])
            if short and (chars >= self.SIZE or len(m[0]) > self.KEEP):
                known = self._pieces(set(short))
                yield b"".join(map(known.__getitem__, short))
                short, chars = [], 0
            if len(m[0]) > self.KEEP:
                for done in self.model.emit([m[0].encode("utf-8", "surrogatepass")]):
                    yield from (ids for _, ids in done)
        if short:
            known = self._pieces(set(short))
            yield b"".join(map(known.__getitem__, short))

    def _ids(self, blocks: list[list[str]]) -> Iterator[bytes]:
        if len(self.units) > self.LIMIT:
            self.units.clear()
        known = [list(map(self.units.get, units)) for units in blocks]
        new = {u for units, ids in zip(blocks, known) if None in ids for u, x in zip(units, ids) if x is None}
        learnt = self._learn(new) if new else {}
        for units, ids in zip(blocks, known):
            yield b"".join([learnt[u] if x is None else x for u, x in zip(units, ids)] if None in ids else ids)

    def cuts(self, text: str | None) -> Iterator[list[str] | str | bytes]:
        """Lists of units of about ``SIZE`` characters, a longer unit by itself, or the ids of a special token."""
        for part in self.special.split(text or "") if self.special else [text or ""]:
            if part in self.model.special:
                yield np.array([self.model.special[part]], "<u4").tobytes()
            elif len(part) <= self.SIZE:
                yield UNIT.findall(part)
            else:
                held, chars = [], 0
                for m in UNIT.finditer(part):
                    if len(m[0]) > self.SIZE:
                        yield held
                        yield m[0]
                        held, chars = [], 0
                        continue
                    held.append(m[0])
                    chars += len(m[0])
                    if chars >= self.SIZE:
                        yield held
                        held, chars = [], 0
                yield held

    def blocks(self, text: str | None) -> Iterator[bytes]:
        """The ids of ``text`` as little-endian unsigned 32-bit integers, a block at a time."""
        for cut in self.cuts(text):
            if isinstance(cut, str):
                yield from self._stream(cut)
            else:
                yield from [cut] if isinstance(cut, bytes) else self._ids([cut])

    def texts(self, texts: list[str | None], chars: int = 1 << 21) -> Iterator[Iterator[bytes]]:
        """The blocks of each text in turn; short texts are encoded some megabytes at a time."""
        at = 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and held < chars and len(texts[end] or "") <= self.SIZE:
                held += len(texts[end] or "")
                end += 1
            if end == at:
                yield self.blocks(texts[at])
                at += 1
                continue
            cuts = [list(self.cuts(t)) for t in texts[at:end]]
            ids = self._ids([c for cut in cuts for c in cut if not isinstance(c, bytes)])
            for cut in cuts:
                yield iter([c if isinstance(c, bytes) else next(ids) for c in cut])
            at = end

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(self.blocks(text)), "<u4")


class Decoder:
    """Incremental decoder: feed ids in any cuts, finish once; malformed bytes become U+FFFD."""

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.state = tokens, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray) -> str:
        return self.state.decode(b"".join(map(self.tokens.__getitem__, ids.tolist())))

    def finish(self) -> str:
        return self.state.decode(b"", True)


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the token ids of every whole text, as little-endian 32-bit integers in a binary.

    Null and empty texts give no ids; repeated rows give repeated rows; other
    columns are ignored; an empty table gives an empty result.
    """
    model = share(docs.sparkSession, Model(path))  # the vocabulary: fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(model).encoder()
        for batch in batches:
            ids = [b"".join(blocks) for blocks in encoder.texts(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, same): digests of ids and of the text decoded from them.

    Ids stream from the encoder to the decoder a block at a time, so a long text
    needs a block's memory.  ``same`` tells whether the decoded text is the input
    (null counts as empty).  Ties, repeated rows and other columns as in encode_texts.
    """
    import hashlib

    model = share(docs.sparkSession, Model(path))

    def one(text: str | None, blocks: Iterator[bytes], tokens: list[bytes]) -> tuple[int, str, str, bool]:
        n, ids_hash, text_hash, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(tokens)
        for block in blocks:
            ids_hash.update(block)
            ids = np.frombuffer(block, "<u4")
            n += len(ids)
            text_hash.update(decoder.feed(ids).encode("utf-8"))
        text_hash.update(decoder.finish().encode("utf-8"))
        given = hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).hexdigest()
        return n, ids_hash.hexdigest(), text_hash.hexdigest(), text_hash.hexdigest() == given

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tokens = held(model).encoder(), held(model).tokens
        for batch in batches:
            texts = batch.column("text").to_pylist()
            cols = list(zip(*(one(t, ids, tokens) for t, ids in zip(texts, encoder.texts(texts))))) or [(), (), (), ()]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "same"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)

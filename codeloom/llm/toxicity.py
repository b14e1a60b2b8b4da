"""Toxicity scores from subword-bag embeddings (operator 4).

Each word is a bag of hashed character n-grams plus the whole word.  The
embeddings of a window's words are averaged and fed to a linear softmax; both
are trained jointly by gradient descent in numpy.  A misspelling shares most of
its n-grams, hence most of its vector, with the word it stands for.  A text is
scored by its windows of ``WINDOW`` words, one from every word on (a shorter text is
one window): its score is that of the highest window, so a long text does not
dilute an insult, wherever it stands.  Training follows the same rule on windows
that overlap by half: a clean text supplies windows labelled 0; of
a toxic text the window that now scores highest is labelled 1.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import fold_of

BUCKETS, DIM, WINDOW = 1 << 17, 12, 24
WORD = re.compile(r"\w{1,64}")  # a longer run is read as several words
MIX = np.uint64(0x9E3779B97F4A7C15)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of 3 to 5 characters of <word> and of the whole of it, and the word of each, in order."""
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), size)
    start = np.cumsum(size) - size
    place = np.arange(len(points)) - start[word]
    left = size[word] - place
    gram = np.zeros(len(points), np.uint64)
    found, of = [], []
    for n in range(1, 6):
        gram = gram[: len(points) - n + 1]
        gram = (gram ^ points[n - 1 :]) * MIX
        gram ^= gram >> np.uint64(31)
        if n >= 3:
            at = np.flatnonzero(left[: len(gram)] >= n)
            found.append(gram[at] + np.uint64(n))
            of.append(word[at])
    whole = np.add.reduceat((points + np.uint64(1)) * (place.astype(np.uint64) * MIX | np.uint64(1)), start) if len(words) else gram
    found.append(whole ^ (whole >> np.uint64(33)))
    of.append(np.arange(len(words)))
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    bucket = (np.concatenate(found) * MIX) >> np.uint64(64 - BUCKETS.bit_length() + 1)
    return bucket.astype(np.int64)[order], of[order]


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Bag:
    """Flat subword ids of a word list, gathered once; windows refer to words."""

    def __init__(self, texts: list[str]):
        index: dict[str, int] = {}
        self.words = [np.array([index.setdefault(w, len(index)) for w in words_of(t)], np.int32) for t in texts]
        self.ids, of = subwords(list(index))
        self.size = np.bincount(of, minlength=len(index))
        self.start = np.cumsum(self.size) - self.size

    def flat(self, words: np.ndarray) -> np.ndarray:
        """Positions in ``ids`` of all subwords of ``words``, in order."""
        n = self.size[words]
        ends = np.cumsum(n)
        return np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(self.start[words], n)


def train(texts: list[str], toxic: np.ndarray, epochs: int = 6, rate: float = 0.3, least: int = 2, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, softmax weights and bias, fitted jointly (Adagrad, log loss)."""
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1, 1, (BUCKETS, DIM)).astype(np.float32) / DIM
    w, b = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    ge, gw, gb = np.full(BUCKETS, 1e-3, np.float32), np.full(w.shape, 1e-3, np.float32), np.full(2, 1e-3, np.float32)
    bag = Bag(texts)
    windows = [(d, at) for d, t in enumerate(bag.words) if len(t) for at in [*range(0, len(t) - WINDOW, WINDOW // 2), max(0, len(t) - WINDOW)]]
    if not windows:
        return emb, w, b
    doc = np.array([d for d, _ in windows])
    part = [bag.words[d][at : at + WINDOW] for d, at in windows]
    # Subwords of few texts stay at zero: they would fit single texts.
    seen = np.bincount(np.concatenate([np.unique(bag.ids[bag.flat(t)]) for t in bag.words if len(t)]), minlength=BUCKETS)
    rare = seen < least
    emb[rare] = 0
    # One window per clean text and epoch; toxic texts choose theirs after the first epoch.
    for epoch in range(epochs):
        scores = _word_scores(bag, emb, w)
        value = np.array([scores[p].mean() for p in part]) + (b[1] - b[0]) if epoch else rng.random(len(part))
        order = np.lexsort((-value, doc))
        first = order[np.r_[True, np.diff(doc[order]) > 0]]
        pos = first[toxic[doc[first]] == 1]
        neg = first[toxic[doc[first]] == 0]  # the highest clean windows: the hardest
        other = rng.permutation(np.flatnonzero(toxic[doc] == 0))[: 4 * (len(pos) + len(neg))]
        pick = rng.permutation(np.concatenate([pos, neg, other]))
        for at in range(0, len(pick), 64):
            sel = pick[at : at + 64]
            chosen = [part[i] for i in sel]
            words = np.concatenate(chosen)
            n_sub = np.array([bag.size[c].sum() for c in chosen])
            ids = bag.ids[bag.flat(words)]
            offs = np.cumsum(n_sub) - n_sub
            # A word counts once, whatever its length: the mean over words of the mean over subwords.
            weight = (1.0 / np.repeat(bag.size[words], bag.size[words]) / np.repeat([len(c) for c in chosen], n_sub)).astype(np.float32)
            mean = np.add.reduceat(emb[ids] * weight[:, None], offs, axis=0)
            z = mean @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = p.copy()
            g[np.arange(len(sel)), toxic[doc[sel]]] -= 1
            dw, db = mean.T @ g, g.sum(axis=0)
            dm = np.repeat(g @ w.T, n_sub, axis=0) * weight[:, None]
            u, inv = np.unique(ids, return_inverse=True)
            de = np.stack([np.bincount(inv, dm[:, k], len(u)) for k in range(DIM)], axis=1).astype(np.float32)
            ge[u] += (de * de).mean(axis=1)
            emb[u] -= np.where(rare[u], 0, rate / np.sqrt(ge[u]))[:, None] * de
            gw += dw * dw
            gb += db * db
            if epoch == 0 and at == 0:
                w += rng.normal(0, 1 / DIM, w.shape).astype(np.float32)
            w -= rate * dw / np.sqrt(gw)
            b -= rate * db / np.sqrt(gb)
    return emb, w, b


def _word_scores(bag: Bag, emb: np.ndarray, w: np.ndarray) -> np.ndarray:
    if not len(bag.ids):
        return np.zeros(0, np.float32)
    sub = emb @ (w[:, 1] - w[:, 0])
    return np.add.reduceat(sub[bag.ids], bag.start) / bag.size


def fit(docs: DataFrame, labels: DataFrame, rows: int = 1500) -> tuple[np.ndarray, float]:
    """Train on at most ``rows`` toxic and twice as many clean labelled documents outside the held-out fold.

    The sample is the ids of least hash, the same on every run; only it leaves
    the executors.  Returns the score of each subword bucket (its embedding
    times the softmax weights) and the bias.  Without labels of both kinds the
    model is neutral.
    """
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(fold_of(F.col("doc_id")) != 0)
    present = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    both = [present.filter(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows if v else 2 * rows) for v in (0, 1)]
    chosen = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(both[0].union(both[1])), "doc_id")
    sample = chosen.dropDuplicates(["doc_id", "text"]).select("doc_id", "text", F.col("toxic").cast("long").alias("toxic"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(b.column(n).to_pylist() for n in ("doc_id", "text", "toxic")))))
        sub, bias = learn_texts([r[1] for r in rows], np.array([r[2] for r in rows], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([sub.tobytes()], pa.binary()), pa.array([bias])], names=["sub", "bias"])

    # The sample is bounded, so one task trains; only the bucket scores reach the driver.
    model = sample.coalesce(1).mapInArrow(learn, "sub binary, bias double").first()
    return (np.frombuffer(model["sub"], np.float32), model["bias"]) if model else (np.zeros(BUCKETS, np.float32), 0.0)


def learn_texts(texts: list[str], toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """Bucket scores and bias from labelled texts; neutral without both labels."""
    if len(set(toxic.tolist())) < 2:
        return np.zeros(BUCKETS, np.float32), 0.0
    fresh = first_of_copies(texts)
    texts, toxic = [texts[i] for i in fresh], toxic[fresh]
    aside = np.arange(len(texts)) % 5 == 0  # calibrates the bias
    if len(set(toxic[~aside].tolist())) < 2 or len(set(toxic[aside].tolist())) < 2:
        aside[:] = False
    emb, w, b = train([t for t, out in zip(texts, aside) if not out], toxic[~aside])
    sub, bias = (emb @ (w[:, 1] - w[:, 0])).astype(np.float32), float(b[1] - b[0])
    if aside.any():
        p = text_scores([t for t, out in zip(texts, aside) if out], sub, bias, {})
        bias -= cut_of(np.log(p) - np.log1p(-p), toxic[aside])
    return sub, bias


def first_of_copies(texts: list[str], width: int = 4, least: int = 8, shared: int = 2) -> np.ndarray:
    """Indices of texts that are no near copies of earlier ones in the (bounded) sample.

    Compared by the ``least`` smallest shingle hashes; a group of copies would
    otherwise teach the words of one text as signs of its label.
    """
    seen: set[int] = set()
    out = []
    for i, t in enumerate(map(words_of, texts)):
        sketch = sorted({zlib.crc32(" ".join(t[k : k + width]).encode("utf-8", "surrogatepass")) for k in range(max(1, len(t) - width + 1))})[:least]
        if sum(h in seen for h in sketch) < shared:
            out.append(i)
        seen.update(sketch)
    return np.array(out, np.int64)


def cut_of(z: np.ndarray, toxic: np.ndarray, clean_weight: float = 4.0) -> float:
    """The logit that best parts the two labels; a clean text lost costs ``clean_weight`` toxic ones missed.

    Half-way between the two neighbours at the least cost, the lowest such place.
    """
    order = np.argsort(z, kind="stable")
    z, y = z[order], toxic[order]
    missed = np.r_[0, np.cumsum(y)] / max(1, y.sum())
    lost = np.r_[np.cumsum((1 - y)[::-1])[::-1], 0] / max(1, (1 - y).sum())
    at = int(np.argmin(missed + clean_weight * lost))
    return float((z[max(at - 1, 0)] + z[min(at, len(z) - 1)]) / 2)


def text_scores(texts: list[str | None], sub: np.ndarray, bias: float, cache: dict[str, float], limit: int = 500_000) -> np.ndarray:
    """Softmax probability of label 1 of the highest window of each text; ``cache`` keeps scores of words."""
    out = np.full(len(texts), bias)
    at = 0
    while at < len(texts):  # about a million characters at a time
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") < 1 << 20):
            size += len(texts[end] or "")
            end += 1
        lists = [words_of(t) for t in texts[at:end]]
        if len(cache) > limit:
            cache.clear()
        new = list(set().union(*lists).difference(cache))
        for k in range(0, len(new), 100_000):
            some = new[k : k + 100_000]
            ids, of = subwords(some)
            cache.update(zip(some, (np.bincount(of, sub[ids], len(some)) / np.bincount(of, minlength=len(some))).tolist()))
        for i, words in enumerate(lists, at):
            if words:
                v = np.array(list(map(cache.__getitem__, words)))
                n = min(len(v), WINDOW)
                sums = np.cumsum(np.r_[0.0, v])
                out[i] = (sums[n:] - sums[:-n]).max() / n + bias
        at = end
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def score_toxicity(docs: DataFrame, labels: DataFrame, rows: int = 1500) -> DataFrame:
    """(doc_id, score) of every whole text; ``labels`` (doc_id, toxic) mark the training rows.

    Score: 0 to 1, higher means label 1 is likelier.  Null, empty and wordless
    texts get the score of the bias alone.  Each row gives one row, repeated
    rows included; other columns are ignored.
    """
    sub, bias = fit(docs, labels, rows)
    model = docs.sparkSession.sparkContext.broadcast(sub)  # BUCKETS floats, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, cache = model.value, {}
        for batch in batches:
            score = text_scores(batch.column("text").to_pylist(), table, bias, cache)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")



def drop_toxic(docs: DataFrame, labels: DataFrame, rows: int = 1500, limit: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose text scores ``limit`` or more; all columns stay.

    The score is computed beside each row, so null or repeated ids need no join.
    """
    sub, bias = fit(docs, labels, rows)
    model = docs.sparkSession.sparkContext.broadcast(sub)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, cache = model.value, {}
        for batch in batches:
            clean = text_scores(batch.column("text").to_pylist(), table, bias, cache) < limit
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)

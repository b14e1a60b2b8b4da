"""Language identification by Kneser-Ney character models (operator 9).

One interpolated Kneser-Ney model per language predicts each character of a
word from up to three before it (a space stands on either side of a word).  The models
are kept as arrays sorted by the hash of an n-gram, one column per language,
holding interpolated probabilities; contexts have back-off weights in like
arrays, so a lookup is a binary search.  A text gets the language of lowest
cross-entropy per character.  What is far from every model, judged by a
quantile calibrated on held-aside sample texts, is marked as rejected.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import fold_of, held, share

ORDER = 4
WORD = re.compile(r"[^\W\d_]+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _positions(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of ' word ' strings end to end, the word of each, and the place within it."""
    points = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(points)) - np.repeat(np.cumsum(size) - size, size)
    return points, word, place


def _gram(points: np.ndarray, at: np.ndarray, first: int, n: int) -> np.ndarray:
    """Hash of the n characters that start ``first`` before position ``at``."""
    h = np.full(len(at), n, np.uint64)
    for k in range(n):
        h = (h ^ points[at - first + k]) * MIX
        h ^= h >> np.uint64(29)
    return h


class Models:
    """``grams[n]``: sorted hashes and probabilities; ``contexts[n]``: sorted hashes and back-off weights."""

    def __init__(self, langs: list[str], texts: dict[str, list[str]], discount: float = 0.75):
        self.langs = langs
        self.grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.contexts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.cache: dict[str, int] = {}
        self.rows = np.zeros((1, len(langs) + 1))
        self.limit, self.heat = np.full(len(langs), np.inf), 20.0
        per = {}
        for lang in langs:
            points, _, place = _positions([w for t in texts[lang] for w in words_of(t)])
            for n in range(ORDER, 0, -1):
                # The lowest order that predicts a place with n - 1 characters before it; the first space is given.
                at = np.flatnonzero(place >= max(1, n - 1))
                gram, first, count = np.unique(_gram(points, at, n - 1, n), return_index=True, return_counts=True)
                pos = at[first]
                per[lang, n] = [gram, pos, count, points]
            for n in range(1, ORDER):  # continuation counts: distinct characters seen before an n-gram
                gram, pos, count, _ = per[lang, n]
                up = per[lang, n + 1]
                tail, kinds = np.unique(_gram(up[3], up[1], n - 1, n), return_counts=True)
                seen = np.searchsorted(tail, gram)
                ok = (seen < len(tail)) & (tail[np.minimum(seen, len(tail) - 1)] == gram) if len(tail) else np.zeros(len(gram), bool)
                # n-grams at the start of a word have no character before them and keep their counts
                per[lang, n][2] = np.where(ok, kinds[np.minimum(seen, max(0, len(kinds) - 1))] if len(kinds) else count, count)
        chars = sum(len(per[lang, 1][0]) for lang in langs) + 2
        self.floor = 1.0 / chars
        for n in range(1, ORDER + 1):
            union, first = np.unique(np.concatenate([per[lang, n][0] for lang in langs]), return_index=True)
            owner = np.concatenate([np.full(len(per[lang, n][0]), i) for i, lang in enumerate(langs)])[first]
            place = np.concatenate([per[lang, n][1] for lang in langs])[first]
            heads = np.zeros(len(union), np.uint64)
            lower = np.full((len(union), len(langs)), 1.0 / chars)
            for i, lang in enumerate(langs):
                mine = np.flatnonzero(owner == i)
                points = per[lang, n][3]
                heads[mine] = _gram(points, place[mine], n - 1, n - 1)
                if n > 1:
                    lower[mine] = self._prob(points, place[mine], n - 1)
            contexts, inverse = np.unique(heads, return_inverse=True)
            prob, back = np.zeros((len(union), len(langs))), np.ones((len(contexts), len(langs)))
            for i, lang in enumerate(langs):
                gram, _, count, _ = per[lang, n]
                c = np.zeros(len(union))
                c[np.searchsorted(union, gram)] = count
                total = np.bincount(inverse, c, len(contexts))
                kinds = np.bincount(inverse, c > 0, len(contexts))
                safe = np.maximum(total, 1)
                back[:, i] = np.where(total > 0, discount * kinds / safe, 1.0)
                prob[:, i] = np.maximum(c - discount, 0) / safe[inverse] + back[inverse, i] * lower[:, i]
            self.grams[n], self.contexts[n] = (union, prob), (contexts, back)

    @staticmethod
    def _find(table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, key), max(0, len(table) - 1))
        return at, (table[at] == key if len(table) else np.zeros(len(key), bool))

    def _prob(self, points: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Probability of each character from the n - 1 before it, a column per language."""
        if n == 0:
            return np.full((len(at), len(self.langs)), self.floor)
        keys, prob = self.grams[n]
        row, hit = self._find(keys, _gram(points, at, n - 1, n))
        out = prob[row] if len(keys) else np.zeros((len(at), len(self.langs)))
        miss = np.flatnonzero(~hit)
        if len(miss):
            heads, back = self.contexts[n]
            row, known = self._find(heads, _gram(points, at[miss], n - 1, n - 1))
            weight = np.where(known[:, None], back[row], 1.0) if len(heads) else 1.0
            out[miss] = weight * self._prob(points, at[miss], n - 1)
        return out

    def word_rows(self, words: list[str]) -> np.ndarray:
        """Per word: summed log-probability of each language, and the number of characters predicted."""
        points, word, place = _positions(words)
        rows = np.zeros((len(words), len(self.langs) + 1))
        for n in range(2, ORDER + 1):
            at = np.flatnonzero(place >= ORDER - 1) if n == ORDER else np.flatnonzero(place == n - 1)
            logs = np.log(np.maximum(self._prob(points, at, n), 1e-300))
            for i in range(len(self.langs)):
                rows[:, i] += np.bincount(word[at], logs[:, i], len(words))
            rows[:, -1] += np.bincount(word[at], minlength=len(words))
        return rows

    def entropies(self, texts: list[str | None], keep: int = 400_000) -> np.ndarray:
        """Cross-entropy per character (nats) of each text and language; NaN for a text without letters."""
        lists = [words_of(t) for t in texts]
        if len(self.cache) > keep:
            self.cache, self.rows = {}, self.rows[:1]
        new = list(set().union(*lists).difference(self.cache))
        if new:
            self.cache.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            rows = [self.word_rows(new[at : at + 50_000]) for at in range(0, len(new), 50_000)]
            letters = np.array([any(map(str.isalpha, w)) for w in new])
            self.rows = np.concatenate([self.rows, np.concatenate(rows) * letters[:, None]])
        out = np.zeros((len(texts), len(self.langs) + 1))
        for i, words in enumerate(lists):
            for at in range(0, len(words), 1 << 18):
                out[i] += self.rows[list(map(self.cache.__getitem__, words[at : at + (1 << 18)]))].sum(axis=0)
        with np.errstate(invalid="ignore", divide="ignore"):
            return -out[:, :-1] / out[:, -1:]

    def decide(self, entropy: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, confidence and rejection of each row of entropies."""
        none = np.isnan(entropy).any(axis=1)
        e = np.where(none[:, None], 0.0, entropy)
        best = e.argmin(axis=1)
        odds = np.exp(-self.heat * (e - e.min(axis=1, keepdims=True)))
        score = np.where(none, 0.0, 1.0 / odds.sum(axis=1))
        lang = ["und" if x else self.langs[b] for x, b in zip(none, best)]
        return lang, score, none | (e.min(axis=1) > self.limit[best])


def fit(docs: DataFrame, rows: int = 400, quantile: float = 0.995, most: int = 8 << 20) -> Models | None:
    """Models of at most ``rows`` texts per language outside the held-out fold (least hash of the id).

    Of a language's texts in this order those that start within its first
    ``most`` characters serve, each up to ``most`` characters, so a language gives
    less than 2 * ``most``.  One task trains; only the models reach the driver.
    """
    from pyspark.sql import Window

    known = docs.filter("doc_id is not null and lang is not null and text is not null").filter(fold_of(F.col("doc_id")) != 0).select("doc_id", "lang")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.distinct().withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= rows).select("doc_id", F.col("lang").alias("__lang"))
    chosen = chosen.hint("broadcast") if known.select("lang").distinct().count() <= 1000 else chosen
    sample = docs.select("doc_id", F.substring("text", 1, most).alias("text")).filter("text is not null").join(chosen, "doc_id")
    before = Window.partitionBy("__lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text").rowsBetween(Window.unboundedPreceding, -1)
    sample = sample.withColumn("__before", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))).filter(F.col("__before") < most)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sorted(r for b in batches for r in zip(*(b.column(n).to_pylist() for n in ("doc_id", "__lang", "text"))))
        if table:
            models = learn_texts([r[2] for r in table], [r[1] for r in table], quantile)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps({n: getattr(models, n) for n in STATE}, 5)], pa.binary())], names=["model"])

    model = sample.select("doc_id", "__lang", "text").repartition(1).mapInArrow(learn, "model binary").first()
    if model is None:
        return None
    models = Models.__new__(Models)
    models.__dict__.update(pickle.loads(model["model"]))
    models.cache, models.rows = {}, np.zeros((1, len(models.langs) + 1))
    return models


STATE = ("langs", "grams", "contexts", "limit", "heat", "floor")


def learn_texts(sample: list[str], of: list[str], quantile: float) -> Models:
    """Models of texts and their languages.

    A fifth of the sample is held aside: it sets, per language, the cross-entropy
    beyond which a text is rejected, and the confidence scale.
    """
    langs = sorted(set(of))
    aside = np.arange(len(sample)) % 5 == 4
    texts = {lang: [t for t, x, out in zip(sample, of, aside) if x == lang and not out] or [t for t, x in zip(sample, of) if x == lang] for lang in langs}
    models = Models(langs, texts)
    entropy = models.entropies(sample)
    truth = np.array([langs.index(x) for x in of])
    ok = aside & ~np.isnan(entropy).any(axis=1)
    for i in range(len(langs)):
        mine = entropy[ok & (truth == i), i]
        if len(mine) >= 20:
            models.limit[i] = 1.05 * float(np.quantile(mine, quantile))
    if ok.any():
        z = entropy[ok] - entropy[ok].min(axis=1, keepdims=True)
        loss = {h: -np.mean(-h * z[np.arange(ok.sum()), truth[ok]] - np.log(np.exp(-h * z).sum(axis=1))) for h in (1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0)}
        models.heat = min(loss, key=loss.get)
    return models


def identify(docs: DataFrame, rows: int = 400) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every whole text of ``docs`` (doc_id, text, lang).

    ``lang`` serves for training only.  Null texts and texts without a letter
    are ``und`` with score 0; without any labelled row all are.  Ties go to
    the language first in order.  Each row gives one row; other columns are ignored.
    """
    models = share(docs.sparkSession, fit(docs, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held(models)
        for batch in batches:
            texts, lang, score, rejected = batch.column("text").to_pylist(), [], [], []
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or "") < 1 << 21):
                    size += len(texts[end] or "")
                    end += 1
                if model is None:
                    part = ["und"] * (end - at), np.zeros(end - at), np.ones(end - at, bool)
                else:
                    part = model.decide(model.entropies(texts[at:end]))
                lang += part[0]
                score.append(part[1])
                rejected.append(part[2])
                at = end
            flat = [np.concatenate(x) if x else np.zeros(0) for x in (score, rejected)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(flat[0], pa.float64()), pa.array(flat[1].astype(bool), pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")

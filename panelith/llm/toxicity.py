"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

Features of a text: the density of a learned lexicon (whole words, and word stems for compounds),
its reach into the text, second-person words and their proximity to lexicon words, capitals,
punctuation, obfuscation (letters mixed with digits or symbols, stretched letters) and length.

Everything is learned from a bounded sample of labelled rows: at most ``sample`` of each label,
those with the least hash of their id. Each half of the sample (by text hash) yields a lexicon, by
document frequency per label, and is described with the other half's, so that no text puts its own
words in the lexicon that describes it. The trees are grown on both halves, the isotonic step is
fitted on margins of trees grown on the other half. Copies of a text fall in the same half. If a half
has fewer than ``HALF`` texts of a label, the sample is not split: one lexicon and one set of margins.

Null and empty texts have all features zero and get the score of such a text. With texts of one
label only every score is that label, without any it is 0. A labelled doc_id with several texts
trains with the least of them. Rows that repeat come back repeated; texts are read whole. Only doc_id
and text are read, and of the labels doc_id and toxic, so other columns may have any names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fold

STEMS = (4, 5, 6, 7)
#: Texts of each label that a half of the sample needs.
HALF = 5
#: Second-person words of the languages at hand (fixed values).
SECOND = frozenset("you your yours yourself du dich dir dein deine deinen deinem ihr euch euer tu te toi ton ta tes vous votre vos usted ustedes tú ti vuestro vosotros".split())
_WORD = re.compile(r"[^\W_]+(?:[*@$#!0-9][^\W_]+)*", re.UNICODE)
_ODD = re.compile(r"[^\W\d_][*@$#!0-9]+[^\W\d_]")
_LONG = re.compile(r"([^\W\d_])\1\1")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
NAMES = ("hits", "density", "stem_hits", "stem_density", "strength", "reach", "second", "near", "capitals", "exclaims", "marks", "symbols", "odd", "stretched", "log_words")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features(text: str, words: dict[str, float], stems: dict[str, float]) -> list[float]:
    tokens = words_of(text)
    n = len(tokens)
    if not n:
        return [0.0] * len(NAMES)
    size = len(text)
    hit, stem_hit, strength, places = 0, 0, 0.0, []
    kinds = set(tokens)
    known = {w: words[w] for w in kinds if w in words}
    by_stem = {}
    for w in kinds:
        if w not in known and len(w) >= STEMS[0]:
            best = max((stems[w[:k]] for k in STEMS if w[:k] in stems), default=0.0)
            if best:
                by_stem[w] = best
    if known or by_stem:
        for i, w in enumerate(tokens):
            if w in known:
                hit += 1
                strength += known[w]
                places.append(i)
            elif w in by_stem:
                stem_hit += 1
                strength += by_stem[w]
                places.append(i)
    second = [i for i, w in enumerate(tokens) if w in SECOND] if not SECOND.isdisjoint(kinds) else []
    near = 0
    if places and second:
        at = np.searchsorted(second, places)
        s = np.array([-(10**9), *second, 10**9])
        near = int((np.minimum(np.abs(s[at] - places), np.abs(s[at + 1] - places)) <= 5).sum())
    return [
        float(min(hit, 50)),
        hit / n,
        float(min(stem_hit, 50)),
        stem_hit / n,
        strength / n,
        len(known) + len(by_stem) + 0.0,
        len(second) / n,
        near / n,
        len(_UPPER.findall(text)) / size,
        text.count("!") / n,
        (text.count("?") + text.count(".") + text.count(",")) / n,
        sum(map(text.count, "#*$%&@")) / n,
        len(_ODD.findall(text)) / n,
        len(_LONG.findall(text)) / n,
        float(np.log1p(n)),
    ]


class Trees:
    """Boosted regression trees on the logistic loss, over quantile bins."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, least: int = 8):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        q = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T)], 1)
        p = float(np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3))
        self.start, self.trees = np.log(p / (1 - p)), []
        f = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree: list = []
            self._grow(tree, q, weight * (y - p), weight * p * (1 - p), np.arange(len(y)), 0)
            self.trees.append(tree)
            f += self._walk(tree, q)
        return self

    def _grow(self, tree: list, q, g, h, rows, depth) -> int:
        me = len(tree)
        tree.append(None)
        value = self.rate * g[rows].sum() / (h[rows].sum() + 1.0)
        best = (1e-6, -1, -1)
        if depth < self.depth and len(rows) >= 2 * self.least:
            all_g, all_h = g[rows].sum(), h[rows].sum()
            for j in range(q.shape[1]):
                b, size = q[rows, j], len(self.cuts[j]) + 1
                sg = np.cumsum(np.bincount(b, g[rows], size))[:-1]
                sh = np.cumsum(np.bincount(b, h[rows], size))[:-1]
                c = np.cumsum(np.bincount(b, minlength=size))[:-1]
                gain = sg**2 / (sh + 1) + (all_g - sg) ** 2 / (all_h - sh + 1) - all_g**2 / (all_h + 1)
                gain[(c < self.least) | (len(rows) - c < self.least)] = -1
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), j, int(gain.argmax()))
        if best[1] < 0:
            tree[me] = (-1, 0, value, 0, 0)
            return me
        _, j, cut = best
        left = q[rows, j] <= cut
        a = self._grow(tree, q, g, h, rows[left], depth + 1)
        b = self._grow(tree, q, g, h, rows[~left], depth + 1)
        tree[me] = (j, cut, value, a, b)
        return me

    @staticmethod
    def _walk(tree: list, q: np.ndarray) -> np.ndarray:
        feature, cut, value, left, right = (np.array(c) for c in zip(*tree))
        at = np.zeros(len(q), int)
        for _ in range(12):
            inner = feature[at] >= 0
            if not inner.any():
                break
            go = q[np.arange(len(q)), np.maximum(feature[at], 0)] <= cut[at]
            at = np.where(inner, np.where(go, left[at], right[at]), at)
        return value[at]

    def margin(self, x: np.ndarray) -> np.ndarray:
        q = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T)], 1)
        return self.start + sum(self._walk(t, q) for t in self.trees)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing step means of y over x (pool adjacent violators), as points to interpolate."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, low, high
    for a, b, w in zip(x[order].tolist(), y[order].tolist(), weight[order].tolist()):
        blocks.append([b, w, a, a])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            m, w, _, hi = blocks.pop()
            p = blocks[-1]
            p[0], p[1], p[3] = (p[0] * p[1] + m * w) / (p[1] + w), p[1] + w, hi
    xs = np.array([v for b in blocks for v in (b[2], b[3])])
    return xs, np.repeat([b[0] for b in blocks], 2)


class Model:
    """Lexicons, trees and calibration; without trees ``curve`` is the score of every text."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], trees: Trees | None, curve):
        self.words, self.stems, self.trees, self.curve = words, stems, trees, curve

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.curve)
        margin = self.trees.margin(np.array([features(t or "", self.words, self.stems) for t in texts]))
        # The steps flatten ties; a little of the margin's own curve keeps the order within a step.
        return np.clip(0.98 * np.interp(margin, *self.curve) + 0.02 / (1 + np.exp(-margin)), 0, 1)


def _terms(batches):
    """(half, term, label) of each distinct word and stem of each sample text; stems end in *."""
    for batch in batches:
        out: dict = {}
        for half, toxic, text in zip(*(c.to_pylist() for c in batch.columns)):
            kinds = set(words_of(text or ""))
            for t in kinds | {w[:k] + "*" for w in kinds for k in STEMS if len(w) > k}:
                row = out.setdefault((half, t), [0, 0])
                row[toxic] += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.int32()), pa.array([k[1] for k in out]), pa.array([v[0] for v in out.values()]), pa.array([v[1] for v in out.values()])], ["half", "term", "clean", "toxic"])


def _lexicon(rows, totals) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems with their log odds, from document counts per label."""
    words, stems = {}, {}
    for r in rows:
        odds = np.log((r.toxic + 0.25) / (totals[1] + 0.5)) - np.log((r.clean + 0.25) / (totals[0] + 0.5))
        (stems if r.term.endswith("*") else words)[r.term.rstrip("*")] = float(odds)
    return words, stems


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 3000, lexicon: int = 2000, evidence: float = 6.0, odds: float = 3.0) -> Model:
    """A model from labelled rows outside fold 0 of 5: at most ``sample`` toxic and twice as many others.

    Rows are weighted to the label's share among all of them. A term enters the lexicon if its log
    odds of standing in a toxic text reach ``odds`` and its log-likelihood ratio ``evidence``.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "toxicity")
    marks = labels.where((fold("doc_id", 5) != 0) & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = {int(r.toxic): r["count"] for r in marks.groupBy("toxic").count().collect()}
    picked = [(int(r.doc_id), int(r.toxic)) for t in (0, 1) for r in marks.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit((2 - t) * sample).collect()]
    ids = spark.createDataFrame(picked, "doc_id long, toxic int")  # at most 3 * sample rows
    half = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(2)).cast("int")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(ids), "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select(half.alias("half"), "toxic", "text")
    texts = scratch.save(texts, "sample")
    totals = {h: [0, 0] for h in (0, 1)}
    for r in texts.groupBy("half", "toxic").count().collect():
        totals[r.half][r.toxic] = r["count"]
    clean, toxic = (totals[0][t] + totals[1][t] for t in (0, 1))
    if not clean or not toxic:
        return Model({}, {}, None, 1.0 if toxic else 0.0)
    if min(min(v) for v in totals.values()) < HALF:
        # Too few for halves: each text is described with a lexicon of all, and margins are not crossed.
        texts = texts.withColumn("half", F.lit(0))
        totals = {0: [clean, toxic], 1: [0, 0]}
    counts = texts.mapInArrow(_terms, "half int, term string, clean long, toxic long").groupBy("half", "term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = scratch.save(counts.where(F.col("toxic") > 1), "terms")
    lexicons = []
    crossed = totals[1] != [0, 0]
    for h in (0, 1) if crossed else (0, 0):
        p = totals[h][1] / sum(totals[h])
        both = F.col("toxic") + F.col("clean")
        gain = F.col("toxic") * F.ln(F.col("toxic") / both / p) + F.when(F.col("clean") > 0, F.col("clean") * F.ln(F.col("clean") / both / (1 - p))).otherwise(0.0)
        lift = F.ln((F.col("toxic") + 0.25) / (totals[h][1] + 0.5)) - F.ln((F.col("clean") + 0.25) / (totals[h][0] + 0.5))
        rows = counts.where((F.col("half") == h) & (lift >= odds) & (gain >= evidence)).orderBy(gain.desc(), "term").limit(lexicon).collect()
        lexicons.append(_lexicon(rows, totals[h]))

    def dense(batches):
        for batch in batches:
            rows = [(t, *features(text or "", *lexicons[1 - h])) for h, t, text in zip(*(c.to_pylist() for c in batch.columns))]
            if rows:
                halves = batch.column(0)
                yield pa.RecordBatch.from_arrays([halves, pa.array([r[0] for r in rows], pa.int32()), pa.array([list(r[1:]) for r in rows], pa.list_(pa.float64()))], ["half", "toxic", "x"])

    rows = texts.mapInArrow(dense, "half int, toxic int, x array<double>").collect()  # at most 3 * sample rows of fixed width
    rows.sort(key=lambda r: (r.half, r.toxic, r.x))
    h, y = np.array([r.half for r in rows]), np.array([float(r.toxic) for r in rows])
    x = np.array([r.x for r in rows])
    prior = np.where(y == 1, 1.0, (share[0] / share[1]) * max((y == 1).sum(), 1) / max((y == 0).sum(), 1))
    trees = Trees().fit(x, y, prior)
    margins = np.zeros(len(y))
    for k in (0, 1) if crossed else ():
        margins[h == k] = Trees().fit(x[h != k], y[h != k], prior[h != k]).margin(x[h == k])
    if not crossed:
        margins = trees.margin(x)
    words = {w: max(a.get(w, 0), b.get(w, 0)) for a, b in [(lexicons[0][0], lexicons[1][0])] for w in {*a, *b}}
    stems = {w: max(a.get(w, 0), b.get(w, 0)) for a, b in [(lexicons[0][1], lexicons[1][1])] for w in {*a, *b}}
    return Model(words, stems, trees, isotonic(margins, y, prior))


def score_toxicity(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = fit_toxicity(docs, labels, **how)

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            if texts:
                score = np.concatenate([model.score(texts[i : i + 256]) for i in range(0, len(texts), 256)])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    plain = docs.select(F.col("doc_id").cast("long"), (fold("doc_id", 5) == 0).alias("held_out"), F.col("text").cast("string"))
    return plain.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")

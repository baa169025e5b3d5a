"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

Impacts are BM25 term weights divided by the item's full score, so a passage scores the weighted
share of an item's terms that it holds, and one threshold serves all items. Postings carry block
maxima: a passage is first bounded, block of items by block, by the maxima of its terms; only where
the bound reaches the threshold does the WAND loop walk the postings of that block, skipping items
that the terms' maxima cannot lift over the threshold. All items above the threshold are retrieved,
none by rank. A hit counts when both the question part and the answer part of the item overlap the
passage by word trigrams.

Items fall in length classes of up to ``SHORTEST`` words, 4 times as many, and so on. Passages are
windows of twice the class's length, half overlapping, so every item's text lies whole in some window
and a long item widens no window but its own class's. Words are runs of letters, digits and non-ASCII
characters, A-Z lower-cased.

The items are indexed in shards of bounded size (``shard_items`` and ``shard_bytes``), one pass over
the documents for each; a small benchmark is one shard. Document frequencies, the number of items
and their mean length are those of all items, so shards and classes only split the postings. Null or
blank texts and items match nothing. Repeated rows give repeated rows; items with equal text are all
reported. Only doc_id and text are read, of the benchmark item_id and text, so other columns may have
any names; ``decontaminate`` passes them on.
"""

from __future__ import annotations

import heapq
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, Scratch, arrow_batches, splitmix, text_chunks, word_hashes

BLOCKS = 64
#: Words of the items of the shortest length class at most.
SHORTEST = 64
U = np.uint64


def split_item(text: str) -> tuple[str, str]:
    """(question, answer): the answer is the last sentence, or the last third if there is but one."""
    parts = [p for p in re.split(r"(?<=[.?!])\s+|\n+", text.strip()) if p.strip()]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    cut = len(words) - max(1, len(words) // 3) if len(words) > 1 else len(words)
    return " ".join(words[:cut]), " ".join(words[cut:])


def hashed(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return word_hashes(data, np.array([0, len(data)]), SEPARATORS)[0]


def trigrams(words: np.ndarray) -> np.ndarray:
    """Hashes of the word trigrams; of the single words where there are fewer than three."""
    if len(words) < 3:
        return words
    return splitmix(words[:-2] * U(3) + splitmix(words[1:-1]) * U(5) + splitmix(splitmix(words[2:])) * U(7))


class Index:
    """An inverted index of items with impacts as shares of the item's own score, and block maxima.

    ``whole``, if the items are a part: (number of all items, their mean length, the most words of an item
    here, {term: number of all items with it}).
    """

    def __init__(self, items: list[tuple[int, str]], k1: float = 1.2, b: float = 0.75, whole: tuple[int, float, int, dict[int, int]] | None = None):
        rows = [(i, t, hashed(t)) for i, t in items]
        rows = [r for r in rows if len(r[2])]
        self.ids = [r[0] for r in rows]
        self.longest = max((len(r[2]) for r in rows), default=1)
        self.parts = [tuple(trigrams(hashed(p)) for p in split_item(t)) for _, t, _ in rows]
        n = len(rows)
        lengths = np.array([len(r[2]) for r in rows], float)
        self.terms = np.unique(np.concatenate([r[2] for r in rows])) if rows else np.zeros(0, U)
        df = np.zeros(len(self.terms))
        counted = []
        for _, _, words in rows:
            ids, tf = np.unique(np.searchsorted(self.terms, words), return_counts=True)
            counted.append((ids, tf))
            df[ids] += 1
        mean = lengths.mean() if rows else 1.0
        every = n
        if whole is not None:
            every, mean, self.longest, held = whole
            df = np.array([held[t] for t in self.terms.tolist()], float)
        idf = np.log(1 + (every - df + 0.5) / (df + 0.5))
        self.postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        self.size = max(1, -(-n // BLOCKS))
        self.bound = np.zeros((len(self.terms), BLOCKS), np.float32)
        for d, (ids, tf) in enumerate(counted):
            w = idf[ids] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[d] / mean))
            w = w / w.sum()
            for t, x in zip(ids.tolist(), w.tolist()):
                self.postings[t].append((d, x))
            self.bound[ids, d // self.size] = np.maximum(self.bound[ids, d // self.size], w)
        self.bound *= np.float32(1.0001)  # the maxima stay bounds in single precision
        self.by_block = [{blk: [p for p in post if p[0] // self.size == blk] for blk in {p[0] // self.size for p in post}} for post in self.postings]

    def lookup(self, words: np.ndarray) -> np.ndarray:
        """Term numbers of word hashes, -1 where no item has the word."""
        if not len(self.terms):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        return np.where(self.terms[at] == words, at, -1)

    def retrieve(self, terms: list[int], block: int, threshold: float) -> list[tuple[int, float]]:
        """All items of a block whose score from the distinct ``terms`` reaches ``threshold``: WAND with block maxima."""
        cursors = [[self.by_block[t][block], 0, float(self.bound[t, block])] for t in terms if block in self.by_block[t]]
        heap = [(c[0][0][0], i) for i, c in enumerate(cursors)]
        heapq.heapify(heap)
        out = []
        while heap:
            taken, bound = [], 0.0
            while heap and bound < threshold:  # the pivot: the first item that the maxima can lift over the threshold
                taken.append(heapq.heappop(heap))
                bound += cursors[taken[-1][1]][2]
            pivot = taken[-1][0]
            while heap and heap[0][0] == pivot:
                taken.append(heapq.heappop(heap))
                bound += cursors[taken[-1][1]][2]
            if bound < threshold:
                break
            score = 0.0
            for item, i in taken:
                c = cursors[i]
                while c[1] < len(c[0]) and c[0][c[1]][0] < pivot:
                    c[1] += 1
                if c[1] < len(c[0]) and c[0][c[1]][0] == pivot:
                    score += c[0][c[1]][1]
                    c[1] += 1
                if c[1] < len(c[0]):
                    heapq.heappush(heap, (c[0][c[1]][0], i))
            if score >= threshold:
                out.append((pivot, score))
        return out

    def search(self, words: np.ndarray, at: np.ndarray, threshold: float, overlap: float) -> dict[tuple[int, int], tuple[float, float, float]]:
        """{(text, item): (score, question overlap, answer overlap)} of adjacent texts of hashed words."""
        hits: dict[tuple[int, int], tuple[float, float, float]] = {}
        if not len(words) or not self.ids:
            return hits
        stride = max(16, self.longest)
        n = np.diff(at)
        pieces = np.maximum(1, -(-n // stride))
        first_piece = np.cumsum(pieces) - pieces
        owner = np.repeat(np.arange(len(n)), n)
        piece = first_piece[owner] + (np.arange(len(words)) - at[:-1][owner]) // stride
        term = self.lookup(words)
        known = term >= 0
        total = int(pieces.sum())
        text_of = np.repeat(np.arange(len(n)), pieces)
        # A window is a piece and the next of the same text; each term counts once in it.
        width = np.int64(len(self.terms))
        known = term >= 0
        keys = np.unique(piece[known] * width + term[known])
        again = keys[keys // width > first_piece[text_of[keys // width]]] - width
        keys = np.unique(np.concatenate([keys, again]))
        term_of = keys % width
        cut = np.searchsorted(keys // width, np.arange(total + 1))
        bound = np.zeros((total, BLOCKS), np.float32)
        full = np.flatnonzero(np.diff(cut))
        if len(full):
            bound[full] = np.add.reduceat(self.bound[term_of], cut[:-1][full], axis=0)
        for p, block in zip(*np.nonzero(bound >= threshold)):
            text = text_of[p]
            terms = term_of[cut[p] : cut[p + 1]].tolist()
            found = self.retrieve(terms, int(block), threshold)
            if not found:
                continue
            lo = at[text] + (p - first_piece[text]) * stride
            window = words[lo : min(lo + 2 * stride, at[text + 1])]
            grams = np.concatenate([trigrams(window), window])
            for item, score in found:
                q, a = (float(np.isin(part, grams).mean()) if len(part) else 1.0 for part in self.parts[item])
                if q >= overlap and a >= overlap:
                    key = (int(text), item)
                    hits[key] = max(hits.get(key, (0.0, 0.0, 0.0)), (score, q, a))
        return hits


def item_shards(benchmark: DataFrame, shard_items: int = 4096, shard_bytes: int = 8 << 20) -> list[DataFrame]:
    """The items in shards of about these sizes at most, each small enough to be an index in a task."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    arrow_batches(benchmark.sparkSession)
    count, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(1, -(-2 * count // shard_items) if count > shard_items else 1, -(-2 * size // shard_bytes) if size > shard_bytes else 1)
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def _item_terms(batches):
    """(length, terms) of the items with words, the terms distinct."""
    for batch in batches:
        words = [w for w in (hashed(t) for t in batch.column(0).to_pylist()) if len(w)]
        terms = [np.unique(w).view(np.int64) for w in words]
        yield pa.RecordBatch.from_arrays([pa.array([len(w) for w in words], pa.int64()), pa.array(terms, pa.list_(pa.int64()))], ["length", "terms"])


def by_length(items: list[tuple[int, str]], whole: tuple[int, float, dict[int, int]] | None = None) -> list[Index]:
    """An index for each length class of ``items``; ``whole`` are the number of all items, their mean length and terms."""
    sized = [(i, t, hashed(t)) for i, t in items]
    sized = [r for r in sized if len(r[2])]
    if whole is None:
        terms, held = np.unique(np.concatenate([np.unique(w) for _, _, w in sized]), return_counts=True) if sized else ([], [])
        whole = len(sized), float(np.mean([len(w) for _, _, w in sized])) if sized else 1.0, dict(zip(map(int, terms), map(int, held)))
    n, mean, held = whole
    classes: dict[int, list[tuple[int, str]]] = {}
    for i, t, words in sized:
        limit = SHORTEST
        while limit < len(words):
            limit *= 4
        classes.setdefault(limit, []).append((i, t))
    return [Index(rows, whole=(n, mean, limit, held)) for limit, rows in sorted(classes.items())]


def search_all(indexes: list[Index], data: np.ndarray, bounds: np.ndarray, threshold: float, overlap: float) -> list[tuple[int, int, float, float, float]]:
    """(text, item id, score, question overlap, answer overlap) of adjacent texts, from all length classes."""
    words, at = word_hashes(data, bounds, SEPARATORS)
    return [(text, index.ids[item], *figures) for index in indexes for (text, item), figures in index.search(words, at, threshold, overlap).items()]


def _indexes(benchmark: DataFrame, **shards) -> list[list[Index]]:
    """The indexes of each shard, all with the figures of the whole benchmark."""
    parts = item_shards(benchmark, **shards)
    rows = [lambda s=s: sorted((int(r.item_id), r.text) for r in s.collect()) for s in parts]
    if len(parts) == 1:
        return [by_length(rows[0]())]
    terms = lambda items: items.select("text").mapInArrow(_item_terms, "length long, terms array<long>")
    every = Scratch(benchmark.sparkSession, "decontam").save(terms(reduce(DataFrame.unionByName, parts)), "terms")
    n, mean = every.agg(F.count("*"), F.avg("length")).first()
    df = every.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    out = []
    for part, items in zip(parts, rows):
        mine = terms(part).select(F.explode("terms").alias("term")).distinct()
        held = {int(r.term) & 0xFFFFFFFFFFFFFFFF: int(r.n) for r in df.join(mine, "term").collect()}  # the terms of one shard
        out.append(by_length(items(), (n, mean, held)))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.6, **shards) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) for every document that holds an item."""
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    names = schema.replace(",", "").split()[::2]
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def search(indexes: list[Index]):
        def run(batches):
            for batch in batches:
                for first, data, bounds in text_chunks(batch.column(1)):
                    hits = search_all(indexes, data, bounds, threshold, overlap)
                    if hits:
                        ids = batch.column(0).take(pa.array([first + h[0] for h in hits]))
                        yield pa.RecordBatch.from_arrays([ids, *(pa.array(c) for c in list(zip(*hits))[1:])], names)

        return run

    return reduce(DataFrame.unionByName, [plain.mapInArrow(search(i), schema) for i in _indexes(benchmark, **shards)])


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.6, **shards) -> DataFrame:
    """The documents that hold no item, unchanged."""
    where = docs.columns.index("text")

    def keep(indexes: list[Index]):
        def run(batches):
            for batch in batches:
                bad = set()
                for first, data, bounds in text_chunks(batch.column(where).cast(pa.string())):
                    bad |= {first + hit[0] for hit in search_all(indexes, data, bounds, threshold, overlap)}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_())) if bad else batch

        return run

    return reduce(lambda df, i: df.mapInArrow(keep(i), docs.schema), _indexes(benchmark, **shards), docs)

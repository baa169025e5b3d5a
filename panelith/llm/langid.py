"""Language identification by word-first backoff.

A word that the training texts know is scored by its log frequency in each language. An unseen word
is scored by its character n-grams, each character by the longest n-gram ending there that any
language knows, from ``longest`` letters down to one. Word edges count as a character. The language
with the highest sum wins; ties go to the first by name.

The frequencies come from a bounded sample of labelled rows: of each language at most ``sample``
documents outside fold 0 of 5, those with the least hash of their id, as far as their texts sum up to
``sample_bytes`` (one text at least). All words of the sample are kept, and all n-grams, each counted
once in every different word. Languages are
the labels found there; a label that is null trains nothing. A doc_id with several texts of a
language trains with the least of them.

Null texts, and texts without a letter, are ``und`` with score 0. With nothing learned every text is
``und``. Repeated rows come back repeated; texts are read whole. Only doc_id, text and lang are read,
so other columns may have any names.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fold

_WORDS = re.compile(r"[^\W\d_]+", re.UNICODE)
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


class Backoff:
    """Per-language log frequencies of words and n-grams, and the scores of whole texts.

    ``words`` and ``grams`` give the row of each term in ``table``, which has a column for each language.
    """

    def __init__(self, langs: list[str], words: dict[str, int], grams: dict[str, int], table: np.ndarray, longest: int):
        self.langs, self.longest, self.table = langs, longest, table
        self.words, self.grams = words, grams
        self.cache: dict[str, list[int]] = {}

    def unseen(self, word: str) -> list[int]:
        """The rows of a word that training has not: for each character, of the longest known n-gram that ends there."""
        edged, out, grams, longest = f" {word} ", [], self.grams, self.longest
        for end in range(2, len(edged) + 1):
            for start in range(max(0, end - longest), end):
                row = grams.get(edged[start:end])
                if row is not None:
                    out.append(row)
                    break
        if len(self.cache) > 200_000:
            self.cache.clear()
        self.cache[word] = out
        return out

    def totals(self, words: list[str]) -> np.ndarray:
        """The summed log frequencies of a text's words in each language."""
        known, cache, rows = self.words, self.cache, []
        for w in words:
            row = known.get(w)
            if row is not None:
                rows.append(row)
            else:
                rows += cache.get(w) or self.unseen(w)
        return self.table[rows].sum(0) if rows else np.zeros(len(self.langs))

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text or "")
        if not words or not self.langs:
            return UNKNOWN, 0.0
        total = sum(self.totals(words[i : i + 100_000]) for i in range(0, len(words), 100_000))
        best = int(total.argmax())
        p = 1.0 / float(np.exp(np.clip(total - total[best], -700, 0)).sum())
        return self.langs[best], p


def _word_counts(batches):
    """(lang, term, n) of the words of a batch."""
    for batch in batches:
        out: dict[str, Counter] = {}
        for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
            out.setdefault(lang, Counter()).update(words_of(text))
        for lang, words in out.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], ["lang", "term", "n"])


def _gram_counts(longest: int):
    """(lang, kind, term, n) of the n-grams of different words, kind being n."""

    def run(batches):
        for batch in batches:
            grams: Counter = Counter()
            for lang, word in zip(*(c.to_pylist() for c in batch.columns)):
                edged = f" {word} "
                for n in range(1, longest + 1):
                    for i in range(max(0, 2 - n), len(edged) - n + 1):
                        grams[lang, edged[i : i + n]] += 1
            langs, terms = zip(*grams) if grams else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([len(t) for t in terms], pa.int32()), pa.array(terms, pa.string()), pa.array(grams.values(), pa.int64())], ["lang", "kind", "term", "n"])

    return run


def labelled_sample(docs: DataFrame, sample: int, sample_bytes: int, scratch: Scratch) -> DataFrame:
    """(lang, text) of the bounded sample. The ids of a language are cut by a threshold of their hash first, so few are sorted.

    The thresholds, a row for each language, are written first: Spark then knows their size and joins them
    without moving a text, or, should there be megabytes of different labels, by a shuffle.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    plain = plain.where((fold("doc", 5) != 0) & F.col("lang").isNotNull() & F.col("doc").isNotNull() & F.col("text").isNotNull())
    rank = F.xxhash64("doc")
    # About 4 * sample ids of a language pass, or all, if there are fewer.
    kinds = plain.groupBy("lang").agg(F.approx_count_distinct("doc").alias("kinds")).select(F.col("lang").alias("name"), F.least(F.lit(1.0), (4.0 * sample + 64) / F.col("kinds")).alias("rate"))
    kinds = scratch.save(kinds, "kinds")
    some = plain.join(kinds, F.col("lang") == F.col("name")).where((rank.bitwiseAND((1 << 52) - 1) / float(1 << 52)) < F.col("rate"))
    some = some.groupBy("lang", "doc").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy(rank.bitwiseAND((1 << 52) - 1), "doc")
    size = F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    some = some.withColumn("row", F.row_number().over(order)).withColumn("size", size)
    return some.where((F.col("row") <= sample) & ((F.col("row") == 1) | (F.col("size") <= sample_bytes))).select("lang", "text")


def fit_language(docs: DataFrame, sample: int = 1500, sample_bytes: int = 16 << 20, longest: int = 4) -> Backoff:
    scratch = Scratch(docs.sparkSession, "langid")
    texts = scratch.save(labelled_sample(docs, sample, sample_bytes, scratch), "sample")
    words = texts.mapInArrow(_word_counts, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))
    words = scratch.save(words.select("lang", F.lit(0).alias("kind"), "term", "n"), "words")
    grams = words.select("lang", "term").mapInArrow(_gram_counts(longest), "lang string, kind int, term string, n long").groupBy("lang", "kind", "term").agg(F.sum("n").alias("n"))
    counts = scratch.save(words.unionByName(grams), "counts")
    rows = counts.toArrow()  # the words and n-grams of the bounded sample
    langs = sorted(pc.unique(rows["lang"]).to_pylist())
    lang_of = pc.index_in(rows["lang"], pa.array(langs, pa.string())).to_numpy()
    kind, n = rows["kind"].to_numpy(), rows["n"].to_numpy().astype(float)
    coded = rows["term"].combine_chunks().dictionary_encode()
    terms, term = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    # Words and n-grams are different terms; one row of the table for each.
    key, place = np.unique(term * 2 + (kind > 0), return_inverse=True)
    order_of = np.zeros(len(key), int)
    order_of[place] = kind
    table = np.zeros((len(key), len(langs)))
    table[place, lang_of] = n
    for k in range(longest + 1):
        mine = order_of == k
        seen = table[mine]
        table[mine] = np.log((seen + 0.1) / (seen.sum(0) + 0.1 * ((seen > 0).sum(0) + 1)))
    words = {terms[t >> 1]: i for i, t in enumerate(key.tolist()) if not t & 1}
    grams = {terms[t >> 1]: i for i, t in enumerate(key.tolist()) if t & 1}
    return Backoff(langs, words, grams, table, longest)


def identify_language(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    model = fit_language(docs, **how)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # the terms of a bounded sample

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                pred, score = zip(*map(shared.value.predict, batch.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    plain = docs.select(F.col("doc_id").cast("long"), (fold("doc_id", 5) == 0).alias("held_out"), F.col("text").cast("string"))
    return plain.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")

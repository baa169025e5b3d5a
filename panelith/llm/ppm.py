"""LM scoring: prediction by partial matching over bytes, and a smoothed unigram base.

The model is a trie of byte contexts, up to ``order`` bytes, with the counts of what follows in all
training texts. The probability of a symbol in a context is count * (1 - escape) / total, the escape
being d / (n + d) for n occurrences and d different followers (method C); on escape the context loses
its oldest byte and the symbols already seen are excluded. Below the empty context stand all 256
bytes and the end of the text, alike. Each text ends with an end symbol, so texts of all lengths
share one distribution; the bytes before a text count as newlines.

All contexts are kept, as tables of Spark with one row for each context and each gram (context and
symbol); nothing about them reaches the driver or is broadcast. The texts fall in batches of about
``batch_bytes``. Each batch meets the tables in a join of its distinct grams, and is then scored with
the code lengths of just these, so a task holds no more than its batch needs, whatever the corpus.
A gram never seen loses bytes of its context in joins with the shorter contexts. Only with ``share``
given, contexts with less than 1 / ``share`` of all positions are left out.

Base: add-one unigram log probabilities over the training tokens, whose counts are made in Spark for
all training rows. Tokens frequent enough to be few (at most ``share`` of them) are broadcast, all
others meet their counts in a join.

Learning takes the rows outside fold 2 of 7 of crc32(doc_id). Null and empty texts are one end token
and one end symbol. With no training rows N and V are 0 and every byte costs log10(257). Repeated
rows come back repeated (rows that repeat a doc_id with another text too).
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fold, text_chunks

END = 256


def gram_keys(data: np.ndarray, bounds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(contexts, symbols) of all positions of adjacent texts, the end of each included.

    A context is the ``order`` bytes before, the latest in the low byte; newlines stand before a text.
    """
    flat, (where, start) = padded(data, bounds, order)
    ends = start + np.diff(bounds)
    places = np.concatenate([where, ends])
    wide = flat.astype(np.int64)
    context = np.zeros(len(flat), np.int64)
    for j in range(order):
        context[j + 1 :] |= wide[: -1 - j] << (8 * j)
    return context[places], np.concatenate([data.astype(np.int64), np.full(len(bounds) - 1, END)])


def padded(data: np.ndarray, bounds: np.ndarray, order: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The texts with ``order`` newlines before each and one place after, the places of their bytes, and of their starts."""
    size = np.diff(bounds)
    start = np.cumsum(size + order + 1) - size - 1
    where = np.arange(len(data)) + np.repeat(start - bounds[:-1], size)
    flat = np.full(len(data) + len(size) * (order + 1), 10, np.uint8)
    flat[where] = data
    return flat, (where, start)


def _batched(order: int, batch_bytes: int, most: int = 600_000):
    """The rows (row, doc_id, held_out, text), packed in blocks with a number of their batch, and after each batch its grams.

    A gram is context * 512 + symbol; its n counts the rows that are not held out, and is 0 if only others have it.
    """

    def rows(number, size, block, gram, n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(size, number)), block, gram, n], ["batch", "block", "gram", "n"])

    def grams(number, held):
        keys, n = _merged(held)
        return rows(number, len(keys), pa.nulls(len(keys), pa.binary()), pa.array(keys), pa.array(n))

    def run(batches):
        number = np.int64(TaskContext.get().partitionId()) << 32
        held, size, waiting = [], 0, 0
        for batch in batches:
            yield rows(number, 1, pa.array([packed(batch)], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()))
            for first, data, bounds in text_chunks(batch.column(3)):
                context, symbol = gram_keys(data, bounds, order)
                learned = ~batch.column(2).slice(first, len(bounds) - 1).to_numpy(zero_copy_only=False).astype(bool)
                keys, n = np.unique((context * 512 + symbol) * 2 + np.concatenate([np.repeat(learned, np.diff(bounds)), learned]), return_counts=True)
                held.append((keys >> 1, n * (keys & 1)))
                size += len(data)
                waiting += len(keys)
                if waiting > most:
                    held = [_merged(held)]
                    waiting = 0
            if size >= batch_bytes:
                yield grams(number, held)
                number += 1
                held, size, waiting = [], 0, 0
        if held:
            yield grams(number, held)

    return run


def packed(batch: pa.RecordBatch) -> bytes:
    """The batch as a compressed Arrow stream, which moves and is stored at a fraction of the texts' size."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _merged(held) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate(c) for c in zip(*held))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


class Trie:
    """What follows every kept context, as tables.

    ``grams[k]`` has (gram, n) of the contexts of k bytes, ``contexts[k]`` (context, sure, drop): log10 of
    what a gram's n is multiplied with, and of what the shorter context's probability is on escape.
    """

    def __init__(self, order: int, grams: list[DataFrame], contexts: list[DataFrame]):
        self.order, self.grams, self.contexts = order, grams, contexts

    @property
    def levels(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(context, symbol, n) of the kept contexts of k bytes, collected: for small corpora."""
        out = []
        for grams, contexts in zip(self.grams, self.contexts):
            rows = grams.withColumn("context", F.shiftright("gram", 9)).join(contexts, "context", "left_semi").toPandas()
            out.append((rows.context.to_numpy(np.int64), rows.gram.to_numpy(np.int64) & 511, rows.n.to_numpy(np.float64)))
        return out

    def costs(self, counts: DataFrame, scratch: Scratch) -> DataFrame:
        """(gram, cost): log10 of the probability of each of the distinct grams of ``counts`` (gram, n)."""
        last = counts.withColumn("context", F.shiftright("gram", 9)).join(self.contexts[self.order], "context", "left")
        last = scratch.save(last.select("gram", F.when(F.col("n") > 0, F.log10("n") + F.col("sure")).alias("cost"), F.coalesce("drop", F.lit(0.0)).alias("drop")), "last")
        rest, cost = last.where("cost is null").select("gram", "drop"), F.lit(-math.log10(257))
        for k in range(self.order):
            small = F.broadcast if k < 2 else lambda df: df  # the contexts of one byte and what follows are 257 * 256 rows at most
            seen = self.grams[k].select(F.col("gram").alias(f"g{k}"), F.col("n").alias(f"n{k}"))
            known = self.contexts[k].select(F.col("context").alias(f"c{k}"), F.col("sure").alias(f"sure{k}"), F.col("drop").alias(f"drop{k}"))
            cut = shortened("gram", k)
            rest = rest.join(small(seen), cut == F.col(f"g{k}"), "left").join(small(known), F.shiftright(cut, 9) == F.col(f"c{k}"), "left")
            here = F.log10(f"n{k}") + F.col(f"sure{k}")
            cost = F.when(here.isNotNull(), here).otherwise(F.coalesce(f"drop{k}", F.lit(0.0)) + cost)
        found = last.where("cost is not null").select("gram", "cost")
        return scratch.save(found.unionByName(rest.select("gram", (F.col("drop") + cost).alias("cost"))).withColumn("cost", F.col("cost").cast("float")), "costs")


def shortened(gram: str, k: int):
    """The gram with the latest ``k`` bytes of its context."""
    return F.col(gram).bitwiseAND((1 << (8 * k + 9)) - 1)


def _model(counts: DataFrame, scratch: Scratch, order: int, share: int | None) -> Trie:
    """The trie of ``counts`` (gram, n), the grams of ``order`` bytes of context."""
    grams = [counts.where("n > 0").select("gram", "n")]
    for k in reversed(range(order)):
        grams.insert(0, scratch.save(grams[0].groupBy(shortened("gram", k).alias("gram")).agg(F.sum("n").alias("n")), f"grams-{k}"))
    positions = grams[0].agg(F.sum("n")).first()[0] or 0
    contexts: list[DataFrame] = []
    for k in range(order + 1):
        rows = grams[k].withColumn("context", F.shiftright("gram", 9))
        if k:
            # The symbols seen here are excluded below, which leaves the mass of the others there.
            below = grams[k - 1].select(F.col("gram").alias("lower"), F.col("n").alias("below"))
            rows = rows.join(below, shortened("gram", k - 1) == F.col("lower"))
        else:
            rows = rows.withColumn("below", F.lit(1))
        rows = rows.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("below").alias("below"))
        if share is not None:
            rows = rows.where(F.col("total") * share >= positions)
        if k:
            parents = contexts[k - 1].select(F.col("context").alias("parent"), F.col("total").alias("whole"), F.col("escape").alias("lower_escape"))
            rows = rows.join(parents, F.col("context").bitwiseAND((1 << (8 * (k - 1))) - 1) == F.col("parent"))
        else:
            rows = rows.withColumn("whole", F.lit(257)).withColumn("lower_escape", F.lit(0.0))
        rows = rows.withColumn("mass", (F.col("whole") - F.col("below") + F.col("lower_escape") * F.col("below")) / F.col("whole"))
        rows = rows.withColumn("escape", F.when(F.col("mass") <= 1e-12, 0.0).otherwise(F.col("kinds") / (F.col("total") + F.col("kinds"))))
        sure, drop = F.log10((1 - F.col("escape")) / F.col("total")), F.when(F.col("escape") > 0, F.log10(F.col("escape") / F.col("mass"))).otherwise(0.0)
        contexts.append(scratch.save(rows.select("context", "total", "escape", sure.alias("sure"), drop.alias("drop")), f"contexts-{k}"))
    return Trie(order, grams, contexts)


def _split(rows: DataFrame, scratch: Scratch, order: int, batch_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the rows' blocks with their batch, the distinct grams of each batch, the counts of all grams)."""
    schema = "batch long, block binary, gram long, n long"
    work = scratch.save(rows.select("row", "doc_id", "held_out", "text").mapInArrow(_batched(order, batch_bytes), schema), "batches")
    grams = work.where("gram is not null").select("batch", "gram", "n")
    counts = scratch.save(grams.groupBy("gram").agg(F.sum("n").alias("n")), "counts")
    return work.where("block is not null").select("batch", "block"), grams.select(F.col("batch").alias("lot"), "gram"), counts


def fit_trie(texts: DataFrame, scratch: Scratch, order: int = 5, share: int | None = None, batch_bytes: int = 32 << 20) -> Trie:
    """The trie of all ``texts`` (column text)."""
    rows = texts.select(F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("doc_id"), F.lit(False).alias("held_out"), "text")
    return _model(_split(rows, scratch, order, batch_bytes)[2], scratch, order, share)


def batch_log10(data: np.ndarray, bounds: np.ndarray, order: int, gram: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """log10 probability of each of adjacent texts with its end, from the sorted grams' costs."""
    context, symbol = gram_keys(data, bounds, order)
    keys = context * 512 + symbol
    by = np.argsort(keys)
    at = np.minimum(np.searchsorted(gram, keys[by]), len(gram) - 1)
    if (gram[at] != keys[by]).any():
        raise RuntimeError("a batch lacks grams of its texts")
    each = np.empty(len(keys))
    each[by] = cost[at]
    sums = np.concatenate([[0.0], np.cumsum(each[: len(data)])])
    return sums[bounds[1:]] - sums[bounds[:-1]] + each[len(data) :]


def _token_counts(batch_rows: int = 400_000):
    """(token, n) of the tokens of many texts at a time."""

    def run(batches):
        count: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.binary()), pa.array(count.values(), pa.int64())], ["token", "n"])

        for batch in batches:
            for raw in batch.column(0).cast(pa.binary()).to_pylist():
                count.update((raw or b"").lower().split())
            if len(count) > batch_rows:
                yield rows()
                count = Counter()
        if count:
            yield rows()

    return run


def score_texts(docs: DataFrame, order: int = 5, share: int | None = None, hot: int = 200_000, batch_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ppm")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", 7) == 2).alias("held_out"), text.alias("text"))
    train = plain.where(~F.col("held_out")).select("text")
    vocabulary = scratch.save(train.mapInArrow(_token_counts(), "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")), "vocabulary")
    ends = train.count()  # the end tokens, one for each training row
    words, kinds = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_all, v = int(words) + ends, int(kinds) + (1 if ends else 0)
    # Tokens with a share of at least 1 / hot of all: at most ``hot`` of them, whatever the corpus.
    often = {bytes(r.token): int(r.n) for r in vocabulary.where(F.col("n") * hot >= n_all).collect()}
    log_total, end_part = math.log10(n_all + v + 1), math.log10(ends + 1)
    logs = spark.sparkContext.broadcast({t: math.log10(c + 1) for t, c in often.items()})
    scratch.drop()  # the counting's shuffle files
    # A row's key tells repeated ids with other texts apart; fully equal rows share a key and results.
    keyed = plain.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "held_out", "text")
    texts, grams, counts = _split(keyed, scratch, order, batch_bytes)
    costs = _model(counts, scratch, order, share).costs(counts, scratch)
    scratch.drop("counts", "last", *(f"{t}-{k}" for t in ("grams", "contexts") for k in range(order + 1)))
    names = ["row", "doc_id", "held_out", "n_tokens", "n_hot", "hot_sum", "score", "cold", "times"]

    def run(rows: pa.Table, priced: pa.Table) -> pa.Table:
        known, out = logs.value, []
        gram, cost = priced.column("gram").to_numpy(), priced.column("cost").to_numpy()
        by = np.argsort(gram)
        gram, cost = gram[by], cost[by]
        for batch in (b for block in rows.column("block") for b in pa.ipc.open_stream(block.as_buffer())):
            for first, data, bounds in text_chunks(batch.column(3)):
                k = len(bounds) - 1
                score = batch_log10(data, bounds, order, gram, cost)
                raws = batch.column(3).slice(first, k).cast(pa.binary()).to_pylist()
                tokens, hots, sums, colds, times = [], [], [], [], []
                for raw in raws:
                    count = Counter(raw.lower().split())
                    n_hot, total, cold, many = 1 if ends else 0, end_part, [], []
                    for t, n in count.items():
                        x = known.get(t)
                        if x is None:
                            cold.append(t)
                            many.append(n)
                        else:
                            total += x * n
                            n_hot += n
                    tokens.append(sum(count.values()) + 1)
                    hots.append(n_hot)
                    sums.append(total)
                    colds.append(cold)
                    times.append(many)
                out.append(pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(first, k) for i in range(3)), pa.array(tokens, pa.int64()), pa.array(hots, pa.int64()), pa.array(sums, pa.float64()), pa.array(score), pa.array(colds, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))], names
                ))
        return pa.Table.from_batches(out)

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_hot long, hot_sum double, score double, cold array<binary>, times array<long>"
    priced = grams.join(costs, "gram").select("lot", "gram", "cost")
    scored = scratch.save(texts.groupBy("batch").cogroup(priced.groupBy("lot")).applyInArrow(run, schema), "scored")
    scratch.drop("batches", "costs")
    rest = scored.select("row", F.explode(F.arrays_zip("cold", "times")).alias("c")).select("row", F.col("c.cold").alias("token"), F.col("c.times").alias("times"))
    sums = rest.join(vocabulary, "token").groupBy("row").agg(F.sum("times").alias("n_cold"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("cold_sum"), F.countDistinct("token").alias("kinds"), F.count("*").alias("rows"))
    # Equal rows bring their tokens once each; what they sum to is shared among them.
    sums = sums.select("row", (F.col("n_cold") * F.col("kinds") / F.col("rows")).cast("long").alias("n_cold"), (F.col("cold_sum") * F.col("kinds") / F.col("rows")).alias("cold_sum"))
    out = scored.drop("cold", "times").join(sums, "row", "left")
    base = F.col("hot_sum") + F.coalesce("cold_sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(log_total)
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_hot") + F.coalesce("n_cold", F.lit(0))).cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), base.alias("base_score"), "score")

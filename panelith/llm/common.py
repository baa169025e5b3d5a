"""Shared helpers: scratch tables in the cluster's checkpoint folder, folds, word arrays, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, modulus: int):
    """crc32 of the column's text form, modulo ``modulus``; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def lower_ascii(column):
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def arrow_batches(spark: SparkSession, rows: int = 500, size: str = "8m") -> None:
    """Bounds what a Python worker holds at once; whole texts come in small batches, light rows in large ones."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


class Scratch:
    """Intermediate tables as Parquet below spark.checkpoint.dir, which all executors share.

    Writing a table cuts the lineage, so that a lost executor costs one stage and not the whole
    job. The folder is the session's own setting. Where it is unset, a session that runs in this one
    process (tests) gets a temporary one, and any other an error. The shuffle files of a write go when it ends.
    """

    CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, label: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.conf.get("spark.master", "").startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="panelith-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark = spark
        self.root = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
        arrow_batches(spark)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path, before = f"{self.root}/{name}", self.spark.conf.get(self.CLEANUP, "false")
        self.spark.conf.set(self.CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(self.CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables no later step reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def splitmix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII but letters and digits.
SEPARATORS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n + 1:
        size = max(n + 1, 1 << 20)
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def word_hashes(data: np.ndarray, bounds: np.ndarray, blank: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased (A-Z) words of adjacent texts; ``blank`` marks the bytes between words.

    ``data`` holds the UTF-8 bytes, ``bounds`` the n+1 offsets of the n texts. Returns the words'
    hashes and n+1 offsets into them. The hash of a word is a polynomial in an odd base modulo
    2**64, taken as a difference of prefix sums, then mixed.
    """
    n = len(data)
    word = ~blank[data]
    first = word.copy()
    inner = np.zeros(n + 1, bool)
    inner[bounds] = True
    first[1:] &= ~word[:-1] | inner[1:n]
    starts = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:] | inner[1:n]
    ends = np.flatnonzero(last) + 1
    up, down = _power_tables(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return splitmix((sums[ends] - sums[starts]) * down[starts]), np.searchsorted(starts, bounds)


def text_chunks(texts: pa.Array, limit: int = 1 << 19):
    """Slices of a string column as (first row, bytes, bounds): about ``limit`` bytes, or one longer text.

    Null texts come as empty ones.
    """
    for array in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        array = array.fill_null("")
        _, raw_offsets, raw = array.buffers()
        kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
        offsets = np.frombuffer(raw_offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        at = 0
        while at < len(array):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


class Bitmap:
    """A filter of fixed size (2**24 bits as 2**18 rows) for the ids of ``df``, whatever their number.

    It lets through every id it was made of and a few others, so a join that follows decides; its
    point is that only rows that may matter are shuffled. The broadcast table has 2**18 rows at most.
    """

    ROWS = 1 << 18

    def __init__(self, scratch: Scratch, df: DataFrame, column: str, label: str):
        slots = df.select(self._slot(column).alias("slot"), F.expr(f"shiftleft(1L, {self._bit(column)})").alias("bits"))
        self.rows = scratch.save(slots.groupBy("slot").agg(F.bit_or("bits").alias("bits")), label)

    def _slot(self, column: str):
        return F.expr(f"pmod(xxhash64({column}), {self.ROWS}L)")

    @staticmethod
    def _bit(column: str) -> str:
        return f"cast(pmod(shiftright(xxhash64({column}), 20), 64) as int)"

    def split(self, df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
        """(rows that may be among the ids, rows that are not)."""
        slot, bits = fresh_names(df, "slot", "bits")
        rows = self.rows.select(F.col("slot").alias(slot), F.col("bits").alias(bits))
        marked = df.join(F.broadcast(rows), self._slot(column) == F.col(slot), "left")
        hit = F.coalesce(F.expr(f"(shiftright({bits}, {self._bit(column)}) & 1L) = 1"), F.lit(False))
        return marked.where(hit).select(*df.columns), marked.where(~hit).select(*df.columns)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def components(scratch: Scratch, edges: DataFrame, label: str, salts: int = 64) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long), root being the least node of its component.

    Alternates large-star and small-star steps, each a grouped minimum that goes back to the edges;
    edges never more than double, and nothing reaches the driver but a checksum per round. It goes on until
    a round changes nothing. A hub's edges are dealt out over ``salts`` groups, which share their minima.
    """
    now = scratch.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{label}-0")
    whole = Window.partitionBy("u")

    def with_least(rows: DataFrame) -> DataFrame:
        """The edges (u, v) with m, the least neighbour of u."""
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)))
        least = rows.groupBy("u", "salt").agg(F.min("v").alias("m")).withColumn("m", F.min("m").over(whole))
        return rows.join(least, ["u", "salt"]).drop("salt")

    i, seen = 0, None
    while True:
        i += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = with_least(large).select(F.explode(F.array(F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = scratch.save(small, f"{label}-{i}")
        sign = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sign == seen:
            break
        if i > 1:
            scratch.drop(f"{label}-{i - 2}")
        seen = sign
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)

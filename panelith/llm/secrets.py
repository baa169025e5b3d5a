"""Secret scans: fixed rules, and a likelihood ratio of two character Markov models.

Everything on the scanning path is DataFrame expressions. The rules find assignments, access keys
and hex runs; the models score every other token, of any length: the sum over neighbouring characters of
log P(random) - log P(ordinary), both first-order Markov models over
``ALPHABET``, backed by the shares of single characters. The sum alone decides; it must exceed ``threshold``,
the log of the prior odds against a secret. Only tokens too short to reach it with any characters are not summed. They are trained from labelled samples: random strings derived
from digests by rule (label 1), and the words of a bounded sample of the documents (label 0).

Positions are code points, ends exclusive, and derived without a regex position function: the text
split at a pattern gives the gaps, the extraction of the pattern the matches, and running lengths
of both give the starts. Null and empty texts have no spans. Repeated rows come back repeated.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules' patterns and least lengths (fixed values).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex", "random")

#: The ordinary words learned from are shorter than this, as secrets are rarer among them.
LEAST_TOKEN = 20
#: A character's least share in both models, so that one that neither sample has tells nothing.
RARE = 1e-4
#: Observations that the single characters' shares weigh in a pair's probability.
BACKING = 8.0
#: Runs of the characters that the models know.
TOKEN = r"[A-Za-z0-9+/_=-]{%d,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"


def matches(rows: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Adds, for each name, the matches of its pattern (name_m) and the gaps around them (name_g)."""
    rows = rows.withColumns({f"{n}_m": F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1)) for n, p in patterns.items()})
    return rows.withColumns({f"{n}_g": F.when(F.size(f"{n}_m") > 0, F.split(text, p, -1)) for n, p in patterns.items()})


def spans(name: str, kind: int, keep=None) -> Column:
    """array<struct<start, kind, stop, value>> of a pattern's leftmost non-overlapping matches."""
    found, gaps = F.col(f"{name}_m"), F.col(f"{name}_g")
    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    empty = F.array().cast("array<struct<start:int,kind:int,stop:int,value:string>>")

    def step(acc, p):
        start = acc["at"] + F.length(p["g"])
        stop = start + F.length(p["m"])
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), p["m"].alias("value")))).alias("out"))

    all_spans = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    out = F.when(F.size(found) > 0, all_spans).otherwise(empty)
    return F.filter(out, keep) if keep is not None else out


def random_samples(count: int, seed: str = "sample") -> list[str]:
    """Strings labelled random, by rule: digests in hex, base 64 and upper-case base 32, cut to 20-40 characters."""
    import base64

    out = []
    for i in range(count):
        d = hashlib.sha512(f"{seed}{i}".encode()).digest()
        size = 20 + d[-1] % 21
        out.append([d.hex(), base64.b64encode(d).decode(), base64.b32encode(d).decode().rstrip("=")][i % 3][:size])
    return out


def log_ratios(random_counts: dict[str, int], plain_counts: dict[str, int]) -> dict[str, float]:
    """log P(b | a, random) - log P(b | a, ordinary) for every character pair a b, from pair counts."""

    def model(counts: dict[str, int]) -> dict[str, float]:
        ends = {b: sum(counts.get(a + b, 0) for a in ALPHABET) for b in ALPHABET}
        whole = sum(ends.values())
        ends = {b: n / whole + RARE if whole else 1.0 for b, n in ends.items()}
        total = sum(ends.values())
        starts = {a: sum(counts.get(a + b, 0) for b in ALPHABET) for a in ALPHABET}
        return {a + b: (counts.get(a + b, 0) + BACKING * ends[b] / total) / (starts[a] + BACKING) for a in ALPHABET for b in ALPHABET}

    random, plain = model(random_counts), model(plain_counts)
    return {p: math.log(random[p] / plain[p]) for p in random}


def fit_models(docs: DataFrame, text_col: str = "text", sample: int = 2000, random_count: int = 3000) -> dict[str, float]:
    """Pair ratios, from ``random_count`` generated strings and the words of ``sample`` documents.

    The documents are those with the least text hash, so a rerun takes the same. The ordinary sample
    is their words of less than ``LEAST_TOKEN`` characters, without what the rules call secret and without
    those seen once, as secrets are; numbers are ordinary all the same.
    """
    randoms: dict[str, int] = {}
    for s in random_samples(random_count):
        for a, b in zip(s, s[1:]):
            randoms[a + b] = randoms.get(a + b, 0) + 1
    text = F.col(text_col).cast("string")
    some = docs.where(text.isNotNull()).select(F.xxhash64(text).alias("h")).distinct().orderBy("h").limit(sample)
    top = some.agg(F.max("h")).first()[0]
    plain: dict[str, int] = {}
    if top is not None:
        chosen = docs.select(text.alias("t")).where(F.col("t").isNotNull() & (F.xxhash64("t") <= top))
        words = chosen.select(F.explode(F.regexp_extract_all(F.regexp_replace("t", f"{ASSIGN}|{ACCESS}|{HEX}", " "), F.lit("([A-Za-z0-9+/_=-]+)"), F.lit(1))).alias("w")).where(F.length("w").between(2, LEAST_TOKEN - 1)).groupBy("w").agg(F.count("*").alias("n")).where("n > 1 or w rlike '^[0-9]+$'")
        pairs = words.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring("w", i, F.lit(2)))).alias("p"))
        plain = {r.p: int(r.n) for r in pairs.groupBy("p").agg(F.sum("n").alias("n")).collect()}  # at most the square of the alphabet
    return log_ratios(randoms, plain)


def least_length(ratios: dict[str, float], threshold: float) -> int:
    """The least length at which any token at all can exceed ``threshold``."""
    return 2 + max(0, math.floor(threshold / max(max(ratios.values()), 1e-9))) if ratios else 2


def token_score(token: Column, table: Column) -> Column:
    """The sum of the log-likelihood ratios of a token's character pairs; ``table`` has them at 128 * first + second."""
    letters = F.split(token, "")
    pairs = F.zip_with(F.slice(letters, 1, F.length(token) - 1), F.slice(letters, 2, F.length(token) - 1), lambda a, b: F.element_at(table, F.ascii(a) * 128 + F.ascii(b) + 1))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def random_spans(table: Column, threshold: float) -> Column:
    """The spans, of kind random, of the tokens that score above ``threshold``; the others only move the position on."""
    found, gaps = F.col("_token_m"), F.col("_token_g")
    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("n"), m.alias("m"), (token_score(m, table) > threshold).alias("hit")))
    empty = F.array().cast("array<struct<start:int,kind:int,stop:int,value:string>>")

    def step(acc, p):
        start = acc["at"] + p["g"]
        stop = start + p["n"]
        span = F.struct(start.alias("start"), F.lit(3).alias("kind"), stop.alias("stop"), p["m"].alias("value"))
        return F.struct(stop.alias("at"), F.when(p["hit"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    spans_of = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.size(found) > 0, spans_of).otherwise(empty)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 14.0, sample: int = 2000, ratios: dict[str, float] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: ``found`` holds all spans by start, then kind; the other columns sum them up.

    A token that the models call random becomes a span of kind random, unless it overlaps a span
    of a rule. It needs a summed ratio above ``threshold``.
    """
    if ratios is None:
        ratios = fit_models(docs, text_col, sample)
    table = F.from_json(F.lit(_json([ratios.get(chr(a) + chr(b), 0.0) for a in range(128) for b in range(128)])), "array<double>")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    value = lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 1)) >= LEAST_VALUE
    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, text.alias("_t"), F.col(text_col).isNull().alias("_null"))
    rows = matches(rows, "_t", {"_assign": ASSIGN, "_access": ACCESS, "_hex": HEX, "_token": TOKEN % least_length(ratios, threshold)})
    rows = rows.withColumn("_base", F.concat(spans("_assign", 0, value), spans("_access", 1), spans("_hex", 2)))
    rows = rows.withColumn("_random", F.filter(random_spans(table, threshold), lambda s: ~F.exists("_base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))))
    rows = rows.withColumn("_base", F.array_sort("_base")).withColumn("found", F.array_sort(F.concat("_base", "_random")))
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    show = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long")
    return rows.select(
        "doc_id",
        *keep,
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(show("_base").cast("binary"), 256).alias("base_sha256"),
        show("found").alias("spans"),
        F.size("_random").cast("long").alias("n_random"),
        "found",
        F.col("_t").alias("scanned"),
        F.col("_null").alias("scanned_null"),
    )


def _json(ratios: list[float]) -> str:
    import json

    return json.dumps(ratios)


def redact(docs: DataFrame, mark: str = "[SECRET]", **how) -> DataFrame:
    """The documents with every span replaced by ``mark`` and n_chars counted anew; null texts stay null."""
    names = docs.columns
    others = {c: f"_kept{i}" for i, c in enumerate(names) if c not in ("doc_id", "text")}
    rows = scan_secrets(docs.withColumnsRenamed(others), keep=tuple(others.values()), **how)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.when(s["start"] >= acc["at"], F.concat(F.substring(F.col("scanned"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    clean = F.aggregate("found", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("scanned"), acc["at"] + 1, F.length("scanned"))))
    text = F.when(F.col("scanned_null"), F.lit(None).cast("string")).when(F.size("found") == 0, F.col("scanned")).otherwise(clean)
    out = rows.select("doc_id", text.alias("text"), *[F.col(k).alias(c) for c, k in others.items()])
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*names)

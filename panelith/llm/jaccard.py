"""Similarity join of documents by the Jaccard coefficient of their word shingles.

Universe-partition pigeonhole. The shingle universe is hashed into m segments, m fixed by the size
band, so that two sets over the threshold differ in at most H < m tokens. If the tolerances v
granted to a set's segments (0: not used, 1: equal subset, 2: subset within one deletion) sum to
H + 1, some segment must agree within its tolerance. A set grants its tolerances where they cost
least: cost is the number of other sets that the segment's signature, or its one-deletion
neighbourhood, would meet.

1. Every distinct set gives one signature for each segment subset. Signatures that no other set
   has are free: a set with H + 1 free signatures has no partner and leaves (most documents do).
2. The sets left give signatures and one-deletion signatures; costs are counted again and each set
   buys the cheapest H + 1 units. Sets that pay nothing leave too.
3. The sets of a bucket bought are compared by parity sketches, whose distance is a lower bound of
   the tokens in which two sets differ; those near enough are joined to candidate groups. A group is dealt out in blocks bounded by
   their tokens; each pair of blocks counts all overlaps exactly with an inverted index and keeps
   a spanning forest of the links, so no pair list of a group of near copies ever exists.

Tokens are 64-bit hashes and sets are known by 64-bit fingerprints. Rows with the same set share one
representative; copies are never paired, they count as links of one another. Texts without words have
an empty set, link with nothing and keep their own doc_id. A null doc_id takes part and gets the
component of its set, if that has a document with an id. Repeated rows come back repeated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Bitmap, Scratch, arrow_batches, components, fresh_names, splitmix, text_chunks, word_hashes

U = np.uint64
_MULT = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93)]


def _roll(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def shingle_sets(data: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and their n+1 offsets."""
    words, at = word_hashes(data, bounds)
    n = np.diff(at)
    owner = np.repeat(np.arange(len(n)), n)
    if len(words) >= k:
        h = np.zeros(len(words) - k + 1, U)
        for j in range(k):
            h = _roll(h * _MULT[j % 4] + words[j : len(words) - k + 1 + j], 23)
        inside = owner[: len(h)] == owner[k - 1 :]
        h, who = splitmix(h[inside]), owner[: len(inside)][inside]
    else:
        h, who = np.zeros(0, U), np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = np.zeros(len(short), U)
        for i, d in enumerate(short):
            x = np.zeros(1, U)
            for j in range(at[d], at[d + 1]):
                x = splitmix(x * _MULT[1] + words[j : j + 1] + U(n[d]))
            whole[i] = x[0]
        h, who = np.concatenate([h, whole]), np.concatenate([who, short])
    order = np.lexsort((h, who))
    h, who = h[order], who[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
    h, who = h[fresh], who[fresh]
    return h, np.searchsorted(who, np.arange(len(n) + 1))


class Rule:
    """The threshold num/den as integers, and the bounds that follow from it."""

    def __init__(self, num: int = 85, den: int = 100):
        self.num, self.den = num, den

    def differ(self, total):
        """Most tokens by which two linked sets differ whose sizes sum to ``total``."""
        return (self.den - self.num) * total // (self.den + self.num)

    def largest(self, s):
        return s * self.den // self.num

    def least(self, s):
        return -(-s * self.num // self.den)

    def bands(self, sizes: np.ndarray) -> np.ndarray:
        return np.maximum(np.frexp(np.maximum(sizes, 1).astype(float))[1] - 1, 0)

    def segments(self, band):
        top = (np.int64(2) << band) - 1
        need = self.differ(top + self.largest(top)) + 1
        return need + need // 20 + 1

    def schemes(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, band, units to grant): the bands in which each set must meet its partners.

        The smaller set of a pair fixes the band, so a set also takes the band below its own if a
        partner may be that small. Sets whose only partners are equal sets take none.
        """
        band = self.bands(sizes)
        own = self.differ(sizes + self.largest(sizes))
        below = (self.least(sizes) < (np.int64(1) << band)) & (band > 0)
        under = self.differ(sizes + (np.int64(1) << band) - 1)
        rows = np.arange(len(sizes))
        some, low = (own > 0) & (sizes > 1), below & (under > 0) & (sizes > 1)
        return np.concatenate([rows[some], rows[low]]), np.concatenate([band[some], band[low] - 1]), np.concatenate([own[some], under[low]]) + 1


def signatures(rule: Rule, tokens: np.ndarray, at: np.ndarray, deletions: bool = False, widest: int = 8):
    """Signatures of all segment subsets of the sets ``tokens[at[i]:at[i+1]]``.

    Returns (set row, band, units, group id, signature, is deletion); a group is one segment of one
    set in one band, its subset's signature being the mixed sum of its tokens' hashes. With
    ``deletions``, the subsets of at most ``widest`` tokens also give one signature for each
    token left out, and only subsets of fewer than ``widest`` tokens may grant a deletion. The empty
    subsets give signatures too then, so that any set can grant H + 1 units.
    """
    sizes = np.diff(at)
    rows, bands, units = rule.schemes(sizes)
    n = sizes[rows]
    total = int(n.sum())
    part = np.repeat(np.arange(len(rows)), n)
    start = np.cumsum(n) - n
    pick = np.arange(total) - np.repeat(start - at[:-1][rows], n)
    tok = tokens[pick]
    m = rule.segments(bands)
    shift = np.cumsum(m) - m
    seg = (splitmix(tok + U(0x51ED270B)) % m[part].astype(U)).astype(np.int64)
    group = shift[part] + seg
    order = np.argsort(group, kind="stable")
    group, part, seg = group[order], part[order], seg[order]
    mixed = splitmix(tok[order] + U(0xA0761D6478BD642F))
    first = np.ones(total, bool)
    first[1:] = group[1:] != group[:-1]
    heads = np.flatnonzero(first)
    sums = np.add.reduceat(mixed, heads) if total else np.zeros(0, U)
    salt = splitmix(seg[heads].astype(U) * U(64) + bands[part[heads]].astype(U) + U(1)) if total else np.zeros(0, U)

    def sign(x, s, band):
        return ((splitmix(x ^ s) & ~U(63)) | band.astype(U)).view(np.int64)

    exact = sign(sums, salt, bands[part[heads]])
    gid = np.arange(len(heads))
    if not deletions:
        return rows[part[heads]], bands[part[heads]], units[part[heads]], gid, exact, np.zeros(len(heads), bool)
    # Segments without tokens agree with each other, and with those of one token within a deletion.
    bare = np.setdiff1d(np.arange(int(m.sum())), group[heads], assume_unique=True)
    whose = np.searchsorted(shift, bare, "right") - 1
    none = sign(np.zeros(len(bare), U), splitmix((bare - shift[whose]).astype(U) * U(64) + bands[whose].astype(U) + U(1)), bands[whose])
    width = np.diff(np.append(heads, total))
    mine = np.repeat(gid, width)
    some = width[mine] <= widest
    each = mine[some]
    less = sign(sums[each] - mixed[some], salt[each], bands[part[heads]][each])
    some_one = np.concatenate([gid, each, len(heads) + np.arange(len(bare))])
    p = np.concatenate([part[heads], part[heads][each], whose])
    return rows[p], bands[p], units[p], some_one, np.concatenate([exact, less, none]), np.concatenate([np.zeros(len(gid), bool), np.ones(len(each), bool), np.zeros(len(bare), bool)])


def fingerprint(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One 64-bit value for each set, 0 for an empty one."""
    out = np.zeros(len(at) - 1, U)
    full = np.diff(at) > 0
    if full.any():
        out[full] = splitmix(np.add.reduceat(splitmix(tokens + U(0x8EBC6AF09C88C6E3)), at[:-1][full]) + np.diff(at)[full].astype(U)) | U(1)
    return out.view(np.int64)


def _lists(values: np.ndarray, at: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))


def sketches(tokens: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Parity bits of each set: each token flips one of 2**j > 2 n bits, so the bits in which two
    sketches differ are a lower bound of the tokens in which the sets do; those of unrelated sets
    differ in about 0.9 n or more. Folding a sketch in halves gives the sketch with fewer bits."""
    places = splitmix(tokens + U(0x2545F4914F6CDD1D))
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        bits = 128 if b - a < 32 else 2 << int(b - a).bit_length()
        out.append(np.packbits((np.bincount((places[a:b] & U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes())
    return out


def apart(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of two sets, from their sketches."""
    if len(a) < len(b):
        a, b = b, a
    x, bits = int.from_bytes(a, "little"), 8 * len(a)
    while bits > 8 * len(b):
        bits //= 2
        x = (x & ((1 << bits) - 1)) ^ (x >> bits)
    return (x ^ int.from_bytes(b, "little")).bit_count()


def _meetings(rule: Rule, few: int = 8):
    """Candidate edges from buckets: rows (grp, side, fp, n, sketch) to (u, v).

    A bucket of a few sets gives its pairs whose sketches allow the threshold. A larger one is
    covered by balls in the sketches' Hamming metric, in which linked sets are within H: centres
    are taken until every set is within H of one, and each centre is joined to the sets within 2 H,
    among them all partners of the sets at home there. So sets far apart are not joined. What is
    joined comes out as stars, no more edges than the bucket has sets.
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(pdf.grp.to_numpy(), kind="stable")
        grp, fp, n, side = (pdf[c].to_numpy()[order] for c in ("grp", "fp", "n", "side"))
        raw = pdf.sketch.to_numpy()[order]
        cut = np.concatenate([[0], np.flatnonzero(grp[1:] != grp[:-1]) + 1, [len(grp)]]).tolist() if len(grp) else [0]
        tried: dict[tuple[int, int], bool] = {}
        ids, sizes = fp.tolist(), n.tolist()
        for lo, hi in zip(cut, cut[1:]):
            across = bool(side[lo:hi].any())
            if hi - lo <= few and not across:
                for i in range(lo, hi):
                    for j in range(i + 1, hi):
                        pair = (ids[i], ids[j]) if ids[i] < ids[j] else (ids[j], ids[i])
                        if pair[0] != pair[1] and pair not in tried:
                            tried[pair] = apart(raw[i], raw[j]) <= rule.differ(sizes[i] + sizes[j])
                continue
            least = min(map(len, raw[lo:hi]))
            bits = np.stack([_fold(r, least) for r in raw[lo:hi]])
            most = rule.differ(2 * max(sizes[lo:hi]))
            away = side[lo:hi] == 0 if across else np.ones(hi - lo, bool)
            root = np.arange(hi - lo)
            while away.any():
                c = int(away.argmax())
                d = np.bitwise_count(bits ^ bits[c]).sum(1)
                away &= d > most
                ball = np.unique(root[d <= 2 * most])
                if len(ball) > 1:
                    root[np.isin(root, ball)] = ball[0]
            for i, r in enumerate(root.tolist()):  # a star for each joined part of the bucket
                if r != i:
                    tried[(ids[lo + r], ids[lo + i])] = True
        out = [p for p, near in tried.items() if near and p[0] != p[1]]
        return pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    return run


def _fold(sketch: bytes, size: int) -> np.ndarray:
    x = np.frombuffer(sketch, np.uint64)
    while len(x) * 8 > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _repeated(batches):
    """From rows (sign, fp) in order of both, those whose sign another fp has too, as (fp, band)."""
    last_sign = last_fp = None
    told = False  # whether the last row is out already
    for batch in batches:
        sign, fp = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        if not len(sign):
            continue
        if last_sign is not None:
            sign, fp = np.concatenate([[last_sign], sign]), np.concatenate([[last_fp], fp])
        fresh = np.ones(len(sign), bool)
        fresh[1:] = (sign[1:] != sign[:-1]) | (fp[1:] != fp[:-1])
        was_told = told and last_sign is not None
        keep_sign, keep_fp = sign[fresh], fp[fresh]
        same = keep_sign[1:] == keep_sign[:-1]
        met = np.zeros(len(keep_sign), bool)
        met[1:] |= same
        met[:-1] |= same
        last_sign, last_fp = keep_sign[-1], keep_fp[-1]
        now_told = bool(met[-1]) or (was_told and len(keep_sign) == 1)
        if was_told:
            met[0] = False
        told = now_told
        yield pa.RecordBatch.from_arrays([pa.array(keep_fp[met]), pa.array(keep_sign[met] & 63)], ["fp", "band"])


def _profile(k: int, rule: Rule):
    """For each text: its size, fingerprint, all signatures, and how many each band has and needs."""

    def run(batches):
        for batch in batches:
            for first, data, bounds in text_chunks(batch.column(1)):
                tokens, at = shingle_sets(data, bounds, k)
                rows, bands, units, _, sign, _ = signatures(rule, tokens, at)
                order = np.argsort(rows, kind="stable")
                n = len(at) - 1
                ids = batch.column(0).slice(first, n)
                cut = np.searchsorted(rows[order], np.arange(n + 1))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(at)), pa.array(fingerprint(tokens, at)), _lists(sign[order], cut, pa.int64())], ["doc_id", "n", "fp", "signs"])

    return run


def _needs(rule: Rule):
    """The units a set of size n must grant in a band, as a Column."""

    def column(n, band):
        low = F.pow(F.lit(2.0), band).cast("long")
        partner = F.when(n >= 2 * low, 2 * low - 1).otherwise(F.floor(n * rule.den / F.lit(rule.num)))
        return F.floor((rule.den - rule.num) * (n + partner) / F.lit(rule.den + rule.num)) + 1

    return column


def _sets(k: int):
    def run(batches):
        for batch in batches:
            for _, data, bounds in text_chunks(batch.column(0)):
                tokens, at = shingle_sets(data, bounds, k)
                yield pa.RecordBatch.from_arrays([pa.array(fingerprint(tokens, at)), _lists(tokens.view(np.int64), at, pa.int64()), pa.array(sketches(tokens, at), pa.binary())], ["fp", "tokens", "sketch"])

    return run


def _open_lists(column) -> tuple[np.ndarray, np.ndarray]:
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False).astype(np.int64)[at[0] : at[-1]].view(U), at - at[0]


def _neighbourhoods(rule: Rule, widest: int):
    """Rows (sign, fp, slot): every signature and one-deletion signature of the sets.

    A slot packs the segment's number within its set, its width (up to widest + 1), its band, and
    whether a token is left out, from high to low bits.
    """

    def run(batches):
        for batch in batches:
            fps = np.asarray(batch.column(0))
            tokens, at = _open_lists(batch.column(1))
            lo = 0
            while lo < len(fps):  # bounded by tokens, not by sets
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + 200_000, "right")) - 1)
                rows, bands, _, seg, sign, gone = signatures(rule, tokens[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], True, widest)
                width = np.bincount(seg[gone], minlength=int(seg.max()) + 1 if len(seg) else 0)
                slot = ((seg.astype(np.int64) * 16 + width[seg]) * 64 + bands) * 2 + gone
                yield pa.RecordBatch.from_arrays([pa.array(sign), pa.array(fps[lo:hi][rows]), pa.array(slot)], ["sign", "fp", "slot"])
                lo = hi

    return run


def link_block(rule: Rule, fps: np.ndarray, tokens: np.ndarray, at: np.ndarray, side: np.ndarray, copies: np.ndarray, across: bool | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(a spanning forest of the links among sets, how many rows each set links with), exactly.

    With two sides, or ``across``, only links across are sought. ``copies`` are the rows that have each set.

    Overlaps of a set with all others are counted over the postings of its tokens. Tokens that more
    than half of the sets hold have the list of those that lack them instead.
    """
    k, sizes = len(fps), np.diff(at)
    owner = np.repeat(np.arange(k), sizes)
    vocabulary, code = np.unique(tokens, return_inverse=True)
    order = np.argsort(code, kind="stable")
    post, cut = owner[order], np.searchsorted(code[order], np.arange(len(vocabulary) + 1))
    freq = np.diff(cut)
    lacking = {int(t): np.setdiff1d(np.arange(k), post[cut[t] : cut[t + 1]], assume_unique=True) for t in np.flatnonzero(freq > k // 2)} if k > 8 else {}
    root, out, degree = np.arange(k), [], np.zeros(k, np.int64)
    if across is None:
        across = bool(side.any()) and not side.all()
    for r in range(k):
        if across and side[r]:
            continue
        codes = code[at[r] : at[r + 1]]
        codes = codes[freq[codes] > 1]
        if not len(codes):
            continue
        many = [int(t) for t in codes if int(t) in lacking] if lacking else []
        few = [post[cut[t] : cut[t + 1]] for t in codes if int(t) not in lacking]
        shared = np.bincount(np.concatenate(few), minlength=k) if few else np.zeros(k, np.int64)
        if many:
            gaps = [lacking[t] for t in many if len(lacking[t])]
            shared = shared + len(many) - (np.bincount(np.concatenate(gaps), minlength=k) if gaps else 0)
        linked = rule.den * shared >= rule.num * (sizes[r] + sizes - shared)
        linked &= side == 1 if across else np.arange(k) > r
        degree[r] += copies[linked].sum()
        degree[linked] += copies[r]
        linked &= root != root[r]
        for j in np.flatnonzero(linked):
            if root[j] != root[r]:
                out.append((int(fps[r]), int(fps[j])))
                root[root == root[j]] = root[r]
    return out, degree


def _verify(rule: Rule):
    """Rows (u, v, n): the links of a forest, with n null, and the sets that link, with v null and the rows they link with."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby("grp", sort=False):
            g = g.drop_duplicates("fp")
            if len(g) < 2:
                continue
            lists = [np.asarray(t, np.int64).view(U) for t in g.tokens]
            at = np.concatenate([[0], np.cumsum([len(t) for t in lists])]).astype(np.int64)
            fps = g.fp.to_numpy()
            links, degree = link_block(rule, fps, np.concatenate(lists), at, g.side.to_numpy(), g.copies.to_numpy(), bool(g.pair.iloc[0]))
            out += [(u, v, None) for u, v in links]
            out += [(int(fps[i]), None, int(degree[i])) for i in np.flatnonzero(degree)]
        return pd.DataFrame({c: pd.array([r[i] for r in out], "Int64") for i, c in enumerate("uvn")})

    return run


def _deal(rows: DataFrame, key, few: int) -> DataFrame:
    """Rows of groups (key) in ``parts`` blocks, once for each pair of blocks (fp, grp, side, unit, pair).

    ``grp`` tells the block pairs apart, ``side`` is 1 for the second block of a pair, ``pair`` tells two blocks from one; block pairs of
    split groups are tasks of their own, whole groups share ``few`` tasks, a number that grows with the rows.
    """
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    one = F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("side")))
    many = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, F.col("part")).alias("a"), F.greatest(p, F.col("part")).alias("b"), (F.col("part") > p).cast("int").alias("side")))
    rows = rows.select("fp", "parts", key.alias("_key"), part.alias("part"))
    rows = rows.select("fp", "parts", "_key", F.explode(F.when(F.col("parts") == 1, one).otherwise(many)).alias("t")).select("fp", "parts", "_key", "t.*")
    unit = F.when(F.col("parts") == 1, F.pmod("_key", F.lit(few))).otherwise(F.xxhash64("_key", "a", "b"))
    return rows.select("fp", F.xxhash64("_key", "a", "b").alias("grp"), "side", unit.alias("unit"), (F.col("a") != F.col("b")).alias("pair"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100, widest: int = 4, bucket: int = 4096, block_tokens: int = 1_000_000) -> DataFrame:
    """(id, n_shingles, component_id, n_links) for every row: the least id reachable by links, and the rows linked with.

    Two rows link when den * |intersection| >= num * |union| over their k-word shingles. A block of
    a candidate group holds at most ``block_tokens`` shingles, or one larger set; larger buckets than ``bucket`` sets are dealt out in blocks too.
    """
    spark = docs.sparkSession
    scratch, rule = Scratch(spark, "jaccard"), Rule(num, den)
    kind = dict(docs.select(id_col).dtypes)[id_col]
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    profile = scratch.save(plain.mapInArrow(_profile(k, rule), "doc_id long, n long, fp long, signs array<long>"), "profile")

    # One representative for each set. Signatures that several sets have:
    # the rows of a signature come sorted, so they are compared in passing and shuffled once.
    signs = profile.select(F.explode("signs").alias("sign"), "fp").repartition("sign").sortWithinPartitions("sign", "fp")
    met = signs.mapInArrow(_repeated, "fp long, band long").groupBy("fp", "band").agg(F.count("*").alias("met"))
    have = profile.where(F.size("signs") > 0).select("fp", "n", F.explode(F.array_distinct(F.transform("signs", lambda s: s.bitwiseAND(63)))).alias("band"), "signs")
    have = have.select("fp", "n", "band", F.size(F.filter("signs", lambda s: s.bitwiseAND(63) == F.col("band"))).alias("all_signs")).groupBy("fp", "band").agg(F.first("n").alias("n"), F.first("all_signs").alias("all_signs"))
    needy = have.join(met, ["fp", "band"], "left").withColumn("met", F.coalesce("met", F.lit(0))).withColumn("units", _needs(rule)(F.col("n"), F.col("band").cast("int"))).where("all_signs - met < units")
    arrow_batches(spark, 20_000)
    needy = scratch.save(needy.select("fp", "band", "units"), "needy")
    arrow_batches(spark)
    profile = scratch.save(profile.select("doc_id", "n", "fp"), "sizes")
    scratch.drop("profile")

    # The sets that are left, from one row of each; they buy the cheapest units.
    heads = needy.select("fp").distinct().join(profile, "fp").groupBy("fp").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").select("doc_id").distinct()
    heads = scratch.save(heads, "heads")
    likely, _ = Bitmap(scratch, heads, "doc_id", "heads-map").split(plain, "doc_id")
    texts = likely.join(heads, "doc_id").select("text")
    sets = scratch.save(texts.mapInArrow(_sets(k), "fp long, tokens array<long>, sketch binary").where(F.size("tokens") > 0).dropDuplicates(["fp"]), "sets")
    rows = scratch.save(sets.mapInArrow(_neighbourhoods(rule, widest), "sign long, fp long, slot long"), "rows")
    gone, band, width, seg = F.expr("slot & 1") == 1, F.expr("shiftright(slot, 1) & 63"), F.expr("shiftright(slot, 7) & 15"), F.expr("shiftright(slot, 1)")
    keys = rows.groupBy("sign").agg(F.count_if(~gone).alias("exact"), F.count_if(gone).alias("less")).where("exact + less > 1")
    paid = rows.join(keys, "sign").groupBy("fp", seg.alias("seg")).agg(
        F.sum(F.when(~gone, F.col("exact") - 1).otherwise(0)).alias("c1"),
        F.sum(F.when(gone, F.col("exact")).otherwise(F.col("exact") - 1 + F.col("less"))).alias("c2"),
    )
    grants = lambda w: F.when(w.between(1, widest - 1), 2).otherwise(1)
    offered = rows.where(~gone).groupBy("fp", band.alias("band")).agg(F.sum(grants(width)).alias("offered"))
    step = lambda u, c: F.struct(F.lit(u).alias("unit"), c.cast("long").alias("cost"))
    paid = paid.withColumn("band", F.expr("seg & 63")).withColumn("width", F.expr("shiftright(seg, 6) & 15"))
    steps = paid.select("fp", "band", "seg", F.explode(F.when(grants(F.col("width")) == 2, F.array(step(1, F.col("c1")), step(2, F.greatest("c1", F.col("c2") - F.col("c1"))))).otherwise(F.array(step(1, F.col("c1"))))).alias("s")).select("fp", "band", "seg", "s.*").where("cost > 0")
    steps = scratch.save(steps, "steps")
    priced = steps.groupBy("fp", "band").agg(F.count("*").alias("priced"))
    short = needy.join(offered, ["fp", "band"]).join(priced, ["fp", "band"]).withColumn("buy", F.col("units") - F.col("offered") + F.col("priced")).where("buy > 0").select("fp", "band", "buy")
    bought = steps.join(short, ["fp", "band"]).withColumn("at", F.row_number().over(Window.partitionBy("fp", "band").orderBy("cost", "seg", "unit"))).where("at <= buy")
    bought = scratch.save(bought.groupBy("fp", "seg").agg(F.max("unit").alias("unit")), "bought")
    wanted = rows.withColumn("seg", seg).join(bought, ["fp", "seg"]).where(~gone | (F.col("unit") == 2)).groupBy("sign").agg(F.max(F.col("unit") == 2).alias("wide"))
    hits = scratch.save(rows.join(wanted, "sign").where(F.col("wide") | ~gone).select("sign", "fp").distinct(), "hits")
    members = hits.groupBy("sign").agg(F.count("*").alias("members")).where("members > 1")
    side = sets.select("fp", F.size("tokens").cast("long").alias("n"), "sketch")
    met = hits.join(members, "sign").withColumn("parts", F.ceil(F.col("members") / F.lit(bucket)).cast("int"))
    met = _deal(met, F.xxhash64("sign"), max(1024, hits.count() // 10_000)).join(side, "fp")
    edges = met.groupBy("unit").applyInPandas(_meetings(rule), "u long, v long")
    edges = scratch.save(edges, "edges")
    scratch.drop("rows", "steps", "bought", "hits")
    groups = scratch.save(components(scratch, edges, "groups"), "groups")

    # Blocks of each group; small groups share a task.
    sized = groups.join(sets.select("fp", F.size("tokens").alias("size")), groups.node == F.col("fp")).select("fp", "root", "size")
    total = sized.groupBy("root").agg(F.sum("size").alias("tokens"))
    dealt = sized.join(total, "root").withColumn("parts", F.ceil(F.col("tokens") / F.lit(block_tokens)).cast("int"))
    work = _deal(dealt.select("fp", "root", "parts"), F.xxhash64("root"), max(1024, (total.agg(F.sum("tokens")).first()[0] or 0) // (block_tokens // 4))).join(sets.select("fp", "tokens"), "fp")
    copies = scratch.save(profile.where("fp <> 0").groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies")), "copies")
    work = work.join(copies.select("fp", "copies"), "fp")
    found = scratch.save(work.groupBy("unit").applyInPandas(_verify(rule), "u long, v long, n long"), "links")
    roots = components(scratch, found.where("n is null").select("u", "v"), "links")
    degrees = found.where("n is not null").groupBy("u").agg(F.sum("n").alias("others"))

    # Back to the rows: the least id of each component.
    named = copies.join(roots, copies.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "low", "copies")
    least = named.groupBy("root").agg(F.min("low").alias("component"))
    named = named.join(least, "root").join(degrees, F.col("fp") == F.col("u"), "left").select("fp", "component", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    out = profile.select("doc_id", "n", "fp").join(named, "fp", "left")
    return out.select(F.col("doc_id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def oracle(k: int = 4, num: int = 85, den: int = 100) -> str:
    """The result over ``documents`` as SQL: all pairs that share a shingle, and all reachable pairs."""
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(words) >= {k} THEN list_distinct(list_transform(range(1, len(words) - {k - 2}), lambda i: array_to_string(words[i : i + {k - 1}], ' '))) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS shingles FROM d
), s AS MATERIALIZED (
  SELECT doc_id, unnest(shingles) AS shingle, len(shingles) AS n FROM g
), l AS MATERIALIZED (
  SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING {den} * count(*) >= {num} * (a.n + b.n - count(*))
), r AS (
  SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u
)
SELECT g.doc_id, len(g.shingles)::BIGINT AS n_shingles, least(g.doc_id, (SELECT min(v) FROM r WHERE r.u = g.doc_id)) AS component_id, (SELECT count(*) FROM l WHERE l.u = g.doc_id)::BIGINT AS n_links
FROM g
"""


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The documents with one of each linked group left: the one with the least doc_id.

    Rows that repeat a doc_id are one document; the first by text stays. Of the rows without a
    doc_id, one of each text stays. Other columns may have any names and are passed on.
    """
    scratch = Scratch(docs.sparkSession, "keep")
    marks = scratch.save(jaccard_components(docs, **how).select(F.col("doc_id").cast("long").alias("doc_id"), "component_id"), "marks")
    ids = marks.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("component_id").alias("component_id"))
    gone, row = fresh_names(docs, "gone", "row")
    ids = scratch.save(ids.where("rows > 1 or component_id <> doc_id").select("doc_id", (F.col("component_id") < F.col("doc_id")).alias("goes")), "ids")
    likely, sure = Bitmap(scratch, ids, "doc_id", "ids-map").split(docs.where("doc_id is not null"), "doc_id")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last()))
    left = likely.join(ids.where("goes").select(F.col("doc_id").alias(gone)), F.col("doc_id") == F.col(gone), "left_anti").withColumn(row, first).where(F.col(row) == 1).select(*docs.columns)
    nameless = docs.where("doc_id is null").withColumn(row, F.row_number().over(Window.partitionBy(F.xxhash64("text"), "text").orderBy(F.lit(1)))).where(F.col(row) == 1).select(*docs.columns)
    return sure.unionByName(left).unionByName(nameless)

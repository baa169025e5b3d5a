import random

import numpy as np
import pandas as pd
import pytest

from panelith.llm.common import Scratch, components
from panelith.llm.jaccard import Rule, _verify, apart, jaccard_components, keep_one, link_block, oracle, shingle_sets, signatures, sketches


def brute(texts, k, num, den):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root, links = list(range(len(texts))), [0] * len(texts)

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
                links[i] += 1
                links[j] += 1
    return [len(s) for s in sets], [find(i) for i in range(len(texts))], links


def corpus(seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    line = " ".join(r.sample(words, 14))
    texts = [None, "", "  \n\t", "one", "One", "one two three", "ONE two three"]
    for size in (5, 9, 20, 40, 80, 150, 300, 900):
        for _ in range(5):
            base = r.choices(words, k=size)
            texts.append(" ".join(base))
            for _ in range(r.randint(1, 6)):
                copy = list(base)
                for _ in range(max(1, int(size * r.choice((0.004, 0.01, 0.02, 0.04))))):
                    copy[r.randrange(len(copy))] = r.choice(words)
                texts.append(" ".join(copy) + (" " + line if r.random() < 0.2 else ""))
            texts.append(" ".join(base).upper())
    base = r.choices(words, k=120)  # one large group of near copies, many of them not within the threshold
    for _ in range(250):
        copy = list(base)
        for _ in range(r.randint(0, 9)):
            copy[r.randrange(len(copy))] = r.choice(words)
        texts.append(" ".join(copy))
    texts += [line + " " + " ".join(r.choices(words, k=r.randint(0, 60))) for _ in range(150)]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize(("k", "num", "how"), [(4, 85, {}), (5, 80, {"bucket": 16, "block_tokens": 3000})])
def test_components_equal_brute_force(spark, k, num, how):
    texts = corpus(k)
    sizes, expected, links = brute(texts, k, num, 100)
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, component_id string, n long")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_components(docs, k=k, num=num, **how).collect()}
    assert got == {i: (sizes[i], expected[i], links[i]) for i in range(len(texts))}


def test_empty_repeated_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert jaccard_components(spark.createDataFrame([], schema)).count() == 0
    long = " ".join(f"t{i}" for i in range(40_000))
    rows = [(7, long), (7, long), (9, long + " end"), (None, long), (None, None), (3, None), (4, "")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(7, 39_996, 7)] * 2 + [(9, 39_997, 7), (None, 39_996, 7), (None, 0, None), (3, 0, 3), (4, 0, 4)], key=str)


def test_keep_one(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a, "x"), (2, a + " more", None), (8, b, "x"), (8, b, "x"), (9, None, "y"), (10, "", "y"), (11, a, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.source) for r in keep_one(docs, k=5, num=80).collect()) == [(2, None), (8, "x"), (9, "y"), (10, "y")]
    assert keep_one(docs.limit(0)).count() == 0


def test_linked_sets_share_a_signature_within_tolerance():
    rule, rng = Rule(85, 100), np.random.default_rng(1)
    for size in (7, 12, 40, 127, 128, 130, 400):
        for _ in range(20):
            a = rng.choice(2**62, size, replace=False).astype(np.uint64)
            drop = rng.integers(0, 2 + size // 12)
            b = np.concatenate([a[drop:], rng.choice(2**62, rng.integers(0, 2 + size // 20)).astype(np.uint64)])
            both = len(a) - drop
            if 100 * both < 85 * (len(a) + len(b) - both):
                continue
            at = np.array([0, len(a), len(a) + len(b)])
            row, band, units, _, sign, _ = signatures(rule, np.concatenate([np.sort(a), np.sort(b)]), at)
            if both == len(a) == len(b):
                continue
            shared = set(sign[row == 0]) & set(sign[row == 1])
            assert shared
            for s in range(2):
                for k in set(band[row == s]):
                    assert rule.segments(k) >= units[(row == s) & (band == k)][0]
            s = sketches(np.concatenate([a, b]), at)
            assert apart(*s) <= len(a) + len(b) - 2 * both


def test_block_links():
    rule, rng = Rule(80, 100), np.random.default_rng(2)
    base = rng.choice(2**62, 50).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(50) > 0.06], rng.choice(2**62, rng.integers(0, 6)).astype(np.uint64)])) for _ in range(60)]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    links, degree = link_block(rule, np.arange(60), np.concatenate(sets), at, np.zeros(60, int), np.ones(60, int))
    truth = {(i, j) for i in range(60) for j in range(i + 1, 60) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert set(links) <= truth
    assert degree.tolist() == [sum(i in p for p in truth) for i in range(60)]

    def parts(pairs):
        root = list(range(60))
        for i, j in pairs:
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
        return root

    assert parts(links) == parts(sorted(truth))


def test_shingles_of_short_and_blank_texts():
    texts = [b"", b" \n", b"a b", b"A\x0bB", b"a b c d", b"x a b c d"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    tokens, at = shingle_sets(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]), 4)
    assert np.diff(at).tolist() == [0, 0, 1, 1, 1, 2]
    assert tokens[at[2]] == tokens[at[3]]
    assert tokens[at[4]] in tokens[at[5] : at[6]]


def test_sets_with_tokens_in_few_segments(spark):
    """Sets of 6 and 7 shingles, some with all of them in one segment, next to their neighbours by one token."""
    full = "w680282 w734035 w821916 w990160 w490601 w818553 w785675 w740413 w645352 w663556".split()
    r = random.Random(7)
    pairs = [full] + [[f"v{r.randrange(10**6)}" for _ in range(10)] for _ in range(1500)]
    rows = [(2 * i + j, " ".join(w[: 10 - j])) for i, w in enumerate(pairs) for j in (0, 1)]
    got = {x.doc_id: (x.component_id, x.n_links) for x in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k=4, num=85, den=100).collect()}
    assert got == {i: (i - i % 2, 1) for i, _ in rows}


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_short_texts_cut_at_both_ends(spark, k, num):
    """Thousands of short texts next to themselves without their first and last words."""
    r = random.Random(k)
    rows = []
    for i in range(3000):
        words = [f"v{r.randrange(10**7)}" for _ in range(r.randint(9, 36))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[r.randint(0, 2) : len(words) - r.randint(0, 2)]))]
    near = {i for i in range(0, len(rows), 2) if brute([rows[i][1], rows[i + 1][1]], k, num, 100)[2][0]}
    got = {x.doc_id: (x.component_id, x.n_links) for x in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k=k, num=num).collect()}
    assert len(near) > 500
    assert got == {i: (i - i % 2, 1) if i - i % 2 in near else (i, 0) for i, _ in rows}


def test_components_of_hubs_and_chains(spark):
    scratch, r = Scratch(spark, "test"), random.Random(4)
    edges = [(5000 + i, 3) for i in range(400)] + [(9000, 5000 + i) for i in range(300)] + [(i, i + 1) for i in range(10_000, 10_200)] + [(r.randrange(200, 900), r.randrange(200, 900)) for _ in range(300)] + [(7, 7)]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    got = {x.node: x.root for x in components(scratch, spark.createDataFrame(edges, "u long, v long"), "c").collect()}
    assert got == {n: find(n) for n in root if n != 7 and any(n in e and e[0] != e[1] for e in edges)}


def test_clashing_columns(spark):
    rows = [(i, " ".join(f"a{j}" for j in range(i % 3, 60))) for i in range(9)] + [(None, "x"), (None, "x"), (3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("_slot", "_bits", "_row", "_gone", "slot", "bits", "row", "gone", "rows", "goes", "fp", "n", "sign", "band", "component_id", "source"):
        docs = docs.withColumn(c, docs.text)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, ((x.doc_id, x.text[:3], x["_slot"][:3]) for x in kept.collect()))) == ["(0, 'a0 ', 'a0 ')", "(None, 'x', 'x')"]
    assert jaccard_components(docs).count() == len(rows)


def test_result_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    frame = spark.createDataFrame(list(enumerate(corpus(8))), "doc_id long, text string")
    documents = frame.toArrow()  # noqa: F841 (read by the SQL)
    got = jaccard_components(frame, k=4, num=85).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted(tuple(x) for x in got) == sorted(duckdb.sql(oracle()).fetchall())


def test_a_block_pair_with_an_empty_side_counts_no_links():
    tokens = list(range(1, 101))
    for side, pair, rows in ((0, False, 3), (0, True, 0), (1, True, 0)):
        block = pd.DataFrame({"grp": 1, "fp": [5, 6], "side": side, "pair": pair, "copies": 1, "tokens": [tokens, tokens[1:]]})
        assert len(_verify(Rule(85, 100))(block)) == rows

import math
import random
import re
from collections import Counter

import numpy as np

from panelith.llm.decontam import BLOCKS, Index, decontaminate, find_leaks, hashed, split_item


def items(n=60, seed=5):
    r = random.Random(seed)
    words = [f"k{i}" for i in range(900)] + ["the", "of", "and"] * 100
    return [(i, " ".join(r.choices(words, k=r.randint(8, 40))).capitalize() + ". Answer " + " ".join(r.choices(words, k=6)) + ".") for i in range(n)]


def test_retrieval_equals_full_scoring():
    index = Index(items())
    r = random.Random(1)
    full = {}
    for t, post in enumerate(index.postings):
        for d, x in post:
            full.setdefault(d, {})[t] = x
    for _ in range(200):
        terms = sorted(set(r.choices(range(len(index.terms)), k=r.randint(1, 60)) + [t for t in full[r.randrange(60)] if r.random() < 0.8]))
        for threshold in (0.2, 0.5, 0.9):
            got = {d: s for block in range(BLOCKS) for d, s in index.retrieve(terms, block, threshold)}
            want = {d: sum(w.get(t, 0) for t in terms) for d, w in full.items()}
            assert set(got) == {d for d, s in want.items() if s >= threshold}
            assert all(abs(got[d] - want[d]) < 1e-9 for d in got)


def test_leaks_are_found_and_others_left(spark):
    bench, r = items(), random.Random(2)
    words = [f"k{i}" for i in range(900)]
    noise = lambda n: " ".join(r.choices(words, k=n))
    rows, truth = [], set()
    for i in range(120):
        text = noise(r.randint(0, 400))
        if i % 3 == 0:
            item = r.choice(bench)
            text = f"{text} {item[1].upper() if i % 2 else item[1]} {noise(r.randint(0, 3000))}"
            truth.add((i, item[0]))
        rows.append((i, text, "s", 0.5))
    question = split_item(bench[0][1])[0]
    rows += [(200, None, "s", 0.0), (201, "", "s", 0.0), (202, question, "s", 0.0), (203, noise(30_000) + " " + bench[7][1], "s", 0.0)]
    truth.add((203, 7))
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string, score double")
    table = spark.createDataFrame([*bench, (None, "x"), (900, None), (901, " ")], "item_id long, text string")
    found = {(x.doc_id, x.item_id) for x in find_leaks(docs, table).collect()}
    assert found == truth
    assert {(x.doc_id, x.item_id) for x in find_leaks(docs, table, shard_items=20).collect()} == truth
    kept = decontaminate(docs, table)
    assert kept.columns == docs.columns
    assert {x.doc_id for x in kept.collect()} == {x[0] for x in rows} - {d for d, _ in truth}
    assert decontaminate(docs, table.limit(0)).count() == len(rows)
    assert find_leaks(docs.limit(0), table).count() == 0


def test_shards_give_the_results_of_one_index(spark):
    bench, r = items(120, 8), random.Random(6)
    rows = []
    for i, (_, text) in enumerate(bench):
        rows.append((i, " ".join(w for w in text.split() if r.random() < 0.75)))
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    found = lambda **how: {(x.doc_id, x.item_id): round(x.score, 9) for x in find_leaks(docs, table, overlap=0.0, **how).collect()}
    one = found()
    assert len(one) > 20
    assert found(shard_items=30) == one


def brute_leaks(rows, bench, threshold=0.6, overlap=0.6, k1=1.2, b=0.75):
    """{(doc_id, item_id): (score, question overlap, answer overlap)} by the definition, over words instead of hashes."""
    words_of = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = lambda w: [tuple(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [(x,) for x in w]
    known = [(i, t, words_of(t)) for i, t in bench if i is not None and words_of(t)]
    n, mean = len(known), sum(len(w) for _, _, w in known) / max(len(known), 1)
    df = Counter(x for _, _, w in known for x in set(w))
    out = {}
    for item, text, words in known:
        tf = Counter(words)
        impact = {x: math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * c * (k1 + 1) / (c + k1 * (1 - b + b * len(words) / mean)) for x, c in tf.items()}
        full = sum(impact.values())
        stride = 64
        while stride < len(words):
            stride *= 4
        parts = [grams(words_of(p)) for p in split_item(text)]
        for doc, passage, *_ in rows:
            passage = words_of(passage)
            for lo in range(0, max(len(passage), 1), stride):
                window = passage[lo : lo + 2 * stride]
                score = sum(impact[x] for x in set(window) if x in impact) / full
                if score < threshold:
                    continue
                held = {*grams(window), *((x,) for x in window)}
                q, a = (sum(g in held for g in p) / len(p) if p else 1.0 for p in parts)
                if q >= overlap and a >= overlap:
                    out[doc, item] = max(out.get((doc, item), (0.0, 0.0, 0.0)), (score, q, a))
    return out


def test_whole_query_by_definition(spark):
    """Partly copied items around the thresholds, items of several length classes, clashing columns."""
    r = random.Random(12)
    bench = items(25, 9) + [(100 + i, t) for i, (_, t) in enumerate(items(6, 10))] + [(200, " ".join(t for _, t in items(5, 11))), (201, "Word"), (202, "two words")]
    rows = []
    for i in range(150):
        words = [f"k{r.randrange(900)}" for _ in range(r.randrange(200))]
        part = [w if r.random() < 0.9 else "x" for w in r.choice(bench)[1].split() if r.random() < r.choice([0.8, 1.0])]
        at = r.randint(0, len(words))
        rows.append((i, " ".join(words[:at] + part + words[at:])))
    rows += [(500, None), (501, ""), rows[0]]
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    want = brute_leaks(rows, bench)
    assert 30 < len(want)
    for c in ("item_id", "score", "length", "terms", "question_overlap"):
        docs = docs.withColumn(c, docs.text)
    table = table.withColumn("doc_id", table.text).withColumn("score", table.text)
    for how in ({}, {"shard_items": 8}):
        found = {(x.doc_id, x.item_id): (x.score, x.question_overlap, x.answer_overlap) for x in find_leaks(docs, table, **how).collect()}
        assert set(found) == set(want)
        assert all(abs(a - b) < 1e-6 for k in want for a, b in zip(found[k], want[k]))
        assert {x.doc_id for x in decontaminate(docs, table, **how).select("doc_id").collect()} == {i for i, _ in rows} - {i for i, _ in want}


def test_items_split_and_hash():
    assert split_item("What is it? It is that.") == ("What is it?", "It is that.")
    assert split_item("a b c d e f") == ("a b c d", "e f")
    assert split_item("word") == ("word", "")
    assert np.array_equal(hashed("A-b, c"), hashed("a B;c"))

"""Toxicity, language and LM operators: learned parts on held-out rows, base columns against brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from panelith.llm import langid, ppm, toxicity
from panelith.llm.common import Scratch

fold = lambda i, m: zlib.crc32(("" if i is None else str(i)).encode()) % m


def sentence(r, words, n):
    return " ".join(r.choice(words) for _ in range(n))


# Toxicity


def toxic_corpus(n=500, seed=1):
    r = random.Random(seed)
    plain = [f"{a}{b}" for a in ("lo", "mi", "tra", "ken", "su") for b in ("ren", "da", "pol", "tik", "mos", "vel")]
    bad = ["grumf", "blarg", "snorkel"]
    rows, labels = [], []
    for i in range(n):
        toxic = r.random() < 0.25
        words = [r.choice(plain) for _ in range(r.randint(5, 120))]
        for _ in range(max(2, len(words) // 30) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice([*bad, "zorkan" + r.choice(["ia", "sch", "um", "ote", "ix"])]))
        rows.append((i, " ".join(words).capitalize() + ".", "x", 0.5))
        if r.random() < 0.8:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_corpus()
    extra = [(900, None, "x", 0.1), (901, "", "x", 0.1), (902, "word " * 30_000, "x", 0.1), (None, "grumf you blarg", "x", 0.1), rows[0]]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, score string, toxic double")
    marks = spark.createDataFrame([*labels, (None, 1, 1), (800, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs, marks).collect()
    assert len(got) == len(rows) + len(extra)
    by_id = {r.doc_id: r for r in got}
    truth = {i: t for i, _, t in labels}
    held = [i for i in truth if fold(i, 5) == 0]
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert sum(by_id[i].predicted == truth[i] for i in held) >= 0.93 * len(held)
    assert by_id[900].score == by_id[901].score < 0.5
    again = {r.doc_id: r.score for r in toxicity.score_toxicity(docs.select("text", "doc_id"), marks).collect()}
    assert again == {r.doc_id: r.score for r in got}
    none = toxicity.score_toxicity(docs, marks.limit(0)).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), marks).count() == 0


def test_toxicity_of_few_labels(spark):
    """Few labels train without halves, one label alone is the score, and columns may clash."""
    rows, labels = toxic_corpus(300, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, toxic double")
    for c in ("half", "x", "clean", "term", "held_out", "predicted", "label"):
        docs = docs.withColumn(c, docs.text)
    truth = dict((i, t) for i, _, t in labels)
    train = [(i, q, t) for i, q, t in labels if fold(i, 5)]
    few = [x for x in train if x[2]][:7] + [x for x in train if not x[2]][:60]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, frame(few)).collect()}
    mean = lambda t: np.mean([got[i].score for i in truth if truth[i] == t])
    assert len({round(r.score, 6) for r in got.values()}) > 1 and mean(1) > mean(0) + 0.1
    for t in (0, 1):
        assert {r.score for r in toxicity.score_toxicity(docs, frame([x for x in train if x[2] == t])).collect()} == {float(t)}


def test_trees_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    trees = toxicity.Trees().fit(x[:400], y[:400], np.ones(400))
    assert ((trees.margin(x[400:]) > 0) == y[400:]).mean() > 0.9
    a, b = rng.normal(size=80), rng.integers(0, 2, 80).astype(float)
    xs, ys = toxicity.isotonic(a, b, np.ones(80))
    assert (np.diff(ys) >= 0).all()
    order = np.argsort(a)
    fit = np.interp(a[order], xs, ys)
    v = b[order]
    best = [max(min(v[i : j + 1].mean() for j in range(k, 80)) for i in range(k + 1)) for k in range(80)]  # the max-min formula
    assert np.allclose(fit, best)


# Language


def test_language(spark):
    r = random.Random(2)
    syllables = {"aa": ["kel", "tro", "min", "sap"], "bb": ["oui", "eau", "ché", "lle"], "cc": ["ung", "sch", "keit", "über"]}
    rows = [(i, sentence(r, ["".join(r.choices(syllables[k], k=r.randint(1, 3))) for _ in range(50)], r.randint(3, 60)).title(), k) for i, k in enumerate(r.choices(list(syllables), k=300))]
    extra = [(400, None, "aa"), (401, "", None), (402, "12 !? 34", "bb"), (403, "Kel tro " * 20_000, None), (404, "é", None), (None, "ung sch", "cc"), rows[0]]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string")
    got = langid.identify_language(docs).collect()
    assert len(got) == len(rows) + len(extra)
    by_id = {x.doc_id: x for x in got}
    held = [(i, k) for i, _, k in rows if fold(i, 5) == 0]
    assert sum(by_id[i].lang_pred == k for i, k in held) >= 0.97 * len(held)
    assert [by_id[i].lang_pred for i in (400, 401, 402)] == ["und"] * 3
    assert by_id[403].lang_pred == "aa"
    assert all(x.lang_pred in ("aa", "bb", "cc", "und") and 0 <= x.score <= 1 for x in got)
    assert all(x.held_out == (fold(x.doc_id, 5) == 0) for x in got)
    unlearned = langid.identify_language(docs.withColumn("lang", docs.lang.substr(9, 0)).where("lang is null")).collect()
    assert {x.lang_pred for x in unlearned} <= {"und"}
    assert langid.identify_language(docs.limit(0)).count() == 0


def test_backoff_prefers_words_then_longer_grams():
    table = np.array([[-1.0, -9.0], [-5.0, -1.0], [-1.0, -5.0], [-1.0, -1.0]])
    m = langid.Backoff(["a", "b"], {"w": 0}, {"x": 1, "yx": 2, " ": 3}, table, 4)
    assert m.predict("w") == ("a", pytest.approx(1.0, abs=1e-3))
    assert m.predict("x")[0] == "b"
    assert m.predict("yx")[0] == "a"
    assert m.predict("?") == ("und", 0.0)


def slow_language(rows, longest=4):
    """lang_pred of every row by the definition, with plain dictionaries."""
    train = [(k, langid.words_of(t or "")) for i, t, k in rows if i is not None and k is not None and t is not None and fold(i, 5)]
    langs = sorted({k for k, words in train if words})
    counts = {k: [Counter() for _ in range(longest + 1)] for k in langs}
    for k, words in train:
        for kind in range(longest + 1) if words else ():
            for w, n in Counter(words).items():
                if not kind:
                    counts[k][0][w] += n
    for k in langs:
        # N-grams count once for each different word.
        for w in counts[k][0]:
            edged = f" {w} "
            for n in range(1, longest + 1):
                for i in range(max(0, 2 - n), len(edged) - n + 1):
                    counts[k][n][edged[i : i + n]] += 1
    log = lambda k, kind, term: math.log((counts[k][kind][term] + 0.1) / (sum(counts[k][kind].values()) + 0.1 * (len(counts[k][kind]) + 1)))

    def predict(text):
        words = langid.words_of(text or "")
        if not words or not langs:
            return "und"
        total = dict.fromkeys(langs, 0.0)
        for w in words:
            if any(counts[k][0][w] for k in langs):
                for k in langs:
                    total[k] += log(k, 0, w)
                continue
            edged = f" {w} "
            for end in range(2, len(edged) + 1):
                for n in range(min(longest, end), 0, -1):
                    gram = edged[end - n : end]
                    if any(counts[k][n][gram] for k in langs):
                        for k in langs:
                            total[k] += log(k, n, gram)
                        break
        return max(langs, key=lambda k: (total[k], [-ord(c) for c in k]))

    return {i: predict(t) for i, t, _ in rows}


def test_language_by_definition(spark):
    """Every word and n-gram counts, those seen once too."""
    r = random.Random(8)
    syllables = {"aa": ["lo", "ken", "su"], "bb": ["lo", "wich", "ren"], "cc": ["ñi", "su", "wich"]}
    word = lambda k: "".join(r.choice(syllables[k]) for _ in range(r.randint(1, 4)))
    rows = [(i, " ".join(word(k) for _ in range(r.randint(1, 12))), k) for i in range(200) for k in [r.choice("abc") * 2]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_language(docs)
    train = {w for i, t, _ in rows if fold(i, 5) for w in langid.words_of(t)}
    assert set(model.words) == train
    want = slow_language(rows)
    assert {x.doc_id: x.lang_pred for x in langid.identify_language(docs).collect()} == want


def test_language_sample_is_bounded_and_columns_may_clash(spark):
    rows = [(i, "lo " * 10, "aa") for i in range(300)] + [(300 + i, "wich " * 20_000, "bb") for i in range(20)] + [(1, "ken", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for c in ("_id", "_lang", "row", "doc", "kinds", "rate", "name", "size", "held_out", "score"):
        docs = docs.withColumn(c, docs.text)
    got = {(r.lang): r["count"] for r in langid.labelled_sample(docs, 50, 150_000, Scratch(spark, "sample")).groupBy("lang").count().collect()}
    assert got == {"aa": 50, "bb": 1}
    assert langid.identify_language(docs).count() == len(rows)


def test_the_sample_moves_no_text_that_it_leaves(spark):
    rows = [(i, "lo ken", "aa" if i % 3 else "bb") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    plan = langid.labelled_sample(docs, 50, 150_000, Scratch(spark, "sample"))._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


# LM scoring


def slow_ppm(levels, order, text):
    """log10 probability by the definition, one symbol and context at a time."""
    counts = {(k, int(c)): {} for k, (cs, _, _) in enumerate(levels) for c in cs}
    for k, (cs, ss, ns) in enumerate(levels):
        for c, s, n in zip(cs, ss, ns):
            counts[k, int(c)][int(s)] = n

    def distribution(k, context):
        if k < 0:
            return dict.fromkeys(range(257), 1 / 257)
        here = counts.get((k, context), {})
        lower = distribution(k - 1, context & ((1 << (8 * (k - 1))) - 1) if k else 0)
        if not here:
            return lower
        n, d = sum(here.values()), len(here)
        rest = {s: p for s, p in lower.items() if s not in here}
        mass = sum(rest.values())
        escape = d / (n + d) if mass > 1e-12 else 0
        return {**{s: c / n * (1 - escape) for s, c in here.items()}, **{s: p / mass * escape for s, p in rest.items()}}

    data = b"\n" * order + text
    total = 0.0
    for i, s in enumerate([*text, 256]):
        context = int.from_bytes(data[i : i + order], "big")
        k = order
        while (k, context & ((1 << (8 * k)) - 1)) not in counts and k:
            k -= 1
        p = distribution(k, context & ((1 << (8 * k)) - 1))
        assert abs(sum(p.values()) - 1) < 1e-6
        total += math.log10(p[s])
    return total


def lm_rows():
    r = random.Random(3)
    words = ["the", "Thing", "of", "ändern", "token", "x1", "lorem", "ipsum"]
    rows = [(i, sentence(r, words + [f"rare{r.randint(0, 400)}"], r.randint(0, 60)), "h") for i in range(120)]
    return [*rows, (200, None, "h"), (201, "", "h"), (202, "THE\x0bthe unseen", "h"), (None, "null id", "h"), rows[5], (rows[6][0], "other text of the same id", "h"), (203, "the of " * 30_000, "h")]


@pytest.mark.parametrize("hot", [50_000, 20])
def test_lm_base(spark, hot):
    rows = lm_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = ppm.score_texts(docs, order=3, share=400, hot=hot).collect()
    count, end = Counter(), object()
    tokens = [[*(t or "").encode().lower().split(), end] for _, t, _ in rows]
    for (i, _, _), w in zip(rows, tokens):
        if fold(i, 7) != 2:
            count.update(w)
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), fold(i, 7) == 2, len(w), sum(count[t] > 0 for t in w), n, round(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in w), 6)) for (i, _, _), w in zip(rows, tokens))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_partial_matching_equals_definition(spark):
    rows = lm_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    texts = [t for i, t, _ in rows if fold(i, 7) != 2]
    trie = ppm.fit_trie(spark.createDataFrame([(t or "",) for t in texts], "text string"), ppm.Scratch(spark, "test"), order=3, share=400)
    got = {(r.doc_id, r.n_tokens): r.score for r in ppm.score_texts(docs, order=3, share=400).collect()}
    for i, t, _ in rows:
        if t is not None and len(t) < 300:
            want = slow_ppm(trie.levels, 3, t.encode())
            assert got[i, len(t.encode().split()) + 1] == pytest.approx(want, rel=1e-4, abs=1e-4)
    assert got[203, 60_001] > 0.6 * 210_000 * math.log10(1 / 257)


def test_lm_keeps_contexts_of_any_share(spark):
    """One context of five bytes in some 250000 positions, below the least share that once was kept."""
    ids = [i for i in range(400) if fold(i, 7) != 2][:130]
    held = next(i for i in range(400) if fold(i, 7) == 2)
    texts = ["ab " * 650] * 128 + ["wxyzvq", "pxyzvr"]
    rows = [*zip(ids, texts), (held, "wxyzvq")]
    got = {r.doc_id: r.score for r in ppm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), batch_bytes=50_000).collect()}
    levels = []
    for k in range(6):
        count = Counter()
        for t in texts:
            data = b"\n" * k + t.encode()
            for i, s in enumerate([*t.encode(), 256]):
                count[int.from_bytes(data[i : i + k], "big"), s] += 1
        levels.append(tuple(zip(*((c, s, n) for (c, s), n in count.items()))))
    for i, t in rows[-3:]:
        assert got[i] == pytest.approx(slow_ppm(levels, 5, t.encode()), rel=1e-6)
    assert got[held] == pytest.approx(got[ids[128]])


def test_lm_empty(spark):
    schema = "doc_id long, text string"
    assert ppm.score_texts(spark.createDataFrame([], schema)).count() == 0
    held = next(i for i in range(100) if fold(i, 7) == 2)
    only = ppm.score_texts(spark.createDataFrame([(held, "a b")], schema)).first()
    assert (only.n_tokens, only.n_known, only.train_tokens) == (3, 0, 0)
    assert only.score == pytest.approx(4 * math.log10(1 / 257), rel=1e-6)
    assert only.base_score == 0.0

import re
from collections import Counter

import numpy as np

from panelith.llm.quality import bound_states, content_share, keep_good, quality_rules, text_lines, train_crf, train_lines, viterbi

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside), failed


def prose(i, n=80):
    return "\n".join(" ".join(f"word{i}x{j}" for j in range(a, a + 10)).capitalize() + "." for a in range(0, n, 10))


def junk(i, n=80):
    return "\n".join(" ".join(f"WORD{i}Q{j}***" for j in range(a, a + 10)) for a in range(0, n, 10))


def tables(spark):
    texts = [prose(i) for i in range(40)] + [junk(i) for i in range(40)]
    texts += [None, "", "a b\x0bc\n\na b\x0bc", "é " * 60, "one two three four " * 30, prose(99, 20_000), prose(1) + "\n" + junk(1), "l1 x\nl1 x\n l1 x"]
    docs = spark.createDataFrame([(i, t, "s", i) for i, t in enumerate(texts)], "doc_id long, text string, kept string, n_words long")
    labels = spark.createDataFrame([(i, int(i < 40), 0) for i in range(0, 80, 2)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    return texts, docs, labels


def test_base_counts_and_verdicts(spark):
    texts, docs, labels = tables(spark)
    rows = {r.doc_id: r for r in quality_rules(docs, labels).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t), i
        if i < 80:
            assert r.kept == (i < 40)
        assert not (r.base_failed and r.kept)


def test_filter_keeps_whole_rows(spark):
    _, docs, labels = tables(spark)
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect() if r.doc_id < 80} == set(range(40))
    assert keep_good(docs.limit(0), labels).count() == 0
    assert keep_good(docs, labels.limit(0)).count() > 40  # no labels: only the base rules reject


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 8):
        emit, trans = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        best = max(range(2**n), key=lambda m: sum(emit[i, m >> i & 1] for i in range(n)) + sum(trans[m >> i & 1, m >> (i + 1) & 1] for i in range(n - 1)))
        assert viterbi(emit, trans).tolist() == [best >> i & 1 for i in range(n)]


def test_training_separates_lines():
    good, bad = [np.array(text_lines(prose(i).encode())[0]) for i in range(10)], [np.array(text_lines(junk(i).encode())[0]) for i in range(10)]
    w, t = train_crf(good + bad, [np.ones(len(s), int) for s in good] + [np.zeros(len(s), int) for s in bad])
    mixed = text_lines((prose(50) + "\n" + junk(50)).encode())
    assert 0.3 < content_share(mixed[0], mixed[1], w, t) < 0.7
    assert content_share([], [], w, t) == 0.0


def test_latent_states_change_within_texts():
    """Documents of both labels mix prose and junk; the share follows the prose that is planted."""
    def lines(text):
        rows, sizes, _ = text_lines(text.encode())
        return np.array(rows), np.array(sizes, float)

    good = [lines(prose(200 + i, 80) + "\n" + junk(200 + i, 10 * (i % 3))) for i in range(30)]
    bad = [lines(prose(100 + i, 10 + 10 * (i % 2)) + "\n" + junk(100 + i, 80)) for i in range(30)]
    w, t = train_lines([x for x, _ in good + bad], [c for _, c in good + bad], [1] * 30 + [0] * 30)
    shares = []
    for k in range(9):
        rows, sizes, _ = text_lines((prose(500, 10 * k) + "\n" + junk(500, 10 * (8 - k))).encode())
        shares.append(content_share(rows, sizes, w, t))
        assert abs(shares[-1] - sum(sizes[:k]) / sum(sizes)) < 1e-9
    assert shares == sorted(shares) and len(set(shares)) == 9


def test_bound_states_are_the_least_change():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 12))
        emit, trans, sizes = rng.normal(size=(n, 2)), rng.normal(size=(2, 2)), rng.integers(1, 9, n).astype(float)
        for label in (0, 1):
            path = bound_states(emit, trans, sizes, label)
            assert (path @ sizes * 2 >= sizes.sum()) if label else (path @ sizes * 2 <= sizes.sum())


def test_clashing_columns(spark):
    _, docs, labels = tables(spark)
    for c in ("quality", "toxic", "doc", "id", "x", "sizes", "content_share"):
        docs = docs.withColumn(c, docs.n_words.cast("string"))
    assert quality_rules(docs, labels).count() == docs.count()
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect() if r.doc_id < 80} == set(range(40))

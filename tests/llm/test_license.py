import random
import re
import string

import pytest

from panelith.llm.license import PHRASES, TEMPLATES, oracle, scan_licenses

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = [(i, label) for i in range(len(words)) for p, label in PHRASES.items() if tuple(words[i : i + len(p)]) == p]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def texts():
    r = random.Random(6)
    pieces = ["CC BY", "cc-by-nc", "General Public License", "all rights reserved", "ALL RIGHTS", "reserved.", "cc", "by", "Éa", "naïve", "the", "license", "general public"]
    out = [None, "", "...", "cc by", "by cc by", "all rights reserved all rights reserved", "cc BY"]
    out += [" ".join(r.choice(pieces) for _ in range(r.randint(1, 40))) for _ in range(80)]
    out.append("word " * 40_000 + "All rights reserved")
    return out


def test_base(spark):
    rows = [(i, t, "l", 1.0) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows + rows[3:5], "doc_id long, text string, labels string, score double")
    summary = scan_licenses(docs)[0].collect()
    assert len(summary) == len(rows) + 2
    for r in summary:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(texts()[r.doc_id]), r.doc_id
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1


def test_templates_are_found_with_gaps_and_insertions(spark):
    names = [n for n, t in TEMPLATES.items() if len(t.split()) >= 12]
    r = random.Random(7)
    noise = lambda n: " ".join(f"n{r.randint(0, 500)}" for _ in range(n))
    rows = []
    for i, n in enumerate(names):
        words = TEMPLATES[n].split()
        words.insert(len(words) // 2, "extra")
        rows.append((i, f"{noise(30)} {' '.join(words).upper()}, {noise(20)}"))
    rows += [(100 + i, noise(200)) for i in range(20)] + [(200, " ".join(TEMPLATES[names[0]].split()[::-1])), (None, TEMPLATES[names[1]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    summary, spans = scan_licenses(docs)
    got = {x.doc_id: x.labels.split(",") for x in summary.collect()}
    for i, n in enumerate(names):
        assert n in got[i]
    assert all(got[100 + i] == [""] for i in range(20))
    assert names[1] in got[None]
    s = {(x.doc_id, x.label): x for x in spans.collect()}
    assert s[0, names[0]].first_word == 30
    assert s[0, names[0]].end_word == 30 + len(TEMPLATES[names[0]].split()) + 1


def test_spans_are_verified_word_by_word(spark):
    texts = ["licensed under the licensed under cc by by sa 4", "Licensed under CC BY-SA 4.0.", "licensed under cc by sa x 4 0", "licensed under cc by cc by sa 4 0", "under cc by sa 4 0 licensed", "released under the MIT license", "released under mit license"]
    got = [r.labels for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))[0].orderBy("doc_id").collect()]
    assert got == ["cc-by", "cc-by,cc-by-sa-4.0", "cc-by", "cc-by", "cc-by,cc-by-sa-4.0", "mit-line", ""]


def test_result_equals_sql(spark):
    """The whole summary against SQL, with damaged templates in noise and columns that clash."""
    duckdb = pytest.importorskip("duckdb")
    r = random.Random(11)
    rows = []
    for i in range(300):
        words = []
        for _ in range(r.randint(0, 4)):
            part = TEMPLATES[r.choice(list(TEMPLATES))].split()
            for _ in range(r.choice([0, 0, 1, 2, 5, 20])):
                at = r.randrange(len(part))
                part[at : at + r.randint(0, 2)] = r.choice([["x"], [], part[:2]])
                part = part or ["x"]
            words += part + ["n"] * r.randint(0, 3)
        rows.append((i, r.choice([" ", "-", ". "]).join(words).upper() if i % 7 else None))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    documents = frame.toArrow()  # noqa: F841 (read by the SQL)
    for c in ("th", "words", "label", "labels", "name", "wanted", "s_doc", "k_doc", "votes", "_slot", "_bits"):
        frame = frame.withColumn(c, frame.text)
    want = duckdb.sql(oracle()).fetchall()
    got = scan_licenses(frame)[0].collect()
    assert sorted(map(str, got and [tuple(x) for x in got])) == sorted(map(str, want))
    assert len({x.labels for x in got}) > 20


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert scan_licenses(docs)[0].count() == 0

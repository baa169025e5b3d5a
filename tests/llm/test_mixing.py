import math
import random

import pytest

from panelith.llm.mixing import mix_sources, source_targets


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, taken int")


def corpus(n=400):
    r = random.Random(5)
    rows = []
    for i in range(n):
        s = r.choice(["hot"] * 8 + ["a", "b", "é", "Z", None])
        rows.append((i, r.choice([None, "", " \x0b\n"]) if r.random() < 0.05 else " ".join(["w"] * r.randint(1, 40)), s, "x", 1))
    rows += [(n, "w " * 50_000, "long", "x", 1), (n + 1, "w", "tiny", "x", 1), (n + 2, None, "void", "x", 1)]
    return rows + rows[:5]


def fill(sizes):
    """Targets by bisection on the common unit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, lo, hi = sum(sizes.values()), 0.0, 1e9
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(min(weight[s] * mid, 3 * sizes[s]) for s in names) < total:
            lo = mid
        else:
            hi = mid
    return {s: min(weight[s] * hi, 3 * sizes[s]) for s in names}


@pytest.mark.parametrize("bucket_rows", [5, 20_000])
def test_mix(spark, bucket_rows):
    rows = corpus()
    got = mix_sources(docs(spark, rows), bucket_rows=bucket_rows).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    targets = fill(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source], rel=1e-6)
        assert 0 <= r.taken <= 3 * r.size
        epochs = math.floor(math.floor(r.target) / r.source_size) if r.source_size else 0
        assert epochs * r.size <= r.taken <= (epochs + 1) * r.size  # complete epochs come first
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in targets.items():
        assert t - 1 <= taken[s] <= t + 1e-6
    again = mix_sources(docs(spark, rows[::-1]), bucket_rows=7).collect()
    key = lambda rs: sorted((r.doc_id, r.taken) for r in rs)
    assert key(got) == key(again)


def test_weights_favour_clean_text(spark):
    rows = [(i, "good plain words here " * 5 if i % 2 else "#b&a$d* |w%o|r<d>s! " * 5, "s" if i < 4000 else "t", "x", 1) for i in range(8000)]
    got = mix_sources(docs(spark, rows)).where("source = 's'").collect()
    share = lambda odd: sum(r.taken for r in got if r.doc_id % 2 == odd) / sum(r.size for r in got if r.doc_id % 2 == odd)
    assert share(1) > share(0) + 0.1


def test_edges(spark):
    assert mix_sources(docs(spark, [])).count() == 0
    only = mix_sources(docs(spark, [(1, "a b c", None, "x", 1), (None, "d", None, "x", 1)])).collect()
    assert sorted(r.taken for r in only) == [1, 3]
    assert [r.taken for r in mix_sources(docs(spark, [(1, None, "s", "x", 1)])).collect()] == [0]


def test_water_filling_orders_by_code_point(spark):
    totals = spark.createDataFrame([("\U0001f600", 100), ("￮", 100), (None, 100), ("a", 100)], "source string, source_size long")
    assert [s for s, _, _ in source_targets(totals)] == ["a", "￮", "\U0001f600", None]


def test_result_equals_sql(spark, tmp_path):
    """The whole result against one window per source; ids repeat or are null, and columns clash."""
    duckdb = pytest.importorskip("duckdb")
    from panelith.llm.mixing import ORACLE

    r = random.Random(9)
    rows = [(i if r.random() < 0.9 else None, ("#!" if r.random() < 0.4 else "") + " ".join(r.choice(["w", "ä#", "x!!", "|"]) for _ in range(r.randint(0, 30))), r.choice(["hot"] * 6 + ["a", "é", None, "b"])) for i in range(1500)]
    rows += [(7, "other text", "hot"), (7, None, "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    documents = frame.toArrow()  # noqa: F841 (read by the SQL)
    for c in ("src", "bucket", "key", "tie", "weight", "name", "size", "b", "s"):
        frame = frame.withColumn(c, frame.text)
    got = sorted(map(str, ((x.doc_id, x.size, x.source_size, round(x.target, 6), x.taken, x.source, x.epochs) for x in mix_sources(frame, bucket_rows=20).collect())))
    want = duckdb.sql(ORACLE).select("doc_id, size, source_size, target, taken, source, epochs").fetchall()
    assert got == sorted(map(str, ((i, a, b, round(t, 6), c, s, e) for i, a, b, t, c, s, e in want)))

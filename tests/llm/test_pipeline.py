import random
import re

import corpus_pipeline

from .test_jaccard import brute


def write(spark, folder, rows, labels, bench):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline(spark, tmp_path):
    r = random.Random(9)
    words = [f"word{i}" for i in range(3000)]
    line = lambda n: " ".join(r.choices(words, k=n)).capitalize() + "."
    prose = lambda: "\n".join(line(r.randint(8, 20)) for _ in range(8))
    bench = [(i, line(25) + " " + line(8)) for i in range(6)]
    rows, labels = [], []

    def put(text, quality=None, source="s"):
        rows.append((len(rows), text, "en", source, len(text or "")))
        if quality is not None:
            labels.append((len(rows) - 1, quality, 0))
        return len(rows) - 1

    good = [put(prose(), 1) for _ in range(40)]
    bad = [put("\n".join(line(12).upper().replace(" ", "!! ") for _ in range(8)), 0) for _ in range(20)]
    base = prose()
    copies = [put(base), put(base), put(base.replace(base.split()[5], "changed")), put(base + " tail")]
    leak = [put(prose() + "\n" + bench[2][1] + "\n" + prose())]
    secret = [put(prose() + " password=0123456789abcdef01 " + prose(), source=None)]
    failed = [put(None), put(""), put("too short")]
    write(spark, str(tmp_path), rows, labels, bench)

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == names
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = {x.doc_id: x for x in docs.collect()}
    assert set(kept["quality"]) == set(range(len(rows))) - set(bad) - set(failed)
    texts = [kept["quality"][i].text for i in sorted(kept["quality"])]
    _, parts, _ = brute([re.sub(r"\s+", " ", t) for t in texts], 5, 80, 100)
    assert set(kept["near_duplicates"]) == {i for k, (i, p) in enumerate(zip(sorted(kept["quality"]), parts)) if k == p}
    assert set(copies) & set(kept["near_duplicates"]) == {copies[0]}
    assert set(kept["near_duplicates"]) - set(kept["decontamination"]) == set(leak)
    assert set(kept["secrets"]) == set(kept["decontamination"])
    assert "0123456789abcdef01" not in kept["secrets"][secret[0]].text
    assert set(good) <= set(kept["secrets"])

    out = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == set(kept["secrets"])
    for i, x in out.items():
        assert x.size == len(kept["secrets"][i].text.split())
        assert 0 <= x.taken <= 3 * x.size
    assert abs(sum(x.taken for x in out.values()) - sum(x.size for x in out.values())) <= 2


def test_pipeline_over_empty_tables(spark, tmp_path):
    write(spark, str(tmp_path), [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

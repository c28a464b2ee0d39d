"""The pipeline stage by stage, each against its definition on the input it got."""

from collections import Counter

import corpus_pipeline
from llm.test_decontamination import brute as contaminated
from llm.test_jaccard import brute as near
from llm.test_wavelet_tokens import brute as encoded

FOLDER = "/root/testdata/sf0.001"


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages(spark, tmp_path):
    docs, seen = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        path = f"file://{tmp_path}/{k}"
        out.write.parquet(path)
        seen.append((docs, spark.read.parquet(path)))
        docs = seen[-1][1]
    columns = seen[0][0].columns
    assert all(after.columns == columns for _, after in seen[:-1]) and 4 <= len(seen) <= 5

    before, after = map(rows_of, seen[0])
    assert after <= before
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    good = [r[0] for r in before if labels.get(r[0]) == 1]
    assert sum(r[0] in set(good) for r in after) >= 0.97 * len(good)

    before, after = map(rows_of, seen[1])
    classes = {r[0]: r[1] for r in near([(r[0], r[1]) for r in before.elements()])}
    assert sorted(r[0] for r in after.elements()) == sorted(set(classes.values())) and after <= before

    before, after = map(rows_of, seen[2])
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    hit = {r[0] for r in contaminated([(r[0], r[1]) for r in before.elements()], items) if r[-1]}
    assert after == Counter({r: n for r, n in before.items() if r[0] not in hit})

    before, after = map(rows_of, seen[3])
    assert set(after) <= set(before) and max(after.values()) <= 2
    words = lambda c: sum(len((r[1] or "").split()) * n for r, n in c.items())
    assert abs(words(after) - 1.5 * words(before)) <= 0.1 * words(before)

    before = sorted((r[0], r[1]) for r in rows_of(seen[4][0]).elements())
    assert sorted(tuple(r) for r in seen[4][1].collect()) == sorted(encoded(before))


def test_run_equals_the_stages(spark):
    found = corpus_pipeline.run(spark, FOLDER)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and found.count() > 100

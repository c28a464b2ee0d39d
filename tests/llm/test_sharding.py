import zlib
from collections import Counter, defaultdict

from assayer.llm import splitter_sharding as S


def check(rows, texts, shards=24):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
        assert r.law == "bytes" and r.grown_shard is None
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in texts)
    for v in by.values():
        assert sorted(r.slot for r in v) == list(range(len(v)))
    total, largest = sum(r.size for r in rows), max(r.size for r in rows)
    for s in range(shards):
        assert abs(sum(r.size for r in by.get(s, [])) - total / shards) <= 2 * max(largest, S.WHOLE_GROUP * total / shards) + 1


def test_sizes_slots_and_reruns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = S.shard(docs).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    again = S.shard(docs.repartition(7), least_ranges=5, samples=2, overfull=1.01).collect()  # the sample only bounds the work
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in rows}
    where = defaultdict(set)
    for r in rows:
        where[r.text_crc32].add(r.shard)
    assert sum(len(v) > 1 for v in where.values()) <= 3


def test_hot_text_is_cut(spark):
    rows = [(i, "the same text " * 20) for i in range(3000)] + [(5000 + i, f"text {i} " * (1 + i % 40)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(S.shard(docs, least_ranges=200).collect(), rows)
    assert len(S.chosen([(7 << 24 | k, 1, 0.0) for k in range(1000)], 10)) == 9  # one text, many ranges


def test_edge_cases(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "é" * 50_000), (4, "a"), (4, "a"), (None, "b"), (None, None), (-5, "z")]
    docs = spark.createDataFrame([(a, b, 1, "k") for a, b in rows], "doc_id long, text string, size int, key string")
    check(S.shard(docs).collect(), rows)
    assert S.shard(docs.limit(0)).count() == 0
    S.write(docs, f"file://{tmp_path}/shards", shards=3)
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter(rows)

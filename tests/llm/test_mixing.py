from collections import defaultdict

from pyspark.sql import functions as F

from assayer.llm import weighted_mixing as M


def waterfill(sizes, weights, total, most=2.0):
    """Shares by weight, cut at the caps, the excess shared anew until none is above."""
    cap, open_ = {}, dict(weights)
    while True:
        rest = total - sum(cap.values())
        share = {s: rest * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return cap | share
        for s in over:
            cap[s] = most * sizes[s]
            del open_[s]


def check(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    sizes = {s: sum(r.size for r in v) for s, v in by.items()}
    names = sorted((s for s in by if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in by)
    goal = waterfill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()))
    for s, v in by.items():
        assert all(r.source_size == sizes[s] and abs(r.target - goal[s]) < 1e-6 * max(1, goal[s]) for r in v)
        assert all(r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in v)
        assert abs(sum(r.taken for r in v) - goal[s]) <= max(r.size for r in v) / 2 + 1e-6


def test_query_matches_sql(twin):
    assert len(twin("op6_mixing")) == 200


def test_targets_and_budgets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = M.mix(docs, bucket_rows=7).collect()
    check(rows)
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in M.mix(docs.repartition(3)).collect())
    assert M.mixed_rows(docs).count() == sum(r.taken // r.size for r in rows if r.size)


def test_crowded_bucket_is_cut_until_it_is_small(spark, monkeypatch):
    docs = spark.range(6_000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', 20 + CAST(id % 17 AS INT))").alias("text"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.when(F.col("id") % 2 > 0, "small")).alias("source"))
    sorted_, around = [], M.around_the_cuts

    def seen(*args):
        edge, full = around(*args)
        sorted_.append([r["count"] for r in edge.groupBy("source").count().collect()])
        return edge, full
    monkeypatch.setattr(M, "around_the_cuts", seen)
    found = {n: M.mix(docs, weight=F.lit(0.1), share=0.6123, bucket_rows=n).collect() for n in (5, 6_000)}
    assert len(sorted_) == 2 and sorted_[0] and max(sorted_[0]) <= 5 < 1000 <= max(sorted_[1])
    taken = [sorted((r.doc_id, r.taken) for r in rows) for rows in found.values()]
    assert taken[0] == taken[1]


def test_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x " * 50_000, "b"), (4, "one two", None), (4, "one two", None), (None, "three", None), (6, "é z", "É"), (7, "w", "b")]
    rows += [(i, "a few words here", "hot") for i in range(8, 60)]
    docs = spark.createDataFrame([(a, b, c, 5, 1.0) for a, b, c in rows], "doc_id long, text string, source string, size int, Target double")
    found = M.mix(docs, bucket_rows=3).collect()
    assert len(found) == len(rows)
    check(found)
    assert M.mix(docs.limit(0)).count() == 0
    nothing = M.mix(docs.filter("text is null")).collect()
    assert [(r.taken, r.target) for r in nothing] == [(0, 0.0)]

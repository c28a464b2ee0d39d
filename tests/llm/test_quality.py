import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from assayer.llm import kneser_ney_quality as Q


def brute(train, texts):
    """Interpolated modified Kneser-Ney by its definition, on word strings."""
    lines = [["<s>", "<s>", *t.split(), "</s>"] for t in train]
    c3 = Counter(tuple(x[i - 2:i + 1]) for x in lines for i in range(2, len(x)))
    c2 = Counter((b, c) for _, b, c in c3)
    c1 = Counter(c for _, c in c2)

    def parts(counts):
        n = Counter(counts.values())
        n1, n2, n3, n4 = (max(1, n[k]) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = [min(max(v, .05), k - .05) for k, v in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]
        off = {g: d[min(c, 3) - 1] for g, c in counts.items()}
        total, left = defaultdict(float), defaultdict(float)
        for g, c in counts.items():
            total[g[:-1]] += c
            left[g[:-1]] += off[g]
        return counts, off, total, left

    m3, m2, m1 = parts(c3), parts(c2), parts({(w,): c for w, c in c1.items()})

    def p(model, gram, lower):
        counts, off, total, left = model
        if gram[:-1] not in total:
            return lower
        return max(0, counts.get(gram, 0) - off.get(gram, 0)) / total[gram[:-1]] + left[gram[:-1]] / total[gram[:-1]] * lower

    out = []
    for t in texts:
        x, nll = ["<s>", "<s>", *t.split(), "</s>"], 0.0
        for i in range(2, len(x)):
            low = p(m1, (x[i],), 1 / (len(c1) + 1))
            nll -= math.log10(p(m3, tuple(x[i - 2:i + 1]), p(m2, tuple(x[i - 1:i + 1]), low)))
        out.append(nll)
    return out


def test_model_equals_definition(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    model = Q.fit(spark.createDataFrame([(t,) for t in texts[:40]], "text string").repartition(3))

    class Held:
        def __init__(self, value):
            self.value = value
    for shards in (1, 5):
        score = Q.Scorer([Held(x) for x in Q.cut(model, shards)], float(model["unknown"][1][0]))
        words, nll = score(pa.array(texts[30:60] + ["", None]))
        assert words.tolist() == [len(t.split()) for t in texts[30:60]] + [0, 0]
        assert np.allclose(nll, brute(texts[:40], texts[30:60] + ["", ""]), rtol=1e-9)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = Q.judge(docs, labels, slim=True).join(labels, "doc_id")
    rates = {r.quality: r.k for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("k")).collect()}
    assert rates[1] > 0.99 and rates[0] < 0.2, rates


def test_small_tables_reject_too(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = Q.judge(docs, labels, slim=True).join(labels, "doc_id")
    assert got.filter("threshold IS NULL").count() == 0
    rates = {r.quality: r.k for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("k")).collect()}
    print(rates)
    assert rates[1] > 0.97 and rates[0] < 0.3, rates


def test_sample_leaves_out_held_and_long_texts(spark):
    docs = spark.createDataFrame([(i, "a b c d", "en" if i % 4 else None) for i in range(40)] + [(100 + i, "w " * 200, "en") for i in range(10)], "doc_id long, text string, lang string")
    marks = docs.select(F.col("doc_id").alias("id"), F.lit(True).alias("trusted"))
    everything = {r.id for r in Q.training_sample(docs, marks, "doc_id", "text", "lang", 100, 10_000).collect()}
    assert len(everything) == 40 and any(i % 4 == 0 and i < 40 for i in set(range(40)) - everything)
    assert {r.id for r in Q.training_sample(docs, marks, "doc_id", "text", "lang", 100, 199).collect()} == {i for i in everything if i < 100}
    assert Q.training_sample(docs, marks, "doc_id", "text", "lang", 7, 10_000).count() == 7


def test_edge_cases(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, " \n ", None), (4, "the cat sat", "en"), (4, "the cat sat", "en"), (None, "the cat", None), (5, "zzz qqq", "xx"), (6, "the cat " * 40_000, "en")]
    docs = spark.createDataFrame([(a, b, c, 1.5, "k") for a, b, c in rows], "doc_id long, text string, lang string, N_Words double, kept string")
    labels = spark.createDataFrame([(4, 1, 0), (6, 1, 0), (5, 0, 0), (5, 1, 0), (9, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = Q.judge(docs, labels)
    assert found.columns == ["doc_id", "text", "lang", "n_words", "perplexity", "threshold", "kept"]
    got = found.collect()
    assert len(got) == len(rows) and all(r.kept for r in got if r.doc_id in (4, 6)) and not any(r.kept for r in got if not (r.text or "").strip())
    assert Q.judge(docs.limit(0), labels).count() == 0
    assert Q.judge(docs, labels.limit(0)).filter("kept").count() == 5
    assert Q.keep_good(docs, labels.limit(0)).count() == 5


def test_all_trusted_rows_are_learnt(spark):
    """Every trusted row with words, but each fifth by language, whatever their number."""
    docs = spark.range(6000).selectExpr("id AS doc_id", "if(id % 10 = 0, '', concat('w', id % 7, ' b')) AS text", "if(id % 3 = 0, 'fr', if(id % 3 = 1, 'en', NULL)) AS lang")
    docs = docs.unionByName(docs.filter("doc_id = 7").withColumn("lang", F.lit("fr")))  # an id that is in two languages
    marks = spark.range(6000).selectExpr("id", "id % 4 <> 0 AS trusted")
    got = sorted(r.id for r in Q.ids_to_learn(docs, marks, "doc_id", "text", "lang").collect())
    rows = {(("=" + r.lang) if r.lang else "null", hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.doc_id) for r in docs.collect() if r.doc_id % 4 and r.text}
    held = {r[2] for place, r in enumerate(sorted(rows), 1) if place % Q.HELD == 2}
    assert got == sorted({r[2] for r in rows} - held) and len(got) > 2500


def test_joined_model_equals_the_broadcast_one(spark, monkeypatch):
    monkeypatch.setattr(Q, "HEAD", 300)
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(400)
    docs = docs.unionByName(docs.limit(30)).unionByName(docs.limit(3).withColumn("text", F.lit(None).cast("string"))).persist()
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    for slim in (True, False):
        one, other = (sorted(tuple(r) for r in Q.judge(docs, labels, slim=slim, held_words=n).select("doc_id", "lang", "n_words", "perplexity", "threshold", "kept").collect()
                             if r.n_words or r.perplexity is None) for n in (10**9, 0))
        assert len(one) == 433 and [r[:3] + r[5:] for r in one] == [r[:3] + r[5:] for r in other]
        assert all(a[k] is b[k] is None or math.isclose(a[k], b[k], rel_tol=1e-9) for a, b in zip(one, other, strict=True) for k in (3, 4))


def test_a_large_model_travels_as_packed_triples(spark, monkeypatch):
    """Word triples are shuffled as places among a chunk's words, in buckets of their middle word; hot words are cut; copies are learnt as often as they stand."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300).select("doc_id", "text", "lang")
    docs = docs.unionByName(docs.limit(20)).unionByName(docs.limit(10).withColumn("doc_id", F.col("doc_id") + 10**9)).persist()
    labels = docs.select("doc_id", (F.col("doc_id") % 4 != 1).cast("int").alias("quality")).distinct()
    monkeypatch.setattr(Q, "HEAD", 200)
    monkeypatch.setattr(Q, "BUCKET_WORDS", 1000)
    monkeypatch.setattr(Q, "CHUNK_BYTES", 100_000)
    texts = Q.marked(docs, labels.select(F.col("doc_id").alias("id")).limit(100), "doc_id", "text")
    dealt = Q.dealing(texts)
    rows = Q.packed(texts, spark.sparkContext.broadcast(dealt), 0, 1).collect()
    assert len(dealt.hot) and max(dealt.parts) > 1 and len({r.b for r in rows}) > 20
    for chosen in ({}, {"train_rows": 10**6}):
        want = {(r.doc_id, r.lang): r for r in Q.judge(docs, labels, slim=True, held_words=10**9, **chosen).collect()}
        got = Q.judge(docs, labels, slim=True, held_words=0, **chosen).collect()
        assert len(got) == 330
        for r in got:
            one = want[r.doc_id, r.lang]
            assert (r.n_words, r.kept) == (one.n_words, one.kept) and all(a is b is None or math.isclose(a, b, rel_tol=1e-9) for a, b in ((r.perplexity, one.perplexity), (r.threshold, one.threshold)))
    monkeypatch.undo()
    rows = Q.packed(texts, spark.sparkContext.broadcast(Q.dealing(texts)), 0, 1).collect()
    places = sum(r.n_triples for r in rows)
    assert places == docs.dropDuplicates(["text"]).filter("text IS NOT NULL").select(F.sum(F.regexp_count("text", F.lit(Q.WORDS)) + 1)).first()[0]
    assert sum(len(r.words) + len(r.triples) + len(r.names) for r in rows) < 10 * places  # a row of three words and a count was 32 bytes

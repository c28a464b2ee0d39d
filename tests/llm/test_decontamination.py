import hashlib
import re

from pyspark.sql import functions as F

from assayer.llm import suffix_decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    out = []
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(window, len(v))
            for i in range(len(v) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j:j + n] == v[i:i + n]:
                        hit.update(range(j, j + n))
                        names.add(str(item))
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=repr)


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    expected = brute([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert got(D.decontaminate(docs, items)) == expected
    assert got(D.decontaminate(docs, items, block_bytes=2000)) == expected  # several blocks of the test set
    assert any(r[5] for r in expected) and not all(r[5] for r in expected)


def test_edge_cases(spark):
    long = "x y " * 40_000
    rows = [(1, None), (2, ""), (3, "One two THREE four-five"), (3, "One two THREE four-five"), (None, "deux Éa five"), (5, long + "a b c d e f g h i j k"),
            (6, "a b c d e f g h i"), (7, "k a b c d e f g h i j a b c d e f g h i j"), (8, "é" * 3000), (9, "  \n ")]
    items = [(1, "two three"), (2, "a b c d e f g h i j k"), (3, None), (4, ""), (2, "five"), (None, "Éa five"), (10, "a b c d e f g h i j")]
    docs = spark.createDataFrame([(a, b, "x", 7) for a, b in rows], "doc_id long, text string, matches string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = D.decontaminate(docs, bench)
    assert found.columns[:2] == ["doc_id", "text"] and len(found.columns) == 2 + len(D.ADDED)
    assert got(found) == brute(rows, [("" if a is None else a, b) for a, b in items])
    spans = {r.doc_id: r.matches for r in found.filter("doc_id = 5").collect()}
    assert [(m.item, m.doc_word, m.item_word, m.words) for m in spans[5]] == [("10", 80000, 0, 10), ("2", 80000, 0, 11)]
    assert D.decontaminate(docs.limit(0), bench).count() == 0
    assert not D.decontaminate(docs, bench.limit(0)).filter(F.col("contaminated")).count()
    assert sorted(r.doc_id for r in D.clean(docs, bench).collect()) == [1, 2, 6, 8, 9]


def test_query_is_whole(spark):
    import __spark_entry__ as entry
    assert entry.queries()["op7_decontamination"](spark, "/root/testdata/sf0.001").count() == 200


def test_query_matches_sql(twin):
    assert len(twin("op7_decontamination")) == 200

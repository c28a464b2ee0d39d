import re
from collections import Counter

import numpy as np
import pytest

from assayer.llm import forest_jaccard as J
from assayer.llm.components import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, threshold=0.8):
    """All pairs by definition: id -> (class, linked documents, linked texts, copies), by row."""
    sets = [grams(t) for _, t in rows]
    n = len(rows)
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    out = []
    linked = [[] for _ in rows]
    for i in range(n):
        for j, common in Counter(j for g in sets[i] for j in where[g] if j > i).items():
            if common * 10 >= round(threshold * 10) * (len(sets[i]) + len(sets[j]) - common):
                linked[i].append(j)
                linked[j].append(i)
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i in range(n):
        groups.setdefault(root(i), []).append(i)
    for i in range(n):
        ids = [rows[j][0] for j in groups[root(i)] if rows[j][0] is not None]
        other = [j for j in linked[i] if sets[j] != sets[i]]
        out.append((rows[i][0], min(ids, default=None), len(linked[i]), len({sets[j] for j in other}), len(linked[i]) - len(other)))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "class_id", "n_links", "n_text_links", "n_copies").collect()), key=repr)


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_depth_is_shortened_to_the_recall():
    assert J.depth_for(0.8, 32, 0.999, 12) == 7 and J.depth_for(0.8, 32, 0.9, 12) > 7 and J.depth_for(0.95, 32, 0.999, 12) == 12
    with pytest.raises(ValueError):
        J.depth_for(0.8, 1, 0.999, 12)


@pytest.mark.parametrize("block", [1_000_000, 1500])
def test_against_brute_force(spark, block):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    expected = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got(J.join(docs, block_shingles=block)) == expected
    assert sum(r[3] > 0 for r in expected) > 10


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(400):
        w = list(base)
        for p in rng.integers(0, 120, k % 5):
            w[p] = f"x{k}y{p}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute(rows)
    found = got(J.join(docs, block_shingles=5000))
    assert found == expected and max(r[3] for r in found) > 100


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " . "), (4, "one two"), (5, "One, two!"), (6, "one two three"), (7, "a b c d e f g h i j"), (7, "a b c d e f g h i j"), (None, "a b c d e f g h i j"),
            (None, "only here without an id at all"), (8, "long word " * 50_000), (9, "long  word " * 50_000), (10, "é à ü ß ö x y z")]
    docs = spark.createDataFrame([(a, b, 0, "c") for a, b in rows], "doc_id long, text string, class_id int, K string")
    assert got(J.join(docs)) == brute(rows)
    assert J.join(docs.limit(0)).count() == 0
    kept = J.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:9]) for r in kept.collect()) == sorted([(1, ""), (2, ""), (3, " . "), (4, "one two"), (6, "one two t"), (7, "a b c d e"), (0, "only here"), (8, "long word"), (10, "é à ü ß ö")])


def test_query_matches_sql(twin):
    assert len(twin("op3_jaccard_join")) == 200

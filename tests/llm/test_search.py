import math
import re
from collections import Counter

import numpy as np

from assayer.llm import hybrid_search as H

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=20):
    """Every document scored for every item."""
    words = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    count, tokens = sum(n > 0 for _, _, n in words), sum(n for _, _, n in words)
    df = Counter(w for _, c, _ in words for w in c)
    out = []
    for name, text in items:
        found = []
        for d, c, n in words:
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * (75 + (25 * n * count) // tokens))) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, d is not None, d or 0))
        out += [(name, k + 1, d if there else None, -s) for k, (s, there, d) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_matches_sql(twin):
    assert len(twin("op13_ranked_search")) > 200
    assert len(twin("op13_ranked_search", "/root/testdata/sf0.01")) > 200


def test_shards_blocks_and_ties_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(60)]
    weight = 1 / np.arange(1, 61)
    texts = [" ".join(rng.choice(words, rng.integers(1, 60), p=weight / weight.sum())) for _ in range(900)]
    docs = [(int(k), texts[k % 700]) for k in rng.permutation(900)]  # 200 texts twice: equal scores
    items = [(f"i{k}", " ".join(rng.choice(words, 12))) for k in range(25)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id string, text string")
    expected = brute(docs, items)
    assert got(H.search(d, i)) == expected
    assert got(H.search(d, i, shard_docs=70, block_bytes=600)) == expected
    assert got(H.search(d, i, shard_postings=100, top=3)) == brute(docs, items, 3)


def test_runs_are_skipped():
    rng = np.random.default_rng(6)
    docs, terms_, corpus = 4096, np.arange(3), H.Corpus(4096, 4096 * 20, np.array([900, 40, 7]))
    lists = [np.sort(rng.choice(docs, n, replace=False)) for n in (40, 3000, 4000)]
    dfs = np.array([len(x) for x in lists])
    shard = H.Shard(np.arange(docs), np.zeros(docs, bool), np.full(docs, 20), terms_, dfs, np.concatenate(lists).astype("<u4"), np.ones(dfs.sum(), "<u4"), corpus)
    best = H.Best(20)
    looked = H.search_shard(shard, Counter({0: 1, 1: 1, 2: 2}), best)
    assert looked < shard.runs  # runs without the rare term cannot reach the 20 best
    total = np.zeros(docs, np.int64)
    for t, n in ((0, 1), (1, 1), (2, 2)):
        total[lists[t]] += n * shard.gain[shard.start[t]:shard.start[t + 1]]
    order = np.lexsort((np.arange(docs), -total))[:20]
    assert best.id.tolist() == order.tolist() and best.score.tolist() == total[order].tolist()


def test_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, "Alpha beta"), (3, "Alpha beta"), (None, "alpha  BETA"), (None, "gamma"), (7, "Été x_y 3D alpha " * 2000), (8, "--- !!"), (9, "été")]
    items = [(1, "alpha alpha beta"), (2, None), (3, ""), (4, "zzz"), (5, "ÉTÉ été x"), (1, "alpha alpha beta"), (None, "gamma")]
    d = spark.createDataFrame([(a, b, 5, "s") for a, b in docs], "doc_id long, text string, rank int, item_id string").repartition(3)
    i = spark.createDataFrame([(a, b, 5.0) for a, b in items], "item_id int, text string, score double")
    assert got(H.search(d, i)) == brute(docs, items)
    assert H.search(d.limit(0), i).count() == 0 and H.search(d, i.limit(0)).count() == 0
    assert H.search(d.filter("doc_id IN (1, 2, 8)"), i).count() == 0
    assert H.search(d, i).columns == ["item_id", "rank", "doc_id", "score"]

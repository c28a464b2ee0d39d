import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers

from assayer.llm import lattice_scores as S

PATH = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def all_ways(word, weight, strange):
    """Sum over every segmentation, by recursion over the first piece."""
    if not word:
        return 1.0
    total = 0.0
    for n in range(1, len(word) + 1):
        piece = word[:n]
        p = weight.get(piece, strange(piece) if n == 1 else 0.0)
        if p:
            total += p * all_ways(word[n:], weight, strange)
    return total


def test_forward_is_the_sum_over_segmentations():
    pieces = [S.SPACE, "a", "b", "ab", "ba", S.SPACE + "a", "abb", S.SPACE + "ab", "b☃"]
    p = np.random.default_rng(2).random(len(pieces) + 2)
    p /= p.sum()
    lattice = S.Lattice(pieces, np.log(p))
    weight = dict(zip(pieces, p))
    strange = lambda c: p[len(pieces)] * 256.0 ** -len(c.encode())
    words = ["a", "ab", "abba", "b☃a", "xé", "a" * 12, "abbab☃x"]
    expected = [math.log(all_ways(S.SPACE + w, weight, strange)) for w in words]
    assert np.allclose(lattice.forward(words), expected)
    long = ["ab" * 60, "b☃" * 40]  # position by position
    old, S.LONG_WORD = S.LONG_WORD, 1000
    try:
        many = lattice.forward(long), lattice.expected(long, np.array([2.0, 3.0]))
    finally:
        S.LONG_WORD = old
    assert np.allclose(lattice.forward(long), many[0]) and np.allclose(lattice.expected(long, np.array([2.0, 3.0])), many[1])
    # Expected uses are the slopes of the weighted log likelihood.
    counts, uses = np.array([1.0, 2, 3, 1, 1, 2, 1]), lattice.expected(words, np.array([1.0, 2, 3, 1, 1, 2, 1]))
    for k in range(len(pieces)):
        w = np.log(p)
        w[k] += 1e-6
        slope = (counts @ S.Lattice(pieces, w).forward(words) - counts @ lattice.forward(words)) / 1e-6
        assert abs(slope - uses[k]) < 1e-4


def test_long_words_run_in_windows():
    pieces = [S.SPACE, "a", "b", "ab", "ba", S.SPACE + "a", "abb", S.SPACE + "ab", "babab", "b☃"]
    p = np.random.default_rng(4).random(len(pieces) + 2)
    lattice = S.Lattice(pieces, np.log(p / p.sum()))
    word = "".join(np.random.default_rng(5).choice(list("ab☃é"), 300, p=[0.5, 0.4, 0.05, 0.05]))
    found = []
    for window in (7, 64, 301, 1000):
        out, uses = np.zeros(1), np.zeros(lattice.count + 3)
        lattice._one(word, 0, np.array([2.0]), out, uses, window)
        found.append((out, uses))
    assert all(np.allclose(out, found[0][0]) and np.allclose(uses, found[0][1]) for out, uses in found)


def test_a_very_long_word_needs_little_memory():
    import tracemalloc
    lattice = S.Lattice([S.SPACE, "a", "b", "ab", "abab" * 4], np.log(np.full(7, 0.1)))
    word = "ab" * 100_000
    tracemalloc.start()
    found = lattice.forward([word])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.isfinite(found) and peak < 120e6


def brute(rows):
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    c, texts = Counter(), 0
    for d, t in rows:
        if not held(d):
            c.update(WORD.findall(lower(t)))
            texts += 1
    n, v = sum(c.values()) + texts, len(c) + (texts > 0)
    out = []
    for d, t in rows:
        w = WORD.findall(lower(t))
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((texts + 1) / (n + v + 1))
        out.append((d, held(d), len(w) + 1, sum(c[x] > 0 for x in w) + (texts > 0), n, round(base, 6)))
    return sorted(out, key=repr)


def test_query_against_brute_force(spark):
    import __spark_entry__ as entry
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    found = entry.queries()["op10_lattice_scores"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found), key=repr) == brute(rows)
    plain = S.score(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), PATH, rounds=0).collect()
    held = lambda rs: sum(r.score for r in rs if r.held_out)
    assert held(found) > held(plain) * 0.9  # fitted weights tell more about unseen texts (scores are negative)


def test_score_is_the_product_over_words(spark):
    rows = [(1, None), (2, ""), (3, "A a b"), (3, "A a b"), (4, " x\ty\x0bz\n"), (None, "naïve ☃ 日本語"), (5, "w " * 60_000), (6, "q" * 5000), (7, "a\xa0b \x1c c")]
    docs = spark.createDataFrame([(a, b, 1.0, 2) for a, b in rows], "doc_id long, text string, base double, score int").repartition(3)
    few, many = (S.score(docs, PATH, frequent=k).collect() for k in (1, 20_000))
    key = lambda r: (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
    assert sorted(map(key, few), key=repr) == sorted(map(key, many), key=repr) == brute(rows)
    assert np.allclose(sorted(r.score for r in few), sorted(r.score for r in many))
    assert all(math.isfinite(r.score) and r.score < 0 for r in many)
    assert S.score(docs.limit(0), PATH).count() == 0

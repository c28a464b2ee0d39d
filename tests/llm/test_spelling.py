import re
import zlib
from collections import Counter

import numpy as np

from assayer.llm import gram_spelling as G

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    """Exactly one inserted, deleted or replaced code point, by trying them all."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(rows, least=7, least_count=2, ratio=10):
    seen = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            seen[run] += 1
    words = {w: n for w, n in seen.items() if len(w) >= least and n >= least_count}
    found = {}
    for w, n in words.items():
        others = sorted((-m, v) for v, m in words.items() if abs(len(v) - len(w)) < 2 and near(v, w))
        best = others[0] if others and -others[0][0] >= ratio * n else None
        found[w] = best and best[1], n, len(others), best and -best[0]
    out = []
    for w, (form, n, many, form_n) in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        out.append((w, form, root, n, many, form_n))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_matches_sql(twin):
    rows = twin("op11_spelling_variants")
    assert len(rows) > 1000
    rows = twin("op11_spelling_variants", "/root/testdata/sf0.01")
    assert sum(r[0] is not None for r in rows) > 20  # forms are found


def test_crowded_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    parts = ["an", "ti", "on", "ér", "th", "or"]
    words = ["".join(rng.choice(parts, rng.integers(3, 6))) for _ in range(300)]
    rows = [(k, " ".join(rng.choice(words, 80))) for k in range(60)] + [(91, "chain " + "abcdefgh " * 2 + "abcdefghi " * 25 + "abcdefghij " * 300 + "Abcdefghij× " * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = brute(rows)
    assert got(G.variants(docs)) == expected
    assert got(G.variants(docs, block_letters=300)) == expected  # blocks of several parts
    assert any(r[1] and r[2] != r[1] for r in expected)


def test_edge_cases(spark):
    long = "abcdefghij" * 400
    rows = [(None, "Zeitung zeitung ZEITUNG"), (1, None), (2, ""), (3, "12 34"), (4, "Écolierß Écolierß"), (4, "Écolierß"),
            (5, f"{long} {long}"), (6, f"{long}x {long}x"), (7, f"x{long[1:]} x{long[1:]}"), (8, "gamekit gamekin gamekit gamekin gamekit"), (9, "GAMEKIT gamekin")]
    docs = spark.createDataFrame([(a, b, "w", 1) for a, b in rows], "doc_id long, text string, word string, n int").repartition(3)
    assert got(G.variants(docs)) == brute(rows)
    assert G.variants(docs.limit(0)).count() == 0
    assert G.variants(docs.filter("doc_id IN (1, 2, 3)")).count() == 0


def test_every_near_pair_shares_a_block():
    rng = np.random.default_rng(2)
    for _ in range(300):
        word = "".join(rng.choice(list("abc"), rng.integers(7, 12)))
        at, letter = rng.integers(0, len(word)), "d"
        for other in (word[:at] + letter + word[at:], word[:at] + letter + word[at + 1:], word[:at] + word[at + 1:]):
            a, b = sorted((word, other), key=len)
            h = len(a) // 2
            assert a[:h] == b[:h] or a[-(len(a) - h):] == b[-(len(a) - h):]

import datetime as dt
import re
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from assayer.llm import line_rules as L
from assayer.llm import url_lists as U

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", ["op1_url_filter", "op9_quality_rules"])
def test_query_matches_sql(twin, name):
    rows = twin(name)
    assert len(rows) >= 20


def lines_of(text):
    return [x for x in (text or "").split("\n") if WORD.search(x)]


def counts(text):
    w = WORD.findall(text or "")
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = lines_of(text)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit),
            len(w) < 50 or 100 * len(hit) > 50 * len(w))


def test_line_rules_edges(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t\n", None), (4, text, None), (4, text, None), (None, text + "\n" + text, "b"), (5, "a b a b a b " * 20_000, "b"),
            (6, "é ☃ \x1c x\x0by\n" * 30, "c"), (7, "one two three one two three", "c")]
    rows += [(100 + i, f"{' '.join(f'u{i}x{k}' for k in range(60))}\nShared  LINE here", "hot") for i in range(40)]
    rows += [(200 + i, f"{'lots of shared words ' * 1}\nShared line here\n" + " ".join(f"s{i}y{k}" for k in range(45)) + "\n" + "\n".join(["shared line here"] * 25), "hot") for i in range(40)]
    docs = spark.createDataFrame([(a, b, c, 3, "z") for a, b, c in rows], "doc_id long, text string, source string, n_words int, h string")
    got = L.judge(docs).collect()
    assert len(got) == len(rows)
    expected = Counter((r[0], *counts(r[1])) for r in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == expected
    by = {r.doc_id: r for r in got}
    assert by[100].n_removed_lines == 1 and by[100].kept and by[100].cleaned == rows[9][1].split("\n")[0]
    assert by[200].n_removed_lines >= 26 and not by[200].kept
    assert by[4].cleaned == text and by[4].kept and by[1].cleaned is None and not by[1].kept
    assert L.judge(docs.limit(0)).count() == 0


def test_documents_that_share_several_lines_are_told_apart(spark):
    menu = [f"menu entry {k}" for k in range(60)]
    own = lambda i: " ".join(f"o{i}x{k}" for k in range(150))
    rows = [(i, "\n".join([*menu, own(i), "footer"]), "shared") for i in range(30)]
    rows += [(100 + i, "\n".join([own(0), *menu[::-1]]), "copied") for i in range(30)]
    rows += [(200 + i, "\n".join([own(i), f"header {h}", f"footer {h}"]), f"two {h}") for h in range(8) for i in range(30)]
    got = L.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    removed = Counter((r.source, r.n_removed_lines, r.kept) for r in got)
    assert removed == {("shared", 61, False): 30, ("copied", 0, True): 30} | {(f"two {h}", 2, True): 30 for h in range(8)}
    assert all(r.cleaned == own(r.doc_id) for r in got if r.source == "shared")


def test_the_limit_does_not_grow_with_the_host(spark):
    own = lambda i: " ".join(f"w{i}y{k}" for k in range(60))
    rows = [(i, own(i) + ("\nsubscribe to our letter" if i < many else ""), host) for host, size, many in (("small", 300, 21), ("large", 3000, 21), ("rare", 300, 20)) for i in range(size)]
    got = L.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {r.source: r.n for r in got.groupBy("source").agg(F.sum("n_removed_lines").alias("n")).collect()} == {"small": 21, "large": 21, "rare": 0}


def test_twin_finds_the_same_frequent_lines(twin):
    rows = twin("op9_quality_rules", "/root/testdata/sf0.1")
    assert sum(r[6] for r in rows) > 100  # n_removed_lines, in the order of names


def brute_urls(captures, entries):
    groups = defaultdict(dict)
    for name, role, kind, pattern, action, at in entries:
        old = groups[name, kind, pattern].get(at, ("", ""))
        groups[name, kind, pattern][at] = (max(old[0], action), max(old[1], role))
    out = []
    for key, url, at in captures:
        m = re.match(r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*([^?#]*)", url or "")
        host = re.sub(r"^www\.|\.$", "", m[1].lower()) if m else ""
        keys = {("word", w) for w in re.findall("[0-9a-z]+", m[2].lower())} if m else set()
        if host and len(host) <= 253:
            parts = host.split(".")
            keys |= {("domain", ".".join(parts[i:])) for i in range(len(parts))} | {("url", host + m[2])}
            if s := re.match("^/([^/]+)", m[2]):
                keys.add(("path", f"{host}/{s[1]}"))
        hit = []
        for (name, kind, pattern), dates in groups.items():
            before = [d for d in dates if at is not None and d <= at]
            if (kind, pattern) in keys and before and dates[max(before)][0] == "add":
                hit.append((name, dates[max(before)][1]))
        roles = {r for _, r in hit}
        out.append((key, ",".join(sorted({n for n, _ in hit})), len(hit), "block" in roles and "allow" not in roles))
    return Counter(out)


def test_url_lists_edges(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    urls = ["http://www.Bad.example.com/x/y?q=1#f", "https://user@sub.bad.example.com:8080/ok", "http://good.example.org/a/b", "ftp://h.example.net", "no url", "", None,
            "http://" + "a" * 300 + ".com/z", "http://h.example.net/" + "seg/" * 20_000, "http://bad.example.com/x/y", "mailto:x@y.z", "http://./x"]
    captures = [(i, u, t(d)) for i, u in enumerate(urls) for d in (1, 3, 5, 9)] + [(99, urls[0], None), (1, urls[1], t(5))]
    entries = [("m", "block", "domain", "bad.example.com", "add", t(3)), ("m", "block", "domain", "bad.example.com", "remove", t(5)), ("m", "block", "domain", "bad.example.com", "add", t(9)),
               ("m", "block", "domain", "bad.example.com", "add", t(3)), ("s", "block", "path", "bad.example.com/x", "add", t(1)), ("r", "allow", "url", "bad.example.com/x/y", "add", t(5)),
               ("w", "block", "word", "seg", "add", t(2)), ("w", "block", "word", "seg", "remove", t(2)), ("c", "block", "domain", "com", "add", t(9)), ("d", "block", "domain", "net", "add", t(2)),
               ("d", "block", "domain", "net", "add", t(4)), ("x", "other", "domain", "net", "add", t(1)), (None, "block", "domain", "org", "add", t(1)), ("n", "block", "domain", None, "add", t(1))]
    df = spark.createDataFrame([(*c, "v", 1) for c in captures], "id long, url string, fetched_at timestamp, kind string, Lists int")
    lists = spark.createDataFrame(entries, "list string, role string, kind string, pattern string, action string, at timestamp")
    got = Counter((r.id, r.lists, r.n_entries, r.blocked) for r in U.judge(df, lists, others=["id"]).collect())
    assert got == brute_urls(captures, [e for e in entries if None not in e and e[1] != "other"])
    assert U.judge(df.limit(0), lists).count() == 0
    assert U.judge(df, lists.limit(0), others=["id"]).filter("blocked OR n_entries > 0").count() == 0

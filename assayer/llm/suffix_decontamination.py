"""Benchmark decontamination with suffix arrays over the training text.

The documents are cut into shards (slices of an Arrow batch). A shard's suffix array holds, in
lexicographic order of their word hashes, the suffixes that begin with a word pair (or a one-word
item) of the test set; no other suffix can be reached by the search. Every test suffix is then
binary-searched in the shard at once. A range of equal leading words gives all occurrences of a
window, runs on one diagonal give the maximal verbatim matches with their places.

Nothing is shuffled: a document lies in one shard. The test set is read in blocks of bounded size
and each block is broadcast; a task holds one block and one shard at a time.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import batch_rows, fields, without
from assayer.llm.word_hashes import WordHasher, letter_digit_words, slices

WINDOW = 10
BLOCK_BYTES = 16_000_000
ADDED = {"n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean",
         "longest": "bigint", "matches": "array<struct<item:string,doc_word:bigint,item_word:bigint,words:bigint>>"}
PAIR = np.uint64(0xD6E8FEB86659FD93)


class TestSuffixes:
    """Distinct windows of a block of test items, ready to be searched in a shard."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.window = window
        self.names = [name for name, _ in items]
        hashes, _, _, first = WordHasher(letter_digit_words())(pa.array([t for _, t in items], pa.string()))
        rows, lengths, owner, place = [], [], [], []
        for k in range(len(items)):
            words = hashes[first[k]:first[k + 1]]
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                rows.append(np.pad(words[i:i + size], (0, window - size)))
                lengths.append(size)
                owner.append(k)
                place.append(i)
        table = np.array(rows, np.uint64).reshape(-1, window)
        self.windows, group = np.unique(table, axis=0, return_inverse=True) if len(table) else (table, np.zeros(0, int))
        group = group.reshape(-1)
        order = np.argsort(group, kind="stable")
        self.owner, self.place = np.array(owner, np.int64)[order], np.array(place, np.int64)[order]
        self.begin = np.searchsorted(group[order], np.arange(len(self.windows) + 1))
        self.length = (self.windows != 0).sum(axis=1)
        single = self.windows[self.length == 1, 0]
        pairs = self.windows[self.length > 1]
        self.single = self._filter(single)
        self.head = self._filter(pairs[:, 0]) if len(pairs) else self._filter(single[:0])
        self.pair = self._filter(pairs[:, 0] * PAIR + pairs[:, 1]) if len(pairs) else self._filter(single[:0])

    @staticmethod
    def _filter(values: np.ndarray) -> np.ndarray:
        """A table over the top bits: no value of the test set is missed, few others pass."""
        seen = np.zeros(1 << 22, bool)
        seen[(values >> np.uint64(42)).astype(np.int64)] = True
        return seen

    def may_start(self, words: np.ndarray, has_next: np.ndarray) -> np.ndarray:
        top = np.uint64(42)
        follow = np.append(words[1:], np.uint64(0))
        found = np.flatnonzero(self.head[(words >> top).astype(np.int64)] & has_next)
        found = found[self.pair[((words[found] * PAIR + follow[found]) >> top).astype(np.int64)]]
        if self.single.any():
            found = np.union1d(found, np.flatnonzero(self.single[(words >> top).astype(np.int64)]))
        return found


def lexicographic(rows: np.ndarray) -> np.ndarray:
    return np.lexsort(rows.T[::-1])


def bound(sorted_rows: np.ndarray, wanted: np.ndarray, depth: np.ndarray, after: bool) -> np.ndarray:
    """Vectorised binary search: first row not before (or past) each wanted prefix of its depth."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(sorted_rows), np.int64)
    columns = np.arange(wanted.shape[1])
    while (open_ := low < high).any():
        k = np.flatnonzero(open_)
        middle = (low[k] + high[k]) // 2
        mine, theirs = wanted[k], sorted_rows[middle]
        differ = (mine != theirs) & (columns < depth[k, None])
        at = differ.argmax(axis=1)
        same = ~differ.any(axis=1)
        rows = np.arange(len(k))
        smaller = theirs[rows, at] < mine[rows, at]
        right = np.where(same, after, smaller)
        low[k[right]] = middle[right] + 1
        high[k[~right]] = middle[~right]
    return low


def occurrences(words: np.ndarray, first: np.ndarray, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """(word position, window number) of every occurrence of a test window inside one text."""
    none = np.zeros(0, np.int64)
    if not len(tests.windows) or not len(words):
        return none, none
    stop = np.repeat(first[1:], np.diff(first))
    starts = tests.may_start(words, np.arange(1, len(words) + 1) < stop)
    if not len(starts):
        return none, none
    reach = starts[:, None] + np.arange(tests.window)
    inside = reach < stop[starts, None]
    rows = np.where(inside, words[np.minimum(reach, len(words) - 1)], np.uint64(0))
    order = lexicographic(rows)
    suffixes, rows = starts[order], rows[order]
    low = bound(rows, tests.windows, tests.length, False)
    high = bound(rows, tests.windows, tests.length, True)
    found = high - low
    number = np.repeat(np.arange(len(found)), found)
    shift = np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found)
    return suffixes[np.repeat(low, found) + shift], number


def maximal_matches(position: np.ndarray, number: np.ndarray, first: np.ndarray, tests: TestSuffixes):
    """Maximal verbatim matches: text, item, word in the text, word in the item, words."""
    many = tests.begin[number + 1] - tests.begin[number]
    at = np.repeat(position, many)
    slot = np.repeat(tests.begin[number], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    size = np.repeat(tests.length[number], many)
    item, place = tests.owner[slot], tests.place[slot]
    text = np.searchsorted(first, at, side="right") - 1
    order = np.lexsort((at, at - place, item, text))
    text, item, place, at, size = text[order], item[order], place[order], at[order], size[order]
    new = np.ones(len(at), bool)
    if len(at) > 1:
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | ((at - place)[1:] != (at - place)[:-1]) | (at[1:] > at[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at)) - 1
    return text[head], item[head], (at - first[text])[head], place[head], (at[tail] + size[tail] - at[head])


def checked(texts: pa.Array, count: int, tests_of) -> dict[str, list]:
    """The added columns for the rows of one batch; ``tests_of`` prepares a block of the test set."""
    hasher, out = WordHasher(letter_digit_words()), {k: [] for k in ADDED}
    parts = []
    for begin, end in slices(texts):
        words, _, _, first = hasher(texts[begin:end])
        parts.append((words, first, np.zeros(len(words) + 1, np.int64), [[] for _ in range(end - begin)]))
    for k in range(count):
        tests = tests_of(k)
        for words, first, cover, found in parts:
            position, number = occurrences(words, first, tests)
            if len(position):
                np.add.at(cover, position, 1)
                np.add.at(cover, position + tests.length[number], -1)
                for t, i, d, p, n in zip(*(x.tolist() for x in maximal_matches(position, number, first, tests))):
                    found[t].append((tests.names[i], d, p, n))
    for words, first, cover, found in parts:
        hit = np.append(0, np.cumsum(np.cumsum(cover[:-1]) > 0))
        counts = hit[first[1:]] - hit[first[:-1]]
        for k, matches in enumerate(found):
            names = sorted({m[0] for m in matches})
            out["n_words"].append(int(first[k + 1] - first[k]))
            out["n_hit"].append(int(counts[k]))
            out["n_items"].append(len(names))
            out["items_sha256"].append(hashlib.sha256(",".join(names).encode()).hexdigest())
            out["contaminated"].append(bool(counts[k] > 0))
            out["longest"].append(max((m[3] for m in matches), default=0))
            out["matches"].append([dict(zip(("item", "doc_word", "item_word", "words"), m)) for m in sorted(matches)])
    return out


def item_blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> list:
    """The test set in broadcast blocks of about ``block_bytes`` each, one block at a time in the driver."""
    spark = benchmark.sparkSession
    slim = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text}`").alias("text"))
    size = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    count = max(1, -(-size // block_bytes))
    found = []
    for k in range(count):
        part = slim if count == 1 else slim.filter(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k)
        found.append(spark.sparkContext.broadcast([(r["item"], r["text"]) for r in part.collect()]))
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: Column | None = None) -> DataFrame:
    """All columns of docs and, per row, what it shares with the benchmark.

    Added: n_words, n_hit (words inside an occurrence of a window), n_items, items_sha256 (of the
    sorted item ids, joined by commas), contaminated, longest (words of the longest verbatim match)
    and matches (item, word in the text, word in the item, words). They replace columns of the same
    name. A window is ``window`` consecutive words of an item; a shorter item with words is one
    window. A null or empty text has no words and is clean; an item without words matches nothing;
    a null item id reads as an empty string; repeated documents are judged one by one, repeated item
    ids count once. ``keep``: condition on the input rows judged at all, others are left out.
    """
    batch_rows(docs.sparkSession, 2000)
    blocks = item_blocks(benchmark, item, item_text, block_bytes)
    rest = without(docs, ADDED)
    if keep is not None:
        rest = rest.filter(keep)
    schema = fields(rest) + ", " + ", ".join(f"{k} {v}" for k, v in ADDED.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests_of = functools.lru_cache(maxsize=1)(lambda k: TestSuffixes(blocks[k].value, window))
        for batch in batches:
            if not batch.num_rows:
                continue
            found = checked(batch.column(text), len(blocks), tests_of)
            match = pa.struct([("item", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("words", pa.int64())])
            kinds = {"items_sha256": pa.string(), "contaminated": pa.bool_(), "matches": pa.list_(match)}
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(found[k], kinds.get(k, pa.int64())) for k in ADDED]],
                                             [*batch.schema.names, *ADDED])

    return rest.mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any hit, in their own columns."""
    return decontaminate(docs, benchmark, **options).filter(~F.col("contaminated")).select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ADDED])


#: The columns of the contract in SQL.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
f AS (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0),
v AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM f),
e AS (SELECT r, k, p, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d JOIN (SELECT DISTINCT k FROM v) ON len(w) >= k)),
h AS (SELECT e.r, e.p, e.k, v.item_id FROM e JOIN v ON e.k = v.k AND e.g = v.g),
n AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + k)) AS q FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT r, coalesce(item_id::VARCHAR, '') AS s FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""

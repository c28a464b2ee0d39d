"""Ranked lexical search, term-at-a-time over short lists and document-at-a-time over long ones.

One scan cuts the documents into shards and writes, per shard, the posting lists of the terms that
the items ask for. Adding up the shards gives the statistics of the corpus. A search task then takes
one shard after another. Per item, the short lists of the shard are summed into accumulators, one for
each document they touch; these accumulators are from there on a single iterator with an upper bound
for every run of documents. It is merged with the long lists in document order, and a run of documents
whose bounds together cannot reach the worst kept score is skipped in all lists.

The items are read in blocks of bounded size; documents are never shuffled, and a task returns at most
``top`` rows an item. All scores are whole numbers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import arrow_rows, stored
from assayer.llm.word_hashes import WordHasher, letter_digit_words, slices

TOP = 20
#: Bytes of item texts and ids that are searched for together.
BLOCK_BYTES = 8_000_000
#: A shard is closed at so many documents or postings; a document may go beyond.
SHARD_DOCS, SHARD_POSTINGS = 4096, 500_000
#: Documents of a run that one upper bound covers.
RUN = 64
#: Short lists of an item hold together at most this share of a shard's documents in postings.
SHORT_SHARE = 0.5
#: Weights and saturation of the score.
TF_SCALE, LENGTH_PERCENT, LENGTH_BASE, SATURATION = 1_000_000_000, 25, 75, 12

INDEX = "docs bigint, tokens bigint, ids binary, missing binary, lengths binary, terms array<int>, dfs array<int>, posts binary, tfs binary"


class Terms:
    """The distinct terms of a block of items, found by their hashes."""

    def __init__(self, texts: list[str | None]):
        hasher = WordHasher(letter_digit_words())
        parts = [hasher(pa.array([t], pa.string()))[0] for t in texts]
        self.hashes = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
        self.items = [Counter(np.searchsorted(self.hashes, p).tolist()) for p in parts]

    def table(self) -> np.ndarray:
        """Marks the leading bits of all terms: few other words pass."""
        seen = np.zeros(1 << 20, bool)
        seen[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        return seen


def postings(hashes: np.ndarray, seen: np.ndarray, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and occurrences of every wanted term in the texts of a slice."""
    at = np.flatnonzero(seen[(words >> np.uint64(44)).astype(np.int64)])
    term = np.searchsorted(hashes, words[at])
    hit = hashes[np.minimum(term, len(hashes) - 1)] == words[at]
    at, term = at[hit], term[hit]
    doc = np.searchsorted(first, at, side="right") - 1
    code, tf = np.unique(doc * len(hashes) + term, return_counts=True)
    return code // len(hashes), code % len(hashes), tf


class ShardWriter:
    """Gathers documents and closes them into shards."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.held, self.docs, self.postings, self.counts = [], 0, 0, [0, 0]

    def add(self, ids: np.ndarray, missing: np.ndarray, lengths: np.ndarray, found: tuple) -> None:
        doc, term, tf = found
        used = np.unique(doc)
        self.held.append((ids[used], missing[used], lengths[used], np.searchsorted(used, doc) + self.docs, term, tf))
        self.docs += len(used)
        self.postings += len(doc)
        self.counts[0] += int((lengths > 0).sum())
        self.counts[1] += int(lengths.sum())

    def full(self, docs: int, most: int) -> bool:
        return self.docs >= docs or self.postings >= most

    def close(self) -> pa.RecordBatch:
        """The shard's row: its documents in the order of their ids, its postings by term and document."""
        ids, missing, lengths, doc, term, tf = (np.concatenate([h[k] for h in self.held]) for k in range(6))
        order = np.lexsort((ids, ~missing))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        doc = place[doc]
        by = np.lexsort((doc, term))
        terms, dfs = np.unique(term, return_counts=True)
        blobs = [ids[order].astype("<i8"), missing[order].astype("u1"), lengths[order].astype("<i8")]
        lists = [doc[by].astype("<u4"), tf[by].astype("<u4")]
        docs, tokens = self.counts
        self.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([docs], pa.int64()), pa.array([tokens], pa.int64()), *[pa.array([b.tobytes()], pa.binary()) for b in blobs],
             pa.array([terms.tolist()], pa.list_(pa.int32())), pa.array([dfs.tolist()], pa.list_(pa.int32())), *[pa.array([b.tobytes()], pa.binary()) for b in lists]],
            ["docs", "tokens", "ids", "missing", "lengths", "terms", "dfs", "posts", "tfs"])


def indexed(slim: DataFrame, terms, shard_docs: int, shard_postings: int) -> DataFrame:
    """One row per shard: counts over all its documents, postings of the wanted terms. ``terms``: broadcast hashes and table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = terms.value
        hasher, writer = WordHasher(letter_digit_words()), ShardWriter()
        for batch in batches:
            for begin, end in slices(batch.column("text")):
                words, _, _, first = hasher(batch.column("text")[begin:end])
                ids = batch.column("id")[begin:end]
                writer.add(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), np.diff(first), postings(hashes, seen, words, first))
                if writer.full(shard_docs, shard_postings):
                    yield writer.close()
        if writer.held:
            yield writer.close()

    return slim.mapInArrow(run, INDEX)


class Corpus(NamedTuple):
    docs: int
    tokens: int
    weights: np.ndarray  # of every term


class Shard:
    """A shard's lists, with what every posting adds and bounds for runs of documents."""

    def __init__(self, ids, missing, lengths, terms, dfs, posts, tfs, corpus: Corpus):
        self.ids, self.missing, self.terms = ids, missing, terms
        self.start = np.append(0, np.cumsum(dfs))
        self.posts = posts.astype(np.int64)
        scale = LENGTH_BASE + (LENGTH_PERCENT * lengths * corpus.docs) // corpus.tokens
        tf = tfs.astype(np.int64)
        self.gain = np.repeat(corpus.weights[terms], dfs) * ((TF_SCALE * tf) // (1000 * tf + SATURATION * scale[self.posts]))
        self.runs = -(-len(ids) // RUN)
        # Where each run begins in each list, and the most that a posting of the list adds in it.
        row = np.repeat(np.arange(len(terms)), dfs)
        cell = row * self.runs + self.posts // RUN
        many = np.bincount(cell, minlength=len(terms) * self.runs)
        self.cut = np.append(0, np.cumsum(many))
        self.bound = np.zeros(len(terms) * self.runs, np.int64)
        used = np.flatnonzero(many)
        if len(used):
            self.bound[used] = np.maximum.reduceat(self.gain, self.cut[used])
        self.bound = self.bound.reshape(len(terms), self.runs)


class Best:
    """The ``top`` best documents so far, in their order."""

    def __init__(self, top: int):
        self.top, self.score, self.id, self.missing = top, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """A lower score is of no use."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        score, ids, missing = np.append(self.score, score), np.append(self.id, ids), np.append(self.missing, missing)
        order = np.lexsort((ids, ~missing, -score))[:self.top]
        self.score, self.id, self.missing = score[order], ids[order], missing[order]


def search_shard(shard: Shard, item: Counter, best: Best, short_share: float = SHORT_SHARE) -> int:
    """Adds a shard's documents to the best of an item; the number of runs that were looked into."""
    asked = np.array(sorted(item), np.int64)
    row = np.searchsorted(shard.terms, asked)
    there = row < len(shard.terms)
    there[there] = shard.terms[row[there]] == asked[there]
    row, times = row[there], np.array([item[t] for t in asked[there].tolist()], np.int64)
    if not len(row):
        return 0
    size = shard.start[row + 1] - shard.start[row]
    order = np.argsort(size, kind="stable")
    row, times, size = row[order], times[order], size[order]
    shorts = int(np.searchsorted(np.cumsum(size), short_share * len(shard.ids), side="right"))
    # Term at a time: the short lists become one list of accumulators.
    sums = np.zeros(shard.runs * RUN, np.int64)
    for k in range(shorts):
        a, b = shard.start[row[k]], shard.start[row[k] + 1]
        sums[shard.posts[a:b]] += times[k] * shard.gain[a:b]
    lists, repeats = row[shorts:], times[shorts:]
    upper = sums.reshape(-1, RUN).max(axis=1) + repeats @ shard.bound[lists]
    # Document at a time, run by run: one more iterator beside the long lists.
    looked = 0
    for run in np.flatnonzero(upper >= best.least).tolist():
        if upper[run] < best.least:
            continue
        looked += 1
        base, total = run * RUN, sums[run * RUN:(run + 1) * RUN].copy()
        for cell, n in zip((lists * shard.runs + run).tolist(), repeats.tolist()):
            a, b = shard.cut[cell], shard.cut[cell + 1]
            if a < b:
                total[shard.posts[a:b] - base] += n * shard.gain[a:b]
        good = np.flatnonzero(total >= best.least)
        if len(good):
            best.add(total[good], shard.ids[base + good], shard.missing[base + good])
    return looked


def best_rows(index: DataFrame, block, top: int) -> DataFrame:
    """(item, score, doc_id): per task the best documents of every item of the block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, corpus = block.value
        best = [Best(top) for _ in items]
        for batch in batches:
            for k in range(batch.num_rows):
                raw = lambda c, kind: np.frombuffer(batch.column(c)[k].as_py(), kind)
                numbers = lambda c: batch.column(c)[k].values.to_numpy().astype(np.int64)
                shard = Shard(raw("ids", "<i8"), raw("missing", "u1").astype(bool), raw("lengths", "<i8"), numbers("terms"), numbers("dfs"), raw("posts", "<u4"), raw("tfs", "<u4"), corpus)
                for item, found in zip(items, best):
                    search_shard(shard, item, found)
        number = np.repeat(np.arange(len(best)), [len(b.score) for b in best])
        join = lambda name, kind: np.concatenate([getattr(b, name) for b in best]) if best else np.zeros(0, kind)
        yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(join("score", np.int64)), pa.array(join("id", np.int64), mask=join("missing", bool))], ["item", "score", "doc_id"])

    return index.select("ids", "missing", "lengths", "terms", "dfs", "posts", "tfs").mapInArrow(run, "item bigint, score bigint, doc_id bigint")


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
           top: int = TOP, block_bytes: int = BLOCK_BYTES, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """The ``top`` best documents of every item: item_id, rank (from 1), doc_id, score.

    Documents with a score above 0 are ranked by score, then by doc_id with null first. Terms are runs
    of ASCII letters and digits and of all code points beyond ASCII, lower-cased in A-Z. Null and empty
    texts have no terms: such documents are not found and such items have no rows. Repeated documents
    take a rank each, repeated items are answered one by one, extra columns are not read, and empty
    tables give no rows. Ids of documents are whole numbers.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text"))
    asked = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("text"))
    kind = asked.schema["item_id"].dataType.simpleString()
    size = asked.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 32), F.lit(0)).alias("n")).first()["n"]
    blocks, parts = max(1, -(-size // block_bytes)), []
    for b in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = part.collect()  # a block of bounded size
        terms = Terms([r["text"] for r in rows])
        if not len(terms.hashes):
            continue
        known = spark.sparkContext.broadcast((terms.hashes, terms.table()))
        with arrow_rows(spark, 1000):
            index = stored(indexed(slim, known, shard_docs, shard_postings), "postings")
        total = index.agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).first()
        if not total["tokens"]:
            continue
        weights = np.zeros(len(terms.hashes), np.int64)
        dfs = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.dfs").alias("df"))
        for r in dfs.collect():  # one row for each term of the block
            weights[r["terms"]] = math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * r["df"] + 1)))
        block = spark.sparkContext.broadcast((terms.items, Corpus(total["docs"], total["tokens"], weights)))
        with arrow_rows(spark, 1):  # a row is a shard
            found = stored(best_rows(index, block, top), "best-rows")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        names = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(rows)], f"item bigint, item_id {kind}")
        parts.append(stored(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"), "ranked"))
    if not parts:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: The columns of the contract in SQL, every document scored.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT (count(*) FILTER (len(w) > 0))::BIGINT AS docs, sum(len(w))::BIGINT AS tokens FROM d),
i AS (SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
k AS (SELECT q, item_id, t, count(*) AS times FROM i GROUP BY ALL),
p AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w)::BIGINT AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM k) GROUP BY ALL),
f AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight FROM (SELECT t, count(*) AS df FROM p GROUP BY t), s),
c AS (SELECT q, item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // tokens))))::BIGINT AS score FROM k JOIN p USING (t) JOIN f USING (t), s GROUP BY q, item_id, r, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST))::INTEGER AS rank, doc_id, score FROM c WHERE score > 0 QUALIFY rank <= 20
"""

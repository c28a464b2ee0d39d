"""N-gram Jaccard join with MinHash LSH in bands of one fixed depth, in place of a forest of tries.

A text is its set of word 5-grams; texts with equal sets are one. Each of ``trees`` bands hashes
``depth`` MinHash values of its own to one number; the depth is the largest up to ``most_depth`` at
which, by formula, a pair at the threshold meets in some band with the target recall. It does not
depend on the data, and no longer prefix is tried. Texts that meet are joined to candidate clusters, and inside a cluster every pair is
verified exactly, in blocks of bounded size: a large cluster is dealt into blocks by a hash and
every pair of blocks is one task, which counts links and returns one row per text, never the pairs.
So no pair that meets is lost, whatever the size of a cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import batch_rows, stored
from assayer.llm.components import components
from assayer.llm.word_hashes import WordHasher, letter_digit_words, slices, spread

WORDS, THRESHOLD = 5, 0.8
TREES, MOST_DEPTH, RECALL = 32, 12, 0.999
#: Shingles of a block; two blocks are in a task's memory at once.
BLOCK_SHINGLES = 1_000_000
POWER = np.uint64(0x9FB21C651E98DF25)


def depth_for(threshold: float, trees: int, recall: float, most: int) -> int:
    """The longest prefix with which a pair at the threshold meets in some trie often enough."""
    for depth in range(most, 0, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    raise ValueError("More trees are needed for this recall.")


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, in a row, and the first of every text.

    A text of fewer than ``width`` words is one shingle of all its words; one without words has none.
    """
    count = np.diff(first)
    many = np.where(count > 0, np.maximum(1, count - width + 1), 0)
    owner = np.repeat(np.arange(len(many)), many)
    at = first[:-1][owner] + np.arange(len(owner)) - (np.cumsum(many) - many)[owner]
    stop, total = first[1:][owner], np.zeros(len(owner), np.uint64)
    padded, factor = np.append(words, np.zeros(width, np.uint64)), np.uint64(1)
    for j in range(width):
        total += np.where(at + j < stop, padded[at + j], np.uint64(0)) * factor
        factor *= POWER
    total = spread(total)
    order = np.lexsort((total, owner))
    total, owner = total[order], owner[order]
    keep = np.ones(len(total), bool)
    keep[1:] = (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])
    return total[keep], np.searchsorted(owner[keep], np.arange(len(many) + 1))


def functions_of(trees: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = spread(np.arange(1, 2 * trees * depth + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[::2].reshape(trees, depth), seeds[1::2].reshape(trees, depth) | np.uint64(1)


def prefixes(sets: np.ndarray, first: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """The trie node of every text (with shingles) in every tree, as a hash of tree and prefix."""
    flip, factor = functions_of(trees, depth)
    full = np.flatnonzero(np.diff(first))
    out = np.zeros((len(full), trees), np.uint64)
    for t in range(trees):
        node = np.full(len(full), t + 1, np.uint64)
        for d in range(depth):
            node = spread(node * POWER + np.minimum.reduceat((sets ^ flip[t, d]) * factor[t, d], first[:-1][full]))
        out[:, t] = node
    return out


def digests(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit digest of every set; 0 without shingles."""
    total = np.append(np.uint64(0), np.cumsum(spread(sets + np.uint64(0x632BE59BD9B4E019)), dtype=np.uint64))
    size = np.diff(first)
    return np.where(size > 0, spread(total[first[1:]] - total[first[:-1]] + size.astype(np.uint64) * POWER) | np.uint64(1), np.uint64(0))


def signed(docs: DataFrame, width: int, trees: int, depth: int) -> DataFrame:
    """(id, text_key, k, n, nodes) of every row of (id, text, text_key); k is null without words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(letter_digit_words())
        for batch in batches:
            for begin, end in slices(batch.column("text")):
                words, _, _, first = hasher(batch.column("text")[begin:end])
                sets, first = shingles(words, first, width)
                size, key = np.diff(first), digests(sets, first).view(np.int64)
                flat = prefixes(sets, first, trees, depth).view(np.int64) if len(sets) else np.zeros((0, trees), np.int64)
                bounds = np.append(0, np.cumsum(np.where(size > 0, trees, 0)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[begin:end], batch.column("text_key")[begin:end], pa.array(key, mask=size == 0), pa.array(size, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.reshape(-1)))], ["id", "text_key", "k", "n", "nodes"])

    return docs.mapInArrow(run, "id bigint, text_key bigint, k bigint, n bigint, nodes array<bigint>")


def with_sets(rows: DataFrame, width: int) -> DataFrame:
    """The text column replaced by its shingles (sorted 64-bit hashes as binary), rows of another text dropped."""
    names = [c for c in rows.columns if c != "text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text") + ", shingles binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(letter_digit_words())
        for batch in batches:
            for begin, end in slices(batch.column("text")):
                part = batch.slice(begin, end - begin)
                words, _, _, first = hasher(part.column("text"))
                sets, first = shingles(words, first, width)
                data = [sets[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                made = pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(data, pa.binary())], [*names, "shingles"])
                yield made.filter(pa.array(digests(sets, first).view(np.int64) == part.column("k").to_numpy()))

    return rows.mapInArrow(run, schema)


class Block:
    """Texts of one task: keys, copies, shingle sets and the side they stand on."""

    def __init__(self, keys, copies, sides, sets):
        self.keys, self.copies, self.sides = np.array(keys, np.int64), np.array(copies, np.int64), np.array(sides, bool)
        self.size = np.array([len(s) for s in sets], np.int64)
        order = np.argsort(self.size, kind="stable")
        self.keys, self.copies, self.sides, self.size = self.keys[order], self.copies[order], self.sides[order], self.size[order]
        sets = [sets[i] for i in order]
        n = len(sets)
        value, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(n), self.size)
        # Frequent shingles become bits, which takes 8 bytes per shingle of the block at most; the
        # others that occur twice become lists of the texts they are in.
        frequent = (count > 1) & (count * 64 >= n)
        number = np.cumsum(frequent) - 1
        keep = frequent[inverse]
        at, column = row[keep], number[inverse[keep]]
        self.bits = np.zeros((n, max(1, -(-int(frequent.sum()) // 64))), np.uint64)
        np.bitwise_or.at(self.bits, (at, column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))
        rare = (count > 1) & ~frequent
        number = np.cumsum(rare) - 1
        keep = rare[inverse]
        at, column = row[keep], number[inverse[keep]]
        self.mine, self.first = column, np.searchsorted(at, np.arange(n + 1))
        order = np.argsort(column, kind="stable")
        self.texts, self.begin = at[order], np.append(0, np.cumsum(count[rare]))

    def rare_common(self, i: int) -> np.ndarray | None:
        """Rare shingles that every text has in common with text i."""
        mine = self.mine[self.first[i]:self.first[i + 1]]
        if not len(mine):
            return None
        many = self.begin[mine + 1] - self.begin[mine]
        at = np.repeat(self.begin[mine] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return np.bincount(self.texts[at], minlength=len(self.keys))

    def links(self, threshold: float, across: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Linked documents and linked texts of every text, and the least key it is connected to here."""
        n = len(self.keys)
        documents, texts, label = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
        top, bottom = round(threshold * 1000), 1000
        step = max(1, 4_000_000 // self.bits.shape[1])
        for i in range(n - 1):
            # Sizes ascend; a larger set than size / threshold cannot reach the threshold.
            stop = np.searchsorted(self.size, self.size[i] * bottom // top, side="right")
            rare = self.rare_common(i)
            for low in range(i + 1, int(stop), step):
                high = min(low + step, int(stop))
                common = np.bitwise_count(self.bits[low:high] & self.bits[i]).sum(axis=1, dtype=np.int64)
                if rare is not None:
                    common += rare[low:high]
                good = common * bottom >= top * (self.size[low:high] + self.size[i] - common)
                if across:
                    good &= self.sides[low:high] != self.sides[i]
                at = low + np.flatnonzero(good)
                if len(at):
                    documents[i] += self.copies[at].sum()
                    texts[i] += len(at)
                    documents[at] += self.copies[i]
                    texts[at] += 1
                    found = np.unique(label[np.append(at, i)])
                    if len(found) > 1:
                        label[np.isin(label, found[1:])] = found[0]
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, label, self.keys)
        return documents, texts, least[label]


def verified(blocks: DataFrame, threshold: float) -> DataFrame:
    """(k, links, text_links, least) from rows (root, i, j, side, k, copies, shingles), whole groups per task."""
    grouped = blocks.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")

    def finish(key, rows):
        block = Block([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [np.frombuffer(r[3], np.uint64) for r in rows])
        documents, texts, least = block.links(threshold, key[1] != key[2])
        some = texts > 0
        return pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (block.keys, documents, texts, least)], ["k", "links", "text_links", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("root", "i", "j")]
            for key, *row in zip(zip(*columns), *(batch.column(c).to_pylist() for c in ("k", "copies", "side")), batch.column("shingles")):
                if key != now:
                    if len(rows) > 1:
                        yield finish(now, rows)
                    now, rows = key, []
                rows.append((row[0], row[1], row[2], row[3].as_buffer()))
        if len(rows) > 1:
            yield finish(now, rows)

    return grouped.mapInArrow(run, "k bigint, links bigint, text_links bigint, least bigint")


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES,
         most_depth: int = MOST_DEPTH, recall: float = RECALL, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per document: doc_id, text_key, class_id, n_links, n_text_links, n_copies.

    Words are runs of ASCII letters, digits and code points beyond ASCII, lower-cased in A-Z. Linked
    are documents whose 5-gram sets have a Jaccard similarity of the threshold or more, copies
    included. class_id is the least doc_id connected by links; n_links counts the linked documents,
    n_text_links the linked different sets, n_copies the other documents with the same set. Null and
    wordless texts have no links and are classes of their own. A null doc_id never names a class of
    others; a class of such rows only has class_id null. text_key is xxhash64 of the text. Repeated
    rows are copies of each other. Extra columns are not read.
    """
    depth = depth_for(threshold, trees, recall, most_depth)
    batch_rows(docs.sparkSession, 1000)
    slim = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text")).withColumn("text_key", F.xxhash64("text"))
    marked = stored(signed(slim, width, trees, depth), "signatures")
    # Equal sets are one text from here on; nodes is the same for all of them.
    texts = stored(marked.filter("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least_id"), F.min("text_key").alias("text_key"),
                                                                   F.first("n").alias("n"), F.first("nodes").alias("nodes")), "texts")
    nodes = texts.select("k", F.explode("nodes").alias("node"))
    met = nodes.groupBy("node").agg(F.min("k").alias("low"), F.max("k").alias("high")).filter("low < high").select("node", "low")
    edges = nodes.join(met, "node").select(F.col("k").alias("a"), F.col("low").alias("b"))
    clusters = components(edges)

    members = stored(clusters.join(texts.select(F.col("k").alias("node"), "copies", "text_key", "n"), "node").select(F.col("node").alias("k"), "root", "copies", "text_key", "n"), "clusters")
    totals = members.groupBy("root").agg(F.ceil(F.sum("n") / block_shingles).alias("parts"))
    # A merge join at every size: the clustered texts grow with the table.
    wanted = slim.select("text", "text_key").join(members.hint("merge"), "text_key").dropDuplicates(["k"])
    blocks = with_sets(wanted.select("text", "k", "root", "copies"), width).join(totals, "root")
    mine, other = F.pmod(F.xxhash64("k"), F.col("parts")), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
    blocks = blocks.withColumn("mine", mine).withColumn("other", other).select(
        "root", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).alias("side"), "k", "copies", "shingles")
    found = stored(verified(blocks, threshold), "links")

    linked = found.groupBy("k").agg(F.sum("links").alias("links"), F.sum("text_links").alias("text_links"))
    roots = components(found.select(F.col("k").alias("a"), F.col("least").alias("b")))
    known = texts.select("k", "copies", "least_id").join(linked, "k", "left").join(roots.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    known = stored(known, "texts-linked")
    names = known.groupBy("root").agg(F.min("least_id").alias("class_id"))
    classes = known.join(names, "root").select("k", "class_id", (F.col("copies") - 1).alias("n_copies"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("text_links", F.lit(0)).alias("text_links"))
    zero = F.lit(0).cast("bigint")
    return marked.select("id", "text_key", "k").join(classes, "k", "left").select(
        F.col("id").alias("doc_id"), "text_key", F.when(F.col("k").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce(F.col("links") + F.col("n_copies"), zero).alias("n_links"), F.coalesce("text_links", zero).alias("n_text_links"),
        F.coalesce("n_copies", zero).alias("n_copies"), F.col("k").isNotNull().alias("has_words"), F.col("k"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Documents in their own columns, of every class only the one with the least id.

    Among rows of that id the least text_key stays, of equal rows one. Texts without words all stay,
    and so do classes that have no id at all, reduced to one row.
    """
    found = join(docs, doc_id, text, **options)
    group = found.filter("has_words").groupBy("class_id", F.when(F.col("class_id").isNull(), F.col("k")).alias("k"))
    first = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_key"))
    keepers = stored(group.agg(F.min(first).alias("f")).select(F.col("f.doc_id").alias("__id"), F.col("f.text_key").alias("__key")), "keepers")
    twice = found.groupBy("doc_id", "text_key").count().filter("count > 1").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    keyed = docs.withColumns({"__k": F.xxhash64(F.col(f"`{text}`")), "__i": F.col(f"`{doc_id}`").cast("bigint")})
    same = lambda t: keyed["__i"].eqNullSafe(t["__id"]) & (keyed["__k"] == t["__key"])
    wordless = F.coalesce(~F.col(f"`{text}`").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"), F.lit(True))
    kept = keyed.filter(~wordless).join(keepers.hint("merge"), same(keepers), "left_semi")
    repeated = stored(keepers.join(twice, keepers["__id"].eqNullSafe(twice["__id"]) & (keepers["__key"] == twice["__key"]), "left_semi"), "repeated")
    if not repeated.isEmpty():
        single = kept.join(repeated, kept["__i"].eqNullSafe(repeated["__id"]) & (kept["__k"] == repeated["__key"]), "left_anti")
        many = kept.join(repeated, kept["__i"].eqNullSafe(repeated["__id"]) & (kept["__k"] == repeated["__key"]), "left_semi")
        kept = single.unionByName(many.dropDuplicates(["__i", "__k"]))
    return kept.unionByName(keyed.filter(wordless)).select(*[F.col(f"`{c}`") for c in docs.columns])


#: The exact join in SQL, for tables without large groups.
SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
c AS (SELECT r, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS k FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
l AS (SELECT x, y, a.k = b.k AS same, b.k AS k FROM p JOIN c a ON a.r = x JOIN c b ON b.r = y WHERE 10 * m >= 8 * (a.n + b.n - m)),
t AS (SELECT r AS x, r AS y FROM d UNION SELECT t.x, l.y FROM t JOIN l ON l.x = t.y),
o AS (SELECT t.x, min(d.doc_id) AS class_id FROM t JOIN d ON d.r = t.y GROUP BY t.x),
q AS (SELECT x, count(*) AS n, count(DISTINCT k) FILTER (WHERE NOT same) AS texts, count(*) FILTER (WHERE same) AS copies FROM l GROUP BY x)
SELECT doc_id, class_id, coalesce(q.n, 0)::BIGINT AS n_links, coalesce(q.texts, 0)::BIGINT AS n_text_links, coalesce(q.copies, 0)::BIGINT AS n_copies
FROM d JOIN o ON o.x = d.r LEFT JOIN q ON q.x = d.r
"""

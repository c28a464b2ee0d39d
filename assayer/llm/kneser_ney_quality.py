"""Quality classifier: perplexity under an interpolated modified Kneser-Ney trigram model.

The model is fitted on all trusted labelled rows but every fifth id by language, which is held out for
the thresholds. Its n-gram, continuation and context counts are Spark aggregations. A model of at most
``held_words`` training words is broadcast: its tables are cut by key into shards, and a batch of
documents looks its n-grams up in one shard after another. A larger model is never held whole: the triples
of all texts are dealt to buckets by their middle word, packed as places among the words of a chunk of
texts. A bucket counts the learnt ones and adds up what its pairs and triples add to the score of each text;
the words themselves are looked up among the ``HEAD`` most frequent ones or joined.

Thresholds cover all labelled rows that are not in the model: per language, the trusted perplexity quantile
that best separates trusted from rejected rows. All documents are scored over their whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import batch_rows, fields, shuffles_dropped, stored, without
from assayer.llm.word_hashes import WordHasher, ascii_space_words, slices, spread

#: A model of more training words than this is joined with the documents and not broadcast.
HELD_WORDS = 1_500_000
#: So many of a large model's most frequent words are broadcast.
HEAD = 500_000
SHARDS = 4
#: Bytes of text whose triples are packed together.
CHUNK_BYTES = 4_000_000
#: Words of a bucket of triples; a middle word that alone has more is cut by the first words.
BUCKET_WORDS = 2_000_000
#: Turns in which the buckets of a large model are dealt out: their shuffles are on disk one after another.
TURNS = 3
#: Up to so many learnt ids are broadcast to the texts.
LEARNT_IDS = 2_000_000
PACKED = "b bigint, names binary, learnt binary, each binary, words binary, triples binary, n_words bigint, n_triples bigint"
#: Leading digits of the id's md5 that cut the trusted ids of a language into runs.
RUN_DIGITS = 3
WORDS = r"[^\x20\x09-\x0D]+"
#: Tokens of its language's mean perplexity that every text gets, so that short texts are judged with care.
PRIOR_TOKENS = 10.0
LEVELS = (0.90, 0.95, 0.98, 0.99, 0.995, 0.999, 1.0)
#: Fewer rejected rows of a language than this say nothing: the highest level holds then.
LEAST_REJECTED = 20
#: A language with fewer trusted rows outside the sample than this takes the threshold of all languages.
LEAST_TRUSTED = 20
#: Every so many-th of the first trusted ids, by language, is held out of the sample for the thresholds.
HELD = 5
BEGIN, END = np.uint64(0x51ED270B35A7C1E3), np.uint64(0x7C0B8D1F2A96E455)
JOIN = np.uint64(0xA24BAED4963EE407)
ADDED = {"n_words": "bigint", "__nll": "double"}
TABLES = ("a3", "g3", "a2", "g2", "p1")


def both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return spread(a * JOIN + b)


def trigrams(words: np.ndarray, first: np.ndarray, begin: np.generic = BEGIN, end: np.generic = END) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two words of context and the predicted word, and the first prediction of every text.

    A text is two begin marks, its words and an end mark; all but the begin marks are predicted.
    """
    count = np.diff(first)
    start = first[:-1] + 3 * np.arange(len(count))
    line = np.full(len(words) + 3 * len(count), begin, words.dtype)
    line[np.arange(len(words)) + 2 + 3 * np.repeat(np.arange(len(count)), count)] = words
    line[start + 2 + count] = end
    predicted = np.ones(len(line), bool)
    predicted[start] = predicted[start + 1] = False
    at = np.flatnonzero(predicted)
    return line[at - 2], line[at - 1], line[at], first + np.arange(len(first))


def count_rows(texts: pa.Array) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher(ascii_space_words(), fold_case=False)
    for begin, end in slices(texts):
        words, _, _, first = hasher(texts[begin:end])
        w1, w2, w3, _ = trigrams(words, first)
        k12 = both(w1, w2)
        _, index, n = np.unique(both(k12, w3), return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([*[pa.array(c[index].view(np.int64)) for c in (k12, w2, w3)], pa.array(n)], ["k12", "w2", "w3", "n"])


def longer_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counted trigrams with the keys of the whole and of its last two words."""
    for batch in batches:
        k12, w2, w3 = (batch.column(c).to_numpy().view(np.uint64) for c in ("k12", "w2", "w3"))
        added = [pa.array(k.view(np.int64)) for k in (both(k12, w3), both(w2, w3))]
        yield pa.RecordBatch.from_arrays([*added, *batch.columns], ["k123", "k23", *batch.schema.names])


def has_word(text: Column) -> Column:
    return F.ltrim(text, F.lit(" \t\n\x0b\x0c\r")) != ""


def word_total(texts: DataFrame) -> int:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pc.sum(pc.count_substring_regex(batch.column("text"), WORDS)).as_py() or 0], pa.int64())], ["n"])

    return texts.mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def ids_to_learn(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """Ids of the trusted texts with words, but every ``HELD``-th by language, in md5 order of the id.

    An id is numbered in its run of leading md5 digits, beyond all earlier runs.
    """
    spoken = docs.filter(has_word(F.col(f"`{text}`"))).select(F.col(f"`{doc_id}`").alias("id"), group_of(F.col(f"`{lang}`")).alias("of"))
    order = F.md5(F.col("id").cast("string"))
    found = spoken.join(labels.filter("trusted").select("id"), "id").distinct().withColumn("order", order).withColumn("run", F.substring(order, 1, RUN_DIGITS))
    found = stored(found, "trusted")
    before = Window.orderBy("of", "run").rowsBetween(Window.unboundedPreceding, -1)  # a row per language and run
    runs = found.groupBy("of", "run").agg(F.count(F.lit(1)).alias("n")).select("of", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("of", "run").orderBy("order", "id"))
    held = found.join(runs, ["of", "run"]).withColumn("place", place).groupBy("id").agg(F.max(F.col("place") % HELD == 2).alias("held"))
    return held.filter("NOT held").select("id")


def training_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, lang: str, rows: int, words: int) -> DataFrame:
    """Trusted texts, first in md5 order of the id, within both bounds; every ``HELD``-th id by language
    is left to the thresholds, and a text that does not fit the words left is passed over."""
    order = F.md5(F.col("id").cast("string"))
    most = -(-rows * HELD // (HELD - 1))
    ids = labels.filter("trusted").select("id").orderBy(order, "id").limit(most)
    found = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).join(F.broadcast(ids), "id")  # at most ``most`` ids
    found = found.withColumn("words", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).filter("words > 0").orderBy(order, "id", F.md5("text")).limit(most)
    place = F.dense_rank().over(Window.orderBy(group_of(F.col("lang")), order, "id"))
    found = found.withColumn("place", place).withColumn("held", F.max(F.col("place") % HELD == 2).over(Window.partitionBy("id"))).filter("NOT held")
    found = stored(found.select("id", "text", "words", F.row_number().over(Window.orderBy(order, "id", F.md5("text"))).alias("number")), "candidates")
    taken, left = [], words
    for r in found.select("number", "words").orderBy("number").collect():  # at most ``most`` pairs
        if r["words"] <= left and len(taken) < rows:
            taken.append(r["number"])
            left -= r["words"]
    return found.filter(F.col("number").isin(taken))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of one, two and more."""
    return discounts_of({r["c"]: r["n"] for r in counts.groupBy(F.least(F.col("c"), F.lit(5)).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()})


def discounts_of(seen: dict[int, int]) -> tuple[float, float, float]:
    """The same from the number of n-grams by count."""
    n1, n2, n3, n4 = (max(1, seen.get(k, 0)) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    bounded = [min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]
    return bounded[0], bounded[1], bounded[2]


def discounted(counts: DataFrame, context: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with their discounted share a of the context, and per context the weight g left to the lower order."""
    d = discounts(counts)
    off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
    contexts = counts.groupBy(*context).agg(F.sum("c").alias("total"), F.sum(off).alias("left"))
    contexts = contexts.select(*context, "total", (F.col("left") / F.col("total")).alias("g"))
    return counts.join(contexts, context).withColumn("a", (F.col("c") - off) / F.col("total")), contexts


def probabilities(sample: DataFrame) -> tuple[dict[str, DataFrame], float]:
    """The model's tables (shares a of known n-grams, weights g left by known contexts, p1 of words) and the probability of any other word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from count_rows(batch.column("text"))

    seen = sample.select("text").mapInArrow(run, "k12 bigint, w2 bigint, w3 bigint, n bigint")
    counted = stored(seen.groupBy("k12", "w2", "w3").agg(F.sum("n").alias("c")), "trigrams")
    three = counted.mapInArrow(longer_keys, f"k123 bigint, k23 bigint, {fields(counted)}")
    two = stored(three.groupBy("k23", "w2", "w3").agg(F.count(F.lit(1)).alias("c")), "bigrams")
    one = two.groupBy("w3").agg(F.count(F.lit(1)).alias("c")).withColumn("all", F.lit(0))  # one context for all
    a3, g3 = discounted(three, ["k12"])
    a2, g2 = discounted(two, ["w2"])
    a1, g1 = discounted(one, ["all"])
    vocabulary = one.count() + 1
    left = g1.first()
    uniform = (left["g"] if left else 1.0) / vocabulary
    return {"a3": a3, "g3": g3, "a2": a2, "g2": g2, "p1": a1.withColumn("p", F.col("a") + F.lit(uniform))}, uniform


def fit(sample: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Key and value of the model's tables, by key, for a sample of at most ``HELD_WORDS`` words or so."""
    tables, uniform = probabilities(sample)
    parts = {"a3": tables["a3"].select("k123", "a"), "g3": tables["g3"].select("k12", "g"), "a2": tables["a2"].select("k23", "a"), "g2": tables["g2"].select("w2", "g"),
             "p1": tables["p1"].select("w3", "p")}
    model = {}
    for name, part in parts.items():
        rows = part.toArrow()
        keys = rows.column(0).to_numpy().view(np.uint64) if rows.num_rows else np.zeros(0, np.uint64)
        order = np.argsort(keys)
        model[name] = keys[order], rows.column(1).to_numpy()[order].astype(np.float64)
    model["unknown"] = np.zeros(1, np.uint64), np.array([uniform])
    return model


def cut(model: dict, shards: int) -> list[dict]:
    """The indexed tables by the leading bits of the key, as plain arrays."""
    edges = [(k << 64) // shards for k in range(shards)]
    out = []
    for k in range(shards):
        part = {}
        for name in TABLES:
            keys, values = model[name]
            low = np.searchsorted(keys, np.uint64(edges[k]))
            high = np.searchsorted(keys, np.uint64(edges[k + 1])) if k + 1 < shards else len(keys)
            part[name] = Index(keys[low:high], values[low:high]).__dict__
        out.append(part)
    return out


class Index:
    """Sorted hash keys with a table of about one slot per key: a lookup compares a few neighbours."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = np.append(keys, np.uint64(2**64 - 1)), np.append(values, 0.0)
        self.size = len(keys)
        if self.size:
            self.low, self.high = keys[0], keys[-1]
            span = int(self.high) - int(self.low)
            self.shift = np.uint64(max(0, span.bit_length() - self.size.bit_length()))
            slots = (keys - self.low) >> self.shift
            self.begin = np.searchsorted(slots, np.arange(int(slots[-1]) + 1, dtype=np.uint64)).astype(np.int32)

    @classmethod
    def shared(cls, parts: dict) -> Index:
        """An index over the arrays of another one (its ``__dict__``), without copies."""
        made = cls.__new__(cls)
        made.__dict__.update(parts)
        return made

    def __call__(self, wanted: np.ndarray, default: float) -> np.ndarray:
        out = np.full(len(wanted), default)
        if not self.size:
            return out
        todo = np.flatnonzero((wanted >= self.low) & (wanted <= self.high))
        at = self.begin[((wanted[todo] - self.low) >> self.shift).astype(np.int64)]
        while len(todo):
            here = self.keys[at]
            equal = (here == wanted[todo]) & (at < self.size)
            out[todo[equal]] = self.values[at[equal]]
            more = (here < wanted[todo]) & (at < self.size)
            todo, at = todo[more], at[more] + 1
        return out


class Scorer:
    def __init__(self, shards: list, unknown: float):
        self.shards = [{name: Index.shared(part.value[name]) for name in TABLES} for part in shards]
        self.edges = np.array([(k << 64) // len(shards) for k in range(1, len(shards))], np.uint64)
        self.unknown = unknown
        self.hasher = WordHasher(ascii_space_words(), fold_case=False)

    def join(self, name: str, keys: np.ndarray, default: float) -> np.ndarray:
        """Values of the keys, one shard after another."""
        if len(self.shards) == 1:
            return self.shards[0][name](keys, default)
        out, shard = np.empty(len(keys)), np.searchsorted(self.edges, keys, side="right")
        for k, tables in enumerate(self.shards):
            at = np.flatnonzero(shard == k)
            out[at] = tables[name](keys[at], default)
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words and negative log10 probability, the end mark included, of every text."""
        words, nll = [], []
        for begin, end in slices(texts):
            hashes, _, _, first = self.hasher(texts[begin:end])
            w1, w2, w3, start = trigrams(hashes, first)
            p = self.join("p1", w3, self.unknown)
            g2 = self.join("g2", w2, -1.0)
            known = np.flatnonzero(g2 >= 0)  # an unseen context hands everything down
            p[known] = self.join("a2", both(w2[known], w3[known]), 0.0) + g2[known] * p[known]
            k12 = both(w1[known], w2[known])
            g3 = self.join("g3", k12, -1.0)
            deep = g3 >= 0
            known, k12, g3 = known[deep], k12[deep], g3[deep]
            p[known] = self.join("a3", both(k12, w3[known]), 0.0) + g3 * p[known]
            words.append(np.diff(first))
            nll.append(-np.add.reduceat(np.log10(p), start[:-1]))
        return np.concatenate(words), np.concatenate(nll)


class Dealt:
    """Where the triples of words go: to the bucket of their middle word, those of a hot middle word to the buckets of its parts by their first word."""

    def __init__(self, buckets: int, hot: dict[int, int], often: np.ndarray):
        """often: hashes of frequent words, in order; their places are their codes, other words are their hashes."""
        self.buckets, self.often = buckets, often
        self.hot = np.array(sorted(hot), np.uint64)
        self.parts = np.array([hot[w] for w in sorted(hot)], np.uint64)

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        at, there = place_of(self.often, hashes)
        return np.where(there, at.astype(np.uint64), hashes)

    def places(self, words: np.ndarray) -> np.ndarray:
        return (spread(words) % np.uint64(self.buckets)).astype(np.int64)

    def is_hot(self, words: np.ndarray) -> np.ndarray:
        return np.isin(words, self.hot)

    def __call__(self, words: np.ndarray, i1: np.ndarray, i2: np.ndarray) -> np.ndarray:
        """Bucket of every triple, given the distinct words and the places of the first two words among them."""
        out = self.places(words)[i2]
        if len(self.hot) and (hot := self.is_hot(words)).any():
            at = np.flatnonzero(hot[i2])
            middle = words[i2[at]]
            part = spread(words[i1[at]] ^ JOIN) % self.parts[np.searchsorted(self.hot, middle)]
            out[at] = self.places(middle + part * JOIN)
        return out

    def rows(self) -> list[tuple[int, int]]:
        """Every hot word with each bucket that has a part of it."""
        return [(int(w.view(np.int64)), int(b)) for w, n in zip(self.hot, self.parts, strict=True) for b in np.unique(self.places(w + np.arange(int(n), dtype=np.uint64) * JOIN))]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Name and number of learnt rows of the distinct texts of some ``CHUNK_BYTES``, their words, and each text's first word."""
    hasher = WordHasher(ascii_space_words(), fold_case=False)

    def whole(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        names, index, inverse = np.unique(np.concatenate([x.column("h").to_numpy() for x in held]), return_index=True, return_inverse=True)
        learnt = np.concatenate([x.column("learnt").to_numpy(zero_copy_only=False) for x in held])
        parts, base, first = [], 0, [np.zeros(1, np.int64)]
        order = np.argsort(index)  # the texts as they stand
        edges = np.cumsum([0, *(x.num_rows for x in held)])
        for x, low, high in zip(held, edges[:-1], edges[1:], strict=True):
            mine = index[order][(index[order] >= low) & (index[order] < high)] - low
            texts = x.column("text").take(pa.array(mine))
            for begin, end in slices(texts, CHUNK_BYTES // 4):
                words, _, _, starts = hasher(texts[begin:end])
                parts.append(words)
                first.append(starts[1:] + base)
                base += len(words)
        return names[order], np.bincount(inverse, learnt, len(names)).astype(np.int64)[order], np.concatenate(parts), np.concatenate(first)

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column("text").nbytes
        if size >= CHUNK_BYTES:
            yield whole(held)
            held, size = [], 0
    if held:
        yield whole(held)


def dealing(texts: DataFrame) -> Dealt:
    """Buckets of some ``BUCKET_WORDS`` words; words that alone have more are hot. The ``HEAD`` most frequent words get codes.

    Words that a chunk has once are not counted: which words have codes, and which are hot, changes no result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, words, first in chunks(batches):
            found, n = np.unique(words, return_counts=True)
            often = n > 1
            key = np.concatenate((np.array([0, BEGIN], np.uint64), found[often]))  # no word is 0: it stands for all
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.concatenate(([len(words) + len(first) - 1, len(first) - 1], n[often])))], ["w", "n"])

    sums = texts.mapInArrow(run, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    top = sums.orderBy(F.desc("n"), "w").limit(HEAD).toArrow()  # HEAD rows; all words together are more than any
    words, n = top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()
    total = int(n[0]) if len(n) else 0
    often, hot = np.sort(words[1:][words[1:] != BEGIN]), n[1:] > BUCKET_WORDS  # a mark has no code
    dealt = Dealt(-(-total // BUCKET_WORDS) or 1, {}, often)
    return Dealt(dealt.buckets, {int(w): -(-int(k) // BUCKET_WORDS) for w, k in zip(dealt.codes(words[1:][hot]), n[1:][hot], strict=True)}, often)


def squeezed(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), "zstd", asbytes=True)


def restored(raw: bytes, kind: type, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, n * np.dtype(kind).itemsize, "zstd"), kind)


def planes(values: np.ndarray) -> np.ndarray:
    """The bytes of the values, all first ones before all second ones."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)


def packed(texts: DataFrame, head: Broadcast, turn: int, turns: int) -> DataFrame:
    """The triples of words of the texts, a row per chunk and bucket: its words once, its triples as places among them, in the order of the texts.

    Only buckets whose number leaves ``turn`` when divided by ``turns``; head: the broadcast ``Dealt``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt = head.value
        for names, learnt, words, first in chunks(batches):
            found, place = coded(words, dealt)
            i1, i2, i3, start = trigrams(place[:-2], first, place[-2], place[-1])
            text = np.repeat(np.arange(len(names), dtype=np.int32), np.diff(start))
            bucket = dealt(found, i1, i2)
            mine = np.flatnonzero(bucket % turns == turn)
            mine = mine[np.argsort((bucket[mine] // turns).astype(np.min_scalar_type(dealt.buckets)), kind="stable")]
            cuts = np.flatnonzero(np.diff(bucket[mine], prepend=-1))
            for at in np.split(mine, cuts[1:]) if len(mine) else ():
                three = np.concatenate((i1[at], i2[at], i3[at]))
                used = np.zeros(len(found), bool)
                used[three] = True
                own = found[used]
                short = (np.cumsum(used) - 1).astype(np.uint16 if len(own) <= 1 << 16 else np.uint32)
                each = np.bincount(text[at], minlength=len(names))
                there = np.flatnonzero(each)
                columns = [names[there].tobytes(), squeezed(learnt[there].astype(np.int32)), squeezed(each[there].astype(np.int32)), squeezed(planes(np.diff(own, prepend=np.uint64(0)))), squeezed(planes(short[three]))]
                yield pa.RecordBatch.from_arrays([pa.array([int(bucket[at[0]])]), *[pa.array([x], pa.binary()) for x in columns], pa.array([len(own)]), pa.array([len(at)])], ["b", "names", "learnt", "each", "words", "triples", "n_words", "n_triples"])

    return texts.mapInArrow(run, PACKED)


def coded(words: np.ndarray, dealt: Dealt) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the distinct words and the two marks, in order, and the place of every word and of the marks among them."""
    found, place = np.unique(np.concatenate((words, np.array([BEGIN, END], np.uint64))), return_inverse=True)
    codes = dealt.codes(found)
    order = np.argsort(codes)
    back = np.empty(len(order), np.int32)
    back[order] = np.arange(len(order), dtype=np.int32)
    return codes[order], back[place]


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names of the texts, learnt rows of each, text of every triple, the words, and the places of each triple's three among them."""
    n = row["n_words"]
    words = np.cumsum(restored(row["words"], np.uint8, 8 * n).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)
    short = np.uint16 if n <= 1 << 16 else np.uint32
    size = np.dtype(short).itemsize
    places = restored(row["triples"], np.uint8, 3 * row["n_triples"] * size).reshape(size, -1).T.copy().view(short).reshape(3, -1)
    names = np.frombuffer(row["names"], np.int64)
    return names, restored(row["learnt"], np.int32, len(names)), np.repeat(np.arange(len(names)), restored(row["each"], np.int32, len(names))), words, places


def sums_by(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, the place of one row of each, and the sums of the values."""
    order = np.argsort(key)
    sorted_ = key[order]
    cuts = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(key) else np.zeros(0, np.int64)
    return sorted_[cuts], order[cuts], *[np.add.reduceat(v[order], cuts) if len(key) else v for v in values]


class Counted:
    """The learnt triples of a bucket: distinct by key, with their words and counts."""

    def __init__(self, rows: Packed):
        held, size = [self.distinct([np.zeros(0, np.uint64)] * 3 + [np.zeros(0, np.int64)])], 0
        for row in rows:
            _, learnt, text, words, places = unpacked(row)
            at = np.flatnonzero(learnt[text])
            w1, w2, w3 = words[places]
            held.append(self.distinct([w1[at], w2[at], w3[at], learnt[text[at]].astype(np.int64)]))
            size += len(held[-1][0])
            if size > 2 * BUCKET_WORDS:
                held, size = [self.distinct([np.concatenate(x) for x in zip(*held, strict=True)])], 0
        self.w1, self.w2, self.w3, self.c = self.distinct([np.concatenate(x) for x in zip(*held, strict=True)])
        self.k12, self.k23 = both(self.w1, self.w2), both(self.w2, self.w3)
        self.k123 = both(self.k12, self.w3)  # in order

    @staticmethod
    def distinct(columns: list[np.ndarray]) -> list[np.ndarray]:
        w1, w2, w3, c = columns
        _, at, n = sums_by(both(both(w1, w2), w3), c)
        return [w1[at], w2[at], w3[at], n]


def values_of(table: tuple[np.ndarray, np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """Values by sorted keys; nan for other keys. Codes are no hashes, so ``Index`` does not serve."""
    at, there = place_of(table[0], wanted)
    return np.where(there, table[1][at], np.nan) if len(table[0]) else np.full(len(wanted), np.nan)


class Packed:
    """The packed rows of a table, one at a time."""

    def __init__(self, table: pa.Table):
        self.table, self.at = table, np.flatnonzero(table.column("words").is_valid().to_numpy())

    def __iter__(self) -> Iterator[dict]:
        for k in self.at:
            yield {n: self.table.column(n)[int(k)].as_py() for n in ("names", "learnt", "each", "words", "triples", "n_words", "n_triples")}


def count_bucket(table: pa.Table, dealt: Dealt) -> pa.Table:
    """What a bucket adds to the counts: counts of counts of triples (kind 3) and pairs (2), pairs that end with a word (1), and firsts of pairs with a hot word (4)."""
    known = Counted(Packed(table))
    out = []

    def add(kind: int, w2: np.ndarray, w3: np.ndarray, n: np.ndarray) -> None:
        out.append([np.full(len(w3), kind), np.full(len(w3), table.column("b")[0].as_py()), w2.view(np.int64), w3.view(np.int64), n])

    def classes(kind: int, counts: np.ndarray) -> None:
        found, n = np.unique(np.minimum(counts, 5), return_counts=True)
        add(kind, np.zeros(len(found), np.uint64), found.astype(np.uint64), n)

    classes(3, known.c)
    _, at, c2 = sums_by(known.k23, np.ones(len(known.c), np.int64))
    w2, w3, hot = known.w2[at], known.w3[at], dealt.is_hot(known.w2[at])
    classes(2, c2[~hot])
    words, n = np.unique(w3[~hot], return_counts=True)
    add(1, np.zeros(len(words), np.uint64), words, n)
    add(4, w2[hot], w3[hot], c2[hot])
    return pa.table([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], ["kind", "b", "w2", "w3", "n"])


def place_of(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted ones among the sorted keys, and whether they are there."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, (keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool))


def score_bucket(table: pa.Table, dealt: Dealt, p1: tuple[np.ndarray, np.ndarray], d2: tuple, d3: tuple) -> pa.Table:
    """(h, s, whole): what the pairs and triples of a bucket add to the negative log10 probability of each text beyond that of its words;
    whole counts the text where its first word is.

    Besides packed rows the bucket has words with their probability (kind 1) and the pairs of its hot words (kind 4).
    """
    side = table.select(["kind", "w2", "w3", "n", "p"]).filter(table.column("words").is_null())
    kind, w2, w3, c, p = (side.column(n).to_numpy() for n in side.column_names)
    rows = Packed(table)
    w2, w3 = w2.astype(np.int64).view(np.uint64), w3.astype(np.int64).view(np.uint64)
    c, p = c.astype(np.int64), p.astype(np.float64)
    off = lambda n, d: np.where(n == 1, d[0], np.where(n == 2, d[1], d[2]))
    known = Counted(rows)
    keys12, _, total3, left3 = sums_by(known.k12, known.c, off(known.c, d3))
    g3 = left3 / total3
    at12, _ = place_of(keys12, known.k12)
    a3 = (known.c - off(known.c, d3)) / total3[at12]

    k23, at, c2 = sums_by(known.k23, np.ones(len(known.c), np.int64))
    own = ~dealt.is_hot(known.w2[at])
    four = kind == 4
    second, third = np.concatenate((known.w2[at][own], w2[four])), np.concatenate((known.w3[at][own], w3[four]))
    keys23, at, c2 = sums_by(both(second, third), np.concatenate((c2[own], c[four])))
    second, third = second[at], third[at]
    rest, at = sums_by(w3)
    words_p = values_of(p1, third)
    beyond = np.flatnonzero(np.isnan(words_p))
    words_p[beyond] = p[at][place_of(rest, third[beyond])[0]] if len(rest) else np.nan
    keys2, _, total2, left2 = sums_by(second, c2, off(c2, d2))
    g2 = left2 / total2
    at2, _ = place_of(keys2, second)
    p2 = (c2 - off(c2, d2)) / total2[at2] + g2[at2] * words_p

    names, sums, whole = [], [], []
    for row in rows:
        name, _, text, words, places = unpacked(row)
        value = np.zeros(len(text))
        at, seen = place_of(keys2, words)
        todo = np.flatnonzero(seen[places[1]])  # an unseen context adds nothing
        w1, w2, w3 = words[places]
        if len(todo):
            value[todo] = g2[at[places[1][todo]]]
            k12, k23 = both(w1[todo], w2[todo]), both(w2[todo], w3[todo])
            at23, pair = place_of(keys23, k23)
            lower = np.where(pair, p2[at23], value[todo])
            at12, deep = place_of(keys12, k12)
            full = np.where(deep, g3[at12], 1.0) * lower if len(keys12) else lower
            if len(a3):
                maybe = np.flatnonzero(pair & deep)  # a learnt triple has both
                at123, triple = place_of(known.k123, both(k12[maybe], w3[todo[maybe]]))
                full[maybe] += np.where(triple, a3[at123], 0.0)
            value[todo] = -np.log10(full) + np.where(pair, np.log10(words_p[at23]), 0.0)
        names.append(name)
        sums.append(np.bincount(text, value, len(name)))
        whole.append(np.bincount(text[w2 == BEGIN], minlength=len(name)))
    return pa.table([pa.array(np.concatenate(x)) for x in (names, sums, whole)], ["h", "s", "whole"]) if names else pa.table([pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.int64())], ["h", "s", "whole"])


def marked(docs: DataFrame, learnt: DataFrame | None, doc_id: str, text: str) -> DataFrame:
    """Texts with words, the 64-bit hash h of each, and whether their id is learnt (none: no id is)."""
    texts = docs.filter(has_word(F.col(f"`{text}`"))).select(F.col(f"`{doc_id}`").alias("__id"), F.xxhash64(F.col(f"`{text}`")).alias("h"), F.col(f"`{text}`").alias("text"))
    if learnt is None:
        return texts.select("h", "text", F.lit(False).alias("learnt"))
    ids = learnt.select(F.col("id").alias("__id"), F.lit(True).alias("learnt"))
    ids = F.broadcast(ids) if learnt.count() <= LEARNT_IDS else ids
    return texts.join(ids, "__id", "left").select("h", "text", F.coalesce("learnt", F.lit(False)).alias("learnt"))


def large_scores(texts: DataFrame) -> DataFrame:
    """(h, n_words, __nll) per distinct text of ``marked`` rows under the model of the learnt ones.

    Triples meet in the bucket of their middle word, which knows all pairs and triples with it; the buckets
    of a hot word get its pairs. All texts are dealt in ``TURNS`` turns, so that only a part of the triples lies on disk at a time.
    """
    spark = texts.sparkSession
    dealt = dealing(texts)
    shared = spark.sparkContext.broadcast(dealt)

    def count(table: pa.Table) -> pa.Table:
        return count_bucket(table, shared.value)

    parts = stored(packed(texts.filter("learnt"), shared, 0, 1).groupBy("b").applyInArrow(count, "kind bigint, b bigint, w2 bigint, w3 bigint, n bigint"), "counts")
    hot = stored(parts.filter("kind = 4").groupBy("w2", "w3").agg(F.sum("n").alias("c")), "hot")
    one = parts.filter("kind = 1").select("w3", "n").union(hot.select("w3", F.lit(1).cast("bigint"))).groupBy("w3").agg(F.sum("n").alias("c"))
    one = stored(one, "words")
    seen = {(r["kind"], r["w3"]): r["n"] for r in parts.filter("kind IN (2, 3)").groupBy("kind", "w3").agg(F.sum("n").alias("n")).collect()}  # ten rows
    for r in hot.groupBy(F.least("c", F.lit(5)).alias("c")).count().collect():
        seen[2, r["c"]] = seen.get((2, r["c"]), 0) + r["count"]
    d2, d3 = (discounts_of({c: n for (k, c), n in seen.items() if k == kind}) for kind in (2, 3))
    a1, g1 = discounted(one.withColumn("all", F.lit(0)), ["all"])
    left = g1.first()
    uniform = (left["g"] if left else 1.0) / (one.count() + 1)
    words = stored(a1.select(F.col("w3").alias("key"), "c", (F.col("a") + F.lit(uniform)).alias("p")), "values")
    top = words.orderBy(F.desc("c"), "key").limit(HEAD).select("key", "p").toArrow()  # HEAD rows
    keys = top.column(0).to_numpy().view(np.uint64)
    order = np.argsort(keys)
    head = spark.sparkContext.broadcast((keys[order], top.column(1).to_numpy()[order]))

    places = spark.createDataFrame(dealt.rows(), "w2 bigint, b bigint")  # a row per bucket and hot word in it
    beside = hot.join(words.select(F.col("key").alias("w3"), "p"), "w3").join(F.broadcast(places), "w2").select("b", F.lit(4).cast("bigint").alias("kind"), "w2", "w3", F.col("c").alias("n"), "p")
    if one.count() > HEAD:
        rest = words.join(words.orderBy(F.desc("c"), "key").limit(HEAD).select("key"), "key", "left_anti").select(F.col("key").alias("w3"), "p")
        beside = beside.union(parts.filter("kind = 1").join(rest, "w3").select("b", "kind", "w2", "w3", "n", "p"))
    beside = stored(beside, "beside")

    def score(table: pa.Table) -> pa.Table:
        return score_bucket(table, shared.value, head.value, d2, d3)

    added = None
    for turn in range(TURNS):
        rows = packed(texts, shared, turn, TURNS).unionByName(beside.filter(F.col("b") % TURNS == turn), allowMissingColumns=True)
        found = rows.groupBy("b").applyInArrow(score, "h bigint, s double, whole bigint").groupBy("h").agg(F.sum("s").alias("s"), F.sum("whole").alias("whole"))
        found = stored(found, "turn")
        added = found if added is None else added.union(found)
    added = added.groupBy("h").agg((F.sum("s") / F.sum("whole")).alias("added"))
    return word_scores(texts, words, shared, head, -float(np.log10(uniform))).join(added, "h").select("h", "n_words", (F.col("__nll") + F.col("added")).alias("__nll"))


def word_scores(texts: DataFrame, words: DataFrame, dealt: Broadcast, head: Broadcast, floor: float) -> DataFrame:
    """(h, n_words, __nll) per distinct text: its words by themselves. The most frequent ones are looked up in the chunk, the others meet their probability in a join."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, _, words, first in chunks(batches):
            found, place = coded(words, dealt.value)
            _, _, i3, start = trigrams(place[:-2], first, place[-2], place[-1])
            text = np.repeat(np.arange(len(names)), np.diff(start))
            p = values_of(head.value, found)[i3]
            rest = np.flatnonzero(np.isnan(p))
            p[rest] = 1.0
            known = np.bincount(text, -np.log10(p), len(names))
            count = np.concatenate((np.diff(first), np.zeros(len(rest), np.int64)))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate((names, found[i3[rest]].view(np.int64)))), pa.array(np.concatenate((names, names[text[rest]]))),
                pa.array(np.concatenate((known, np.full(len(rest), np.nan))), from_pandas=True), pa.array(count), pa.array(np.arange(len(count)) < len(names))], ["key", "h", "known", "n", "whole"])

    found = texts.mapInArrow(run, "key bigint, h bigint, known double, n bigint, whole boolean").join(words.select("key", (-F.log10("p")).alias("v")), "key", "left")
    sums = found.groupBy("h").agg(F.max("n").alias("n_words"), F.count_if("whole").alias("copies"), F.sum(F.when(F.col("whole"), F.col("known")).otherwise(F.coalesce("v", F.lit(floor)))).alias("s"))
    return sums.select("h", "n_words", (F.col("s") / F.col("copies")).alias("__nll"))


def perplexities(docs: DataFrame, shards: list, unknown: float, text: str, slim: bool = False) -> DataFrame:
    """All columns of docs (``slim``: but the text) with n_words and __nll."""
    rest = without(docs, ADDED)
    names = [c for c in rest.columns if not slim or c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shards, unknown)
        for batch in batches:
            if batch.num_rows:
                words, nll = score(batch.column(text))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(words, pa.int64()), pa.array(nll)], [*names, *ADDED])

    return rest.mapInArrow(run, fields(rest.select(*[F.col(f"`{c}`") for c in names])) + ", n_words bigint, __nll double")


def group_of(lang: Column) -> Column:
    """A language as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit("null"))


def thresholds(scored: DataFrame, labels: DataFrame, learnt: DataFrame) -> DataFrame:
    """Per language (and for all together): mean, chosen quantile and cut of the log10 perplexity."""
    judged = labels.join(learnt, "id", "left_anti").join(scored.filter("n_words > 0"), "id")
    judged = judged.select(F.explode(F.array(group_of(F.col("lang")), F.lit("all"))).alias("of"), "trusted", F.col("__nll").alias("nll"), (F.col("n_words") + 1).alias("n"))
    judged = stored(judged, "judged")
    means = judged.filter("trusted").groupBy("of").agg((F.sum("nll") / F.sum("n")).alias("mean"), F.count(F.lit(1)).alias("trusted"))
    means = means.filter((F.col("of") == "all") | (F.col("trusted") >= LEAST_TRUSTED)).select("of", "mean")
    scores = judged.join(means, "of").select("of", "mean", "trusted", smoothed(F.col("nll"), F.col("n"), F.col("mean")).alias("s"))
    cuts = scores.filter("trusted").groupBy("of", "mean").agg(F.percentile_approx("s", list(LEVELS), 10_000).alias("q"))
    cuts = cuts.select("of", "mean", F.posexplode("q").alias("level", "cut"))
    tried = cuts.join(scores.select("of", "trusted", "s"), "of").groupBy("of", "mean", "level", "cut").agg(
        F.avg(F.when(F.col("trusted"), (F.col("s") <= F.col("cut")).cast("double"))).alias("kept"),
        F.avg(F.when(~F.col("trusted"), (F.col("s") > F.col("cut")).cast("double"))).alias("caught"), F.sum((~F.col("trusted")).cast("long")).alias("rejected"))
    value = F.when(F.col("rejected") >= LEAST_REJECTED, F.col("kept") + F.col("caught")).otherwise(F.lit(0.0))
    best = tried.groupBy("of", "mean").agg(F.max(F.struct(F.round(value, 6).alias("v"), "level", "cut")).alias("b"))
    return best.select("of", "mean", F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.col("b.level") + 1).alias("quantile"), F.col("b.cut").alias("cut"))


def smoothed(nll: Column, n: Column, mean: Column) -> Column:
    return (nll + F.lit(PRIOR_TOKENS) * mean) / (n + F.lit(PRIOR_TOKENS))


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", train_rows: int | None = None,
          train_words: int | None = None, shards: int = SHARDS, slim: bool = False, held_words: int = HELD_WORDS) -> DataFrame:
    """All columns of docs (``slim``: id and language only) with n_words, perplexity, threshold, kept.

    Per word; the threshold is that of the document's language, or of all languages together where
    that language has fewer than ``LEAST_TRUSTED`` trusted labelled rows outside the model; a null
    language is one of its own. ``train_rows`` and ``train_words`` bound the rows of the model on demand; without them
    all but the held-out ones are learnt. With less than two trusted texts every document with words is kept. Null and empty texts and texts of white space have no
    words, perplexity null, and are not kept. Repeated rows are judged one by one; contradicting
    labels of an id count as rejected, null labels as none. Columns of the added names are replaced.
    """
    spark = docs.sparkSession
    batch_rows(spark, 1000)
    base = without(docs, ("n_words", "perplexity", "threshold", "kept"))
    marks = stored(labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.min(F.col("quality") > 0).alias("trusted")), "marks")
    unbounded = train_rows is None and train_words is None
    if unbounded:
        learnt = stored(ids_to_learn(base, marks, doc_id, text, lang), "learnt")
        sample = base.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).join(learnt, "id")
        sample = sample.filter(has_word(F.col("text")))
    else:
        sample = stored(training_sample(base, marks, doc_id, text, lang, *(2**31 if most is None else most for most in (train_rows, train_words))), "training")
        learnt = sample.select("id").distinct()
    key = [F.col(f"`{doc_id}`").alias("id"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")]
    if word_total(sample.select("text")) <= held_words:
        model = fit(sample)
        parts = [spark.sparkContext.broadcast(part) for part in cut(model, shards)]
        unknown = float(model["unknown"][1][0])
        scored = stored(perplexities(base.select(*key), parts, unknown, "text", slim=True), "perplexities")
        every_row = lambda: perplexities(base, parts, unknown, text)
    else:
        with shuffles_dropped(spark):
            scores = stored(large_scores(marked(base, learnt, doc_id, text) if unbounded else marked(base, None, doc_id, text).union(marked(sample, learnt, "id", "text"))), "scores")

        def beside(rows: DataFrame) -> DataFrame:
            found = rows.join(scores.withColumnRenamed("h", "__h"), "__h", "left").drop("__h")
            return found.withColumn("n_words", F.coalesce("n_words", F.lit(0).cast("bigint")))

        name = F.xxhash64(key[2]).alias("__h")
        scored = stored(beside(base.select(*key[:2], name)), "perplexities")
        every_row = lambda: beside(base.select("*", name))
    cuts = stored(thresholds(scored, marks, learnt), "thresholds")
    own = cuts.filter("of <> 'all'").select(F.col("of").alias("__of"), F.col("mean").alias("__mean"), F.col("cut").alias("__cut"))
    every = cuts.filter("of = 'all'").agg(F.max("mean").alias("__mean_all"), F.max("cut").alias("__cut_all"))  # a single row
    rows = scored.select(F.col("id").alias(doc_id), F.col("lang").alias(lang), "n_words", "__nll") if slim else every_row()
    joined = rows.join(own, group_of(F.col(f"`{lang}`")) == F.col("__of"), "left").withColumn("__one", F.lit(1)).join(every.withColumn("__one", F.lit(1)), "__one", "left")
    mean, cut_ = F.coalesce("__mean", "__mean_all"), F.coalesce("__cut", "__cut_all")
    score = F.when(F.col("n_words") > 0, smoothed(F.col("__nll"), F.col("n_words") + 1, F.coalesce(mean, F.col("__nll") / (F.col("n_words") + 1))))
    names = [c for c in rows.columns if c not in ADDED]
    return joined.select(*[F.col(f"`{c}`") for c in names], "n_words", F.pow(F.lit(10.0), score).alias("perplexity"), F.pow(F.lit(10.0), cut_).alias("threshold"),
                         (F.coalesce(score <= cut_, F.lit(True)) & (F.col("n_words") > 0)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The kept documents in their own columns."""
    return judge(docs, labels, **options).filter("kept").select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_words", "perplexity", "threshold", "kept")])

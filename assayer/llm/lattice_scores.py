"""LM scoring with a subword lattice: the probability of a text summed over all its segmentations.

The vocabulary is that of an existing piece model; its order gives the first weights, and a few
rounds of expectation-maximisation over the training words give each piece its probability. Pieces
do not cross words, so a text's marginal probability is the product over its words, and each
distinct word is run through the lattice once (log-space forward recursion, many words at a time).
Counts and lattice values of the words come back to the texts in one join; the most frequent words,
a fixed number, are looked up in a broadcast table instead, which also takes the hot join keys away.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.common import batch_rows, stored
from assayer.llm.kneser_ney_quality import Index
from assayer.llm.word_hashes import WordHasher, ascii_space_words, powers, slices, spread

ROUNDS = 2
#: Pseudo-count of every piece, so that none is impossible.
PRIOR = 0.1
FREQUENT = 20_000
WORD_BATCH = 20_000
LONG_WORD = 64
#: Code points of a long word whose edges are held at once.
LONG_WINDOW = 65_536
HELD_OUT = (7, 2)  # modulus and remainder of crc32(id)
END = np.uint64(0x3C79AC492BA7B653)
SPACE = "▁"  # the piece model's mark of a word start


def pieces_of(path: str) -> list[str]:
    """Ordinary pieces of the model in its order; control, unknown and byte pieces are left out."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def log_sum(terms: np.ndarray) -> np.ndarray:
    """Logarithm of the sum of exponentials over the first axis; every column has a finite term."""
    top = terms.max(axis=0)
    return top + np.log(np.exp(terms - top).sum(axis=0))


class Lattice:
    """Log probabilities of words under a unigram piece model.

    Weights: one natural-log probability per piece, then one for a code point that is no piece (spread
    evenly over the values of its UTF-8 bytes), then one for the end of a text.
    """

    def __init__(self, pieces: list[str], weights: np.ndarray):
        self.longest = max(map(len, pieces))
        self.up, self.down = powers(1 << 12)
        hashes = np.array([self._whole(p) for p in pieces], np.uint64)
        order = np.argsort(hashes)
        self.index = Index(hashes[order], order.astype(np.float64))
        self.seen = np.zeros(1 << 22, bool)  # by the top bits: few other strings pass
        self.seen[(hashes >> np.uint64(42)).astype(np.int64)] = True
        self.count = len(pieces)
        self.weights = np.append(weights, -np.inf)  # the last for no edge

    @staticmethod
    def _codes(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)

    def _whole(self, piece: str) -> int:
        codes = spread(self._codes(piece) + np.uint64(1))
        return int(spread(np.sum(codes * self.up[:len(codes)], dtype=np.uint64, keepdims=True))[0])

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece number of the edge of length l + 1 that ends at a code point (count + 2: none), its log weight, and word starts."""
        return self._edges(self._codes("".join(SPACE + w for w in words)), np.array([len(w) + 1 for w in words]))

    def _edges(self, codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start = np.cumsum(size) - size
        n = len(codes)
        if len(self.up) <= n:
            self.up, self.down = powers(n + n // 8 + 1)
        total = np.append(np.uint64(0), np.cumsum(spread(codes + np.uint64(1)) * self.up[:n], dtype=np.uint64))
        place = np.arange(n) - np.repeat(start, size)  # code points before in the word
        numbers = np.full((self.longest, n), self.count + 2, np.int32)
        for l in range(min(self.longest, int(size.max()))):
            at = np.flatnonzero(place >= l)
            wanted = spread((total[at + 1] - total[at - l]) * self.down[at - l])
            may = np.flatnonzero(self.seen[(wanted >> np.uint64(42)).astype(np.int64)])
            numbers[l, at[may]] = self.index(wanted[may], self.count + 2).astype(np.int32)
        values = self.weights[numbers]
        strange = numbers[0] == self.count + 2
        numbers[0, strange] = self.count
        wide = 1 + (codes >= 0x80).astype(int) + (codes >= 0x800) + (codes >= 0x10000)
        values[0, strange] = self.weights[self.count] - math.log(256) * wide[strange]
        return numbers, values, start

    def forward(self, words: list[str]) -> np.ndarray:
        """Natural-log marginal probability of every word."""
        return self._run(words, None)[0]

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of every piece (and of strange code points) in the words, each ``counts`` times."""
        return self._run(words, counts)[1]

    def _run(self, words: list[str], counts: np.ndarray | None):
        out, uses = np.zeros(len(words)), np.zeros(self.count + 3)
        size = np.array([len(w) + 1 for w in words], np.int64)
        short = np.flatnonzero(size <= LONG_WORD)
        short = short[np.argsort(-size[short], kind="stable")]
        for k in range(0, len(short), WORD_BATCH):
            rows = short[k:k + WORD_BATCH]
            self._many([words[i] for i in rows], size[rows], rows, counts, out, uses)
        for i in np.flatnonzero(size > LONG_WORD):
            self._one(words[i], int(i), counts, out, uses)
        return out, uses

    def _many(self, words, size, rows, counts, out, uses) -> None:
        """Words by falling length: the first ones are still running at a position."""
        numbers, values, start = self.edges(words)
        n, most = len(words), int(size[0])
        alpha = np.full((most + 1, n), -np.inf)
        alpha[0] = 0.0
        running = [int(np.searchsorted(-size, -j, side="right")) for j in range(most + 1)]
        for j in range(1, most + 1):
            k = running[j]
            ends = start[:k] + j - 1
            alpha[j, :k] = log_sum(np.stack([alpha[j - l - 1, :k] + values[l, ends] for l in range(min(j, self.longest))]))
        total = alpha[size, np.arange(n)]
        out[rows] = total
        if counts is None:
            return
        beta = np.full((most + 1, n), -np.inf)
        beta[size, np.arange(n)] = 0.0
        for j in range(most - 1, -1, -1):  # words that go on after position j
            terms = []
            for l in range(min(most - j, self.longest)):
                k = running[j + l + 1]
                term = np.full(running[j + 1], -np.inf)
                term[:k] = values[l, start[:k] + j + l] + beta[j + l + 1, :k]
                terms.append(term)
            beta[j, :running[j + 1]] = log_sum(np.stack(terms))
        word = np.repeat(np.arange(n), size)
        place = np.arange(len(word)) - start[word]
        weight = counts[rows]
        for l in range(self.longest):
            ends = np.flatnonzero(numbers[l] < self.count + 2)
            w, j = word[ends], place[ends] + 1
            share = np.exp(alpha[j - l - 1, w] + values[l, ends] + beta[j, w] - total[w]) * weight[w]
            uses += np.bincount(numbers[l, ends], share, minlength=len(uses))

    def _ending(self, codes: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Edges that end at the code points a to b - 1 of a word."""
        begin = max(0, a - self.longest + 1)
        numbers, values, _ = self._edges(codes[begin:b], np.array([b - begin]))
        return numbers[:, a - begin:], values[:, a - begin:]

    def _one(self, word, i, counts, out, uses, window: int = LONG_WINDOW) -> None:
        """A long word position by position; its edges are there for one window at a time."""
        codes, longest, none = self._codes(SPACE + word), self.longest, -math.inf
        n = len(codes)

        def add(terms):
            top = max(terms, default=none)
            return top if top == none else top + math.log(sum(math.exp(t - top) for t in terms))

        alpha = np.full(n + 1, none)
        alpha[0] = 0.0
        for a in range(0, n, window):
            b = min(n, a + window)
            rows, base = self._ending(codes, a, b)[1].T.tolist(), max(0, a - longest)
            near = alpha[base:a + 1].tolist()
            for j in range(a + 1, b + 1):
                row = rows[j - 1 - a]
                near.append(add([near[j - l - 1 - base] + row[l] for l in range(min(j, longest)) if row[l] != none]))
            alpha[a + 1:b + 1] = near[a + 1 - base:]
        out[i] = alpha[n]
        if counts is None:
            return
        beta = np.full(n + 1, none)
        beta[n] = 0.0
        for a in reversed(range(0, n, window)):
            b = min(n, a + window)
            numbers, values = self._ending(codes, a, min(n, b + longest))
            rows, near = values.T.tolist(), [none] * (b - a) + beta[b:min(n, b + longest) + 1].tolist()
            for j in range(b - 1, a - 1, -1):
                near[j - a] = add([rows[j + l - a][l] + near[j + l + 1 - a] for l in range(min(n - j, longest)) if rows[j + l - a][l] != none])
            beta[a:b] = near[:b - a]
            for l in range(min(b, longest)):
                ends = np.arange(max(a, l), b)
                at = ends - a
                uses += np.bincount(numbers[l, at], np.exp(alpha[ends - l] + values[l, at] + beta[ends + 1] - alpha[n]) * counts[i], minlength=len(uses))


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches of short rows joined to tables of about ``rows`` rows."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            yield pa.Table.from_batches(held)
            held, count = [], 0
    if count:
        yield pa.Table.from_batches(held)


def distinct_words(texts: pa.Array, train: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(h, word, n) per slice: every distinct word, lower-cased in A-Z, with its count in training rows."""
    hasher = WordHasher(ascii_space_words())
    for begin, end in slices(texts):
        part = texts[begin:end]
        hashes, starts, ends, first = hasher(part)
        if not len(hashes):
            continue
        key, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        n = np.bincount(inverse.reshape(-1), np.repeat(train[begin:end], np.diff(first)), minlength=len(key)).astype(np.int64)
        raw = b"".join(t.as_buffer().to_pybytes() for t in part if t.is_valid)
        words = [raw[a:b].lower() for a, b in zip(starts[index].tolist(), ends[index].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n)], ["h", "word", "n"])


def word_counts(rows: DataFrame) -> DataFrame:
    """(h, word, c) of every distinct word of rows (text, train)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from distinct_words(batch.column("text"), batch.column("train").to_numpy(zero_copy_only=False).astype(np.int64))

    return rows.select("text", "train").mapInArrow(run, "h bigint, word string, n bigint").groupBy("h").agg(F.first("word").alias("word"), F.sum("n").alias("c"))


def fitted(words: DataFrame, pieces: list[str], texts: int, rounds: int) -> np.ndarray:
    """Weights of the pieces from the training words; per round one pass and one number per piece."""
    spark = words.sparkSession
    rank = np.arange(len(pieces)) + 2.7  # the model's order read as a power law
    uses = np.append(1 / rank / np.sum(1 / rank), [1e-4, 1e-4])
    weights = np.log(uses / uses.sum())
    shared = spark.sparkContext.broadcast(pieces)  # the vocabulary's size bounds it

    for _ in range(rounds):
        def run(batches: Iterator[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            lattice, total = Lattice(shared.value, weights), 0.0
            for part in gathered(batches, WORD_BATCH):
                total = total + lattice.expected(part.column("word").to_pylist(), part.column("c").to_numpy().astype(float))
            if not np.isscalar(total):
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["piece", "uses"])
        found = words.filter("c > 0").select("word", "c").mapInArrow(run, "piece bigint, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()
        uses = np.full(len(pieces) + 2, PRIOR)
        known = found.column("piece").to_numpy()
        inside = known < len(pieces) + 1
        uses[known[inside]] += found.column("uses").to_numpy()[inside]
        uses[-1] += texts
        weights = np.log(uses / uses.sum())
    return weights


def text_rows(rows: DataFrame, frequent, end: tuple[float, float, bool]) -> DataFrame:
    """Per distinct text of a task: one row of sums over its frequent words and its end, and a row per other word.

    ``frequent``: broadcast (hashes, base, lattice, known) in hash order; ``end``: base and lattice of the end and whether it is known.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = WordHasher(ascii_space_words()), set()
        keys, base, lattice, known = frequent.value
        index = Index(keys, np.arange(len(keys), dtype=float))
        for batch in batches:
            names = batch.column("t").to_pylist()
            new = [k for k, t in enumerate(names) if t not in seen and not seen.add(t)]  # copies within a task are one text
            if not new:
                continue
            texts, t = batch.column("text").take(pa.array(new)), np.array([names[k] for k in new], np.int64)
            for begin, stop in slices(texts):
                hashes, _, _, first = hasher(texts[begin:stop])
                n = stop - begin
                at = index(hashes, -1.0).astype(np.int64)
                owner = np.repeat(np.arange(n), np.diff(first))
                here = at >= 0
                mine, slot = owner[here], at[here]
                sums = [np.bincount(mine, w, minlength=n) for w in (base[slot], lattice[slot])]
                counts = [np.bincount(mine, minlength=n) + 1, np.bincount(mine, known[slot], minlength=n).astype(np.int64) + (1 if end[2] else 0)]
                owner, hashes = owner[~here], hashes[~here]
                order = np.lexsort((hashes, owner))
                owner, hashes = owner[order], hashes[order]
                head = np.ones(len(owner), bool)
                head[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
                head = np.flatnonzero(head)
                many = np.diff(np.append(head, len(owner)))
                own, zero = t[begin:stop], np.zeros(len(head), np.int64)
                columns = [np.concatenate(c) for c in (
                    (own, own[owner[head]]), (own, hashes[head].view(np.int64)), (np.zeros(n, np.int64), many), (np.ones(n, np.int64), zero), (counts[0], zero),
                    (counts[1], zero), (sums[0] + end[0], zero.astype(float)), (sums[1] + end[1], zero.astype(float)))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["t", "h", "n", "m", "tokens", "known", "base", "lattice"])

    return rows.select("t", "text").mapInArrow(run, "t bigint, h bigint, n bigint, m bigint, tokens bigint, known bigint, base double, lattice double")


def score(docs: DataFrame, pieces: str, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, frequent: int = FREQUENT) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose crc32(id as text) leaves another remainder than HELD_OUT; a null id reads
    as empty text. Tokens are the words between ASCII white space, A-Z lower-cased, and one end per text;
    a null text is empty, so its only token is the end. base_score: add-one unigram log10 probability;
    score: marginal log10 probability over all segmentations. Repeated rows count as often as they
    occur. Without training rows the vocabulary's order alone gives the weights. Extra columns are
    not read. Texts are told apart by xxhash64, words by a 64-bit hash.
    """
    spark: SparkSession = docs.sparkSession
    batch_rows(spark, 2000)
    modulus, rest = HELD_OUT
    held = F.pmod(F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == rest
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), held.alias("held_out")).withColumns(
        {"train": ~F.col("held_out"), "t": F.xxhash64("text")})
    marks = stored(rows.select("id", "held_out", "t"), "lm-rows")
    words = stored(word_counts(rows), "lm-words")
    texts = marks.filter("NOT held_out").count()
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0)).alias("v")).first()
    n, v = sums["n"] + texts, sums["v"] + (texts > 0)
    names = pieces_of(pieces)
    weights = fitted(words, names, texts, rounds)
    shared = spark.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(shared.value, weights)
        for batch in gathered(batches, WORD_BATCH):
            value = lattice.forward(batch.column("word").to_pylist()) / math.log(10)
            c = batch.column("c").to_numpy()
            base = np.log10((c + 1) / (n + v + 1))
            yield pa.RecordBatch.from_arrays([batch.column("h").combine_chunks(), pa.array(c), pa.array(base), pa.array(value)], ["h", "c", "base_h", "lattice_h"])

    scored = stored(words.mapInArrow(run, "h bigint, c bigint, base_h double, lattice_h double"), "lm-scores")
    top = scored.orderBy(F.desc("c"), "h").limit(frequent).toArrow()  # ``frequent`` rows
    keys = top.column("h").to_numpy().view(np.uint64) if top.num_rows else np.zeros(0, np.uint64)
    order = np.argsort(keys)
    known = (top.column("c").to_numpy() > 0).astype(float)[order]
    table = spark.sparkContext.broadcast((keys[order], top.column("base_h").to_numpy()[order], top.column("lattice_h").to_numpy()[order], known))
    end = (math.log10((texts + 1) / (n + v + 1)), weights[-1] / math.log(10), texts > 0)

    joined = text_rows(rows, table, end).join(scored, "h", "left")
    part = lambda c: F.coalesce(F.col(c), F.lit(0.0)) * F.col("n")
    by_text = joined.groupBy("t").agg(F.sum("m").alias("m"), F.sum(F.col("tokens") + F.col("n")).alias("tokens"), F.sum(F.col("known") + F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"),
                                      F.sum(F.col("base") + part("base_h")).alias("base"), F.sum(F.col("lattice") + part("lattice_h")).alias("lattice"))
    whole = lambda c: (F.col(c) / F.col("m")).cast("bigint")  # noqa: E731  a text met in m tasks was summed m times
    return marks.join(by_text, "t").select(F.col("id").alias(doc_id), "held_out", whole("tokens").alias("n_tokens"), whole("known").alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
                                           (F.col("base") / F.col("m")).alias("base_score"), (F.col("lattice") / F.col("m")).alias("score"))

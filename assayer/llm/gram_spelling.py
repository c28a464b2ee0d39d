"""Spelling variants of the corpus vocabulary by blocked Gram matrices of letter counts.

Every word becomes a vector of letter counts. In a block of words the squared distances of all pairs
come from one NumPy product; one replaced letter makes 2, one inserted or deleted letter makes 1, so
only pairs of equal length at 2 and of adjacent lengths at 1 are left, and their edits are verified.

Blocks are cut so that no near pair is lost and the vocabulary is never squared. Let L be the shorter
length of a pair and h = L // 2: one edit leaves either the first h or the last L - h letters alone. So
words of lengths L and L + 1 meet once by their first h and once by their last L - h letters, and a
pair counts where the beginnings agree, else where the ends agree. A crowded block is dealt into
parts by a hash and every pair of parts is a block of its own.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import stored

LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
#: A letter is lost from a run if this divides the crc32 of ``<doc_id>:<run>``.
LOSS = 31
LETTERS = "A-Za-zÀ-ÿ"
FOLD = {c: c + 32 for c in range(65, 91)}
#: Letters of all words of a part of a block; a block with more is dealt into parts.
BLOCK_LETTERS = 20_000
#: Words that blocks with the same lengths gather before they are multiplied together.
TOGETHER = 192
#: Distinct words that a counting task holds before it hands them on.
HELD_WORDS = 200_000
#: Bytes of the pairs compared at once.
PAIR_BYTES = 32_000_000


def runs_of(doc_id: str | None, text: str | None, find: re.Pattern, least: int) -> Counter:
    """Lower-cased runs of a text with their counts, each after the loss of its letter."""
    folded: Counter = Counter()
    for run, n in Counter(find.findall(text or "")).items():
        folded[run.lower() if run.isascii() else run.translate(FOLD)] += n
    out: Counter = Counter()
    begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in folded.items():
        h = zlib.crc32(run.encode(), begun)
        if h % LOSS == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < least:
                continue
        out[run] += n
    return out


def vocabulary(docs: DataFrame, doc_id: str, text: str, least: int, least_count: int) -> DataFrame:
    """(word, n): the words of all texts with their occurrences. Tasks count first, then the counts are added."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, held = re.compile(f"[{LETTERS}]{{{least},}}"), Counter()
        for batch in batches:
            # One text at a time is a Python string.
            for name, value in zip(batch.column("id"), batch.column("text")):
                held.update(runs_of(name.as_py(), value.as_py(), find, least))
                if len(held) > HELD_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.int64())], ["word", "n"])
                    held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    slim = docs.select(F.col(f"`{doc_id}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text"))
    counts = slim.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= least_count)


def keyed(words: DataFrame, least: int) -> DataFrame:
    """A row for every block a word belongs to: shorter length, side (0 beginning, 1 end) and shared letters."""
    blocks = F.expr(f"""filter(flatten(transform(array(0, 1), d -> array(
        struct(length(word) - d AS short, 0 AS side, substr(word, 1, (length(word) - d) div 2) AS shared),
        struct(length(word) - d AS short, 1 AS side, right(word, length(word) - d - (length(word) - d) div 2) AS shared)))), b -> b.short >= {least})""")
    return words.withColumn("b", F.explode(blocks)).select("word", "n", "b.short", "b.side", "b.shared")


def dealt(rows: DataFrame, block_letters: int) -> DataFrame:
    """Rows with the pair (i, j) of parts of their block and their own part; only crowded blocks have several."""
    names = ["short", "side", "shared"]
    crowded = rows.groupBy(*names).agg(F.sum(F.length("word")).alias("letters")).filter(F.col("letters") > block_letters)
    crowded = crowded.select(*names, F.ceil(F.col("letters") / block_letters).cast("int").alias("parts"))
    rows = rows.join(crowded, names, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select(*names, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "word", "n")


def letter_rows(words: list[str], size: int) -> np.ndarray:
    """Equally long words as rows of letters; all letters lie below 256."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), size)


def letter_counts(rows: np.ndarray, code: np.ndarray, kinds: int, number: type) -> np.ndarray:
    flat = np.arange(len(rows))[:, None] * kinds + code[rows]
    return np.bincount(flat.reshape(-1), minlength=len(rows) * kinds).reshape(len(rows), kinds).astype(number)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all of b: the norms ride along in one product."""
    one = np.ones((len(a), 1), a.dtype), np.ones((len(b), 1), b.dtype)
    norm = (a * a).sum(axis=1, keepdims=True), (b * b).sum(axis=1, keepdims=True)
    return np.hstack([a * a.dtype.type(-2), norm[0], one[0]]) @ np.hstack([b, one[1], norm[1]]).T


def near_pairs(short: np.ndarray, long: np.ndarray, allowed) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of near words; the long rows are numbered after the short ones.

    ``allowed(x, y)`` says which pairs of numbers this block may count.
    """
    size = short.shape[1]
    code = np.zeros(256, np.int64)
    present = np.unique(np.concatenate((short.reshape(-1), long.reshape(-1))))
    code[present] = np.arange(len(present))
    number = np.float32 if size < 2000 else np.float64  # products stay whole numbers
    a, b = letter_counts(short, code, len(present), number), letter_counts(long, code, len(present), number)
    found = []
    step = max(1, PAIR_BYTES // (size * max(len(short), len(long), 1)))
    for begin in range(0, len(short), step):
        x, y = np.nonzero(squared(a[begin:begin + step], a[begin:]) == 2)
        x, y = x + begin, y + begin
        keep = x < y
        x, y = x[keep], y[keep]
        keep = allowed(x, y)
        x, y = x[keep], y[keep]
        keep = (short[x] != short[y]).sum(axis=1) == 1
        found.append((x[keep], y[keep]))
        x, y = np.nonzero(squared(a[begin:begin + step], b) == 1)
        x = x + begin
        keep = allowed(x, y + len(short))
        x, y = x[keep], y[keep]
        # Equal letters from the front and, shifted by one, from the back must cover the short word.
        front = np.minimum.accumulate(short[x] == long[y, :-1], axis=1).sum(axis=1)
        back = np.minimum.accumulate((short[x] == long[y, 1:])[:, ::-1], axis=1).sum(axis=1)
        keep = front + back >= size
        found.append((x[keep], y[keep] + len(short)))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def multiplied(rows: dict[str, list]) -> pa.RecordBatch | None:
    """Per word of a block: its near words, and the most frequent of them (the least word of equals)."""
    length, words = rows["short"][0], rows["word"]
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    shorts = int((size == length).sum())
    if not shorts:
        return None
    words = [words[k] for k in order]
    side, many = rows["side"][0], np.array(rows["n"], np.int64)[order]
    part, split = np.array(rows["part"])[order], np.array([a != b for a, b in zip(rows["i"], rows["j"])])[order]
    names = [(rows["shared"][k], rows["i"][k], rows["j"][k]) for k in order]
    number: dict = {}
    block = np.array([number.setdefault(x, len(number)) for x in names])
    short, long = letter_rows(words[:shorts], length), letter_rows(words[shorts:], length + 1)
    begin = np.concatenate((short[:, :length // 2], long[:, :length // 2])) if side else None

    def allowed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        keep = (block[x] == block[y]) & ~(split[x] & (part[x] == part[y]))
        if side:  # equal beginnings were met there
            at = np.flatnonzero(keep)
            keep[at] = (begin[x[at]] != begin[y[at]]).any(axis=1)
        return keep

    x, y = near_pairs(short, long, allowed)
    if not len(x):
        return None
    x, y = np.concatenate((x, y)), np.concatenate((y, x))
    rank = np.empty(len(words), np.int64)
    rank[np.array(sorted(range(len(words)), key=words.__getitem__))] = np.arange(len(words))
    order = np.lexsort((rank[y], -many[y], x))
    x, y = x[order], y[order]
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    counts = np.diff(np.append(first, len(x)))
    return pa.RecordBatch.from_arrays([pa.array([words[k] for k in x[first]]), pa.array(counts), pa.array(-many[y[first]]), pa.array([words[k] for k in y[first]])],
                                      ["word", "n_near", "less", "best"])


def met(rows: DataFrame) -> DataFrame:
    """(word, n_near, less, best) from every block; less is the negative count of the best near word."""
    names = ["short", "side", "shared", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            columns = batch.to_pydict()
            key = list(zip(*(columns[c] for c in names)))
            cuts = [k for k in range(1, len(key)) if key[k] != key[k - 1]]
            for begin, end in zip([0, *cuts], [*cuts, len(key)]):
                if held:
                    last = tuple(held[c][-1] for c in names)
                    if last[:2] != key[begin][:2] or last != key[begin] and len(held["word"]) >= TOGETHER:
                        if (out := multiplied(held)) is not None:
                            yield out
                        held = {}
                for c, values in columns.items():
                    held.setdefault(c, []).extend(values[begin:end])
        if held and (out := multiplied(held)) is not None:
            yield out

    return rows.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, "word string, n_near bigint, less bigint, best string")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT,
             ratio: int = RATIO, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words come from maximal runs of letters A-Z, a-z and U+00C0 to U+00FF, lower-cased in A-Z; a run
    loses a letter where the crc32 of ``<doc_id>:<run>`` says so. Words have ``least_letters`` letters
    and ``least_count`` occurrences at least. Two words are near if one insertion, deletion or
    replacement of a code point makes them equal. form is the near word of the largest n (the least of
    equals) if it has ``ratio`` times the word's n; root is reached by following forms. A null text has
    no words, a null id reads as an empty one, repeated rows count again, extra columns are not read,
    and no words give no rows. Words of any length are compared whole.
    """
    words = stored(vocabulary(docs, doc_id, text, least_letters, least_count), "vocabulary")
    near = met(dealt(keyed(words, least_letters), block_letters))
    empty = F.lit(0).cast("bigint")
    # The counts of blocks and the words themselves meet in one grouping.
    rows = words.select("word", "n", empty.alias("n_near"), F.lit(None).cast("struct<less:bigint,best:string>").alias("best"))
    rows = rows.unionByName(near.select("word", empty.alias("n"), "n_near", F.struct("less", "best").alias("best")))
    known = rows.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    formed = -F.col("best.less") >= F.col("n") * ratio
    known = stored(known.select("word", "n", "n_near", F.when(formed, F.col("best.best")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n")), "near-words")
    roots = known.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = known.agg(F.max("n").alias("n")).first()["n"] or 1
    # A chain of k forms needs a last word of least_count * ratio**k; every round doubles the steps taken.
    steps = max(1, int(math.log(max(1, most / least_count), max(2, ratio))) + 1)
    for _ in range((steps - 1).bit_length()):
        above = roots.select(F.col("word").alias("root"), F.col("root").alias("top"))
        roots = stored(roots.join(above, "root", "left").select("word", F.coalesce("top", "root").alias("root")), "roots")
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The columns of the contract in SQL: near words share what is left when a letter goes.
SQL = r"""
WITH RECURSIVE b AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) v(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM b WHERE k < 8),
z AS (SELECT list(c ORDER BY i) AS t FROM b WHERE k = 8),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
g AS (SELECT d, w, count(*) AS n FROM r WHERE length(w) >= 7 GROUP BY ALL),
h AS (SELECT w, n, flatten(list_transform(string_split(d || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END)) AS s FROM g),
c AS (SELECT w, n, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], s), lambda a, x: xor(a >> 8, t[1 + (xor(a, x) & 255)]))) AS h FROM h, z),
a AS (SELECT CASE WHEN h % 31 = 0 THEN w[1:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, n FROM c),
v AS (SELECT word, sum(n)::BIGINT AS n FROM a WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
e AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT x.word, y.word AS other, y.n FROM e x JOIN e y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION SELECT e.word, v.word, v.n FROM e JOIN v ON v.word = e.rest UNION SELECT v.word, e.word, e.n FROM e JOIN v ON v.word = e.rest),
m AS (SELECT word, count(*) AS n_near, max(n) AS best_n FROM p GROUP BY word),
k AS (SELECT word, min(other) AS best FROM p JOIN m USING (word) WHERE n = best_n GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 10 * v.n THEN best END AS form, CASE WHEN best_n >= 10 * v.n THEN best_n END::BIGINT AS form_n FROM v LEFT JOIN m USING (word) LEFT JOIN k USING (word)),
o AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT o.word, o.next, f.form FROM o JOIN f ON f.word = o.next)
SELECT f.word, f.form, o.at AS root, f.n, f.n_near, f.form_n FROM f JOIN o ON o.word = f.word AND o.next IS NULL
"""

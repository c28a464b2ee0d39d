"""Secrets in texts: three fixed patterns and a battery of randomness tests over long tokens.

A token is a run of letters, digits, ``+ / _ -`` of at least 16 characters that mixes kinds of
characters; its alphabet says which encoding it may be. Three tests hold it against a uniform draw
from that alphabet: chi-squared over the symbols, runs above and below the middle, and the correlation
of neighbours. Their squared z-scores add up to the statistic: small means random, and a token that a
uniform draw would hardly make is none.

How random ordinary text looks depends on its length and on the alphabet. So the letters and digits of
all documents are cut, whole and one after another, into windows of the given lengths, which are read in
16, 36 or 62 symbols in turn; the same battery over these windows is the distribution that a token of
that length and kind of alphabet (its band) is compared with: its p-value is the share of windows that
look as random. The Benjamini-Hochberg rule over all tokens of the corpus then bounds the share of
false discoveries. Only two tables of band and statistic, of fixed size, reach the driver.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import arrow_rows, stored
from assayer.llm.word_hashes import slices

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "random")
#: Window lengths; a token is compared with the windows of the longest length that it has.
LENGTHS = (16, 20, 24, 32, 40, 48, 64, 96, 128, 192, 256)
#: Cells of the statistic per unit, and their number.
PER_UNIT, CELLS = 4, 256
FALSE_SHARE = 0.05
#: A uniform draw stays below this statistic in 999 of 1,000 cases (chi-squared with three degrees of freedom).
RANDOM_LIMIT = 16.27

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings by their symbols in order of value, the narrowest first.
ENCODINGS = {
    "hex": DIGITS + "abcdef", "hex_upper": DIGITS + "ABCDEF", "base32": UPPER + "234567", "base36": DIGITS + LOWER, "base36_upper": DIGITS + UPPER,
    "base62": DIGITS + UPPER + LOWER, "base64": UPPER + LOWER + DIGITS + "+/", "base64url": UPPER + LOWER + DIGITS + "-_",
}
SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
TOKEN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("band", pa.int32()), ("cell", pa.int32()), ("encoding", pa.string()), ("statistic", pa.float64())])


def marks(symbols: str) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[np.frombuffer(symbols.encode(), np.uint8)] = True
    return mask


def values(symbols: str) -> np.ndarray:
    """Value of every byte in an encoding, 255 outside of it."""
    out = np.full(256, 255, np.uint8)
    out[np.frombuffer(symbols.encode(), np.uint8)] = np.arange(len(symbols), dtype=np.uint8)
    return out


TOKEN_BYTES, HEX_BYTES = marks(UPPER + LOWER + DIGITS + "+/_-"), marks(DIGITS + "abcdef")
TABLES = {name: (values(symbols), len(symbols)) for name, symbols in ENCODINGS.items()}
#: How windows are read: number of symbols and value of every byte. Letters and digits share 16 symbols, share case, or neither.
FOLDED = np.minimum(values(DIGITS + LOWER), values(DIGITS + UPPER))
READINGS = ((16, np.where(FOLDED < 255, FOLDED % 16, 255)), (36, FOLDED), TABLES["base62"][::-1])
#: The reading that each encoding is compared with.
READING_OF = {"hex": 0, "hex_upper": 0, "base32": 1, "base36": 1, "base36_upper": 1, "base62": 2, "base64": 2, "base64url": 2}
BANDS = len(READINGS) * len(LENGTHS)
CLASSES = tuple(marks(c) for c in (UPPER, LOWER, DIGITS))


def battery(symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, kinds: np.ndarray, most: int) -> np.ndarray:
    """Sum of the three squared z-scores of every run of symbols.

    ``begin`` and ``size`` cut all of ``symbols`` into consecutive runs of two symbols or more; a run is
    held against a uniform draw of ``kinds`` symbols, of which no run has more than ``most``.
    """
    run = np.repeat(np.arange(len(size)), size)
    m, k = size.astype(np.float64), kinds.astype(np.float64)
    counts = np.bincount(run * most + symbols, minlength=len(size) * most).reshape(len(size), most).astype(np.float64)
    chi = (k * (counts * counts).sum(axis=1) / m - m - (k - 1)) / np.sqrt(2 * (k - 1) * (m - 1) / m)
    above = symbols >= (kinds // 2)[run]
    same = np.append(run[1:] == run[:-1], False)
    changes = np.add.reduceat(np.append(above[1:] != above[:-1], False) & same, begin, dtype=np.int64)
    high = np.add.reduceat(above, begin, dtype=np.int64).astype(np.float64)
    mean = 2 * high * (m - high) / m + 1
    spread = (mean - 1) * (mean - 2) / (m - 1)
    # All symbols on one side: as improbable as that many equal tosses.
    runs = np.where(spread > 0, (changes + 1 - mean) ** 2 / np.where(spread > 0, spread, 1), 2 * np.log(2) * (m - 1))
    centred = symbols - ((k - 1) / 2)[run]
    serial = np.add.reduceat(np.append(centred[1:] * centred[:-1], 0.0) * same, begin) * 12 / (k * k - 1) / np.sqrt(m - 1)
    return chi * chi + runs + serial * serial


def cells(statistic: np.ndarray) -> np.ndarray:
    return np.minimum(statistic * PER_UNIT, CELLS - 1).astype(np.int64)


def length_class(size: np.ndarray) -> np.ndarray:
    return np.searchsorted(LENGTHS, size, side="right") - 1


def windows(texts: list[bytes]) -> np.ndarray:
    """Counts by band and cell of all windows of the texts; texts begin with different bands."""
    parts, sizes, readings = [], [], []
    lengths, turn = np.tile(LENGTHS, len(READINGS)), np.repeat(np.arange(len(READINGS)), len(LENGTHS))
    for text in texts:
        raw = np.frombuffer(text, np.uint8)
        raw = raw[FOLDED[raw] < 255]
        many, shift = len(raw) // lengths.sum() + 1, -(zlib.crc32(text) % BANDS)
        cycle = np.tile(np.roll(lengths, shift), many)
        ends = np.cumsum(cycle)
        n = int(np.searchsorted(ends, len(raw), side="right"))
        if n:
            parts.append(raw[:ends[n - 1]])
            sizes.append(cycle[:n])
            readings.append(np.tile(np.roll(turn, shift), many)[:n])
    if not parts:
        return np.zeros(BANDS * CELLS, np.int64)
    size, reading = np.concatenate(sizes), np.concatenate(readings)
    symbols = np.stack([table for _, table in READINGS])[np.repeat(reading, size), np.concatenate(parts)]
    statistic = battery(symbols.astype(np.int64), np.cumsum(size) - size, size, np.array([k for k, _ in READINGS])[reading], READINGS[-1][0])
    return np.bincount((reading * len(LENGTHS) + length_class(size)) * CELLS + cells(statistic), minlength=BANDS * CELLS)


def long_runs(raw: np.ndarray, mask: np.ndarray, least: int) -> list[tuple[int, int]]:
    inside = np.concatenate(([False], mask[raw], [False])).view(np.int8)
    edge = np.flatnonzero(np.diff(inside))
    begin, end = edge[::2], edge[1::2]
    keep = end - begin >= least
    return list(zip(begin[keep].tolist(), end[keep].tolist()))


def encoding_of(token: np.ndarray) -> str | None:
    """The narrowest encoding of a token with two kinds of characters or more; other tokens are plain."""
    if sum(bool(c[token].any()) for c in CLASSES) < 2:
        return None
    return next((name for name, (table, _) in TABLES.items() if (table[token] < 255).all()), None)


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) in bytes of all matches of the fixed patterns."""
    out = []
    if b"=" in text or b":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST["assign"]]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(a, 2, b) for a, b in long_runs(np.frombuffer(text, np.uint8), HEX_BYTES, LEAST["hex"])]
    return sorted(out)


def tokens_of(text: bytes) -> list[tuple[int, int, str]]:
    raw = np.frombuffer(text, np.uint8)
    return [(a, b, name) for a, b in long_runs(raw, TOKEN_BYTES, LENGTHS[0]) if (name := encoding_of(raw[a:b]))]


def places(text: bytes):
    """From places in bytes to places in code points."""
    if text.isascii():
        return lambda at: at
    before = np.append(0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))
    return lambda at: int(before[at])


def examined(texts: list[bytes]) -> tuple[list, list, list]:
    """Per text the base spans, their digest and the tokens with their statistic."""
    spans, digests, tokens, symbols, kinds, at = [], [], [], [], [], []
    for row, text in enumerate(texts):
        base, found = base_spans(text), tokens_of(text)
        if base or found:
            place = places(text)
            base = [(place(a), kind, place(b)) for a, kind, b in base]
            for a, b, name in found:
                table, many = TABLES[name]
                symbols.append(table[np.frombuffer(text, np.uint8)[a:b]])
                kinds.append(many)
                at.append((row, place(a), place(b), name))
        spans.append([dict(zip(("start", "kind", "end"), s)) for s in base])
        digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest())
        tokens.append([])
    if at:
        size = np.fromiter(map(len, symbols), np.int64, len(symbols))
        statistic = battery(np.concatenate(symbols).astype(np.int64), np.cumsum(size) - size, size, np.array(kinds), 64)
        for (row, a, b, name), length, cell, s in zip(at, length_class(size).tolist(), cells(statistic).tolist(), statistic.tolist()):
            tokens[row].append({"start": a, "end": b, "band": READING_OF[name] * len(LENGTHS) + length, "cell": cell, "encoding": name, "statistic": s})
    return spans, digests, tokens


def limits(null: np.ndarray, seen: np.ndarray, share: float) -> list[int]:
    """The last cell of every band that counts as a discovery, -1 for none.

    ``null`` and ``seen``: windows and tokens by band and cell. The p-value of a cell is the share of
    windows of its band that look at least as random, the token itself counted among them, and 1 beyond
    ``RANDOM_LIMIT``; a band without windows discovers nothing.
    """
    p = (1 + np.cumsum(null, axis=1)) / (1 + null.sum(axis=1, keepdims=True))
    p[:, int(RANDOM_LIMIT * PER_UNIT) + 1:] = 1
    order = np.argsort(p, axis=None, kind="stable")
    least, many = p.reshape(-1)[order], np.cumsum(seen.reshape(-1)[order])
    # Cells with one p-value are taken together.
    good = np.flatnonzero((least * max(1, many[-1]) <= share * many) & np.append(least[1:] > least[:-1], True))
    if not len(good):
        return [-1] * len(p)
    return [int((row <= least[good[-1]]).sum()) - 1 for row in p]


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", false_share: float = FALSE_SHARE) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans and found.

    found holds every span (start, end, kind; code points, end exclusive) in the order of start, then
    kind as in ``KINDS``; spans is the same as ``kind:start:end`` joined by commas, and base_sha256 the
    digest of those of the three patterns. Spans of the kind random are tokens that the battery finds,
    unless one of the patterns covers them. A null or empty text has no spans; repeated rows are scanned
    one by one and count again; extra columns are not read; texts of any length are scanned whole.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    slim = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    schema = (f"id {kind}, base array<struct<start:bigint,kind:int,end:bigint>>, base_sha256 string, "
              "tokens array<struct<start:bigint,end:bigint,band:int,cell:int,encoding:string,statistic:double>>, cell int, windows bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, names, id_type = np.zeros(BANDS * CELLS, np.int64), ["id", "base", "base_sha256", "tokens", "cell", "windows"], None
        for batch in batches:
            id_type = batch.schema.field("id").type
            for begin, end in slices(batch.column("text")):
                texts = pc.fill_null(batch.column("text")[begin:end], "").cast(pa.large_string()).cast(pa.large_binary()).to_pylist()
                counts += windows(texts)
                spans, digests, tokens = examined(texts)
                yield pa.RecordBatch.from_arrays([batch.column("id")[begin:end], pa.array(spans, pa.list_(SPAN)), pa.array(digests), pa.array(tokens, pa.list_(TOKEN)),
                                                  pa.nulls(len(texts), pa.int32()), pa.nulls(len(texts), pa.int64())], names)
        used = np.flatnonzero(counts)
        if len(used):  # rows of the windows: no digest, a cell
            none = len(used)
            yield pa.RecordBatch.from_arrays([pa.nulls(none, id_type), pa.nulls(none, pa.list_(SPAN)), pa.nulls(none, pa.string()), pa.nulls(none, pa.list_(TOKEN)),
                                              pa.array(used, pa.int32()), pa.array(counts[used])], names)

    with arrow_rows(docs.sparkSession, 1000):
        rows = stored(slim.mapInArrow(run, schema), "spans")
    null, seen = np.zeros((2, BANDS * CELLS), np.int64)
    for r in rows.filter("cell IS NOT NULL").groupBy("cell").agg(F.sum("windows").alias("n")).collect():  # at most one row for each cell
        null[r["cell"]] = r["n"]
    place = (F.col("t.band") * CELLS + F.col("t.cell")).alias("cell")
    for r in rows.select(F.explode("tokens").alias("t")).groupBy(place).agg(F.count(F.lit(1)).alias("n")).collect():
        seen[r["cell"]] = r["n"]
    last = F.array(*[F.lit(n) for n in limits(null.reshape(-1, CELLS), seen.reshape(-1, CELLS), false_share)])
    named = lambda x, number, name: F.struct(x["start"].alias("start"), number.alias("number"), x["end"].alias("end"), name.alias("kind"))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    covered = lambda t: F.exists("base", lambda b: (b["start"] <= t["start"]) & (b["end"] >= t["end"]))
    found = F.filter("tokens", lambda t: (t["cell"] <= F.get(last, t["band"])) & ~covered(t))
    every = F.sort_array(F.concat(F.transform("base", lambda b: named(b, b["kind"], F.get(kinds, b["kind"]))), F.transform(found, lambda t: named(t, F.lit(3), F.lit("random")))))
    out = rows.filter("cell IS NULL").withColumn("every", every)
    many = lambda k: F.size(F.filter("every", lambda s: s["number"] == k)).cast("long")
    return out.select(
        F.col("id").alias(doc_id), *[many(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], "base_sha256",
        F.array_join(F.transform("every", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"),
        F.transform("every", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("found"))

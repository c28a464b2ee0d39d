"""Token ids of a corpus as one wavelet matrix per shard.

Documents are range-partitioned by id (a second key splits an id that many rows share), encoded,
and written in id order as files of bounded size; the manifest of the files is a table. A file
holds bit-planes (most significant bit first, each stably partitioned by the plane above), which
answer access, counting and occurrence lookup through rank and select, and the ids and lengths of
its documents. Reading back needs the files and the manifest only.

A task writes under a name of its own attempt and only names in the manifest count, so a repeated
task does no harm. Paths go through pyarrow.fs, hence any store it knows.
"""

from __future__ import annotations

import array
import functools
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.llm.common import batch_rows, scratch, stored
from assayer.llm.kneser_ney_quality import Index
from assayer.llm.word_hashes import byte_values, powers, slices, spread

MAGIC = b"WMTX0001"
BLOCK = 512  # bits between two entries of the rank directory
#: Tokens after which a file is closed; the last document may go beyond.
FILE_TOKENS = 4_000_000
#: Bytes of text encoded at once: a task's working memory is some forty times that.
SLICE_BYTES = 1_500_000
#: Distinct pieces a worker remembers, at some 40 bytes each.
CACHE_CHUNKS = 1_000_000
END_ID = 2
PUNCTUATION = ".,!?;:*$&%#|"
#: How the vocabulary writes a space, and pieces that begin with one in a text for the library.
SPACE_MARK, JOINED = "\u0120", 200
MANIFEST = "part int, file int, path string, docs bigint, tokens bigint, bytes bigint"


class WaveletMatrix:
    """A sequence of symbols below 2**levels as bit-planes with rank and select."""

    def __init__(self, planes: list[np.ndarray], zeros: list[int], n: int):
        self.planes, self.zeros, self.n, self.levels = planes, zeros, n, len(planes)

    @classmethod
    def of(cls, ids: np.ndarray, levels: int) -> WaveletMatrix:
        planes, zeros, now = [], [], np.asarray(ids)
        for shift in range(levels - 1, -1, -1):
            bit = (now & now.dtype.type(1 << shift)).astype(bool)
            planes.append(np.packbits(bit, bitorder="little"))
            zeros.append(len(now) - int(np.count_nonzero(bit)))
            if shift:
                now = np.concatenate((np.compress(~bit, now), np.compress(bit, now)))
        return cls(planes, zeros, len(now))

    @functools.cached_property
    def directory(self) -> list[np.ndarray]:
        """Ones before every block of a plane."""
        out = []
        for plane in self.planes:
            ones = np.bitwise_count(np.pad(plane, (0, -len(plane) % (BLOCK // 8)))).reshape(-1, BLOCK // 8).sum(axis=1)
            out.append(np.append(0, np.cumsum(ones, dtype=np.int64)))
        return out

    def _ones(self, level: int, i: int) -> int:
        """Ones of a plane before position i."""
        plane, block = self.planes[level], i // BLOCK
        count, byte = int(self.directory[level][block]), i >> 3
        count += int(np.bitwise_count(plane[block * (BLOCK // 8):byte]).sum())
        return count + (int(plane[byte]) & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else count

    def _place(self, level: int, k: int, bit: int) -> int:
        """Position of the k-th (from 0) such bit of a plane."""
        low, high = 0, self.n
        while low < high:  # first i with more than k such bits in [0, i]
            middle = (low + high) // 2
            ones = self._ones(level, middle + 1)
            low, high = (low, middle) if (ones if bit else middle + 1 - ones) > k else (middle + 1, high)
        return low

    def access(self, i: int) -> int:
        symbol = 0
        for level in range(self.levels):
            bit = int(self.planes[level][i >> 3]) >> (i & 7) & 1
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            symbol = symbol << 1 | bit
        return symbol

    def _range(self, symbol: int, low: int, high: int) -> tuple[int, int]:
        for level in range(self.levels):
            a, b = self._ones(level, low), self._ones(level, high)
            bit = symbol >> (self.levels - 1 - level) & 1
            low, high = (self.zeros[level] + a, self.zeros[level] + b) if bit else (low - a, high - b)
        return low, high

    def count(self, symbol: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of the symbol in [low, high)."""
        if symbol < 0 or symbol >> self.levels:
            return 0
        low, high = self._range(symbol, low, self.n if high is None else high)
        return high - low

    def select(self, symbol: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence, -1 if there are fewer."""
        if not 0 <= k < self.count(symbol):
            return -1
        i = self._range(symbol, 0, self.n)[0] + k
        for level in range(self.levels - 1, -1, -1):
            bit = symbol >> (self.levels - 1 - level) & 1
            i = self._place(level, i - self.zeros[level] if bit else i, bit)
        return i

    def locate(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]

    def decode(self) -> np.ndarray:
        """All symbols: the partitions are undone from the last plane up."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level in range(self.levels - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").astype(bool)
            before = np.empty_like(now)
            before[np.flatnonzero(~bit)] = now[:self.zeros[level]]
            before[np.flatnonzero(bit)] = now[self.zeros[level]:] | kind(1 << (self.levels - 1 - level))
            now = before
        return now


def to_bytes(matrix: WaveletMatrix, doc_ids: np.ndarray, missing: np.ndarray, lengths: np.ndarray) -> bytes:
    """The file: magic, counts, zeros per plane, then compressed planes and document columns by size."""
    pack = pa.Codec("zstd", compression_level=1)
    parts = [*matrix.planes, doc_ids.astype("<i8"), missing.astype("u1"), lengths.astype("<i8")]
    raw = [np.ascontiguousarray(p).tobytes() for p in parts]
    packed = [pack.compress(r, asbytes=True) if r else b"" for r in raw]
    head = struct.pack("<8sQQQ", MAGIC, matrix.n, matrix.levels, len(doc_ids))
    sizes = struct.pack(f"<{matrix.levels}Q{2 * len(raw)}Q", *matrix.zeros, *(x for r, p in zip(raw, packed) for x in (len(r), len(p))))
    return head + sizes + b"".join(packed)


def from_bytes(data: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray, np.ndarray]:
    magic, n, levels, _ = struct.unpack_from("<8sQQQ", data)
    if magic != MAGIC:
        raise ValueError("Not a wavelet token file.")
    numbers = struct.unpack_from(f"<{levels}Q{2 * (levels + 3)}Q", data, 32)
    zeros, sizes = list(numbers[:levels]), numbers[levels:]
    pack, at, parts = pa.Codec("zstd"), 32 + 8 * len(numbers), []
    for size, packed in zip(sizes[::2], sizes[1::2]):
        parts.append(pack.decompress(data[at:at + packed], size, asbytes=True) if size else b"")
        at += packed
    planes = [np.frombuffer(p, np.uint8) for p in parts[:levels]]
    return (WaveletMatrix(planes, zeros, n), np.frombuffer(parts[-3], "<i8"), np.frombuffer(parts[-2], "u1").astype(bool),
            np.frombuffer(parts[-1], "<i8"))


@functools.lru_cache(maxsize=2)
def tokenizer_of(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core already
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


class Remembered:
    """Ids of pieces by the 64-bit hash of a piece, in flat arrays; what was not asked for lately goes first."""

    def __init__(self, limit: int):
        self.limit, self.turn = limit, 0
        self.flat, self.start, self.length, self.asked = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.keys = np.zeros(0, np.uint64)
        self.main, self.indexed = Index(self.keys, np.zeros(0)), 0
        self.recent = self.main

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of every key, -1 if there is none."""
        out = self.main(keys, -1.0)
        lost = np.flatnonzero(out < 0)
        if len(lost) and self.recent.size:
            out[lost] = self.recent(keys[lost], -1.0)
        return out.astype(np.int64)

    def add(self, keys: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Takes up new distinct keys; the large index is made anew only when the small one has grown."""
        self.start = np.append(self.start, len(self.flat) + np.cumsum(lengths) - lengths)
        self.length, self.flat, self.keys = np.append(self.length, lengths), np.append(self.flat, ids), np.append(self.keys, keys)
        self.asked = np.append(self.asked, np.full(len(keys), self.turn, np.int32))
        if (len(self.keys) - self.indexed) * 8 > self.indexed:
            self.main, self.indexed, self.recent = self._index(0), len(self.keys), self._index(len(self.keys))
        else:
            self.recent = self._index(self.indexed)

    def _index(self, begin: int) -> Index:
        order = np.argsort(self.keys[begin:])
        return Index(self.keys[begin:][order], (order + begin).astype(np.float64))

    def used(self, entries: np.ndarray) -> None:
        self.asked[entries] = self.turn
        self.turn += 1

    def trim(self) -> None:
        """Keeps the half that was asked for last, once there are too many entries."""
        if len(self.keys) <= self.limit:
            return
        keep = np.sort(np.argsort(self.asked, kind="stable")[-(self.limit // 2):])
        many = self.length[keep]
        begin = np.cumsum(many) - many
        self.flat = self.flat[np.repeat(self.start[keep] - begin, many) + np.arange(many.sum())]
        self.keys, self.length, self.asked, self.start = self.keys[keep], many, self.asked[keep], begin
        self.main, self.indexed, self.recent = self._index(0), len(keep), self._index(len(keep))


class Encoder:
    """Encodes texts with the tokenizers library, each distinct piece between single spaces once.

    The vocabulary's pattern starts a new piece at every space that stands between two characters
    other than white space, and where closing punctuation follows letters, so such pieces are
    independent. All pieces of a slice are hashed at once and looked up by their hashes; only those
    not remembered become strings. Texts with other white space next to a space go through the library
    whole.
    """

    def __init__(self, path: str, cache: int):
        self.tokenizer, self.known = tokenizer_of(path), Remembered(cache)
        self.values = byte_values(False)
        self.up, self.down = powers(1 << 16)
        self.leads = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.leads[[i for t, i in self.tokenizer.get_vocab().items() if t[0] == SPACE_MARK]] = True

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in a row, and how many each has."""
        found = [array.array("I", e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.frombuffer(b"".join(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _encode_spaced(self, data: bytes, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces that begin with their only space, in one text per ``JOINED`` pieces: such a
        piece's first token, and no other, begins with the space."""
        ends = np.append(0, np.cumsum(size))
        cuts = np.append(ends[:-1:JOINED], ends[-1]).tolist()
        ids, _ = self._encode([data[a:b].decode() for a, b in zip(cuts, cuts[1:])])
        first = np.flatnonzero(self.leads[ids])
        if len(first) == len(size):
            return ids, np.diff(np.append(first, len(ids)))
        return self._encode([data[a:b].decode() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())])

    def _ids(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray, spaced: np.ndarray) -> np.ndarray:
        """Entry of every piece; ``spaced``: the space before it belongs to it."""
        if len(self.up) <= len(raw):
            self.up, self.down = powers(len(raw) + len(raw) // 8 + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.values[raw] * self.up[:len(raw)], out=total[1:])
        keys = spread((total[end] - total[begin]) * self.down[begin] + spaced.astype(np.uint64))
        self.known.trim()
        entry = self.known.find(keys)
        lost = np.flatnonzero(entry < 0)
        if len(lost):
            new, first, inverse = np.unique(keys[lost], return_index=True, return_inverse=True)
            inverse = inverse.reshape(-1)
            for group in (spaced[lost[first]], ~spaced[lost[first]]):
                at = lost[first[group]]
                if not len(at):
                    continue
                low, size = begin[at] - spaced[at], end[at] - begin[at] + spaced[at]
                data = raw[np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())].tobytes()
                if spaced[at[0]]:
                    found = self._encode_spaced(data, size)
                else:
                    ends = np.cumsum(size).tolist()
                    found = self._encode([data[a:b].decode() for a, b in zip([0, *ends], ends)])
                entry[lost[group[inverse]]] = len(self.known.keys) + (np.cumsum(group) - 1)[inverse[group[inverse]]]
                self.known.add(new[group], *found)
        self.known.used(entry)
        return entry

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and the number of ids of every text."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        low, high = int(bounds[0]), int(bounds[-1])
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[low:high] if high > low else np.zeros(0, np.uint8)
        bounds = bounds - low
        begin, stem, end, owner, whole = pieces(raw, bounds)
        plain = ~whole[owner]
        begin, stem, end, owner = begin[plain], stem[plain], end[plain], owner[plain]
        # A word, then its closing punctuation if that is a piece of its own.
        two = stem < end
        parts = 1 + two
        at = np.cumsum(parts) - parts
        first, last = np.repeat(begin, parts), np.repeat(end, parts)
        last[at], first[at[two] + 1] = stem, stem[two]
        spaced = np.zeros(len(first), bool)
        spaced[at] = begin > bounds[owner]
        entry, text = self._ids(raw, first, last, spaced), np.repeat(owner, parts)
        flat, start, many = self.known.flat, self.known.start[entry], self.known.length[entry]
        odd = np.flatnonzero(whole)
        if len(odd):
            ids, sizes = self._encode([texts[int(i)].as_py() for i in odd])
            order = np.argsort(np.append(text, odd), kind="stable")
            start = np.append(start, len(flat) + np.cumsum(sizes) - sizes)[order]
            many, text, flat = np.append(many, sizes)[order], np.append(text, odd)[order], np.append(flat, ids)
        before = np.cumsum(many) - many
        ids = flat.take(np.repeat(start - before, many) + np.arange(many.sum()))
        return ids, np.bincount(text, many, minlength=len(texts)).astype(np.int64)


def marked(*codes: int) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[list(codes)] = True
    return mask


PLAIN_WHITE = marked(*range(0x09, 0x0E), *range(0x1C, 0x20))
CLOSING = marked(*PUNCTUATION.encode())
ASCII_LETTERS = marked(*range(0x41, 0x5B), *range(0x61, 0x7B))
#: White space beyond ASCII, and the bytes that lead it.
WIDE_LEADS = marked(0xC2, 0xE1, 0xE2, 0xE3)
WIDE_WHITE = {w.encode() for w in "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))}


def pieces(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end of the stem and end of every word between spaces, its text, and which texts must go whole.

    The stem ends before closing punctuation if it is of letters (ASCII and U+00C0 to U+00FF), else with
    the word. A text goes whole if spaces touch each other, one of its ends or other white space.
    """
    n = len(bounds) - 1
    space = raw == 0x20
    edge = np.zeros(len(raw) + 1, bool)
    edge[bounds] = True
    begin = np.flatnonzero(~space & (np.concatenate(([True], space))[:len(raw)] | edge[:-1]))
    end = np.flatnonzero(~space & (np.concatenate((space[1:], [True]))[:len(raw)] | edge[1:])) + 1
    owner = np.searchsorted(bounds, begin, side="right") - 1
    spaces = np.append(0, np.cumsum(space))[bounds]
    whole = np.diff(spaces) != np.maximum(np.bincount(owner, minlength=n) - 1, 0)
    whole[owner[PLAIN_WHITE[raw[begin]] | PLAIN_WHITE[raw[end - 1]]]] = True
    data = raw.tobytes()
    for k in np.flatnonzero(WIDE_LEADS[raw[begin]]).tolist():
        a, b = int(begin[k]), int(end[k])
        if data[a:min(b, a + 2)] in WIDE_WHITE or data[a:min(b, a + 3)] in WIDE_WHITE:
            whole[owner[k]] = True
    for k in np.flatnonzero((raw[np.maximum(end - 2, 0)] == 0xC2) | WIDE_LEADS[raw[np.maximum(end - 3, 0)]]).tolist():
        a, b = int(begin[k]), int(end[k])
        if data[max(a, b - 2):b] in WIDE_WHITE or data[max(a, b - 3):b] in WIDE_WHITE:
            whole[owner[k]] = True
    letter = ASCII_LETTERS[raw]
    wide = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)) if len(raw) else np.zeros(0, np.int64)
    letter[wide] = letter[wide + 1] = True
    last = np.maximum.accumulate(np.where(CLOSING[raw], 0, np.arange(1, len(raw) + 1, dtype=np.int32)))
    stem = last[end - 1].astype(np.int64)
    others = np.append(0, np.cumsum(~letter, dtype=np.int32))
    alone = (stem > begin) & (others[np.maximum(stem, begin)] == others[begin])
    return begin, np.where(alone, stem, end), end, owner, whole


@functools.lru_cache(maxsize=2)
def encoder_of(path: str, cache: int) -> Encoder:
    return Encoder(path, cache)


def write_shards(docs: DataFrame, tokenizer: str, folder: str, id_column: str = "doc_id", text: str = "text",
                 end_id: int = END_ID, file_tokens: int = FILE_TOKENS, cache: int = CACHE_CHUNKS) -> DataFrame:
    """Encode and write all documents in ascending id order (nulls first); the manifest of the files.

    A null text is empty, so the document is the end id alone. Equal ids keep the order of a hash of
    their texts, and rows equal in both are dealt by row, so no id or text fills a partition alone. No rows make no files. Extra columns are not read.
    """
    batch_rows(docs.sparkSession, 5000)
    rows = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text"))
    keys = ["id", "tie", "row"]
    ranged = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(*keys).sortWithinPartitions(*keys).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, number, pending, held = TaskContext.get().partitionId(), 0, [], 0
        encode = encoder_of(tokenizer, cache)
        levels = max(end_id, encode.tokenizer.get_vocab_size() - 1).bit_length()

        def flush():
            nonlocal number, pending, held
            ids = np.concatenate([p[0] for p in pending])
            data = to_bytes(WaveletMatrix.of(ids.astype(np.uint16) if levels <= 16 else ids, levels), *(np.concatenate([p[k] for p in pending]) for k in (1, 2, 3)))
            path = f"{root}/{part:06d}-{number:06d}-{uuid.uuid4().hex}.wm"
            with store.open_output_stream(path) as out:
                out.write(data)
            row = [[part], [number], [path], [sum(len(p[1]) for p in pending)], [len(ids)], [len(data)]]
            number, pending, held = number + 1, [], 0
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["part", "file", "path", "docs", "tokens", "bytes"])

        for batch in batches:
            for begin, end in slices(batch.column("text"), SLICE_BYTES):
                ids, many = encode(batch.column("text")[begin:end])
                ids = np.insert(ids, np.cumsum(many), end_id)
                names = batch.column("id")[begin:end]
                pending.append((ids, pc.fill_null(names, 0).to_numpy(zero_copy_only=False), pc.is_null(names).to_numpy(zero_copy_only=False), many + 1))
                held += len(ids)
                if held >= file_tokens:
                    yield flush()
        if pending:
            yield flush()

    return ranged.mapInArrow(run, MANIFEST)


def opened(folder: str, path: str) -> bytes:
    from pyarrow import fs
    store, _ = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(path) as data:
        return data.read()


def placed(manifest: DataFrame) -> DataFrame:
    """The manifest with the tokens before every file: totals of the partitions first, then within one."""
    totals = manifest.groupBy("part").agg(F.sum("tokens").alias("all"))
    before = F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row per write task
    inside = F.sum("tokens").over(Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    return (manifest.join(totals.select("part", F.coalesce(before, F.lit(0)).alias("before")), "part")
            .withColumn("start", F.col("before") + F.coalesce(inside, F.lit(0))).drop("before"))


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document, decoded from the files: doc_id, start, n_tokens, ids_crc32."""
    files = placed(manifest).select("path", "start", "tokens")
    spread = files.repartition(max(1, manifest.count()), "path")  # one row per file: a task decodes a file or two

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, tokens in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "tokens"))):
                matrix, doc_ids, missing, lengths = from_bytes(opened(folder, path))
                ids = matrix.decode().astype("<u4")
                if len(ids) != tokens:
                    raise ValueError(f"{path}: {len(ids)} tokens, the manifest has {tokens}.")
                ends = np.cumsum(lengths)
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64(), mask=missing), pa.array(start + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spread.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def search(manifest: DataFrame, folder: str, token: int) -> DataFrame:
    """Occurrences of a token from the compressed files alone: path, count and positions in the corpus."""
    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                matrix = from_bytes(opened(folder, path))[0]
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([matrix.count(token)], pa.int64()), pa.array([[start + i for i in matrix.locate(token)]], pa.list_(pa.int64()))],
                                                 ["path", "count", "positions"])
    return placed(manifest).select("path", "start").repartition(max(1, manifest.count()), "path").mapInArrow(run, "path string, count bigint, positions array<bigint>")


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the corpus to new files in the shared folder and read every document back from them."""
    spark: SparkSession = docs.sparkSession
    folder = scratch(spark, "tokens")
    if "://" not in folder and folder.startswith("file:"):
        folder = folder.replace("file:", "file://", 1)
    manifest = stored(write_shards(docs, tokenizer, folder, **options), "manifest")
    return read_shards(manifest, folder)

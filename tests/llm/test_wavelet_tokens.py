import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from assayer.llm import wavelet_tokens as W
from assayer.llm.common import stored

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(rows):
    """Whole texts through the library, one by one."""
    tokenizer, out, start = Tokenizer.from_file(PATH), [], 0
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_matrix_operations():
    ids = np.random.default_rng(1).integers(0, 40, 3000).astype(np.uint16)
    matrix = W.from_bytes(W.to_bytes(W.WaveletMatrix.of(ids, 7), np.array([1]), np.array([False]), np.array([3000])))[0]
    assert (matrix.decode() == ids).all()
    assert [matrix.access(i) for i in range(0, 3000, 97)] == ids[::97].tolist()
    for symbol in (0, 13, 39, 41, 127, 300):
        places = np.flatnonzero(ids == symbol)
        assert matrix.locate(symbol) == places.tolist() and matrix.count(symbol, 100, 2000) == ((places >= 100) & (places < 2000)).sum()
        assert matrix.select(symbol, len(places)) == -1
    assert W.WaveletMatrix.of(ids[:0], 7).decode().tolist() == []


def test_round_trip_equals_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(tuple(r) for r in W.round_trip(docs.repartition(5), PATH, file_tokens=20_000).collect())
    assert got == brute(sorted((r.doc_id, r.text) for r in docs.collect()))


def test_edge_cases(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, " "), (4, "  two  spaces "), (5, "line\n\n  next\tTab \n"), (6, "it's 2024, isn't it?? a1b2 été!! x*** y|z ---"), (6, "tie"), (6, "tie"),
            (7, "<|endoftext|> and foo<|endoftext|>bar"), (8, "word " * 30_000), (9, "日本語 テキスト  x y"), (10, "x" * 20_000), (11, "a\x1cb \x1c c")]
    docs = spark.createDataFrame([(a, b, 1, "p") for a, b in rows], "doc_id long, text string, start int, path string").repartition(4)
    got = [tuple(r) for r in W.round_trip(docs, PATH).collect()]
    assert sorted(got) == sorted(brute(rows)) or sorted(got) == sorted(brute(rows[:6] + [rows[6], rows[7], rows[5]] + rows[8:]))
    with_null = spark.createDataFrame([(5, "b"), (None, "a")], "doc_id long, text string")
    assert sorted((tuple(r) for r in W.round_trip(with_null, PATH).collect()), key=lambda r: r[1]) == brute([(None, "a"), (5, "b")])
    assert W.round_trip(docs.limit(0), PATH).count() == 0
    folder = f"file://{tmp_path}/files"
    manifest = stored(W.write_shards(docs, PATH, folder), "manifest")
    ends = sorted(i for r in W.search(manifest, folder, 2).collect() for i in r.positions)
    assert ends[:2] == [0, 1] and len(ends) >= len(rows)

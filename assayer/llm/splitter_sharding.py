"""Sharding by sampled splitters: shards of near equal bytes over a range-partitioned key.

The key puts equal texts side by side: the leading 40 bits of a text hash, then 24 bits of an id
hash, which let a text that very many rows share be cut anywhere. A size-weighted sample of keys
gives quantile boundaries; the records are dealt to those ranges, and a range whose measured bytes
are too many is subdivided by a sample of its own. Exact range totals and running totals inside the
ranges then place every record, so shard sizes do not depend on the sample, which only bounds the
work of a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import stored

SHARDS = 24
#: Bytes of records that a range should have, and how often that a range is subdivided.
RANGE_BYTES, OVERFULL = 256_000_000, 1.5
#: Fewest ranges, so that small tables also use several tasks, and sampled keys per range.
LEAST_RANGES, SAMPLES = 48, 32
#: A group of equal texts stays whole while it is at most this part of a shard.
WHOLE_GROUP = 0.02
LOW_BITS = 24


def chosen(sample: list[tuple[int, int, float]], parts: int) -> np.ndarray:
    """Boundaries at the quantiles of the size-weighted sample.

    A boundary moves to the first key of its text unless that would repeat the boundary before it: then
    the text alone fills a range and is cut between its rows.
    """
    keys = np.sort(np.array([k for k, *_ in sample], np.int64))
    if not len(keys):
        return keys
    found: list[int] = []
    for raw in keys[(np.arange(1, parts) * len(keys)) // parts].tolist():
        start = raw >> LOW_BITS << LOW_BITS
        value = start if not found or start > found[-1] else raw
        if not found or value > found[-1]:
            found.append(value)
    return np.array(found, np.int64)


def dealt(rows: DataFrame, boundaries: np.ndarray, name: str) -> DataFrame:
    """rows with the number of the range that their key is in."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + f", {name} bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = np.searchsorted(boundaries, batch.column("key").to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number, pa.int64())], [*batch.schema.names, name])

    return rows.mapInArrow(run, schema)


def sampled(rows: DataFrame, rate) -> list[tuple[int, int, float]]:
    """Keys drawn with a chance in proportion to size; the draw is a hash, so reruns agree."""
    u = F.pmod(F.xxhash64("key", "id", F.lit("draw")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return [(r["key"], r["size"], 0.0) for r in rows.filter(u < F.col("size") * rate).select("key", "size").collect()]


def shard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, range_bytes: int = RANGE_BYTES, overfull: float = OVERFULL,
          least_ranges: int = LEAST_RANGES, samples: int = SAMPLES, whole_group: float = WHOLE_GROUP) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, position.

    Law ``bytes``: a shard takes the records whose middle byte lies in its equal part of all bytes, in
    key order, so two shards differ by about one record or small group at most. Size is the UTF-8 length
    of the text (null: 0) plus 8; the checksum of a null text is that of an empty one. Rows of equal
    texts stay in one shard while they are few. slot counts from 0 in every shard, position over all
    records; rows equal in id and text are interchangeable, and which of them comes first is fixed by
    nothing but the run. A null id is like any other. An empty table gives an empty one; extra columns
    are not read. The sample has about ``samples`` keys per range, at 256 MB a range some 13 million
    8-byte keys for 100 TB.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    high = F.shiftleft(F.shiftright(F.xxhash64(t), LOW_BITS), LOW_BITS)
    key = high.bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.col(f"`{doc_id}`")), 64 - LOW_BITS))
    rows = stored(docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), (F.octet_length(t) + 8).cast("bigint").alias("size"), F.crc32(t.cast("binary")).alias("crc"), key.alias("key")), "shard-keys")
    total, largest = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    parts = max(least_ranges, -(-total // range_bytes))
    target = max(1, total / parts)
    ranged = dealt(rows, chosen(sampled(rows, F.lit(samples / target)), parts), "range")
    sizes = ranged.groupBy("range").agg(F.sum("size").alias("bytes"))
    heavy = {r["range"]: r["bytes"] for r in sizes.filter(F.col("bytes") > max(overfull * target, largest)).collect()}
    if heavy:
        inside = ranged.filter(F.col("range").isin(list(heavy)))
        finer = chosen(sampled(inside, F.lit(4 * samples / target)), 4 * max(1, round(sum(heavy.values()) / target)))
        ranged = dealt(ranged, finer, "part")  # ranges without keys of the finer sample are not cut
    else:
        ranged = ranged.withColumn("part", F.lit(0).cast("bigint"))
    ranged = stored(ranged, "shard-ranges")

    # Ranges and parts ascend with the key. Their totals are one row per range.
    totals = ranged.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("range", "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("at"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("nth"))
    inner = Window.partitionBy("range", "part").orderBy("key", "id", "crc", "size")
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy("range", "part", F.shiftright("key", LOW_BITS), "crc", "size")
    placed = ranged.join(offsets, ["range", "part"]).withColumns({
        "end": F.col("at") + F.sum("size").over(upto), "position": F.col("nth") + F.row_number().over(inner) - 1})
    placed = placed.withColumns({"group_end": F.max("end").over(group), "group_start": F.min(F.col("end") - F.col("size")).over(group)})
    span = total / shards if total else 1.0
    small = F.col("group_end") - F.col("group_start") <= F.lit(whole_group * span)
    middle = F.when(small, (F.col("group_end") + F.col("group_start")) / 2).otherwise(F.col("end") - F.col("size") / 2)
    placed = placed.withColumn("shard", F.least(F.floor(middle / F.lit(span)), F.lit(shards - 1)).cast("int"))
    placed = stored(placed.select("id", "size", "crc", "shard", "position"), "shard-places")
    first = placed.groupBy("shard").agg(F.min("position").alias("first"))  # one row per shard
    return placed.join(F.broadcast(first), "shard").select(
        F.col("id").alias(doc_id), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("position") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "position")


def write(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", **options) -> None:
    """The records themselves as one folder per shard, in slot order.

    Records find their shard by id and checksum of the text; among rows equal in both any takes any slot.
    """
    place = shard(docs, doc_id, text, **options)
    places = place.select(F.col(doc_id).alias("__id"), F.col("text_crc32").alias("__crc"), "shard", "slot").withColumn(
        "__n", F.row_number().over(Window.partitionBy("__id", "__crc").orderBy("shard", "slot")))
    keyed = docs.withColumns({"__crc": F.crc32(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")), "__id": F.col(f"`{doc_id}`").cast("bigint")})
    keyed = keyed.withColumn("__n", F.row_number().over(Window.partitionBy("__id", "__crc").orderBy(F.lit(0))))
    joined = keyed.join(places.withColumnsRenamed({"__id": "__i", "__crc": "__c", "__n": "__m"}), F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__crc") == F.col("__c")) & (F.col("__n") == F.col("__m")))
    out = joined.drop("__id", "__crc", "__n", "__i", "__c", "__m")
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

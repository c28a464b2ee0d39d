"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

Every document draws an exponential key, -ln(u) / quality weight, with u from a hash of its id. A
source's budget buys whole epochs first; the rest goes to the documents with the smallest keys, up
to the budget. Only a per-source cut in key order is needed for that, and it is found without
sorting a source: totals per key bucket give the bucket that holds the cut, a bucket of more than
``bucket_rows`` rows is cut again at quantiles of its keys, and only the last one is sorted. The final pass compares each row with the cut of its source, so texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import stored, without

SHARE = 1.5  # of all words, the size of the mix
MOST = 2.0  # epochs of a source
SOURCE_WEIGHTS = (5, 2, 1)
BUCKET_ROWS = 1_000
FINER = 256  # buckets of one that has too many rows
WORD = r"[^\x20\x09-\x0D]+"
ADDED = ("size", "source_size", "target", "taken")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: Column) -> Column:
    """A weight from 0.1 to 1 that falls with the share of symbols; 0.1 for null and empty texts."""
    length = F.length(text)
    odd = F.regexp_count(text, F.lit(r"[#*$%&|<>!]"))
    return F.coalesce(F.when(length > 0, F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(5.0) * odd / length)), F.lit(0.1))


def sampling_key(doc_id: Column, weight: Column, seed: str) -> Column:
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f"|{seed}")))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(2**52))
    return -F.ln(u) / weight


def targets(totals: DataFrame, share: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    """Target words per source; ``totals`` has one row per source: source, source_size, rows.

    Sources in code-point order, null last, take the weights in turn. Shares above ``most`` times a
    source are cut there and the excess is shared anew until none is above: with the sources sorted by
    cap / weight that is the first rate not above the next cap. The windows run over one row per source.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = totals.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", F.lit(most) * F.col("source_size"))
    by_rate = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier, everything = by_rate.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    ranked = ranked.select("*", F.row_number().over(by_rate).alias("place"), F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)).alias("spent"),
                           F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)).alias("used"),
                           F.sum("weight").over(everything).alias("all_weights"), (F.lit(share) * F.sum("source_size").over(everything)).alias("budget"))
    ranked = ranked.withColumn("rate", (F.col("budget") - F.col("spent")) / (F.col("all_weights") - F.col("used")))
    first = F.min(F.when(F.col("rate") <= F.col("cap") / F.col("weight"), F.struct("place", "rate"))).over(everything)
    ranked = ranked.withColumn("cut", first)
    # Without a cut (a share above the caps) every source is at its cap.
    target = F.when(F.col("cut").isNull() | (F.col("place") < F.col("cut.place")), F.col("cap")).otherwise(F.col("cut.rate") * F.col("weight"))
    return ranked.select("source", "source_size", "rows", target.alias("target"))


def around_the_cuts(slim: DataFrame, goals: DataFrame, bucket_rows: int) -> tuple[DataFrame, DataFrame]:
    """The rows of the key bucket of each source that holds its cut, with the words __before it, and per
    source the largest key __full of the buckets below.

    A bucket has at most ``bucket_rows`` rows, or rows of one key only.
    """
    # 1 - exp(-key) is monotone in the key and uniform where weights are 1; smaller weights crowd the last buckets.
    place = F.least(F.floor((F.lit(1.0) - F.exp(-F.col("__key"))) * F.col("buckets")), F.col("buckets") - 1)
    rows = slim.join(goals.select(F.col("source").alias("__source"), "rest", "buckets"), F.col("source").eqNullSafe(F.col("__source")))
    rows = rows.select("source", "__size", "__key", "__id", "__tie", "rest", F.lit(0).cast("long").alias("__start"), place.alias("__bucket"))
    full = None
    while True:
        parts = rows.groupBy("source", "rest", "__start", "__bucket").agg(
            F.sum("__size").alias("__all"), F.count(F.lit(1)).alias("__rows"), F.min("__key").alias("__low"), F.max("__key").alias("__top"))
        before = F.coalesce(F.sum("__all").over(Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parts = stored(parts.withColumn("__before", F.col("__start") + before), "mix-buckets")
        below = parts.filter(F.col("__before") + F.col("__all") <= F.col("rest")).select("source", "__top")
        full = below if full is None else full.union(below)
        edges = parts.filter((F.col("__before") < F.col("rest")) & (F.col("rest") < F.col("__before") + F.col("__all")))
        edges = edges.select(F.col("source").alias("__s"), F.col("__bucket").alias("__b"), "__before", ((F.col("__rows") > bucket_rows) & (F.col("__low") < F.col("__top"))).alias("__wide"))  # one bucket per source at most
        edge = rows.join(edges, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b"))).select(
            "source", "__size", "__key", "__id", "__tie", "rest", "__before", "__wide")
        if not edges.agg(F.max("__wide")).first()[0]:
            return edge, full.groupBy("source").agg(F.max("__top").alias("__full"))
        edge = stored(edge, "mix-edges")
        # Ends below the largest key leave at least two buckets.
        steps = edge.filter("__wide").groupBy(F.col("source").alias("__of")).agg(
            F.percentile_approx("__key", [k / FINER for k in range(1, FINER)], 10_000).alias("__ends"), F.min("__key").alias("__low"), F.max("__key").alias("__top"))
        steps = steps.select("__of", F.concat(F.array("__low"), F.filter("__ends", lambda x: x < F.col("__top"))).alias("__ends"))
        finer = F.when(F.col("__ends").isNull(), F.lit(0)).otherwise(F.size(F.filter("__ends", lambda x: x < F.col("__key")))).cast("long")
        rows = edge.join(steps, F.col("source").eqNullSafe(F.col("__of")), "left").select(
            "source", "__size", "__key", "__id", "__tie", "rest", F.col("__before").alias("__start"), finer.alias("__bucket"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None, share: float = SHARE,
        most: float = MOST, weights: tuple[int, ...] = SOURCE_WEIGHTS, seed: str = "mix", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All columns of docs with size, source_size, target and taken (words the mix takes, repeats counted).

    Documents are taken whole; the last one of a source is taken if that brings the source nearer its
    target, so a source misses it by half a document at most. Null and empty texts have size 0; a null
    source is a source of its own; rows equal in id and text are one draw and are taken together.
    Weights are clamped to at least 0.01. The added columns replace columns of their names. An empty
    table gives an empty one.
    """
    base = without(docs, ADDED)
    own = F.greatest(F.coalesce(weight if weight is not None else text_quality(F.col(f"`{text}`")), F.lit(0.01)), F.lit(0.01))
    drawn = {"__size": word_count(F.col(f"`{text}`")), "__key": sampling_key(F.col(f"`{doc_id}`"), own, seed),
             "__id": F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), "__tie": F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")))}
    slim = stored(base.select(F.col(f"`{source}`").alias("source"), *[c.alias(k) for k, c in drawn.items()]), "mix-keys")
    totals = slim.groupBy("source").agg(F.sum("__size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    goals = targets(totals, share, most, weights)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    goals = stored(goals.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
                   .withColumn("buckets", F.ceil(2 * F.col("rows") / bucket_rows)), "mix-targets")

    edge, full = around_the_cuts(slim, goals, bucket_rows)
    inside = edge.groupBy("source", "__key", "__id", "__tie", "rest", "__before").agg(F.sum("__size").alias("__unit"))
    upto = F.sum("__unit").over(Window.partitionBy("source").orderBy("__key", "__id", "__tie").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("__upto", upto).filter(F.col("__before") + F.col("__upto") - F.col("__unit") / 2 <= F.col("rest"))
    cuts = inside.groupBy("source").agg(F.max(F.struct("__key", "__id", "__tie")).alias("__cut")).withColumnRenamed("source", "__s")
    full = full.withColumnRenamed("source", "__f")
    plan = (goals.join(cuts, F.col("source").eqNullSafe(F.col("__s")), "left").join(full, F.col("source").eqNullSafe(F.col("__f")), "left")
            .select(F.col("source").alias("__source"), "source_size", "target", "epochs", "__cut", "__full"))
    plan = stored(plan, "mix-cuts")

    taken = F.coalesce(F.struct("__key", "__id", "__tie") <= F.col("__cut"), F.lit(False)) | F.coalesce(F.col("__key") <= F.col("__full"), F.lit(False))
    return (base.withColumns(drawn).join(plan, F.col(f"`{source}`").eqNullSafe(F.col("__source")))
            .select(*[F.col(f"`{c}`") for c in base.columns], F.col("__size").alias("size"), "source_size", "target",
                    (F.col("__size") * (F.col("epochs") + taken.cast("long"))).cast("long").alias("taken"),
                    (F.col("epochs") + taken.cast("long")).cast("int").alias("__copies")))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as the mix takes it, in the columns of docs.

    Documents without words cost nothing and are left out.
    """
    found = mix(docs, **options).filter(F.col("taken") > 0)
    return found.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ADDED])


#: The same mix in SQL for the columns of the contract.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|mix'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / CASE WHEN length(text) > 0 THEN greatest(0.1, 1.0 - 5.0 * len(regexp_extract_all(text, '[#*$%&|<>!]')) / length(text)) ELSE 0.1 END AS k,
    coalesce(doc_id::VARCHAR, '') AS i, md5(coalesce(text, '')) AS t
  FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, 2.0 * source_size AS cap FROM s),
r AS (SELECT *, row_number() OVER o AS place, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rate
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
c AS (SELECT min(place) AS first_open, arg_min(rate, place) AS open_rate FROM r WHERE rate <= cap / weight),
g AS (SELECT source, source_size, CASE WHEN place < first_open THEN cap ELSE open_rate * weight END AS target FROM r, c),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM g),
u AS (SELECT source, k, i, t, sum(size) AS unit FROM d GROUP BY ALL),
p AS (SELECT source, k, i, t, unit, sum(unit) OVER (PARTITION BY source ORDER BY k, i, t ROWS UNBOUNDED PRECEDING) AS upto FROM u)
SELECT d.doc_id, d.size, e.source_size::BIGINT AS source_size, e.target,
  (d.size * (e.epochs + CASE WHEN p.upto - p.unit / 2 <= e.target - e.epochs * e.source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
JOIN p ON p.source IS NOT DISTINCT FROM d.source AND p.k = d.k AND p.i = d.i AND p.t = d.t
"""

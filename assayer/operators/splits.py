"""Train, validation and test parts and cross-validation folds.

A part is decided row by row: random splits compare the md5 of the key with cut hashes, time
splits compare the timestamp with cut times. Finding the cuts takes narrow counting passes;
the rows themselves are never sorted or shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import dates
from assayer.functions.digests import key_hash
from assayer.operators import ranking
from assayer.operators.profile import types_of

PARTS = ["train", "validation", "test"]


class SplitError(ValueError):
    """The requested split cannot be made from these rows."""


def part_sizes(n: int, test_size: float = 0.2, validation_size: float = 0.2) -> tuple[int, int]:
    """Rows for test, then for validation out of the rest."""
    test = math.ceil(n * test_size)
    return test, math.ceil((n - test) * validation_size)


def _class_of(name: str) -> Column:
    """A class as a text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("null"))


def hash_cuts(df: DataFrame, key, wanted, within: str | None = None) -> dict:
    """Per class the size and the hashes at the wanted positions in md5 order of the key.

    ``wanted(n)`` gives the positions for a class of n rows. Rows are counted by the first
    digits of the hash, as many as the rows need; only the few buckets that hold a wanted position are
    looked into. The driver holds a few hashes for every class.
    """
    group = _class_of(within) if within else F.lit("")
    hashed = df.select(group.alias("g"), key_hash(key).alias("h"))
    sizes = {r["g"]: r["n"] for r in hashed.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}  # the classes of a target
    digits = max(1, math.ceil(math.log(max(1, sum(sizes.values()) / ranking.HASH_ROWS), 16)))
    hashed = hashed.withColumn("b", F.substring("h", 1, digits))
    targets = [(g, i, int(p)) for g, n in sizes.items() for i, p in enumerate(wanted(n)) if 0 < p <= n]
    if not targets:
        return {g: (n, [None] * len(wanted(n))) for g, n in sizes.items()}
    filled = hashed.groupBy("g", "b").agg(F.count(F.lit(1)).alias("n"))
    over = Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    placed = filled.withColumn("before", F.coalesce(F.sum("n").over(over), F.lit(0)))
    asked = F.broadcast(df.sparkSession.createDataFrame(targets, "g string, i int, p long"))
    hits = placed.join(asked, "g").filter((F.col("before") < F.col("p")) & (F.col("p") <= F.col("before") + F.col("n"))).collect()
    wanted_buckets = F.broadcast(df.sparkSession.createDataFrame(
        [(r["g"], r["b"], r["i"], r["p"] - r["before"]) for r in hits], "g string, b string, i int, k long"))
    local = Window.partitionBy("g", "b", "i").orderBy("h")
    found = (hashed.join(wanted_buckets, ["g", "b"]).withColumn("at", F.row_number().over(local))
             .filter(F.col("at") == F.col("k")).select("g", "i", "h").collect())
    out = {g: (n, [None] * len(wanted(n))) for g, n in sizes.items()}
    for r in found:
        out[r["g"]][1][r["i"]] = r["h"]
    return out


def _by_class(cuts: dict, within: str | None, choose) -> Column:
    """``choose`` made of the cut hashes of a row's own class: one lookup, however many classes there are."""
    listed = {g: F.array(*[F.lit(h).cast("string") for h in hashes]) for g, (_, hashes) in cuts.items()}
    if within is None:
        own = listed.get("", F.array())
        return choose(lambda i: F.get(own, F.lit(i)))
    own = F.try_element_at(F.create_map(*[x for g, hashes in listed.items() for x in (F.lit(g), hashes)]), _class_of(within))
    return choose(lambda i: F.get(own, F.lit(i)))


def _hash_part(df: DataFrame, key, target: str | None, test_size: float) -> Column:
    def wanted(n):
        test, validation = part_sizes(n, test_size)
        return [test, test + validation]
    cuts = hash_cuts(df, key, wanted, target)
    h = key_hash(key)
    # A class without such a position has no hash there, and the comparison does not hold.
    return _by_class(cuts, target, lambda cut: F.when(h <= cut(0), "test").when(h <= cut(1), "validation").otherwise("train"))


def random_split(df: DataFrame, key, target: str | None = None, test_size: float = 0.2) -> DataFrame:
    """``part`` by md5 order of the key, the same shares in every class of ``target``."""
    return df.withColumn("part", _hash_part(df, key, target, test_size))


def chronological_cut(counts: DataFrame, ts: str, target: int, rows: int | None = None):
    """The timestamp whose last row is nearest to position ``target``; None without a boundary.

    ``counts`` has one row per distinct timestamp with n. The last timestamp is no boundary.
    """
    summed = ranking.running_totals(counts, "__at", ["n"], rows=rows)
    top = summed.agg(F.max("__at").alias("m")).first()["m"]
    return (summed.filter(F.col("__at") < F.lit(top)).agg(
        F.min_by(F.struct(F.col(ts).alias("ts"), F.col("upto_n").alias("upto")), F.struct(F.abs(F.col("upto_n") - F.lit(target)), "upto_n")).alias("cut"))
        .first()["cut"])


def chronological_split(df: DataFrame, ts: str, test_size: float = 0.2) -> DataFrame:
    """``part`` by time: equal timestamps stay together, the newest rows are the test part."""
    at = dates.instant(F.col(ts), types_of(df)[ts].simpleString())
    timed = df.withColumn("__ts", at)
    counts = timed.groupBy("__ts").agg(F.count(F.lit(1)).alias("n")).withColumn("__at", F.unix_micros("__ts"))
    facts = counts.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct"), F.count_if(F.col("__ts").isNull()).alias("bad")).first()
    if facts["bad"]:
        raise SplitError("The time to split by is missing or invalid in some rows.")
    first = chronological_cut(counts, "__ts", int(facts["rows"] * (1 - test_size)), facts["distinct"])
    if first is None:
        raise SplitError("A chronological split needs enough distinct timestamps.")
    development = counts.filter(F.col("__ts") <= F.lit(first["ts"]))
    second = chronological_cut(development, "__ts", int(first["upto"] * 0.8), facts["distinct"])
    if second is None:
        raise SplitError("A chronological split needs enough distinct timestamps.")
    part = F.when(F.col("__ts") <= F.lit(second["ts"]), "train").when(F.col("__ts") <= F.lit(first["ts"]), "validation").otherwise("test")
    return timed.withColumn("part", part).drop("__ts")


def group_split(df: DataFrame, group: str, test_size: float = 0.2) -> DataFrame:
    """``part`` by whole groups; the share counts groups, not rows. The cut hash needs no join."""
    groups = df.select(group).distinct()
    facts = groups.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(group).isNull()).alias("bad")).first()
    if facts["bad"] or facts["n"] < 5:
        raise SplitError("Fewer than five groups cannot be dealt to three parts.")
    return df.withColumn("part", _hash_part(groups, [group], None, test_size))


def split(df: DataFrame, key, strategy: str = "random", column: str | None = None, target: str | None = None, test_size: float = 0.2) -> DataFrame:
    """Adds ``part``: train, validation or test."""
    if strategy == "chronological":
        return chronological_split(df, column, test_size)
    if strategy == "group":
        return group_split(df, column, test_size)
    return random_split(df, key, target, test_size)


def split_report(parted: DataFrame, target: str | None = None) -> DataFrame:
    """Rows per part, classes per part, and whether the split can be used."""
    cells = [F.count_if(F.col("part") == p).alias(p) for p in PARTS]
    if target is None:
        one = parted.agg(*cells).withColumn("missing_classes", F.lit(0).cast("long"))
    else:
        one = parted.groupBy(target).agg(*cells).agg(
            *[F.sum(p).alias(p) for p in PARTS],
            F.count_if((F.col("train") == 0) | (F.col("validation") == 0) | (F.col("test") == 0)).alias("missing_classes"))
    return one.withColumn("usable", (F.least(*PARTS) >= 5) & (F.col("missing_classes") == 0))


def missing_classes(parted: DataFrame, target: str) -> DataFrame:
    """(part, class) combinations without a row: from one count per class, no cross join."""
    wide = parted.groupBy(target).agg(*[F.count_if(F.col("part") == p).alias(p) for p in PARTS])
    cells = F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).alias("rows")) for p in PARTS])
    return wide.select(F.col(target).alias("class"), F.inline(cells)).filter(F.col("rows") == 0).select("part", "class")


# ---- folds ----------------------------------------------------------------------------------

def fold_count(k: int, rarest: int) -> int:
    return min(k, rarest)


def random_folds(df: DataFrame, key, k: int = 3, target: str | None = None) -> DataFrame:
    """``fold`` 0..k-1 by md5 order, equal shares of every class of ``target``.

    With a target no more folds than rows of the rarest class are made.
    """
    if target is not None:
        rarest = df.groupBy(target).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0]
        k = fold_count(k, rarest)
        if k < 2:
            raise SplitError("A class has fewer rows than there are folds.")

    def wanted(n):
        return [n * (i + 1) // k for i in range(k - 1)]
    cuts, h = hash_cuts(df, key, wanted, target), key_hash(key)

    def choose(cut):
        fold = F.lit(k - 1)
        for i in range(k - 2, -1, -1):
            fold = F.when(h <= cut(i), i).otherwise(fold)
        return fold
    return df.withColumn("fold", _by_class(cuts, target, choose).cast("int"))


def dealt_sizes(steps: list[tuple[int, int]], k: int) -> list[tuple[int, int, int]]:
    """Groups of every size per fold when the largest group left always goes to the lightest fold.

    ``steps``: (rows of a group, number of such groups). Equal folds are taken in order. Groups of one
    size are dealt together: folds rise to a common level, then take turns; so the cost follows the
    number of different sizes. Returns (rows, fold, groups).
    """
    weight, out = [0] * k, []
    for size, groups in sorted(steps, reverse=True):
        taken = [0] * k
        if size:
            # Every fold takes groups up to the level that the last full round reaches.
            low, high = min(weight), max(weight) + size * groups
            while low < high:
                level = (low + high) // 2
                if sum(max(0, -(-(level - w) // size)) for w in weight) <= groups:
                    low = level + 1
                else:
                    high = level
            taken = [max(0, -(-(low - 1 - w) // size)) for w in weight]
            for f in range(k):
                weight[f] += taken[f] * size
        for _ in range(groups - sum(taken)):
            f = min(range(k), key=lambda i: (weight[i], i)) if size else taken.index(min(taken))
            taken[f] += 1
            weight[f] += size
        out += [(size, f, n) for f, n in enumerate(taken) if n]
    return out


def group_folds(df: DataFrame, group: str, k: int = 3) -> DataFrame:
    """``fold`` per whole group: the largest group left goes to the lightest fold, of equal folds the first.

    Rows without a group are one group together. Groups of one size are dealt in md5 order of the
    group, the first ones to the first fold. The driver sees one pair of numbers per different size.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    steps = [(r["n"], r["groups"]) for r in sizes.groupBy("n").agg(F.count(F.lit(1)).alias("groups")).collect()]  # different sizes of groups
    shares = dealt_sizes(steps, k)
    ends, upto = [], {}
    for size, fold, groups in shares:
        upto[size] = upto.get(size, 0) + groups
        ends.append((size, fold, upto[size] - groups, upto[size]))
    table = df.sparkSession.createDataFrame(ends, "n long, fold int, after long, upto long")
    table = table.groupBy("n").agg(F.sort_array(F.collect_list(F.struct("after", "upto", "fold"))).alias("folds"))  # k at most
    inside = ranking.hash_positions(sizes, [group], within=["n"], rows=sum(g for _, g in steps))
    hit = F.filter("folds", lambda x: (F.col("position") > x["after"]) & (F.col("position") <= x["upto"]))
    assigned = inside.join(table, "n").select(group, F.get(hit, F.lit(0))["fold"].alias("fold"))
    # One row per group on the right: adaptive execution splits a hot group on the left.
    return ranking.join_groups(df, assigned, [group])


def time_folds(df: DataFrame, ts: str, k: int = 3) -> DataFrame:
    """One row per (fold, role, row): train grows block by block over the distinct timestamps.

    A row without a valid time comes out once, with fold null and role ``invalid``.
    """
    at = dates.instant(F.col(ts), types_of(df)[ts].simpleString())
    instants = df.select(at.alias("__ts")).filter("__ts IS NOT NULL").distinct().withColumns({"__at": F.unix_micros("__ts"), "one": F.lit(1)})
    n = instants.count()
    if n <= k:
        raise SplitError("There are no more instants than folds.")
    block = n // (k + 1)
    starts = [n - k * block + i * block for i in range(k)]
    placed = ranking.running_totals(instants, "__at", ["one"], rows=n)
    first = {r["upto_one"] - 1: r["__ts"] for r in placed.filter((F.col("upto_one") - 1).isin(starts)).collect()}
    edges = [first[s] for s in starts] + [None]
    roles = [F.when(at.isNull(), F.struct(F.lit(None).cast("int").alias("fold"), F.lit("invalid").alias("role")))]
    for i in range(k):
        valid = at >= F.lit(edges[i])
        if edges[i + 1] is not None:
            valid = valid & (at < F.lit(edges[i + 1]))
        for role, rows in (("train", at < F.lit(edges[i])), ("validation", valid)):
            roles.append(F.when(rows, F.struct(F.lit(i).alias("fold"), F.lit(role).alias("role"))))
    return df.withColumn("__r", F.explode(F.filter(F.array(*roles), lambda r: r.isNotNull()))).select(*df.columns, "__r.fold", "__r.role")


@dataclass
class FoldPlan:
    """Rows with fold (and role, where a fold learns from some of the others only), and how they came about."""

    rows: DataFrame
    folds: int
    strategy: str
    status: str  # completed, or unavailable with the reason: then one fold, the validation part
    reason: str | None = None


def classes_covered(folded: DataFrame, label: str, k: int) -> bool:
    """Has every fold all classes among its training and its validation rows? One scan: a row per class."""
    def side(i: int, role: str):
        if "role" in folded.columns:
            return F.count_if((F.col("fold") == i) & (F.col("role") == role))
        return F.count_if(F.col("fold") == i if role == "validation" else F.col("fold") != i)

    counts = folded.groupBy(label).agg(F.least(*[side(i, role) for i in range(k) for role in ("train", "validation")], F.lit(2**62)).alias("least"))
    return (counts.agg(F.min("least").alias("m")).first()["m"] or 0) > 0


def fold_plan(parted: DataFrame, key, task: str, k: int = 3, strategy: str = "random", column: str | None = None, label: str = "label") -> FoldPlan:
    """Folds of the train part for comparing models, or the validation part where folds cannot serve.

    Folds cannot serve when there are too few instants, groups or rows of a class, or when a class is
    missing from the rows a fold learns from or is judged by.
    """
    train = parted.filter(F.col("part") == "train")
    reason, name = None, {"chronological": "TimeSeries", "group": "Groups"}.get(strategy, "Stratified" if task == "classification" else "Shuffled")
    folded = None
    if strategy == "chronological":
        if train.select(column).distinct().count() <= k:
            reason = "There are too few distinct timestamps for folds."
        else:
            folded = time_folds(train, column, k).filter(F.col("fold").isNotNull())
    elif strategy == "group":
        k = min(k, train.select(column).distinct().count())
        if k < 2:
            reason = "There are too few groups for folds."
        else:
            folded = group_folds(train, column, k)
    else:
        if task == "classification":
            k = fold_count(k, train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("m")).first()["m"] or 0)
        if k < 2:
            reason = "A class has too few rows for folds."
        else:
            folded = random_folds(train, key, k, label if task == "classification" else None)
    if folded is not None and task == "classification" and not classes_covered(folded, label, k):
        reason = "A fold lacks a class."
    if reason is None:
        return FoldPlan(folded, k, name, "completed")
    held = parted.filter(F.col("part").isin("train", "validation"))
    return FoldPlan(held.withColumns({"fold": F.lit(0), "role": F.col("part"), "part": F.lit("train")}), 1, name, "unavailable", f"{reason} Models are chosen on the validation part.")


def fold_roles(folded: DataFrame, k: int) -> DataFrame:
    """(fold, role) per row from a fold number: validation in its own fold, train in the others."""
    roles = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.struct(
        i.alias("number"), F.when(i == F.col("fold"), "validation").otherwise("train").alias("role")))
    rest = [c for c in folded.columns if c != "fold"]
    return folded.withColumn("__r", F.explode(roles)).select(*rest, F.col("__r.number").alias("fold"), "__r.role")

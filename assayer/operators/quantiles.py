"""Exact quantiles with linear interpolation, by narrowing brackets.

Each wanted order statistic has a bracket: the least and greatest value it can be, what lies below, and
what lies inside. While more values lie inside than one buffer takes, the bracket is cut into cells, the
values of each cell are counted, and the cell that holds the wanted place becomes the bracket, with its
own least and greatest value. Cells are even in the values, or in their logarithm where that did not
help, so a bracket is narrowed like the digits of a number and ends at a buffer of values or at a single
value, however often it is repeated. All columns, places and groups are narrowed in the same scans.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.operators.ranking import join_groups

#: Values of a bracket that are taken into one buffer.
HELD_VALUES = 500_000
#: Cells of a bracket.
CELLS = 1024
#: So many large groups at most have their brackets on the driver.
FEW_GROUPS = 32
#: Types of group keys that are the same as a literal and as a value on the driver.
PLAIN = (T.StringType, T.IntegralType, T.BooleanType)
INFINITY = "double('Infinity')"


def quantiles(df: DataFrame, columns, shares, by=(), rows: int | None = None, held: int = HELD_VALUES) -> DataFrame:
    """One row per ``by`` group with an array of quantiles per column (named as the column).

    Null and NaN are no values; a column without values has null. ``rows``, if known, spares a count.
    """
    by, columns, shares = list(by), list(columns), list(shares)
    values = df.select(*[F.col(f"`{b}`").alias(f"__b{k}") for k, b in enumerate(by)],
                       *[F.expr(f"if(isnan(double(`{c}`)), NULL, double(`{c}`))").alias(f"v{i}") for i, c in enumerate(columns)])
    keys = [f"__b{k}" for k in range(len(by))]
    rows = df.count() if rows is None else rows
    if rows <= held:  # every bracket is closed from the start
        found = _at_once(values, len(columns), shares, keys)
    else:
        found = _grouped(values, len(columns), shares, keys, held) if by else _ungrouped(values, len(columns), shares, held)
    return found.toDF(*by, *columns)


def medians(df: DataFrame, columns, by=(), rows: int | None = None) -> DataFrame:
    """One row per ``by`` group with the median of each column."""
    got = quantiles(df, columns, [0.5], by, rows)
    return got.select(*by, *[F.get(f"`{c}`", F.lit(0)).alias(c) for c in columns])


def _at_once(values: DataFrame, many: int, shares, keys) -> DataFrame:
    """Groups that fit one buffer: the built-in percentile."""
    wanted = ", ".join(f"double('{float(s)!r}')" for s in shares)
    return values.groupBy(*keys).agg(*[F.expr(f"percentile(v{i}, array({wanted})) AS v{i}") for i in range(many)])


# ---- cells of a bracket ---------------------------------------------------------------------------

def _even(v: str, low: str, high: str) -> str:
    whole = f"try_divide({v} - {low}, {high} - {low})"
    half = f"try_divide({v} * 0.5D - {low} * 0.5D, {high} * 0.5D - {low} * 0.5D)"  # the width may exceed the doubles
    return f"if(abs({high} - {low}) < {INFINITY}, {whole}, {half})"


def _logarithmic(v: str, low: str, high: str) -> str:
    # Monotone over all doubles; the logarithm of the least one is above -745.
    g = lambda x: f"if({x} = 0, 0D, signum({x}) * least(2000D, ln(abs({x})) + 745))"
    return f"try_divide({g(v)} - {g(low)}, {g(high)} - {g(low)})"


def cell_sql(v: str, low: str, high: str, logarithmic: str) -> str:
    """Number of the cell of ``v`` in [low, high]: never falling in v, and two cells at least hold values."""
    even, log = _even(v, low, high), _logarithmic(v, low, high)
    share = f"CASE WHEN {logarithmic} OR abs({low}) = {INFINITY} OR abs({high}) = {INFINITY} THEN coalesce({log}, {even}) ELSE {even} END"
    return f"int(least({CELLS - 1}, greatest(0, floor({share} * {CELLS}))))"


# ---- without groups or with a few large ones: brackets on the driver ---------------------------------

class Bracket(NamedTuple):
    low: float
    high: float
    below: int
    inside: int
    logarithmic: bool = False


def _literal(x: float) -> str:
    return f"double('{x!r}')".replace("inf", "Infinity")


def _narrowed(bracket: Bracket, cells, place: int) -> Bracket:
    """The cell that holds the place; logarithmic cells follow where even ones left most values together."""
    below = bracket.below
    for _, n, low, high in cells:
        if place < below + n:
            return Bracket(low, high, below, n, not bracket.logarithmic and n * 4 > bracket.inside)
        below += n
    raise AssertionError("Counts of a bracket do not reach its place.")


def _inside(values: DataFrame, brackets: list[tuple[str, int, Bracket]]) -> DataFrame:
    """(id, v) of the values that lie in a bracket; each is (row condition, column, bracket).

    Brackets under one condition are equal or disjoint, so a value lies in one at most.
    """
    columns: dict[int, list[str]] = {}
    for k, (where, i, b) in enumerate(brackets):
        columns.setdefault(i, []).append(f"WHEN {where} AND v{i} BETWEEN {_literal(b.low)} AND {_literal(b.high)} THEN named_struct('id', {k}, 'v', v{i})")
    # Higher-order functions are not compiled: rows outside are made and dropped.
    return values.selectExpr(f"inline(array({', '.join(f'CASE {chr(32).join(found)} END' for found in columns.values())}))").filter("id IS NOT NULL")


def _listed(found) -> str:
    return f"array({', '.join(found)})"


def _narrowed_here(values: DataFrame, wheres: list[str], sizes: list, many: int, shares, held: int) -> list[list]:
    """Per row condition and column the quantiles, or None without values; ``sizes`` has n, low and high of the columns."""
    state: dict[tuple[int, int, int], Bracket] = {}
    for g in range(len(wheres)):
        for i in range(many):
            for share in shares if sizes[g][f"n{i}"] else ():
                at = share * (sizes[g][f"n{i}"] - 1)
                for place in {math.floor(at), math.ceil(at)}:
                    state[g, i, place] = Bracket(sizes[g][f"low{i}"], sizes[g][f"high{i}"], 0, sizes[g][f"n{i}"])
    while wide := {t: b for t, b in state.items() if b.inside > held and b.low < b.high}:
        brackets = list(dict.fromkeys((g, i, b) for (g, i, _), b in wide.items()))
        facts = [f"get({_listed(map(_literal, x))}, id) AS {name}" for name, x in (("low", [b.low for *_, b in brackets]), ("high", [b.high for *_, b in brackets]))]
        facts.append(f"get({_listed(str(b.logarithmic).lower() for *_, b in brackets)}, id) AS logarithmic")
        rows = _inside(values, [(wheres[g], i, b) for g, i, b in brackets]).selectExpr("id", "v", *facts)
        counted = rows.selectExpr("id", "v", f"{cell_sql('v', 'low', 'high', 'logarithmic')} AS cell").groupBy("id", "cell").agg(
            F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        cells: dict[int, list] = {}
        for r in counted.collect():  # CELLS rows a bracket
            cells.setdefault(r["id"], []).append((r["cell"], r["n"], r["low"], r["high"]))
        at = {t: k for k, t in enumerate(brackets)}
        for (g, i, place), b in wide.items():
            state[g, i, place] = _narrowed(b, sorted(cells[at[g, i, b]]), place)
    found = {t: b.low for t, b in state.items() if b.low == b.high}
    brackets = list(dict.fromkeys((g, i, b) for (g, i, _), b in state.items() if b.low < b.high))
    if brackets:
        places = [sorted(p - b.below for (h, j, p), c in state.items() if (h, j, c) == (g, i, b)) for g, i, b in brackets]
        held_values = _inside(values, [(wheres[g], i, b) for g, i, b in brackets]).groupBy("id").agg(F.sort_array(F.collect_list("v")).alias("s"))  # ``held`` values at most
        wanted = ", ".join(f"{k}, array({', '.join(map(str, p))})" for k, p in enumerate(places))
        for r in held_values.selectExpr("id", f"transform(map({wanted})[id], k -> get(s, int(k))) AS got").collect():
            g, i, b = brackets[r["id"]]
            found |= {(g, i, b.below + p): v for p, v in zip(places[r["id"]], r["got"])}
    out: list[list] = []
    for g in range(len(wheres)):
        out.append([])
        for i in range(many):
            row = []
            for share in shares if sizes[g][f"n{i}"] else ():
                at = share * (sizes[g][f"n{i}"] - 1)
                low, high = math.floor(at), math.ceil(at)
                row.append(found[g, i, low] if low == high else (high - at) * found[g, i, low] + (at - low) * found[g, i, high])
            out[-1].append(row or None)
    return out


def _extent(many: int) -> list:
    return [F.expr(e) for i in range(many) for e in (f"count(v{i}) AS n{i}", f"min(v{i}) AS low{i}", f"max(v{i}) AS high{i}")]


def _ungrouped(values: DataFrame, many: int, shares, held: int) -> DataFrame:
    sizes = values.agg(*_extent(many)).first()
    out = _narrowed_here(values, ["true"], [sizes], many, shares, held)
    return values.sparkSession.createDataFrame([tuple(out[0])], ", ".join(f"v{i} array<double>" for i in range(many)))


def _few_groups(values: DataFrame, many: int, shares, keys, held: int, large: list) -> DataFrame:
    """The quantiles of a few large groups, narrowed in the same scans like those without groups."""
    group = F.lit(None).cast("int")
    for g, r in reversed(list(enumerate(large))):
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.lit(r[k]).cast(values.schema[k].dataType))
        group = F.when(same, F.lit(g)).otherwise(group)
    mine = values.select(group.alias("__g"), *[f"v{i}" for i in range(many)]).filter("__g IS NOT NULL")
    sizes = {r["__g"]: r for r in mine.groupBy("__g").agg(*_extent(many)).collect()}
    out = _narrowed_here(mine, [f"__g = {g}" for g in range(len(large))], [sizes[g] for g in range(len(large))], many, shares, held)
    schema = T.StructType([*[values.schema[k] for k in keys], *[T.StructField(f"v{i}", T.ArrayType(T.DoubleType())) for i in range(many)]])
    return values.sparkSession.createDataFrame([(*[r[k] for k in keys], *found) for r, found in zip(large, out)], schema)


# ---- by group: brackets in a table ---------------------------------------------------------------------

def _within(long: DataFrame, brackets: DataFrame, keys) -> DataFrame:
    """The rows (group, column, value) beside the brackets they lie in; brackets of a group's column are one array."""
    names = [c for c in brackets.columns if c not in (*keys, "c")]
    arrays = brackets.groupBy(*keys, "c").agg(F.collect_list(F.struct(*names)).alias("brackets"))
    beside = join_groups(long, arrays, [*keys, "c"])
    hit = F.filter("brackets", lambda b: (F.col("v") >= b["low"]) & (F.col("v") <= b["high"]))
    return beside.select(*keys, "c", "v", F.explode(hit).alias("b")).select(*keys, "c", "v", *[F.col(f"b.{n}").alias(n) for n in names])


def _narrowed_groups(long: DataFrame, state: DataFrame, keys) -> DataFrame:
    """The state of the wide brackets after one more scan."""
    bracket = [*keys, "c", "low", "high", "below", "inside", "logarithmic"]
    asked = state.select(*bracket).distinct()
    rows = _within(long, asked, keys).withColumn("cell", F.expr(cell_sql("v", "low", "high", "logarithmic")))
    cells = rows.groupBy(*bracket, "cell").agg(F.count("v").alias("n"), F.min("v").alias("first"), F.max("v").alias("last"))
    listed = cells.groupBy(*bracket).agg(F.sort_array(F.collect_list(F.struct("cell", "n", "first", "last"))).alias("cells"))  # CELLS at most
    beside = join_groups(state, listed, bracket)
    # Walk over the cells until the place is reached.
    walk = F.expr("""aggregate(cells, named_struct('below', below, 'n', bigint(0), 'first', double(0), 'last', double(0), 'done', false),
        (a, x) -> CASE WHEN a.done THEN a WHEN place < a.below + x.n THEN named_struct('below', a.below, 'n', x.n, 'first', x.first, 'last', x.last, 'done', true)
                  ELSE named_struct('below', a.below + x.n, 'n', a.n, 'first', a.first, 'last', a.last, 'done', false) END)""")
    got = beside.withColumn("w", walk)
    return got.select(*keys, "c", "place", F.col("w.first").alias("low"), F.col("w.last").alias("high"), F.col("w.below").alias("below"), F.col("w.n").alias("inside"),
                      (~F.col("logarithmic") & (F.col("w.n") * 4 > F.col("inside"))).alias("logarithmic"))


def _grouped(values: DataFrame, many: int, shares, keys, held: int) -> DataFrame:
    """Groups that fit a buffer at once; the brackets of many larger groups stay a table, joined with their rows."""
    sized = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).persist()
    large = sized.filter(F.col("__n") > held).select(*keys)
    if large.isEmpty():
        return _at_once(values, many, shares, keys)
    few = large.limit(FEW_GROUPS + 1).collect() if all(isinstance(values.schema[k].dataType, PLAIN) for k in keys) else []
    alone = sized.filter(F.col("__n") <= held).isEmpty() if few else False
    if alone and len(few) <= FEW_GROUPS:
        return _few_groups(values, many, shares, keys, held, few)
    same = F.lit(True)
    for k in keys:
        same = same & values[k].eqNullSafe(large[k])
    small = _at_once(values.join(large, same, "left_anti"), many, shares, keys)
    if 0 < len(few) <= FEW_GROUPS:
        return small.unionByName(_few_groups(values, many, shares, keys, held, few))
    cells = ", ".join(f"named_struct('c', {i}, 'v', v{i})" for i in range(many))
    long = join_groups(values, large, keys).selectExpr(*keys, f"inline(array({cells}))").filter("v IS NOT NULL")
    sizes = long.groupBy(*keys, "c").agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).persist()
    places = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(F.lit(s) * (F.col("n") - 1)), F.ceil(F.lit(s) * (F.col("n") - 1))) for s in map(float, shares)])))
    state = sizes.select(*keys, "c", F.explode(places).alias("place"), "low", "high", F.lit(0).cast("bigint").alias("below"), F.col("n").alias("inside"), F.lit(False).alias("logarithmic"))
    wide = (F.col("inside") > held) & (F.col("low") < F.col("high"))
    while not (state := state.persist()).filter(wide).isEmpty():
        state = _narrowed_groups(long, state.filter(wide), keys).unionByName(state.filter(~wide))
    closed = state.filter("low = high").select(*keys, "c", "place", F.col("low").alias("value"))
    rest = state.filter("low < high").groupBy(*keys, "c", "low", "high", "below").agg(F.collect_list("place").alias("places"))
    inside = _within(long, rest, keys).groupBy(*keys, "c", "low", "high", "below").agg(F.first("places").alias("places"), F.sort_array(F.collect_list("v")).alias("s"))  # ``held`` values at most
    inside = inside.select(*keys, "c", "below", "s", F.explode("places").alias("place")).select(*keys, "c", "place", F.expr("get(s, int(place - below))").alias("value"))
    known = closed.unionByName(inside).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("c", "place"), "value"))).alias("values"))
    counts = sizes.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("c", "n"))).alias("counts"))  # a few places a column
    # A large group may have no values at all: every group has a row of its own beside its counts and values.
    none = {"counts": F.lit(None).cast(counts.schema["counts"].dataType).alias("counts"), "values": F.lit(None).cast(known.schema["values"].dataType).alias("values")}
    parts = large.select(*keys, none["counts"], none["values"]).unionByName(counts.select(*keys, "counts", none["values"])).unionByName(known.select(*keys, none["counts"], "values"))
    table = parts.groupBy(*keys).agg(F.first("counts", ignorenulls=True).alias("counts"), F.first("values", ignorenulls=True).alias("values"))

    def picked(i: int) -> Column:
        n = F.try_element_at("counts", F.lit(i))
        value = lambda at: F.try_element_at("values", F.struct(F.lit(i).alias("c"), at.alias("place")))
        out = []
        for share in map(float, shares):
            at = F.lit(share) * (n - 1)
            low, high = F.floor(at), F.ceil(at)
            out.append(F.when(low == high, value(low)).otherwise((high - at) * value(low) + (at - low) * value(high)))
        return F.when(n > 0, F.array(*out)).alias(f"v{i}")

    return small.unionByName(table.select(*keys, *[picked(i) for i in range(many)]))


def median_absolute_deviation(df: DataFrame, columns, rows: int | None = None) -> dict[str, tuple[float, float]]:
    """Median and median absolute deviation per column, from two passes over the rows."""
    rows = df.count() if rows is None else rows
    centre = medians(df, columns, rows=rows).first()
    spread_of = df.select(*[F.abs(F.col(f"`{c}`").cast("double") - F.lit(centre[c])).alias(c) for c in columns])
    spread = medians(spread_of, columns, rows=rows).first()
    return {c: (centre[c], spread[c]) for c in columns}

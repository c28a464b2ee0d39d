"""Table clean-up as projections: names, text cells, infinities, incomplete rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.numbers import finite, is_infinite, to_number
from assayer.functions.text import clean

NESTED = (T.ArrayType, T.MapType, T.StructType)
REAL = (T.DoubleType, T.FloatType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def trimmed_names(names) -> list[str]:
    """Names without outer spaces, 255 characters at most, blanks numbered; unique or an error."""
    out = [str(n).strip()[:255] or f"column_{i}" for i, n in enumerate(names)]
    if len(set(out)) != len(out):
        raise ValueError("Two column names are the same once trimmed.")
    return out


def normalize(df: DataFrame) -> DataFrame:
    """Clean names, nested cells as JSON text, decimals as doubles, infinities and NaN as null."""
    names = trimmed_names(df.columns)
    out = []
    for field, name in zip(df.schema.fields, names):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, NESTED):
            c = F.to_json(c)
        elif isinstance(field.dataType, REAL + (T.DecimalType,)):
            c = finite(c)
        elif isinstance(field.dataType, T.TimestampNTZType):
            c = c.cast("timestamp")
        out.append(c.alias(name))
    return df.select(*out)


def nonfinite_counts(df: DataFrame) -> DataFrame:
    """One row per numeric column: how many cells are plus or minus infinity."""
    reals = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    one = df.agg(*[F.count_if(is_infinite(F.col(f"`{c}`"))).alias(c) for c in reals])
    return long_form(one, {c: {"infinite_values": f"`{c}`"} for c in reals})


def long_form(wide: DataFrame, cells: dict, name: str = "column") -> DataFrame:
    """One row per entry from a wide row: a single explode, no second scan.

    ``cells`` maps each entry to its fields as SQL text; one text is far cheaper to hand over
    than hundreds of column objects.
    """
    rows = ", ".join("named_struct(" + ", ".join([f"'{name}', {quoted(c)}", *[f"'{k}', {v}" for k, v in fields.items()]]) + ")"
                     for c, fields in cells.items())
    return wide.selectExpr(f"inline(array({rows}))")


def quoted(value) -> str:
    """A text or number as an SQL literal."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(value)


def complete_cases(df: DataFrame, columns) -> DataFrame:
    """Rows in which every column is present and finite."""
    reals = {f.name for f in df.schema.fields if isinstance(f.dataType, REAL)}
    keep = F.lit(True)
    for c in columns:
        keep = keep & (finite(F.col(f"`{c}`")).isNotNull() if c in reals else F.col(f"`{c}`").isNotNull())
    return df.filter(keep)


def coerce_numbers(df: DataFrame, column: str, into: str | None = None, drop: bool = True) -> DataFrame:
    """Text as numbers, what does not parse as null; such rows are dropped unless told otherwise."""
    into = into or column
    out = df.withColumn(into, to_number(F.col(column)))
    return out.filter(F.col(into).isNotNull()) if drop else out


def clean_text(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({c: clean(F.col(c)) for c in columns})


def input_violations(df: DataFrame, key, required, numeric) -> DataFrame:
    """One row per bad cell of a scoring input: key, column, reason."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError("The input is missing: " + ", ".join(sorted(missing)))
    checks = [F.when(F.col(c).isNotNull() & to_number(F.col(c)).isNull(),
                     F.struct(F.lit(c).alias("column"), F.lit("must be a finite number or null").alias("reason")))
              for c in numeric]
    return (df.select(*key, F.explode(F.filter(F.array(*checks), lambda v: v.isNotNull())).alias("v"))
            .select(*key, "v.column", "v.reason"))


def valid_inputs(df: DataFrame, key, required, numeric) -> DataFrame:
    """The rows without a violation, numeric fields as doubles."""
    keep = F.lit(True)
    for c in numeric:
        keep = keep & ~(F.col(c).isNotNull() & to_number(F.col(c)).isNull())
    return df.filter(keep).select(*key, *[to_number(F.col(c)).alias(c) if c in numeric else F.col(c)
                                          for c in required if c not in key])

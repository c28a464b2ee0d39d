"""Quality rules with the frequency of lines across documents; DataFrame functions only.

Counts of a text come from array functions inside its row. Lines are normalised and hashed; per host
(the source) the distinct documents of a line are counted, where copies of a document count once: a
document is named by a hash of all its distinct lines. Lines in more than
the limit are removed and a document that keeps too few of its words is rejected. What is needed per
row (counts and line hashes, no text unless asked for) is written once with a row number; joins and
groupings work on that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import stored

SPACE = r"[\x20\x09-\x0D]+"
LEAST_WORDS, REPEAT_PERCENT = 50, 50
#: A line goes if more than this many documents of its host have it, whatever the size of the host.
LINE_DOCUMENTS = 20
#: Percentage of its words that a document must keep.
LEFT_PERCENT = 50
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != F.lit(""))


def normalised(line: Column) -> Column:
    return F.translate(F.trim(F.regexp_replace(line, SPACE, " ")), UPPER, LOWER)


def base_counts(df: DataFrame, text: str) -> DataFrame:
    """df with the counts of each text; __ columns are left for the caller to drop."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({"__words": words_of(t), "__lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    df = df.withColumns({
        "n_words": F.size("__words").cast("long"), "word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__windows": F.expr("CASE WHEN size(__words) > 2 THEN transform(sequence(0, size(__words) - 3), i -> xxhash64(__words[i], __words[i + 1], __words[i + 2])) ELSE array() END")})
    # Equal windows stand side by side once sorted; only texts with any are sorted.
    df = df.withColumn("__order", F.expr("CASE WHEN size(array_distinct(__windows)) < size(__windows) THEN sort_array(transform(__windows, (h, i) -> struct(h, i))) ELSE array() END"))
    df = df.withColumn("__at", F.expr("sort_array(transform(filter(__order, (s, k) -> (k > 0 AND get(__order, k - 1).h = s.h) OR (k < size(__order) - 1 AND get(__order, k + 1).h = s.h)), s -> s.i))"))
    covered = F.expr("aggregate(__at, struct(-3 AS last, 0 AS total), (a, p) -> struct(p AS last, a.total + least(3, p - a.last) AS total), a -> a.total)")
    return df.withColumn("n_repeat_words", covered.cast("long"))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", line_documents: int = LINE_DOCUMENTS,
          left_percent: int = LEFT_PERCENT, cleaned: bool = True) -> DataFrame:
    """One row per document: doc_id, host, the counts, base_failed, n_removed_lines, n_left_words, kept
    and, with ``cleaned``, the text without the removed lines.

    A null text counts as empty; null and empty texts have no words and fail the base rules. A null
    host is a host of its own. Repeated rows are judged one by one and count as one document of a
    line. Extra columns are not read. A text without frequent lines is returned unchanged.
    """
    slim = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{host}`").alias("__host"), F.col(f"`{text}`").alias("__text"))
    rows = base_counts(slim, "__text")
    rows = rows.withColumn("__marks", F.transform("__lines", lambda x: F.struct(F.md5(normalised(x)).alias("h"), F.size(words_of(x)).alias("n"))))
    keep = ["__id", "__host", *(["__text"] if cleaned else []), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "__marks"]
    rows = stored(rows.select(F.monotonically_increasing_id().alias("__row"), *keep), "line-marks")

    sets = rows.select("__host", F.sort_array(F.array_distinct("__marks.h")).alias("s"))
    each = sets.select("__host", F.xxhash64("s").alias("name"), F.explode("s").alias("h"))
    counts = each.distinct().groupBy("__host", "h").agg(F.count(F.lit(1)).alias("seen")).filter(F.col("seen") > line_documents)
    frequent = stored(counts.select(F.col("__host").alias("__of"), "h", "seen"), "frequent-lines")
    lines = rows.select("__row", "__host", F.explode("__marks").alias("m")).select("__row", "__host", "m.h", "m.n")
    gone = lines.join(frequent, lines["__host"].eqNullSafe(frequent["__of"]) & (lines["h"] == frequent["h"]))
    gone = gone.groupBy("__row").agg(F.sum("n").alias("__gone"), F.count(F.lit(1)).alias("n_removed_lines"), F.collect_set(lines["h"]).alias("__gone_lines"))
    out = rows.join(gone, "__row", "left").withColumns({"n_removed_lines": F.coalesce("n_removed_lines", F.lit(0).cast("long")), "n_left_words": F.col("n_words") - F.coalesce("__gone", F.lit(0).cast("long"))})
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)
    depleted = F.col("n_left_words") * 100 < F.col("n_words") * left_percent
    columns = [F.col("__id").alias(doc_id), F.col("__host").alias(host), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
               failed.alias("base_failed"), "n_removed_lines", "n_left_words", (~failed & ~depleted).alias("kept")]
    if cleaned:
        rest = F.array_join(F.filter(F.split("__text", "\n"), lambda x: ~F.array_contains("__gone_lines", F.md5(normalised(x)))), "\n")
        columns.append(F.when(F.col("__gone_lines").isNull(), F.col("__text")).otherwise(rest).alias("cleaned"))
    return out.select(*columns)


#: The columns of the contract in SQL.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
p AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
c AS (SELECT r, count(DISTINCT i + k) AS n FROM p, (VALUES (0), (1), (2)) v(k) GROUP BY r),
l AS (SELECT r, source, md5(translate(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h,
    len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT r, source, unnest(lines) AS x FROM w)),
m AS (SELECT r, md5(array_to_string(list_sort(list_distinct(list(h))), ',')) AS s FROM l GROUP BY r),
q AS (SELECT l.source, l.h FROM l JOIN m USING (r) GROUP BY ALL HAVING count(DISTINCT m.s) > 20),
o AS (SELECT r, sum(l.n) AS n, count(*) AS gone FROM l JOIN q ON l.h = q.h AND l.source IS NOT DISTINCT FROM q.source GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  len(words) < 50 OR 100 * coalesce(c.n, 0) > 50 * len(words) AS base_failed,
  NOT (len(words) < 50 OR 100 * coalesce(c.n, 0) > 50 * len(words)) AND NOT (len(words) - coalesce(o.n, 0)) * 100 < 50 * len(words) AS kept, coalesce(o.gone, 0)::BIGINT AS n_removed_lines
FROM w LEFT JOIN c USING (r) LEFT JOIN o USING (r)
"""

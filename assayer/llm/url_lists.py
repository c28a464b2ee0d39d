"""URL filter with dated lists: a temporal list join; DataFrame functions only.

Dated additions and removals of a list entry become validity intervals that do not overlap. A
capture is reduced to the keys an entry can name (every domain suffix of its host, host and path,
host and first path segment, words of the path) and joined as of its fetch time: a key meets the
one interval of an entry that holds then. Only keys travel, never page content; a key that a large
part of the captures share has few intervals on the other side, so the join splits it freely.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import stored

AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"
#: A longer name is no host name; it bounds the suffixes of a capture.
HOST_CHARS = 253
KINDS = ("domain", "path", "url", "word")


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port, leading www. and closing dot; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, AUTHORITY, 1)), r"^www\.|\.$", "")


def intervals(entries: DataFrame) -> DataFrame:
    """(list, role, kind, pattern, since, until) from dated entries (list, role, kind, pattern, action, at).

    An addition holds until the next entry of the same list and pattern; a removal ends it. At one
    instant a removal beats an addition and role block beats allow. Entries with a null in any column,
    an unknown kind, role or action are void. until is null while open.
    """
    valid = entries.filter(F.col("kind").isin(*KINDS) & F.col("role").isin("allow", "block") & F.col("action").isin("add", "remove")
                           & F.col("list").isNotNull() & F.col("pattern").isNotNull() & F.col("at").isNotNull())
    once = valid.groupBy("list", "kind", "pattern", "at").agg(F.max("role").alias("role"), F.max("action").alias("action"))
    after = F.lead("at").over(Window.partitionBy("list", "kind", "pattern").orderBy("at"))
    return once.withColumn("until", after).filter(F.col("action") == "add").select("list", "role", "kind", "pattern", F.col("at").alias("since"), "until")


def keys(url: Column) -> Column:
    """Distinct (kind, pattern) that an entry for this URL can have."""
    host, path = host_of(url), F.regexp_extract(url, PATH, 1)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    named = (host != "") & (F.length(host) <= HOST_CHARS)

    def of(kind: str, values: Column) -> Column:
        return F.transform(F.filter(values, lambda v: v != ""), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("pattern")))
    segment = F.regexp_extract(path, r"^/([^/]+)", 1)
    found = F.concat(of("domain", F.when(named, suffixes).otherwise(F.array().cast("array<string>"))), of("url", F.array(F.when(named, F.concat(host, path)).otherwise(F.lit("")))),
                     of("path", F.array(F.when(named & (segment != ""), F.concat_ws("/", host, segment)).otherwise(F.lit("")))),
                     of("word", F.split(F.lower(path), r"[^0-9a-z]+")))
    return F.array_distinct(found)


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", fetched_at: str = "fetched_at", others: list[str] | None = None) -> DataFrame:
    """Captures (url, fetched_at and the ``others``) with host, lists, n_entries and blocked.

    lists: names of the lists with an entry active at fetch time, sorted, joined by commas. Blocked is
    a capture with an active block entry and no active allow entry. A null, empty or unparsable URL and
    a null fetch time meet no entry and pass. Repeated captures are judged one by one; of columns that
    are not asked for nothing is read.
    """
    rest = [F.col(f"`{c}`") for c in (others or [])]
    slim = captures.select(*rest, F.col(f"`{url}`").alias("__url"), F.col(f"`{fetched_at}`").alias("__at"), F.monotonically_increasing_id().alias("__row"))
    slim = stored(slim, "captures")  # fixes the row numbers
    valid = stored(intervals(entries), "intervals")
    asked = slim.select("__row", "__at", F.explode(keys(F.col("__url"))).alias("k")).select("__row", "__at", "k.kind", "k.pattern")
    met = asked.join(valid, ["kind", "pattern"]).filter((F.col("__at") >= F.col("since")) & (F.col("until").isNull() | (F.col("__at") < F.col("until"))))
    found = met.groupBy("__row").agg(F.array_join(F.sort_array(F.collect_set("list")), ",").alias("lists"), F.count(F.lit(1)).alias("n_entries"),
                                     F.max((F.col("role") == "block").cast("int")).alias("__block"), F.max((F.col("role") == "allow").cast("int")).alias("__allow"))
    blocked = F.coalesce((F.col("__block") == 1) & (F.col("__allow") == 0), F.lit(False))
    return slim.join(found, "__row", "left").select(
        *rest, F.col("__url").alias(url), F.col("__at").alias(fetched_at), F.coalesce(host_of(F.col("__url")), F.lit("")).alias("host"),
        F.coalesce("lists", F.lit("")).alias("lists"), F.coalesce("n_entries", F.lit(0).cast("long")).alias("n_entries"), blocked.alias("blocked"))


def digit(value: Column, start: int, below: int) -> Column:
    return F.conv(F.substring(F.md5(value), start, 6), 16, 10).cast("int") % below


def day(number: Column) -> Column:
    return F.timestamp_seconds(F.lit(1704067200) + number.cast("long") * 86400)


def derived_captures(pages: DataFrame) -> DataFrame:
    """The pages with a fetch time of 2024 that follows from url and page_id."""
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1704067200) + digit(F.col("url"), 1, 360).cast("long") * 86400 + F.pmod(F.col("page_id"), F.lit(86400))).alias("fetched_at"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """Dated lists over all pages: hosts that come, go and return, sections, single pages and path words."""
    hosts = pages.select(host_of(F.col("url")).alias("h")).distinct().filter("h <> ''")
    a, b = digit(F.col("h"), 1, 180), digit(F.col("h"), 7, 60)

    def entry(df, name, role, kind, pattern, action, at, where):
        return df.filter(where).select(F.lit(name).alias("list"), F.lit(role).alias("role"), F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(action).alias("action"), day(at).alias("at"))
    h = F.col("h")
    section = pages.select(host_of(F.col("url")).alias("h"), F.regexp_extract(F.regexp_extract("url", PATH, 1), r"^/([^/]+)", 1).alias("s")).distinct().filter("h <> '' AND s <> ''")
    section = section.select(F.concat_ws("/", "h", "s").alias("h"))
    single = pages.select(F.concat(host_of(F.col("url")), F.regexp_extract("url", PATH, 1)).alias("h")).distinct().filter("h <> ''")
    word = pages.select(F.explode(F.split(F.lower(F.regexp_extract("url", PATH, 1)), r"[^0-9a-z]+")).alias("h")).distinct().filter("h <> ''")
    parts = [entry(hosts, "malware", "block", "domain", h, "add", a, b % 4 == 0), entry(hosts, "malware", "block", "domain", h, "remove", a + b, (b % 4 == 0) & (a % 3 == 0)),
             entry(hosts, "malware", "block", "domain", h, "add", a + b + 90, (b % 4 == 0) & (a % 6 == 0)), entry(section, "sections", "block", "path", h, "add", a, b % 5 == 1),
             entry(section, "sections", "block", "path", h, "remove", a + 120, (b % 5 == 1) & (a % 2 == 0)), entry(single, "reviewed", "allow", "url", h, "add", a, b % 6 == 2),
             entry(word, "words", "block", "word", h, "add", a, b % 30 == 3)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: The query over pages in SQL; its dated lists are the same.
SQL = r"""
WITH c AS (SELECT row_number() OVER () AS r, page_id, url, 1704067200 + (('0x' || substr(md5(url), 1, 6))::INT % 360)::BIGINT * 86400 + page_id % 86400 AS s,
    regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.|\.$', '', 'g') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
k AS (
  SELECT r, s, 'domain' AS kind, list_aggregate(string_split(host, '.')[i:], 'string_agg', '.') AS h FROM (SELECT r, s, host, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM c WHERE host <> '' AND length(host) <= 253)
  UNION SELECT r, s, 'url', host || path FROM c WHERE host <> '' AND length(host) <= 253
  UNION SELECT r, s, 'path', host || '/' || regexp_extract(path, '^/([^/]+)', 1) FROM c WHERE host <> '' AND length(host) <= 253 AND regexp_extract(path, '^/([^/]+)', 1) <> ''
  UNION SELECT r, s, 'word', h FROM (SELECT r, s, unnest(regexp_extract_all(lower(path), '[0-9a-z]+')) AS h FROM c)),
n AS (SELECT kind, h, ('0x' || substr(md5(h), 1, 6))::INT % 180 AS a, ('0x' || substr(md5(h), 7, 6))::INT % 60 AS b FROM (
  SELECT 'domain' AS kind, host AS h FROM c WHERE host <> '' UNION SELECT kind, h FROM k WHERE kind <> 'domain')),
e AS (
  SELECT 'malware' AS list, 'block' AS role, kind, h, a AS f, CASE WHEN a % 3 = 0 THEN a + b END AS u FROM n WHERE kind = 'domain' AND b % 4 = 0
  UNION ALL SELECT 'malware', 'block', kind, h, a + b + 90, NULL FROM n WHERE kind = 'domain' AND b % 4 = 0 AND a % 6 = 0
  UNION ALL SELECT 'sections', 'block', kind, h, a, CASE WHEN a % 2 = 0 THEN a + 120 END FROM n WHERE kind = 'path' AND b % 5 = 1
  UNION ALL SELECT 'reviewed', 'allow', kind, h, a, NULL FROM n WHERE kind = 'url' AND b % 6 = 2
  UNION ALL SELECT 'words', 'block', kind, h, a, NULL FROM n WHERE kind = 'word' AND b % 30 = 3),
m AS (SELECT k.r, string_agg(DISTINCT e.list, ',' ORDER BY e.list) AS lists, count(*) AS n, bool_or(role = 'block') AS bl, bool_or(role = 'allow') AS al
  FROM k JOIN e ON k.kind = e.kind AND k.h = e.h AND k.s >= 1704067200 + e.f::BIGINT * 86400 AND (e.u IS NULL OR k.s < 1704067200 + e.u::BIGINT * 86400) GROUP BY k.r)
SELECT page_id, url, s AS fetched_second, host, coalesce(lists, '') AS lists, coalesce(n, 0)::BIGINT AS n_entries, coalesce(bl AND NOT al, false) AS blocked FROM c LEFT JOIN m USING (r)
"""

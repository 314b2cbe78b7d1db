"""Operator 4. URL filter by a temporal list join.

A list is a table of dated entries: from ``effective`` on, ``pattern`` is blocked, allowed, or off the list. Entries of a pattern become validity intervals (each ends where the next
begins), and an as-of join evaluates every capture against what was active when it was fetched. Patterns are host suffixes of two labels or more, and a host with the first segment
of its path. Of the active patterns that match, the longest decides.

The join is an equality join on the pattern, with the interval as a condition: a host with a third of all captures is a skewed side of a merge join, which adaptive execution splits; the intervals are read back from the shared folder, so that the join has plain shuffles on both sides. Nothing is broadcast.

Null and malformed URLs have no host and no match; captures without a fetch time match nothing. Entries with a null pattern or time are ignored; of entries of one pattern at one time the
strictest holds (block, allow, remove). A verdict depends on URL and time only, so captures with a null or a repeated key are judged like any other, and repeated captures each get their row. Empty lists match nothing; an empty
table of captures gives an empty result. Extra columns of captures and entries are kept out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftrank.sources.checkpoints import stored

HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
SEGMENT = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+/([^/?#]+)"


def host(url: str = "url") -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def intervals(entries: DataFrame) -> DataFrame:
    """``(pattern, action, since, until)``: when each listed pattern is blocked or allowed; ``until`` is null for what still holds."""
    strict = F.when(F.col("action") == "block", 0).when(F.col("action") == "allow", 1).otherwise(2)
    dated = entries.where("pattern IS NOT NULL AND effective IS NOT NULL").groupBy("pattern", "effective").agg(F.min_by("action", strict).alias("action"))
    until = F.lead("effective").over(Window.partitionBy("pattern").orderBy("effective"))
    return dated.withColumn("until", until).where(F.col("action").isin("block", "allow")).select("pattern", "action", F.col("effective").alias("since"), "until")


def candidates(captures: DataFrame) -> DataFrame:
    """``(url, fetched, pattern)``: every pattern that could match a capture; captures of one URL at one time are one."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    segment = F.regexp_extract("url", SEGMENT, 1)
    patterns = F.when(segment != "", F.concat(suffixes, F.array(F.concat_ws("/", "host", segment)))).otherwise(suffixes)
    once = captures.where("url IS NOT NULL AND fetched IS NOT NULL").select("url", "fetched").distinct()
    return once.withColumn("host", host()).where("host <> ''").select("url", "fetched", F.explode(patterns).alias("pattern"))


def evaluate(captures: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """``key, host, fetched, verdict, pattern, since`` of each capture; the verdict is block, allow or none."""
    active = (
        candidates(captures).hint("merge").join(stored(intervals(entries)), "pattern")
        .where("since <= fetched AND (until IS NULL OR fetched < until)")
        .groupBy("url", "fetched").agg(F.max(F.struct(F.length("pattern").alias("n"), "pattern", "action", "since")).alias("best"))
    )
    # read back, so that a URL with a third of all captures is a skewed side of a plain join
    joined = captures.select(key, "url", F.nullif(host(), F.lit("")).alias("host"), "fetched").hint("merge").join(stored(active), ["url", "fetched"], "left")
    return joined.select(key, "host", "fetched", F.coalesce("best.action", F.lit("none")).alias("verdict"), F.col("best.pattern").alias("pattern"), F.col("best.since").alias("since"))


def draw(column: Column, n: int) -> Column:
    """A portable pseudo-random number below ``n``."""
    return F.pmod(F.conv(F.substring(F.md5(column), 1, 8), 16, 10).cast("long"), F.lit(n))


def dated_pages(pages: DataFrame) -> DataFrame:
    """Captures ``(page_id, url, fetched)``: the tables have no fetch times, so the page's number gives each one, in the minutes of 400 days."""
    minute = draw(F.col("page_id").cast("string"), 400 * 1440)
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1_700_000_000) + minute * 60).alias("fetched"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """A list that grows with the pages: each host, parent domain and first path segment that occurs has up to three dated entries."""
    parts = pages.select(host().alias("host"), F.regexp_extract("url", SEGMENT, 1).alias("segment")).where("host <> ''")
    parent = F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1)
    every = parts.select(F.explode(F.array("host", parent, F.concat_ws("/", "host", "segment"))).alias("pattern")).where("pattern <> ''").distinct()
    turns = every.select("pattern", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("turn"))
    key = F.concat_ws("#", "pattern", F.col("turn").cast("string"))
    action = F.element_at(F.array(F.lit("block"), F.lit("allow"), F.lit("remove")), (draw(F.concat(key, F.lit("a")), 3) + 1).cast("int"))
    return turns.where(draw(F.concat(key, F.lit("k")), 2) == 0).select("pattern", action.alias("action"), F.timestamp_seconds(F.lit(1_700_000_000) + draw(key, 400) * 86_400).alias("effective"))


ORACLE = r"""
WITH p AS (
  SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
         regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+/([^/?#]+)', 1) AS segment,
         make_timestamp((1700000000 + (('0x' || substr(md5(page_id::VARCHAR), 1, 8))::BIGINT % 576000) * 60) * 1000000) AS fetched
  FROM pages),
names AS (
  SELECT DISTINCT pattern FROM (
    SELECT unnest([host, regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1), host || '/' || segment]) AS pattern FROM p WHERE host <> '') WHERE pattern <> ''),
turns AS (SELECT pattern, pattern || '#' || turn AS key FROM names, unnest([0, 1, 2]) AS t(turn)),
entries AS (
  SELECT pattern, ['block', 'allow', 'remove'][('0x' || substr(md5(key || 'a'), 1, 8))::BIGINT % 3 + 1] AS action,
         make_timestamp((1700000000 + (('0x' || substr(md5(key), 1, 8))::BIGINT % 400) * 86400) * 1000000) AS effective
  FROM turns WHERE ('0x' || substr(md5(key || 'k'), 1, 8))::BIGINT % 2 = 0),
dated AS (SELECT pattern, effective, min_by(action, CASE action WHEN 'block' THEN 0 WHEN 'allow' THEN 1 ELSE 2 END) AS action FROM entries GROUP BY ALL),
valid AS (SELECT pattern, action, effective AS since, lead(effective) OVER (PARTITION BY pattern ORDER BY effective) AS until FROM dated),
cand AS (
  SELECT page_id, fetched, unnest(list_transform(range(1, greatest(len(string_split(host, '.')), 2)), lambda i: array_to_string(string_split(host, '.')[i:], '.'))
         || CASE WHEN segment <> '' THEN [host || '/' || segment] ELSE [] END) AS pattern
  FROM p WHERE host <> ''),
best AS (
  SELECT c.page_id, c.fetched, max({'n': length(c.pattern), 'pattern': c.pattern, 'action': v.action, 'since': v.since}) AS b
  FROM (SELECT DISTINCT * FROM cand) c JOIN valid v ON v.pattern = c.pattern AND v.action <> 'remove' AND v.since <= c.fetched AND (v.until IS NULL OR c.fetched < v.until)
  GROUP BY ALL)
SELECT p.page_id, nullif(p.host, '') AS host, p.fetched, coalesce(b.action, 'none') AS verdict, b.pattern AS pattern, b.since AS since
FROM p LEFT JOIN best ON best.page_id = p.page_id AND best.fetched = p.fetched
"""

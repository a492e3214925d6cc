"""Line dedup by site-relative frequency, in DataFrame operations only.

Lines are counted per host as the number of the host's pages that hold them, and a line that more
than max_ratio of the pages hold is dropped from all of them. Frequencies of a host's lines above the ratio
sum to its mean number of distinct lines a page, so a host has at most (that mean / max_ratio)
boilerplate lines: they are gathered into one row for each host, and pages look them up: by broadcast up to a bound
in bytes, and beyond it by a join on the host, which adaptive execution splits for hosts with very many pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialize, small

#: A line on more than this part of a host's pages is boilerplate.
MAX_RATIO = 0.5
#: An option that is off at 1: lines on fewer pages stay. At 1 a host's only page has all its lines on all pages, and loses them.
MIN_PAGES = 1

# Patterns that turn markup into lines.
UNSEEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
BLOCK = r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|article|section|nav|header|footer|title|body|head|html)\b[^>]*>"
TAG = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"))


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def lines_of(html: Column) -> Column:
    """Non-empty trimmed lines of a page's text; a null page has none."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), UNSEEN, " ")
    text = F.regexp_replace(F.regexp_replace(text, BLOCK, "\n"), TAG, "")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.array_remove(F.transform(F.split(text, "\n"), lambda x: F.btrim(x)), "")


def _digest(line: Column) -> Column:
    """128 bits in two longs (the constant first: it seeds the second hash), so that lines of one host don't collide at any size."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def drop_boilerplate(pages: DataFrame, host: str, lines: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """pages with a column kept: the array `lines` without lines that at least min_pages pages of the
    same host and more than max_ratio of them hold. Every column of pages comes along."""
    h, common = fresh(pages, "_host"), fresh(pages, "_common")
    seen = pages.select(F.col(host).alias(h), F.explode_outer(F.array_distinct(F.transform(F.col(lines), _digest))).alias("d")).where("d is not null")
    counts = seen.groupBy(h, "d").count().where(F.col("count") >= min_pages)
    totals = materialize(pages.groupBy(F.col(host).alias("t")).agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages), "hosts")
    n_hosts = totals.count()
    found = counts.join(small(totals, n_hosts), F.col(h).eqNullSafe(F.col("t"))).where(F.col("count") > F.col("pages") * max_ratio)
    found = materialize(found.groupBy(h).agg(F.collect_list("d").alias(common)), "boilerplate")
    held = found.agg(F.sum(F.size(common))).first()[0] or 0
    out = pages.join(small(found, 0, held * 40), F.col(host).eqNullSafe(F.col(h)), "left").drop(h)
    # the page's own boilerplate by hashing, so that a line is compared with no other of its host
    out = out.withColumn(common, F.array_intersect(F.transform(F.col(lines), _digest), F.col(common)))
    keep = F.filter(F.col(lines), lambda x: ~F.array_contains(F.col(common), _digest(x)))
    return out.withColumn("kept", F.when(F.coalesce(F.size(common), F.lit(0)) <= 0, F.col(lines)).otherwise(keep)).drop(common)


def line_dedup(spark: SparkSession, pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, host, n_lines, n_dropped, text (the lines kept, joined by newlines) for each row of pages.

    A null or malformed url has the host ''; a null page has no lines; a line repeated on a page
    counts once for that page and is dropped each time; repeated rows are pages of their own. A very
    long page is one row of lines; a line at exactly the ratio stays. Other columns are ignored; no rows give none.
    """
    split = materialize(pages.select("page_id", host_of(F.col("url")).alias("host"), lines_of(F.col("html")).alias("lines")), "lines")
    out = drop_boilerplate(split, "host", "lines", max_ratio, min_pages)
    n = F.size("lines")
    return out.select("page_id", "host", n.alias("n_lines"), (n - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


ORACLE = rf"""
WITH t AS (SELECT page_id, lower(coalesce(regexp_extract(url, '{HOST}', 1), '')) AS host,
  regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{UNSEEN}', ' ', 'g'), '{BLOCK}', chr(10), 'g'), '{TAG}', '', 'g') AS x FROM pages),
l AS (SELECT page_id, host, list_filter(list_transform(string_split(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), chr(10)), lambda y: trim(y)), lambda y: y <> '') AS lines FROM t),
c AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM l) GROUP BY ALL),
h AS (SELECT host, count(*) AS pages FROM l GROUP BY host),
b AS (SELECT host, list(line) AS common FROM c JOIN h USING (host) WHERE n >= {MIN_PAGES} AND n > pages * {MAX_RATIO} GROUP BY host),
k AS (SELECT page_id, host, lines, list_filter(lines, lambda y: NOT list_contains(coalesce(common, []), y)) AS kept FROM l LEFT JOIN b USING (host))
SELECT page_id, host, len(lines)::INTEGER AS n_lines, (len(lines) - len(kept))::INTEGER AS n_dropped, coalesce(array_to_string(kept, chr(10)), '') AS text FROM k
"""

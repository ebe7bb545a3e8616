"""Site-relative line deduplication.

Rows are grouped by site. A line's ratio is the number of the site's pages that contain it over the number of its
pages; lines above ``max_ratio`` are boilerplate and are dropped from every page of the site.

Lines are counted as 64-bit keys once a page, with a partial aggregate before the shuffle. A site's boilerplate
can't be long: each such line is on more than ``max_ratio`` of the pages, so there are fewer than the mean number of
lines a page over ``max_ratio``. It is kept as one array a site. The arrays are broadcast while their
size, which is measured, is small; beyond that they are repeated over ``SALTS`` parts of the site's pages,
so a site with a third of all pages is no single task. Pages are filtered in place; no line is shuffled back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: A line on more than a fifth of a site's pages, and on two at least, is boilerplate. The floor shields what stands on one page of a small site;
#: the ratio lies above that of short lines that meet by chance (README).
MAX_RATIO, MIN_PAGES = 0.2, 2
SALTS = 64
BROADCAST_KEYS = 2_000_000


def line_key(line: Column) -> Column:
    """Lines are the same if they are so after trimming and making one space of white space."""
    return F.xxhash64(F.trim(F.regexp_replace(line, "[ \\t\\r\\f\\x0B]+", " ")))


def _has_words(line: Column) -> Column:
    return line.rlike("[^ \\t\\r\\f\\x0B]")


def boilerplate(pages: DataFrame, max_ratio: float, min_pages: int, clean: bool = False) -> DataFrame:
    """(site, keys): the keys of each site's boilerplate. ``pages`` has site and lines (array of strings); ``clean``
    lines are trimmed and not blank already.

    A line counts from ``min_pages`` pages on: on fewer, repetition tells nothing.
    """
    sizes = pages.groupBy("site").agg(F.count(F.lit(1)).alias("n_pages"))
    lines = F.transform("lines", lambda x: F.xxhash64(x)) if clean else F.transform(F.filter("lines", _has_words), line_key)
    counts = pages.select("site", F.explode(F.array_distinct(lines)).alias("key")).groupBy("site", "key").agg(F.count(F.lit(1)).alias("n"))
    found = counts.where(F.col("n") >= min_pages).join(F.broadcast(sizes) if sizes.count() <= BROADCAST_KEYS else sizes, "site")
    return found.where(F.col("n") > max_ratio * F.col("n_pages")).groupBy("site").agg(F.collect_list("key").alias("keys"))


def without_boilerplate(pages: DataFrame, max_ratio: float, min_pages: int, clean: bool = False) -> DataFrame:
    """``pages`` (site, lines, ...) with column kept_lines. Blank lines stay where they are."""
    found = checkpointed(boilerplate(pages, max_ratio, min_pages, clean))
    size = found.agg(F.coalesce(F.sum(F.size("keys") + 8), F.lit(0))).first()[0]
    if size <= BROADCAST_KEYS:
        joined = pages.join(F.broadcast(found), "site", "left")
    else:
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
        joined = pages.withColumn("salt", salt).join(salted, ["site", "salt"], "left").drop("salt")
    key = F.xxhash64 if clean else line_key
    drop = lambda x: F.array_contains("keys", key(x)) & (F.lit(True) if clean else _has_words(x))
    kept = F.when(F.col("keys").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~drop(x)))
    return joined.withColumn("kept_lines", kept).drop("keys")


def host(url: Column) -> Column:
    """Lower-case host of a URL without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def html_lines(html: Column) -> Column:
    """Text lines of a page: block elements end a line, other tags go, common character references are read."""
    text = html
    for pattern, by in (
        ("(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|<!--.*?-->", " "),
        ("(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|nav|footer|header|section|title|head|body|html)\\b[^>]*>", "\n"),
        ("<[^>]*>", ""),
    ):
        text = F.regexp_replace(text, pattern, by)
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    # White space is made one space at once; a line's ends are trimmed after the split.
    return F.filter(F.transform(F.split(F.regexp_replace(text, "[ \\t\\r\\f\\x0B]+", " "), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def page_lines(pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, host, n_lines, n_dropped and text of every row of ``pages`` (page_id, url, html).

    A null or hostless url is a site of its own, the empty host; null html has no lines; very long pages are one array of lines;
    repeated rows count as pages each; an empty table gives an empty one; other columns are not read.
    """
    lines = F.coalesce(html_lines(F.col("html")), F.array().cast("array<string>"))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce(host(F.col("url")), F.lit("")).alias("site"), lines.alias("lines"))
    kept = without_boilerplate(rows, max_ratio, min_pages, clean=True)
    return kept.select(
        "page_id",
        F.col("site").alias("host"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size("kept_lines")).cast("bigint").alias("n_dropped"),
        F.array_join("kept_lines", "\n").alias("text"),
    )


def deduplicated(docs: DataFrame, site_column: str = "source", text_column: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text and n_chars, where there is one, counted anew.

    No row is dropped. A null site is one site; a null text stays null, an empty one empty; a very long text is one array of lines; repeated rows
    count as pages each; an empty table gives an empty one. n_chars keeps its type.
    """
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"))
    site = F.coalesce(F.col(f"doc.`{site_column}`").cast("string"), F.lit(""))
    rows = packed.select("doc", site.alias("site"), F.split(F.col(f"doc.`{text_column}`"), "\n").alias("lines"))
    kept = without_boilerplate(rows, max_ratio, min_pages).withColumn("new", F.array_join("kept_lines", "\n"))
    columns = []
    for c in names:
        of = F.col(f"doc.`{c}`")
        if c == text_column:
            of = F.col("new")
        elif c == "n_chars":
            of = F.coalesce(F.char_length("new").cast(docs.schema[c].dataType), of)
        columns.append(of.alias(c))
    return kept.select(*columns)


#: DuckDB SQL for page_lines() with the default ratio.
ORACLE = r"""
WITH t AS (
  SELECT page_id, coalesce(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS host,
    replace(replace(replace(replace(replace(
      regexp_replace(regexp_replace(regexp_replace(html,
        '<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->', ' ', 'gis'),
        '</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|nav|footer|header|section|title|head|body|html)\b[^>]*>', chr(10), 'gi'),
        '<[^>]*>', '', 'g'),
      '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS text
  FROM pages),
l AS (
  SELECT page_id, host, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\f\x0B]+', ' ', 'g'))),
    lambda x: x <> '') AS lines FROM t),
h AS (SELECT host, count(*) AS n_pages FROM l GROUP BY host),
d AS (SELECT DISTINCT page_id, host, unnest(lines) AS line FROM l),
c AS (SELECT host, line, count(*) AS n FROM d GROUP BY host, line),
b AS (SELECT c.host, list(line) AS bad FROM c JOIN h USING (host) WHERE n >= 2 AND n > 0.2 * n_pages GROUP BY c.host),
k AS (SELECT page_id, l.host, lines, CASE WHEN bad IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(bad, x)) END AS kept
  FROM l LEFT JOIN b USING (host))
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped,
  coalesce(array_to_string(kept, chr(10)), '') AS text
FROM k
"""

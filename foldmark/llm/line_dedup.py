"""Line dedup by site-relative frequency: a line that stands on too large a part of a host's pages is boilerplate.

One row at a time pages become lines and lines 64-bit hashes; each page counts a line once, so partial sums do most
of the work before the only shuffle of hashes. Pages are counted by their addresses alone. A host's boilerplate has at most (mean lines of a page / ratio) lines,
however many pages it has, so it is kept as one array for each host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldmark.llm._shared import bare, free, small, staged, table

#: Tags that end a line of text.
BLOCKS = "p|div|li|ul|ol|nav|h[1-6]|tr|table|article|section|header|footer|aside|title|head|body|html|br|hr|blockquote|pre"


def host_of(url: Column) -> Column:
    """The host of a URL in lower case without user, port and a leading www.; empty for null or none."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", ""), F.lit(""))


def lines_of(html: Column) -> Column:
    """The lines of text of a page, trimmed, with single spaces, none empty: scripts, styles and comments go, tags in
    BLOCKS and line feeds end a line, other tags go."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", "\n")
    text = F.regexp_replace(text, rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n")
    text = F.regexp_replace(F.regexp_replace(text, r"<[^>\n]*>", ""), r"[\t\r\f\x0B\x20]+", " ")
    return F.filter(F.split(text, r"\x20?\n[\n\x20]*"), lambda x: F.trim(x) != "")


def drop_boilerplate(pages: DataFrame, ratio: float = 0.5, min_pages: int = 2, url_col: str = "url", html_col: str = "html", names: tuple[str, str, str, str] = ("host", "lines", "n_lines", "n_dropped")) -> DataFrame:
    """pages with four more columns: host, lines (array of those kept, in order), n_lines and n_dropped.

    A line goes if the pages that hold it are more than `ratio` of its host's pages. On hosts with fewer than min_pages pages
    all lines stay: where there is one page, every line stands on all pages of the host, which says nothing; 1 applies the ratio
    there, too. Pages of null or unreadable URLs share the host ''. Null html has no lines. Rows repeated count as
    pages of their own. All columns pass through; a new one whose name is taken gets underscores after it.
    """
    host, lines, n_lines, n_dropped = names = free(pages, names)
    kept, drop, pages_n = (bare(pages, set(names), p) for p in ("__kept", "__drop", "__pages"))
    rows = pages.withColumn(host, host_of(F.col(url_col))).withColumn(lines, F.transform(lines_of(F.col(html_col)), lambda x: F.trim(x)))
    line = lambda x: F.xxhash64(x)
    hosts = rows.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias(pages_n)).filter(F.col(pages_n) >= min_pages)
    seen = rows.select(F.col(host).alias("host"), F.explode(F.array_distinct(F.transform(lines, line))).alias("line"))
    often = seen.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).join(small(staged(hosts, "hosts")), "host").filter(F.col("n") > ratio * F.col(pages_n))
    gone = staged(often.groupBy(F.col("host").alias(pages_n)).agg(F.collect_list("line").alias(drop)), "boilerplate")
    rows = rows.join(small(gone), F.col(host) == F.col(pages_n), "left")
    rows = rows.withColumn(kept, F.when(F.col(drop).isNull(), F.col(lines)).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col(drop), line(x)))))
    return rows.select(*[F.col(f"`{c}`") for c in pages.columns], host, F.col(kept).alias(lines), F.size(lines).cast("long").alias(n_lines), (F.size(lines) - F.size(kept)).cast("long").alias(n_dropped))


def line_dedup_query(spark, sf_dir: str) -> DataFrame:
    pages = drop_boilerplate(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "host", "n_lines", "n_dropped", F.array_join("lines", "\n").alias("kept_text"))


SQL = rf"""
WITH t AS (SELECT page_id, coalesce(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', ''), '') AS host,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->', chr(10), 'g'),
    '(?i)</?(?:{BLOCKS})\b[^>]*>', chr(10), 'g'), '<[^>\n]*>', '', 'g'), '[\t\r\f\x0B\x20]+', ' ', 'g') AS text FROM pages),
p AS (SELECT row_number() OVER () AS r, page_id, host, list_filter(list_transform(regexp_split_to_array(text, '\x20?\n[\n\x20]*'), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines FROM t),
h AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
c AS (SELECT host, line, count(*) AS n FROM (SELECT DISTINCT r, host, unnest(lines) AS line FROM p) GROUP BY ALL),
b AS (SELECT host, list(line) AS gone FROM c JOIN h USING (host) WHERE pages >= 2 AND n > 0.5 * pages GROUP BY host),
k AS (SELECT page_id, p.host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(gone, []), x)) AS kept FROM p LEFT JOIN b ON b.host = p.host)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped, array_to_string(kept, chr(10)) AS kept_text FROM k
"""

"""Line dedup by site-relative frequency.

A line is boilerplate of a site when the share of the site's pages that
contain it exceeds a ratio.  Lines are counted once per page as 128-bit
hashes, so the shuffles carry hashes, and the partial aggregation folds a line
that a whole site shares before it moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_folder, pick

#: What is not text, which tags end a line, any other tag.
HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
BLOCK_TAGS = ("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
              "head header hr html li main nav ol option p pre section select table tbody td tfoot th thead title tr ul")
LINE_END = rf"(?i)</?(?:{'|'.join(BLOCK_TAGS.split())})\b[^>]*>"
TAG = r"<[^>]*>"
SPACE_RUN = r"[\x20\x09\x0B-\x0D]+"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def lines_of(html: Column) -> Column:
    """Non-empty text lines of a page: block tags and line breaks end a line, white space is folded."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " ")
    text = F.regexp_replace(F.regexp_replace(text, LINE_END, "\n"), TAG, "")
    folded = F.regexp_replace(text, SPACE_RUN, " ")
    return F.filter(F.transform(F.split(folded, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def drop_boilerplate(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                     ratio: float = 0.2, least_pages: int = 3) -> DataFrame:
    """One row per input row: ``page_id, host, n_lines, n_dropped, text`` without its site's boilerplate lines.

    A line is dropped when more than ``ratio`` of the host's pages contain it,
    and at least ``least_pages`` do.  The extracted lines are written once to
    the shared folder and read for counting, marking and cutting.

    * null html: no line, empty text; null url or a url without a host: host
      null, a page of no site, which loses nothing;
    * null id and repeated rows: each row is a page of its own and counts as one;
    * a line repeated within a page counts once, and goes everywhere in it;
    * empty table: no rows.  Other columns are ignored.
    """
    spark = pages.sparkSession
    folder = fresh_folder(spark, "lines")
    (pick(pages, page_id=id_col, url=url_col, html=html_col)
     .select("page_id", host_of(F.col("url")).alias("host"), lines_of(F.col("html")).alias("lines")).write.parquet(folder))
    rows = spark.read.parquet(folder)
    digest = lambda line: F.unhex(F.md5(line))

    sites = rows.filter("host is not null").groupBy("host").agg(F.count("*").alias("pages"))
    each = rows.filter("host is not null").select(
        "page_id", "host", F.explode(F.array_distinct(F.transform("lines", digest))).alias("line"))
    common = (each.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= least_pages)
              .join(sites, "host").filter(F.col("n") > ratio * F.col("pages")).select("host", "line"))
    marked = (each.join(common, ["host", "line"]).groupBy("page_id", "host").agg(F.collect_set("line").alias("gone"))
              .select(F.col("page_id").alias("marked_id"), F.col("host").alias("marked_host"), "gone"))
    same = F.col("page_id").eqNullSafe(F.col("marked_id")) & (F.col("host") == F.col("marked_host"))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x: ~F.array_contains("gone", digest(x))))
    out = rows.join(marked, same, "left").select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
    return out.select("page_id", "host", "n_lines", (F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"),
                      F.array_join("kept", "\n").alias("text"))


LINES_SQL = rf"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id,
    nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS host,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      coalesce(html, ''), '{HIDDEN}', ' ', 'g'), '{LINE_END}', chr(10), 'g'), '{TAG}', '', 'g'), '{SPACE_RUN}', ' ', 'g'), chr(10)),
      lambda x: trim(x)), lambda x: x <> '') AS lines
  FROM pages),
s AS (SELECT host, count(*) AS pages FROM p WHERE host IS NOT NULL GROUP BY host),
e AS (SELECT DISTINCT r, host, unnest(lines) AS line FROM p WHERE host IS NOT NULL),
c AS (SELECT e.host, line FROM e JOIN s ON e.host = s.host GROUP BY e.host, line, pages HAVING count(*) >= 3 AND count(*) > 0.2 * pages),
m AS (SELECT e.r, list(e.line) AS gone FROM e JOIN c ON e.host = c.host AND e.line = c.line GROUP BY e.r),
k AS (SELECT p.*, CASE WHEN gone IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(gone, x)) END AS kept
      FROM p LEFT JOIN m ON p.r = m.r)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped,
  array_to_string(kept, chr(10)) AS text
FROM k
"""

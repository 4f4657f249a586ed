"""Line dedup by site-relative frequency.

A line's share of its host is the number of pages with it over the host's pages, pages of the same text being one. A line is
boilerplate if its share surely exceeds ``ratio``: n pages out of a host's N by n - 2 * sqrt(n) > ratio * N, two standard errors
of a count being taken off, so that what a few pages of a small host happen to share isn't boilerplate. A page
whose every line is boilerplate is no page with boilerplate around its content: it keeps them.

Lines are counted by a 128-bit hash, so counting shuffles no text; the positions of boilerplate lines then go back to their pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, written

RATIO = 0.01


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, without port and credentials; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def boilerplate_lines(pages: DataFrame, page: str, host: str, text: str, ratio: float = RATIO) -> tuple[DataFrame, DataFrame]:
    """(line occurrences: id, host, pos, k; boilerplate: host, k). k hashes the trimmed line; blank lines have none."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    rows = pages.select(F.col(page).alias("id"), F.col(host).alias("host"), F.posexplode(lines).alias("pos", "line"))
    rows = rows.withColumn("line", F.trim("line")).filter("line <> ''")
    rows = rows.select("id", "host", "pos", F.struct(F.xxhash64("line").alias("a"), F.xxhash64(F.lit("line"), "line").alias("b")).alias("k"))
    body = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    totals = pages.groupBy(F.col(host).alias("host")).agg(F.count_distinct(body).alias("pages"))
    # One row for each page and line: pages are whole in a task, so this needs no shuffle of its own.
    once = pages.select(F.col(host).alias("host"), body.alias("body"), F.explode(F.array_distinct(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""))).alias("line"))
    once = once.select("host", "body", F.struct(F.xxhash64("line").alias("a"), F.xxhash64(F.lit("line"), "line").alias("b")).alias("k"))
    counts = once.groupBy("host", "k").agg(F.count_distinct("body").alias("n")).filter("n >= 2")
    found = counts.alias("c").join(small(written(totals, "line-hosts")).alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")))
    found = found.filter(F.col("n") - 2 * F.sqrt("n") > ratio * F.col("pages"))
    return rows, written(found.select("c.host", "k"), "line-boilerplate")


def drop_boilerplate(pages: DataFrame, page: str = "doc_id", host: str = "source", text: str = "text", ratio: float = RATIO) -> DataFrame:
    """pages with text rid of boilerplate lines, and n_lines and n_dropped.

    Lines end at \\n and compare by what is left after trimming spaces; blank lines stay. Null text
    stays null and has no lines; text that is all boilerplate stays as it is. A null host is one host. Rows of one text
    count as one page of their host, whatever their ids, and each row is cleaned by its own lines. Other columns stay; ones named
    n_lines or n_dropped give way to these. An empty table gives no rows.
    """
    row = F.struct(*pages.columns)
    own = [F.col(page), F.col(host), F.col(text)]
    key = F.struct(F.xxhash64(*own).alias("a"), F.xxhash64(F.lit("page"), *own).alias("b"))  # equal rows have equal lines
    keyed = pages.select(row.alias("row"), F.col(host).alias("host"), F.col(text).alias("text"), key.alias("id"))
    rows, found = boilerplate_lines(keyed, "id", "host", "text", ratio)
    hits = rows.alias("r").join(small(found).alias("f"), F.col("r.host").eqNullSafe(F.col("f.host")) & (F.col("r.k") == F.col("f.k"))).select("r.id", "r.pos")
    bad = hits.groupBy("id").agg(F.collect_set("pos").alias("bad"))
    got = keyed.select("row", "id").join(bad, "id", "left").withColumn("lines", F.split(F.col(f"row.{text}"), "\n", -1))
    all_bad = F.size("bad") == F.size(F.filter("lines", lambda x: F.trim(x) != ""))
    got = got.withColumn("bad", F.when(~all_bad, F.col("bad")))
    none = F.array().cast("array<int>")
    kept = F.filter("lines", lambda x, i: ~F.array_contains(F.coalesce("bad", none), i))
    clean = F.when(F.col("bad").isNull(), F.col(f"row.{text}")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long")
    n_dropped = F.when(F.col("bad").isNull(), 0).otherwise(F.size("bad")).cast("long")
    other = [c for c in pages.columns if c not in ("n_lines", "n_dropped")]
    return got.select(*[clean.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in other], n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


def op7(spark, sf_dir: str) -> DataFrame:
    found = drop_boilerplate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


OP7_SQL = r"""
WITH l AS (SELECT doc_id, source, text, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
t AS (SELECT source, count(DISTINCT text) AS pages FROM documents GROUP BY source),
c AS (SELECT source, trim(line) AS line, count(DISTINCT text) AS n FROM l WHERE trim(line) <> '' GROUP BY 1, 2),
b AS (SELECT c.source, c.line FROM c JOIN t USING (source) WHERE n >= 2 AND n - 2 * sqrt(n) > 0.01 * pages),
h AS (SELECT l.*, b.line IS NOT NULL AS hit FROM l LEFT JOIN b ON l.source = b.source AND trim(l.line) = b.line),
m AS (SELECT *, hit AND NOT bool_and(hit OR trim(line) = '') OVER (PARTITION BY doc_id) AS bad FROM h),
r AS (SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (bad) AS BIGINT) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT bad), '') AS text FROM m GROUP BY doc_id)
SELECT doc_id, n_lines, n_dropped, length(text) AS n_chars, sha256(text) AS text_sha256 FROM r
"""


def html_lines(pages: DataFrame) -> DataFrame:
    """page_id, host of the URL, and text: the HTML with each tag as the end of a line."""
    return pages.select("page_id", host_of(F.col("url")).alias("host"), F.regexp_replace("html", "<[^<>]*>", "\n").alias("text"))


def site_lines(spark, sf_dir: str) -> DataFrame:
    """Boilerplate by the hosts of URLs: each page's lines between tags, and how many of them its site repeats."""
    found = drop_boilerplate(html_lines(spark.read.parquet(f"{sf_dir}/pages.parquet")), page="page_id", host="host")
    return found.select("page_id", "host", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


SITE_SQL = r"""
WITH h AS (SELECT page_id, lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '')) AS host, string_split(regexp_replace(html, '<[^<>]*>', chr(10), 'g'), chr(10)) AS lines FROM pages),
l AS (SELECT page_id, host, lines, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line FROM h),
t AS (SELECT host, count(DISTINCT lines) AS pages FROM h GROUP BY host),
c AS (SELECT host, trim(line) AS line, count(DISTINCT lines) AS n FROM l WHERE trim(line) <> '' GROUP BY 1, 2),
b AS (SELECT c.host, c.line FROM c JOIN t ON c.host IS NOT DISTINCT FROM t.host WHERE n >= 2 AND n - 2 * sqrt(n) > 0.01 * pages),
g AS (SELECT l.*, b.line IS NOT NULL AS hit FROM l LEFT JOIN b ON l.host IS NOT DISTINCT FROM b.host AND trim(l.line) = b.line),
m AS (SELECT *, hit AND NOT bool_and(hit OR trim(line) = '') OVER (PARTITION BY page_id) AS bad FROM g)
SELECT page_id, host, count(*) AS n_lines, CAST(count(*) FILTER (bad) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT bad), '')) AS text_sha256 FROM m GROUP BY page_id, host
"""

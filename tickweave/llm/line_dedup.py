"""Boilerplate lines by their frequency on a site.

Pages are grouped by host. For every line the pages of the host that hold it
are counted and divided by the host's pages; lines above a ratio are navigation,
footers and the like, and go from every page of that host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import stage

#: Elements that begin and end a line of a page.
BLOCKS = (
    "address|article|aside|blockquote|body|br|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|"
    "main|nav|ol|option|p|pre|section|table|tbody|td|th|thead|title|tr|ul"
)
#: Without its end, such an element reaches to the end of the page, as in browsers; so no opener is searched from twice.
UNSEEN = r"(?is)<script\b.*?(?:</script>|\z)|<style\b.*?(?:</style>|\z)|<!--.*?(?:-->|\z)"
BREAK = rf"(?i)</?(?:{BLOCKS})(?:\s[^>]*)?/?>"
TAG = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)"


def replace_tags(text: Column, pattern: str, by: str) -> Column:
    """Replaces a pattern that ends in >. Only what stands before the last > is searched, so every < meets its end and the time is linear.

    The text is bound to a name: written out at each of its uses, it would be computed at each of them.
    """

    def replaced(x: Column) -> Column:
        rest = F.length(F.substring_index(x, ">", -1))
        return F.concat(F.regexp_replace(F.left(x, F.length(x) - rest), pattern, by), F.right(x, rest))

    return F.transform(F.array(text), replaced)[0]


def html_lines(html: Column) -> Column:
    """Trimmed text lines of a page in order, without empty ones; null gives none."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), UNSEEN, "")
    text = replace_tags(replace_tags(text, BREAK, "\n"), TAG, "")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def host_of(url: Column) -> Column:
    """Lower-case host of an address, '' where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def boilerplate(df: DataFrame, host: str, lines: str, max_ratio: float, min_pages: int) -> DataFrame:
    """``host, drop``: hashes of the lines that go from the host's pages.

    Counts are summed before the shuffle, so a host with a third of all pages
    sends one row for each of its lines and task. A host's list is short: each
    entry stands on more than ``max_ratio`` of its pages, so there are at most
    1 / ``max_ratio`` times the lines of a mean page.
    """
    site = F.coalesce(F.col(host), F.lit("")).alias("host")
    seen = df.select(site, F.explode(F.array_distinct(F.transform(F.col(lines), lambda x: F.xxhash64(F.trim(x))))).alias("line"))
    counts = seen.groupBy("host", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    totals = stage(df.groupBy(site).agg(F.count("*").alias("of")), "host-pages")
    over = counts.join(totals, "host").where(F.col("pages") > F.col("of") * max_ratio)
    return stage(over.groupBy("host").agg(F.array_sort(F.collect_list("line")).alias("drop")), "boilerplate")


def drop_lines(df: DataFrame, host: str, lines: str, max_ratio: float = 0.1, min_pages: int = 3) -> DataFrame:
    """``df`` with the array ``lines`` reduced to what is no boilerplate, and ``n_dropped`` (long).

    A line goes if more than ``max_ratio`` of its host's pages, and at least
    ``min_pages`` of them, hold it (lines compare without surrounding spaces,
    by a 64-bit hash within one host). Blank lines stay. A page repeated in the
    table counts each time; null and empty hosts are one host; null
    ``lines`` stay null with 0 dropped. A column named ``n_dropped`` is
    replaced; other columns pass through.
    """
    listed = boilerplate(df, host, lines, max_ratio, min_pages)
    joined = df.drop("n_dropped").alias("p").join(listed.alias("b"), F.coalesce(F.col(f"p.{host}"), F.lit("")) == F.col("b.host"), "left")
    own = F.col(f"p.{lines}")
    hit = F.array_intersect(F.transform(own, lambda x: F.xxhash64(F.trim(x))), F.col("b.drop"))
    kept = F.when(F.size(hit) > 0, F.filter(own, lambda x: (F.trim(x) == "") | ~F.array_contains(hit, F.xxhash64(F.trim(x))))).otherwise(own)
    rest = [F.col(f"p.{c}") for c in df.columns if c not in (lines, "n_dropped")]
    cut = joined.select(*rest, own.alias("__had"), kept.alias(lines))
    return cut.withColumn("n_dropped", F.coalesce(F.size("__had") - F.size(lines), F.lit(0)).cast("long")).drop("__had")


def dedup_pages(pages: DataFrame, max_ratio: float = 0.1, min_pages: int = 3) -> DataFrame:
    """``page_id, host, n_lines, n_dropped, text`` of raw web pages (``page_id, url, html``)."""
    lines = stage(pages.select("page_id", host_of(F.col("url")).alias("host"), html_lines(F.col("html")).alias("lines")), "page-lines")
    out = drop_lines(lines, "host", "lines", max_ratio, min_pages)
    return out.select("page_id", "host", (F.size("lines") + F.col("n_dropped")).cast("long").alias("n_lines"), "n_dropped", F.array_join("lines", "\n").alias("text"))


def dedup_documents(docs: DataFrame, max_ratio: float = 0.1, min_pages: int = 3) -> DataFrame:
    """Plain documents, ``source`` as their site: same columns, ``text`` and ``n_chars`` without boilerplate lines.

    The rule is that of pages: more than ``max_ratio`` of the source's documents,
    at least ``min_pages``, whatever the source's size.
    Every document stays, with an empty text if all its lines were boilerplate;
    a null text stays null.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    out = drop_lines(docs.select("source", F.split("text", "\n").alias("lines"), own), "source", "lines", max_ratio, min_pages)
    cut = F.col("n_dropped") > 0
    text = F.array_join("lines", "\n")
    new = {"text": F.when(cut, text), "n_chars": F.when(cut, F.length(text).cast("long"))}
    return out.select(*[F.coalesce(new[c], F.col("row").getField(c)).alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """Every web page without its site's boilerplate lines."""
    return dedup_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def sql() -> str:
    return rf"""
        WITH cut AS (
            SELECT page_id, coalesce(lower(regexp_extract(url, '{HOST}', 1)), '') AS host,
                   list_filter(list_transform(string_split(
                       regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{UNSEEN}', '', 'g'),
                                                     '{BREAK}', chr(10), 'g'), '{TAG}', '', 'g'), chr(10)),
                       lambda x: trim(x)), lambda x: x <> '') AS lines
            FROM pages),
        totals AS (SELECT host, count(*) AS of FROM cut GROUP BY host),
        seen AS (SELECT host, unnest(list_distinct(lines)) AS line FROM cut),
        dropped AS (
            SELECT seen.host, seen.line FROM seen JOIN totals ON seen.host = totals.host
            GROUP BY seen.host, seen.line, totals.of
            HAVING count(*) >= 3 AND count(*) > totals.of * 0.1),
        listed AS (SELECT host, list(line) AS lines FROM dropped GROUP BY host),
        kept AS (
            SELECT page_id, cut.host AS host, cut.lines AS had,
                   list_filter(cut.lines, lambda x: NOT list_contains(coalesce(listed.lines, []), x)) AS lines
            FROM cut LEFT JOIN listed ON cut.host = listed.host)
        SELECT page_id, host, CAST(len(had) AS BIGINT) AS n_lines, CAST(len(had) - len(lines) AS BIGINT) AS n_dropped,
               coalesce(array_to_string(lines, chr(10)), '') AS text
        FROM kept
    """

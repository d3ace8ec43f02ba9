"""Site-relative line dedup, in DataFrame functions only.

Pages are grouped by host; a line's boilerplate ratio is the number of the host's pages that contain
it over the host's page total. Copies of a page are one page for both numbers: a text does not become boilerplate by standing
on its host twice, so an exact copy keeps its lines until a later step decides which copy stays. Lines above the limit are
dropped wherever they stand on that host, on hosts of every size; a line on one page alone repeats nothing and stays. On hosts of
fewer pages than one over the limit any line that two different pages share is above it and goes. A host can have no more such lines than
lines per page over the limit, so they fit into one array of hashes per host. That table is written, and joins back to the pages: by a broadcast where Spark finds it small, else
by a join whose hot hosts adaptive execution splits.

The host is a column (``source`` for the documents) or any other expression, such as :func:`url_host` of a URL.

Defined results: lines are split at line feeds and compared by 64-bit hashes within a host (of
a billion different lines two may be taken for one); lines of white space only always
stay; a null text stays null and is a page without lines; a null host is a host of its own; a page
whose lines are all dropped keeps its row with an empty text; texts of any length are read whole; repeated rows
are one page, as copies are (null texts of a host too); a ratio equal to the limit stays; an empty table gives an empty result; other columns, of any
name, pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Largest share of a host's pages that may contain a line.
MAX_RATIO = 0.02


def url_host(url: Column) -> Column:
    """The host of a URL, lower-cased, without user and port; null where there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.when(host != "", host)


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def boilerplate(pages: DataFrame, host: str | Column = "source", text: str = "text", max_ratio: float = MAX_RATIO) -> DataFrame:
    """(host, drop): for each host that has any, the hashes of its boilerplate lines."""
    kept = F.filter(_lines(text), lambda x: F.trim(F.translate(x, "\t\r\x0b\x0c", "    ")) != "")
    lines = F.array_distinct(F.transform(kept, lambda x: F.xxhash64(x))).alias("lines")
    seen = pages.select(_host(host), F.xxhash64(text).alias("page"), F.length(text).alias("size"), lines)
    seen = seen.groupBy("host", "page", "size").agg(F.any_value("lines").alias("lines"))
    totals = seen.groupBy("host").agg(F.count("*").alias("pages"))
    counts = seen.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where("n > 1")
    over = counts.join(totals, "host").where(F.col("n") > max_ratio * F.col("pages"))
    return over.groupBy("host").agg(F.collect_list("line").alias("drop"))


def _host(host: str | Column) -> Column:
    """In a struct, so that null is a host like others."""
    return F.struct((F.col(f"`{host}`") if isinstance(host, str) else host).alias("h")).alias("host")


def drop_boilerplate(pages: DataFrame, ws: Workspace, host: str | Column = "source", text: str = "text", max_ratio: float = MAX_RATIO, dropped: str | None = None) -> DataFrame:
    """``pages`` with the boilerplate lines gone from ``text``; with ``dropped``, a last column of that name says
    how many went. Rows travel as one struct, so their columns may have any names."""
    # Written first: its true size then decides between a broadcast and a shuffle of the texts.
    drop = ws.keep(boilerplate(pages, host, text, max_ratio), "boilerplate")
    page = F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page")
    joined = pages.select(page, _host(host), F.col(f"`{text}`").alias("text")).join(drop, "host", "left")
    # An intersection is hashed: a page costs its lines and its host's list once, not each line the whole list.
    joined = joined.withColumn("present", F.array_intersect(F.transform(_lines("text"), lambda x: F.xxhash64(x)), F.col("drop")))
    # Those present on a page are dealt into about as many buckets as they fill, so long pages stay far from quadratic.
    n = (F.floor(F.sqrt(F.size("present"))) + 1).cast("int")
    buckets = F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.filter("present", lambda h: F.pmod(h, n) == b))
    joined = joined.withColumn("buckets", F.when(F.size("present") > 0, buckets))
    hits = lambda h: F.array_contains(F.get("buckets", F.pmod(h, F.size("buckets")).cast("int")), h)
    kept = F.when(F.col("buckets").isNotNull(), F.filter(_lines("text"), lambda x: ~hits(F.xxhash64(x))))
    joined = joined.select("page", "text", kept.alias("kept"))
    gone = F.when(F.col("kept").isNotNull(), F.size(_lines("text")) - F.size("kept")).otherwise(0).cast("long")
    cleaned = F.when(F.col("kept").isNotNull(), F.array_join("kept", "\n")).otherwise(F.col("text"))
    out = joined.select("page", cleaned.alias("cleaned"), gone.alias("gone"))
    fields = [F.col("cleaned").alias(c) if c == text else F.col(f"page.`{c}`") for c in pages.columns]
    return out.select(*fields, *([F.col("gone").alias(dropped)] if dropped else []))


def clean_documents(docs: DataFrame, ws: Workspace) -> DataFrame:
    """Documents with their source as host: the same columns, texts cleaned, n_chars as they are now."""
    out = drop_boilerplate(docs, ws)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return out


def line_report(docs: DataFrame, ws: Workspace) -> DataFrame:
    """One row per document: lines before, lines dropped, and the digest of what is left."""
    n_lines = F.coalesce(F.size(_lines("text")), F.lit(0)).cast("long")
    n_lines = F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(n_lines)
    out = drop_boilerplate(docs.select("doc_id", "source", "text", n_lines.alias("n_lines")), ws, dropped="n_dropped")
    digest = F.sha2(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256)
    return out.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


ORACLE = f"""
WITH d AS (SELECT doc_id, source, text, row_number() OVER () AS r FROM documents),
p AS (SELECT r, min(r) OVER (PARTITION BY source, text) AS page FROM d),
l AS (SELECT r, page, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d JOIN p USING (r) WHERE text IS NOT NULL),
pages AS (SELECT source, count(DISTINCT page) AS pages FROM d JOIN p USING (r) GROUP BY source),
over AS (
  SELECT l.source, l.line FROM l JOIN pages p ON l.source IS NOT DISTINCT FROM p.source
  WHERE trim(translate(l.line, chr(9) || chr(13) || chr(11) || chr(12), '    ')) <> ''
  GROUP BY l.source, l.line, p.pages
  HAVING count(DISTINCT l.page) > 1 AND count(DISTINCT l.page) > {MAX_RATIO} * p.pages),
marked AS (SELECT l.*, o.line IS NOT NULL AS gone FROM l LEFT JOIN over o ON l.source IS NOT DISTINCT FROM o.source AND l.line = o.line),
kept AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '') AS text
  FROM marked GROUP BY r)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (r)
"""

"""Line dedup by site-relative frequency; built-in functions only.

The pages of a host that hold a line are divided by the host's page total. A line is
boilerplate of the host if more than RATIO percent of its pages hold it, and at least
``least_pages`` of them, without which every line of a small site would be. Pages of equal text
count once, so a page's exact copies don't make its lines boilerplate. Such lines are
dropped from all of the host's pages, also from those that they make up wholly, and all
other lines stay in order.

``digest`` takes web pages: their host, and as lines the text between block tags and line
feeds, without scripts, styles, comments and inline tags. ``drop_boilerplate`` takes any
table with a column that stands for the site, and splits at line feeds; ``digest_documents``
does so for documents and their source. ``digests`` has the rows of both tables, which share
no site. Lines are compared whole; lines of white space only are no boilerplate and stay.

Distinct (site, line, page text) rows are made in the map tasks and dealt by all three, so
neither a hot site nor a hot line goes to one task, and then summed. A site has at most
(lines of its mean page * 100 / ratio) boilerplate lines, so its list of their hashes is
short, and pages meet it in one join by site; Spark broadcasts the lists if they are small
and splits a hot site if they are not.

Lines and texts are told apart by 64-bit hashes. A null site (or url) is a site of its
own; a null text stays null and counts as an empty page, without lines. Very long texts
are split whole. Repeated rows keep their number. Nothing is ordered, so there are no
ties; a share of exactly RATIO percent is no boilerplate. An empty table gives an empty
result. Other columns are carried untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import written
from millrace.llm.url_filter import LOWER, UPPER, host_of

#: The boilerplate ratio in percent, and the least pages of a site that hold such a line. Hosts
#: of web pages may be small, and what is on three of their pages is mostly menus and footers;
#: so may the sources of documents that are digested.
RATIO, LEAST_PAGES, LEAST_OF_HOST = 1, 5, 3
NOT_BLANK = r"[^\x20\x09-\x0D]"
#: What of a page is no text, and what ends a line of it.
UNSEEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
BREAK = r"\n|(?i)</?(?:address|article|aside|blockquote|body|br|button|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul)(?:[\s/][^>]*)?>"
INLINE = r"<[^>]*>"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def lines_of_html(html: Column) -> Column:
    """The lines of a page that a reader sees, with blanks at their ends cut off."""
    parts = F.split(F.regexp_replace(F.coalesce(html, F.lit("")), UNSEEN, ""), BREAK)
    plain = F.transform(parts, lambda x: F.regexp_replace(F.regexp_replace(x, INLINE, ""), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))
    return F.filter(plain, lambda x: x != "")


def site_key(site: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), site.cast("string")), F.lit("n"))


def boilerplate(rows: DataFrame, ratio: int = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(site, hashes) of rows (site, text, lines): the boilerplate lines of each site that has any."""
    page = F.xxhash64(F.coalesce("text", F.lit(""))).alias("page")
    totals = rows.select("site", page).distinct().groupBy("site").agg(F.count("*").alias("pages"))
    hashes = F.transform(F.filter("lines", lambda x: F.regexp_like(x, F.lit(NOT_BLANK))), lambda x: F.xxhash64(x))
    held = rows.select("site", page, F.explode(hashes).alias("line")).distinct().groupBy("site", "line").agg(F.count("*").alias("held"))
    often = held.where(F.col("held") >= least_pages).join(totals, "site").where(F.col("held") * 100 > F.col("pages") * ratio)
    return often.groupBy("site").agg(F.collect_list("line").alias("hashes"))


def split_pages(pages: DataFrame, site: Column, text: Column, lines: Column, ratio: int = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(page, lines, kept): each page's columns in a struct, all its lines, and what stays;
    ``site``, ``text`` and ``lines`` are columns of ``pages``."""
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("page"), site_key(site).alias("site"), text.alias("text"), lines.alias("lines"))
    flagged = written(boilerplate(rows, ratio, least_pages), "boilerplate")
    joined = rows.join(flagged, "site", "left")
    joined = joined.withColumn("hits", F.array_intersect(F.transform("lines", lambda x: F.xxhash64(x)), "hashes"))
    kept = F.filter("lines", lambda x: ~F.array_contains("hits", F.xxhash64(x)) | ~F.regexp_like(x, F.lit(NOT_BLANK)))
    return joined.select("page", "lines", F.when(F.size("hits") > 0, kept).otherwise(F.col("lines")).alias("kept"))


def drop_boilerplate(pages: DataFrame, site: str = "source", text: str = "text", ratio: int = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """All pages with all their columns, the text without the site's boilerplate lines; a
    column n_chars, if there is one, follows the text."""
    rows = split_pages(pages, F.col(f"`{site}`"), F.col(f"`{text}`"), lines_of(F.col(f"`{text}`")), ratio, least_pages)
    new = F.when(F.col("page")[text].isNotNull(), F.array_join("kept", "\n"))
    out = rows.select("page", new.alias("new"))
    made = {text: F.col("new"), "n_chars": F.when(F.col("new").isNull(), F.col("page")["n_chars"]).otherwise(F.length("new").cast("bigint"))} if "n_chars" in pages.columns else {text: F.col("new")}
    return out.select(*(made.get(c, F.col("page")[c]).alias(c) for c in pages.columns))


def what_stays() -> tuple[Column, ...]:
    """Lines before and after, and the SHA-256 of the lines that stay."""
    return F.size("lines").cast("bigint").alias("n_lines"), F.size("kept").cast("bigint").alias("n_kept"), F.sha2(F.array_join("kept", "\n"), 256).alias("text_sha256")


def digest(pages: DataFrame, least_pages: int = LEAST_OF_HOST) -> DataFrame:
    """page_id, host, lines before and after, and the SHA-256 of the lines that stay."""
    # written, so that the pages are taken apart once
    same = F.xxhash64(F.coalesce("html", F.lit(""))).cast("string").alias("html")
    held = written(pages.select("page_id", host_of(F.col("url")).alias("host"), same, lines_of_html(F.col("html")).alias("lines")), "lines")
    rows = split_pages(held, F.col("host"), F.col("html"), F.col("lines"), least_pages=least_pages)
    return rows.select("page.page_id", "page.host", *what_stays())


def digest_documents(documents: DataFrame, least_pages: int = LEAST_OF_HOST) -> DataFrame:
    """doc_id, source, lines before and after, and the SHA-256 of the lines that stay."""
    held = documents.select("doc_id", "source", "text")
    rows = split_pages(held, F.col("source"), F.col("text"), lines_of(F.col("text")), least_pages=least_pages)
    return rows.select("page.doc_id", "page.source", *what_stays())


def digests(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """The rows of ``digest`` and ``digest_documents``: page_id and host are null for documents,
    doc_id and source for pages. A page's host is never null."""
    return digest(pages).unionByName(digest_documents(documents), allowMissingColumns=True)


def sql(table: str, identity: str, site: str, text: str, lines: str, least_pages: int = LEAST_PAGES) -> str:
    """The same in DuckDB: identity columns, site, n_lines, n_kept and text_sha256."""
    return rf"""
with d as materialized (select row_number() over () as k, {identity}, {site} as site, coalesce({text}, '') as t from {table}),
ls as materialized (select k, site, t, {lines} as lines from d),
totals as (select site, count(distinct t) as pages from d group by site),
l as materialized (select k, site, t, unnest(lines) as line, generate_subscripts(lines, 1) as pos from ls),
held as (select site, line, count(distinct t) as held from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by site, line),
flagged as (select h.site, line from held h join totals o on h.site is not distinct from o.site
  where held >= {least_pages} and held * 100 > pages * {RATIO}),
marked as (select l.k, l.line, l.pos, f.line is null as stays from l left join flagged f on l.line = f.line and l.site is not distinct from f.site),
texts as (select k, count(*) as n, count(*) filter (stays) as n_kept, string_agg(line, chr(10) order by pos) filter (stays) as t from marked group by k)
select {identity}, site, coalesce(n, 0)::bigint as n_lines, coalesce(n_kept, 0)::bigint as n_kept, sha256(coalesce(texts.t, '')) as text_sha256 from d left join texts using (k)"""


def _pages_sql() -> str:
    host = f"translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
    ends = r"'^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$'"
    lines = f"list_filter(list_transform(regexp_split_to_array(regexp_replace(t, '{UNSEEN}', '', 'g'), '{BREAK}'), lambda x: regexp_replace(regexp_replace(x, '{INLINE}', '', 'g'), {ends}, '', 'g')), lambda x: x <> '')"
    return sql("pages", "page_id", host, "html", lines, LEAST_OF_HOST).replace("page_id, site, coalesce(n,", "page_id, site as host, coalesce(n,")


ORACLE_SQL = _pages_sql()
#: For a table of documents with the columns doc_id, text and source, as ``drop_boilerplate`` takes it.
DOCUMENTS_SQL = sql("documents", "doc_id", "source", "text", "string_split(t, chr(10))")
#: For both tables, as ``digests`` takes them.
DIGESTS_SQL = f"""
select page_id, host, n_lines, n_kept, text_sha256, null::bigint as doc_id, null::varchar as source from ({ORACLE_SQL})
union all
select null, null, n_lines, n_kept, text_sha256, doc_id, site from ({sql("documents", "doc_id", "source", "text", "string_split(t, chr(10))", LEAST_OF_HOST)})"""

"""Line deduplication by site-relative frequency.

Within each host, a line's ratio is the share of the host's pages that contain it; lines
above the ratio are boilerplate and are dropped from the host's pages. A line of one page
alone repeats nothing, so it stays, however few pages its host has.

Pages are counted per host and line digest with partial aggregation, so neither a hot host
nor a hot line meets in one task. Of a host's lines at most (distinct lines of a page on
average) / ratio can exceed the ratio, so its boilerplate is a list of proven size, and
pages are cleaned where they lie, by looking their lines up in that list.

Defined cases: a null or unparsable url has host ''; a null or empty page has no lines;
repeated rows count as pages of their own, so a line of two equal rows is on two pages. Very
long pages are read whole, in time linear in their size. An empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Scratch

#: Elements that start a new line.
BLOCK_TAGS = "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split()
# Each pattern also eats an element, comment or tag that never closes, to the end of the page,
# so no match starts over the same text twice.
HIDDEN = r"(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)"
BLOCK = r"(?i)</?(?:" + "|".join(BLOCK_TAGS) + r")\b[^>]*(?:>|\z)"
TAG = r"<[^>]*(?:>|\z)"
#: Fixed value: white space that lines are trimmed of, [\x20\x09-\x0D].
TRIMMED = " \t\n\x0b\x0c\r"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def page_lines(html: Column) -> Column:
    """Non-blank trimmed lines of a page's visible text, in order; entities stay as they are."""
    shown = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "")
    text = F.regexp_replace(F.regexp_replace(shown, BLOCK, "\n"), TAG, "")
    return _split(text)


def text_lines(text: Column) -> Column:
    """Non-blank trimmed lines of plain text, in order."""
    return _split(F.coalesce(text, F.lit("")))


def _split(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[\r\n]+"), lambda x: F.btrim(x, F.lit(TRIMMED))), lambda x: x != "")


def _digest(line: Column) -> Column:
    """A text: arrays of texts are intersected by hashing."""
    return F.md5(line.cast("binary"))


def drop_boilerplate(rows: DataFrame, ratio: float = 0.05, small: int = 10_000) -> DataFrame:
    """Rows of (page_id, host, lines) with n_lines, n_dropped and the kept lines.

    The broadcast of the hosts' lists depends on a count of hosts and lines; larger tables
    are joined by host.
    """
    scratch = Scratch(rows.sparkSession, "lines")
    own = F.array_distinct(F.transform("lines", _digest))
    totals = rows.groupBy("host").agg(F.count("*").alias("pages"))
    counts = rows.select("host", F.explode(own).alias("digest")).groupBy("host", "digest").agg(F.count("*").alias("n")).filter("n > 1")
    common = counts.join(totals, "host").filter(F.col("n") / F.col("pages") > ratio)
    lists = scratch.save(common.groupBy("host").agg(F.collect_list("digest").alias("common")), "common")
    entries = lists.agg(F.sum(F.size("common"))).first()[0] or 0
    lists = F.broadcast(lists) if entries <= small else lists
    # The intersection is hashed, so a line is then looked up among the page's own boilerplate only.
    gone = F.coalesce(F.array_intersect(own, F.col("common")), F.array().cast("array<string>"))
    # Bound to a lambda's variable, it is computed once a page and not once a line.
    kept = F.transform(F.array(gone), lambda g: F.filter("lines", lambda x: ~F.array_contains(g, _digest(x))))[0]
    found = rows.join(lists, "host", "left").withColumn("kept_lines", kept)
    return found.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept_lines")).cast("long").alias("n_dropped"), "kept_lines")


def clean_pages(pages: DataFrame, ratio: float = 0.05, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, n_lines, n_dropped and kept_lines of every page."""
    scratch = Scratch(pages.sparkSession, "lines")
    rows = pages.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), page_lines(F.col(html_col)).alias("lines"))
    return drop_boilerplate(scratch.save(rows, "rows"), ratio)

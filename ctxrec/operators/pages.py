"""Page html -> readable text, and the resource flags derived from it.

Block-based extraction after the shallow-text-features rule: the html is cut
into text blocks at block-level tags; each block gets its word count and link
density (words inside ``<a>`` / words); a block is content or boilerplate
from its own and its neighbours' values. The whole computation is a per-row
map over array higher-order functions (no explode, no shuffle, no regroup),
so it scales with the number of pages and keeps whole-page texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxrec.functions.urls import url_blacklisted
from ctxrec.operators.store import upsert_resources

# Markup patterns and the block classification thresholds.
DROP_REGEX = r"(?is)<(script|style|head)(\s[^>]*)?>.*?</(script|style|head)>|<!--.*?-->"
BLOCK_REGEX = (r"(?i)<\s*/?\s*(p|div|li|ul|ol|h1|h2|h3|h4|h5|h6|article|nav|section|header"
               r"|footer|table|tr|td|br)\b[^>]*>")
LINK_REGEX = r"(?is)<a\b[^>]*>(.*?)</a>"
TAG_REGEX = r"(?s)<[^>]*>"
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
MAX_LINK_DENSITY = 1.0 / 3.0
PREV_LINK_DENSITY = 0.555556
WORDS_LOW, NEXT_WORDS_LOW, PREV_WORDS_LOW = 16, 15, 4
WORDS_HIGH, NEXT_WORDS_HIGH = 40, 17
MIN_TEXTUAL_CHARS = 200

# Patterns of the page fixture's spam sites.
PAGE_BLACKLIST = ["spam-farm", "cheap-pills"]


def clean_text(c: Column) -> Column:
    """Markup-free text: tags -> space, entities decoded, whitespace collapsed."""
    t = F.regexp_replace(c, TAG_REGEX, " ")
    for ent, ch in ENTITIES:
        t = F.replace(t, F.lit(ent), F.lit(ch))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def word_count(t: Column) -> Column:
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, " ")))


def _block(raw: Column) -> Column:
    text = clean_text(raw)
    linked = clean_text(F.array_join(F.regexp_extract_all(raw, F.lit(LINK_REGEX), F.lit(1)), " "))
    return F.struct(text.alias("text"), word_count(text).alias("w"), word_count(linked).alias("lw"))


def _is_content(b: Column, prev: Column, nxt: Column) -> Column:
    ld = b["lw"] / b["w"]
    p_w = F.coalesce(prev["w"], F.lit(0))
    p_ld = F.coalesce(prev["lw"] / prev["w"], F.lit(0.0))
    n_w = F.coalesce(nxt["w"], F.lit(0))
    low = (b["w"] > WORDS_LOW) | (n_w > NEXT_WORDS_LOW) | (p_w > PREV_WORDS_LOW)
    high = (b["w"] > WORDS_HIGH) | (n_w > NEXT_WORDS_HIGH)
    return F.when(ld > MAX_LINK_DENSITY, F.lit(False)) \
        .when(p_ld <= PREV_LINK_DENSITY, low).otherwise(high)


def page_blocks(html: Column) -> Column:
    """Non-empty text blocks of a page: struct(text, w words, lw linked words)."""
    raw = F.split(F.regexp_replace(F.coalesce(html, F.lit("")), DROP_REGEX, ""), BLOCK_REGEX, -1)
    return F.filter(F.transform(raw, _block), lambda b: b["w"] > 0)


def content_text(blocks: Column) -> Column:
    """Content blocks joined by newlines ('' if none). ``blocks`` should be a
    column reference (see :func:`with_page_text`): each element looks up its
    neighbours in it."""
    keep = F.transform(blocks, lambda b, i: F.struct(
        b["text"].alias("text"),
        _is_content(b, F.try_element_at(blocks, i), F.try_element_at(blocks, i + 2)).alias("keep")))
    return F.array_join(F.transform(F.filter(keep, lambda x: x["keep"]), lambda x: x["text"]), "\n")


def with_page_text(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Adds the extracted text of ``html``. The blocks are a column of their
    own (materialised once per row) before the neighbour lookups read them."""
    return (df.withColumn("__blocks", page_blocks(F.col(html)))
            .withColumn(out, content_text(F.col("__blocks")))
            .drop("__blocks"))


def extract_page_text(pages: DataFrame) -> DataFrame:
    return with_page_text(pages.select("page_id", "url", "html")).drop("html")


def classify_resources(resources: DataFrame, text_col: str = "text") -> DataFrame:
    """Empty text -> blacklisted; else the text becomes the content and
    ``textual`` = at least 200 characters; every resource is processed."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    empty = t == ""
    return (resources
            .withColumn("textual", F.col("textual") | (F.length(t) >= MIN_TEXTUAL_CHARS))
            .withColumn("blacklisted", F.col("blacklisted") | empty)
            .withColumn("content", F.when(empty, F.col("content")).otherwise(t))
            .withColumn("processed", F.lit(True))
            .drop(text_col))


def prepare_resources(resources: DataFrame, pages: DataFrame,
                      patterns: Sequence[str] | None = None) -> DataFrame:
    """Process the pending resources: a blacklisted url or a missing page
    yields '' (and so a blacklisted resource); the others get the extracted
    text of their page. Already processed resources are left as they are."""
    done = resources.where(F.col("processed"))
    pending = resources.where(~F.col("processed"))
    allowed = ~url_blacklisted(F.col("url"), patterns)
    html = pages.groupBy("url").agg(F.min_by("html", "page_id").alias("html"))
    fetched = pending.join(html, on="url", how="left").withColumn(
        "html", F.when(allowed, F.col("html")))
    fetched = with_page_text(fetched, "html", "__text").drop("html")
    return done.unionByName(classify_resources(fetched, "__text"))


def resources_from_pages(pages: DataFrame) -> DataFrame:
    """Pending resources for every page url (get-or-create with defaults)."""
    return upsert_resources(None, pages.select("url"))

"""String, JSON and HTML expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalise_component(c: Column) -> Column:
    """Lower-case identifier: other characters become one underscore, trimmed."""
    lowered = F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_")
    return F.regexp_replace(lowered, "^_+|_+$", "")


def fingerprint(cols: Sequence[Column]) -> Column:
    """SHA-256 of the fields in order.

    The separator and the escape inside a field are escaped and NULL has a mark
    of its own, so different rows never write the same text.
    """
    texts = [F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")) for c in cols]
    return F.sha2(F.concat_ws("|", *[F.coalesce(t, F.lit("\\N")) for t in texts]), 256)


def fixed6(c: Column) -> Column:
    """A double as text with six decimals."""
    return F.format_string("%.6f", c)


def paragraphs(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per non-blank ``<p>`` block: tags stripped, entities unescaped.

    Works on the whole page text; ``para_no`` is the block's place on the page.
    """
    # Named entities.
    entities = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
    body = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1))
    out = pages.select(*[c for c in pages.columns if c != html], F.posexplode(body).alias("para_no", "raw"))
    text = F.regexp_replace("raw", "<[^>]+>", "")
    for name, char in entities:
        text = F.replace(text, F.lit(name), F.lit(char))
    return out.withColumn("paragraph", F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))).filter("paragraph <> ''").drop("raw")


def links(pages: DataFrame, pattern: str, html: str = "html") -> DataFrame:
    """One row per anchor whose target matches ``pattern``."""
    hrefs = F.regexp_extract_all(F.col(html), F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))
    out = pages.select(*[c for c in pages.columns if c != html], F.posexplode(hrefs).alias("link_no", "href"))
    return out.filter(F.col("href").rlike(pattern))

"""Text expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named and numbered character references that are decoded, the ampersand last.
ENTITIES = (
    ("(?i)&lt;|&lt(?![a-z;])", "<"),
    ("(?i)&gt;|&gt(?![a-z;])", ">"),
    ("(?i)&quot;?|&#0*34;?|&#x0*22;?", '"'),
    ("(?i)&apos;|&#0*39;?|&#x0*27;?", "'"),
    ("(?i)&nbsp;?|&#0*160;?|&#xa0;?", " "),
    ("(?i)&hellip;|&#8230;", "…"),
    ("(?i)&mdash;|&#8212;", "—"),
    ("(?i)&ndash;|&#8211;", "–"),
    ("(?i)&rsquo;|&#8217;", "’"),
    ("(?i)&lsquo;|&#8216;", "‘"),
    ("(?i)&rdquo;|&#8221;", "”"),
    ("(?i)&ldquo;|&#8220;", "“"),
    ("(?i)&euro;|&#8364;", "€"),
    ("(?i)&amp;|&amp(?![a-z;])|&#0*38;?|&#x26;?", "&"),
)

LINK = r"(?i)https?://\S+"
MENTION = r"(?U)@\w+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decode_entities(text: Column | str) -> Column:
    """Character references decoded once; ``&amp;lt;`` becomes ``&lt;``."""
    c = _col(text)
    out = c
    for pattern, to in ENTITIES:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(to))
    return F.when(c.contains("&"), out).otherwise(c)


def squeeze(text: Column | str) -> Column:
    """Runs of white space (also no-break blanks) as one blank, none at the ends."""
    return F.trim(F.regexp_replace(_col(text), r"(?U)\s+", " "))


def without_links(text: Column | str) -> Column:
    """Mentions and links taken out."""
    return F.regexp_replace(F.regexp_replace(_col(text), LINK, " "), MENTION, " ")


def has_content(text: Column | str) -> Column:
    """Whether a letter or digit remains without mentions and links; false for null."""
    return F.coalesce(without_links(decode_entities(text)).rlike(r"[\p{L}\p{N}]"), F.lit(False))


def words(text: Column | str) -> Column:
    """Longest runs of letters and digits after decoding entities, lower-casing and deleting
    apostrophes; an empty array for null."""
    low = F.regexp_replace(F.lower(decode_entities(F.coalesce(_col(text), F.lit("")))), "['’‘ʼ＇]", "")
    return F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), 0)


def normalise(text: Column | str) -> Column:
    """Entities decoded, white space squeezed; null becomes empty."""
    return squeeze(decode_entities(F.coalesce(_col(text), F.lit(""))))


def match_form(text: Column | str) -> Column:
    """The form rules are matched on: normalised, without mentions and links, lower case."""
    return squeeze(F.lower(without_links(decode_entities(F.coalesce(_col(text), F.lit(""))))))

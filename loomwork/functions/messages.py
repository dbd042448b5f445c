"""Expressions over message columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def direction(inbound: Column | str) -> Column:
    """``inbound`` / ``outbound`` / ``unknown`` from a true/false text in any case."""
    v = F.lower(F.trim(F.coalesce(_c(inbound), F.lit(""))))
    return F.when(v == "true", "inbound").when(v == "false", "outbound").otherwise("unknown")


def canonical_inbound(inbound: Column | str) -> Column:
    v = F.lower(F.trim(F.coalesce(_c(inbound), F.lit(""))))
    return F.when(v == "true", "True").when(v == "false", "False").otherwise("Unknown")


def present(x: Column | str) -> Column:
    """Neither null, nor blank, nor the text ``nan``."""
    t = F.trim(F.coalesce(_c(x), F.lit("")))
    return (t != "") & (t != "nan")


def ascii_ratio(text: Column | str) -> Column:
    """Share of ASCII characters; 1 for empty texts."""
    t = F.coalesce(_c(text), F.lit(""))
    n = F.length(t)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.length(F.regexp_replace(t, r"[^\x00-\x7F]", "")) / n)


def likely_english(text: Column | str, least: float = 0.85) -> Column:
    return ascii_ratio(text) >= least


def masked_fields(text: Column | str) -> Column:
    """Number of ``__name__`` fields."""
    return F.regexp_count(F.coalesce(_c(text), F.lit("")), F.lit("__[a-zA-Z]+__"))


def useful_words(text: Column | str) -> Column:
    """Number of words of letters (of any alphabet) only, links and mentions left out."""
    t = F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"https?://\S+", " ")
    t = F.regexp_replace(t, r"@\S+", " ")
    return F.size(F.filter(F.split(t, r"\s+"), lambda w: w.rlike(r"^\p{L}+$")))


def first_mention(text: Column | str) -> Column:
    """First word that begins with @, without closing punctuation; null if it is a number or missing."""
    words = F.split(F.trim(F.coalesce(_c(text), F.lit(""))), r"\s+")
    name = F.regexp_replace(F.substr(F.try_element_at(F.filter(words, lambda w: w.startswith("@")), F.lit(1)), F.lit(2)), r"[.,!?;:]+$", "")
    return F.when((name != "") & ~name.rlike("^[0-9]+$"), name)


def redact_plain(text: Column | str) -> Column:
    """Numbers of eight and more digits and words around @ masked."""
    return F.regexp_replace(F.regexp_replace(_c(text), r"(?U)\b\d{8,}\b", "[ID]"), r"(?U)\S+@\S+", "[email]")


def without_handles(text: Column | str) -> Column:
    """Words that begin with @ left out."""
    words = F.split(F.trim(F.coalesce(_c(text), F.lit(""))), r"\s+")
    return F.array_join(F.filter(words, lambda w: ~w.startswith("@")), " ")


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(part / F.greatest(whole, F.lit(1)) * 100, digits)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def bar(share: Column, width: int = 20) -> Column:
    """A bar of ``width`` signs, filled by a share of 0 to 1."""
    full = F.round(clamp(share) * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))


def numbered(prefix: str, n: Column, digits: int = 3) -> Column:
    """Ids such as ``BM_007``."""
    return F.format_string(f"{prefix}%0{digits}d", n)

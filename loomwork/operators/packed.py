"""Several values packed in one field: one row per value, position kept.

Method: a parsing expression grammar with ordered choice and backtracking.  The
first alternative that matches at a place wins; a quoted or bracketed value that
turns out malformed is given up and the place is read again by the next
alternative, with an error flag on the values that come out of it.

    field   <- space items end
    items   <- item? (delimiter+ item?)*
    item    <- quoted / list / bare
    list    <- '[' items ']' / '(' items ')' / '{' items '}'
    quoted  <- q (escaped / doubled / char)* q &(delimiter / close / end)
             / q (doubled / char)* q &(delimiter / close / end)       q: " ' or a pair
    bare    <- any run without delimiter (in a list: nor its closing sign)

Delimiters inside quotes are text, doubled and escaped quotes are quotes, and a quote inside
a word is an ordinary sign.  With ``packed_ids`` the values are ids, which hold no such
signs, so that quotes and brackets may be anywhere and quotes may hold several ids:

    quoted  <- q grouped q / q items q                 grouped <- 1-3 digits (',' 3 digits)+
    bare    <- any run without delimiter, quote or bracket

Fields that are one bare value need no grammar and are read by a column expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELIMITERS = ",;|\t\n\r"
ID_DELIMITERS = ",;|/\t\n\r "
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "«": "»"}
BRACKETS = {"[": "]", "(": ")", "{": "}"}
BRACKETS_OF = {close: open_ for open_, close in BRACKETS.items()}
NULL_WORDS = ("nan", "null", "none", "n/a", "na")

_GROUPED = re.compile(r"\d{1,3}(?:,\d{3})+(?!\d)")
_ESCAPED = re.compile(r"\\(.)", re.S)


class Grammar:
    """The grammar for one set of delimiters.  ``parse`` is iterative over a stack of
    open brackets, so neither length nor nesting of a field is limited."""

    def __init__(self, delimiters: str = DELIMITERS, packed_ids: bool = False):
        d = re.escape(delimiters)
        self.packed_ids = packed_ids
        self.split = re.compile(f"[{d}]+")
        self.skip = re.compile(f"[{d}\\s]+")
        ends = re.escape("".join(BRACKETS.values()))
        self.quoted = {}
        for q, c in QUOTES.items():
            x, after = re.escape(c), f"(?=\\s*(?:[{d}{ends}]|$))"
            self.quoted[q] = (re.compile(f"{q}((?:[^{x}\\\\]|{x}{x}|\\\\.)*+){x}{after}", re.S), re.compile(f"{q}((?:[^{x}]|{x}{x})*+){x}{after}", re.S))
        if packed_ids:
            signs = re.escape("".join(QUOTES) + "".join(QUOTES.values()) + "".join(BRACKETS)) + ends
            self.bare = {None: re.compile(f"[^{d}{signs}]+")}
        else:
            self.bare = {x: re.compile(f"[^{d}{re.escape(x or '')}]+") for x in (None, *BRACKETS.values())}

    def parse(self, field: str) -> list[tuple[str, str | None]]:
        """``(value, error)`` in order; error is None for well-formed values."""
        out: list[tuple[str, str | None]] = []
        open_: list[tuple[str, int]] = []
        unclosed: set[str] = set()
        at, n, error = 0, len(field), None
        while at < n:
            m = self.skip.match(field, at)
            if m:
                at = m.end()
                continue
            c = field[at]
            if c in QUOTES and (end := self._quoted(field, at, out, error, unclosed)):
                at = end
            elif c in QUOTES and (self.packed_ids or c in unclosed):  # backtrack: the quote is a sign to be skipped
                error, at = "open quote", at + 1
            elif c in BRACKETS:
                open_.append((BRACKETS[c], len(out)))
                at += 1
            elif open_ and c == open_[-1][0]:
                open_.pop()
                at += 1
            elif m := self._bare(field, at, open_):
                value = m.group().strip()
                wrong = "text after quote" if c in QUOTES else "stray " + value[-1] if value[-1] in "])}" and not self.packed_ids and BRACKETS_OF[value[-1]] not in value else None
                out.append((value, error or wrong))
                at = m.end()
            else:  # a closing sign that nothing opened
                error, at = error or "stray " + c, at + 1
        if open_:
            out = [(v, e or ("open bracket" if i >= open_[0][1] else None)) for i, (v, e) in enumerate(out)]
        return out

    def _bare(self, field: str, at: int, open_: list[tuple[str, int]]) -> re.Match | None:
        return self.bare[None if self.packed_ids or not open_ else open_[-1][0]].match(field, at)

    def _quoted(self, field: str, at: int, out: list, error: str | None, unclosed: set[str]) -> int:
        """Ordered choice for a quoted value; the place after it, or 0 if malformed."""
        q = field[at]
        if q in unclosed:
            return 0
        end = field.find(QUOTES[q], at + 1)
        if end < 0:
            unclosed.add(q)
            return 0
        if self.packed_ids:
            return self._quoted_ids(field, at, end, out, error)
        for pattern, escapes in zip(self.quoted[q], (True, False), strict=True):
            m = pattern.match(field, at)
            if m:
                inner = m.group(1).replace(QUOTES[q] * 2, QUOTES[q])
                out.append((_ESCAPED.sub(r"\1", inner) if escapes else inner, error))
                return m.end()
        return 0

    def _quoted_ids(self, field: str, at: int, end: int, out: list, error: str | None) -> int:
        after = field[end + 1 : end + 2]
        inner = field[at + 1 : end]
        if after and not self.skip.match(after) and after not in BRACKETS.values():
            return 0  # a quote inside a value
        if _GROUPED.fullmatch(inner.strip()):
            out.append((inner.strip().replace(",", ""), error))
        else:
            for part in self.split.split(inner):
                part = part.strip("".join(QUOTES) + "".join(QUOTES.values()))
                if part:
                    out.append((part, error))
        return end + 1


def split_packed(
    df: DataFrame, field: str, keep: list[str], delimiters: str | None = None, null_words: tuple[str, ...] = NULL_WORDS, packed_ids: bool = False
) -> DataFrame:
    """``keep`` columns, ``position`` (from 1), ``n_values``, ``value`` and ``error``, one row per value.

    * Null, blank and null-word fields give no row; empty places do not count.
    * An open quote sets ``error`` on the values read after it, an open bracket on those inside
      it, text after a closing quote on its own value, which keeps the quotes.
    * A quoted value may be empty or blank; it is kept as it is.
    * Repeated values stay, each with its position.  Only ``keep`` and ``field`` are read,
      so further columns may have any names.
    """
    delimiters = delimiters or (ID_DELIMITERS if packed_ids else DELIMITERS)
    marks = "".join(set(delimiters) | set(QUOTES) | set(QUOTES.values()) | set(BRACKETS) | set(BRACKETS.values()))
    special = "[" + "".join("\\" + c if c in '[]\\^-"' else c for c in marks) + "]"
    src = df.select(*keep, F.trim(F.regexp_replace(field, r"^\s+|\s+$", "")).alias("__f")).filter(
        F.col("__f").isNotNull() & (F.col("__f") != "") & ~F.lower("__f").isin(*null_words)
    )
    plain = src.filter(~F.col("__f").rlike(special)).select(
        *keep,
        F.lit(1).alias("position"),
        F.lit(1).alias("n_values"),
        F.col("__f").alias("value"),
        F.lit(None).cast("string").alias("error"),
    )
    hard = src.filter(F.col("__f").rlike(special))
    item = T.StructType([T.StructField("value", T.StringType()), T.StructField("error", T.StringType())])
    schema = T.StructType([*[f for f in src.schema if f.name != "__f"], T.StructField("__v", T.ArrayType(item))])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammar = Grammar(delimiters, packed_ids)
        for pdf in batches:
            pdf["__v"] = [[{"value": v, "error": e} for v, e in grammar.parse(f)] for f in pdf.pop("__f")]
            yield pdf

    parsed = hard.mapInPandas(read, schema)
    rows = parsed.select(*keep, F.size("__v").alias("n_values"), F.posexplode("__v").alias("__p", "__x")).select(
        *keep,
        (F.col("__p") + 1).alias("position"),
        "n_values",
        F.col("__x.value").alias("value"),
        F.col("__x.error").alias("error"),
    )
    return plain.unionByName(rows)

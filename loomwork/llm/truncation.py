"""Texts that were cut off on their way.

Method: a structural completeness check by a stack automaton, judged against each
source's baseline.

1. The automaton reads the structural signs of the whole text (quotes, brackets, markup
   tags, character references, escapes) and keeps the open ones on a stack.  At the end it
   knows what is still open and whether the text stops inside a tag, a reference, an escape
   or a multibyte character.
2. The tail, the words after the last end of a sentence or line, is classified: terminated,
   a cut mark (dots, ellipsis), or bare.
3. Baselines over all texts: tails that end many distinct texts are closing lines of that
   corpus (sign-offs, references, signatures) and are no cut; copies of a text count once,
   and a mere cut mark or a tail that ends inside a word is no closing line.  A structural sign that is open in many
   texts of a source, and a missing terminator in a source that seldom has one, are
   habits of the source and no evidence.
4. Habits are estimated from texts whose tail shows no cut, so that cuts do not lower their
   own baseline.  A tail shows a cut by a mark, a comma or the like at its end, or a last
   word that inside the texts is mostly the beginning of longer words.  A cut mark is
   evidence in every source.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators.skew import lookup_join
from loomwork.session import written

#: A tail that ends this share of all distinct texts (and at least three) is a closing line.
CLOSING_SHARE = 0.004
#: A structural sign left open in more than this share of a source's texts is its habit.
HABIT_SHARE = 0.05
#: A source whose plain texts end in a terminator less often than this has no such rule.
TERMINATOR_SHARE = 0.5
#: A last word is a fragment if the longer words it begins are more than this many times as frequent.
FRAGMENT_RATIO = 20

FIELDS = ["blank", "broken", "quote", "bracket", "markup", "kind", "tail", "last", "dangling", "inside", "digest"]
TERMINATORS = ".!?。！？．؟।"
_CLOSERS = "\"'”’»)]}』」*_"
_PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "「": "」", "『": "』"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "li"}
_SIGN = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)([^<>]*)>|[()\[\]{}“”«»「」『』\"]")
_BROKEN_TAG = re.compile(r"<(?:/?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?|/|!-{0,2}[^<>]*)$")
_BROKEN_NUMBER = re.compile(r"#(?:[0-9]{0,7}|[xX][0-9A-Fa-f]{0,6})")
#: What a character reference can begin with; names that begin with a capital are left out (``AT&T``).
_REF_STARTS = {n[:k] for n in name2codepoint if n[0].islower() for k in range(1, len(n) + 1)}
_BROKEN_ESCAPE = re.compile(r"\\(?:u[0-9A-Fa-f]{0,3}|x[0-9A-Fa-f]?)?$")
_MARK = re.compile(r"\s*(?:\[\s*(?:\.\.\.|…)\s*\]|\(\s*(?:\.\.\.|…)\s*\)|\.{2,}|…|\[(?:cut|more|truncated|snip)\]|>>)\s*$", re.I)
_CLOSING_TAGS = re.compile(r"(?:\s*</[A-Za-z][A-Za-z0-9]*>)+\s*$")
_BREAK = re.compile(rf"(?:[{TERMINATORS}…]+[{re.escape(_CLOSERS)}]*(?:\s+|$)|[。！？．]|\n)")
_SPEAKER = re.compile(r"^\s*[A-Z][\w ]{0,20}:\s+")
_LINK_END = re.compile(r"https?://[^\s/]+\.[^\s/]+/\S*$|www\.\S+\.\S+/\S*$", re.I)
_REFERENCE = re.compile(r"(?:^|\s)(?:ref|reference|case|ticket|order|invoice|no|nr|id|fall|dossier|caso|zaak|chamado)\w*[\s.:#]*(?:no|nr|number)?[\s.:#]*[A-Za-z]{0,3}-?\d{3,}$", re.I)
_INITIALS = re.compile(r"(?:^|\s)[\^~]\s?[A-Za-z]{1,3}$")
#: Words that begin a usual sign-off on a line of its own.
_SIGN_OFF = re.compile(
    r"^(?:many thanks|thanks|thank you|thx|regards|best|kind regards|best regards|cheers|sincerely|yours|sent from|no further action|"
    r"gracias|saludos|merci|cordialement|danke|grüße|mit freundlichen|obrigad[oa]|groet|bedankt|met vriendelijke|--|__|==|\*\*|\[.*\]|-.*-)",
    re.I,
)
_SIGN_LINE = re.compile(r"^(?:(?:many|best|kind|warm)\s)?(?:thanks|thank you|regards|best|cheers|sincerely|yours|gracias|saludos|merci|danke|obrigad[oa]|bedankt)(?:\sin\sadvance)?[,.!]?$", re.I)


def _scan(text: str) -> tuple[bool, bool, bool]:
    """Whether a quote, a bracket, a markup element is open at the end."""
    stack: list[str] = []
    straight = False
    for m in _SIGN.finditer(text):
        s = m.group()
        if m.group(2):
            name = m.group(2).lower()
            if name in _VOID or m.group(3).endswith("/"):
                continue
            if m.group(1):
                if "<" + name in stack:  # closes everything opened since
                    while stack.pop() != "<" + name:
                        pass
            else:
                stack.append("<" + name)
        elif s == '"':
            straight = not straight
        elif s in _PAIRS:
            stack.append(_PAIRS[s])
        elif s in stack:
            while stack.pop() != s:
                pass
    quotes = {"”", "»", "」", "』"}
    return straight or any(s in quotes for s in stack), any(s in ")]}" for s in stack), any(s[0] == "<" for s in stack)


def _broken(body: str) -> str | None:
    """What the text stops inside of: a character, a tag, a character reference, an escape."""
    last = body[-1]
    if last == "�" or "\ud800" <= last <= "\udfff" or unicodedata.category(last) == "Cn":
        return "character"
    at = body.rfind("<")
    if at >= 0 and body.find(">", at) < 0 and _BROKEN_TAG.fullmatch(body, at):
        return "markup"
    at = body.rfind("&", -12)
    if at >= 0 and (body[at + 1 :] in _REF_STARTS or _BROKEN_NUMBER.fullmatch(body, at + 1)):
        return "reference"
    at = body.rfind("\\", -6)
    return "escape" if at >= 0 and _BROKEN_ESCAPE.fullmatch(body, at) else None


def _last_word(text: str) -> str | None:
    at = len(text)
    while at and (text[at - 1].isalnum() or text[at - 1] in "_'’"):
        at -= 1
    return text[at:].lower() or None


def _last_piece(text: str) -> str:
    """What follows the last end of a sentence or line that something follows; looks as far back as that is."""
    width = 400
    while True:
        pieces = _BREAK.split(text[-width:])
        piece = next((t for t in reversed(pieces[1:]) if t and t.strip()), None)
        if piece is not None or width >= len(text):
            return (piece if piece is not None else pieces[0] if pieces[0].strip() else text).strip()
        width *= 4


def ending(text: str) -> dict:
    """What the automaton and the tail say about one text; the whole text is read."""
    body = text.rstrip()
    out = dict.fromkeys(FIELDS, None) | {"blank": not body, "quote": False, "bracket": False, "markup": False, "kind": "terminated", "dangling": False, "inside": False}
    if not body:
        return out
    out["broken"] = _broken(body)
    out["quote"], out["bracket"], out["markup"] = _scan(body)
    pure = _CLOSING_TAGS.sub("", body) if body[-1] == ">" else body
    end = pure[-1:] or " "
    lines = pure.rsplit("\n", 2)
    line = _SPEAKER.sub("", lines[-1]).strip()
    token = (pure.rsplit(None, 1) or [""])[-1]
    mark = _MARK.search(pure, max(0, len(pure.rstrip("\u2026. >])")) - 12))
    tail = _SPEAKER.sub("", _last_piece(pure))
    if mark:
        kind = "mark"
        tail = line if len(line) < 40 else tail
    elif end in TERMINATORS or (pure.rstrip(_CLOSERS)[-1:] or " ") in TERMINATORS:
        kind = "terminated"
    elif _LINK_END.search(token) or _REFERENCE.search(" ".join(pure.rsplit(None, 6)[-6:])) or _INITIALS.search(pure[-8:]) or _symbol(end):
        kind = "closing"
    elif len(line) <= 40 and len(lines) > 1 and _SIGN_LINE.match(lines[-2].strip()):
        kind = "sign-off"
    elif _SIGN_OFF.match(line) and len(line) <= 40 and len(lines) > 1 and line == tail:
        kind = "sign-off"
    else:
        kind = "bare"
    out["kind"] = kind
    same = re.sub(r"[\W_]+", "", re.sub(r"\d+", "9", body)).lower()
    out["digest"] = _digest(same)
    if kind in ("bare", "mark"):
        stem = pure[: mark.start()].rstrip() if mark else pure
        out["last"] = _last_word(stem)
        out["dangling"] = stem[-1:] in tuple(",;:([{")
    if kind in ("bare", "mark", "sign-off") and not (mark and not re.search(r"\w", _MARK.sub("", tail))):
        out["tail"] = _digest(re.sub(r"\d+", "9", tail))
        # a capital begins a name in a signature, which seldom stands inside the texts
        word = re.sub(r"\s*(?:…|\.{2,})$", "", tail)
        at = len(word) - len(_last_word(word) or "")
        out["inside"] = word[at : at + 1].islower()
    return out


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=12).digest()


def _symbol(c: str) -> bool:
    """Emoji and the like."""
    return c != "�" and (unicodedata.category(c) in ("So", "Sk") or c in "\ufe0f\u200d\u2764")


def endings(documents: DataFrame) -> DataFrame:
    """``doc_id, source`` and the fields of :func:`ending` of ``documents (doc_id, source, text)``."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen = pd.DataFrame([ending(t) for t in pdf.pop("text")], columns=FIELDS)
            yield pd.concat([pdf.reset_index(drop=True), seen], axis=1)

    src = documents.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "text").filter(F.col("text").isNotNull())
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInPandas(
        read,
        f"doc_id {kind}, source string, blank boolean, broken string, quote boolean, bracket boolean, markup boolean, kind string, tail binary, "
        "last string, dangling boolean, inside boolean, digest binary",
    )


def fragments(documents: DataFrame, seen: DataFrame) -> DataFrame:
    """``last``: the last words of ``seen`` that inside the texts are mostly the beginning of longer words."""
    # patterns of the end are tried where they can match; a mark is short, so the last 40 characters show it
    bare = F.when(F.rtrim("text").endswith(">"), F.regexp_replace("text", _CLOSING_TAGS.pattern, "")).otherwise(F.col("text"))
    cut = F.greatest(F.length("bare") - 40, F.lit(0))
    body = F.concat(F.substring("bare", F.lit(1), cut), F.regexp_replace(F.substring("bare", cut + 1, F.lit(40)), "(?i)" + _MARK.pattern, ""))
    found = F.regexp_extract_all(F.lower(body), F.lit(r"[\p{L}\p{N}_'’]+"), 0)
    # no filter on the words: it would find them a second time
    inner = documents.filter(F.col("text").isNotNull()).select(bare.alias("bare")).select(found.alias("w"))
    vocabulary = written(
        inner.select(F.explode(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0)))).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "inner-words"
    )
    lasts = seen.filter(F.col("last").isNotNull()).select("last").distinct()
    lengths = sorted(r["k"] for r in lasts.select(F.length("last").alias("k")).distinct().collect())  # numbers up to the longest word
    begun = vocabulary.filter(F.length("word") > 1).select(
        F.explode(F.transform(F.filter(F.lit(lengths).cast("array<int>"), lambda k: k < F.length("word")), lambda k: F.substring("word", F.lit(1), k))).alias("last"), "n"
    )
    longer = begun.join(lasts, "last", "left_semi").groupBy("last").agg(F.sum("n").alias("n_longer"))
    whole = vocabulary.select(F.col("word").alias("last"), F.col("n").alias("n_whole"))
    return longer.join(whole, "last", "left").filter(F.col("n_longer") > FRAGMENT_RATIO * F.coalesce("n_whole", F.lit(0))).select("last")


def _share(flag: Column, of: Column | None = None) -> Column:
    of = F.lit(True) if of is None else of
    return F.count(F.when(flag & of, 1)) / F.greatest(F.count(F.when(of, 1)), F.lit(1))


def truncated(
    documents: DataFrame, closing_share: float = CLOSING_SHARE, habit_share: float = HABIT_SHARE, terminator_share: float = TERMINATOR_SHARE
) -> DataFrame:
    """``doc_id, source, cut, reason`` for every text that is not null.

    * Blank texts are whole.  Rows that repeat a doc_id are judged each.
    * A null source is a source of its own.  An empty table gives an empty result.
    """
    seen = written(endings(documents), "endings")
    per_word = seen.groupBy("last").agg(F.count("*").alias("n_last"))
    broken_words = written(fragments(documents, seen).withColumn("fragment", F.lit(True)).join(per_word, "last"), "fragments")
    shown = F.coalesce("fragment", F.lit(False)) | F.col("dangling") | (F.col("kind") == "mark") | F.col("broken").isNotNull()
    seen = written(lookup_join(seen, broken_words, "last", "n_last", "left").withColumn("shows", shown).drop("n_last"), "seen")
    n = seen.filter(~F.col("blank")).select("digest").distinct().count()
    least = max(3, int(closing_share * n))
    inside = F.coalesce("fragment", F.lit(False)) & F.col("inside")
    # at most 1 / closing_share tails can end that many texts: a bounded side
    closings = (
        seen.filter(F.col("kind").isin("bare", "mark", "sign-off") & F.col("broken").isNull() & F.col("tail").isNotNull() & ~inside)
        .select("tail", "digest")
        .distinct()
        .groupBy("tail")
        .agg(F.count("*").alias("n_tail"))
        .filter(F.col("n_tail") >= least)
        .select("tail", F.lit(True).alias("usual"))
    )
    marked = written(seen.join(F.broadcast(closings), "tail", "left"), "tails")
    whole = F.col("kind").isin("terminated", "closing", "sign-off") | F.col("usual").isNotNull()
    uncut = ~F.col("blank") & F.col("broken").isNull() & (whole | ~F.col("shows"))
    ends, bare = (F.col("kind") == k for k in ("terminated", "bare"))
    free = ~F.col("blank") & F.col("usual").isNull()
    base = marked.groupBy("source").agg(
        F.count("*").alias("n_source"),
        *[_share(F.col(s), uncut & whole).alias(f"w_{s}") for s in ("quote", "bracket", "markup")],
        *[_share(F.col(s), uncut).alias(f"u_{s}") for s in ("quote", "bracket", "markup")],
        _share(ends, free & (ends | (bare & ~F.col("shows")))).alias("p_end"),
        _share(F.col("shows"), free & bare).alias("p_shows"),
    )
    # most bare tails show a cut where they come from cuts; where they are the habit they seldom do
    rule = (F.col("p_end") >= terminator_share) | (F.col("p_shows") >= terminator_share)
    base = base.select(
        "source", "n_source", rule.alias("rule"), *[F.when(rule, F.col(f"w_{s}")).otherwise(F.col(f"u_{s}")).alias(f"p_{s}") for s in ("quote", "bracket", "markup")]
    )
    rows = lookup_join(marked, written(base, "sources"), "source", "n_source")
    usual = F.coalesce("usual", F.lit(False)) | F.col("kind").isin("closing", "sign-off")
    reason = (
        F.when(F.col("blank"), None)
        .when(F.col("broken").isNotNull(), F.concat(F.lit("broken "), "broken"))
        .when(usual, None)
        .when(F.col("markup") & (F.col("p_markup") <= habit_share), "open markup")
        .when(F.col("quote") & (F.col("p_quote") <= habit_share), "open quote")
        .when(F.col("bracket") & (F.col("p_bracket") <= habit_share), "open bracket")
        .when(F.col("kind") == "mark", "cut mark")
        .when((F.col("kind") == "bare") & F.col("rule"), "no terminator")
    )
    out = rows.withColumn("reason", reason)
    return out.select("doc_id", "source", F.col("reason").isNotNull().alias("cut"), "reason")


def truncation_by_source(result: DataFrame) -> DataFrame:
    """``source, n_texts, n_cut, share``."""
    return result.groupBy("source").agg(
        F.count("*").alias("n_texts"), F.count(F.when(F.col("cut"), 1)).alias("n_cut"), F.round(_share(F.col("cut")), 6).alias("share")
    )

"""Passages of held-out items inside a training corpus.

Method: a distributed positional inverted index.

1. Index: a term is a word with the word after it (its list is the intersection of both
   words' lists one place apart), kept as a hash of both; every place of every document is a
   posting ``term, doc_id, pos``.  Each task sorts its own postings by term, so the index is
   split by documents and needs no shuffle.
2. Query: in every window of ``n`` words of an item the two rarest terms of the corpus are
   its anchors.  The anchors' lists are read in one pass; the place in the item subtracted
   from the place in the document gives the offset, and both lists of a window must
   hold the same offset.  Postings of a document lie in one task, so this is counted there
   before anything is shuffled.
3. The documents left are compared with the item at that offset, place by place; ``n``
   places in a row without a gap are a phrase match.  Terms with equal hashes end here.

Proximity matches (``n`` places of the item within ``slack`` places of one offset) may lack
any word, so no anchors will do: the lists of all words of the items are intersected
document at a time, the hits of one document on all items of a block as arrays.
"""

from __future__ import annotations

import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.text import words
from loomwork.operators.skew import lookup_join
from loomwork.session import shipped, written

WORDS_IN_A_ROW = 12
#: Words of the items that one block of proximity queries holds; more items are more blocks.
BLOCK_WORDS = 1_000_000
#: Words of a document whose hits are held at once; longer documents are read in overlapping pieces.
PIECE_WORDS = 20_000


def _terms(rows: DataFrame, keep: list[str], pos: str) -> DataFrame:
    """``keep``, ``pos`` and ``term`` of every place of ``rows (keep, w)``."""
    pairs = F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1)))
    return rows.select(*keep, F.posexplode(pairs).alias(pos, "term"))


def build_index(documents: DataFrame) -> DataFrame:
    """``term, doc_id, pos`` of ``documents (doc_id, text)``, written, sorted by term within its files.

    Null and blank texts have no postings."""
    rows = _terms(documents.select("doc_id", words("text").alias("w")), ["doc_id"], "pos")
    return written(rows.select("term", "doc_id", "pos").sortWithinPartitions("term"), "postings")


def item_texts(items: DataFrame, n: int) -> DataFrame:
    """``item, version, w`` of ``items (item, text)`` with ``n`` words or more; an item with two texts has two versions."""
    rows = written(items.filter(F.col("item").isNotNull()).select("item", words("text").alias("w")), "items")
    return written(rows.filter(F.size("w") >= n).distinct().withColumn("version", F.xxhash64("w")), "item-words")


def _anchors(places: DataFrame, n: int) -> DataFrame:
    """``item, version, pair, q, role, term, df``: the two rarest terms of every window of ``n`` words, as two rows.

    A window with a term that is in no document has none."""
    inside = F.lit(max(1, n - 1))  # terms of a window
    w = Window.partitionBy("item", "version").orderBy("q").rowsBetween(0, max(0, n - 2))
    ranked = places.withColumn("win", F.array_sort(F.collect_list(F.struct("df", "q", "term")).over(w))).filter(F.size("win") == inside)
    ranked = ranked.filter(F.col("win")[0]["df"] > 0)
    two = ranked.select("item", "version", F.col("win")[0].alias("a"), F.get("win", F.least(inside - 1, F.lit(1))).alias("b"))
    roles = F.array(F.struct(F.lit(1).alias("role"), F.col("a").alias("x")), F.struct(F.lit(2).alias("role"), F.col("b").alias("x")))
    pair = F.col("a.q").cast("bigint") * (1 << 31) + F.col("b.q")
    rows = two.select("item", "version", pair.alias("pair"), F.explode(roles).alias("r")).distinct()
    return rows.select("item", "version", "pair", "r.role", "r.x.q", "r.x.term", "r.x.df")


def leaked_passages(documents: DataFrame, items: DataFrame, n: int = WORDS_IN_A_ROW, slack: int = 0) -> DataFrame:
    """``doc_id, item, n_matched, longest_run`` of documents and items that match.

    With ``slack`` 0 these are phrase matches: at least ``n`` words in a row, the same in
    the same order.  With more, proximity matches: at least ``n`` places of the item found within
    ``slack`` places of where they should be.

    * Items of less than ``n`` words and null texts match nothing; an empty table gives an empty result.
    * Items with equal texts are reported each; an item with two texts is searched with both.
    """
    texts = item_texts(items, n)
    if slack:
        return _near_passages(documents, texts, n, slack)
    index = build_index(documents)
    places = _terms(texts, ["item", "version"], "q")
    # how often the items' terms occur in all documents; the vocabulary grows with the items only
    vocabulary = written(places.select("term").distinct(), "item-vocabulary")
    df = index.select("term").join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    known = places.join(written(df, "item-terms"), "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    anchors = written(_anchors(known, n), "anchors")
    hits = lookup_join(index, anchors, "term", "df").select(
        "doc_id", "item", "version", (F.col("pos") - F.col("q")).alias("off"), "pair", "role"
    )
    both = hits.groupBy("doc_id", "item", "version", "off", "pair").agg(F.bit_or("role").alias("roles")).filter("roles = 3")
    candidates = written(both.select("doc_id", "item", "version", "off").distinct(), "candidates")
    # the words of a document are read once for all its candidates, which keep the piece of the item's length
    sized = candidates.join(texts.select("item", "version", F.size("w").alias("m")), ["item", "version"])
    asked = sized.groupBy("doc_id").agg(F.collect_list(F.struct("item", "version", "off", "m")).alias("asked"))
    read = documents.select("doc_id", "text").join(asked, "doc_id").select("doc_id", words("text").alias("dw"), "asked")
    pieces = read.select(
        "doc_id", F.explode(F.transform("asked", lambda x: F.struct(x["item"].alias("item"), x["version"].alias("version"), x["off"].alias("off"), F.slice("dw", F.greatest(x["off"], F.lit(0)) + 1, x["m"]).alias("piece")))).alias("x")
    ).select("doc_id", "x.*")
    pair = pieces.join(texts, ["item", "version"])
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"), F.lit(0).alias("n"))

    def step(acc, q):
        same = F.get("piece", q + F.least(F.col("off"), F.lit(0))) == F.get("w", q)
        run = F.when(same, acc["run"] + 1).otherwise(F.lit(0))
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"), (acc["n"] + F.when(same, 1).otherwise(0)).alias("n"))

    runs = pair.select("doc_id", "item", F.aggregate(F.sequence(F.lit(0), F.size("w") - 1), start, step).alias("r"))
    found = runs.groupBy("doc_id", "item").agg(F.max("r.n").alias("n_matched"), F.max("r.best").alias("longest_run"))
    return found.filter(F.col("longest_run") >= n)


def nearest(places: dict[str, list[int]], item: list[str], n: int, slack: int) -> tuple[int, int]:
    """The most places of ``item`` within ``slack`` places of one offset, and the longest run of
    such places, over all offsets with ``n`` places or more; zeros if there are none."""
    hits = sorted((pos - q, q) for q, term in enumerate(item) for pos in places.get(term, ()))
    most = longest = low = 0
    inside: Counter = Counter()
    for i, (diag, q) in enumerate(hits):
        inside[q] += 1
        while diag - hits[low][0] > 2 * slack:
            gone = hits[low][1]
            inside[gone] -= 1
            if not inside[gone]:
                del inside[gone]
            low += 1
        if len(inside) < n or (i + 1 < len(hits) and hits[i + 1][0] - hits[low][0] <= 2 * slack):
            continue  # too few, or the next hit still belongs to this offset
        most = max(most, len(inside))
        run, last = 0, -2
        for at in sorted(inside):
            run = run + 1 if at == last + 1 else 1
            last = at
            longest = max(longest, run)
    return most, longest


class ItemLists:
    """Places of every word in a block of items: lists by word, as arrays one after another."""

    def __init__(self, names: list, texts: list[list[str]]):
        self.names, self.texts = names, texts
        by_word: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, text in enumerate(texts):
            for q, word in enumerate(text):
                by_word[word].append((i, q))
        self.ids = {w: k for k, w in enumerate(by_word)}
        flat = np.array([x for lists in by_word.values() for x in lists], dtype=np.int64).reshape(-1, 2)
        self.item, self.q = flat[:, 0], flat[:, 1]
        self.start = np.concatenate([[0], np.cumsum([len(x) for x in by_word.values()])]).astype(np.int64)
        self.longest = max(map(len, texts), default=0)

    def candidates(self, w: list[str], n: int, slack: int) -> set[int]:
        """Items with ``n`` hits or more, repeated ones counted each, within ``2 * slack`` of one offset."""
        ids = np.array([self.ids.get(x, -1) for x in w], dtype=np.int64)
        step = max(1, PIECE_WORDS)
        out: set[int] = set()
        for a in range(0, len(w), step):  # pieces overlap by the reach of an item
            part = ids[a : a + step + self.longest + 2 * slack]
            pos = np.nonzero(part >= 0)[0]
            if len(pos) < n:
                continue
            k = part[pos]
            count = self.start[k + 1] - self.start[k]
            ends = np.cumsum(count)
            at = np.arange(ends[-1]) + np.repeat(self.start[k] - (ends - count), count)
            width = len(part) + self.longest + 2 * slack + 2
            key = np.sort(self.item[at] * width + (np.repeat(pos, count) - self.q[at] + self.longest))
            if len(key) >= n:
                near = key[n - 1 :] - key[: len(key) - n + 1] <= 2 * slack
                first, last = key[: len(key) - n + 1][near] // width, key[n - 1 :][near] // width
                out.update(first[first == last].tolist())
        return out


def _near_passages(documents: DataFrame, texts: DataFrame, n: int, slack: int) -> DataFrame:
    """Proximity matches of :func:`leaked_passages`.  The documents are read once for each block of items."""
    total = texts.agg(F.sum(F.size("w"))).first()[0] or 0
    n_blocks = max(1, -(-total // BLOCK_WORDS))
    docs = documents.select("doc_id", words("text").alias("w"))
    if n_blocks > 1:
        docs = written(docs, "doc-words")
    types = {f.name: f.dataType.simpleString() for f in [*texts.schema, *docs.schema]}
    schema = f"doc_id {types['doc_id']}, item {types['item']}, n_matched int, longest_run int"
    found = None
    for b in range(n_blocks):
        rows = texts.filter(F.pmod(F.xxhash64("item", "version"), F.lit(n_blocks)) == b).select("item", "w").collect()  # about BLOCK_WORDS words
        held = shipped(documents.sparkSession, ItemLists([r["item"] for r in rows], [list(r["w"]) for r in rows]))
        part = docs.mapInPandas(_near(held, n, slack), schema)
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item").agg(F.max("n_matched").alias("n_matched"), F.max("longest_run").alias("longest_run"))


def _near(held, n: int, slack: int):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lists = pickle.loads(held.value)
        for pdf in batches:
            got = []
            for doc_id, w in zip(pdf["doc_id"], pdf["w"], strict=True):
                if w is None or len(w) < n:
                    continue
                asked = lists.candidates(w, n, slack)
                if not asked:
                    continue
                at = defaultdict(list)
                for pos, term in enumerate(w):
                    at[term].append(pos)
                for i in asked:
                    most, longest = nearest(at, lists.texts[i], n, slack)
                    if most >= n:
                        got.append((doc_id, lists.names[i], most, longest))
            yield pd.DataFrame(got, columns=["doc_id", "item", "n_matched", "longest_run"])

    return read

"""Records that differ in writing only: one group each, with the number of copies.

Method: recursive radix partitioning on canonical bytes.

1. Each record becomes its canonical bytes (entities decoded, lower case, letters
   and digits only; a list of ``name: value`` fields in sorted order).  Records of one
   input partition with equal bytes become one entry at once, so a text that is a
   third of all records is one entry a partition from here on.
2. Entries are put into buckets by their first ``step`` bytes.  Buckets above
   ``bucket_bytes`` are split by further bytes (as many as before, so that long common
   prefixes take few rounds) until each fits.  A bucket that holds one text only cannot be
   split and needs no splitting, as it has one entry a partition.
3. Whole buckets are gathered into tasks of about ``task_bytes``; each task counts in a
   burst trie with terminal counters, which gives the smallest id and the entries of each text.
4. The groups of two and more are joined back to the entries by a 128-bit digest; hot
   groups are salted, so their records are never in one task.  Copies are distinct ids:
   a record that is stored in two partitions counts once.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators.skew import lookup_join
from loomwork.session import written

STEP = 8
BUCKET_BYTES = 8 << 20
TASK_BYTES = 16 << 20

_DROP = re.compile(r"[\W_]+")
_LEAD = re.compile(r"\s*((?:@\w+[\s:,]*)*)")
_FIELD = re.compile(r"\s*[^\W\d_][\w \t\-]*[:=]\s*\S")
_BETWEEN = re.compile(r"\s*(?:[,;|\n]|\s/\s)\s*")


def canonical(text: str) -> bytes:
    """Canonical bytes of a record; empty if it has no letter and no digit."""
    text = html.unescape(text) if "&" in text else text
    if ":" in text or "=" in text:
        lead = _LEAD.match(text)
        parts = [p for p in _BETWEEN.split(text[lead.end() :].strip()) if p]
        if len(parts) > 1 and all(_FIELD.match(p) for p in parts):
            fields = sorted(_DROP.sub("", p.lower()) for p in parts)
            return "\x1f".join([_DROP.sub("", lead.group(1).lower()), *fields]).encode()
    return _DROP.sub("", text.lower()).encode()


class BurstTrie:
    """A trie over byte strings whose leaves are small dictionaries of suffixes.

    Each terminal counts its strings and keeps the smallest id.  A leaf of more than
    ``burst`` suffixes is split by the next byte."""

    def __init__(self, burst: int = 1024):
        self.burst = burst
        self.root: list = [None, {}]  # [children by byte or None, suffix -> [count, smallest id]]

    def add(self, key: bytes, count: int, first: int) -> None:
        node, at = self.root, 0
        while node[0] is not None and at < len(key):
            nxt = node[0].get(key[at])
            if nxt is None:
                nxt = node[0][key[at]] = [None, {}]
            node = nxt
            at += 1
        leaf = node[1]
        suffix = key[at:]
        terminal = leaf.get(suffix)
        if terminal is None:
            leaf[suffix] = [count, first]
            if node[0] is None and len(leaf) > self.burst:
                self._burst(node)
        else:
            terminal[0] += count
            if first < terminal[1]:
                terminal[1] = first

    def _burst(self, node: list) -> None:
        children: dict[int, list] = {}
        stays = {}
        for suffix, terminal in node[1].items():
            if suffix:
                children.setdefault(suffix[0], [None, {}])[1][suffix[1:]] = terminal
            else:
                stays[suffix] = terminal
        node[0], node[1] = children, stays

    def terminals(self) -> Iterator[tuple[bytes, int, int]]:
        """``(key, count, smallest id)`` of all strings."""
        stack = [(self.root, b"")]
        while stack:
            node, prefix = stack.pop()
            for suffix, (count, first) in node[1].items():
                yield prefix + suffix, count, first
            if node[0]:
                stack.extend((child, prefix + bytes([b])) for b, child in node[0].items())


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def entries_of(records: DataFrame) -> DataFrame:
    """``key`` (canonical bytes), ``digest``, ``ids``, ``n``, ``first`` of ``records (id bigint, text)``,
    one row for each distinct key of an input partition."""

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[bytes, list[int]] = {}
        held = 0

        def out() -> pd.DataFrame:
            ids = [sorted(set(v)) for v in found.values()]
            return pd.DataFrame(
                {"key": list(found), "digest": [_digest(k) for k in found], "ids": ids, "n": [len(v) for v in ids], "first": [v[0] for v in ids]}
            )

        for pdf in batches:
            for i, t in zip(pdf["id"].tolist(), pdf["text"].tolist(), strict=True):
                key = canonical(t)
                if key:
                    held += 1
                    got = found.get(key)
                    if got is None:
                        found[key] = [i]
                        held += len(key) // 64
                    else:
                        got.append(i)
            if held > 100_000:  # bounds the memory of a task; entries may repeat a key after that
                yield out()
                found, held = {}, 0
        if found:
            yield out()

    rows = records.select("id", "text").filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    return rows.mapInPandas(combine, "key binary, digest binary, ids array<bigint>, n bigint, first bigint")


def radix_buckets(entries: DataFrame, step: int = STEP, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """``key, n, first, bucket`` (the prefix of the entry's bucket), and the bytes of all entries."""
    open_, done, total, level = entries.select("key", "n", "first"), [], 0, 1
    size = F.length("key") + F.lit(48)
    while True:
        width = step * 2 ** (level - 1)  # each split takes as many further bytes as all before it
        prefix = F.substring("key", 1, width)
        sizes = open_.groupBy(prefix.alias("bucket")).agg(F.sum(size).alias("bytes"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        sizes = written(sizes.filter((F.col("bytes") > bucket_bytes) & (F.col("lo") != F.col("hi"))).select("bucket"), "radix")
        if level == 1:
            total = entries.agg(F.sum(size)).first()[0] or 0
        with_prefix = open_.withColumn("bucket", prefix)
        n_large = sizes.count()
        if n_large == 0:
            done.append(with_prefix)
            break
        # at most total / bucket_bytes buckets are too large; their size decides on the join
        large = sizes.select("bucket")
        done.append(with_prefix.join(large, "bucket", "left_anti").select("key", "n", "first", "bucket"))
        open_ = with_prefix.join(large, "bucket", "left_semi").select("key", "n", "first")
        level += 1
    out = done[0].select("key", "n", "first", "bucket")
    for part in done[1:]:
        out = out.unionByName(part.select("key", "n", "first", "bucket"))
    return out, total


def count_copies(
    entries: DataFrame, step: int = STEP, bucket_bytes: int = BUCKET_BYTES, task_bytes: int = TASK_BYTES, least: int = 2
) -> DataFrame:
    """``digest, first, n`` of every text whose counter ``n`` is ``least`` or more (ids, repeats counted once an input partition)."""
    buckets, total = radix_buckets(entries, step, bucket_bytes)
    tasks = max(1, math.ceil(total / task_bytes))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = BurstTrie()
        for pdf in batches:
            for key, n, first in zip(pdf["key"].tolist(), pdf["n"].tolist(), pdf["first"].tolist(), strict=True):
                trie.add(bytes(key), n, first)
        rows = [(_digest(k), first, n) for k, n, first in trie.terminals() if n >= least]
        for a in range(0, len(rows), 20_000):
            yield pd.DataFrame(rows[a : a + 20_000], columns=["digest", "first", "n"])

    return buckets.repartition(tasks, "bucket").select("key", "n", "first").mapInPandas(count, "digest binary, first bigint, n bigint")


def _members(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """Distinct ``digest, first, id`` of the groups that count two or more."""
    rows = lookup_join(entries.select("digest", "ids"), groups.filter("n > 1"), "digest", "n")
    return rows.select("digest", "first", F.explode("ids").alias("id")).distinct()


def formatting_pairs(records: DataFrame, **sizes: int) -> DataFrame:
    """Distinct ``first, id``: the smallest id of each group with each other id of it."""
    entries = written(entries_of(records), "entries")
    groups = written(count_copies(entries, **sizes), "groups")
    return _members(entries, groups).filter(F.col("id") != F.col("first")).select("first", "id").distinct()


def formatting_groups(records: DataFrame, **sizes: int) -> DataFrame:
    """``id, first, copies``: every record of a group of two or more, with the smallest id and the ids of its group.

    * Null and blank texts and texts without letters and digits belong to no group.
    * Records that repeat id and text are one; an id with two texts may be in two groups, and
      has a row in each.
    * An empty table gives an empty result; further columns are ignored.
    """
    entries = written(entries_of(records), "entries")
    groups = written(count_copies(entries, **sizes), "groups")
    members = written(_members(entries, groups), "members")
    copies = written(members.groupBy("digest").agg(F.count("*").alias("copies")).filter("copies > 1"), "copies")
    return lookup_join(members, copies, "digest", "copies").select("id", "first", "copies")


def collapse(records: DataFrame, **sizes: int) -> DataFrame:
    """One row for each text: ``first`` (smallest id) and ``copies`` (number of ids)."""
    entries = written(entries_of(records), "entries")
    groups = written(count_copies(entries, least=1, **sizes), "groups")
    many = _members(entries, groups).groupBy("digest", "first").agg(F.count("*").alias("copies")).select("first", "copies")
    return groups.filter("n = 1").select("first", F.col("n").alias("copies")).unionByName(many)

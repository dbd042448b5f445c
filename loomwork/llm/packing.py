"""Texts packed into containers of a fixed number of tokens.

Method: vector best-fit.  A container has three capacities: tokens, documents and
attention cost (the sum of squared lengths, at most ``attention`` of the square of the tokens;
an item that needs more alone has a container of its own).  Items are taken by falling size; of the open
containers that can hold an item under every constraint the one is chosen whose weighted
residual vector is shortest afterwards (``norm``) or has the largest weighted dot product
with the item (``dot``).

An item is divided only if it alone exceeds the capacity: into pieces of the full
capacity and a rest.  Items are packed in shards of about ``shard_items``, chosen by a hash;
containers that stay below ``full`` are opened again and their items packed anew with
those of other shards, ``rounds`` times.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.session import written

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
SHARD_ITEMS = 4000
MAX_DOCS = 128
#: Share of the full attention cost (the square of the tokens) that a container may have.
ATTENTION = 0.75
#: Fixed value: the split pattern of the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def token_counter(name: str, vocabulary: bytes) -> Callable[[list[str]], list[int]]:
    """Counts tokens with the content of a vocabulary file called ``name`` (.tiktoken, .json or .model)."""
    if name.endswith(".tiktoken"):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        enc = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(enc.encode_ordinary(t)) for t in texts]
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_buffer(vocabulary)
        tok.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=vocabulary)
    return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]


def token_sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, n_tokens`` of ``documents (doc_id, text)``; null texts have none.

    The vocabulary file is read by the driver and sent to the executors, which need no copy of it."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    sent = documents.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = token_counter(tokenizer, sent.value)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": counter([t if isinstance(t, str) else "" for t in pdf["text"]])})

    return documents.select("doc_id", "text").mapInPandas(count, f"doc_id {kind}, n_tokens bigint")


def best_fit(
    sizes: np.ndarray, capacity: int, max_docs: int, attention: float, weights: tuple[float, float, float], rule: str = "norm"
) -> np.ndarray:
    """Container number of each item (sizes in tokens, none above ``capacity``)."""
    order = np.argsort(-sizes, kind="stable")
    n = len(sizes)
    out = np.empty(n, dtype=np.int64)
    cap_att = attention * capacity * capacity
    w = np.asarray(weights, dtype=float)
    w2 = w * w
    residual = np.empty((max(n, 1), 3))
    number = np.empty(max(n, 1), dtype=np.int64)  # open containers: place -> number
    n_open = made = 0
    least = int(sizes.min()) if n else 0
    for i in order:
        s = int(sizes[i])
        need = np.array([s / capacity, 1 / max_docs, min(s * s, cap_att) / cap_att])
        best = -1
        if n_open:
            after = residual[:n_open] - need
            fits = (after > -1e-12).all(1)
            if fits.any():
                if rule == "dot":
                    score = np.where(fits, -(residual[:n_open] * need * w).sum(1), np.inf)
                else:
                    score = np.where(fits, (after * after * w2).sum(1), np.inf)
                best = int(score.argmin())
        if best < 0:
            best = n_open
            residual[best] = 1.0
            number[best] = made
            made += 1
            n_open += 1
        residual[best] -= need
        out[i] = number[best]
        if residual[best][0] * capacity < least - 1e-9 or residual[best][1] * max_docs < 1 - 1e-9:
            n_open -= 1  # no item left can go in
            residual[best] = residual[n_open]
            number[best] = number[n_open]
    return out


def pack(
    sizes: DataFrame,
    budgets: DataFrame,
    max_docs: int = MAX_DOCS,
    attention: float = ATTENTION,
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1),
    rule: str = "norm",
    shard_items: int = SHARD_ITEMS,
    full: float = 0.98,
    rounds: int = 2,
) -> DataFrame:
    """``budget_id, bin_id, doc_id, piece, start_token, n_tokens`` for ``sizes (doc_id, n_tokens)`` and
    ``budgets (budget_id, capacity_tokens)``.

    * Every token of every item is in exactly one container of each budget; no container exceeds
      its tokens, ``max_docs`` documents or ``attention * capacity**2`` (an item that exceeds
      the last one alone has a container of its own).
    * Items without tokens need no room and are in no container.  Budgets without a positive
      capacity, and repeated budgets, are left out.  Empty tables give an empty result.
    """
    room = budgets.select("budget_id", F.col("capacity_tokens").cast("bigint").alias("cap")).filter("cap > 0").dropDuplicates(["budget_id"])
    items = sizes.filter("n_tokens > 0").select("doc_id", F.col("n_tokens").cast("bigint").alias("total"))
    # the budgets are a few rows of configuration; the items are not compared with each other
    n_budgets = room.count()
    pairs = items.withColumn("b", F.explode(F.array(*[F.struct(F.lit(r["budget_id"]).alias("budget_id"), F.lit(r["cap"]).alias("cap")) for r in room.collect()]))) if n_budgets else None
    if pairs is None:
        return items.select(F.lit(0).alias("budget_id"), F.lit("").alias("bin_id"), "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start_token"), F.col("total").alias("n_tokens")).filter("false")
    whole = pairs.select("doc_id", "total", "b.*")
    pieces = whole.select(
        "budget_id", "cap", "doc_id", "total",
        F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.col("total") - 1, F.col("cap"))).alias("piece", "start_token"),
    ).withColumn("n_tokens", F.least("cap", F.col("total") - F.col("start_token"))).drop("total")
    pieces = written(pieces, "pieces")
    types = {f.name: f.dataType.simpleString() for f in pieces.schema}
    schema = f"budget_id {types['budget_id']}, cap bigint, doc_id {types['doc_id']}, piece int, start_token bigint, n_tokens bigint, bin_id string"

    # pieces of the full capacity are containers by themselves
    alone = pieces.filter("n_tokens = cap").withColumn("bin_id", F.concat_ws("-", F.lit("f"), "budget_id", "doc_id", "piece"))
    open_ = pieces.filter("n_tokens < cap")
    parts = [alone.select("budget_id", "bin_id", "doc_id", "piece", "start_token", "n_tokens")]
    for level in range(rounds + 1):
        per = open_.groupBy("budget_id").agg(F.count("*").alias("n")).collect()  # one row a budget
        if not per:
            break
        shards = {r["budget_id"]: max(1, math.ceil(r["n"] / shard_items)) for r in per}
        n_shards = F.lit(1)
        for b, n in shards.items():
            n_shards = F.when(F.col("budget_id") == F.lit(b), F.lit(n)).otherwise(n_shards)
        sharded = open_.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.lit(level)), n_shards).cast("int")).withColumn("level", F.lit(level))

        def fill(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
            cap = int(pdf["cap"].iloc[0])
            got = best_fit(pdf["n_tokens"].to_numpy(), cap, max_docs, attention, weights, rule)
            head = f"{pdf['level'].iloc[0]}-{pdf['budget_id'].iloc[0]}-{pdf['shard'].iloc[0]}-"
            return pdf.drop(columns=["shard", "level"]).assign(bin_id=[head + str(g) for g in got])

        packed = written(sharded.groupBy("budget_id", "shard").applyInPandas(fill, schema), "packed")
        if level == rounds:
            parts.append(packed.select("budget_id", "bin_id", "doc_id", "piece", "start_token", "n_tokens"))
            break
        fills = packed.groupBy("bin_id").agg((F.sum("n_tokens") >= full * F.first("cap")).alias("done"))
        marked = written(packed.join(fills, "bin_id"), "fills")
        parts.append(marked.filter("done").select("budget_id", "bin_id", "doc_id", "piece", "start_token", "n_tokens"))
        open_ = marked.filter("not done").drop("bin_id", "done")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fill_report(packed: DataFrame, budgets: DataFrame, max_docs: int = MAX_DOCS, attention: float = ATTENTION) -> DataFrame:
    """``budget_id, capacity_tokens, n_bins, least_bins, n_tokens, fill``.

    ``least_bins`` is a bound that no packing can go below: a container for each piece that fills
    the tokens or the attention cost alone, and for the rest what the scarcest capacity needs."""
    room = budgets.select("budget_id", "capacity_tokens").dropDuplicates(["budget_id"])
    rows = packed.join(room, "budget_id")
    cap = F.col("capacity_tokens").cast("double")
    square = F.col("n_tokens").cast("double") * F.col("n_tokens")
    alone = (F.col("n_tokens") >= F.col("capacity_tokens")) | (square >= F.lit(attention) * cap * cap)
    rest = lambda x: F.sum(F.when(~alone, x).otherwise(0))
    per = rows.groupBy("budget_id", "capacity_tokens").agg(
        F.countDistinct("bin_id").alias("n_bins"), F.sum("n_tokens").alias("n_tokens"), F.count_if(alone).alias("n_alone"),
        rest(F.col("n_tokens")).alias("rest_tokens"), rest(square).alias("rest_attention"), F.count_if(~alone).alias("n_rest"),
    )
    needs = [F.col("rest_tokens") / cap, F.col("n_rest") / F.lit(float(max_docs)), F.col("rest_attention") / (F.lit(attention) * cap * cap)]
    least = F.col("n_alone") + F.greatest(*[F.ceil(x - 1e-9) for x in needs])
    return per.select(
        "budget_id", "capacity_tokens", "n_bins", least.cast("bigint").alias("least_bins"), "n_tokens",
        F.round(F.col("n_tokens") / (F.col("n_bins") * F.col("capacity_tokens")), 4).alias("fill"),
    )

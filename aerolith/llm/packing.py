"""Filling containers of fixed capacity: variable-capacity best fit.

The permitted lengths of a capacity C are its eighths. All lengths are in play at once: items come
in falling size, and each goes into the open container where it leaves the least room. Where none
has room a new one is opened, and its length is chosen over all permitted lengths together with what
the items still to come can fill: of the room that a length would leave, only so much counts as
filled as there are tokens in items that fit it, less the room that open containers already offer
them. The least cost per filled token wins, where a container costs its length plus a fixed amount.
So long as small items abound, the full capacity is cheapest; where they run short, an item gets a
length near its own. At the end every container shrinks to the smallest permitted length that holds
what is in it.

Containers are filled in independent shards of at most ``shard_items`` items, chosen by a hash of the
item, so no key can make a shard hot; each shard leaves at most a few containers part empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.llm.prefix_bpe import TOKENIZERS, vocabulary

#: Permitted lengths as parts of the capacity, in eighths.
EIGHTHS = (1, 2, 3, 4, 5, 6, 7, 8)
#: What a container costs besides its length, in tokens.
OPENING = 16
SHARD_ITEMS = 20_000

_OTHERS: dict[str, object] = {}


def _library(name: str, folder: str):
    """A counting function of a tokenizer that is not byte-level BPE, loaded once per worker."""
    key = f"{folder}/{name}"
    if key not in _OTHERS:
        if name.startswith("piece_"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=f"{key}.model")
            _OTHERS[key] = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(f"{key}.json")
            t.encode_special_tokens = True
            _OTHERS[key] = lambda texts: [len(x) for x in t.encode_batch_fast(texts, add_special_tokens=False)]
    return _OTHERS[key]


def token_counts(text: Column, name: str, folder: str = TOKENIZERS) -> Column:
    """Number of tokens of each text by the named public tokenizer; 0 for null and empty texts."""

    @F.arrow_udf("bigint")
    def count(v: pa.Array) -> pa.Array:
        texts = v.to_pylist()
        if name.startswith("byte_bpe"):
            enc = vocabulary(name, folder)
            return pa.array([len(enc.encode(t)) for t in texts], type=pa.int64())
        out = np.zeros(len(texts), dtype=np.int64)
        some = [i for i, t in enumerate(texts) if t]
        tally = _library(name, folder)
        for i in range(0, len(some), 256):
            part = some[i : i + 256]
            out[part] = tally([texts[j] for j in part])
        return pa.array(out)

    return count(text)


def permitted(capacity: int) -> list[int]:
    return sorted({max(1, capacity * e // 8) for e in EIGHTHS} | {capacity})


def best_fit(sizes: np.ndarray, capacity: int, opening: int = OPENING) -> tuple[np.ndarray, list[int]]:
    """Container number of each item, and each container's final length. All sizes lie in 1..capacity."""
    lengths = permitted(capacity)
    where = np.empty(len(sizes), dtype=np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open containers by room left
    some = 0  # bit r is set if room[r] is not empty
    used: list[int] = []
    order = np.argsort(-sizes, kind="stable")
    upto = np.cumsum(np.bincount(sizes, minlength=capacity + 1) * np.arange(capacity + 1)).tolist()  # tokens in items of at most that size
    to_come, offered = int(sizes.sum()), 0  # tokens still to come, and room in open containers
    for i in order.tolist():
        n = int(sizes[i])
        to_come -= n
        fitting = some >> n
        if fitting:
            r = n + (fitting & -fitting).bit_length() - 1
            c = room[r].pop()
            offered -= r
            if not room[r]:
                some &= ~(1 << r)
        else:
            r, least = 0, 0.0
            for s in lengths:
                if s >= n:
                    left = s - n
                    # Items come in falling size: all that are smaller than this one are still to come.
                    supply = max(0, min(to_come, upto[left]) - offered)
                    cost = (s + opening) / (n + min(left, supply))
                    if not r or cost < least:
                        r, least = s, cost
            c = len(used)
            used.append(0)
        where[i] = c
        used[c] += n
        if r > n:
            room[r - n].append(c)
            some |= 1 << (r - n)
            offered += r - n
    final = [next(s for s in lengths if s >= u) for u in used]
    return where, final


def pack(items: DataFrame, capacities: dict[int, int], shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Assign every item to a container of its profile.

    ``items``: (profile_id, doc_id, n_tokens); ``capacities``: capacity of each profile, a small
    fixed list. Result: (profile_id, doc_id, piece, start, n_tokens, container_id,
    container_length), one row per item or, for an item longer than the capacity, per piece: full
    containers, and the rest as an item like others. An item that fits is never split. Items of no
    tokens (null, empty texts, or a null count) have one row with a null container. Rows of unknown
    profiles come out the same way. Repeated rows are items of their own.
    """
    cap = F.lit(None)
    if capacities:
        cap = F.try_element_at(F.create_map(*[x for p, c in capacities.items() for x in (F.lit(p), F.lit(c))]), F.col("profile_id"))
    d = items.select("profile_id", "doc_id", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"), cap.cast("bigint").alias("__cap"))
    d = d.withColumn("__cap", F.coalesce("__cap", F.lit(0))).withColumn("__pieces", F.when((F.col("__cap") > 0) & (F.col("n_tokens") > 0), F.ceil(F.col("n_tokens") / F.col("__cap"))).otherwise(1))
    d = d.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("__pieces").cast("int") - 1)))
    d = d.withColumn("start", F.col("piece") * F.col("__cap")).withColumn("n_tokens", F.when(F.col("__cap") > 0, F.least(F.col("__cap"), F.col("n_tokens") - F.col("start"))).otherwise(F.col("n_tokens")))
    real = (F.col("__cap") > 0) & (F.col("n_tokens") > 0)
    none = d.where(~real).select("profile_id", "doc_id", "piece", "start", "n_tokens", F.lit(None).cast("string").alias("container_id"), F.lit(None).cast("int").alias("container_length"))
    n = items.count()
    shards = max(1, -(-n // (max(1, len(capacities)) * shard_items)))
    d = d.where(real).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            p = p.sort_values(["doc_id", "piece"], kind="stable", ignore_index=True)
            where, final = best_fit(p["n_tokens"].to_numpy(), int(p["__cap"].iat[0]))
            prefix = f"{p['profile_id'].iat[0]}-{p['shard'].iat[0]}-"
            p["container_id"] = [prefix + str(c) for c in where.tolist()]
            p["container_length"] = np.array(final, dtype=np.int32)[where]
            yield p[["profile_id", "doc_id", "piece", "start", "n_tokens", "container_id", "container_length"]]

    schema = "profile_id int, doc_id bigint, piece int, start bigint, n_tokens bigint, container_id string, container_length int"
    narrow = d.select("profile_id", "doc_id", "piece", "start", "n_tokens", "__cap", "shard")
    return narrow.groupBy("profile_id", "shard").applyInPandas(lambda p: next(fill(iter([p]))), schema).union(none)

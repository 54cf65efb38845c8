"""Packing: optimal length buckets by dynamic programming, then token-budget batches inside each bucket.

1. A text of n tokens is cut into pieces of at most ``max_tokens``; every piece is kept.
2. The global histogram of piece lengths has at most ``max_tokens`` cells, whatever the number of texts.
   Dynamic programming over it finds the ``n_buckets`` upper bounds with the least padding.
3. A bucket padded to length L takes floor(token_budget / L) pieces per batch. The position of a piece in its
   bucket is its rank within a salt (a hash of the id) plus the size of the salts before it, so no bucket is
   one task, and only the last batch of a bucket can be short.

The text itself never moves: only id, piece number and length are shuffled.

Defined cases: NULL, empty and blank texts have 0 tokens and get one row without bucket and batch; repeated rows
are packed as often as they occur; ties of padding take the smaller bound; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldspark.llm.text import WORD, spooled

MAX_TOKENS = 2048
TOKEN_BUDGET = 16384
N_BUCKETS = 8
SALT_ROWS = 8192


def count_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("int")


def pieces_of(docs: DataFrame, id_column: str, length: Column, max_tokens: int) -> DataFrame:
    """One row per piece: id, piece number, first token and number of tokens."""
    cut = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_n") / max_tokens) - 1, F.lit(0)).cast("int"))
    return (
        docs.select(F.col(id_column).alias("doc_id"), length.cast("int").alias("_n"))
        .select("doc_id", "_n", F.explode(cut).alias("piece"))
        .select(
            "doc_id",
            "piece",
            (F.col("piece") * max_tokens).alias("first_token"),
            F.least(F.col("_n") - F.col("piece") * max_tokens, F.lit(max_tokens)).alias("n_tokens"),
        )
    )


def optimal_bounds(lengths: Sequence[int], counts: Sequence[int], n_buckets: int) -> list[int]:
    """Upper bounds of at most ``n_buckets`` buckets that minimise total padding; of equal choices the smaller cut."""
    order = np.argsort(lengths)
    size = np.asarray(lengths, dtype=np.int64)[order]
    many = np.asarray(counts, dtype=np.int64)[order]
    n = len(size)
    if n == 0:
        return []
    rows = np.concatenate([[0], np.cumsum(many)])
    tokens = np.concatenate([[0], np.cumsum(many * size)])
    # best[j]: least padding of the first j cells with the buckets used so far.
    best = np.concatenate([[0], size * rows[1:] - tokens[1:]])
    cuts: list[np.ndarray] = [np.zeros(n + 1, dtype=np.int64)]
    for _ in range(min(n_buckets, n) - 1):
        new, cut = best.copy(), np.zeros(n + 1, dtype=np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + size[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            cut[j] = int(np.argmin(cost))
            new[j] = cost[cut[j]]
        best = new
        cuts.append(cut)
    bounds, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        bounds.append(int(size[j - 1]))
        j = int(cut[j])
    return bounds[::-1]


def pack(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    length: Column | None = None,
    max_tokens: int = MAX_TOKENS,
    token_budget: int = TOKEN_BUDGET,
    n_buckets: int = N_BUCKETS,
    salt_rows: int = SALT_ROWS,
) -> DataFrame:
    """Assign every piece of every text to a bucket, a batch and a slot in it.

    ``length`` gives the token count of a row (default: its words). Returns doc_id, piece, first_token, n_tokens,
    bucket, bucket_length, batch, slot and padding.
    """
    if not 0 < max_tokens <= token_budget:
        raise ValueError("max_tokens has to be positive and at most token_budget")
    spark = docs.sparkSession
    pieces = spooled(pieces_of(docs, id_column, count_words(text_column) if length is None else length, max_tokens))
    cells = pieces.filter("n_tokens > 0").groupBy("n_tokens").count().collect()  # at most max_tokens rows
    bounds = optimal_bounds([c["n_tokens"] for c in cells], [c["count"] for c in cells], n_buckets)
    layout = pieces.select("*", *_bucket_of(bounds))

    total = sum(c["count"] for c in cells)
    salts = max(1, -(-total // salt_rows))
    salt = F.when(F.col("bucket").isNotNull(), F.pmod(F.conv(F.substring(F.md5(_name()), 1, 8), 16, 10).cast("long"), F.lit(salts)))
    layout = layout.withColumn("_salt", salt)
    # Sizes before a salt: one row per bucket and salt, in order of the bucket; salts grow with the rows / salt_rows.
    sizes = layout.filter("bucket is not null").groupBy("bucket", "_salt").agg(F.count("*").alias("_rows"))
    before = sizes.withColumn("_before", F.sum("_rows").over(W.partitionBy("bucket").orderBy("_salt")) - F.col("_rows")).drop("_rows")
    within = W.partitionBy("bucket", "_salt").orderBy("doc_id", "piece", "n_tokens")
    placed = layout.withColumn("_rank", F.row_number().over(within) - 1).join(F.broadcast(before) if total < salt_rows * 10_000 else before, ["bucket", "_salt"], "left")
    capacity = F.floor(F.lit(token_budget) / F.col("bucket_length"))
    position = F.col("_before") + F.col("_rank")
    return placed.select(
        "doc_id",
        "piece",
        "first_token",
        "n_tokens",
        "bucket",
        "bucket_length",
        F.floor(position / capacity).cast("long").alias("batch"),
        F.pmod(position, capacity).cast("int").alias("slot"),
        (F.col("bucket_length") - F.col("n_tokens")).alias("padding"),
    )


def _name() -> Column:
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("piece").cast("string"))


def _bucket_of(bounds: list[int]) -> list[Column]:
    """Number and bound of the first bucket that holds a piece; NULL for pieces without tokens."""
    number, bound = F.lit(None).cast("int"), F.lit(None).cast("int")
    for k in reversed(range(len(bounds))):
        fits = (F.col("n_tokens") > 0) & (F.col("n_tokens") <= bounds[k])
        number, bound = F.when(fits, F.lit(k)).otherwise(number), F.when(fits, F.lit(bounds[k])).otherwise(bound)
    return [number.alias("bucket"), bound.alias("bucket_length")]

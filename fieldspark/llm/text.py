"""Shared helpers: word rules, Arrow blocks of bounded size, tables kept in the checkpoint folder.

Words are runs of characters other than the ASCII blanks 0x20 and 0x09-0x0D.
``bytes.split()`` cuts UTF-8 at exactly these bytes, so Python tasks and Spark or
DuckDB expressions agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.plans.scale import attach, checkpoint_folder, durable, release, ship, spooled  # noqa: F401  (shared by the operators)

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
BLOCK_BYTES = 1_000_000


def words_of(text: Column) -> Column:
    """The words of a text; an empty list for NULL."""
    cut = F.split(F.coalesce(text, F.lit("")), GAP)
    return F.filter(cut, lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def remainder(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; NULL for a NULL id."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus


def text_blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, list[bytes | None]]]:
    """Cut a batch into runs of rows of about ``limit`` bytes: start, end and the texts as UTF-8."""
    texts = batch.column(column)
    texts = texts.cast(pa.large_binary()) if not pa.types.is_binary(texts.type) else texts
    start, size, rows = 0, 0, []
    for k, value in enumerate(texts):
        raw = value.as_py()
        rows.append(raw)
        size += len(raw or b"")
        if size >= limit:
            yield start, k + 1, rows
            start, size, rows = k + 1, 0, []
    if rows:
        yield start, len(texts), rows


def fresh(df: DataFrame, *names: str) -> DataFrame:
    """Drop the columns that an operator is about to write, whatever their letter case."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it, whatever the letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(id_column: str, text_column: str) -> Column:
    """Names a row by id and text, so that a repeated id with another text stays apart."""
    return F.xxhash64(F.col(id_column).cast("string"), F.col(text_column))


def once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` and new columns that are evaluated once per row, however often a later step refers to them.

    A generator over one element stands between the steps, so the optimizer cannot copy an expensive expression into
    the places, lambdas among them, that use it.
    """
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_once")
    return df.select(*keep, made).select(*keep, *[F.col(f"_once.{n}").alias(n) for n in columns])

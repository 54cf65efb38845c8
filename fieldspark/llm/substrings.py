"""Substring dedup by hashing lines and the sentences inside them.

1. A text is cut into lines. A line of at least ``min_words`` words is a unit; so is every sentence in it of at least
   ``min_words`` words, which catches a passage that stands inside another line. Units are normalised (case, blanks)
   and hashed to 128 bits.
2. Digests are grouped globally: a digest that occurs once drops out; of the others the earliest occurrence, in the
   order of ``rank`` (id, then place in the text), stays. The minimum is a partial aggregate. To mark the occurrences,
   digests with more than ``HOT_ROWS`` of them, of which there are few, are joined where the occurrences are; only the others
   are dealt out by digest. So a line that stands in a third of all texts is no hot task.
3. The spans of the removed units are joined back to their texts, which are cut by code point offsets of the original.

Defined cases: NULL texts stay NULL and empty ones empty; repeated rows with the same id and text get the same result;
a passage repeated inside one text keeps its first place; rows with a NULL id rank last; an empty table gives an empty
result; columns of the input named like a result column are replaced, all others may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.llm.text import attach, free_name, fresh, row_key, ship, spooled, text_blocks

MIN_WORDS = 8
HOT_ROWS = 1_000
_SENTENCE = re.compile(r"[^.!?]*[.!?]*")
_CASE = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def units_of(text: str, min_words: int = MIN_WORDS) -> list[tuple[int, int, bytes, bool]]:
    """Start, end, digest and kind (True: a whole line) of the units of a text, by start."""
    found, at = [], 0
    for line in text.split("\n"):
        words = line.split()
        if len(words) >= min_words:
            found.append((at, at + len(line), _digest(words), True))
            parts = [m for m in _SENTENCE.finditer(line) if m.end() > m.start()]
            for m in parts if len(parts) > 1 else ():
                inner = m.group().split()
                if len(inner) >= min_words:
                    found.append((at + m.start(), at + m.end(), _digest(inner), False))
        at += len(line) + 1
    return found


def _digest(words: list[str]) -> bytes:
    return blake2b(" ".join(words).translate(_CASE).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _units(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, texts in text_blocks(batch, "_text"):
                rows, digests, starts, ends, kinds = [], [], [], [], []
                for k, raw in enumerate(texts):
                    for s, e, digest, line in units_of(raw.decode("utf-8", "surrogatepass") if raw else "", min_words):
                        rows.append(k)
                        digests.append(digest)
                        starts.append(s)
                        ends.append(e)
                        kinds.append(line)
                at = pa.array(rows, pa.int64())
                block = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays(
                    [block.column("_row").take(at), block.column("_rank").take(at), pa.array(digests, pa.binary()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(kinds, pa.bool_())],
                    names=["_row", "_rank", "digest", "start", "end", "line"],
                )

    return run


def repeated_units(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The units that repeat an earlier one: row key, start and end (code points of the original text)."""
    ship(docs.sparkSession)
    source = docs.select(row_key(id_column, text_column).alias("_row"), F.col(id_column).alias("_rank"), F.col(text_column).alias("_text"))
    schema = T.StructType([*source.schema.fields[:2], T.StructField("digest", T.BinaryType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("line", T.BooleanType())])
    units = spooled(source.mapInArrow(_units(min_words), schema))
    # Rows without an id rank last; a line counts before a sentence at the same place.
    place = F.struct(F.col("_rank").isNull().alias("none"), F.col("_rank").alias("rank"), F.col("_row").alias("row"), F.col("start").alias("start"), (~F.col("line")).alias("part"))
    twice = spooled(units.groupBy("digest").agg(F.count("*").alias("held")).filter("held > 1"))
    again = spooled(_met(units, twice, twice))
    firsts = spooled(again.groupBy("digest").agg(F.min(place).alias("_first")))
    return _met(again, firsts, twice).filter(place != F.col("_first")).select("_row", "start", "end", "line")


def _met(units: DataFrame, facts: DataFrame, counts: DataFrame) -> DataFrame:
    """The units whose digest is in ``facts``, with these; ``counts`` says how many units have a digest."""
    hot = attach(units, counts.filter(F.col("held") > HOT_ROWS).select("digest", F.lit(True).alias("_hot")), ["digest"], "left")
    few = facts.join(counts.filter(F.col("held") > HOT_ROWS).select("digest"), "digest", "left_semi")
    there = attach(hot.filter("_hot").drop("_hot"), few, ["digest"])
    return there.unionByName(hot.filter("_hot is null").drop("_hot").join(facts, "digest"))


def _cut(text_column: str, spans_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, texts in text_blocks(batch, text_column):
                block = batch.slice(start, end - start)
                made = [cut_spans(None if t is None else t.decode("utf-8", "surrogatepass"), s.as_py() or []) for t, s in zip(texts, block.column(spans_column), strict=True)]
                columns = {n: block.column(n) for n in block.schema.names if n != spans_column}
                columns[text_column] = pa.array([m[0] for m in made], pa.string())
                columns["removed"] = pa.array([m[1] for m in made], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


_BLANK = " \t\r\x0b\x0c"


def _whole_line(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The line, its end included, if nothing but blanks is left of it beside the span."""
    while start and text[start - 1] in _BLANK:
        start -= 1
    while end < len(text) and text[end] in _BLANK:
        end += 1
    if (start and text[start - 1] != "\n") or (end < len(text) and text[end] != "\n"):
        return None
    return start, min(end + 1, len(text))


def cut_spans(text: str | None, spans: list[dict]) -> tuple[str | None, list[dict]]:
    """The text without the spans, and the spans as joined, disjoint ranges of the original.

    A removed line takes its line end along; so does a line of which only blanks are left.
    """
    if text is None or not spans:
        return text, []
    joined: list[tuple[int, int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in spans):
        # Spans with only blanks between them are one if they are all that their line holds.
        if joined and s <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(joined[-1][1], e))
        else:
            joined.append((s, e))
    runs: list[list[tuple[int, int]]] = []
    for span in joined:
        if runs and not text[runs[-1][-1][1] : span[0]].strip(_BLANK):
            runs[-1].append(span)
        else:
            runs.append([span])
    joined = []
    for run in runs:
        line = _whole_line(text, run[0][0], run[-1][1])
        joined += run if line is None else [line]
    out, at, ranges = [], 0, []
    for s, e in joined:
        out.append(text[at:s])
        at = e
        if ranges and ranges[-1]["end"] == s:
            ranges[-1]["end"] = e
        else:
            ranges.append({"start": s, "end": e})
    return "".join([*out, text[at:]]), ranges


def drop_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with repeated units cut out of the text, and ``removed``: the ranges of the original text."""
    plain = fresh(docs, "removed")
    row, spans_name = free_name(plain, "_row_of_text"), free_name(plain, "_spans_of_text")
    spans = (
        repeated_units(plain, id_column, text_column, min_words)
        .select(F.col("_row").alias(row), "start", "end")
        .distinct()
        .groupBy(row)
        .agg(F.collect_list(F.struct("start", "end")).alias(spans_name))
    )
    joined = plain.withColumn(row, row_key(id_column, text_column)).join(spans, row, "left").drop(row)
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*[f for f in joined.schema.fields if f.name != spans_name], T.StructField("removed", span)])
    return joined.mapInArrow(_cut(text_column, spans_name), schema).select(*plain.columns, "removed")

"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests; DataFrame functions only.

1. A text of any size is cut into paragraphs at its line ends and sentence ends; each distinct one is a 64-bit digest.
2. A sketch has three sub-tables. A digest goes to one cell of each; a cell holds the number of its digests, their XOR
   and the XOR of their check hashes. The fingerprint is the fixed-size base sketch as text.
3. To compare two versions, their digests are dealt to parts of a few digests by further bits, so the work is linear in
   the length of a text. In each part the cells of one version are subtracted from the other's and peeled: a cell
   with one digest gives it away, and it is removed from its other cells, until all cells are empty.
4. If cells are left, the part is tried again with four and with sixteen times the cells; the last resort is the
   difference of the digests themselves. The likeness is the Jaccard similarity that follows from both sizes and the
   number of recovered digests.

Defined cases: a NULL text counts as empty; two texts without paragraphs have the likeness 1; a text whose edited form
equals it has the likeness 1; rows with equal id and text are one document in the order and each get its result; rows
without an id come last; a single document is its own successor; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldspark.llm.text import once, row_key, spooled

# Cells of one sub-table: base size and the sizes of the retries.
SIZES = (4, 16, 64)
# Digests of one version that a part gets on average, at most.
PART = 2
ROUNDS = 6


def paragraphs(text: Column) -> Column:
    """The distinct digests of the paragraphs of a text, sorted."""
    cut = F.split(F.regexp_replace(text, r"([.!?])[ \t]+", "$1\n"), "\n")
    named = F.transform(F.filter(F.transform(cut, lambda p: F.trim(p)), lambda p: p != ""), lambda p: F.xxhash64(p))
    return F.array_sort(F.array_distinct(named))


def _cell(c: Column, k: Column, s: Column) -> Column:
    return F.struct(c.cast("int").alias("c"), k.alias("k"), s.alias("s"))


def _placed(digest: Column, size: int) -> list[Column]:
    """Where a digest goes: a bit mask of its three cells if the sketch has at most 63 cells, else their numbers."""
    spots = [(F.shiftright(digest, 9 * t) % size + size) % size + t * size for t in range(3)]
    if 3 * size > 63:
        return [p.cast("int").alias(f"p{t}") for t, p in enumerate(spots)]
    mask = F.lit(0).cast("long")
    for p in spots:
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), p.cast("int")))
    return [mask.alias("m")]


def _in_cell(entry: Column, i: Column, size: int) -> Column:
    if 3 * size > 63:
        return (entry["p0"] == i) | (entry["p1"] == i) | (entry["p2"] == i)
    return F.getbit(entry["m"], i) == 1


def sketch(digests: Column, size: int) -> Column:
    """The cells of a set of digests: count, XOR of the digests and XOR of their check hashes."""
    entries = F.transform(digests, lambda d: F.struct(d.alias("k"), F.xxhash64(d).alias("s"), *_placed(d, size)))
    blank = F.expr("named_struct('c', 0, 'k', 0L, 's', 0L)")

    def cell(e: Column, i: Column) -> Column:
        add = lambda x, d: _cell(x["c"] + 1, x["k"].bitwiseXOR(d["k"]), x["s"].bitwiseXOR(d["s"]))
        return F.aggregate(F.filter(e, lambda d: _in_cell(d, i, size)), blank, add)

    return _with(entries, lambda e: F.transform(F.sequence(F.lit(0), F.lit(3 * size - 1)), lambda i: cell(e, i)))


def subtract(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: _cell(a["c"] - b["c"], a["k"].bitwiseXOR(b["k"]), a["s"].bitwiseXOR(b["s"])))


def peel(difference: Column, size: int) -> Column:
    """The number of digests that differ; NULL if cells are left when no cell holds a single digest any more.

    Every round takes the digests of all single cells at once; a digest that is single in several cells looks the same
    in each of them and counts once.
    """

    def single(x: Column) -> Column:
        return (F.abs(x["c"]) == 1) & (F.xxhash64(x["k"]) == x["s"])

    def round_(state: Column, _: Column) -> Column:
        def remove(found: Column) -> Column:
            entries = F.transform(found, lambda x: F.struct(x["c"].alias("c"), x["k"].alias("k"), x["s"].alias("s"), *_placed(x["k"], size)))
            take = lambda x, d: _cell(x["c"] - d["c"], x["k"].bitwiseXOR(d["k"]), x["s"].bitwiseXOR(d["s"]))
            left = lambda e: F.transform(
                state["cells"], lambda x, i: F.aggregate(F.filter(e, lambda d: _in_cell(d, i, size)), x, take)
            )
            return F.struct(_with(entries, left).alias("cells"), (state["n"] + F.size(found)).alias("n"))

        found = F.array_distinct(F.filter(state["cells"], single))
        return _with(found, lambda f: F.when(F.size(f) == 0, state).otherwise(remove(f)))

    start = F.struct(difference.alias("cells"), F.lit(0).alias("n"))
    left = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_)
    return _with(left, lambda s: F.when(~F.exists(s["cells"], _filled), s["n"]))


def _filled(x: Column) -> Column:
    return (x["c"] != 0) | (x["k"] != 0) | (x["s"] != 0)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _parts(digests: Column, levels: Column) -> Column:
    """The digests dealt to 2^levels parts by bits 32, 33, ... of the digest, one bit at a time."""

    def halve(parts: Column, bit: Column) -> Column:
        side = lambda p, v: F.filter(p, lambda d: F.getbit(d, bit) == v)
        return F.flatten(F.transform(parts, lambda p: F.array(side(p, 0), side(p, 1))))

    bits = F.when(levels > 0, F.sequence(F.lit(32), F.lit(31) + levels)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(bits, F.array(digests), halve)


def differing(left: Column, right: Column) -> Column:
    """The number of digests that two sets differ in, recovered by peeling."""
    larger = F.greatest(F.size(left), F.size(right))
    levels = F.greatest(F.lit(0), F.least(F.lit(24), F.ceil(F.log2((larger + 1) / PART)))).cast("int")

    def of_part(a: Column, b: Column) -> Column:
        def tries(size: int) -> Column:
            cells = subtract(sketch(a, size), sketch(b, size))
            return _with(cells, lambda c: F.when(F.exists(c, _filled), peel(c, size)).otherwise(0))

        exact = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
        return F.when((F.size(a) == 0) & (F.size(b) == 0), 0).otherwise(F.coalesce(*[tries(s) for s in SIZES], exact))

    return F.aggregate(F.zip_with(_parts(left, levels), _parts(right, levels), of_part), F.lit(0), lambda x, y: x + y)


def likeness(left: Column, right: Column) -> Column:
    total = F.size(left) + F.size(right)
    d = differing(left, right)
    return F.when(total == 0, F.lit(1.0)).otherwise(_with(d, lambda n: (total - n) / (total + n)))


def as_text(digests: Column) -> Column:
    """The base sketch as text: the number of digests, then count and hex of every cell."""
    cell = lambda x: F.concat(x["c"].cast("string"), F.lit("."), F.hex(x["k"]), F.lit("."), F.hex(x["s"]))
    return F.concat(F.size(digests).cast("string"), F.lit(":"), F.array_join(F.transform(sketch(digests, SIZES[0]), cell), ","))


def with_successor(order: DataFrame) -> DataFrame:
    """``order`` (id, key, n) with next_key: the key of the next row by descending id, of the first after the last.

    The ids are dealt by range; a window sees one range, and one row per range settles the borders.
    """
    by = [F.col("id").desc_nulls_last(), F.col("key")]
    dealt = spooled(order.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    place = F.struct(F.col("_part"), F.col("id").isNull().alias("none"))
    tops = dealt.withColumn("_row", F.row_number().over(W.partitionBy("_part").orderBy(*by))).filter("_row = 1").select("_part", F.col("key").alias("_top"))
    # One row per range.
    ring = W.partitionBy(F.lit(0)).orderBy("_part")
    border = tops.select("_part", F.coalesce(F.lead("_top").over(ring), F.first("_top").over(ring)).alias("_border"))
    after = F.lead("key").over(W.partitionBy("_part").orderBy(*by))
    return dealt.withColumn("_after", after).join(F.broadcast(border), "_part").select("id", "key", "n", F.coalesce("_after", "_border").alias("next_key"))


def fingerprint_versions(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness (see the query's contract).

    Edited form: the last third of the code points replaced by as many from the start of the next document.
    """
    source = docs.select(
        F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")
    ).withColumn("key", row_key("id", "text"))
    # Both joins take the same two columns, so the texts are shuffled once.
    texts = source.select("key", "text")
    chain = spooled(with_successor(source.select("id", "key", F.char_length("text").alias("n")).distinct()))
    asked = chain.select(F.col("next_key").alias("key"), F.col("key").alias("asker"), "id", F.floor(F.col("n") / 3).cast("int").alias("take"))
    given = (
        once(texts.join(asked, "key"), ["asker", "id"], head=F.expr("substring(text, 1, take)"), after=paragraphs(F.col("text")))
        .withColumnRenamed("asker", "key")
        .dropDuplicates(["key"])
    )
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 3) as int))"), F.col("head"))
    joined = once(texts.join(given, "key"), ["id", "text", "after"], edited=edited)
    rows = once(
        joined,
        ["id"],
        n_chars=F.char_length("text"),
        own=paragraphs(F.col("text")),
        changed=paragraphs(F.col("edited")),
        after=F.col("after"),
        edited_sha256=F.sha2("edited", 256),
    )
    return rows.select(
        F.col("id").alias(id_column),
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("after")).alias("near_next"),
    )

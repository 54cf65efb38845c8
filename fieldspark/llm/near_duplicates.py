"""Near-duplicate classes from bottom-k sketches of word shingles.

1. One hash function maps every distinct shingle of ``SHINGLE`` words to 64 bits; the k smallest values are a text's
   sketch. Texts with equal shingle sets are one representative from here on, so exact copies never meet as pairs.
2. Inverted lists: a retained value lists the representatives that hold it. Two sets over the threshold share at
   least half of their retained values (all but about one pair in 10^5 at the threshold itself, where k = 64), so only
   the rarest values of a sketch need a list: as many as it takes to meet every partner that shares half of the rest.
3. Every list first compares its members with one hub; members that a verified link has joined need no further
   comparison. Only lists that still hold several components go on, with a share of hubs that grows by GROWTH
   per round up to all members. A list of n copies costs about n comparisons; no link between components is lost.
   For members of lists of more than LARGE the full sets are split first: shingles with at most RARE holders among
   them give their pairs directly, at most RARE per shingle; without such a pair only the common shingles can be
   shared, and members with too few of them for any partner leave the list. Both bounds are exact.
4. A compared pair passes a size filter, then the estimate over the bottom k of the union of both sketches, then the
   exact Jaccard similarity of the full sets.
5. Components are found by repeated large-star and small-star steps over the links.

Defined cases: NULL, empty and blank texts have an empty set and stay alone; texts with fewer words than a shingle have
their whole sequence as the one shingle; repeated rows and ties are in one class, whose id is the smallest id; rows with
a NULL id stay alone with a NULL class and are kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.llm.text import attach, durable, free_name, release, row_key, ship, spooled, text_blocks

SHINGLE = 5
SKETCH = 64
PERCENT = 75
# Hubs of a list in the first round after the star; every later round takes GROWTH times as many.
HUBS = 8
GROWTH = 64
# Lists with more members are split by common and rare shingles; a rare one has at most RARE holders.
LARGE = 64
RARE = 16
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(texts: list[bytes | None], width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    cut = [t.lower().split() if t else [] for t in texts]
    flat = [w for words in cut for w in words]
    code = np.fromiter(map(xxhash.xxh3_64_intdigest, flat), dtype=np.uint64, count=len(flat))
    full = np.zeros(max(0, len(code) - width + 1), dtype=np.uint64)
    for k in range(width):
        full = full * _FACTOR + code[k : k + len(full)]
    full = _mix(full)
    out, at = [], 0
    for words in cut:
        n = len(words)
        if n >= width:
            out.append(np.unique(full[at : at + n - width + 1]))
        elif n:
            short = np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], dtype=np.uint64)
            out.append(_mix(short))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += n
    return out


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *[len(a) for a in arrays]])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, texts in text_blocks(batch, "_text"):
                sets = shingle_hashes(texts)
                digests = [blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                # Spark compares signed numbers, so the sketch holds the smallest signed values.
                sketches = [np.sort(s.view(np.int64))[:k].view(np.uint64) if len(s) > k else s for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(start, end - start), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), _lists(sketches)],
                    names=["id", "n", "digest", "sketch"],
                )

    return run


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, end, texts in text_blocks(batch, "_text"):
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(start, end - start), _lists(shingle_hashes(texts))], names=["id", "shingles"])


def signatures(docs: DataFrame, id_column: str, text_column: str, k: int = SKETCH) -> DataFrame:
    """id, number of distinct shingles, digest of the set and its bottom-k sketch."""
    ship(docs.sparkSession)
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("_text"))
    schema = T.StructType([source.schema["id"], T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("sketch", T.ArrayType(T.LongType()))])
    return source.mapInArrow(_signatures(k), schema)


def inverted_lists(sketches: DataFrame) -> DataFrame:
    """(value, id, n) for the rarest shared values of each sketch; a value with one holder is left out.

    Of s retained values at least ceil(s / 2) are shared with a partner, so of the s - ceil(s / 2) + 1 rarest at
    least one is. Values with one holder are the rarest and take up their part of these places.
    """
    entries = sketches.select("id", "n", F.size("sketch").alias("s"), F.explode("sketch").alias("value"))
    held = entries.groupBy("value").agg(F.count("*").alias("holders")).filter("holders > 1")
    shared = entries.join(held, "value").groupBy("id", "n", "s").agg(F.sort_array(F.collect_list(F.struct("holders", "value"))).alias("values"))
    places = F.col("s") - F.ceil(F.col("s") / 2) + 1 - (F.col("s") - F.size("values"))
    rare = shared.filter(places > 0).select("id", "n", F.explode(F.slice("values", F.lit(1), places.cast("int"))).alias("v"))
    return rare.select(F.col("v.value").alias("value"), "id", "n")


def _close(a: str, b: str, percent: int) -> Column:
    """The estimate over the union's bottom k, with a margin of about four and a half standard errors (k = 64)."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return 3 * 100 * both >= 2 * percent * F.size(union)


def _settled(edges: DataFrame) -> bool:
    """Whether edges (u, v), v < u, are stars: every u has one v, which is no u itself. Then v is the least of its component."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.union(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out > 1 or out = 1 and into = 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that is reachable over links (a, b), for all ids but these smallest ones."""
    edges = spooled(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    while not _settled(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: neighbours above a node move to the least of its neighbourhood.
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # Small star: neighbours below a node move to the least of them.
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(down, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = spooled(moved.union(down.select("u", F.col("m").alias("v"))).distinct())
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def joined_labels(labels: DataFrame | None, merged: DataFrame) -> DataFrame:
    """``labels`` (id, component) after its components have been ``merged``, itself (id, component) over components and single ids."""
    if labels is None:
        return merged
    target = merged.select(F.col("id").alias("component"), F.col("component").alias("_to"))
    moved = labels.join(target, "component", "left").select("id", F.coalesce("_to", "component").alias("component"))
    # The smallest id of a component has no label yet, so no id is in both parts.
    return spooled(moved.union(merged))


def _enough(shared: Column, percent: int) -> Column:
    """Whether ``shared`` common shingles of sets of ``n`` and ``hn`` reach the threshold."""
    return 100 * shared >= percent * (F.col("n") + F.col("hn") - shared)


def _alike_sizes(percent: int) -> Column:
    return 100 * F.least("n", "hn") >= percent * F.greatest("n", "hn")


def split_large_lists(lists: DataFrame, full: DataFrame, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """``lists`` with ``c`` and ``own``, less members that no common shingles can link there, and the pairs (a, b) that share rare ones.

    The shingles of all members of large lists are common (more than RARE holders among them) or rare. Two members
    without a shared rare shingle have at most the smaller of their counts ``c`` of common shingles in common. All others
    meet in the list of a rare shingle, which has at most RARE members. ``own`` are the lists that an id is left in. Both
    columns are NULL for ids in no large list.
    """
    large = lists.groupBy("value").agg(F.count("*").alias("size")).filter(F.col("size") > LARGE)
    members = spooled(lists.join(large.select("value"), "value", "left_semi").select("id", "n").distinct())
    if members.isEmpty():
        return lists.withColumn("c", F.lit(None).cast("long")).withColumn("own", F.lit(None).cast("array<bigint>")), None
    ids = members.select("id").distinct()
    rows = full.join(ids, "id").select("id", F.explode("shingles").alias("g"))
    held = rows.groupBy("g").agg(F.count("*").alias("holders")).filter("holders > 1")
    shared = spooled(rows.join(held, "g"))
    common = shared.filter(F.col("holders") > RARE).groupBy("id").agg(F.count("*").alias("c"))
    counts = spooled(ids.join(common, "id", "left").select("id", F.coalesce("c", F.lit(0).cast("long")).alias("c")))

    rare = shared.filter(F.col("holders") <= RARE).select("id", "g").join(members, "id").join(counts, "id")
    partners = rare.select("g", F.col("id").alias("h"), F.col("n").alias("hn"), F.col("c").alias("hc"))
    most = F.least("c", "hc")
    met = rare.join(partners, "g").filter((F.col("id") < F.col("h")) & _alike_sizes(percent) & ~_enough(most, percent))
    met = met.groupBy("id", "h", "n", "hn", most.alias("most")).agg(F.count("*").alias("r"))
    pairs = met.filter(_enough(F.col("most") + F.col("r"), percent)).select(F.col("id").alias("a"), F.col("h").alias("b")).distinct()

    # A set of n needs percent of its own shingles in common with anything, and more with a partner of least_n.
    counted = spooled(lists.join(counts, "id", "left"))
    able = 100 * F.col("c") >= percent * F.col("n")
    bounds = counted.groupBy("value").agg(F.min(F.when(able, F.col("n"))).alias("least_n"), F.max(F.col("c").isNull()).alias("mixed"))
    fits = able & ((100 + percent) * F.col("c") >= percent * (F.col("n") + F.col("least_n")))
    kept = spooled(counted.join(bounds, "value").filter(F.col("mixed") | fits).select("value", "id", "n", "c"))
    own = kept.filter("c is not null").groupBy("id").agg(F.collect_set("value").alias("own"))
    return kept.join(own, "id", "left").select("value", "id", "n", "c", "own"), spooled(pairs)


def _reachable(percent: int) -> Column:
    """Whether sizes, and for two members of large lists their common shingles, leave room for the threshold here.

    Such members are paired only in the first list that they share: once it is no longer open, it has joined them.
    """
    bound = F.col("c").isNull() | F.col("hc").isNull() | _enough(F.least("c", "hc"), percent)
    first = F.col("own").isNull() | F.col("hown").isNull() | (F.col("value") == F.array_min(F.array_intersect("own", "hown")))
    return _alike_sizes(percent) & bound & first


def _verified(pairs: DataFrame, reps: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that pass the estimate and then the exact similarity of the full sets, with their other columns.

    Only the sketches and sets of ids that stand in a pair are moved: both tables are cut by the list of these ids, which
    is broadcast if it is small, before they are shuffled to the pairs.
    """
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    pairs = spooled(pairs)
    ids = durable(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    found = pairs
    for column in ("a", "b"):
        sketches = attach(reps.select("id", "sketch"), ids, ["id"], "left_semi")
        found = found.join(sketches.select(F.col("id").alias(column), F.col("sketch").alias(f"s{column}")), column)
    found = found.filter(_close("sa", "sb", percent)).select("a", "b", *rest)
    for column in ("a", "b"):
        sets = attach(full, ids, ["id"], "left_semi")
        found = found.join(sets.select(F.col("id").alias(column), F.col("shingles").alias(f"s{column}")), column)
    both = F.size(F.array_intersect("sa", "sb"))
    found = found.select("a", "b", *rest, both.alias("i"), (F.size("sa") + F.size("sb") - both).alias("u"))
    found = spooled(found.filter(100 * F.col("i") >= percent * F.col("u")).select("a", "b", *rest))
    release(pairs, ids)
    return found


def verified_links(lists: DataFrame, reps: DataFrame, full: DataFrame, percent: int) -> DataFrame | None:
    """(id, component) of the representatives in components of two or more."""
    lists, rare_pairs = split_large_lists(lists, full, percent)
    members = spooled(lists)
    labels, floor, share = None, 0.0, HUBS
    if rare_pairs is not None and not rare_pairs.isEmpty():
        found = _verified(rare_pairs, reps, full, percent)
        if not found.isEmpty():
            labels = components(found)
    first = True
    # The hub of the star holds mostly common shingles, so that it lies in the middle of a group of copies.
    place = F.struct((-F.coalesce(F.col("c"), F.lit(0)) / F.col("n")).alias("rest"), "id", "n", "c", "own", "k")
    while True:
        if labels is None:
            held = members.withColumn("k", F.col("id"))
        else:
            held = members.join(labels, "id", "left").select("value", "id", "n", "c", "own", F.coalesce("component", "id").alias("k"))
        open_lists = held.groupBy("value").agg(F.count("*").alias("size"), F.min("k").alias("lo"), F.max("k").alias("hi"), F.min(place).alias("hub"))
        open_lists = spooled(open_lists.filter("lo != hi").drop("lo", "hi"))
        largest = open_lists.agg(F.max("size")).first()[0]
        if largest is None:
            return labels
        held = spooled(held.join(open_lists.select("value", "size"), "value"))
        if first:
            chosen, turn = open_lists.select("value", "hub.*"), F.col("id") != F.col("h")
        else:
            # A hash of the member decides in which round it is a hub, so no list has to be ranked. The earlier hub
            # of two members forms their pair.
            lot, hub_lot = (F.pmod(F.xxhash64(name), F.lit(1 << 30)) / float(1 << 30) for name in ("id", "h"))
            turn = (hub_lot < lot) | ((hub_lot == lot) & (F.col("h") < F.col("id")))
            chosen = held.filter((lot * F.col("size") < share) & (lot * F.col("size") >= floor))
        hubs = chosen.select("value", F.col("id").alias("h"), F.col("n").alias("hn"), F.col("c").alias("hc"), F.col("own").alias("hown"), F.col("k").alias("hk"))
        pairs = (
            held.join(hubs, "value")
            .filter((F.col("k") != F.col("hk")) & turn & _reachable(percent))
            .select(F.least("id", "h").alias("a"), F.greatest("id", "h").alias("b"), F.least("k", "hk").alias("ka"), F.greatest("k", "hk").alias("kb"))
            .distinct()
        )
        found = _verified(pairs, reps, full, percent)
        release(open_lists)
        if not found.isEmpty():
            # Only the components that these links join are searched, not the links of earlier rounds again.
            labels = joined_labels(labels, components(found.select(F.col("ka").alias("a"), F.col("kb").alias("b"))))
        if first:
            first = False
        else:
            if share >= largest:
                return labels
            floor, share = share, share * GROWTH
        members = held.select("value", "id", "n", "c", "own")


def near_duplicate_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = PERCENT, k: int = SKETCH) -> DataFrame:
    """One row per row of ``docs``: the id, n_shingles, component_id and kept (it is the id of its class)."""
    marked = spooled(signatures(docs, id_column, text_column, k))
    sets = marked.filter("n > 0 and id is not null")
    reps = spooled(sets.groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    lists = spooled(inverted_lists(reps))
    suspects = spooled(lists.select("id").distinct())
    chosen = attach(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("_text")).filter("id is not null"), suspects, ["id"], "left_semi")
    schema = T.StructType([chosen.schema["id"], T.StructField("shingles", T.ArrayType(T.LongType()))])
    full = spooled(chosen.mapInArrow(_full_sets, schema))
    # A repeated id may stand for several texts; only its representative's set counts.
    labels = verified_links(lists, reps, full, percent)
    groups = reps.select("digest", "id")
    if labels is not None:
        groups = groups.join(labels, "id", "left").select("digest", F.coalesce("component", "id").alias("c"))
    else:
        groups = groups.select("digest", F.col("id").alias("c"))
    joined = marked.select("id", "n", "digest").join(groups, "digest", "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("c")).otherwise(F.col("id"))
    return joined.select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        (F.col("id").isNull() | (F.col("id") == component)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each class, with all columns: that of the smallest id, a NULL id last; texts without words all stay.

    Rows are told apart by a digest of id and text, so rows with a NULL or repeated id are judged too; of rows that are
    equal in both, one stays.
    """
    key = free_name(docs, "_key_of_row")
    keyed = docs.withColumn(key, row_key(id_column, text_column))
    classes = near_duplicate_classes(keyed.select(key, text_column), key, text_column).filter("n_shingles > 0")
    rows = classes.select(F.col(key), "component_id").groupBy(key).agg(F.first("component_id").alias("component_id"), F.count("*").alias("held"))
    named = keyed.select(key, F.col(id_column).alias("id")).groupBy(key).agg(F.first("id").alias("id"))
    rows = spooled(rows.join(named, key))
    best = rows.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col(key).alias("key"))).alias("best"))
    rest = free_name(docs, "_held_by_row")
    verdicts = rows.join(best, "component_id").select(key, F.when(F.col("best.key") == F.col(key), F.col("held")).otherwise(0).alias(rest))
    # Most rows are the only ones of their class and need no verdict.
    judged = attach(keyed, spooled(verdicts.filter(F.col(rest) != 1)), [key], "left")
    one = judged.filter(F.col(rest) > 1).dropDuplicates([key])
    return judged.filter(F.col(rest).isNull()).unionByName(one).select(*docs.columns)



"""Merkle manifest of a dataset, its subtrees stored in van Emde Boas layout.

1. A row is a leaf: the SHA-256 of its fields, each with its length. Leaves of a group (language) are numbered by id through
   range partitions, so a group of any size is spread over many tasks.
2. Aligned runs of FANOUT^HEIGHT leaves are blocks. A block's task builds its subtree and stores all its digests as one
   value in van Emde Boas layout: the tree is cut at half its height, the top part is stored first, then the bottom parts
   from left to right, each in turn by the same rule. Addresses come from arithmetic alone, for storing a node, for
   reading its children and for reading its siblings; a path to the root thus crosses few stretches of memory or of a
   file, whatever their size.
3. The roots of the blocks are the leaves of the next tier of blocks, until a group has one block, whose root is the
   group's. The groups' roots, in order, are the leaves of a last tree, whose root is that of the dataset.
4. Paths run down from the last tree: every block gets the siblings above its root by a join with the tier above, so
   a leaf's proof is made where its block is, and no path of a leaf is ever stored or shuffled.

Every FANOUT consecutive nodes (the last run: what is left, even one) become the digest of their concatenated hex digests
while there is more than one node; a single leaf is its own root.

Defined cases: a NULL field is written "-", a NULL group comes first and is a group of its own; a NULL id comes before all
others; rows with equal ids are ordered by their leaf and repeated rows are repeated leaves; empty and very long texts
are hashed as they are; a lone row has an empty proof; an empty table gives an empty result; columns that are not among
the hashed ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.llm.text import ascii_lower, attach, remainder, ship, spooled
from fieldspark.operators.ordered import number_rows

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 8
HEIGHT = 3
BLOCK = FANOUT**HEIGHT
# Leaves of a range partition in which they are numbered, where there are more than the session's partitions.
RUN_ROWS = 1_000_000
_SIZE = 32


def tree_size(levels: int) -> int:
    """Nodes of a full tree with this many levels."""
    return (FANOUT**levels - 1) // (FANOUT - 1)


def addresses(level: int, index: np.ndarray, levels: int) -> np.ndarray:
    """Places of the nodes ``index`` of a level in the van Emde Boas layout of a full tree."""
    if levels == 1:
        return np.zeros_like(index)
    top = levels // 2
    if level < top:
        return addresses(level, index, top)
    below, bottom = FANOUT ** (level - top), levels - top
    return tree_size(top) + (index // below) * tree_size(bottom) + addresses(level - top, index % below, bottom)


@lru_cache(maxsize=16)
def _level_addresses(level: int, levels: int) -> tuple[int, ...]:
    return tuple(addresses(level, np.arange(FANOUT**level), levels).tolist())


def block_height(n: int) -> int:
    """Levels above the leaves of a block in a tree of n leaves: all of HEIGHT unless the block is the whole tree."""
    height = 0
    while FANOUT**height < min(n, BLOCK):
        height += 1
    return height


def digest_of(children: Sequence[bytes]) -> bytes:
    return sha256("".join(c.hex() for c in children).encode()).digest()


class Subtree:
    """The digests of one block, by level (0: its root) and index, in one stretch of bytes."""

    def __init__(self, height: int, count: int, nodes: bytes | bytearray):
        self.height, self.nodes = height, nodes
        self.counts = [-(-count // FANOUT ** (height - d)) for d in range(height + 1)]

    @classmethod
    def built(cls, leaves: Sequence[bytes], height: int) -> Subtree:
        tree = cls(height, len(leaves), bytearray(_SIZE * tree_size(height + 1)))
        for k, leaf in enumerate(leaves):
            tree.put(height, k, leaf)
        for level in range(height - 1, -1, -1):
            for k in range(tree.counts[level]):
                tree.put(level, k, digest_of(tree.run(level + 1, k * FANOUT)))
        return tree

    def put(self, level: int, index: int, digest: bytes) -> None:
        at = _SIZE * _level_addresses(level, self.height + 1)[index]
        self.nodes[at : at + _SIZE] = digest

    def get(self, level: int, index: int) -> bytes:
        at = _SIZE * _level_addresses(level, self.height + 1)[index]
        return bytes(self.nodes[at : at + _SIZE])

    def run(self, level: int, index: int) -> list[bytes]:
        """All nodes of the run that a node belongs to."""
        first = index - index % FANOUT
        return [self.get(level, k) for k in range(first, min(first + FANOUT, self.counts[level]))]

    def path(self, index: int) -> bytes:
        """For every level from a leaf up to the root: place in the run, length of the run, and the digests of the others."""
        out = bytearray()
        for level in range(self.height, 0, -1):
            run, own = self.run(level, index), index % FANOUT
            out += bytes((own, len(run))) + b"".join(run[:own] + run[own + 1 :])
            index //= FANOUT
        return bytes(out)


def path_steps(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """Place in the run and the digests of the others, level by level."""
    at = 0
    while at < len(path):
        own, size = path[at], path[at + 1]
        others = [path[k : k + _SIZE] for k in range(at + 2, at + 2 + _SIZE * (size - 1), _SIZE)]
        yield own, others
        at += 2 + _SIZE * (size - 1)


def folded(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and the siblings on its path lead to."""
    for own, others in path_steps(path):
        leaf = digest_of([*others[:own], leaf, *others[own:]])
    return leaf


def proof_digest(path: bytes) -> bytes:
    return digest_of([d for _, others in path_steps(path) for d in others])


def row_digest(fields: Sequence[Column]) -> Column:
    """SHA-256, as binary, of fields written as their UTF-8 length, a colon and their text, or "-" for NULL."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def leaf_rows(docs: DataFrame, fields: Sequence[str] = FIELDS, id_column: str = "doc_id", group_column: str = "lang", text_column: str = "text") -> DataFrame:
    """tree (the group, NULL first), id, leaf, and ``altered``: the leaf after tampering, for the ids that are tampered with."""
    tree = F.coalesce(F.concat(F.lit("="), F.col(group_column).cast("string")), F.lit("-"))
    changed = [ascii_lower(F.col(c)) if c == text_column else F.col(c) for c in fields]
    altered = F.when(remainder(id_column, 3) == 0, row_digest(changed))
    return docs.select(tree.alias("tree"), F.col(id_column).alias("id"), row_digest([F.col(c) for c in fields]).alias("leaf"), altered.alias("altered"))


@dataclass
class Manifest:
    """Tiers of blocks, lowest first, of the groups' trees and of the tree over the groups; ``leaves`` are blocks too.

    A block has tree, block (its number), n (leaves of the whole tree), count, nodes (van Emde Boas layout) and root; those of
    ``leaves`` also the ids and altered leaves of their rows.
    """

    leaves: DataFrame
    tiers: list[DataFrame]
    groups: DataFrame  # tree, pos: the groups in order
    group_tiers: list[DataFrame]
    root: bytes | None

    def blocks(self) -> DataFrame:
        """All blocks of all tiers in one table, with ``scope`` (group or dataset) and ``tier``."""
        columns = ["tree", "block", "n", "count", "nodes", "root"]
        every = [("group", k, t) for k, t in enumerate([self.leaves, *self.tiers])] + [("dataset", k, t) for k, t in enumerate(self.group_tiers)]
        parts = [t.select(F.lit(scope).alias("scope"), F.lit(k).alias("tier"), *columns) for scope, k, t in every]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


def _build(keep: list[tuple[str, pa.DataType]]):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by("pos")
        n = rows.column("n")[0].as_py()
        tree = Subtree.built(rows.column("leaf").to_pylist(), block_height(n))
        values = {
            "tree": pa.array([key[0].as_py()], pa.string()),
            "block": pa.array([key[1].as_py()], pa.int64()),
            "n": pa.array([n], pa.int64()),
            "count": pa.array([len(rows)], pa.int32()),
            "nodes": pa.array([bytes(tree.nodes)], pa.binary()),
            "root": pa.array([tree.get(0, 0)], pa.binary()),
        }
        values |= {name: pa.array([rows.column(name).to_pylist()], pa.list_(kind)) for name, kind in keep}
        return pa.table(values)

    return run


def build_blocks(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Blocks of the numbered leaves ``rows`` (tree, pos, n, leaf), with lists of the ``keep`` columns."""
    from pyspark.sql.pandas.types import to_arrow_type

    schema = T.StructType().add("tree", "string").add("block", "long").add("n", "long").add("count", "integer").add("nodes", "binary").add("root", "binary")
    for name in keep:
        schema = schema.add(name, T.ArrayType(rows.schema[name].dataType))
    kinds = [(name, to_arrow_type(rows.schema[name].dataType)) for name in keep]
    grouped = rows.withColumn("block", F.floor(F.col("pos") / BLOCK)).groupBy("tree", "block")
    return spooled(grouped.applyInArrow(_build(kinds), schema))


def build_tiers(blocks: DataFrame) -> list[DataFrame]:
    """The tiers above ``blocks``: blocks of the roots of the blocks below, for trees with more than one of these."""
    tiers = []
    largest = blocks.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    below = blocks
    while largest > BLOCK:
        largest = -(-largest // BLOCK)
        rows = below.filter(F.col("n") > BLOCK).select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("root").alias("leaf"))
        below = build_blocks(rows)
        tiers.append(below)
    return tiers


def tree_roots(tiers: Sequence[DataFrame]) -> DataFrame:
    """(tree, root): the root of the one block that a tree ends in."""
    parts = [t.filter(F.col("n") <= BLOCK).select("tree", "root") for t in tiers]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """The stored ``rows`` with pos, the place in the tree from 0, and n, the leaves of the tree."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // RUN_ROWS)
    kept = [c for c in rows.columns if c != "tree"]
    return number_rows(rows, ["tree"], order, parts).select("tree", *kept, (F.col("_rn") - 1).alias("pos"), F.col("_n").alias("n"))


def build_manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_column: str = "doc_id", group_column: str = "lang", text_column: str = "text") -> Manifest:
    """The stored manifest of a table."""
    ship(docs.sparkSession)
    rows = spooled(leaf_rows(docs, fields, id_column, group_column, text_column))
    leaves = build_blocks(_numbered(rows, ["id", "leaf"]), keep=["id", "altered"])
    tiers = build_tiers(leaves)
    subroots = tree_roots([leaves, *tiers]).select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("leaf"))
    numbered = spooled(_numbered(spooled(subroots), ["name"]))
    top = build_blocks(numbered)
    group_tiers = [top, *build_tiers(top)]
    found = tree_roots(group_tiers).first()
    groups = numbered.select(F.col("name").alias("tree"), "pos", F.col("leaf").alias("subroot"))
    return Manifest(leaves, tiers, groups, group_tiers, bytes(found["root"]) if found else None)


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tree, pos, path) of every leaf of a block, down from the block's own ``above``."""
    for batch in batches:
        for row in batch.to_pylist():
            tree = Subtree(block_height(row["n"]), row["count"], row["nodes"])
            first = row["block"] * BLOCK
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["tree"]] * row["count"], pa.string()),
                    pa.array(range(first, first + row["count"]), pa.int64()),
                    pa.array([tree.path(k) + row["above"] for k in range(row["count"])], pa.binary()),
                ],
                names=["tree", "pos", "path"],
            )


def _walked_down(tiers: Sequence[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, block, above) of the blocks of the lowest of ``tiers``; (tree, above) is given for whole trees."""
    paths = None
    for tier in reversed(tiers):
        own = attach(tier.filter(F.col("n") <= BLOCK), above, ["tree"])
        if paths is not None:
            lower = tier.filter(F.col("n") > BLOCK).join(paths.select("tree", F.col("pos").alias("block"), F.col("path").alias("above")), ["tree", "block"])
            own = own.unionByName(lower)
        paths = spooled(own.select("tree", "block", "n", "count", "nodes", "above").mapInArrow(_paths, "tree string, pos long, path binary")) if tier is not tiers[0] else own
    return paths


def _audited(id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                tree = Subtree(block_height(row["n"]), row["count"], row["nodes"])
                leaves = [tree.get(tree.height, k) for k in range(row["count"])]
                paths = [tree.path(k) + row["above"] for k in range(row["count"])]
                ends = [folded(a or leaf, p) for a, leaf, p in zip(row["altered"], leaves, paths, strict=True)]
                hexed = [[d.hex() for d in leaves], [row["subroot"].hex()] * len(leaves), [row["top"].hex()] * len(leaves), [proof_digest(p).hex() for p in paths], [d.hex() for d in ends]]
                columns = [pa.array(row["id"], id_type), *[pa.array(h, pa.string()) for h in hexed], pa.array([d == row["top"] for d in ends])]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return run


def audit(manifest: Manifest, id_column: str = "doc_id") -> DataFrame:
    """Per row: its leaf, the roots, the digest of its proof, and the root that the (tampered) leaf leads to."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = manifest.leaves.sparkSession
    start = spark.range(1).select(F.lit("").alias("tree"), F.lit(b"").alias("above"))
    paths = _walked_down(manifest.group_tiers, start).select("tree", "block", "n", "count", "nodes", "above")
    paths = paths.mapInArrow(_paths, "tree string, pos long, path binary").select("pos", F.col("path").alias("above"))
    above = spooled(manifest.groups.join(paths, "pos").select("tree", "above"))
    leaves = _walked_down([manifest.leaves, *manifest.tiers], above)
    rooted = attach(leaves, manifest.groups.select("tree", "subroot"), ["tree"]).withColumn("top", F.lit(manifest.root).cast("binary"))
    kind = manifest.leaves.schema["id"].dataType.elementType
    schema = T.StructType().add("id", kind)
    for name in ("leaf", "subroot", "root", "proof_sha256", "folded_root"):
        schema = schema.add(name, "string")
    out = rooted.select("n", "count", "nodes", "id", "altered", "above", "subroot", "top").mapInArrow(_audited(to_arrow_type(kind)), schema.add("verified", "boolean"))
    return out.withColumnRenamed("id", id_column)


def audit_sql(fields: Sequence[str] = FIELDS, levels: int = 8) -> str:
    """Level by level, for up to FANOUT^levels leaves a group and as many groups."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def hashed(tampered: bool) -> str:
        parts = []
        for f in fields:
            value = f"CAST({f} AS VARCHAR)"
            if tampered and f == "text":
                value = f"translate({value}, '{upper}', '{upper.lower()}')"
            parts.append(f"coalesce(octet_length(encode({value})) || ':' || {value}, '-')")
        return f"sha256({' || '.join(parts)})"

    # CRC-32 of the decimal id: polynomial 0xEDB88320, bit by bit, over the bytes of its digits.
    bit = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
    step = "xor(c, CAST(ascii(ch) AS BIGINT))"
    crc = f"""
crc0 AS (SELECT id, CAST(id AS VARCHAR) AS s, 1 AS k, CAST(4294967295 AS BIGINT) AS c FROM (SELECT DISTINCT doc_id AS id FROM documents WHERE doc_id IS NOT NULL)),
crc(id, s, k, c, b) AS (
  SELECT id, s, k, c, 0 FROM crc0
  UNION ALL
  SELECT id, s, CASE WHEN b = 7 THEN k + 1 ELSE k END, {bit.format("v")}, (b + 1) % 8
  FROM (SELECT id, s, k, b, CASE WHEN b = 0 THEN {step.replace("ch", "substr(s, k, 1)")} ELSE c END AS v FROM crc WHERE k <= length(s))),
tamper AS (SELECT id, xor(c, 4294967295) % 3 = 0 AS hit FROM crc WHERE k = length(s) + 1)"""
    climb = []
    for tree, first in (("g", "SELECT tree, pos, h, count(*) OVER (PARTITION BY tree) AS n FROM leaf"), ("t", "SELECT 0 AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, h, count(*) OVER () AS n FROM groot")):
        climb.append(f"{tree}0 AS ({first})")
        for k in range(1, levels + 1):
            climb.append(
                f"{tree}{k} AS (SELECT tree, pos // {FANOUT} AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h, CAST(ceil(any_value(n) / {FANOUT}) AS BIGINT) AS n "
                f"FROM {tree}{k - 1} WHERE n > 1 GROUP BY tree, pos // {FANOUT})"
            )
        ends = " UNION ALL ".join(f"SELECT tree, h FROM {tree}{k} WHERE n = 1" for k in range(levels + 1))
        climb.append(f"{tree}root AS ({ends})")
    # One row per leaf: its place, what its proof holds so far and where its folding stands.
    fold = ["up0 AS (SELECT rid, tree, pos, '' AS proof, coalesce(altered, h) AS cur FROM leaf)"]
    at = 0
    for tree in ("g", "t"):
        if tree == "t":
            fold.append(f"up{at + 1} AS (SELECT rid, tree, 0 AS pos, proof, cur FROM up{at})")
            at += 1
        for k in range(levels):
            place = "u.pos" if tree == "g" else f"r.pos // {FANOUT**k}"
            join = f"JOIN {tree}{k} x ON x.tree = u.tree AND x.pos // {FANOUT} = u.pos // {FANOUT}" if tree == "g" else (
                f"JOIN order_of r ON r.name = u.tree JOIN {tree}{k} x ON x.pos // {FANOUT} = r.pos // {FANOUT ** (k + 1)}"
            )
            grown = (
                f"SELECT u.rid, any_value(u.tree) AS tree, any_value(u.pos) // {FANOUT} AS pos, any_value(u.proof) || coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos <> {place}), '') AS proof, "
                f"sha256(string_agg(CASE WHEN x.pos = {place} THEN u.cur ELSE x.h END, '' ORDER BY x.pos)) AS cur FROM up{at} u {join} WHERE x.n > 1 GROUP BY u.rid"
            )
            fold.append(f"up{at + 1} AS (WITH grown AS ({grown}) SELECT * FROM grown UNION ALL SELECT * FROM up{at} WHERE rid NOT IN (SELECT rid FROM grown))")
            at += 1
    return f"""
WITH RECURSIVE {crc.strip()},
row_hash AS (
  SELECT doc_id, coalesce('=' || CAST(lang AS VARCHAR), '-') AS tree, {hashed(False)} AS h, CASE WHEN hit THEN {hashed(True)} END AS altered
  FROM documents LEFT JOIN tamper ON tamper.id = documents.doc_id),
leaf AS (
  SELECT row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, h) AS rid, doc_id, tree, h, altered, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM row_hash),
{", ".join(climb[: levels + 2])},
order_of AS (SELECT tree AS name, row_number() OVER (ORDER BY tree) - 1 AS pos FROM groot),
{", ".join(climb[levels + 2 :])},
{", ".join(fold)}
SELECT doc_id, leaf.h AS leaf, groot.h AS subroot, troot.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = troot.h AS verified
FROM leaf JOIN up{at} USING (rid) JOIN groot ON groot.tree = leaf.tree CROSS JOIN troot"""

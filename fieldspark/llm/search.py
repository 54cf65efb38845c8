"""Ranked lexical search: the Best Position Algorithm over impact lists.

1. The items of a block give the vocabulary, of bounded bytes; more items are searched in several blocks. Every whole text
   is cut once into terms, and its length and the counts of the vocabulary's terms are stored.
2. Spark adds up the number of texts N, their terms L and the document frequencies, which give weights and impacts.
3. Documents stay where they are: a task takes runs of documents of a bounded number of postings and lays out, for each
   term, the impact list of the run: postings by falling impact. Another order, by term and document, serves direct access.
4. Best Position Algorithm, for each item: sorted access goes down all lists of the item together. Each new document is
   looked up in all other lists, and every position it is found at is marked. A list's best position is the end of its
   run of marked positions from the top, which may lie far below the last one read. No unseen document can score more
   than the sum of the weighted impacts at the best positions; the search ends once that is strictly below the k-th score,
   so equal scores, which are ranked by id, are never cut off.
5. A task keeps the k best documents of an item over all its runs, whose k-th score ends later runs earlier, and sends
   only these. Spark ranks them; no list and no key is ever gathered as a whole.

Terms are maximal runs of ASCII letters, digits and all characters outside ASCII; only A-Z are lower-cased.

Defined cases: NULL, empty and blank texts have no term, are not counted and are never found; items without a term or with
unknown terms alone give no row; every row of ``queries`` is an item of its own, also with a repeated or NULL id; repeated
rows of ``docs`` count and are found as often as they occur; of equal scores the smaller id comes first, a NULL id last;
empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.llm.text import ship, spooled, text_blocks

K = 10
# UTF-8 bytes of the item texts of one block: bounds the vocabulary that every task holds.
ITEM_BYTES = 2_000_000
# Postings of one run of documents, and the depth of the first sorted accesses.
RUN_POSTINGS = 1_000_000
FIRST_DEPTH = 16
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_DOC_BITS, _IMPACT_BITS = 20, 20
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(raw: bytes | None) -> list[bytes]:
    """The terms of a text given as UTF-8, in order and with repeats."""
    return raw.translate(_FOLD).split() if raw else []


def _vectors(shared):
    """id, number of terms, and the known terms of each text with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            for start, end, texts in text_blocks(batch, "text"):
                sizes, found, counts = [], [], []
                for raw in texts:
                    words = terms_of(raw)
                    at = np.fromiter((get(w, -1) for w in words), dtype=np.int32, count=len(words))
                    known, times = np.unique(at[at >= 0], return_counts=True)
                    sizes.append(len(words))
                    found.append(known)
                    counts.append(times.astype(np.int32))
                ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                flat = [pa.array(np.concatenate(x) if x else [], pa.int32()) for x in (found, counts)]
                lists = [pa.ListArray.from_arrays(ends, x) for x in flat]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(start, end - start), pa.array(sizes, pa.int64()), *lists], names=["id", "n", "terms", "counts"])

    return run


class ImpactLists:
    """The impact lists of one run of documents, numbered from 0, and direct access to them."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int):
        low = (1 << _IMPACT_BITS) - 1
        order = np.sort((term << (_DOC_BITS + _IMPACT_BITS)) | ((low - impact) << _DOC_BITS) | doc)
        self.doc = order & ((1 << _DOC_BITS) - 1)
        self.impact = low - ((order >> _DOC_BITS) & low)
        self.terms = order >> (_DOC_BITS + _IMPACT_BITS)
        places = (self.terms << _DOC_BITS) | self.doc
        self.at = np.argsort(places, kind="stable")
        self.places = places[self.at]
        self.met = np.zeros(n_docs, dtype=bool)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The up to k documents with the highest scores above 0 among those of at least ``floor``, and their scores."""
        start = np.searchsorted(self.terms, terms, "left")
        size = np.searchsorted(self.terms, terms, "right") - start
        held = size > 0
        terms, weights, start, size = terms[held], weights[held], start[held], size[held]
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(terms):
            return docs, scores
        offset = np.concatenate([[0], np.cumsum(size)[:-1]])
        marked = np.zeros(int(size.sum()), dtype=bool)
        upto = np.zeros(len(terms), dtype=np.int64)  # marked positions from the top of each list
        met, depth, step = [], 0, FIRST_DEPTH
        while True:
            read = np.concatenate([self.doc[s + depth : s + min(depth + step, n)] for s, n in zip(start, size, strict=True) if n > depth])
            new = np.unique(read)
            new = new[~self.met[new]]
            self.met[new] = True
            met.append(new)
            wanted = (terms[:, None] << _DOC_BITS) | new[None, :]
            found = np.minimum(np.searchsorted(self.places, wanted), len(self.places) - 1)
            hit = self.places[found] == wanted
            place = self.at[found]
            value = (np.where(hit, self.impact[place], 0) * weights[:, None]).sum(0)
            marked[(place - start[:, None] + offset[:, None])[hit]] = True
            docs, scores = np.concatenate([docs, new]), np.concatenate([scores, value])
            if len(docs) > k:
                keep = np.lexsort((rank[docs], -scores))[:k]
                docs, scores = docs[keep], scores[keep]
            bound = 0
            for j, n in enumerate(size):
                rest = marked[offset[j] + upto[j] : offset[j] + n]
                ahead = int(rest.argmin()) if len(rest) else 0
                upto[j] = n if len(rest) and rest[ahead] else upto[j] + ahead
                if upto[j] < n:
                    bound += int(weights[j]) * int(self.impact[start[j] + upto[j] - 1])
            depth, step = depth + step, step * 2
            kth = int(scores.min()) if len(scores) == k else 0
            if bound < max(kth, floor, 1) or depth >= size.max():
                break
        self.met[np.concatenate(met)] = False
        good = scores >= max(1, floor)
        return docs[good], scores[good]


def _ordered(ids: list) -> np.ndarray:
    """The rank of each id, NULL last."""
    rank = np.empty(len(ids), dtype=np.int64)
    rank[sorted(range(len(ids)), key=lambda j: (ids[j] is None, ids[j] if ids[j] is not None else 0))] = np.arange(len(ids))
    return rank


def _search(shared, n_texts: int, n_terms: int, k: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, items = shared.value
        top: dict[int, list[tuple]] = {}

        def search_run(parts: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(parts).combine_chunks()
            terms, counts = (rows.column(c).chunk(0) for c in ("terms", "counts"))
            length = rows.column("n").to_numpy().astype(np.int64)
            tf = counts.flatten().to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(rows)), np.diff(terms.offsets.to_numpy()))
            m = 100 - 90 + (90 * length * n_texts) // n_terms
            impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
            lists = ImpactLists(doc, terms.flatten().to_numpy().astype(np.int64), impact, len(rows))
            ids = rows.column("id").to_pylist()
            rank = _ordered(ids)
            for item, own in items:
                best = top.setdefault(item, [])
                docs, scores = lists.best(own, weight[own], k, -best[-1][0] if len(best) == k else 0, rank)
                if len(docs):
                    best += [(-int(s), ids[d] is None, ids[d]) for d, s in zip(docs, scores, strict=True)]
                    best.sort(key=lambda b: (b[0], b[1], 0 if b[1] else b[2]))
                    del best[k:]

        held, postings = [], 0
        for batch in batches:
            sizes = np.cumsum(np.diff(batch.column("terms").offsets.to_numpy()))
            at = 0
            while at < batch.num_rows:
                before = sizes[at - 1] if at else 0
                # Every row has a posting, so a run has no more rows than a place in the lists can name.
                end = min(batch.num_rows, max(at + 1, int(np.searchsorted(sizes, before + RUN_POSTINGS - postings, "right"))))
                held.append(batch.slice(at, end - at))
                postings += int(sizes[end - 1] - before)
                at = end
                if postings >= RUN_POSTINGS or at < batch.num_rows:
                    search_run(held)
                    held, postings = [], 0
        if held:
            search_run(held)
        rows = [(item, *b) for item, best in top.items() for b in best]
        columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[3] for r in rows], id_type), pa.array([-r[1] for r in rows], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "id", "score"])

    return run


def _search_block(items: list[tuple[int, list[bytes]]], docs: DataFrame, k: int) -> DataFrame:
    """(item, id, score) of the best k documents of each task, for items whose terms are at hand."""
    context = docs.sparkSession.sparkContext
    number: dict[bytes, int] = {}
    own = [(item, np.array([number.setdefault(t, len(number)) for t in dict.fromkeys(terms)], dtype=np.int64)) for item, terms in items]
    schema = T.StructType([docs.schema["id"], T.StructField("n", T.LongType()), *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("terms", "counts")]])
    vectors = spooled(docs.mapInArrow(_vectors(context.broadcast(number)), schema).filter("n > 0"))
    n_texts, n_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    holders = np.zeros(len(number))
    # One row for each term of the vocabulary at most.
    for row in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        holders[row["term"]] = row["count"]
    weight = np.floor(1000 * np.log((2.0 * n_texts + 2) / (2.0 * holders + 1))).astype(np.int64)
    plan = context.broadcast((weight, [(item, terms) for item, terms in own if len(terms)]))
    kind = pa.schema([pa.field("id", _arrow_type(docs.schema["id"].dataType))]).field(0).type
    found = vectors.filter(F.size("terms") > 0).mapInArrow(
        _search(plan, int(n_texts), int(n_terms), k, kind), T.StructType([T.StructField("item", T.LongType()), docs.schema["id"], T.StructField("score", T.LongType())])
    )
    return found


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def search(
    queries: DataFrame,
    docs: DataFrame,
    k: int = K,
    item_column: str = "item_id",
    query_column: str = "text",
    id_column: str = "doc_id",
    text_column: str = "text",
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """Per row of ``queries`` its up to k best documents: the item's id, rank from 1, the document's id and its score."""
    spark = docs.sparkSession
    ship(spark)
    items = spooled(queries.select(F.monotonically_increasing_id().alias("item"), F.col(item_column).alias("name"), F.col(query_column).alias("text")))
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    volume = items.agg(F.coalesce(F.sum(F.octet_length("text") + 8), F.lit(0))).first()[0]
    blocks = max(1, -(-volume // item_bytes))
    found = None
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).select("item", "text").collect()
        part = [(r["item"], terms_of(r["text"].encode("utf-8", "surrogatepass") if r["text"] else None)) for r in rows]
        some = _search_block(part, source, k)
        found = some if found is None else found.union(some)
    by_item = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(by_item)).filter(F.col("rank") <= k)
    # At most k rows an item: the items' own ids are the larger side.
    return ranked.join(items.select("item", "name"), "item").select(F.col("name").alias(item_column), "rank", F.col("id").alias(id_column), "score")


def search_sql(k: int = K) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    terms = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{TERM}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {terms} AS ts FROM documents),
sized AS (SELECT rid, doc_id, len(ts) AS n FROM d WHERE len(ts) > 0),
total AS (SELECT CAST(count(*) AS BIGINT) AS texts, CAST(sum(n) AS BIGINT) AS terms FROM sized),
q AS (SELECT item, item_id, unnest(list_distinct(ts)) AS term FROM (SELECT row_number() OVER () AS item, item_id, {terms} AS ts FROM benchmark)),
post AS (
  SELECT rid, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT rid, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
weighed AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * texts + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM post, total GROUP BY term, texts),
norm AS (SELECT rid, doc_id, 100 - 90 + ((90 * n * texts) // terms) AS m FROM sized, total),
scored AS (
  SELECT item, item_id, doc_id, rid, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN weighed USING (term) JOIN post USING (term) JOIN norm USING (rid) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= {k}"""

"""Hidden Markov language model: Baum-Welch over partitions, exact scaled forward scores.

1. Words of all training texts are counted (each task adds up its own first). The most frequent words are symbols of
   their own; every other word belongs to a class named by a hash of its ending, and has the probability
   (c + 1) / (N_class + V_class + 1) in it. An end token closes every text.
2. Texts become symbol numbers once. Logarithms of at most ``HEAD`` most frequent words are at hand in every task (a table
   of bounded size, cut at a count that a histogram of the counts gives); the rarer ones are counted per text and joined
   with the whole count table.
3. Every Baum-Welch pass runs over all training texts and whole texts, in ``SLICES`` disjoint slices: tasks compute the
   expected counts of a slice by a scaled forward-backward pass, Spark adds them up, and they replace what the slice gave in
   the pass before; the model is improved from the sums over all slices after each one. So every text counts alike, and
   few passes bring many improvements. A long text is laid out in stretches of ``STRETCH`` tokens that are worked
   on side by side; the products of a stretch's transitions carry the forward and backward messages over the cuts, so
   the counts, those of the moves across a cut among them, are exactly those of the unbroken text.
4. Scoring runs the scaled forward recursion over the whole token sequence of every text.

Defined cases: NULL, empty and blank texts are the end token alone; words never seen in training have count 0 in both
scores; repeated rows count in training as often as they occur and get equal scores; rows with a NULL id are training
rows and not held out; an empty table gives an empty result, and without training rows all counts are 0; other columns
are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.llm.text import remainder, ship, spooled, text_blocks

STATES = 8
OWN = 2048
CLASSES = 254
HEAD = 100_000
LONGEST_HEAD_WORD = 64
PASSES = 2
SLICES = 10
STRETCH = 512
# Stretches of one table of forward messages.
SIDE_BY_SIDE = 400
COUNTED_WORDS = 100_000
END = b""  # no word is empty


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


@dataclass
class Model:
    first: np.ndarray  # (1, K): start of a text
    move: np.ndarray  # (K, K)
    emit: np.ndarray  # (symbols, K)


@dataclass
class Coding:
    """What a task needs to turn words into symbols and logarithms."""

    head: dict[bytes, int]
    log_count: np.ndarray  # log10(c + 1) of a head word
    symbol: np.ndarray
    class_log: np.ndarray  # log10 of the class totals
    end_log: float  # log10(c + 1) of the end token
    end_known: int
    symbol_count: np.ndarray  # training tokens of each symbol

    @property
    def n_symbols(self) -> int:
        return OWN + 1 + CLASSES


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter[bytes] = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "c"])

    for batch in batches:
        for _, _, texts in text_blocks(batch, "_text"):
            for raw in texts:
                found.update(raw.lower().split() if raw else ())
            found[END] += len(texts)
            if len(found) > COUNTED_WORDS:
                yield rows()
                found = Counter()
    if found:
        yield rows()


def word_counts(docs: DataFrame, text_column: str) -> DataFrame:
    """(word, c) over the words and end tokens of ``docs``; the end token is the empty word."""
    return docs.select(F.col(text_column).alias("_text")).mapInArrow(_counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def head_words(words: DataFrame, most: int = HEAD) -> list[tuple[bytes, int]]:
    """The most frequent words with their counts, at most ``most``, by falling count.

    A histogram of the counts, in eighths of an octave, says from which count on there are no more words than that, so
    a bounded number of rows is sent.
    """
    usable = words.filter(F.octet_length("word") <= LONGEST_HEAD_WORD).withColumn("step", F.floor(8 * F.log2("c")))
    least, total = None, 0
    for row in sorted(usable.groupBy("step").count().collect(), key=lambda r: -r["step"]):
        total += row["count"]
        if total > most:
            break
        least = row["step"]
    if least is None:
        return []
    return sorted(((bytes(r["word"]), r["c"]) for r in usable.filter(F.col("step") >= least).select("word", "c").collect()), key=lambda w: (-w[1], w[0]))


def build_coding(counts: DataFrame) -> Coding:
    words = counts.filter(F.col("word") != F.lit(END))
    top = head_words(words)
    suffix = F.expr("substring(word, greatest(1, octet_length(word) - 2), 3)")
    sums = words.groupBy((F.crc32(suffix) % CLASSES).alias("cls")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    total, tokens = np.ones(CLASSES), np.zeros(CLASSES)
    for r in sums:
        total[r["cls"]] += r["n"] + r["v"]
        tokens[r["cls"]] += r["n"]
    for w, c in top[:OWN]:
        total[word_class(w)] -= c + 1
        tokens[word_class(w)] -= c
    end = counts.filter(F.col("word") == F.lit(END)).agg(F.sum("c")).first()[0] or 0
    symbol = np.array([k if k < OWN else OWN + 1 + word_class(w) for k, (w, _) in enumerate(top)], dtype=np.int16)
    own = np.zeros(OWN)
    own[: min(OWN, len(top))] = [c for _, c in top[:OWN]]
    return Coding(
        {w: k for k, (w, _) in enumerate(top)},
        np.log10(np.array([c for _, c in top], dtype=float) + 1),
        symbol,
        np.log10(total),
        float(np.log10(end + 1)),
        int(end > 0),
        np.concatenate([own, [end], tokens]),
    )


def _coded(coding):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code: Coding = coding.value
        get = code.head.get
        # The last entry stands for words outside the head table.
        log_count = np.append(code.log_count, 0.0)
        symbol = np.append(code.symbol, 0).astype(np.int16)
        for batch in batches:
            for start, end, texts in text_blocks(batch, "_text"):
                out = {n: [] for n in ("n_tokens", "known", "log_all", "log_class", "norm", "symbols", "rare", "rare_n")}
                for raw in texts:
                    words = raw.lower().split() if raw else []
                    at = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
                    sym = symbol[at]
                    rare: Counter[bytes] = Counter()
                    for k in np.flatnonzero(at < 0):
                        w = words[k]
                        rare[w] += 1
                        sym[k] = OWN + 1 + word_class(w)
                    logs = log_count[at]
                    in_class = sym > OWN
                    out["n_tokens"].append(len(words) + 1)
                    out["known"].append(int((at >= 0).sum()) + code.end_known)
                    out["log_all"].append(float(logs.sum()) + code.end_log)
                    out["log_class"].append(float(logs[in_class].sum()))
                    out["norm"].append(float(code.class_log[sym[in_class] - OWN - 1].sum()))
                    out["symbols"].append(np.append(sym, np.int16(OWN)).tobytes())
                    out["rare"].append(list(rare))
                    out["rare_n"].append(list(rare.values()))
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32())]
                fixed = [batch.column(n).slice(start, end - start) for n in ("_id", "held_out")]
                yield pa.RecordBatch.from_arrays([*fixed, *[pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]], names=["_id", "held_out", *out])

    return run


@dataclass
class _Stretches:
    """The stretches of some texts: symbols, the text each belongs to and its place in it."""

    parts: list[np.ndarray]
    text: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, symbols: list[bytes]) -> _Stretches:
        parts, text, place = [], [], []
        for k, raw in enumerate(symbols):
            seq = np.frombuffer(raw, dtype=np.int16)
            for at in range(0, len(seq), STRETCH):
                parts.append(seq[at : at + STRETCH])
                text.append(k)
                place.append(at // STRETCH)
        return cls(parts, np.array(text, dtype=np.int64), np.array(place, dtype=np.int64))


def _table(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The parts, longest first, as a (time, part) table, and how many of them reach each time."""
    sizes = np.array([len(p) for p in parts])
    table = np.zeros((sizes[0], len(parts)), dtype=np.int16)
    for k, p in enumerate(parts):
        table[: len(p), k] = p
    return table, np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")


def _carried(model: Model, cut: _Stretches) -> tuple[np.ndarray, np.ndarray]:
    """The forward message into each stretch and the backward message at its end, up to a factor.

    A stretch's transitions multiply to one matrix; all stretches are multiplied out side by side, then the messages
    go from stretch to stretch. Stretches of texts that are one stretch keep the plain start and end.
    """
    k, n = model.move.shape[0], len(cut.parts)
    into, after = np.zeros((n, k)), np.ones((n, k))
    long = np.flatnonzero(cut.place > 0)
    if not len(long):
        return into, after
    # Messages pass through the first stretch as a vector and through each later one as a matrix.
    long = np.unique(np.concatenate([long, long - 1]))
    order = long[np.argsort([-len(cut.parts[j]) for j in long], kind="stable")]
    matrix = np.zeros((n, k, k))
    for low in range(0, len(order), SIDE_BY_SIDE):
        some = order[low : low + SIDE_BY_SIDE]
        table, alive = _table([cut.parts[j] for j in some])
        now = np.broadcast_to(np.eye(k), (len(some), k, k)).copy()
        starts = cut.place[some] == 0
        ahead = model.emit[table]
        for t, m in enumerate(alive):
            # One product for all stretches: their rows stand below each other.
            step = (now[:m].reshape(m * k, k) @ model.move).reshape(m, k, k)
            if t == 0:
                step[starts[:m]] = model.first[0]
            np.multiply(step, ahead[t, :m, None, :], out=now[:m])
            if t % 16 == 15:
                now[:m] /= now[:m].sum((1, 2), keepdims=True)
        matrix[some] = now / now.sum((1, 2), keepdims=True)
    last = cut.place.max()
    for place in range(1, last + 1):
        here = np.flatnonzero(cut.place == place)
        before = here - 1
        if place == 1:
            message = matrix[before][:, 0]
        else:
            message = np.einsum("ni,nij->nj", into[before], matrix[before])
        into[here] = message / message.sum(1, keepdims=True)
    for place in range(last, 0, -1):
        here = np.flatnonzero(cut.place == place)
        message = np.einsum("nij,nj->ni", matrix[here], after[here])
        after[here - 1] = message / message.sum(1, keepdims=True)
    return into, after


def expected_counts(model: Model, symbols: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves (K, K) and emissions (symbols, K) of some whole texts, and their log likelihood."""
    k = model.move.shape[0]
    n_symbols = model.emit.shape[0]
    starts, moves, emits, log = np.zeros(model.first.shape), np.zeros((k, k)), np.zeros((n_symbols, k)), 0.0
    cut = _Stretches.of(symbols)
    into, after = _carried(model, cut)
    order = np.argsort([-len(p) for p in cut.parts], kind="stable")
    for low in range(0, len(order), SIDE_BY_SIDE):
        some = order[low : low + SIDE_BY_SIDE]
        begins = cut.place[some] == 0
        table, alive = _table([cut.parts[j] for j in some])
        steps, ones = len(table), np.ones(k)
        likely = model.emit[table]
        alpha, scale = np.zeros((steps, len(some), k)), np.ones((steps, len(some)))
        for t in range(steps):
            m = alive[t]
            if t == 0:
                now = np.where(begins[:, None], model.first[0], into[some] @ model.move)
            else:
                now = alpha[t - 1, :m] @ model.move
            now *= likely[t, :m]
            total = now @ ones
            np.divide(now, total[:, None], out=alpha[t, :m])
            scale[t, :m] = total
        log += float(np.log(scale).sum())
        likely /= scale[:, :, None]
        beta, back = after[some], np.ascontiguousarray(model.move.T)
        for t in range(steps - 1, -1, -1):
            m = alive[t]
            r = alive[t + 1] if t < steps - 1 else 0
            if r:
                ahead = beta[:r] * likely[t + 1, :r]
                moves += model.move * (alpha[t, :r].T @ ahead)
                np.matmul(ahead, back, out=beta[:r])
            if m > r:
                # A stretch that ends here: its backward message gets the scale that makes the posterior sum to one.
                beta[r:m] /= (alpha[t, r:m] * beta[r:m]).sum(1, keepdims=True)
            alpha[t, :m] *= beta[:m]
        goes_on = ~begins
        ahead = beta[goes_on] * likely[0, goes_on]
        moves += model.move * (into[some][goes_on].T @ ahead)
        starts[0] += alpha[0][begins].sum(0)
        flat = table.ravel()
        for s in range(k):
            emits[:, s] += np.bincount(flat, weights=alpha[:, :, s].ravel(), minlength=n_symbols)
    return starts, moves, emits, log


def improved(starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, general: np.ndarray) -> Model:
    """Parameters from expected counts, smoothed so that no symbol is impossible in a state."""
    first = (starts + 0.1) / (starts + 0.1).sum(1, keepdims=True)
    move = (moves + 0.1) / (moves + 0.1).sum(1, keepdims=True)
    emit = emits + 5.0 * general[:, None]
    return Model(first, move, emit / emit.sum(0, keepdims=True))


def _start_model(general: np.ndarray) -> Model:
    rng = np.random.default_rng(7)
    emit = general[:, None] * np.exp(rng.normal(0, 1, (len(general), STATES)))
    move = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
    return Model(np.full((1, STATES), 1 / STATES), move, emit / emit.sum(0, keepdims=True))


def _round(model: Model):
    """One task's expected counts as (place, value) rows; places number the starts, moves and emissions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                raw = batch.column("symbols").slice(at, 500).to_pylist()
                s, m, e, log = expected_counts(model, raw)
                flat = np.concatenate([s.ravel(), m.ravel(), e.ravel(), [log]])
                total = flat if total is None else total + flat
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["place", "value"])

    return run


def train(coded: DataFrame, symbol_count: np.ndarray, passes: int = PASSES, slices: int = SLICES) -> Model:
    """Baum-Welch over all rows of ``coded`` (columns _row, symbols), from the frequencies of the symbols."""
    n_symbols, k = len(symbol_count), STATES
    general = (symbol_count + 0.5) / (symbol_count + 0.5).sum()
    model = _start_model(general)
    counts = np.zeros((slices, k + k * k + n_symbols * k + 1))
    for step in range(passes * slices):
        rows = coded.filter(F.pmod("_row", F.lit(slices)) == step % slices).select("symbols")
        sums = rows.mapInArrow(_round(model), "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
        counts[step % slices] = 0.0
        for r in sums:
            counts[step % slices, r["place"]] = r["value"]
        flat = counts.sum(0)
        starts, moves, emits = flat[:k].reshape(1, k), flat[k : k + k * k].reshape(k, k), flat[k + k * k : -1].reshape(n_symbols, k)
        if emits.any():
            model = improved(starts, moves, emits, general)
    return model


def forward_log10(model: Model, symbols: list[bytes]) -> np.ndarray:
    """log10 likelihood of whole symbol sequences by the scaled forward recursion."""
    parts = [np.frombuffer(raw, dtype=np.int16) for raw in symbols]
    order = np.argsort([-len(p) for p in parts], kind="stable")
    out = np.zeros(len(parts))
    sizes = np.array([len(parts[j]) for j in order])
    flat = np.concatenate([parts[j] for j in order]) if len(parts) else np.zeros(0, dtype=np.int16)
    offset = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(parts) else sizes
    alive = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")
    log, now, ones = np.zeros(len(parts)), None, np.ones(model.move.shape[0])
    product, pending = np.ones(len(parts)), 0
    for t, m in enumerate(alive):
        step = np.repeat(model.first[:1], m, axis=0) if t == 0 else now[:m] @ model.move
        step *= model.emit[flat[offset[:m] + t]]
        total = step @ ones
        step /= total[:, None]
        now = step
        product[:m] *= total
        pending += 1
        if pending == 20:  # far from the smallest double: a step is at least about 1e-12
            log += np.log10(product)
            product, pending = np.ones(len(parts)), 0
    log += np.log10(product)
    out[order] = log
    return out


def _scored(model: Model, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                log = forward_log10(model, part.column("symbols").to_pylist())
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in keep], pa.array(log)], names=[*keep, "log_hidden"])

    return run


def score_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", passes: int = PASSES) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score and the model's score, both log10."""
    spark = docs.sparkSession
    ship(spark)
    held = F.coalesce(remainder(id_column, 7) == 2, F.lit(False))
    source = docs.select(F.col(id_column).alias("_id"), held.alias("held_out"), F.col(text_column).alias("_text"))
    counts = spooled(word_counts(source.filter(~F.col("held_out")), "_text"))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    coding = build_coding(counts)
    shared = spark.sparkContext.broadcast(coding)
    schema = T.StructType([*source.schema.fields[:2]])
    for name, kind in (("n_tokens", "long"), ("known", "long"), ("log_all", "double"), ("log_class", "double"), ("norm", "double"), ("symbols", "binary"), ("rare", T.ArrayType(T.BinaryType())), ("rare_n", T.ArrayType(T.IntegerType()))):
        schema = schema.add(name, kind)
    coded = spooled(source.mapInArrow(_coded(shared), schema).withColumn("_row", F.monotonically_increasing_id()))
    model = train(coded.filter(~F.col("held_out")), coding.symbol_count, passes)

    rare = coded.select("_row", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select("_row", F.col("r.rare").alias("word"), F.col("r.rare_n").alias("tf"))
    tail = (
        rare.join(counts, "word")
        .groupBy("_row")
        .agg(F.sum(F.col("tf") * F.log10(F.col("c") + 1.0)).alias("tail"), F.sum("tf").alias("tail_known"))
    )
    keep = ["_row", "_id", "held_out", "n_tokens", "known", "log_all", "log_class", "norm"]
    schema = T.StructType([*coded.select(*keep).schema.fields, T.StructField("log_hidden", T.DoubleType())])
    scored = coded.select(*keep, "symbols").mapInArrow(_scored(model, keep), schema).join(tail, "_row", "left")
    more = F.coalesce("tail", F.lit(0.0))
    return scored.select(
        F.col("_id").alias(id_column),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("log_all") + more - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
        (F.col("log_hidden") + F.col("log_class") + more - F.col("norm")).alias("score"),
    )

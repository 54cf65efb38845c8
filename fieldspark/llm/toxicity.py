"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

1. Voters look at a whole text: fixed insult lists, patterns, and lists of words and word stems that the labelled
   training rows mark as toxic.
2. A text's votes form a bit pattern. Spark counts the patterns of all training texts, by label where there is one;
   the table has at most 3 * 2^voters rows, whatever the number of texts.
3. The generative model over these counts is fitted by expectation maximisation: class balance, the accuracies of all
   voters, and for strongly correlated voters a dependence on one other voter (a forest chosen by conditional mutual
   information). Its posterior is the label of a text.
4. A logistic classifier over all words and stems with enough texts is trained on the posteriors and scores every whole text.

Labels are read only from rows whose crc32(id as text) mod 4 is not 2. Labels, language, source and id are no inputs
of a score. Copies of a text say nothing new: lists, pattern counts and classifier take each distinct text once, a text
whose copies differ in label once per label. Learned lists come from all labelled training texts and have no fixed size:
at most the mean number of features of a toxic text, times about 125, can reach the support. Bound: the classifier is
fitted on at most about ``SAMPLE`` distinct training texts (chosen by a hash of the text); which features it has, only
their support among these texts decides, and each text goes to the driver as packed numbers of its features.

Defined cases: NULL, empty and blank texts have no words and get the classifier's base score; NULL labels and labels
without a document are ignored, of several labels of a document the highest counts; repeated rows get equal scores; rows
with a NULL id are scored and are not held out; an empty table gives an empty result; with no labels at all the fixed
voters alone make the labels; columns of the input named like a result column are replaced, all others may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.llm.text import attach, free_name, fresh, remainder, ship, spooled, text_blocks

SAMPLE = 10_000
# Distinct texts that a feature of the classifier stands in, at least, and that share of the toxic ones.
SUPPORT = 5
SUPPORT_SHARE = 0.01
THRESHOLD = 0.3
STEMS = (4, 5, 6)

# Insults by kind.
LEXICONS = {
    "intellect": "idiot idiots moron morons stupid imbecile imbeciles dumb dumbass fool fools brainless clown clowns dimwit",
    "worth": "loser losers worthless pathetic useless nobody failure failures wimp coward cowards",
    "disgust": "scum trash garbage disgusting filth filthy vermin pig pigs creep creeps freak freaks",
}
PATTERNS = {
    "address": rb"\byou(?:'re| are)? (?:a |an |such a |so )?(?:idiot|moron|stupid|dumb|loser|worthless|pathetic|scum|trash|fool|clown|freak)\b",
    "threat": rb"\b(?:kill|hurt|destroy|beat) (?:you|yourself|them|him|her)\b|\bgo die\b",
    "masked": rb"\b[a-z]\*{2,}[a-z]*",
}
# One of these stands in every match of the pattern.
NEEDED = {"address": (b"you ", b"you'"), "threat": (b"kill ", b"hurt ", b"destroy ", b"beat ", b"go die"), "masked": (b"**",)}
LEARNED = ("word", "stem4", "stem5")
VOTERS = [*LEXICONS, *PATTERNS, "several", *LEARNED]
_BREAKS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\"()[]{}", b"abcdefghijklmnopqrstuvwxyz" + b" " * 13)
_RULES = {k: re.compile(v) for k, v in PATTERNS.items()}
_LISTS = {k: frozenset(w.encode() for w in v.split()) for k, v in LEXICONS.items()}
_ALL = frozenset().union(*_LISTS.values())


@dataclass
class ToxicityModel:
    learned: dict[bytes, int] = field(default_factory=dict)  # feature -> learned voter
    weights: dict[bytes, float] = field(default_factory=dict)
    bias: float = 0.0
    accuracies: dict[str, tuple[float, float]] = field(default_factory=dict)  # P(vote | clean), P(vote | toxic)
    parents: dict[str, str] = field(default_factory=dict)  # correlated voters


# Bytes of text of a block; what a task holds besides its table is of the order of a block.
BLOCK = 2_000_000


@dataclass
class _Words:
    """The distinct words of a block of texts, and the distinct pairs (text, word), in order."""

    words: pa.Array
    text: np.ndarray
    word: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes | None]) -> _Words:
        flat = pa.array([(raw or b"").translate(_BREAKS) for raw in texts], pa.large_binary())
        # The cut is at ASCII blanks, so it does not matter whether the bytes are valid text.
        lists = pc.ascii_split_whitespace(flat.view(pa.large_string()))
        found = pc.list_flatten(lists).view(pa.large_binary())
        real = pc.greater(pc.binary_length(found), 0)
        coded = found.filter(real).dictionary_encode()
        text, word = _distinct(pc.list_parent_indices(lists).filter(real).to_numpy(), coded.indices.to_numpy(), len(coded.dictionary))
        return cls(coded.dictionary, text, word)

    def holders(self, wanted: Iterable[bytes]) -> np.ndarray:
        """The texts that have one of the ``wanted`` words, once for each that they have."""
        there = pc.is_in(self.words, value_set=_names(wanted)).to_numpy(zero_copy_only=False)
        return self.text[there[self.word]]

    def features(self) -> Iterator[tuple[np.ndarray, pa.Array]]:
        """Words themselves, marked, then stems of each length: the words' numbers and their features."""
        every = np.arange(len(self.words))
        yield every, pc.binary_join_element_wise(pa.scalar(b"=", pa.large_binary()), self.words, pa.scalar(b"", pa.large_binary()))
        sizes = pc.binary_length(self.words).to_numpy()
        for n in STEMS:
            long = every[sizes >= n]
            yield long, pc.binary_slice(self.words.take(pa.array(long)), 0, n)

    def pairs(self, table: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs (text, place of a feature in ``table``), in order."""
        texts, places = [], []
        for number, names in self.features():
            place = np.full(len(self.words), -1, dtype=np.int64)
            place[number] = pc.fill_null(pc.index_in(names, value_set=table), -1).to_numpy()
            at = place[self.word]
            texts.append(self.text[at >= 0])
            places.append(at[at >= 0])
        return _distinct(np.concatenate(texts), np.concatenate(places), len(table))


def _distinct(text: np.ndarray, value: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of texts and values below ``size``, in order."""
    pairs = text.astype(np.int64) * max(1, size) + value
    pairs.sort()
    return np.divmod(pairs[np.diff(pairs, prepend=-1) > 0], max(1, size))


def _names(table: Iterable[bytes]) -> pa.Array:
    return pa.array(list(table), pa.large_binary())


def vote_masks(texts: list[bytes | None], found: _Words, learned: dict[bytes, int]) -> np.ndarray:
    """Bit k is set if voter k of VOTERS finds the text toxic."""
    n = len(texts)
    votes = [np.bincount(found.holders(words), minlength=n) > 0 for words in _LISTS.values()]
    flat = [raw.lower() if raw else b"" for raw in texts]
    for kind, rule in _RULES.items():
        votes.append(np.array([any(x in raw for x in NEEDED[kind]) and rule.search(raw) is not None for raw in flat]))
    votes.append(np.bincount(found.holders(_ALL), minlength=n) >= 2)
    text, feature = found.pairs(_names(learned))
    voter = np.array(list(learned.values()), dtype=np.int64)[feature]
    votes += [np.bincount(text[voter == k], minlength=n) > 0 for k in range(len(LEARNED))]
    return sum(v.astype(np.int32) << k for k, v in enumerate(votes))


def _votes(learned: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, texts in text_blocks(batch, "_text", BLOCK):
                masks = vote_masks(texts, _Words.of(texts), learned)
                kept = [batch.column(n).slice(start, end - start) for n in ("_id", "_h")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(masks, pa.int32())], names=["_id", "_h", "mask"])

    return run


def _feature_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, texts, summed label) of each block."""
    for batch in batches:
        for start, end, texts in text_blocks(batch, "_text", BLOCK):
            label = np.array([y or 0.0 for y in batch.column("_y").slice(start, end - start).to_pylist()])
            found = _Words.of(texts)
            for number, names in found.features():
                coded = names.dictionary_encode()
                n = len(coded.dictionary)
                code = np.full(len(found.words), -1, dtype=np.int64)
                code[number] = coded.indices.to_numpy()
                at = code[found.word]
                text, feature = _distinct(found.text[at >= 0], at[at >= 0], n)
                sums = [np.bincount(feature, minlength=n), np.bincount(feature, weights=label[text], minlength=n)]
                yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.binary()), *map(pa.array, sums)], names=["feature", "texts", "label_sum"])


def _feature_rows(table: list[bytes]):
    """The label and the packed numbers of the features of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _names(table)
        for batch in batches:
            for start, end, texts in text_blocks(batch, "_text", BLOCK):
                text, feature = _Words.of(texts).pairs(places)
                parts = np.split(feature.astype(np.int32), np.searchsorted(text, np.arange(1, len(texts))))
                packed = pa.array([part.tobytes() for part in parts], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("_y").slice(start, end - start), packed], names=["_y", "features"])

    return run


def _scores(weights: dict[bytes, float], bias: float, keep: list[str], text_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, values = _names(weights), np.array(list(weights.values()))
        for batch in batches:
            for start, end, texts in text_blocks(batch, text_column, BLOCK):
                text, feature = _Words.of(texts).pairs(places)
                # A text's weights are added in the order of the features, wherever the text stands.
                z = bias + np.bincount(text, weights=values[feature], minlength=len(texts))
                score = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                columns = {n: batch.column(n).slice(start, end - start) for n in keep}
                yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(score)], names=[*columns, "score"])

    return run


def _sums(rows: DataFrame, least: int) -> DataFrame:
    schema = "feature binary, texts long, label_sum double"
    return rows.mapInArrow(_feature_sums, schema).groupBy("feature").agg(F.sum("texts").alias("texts"), F.sum("label_sum").alias("label_sum")).filter(F.col("texts") >= least)


def fit_label_model(bits: np.ndarray, free: np.ndarray, toxic: np.ndarray, clean: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """Posterior of each pattern, P(vote | class) of each voter, and the voter that each correlated voter depends on.

    ``bits`` has a row per pattern; ``free``, ``toxic`` and ``clean`` count its unlabelled and labelled texts.
    """
    n, m = bits.shape
    many = bits.sum(1)
    post = np.where(toxic + clean > 0, (toxic + 0.1) / (toxic + clean + 0.2), np.where(many > 0, 0.9, 0.05))
    parents: dict[int, int] = {}
    for stage in range(2):
        for _ in range(rounds):
            one, zero = toxic + free * post, clean + free * (1 - post)
            log = np.stack([np.full(n, np.log(zero.sum() + 1.0)), np.full(n, np.log(one.sum() + 1.0))])
            accuracy = np.empty((m, 2))
            for y, weight in enumerate((zero, one)):
                for k in range(m):
                    accuracy[k, y] = (weight @ bits[:, k] + 0.5) / (weight.sum() + 1.0)
                    if k in parents:
                        p = bits[:, parents[k]]
                        rate = np.array([(weight @ (bits[:, k] * (p == v)) + 0.5) / (weight @ (p == v) + 1.0) for v in (0, 1)])[p]
                    else:
                        rate = accuracy[k, y]
                    log[y] += np.log(np.where(bits[:, k] == 1, rate, 1 - rate))
            post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if stage == 0:
            parents = _correlated(bits, (clean + free * (1 - post), toxic + free * post))
    return post, accuracy, parents


def _correlated(bits: np.ndarray, weights: tuple[np.ndarray, np.ndarray]) -> dict[int, int]:
    """A forest over the voters: the largest conditional mutual informations that are significant."""
    m = bits.shape[1]
    total = sum(w.sum() for w in weights)
    gains = []
    for i in range(m):
        for j in range(i):
            info = 0.0
            for w in weights:
                if w.sum() <= 0:
                    continue
                for a in (0, 1):
                    for b in (0, 1):
                        joint = w @ ((bits[:, i] == a) & (bits[:, j] == b)) / w.sum()
                        apart = (w @ (bits[:, i] == a)) * (w @ (bits[:, j] == b)) / w.sum() ** 2
                        if joint > 0:
                            info += w.sum() / max(total, 1) * joint * np.log(joint / apart)
            if 2 * total * info > 20:
                gains.append((info, i, j))
    root = list(range(m))
    edges: dict[int, list[int]] = {k: [] for k in range(m)}

    def top(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    for _, i, j in sorted(gains, reverse=True):
        if top(i) != top(j):
            root[top(i)] = top(j)
            edges[i].append(j)
            edges[j].append(i)
    parents: dict[int, int] = {}
    seen: set[int] = set()
    for start in range(m):
        stack = [start] if start not in seen else []
        seen.add(start)
        while stack:
            k = stack.pop()
            for other in edges[k]:
                if other not in seen:
                    seen.add(other)
                    parents[other] = k
                    stack.append(other)
    return parents


def fit_linear(rows: list[np.ndarray], target: np.ndarray, size: int, penalty: float = 1.0, steps: int = 200) -> tuple[np.ndarray, float]:
    """Logistic regression on probabilistic labels with an L2 penalty, by gradient steps with momentum.

    A row holds the numbers of its features. Sums run over pieces of bounded length.
    """
    count = len(rows)
    if count == 0:
        return np.zeros(size), -2.0
    # A piece: its rows that have features, how many each has, where it begins, and the features.
    pieces, piece, held = [], [], 0
    for k, row in enumerate(rows):
        if len(row):
            piece.append(k)
            held += len(row)
        if piece and (held > 1_000_000 or k == count - 1):
            sizes = np.array([len(rows[j]) for j in piece])
            pieces.append((np.array(piece), sizes, np.cumsum(sizes) - sizes, np.concatenate([rows[j] for j in piece])))
            piece, held = [], 0
    weight, bias = np.zeros(size), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        z = np.full(count, bias)
        for row, _, begin, at in pieces:
            z[row] += np.add.reduceat(weight[at], begin)
        off = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - target
        pull = sum((np.bincount(at, weights=np.repeat(off[row], sizes), minlength=size) for row, sizes, _, at in pieces), np.zeros(size))
        slope = np.append(pull + penalty * weight, off.sum()) / count
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        move = 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        weight, bias = weight - move[:-1], bias - move[-1]
    return weight, float(bias)


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """Learn the voters' lists, the label model and the classifier."""
    ship(docs.sparkSession)
    model = ToxicityModel()
    source = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text")).filter("_id is not null")
    source = source.filter(remainder("_id", 4) != 2).withColumn("_h", F.xxhash64("_text"))
    known = labels.select(F.col(id_column).alias("_id"), F.col(label_column).alias("_y")).filter("_id is not null and _y is not null")
    known = spooled(known.filter(remainder("_id", 4) != 2).groupBy("_id").agg(F.max("_y").cast("double").alias("_y")))
    labelled = spooled(attach(source, known, ["_id"]).select("_h", "_text", "_y").dropDuplicates(["_h", "_y"]))
    n_toxic = labelled.agg(F.coalesce(F.sum("_y"), F.lit(0.0))).first()[0]
    # A listed word stands in at least five distinct texts and about one of a hundred toxic ones.
    marked = _sums(labelled.select("_text", "_y"), max(SUPPORT, int(SUPPORT_SHARE * n_toxic)))
    rate = (F.col("label_sum") + 0.1) / (F.col("texts") + 1.0)
    lists = marked.filter(rate >= 0.8).select("feature").collect()
    for row in lists:
        name = bytes(row["feature"])
        model.learned[name] = 0 if name[:1] == b"=" else 1 if len(name) <= STEMS[0] else 2

    schema = T.StructType([source.schema["_id"], T.StructField("_h", T.LongType()), T.StructField("mask", T.IntegerType())])
    votes = source.mapInArrow(_votes(model.learned), schema)
    has = lambda of: F.coalesce(F.max(of), F.lit(False))
    texts = attach(votes, known, ["_id"], "left").groupBy("_h", "mask").agg(has(F.col("_y") > 0).alias("toxic"), has(F.col("_y") <= 0).alias("clean"))
    texts = spooled(texts.withColumn("free", ~F.col("toxic") & ~F.col("clean")))
    # At most 2^voters rows.
    table = texts.groupBy("mask").agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in ("free", "toxic", "clean")]).orderBy("mask").collect()
    if not table:
        model.bias = -2.0
        return model
    masks = np.array([r["mask"] for r in table])
    bits = (masks[:, None] >> np.arange(len(VOTERS))) & 1
    counts = [np.array([r[c] or 0 for r in table], dtype=float) for c in ("free", "toxic", "clean")]
    post, accuracy, parents = fit_label_model(bits, *counts)
    model.accuracies = {v: (float(accuracy[k, 0]), float(accuracy[k, 1])) for k, v in enumerate(VOTERS)}
    model.parents = {VOTERS[k]: VOTERS[p] for k, p in parents.items()}

    total = sum(int(c.sum()) for c in counts)
    share = min(1.0, sample / max(1, total))
    lot = F.pmod(F.xxhash64("_h"), F.lit(1 << 30)) / float(1 << 30)
    # At most about ``sample`` rows of a few bytes, so the broadcast is bounded.
    few = texts.filter(lot < share).withColumn("_y", _lookup(masks, post)).select("_h", "_y")
    chosen = spooled(source.join(F.broadcast(few), "_h").select("_h", "_text", "_y").dropDuplicates(["_h"])).select("_text", "_y")
    found = _sums(chosen, max(SUPPORT, int(SUPPORT_SHARE * n_toxic * share))).select("feature").toArrow().column("feature")
    features = sorted(found.to_pylist())
    packed = chosen.mapInArrow(_feature_rows(features), "_y double, features binary").toArrow()
    rows = sorted(zip(packed.column("_y").to_pylist(), packed.column("features").to_pylist(), strict=True))
    del found, packed
    weight, model.bias = fit_linear([np.frombuffer(f, dtype=np.int32) for _, f in rows], np.array([y for y, _ in rows]), len(features))
    model.weights = dict(zip(features, weight.tolist(), strict=True))
    return model


def _lookup(masks: np.ndarray, post: np.ndarray) -> Column:
    pairs = [F.lit(x) for m, p in zip(masks, post, strict=True) for x in (int(m), float(p))]
    return F.create_map(*pairs)[F.col("mask")]


def score(docs: DataFrame, model: ToxicityModel, id_column: str = "doc_id", text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (default all) with held_out, score and predicted."""
    ship(docs.sparkSession)
    made = ("held_out", "score", "predicted")
    rest = fresh(docs, *made).columns
    keep = rest if keep is None else [c for c in keep if c in rest]
    held = free_name(docs, "_held_out")
    source = docs.select(*dict.fromkeys([*keep, text_column]), F.coalesce(remainder(id_column, 4) == 2, F.lit(False)).alias(held))
    schema = T.StructType([*source.select(*keep, held).schema.fields, T.StructField("score", T.DoubleType())])
    scored = source.mapInArrow(_scores(model.weights, model.bias, [*keep, held], text_column), schema)
    return scored.select(*keep, F.col(held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

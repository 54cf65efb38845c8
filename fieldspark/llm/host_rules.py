"""Quality rules with host verdicts: rule failures by domain, shrunk with an empirical beta prior.

1. Every whole text is measured once (words, symbols, repeated lines, words in repeated windows).
2. The failures of each rule are summed by host; sums are pre-aggregated, so a hot host is no hot task.
3. The failure rates of all hosts give a beta prior per rule by the method of moments; a host's rate is its
   posterior mean, so a host with few texts keeps close to the prior.
4. The limit of a rule follows from the prior: the rate at which the odds of a failure are ODDS times those of the prior's
   mean. A host is refused if its rate is above the limit with a posterior probability of at least 1 - DOUBT. The tail is
   bounded by Cantelli's inequality, var / (var + (mean - limit)^2), which holds for every distribution, so no host is
   refused on less. Its verdict is joined to its documents.

Defined cases: a NULL or empty text has no words and fails; texts without a host form the host NULL, which gets
no host verdict; repeated rows count as often as they occur; an empty table gives an empty result; columns of the
input that have the name of a result column are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.text import attach, free_name, fresh, ship, spooled, text_blocks

MIN_WORDS = 20
REPEAT_PERCENT = 30
SYMBOL_PERCENT = 10
LINE_PERCENT = 30
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
RULES = ("short", "repeats", "symbols", "lines")
# A refused host fails a rule with odds above ODDS times the usual, with a posterior doubt of at most DOUBT.
ODDS = 2.0
DOUBT = 0.05
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_BLANKS = b" \t\n\r\x0b\x0c"
_CONTINUATION = bytes(range(0x80, 0xC0))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window found at least twice. Windows are compared exactly, by ranks of doubled length."""
    n = len(words)
    if n <= window:
        return 0
    rank = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64)
    length = 1
    while length < window:
        step = min(length, window - length)
        pair = rank[: n - length - step + 1] * n + rank[step : step + n - length - step + 1]
        rank, names = pd.factorize(pair)
        if len(names) == len(rank):
            return 0
        length += step
    found = np.bincount(rank)[rank] > 1
    cover = np.zeros(n + 1, dtype=np.int64)
    start = np.flatnonzero(found)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + window, -1)
    return int(np.count_nonzero(np.cumsum(cover[:n])))


def measure(raw: bytes | None) -> tuple[int, int, int, int, int, int]:
    """The MEASURES of one text given as UTF-8."""
    if not raw:
        return 0, 0, 0, 0, 0, 0
    words = raw.split()
    packed = raw.translate(None, _BLANKS)
    chars = len(packed.translate(None, _CONTINUATION))
    symbols = len(packed) - len(packed.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    lines = again = 0
    for line in raw.split(b"\n"):
        if not line or line.isspace():
            continue
        lines += 1
        if line in seen:
            again += 1
        else:
            seen.add(line)
    return len(words), chars, symbols, lines, again, repeated_words(words)


def _measured(text_column: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, texts in text_blocks(batch, text_column):
                values = np.array([measure(t) for t in texts], dtype=np.int64).reshape(-1, len(MEASURES))
                columns = {n: batch.column(n).slice(start, end - start) for n in keep}
                columns |= {n: pa.array(values[:, k]) for k, n in enumerate(MEASURES)}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def with_measures(docs: DataFrame, text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of the documents (default all) with the MEASURES of their texts."""
    ship(docs.sparkSession)
    plain = fresh(docs, *MEASURES)
    keep = [c for c in (plain.columns if keep is None else keep) if c in plain.columns]
    schema = plain.select(*keep).schema
    for name in MEASURES:
        schema = schema.add(name, "long")
    return plain.select(*dict.fromkeys([*keep, text_column])).mapInArrow(_measured(text_column, keep), schema)


def rule_failures() -> dict[str, Column]:
    n = F.col("n_words")
    return {
        "short": n < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > REPEAT_PERCENT * n,
        "symbols": 100 * F.col("n_symbols") > SYMBOL_PERCENT * F.col("word_chars"),
        "lines": 100 * F.col("n_dup_lines") > LINE_PERCENT * F.col("n_lines"),
    }


def host_verdicts(measured: DataFrame, host: str, odds: float = ODDS, doubt: float = DOUBT) -> DataFrame:
    """One row per host (column ``host``): texts, shrunk rate of each rule, and whether the host is refused.

    The prior has the mean m and the variance v of the host rates: strength m(1-m)/v - 1, at least 1. Where all hosts
    agree (v = 0) or there are fewer than two, the strength is the number of texts, that is all hosts get the mean.
    """
    failed = rule_failures()
    hosts = spooled(
        measured.select(host, *[failed[r].cast("long").alias(r) for r in RULES])
        .filter(F.col(host).isNotNull())
        .groupBy(host)
        .agg(F.count("*").alias("host_docs"), *[F.sum(r).alias(f"_{r}") for r in RULES])
    )
    rates = hosts.select("host_docs", *[(F.col(f"_{r}") / F.col("host_docs")).alias(r) for r in RULES])
    moments = rates.agg(
        F.sum("host_docs").alias("docs"), *[f(r).alias(f"{k}_{r}") for r in RULES for k, f in (("mean", F.avg), ("var", F.var_pop))]
    ).first()
    shrunk, refused = [], F.lit(False)
    for rule in RULES:
        mean, var = moments[f"mean_{rule}"] or 0.0, moments[f"var_{rule}"] or 0.0
        strength = max(1.0, mean * (1 - mean) / var - 1) if var > 1e-12 else float(max(1, moments["docs"] or 1))
        total = F.col("host_docs") + strength
        rate = (F.col(f"_{rule}") + mean * strength) / total
        limit = odds * mean / (1 - mean + odds * mean)
        spread = rate * (1 - rate) / (total + 1)
        above = (rate > limit) & (spread <= doubt * (spread + (rate - limit) * (rate - limit)))
        shrunk.append(rate.alias(f"host_{rule}"))
        refused = refused | above
    return hosts.select(host, "host_docs", *shrunk, refused.alias("host_refused"))


def judge(
    docs: DataFrame,
    text_column: str = "text",
    host_column: str = "source",
    carry: list[str] | None = None,
    odds: float = ODDS,
    doubt: float = DOUBT,
) -> DataFrame:
    """The documents with measures, base_failed, host rates and ``kept``.

    ``carry`` names the input columns to return (default all); the measured rows are stored once in the
    checkpoint folder, because both the host sums and the result read them.
    """
    made = [*MEASURES, "base_failed", "host_docs", "host_refused", "kept", *[f"host_{r}" for r in RULES]]
    # The host may have the name of a result column, so it goes along under a name of its own.
    host = free_name(docs, "_host_of_text")
    rest = fresh(docs, *made).columns
    keep = [c for c in rest if carry is None or c in carry or c == host_column]
    measured = spooled(with_measures(docs.withColumn(host, F.col(host_column)), text_column, [*keep, host]))
    verdicts = host_verdicts(measured, host, odds, doubt)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    judged = attach(measured, verdicts, [host], "left")
    refused = F.coalesce("host_refused", F.lit(False))
    facts = ["host_docs", *[f"host_{r}" for r in RULES]]
    return judged.select(*keep, *MEASURES, *facts, refused.alias("host_refused"), failed.alias("base_failed"), (~failed & ~refused).alias("kept"))

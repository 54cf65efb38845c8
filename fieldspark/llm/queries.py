"""The registered queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm import (
    fingerprints,
    host_rules,
    language_model,
    licenses,
    merkle,
    near_duplicates,
    packing,
    search,
    sentencepieces,
    substrings,
    toxicity,
    url_filter,
    vector_join,
)
from fieldspark.llm.text import GAP, WORD

TOKENIZER = os.environ.get("FIELDSPARK_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")

# The host and path rules of the URL query.
URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
# The URL list holds the pages of hosts that name a trade of unwanted pages among their parts.
UNWANTED = "adserver ads adult bets betting casino casinos escort jackpot pills poker porn replica slots spam torrent tracker tracking viagra warez xxx".split()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=["doc_id"])


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rules.judge(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return judged.select("doc_id", *host_rules.MEASURES, "base_failed", "kept", "source", "host_refused")


def op4_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op5_prefix_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and the length and digest of the text that they decode to."""
    encoded = sentencepieces.encode(_table(spark, sf_dir, "documents"), TOKENIZER, keep=["doc_id"], check=True)
    return encoded.select("doc_id", "piece_ids", F.size("piece_ids").alias("n_pieces"), "decoded_chars", "decoded_sha256")


def op6_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.drop_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_url_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed are the URLs of all pages on a host with one of the UNWANTED words among its parts."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    parts = F.split(url_filter.host_of(F.col("url")), r"[.\-]")
    listed = pages.filter(F.arrays_overlap(parts, F.array(*map(F.lit, UNWANTED)))).select("url")
    return url_filter.filter_urls(pages, listed, rules=URL_RULES).select("page_id", "host", "path", "rule", "verdict", "canonical", "listed")


def op8_paragraph_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_versions(_table(spark, sf_dir, "documents"))


def op9_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_classes(_table(spark, sf_dir, "documents"))


def op10_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(merkle.build_manifest(_table(spark, sf_dir, "documents")))


def op12_best_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_table(spark, sf_dir, "benchmark"), _table(spark, sf_dir, "documents"))


def op13_grid_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.near_vector_classes(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_length_buckets,
        op2_toxicity,
        op3_host_rules,
        op4_license_windows,
        op5_prefix_viterbi,
        op6_unit_dedup,
        op7_url_bloom,
        op8_paragraph_sketch,
        op9_bottom_k,
        op10_hidden_markov,
        op11_merkle_manifest,
        op12_best_position,
        op13_grid_order_join,
    )
}

_WORDS = f"regexp_extract_all(coalesce(text, ''), '{WORD}')"


def packing_sql() -> str:
    """The dynamic programme as one level of subquery per bucket; ties take the smaller cut, as in the operator."""
    k, limit, budget = packing.N_BUCKETS, packing.MAX_TOKENS, packing.TOKEN_BUDGET
    levels = ["best1 AS (SELECT j, size * r - t AS pad, 0 AS cut FROM cells)"]
    for b in range(2, k + 1):
        levels.append(
            f"best{b} AS (SELECT j, min(v.pad) AS pad, min_by(v.i, (v.pad, v.i)) AS cut FROM ("
            f"SELECT c.j, p.j AS i, p.pad + c.size * (c.r - q.r) - (c.t - q.t) AS pad FROM cells c "
            f"JOIN (SELECT j, pad FROM best{b - 1} UNION ALL SELECT 0, 0) p ON p.j < c.j JOIN sums q ON q.j = p.j) v GROUP BY j)"
        )
    back = [f"cut{k} AS (SELECT max(j) AS j FROM cells)"]
    for b in range(k, 1, -1):
        back.append(f"cut{b - 1} AS (SELECT coalesce((SELECT cut FROM best{b} WHERE j = (SELECT j FROM cut{b})), 0) AS j)")
    bounds = " UNION ".join(f"SELECT j FROM cut{b}" for b in range(1, k + 1))
    return f"""
WITH docs AS (SELECT doc_id, CAST(len({_WORDS}) AS INTEGER) AS n FROM documents),
pieces AS (
  SELECT doc_id, CAST(piece AS INTEGER) AS piece, CAST(piece * {limit} AS INTEGER) AS first_token, CAST(least(n - piece * {limit}, {limit}) AS INTEGER) AS n_tokens
  FROM (SELECT doc_id, n, unnest(range(0, greatest(CAST(ceil(n / {limit}) AS INTEGER), 1))) AS piece FROM docs)),
hist AS (SELECT n_tokens AS size, count(*) AS c FROM pieces WHERE n_tokens > 0 GROUP BY 1),
cells AS (SELECT size, row_number() OVER o AS j, CAST(sum(c) OVER o AS BIGINT) AS r, CAST(sum(c * size) OVER o AS BIGINT) AS t FROM hist WINDOW o AS (ORDER BY size)),
sums AS (SELECT j, r, t FROM cells UNION ALL SELECT 0, 0, 0),
{', '.join(levels)},
{', '.join(back)},
bounds AS (SELECT CAST(size AS INTEGER) AS bucket_length, CAST(row_number() OVER (ORDER BY size) - 1 AS INTEGER) AS bucket FROM cells WHERE j IN ({bounds})),
total AS (SELECT greatest(1, CAST(ceil(count(*) / {packing.SALT_ROWS}) AS BIGINT)) AS salts FROM pieces WHERE n_tokens > 0),
placed AS (
  SELECT p.*, (SELECT min(bucket) FROM bounds b WHERE p.n_tokens > 0 AND b.bucket_length >= p.n_tokens) AS bucket,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || piece), 1, 8) AS BIGINT) % (SELECT salts FROM total) AS salt FROM pieces p),
ranked AS (
  SELECT p.*, b.bucket_length, row_number() OVER (PARTITION BY p.bucket ORDER BY salt, doc_id NULLS FIRST, piece, n_tokens) - 1 AS pos FROM placed p LEFT JOIN bounds b USING (bucket))
SELECT doc_id, piece, first_token, n_tokens, bucket, bucket_length,
  CASE WHEN bucket IS NOT NULL THEN CAST(pos // ({budget} // bucket_length) AS BIGINT) END AS batch,
  CASE WHEN bucket IS NOT NULL THEN CAST(pos % ({budget} // bucket_length) AS INTEGER) END AS slot,
  bucket_length - n_tokens AS padding FROM ranked"""


def host_rules_sql(table: str = "documents") -> str:
    r = host_rules
    rules = {
        "short": f"n_words < {r.MIN_WORDS}",
        "repeats": f"100 * n_repeat_words > {r.REPEAT_PERCENT} * n_words",
        "symbols": f"100 * n_symbols > {r.SYMBOL_PERCENT} * word_chars",
        "lines": f"100 * n_dup_lines > {r.LINE_PERCENT} * n_lines",
    }
    sums = ", ".join(f"sum(CAST({c} AS INTEGER)) AS {k}" for k, c in rules.items())
    moments = ", ".join(f"avg({k} / n) AS m_{k}, var_pop({k} / n) AS v_{k}" for k in rules)
    rate = {k: f"(({k} + m_{k} * s_{k}) / (n + s_{k}))" for k in rules}
    limit = {k: f"({r.ODDS} * m_{k} / (1 - m_{k} + {r.ODDS} * m_{k}))" for k in rules}
    spread = {k: f"({rate[k]} * (1 - {rate[k]}) / (n + s_{k} + 1))" for k in rules}
    refused = " OR ".join(
        f"({rate[k]} > {limit[k]} AND {spread[k]} <= {r.DOUBT} * ({spread[k]} + ({rate[k]} - {limit[k]}) * ({rate[k]} - {limit[k]})))" for k in rules
    )
    strength = ", ".join(f"CASE WHEN v_{k} > 1e-12 THEN greatest(1.0, m_{k} * (1 - m_{k}) / v_{k} - 1) ELSE greatest(1, docs) END AS s_{k}" for k in rules)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM {table}),
w AS (SELECT rid, {_WORDS} AS ws FROM d),
tok AS (SELECT rid, unnest(range(0, len(ws) - {r.WINDOW - 1})) AS i, ws FROM w WHERE len(ws) >= {r.WINDOW}),
win AS (SELECT rid, i, array_to_string(ws[i + 1 : i + {r.WINDOW}], ' ') AS g FROM tok),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + o) AS n_repeat_words FROM twice, range(0, {r.WINDOW}) t(o) GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
ln AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '{WORD}') GROUP BY rid),
m AS (
  SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{GAP}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN ln USING (rid)),
h AS (SELECT source, count(*) AS n, {sums} FROM m WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT *, {strength} FROM (SELECT sum(n) AS docs, {moments} FROM h)),
v AS (SELECT source, {refused} AS host_refused FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
  n_words < {r.MIN_WORDS} OR 100 * n_repeat_words > {r.REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {r.MIN_WORDS} OR 100 * n_repeat_words > {r.REPEAT_PERCENT} * n_words) AND NOT coalesce(host_refused, false) AS kept,
  source, coalesce(host_refused, false) AS host_refused
FROM m LEFT JOIN v USING (source)"""


def near_duplicates_sql() -> str:
    """Exact: all pairs that share a shingle, then components by propagation of the least id."""
    n = near_duplicates.SHINGLE
    words = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {words} AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, hash(array_to_string(ws[i + 1 : i + {n}], ' ')) AS g
  FROM (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - {n - 1}, CASE WHEN len(ws) > 0 THEN 1 ELSE 0 END))) AS i FROM w)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM inter JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * i >= {near_duplicates.PERCENT} * (x.n + y.n - i)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.id),
least AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w LEFT JOIN size USING (doc_id) JOIN least ON least.id = w.doc_id"""


def urls_sql() -> str:
    f = url_filter
    rules = sorted(URL_RULES.items(), key=lambda r: -len(r[0]))  # a stable sort: of equal lengths the first one

    def fits(name: str) -> str:
        where, _, rest = name.partition("/")
        return f"(host = '{where}' OR ends_with(host, '.{where}')) AND starts_with(path, '/{rest}')"

    rule = "CASE " + " ".join(f"WHEN {fits(n)} THEN '{n}'" for n, _ in rules) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(n)} THEN '{v}'" for n, v in rules) + " ELSE CASE WHEN listed THEN 'block' ELSE 'allow' END END"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    unwanted = ", ".join(f"'{x}'" for x in UNWANTED)
    return f"""
WITH named AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(url, '{f.HOST}', 1), '{upper}', '{upper.lower()}'), '') AS host,
    coalesce(regexp_extract(url, '{f.PATH}', 1), '') AS path,
    array_to_string(list_sort(list_filter(string_split(coalesce(regexp_extract(url, '{f.QUERY}', 1), ''), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '{f.TRACKING}'))), '&') AS query FROM pages),
c AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^www\\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical FROM named),
l AS (SELECT DISTINCT canonical FROM c WHERE list_has_any(regexp_split_to_array(host, '[.-]'), [{unwanted}])),
j AS (SELECT c.*, l.canonical IS NOT NULL AS listed FROM c LEFT JOIN l ON c.canonical = l.canonical)
SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict, canonical, listed FROM j"""


ORACLES = {
    "op1_length_buckets": packing_sql(),
    "op3_host_rules": host_rules_sql(),
    "op4_license_windows": licenses.scan_sql(),
    "op7_url_bloom": urls_sql(),
    "op9_bottom_k": near_duplicates_sql(),
    "op11_merkle_manifest": merkle.audit_sql(),
    "op12_best_position": search.search_sql(),
    "op13_grid_order_join": vector_join.classes_sql(),
}

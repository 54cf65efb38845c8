"""Names that clash, odd texts and rows, refused hosts, models against enumeration, and the stages of the pipeline against plain Python."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from fieldspark.llm import host_rules, language_model, near_duplicates, packing, queries, sentencepieces, substrings, toxicity, url_filter

ODD_NAMES = ["_text", "_Row", "_rank", "_spans", "_out", "_id", "block", "w0", "_in", "_host", "_h", "_y", "mask", "Kept", "score", "removed", "_words", "carried_0", "_row_of_text", "n_words", "id", "shingles"]


def clashing(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in ODD_NAMES)
    return spark.createDataFrame([(i, t, "en", f"h{k % 3}", 0, *ODD_NAMES) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], schema)


def carried(rows, names=ODD_NAMES):
    return all(r[n] == n for r in rows for n in names)


# --- names ------------------------------------------------------------------------------------


def test_columns_of_any_name_are_carried(spark):
    docs = clashing(spark, ["one two three. four five", None, "", "one two three. four five"])
    other = [n for n in ODD_NAMES if n not in ("removed",)]
    assert carried(substrings.drop_repeats(docs).collect(), other)
    rest = [n for n in ODD_NAMES if n != "score"]
    labels = spark.createDataFrame([(0, 1)], "doc_id long, toxic int")
    assert carried(toxicity.score(docs, toxicity.fit(docs, labels)).collect(), rest)
    coded = sentencepieces.encode(docs, queries.TOKENIZER)
    assert carried(coded.collect()) and carried(sentencepieces.decode(coded, queries.TOKENIZER).collect())
    pages = docs.withColumnRenamed("text", "url")
    assert carried(url_filter.filter_urls(pages, pages, rules={}).collect())
    judged = host_rules.judge(docs).collect()
    assert carried(judged, [n for n in ODD_NAMES if n.lower() not in ("kept", "n_words")])
    assert carried(near_duplicates.drop_near_duplicates(docs).collect())


def test_stages_keep_columns_named_like_their_results(spark):
    text = " ".join(f"word{k}" for k in range(40))
    docs = clashing(spark, [text, text, text + " x", "short"])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, "/root/testdata/sf0.001").collect()
        assert rows and carried(rows), name
    plain = docs.drop("source")
    assert corpus_pipeline.drop_poor(spark, plain, "").columns == plain.columns


# --- pieces -----------------------------------------------------------------------------------


def test_pieces_give_back_private_characters_and_long_texts(spark):
    texts = [" a▁b", "▁▁", "", " ", "  x ", "tail ", "a\u0000b", "\U0001f600▁", "word " * 90_000, "ab" * 2_000 + " ▁x" * 70_000]
    vocabulary = sentencepieces.load_vocabulary(queries.TOKENIZER)
    encoder = sentencepieces.WordEncoder(vocabulary)
    assert [sentencepieces.decode_ids(vocabulary, i) for i in sentencepieces.encode_block(encoder, texts)] == texts
    docs = clashing(spark, [*texts, None])
    rows = sentencepieces.encode(docs, queries.TOKENIZER, keep=["doc_id"], check=True).collect()
    for r in rows:
        text = [*texts, None][r["doc_id"]]
        assert r["decoded_chars"] == (None if text is None else len(text))
        assert r["decoded_sha256"] == (None if text is None else hashlib.sha256(text.encode()).hexdigest())
    decoded = sentencepieces.decode(sentencepieces.encode(docs, queries.TOKENIZER), queries.TOKENIZER).collect()
    assert all(r["decoded"] == r["text"] for r in decoded)


def test_pieces_do_not_depend_on_blocks_or_what_is_remembered(monkeypatch):
    rng = random.Random(3)
    vocabulary = sentencepieces.load_vocabulary(queries.TOKENIZER)
    texts = [" ".join(rng.choice(["the", "nation", "thinking", "x" * rng.randint(1, 9), "éß"]) for _ in range(30)) for _ in range(40)]
    whole = sentencepieces.encode_block(sentencepieces.WordEncoder(vocabulary), texts)
    monkeypatch.setattr(sentencepieces, "KNOWN_BYTES", 500)
    monkeypatch.setattr(sentencepieces, "PART_CHARS", 20)
    encoder = sentencepieces.WordEncoder(vocabulary)
    assert [sentencepieces.encode_block(encoder, [t])[0] for t in texts] == whole
    assert encoder.known_bytes < 1_000


# --- substrings -------------------------------------------------------------------------------


def plain_cut(rows, min_words=8):
    """The texts by id with every unit that repeats an earlier one cut out, character by character."""
    found = []
    for key, text in rows:
        at = 0
        for line in (text or "").split("\n"):
            sentences = [m for m in re.finditer(r"[^.!?]*[.!?]*", line) if m.end() > m.start()]
            spans = [(at, at + len(line), 0)] + [(at + m.start(), at + m.end(), 1) for m in sentences if len(sentences) > 1]
            for s, e, part in spans:
                words = (text or "")[s:e].split()
                if len(words) >= min_words:
                    norm = re.sub("[A-Z]", lambda m: m[0].lower(), " ".join(words))
                    found.append((norm, key, s, part, e))
            at += len(line) + 1
    first = {}
    for unit in sorted(found, key=lambda f: (f[1], f[2], f[3])):
        first.setdefault(unit[0], unit[1:4])
    out = {}
    for key, text in rows:
        gone = bytearray(len(text or ""))
        for norm, k, s, part, e in found:
            if k == key and first[norm] != (k, s, part):
                gone[s:e] = b"\x01" * (e - s)
        kept, at = [], 0
        for line in (text or "").split("\n"):
            end = at + len(line)
            left = "".join(c for c, g in zip(line, gone[at:end], strict=True) if not g)
            whole = any(gone[at:end]) and not left.strip(" \t\r\x0b\x0c")
            kept.append("" if whole else left + (text or "")[end : end + 1])
            at = end + 1
        out[key] = None if text is None else "".join(kept)
    return out


def odd_passages(rng, n=60):
    said = [" ".join(rng.choice(["alpha", "Beta", "gamma", "delta"]) for _ in range(rng.randint(5, 12))) + rng.choice([".", "!", ""]) for _ in range(40)]
    texts = []
    for _ in range(n):
        lines = [rng.choice([" ", "", "\t"]) + rng.choice([" ", "  "]).join(rng.choice(said) for _ in range(rng.randint(0, 4))) + rng.choice(["", " ", "\t"]) for _ in range(rng.randint(0, 5))]
        texts.append("\n".join(lines))
    return texts


@pytest.mark.parametrize("hot", [1_000, 3])
def test_substrings_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT_ROWS", hot)
    texts = [*odd_passages(random.Random(hot)), None, "", "One two three four five six seven eight. nine ten eleven twelve thirteen fourteen fifteen sixteen. \nx"]
    texts += [texts[-1] + "\nlast"] * 2
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in substrings.drop_repeats(clashing(spark, texts)).collect()}
    want = plain_cut(rows)
    assert {k: r["text"] for k, r in got.items()} == want
    for k, r in got.items():
        # The ranges, cut from the original, leave the new text.
        left, at = [], 0
        for span in r["removed"]:
            left.append(texts[k][at : span["start"]])
            at = span["end"]
        assert (texts[k] is None and r["text"] is None) or "".join([*left, texts[k][at:]]) == r["text"]


# --- hosts ------------------------------------------------------------------------------------


def plain_hosts(rows, odds, doubt):
    """Refused hosts by the posterior's tail: rows of (host, failed)."""
    n, f = Counter(h for h, _ in rows), Counter(h for h, bad in rows if bad)
    rates = [f[h] / n[h] for h in n]
    mean = sum(rates) / len(rates)
    var = sum((r - mean) ** 2 for r in rates) / len(rates)
    strength = max(1.0, mean * (1 - mean) / var - 1) if var > 1e-12 else sum(n.values())
    limit = odds * mean / (1 - mean + odds * mean)
    refused = {}
    for h in n:
        a, b = f[h] + mean * strength, n[h] - f[h] + (1 - mean) * strength
        rate, spread = a / (a + b), a * b / (a + b) ** 2 / (a + b + 1)
        refused[h] = rate > limit and spread / (spread + (rate - limit) ** 2) <= doubt
        if refused[h]:
            # The bound is on the safe side of the tail itself, here by numeric integration.
            grid = (np.arange(200_000) + 0.5) / 200_000
            log = (a - 1) * np.log(grid) + (b - 1) * np.log1p(-grid)
            weight = np.exp(log - log.max())
            assert weight[grid > limit].sum() / weight.sum() >= 1 - doubt
    return refused


def test_hosts_that_stand_out_are_refused_and_small_ones_need_more(spark):
    rng = random.Random(8)
    good, bad = " ".join(f"w{k}" for k in range(30)), "few words"
    rows = []
    for h in range(20):
        rows += [(f"good{h}", bad if rng.random() < 0.06 else good) for _ in range(rng.choice([40, 400]))]
    rows += [("large", bad if rng.random() < 0.7 else good) for _ in range(500)]
    rows += [("small", t) for t in (bad, good)] + [("tiny", bad)] + [(None, bad), (None, good)]
    docs = spark.createDataFrame([(k, t, h) for k, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    want = plain_hosts([(h, t == bad) for h, t in rows if h], host_rules.ODDS, host_rules.DOUBT)
    judged = {r["doc_id"]: r for r in host_rules.judge(docs).collect()}
    for k, (h, t) in enumerate(rows):
        assert judged[k]["host_refused"] == want.get(h, False)
        assert judged[k]["kept"] == (t == good and not want.get(h, False))
    assert want["large"] and not want["small"] and not want["tiny"] and not any(want[f"good{h}"] for h in range(20))


def test_no_host_is_refused_where_all_are_alike(spark):
    docs = spark.createDataFrame([(k, "few", f"h{k % 4}") for k in range(40)], "doc_id long, text string, source string")
    assert host_rules.judge(docs).filter("host_refused").count() == 0


# --- toxicity ---------------------------------------------------------------------------------


def toxicity_features(text):
    """The words of a text, marked, and their stems."""
    cut = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\"()[]{}", b"abcdefghijklmnopqrstuvwxyz" + b" " * 13)
    words = set((text or "").encode().translate(cut).split())
    return {f for w in words for f in [b"=" + w, *[w[:n] for n in toxicity.STEMS if len(w) >= n]]}


@pytest.mark.parametrize("block", [1, 60, 2_000_000])
def test_blocks_of_texts_give_the_features_of_each_text(monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    rng = random.Random(5)
    pool = ["idiot", "you", "are", "an", "Stupid", "k**l", "go", "die", "naïve", "ab", "abcd", "abcde", "abcdef", "abcdefg", "\x1c", "\u2028", "kill them", "(trash)"]
    texts = [None, "", " \n\t ", "x" * 5000, *["".join(rng.choice(pool) + rng.choice([" ", "\n", ", ", "\x0b", "\u00a0"]) for _ in range(rng.randrange(12))) for _ in range(150)]]
    texts += texts[10:20]
    wanted = [toxicity_features(t) for t in texts]
    labels = [float(k % 3 == 0) if k % 5 else None for k in range(len(texts))]
    table = pa.record_batch({"_id": range(len(texts)), "_h": range(len(texts)), "_text": texts, "_y": pa.array(labels, pa.float64())})

    sums, by_label = Counter(), Counter()
    for b in toxicity._feature_sums(iter([table])):
        for f, n, y in zip(*[c.to_pylist() for c in b.columns], strict=True):
            sums[f] += n
            by_label[f] += y
    assert sums == Counter(f for s in wanted for f in s)
    assert +by_label == Counter(f for s, y in zip(wanted, labels, strict=True) if y for f in s)

    names = sorted(sums)[::2]
    packed = [x for b in toxicity._feature_rows(names)(iter([table])) for x in b.column("features").to_pylist()]
    assert [set(np.frombuffer(x, dtype=np.int32)) for x in packed] == [{k for k, f in enumerate(names) if f in s} for s in wanted]

    weights = {f: rng.uniform(-1, 1) for f in names}
    scores = [x for b in toxicity._scores(weights, -1.0, ["_id"], "_text")(iter([table])) for x in b.column("score").to_pylist()]
    assert scores == pytest.approx([1 / (1 + math.exp(1.0 - sum(weights.get(f, 0.0) for f in s))) for s in wanted])
    assert scores[10:20] == scores[-10:]

    learned = {b"=naive": 0, b"=abcd": 0, b"abcd": 1, b"abcde": 2}
    masks = [x for b in toxicity._votes(learned)(iter([table])) for x in b.column("mask").to_pylist()]
    words = [{f[1:].decode() for f in s if f[:1] == b"="} for s in wanted]
    lists = [set(v.split()) for v in toxicity.LEXICONS.values()]
    for text, s, held, mask in zip(texts, wanted, words, masks, strict=True):
        votes = [bool(held & some) for some in lists]
        votes += [re.search(rule, (text or "").encode().lower()) is not None for rule in toxicity.PATTERNS.values()]
        votes += [len(held & set().union(*lists)) >= 2, *[any(learned.get(f) == k for f in s) for k in range(3)]]
        assert mask == sum(v << k for k, v in enumerate(votes))


def test_posteriors_are_those_of_the_label_model():
    rng = np.random.default_rng(5)
    truth = rng.random(4000) < 0.3
    votes = np.stack([rng.random(4000) < np.where(truth, p, q) for p, q in ((0.9, 0.05), (0.7, 0.1), (0.6, 0.02), (0.8, 0.3))], 1)
    votes = np.column_stack([votes, votes[:, 0] ^ (rng.random(4000) < 0.02)]).astype(int)
    bits, where = np.unique(votes, axis=0, return_inverse=True)
    # Every third text has a label.
    labelled = np.arange(4000) % 3 == 0
    free, toxic, clean = (np.bincount(where.ravel()[which], minlength=len(bits)).astype(float) for which in (~labelled, labelled & truth, labelled & ~truth))
    post, accuracy, parents = toxicity.fit_label_model(bits, free, toxic, clean, rounds=400)
    assert parents.get(4) == 0 or parents.get(0) == 4
    # At the fixed point the posterior is Bayes' rule over the model's own tables, summed over both classes.
    one, zero = toxic + free * post, clean + free * (1 - post)

    def rate(k, y, row):
        weight = one if y else zero
        if k in parents:
            same = bits[:, parents[k]] == row[parents[k]]
            yes = (weight @ (bits[:, k] * same) + 0.5) / (weight @ same + 1.0)
        else:
            yes = (weight @ bits[:, k] + 0.5) / (weight.sum() + 1.0)
        return yes if row[k] else 1 - yes

    for row, p in zip(bits, post, strict=True):
        joint = [(w.sum() + 1.0) * math.prod(rate(k, y, row) for k in range(5)) for y, w in ((0, zero), (1, one))]
        assert p == pytest.approx(joint[1] / sum(joint), abs=2e-3)
    assert np.mean((post[where.ravel()] > 0.5) == truth) > 0.93
    assert accuracy[0, 1] > 0.8 > 0.2 > accuracy[0, 0]


def test_classifier_has_every_feature_with_support(spark):
    texts = [f"aaaa{k % 40:02d} bbbb{k % 7} idiot" if k % 4 == 0 else f"aaaa{k % 40:02d} cccc{k % 900:03d}" for k in range(900)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(900)], "doc_id long, toxic int")
    model = toxicity.fit(clashing(spark, texts), labels)
    trained = [t for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 4 != 2]
    counts = Counter(f for t in set(trained) for f in toxicity_features(t))
    assert set(model.weights) == {f for f, n in counts.items() if n >= toxicity.SUPPORT} and len(model.weights) > 50


# --- language model ---------------------------------------------------------------------------


@pytest.mark.parametrize(("stretch", "side"), [(4, 800), (3, 2), (1, 3)])
def test_counts_across_cuts_are_those_of_whole_texts(monkeypatch, stretch, side):
    rng = np.random.default_rng(1)
    part = lambda *shape: (lambda x: x / x.sum(-1, keepdims=True))(rng.random(shape))
    model = language_model.Model(part(1, 3), part(3, 3), part(3, 5).T)
    seqs = [np.array(rng.integers(0, 5, n), dtype=np.int16) for n in (1, 4, 5, 9, 26)]
    starts, moves, emits, log = np.zeros((1, 3)), np.zeros((3, 3)), np.zeros((5, 3)), 0.0
    for s in seqs:
        alpha = [model.first[0] * model.emit[s[0]]]
        for o in s[1:]:
            alpha.append((alpha[-1] @ model.move) * model.emit[o])
        beta = [np.ones(3)]
        for o in s[:0:-1]:
            beta.insert(0, model.move @ (model.emit[o] * beta[0]))
        total = alpha[-1].sum()
        log += math.log(total)
        starts[0] += alpha[0] * beta[0] / total
        for t, o in enumerate(s):
            emits[o] += alpha[t] * beta[t] / total
            if t:
                moves += np.outer(alpha[t - 1], model.emit[o] * beta[t]) * model.move / total
    monkeypatch.setattr(language_model, "STRETCH", stretch)
    monkeypatch.setattr(language_model, "SIDE_BY_SIDE", side)
    got = language_model.expected_counts(model, [s.tobytes() for s in seqs])
    for have, want in zip(got, (starts, moves, emits, log), strict=True):
        assert np.allclose(have, want)


def test_scores_match_a_plain_restatement(spark, monkeypatch):
    monkeypatch.setattr(language_model, "HEAD", 25)
    monkeypatch.setattr(language_model, "OWN", 10)
    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words[min(59, int(rng.expovariate(0.08)))] for _ in range(rng.randint(0, 30))) for _ in range(80)] + [None, "", " W1 never-seen "]
    docs = clashing(spark, texts)
    out = {r["doc_id"]: r for r in language_model.score_texts(docs, passes=1).collect()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in range(len(texts))}
    cut = [[*(t or "").lower().split(), ""] for t in texts]
    counts = Counter(w for k, c in enumerate(cut) if not held[k] for w in c)
    n, v = sum(counts.values()), len(counts)
    for k, tokens in enumerate(cut):
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        r = out[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0
    assert out[80]["score"] == out[81]["score"]


def test_the_head_is_bounded_and_holds_the_most_frequent(spark):
    rows = [(f"w{k:04d}".encode(), 1 + 5000 // (k + 1)) for k in range(4000)]
    words = spark.createDataFrame(rows, "word binary, c long")
    top = language_model.head_words(words, 300)
    assert 0 < len(top) <= 300 and top == sorted(rows, key=lambda r: (-r[1], r[0]))[: len(top)]
    assert language_model.head_words(words, 10_000) == sorted(rows, key=lambda r: (-r[1], r[0]))
    assert language_model.head_words(spark.createDataFrame([(f"x{k}".encode(), 1) for k in range(50)], "word binary, c long"), 10) == []


# --- URL rules --------------------------------------------------------------------------------


def test_of_equally_long_rules_the_first_listed_counts(spark):
    pages = spark.createDataFrame([("http://a.com/x/1",)], "url string")
    for rules in ({"a.com/": "block", "com/x/": "allow"}, {"com/x/": "allow", "a.com/": "block"}):
        row = url_filter.filter_urls(pages, pages.filter("false"), rules=rules).first()
        assert (row["rule"], row["verdict"]) == next(iter(rules.items()))


# --- near copies and the pipeline -------------------------------------------------------------


def shingle_set(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def plain_classes(texts):
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    return root


def test_one_row_of_each_class_stays(spark):
    text = " ".join(f"w{k}" for k in range(50))
    other = " ".join(f"v{k}" for k in range(50))
    texts = [text, text, text + " x", None, "", "", other, other, text, "two words", "two words"]
    ids = [1, 1, 2, 3, 4, 4, None, None, None, 7, 6]
    rows = near_duplicates.drop_near_duplicates(clashing(spark, texts, ids)).collect()
    got = Counter((r["doc_id"], r["text"]) for r in rows)
    assert got == Counter([(1, text), (3, None), (4, ""), (4, ""), (None, other), (6, "two words")])


def test_pipeline_matches_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    rows = {r["doc_id"]: r for r in docs.collect()}
    assert len(rows) == docs.count()

    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))

    def predicted(text):
        found = toxicity_features(text)
        return 1 / (1 + math.exp(-(model.bias + sum(model.weights.get(f, 0.0) for f in found)))) >= toxicity.THRESHOLD

    after = spark.createDataFrame([r for r in rows.values() if not predicted(r["text"])], docs.schema)
    stage = dict(corpus_pipeline.STAGES)
    got = stage["toxicity"](spark, docs, sf)
    assert got.columns == columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, after.collect()))

    def poor(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        seen = Counter(windows)
        covered = {k + o for k, w in enumerate(windows) if seen[w] > 1 for o in range(8)}
        return len(words) < 20 or 100 * len(covered) > 30 * len(words)

    # No host of this table stands out, as the README states.
    kept = [r for r in after.collect() if not poor(r["text"])]
    got = stage["quality_rules"](spark, after, sf)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, kept))

    kept.sort(key=lambda r: r["doc_id"])
    root = plain_classes([r["text"] for r in kept])
    distinct = [r for k, r in enumerate(kept) if root[k] == k]
    got = stage["near_dedup"](spark, spark.createDataFrame(kept, docs.schema), sf)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, distinct))

    cut = plain_cut([(r["doc_id"], r["text"]) for r in distinct])
    got = stage["substring_dedup"](spark, spark.createDataFrame(distinct, docs.schema), sf)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == cut and got.columns == columns

    sizes = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for k, t in cut.items()}
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {k: sum(r["n_tokens"] for r in packed if r["doc_id"] == k) for k in sizes} == sizes
    lengths = Counter(r["n_tokens"] for r in packed if r["n_tokens"])
    bounds = packing.optimal_bounds(list(lengths), list(lengths.values()), packing.N_BUCKETS)
    assert all(r["bucket_length"] == min(b for b in bounds if b >= r["n_tokens"]) for r in packed if r["n_tokens"])
    used = Counter((r["bucket"], r["batch"], r["slot"]) for r in packed if r["n_tokens"])
    assert set(used.values()) == {1}

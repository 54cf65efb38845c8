"""The operators against brute force, and their defined cases, on small tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from fieldspark.llm import fingerprints, host_rules, language_model, licenses, near_duplicates, packing, queries, sentencepieces, substrings, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, removed string"
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
LINE = "a passage of more than eight words that stands in several of the texts"


def rows_of(texts, source="s"):
    return [(k, t, "en", source, None, "clash", "clash", "clash") for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs, empty, blank and very long texts, ties, repeated rows, a NULL id, and clashing extra columns."""
    texts = [None, "", " \t\n", "word " * 30_000, BASE, BASE, BASE + " more", LINE + ".\n" + LINE, "é😀▁ \u0000 #*$"]
    rows = [*rows_of(texts), *rows_of(texts)[4:6], (None, BASE, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


def test_every_operator_takes_odd_rows_and_empty_tables(spark, odd, empty):
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(8)] + [(4, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    model = queries.TOKENIZER
    steps = {
        "packing": lambda d: packing.pack(d),
        "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, labels)),
        "host": lambda d: host_rules.judge(d),
        "licenses": lambda d: licenses.scan(d),
        "pieces": lambda d: sentencepieces.decode(sentencepieces.encode(d, model), model),
        "substrings": lambda d: substrings.drop_repeats(d),
        "urls": lambda d: url_filter.filter_urls(d.withColumnRenamed("text", "url"), d.select(d.text.alias("url")), rules=queries.URL_RULES),
        "fingerprints": lambda d: fingerprints.fingerprint_versions(d),
        "near": lambda d: near_duplicates.near_duplicate_classes(d),
        "language": lambda d: language_model.score_texts(d),
    }
    for name, step in steps.items():
        assert step(empty).count() == 0, name
        assert step(odd).count() == {"licenses": 0, "packing": 12 + 14}.get(name, 12), name


def test_packing_bounds_are_optimal_and_batches_full():
    rng = random.Random(3)
    for _ in range(30):
        sizes = rng.sample(range(1, 40), rng.randint(1, 7))
        counts = [rng.randint(1, 9) for _ in sizes]
        pad = lambda bounds: sum(c * (min(b for b in bounds if b >= s) - s) for s, c in zip(sizes, counts, strict=True))
        for k in (1, 2, 3):
            best = min(pad([*some, max(sizes)]) for n in range(min(k, len(sizes))) for some in itertools.combinations(sizes, n))
            assert pad(packing.optimal_bounds(sizes, counts, k)) == best


def test_packing_keeps_every_token(spark):
    rng = random.Random(1)
    texts = ["w " * rng.randint(0, 90) for _ in range(200)]
    out = packing.pack(spark.createDataFrame(rows_of(texts), SCHEMA), max_tokens=32, token_budget=128, n_buckets=3, salt_rows=10).collect()
    for k, t in enumerate(texts):
        assert sum(r["n_tokens"] for r in out if r["doc_id"] == k) == len(t.split())
    batches: dict = {}
    for r in out:
        if r["bucket"] is not None:
            batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    for (bucket, batch), some in batches.items():
        size = some[0]["bucket_length"]
        assert sorted(r["slot"] for r in some) == list(range(len(some))) and len(some) * size <= 128
        assert len(some) == 128 // size or batch == max(b for k, b in batches if k == bucket)


def test_measures_match_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 60))]
        n = len(words)
        windows = [tuple(words[k : k + 8]) for k in range(n - 7)]
        covered = {k + o for k, w in enumerate(windows) if windows.count(w) > 1 for o in range(8)}
        assert host_rules.repeated_words([w.encode() for w in words]) == len(covered)
    assert host_rules.measure("é #x\n\ny y\ny y\n".encode()) == (6, 7, 1, 3, 1, 0)


def test_substrings_keep_the_first_and_the_offsets(spark):
    texts = [f"own words here\n{LINE}", f"{LINE.upper()}\nother", f"Start of a text. {LINE}. End of it.", "short line\nshort line"]
    out = {r["doc_id"]: r for r in substrings.drop_repeats(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()}
    assert out[0]["text"] == texts[0] and out[3]["text"] == texts[3] and out[0]["removed"] == []
    assert out[1]["text"] == "other" and [tuple(s) for s in out[1]["removed"]] == [(0, len(LINE) + 1)]


def test_substrings_leave_passages_that_are_no_whole_unit(spark):
    short = "It has few words. So has this. And this one too."
    texts = [f"{LINE}.", f"He said that {LINE} and went on.", f"own start here\n{short}", f"Another start. {short} And another end of it."]
    out = {r["doc_id"]: r for r in substrings.drop_repeats(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()}
    assert all(out[k]["text"] == t and out[k]["removed"] == [] for k, t in enumerate(texts))


def test_pieces_round_trip_and_are_optimal():
    vocabulary = sentencepieces.load_vocabulary(queries.TOKENIZER)
    encoder = sentencepieces.WordEncoder(vocabulary)
    texts = ["", " lead", "two  blanks ", "a▁b\n\té😀", "thinking of the nation", "x" * 3000]
    ids = sentencepieces.encode_block(encoder, texts)
    assert [sentencepieces.decode_ids(vocabulary, i) for i in ids] == texts
    table = vocabulary.table

    def best(word):
        if not word:
            return 0.0
        return max((table[word[:k]][1] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in table), default=-1e300)

    for word in ("▁thinking", "▁nation", "▁erthand", "▁of,"):
        found = encoder.encode_sorted([word])[word]
        assert sum(vocabulary.scores[i] for i in found) == pytest.approx(best(word))
    together = encoder.encode_sorted(sorted(["▁the", "▁then", "▁thenation", "▁th"]))
    assert all(together[w] == encoder.encode_sorted([w])[w] for w in together)


def test_fingerprints_match_brute_force(spark):
    rng = random.Random(2)
    texts = [".\n".join(rng.choice(["alpha beta", "gamma", "delta x", "eps", "zeta", f"own {k} {j}"]) for j in range(rng.randint(0, 40))) for k in range(60)]
    texts += [texts[3], "\n".join(f"line {k}" for k in range(400))]
    out = {r["doc_id"]: r for r in fingerprints.fingerprint_versions(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()}

    def units(t):
        t = re.sub(r"([.!?])[ \t]+", "\\1\n", t)
        return {p.strip(" ") for p in t.split("\n")} - {""}

    def likeness(a, b):
        return len(units(a) & units(b)) / len(units(a) | units(b)) if units(a) | units(b) else 1.0

    for k, t in enumerate(texts):
        after = texts[k - 1]
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        assert out[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and out[k]["n_chars"] == len(t)
        assert out[k]["near_edited"] == pytest.approx(likeness(t, edited)) and out[k]["near_next"] == pytest.approx(likeness(t, after))
    assert out[3]["fingerprint"] == out[60]["fingerprint"]


def test_fingerprints_cut_texts_of_every_size_alike(spark):
    said = [f"Sentence {k} of this text says something of its own{'.!?'[k % 3]}" for k in range(60)]
    # The edited form of the second text is under 1,000 code points; the third has no line end.
    texts = ["Tiny text. Two.", " ".join(said[:22]), " ".join(said)]
    edited = [t[: len(t) - len(t) // 3] + texts[k - 1][: len(t) // 3] for k, t in enumerate(texts)]
    assert len(edited[1]) < 1000 < len(texts[1])
    units = lambda t: {p.strip(" ") for p in re.sub(r"([.!?])[ \t]+", "\\1\n", t).split("\n")} - {""}
    likeness = lambda a, b: len(units(a) & units(b)) / len(units(a) | units(b))
    out = {r["doc_id"]: r for r in fingerprints.fingerprint_versions(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()}
    for k, t in enumerate(texts):
        assert out[k]["near_edited"] == pytest.approx(likeness(t, edited[k])) and out[k]["near_next"] == pytest.approx(likeness(t, texts[k - 1]))
    assert min(out[1]["near_edited"], out[2]["near_edited"]) > 0.4


def test_near_duplicates_match_brute_force_in_a_large_group(spark):
    rng = random.Random(4)
    base = [f"w{k}" for k in range(80)]
    texts = []
    for k in range(150):
        words = list(base)
        for at in rng.sample(range(80), rng.choice([0, 1, 2, 3, 6])):
            words[at] = f"x{k}_{at}"
        texts.append(" ".join(words))
    texts += [" ".join(f"o{k}_{j}" for j in range(30)) for k in range(20)] + ["", "same two", "same two"]
    sets = [set(zip(*[t.split()[o:] for o in range(5)])) if len(t.split()) >= 5 else ({tuple(t.split())} if t.split() else set()) for t in texts]
    root = list(range(len(texts)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            low, high = sorted((top(a), top(b)))
            root[high] = low
    out = near_duplicates.near_duplicate_classes(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out} == {k: (len(s), top(k), top(k) == k) for k, s in enumerate(sets)}


def test_forward_score_is_the_sum_over_all_paths():
    rng = np.random.default_rng(0)
    k, n = 3, 5
    part = lambda *shape: (lambda x: x / x.sum(-1, keepdims=True))(rng.random(shape))
    model = language_model.Model(part(2, k), part(k, k), part(k, n).T)
    seqs = [np.array(rng.integers(0, n, size), dtype=np.int16) for size in (1, 4, 6)]
    got = language_model.forward_log10(model, [s.tobytes() for s in seqs])
    for s, value in zip(seqs, got, strict=True):
        total = 0.0
        for path in itertools.product(range(k), repeat=len(s)):
            p = model.first[0, path[0]] * model.emit[s[0], path[0]]
            for a, b, o in zip(path, path[1:], s[1:], strict=False):
                p *= model.move[a, b] * model.emit[o, b]
            total += p
        assert value == pytest.approx(np.log10(total))
    starts, moves, emits, log = language_model.expected_counts(model, [s.tobytes() for s in seqs])
    assert starts.sum() == pytest.approx(3) and moves.sum() == pytest.approx(8) and emits.sum() == pytest.approx(11)
    assert log == pytest.approx(got.sum() * np.log(10))


def test_language_model_and_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    scored = [r for r in queries.op10_hidden_markov(spark, sf).collect() if r["held_out"]]
    assert sum(r["score"] for r in scored) > sum(r["base_score"] for r in scored)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in scored)
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = [r for r in queries.op2_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in truth]
    caught = sum(r["predicted"] and truth[r["doc_id"]] for r in found)
    assert caught >= 0.6 * sum(truth[r["doc_id"]] for r in found) and caught >= 0.7 * sum(r["predicted"] for r in found)


def test_toxicity_learns_the_same_from_copies_and_keeps_every_listed_word(spark):
    rng = random.Random(6)
    plain = [f"common{k:03d}" for k in range(300)]
    insults = [hashlib.md5(str(k).encode()).hexdigest()[:12] for k in range(450)]
    texts = [" ".join(rng.sample(plain, 40)) for _ in range(300)]
    texts += [" ".join(rng.sample(plain, 20) + [insults[(30 * k + j) % 450] for j in range(30)]) for k in range(200)]
    texts += [" ".join([*(f"rare{k}" for k in range(300)), *insults[:2]])] * 100
    labels = spark.createDataFrame([(k, int(k >= 300)) for k in range(len(texts))], "doc_id long, toxic int")
    fitted = [toxicity.fit(spark.createDataFrame(rows_of(some), SCHEMA), labels) for some in (texts[:502], texts)]
    assert any(zlib.crc32(str(k).encode()) % 4 != 2 for k in (500, 501))
    assert fitted[0].learned == fitted[1].learned and fitted[0].weights == pytest.approx(fitted[1].weights)
    assert {b"=" + w.encode() for w in insults} <= fitted[1].learned.keys() and not any(f.startswith(b"=rare") for f in fitted[1].learned)


def test_url_list_has_no_false_positives(spark):
    pages = spark.createDataFrame([(k, f"http://www.a.com/p{k}/?utm_source=x&b={k}") for k in range(3000)] + [(-1, None), (-2, "no scheme")], "page_id long, url string")
    listed = spark.createDataFrame([(f"https://A.com:443/p{k}?b={k}",) for k in range(0, 3000, 7)] + [(None,)], "url string")
    out = {r["page_id"]: r for r in url_filter.filter_urls(pages, listed).collect()}
    assert all(out[k]["listed"] == (k % 7 == 0) for k in range(3000)) and out[-1]["verdict"] == out[-2]["verdict"] == "allow" and out[-1]["host"] == ""

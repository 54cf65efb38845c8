"""The Merkle manifest, the ranked search and the vector join against brute force, and their defined cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from fieldspark.llm import merkle, queries, search, vector_join

DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, score string, tree string, id string, terms string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash", "clash") for r in rows], DOCS)


# --- Merkle manifest -------------------------------------------------------------------


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest(["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def climb(levels, k, changed):
    """Siblings level by level, and the root that a changed node leads to."""
    proof = []
    for nodes in levels[:-1]:
        first = k - k % 8
        run = list(nodes[first : first + 8])
        proof += run[: k - first] + run[k - first + 1 :]
        run[k - first] = changed
        changed, k = digest(run), k // 8
    return proof, changed


def expected_audit(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [levels_of([entry[2] for entry in sorted(groups[g], key=lambda e: e[:3])]) for g in names]
    top = levels_of([t[-1][0] for t in trees])
    out = Counter()
    for place, name in enumerate(names):
        for k, (_, _, leaf, row) in enumerate(sorted(groups[name], key=lambda e: e[:3])):
            changed = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                lower = None if row[4] is None else re.sub("[A-Z]", lambda m: m[0].lower(), row[4])
                changed = leaf_of((*row[:4], lower))
            proof, end = climb(trees[place], k, changed)
            proof_up, end = climb(top, place, end)
            root = top[-1][0]
            out[(row[0], leaf, trees[place][-1][0], root, digest(proof + proof_up), end, end == root)] += 1
    return out


def audited(docs):
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return Counter(tuple(r[c] for c in columns) for r in merkle.audit(merkle.build_manifest(docs)).collect())


def odd_rows():
    rng = random.Random(2)
    rows = [(k, rng.choice(["s", None]), "big", k, f"Text {k}") for k in range(1200)]
    rows += [(k, "s", rng.choice(["éa", "b", "", None, "-"]), None, rng.choice([None, "", "Abc É", "x" * 50_000])) for k in range(60)]
    rows += [(None, None, None, None, None), (None, "s", "b", 1, "N"), rows[3], rows[3], (7, "s", "big", 7, "another row of id 7")]
    return rows


def test_van_emde_boas_addresses_are_a_permutation_and_recursive():
    for levels in (1, 2, 3, 4):
        places = [a for d in range(levels) for a in merkle.addresses(d, np.arange(8**d), levels).tolist()]
        assert sorted(places) == list(range(merkle.tree_size(levels)))
    # Four levels: the two upper ones fill the first nine places, then each lower subtree lies in one stretch.
    assert sorted(merkle.addresses(1, np.arange(8), 4).tolist()) == list(range(1, 9))
    for k in range(64):
        below = merkle.addresses(3, np.arange(8 * k, 8 * k + 8), 4)
        assert below.tolist() == list(range(9 + 9 * k + 1, 9 + 9 * k + 9)) and merkle.addresses(2, np.array([k]), 4)[0] == 9 + 9 * k


def test_audit_matches_brute_force(spark):
    rows = odd_rows()
    assert audited(documents(spark, rows)) == expected_audit(rows)
    assert audited(documents(spark, rows[:1])) == expected_audit(rows[:1])


def test_audit_through_several_tiers_and_range_partitions(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RUN_ROWS", 700)
    rows = [(k, "s", "one", k, "T") for k in range(5000)] + [(k, "s", f"l{k}", k, "T") for k in range(530)]
    assert audited(documents(spark, rows)) == expected_audit(rows)


def test_manifest_of_nothing(spark):
    empty = documents(spark, odd_rows()).filter("false")
    manifest = merkle.build_manifest(empty)
    assert manifest.root is None and merkle.audit(manifest).count() == 0 and manifest.blocks().count() == 0


# --- ranked search -----------------------------------------------------------------------


def plain_terms(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def expected_search(items, texts, k):
    bags = [(i, Counter(plain_terms(t))) for i, t in texts]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_texts, n_terms = len(bags), sum(n for _, _, n in bags)
    out = Counter()
    for item, text in items:
        found = []
        for i, bag, n in bags:
            m = 100 - 90 + (90 * n * n_texts) // n_terms
            score = 0
            for t in set(plain_terms(text)):
                if bag[t]:
                    df = sum(1 for _, b, _ in bags if b[t])
                    w = math.floor(1000 * math.log((2 * n_texts + 2) / (2 * df + 1)))
                    score += w * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        for rank, f in enumerate(sorted(found, key=lambda f: f[:3])[:k]):
            out[(item, rank + 1, f[3], -f[0])] += 1
    return out


def searched(spark, items, texts, **options):
    q = spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, score string")
    d = spark.createDataFrame([(*t, "clash", "clash") for t in texts], "doc_id long, text string, item_id string, n string")
    return Counter(tuple(r) for r in search.search(q, d, **options).select("item_id", "rank", "doc_id", "score").collect())


def odd_texts(rng, n=400):
    words = [f"w{k}" for k in range(60)]
    texts = [(k, " ".join(words[min(59, int(rng.expovariate(0.12)))] for _ in range(rng.randint(1, 25)))) for k in range(n)]
    texts += [(1000 + k, "W1 w2-w3 é_w4") for k in range(30)]  # ties
    return texts + [(2000, None), (2001, ""), (2002, " \t!"), (None, "w1 w2 w3"), (5, "w1 w1"), (5, "w1 w1"), (2003, "w5 " * 30_000)]


def test_search_matches_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    texts = odd_texts(rng)
    items = [(k, t) for k, t in rng.sample(texts[:400], 20)] + [(1, "w1 w2 w3 w4"), (1, "É é"), (None, "w9 unknown"), (77, None), (78, "unknown only")]
    want = expected_search(items, texts, 10)
    assert searched(spark, items, texts) == want
    # Several blocks of items give the same.
    assert searched(spark, items, texts, item_bytes=300) == want
    assert searched(spark, items, texts, k=3) == expected_search(items, texts, 3)
    assert not searched(spark, items[:3], []) and not searched(spark, [], texts)


def test_best_positions_end_before_the_last_read_and_lose_nothing():
    rng = np.random.default_rng(3)
    for trial in range(40):
        n_docs, n_terms = 3000, 6
        held = rng.random((n_terms, n_docs)) < 0.6
        impact = np.where(held, rng.integers(1, 50 if trial % 2 else 100_000, (n_terms, n_docs)), 0)
        term, doc = np.nonzero(impact)
        lists = search.ImpactLists(doc.astype(np.int64), term.astype(np.int64), impact[term, doc].astype(np.int64), n_docs)
        weights = rng.integers(0, 2000, n_terms)
        total = weights @ impact
        rank = rng.permutation(n_docs)
        order = np.lexsort((rank, -total))[:10]
        docs, scores = lists.best(np.arange(n_terms), weights, 10, 0, rank)
        have = sorted(zip((-scores).tolist(), rank[docs].tolist(), strict=True))
        assert have == sorted((-int(total[d]), int(rank[d])) for d in order if total[d] > 0)
        # Documents that tie with a floor are kept, those below it are not.
        docs, scores = lists.best(np.arange(n_terms), weights, 10, int(total[order[4]]), rank)
        assert (scores >= total[order[4]]).all() and set(order[:5]) <= set(docs.tolist())
        assert not lists.met.any()


# --- vector join --------------------------------------------------------------------------


def expected_classes(rows, width, cosine=0.95):
    usable = [i for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    x = np.array([np.pad(np.array(v, dtype=float), (0, width - len(v))) for i, v in rows if i is not None and v and all(e is not None and math.isfinite(e) for e in v) and any(v)])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    linked = unit @ unit.T >= cosine
    np.fill_diagonal(linked, False)
    label = np.array(usable)
    while True:
        lower = np.minimum(label, np.where(linked, label[None, :], 10**9).min(1))
        if (lower == label).all():
            break
        label = lower
    out = Counter((i, int(n), int(c), i == c) for i, n, c in zip(usable, linked.sum(1), label, strict=True))
    kept = Counter(usable)
    for i, _ in rows:
        if i is None:
            out[(None, 0, None, True)] += 1
        elif kept[i]:
            kept[i] -= 1
        else:
            out[(i, 0, i, True)] += 1
    return out


def odd_vectors(rng, n=900, width=12):
    base = rng.normal(size=(150, width))
    rows = []
    for k in range(n):
        off = rng.normal(size=width) * rng.choice([0, 0.05, 0.2, 0.35])
        rows.append((k, (base[min(int(rng.exponential(15)), 149)] + off).tolist()))
    rows += [(2000, None), (2001, []), (2002, [0.0] * width), (2003, [1.0, None] * 6), (2004, [float("nan")] * width), (2005, [float("inf")] * width)]
    return rows + [(None, rows[0][1]), (5, rows[7][1]), (5, rows[7][1]), (2006, rows[0][1][:7]), (2007, [1e-200] * width), (2008, [1e200] * width)]


@pytest.mark.parametrize("tile", [100, 100_000])
def test_vector_classes_match_brute_force(spark, tile):
    rows = odd_vectors(np.random.default_rng(tile))
    # The brute force would overflow on the squares of the last two, which only link with each other.
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "vec_id long, embedding array<double>, label string, digest string")
    got = Counter(tuple(r) for r in vector_join.near_vector_classes(df, tile=tile).select("vec_id", "n_links", "component_id", "kept").collect())
    scaled = [(i, None if v is None else [1.0] * 12 if i in (2007, 2008) else v) for i, v in rows]
    assert got == expected_classes(scaled, 12)


def test_vector_classes_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vector_join.near_vector_classes(df).count() == 0
    alone = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in vector_join.near_vector_classes(alone).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_runs_that_are_skipped_hold_no_link(monkeypatch):
    monkeypatch.setattr(vector_join, "LEAF", 8)
    rng = np.random.default_rng(9)
    vectors = np.repeat(rng.normal(size=(60, 5)), 5, axis=0) + 0.1 * rng.normal(size=(300, 5))
    unit = vector_join._unit(vectors)
    axes = np.linalg.qr(rng.normal(size=(5, 3)))[0]
    order = np.lexsort(np.floor(vector_join.places_of(unit, unit.mean(0), axes) / 0.3).T[::-1])
    side = vector_join._Side(vectors[order], np.ones(300), unit.mean(0), axes)
    near = set(vector_join.leaf_pairs(side, side, vector_join.squared_reach(0.95)))
    every = {(i, j) for i in range(38) for j in range(i, 38)}
    assert near < every
    cosines = side.units @ side.units.T
    for i, j in every - near:
        assert (cosines[i * 8 : i * 8 + 8, j * 8 : j * 8 + 8] < 0.95).all()


def test_new_queries_are_registered():
    for name in ("op11_merkle_manifest", "op12_best_position", "op13_grid_order_join"):
        assert name in queries.QUERIES and name in queries.ORACLES

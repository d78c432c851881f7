"""Ranked search, fingerprints and hard negatives against brute force, and on odd rows."""

import hashlib
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
import regex

from fieldorder.llm import hard_negatives, lexical, queries, syncmers

SF = "/root/testdata/sf0.001"
TERM = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("name", ["op11_ranked_search", "op13_hard_negatives"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.SQL[name]).df()
    cols = sorted(want.columns)
    assert len(got) > 100 and sorted(got.columns) == cols
    assert sorted(map(tuple, got[cols].values.tolist())) == sorted(map(tuple, want[cols].values.tolist()))


# ---- ranked search


def folded(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute_ranking(docs, items, k):
    split = [(i, Counter(folded(t))) for i, t in docs]
    split = [(i, c, sum(c.values())) for i, c in split if c]
    total, words = len(split), sum(n for _, _, n in split)
    holding = Counter(t for _, c, _ in split for t in c)
    texts = {}
    for i, t in items:
        texts.setdefault(i, set()).add(t or "")
    out = {}
    for item, some in texts.items():
        wanted = Counter(t for text in some for t in folded(text))
        rows = []
        for i, c, n in split:
            m = 75 + 25 * n * total // words
            s = sum(
                times * math.floor(1000 * math.log((2 * total + 2) / (2 * holding[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                for t, times in wanted.items() if t in c
            )
            if s > 0:
                rows.append((-s, i is None, i))
        out[item] = [(i, -s) for s, _, i in sorted(rows, key=lambda r: (r[0], r[1], r[2] or 0))[:k]]
    return {i: r for i, r in out.items() if r}


def search_rows():
    r = random.Random(11)
    words = ["".join(r.choice("abcdeé9") for _ in range(r.randint(1, 3))) for _ in range(150)]
    prose = lambda n: r.choice([" ", ", ", "_", "\n"]).join(r.choice(words).title() for _ in range(n))
    docs = [(i, prose(r.choice([1, 5, 30, 120]))) for i in range(400)]
    docs += [(400 + i, docs[7][1]) for i in range(30)]  # equal scores
    docs += [(5, docs[5][1]), (5, docs[5][1]), (None, docs[9][1]), (None, None), (900, None), (901, ""), (902, " ._\x00{} "), (903, prose(200_000))]
    items = [(i, prose(r.choice([1, 3, 20]))) for i in range(25)] + [(50, docs[7][1]), (51, docs[5][1]), (None, "9 a")]
    items += [(60, None), (61, ""), (62, "zzzzzz"), (63, " ".join(f"{w} {w}x{i}" for i, w in enumerate(words))), (0, "a b a"), (64, "a"), (64, "a")]
    return docs, items


@pytest.mark.parametrize("k,docs_a_block,item_bytes", [(20, 8192, 10**7), (3, 64, 10**7), (20, 100, 400)])
def test_ranked_search(spark, monkeypatch, k, docs_a_block, item_bytes):
    docs, items = search_rows()
    monkeypatch.setattr(lexical, "ITEM_BYTES", item_bytes)
    monkeypatch.setattr(lexical, "BLOCK_DOCS", docs_a_block)
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, score string").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    got = {}
    for x in sorted(lexical.rank_documents(d, q, k).collect(), key=lambda x: x["rank"]):
        rows = got.setdefault(x.item_id, [])
        rows.append((x.doc_id, x.score))
        assert x["rank"] == len(rows)
    assert got == brute_ranking(docs, items, k)
    assert lexical.rank_documents(d.where("false"), q, k).count() == 0 and lexical.rank_documents(d, q.where("false"), k).count() == 0


# ---- fingerprints


def slow_anchors(text, k, s):
    """Straight from the definition, with the hashes of single stretches."""
    one = lambda x: int(syncmers._selected(syncmers._points(x), len(x), len(x))[1][0])
    inner = lambda x: int(syncmers._mixed(np.array([sum(
        int(syncmers._mixed(np.array([ord(c) + 1], np.uint64))[0]) * pow(syncmers._MULTIPLIER, j, 2**64) for j, c in enumerate(x)) % 2**64], np.uint64))[0])
    out = []
    for i in range(len(text) - k + 1):
        h = [inner(text[j : j + s]) for j in range(i, i + k - s + 1)]
        if min(h) in (h[0], h[-1]):
            out.append((i, one(text[i : i + k])))
    return out


def test_anchors_are_closed_syncmers():
    r = random.Random(2)
    for n in (40, 60, 150):
        text = "".join(r.choice("ab é🙂") for _ in range(n))
        at, hashes = syncmers.anchors([text], 12, 4)[0]
        assert list(zip(at.tolist(), hashes.tolist())) == slow_anchors(text, 12, 4)


def test_anchors_depend_on_no_context(monkeypatch):
    r = random.Random(1)
    monkeypatch.setattr(syncmers, "SEGMENT", 4096)
    some = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    texts = [some(r.choice([0, 1, 5, 39, 40, 41, 80, 300, 1500])) for _ in range(80)] + ["a" * 500, some(20_000)]
    found = syncmers.anchors(texts)
    for text, (at, hashes) in zip(texts, found):
        if len(text) >= syncmers.K:
            whole = {}
            for i in range(len(text) - syncmers.K + 1):
                a, h = syncmers._selected(syncmers._points(text[i : i + syncmers.K]), syncmers.K, syncmers.S)
                whole.update({i: h[0]} if len(a) else {})
            assert dict(zip(at.tolist(), hashes)) == whole or (not whole and len(at) == 1 and len(text) < 2 * syncmers.K)
            assert np.diff(at, prepend=-1).max() <= syncmers.K - syncmers.S + 1
        again = syncmers.read_fingerprint(syncmers.fingerprint((at, hashes)))
        assert (again[0] == at).all() and (again[1] == hashes).all() and syncmers.likeness(again, (at, hashes)) == 1
    for _ in range(600):
        i, j = r.randrange(len(texts)), r.randrange(len(texts))
        want = syncmers.anchors([syncmers.edited(texts[i], texts[j])])[0]
        got = syncmers.edited_anchors(texts[i], found[i], texts[j], found[j])
        assert want[0].tolist() == got[0].tolist() and want[1].tolist() == got[1].tolist()


def test_likeness_goes_by_place():
    r = random.Random(3)
    a, b, c = ("".join(r.choice("abcdefgh ") for _ in range(4000)) for _ in range(3))
    f = lambda t: syncmers.anchors([t])[0]
    assert syncmers.likeness(f(a), f(b)) == 0 and syncmers.likeness(f(""), f("")) == 1 and syncmers.likeness(f(""), f(a)) == 0
    assert syncmers.likeness(f(a), f("some words first " + a)) > 0.98
    assert 0.4 < syncmers.likeness(f(a + b), f(a + c)) < 0.6
    mixed = [a[i : i + 44] for i in range(0, 4000, 44)]
    r.shuffle(mixed)
    assert syncmers.likeness(f(a), f("".join(mixed))) < 0.2  # shared anchors, but elsewhere


def test_fingerprints(spark):
    r = random.Random(4)
    some = lambda n: "".join(r.choice("abcdefgh é\n") for _ in range(n))
    rows = [(i, some(r.choice([0, 1, 2, 30, 41, 200, 900]))) for i in range(120)] + [(200, some(700_000)), (201, None), (202, ""), (None, "last"), (-5, "first")]
    rows += [(7, "other"), (300, "same"), (301, "same")] + [(150, "again and again, " * 9)] * 40 + [(None, None)] * 3
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_chars int, near_next string").repartition(5).cache()
    got = syncmers.fingerprints(d).collect()
    assert len(got) == len(rows)
    prints = {}
    for x in got:
        prints.setdefault(x.doc_id, []).append(x)
    one = sorted((i, t or "") for i, t in rows if i is not None and [j for j, _ in rows].count(i) == 1)
    texts = dict(one)
    order = sorted({i for i, _ in rows if i is not None})
    checked = 0
    for i, after in zip(order, order[1:]):
        if i not in texts or after not in texts:
            continue
        checked += 1
        (x,), text, later = prints[i], texts[i], texts[after]
        assert bool(x.fingerprint) == bool(text)
        changed = syncmers.edited(text, later)
        a, e, n = syncmers.anchors([text, changed, later])
        assert x.n_chars == len(text) and x.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert (x.fingerprint, x.edited_fingerprint) == (syncmers.fingerprint(a), syncmers.fingerprint(e))
        assert (x.near_edited, x.near_next) == (syncmers.likeness(a, e), syncmers.likeness(a, n))
    assert checked > 100 and len({x.fingerprint for x in prints[150]}) == 1 and prints[300][0].fingerprint == prints[301][0].fingerprint
    assert sorted(x.near_next for x in prints[150])[1] == 1  # repeated rows follow each other, but for the last
    assert [x.near_next for x in syncmers.fingerprints(d.where("doc_id = 300")).collect()] == [1]
    assert syncmers.fingerprints(d.where("false")).count() == 0


def test_the_last_document_is_followed_by_the_first(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((x.doc_id, x.text) for x in d.collect())
    got = {x.doc_id: x for x in syncmers.fingerprints(d).collect()}
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()


# ---- hard negatives


def brute_negatives(rows, positives=5, negatives=3, low=50, high=95):
    kept = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        kept[i] = min(kept.get(i, (label, v)), (label, v))
    whole = {i: (label, [int(c) * 256 if abs(c) >= 2**53 else math.floor(256 * c) for c in v]) for i, (label, v) in kept.items()}
    hold = lambda s: max(-hard_negatives.TOP, min(hard_negatives.TOP, s))
    out = set()
    for a, (label, v) in whole.items():
        if a % 50:
            continue
        scored = [(-hold(sum(p * q for p, q in zip(v, w))), i, lab == label) for i, (lab, w) in whole.items() if i != a and len(w) == len(v)]
        for p, i, _ in [x for x in sorted(scored) if x[2]][:positives]:
            fit = [(n, j) for n, j, same in sorted(scored) if not same and low * -p <= 100 * -n <= high * -p]
            out |= {(a, i, k, j, -p, -n) for k, (n, j) in enumerate(fit[:negatives], 1)}
    return out


@pytest.mark.parametrize("cells", [1_000_000, 700])
def test_hard_negatives(spark, monkeypatch, cells):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(hard_negatives, "ROW_CELLS", cells)
    monkeypatch.setattr(hard_negatives, "ANCHOR_CELLS", cells // 10)
    monkeypatch.setattr(hard_negatives, "TILE", 1000)
    vecs = np.round(rng.standard_normal((400, 8)) * 0.3 + 0.2, 2)  # ties are common
    vecs[200:260] = vecs[0]
    rows = [(i, v.tolist(), int(l)) for i, (v, l) in enumerate(zip(vecs, rng.integers(0, 3, 400) * rng.integers(0, 2, 400)))]
    nan, inf = float("nan"), float("inf")
    rows += [(1000, None, 1), (1050, [nan] * 8, 1), (1100, [inf] + [0.1] * 7, 1), (1150, [0.1, None] * 4, 1), (1200, [0.5] * 8, None), (None, [0.5] * 8, 1)]
    rows += [(1250, [], 1), (1251, [], 1), (1252, [], 0), (1300, [0.0] * 8, 1), (1350, [0.4] * 5, 1), (1351, [0.4] * 5, 1), (1352, [0.3] * 5, 0)]
    rows += [(50, rows[50][1], rows[50][2]), (100, [0.1] * 8, -4), (1400, [-0.5] * 8, 7), (1401, [0.5] * 8, 7)]  # repeated row, two rows of one id, a negative score
    d = spark.createDataFrame([(*x, 1, 2) for x in rows], "vec_id long, embedding array<double>, label int, id int, score int").repartition(3)
    got = [tuple(x) for x in hard_negatives.mine(d, "id % 50 = 0").collect()]
    assert len(got) == len(set(got)) > 60 and set(got) == brute_negatives(rows)
    assert hard_negatives.mine(d.where("false"), "id % 50 = 0").count() == 0


def test_hard_negatives_of_large_components(spark):
    big = [(0, [1e15, 3.0], 1), (1, [1e15, 5.0], 1), (2, [0.9e15, 1.0], 0), (3, [0.5e15, 7.0], 0), (50, [1e308, -1e308], 0), (51, [1e308, 2.0], 0), (52, [6e307, 0.0], 1)]
    d = spark.createDataFrame(big, "vec_id long, embedding array<double>, label int")
    assert {tuple(x) for x in hard_negatives.mine(d, "id % 50 = 0").collect()} == brute_negatives(big)

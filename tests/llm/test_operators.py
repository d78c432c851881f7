"""Every operator against a brute-force version on small tables, and on nulls, empty, long, tied and repeated rows."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldorder.llm import ann, chat, html_text, line_dedup, mixing, ngram_join, packing, quality, queries, tokens, url_filter
from fieldorder.llm.components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, size string, label string"  # the last two names clash with columns in use
PATH = public_tokenizers.path("word_bpe_49k.json")
TOK = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def words():
    r = random.Random(5)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(3000)]


@pytest.fixture(scope="module")
def docs(spark, words):
    r = random.Random(6)
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = [prose(r.randint(60, 200)) for _ in range(20)]
    rows = [(i, t, f"s{i % 4}") for i, t in enumerate(base)]
    for i in range(20, 60):  # copies and near copies of the first ten
        t = base[i % 10].split()
        if i % 3:
            t[r.randrange(len(t))] = r.choice(words)
        rows.append((i, " ".join(t), None if i % 7 == 0 else "s1"))
    rows += [(60, None, "s1"), (61, "", None), (62, " \n\t ", "s2"), (63, "one two", "s2"), (64, "one two", "s3")]
    rows += [(65, prose(15000), "s1"), (66, "It's <|endoftext|> x\x1cy É Σ 12 z", "s0"), (None, base[0], "s0"), (3, base[3], "s3")]
    return spark.createDataFrame([(*x, "a", "b") for x in rows], DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def text_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def encoded(text):
    return TOK.encode(text, add_special_tokens=False).ids


def test_packing(spark, docs):
    got = packing.packed(docs, PATH, ids=True).collect()
    want = Counter()
    for i, t in text_of(docs):
        ids = [*encoded(t), 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            b = np.array(ids[at : at + 4096], "<u4").tobytes()
            want[i, k, at, len(b) // 4, zlib.crc32(b), b] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == want
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    ends = {}
    for s, o, n in places:
        assert o == ends.get(s, 0)
        ends[s] = o + n
    assert max(ends.values()) <= 4096
    assert packing.packed(empty(spark), PATH).count() == 0


def test_plan_needs_few_sequences():
    r = random.Random(1)
    for trial in range(200):
        cap = r.choice([12, 30, 64])
        counts = Counter(r.choice([r.randint(1, cap), r.randint(cap // 3, cap // 2 + 1)]) for _ in range(r.randint(1, 60)))
        used, number = {}, Counter()
        for n, first, many, seq, offset in packing.plan(dict(counts), cap):
            assert first == number[n]
            number[n] += many
            for i in range(many):
                used.setdefault(seq + i, []).append((offset, n))
        assert number == counts
        for parts in used.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= cap
        total = -(-sum(n * c for n, c in counts.items()) // cap)
        large = sum(c for n, c in counts.items() if 2 * n > cap)
        assert len(used) <= 1.25 * max(total, large) + 1


def test_token_counts(spark, docs):
    for k in (4, 65_536):
        got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(docs, PATH, k=k).collect())
        assert got == Counter((i, len(t.encode()), len(encoded(t)), len(encoded(t)) > 2048) for i, t in text_of(docs))
    model = public_tokenizers.path("piece_bpe_32k.model")
    assert {r.n_tokens for r in tokens.token_counts(docs.where("doc_id in (60, 61)"), model).collect()} == {0}
    assert tokens.token_counts(empty(spark), PATH).count() == 0


def test_odd_texts_have_the_librarys_ids():
    r = random.Random(2)
    memo = tokens.WordMemo(open(PATH, "rb").read())
    signs = list("aAzZ'sStT .,!?\t\n\x0b\x1c\x85  éÉßİΣσςñ中文字🙂é12½²ªµ-_") + ["<|endoftext|>", "'re", "'LL"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    assert memo.ids(texts) == [np.array(encoded(t), "<u4").tobytes() for t in texts]


def test_nearest(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((1500, 16)).astype("float32")
    v[50:60] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0, None] * 8), (2004, []), (0, v[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = df.where("vec_id % 100 = 0")
    got = {}
    for r in ann.nearest(df, q).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    hits = 0
    for i in range(0, 1500, 100):
        d = np.sqrt(((v.astype(float) - v[i].astype(float)) ** 2).sum(1))
        best = sorted((x, j) for j, x in enumerate(d) if j != i)[:10]
        assert len(got[i]) == 10 and got[i] == sorted(got[i]) and all(abs(s - d[j]) < 1e-12 for s, j in got[i])
        hits += len({j for _, j in best} & {j for _, j in got[i]})
    assert hits >= 0.9 * 150 and set(got) == set(range(0, 1500, 100))
    assert [j for _, j in got[0]] == list(range(50, 60))
    nameless = df.unionByName(df.limit(5).withColumn("vec_id", F.lit(None).cast("long")))
    assert ann.nearest(nameless, nameless.where("vec_id % 100 = 0 OR vec_id IS NULL")).where("query_id IS NULL OR vec_id IS NULL").count() == 0
    large = spark.createDataFrame([(i, [1e200 * i, -1e200]) for i in range(4)], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in ann.nearest(large, large.where("vec_id = 0"), k=3).orderBy("rank").collect()] == [(i, 1e200 * i) for i in (1, 2, 3)]
    few = ann.nearest(df.where("vec_id < 3"), q.where("vec_id = 0")).collect()
    assert [r.vec_id for r in few] != [] and len(few) == 2
    assert ann.nearest(df.where("false"), q).count() == 0


def test_quality(spark, docs, words):
    r = random.Random(9)
    junk = [
        ("loop", "spam and eggs for all of us today " * 60), ("noise", "".join(chr(33 + r.randrange(94)) + " " * (k % 7 == 0) for k in range(9000))),
        ("short", "a b c"), ("clean", " ".join(r.choice(words) for _ in range(400))),
    ]
    d = spark.createDataFrame([(t, x, "", "", "") for t, x in junk], DOCS.replace("long", "string", 1))
    kept = {x.doc_id: x.kept for x in quality.quality(d).collect()}
    assert kept == {"loop": False, "noise": False, "short": False, "clean": True}
    for x in quality.quality(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        w = (x.text or "").encode().split()
        tri = Counter(zip(w, w[1:], w[2:]))
        cover = {i + j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = (x.text or "").split("\n")
        dup = sum(bool(a.split()) and a in lines[:k] for k, a in enumerate(lines))
        assert (x.n_words, x.n_repeat_words, x.n_dup_lines) == (len(w), len(cover), dup)
        assert x.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (x.base_failed and x.kept)
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and good.count() == quality.quality(docs).where("kept").count()
    assert quality.quality(empty(spark)).count() == 0


def test_quality_bands_decide(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    label = {x.doc_id: x.quality for x in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = quality.quality(docs).collect()
    lost = lambda q: [not x.kept for x in rows if not x.base_failed and label.get(x.doc_id) == q]
    junk, good = lost(0), lost(1)
    assert sum(junk) >= 0.75 * len(junk) > 0 and sum(good) <= 0.03 * len(good)
    kept = {x.doc_id for x in rows if x.kept and 3000 <= x.n_words * 6 <= 60000 and label.get(x.doc_id) == 1}
    r, bad = random.Random(2), []
    for x in docs.where("lang = 'en'").collect():
        if x.doc_id in kept:
            w = [y.strip(".,") for y in x.text.split()]
            bad += ["".join(y + r.choice(["### ", "$$$ ", "%%% ", "*** "]) for y in w), " | ".join(r.sample(w, 9)) + " | " + " | ".join(r.choices(sorted(set(w))[:150], k=len(w)))]
    d = spark.createDataFrame([(str(i), t) for i, t in enumerate(bad)], "doc_id string, text string")
    out = quality.quality(d).where("not base_failed").select("kept").collect()
    assert len(out) > 40 and sum(x.kept for x in out) <= 0.1 * len(out)


def brute_components(rows, n, percent):
    sets = []
    for _, t in rows:
        w = t.encode().lower().split()
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = group[a], group[b]
                group = [y if g == x else g for g in group]
    out = Counter()
    for (i, _), s, g in zip(rows, sets, group):
        ids = [j for (j, _), h in zip(rows, group) if h == g and j is not None]
        out[i, len(s), min(ids) if s and ids else i] += 1
    return out


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (3, 50)])
def test_ngram_join(spark, docs, n, percent):
    got = Counter(tuple(r) for r in ngram_join.ngram_join(docs, n, percent).collect())
    assert got == brute_components(text_of(docs), n, percent)
    assert ngram_join.ngram_join(empty(spark), n, percent).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.id: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>x="</p>"</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href=/a>Menu one</a><li><a href=/b>Two</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="sidebar"><p>Side text of some length here</p></div>
<{0}><h1>Head &amp; line</h1><p>First <b>bold</b>
   text&nbsp;goes on for a good while so that it counts.<p>Second<br>part &lt;ok&gt; with more words in it, as prose has.
<div class="ad">Buy now</div><ul><li>item one</li><li>item two</li></ul><form><label>Mail</label><button>Go</button></form></{0}>
<section class="comments"><p>A reader says something rather long about this article, and more.</p></section>
<aside>Related</aside><footer>&copy; foot</footer>"""


def test_html(spark):
    want = "Head & line\nFirst bold text goes on for a good while so that it counts.\nSecond part <ok> with more words in it, as prose has.\nitem one\nitem two"  # noqa: E501
    for tag in ("article", "main", "div"):
        assert html_text.main_text(PAGE.replace("{0}", tag)) == want
    rows = [(1, "u", PAGE.replace("{0}", "article"), "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<nav>a</nav>", "x"), (4, "u", "<p", "x")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id, r.n_chars) for r in got)[:4] == [(1, len(want)), (2, 0), (3, 0), (4, 0)] and len(got) == 5
    assert html_text.main_text("<article>" + "<p>long words go here</p>" * 5000).count("\n") == 4999


def test_html_keeps_all_of_an_article():
    para = lambda k, n=3: "".join(f"<p>Part {k} {i} goes on with many words, as the prose of a page does, for a while.</p>" for i in range(n))
    parts = lambda text: [x for x in text.split("\n") if x.startswith("Part")]
    text = html_text.main_text
    menu = "<nav><a href=a>menu</a></nav>"
    assert len(parts(text(f"<body>{menu}<article>{para(1, 5)}</article><article>{para(2)}</article></body>"))) == 8
    assert len(parts(text(f"<body><div>{para(1, 13)}</div><div class=ad>Buy this now.</div><div>{para(2, 7)}</div></body>"))) == 20
    for name in ("layout has-sidebar", "content-sidebar-wrap", "post no-comments"):
        for tag in ("article", "div"):
            page = f"<body>{menu}<div class='{name}'><{tag}>{para(1, 5)}</{tag}><div class=sidebar><p>Other words.</p></div></div></body>"
            assert len(parts(text(page))) == 5 and "Other" not in text(page)
    link = f"<body><div>{para(1)}<p><a href=x>Linked words only</a></p>{para(2)}</div></body>"
    assert "Linked words only" in text(link)
    assert "Cheap" not in text(f"<body>{menu}<article>{para(1, 5)}<p>So <span class=ad>Cheap</span> it goes.</p></article></body>")


def test_edit_distance():
    r = random.Random(1)
    for _ in range(2000):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 9))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert line_dedup.edit_distance(a, b) == row[-1]


def test_line_dedup(spark, words):
    r = random.Random(4)
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    long = [line(120) for _ in range(6)]
    near = long[0].replace(long[0].split()[60], "changed", 1)
    rows = [
        (2, "\n".join([long[0], "---", long[1]]), "a"), (1, "\n".join([long[2], long[0].upper() + "!", "---"]), "b"),
        (3, "\n".join([near, long[3], "---"]), "c"), (4, long[4] + "\n" + long[4], "d"), (5, None, "e"), (6, "", "f"), (None, long[5], "g"), (7, long[5], "h"),
        (8, long[1], "i"), (8, long[1], "i"),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_lines string")
    out = line_dedup.dedup_lines(d)
    assert out.columns == ["doc_id", "text", "n_lines", "n_removed"]
    text = {x.doc_id: x.text for x in out.collect()}
    assert text[1] == rows[1][1] and text[2] == "---\n" + long[1] and text[4] == long[4] and text[5] is None and text[6] == ""
    assert text[7] == long[5] and text[None] == "" and text[8] == "" and out.count() == 10
    alike = line_dedup.alike(near.encode().split(), long[0].encode().split(), 80)
    close = np.bitwise_count(np.bitwise_xor(*line_dedup.simhashes(line_dedup.Words([list(set(x.encode().split())) for x in (near, long[0])])).view(np.uint64))).sum() <= 26
    assert alike and close
    assert text[3] in (f"{long[3]}\n---", rows[2][1])
    clash = line_dedup.dedup_lines(d.toDF("doc_id", "text", "_row").withColumn("g", F.lit(1)).withColumn("_gone", F.lit(2)))
    assert clash.columns == ["doc_id", "text", "_row", "g", "_gone", "n_lines", "n_removed"]
    assert {(x.doc_id, x.text, x._row, x.g, x._gone) for x in clash.collect()} == {(x.doc_id, x.text, x.n_lines, 1, 2) for x in out.collect()}
    assert line_dedup.dedup_lines(d.where("false")).count() == 0


def test_line_groups_of_many_copies(spark, words, monkeypatch):
    r = random.Random(9)
    monkeypatch.setattr(line_dedup, "PACKED", 2000)
    base, part = [r.choice(words) for _ in range(30)], [r.choice(words) for _ in range(12)]
    lines = [base[:k] + [r.choice(words)] + base[k + 1 :] for k in [*range(30)] * 4]  # a large group of near copies
    lines += [part + [r.choice(words) for _ in range(18)] for _ in range(60)]  # a passage in lines that differ
    r.shuffle(lines)
    d = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "doc_id long, text string").repartition(3)
    kept = {x.doc_id for x in line_dedup.dedup_lines(d).collect() if x.text}
    copies = [i for i, x in enumerate(lines) if x[:12] != part]
    assert kept == set(range(len(lines))) - set(copies[1:])


@pytest.mark.parametrize("percent", [80, 60])
def test_line_groups_are_those_of_brute_force(spark, words, percent):
    r = random.Random(8)
    lines = []
    for k in range(90):
        base = [r.choice(words[: 40 if k % 3 == 0 else 3000]) for _ in range(r.choice([4, 5, 6, 8, 10, 11, 20, 40, 100]))]
        lines.append(base)
        for share in (0.05, 0.1, 0.2, 0.2):
            x = list(base)
            for _ in range(int(share * len(x))):
                at, kind = r.randrange(len(x)), r.randrange(3)
                x[at : at + (kind < 2)] = [r.choice(words)] if kind != 1 else []
            lines.append(x)
    r.shuffle(lines)
    split = [x.encode().split() for x in map(" ".join, lines)]
    group = list(range(len(split)))
    pairs = [(i, j) for j in range(len(split)) for i in range(j) if line_dedup.alike(split[i], split[j], percent)]
    for _ in split:
        before = list(group)
        for i, j in pairs:
            group[i] = group[j] = min(group[i], group[j])
        if group == before:
            break
    for (i, j) in r.sample(pairs, 100):
        a, b = line_dedup.parities(line_dedup.Words([split[i], split[j]])).view(np.uint64)
        n, m = len(split[i]), len(split[j])
        assert np.bitwise_count(a ^ b).sum() <= 2 * (max(n, m) - -(-percent * max(n, m) // 100)) - abs(n - m)
    d = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "doc_id long, text string").repartition(3)
    kept = {x.doc_id for x in line_dedup.dedup_lines(d, percent).collect() if x.text}
    assert len(pairs) > 200 and kept == set(group)


def test_mixing(spark, docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toArrow())
    got = mixing.mix(docs).toPandas()
    want = con.sql(queries.SQL["op8_source_mixing"]).df()
    for c in ("size", "source_size", "taken", "copies"):
        assert sorted(got[c]) == sorted(want[c])
    assert sorted(got.target) == sorted(want.target) and (got.taken <= 2 * got["size"]).all()
    assert abs(got.groupby("source", dropna=False).target.first().sum() - 1.5 * got["size"].sum()) < 1e-6
    assert mixing.mix(empty(spark)).count() == 0


def test_the_last_place_goes_to_one_of_equal_rows(spark):
    w = lambda n: " ".join(["w"] * n)
    rows = [(1, w(150), "a")] * 40 + [(k, w(10), "b") for k in range(100)] + [(None, w(7), None)] * 30
    d = spark.createDataFrame([(*x, "", "") for x in rows], DOCS).repartition(3)
    got = mixing.mix(d, carry=["label"]).toPandas()
    for _, g in got.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max()
    con = duckdb.connect()
    con.register("documents", d.select("doc_id", "text", "source").toArrow())
    assert sorted(got.taken) == sorted(con.sql(queries.SQL["op8_source_mixing"]).df().taken) and "label" in got


def test_mix_stage_goes_by_row(spark):
    import corpus_pipeline as p

    w = lambda n, x="w": " ".join([x] * n)
    rows = [(1, w(50), "a"), (1, w(9), "a"), (None, w(40), "a"), (None, w(8), "b"), (3, w(30), "b"), (3, w(30), "b"), (4, None, "b"), (5, "", None)]
    d = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((x.doc_id, x.text) for x in p.mix_stage(spark, d.repartition(2), SF).collect())
    want = Counter()
    for x in mixing.mix(d.withColumn("t", F.col("text")), carry=["t"]).collect():
        want[x.doc_id, x.t] += x.copies
    assert got == +want and p.mix_stage(spark, d.where("false"), SF).count() == 0


def test_chat(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [
        (1, 0, "system", "be <|kind|>"), (1, 1, "user", "a\\b"), (1, 2, "assistant", said), (1, 3, "user", None), (1, 4, "assistant", "<s>\n</s>\n\\"),
        (1, 5, "user", "bye"), (2, 0, "user\n<s>", "no reply"), (None, 0, None, ""), (3, 1, "assistant", "x"), (3, 1, "assistant", "x"),
    ]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    ex = chat.examples(d)
    got = {r.conv_id: r for r in chat.read_back(ex).collect()}
    for conv in (1, 2, None, 3):
        mine = [r for r in rows if r[0] == conv]
        every = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256(every.encode()).hexdigest() and got[conv].n_turns == len(mine)
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got[conv].loss_chars == len(loss)
    whole = {(r.conv_id, r.example): r for r in chat.expand(ex).collect()}
    assert set(whole) == {(1, 0), (1, 1), (3, 0), (3, 1)} and whole[1, 1].text.startswith(whole[1, 0].text)
    a = whole[1, 1]
    assert chat.unescaped(a.text[a.loss_start : a.loss_end]) == "<s>\n</s>\n\\" and a.text.count("</s>") == 5
    assert chat.read_back(chat.examples(d.where("false"))).count() == 0


def test_urls(spark):
    urls = [
        "http://A.Example.NET/en/1", "http://x.net/1", "http://x.net", "http://example.com/de/", "http://notexample.com/de/", "https://a.org/fr/2?x=1",
        "http://a.org/en/5", "http://www.a.org/en/5/?q", "http://b.org/en/5.html#t", None, "nothing", "://", "http://b.org/en/5",
    ]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame([("http://m.b.org/en/5/",), (None,), ("http://b.org/en/5",)], "url string")
    got = {r.page_id: r for r in url_filter.judge(d, listed).collect()}
    rules = {0: "example.net/en/", 1: "net/", 3: "example.com/de/", 5: "org/fr/"}
    assert {i: r.rule for i, r in got.items()} == {i: rules.get(i) for i in range(len(urls))}
    assert {i for i, r in got.items() if r.verdict == "block"} == {1, 3, 8, 12} and got[0].host == "a.example.net" and got[2].path == ""
    many = spark.range(20_000).select(F.concat(F.lit("http://h.org/"), F.col("id")).alias("url"))
    test = spark.range(0, 40_000, 7).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.org/"), F.col("id")).alias("url"))
    assert url_filter.judge(test, many).where("listed <> (page_id < 20000)").count() == 0
    assert url_filter.judge(d.where("false"), listed).count() == 0


@pytest.mark.parametrize("name", ["op8_source_mixing", "op10_url_filters"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.SQL[name]).df()
    cols = sorted(want.columns)
    plain = lambda x: sorted(map(repr, x[cols].astype(object).where(x[cols].notna(), None).itertuples(index=False, name=None)))
    assert sorted(got.columns) == cols and plain(got) == plain(want)


def test_near_stage_goes_by_row(spark, words):
    import corpus_pipeline as p

    r = random.Random(3)
    a, b, c, e = (" ".join(r.choice(words) for _ in range(80)) for _ in range(4))
    rows = [(1, a), (1, a), (2, b), (5, b + " more"), (5, c), (None, e), (None, e), (None, e + " end"), (7, None), (8, "")]
    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(x.doc_id, x.text) for x in p.near_stage(spark, d.repartition(3), SF).collect()]
    assert len(got) == 6 and {(1, a), (2, b), (5, c), (7, None), (8, "")} < set(got)
    assert [t for i, t in got if i is None][0] in (e, e + " end")


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids, texts = {r.doc_id for r in docs.collect()}, {}
    for name, stage in p.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == p.COLUMNS, name
        if name == "quality rules":
            good = quality.quality(before).where("kept").select("doc_id").collect()
            assert {r.doc_id for r in good} == {r.doc_id for r in docs.collect()}
        if name == "n-gram Jaccard join":
            want = brute_components(text_of(before), 5, 80)
            assert {r.doc_id for r in docs.collect()} == {c for _, _, c in want}
        texts = {r.doc_id for r in docs.collect()}
        assert texts and texts <= ids
    pieces = p.pack_stage(spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == texts
    assert sum(r.length for r in pieces) == sum(len(encoded(t)) + 1 for _, t in text_of(docs))


def test_line_words_are_counted_in_all_documents(spark, monkeypatch):
    from fieldorder.llm import line_dedup
    from fieldorder.llm.common import digest64

    monkeypatch.setattr(line_dedup, "SAMPLE", 1, raising=False)
    texts = ["alpha beta\nalpha " + " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(6000))] * 3 + ["alpha gamma"] * 5
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    names, counts = line_dedup.frequent_words(df)
    got = dict(zip(names.tolist(), counts.tolist()))
    number = lambda w: int.from_bytes(digest64(w), "little")
    assert len(got) == 6003 and got[number(b"alpha")] == 11 and got[number(b"gamma")] == 5 and got[number(b"waaa")] == 3


def test_a_task_calls_python_once_for_its_pieces_and_once_for_its_words(spark, docs, monkeypatch):
    """Two Python maps in one stage hold two workers a core, each with its own memo."""
    maps = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    assert maps(packing.token_pieces(docs, PATH)) == 1
    from fieldorder.llm import line_dedup

    kind, made = type(docs), []
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, f=kind.mapInArrow, **b: made.append(f(self, *a, **b)) or made[-1])
    names, counts = line_dedup.frequent_words(docs)
    assert len(names) == len(counts) > 0 and [maps(d) for d in made] == [1]


def test_latin_texts_are_learned_in_lower_case():
    from fieldorder.llm import tokens

    with open(PATH, "rb") as f:
        memo = tokens.WordMemo(f.read())
    texts = ["Word WORD word It's IT'S", "ÀÉ ßÄ µ Ÿ", "É Σ ΣΑΣ Word", "<|ENDOFTEXT|> x1y22 &&&a", "", "a\xa0B", "Word <|endoftext|> WORD"]
    assert [np.frombuffer(x, "<u4").tolist() for x in memo.ids(texts[:1])] == [encoded(texts[0])]
    assert set(memo.words) == {"word", "it's"}
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in memo.ids(texts)] == [encoded(t) for t in texts]


def test_shuffle_files_of_word_counts_go_before_keys_are_packed(spark, docs, monkeypatch):
    from fieldorder.llm import line_dedup

    did = []
    monkeypatch.setattr(line_dedup, "frequent_words", lambda d, f=line_dedup.frequent_words: (did.append("counted"), f(d))[1])
    monkeypatch.setattr(line_dedup, "released", lambda *a, f=line_dedup.released: (did.append("released"), f(*a)))
    line_dedup.packed_keys(docs, 80, 16, 4)
    assert did == ["counted", "released"]


@pytest.mark.parametrize("percent", [80, 60, 100])
def test_lines_of_similar_lengths_share_a_part_of_their_key(spark, percent):
    d = spark.range(1, 300).selectExpr("7L AS key", "id", "CAST(id AS int) AS words")
    parts = {}
    for x in line_dedup.by_length(d, percent).collect():
        parts.setdefault(x.id, set()).add(x.key)
    assert all(parts[n] & parts[m] for m in range(1, 300) for n in range(-(-percent * m // 100), m + 1))
    assert not parts[10] & parts[200] and sum(map(len, parts.values())) <= 2 * 299


def test_near_copies_of_a_line_meet_a_few_times_each(spark, words, monkeypatch):
    r = random.Random(12)
    base = [r.choice(words) for _ in range(60)]
    lines = [base]
    for _ in range(240):  # near copies of the line, and of its beginnings and ends
        x = base[:]
        for k in r.sample(range(60), 6):
            x[k] = r.choice(words)
        at = r.choice([60, 60, 60, 40, 30, 20])
        lines.append(x[:at] if r.random() < 0.5 else x[-at:])
    split = [" ".join(x).encode().split() for x in lines]
    group = list(range(len(split)))
    pairs = [(i, j) for j in range(len(split)) for i in range(j) if line_dedup.alike(split[i], split[j], 80)]
    for _ in split:
        before = list(group)
        for i, j in pairs:
            group[i] = group[j] = min(group[i], group[j])
        if group == before:
            break
    kind, met = type(spark.range(1)), []
    monkeypatch.setattr(kind, "distinct", lambda self, f=kind.distinct: met.append(self.count() if self.columns == ["a", "b"] else 0) or f(self))
    d = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "doc_id long, text string").repartition(3)
    kept = {x.doc_id for x in line_dedup.dedup_lines(d).collect() if x.text}
    assert kept == set(group)
    # one round of pivots connects nearly all; what is still open meets less than once a line
    assert [n for n in met if n][-1] < len(lines) < len(pairs)

"""Ranked search, HTML extraction and periodic runs, against brute force and hand-made pages."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import html_text, periodic, ranked_search
from feedloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"

# ---- ranked search ----


def ranking_by_hand(docs, items, k):
    """docs: (id, text) rows; items: (id, text) rows."""
    find = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    terms = lambda t: find.findall((t or "").translate(lower))
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(1 for _, c in counted if c), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted: dict = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    rows = []
    for item, ts in wanted.items():
        scored = []
        for i, c in counted:
            m = 50 + (50 * sum(c.values()) * n) // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        rows += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(rows, key=repr)


def got_rows(df):
    return sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()], key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_search_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK", 4)
    monkeypatch.setattr(ranked_search, "WINDOW", 16)
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    pick = lambda n: " ".join(words[int(60 * rng.random() ** 3)] for _ in range(n))
    docs = [(i * 7 % 1000, pick(rng.randrange(0, 40))) for i in range(400)]
    items = [(i, pick(rng.randrange(1, 12))) for i in range(12)]
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = ranking_by_hand(docs, items, 10)
    assert got_rows(ranked_search.rank_documents(*frames, k=10, shard_words=1500)) == want
    # All lists stored (the vocabulary is over the bound), and items in several blocks.
    terms = frames[1].select(F.explode(ranked_search.term_column("text")).alias("term"))
    index = ranked_search.build_index(frames[0], terms, shard_docs=50, filter_terms=3)
    assert index.where("term is not null").select("term").distinct().count() > 50
    assert got_rows(ranked_search.search(index, frames[1], k=10, query_block=3)) == want


def test_block_maxima_spare_blocks():
    """A rare word sets the bar; of the common word's list only blocks that can reach it are opened."""
    opened = []
    builder = ranked_search.ShardBuilder(None)
    import pyarrow as pa

    whole = pa.list_(pa.int64())
    kinds = {"shard": pa.int64(), "term": pa.string(), "df": pa.int64(), "ids": whole, "data": pa.binary()}
    schema = pa.schema([pa.field(c, kinds.get(c, whole)) for c in ranked_search._index_type(ranked_search.T.LongType()).names])
    n = 20_000
    words = [[b"common"] + [b"x"] * (i % 7) + ([b"rare"] * 3 if i < 60 or i == 15_001 else []) for i in range(n)]
    documents, postings = builder.rows(0, pa.array(range(n), pa.int64()), words, schema)
    impact = ranked_search.Impact(n, sum(map(len, words)))
    factor = impact.factor(np.array([len(w) for w in words]))
    rows = {r["term"]: r for r in postings.to_pylist()}
    lists = {t: ranked_search.PostingList(r, impact, factor, ranked_search.zstandard.ZstdDecompressor().decompress) for t, r in rows.items()}
    assert len(rows["common"]["last"]) == -(-n // ranked_search.BLOCK)
    plain = lists["common"].block
    lists["common"].block = lambda i: (opened.append(i), plain(i))[1]
    places, scores = ranked_search.best_of_shard([(lists["common"], 1), (lists["rare"], 5000)], n, 50)
    assert 15_001 in places and len(places) == 50
    tf = np.array([[w.count(b"common"), w.count(b"rare")] for w in words])
    full = impact.of(tf[:, 0], factor) + 5000 * impact.of(tf[:, 1], factor)
    assert sorted(scores.tolist()) == sorted(full.tolist())[-50:]
    window = ranked_search.WINDOW // ranked_search.BLOCK
    assert {i for i in opened if i > window} == {15_001 // ranked_search.BLOCK}


def test_search_odd_input(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "THE Same text"), (1, "漢字"), (None, "b"), (2, None), (3, ""), (4, "nothing-of-this zzz")], "item_id int, text string").withColumn("doc_id", F.lit("clash"))
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    wants = [(r.item_id, r.text) for r in items.collect()]
    got = ranked_search.rank_documents(odd_docs, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = ranking_by_hand(rows, wants, 50)
    assert got_rows(got) == want and {r[0] for r in want} == {1, None}
    assert ranked_search.rank_documents(no_docs, items).count() == 0 and ranked_search.rank_documents(odd_docs, items.limit(0)).count() == 0
    text_ids = odd_docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert ranked_search.rank_documents(text_ids, items).schema["doc_id"].dataType.simpleString() == "string"


# ---- pages ----


def prose(spark):
    text = " ".join(r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").orderBy("doc_id").limit(8).collect())
    words = [w for w in text.split() if "<" not in w and "&" not in w]
    return lambda n, start=0: " ".join(words[start * 7 : start * 7 + n])


@pytest.fixture(scope="module")
def weights(spark):
    return html_text.train(spark.read.parquet(f"{SF}/pages.parquet"))


def test_leaf_blocks():
    page = """<!DOCTYPE html><title>no &amp; no</title><style>p{}</style><body class='a-b'><!-- <p>no</p> --><p>One <b>two</i>three &lt;&#233;&nbsp;x<br>four
    <div id=Main-box>five<script>var t="<p>no</p>";</script> six<p title="a>b">seven</div>5 < 6 &copy &unknown;<ul><li>a<li><a href=x>b c</a> d</ul></p><textarea><p>no</textarea>"""
    got = html_text.leaf_blocks(page)
    assert [b.text for b in got] == ["One twothree <é x four", "five six", "seven", "5 < 6 © &unknown;", "a", "b c d"]
    assert got[1].path == ("body", ".a", ".b", "div", ".main", ".box") and got[2].near == ("p", "div", ".main", ".box")
    assert [b.linked for b in got] == [0, 0, 0, 0, 0, 3]
    assert html_text.leaf_blocks("") == [] and html_text.leaf_blocks(" \n ") == [] and [b.text for b in html_text.leaf_blocks("plain <")] == ["plain <"]
    assert [b.text for b in html_text.leaf_blocks("<p>a<!-- never closed <p>b")] == ["a"]
    assert len(html_text.leaf_blocks("<div class=x>" * 20_000 + "deep" + "</div>" * 20_000)) == 1


def test_gradients_equal_differences():
    settings = html_text.Settings(path_buckets=16, word_buckets=16, width=3, state=4)
    p = {k: v.astype(np.float64) for k, v in html_text.new_weights(settings).items()}
    features = html_text.Features(settings)
    block = lambda t, *path: html_text.Block(t, 0, path, path[-1:])
    pages = [[block("a b", "p"), block("c.", "div", "p"), block("d", "li")], [block("e f g", "p")]]
    labels = np.array([1.0, 0, 1, 0])
    batch = html_text.Batch([features.of(b) for b in pages])

    def loss():
        odds = html_text.forward(p, batch)
        return float(np.mean(np.log1p(np.exp(odds)) - labels * odds))

    grad = html_text.gradients(p, batch, labels)
    rng = np.random.default_rng(0)
    for name, value in p.items():
        for at in {tuple(int(rng.integers(s)) for s in value.shape) for _ in range(6)}:
            kept, step = value[at], 1e-3
            value[at] = kept + step
            up = loss()
            value[at] = kept - step
            down = loss()
            value[at] = kept
            assert abs((up - down) / (2 * step) - grad[name][at]) < 2e-4, name


def test_labels_do_not_depend_on_the_batch(spark, weights):
    pages = [html_text.leaf_blocks(r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").limit(40).collect()]
    features = html_text.Features(html_text.Settings())
    whole = html_text.label_pages(pages, weights, features)
    assert all((html_text.label_pages([b], weights, features)[0] == y).all() for b, y in zip(pages, whole))


def test_pages_of_the_table(spark):
    """Every page of the table: the blocks of its article element, all of them and nothing else."""
    found = {r.page_id: r for r in QUERIES["op12_html"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(found) == len(pages)
    for p in pages:
        blocks = html_text.leaf_blocks(p.html)
        want = " ".join(b.text for b in blocks if "article" in b.path)
        assert found[p.page_id].text == want and found[p.page_id].n_chars == len(want) and found[p.page_id].url == p.url


def test_pages_of_other_layouts(spark, weights):
    P = prose(spark)
    body = [f"<p>KEEP {P(30, i)}</p>" for i in range(4)]
    pages = [
        f"<header><a href=/>Site</a><p>{P(6)}</p></header><div class='menu'><a href=1>Home</a> <a href=2>About</a></div><main><h1>KEEP {P(5)}</h1>{''.join(body)}<aside><h3>Related</h3><p>{P(12)}</p></aside><p>KEEP {P(20)}</p></main>"
        f"<section id=comments><h3>Comments</h3><div class=comment><p>{P(25, 4)}</p></div><div class=comment><p>{P(35, 2)}</p></div></section><form action=x><label>Email</label><input><button>Subscribe</button></form><footer><p>{P(20)}</p></footer>",
        f"<div id=header><h2>{P(3)}</h2></div><div id=nav><ul><li><a>{P(1)}</a><li><a>{P(1, 1)}</a></ul></div><div class=cookie-notice><p>{P(14, 2)}</p><button>OK</button></div><div id=content><h1>KEEP {P(4)}</h1><div class=ad-box>{P(10, 3)}</div>{''.join(body)}"
        f"<ul><li>KEEP {P(8)}</li><li>KEEP {P(6, 2)}</li></ul><div class=comments><div class=comment>{P(20)}</div></div></div><div id=sidebar><p>{P(30, 1)}</p></div><div id=footer>{P(12)}</div>",
        f"<article><header><h1>KEEP {P(6)}</h1></header>{''.join(body)}<blockquote>KEEP {P(12)}</blockquote><div class=advert>{P(30)}</div></article><div class=sidebar><h4>Popular</h4><p>{P(20)}</p></div><div class=notice>{P(9)}</div>",
        f"<div class=banner>{P(12)}</div><article><h1>KEEP {P(6)}</h1>{''.join(body)}</article><section class=reader-comments><article class=comment><p>{P(33)}</p></article><article class=comment><p>{P(23, 3)}</p></article></section>",
        f"<aside class=sidebar><h2>{P(2)}</h2><p>{P(22)}</p></aside><article><h1>KEEP {P(6)}</h1>{''.join(body)}<form class=poll><p>{P(9)}</p><select><option>Yes<option>No</select></form><p>KEEP One.</p></article><footer>{P(8)}</footer>",
        f"<div><h1>KEEP {P(5)}</h1>{''.join(body)}</div>",
    ]
    found = html_text.extract_text(spark.createDataFrame([(i, f"<html><body>{p}</body></html>") for i, p in enumerate(pages)], "page_id int, html string"), weights).collect()
    wrong = total = exact = 0
    for r in found:
        blocks = html_text.leaf_blocks(r.html)
        (labels,) = html_text.label_pages([blocks], weights, html_text.Features(html_text.Settings()))
        total += len(blocks)
        wrong += sum(("KEEP" in b.text) != y for b, y in zip(blocks, labels.tolist()))
        exact += r.text == " ".join(b.text for b in blocks if "KEEP" in b.text)
    assert wrong <= 0.03 * total and exact >= len(pages) - 1  # of blocks whose layout is in no table


def test_pages_odd_input(spark, weights):
    rows = [(1, None), (1, ""), (2, " "), (None, "<p>"), (3, "<article><p>" + "word " * 200_000 + "</article>"), (3, "<p>" * 30_000)]
    df = spark.createDataFrame(rows, "page_id int, html string").withColumns({c: F.lit("clash") for c in ("text", "k", "path")})
    got = html_text.extract_text(df, weights)
    assert got.columns == ["page_id", "html", "k", "path", "text"]
    texts = [r.text for r in got.collect()]
    assert texts[:4] == ["", "", "", ""] and texts[4] == " ".join(["word"] * 200_000) and texts[5] == ""
    few = html_text.Settings(steps=2)
    empty = df.limit(0)
    assert html_text.extract_text(empty, html_text.train(empty, few), few).count() == 0
    assert html_text.extract_text(df, html_text.train(df.where("html = ' '"), few), few).count() == len(rows)


# ---- periodic runs ----


def runs_by_hand(words, least=6, repeats=4):
    n, out = len(words), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, repeats * q):
                run = words[i : i + length]
                if not any(all(run[k] == run[k + d] for k in range(length - d)) for d in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_texts(rng, n):
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(0, 6)):
            if rng.random() < 0.6:
                unit = [rng.choice("ab" if rng.random() < 0.5 else "abcdef") for _ in range(rng.randrange(1, 12))]
                words += (unit * 8)[: rng.randrange(len(unit) * 3, len(unit) * 7)]
            else:
                words += [rng.choice("abcxyz") for _ in range(rng.randrange(10))]
        yield rng.choice([" ", "\n", " \t "]).join(words)


@pytest.mark.parametrize("least, repeats", [(6, 4), (1, 3), (12, 5)])
def test_runs_equal_brute_force(least, repeats):
    rng = random.Random(repeats)
    for _ in range(150):
        texts = list(periodic_texts(rng, 4))
        for text, (words, runs, copied) in zip(texts, periodic.runs_of([t.encode() for t in texts], least, repeats)):
            want = runs_by_hand(text.split(), least, repeats)
            assert list(zip(*[x.tolist() for x in runs])) == want, text
            gone = {i for s, length, q in want for i in range(s + q, s + length)}
            assert set(np.flatnonzero(copied).tolist()) == gone


def test_splitting_leaves_little_of_prose(spark):
    texts = [r.text.encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    words = [t.split() for t in texts]
    table: dict = {}
    flat = np.array([table.setdefault(w, len(table)) for ws in words for w in ws])
    lengths = np.array([len(w) for w in words])
    _, left = periodic.surviving_segments(flat, np.cumsum(lengths) - lengths, lengths)
    assert left.sum() < 0.1 * len(flat)


def test_runs_of_long_texts():
    """Many words, few of them different: still a few steps a word."""
    rng = random.Random(3)
    long = ("a " * 200_000).encode(), ("a b a c " * 50_000).encode(), " ".join(rng.choice("ab") for _ in range(100_000)).encode()
    found = [r for _, r, _ in periodic.runs_of(list(long))]
    assert [len(r[0]) for r in found[:2]] == [1, 1] and found[0][2][0] == 1 and found[1][2][0] == 4 and len(found[2][0]) > 1000


def test_runs_odd_input(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    got = periodic.find_runs(odd_docs).collect()
    assert len(got) == len(rows)
    for r, g in zip(rows, got):
        words = (r.text or "").encode().split()
        if len(words) < 1000:
            assert [tuple(x) for x in g.runs] == runs_by_hand(words)
        assert g.doc_id == r.doc_id and g.n_words == len(words)
    assert [tuple(x) for x in got[4].runs] == [(0, 60_000, 3)] and got[4].collapsed == "a b c"
    assert periodic.find_runs(no_docs).count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(odd_docs, repeats=2)


def test_op13_columns(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op13_periodic"](spark, SF).collect():
        h = zlib.crc32(str(r.doc_id).encode())
        words = (docs[r.doc_id] or "").encode().split()
        if len(words) > 3000:
            continue  # the SQL covers them
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = runs_by_hand(words)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        assert r.n_runs == len(runs) and (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()


def test_repeat_tails_leaves_odd_rows(spark, odd_docs):
    got = periodic.repeat_tails(odd_docs).collect()
    for r, g in zip(odd_docs.collect(), got):
        if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 10:
            assert g.text == (r.text or "")

"""SimHash, components, embeddings and line dedup against brute force."""

from __future__ import annotations

import collections
import random

import numpy as np
import pytest

from feedloom.llm import embedding_dedup, lines, simhash
from feedloom.llm.components import components


class Classes:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 200)]
    classes = Classes({x for e in edges for x in e})
    for a, b in edges:
        classes.join(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: classes.find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint_by_hand(text, words):
    import xxhash

    found = (text or "").encode().lower().split()
    runs = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("shard_rows", [simhash.SHARD_ROWS, 3])
def test_simhash_components(spark, documents, odd_docs, shard_rows):
    docs = documents.select("doc_id", "text").union(odd_docs.where("doc_id is not null").selectExpr("doc_id + 100000", "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    classes = Classes({i for i, _ in rows})
    prints = [fingerprint_by_hand(t, 4) for _, t in rows]
    for x in range(len(rows)):
        for y in range(x):
            if (prints[x] ^ prints[y]).bit_count() <= 4:
                classes.join(rows[x][0], rows[y][0])
    got = simhash.simhash_components(docs, words=4, radius=4, shard_rows=shard_rows).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, bytes(r.fp).hex(), r.component_id) for r in got) == sorted((i, f"{p:016x}", classes.find(i)) for (i, _), p in zip(rows, prints))


def test_simhash_native_hash(spark):
    """The hash is the one that Spark's xxhash64 gives."""
    from pyspark.sql import functions as F

    want = spark.range(1).select(F.xxhash64(F.lit("one two three four"))).first()[0]
    assert int(simhash.shingle_hashes(b"One two\tTHREE\n four", 4)[0]) == want % 2**64


def test_simhash_odd_input(spark, odd_docs, no_docs):
    got = simhash.simhash_components(odd_docs, words=4)
    assert got.columns == ["doc_id", "_key", "fp", "component_id"] and got.count() == 12
    zero = {r.component_id for r in got.collect() if not any(r.fp)}
    assert zero == {0}  # null, empty and blank texts are one group
    assert simhash.simhash_components(no_docs).count() == 0
    kept = simhash.keep_one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [r.text for r in kept.collect()]
    assert texts.count("The same text.") == 1 and len([t for t in texts if not (t or "").split()]) == 1
    assert simhash.keep_one_of_each(no_docs).count() == 0


def test_near_copies_leave_one(spark):
    rng = random.Random(4)
    words, rows = ["w%d" % i for i in range(4000)], []
    for g in range(12):
        text = [rng.choice(words) for _ in range(400)]
        for c in range(5):
            copy = list(text)
            for _ in range(c):
                copy[rng.randrange(400)] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rows += [(1000 + i, " ".join(rng.choice(words) for _ in range(60))) for i in range(40)]
    kept = {r.doc_id for r in simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {5 * g for g in range(12)} | set(range(1000, 1040))


def shingles_by_hand(text, words=5):
    found = text.lower().split()
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


@pytest.mark.parametrize("group_rows", [simhash.GROUP_ROWS, 9])
def test_near_dedup_equals_brute_force_jaccard(spark, group_rows):
    """Short and long texts around the similarity of 0.8, on both sides, chains, and one text that repeats a passage."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = []
    for n, edits in [(400, 9), (400, 11), (150, 4), (12, 1), (9, 1), (60, 2)] * 4:
        text = [word() for _ in range(n)]
        rows.append((len(rows), " ".join(text)))
        for _ in range(5):
            copy = list(text)
            for _ in range(rng.randrange(1, edits + 1)):
                copy[rng.randrange(n)] = word()
            rows.append((len(rows), " ".join(copy)))
        for k in range(3):
            rows.append((len(rows), " ".join([*text, *[word() for _ in range(n * (18 + 3 * k) // 100)]])))
            text = text[n * (9 + 2 * k) // 100 :] + [word() for _ in range(n * (9 + 2 * k) // 100)]
            rows.append((len(rows), " ".join(text)))
    base = [word() for _ in range(300)]
    rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join([*base, *base[:8] * 60]))]
    sets = [shingles_by_hand(t) for _, t in rows]
    classes = Classes(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                classes.join(i, j)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one_of_each(df, group_rows=group_rows).collect()}
    assert kept == {classes.find(i) for i in range(len(rows))}


# ---- embeddings ----


def links_by_hand(rows, cosine):
    ok = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, classes = [0] * len(rows), Classes(range(len(rows)))
    for i in ok:
        for j in ok:
            if i != j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= cosine:
                    n[i] += 1
                    classes.join(i, j)
    low = collections.defaultdict(list)
    for i, (key, _, _) in enumerate(rows):
        low[classes.find(i)].append(key)
    out = []
    for i, (key, _, _) in enumerate(rows):
        known = [k for k in low[classes.find(i)] if k is not None]
        first = min(known) if known else None
        out.append((key, n[i], first, key == first))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_rows", [embedding_dedup.BLOCK_ROWS, 7])
def test_embedding_components(spark, block_rows):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(160):
        near = rng.normal(size=16) if i % 4 == 0 else np.array(rows[-1][1]) + rng.normal(size=16) * 0.15
        rows.append((i, [float(x) for x in near], int(i // 40)))
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (201, rows[0][1], 0), (202, [2 * x for x in rows[5][1]], 0), (203, rows[0][1], None), (None, rows[80][1], 2), (None, [1.0] * 16, 9)]
    rows += [(300, None, 0), (301, [], 0), (302, [0.0] * 16, 0), (303, [float("nan")] * 16, 0), (304, [float("inf"), *[1.0] * 15], 0), (305, [None, *rows[0][1][1:]], 0), (306, [1.0, 2.0], 0), (307, [2.0, 4.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' as cls", "'x' as root", "'x' as own")
    got = embedding_dedup.embedding_components(df, block_rows=block_rows)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got.collect()), key=repr) == links_by_hand(rows, 0.93)
    assert embedding_dedup.embedding_components(df.limit(0)).count() == 0


def test_every_close_pair_reaches_the_count():
    width, least = embedding_dedup.calibrate(0.93, 64, 64)
    rng, turn = np.random.default_rng(1), embedding_dedup.rotation(64)
    for _ in range(300):
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        b = rng.normal(size=64)
        b -= (b @ a) * a
        b = 0.93 * a + np.sqrt(1 - 0.93**2) * b / np.linalg.norm(b)
        assert (np.abs((a - b) @ turn) <= width).sum() >= least


# ---- lines ----


def cut_by_hand(docs, least):
    """docs in order of their ids: every run of lines, its words, and whether it occurs earlier."""
    found = [[(p, s) for p, s in enumerate((t or "").split("\n")) if s.split()] for _, t in docs]
    places = collections.defaultdict(list)
    for d, seq in enumerate(found):
        for a in range(len(seq)):
            for b in range(a + 1, len(seq) + 1):
                places[tuple(s for _, s in seq[a:b])].append((d, a))
    gone = [set() for _ in docs]
    for run, at in places.items():
        if len(at) > 1 and sum(len(s.split()) for s in run) >= least:
            for d, a in at:
                if (d, a) != min(at):
                    gone[d] |= set(range(a, a + len(run)))
    out = []
    for (key, text), seq, cut in zip(docs, found, gone):
        lost = set()
        for k in cut:
            lost.add(seq[k][0])
            if k + 1 in cut:  # what lies between two deleted neighbours goes too
                lost |= set(range(seq[k][0], seq[k + 1][0]))
        out.append((key, None if text is None else "\n".join(s for p, s in enumerate(text.split("\n")) if p not in lost)))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_dedup(spark, seed):
    rng = random.Random(seed)
    stock = ["a b", "c", "d e f", "g h", "", "x y z w", "k", "  ", "m n"]
    docs = [(i, "\n".join(rng.choice(stock) if rng.random() < 0.8 else f"u{rng.randrange(9999)}" for _ in range(rng.randrange(14)))) for i in range(40)]
    docs += [(100 + i, docs[i][1]) for i in range(4)] + [(200, "\n".join(["c"] * 12)), (201, None), (202, "")]
    least = rng.choice([3, 5, 8])
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "length(text) as n_chars", "'x' as segment", "'x' as start")
    got = lines.drop_repeated_lines(df, least, count_col="n_chars")
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in got.collect() if r.text is not None) == sorted(x for x in cut_by_hand(docs, least) if x[1] is not None)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.collect())


def test_line_dedup_odd_input(spark, odd_docs, no_docs):
    got = lines.drop_repeated_lines(odd_docs, 3)
    assert got.columns == odd_docs.columns and got.count() == 12
    texts = [r.text for r in got.collect()]
    # rows that repeat id and text are one document; the row without id comes last and loses the line
    assert texts.count("The same text.") == 2 and None in texts
    assert lines.drop_repeated_lines(no_docs).count() == 0


def test_passages_of_fifty_words_go(spark):
    rng = random.Random(8)
    line = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    passage = [line(20), line(15), line(16)]
    short = [line(20), line(20)]
    docs = [(i, "\n".join([line(9), *passage, line(9), *short, line(8)])) for i in range(6)]
    got = {r.doc_id: r.text for r in lines.drop_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[0] == docs[0][1]
    for i in range(1, 6):
        assert not any(p in got[i] for p in passage) and all(s in got[i] for s in short) and len(got[i].split("\n")) == 5

"""Quality classifier, decontamination, the pipeline and the registered queries."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from compare import connect, differences
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from feedloom.llm import bpe, classifier, decontamination, simhash
from feedloom.llm.queries import QUERIES, SQL

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

# ---- classifier ----


def features_by_hand(text, settings):
    """Counts of buckets, one word and one n-gram at a time."""
    base, mix, size = 0x100000001B3, 0x9E3779B97F4A7C15, 64 - settings.bucket_bits
    bucket = lambda h: (h * mix % 2**64) >> size
    out: dict[int, int] = {}
    hashes = []
    for word in text.split():
        h = 0
        for c in word:
            h = (h * base + ord(c)) % 2**64
        hashes.append(h * base % 2**64)
        for n in settings.grams:
            marked = f" {word} "
            for i in range(len(marked) - n + 1):
                g = n
                for c in marked[i : i + n]:
                    g = (g * base + ord(c)) % 2**64
                out[bucket(g)] = out.get(bucket(g), 0) + 1
    for h in hashes:
        out[bucket(h)] = out.get(bucket(h), 0) + 1
    for a, b in zip(hashes, hashes[1:]):
        h = 1 if a == b else (a * base + b) % 2**64
        out[bucket(h)] = out.get(bucket(h), 0) + 1
    return out


def test_features():
    settings = classifier.Settings()
    hasher = classifier.Hasher(settings.bucket_bits, settings.grams)
    for text in ("", " ", "a", "The  cat\nsat sat sat", "Ünï 漢字 😀 x!", "ab " * 50):
        ids, counts = classifier.bucket_counts(text, hasher)
        assert dict(zip(ids.tolist(), counts.tolist())) == features_by_hand(text, settings), text


def test_scores_do_not_depend_on_the_batch():
    settings = classifier.Settings()
    hasher = classifier.Hasher(settings.bucket_bits, settings.grams)
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma é", "\n", "x" * 40]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(300))) for _ in range(40)] + ["", "y" * 5000, " ".join(rng.choice(words) for _ in range(60_000))]
    weights = np.random.default_rng(1).integers(-(2**28), 2**28, 1 << settings.bucket_bits).astype(np.int32)
    want = []
    for text in texts:
        counts = features_by_hand(text, settings)  # the long text is cut inside, which must not show
        total, number = sum(int(weights[b]) * n for b, n in counts.items()), sum(counts.values())
        want.append((total / max(1, number) + 5) / classifier.FIXED)
    whole = classifier.log_odds(texts, hasher, weights, 5)
    assert len(texts[-1]) > 1 << 18 and np.allclose(whole, want)
    assert np.array_equal(whole, [classifier.log_odds([t], hasher, weights, 5)[0] for t in texts])


def test_held_out(spark):
    rows = spark.range(200).select("id", classifier.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)


def test_quality_on_held_out_rows(spark):
    scored = QUERIES["op1_quality"](spark, LARGER)
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    rows = scored.where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert scored.count() == 1000 and scored.where("score not between 0 and 1 or score is null").count() == 0


def test_classifier_odd_input(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (2, 0), (4, 7), (9, None), (None, 1), (77, 1)], "doc_id long, label int")
    model = classifier.train(odd_docs, labels, classifier.Settings(steps=50))
    got = classifier.score(odd_docs, model)
    assert got.columns == [c for c in odd_docs.columns if c != "score"] + ["score"]
    rows = got.collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not (r.text or "").split()}) == 1 and len({r.score for r in rows if r.text == "The same text."}) == 1
    for none in (labels.limit(0), labels.where("label = 1")):
        weights, _ = classifier.train(odd_docs, none)
        assert not weights.any()
    assert classifier.score(no_docs, classifier.train(no_docs, labels)).count() == 0


# ---- decontamination ----


def test_decontamination_equals_brute_force(spark, odd_texts):
    rng = random.Random(4)
    stock = ["the", "a", "of", "x1", "y2", "é", "zed", "Q"]
    items = [(i, " ".join(rng.choice(stock) for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 10, 14, 25])))) for i in range(30)] + [(31, None), (31, "the a of x1 y2 zed q é the a of"), (31, "zed zed zed")]
    docs = [(i, "".join(rng.choice(stock) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(rng.randrange(60)))) for i in range(120)]
    docs += [(1000 + i, f"{rng.choice(stock)} {t}. {rng.choice(stock)}") for i, (_, t) in enumerate(items) if t] + [(2000 + i, t) for i, t in enumerate(odd_texts)]
    want = []
    for key, text in docs:
        words, hit, owners = [w.decode() for w in decontamination.words_of((text or "").encode())], set(), set()
        for item, passage in items:
            own = [w.decode() for w in decontamination.words_of((passage or "").encode())]
            size = min(10, len(own))
            windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
            for p in range(len(words) - size + 1):
                if tuple(words[p : p + size]) in windows:
                    hit |= set(range(p, p + size))
                    owners.add(str(item))
        want.append((key, len(words), len(hit), sorted(owners)))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hits", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit("clash"))
    for part_words in (decontamination.PART_WORDS, 60):
        got = decontamination.mark_contamination(df, bench, part_words=part_words)
        assert got.columns == ["doc_id", "text", "n_words", "n_hit", "hits", "items"]
        assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got.collect()) == sorted(want)
    assert decontamination.mark_contamination(df, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontamination.mark_contamination(df.limit(0), bench).count() == 0


# ---- pipeline ----


def test_pipeline_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "decontaminate", "tokenise"]
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    kept = stages["quality"](spark, docs, LARGER)
    assert kept.columns == docs.columns
    scores = {r.doc_id: r.score for r in QUERIES["op1_quality"](spark, LARGER).collect()}
    kept_ids = {r.doc_id for r in kept.collect()}
    assert kept_ids == {i for i, s in scores.items() if s >= 0.5}
    assert np.mean([(i in kept_ids) == (q == 1) for i, q in labels.items()]) > 0.97

    before = {r.doc_id: r.text for r in kept.collect()}
    lined = stages["line_dedup"](spark, kept, LARGER)
    after = {r.doc_id: (r.text, r.n_chars) for r in lined.collect()}
    assert lined.columns == docs.columns and after.keys() == before.keys() and all(n == len(t) for t, n in after.values())
    assert sum(t != before[i] for i, (t, _) in after.items()) > 0

    near = stages["near_dedup"](spark, lined, LARGER)
    sets = {i: set(simhash.shingle_hashes(t.encode(), 5).tolist()) for i, (t, _) in after.items()}
    ids = sorted(sets)
    up = list(range(len(ids)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in range(len(ids)):
        a = sets[ids[x]]
        for y in range(x):
            b = sets[ids[y]]
            both = len(a & b) if 0.8 * len(a) <= len(b) <= len(a) / 0.8 else -1
            if both >= 0.8 * (len(a) + len(b) - both):  # Jaccard similarity of the shingle sets; two empty sets are alike
                low, high = sorted((find(x), find(y)))
                up[high] = low
    alone = {ids[x] for x in range(len(ids)) if find(x) == x}
    left = {r.doc_id for r in near.collect()}
    assert near.columns == docs.columns and alone <= left and len(left - alone) <= 0.002 * len(ids)

    clean = stages["decontaminate"](spark, near, LARGER)
    marked = {r.doc_id for r in decontamination.mark_contamination(near, spark.read.parquet(f"{LARGER}/benchmark.parquet")).where("n_hit > 0").collect()}
    clean_ids = {r.doc_id for r in clean.collect()}
    assert clean.columns == docs.columns and clean_ids == left - marked and marked

    last = stages["tokenise"](spark, clean, LARGER).collect()
    assert {r.doc_id for r in last} == clean_ids
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        _, tokens = bpe.rank_encoder(file.read(), public_tokenizers.PATTERN)
    assert all(bpe.decode(np.array(r.ids, "<u4").tobytes(), tokens).decode() == after[r.doc_id][0] for r in last)
    assert {r.doc_id for r in corpus_pipeline.run(spark, LARGER).collect()} == clean_ids


@pytest.mark.parametrize("name", ["quality", "line_dedup", "near_dedup", "decontaminate"])
def test_stages_keep_columns_of_any_name(spark, name):
    clash = ("_llm_score", "_llm_key", "_LLM_id", "_llm_cuts", "Items", "hits", "n_hit", "n_words", "score", "items_kept", "a.b")
    base = spark.read.parquet(f"{SF}/documents.parquet")
    docs = base.withColumns({c: F.struct(F.lit("keep me").alias("x")) for c in clash})
    plain = dict(corpus_pipeline.STAGES)[name](spark, base, SF)
    got = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    assert got.columns == docs.columns and got.schema == docs.schema
    rows = got.collect()
    assert all(r[c].x == "keep me" for r in rows for c in clash) and {r.doc_id for r in rows} == {r.doc_id for r in plain.collect()}


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_training_takes_labels_of_the_texts_at_hand(spark):
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "bad junk there") for i in range(40)], "doc_id long, text string")
    labels = spark.range(100_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("label"))
    rows = classifier.score(docs, classifier.train(docs, labels, classifier.Settings(train_rows=64))).collect()
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in rows)


# ---- registry ----


def test_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", ["op6_decontamination", "op7_lines"])  # the smallest scale has few passages and runs
def test_query_equals_sql_at_the_larger_scale(spark, name):
    assert differences(QUERIES[name](spark, LARGER), connect(LARGER), SQL[name]) is None

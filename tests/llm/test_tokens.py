"""BPE against the reference libraries, and token files round trips."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from feedloom.llm import bpe, token_files

RANKS, JSON = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    with open(RANKS, "rb") as file:
        return bpe.rank_encoder(file.read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(JSON)
    found.encode_special_tokens = True
    return found


def hard_texts(n):
    rng = random.Random(3)
    letters = "ab cd\n\t  .,'sé漢 　\x0b0١९Ⅷ²_-!?\x85​😀😃\xa0"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(n)] + ["it's we'll  I'd\n\n x", " <|endoftext|> ", "a" * 3000, "ab" * 2000]


def merge_by_hand(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while not (len(parts) == 1 or piece in ranks):
        best = min(((ranks.get(parts[i] + parts[i + 1], 10**9), i) for i in range(len(parts) - 1)), default=(10**9, 0))
        if best[0] == 10**9:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return [ranks[piece]] if piece in ranks else [ranks[p] for p in parts]


def test_merge_of_any_ranks():
    """Also ranks that no training would give: later merges may rank before earlier ones, and tokens may be reached in several ways."""
    rng = random.Random(1)
    for _ in range(300):
        tokens = {bytes([b]) for b in b"abc"} | {bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6))) for _ in range(25)}
        ranks = dict(zip(rng.sample(sorted(tokens), len(tokens)), rng.sample(range(50_000), len(tokens))))
        piece = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 40)))
        assert bpe.merge(piece, ranks, 6) == merge_by_hand(piece, ranks)


def test_encoder_equals_reference(encoder, reference):
    for text in hard_texts(1500):
        got = encoder[0].encode(text)
        assert np.frombuffer(got, "<u4").tolist() == reference.encode_ordinary(text), text
        assert bpe.decode(got, encoder[1]) == text.encode()


def test_long_pretoken(encoder, reference):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh") for _ in range(40_000))
    assert np.frombuffer(encoder[0].encode(text), "<u4").tolist() == reference.encode_ordinary(text)


def test_full_tables_start_anew(reference, monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_ENTRIES", 7)
    with open(RANKS, "rb") as file:
        encoder, _ = bpe.rank_encoder(file.read(), public_tokenizers.PATTERN)
    text = " ".join(f"w{i % 13} x,{i}" for i in range(300))
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


def test_encode_texts(spark, documents, odd_docs, no_docs, reference):
    docs = documents.select("doc_id", "text").union(odd_docs.select("doc_id", "text"))
    want = []
    for row in docs.collect():
        ids = reference.encode_ordinary(row.text or "")
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((row.doc_id, len(ids), ids, digest, hashlib.sha256((row.text or "").encode()).hexdigest()))
    got = bpe.encode_texts(docs, RANKS, public_tokenizers.PATTERN)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    decoded = bpe.decode_ids(got, RANKS)
    assert {(r.decoded_sha256, hashlib.sha256(r.decoded.encode()).hexdigest()) for r in decoded.collect()} == {(w[4], w[4]) for w in want}
    assert bpe.encode_texts(odd_docs, RANKS, public_tokenizers.PATTERN).count() == 12
    assert bpe.encode_texts(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


# ---- files ----


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_planes_round_trip(bits, n):
    for top in (1, 2, 255, 256, 50_000, 2**32 - 1):
        ids = np.random.default_rng(n).integers(0, top, n, dtype=np.uint32)
        assert np.array_equal(token_files.from_planes(token_files.to_planes(ids, bits), n, bits), ids)


def test_shard_walk_and_slices():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    counts = [1, 300, 5, 64, 128, 1, 1000]
    ids = rng.integers(0, 50_000, sum(counts), dtype=np.uint32)
    table = pa.table({"doc_id": pa.array(range(len(counts))), "n_tokens": pa.array(counts, pa.int64())})
    content = token_files.pack_shard(3, 4, ids, table, 64, False)
    shard = token_files.Shard(content)
    assert (shard.part, shard.sequence, shard.n_ids, shard.n_docs) == (3, 4, len(ids), len(counts))
    at = 0
    for (row, start, got), n in zip(shard.walk(), counts):
        assert start == at and np.array_equal(got, ids[at : at + n])
        at += n
    assert np.array_equal(shard.ids(60, 200), ids[60:200]) and len(shard.ids(5, 5)) == 0
    with pytest.raises(ValueError):
        token_files.Shard(content[:-9] + b"\0" + content[-8:])


def expected_rows(rows, library):
    out, at = [], 0
    for key, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_token_files(spark, documents, odd_docs, no_docs, library):
    docs = documents.select("doc_id", "text").union(odd_docs.where("doc_id is not null and text not like 'x%'").selectExpr("doc_id + 100000", "text"))
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: r[0])
    got = token_files.token_files(docs.repartition(5), JSON, public_tokenizers.PATTERN, block_ids=128, shard_ids=5000)
    assert sorted(map(tuple, got.collect())) == expected_rows(rows, library)
    assert token_files.token_files(no_docs, JSON, public_tokenizers.PATTERN).count() == 0
    odd = token_files.token_files(odd_docs, JSON, public_tokenizers.PATTERN).collect()
    assert len(odd) == 12 and max(r.start + r.n_tokens for r in odd) == sum(r.n_tokens for r in odd)


def test_library_encoder_equals_library(library):
    with open(JSON, encoding="utf-8") as file:
        encoder = token_files.library_encoder(file.read(), public_tokenizers.PATTERN)
    for text in hard_texts(800):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_ids_can_be_kept(spark, tmp_path, library):
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string").withColumn("start", F.lit("clash"))
    folder = f"file://{tmp_path}/tokens"
    files = token_files.write_token_files(docs, JSON, public_tokenizers.PATTERN, folder, bits=True)
    got = token_files.read_token_files(spark, folder, files, docs.schema["doc_id"].dataType, keep_ids=True)
    assert {r.doc_id: r.ids for r in got.collect()} == {1: [*library.encode("one two").ids, 0], 2: [0]}


# ---- added tokens: the library with its defaults ----


def with_added_tokens():
    """The tokenizer file with more added tokens, of every kind of flag."""
    import json

    with open(JSON, encoding="utf-8") as file:
        whole = json.load(file)
    plain = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False}
    more = [("<|end", {}), ("WORD", {"single_word": True}), ("<L>", {"lstrip": True}), ("<R>", {"rstrip": True, "special": True}), ("<LR>", {"lstrip": True, "rstrip": True}), ("<n>", {"normalized": True}), ("<n><n>", {"normalized": True})]
    whole["added_tokens"] += [{"id": 50257 + i, "content": c, **plain, **flags} for i, (c, flags) in enumerate(more)]
    return json.dumps(whole)


@pytest.mark.parametrize("more", [False, True])
def test_added_tokens_equal_library_defaults(more):
    from tokenizers import Tokenizer

    with open(JSON, encoding="utf-8") as file:
        raw = with_added_tokens() if more else file.read()
    library, encoder = Tokenizer.from_str(raw), token_files.file_encoder(raw, public_tokenizers.PATTERN)
    rng = random.Random(5)
    stock = ["<|endoftext|>", "<|endoftext", "|>", "<|end", "WORD", "<L>", "<R>", "<LR>", "<n>", " ", "  ", "\n", "a", "b c", "é", "漢", ".", "_", "1", "\u3000"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", *hard_texts(200)] + ["".join(rng.choice(stock) for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_token_files_with_added_tokens(spark):
    from tokenizers import Tokenizer

    rows = [(1, "a <|endoftext|> b"), (2, "after"), (3, "<|endoftext|>"), (4, None), (5, "x<|endoftext|>\n\n<|endoftext|> y")]
    got = token_files.token_files(spark.createDataFrame(rows, "doc_id long, text string"), JSON, public_tokenizers.PATTERN)
    assert sorted(map(tuple, got.collect())) == expected_rows(rows, Tokenizer.from_file(JSON))
    assert got.where("doc_id = 1").first().n_tokens == 5

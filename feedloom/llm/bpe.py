"""Byte-level BPE: encoding with a hierarchical-bitmap rank queue, and decoding.

Every merge rank has a bucket of linked-list positions. A two-level bitmap over the ranks names the lowest bucket that is not empty
by finding first set bits, so the next merge costs the same however long the pre-token is; entries whose pair has changed meanwhile are
skipped. Chunks between single spaces repeat a lot, so each worker process keeps a bounded table of encoded ones.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import types
from array import array
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import id_text

#: Entries that a worker keeps of encoded chunks, and an eighth as many of other pre-tokens; longer ones are not kept.
TABLE_ENTRIES, TABLE_CHARS = 640_000, 64
#: With this pattern ``ChunkEncoder`` knows some cuts without asking it.
PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARKS = frozenset(",.;:!?)")
#: Spaces between two characters that are no white space: a pre-token always begins there.
SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def once_per_process(name: str, make):
    """``make()``, kept for later tasks of the same Python worker."""
    holder = sys.modules.setdefault("_feedloom_worker", types.ModuleType("_feedloom_worker"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the lines of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


def merge(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """Ids of one pre-token: the pair of lowest rank, the leftmost of equals, is merged until none is left.

    ``buckets`` has the positions of each rank as a small heap. Bit r of the lower bitmap, kept in words of 256 bits, says that rank r has a
    bucket; bit w of ``top`` says that word w is not zero.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, get = len(piece), ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    token: list[int | None] = [ranks[piece[i : i + 1]] for i in range(n)]
    pair: list[int | None] = [None] * n  # rank of the pair that begins here
    buckets: dict[int, list[int]] = {}
    words: dict[int, int] = {}
    top = 0
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            pair[i] = rank
            if rank in buckets:
                buckets[rank].append(i)  # positions ascend: still a heap
            else:
                buckets[rank] = [i]
                word = rank >> 8
                words[word] = words.get(word, 0) | 1 << (rank & 255)
                top |= 1 << word
    while top:
        word = (top & -top).bit_length() - 1
        bits = words[word]
        low = bits & -bits
        lowest = word << 8 | low.bit_length() - 1
        bucket = buckets[lowest]
        i = heappop(bucket)
        if not bucket:
            del buckets[lowest]
            words[word] = bits = bits ^ low
            if not bits:
                top ^= 1 << word
        if pair[i] != lowest:
            continue  # the pair has changed since
        j = after[i]
        after[i] = k = after[j]
        token[i], token[j], pair[j] = lowest, None, None
        if k < n:
            before[k] = i
        for at in (i, before[i]):
            if at < 0:
                continue
            middle = after[at]
            rank = None
            if middle < n:
                end = after[middle]
                if end - at <= longest:
                    rank = get(piece[at:end])
            pair[at] = rank
            if rank is not None:
                if rank in buckets:
                    heappush(buckets[rank], at)
                else:
                    buckets[rank] = [at]
                    word = rank >> 8
                    words[word] = words.get(word, 0) | 1 << (rank & 255)
                    top |= 1 << word
    return [t for t in token if t is not None]


class Table:
    """What came first stays for good, up to ``limit`` entries: by Zipf's law that holds nearly all frequent ones. Later entries share a
    second part a quarter as large, which starts anew when it is full."""

    __slots__ = ("first", "limit", "recent")

    def __init__(self, limit: int):
        self.limit, self.first, self.recent = limit, {}, {}

    def get(self, key):
        got = self.first.get(key)
        return self.recent.get(key) if got is None else got

    def put(self, key, value) -> None:
        if len(self.first) < self.limit:
            self.first[key] = value
        else:
            if len(self.recent) >= self.limit // 4:
                self.recent.clear()
            self.recent[key] = value


class ChunkEncoder:
    """Ids of a text, as little-endian unsigned 32-bit integers, through tables of chunks and pre-tokens. ``pretoken`` encodes one pre-token."""

    def __init__(self, pattern: str, pretoken):
        compiled = regex.compile(pattern)
        self.find, self.match, self.pretoken = compiled.findall, compiled.match, pretoken
        self.plain_pattern = pattern == PLAIN_PATTERN
        self.chunks, self.pretokens = Table(TABLE_ENTRIES), Table(TABLE_ENTRIES // 8)

    def _piece(self, piece: str) -> bytes:
        ids = array("I", self.pretoken(piece))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _plain(self, text: str) -> bytes:
        out = []
        for piece in self.find(text):
            # A pre-token of a space and a chunk shares that chunk's entry: what the chunk alone would be cut into is this one pre-token.
            spaced = len(piece) > 1 and piece[0] == " " and not piece[1].isspace()
            table, key = (self.chunks, piece[1:]) if spaced else (self.pretokens, piece)
            got = table.get(key)
            if got is None:
                got = self._piece(piece)
                if len(piece) <= TABLE_CHARS:
                    table.put(key, got)
            out.append(got)
        return b"".join(out)

    def _new_chunk(self, chunk: str) -> bytes:
        """Encode a chunk that is in no table, and keep it. With the plain pattern a word of letters is one pre-token, and a mark after one is another."""
        text = " " + chunk
        if self.plain_pattern and chunk.isascii():
            if chunk.isalpha():
                got = self._piece(text)
            elif chunk[-1:] in MARKS and chunk[:-1].isalpha():
                got = self._chunk(chunk[:-1]) + self._plain(chunk[-1])
            else:
                got = self._plain(text)
        else:
            first = self.match(text)
            got = self._piece(text) if first is not None and first.end() == len(text) else self._plain(text)
        if len(chunk) <= TABLE_CHARS and chunk and not chunk[0].isspace() and not chunk[-1].isspace():
            self.chunks.put(chunk, got)
        return got

    def _chunk(self, chunk: str) -> bytes:
        return self.chunks.get(chunk) or self._new_chunk(chunk)

    def encode(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        got = list(map(self.chunks.first.get, rest))
        cut = not first[-1:].isspace()
        if cut and None in got:
            recent = self.chunks.recent
            for i, ids in enumerate(got):
                if ids is None:
                    chunk = rest[i]
                    if not chunk or chunk[0].isspace() or chunk[-1].isspace():
                        cut = False
                        break
                    got[i] = recent.get(chunk) or self._chunk(chunk)
        if not cut:
            first, *rest = SAFE_SPACE.split(text)
            got = [self._chunk(c) for c in rest]
        return self._plain(first) + b"".join(got)


def rank_encoder(raw: bytes, pattern: str) -> tuple[ChunkEncoder, list[bytes]]:
    ranks = read_ranks(raw)
    longest = max(map(len, ranks), default=0)
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return ChunkEncoder(pattern, lambda piece: merge(piece.encode("utf-8", "surrogatepass"), ranks, longest)), tokens


def decode(ids: bytes, tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_texts(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids array, ids_sha256, decoded_sha256), one row per input row; without ``ids`` if they are not kept.

    ``ids_sha256`` is taken over little-endian unsigned 32-bit ids and ``decoded_sha256`` over the bytes that the ids decode to.
    Null texts count as empty and have no ids. Special tokens are ordinary text. Other columns of the input are not read.
    """
    source = id_text(docs, id_col, text_col)
    with open(rank_file, "rb") as file:  # read by the driver: executors need no such file
        shared = source.sparkSession.sparkContext.broadcast(file.read())
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        name = "bpe_" + hashlib.sha256(shared.value + pattern.encode()).hexdigest()
        encoder, tokens = once_per_process(name, lambda: rank_encoder(shared.value, pattern))
        for batch in batches:
            counts, ids, digests, decoded = [], [], [], []
            for text in batch.column("text").to_pylist():
                got = encoder.encode(text)
                counts.append(len(got) // 4)
                if keep_ids:
                    ids.append(np.frombuffer(got, "<u4").astype(np.int32))
                digests.append(hashlib.sha256(got).hexdigest())
                decoded.append(hashlib.sha256(decode(got, tokens)).hexdigest())
            columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(counts, pa.int64())}
            columns |= {"ids": pa.array(ids, pa.list_(pa.int32()))} if keep_ids else {}
            columns |= {"ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    middle = "ids array<int>, " if keep_ids else ""
    return source.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, {middle}ids_sha256 string, decoded_sha256 string")


def decode_ids(encoded: DataFrame, rank_file: str, ids_col: str = "ids") -> DataFrame:
    """The input with a last column ``decoded``: the text of its ids; bytes that are no UTF-8 become replacement characters. Null ids stay null."""
    from pyspark.sql import types as T

    encoded = encoded.drop("decoded")
    with open(rank_file, "rb") as file:
        shared = encoded.sparkSession.sparkContext.broadcast(file.read())

    def run(batches):
        tokens = [t for t, _ in sorted(read_ranks(shared.value).items(), key=lambda x: x[1])]
        for batch in batches:
            texts = [None if ids is None else b"".join(map(tokens.__getitem__, ids)).decode("utf-8", "replace") for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))

"""Supervised subword embeddings: hashed word and character n-gram vectors, averaged per document, softmax on top.

Training is plain stochastic gradient descent in numpy on a bounded sample of labelled rows, in one task. The average and the softmax
layer are linear, so a trained model collapses to one number per hash bucket; scoring whole texts is then a vectorised sum. The
numbers are fixed-point integers: a score does not depend on how rows were dealt to tasks or texts cut into blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import set_aside

FIXED = 1 << 24
GAPS = " \t\n\r\x0b\x0c"
_BASE = 0x100000001B3
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    #: Hash buckets of the embedding table, as a power of two, and its width.
    bucket_bits: int = 17
    width: int = 16
    grams: tuple[int, ...] = (3, 4, 5)
    #: The bound on what training sees: labelled rows.
    train_rows: int = 4096
    #: Steps of gradient descent, however few the rows are.
    steps: int = 12_000
    rate: float = 0.1
    seed: int = 11


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
    up, down = np.full(n + 1, base), np.full(n + 1, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Hasher:
    """Buckets of words, of pairs of neighbouring words and of character n-grams inside words, word ends included, for many pieces of text at once."""

    def __init__(self, bucket_bits: int, grams: tuple[int, ...]):
        self.shift, self.grams = np.uint64(64 - bucket_bits), grams
        self.up, self.down = _powers(1 << 16)

    def features(self, pieces: list[str]):
        """Yields (piece index per feature, bucket per feature); indices ascend within each yield."""
        codes = np.frombuffer((" " + " ".join(pieces) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(p) + 1 for p in pieces])
        gap = (codes == 32) | ((codes >= 9) & (codes <= 13))
        wide = codes.astype(np.uint64)
        wide[gap] = 32
        n = len(codes)
        if n > len(self.up):
            self.up, self.down = _powers(2 * n)
        starts, stops = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1, np.flatnonzero(~gap[:-1] & gap[1:]) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(wide * self.down[:n], out=sums[1:])
        words = (sums[stops] - sums[starts]) * self.up[stops]
        owner = np.searchsorted(ends, starts, side="right")
        yield owner, (words * _MIX) >> self.shift
        near = np.flatnonzero(owner[1:] == owner[:-1])  # pairs of neighbours; all pairs of one word with itself share a bucket
        pairs = np.where(words[near] == words[near + 1], np.uint64(1), words[near] * np.uint64(_BASE) + words[near + 1])
        yield owner[near], (pairs * _MIX) >> self.shift
        where = np.repeat(np.arange(len(pieces)), np.diff(np.r_[0, ends]))  # position i belongs to the piece that ends after it
        inner = np.r_[0, np.cumsum(gap)]
        for k in self.grams:
            m = n - k + 1
            if m <= 0:
                continue
            keep = np.flatnonzero(inner[k - 1 : k - 1 + m] == inner[1 : m + 1])  # no white space but at the ends
            h = np.full(len(keep), k, np.uint64)
            for j in range(k):
                h = h * np.uint64(_BASE) + wide[keep + j]
            yield where[np.minimum(keep, len(where) - 1)], (h * _MIX) >> self.shift


def _pieces(texts: list[str], limit: int = 1 << 18):
    """Blocks of about ``limit`` characters.

    A longer text is cut at white space, which no word or n-gram crosses; ``text_features`` adds the pair of words at a cut. Cuts depend on the text alone.
    """
    index, pieces, size = [], [], 0
    for i, text in enumerate(texts):
        start = 0
        while True:
            end = min(len(text), start + limit)
            while end < len(text) and text[end] not in " \t\n\r\x0b\x0c":
                end += 1
            index.append(i)
            pieces.append(text[start:end])
            size += end - start + 1
            if size >= limit:
                yield index, pieces
                index, pieces, size = [], [], 0
            start = end
            if start >= len(text):
                break
    if pieces:
        yield index, pieces


def _edge(piece: str, last: bool) -> str:
    """The first or last word of a piece; empty if it has none."""
    if last:
        piece = piece.rstrip(GAPS)
        return piece[max(piece.rfind(c) for c in GAPS) + 1 :]
    piece = piece.lstrip(GAPS)
    ends = [i for i in map(piece.find, GAPS) if i >= 0]
    return piece[: min(ends, default=len(piece))]


def text_features(texts: list[str], hasher: Hasher):
    """Yields (text index per feature, bucket per feature) of all words, pairs and n-grams of whole texts; indices ascend within each yield."""
    before: tuple[int, str] = (-1, "")  # last word so far of the text that the last piece belongs to
    for index, pieces in _pieces(texts):
        at = np.asarray(index)
        for where, bucket in hasher.features(pieces):
            yield at[where], bucket
        for i, piece in zip(index, pieces):
            if before[0] == i and before[1]:
                following = _edge(piece, last=False)
                if following:
                    _, (_, pair), *_ = hasher.features([f"{before[1]} {following}"])
                    yield np.array([i]), pair
            before = (i, _edge(piece, last=True) or (before[1] if before[0] == i else ""))


def bucket_counts(text: str, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Different buckets of one text with their counts."""
    ids, counts = np.unique(np.concatenate([b for _, b in text_features([text], hasher)]), return_counts=True)
    return ids.astype(np.int32), counts.astype(np.int32)


def fit(examples: list[tuple[int, np.ndarray, np.ndarray]], settings: Settings) -> tuple[np.ndarray, int]:
    """Stochastic gradient descent over (label, buckets, counts). Returns fixed-point bucket weights and bias of the log-odds of label 1.

    Without examples of both labels the weights are zero and the bias is the log-odds of the smoothed share of label 1.
    """
    n1 = sum(label for label, _, _ in examples)
    n, size = len(examples), 1 << settings.bucket_bits
    prior = float(np.log((n1 + 1) / (n - n1 + 1)))
    if n1 in (0, n):
        return np.zeros(size, np.int32), round(prior * FIXED)
    rng = np.random.default_rng(settings.seed)
    table = rng.uniform(-1 / settings.width, 1 / settings.width, (size, settings.width)).astype(np.float32)
    layer = rng.normal(0, 0.1, (settings.width, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    # Both labels weigh the same in total, so that a probability of one half is the middle between them.
    weigh = np.array([n / (2 * (n - n1)), n / (2 * n1)], np.float32)
    shares = [(counts / counts.sum()).astype(np.float32) if len(counts) else counts.astype(np.float32) for _, _, counts in examples]
    step = 0
    while step < settings.steps:
        for i in rng.permutation(n)[: settings.steps - step]:
            label, ids, _ = examples[i]
            rate = np.float32(settings.rate * (1 - step / settings.steps))
            step += 1
            mean = shares[i] @ table[ids] if len(ids) else np.zeros(settings.width, np.float32)
            odds = mean @ layer + bias
            p = np.exp(odds - odds.max())
            p /= p.sum()
            p[label] -= 1
            p *= weigh[label]
            back = layer @ p
            layer -= rate * np.outer(mean, p)
            bias -= rate * np.float32(0.1) * p
            table[ids] -= rate * shares[i][:, None] * back
    weights = table @ (layer[:, 1] - layer[:, 0])
    return np.round(np.clip(weights, -60, 60) * FIXED).astype(np.int32), round(float(bias[1] - bias[0]) * FIXED)


def train(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label"):
    """Fit on ``labels`` (id, label 0 or 1) joined with the texts of ``docs``. Returns (weights, bias).

    The sample is the ``train_rows`` labelled ids of ``docs`` that hash lowest; an id with several labels counts with the smallest. Labels
    that are neither 0 nor 1, null ids and labelled ids without a text are left out; a null text counts as empty.
    """
    settings = settings or Settings()
    usable = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).where("_id is not null and y in (0, 1)")
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    present = texts.select("_id").join(usable, "_id")
    sample = present.groupBy("_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(settings.train_rows)
    texts = texts.join(F.broadcast(sample), "_id")  # train_rows bounds its size

    def count(batches):
        hasher = Hasher(settings.bucket_bits, settings.grams)
        for batch in batches:
            got = [bucket_counts(t, hasher) for t in batch.column("text").to_pylist()]
            columns = [pa.array([g[j] for g in got], pa.list_(pa.int32())) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("y"), *columns], ["_id", "y", "ids", "counts"])

    kind = texts.schema["_id"].dataType.simpleString()
    counted = texts.select("_id", "y", "text").mapInArrow(count, f"_id {kind}, y int, ids array<int>, counts array<int>")

    def learn(batches):
        examples = []
        for batch in batches:
            ids, counts = (batch.column(c) for c in ("ids", "counts"))
            for i, y in enumerate(batch.column("y").to_pylist()):
                examples.append((y, np.asarray(ids[i].values), np.asarray(counts[i].values)))
        weights, bias = fit(examples, settings)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], ["weights", "bias"])

    row = counted.repartition(1).sortWithinPartitions("_id", F.xxhash64("ids")).mapInArrow(learn, "weights binary, bias bigint").first()
    if row is None:
        return fit([], settings)
    return np.frombuffer(row.weights, np.int32), row.bias


def log_odds(texts: list[str], hasher: Hasher, weights: np.ndarray, bias: int) -> np.ndarray:
    """Log-odds of label 1, from exact integer sums over all words and n-grams of each text."""
    total, number = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for where, bucket in text_features(texts, hasher):
        if len(where):
            first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
            np.add.at(total, where[first], np.add.reduceat(weights[bucket].astype(np.int64), first))
            np.add.at(number, where[first], np.diff(np.r_[first, len(where)]))
    return (total / np.maximum(number, 1) + bias) / FIXED


def score(docs: DataFrame, model, settings: Settings | None = None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Every row of ``docs`` with a last column ``score_col``: the probability of label 1, 0 to 1, of the whole text.

    Null and empty texts, and those without words, get the model's prior. Rows, repeated ones included, and all other columns stay as they
    are; a column that already has the name ``score_col`` is replaced.
    """
    settings = settings or Settings()
    docs, restore = set_aside(docs.drop(score_col))
    shared = docs.sparkSession.sparkContext.broadcast((model[0], model[1]))  # one number per bucket, whatever the input

    def run(batches):
        weights, bias = shared.value
        hasher = Hasher(settings.bucket_bits, settings.grams)
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            values = 1 / (1 + np.exp(-log_odds(texts, hasher, weights, bias)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], [*batch.schema.names, score_col])

    from pyspark.sql import types as T

    return restore(docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])))


def held_out(id_col: str = "doc_id"):
    """True for the third of all ids that labels must not be learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))

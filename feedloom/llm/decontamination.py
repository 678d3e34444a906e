"""Benchmark passages in documents: a prefix-filtered containment join.

Each window of consecutive item words is a set of word shingles that a document must contain whole. Shingles are ordered by rarity over
all documents; for containment the necessary prefix is the one rarest shingle of a window. Where a document has it, the shingle's place in
the window says where the window would begin; the document's length and that position rule candidates out, and the words of the rest are
compared one by one.

Documents are never shuffled. What tasks get of the benchmark is bounded: it is taken in parts of at most ``part_words`` words,
one pass over the documents each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.llm.common import set_aside, share
from feedloom.session import materialise

WINDOW, SHINGLE = 10, 3
#: Words of the benchmark that one pass holds.
PART_WORDS = 1_000_000
#: Lower-cases A-Z and makes a space of every ASCII character that is neither letter nor digit.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


@dataclass
class Part:
    """Some items of the benchmark as arrays: a word's number, and per window its words and item."""

    numbers: dict[bytes, int]
    items: list
    windows: np.ndarray  # all windows, end to end
    starts: np.ndarray  # where each begins
    lengths: np.ndarray
    owners: np.ndarray  # index into items
    shingle: int

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """A code per shingle of consecutive word numbers; -1 where a word is in no item."""
        base = len(self.numbers) + 1
        n = len(ids) - self.shingle + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        code, known = np.zeros(n, np.int64), np.ones(n, bool)
        for j in range(self.shingle):
            part = ids[j : j + n]
            code = code * base + part
            known &= part >= 0
        code[~known] = -1
        return code


def make_part(rows: list[tuple], window: int, shingle: int) -> list[Part]:
    """Parts of items (id, text): windows of at least ``shingle`` words, and for each shorter length a part of its own."""
    numbers: dict[bytes, int] = {}
    found: dict[int, tuple[list, list, list]] = {}
    items: dict = {}
    for item, text in rows:
        words = words_of(text)
        ids = [numbers.setdefault(w, len(numbers)) for w in words]
        size = min(window, len(ids))
        if not size:
            continue
        owner = items.setdefault(item, len(items))
        flat, lengths, owners = found.setdefault(min(size, shingle), ([], [], []))
        for at in range(len(ids) - size + 1):
            flat.extend(ids[at : at + size])
            lengths.append(size)
            owners.append(owner)
    out = []
    for width, (flat, lengths, owners) in sorted(found.items()):
        sizes = np.array(lengths, np.int64)
        # base**shingle must stay within 63 bits; a wider vocabulary takes shorter shingles
        while width > 1 and (len(numbers) + 1) ** width >= 1 << 62:
            width -= 1
        out.append(Part(numbers, list(items), np.array(flat, np.int64), np.r_[0, np.cumsum(sizes)[:-1]], sizes, np.array(owners, np.int64), width))
    return out


def window_codes(part: Part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, offset, code) of every shingle of every window."""
    n = part.lengths - part.shingle + 1
    window = np.repeat(np.arange(len(n)), n)
    offset = np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
    at, base = part.starts[window] + offset, len(part.numbers) + 1
    code = np.zeros(len(at), np.int64)
    for j in range(part.shingle):
        code = code * base + part.windows[at + j]
    return window, offset, code


class Index:
    """Windows by their rarest shingle."""

    def __init__(self, part: Part, counts: dict[int, int]):
        self.part = part
        window, offset, code = window_codes(part)
        rarity = np.array([counts.get(c, 0) for c in code.tolist()], np.int64)
        order = np.lexsort((offset, code, rarity, window))
        first = order[np.r_[True, window[order][1:] != window[order][:-1]]]
        by_code = first[np.argsort(code[first], kind="stable")]
        self.code, self.window, self.offset = code[by_code], window[by_code], offset[by_code]

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) of every occurrence in a document's word numbers."""
        codes = self.part.codes(ids)
        spots = np.flatnonzero(codes >= 0)
        low, high = np.searchsorted(self.code, codes[spots]), np.searchsorted(self.code, codes[spots], side="right")
        width = high - low
        spots, low, width = spots[width > 0], low[width > 0], width[width > 0]
        if not len(spots):
            return spots, spots
        row = np.repeat(low - np.r_[0, np.cumsum(width)[:-1]], width) + np.arange(width.sum())
        window = self.window[row]
        start = np.repeat(spots, width) - self.offset[row]
        size = self.part.lengths[window]
        fits = (start >= 0) & (start + size <= len(ids))
        window, start, size = window[fits], start[fits], size[fits]
        same = np.ones(len(window), bool)
        for j in range(int(size.max(initial=0))):
            live = np.flatnonzero(same & (size > j))
            same[live] = ids[start[live] + j] == self.part.windows[self.part.starts[window[live]] + j]
        return window[same], start[same]


def _word_numbers(words: list[bytes], numbers: dict[bytes, int]) -> np.ndarray:
    get = numbers.get
    return np.array([get(w, -1) for w in words], np.int64)


def shingle_counts(docs: DataFrame, parts: list[Part], text_col: str = "text") -> list[dict[int, int]]:
    """In how many documents each shingle of the parts occurs, over all documents."""
    shared = share(docs.sparkSession, [(p, np.unique(window_codes(p)[2])) for p in parts])  # part_words bounds it

    def count(batches):
        wanted = shared()
        totals = [np.zeros(len(codes), np.int64) for _, codes in wanted]
        for batch in batches:
            for text in batch.column("text").to_pylist():
                ids = _word_numbers(words_of(text), wanted[0][0].numbers)
                for total, (part, codes) in zip(totals, wanted):
                    got = np.unique(part.codes(ids))
                    at = np.searchsorted(codes, got)
                    ok = at < len(codes)
                    total[at[ok][codes[at[ok]] == got[ok]]] += 1
        for i, total in enumerate(totals):
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), i, np.int32)), pa.array(wanted[i][1][seen]), pa.array(total[seen])], ["part", "code", "n"])

    counted = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text")).mapInArrow(count, "part int, code bigint, n bigint")
    out: list[dict[int, int]] = [{} for _ in parts]
    for row in counted.groupBy("part", "code").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row.part][row.code] = row.n
    return out


OUT = ("n_words", "n_hit", "hits", "items")
_SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("past", T.LongType())]))


def mark_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    shingle: int = SHINGLE,
    part_words: int = PART_WORDS,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Every row of ``docs``, all its columns as they are, with n_words, n_hit, hits and items at the end (which replace columns so named).

    ``hits`` are the stretches of words (first, past the last) inside occurrences of a window, ``n_hit`` their total length; ``items``
    the ids, as distinct sorted strings, of items with such a window. A null text has no words. Items without words or id match nothing; items that
    repeat an id count as one. Without items nothing is hit. Repeated documents are judged alike.
    """
    docs, restore = set_aside(docs.drop(*OUT))
    bench = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{item_text_col}`").cast("binary").alias("text")).where("item is not null and text is not null")
    n_words = F.size(F.regexp_extract_all(F.col("text").cast("string"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)))
    n_parts = max(1, -(-(bench.agg(F.sum(n_words)).first()[0] or 0) // part_words))
    none = {"n_words": F.lit(0).cast("bigint"), "n_hit": F.lit(0).cast("bigint"), "hits": F.array().cast(_SPANS), "items": F.array().cast("array<string>")}
    state = docs.withColumns(none)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hits", _SPANS), T.StructField("items", T.ArrayType(T.StringType()))])
    for number in range(n_parts):
        mine = bench.where(F.pmod(F.xxhash64("item"), F.lit(n_parts)) == number)
        parts = make_part(sorted((r.item, bytes(r.text)) for r in mine.collect()), window, shingle)  # about part_words words
        counts = shingle_counts(docs, parts, text_col) if parts else []
        shared = share(docs.sparkSession, [Index(p, c) for p, c in zip(parts, counts)])
        state = state.mapInArrow(_search(shared, text_col), schema)
        if number + 1 < n_parts:
            state = materialise(state)
    return restore(state)


def _search(shared, text_col: str):
    def run(batches):
        indexes = shared()
        for batch in batches:
            n_words, n_hit, spans, items = [], [], [], []
            for text, old, was in zip(batch.column(text_col).to_pylist(), batch.column("hits").to_pylist(), batch.column("items").to_pylist()):
                words = words_of((text or "").encode("utf-8", "surrogatepass"))
                found = [(s["first"], s["past"]) for s in old]
                owners = set(was)
                ids = _word_numbers(words, indexes[0].part.numbers) if indexes else None
                for index in indexes:
                    window, start = index.find(ids)
                    if len(start):
                        pairs = np.unique(np.stack([start, start + index.part.lengths[window]]), axis=1)
                        found.extend(map(tuple, pairs.T.tolist()))
                        owners.update(index.part.items[o] for o in np.unique(index.part.owners[window]).tolist())
                joined: list[list[int]] = []
                for first, past in sorted(found):
                    if joined and first <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], past)
                    else:
                        joined.append([first, past])
                n_words.append(len(words))
                n_hit.append(sum(b - a for a, b in joined))
                spans.append([{"first": a, "past": b} for a, b in joined])
                items.append(sorted(owners))
            made = {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64())}
            made |= {c: pa.array(v, batch.schema.field(c).type) for c, v in (("hits", spans), ("items", items))}
            yield pa.RecordBatch.from_arrays([made.get(c, batch.column(c)) for c in batch.schema.names], batch.schema.names)

    return run

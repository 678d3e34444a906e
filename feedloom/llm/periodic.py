"""Periodic runs of words: recursive frequency splitting, then a lag scan of what survives.

A run of period q has at least ``repeats`` times q words, so each of its words occurs at least ``repeats`` times in any segment that
holds the run. Words too rare in their segment cut it; the pieces are counted anew until nothing more is cut. In ordinary prose
nothing is left by then. Surviving segments are scanned lag by lag. For lags from B to 2B (B a power of two) a run holds a whole
aligned block of B words that recurs one lag later, so only such lags are looked at, block by block; candidates come from rolling hashes
and are compared word by word, so results are exact. The scan takes n log n steps.

Everything happens inside the document's own task: no shuffle, and memory goes with one block of texts or the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.llm.common import id_text

#: A run has at least this many words and this many repeats of its period.
LEAST_WORDS, REPEATS = 6, 4
#: Bytes of text that are split into words at a time; a longer text is a block of its own.
BLOCK_BYTES = 1 << 21
#: Pairs of words compared at a time.
CHUNK = 1 << 21

_BASE = 0x100000001B3
_MIX = np.uint64(0x9E3779B97F4A7C15)


def surviving_segments(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, least_words: int = LEAST_WORDS, repeats: int = REPEATS) -> tuple[np.ndarray, np.ndarray]:
    """Segments (start, length) of ``words`` in which every word occurs ``repeats`` times; no qualifying run lies outside them.

    ``starts`` and ``lengths`` are the texts. A segment that was not cut in a round is done; the others are counted again.
    """
    done: list[tuple[np.ndarray, np.ndarray]] = []
    size = int(words.max(initial=0)) + 1
    open_ = lengths >= least_words
    starts, lengths = starts[open_], lengths[open_]
    while len(starts):
        segment = np.repeat(np.arange(len(starts)), lengths)
        first = np.cumsum(lengths) - lengths
        at = np.arange(len(segment)) - np.repeat(first - starts, lengths)
        key = segment * size + words[at]
        _, where, count = np.unique(key, return_inverse=True, return_counts=True)
        keep = count[where] >= repeats
        whole = np.logical_and.reduceat(keep, first)
        done.append((starts[whole], lengths[whole]))
        left = keep & ~whole[segment]
        at, segment = at[left], segment[left]
        if not len(at):
            break
        heads = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(segment) != 0)])
        lengths = np.diff(np.r_[heads, len(at)])
        starts = at[heads]
        open_ = lengths >= least_words
        starts, lengths = starts[open_], lengths[open_]
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, lengths = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(starts)
    return starts[order].astype(np.int64), lengths[order].astype(np.int64)


def _ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset within the row) for rows of the given numbers of elements."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _agreement(x: np.ndarray, a: np.ndarray, b: np.ndarray, reach: np.ndarray, step: int) -> np.ndarray:
    """How many words agree from positions ``a`` and ``b`` on in direction ``step``, at most ``reach`` each."""
    out = np.zeros(len(a), np.int64)
    cuts = np.searchsorted(np.cumsum(reach), np.arange(CHUNK, int(reach.sum()) + CHUNK, CHUNK), side="left") + 1
    low = 0
    for high in np.minimum(cuts, len(a)):
        if high <= low:
            continue
        part = reach[low:high]
        row, offset = _ragged(part)
        differs = x[a[low:high][row] + step * offset] != x[b[low:high][row] + step * offset]
        got = part.copy()
        np.minimum.at(got, row[differs], offset[differs])
        out[low:high] = got
        low = high
    return out


def lag_scan(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, least_words: int = LEAST_WORDS, repeats: int = REPEATS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs (start, length, period) inside the given segments; a period is the smallest of its run."""
    found = [(np.zeros(0, np.int64),) * 3]
    block = 1
    while True:
        fits = lengths >= max(least_words, repeats * block)
        starts, lengths = starts[fits], lengths[fits]
        if not len(starts):
            break
        # The segments side by side, each closed by a word of its own that occurs nowhere else.
        row, offset = _ragged(lengths + 1)
        x = words[np.minimum(starts[row] + offset, len(words) - 1)].astype(np.int64)
        ends = np.cumsum(lengths + 1) - 1
        base = ends - lengths
        x[ends] = -1 - np.arange(len(ends))
        n = len(x)
        mixed = (x.astype(np.uint64) * _MIX) ^ (x.astype(np.uint64) >> np.uint64(7))
        up = np.full(n + 1, np.uint64(_BASE))
        up[0] = 1
        up = np.multiply.accumulate(up)
        # Hash of the block at every position: sum of word times falling powers, by doubling the span.
        hashes, span = mixed, 1
        while span < block:
            hashes = hashes[:-span] * up[span] + hashes[span:]
            span *= 2
        # Ends of the runs known so far, as the furthest one that begins at or before each position.
        cover = np.zeros(n, np.int64)
        known = [np.concatenate(c) for c in zip(*found)]
        if len(known[0]):
            mine = np.searchsorted(starts, known[0], side="right") - 1
            inside = (mine >= 0) & (known[0] < starts[mine] + lengths[mine])
            shift = base[mine] - starts[mine]
            np.maximum.at(cover, (known[0] + shift)[inside], (known[0] + known[1] + shift)[inside])
            cover = np.maximum.accumulate(cover)
        hits_a, hits_q = [], []
        blocks = np.arange(0, len(hashes), block)
        for low in range(0, len(blocks), max(1, CHUNK // block)):
            a = blocks[low : low + max(1, CHUNK // block), None]
            other = a + np.arange(block, 2 * block)[None, :]
            near = other < len(hashes)
            same = near & (hashes[a] == hashes[np.minimum(other, len(hashes) - 1)])
            # A known run over both copies means that this lag is a multiple of its period.
            same &= cover[a] < other + block
            i, j = np.nonzero(same)
            hits_a.append(a[i, 0])
            hits_q.append(j + block)
        a, q = np.concatenate(hits_a), np.concatenate(hits_q)
        true = _agreement(x, a, a + q, np.full(len(a), block), 1) == block
        a, q = a[true], q[true]
        if len(a):
            order = np.lexsort((a, q))
            a, q = a[order], q[order]
            head = np.r_[True, (np.diff(q) != 0) | (np.diff(a) != block)]
            tail = np.r_[head[1:], True]
            first, last, q = a[head], a[tail] + block, q[head]
            # Neighbouring aligned blocks do not agree, so less than a block is left on either side.
            last = last + _agreement(x, last, last + q, np.minimum(block, n - last - q), 1)
            first = first - _agreement(x, first - 1, first - 1 + q, np.minimum(block, first), -1)
            length = last - first + q
            good = length >= np.maximum(least_words, repeats * q)
            first, length, q = first[good], length[good], q[good]
            mine = np.searchsorted(base, first, side="right") - 1
            found.append((first - base[mine] + starts[mine], length, q))
        block *= 2
    start, length, period = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def runs_of(texts: list[bytes], least_words: int = LEAST_WORDS, repeats: int = REPEATS):
    """Per text: its words, its runs (starts, lengths, periods) and which words are copies inside a run."""
    split = [t.split() for t in texts]
    lengths = np.array([len(w) for w in split], np.int64)
    bases = np.cumsum(lengths) - lengths
    table: dict[bytes, int] = {}
    number = table.setdefault
    words = np.fromiter((number(w, len(table)) for ws in split for w in ws), np.int64, int(lengths.sum()))
    start, length, period = lag_scan(words, *surviving_segments(words, bases, lengths, least_words, repeats), least_words, repeats)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    copied = np.cumsum(edge[:-1]) > 0
    cut = np.searchsorted(start, np.r_[bases, len(words)])
    for i, ws in enumerate(split):
        low, high, base = cut[i], cut[i + 1], bases[i]
        yield ws, (start[low:high] - base, length[low:high], period[low:high]), copied[base : base + len(ws)]


def _blocks(texts: list[bytes], limit: int):
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > limit:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, repeats: int = REPEATS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>, collapsed), one row per input row.

    Words are what white space (space and U+0009 to U+000D) separates, numbered from 0. A run is a stretch of words with smallest period q, at
    least ``least_words`` and ``repeats`` times q long, that no neighbouring word extends; runs come by start, then period. ``collapsed``
    holds the words that no run contains after its first q, joined by one space. Null, empty and blank texts have no words, no runs and
    an empty ``collapsed``. Rows with null or repeated ids or equal texts each keep their own row; other columns are not read. ``repeats`` is 3 or more.
    """
    if repeats < 3 or least_words < 1:
        raise ValueError("a run needs three repeats or more")
    source = id_text(docs, id_col, text_col)
    run_type = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])
    fields = [T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run_type, False)), T.StructField("collapsed", T.StringType())]
    arrow_run = pa.struct([pa.field(c, pa.int64(), False) for c in ("start", "length", "period")])

    def find(batches):
        for batch in batches:
            counts, offsets, kept = [], [0], []
            columns: list[list[np.ndarray]] = [[], [], []]
            for block in _blocks(batch.column("text").cast(pa.binary()).to_pylist(), block_bytes):
                for words, runs, copied in runs_of(block, least_words, repeats):
                    counts.append(len(words))
                    offsets.append(offsets[-1] + len(runs[0]))
                    for held, values in zip(columns, runs):
                        held.append(values)
                    kept.append(b" ".join(words) if not copied.any() else b" ".join([w for w, c in zip(words, copied.tolist()) if not c]))
            flat = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in columns]
            rows = pa.StructArray.from_arrays(flat, fields=list(arrow_run))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows, type=pa.list_(pa.field("element", arrow_run, False)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), lists, pa.array(kept, pa.binary()).view(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return source.mapInArrow(find, T.StructType(fields))


def repeat_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with a planted period in about a tenth of the texts.

    With h the CRC-32 of the decimal id and g = h div 10: if h mod 10 is 0 and the text has n > 0 words, each word i from a = g mod n on becomes
    word a + (i - a) mod p, where p = 1 + (n - a) div (3 + g mod 8); its words are then joined by one space. Other texts, and those with a null id, stay.
    """
    source = id_text(docs, id_col, text_col).withColumn("_h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    split = F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != "")
    source = source.withColumn("_w", F.when(F.col("_h") % 10 == 0, split)).withColumn("_g", F.floor(F.col("_h") / 10))
    source = source.withColumn("_a", F.when(F.size("_w") > 0, F.col("_g") % F.size("_w")))
    source = source.withColumn("_p", 1 + F.floor((F.size("_w") - F.col("_a")) / (3 + F.col("_g") % 8)))
    changed = F.transform("_w", lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.get("_w", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))))
    return source.select("doc_id", F.when(F.col("_a").isNotNull(), F.array_join(changed, " ")).otherwise(F.col("text")).alias("text"))

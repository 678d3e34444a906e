"""Ranked lexical search: a sharded inverted index with block maxima, searched by Block-Max MaxScore.

Index: each task cuts its rows into shards and writes, per shard, one row with its documents (ids and lengths, in order of id) and one
row per term with its postings in compressed blocks of ``BLOCK`` documents. A block carries the (frequency, length) pairs that no
other pair of the block beats, so its highest impact is exact for whatever corpus statistics a search brings.

Search: postings join the query terms on the term; shard and query block meet in one task. There the lists of an item are ordered by their
global bound: those whose bounds together stay under the 50th best score so far are non-essential. Essential lists are added up
window by window; a candidate goes on to a non-essential list only if its score, the maximum of the block it falls into and
the bounds of the remaining lists can still reach that score, and only blocks with such candidates are decompressed. Each shard yields
at most k rows per item, and one ranking per item merges them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.llm.common import id_text, share
from feedloom.session import materialise

#: Postings of a block, documents of a search window, and bounds of a shard.
BLOCK, WINDOW, SHARD_WORDS, SHARD_DOCS = 128, 4096, 1 << 21, 1 << 16
#: Items that are searched together in one task, about.
QUERY_BLOCK = 2048
#: Up to this many different query terms, about 16 MB, are sent to the tasks and only their lists are stored; beyond, all lists are.
FILTER_TERMS = 1 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All bytes under 0x80 but digits and letters separate terms.
_TABLE = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def term_column(text: Column | str) -> Column:
    """The terms of a text column, repeats included; null has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


# ---- the index ----


def _narrow(values: np.ndarray) -> tuple[int, bytes]:
    top = int(values.max(initial=0))
    width = 0 if top < 1 << 8 else 1 if top < 1 << 16 else 2
    return width, values.astype(("<u1", "<u2", "<u4")[width]).tobytes()


def pack_block(places: np.ndarray, counts: np.ndarray, before: int, squeeze) -> bytes:
    """Gaps between places (from ``before`` on) and counts, each as narrow as its largest value allows, then zstandard."""
    (a, gaps), (b, tf) = _narrow(np.diff(places, prepend=before)), _narrow(counts)
    return squeeze(bytes([a, b]) + gaps + tf)


def unpack_block(packed: bytes, before: int, expand) -> tuple[np.ndarray, np.ndarray]:
    raw = expand(packed)
    kinds = ("<u1", "<u2", "<u4")
    wide = (1 << raw[0]) + (1 << raw[1])
    n = (len(raw) - 2) // wide
    gaps = np.frombuffer(raw, kinds[raw[0]], n, 2)
    return before + np.cumsum(gaps, dtype=np.int64), np.frombuffer(raw, kinds[raw[1]], n, 2 + (n << raw[0])).astype(np.int64)


def _index_type(id_type: T.DataType) -> T.StructType:
    whole = T.ArrayType(T.LongType())
    return T.StructType(
        [
            T.StructField("shard", T.LongType()), T.StructField("term", T.StringType()), T.StructField("df", T.LongType()),
            T.StructField("ids", T.ArrayType(id_type)), T.StructField("lengths", whole),
            T.StructField("last", whole), T.StructField("offset", whole), T.StructField("best_at", whole), T.StructField("best_tf", whole), T.StructField("best_n", whole),
            T.StructField("data", T.BinaryType()),
        ]
    )


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.astype(np.int64)))


class ShardBuilder:
    """One shard's rows from the texts of its documents."""

    def __init__(self, vocabulary: dict[bytes, int] | None):
        self.fixed = vocabulary
        self.squeeze = zstandard.ZstdCompressor(level=1).compress

    def rows(self, shard: int, ids: pa.Array, words: list[list[bytes]], schema: pa.Schema):
        order = pc.sort_indices(ids, sort_keys=[("", "ascending")], null_placement="at_end").to_numpy()
        lengths = np.array([len(w) for w in words], np.int64)[order]
        names = {} if self.fixed is None else self.fixed
        if self.fixed is None:
            number = names.setdefault
            flat = np.fromiter((number(w, len(names)) for i in order for w in words[i]), np.int64, int(lengths.sum()))
        else:
            get = names.get
            flat = np.fromiter((get(w, -1) for i in order for w in words[i]), np.int64, int(lengths.sum()))
        place = np.repeat(np.arange(len(order)), lengths)
        known = flat >= 0
        key, tf = np.unique(flat[known] * len(order) + place[known], return_counts=True)
        term, place = np.divmod(key, max(1, len(order)))
        yield self._documents(shard, ids.take(pa.array(order)), lengths, schema)
        if len(key):
            yield self._postings(shard, term, place, tf.astype(np.int64), lengths[place], names, schema)

    def _documents(self, shard: int, ids: pa.Array, lengths: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
        columns = {c: pa.nulls(1, schema.field(c).type) for c in schema.names}
        columns |= {"shard": pa.array([shard], pa.int64()), "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids).cast(schema.field("ids").type)}
        columns["lengths"] = _lists(lengths, np.array([0, len(lengths)])).cast(schema.field("lengths").type)
        return pa.RecordBatch.from_arrays([columns[c] for c in schema.names], schema=schema)

    def _postings(self, shard, term, place, tf, length, names, schema) -> pa.RecordBatch:
        heads = np.flatnonzero(np.r_[True, np.diff(term) != 0])
        df = np.diff(np.r_[heads, len(term)])
        inner = np.arange(len(term)) - np.repeat(heads, df)
        block_at = np.flatnonzero(inner % BLOCK == 0)
        sizes = np.diff(np.r_[block_at, len(term)])
        ends = block_at + sizes - 1
        before = np.where(inner[block_at] == 0, -1, place[block_at - 1])
        # Within a block: lengths rising; a posting counts only if its frequency is above that of all shorter documents.
        block = np.repeat(np.arange(len(block_at)), sizes)
        order = np.lexsort((-tf, length, block))
        level = np.maximum.accumulate(tf[order] + block * (int(tf.max()) + 1))
        best = np.r_[True, level[1:] > level[:-1]]
        best_block, best_tf, best_n = block[best], tf[order][best], length[order][best]
        packed = [pack_block(place[a : a + n], tf[a : a + n], b, self.squeeze) for a, n, b in zip(block_at.tolist(), sizes.tolist(), before.tolist())]
        blocks_of = -(-df // BLOCK)
        first = np.r_[0, np.cumsum(blocks_of)]
        bytes_at = np.r_[0, np.cumsum([len(p) for p in packed])]
        best_at = np.searchsorted(best_block, np.arange(len(block_at)))
        best_cut = np.searchsorted(best_block, first)
        ordered = list(names)  # numbers were given in this order
        texts = [ordered[t] for t in term[heads].tolist()]
        n = len(heads)
        columns = {
            "shard": pa.array(np.full(n, shard, np.int64)), "term": pa.array(texts, pa.binary()).view(pa.string()), "df": pa.array(df.astype(np.int64)),
            "ids": pa.nulls(n, schema.field("ids").type), "lengths": pa.nulls(n, schema.field("lengths").type),
            "last": _lists(place[ends], first), "offset": _lists(bytes_at[:-1] - np.repeat(bytes_at[first[:-1]], blocks_of), first),
            "best_at": _lists(best_at - np.repeat(best_cut[:-1], blocks_of), first), "best_tf": _lists(best_tf, best_cut), "best_n": _lists(best_n, best_cut),
            "data": pa.array([b"".join(packed[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())], pa.binary()),
        }
        return pa.RecordBatch.from_arrays([columns[c].cast(schema.field(c).type) for c in schema.names], schema=schema)


def build_index(docs: DataFrame, terms: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS, shard_docs: int = SHARD_DOCS, filter_terms: int = FILTER_TERMS) -> DataFrame:
    """The index of all rows of ``docs``, written to the shared folder. Terms are runs of letters, digits and characters beyond ASCII; A-Z count as a-z.

    With ``terms`` (column term) only their lists are stored, if there are at most ``filter_terms`` different ones. A shard takes whole
    documents up to ``shard_words`` words or ``shard_docs`` documents; a longer document is a shard of its own. Every row is a document,
    also with a null or repeated id or a text that repeats; documents without terms have length 0. Other columns are not read.
    """
    source = id_text(docs, id_col, text_col)
    vocabulary = None
    if terms is not None:
        wanted = terms.select("term").distinct().limit(filter_terms + 1).collect()  # bounded by filter_terms
        if len(wanted) <= filter_terms:
            vocabulary = {r.term.encode(): i for i, r in enumerate(wanted)}
    shared = share(docs.sparkSession, vocabulary)
    fields = _index_type(source.schema["doc_id"].dataType)

    def build(batches):
        builder, task, sequence = ShardBuilder(shared()), TaskContext.get().partitionId(), 0
        schema = None
        ids: list[pa.Array] = []
        words: list[list[bytes]] = []
        size = 0
        for batch in batches:
            column = batch.column("doc_id")
            if schema is None:
                whole = pa.list_(pa.int64())
                kinds = {"shard": pa.int64(), "term": pa.string(), "df": pa.int64(), "ids": pa.list_(column.type), "data": pa.binary()}
                schema = pa.schema([pa.field(c, kinds.get(c, whole)) for c in fields.names])
            start = 0
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                found = terms_of(text)
                if words and (size + len(found) > shard_words or len(words) >= shard_docs):
                    ids.append(column.slice(start, i - start))
                    yield from builder.rows((task << 24) + sequence, pa.concat_arrays(ids), words, schema)
                    ids, words, size, start, sequence = [], [], 0, i, sequence + 1
                words.append(found)
                size += len(found)
            ids.append(column.slice(start))
        if words:
            yield from builder.rows((task << 24) + sequence, pa.concat_arrays(ids), words, schema)

    return materialise(source.mapInArrow(build, fields))


# ---- the search ----


class PostingList:
    """One term's blocks in a shard; blocks are decompressed when a search needs them and kept while the shard is searched."""

    def __init__(self, row: dict, impact, factor: np.ndarray, expand):
        self.last, self.offset = np.asarray(row["last"], np.int64), np.append(np.asarray(row["offset"], np.int64), len(row["data"]))
        self.data, self.factor, self.expand, self.impact = row["data"], factor, expand, impact
        best = impact.of(np.asarray(row["best_tf"], np.int64), impact.factor(np.asarray(row["best_n"], np.int64)))
        self.block_max = np.maximum.reduceat(best, np.asarray(row["best_at"], np.int64))
        self.top = int(self.block_max.max())
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        got = self.held.get(i)
        if got is None:
            places, tf = unpack_block(self.data[self.offset[i] : self.offset[i + 1]], int(self.last[i - 1]) if i else -1, self.expand)
            got = self.held[i] = (places, self.impact.of(tf, self.factor[places]))
        return got

    def blocks(self, numbers) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.block(i) for i in numbers]
        return (np.concatenate([p for p, _ in parts]), np.concatenate([v for _, v in parts])) if len(parts) != 1 else parts[0]

    def window(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        got = self.windows.get(low)
        if got is None:
            a, b = np.searchsorted(self.last, (low, high - 1))
            if a == len(self.last):
                got = (np.zeros(0, np.int64), np.zeros(0, np.int64))
            else:
                places, values = self.blocks(range(a, min(b + 1, len(self.last))))
                i, j = np.searchsorted(places, (low, high))
                got = places[i:j], values[i:j]
            self.windows[low] = got
        return got


class Impact:
    """A posting's integer impact, before the term's weight, under the statistics of the whole corpus: N documents with terms, L terms."""

    def __init__(self, n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, max(1, n_terms)

    def factor(self, lengths: np.ndarray) -> np.ndarray:
        return 50 + (50 * lengths * self.n_docs) // self.n_terms

    @staticmethod
    def of(tf: np.ndarray, factor: np.ndarray) -> np.ndarray:
        return (1_000_000_000 * tf) // (1000 * tf + 20 * factor)


def best_of_shard(lists: list[tuple[PostingList, int]], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the k best documents of a shard with a score above 0; equal scores by place."""
    lists = sorted(((p, w) for p, w in lists if w > 0), key=lambda x: x[0].top * x[1])
    bounds = np.cumsum([p.top * w for p, w in lists])
    places, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
    for low in range(0, n_docs, WINDOW):
        high = min(low + WINDOW, n_docs)
        essential = int(np.searchsorted(bounds, least))  # lists before it cannot reach ``least`` even together
        if essential == len(lists):
            break
        total = np.zeros(high - low, np.int64)
        for p, w in lists[essential:]:
            at, value = p.window(low, high)
            total[at - low] += w * value
        found = np.flatnonzero(total)
        score = total[found]
        found = found + low
        for j in range(essential - 1, -1, -1):
            can = score + bounds[j] >= least
            found, score = found[can], score[can]
            if not len(found):
                break
            p, w = lists[j]
            rest = bounds[j - 1] if j else 0
            block = np.searchsorted(p.last, found)
            some = block < len(p.last)
            bound = np.where(some, w * p.block_max[np.minimum(block, len(p.last) - 1)], 0)
            can = score + bound + rest >= least
            found, score, block = found[can], score[can], block[can & some]
            if not len(block):
                continue
            at, value = p.windows.get(low) or p.blocks(np.unique(block).tolist())
            where = np.minimum(np.searchsorted(at, found), max(0, len(at) - 1))
            if len(at):
                score = score + np.where(at[where] == found, w * value[where], 0)
        can = score >= least
        places, scores = np.concatenate([places, found[can]]), np.concatenate([scores, score[can]])
        if len(places) > k:
            order = np.lexsort((places, -scores))[:k]
            places, scores = places[order], scores[order]
        if len(places) == k:
            least = max(1, int(scores.min()))
    order = np.lexsort((places, -scores))
    return places[order], scores[order]


def search(index: DataFrame, items: DataFrame, k: int = 50, item_col: str = "item_id", text_col: str = "text", query_block: int = QUERY_BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0, equal scores by ascending doc_id, null ids last.

    With N documents that have terms, L terms in all, n terms in the document, df documents with the term and tf its occurrences in the document:
    w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 50 + (50 n N) div L, and a score is the sum of w ((10^9 tf) div (1000 tf + 20 m)) over the
    item's different terms. Rows that share an item id, null included, are one item; null texts have no terms, and items that find
    nothing have no rows. ``index`` comes from ``build_index``; other columns of ``items`` are not read.
    """
    spark = index.sparkSession
    documents = index.where("term is null").select("shard", "ids", "lengths")
    has = F.size(F.filter("lengths", lambda x: x > 0))
    sizes = documents.agg(F.sum(has).alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("l")).first()
    n_docs, n_terms = int(sizes.n or 0), int(sizes.l or 0)
    item_type = items.schema[item_col].dataType
    pairs = items.select(F.col(f"`{item_col}`").alias("item_id"), F.explode(F.array_distinct(term_column(f"`{text_col}`"))).alias("term")).distinct()
    counts = index.where("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs).cast("double") + 2) / (2 * F.col("df") + 1))).alias("w")
    n_items = pairs.select("item_id").distinct().count()
    blocks = max(1, -(-n_items // query_block))
    number = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("part")
    wanted = pairs.join(counts, "term").select(number, "term", "item_id", weight)
    wanted = wanted.groupBy("part", "term").agg(F.collect_list(F.struct("item_id", "w")).alias("queries"))  # at most one entry per item of the block
    lists = index.where("term is not null").drop("ids", "lengths", "df").join(wanted, "term")
    empty = [F.lit(None).cast(index.schema[c].dataType).alias(c) for c in ("term", "last", "offset", "best_at", "best_tf", "best_n", "data")]
    heads = documents.select("shard", *empty, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("part"), F.lit(None).cast(wanted.schema["queries"].dataType).alias("queries"), "ids", "lengths")
    lists = lists.select("shard", *[c for c in heads.columns if c not in ("shard", "ids", "lengths")], *[F.lit(None).cast(documents.schema[c].dataType).alias(c) for c in ("ids", "lengths")])
    id_type = documents.schema["ids"].dataType.elementType
    fields = T.StructType([T.StructField("item_id", item_type), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())])
    impact = Impact(n_docs, n_terms)

    def run(table: pa.Table) -> pa.Table:
        ids = lengths = None
        expand = zstandard.ZstdDecompressor().decompress
        held, queries, keys = [], {}, {}
        for row_ids, row in zip(table.column("ids"), table.drop_columns(["ids"]).to_pylist()):
            if row["term"] is None:
                ids, lengths = row_ids.values, np.asarray(row["lengths"], np.int64)
            else:
                held.append(row)
        if held:
            factor = impact.factor(lengths)
            for row in held:
                postings = PostingList(row, impact, factor, expand)
                for q in row["queries"]:
                    key = repr(q["item_id"])
                    keys.setdefault(key, q["item_id"])
                    queries.setdefault(key, []).append((postings, q["w"]))
        out_items, out_places, out_scores = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for key, wants in queries.items():
            places, scores = best_of_shard(wants, len(lengths), k)
            out_items += [keys[key]] * len(places)
            out_places.append(places)
            out_scores.append(scores)
        item_kind = table.schema.field("queries").type.value_type.field("item_id").type
        id_kind = table.schema.field("ids").type.value_type
        at = pa.array(np.concatenate(out_places))
        taken = ids.take(at) if ids is not None and len(at) else pa.array([], id_kind)
        return pa.table([pa.array(out_items, item_kind), taken.cast(id_kind), pa.array(np.concatenate(out_scores))], names=["item_id", "doc_id", "score"])

    found = heads.unionByName(lists).groupBy("shard", "part").applyInArrow(run, fields)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", **options) -> DataFrame:
    """Index ``docs`` for the terms of ``items`` and search it."""
    terms = items.select(F.explode(term_column(f"`{item_text_col}`")).alias("term"))
    return search(build_index(docs, terms, id_col, text_col, **options), items, k, item_col, item_text_col)

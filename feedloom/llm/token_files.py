"""Token ids of a corpus as binary shard files: fixed-size id blocks, transposed into byte or bit planes, each plane compressed alone.

Layout of a shard (all numbers little-endian)::

    magic 8 bytes | version, plane kind, block ids, part, sequence : u32 | ids, documents, blocks : u64
    | planes, offset and length of the document table : u64 | chunk index : per block ids u32, planes u32, then offset u64, length u32 per plane
    | compressed planes | document table (Arrow stream of doc_id, n_tokens, compressed) | CRC-32 of all before : u32

Documents lie in ascending order of doc_id, within a shard and from shard to shard (part, then sequence). A shard is written under
a temporary name and renamed, so a repeated task attempt replaces it whole.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.llm.bpe import ChunkEncoder, once_per_process
from feedloom.llm.common import id_text, share
from feedloom.session import materialise, shared_folder

MAGIC = b"PLANEIDS"
HEAD = "<8sIIIIIQQQQQ"
#: Ids of a block and of a shard file, about.
BLOCK_IDS, SHARD_IDS = 1 << 16, 1 << 22
SUFFIX = ".planes"


# ---- blocks ----


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of unsigned 32-bit ids, lowest first, without the empty ones above the highest id."""
    raw = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    top = int(ids.max(initial=0)).bit_length()
    if not bits:
        return [np.ascontiguousarray(raw[:, i]).tobytes() for i in range(max(1, -(-top // 8)))]
    spread = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(spread[:, i]).tobytes() for i in range(max(1, top))]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    out = np.zeros(n, np.uint32)
    for i, plane in enumerate(planes):
        got = np.frombuffer(plane, np.uint8)
        out |= (np.unpackbits(got)[:n].astype(np.uint32) << np.uint32(i)) if bits else got.astype(np.uint32) << np.uint32(8 * i)
    return out


def pack_shard(part: int, sequence: int, ids: np.ndarray, table: pa.Table, block_ids: int, bits: bool) -> bytes:
    squeeze = zstandard.ZstdCompressor(level=3).compress
    blocks = [ids[a : a + block_ids] for a in range(0, len(ids), block_ids)]
    packed = [[squeeze(p) for p in to_planes(b, bits)] for b in blocks]
    index_size = sum(8 + 12 * len(p) for p in packed)
    at, index, body = struct.calcsize(HEAD) + index_size, [], []
    for block, planes in zip(blocks, packed):
        index.append(struct.pack("<II", len(block), len(planes)))
        for plane in planes:
            index.append(struct.pack("<QI", at, len(plane)))
            body.append(plane)
            at += len(plane)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    documents = sink.getvalue().to_pybytes()
    head = struct.pack(HEAD, MAGIC, 1, int(bits), block_ids, part, sequence, len(ids), table.num_rows, len(blocks), at, len(documents))
    whole = b"".join([head, *index, *body, documents])
    return whole + struct.pack("<I", zlib.crc32(whole))


class Shard:
    """One shard file's content; blocks are decoded one at a time, through the chunk index."""

    def __init__(self, content: bytes):
        magic, version, kind, self.block_ids, self.part, self.sequence, self.n_ids, self.n_docs, blocks, at, size = struct.unpack_from(HEAD, content)
        if magic != MAGIC or version != 1 or zlib.crc32(memoryview(content)[:-4]) != struct.unpack("<I", content[-4:])[0]:
            raise ValueError("not a whole shard of token planes")
        self.content, self.bits, self.index = content, bool(kind), []
        self.documents = pa.ipc.open_stream(content[at : at + size]).read_all()
        where = struct.calcsize(HEAD)
        for _ in range(blocks):
            n, planes = struct.unpack_from("<II", content, where)
            self.index.append((n, [struct.unpack_from("<QI", content, where + 8 + 12 * i) for i in range(planes)]))
            where += 8 + 12 * planes

    def block(self, i: int) -> np.ndarray:
        n, planes = self.index[i]
        expand = zstandard.ZstdDecompressor().decompress
        return from_planes([expand(self.content[a : a + size]) for a, size in planes], n, self.bits)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the shard, from the blocks that hold them."""
        first, last = start // self.block_ids, -(-stop // self.block_ids)
        parts = [self.block(i) for i in range(first, last)]
        whole = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        return whole[start - first * self.block_ids : stop - first * self.block_ids]

    def walk(self):
        """(row, offset, ids) of each document in order, holding one block and one document at a time."""
        block, base, at = np.zeros(0, np.uint32), 0, 0
        following = 0
        for row, n in enumerate(self.documents.column("n_tokens").to_pylist()):
            parts, need = [], n
            while need:
                if at == base + len(block):
                    base += len(block)
                    block = self.block(following)
                    following += 1
                take = block[at - base : at - base + need]
                parts.append(take)
                at += len(take)
                need -= len(take)
            yield row, at - n, np.concatenate(parts) if len(parts) != 1 else parts[0]


# ---- the tokenizer ----


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 as itself, the others from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


def library_encoder(tokenizer_json: str, pattern: str) -> ChunkEncoder:
    """The tokenizers library's model on each pre-token; repeated chunks come from a table. Added tokens are ordinary text here."""
    from tokenizers import Tokenizer

    model, letters = Tokenizer.from_str(tokenizer_json).model, _byte_letters()
    space = letters[32]

    def pretoken(piece: str) -> list[int]:
        if piece.isascii() and piece[1:].isalnum() and piece[0] == " ":  # printable bytes stand for themselves
            spelled = space + piece[1:]
        else:
            spelled = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(letters)
        return [t.id for t in model.tokenize(spelled)]

    return ChunkEncoder(pattern, pretoken)


class AddedTokens:
    """``encode(add_special_tokens=False)`` of the library's whole tokenizer: the file's added tokens first, ``plain`` on the text between them.

    As in the library the leftmost and then longest token is taken, those that are not normalized before the others; ``single_word`` tokens
    need no word character beside them, ``lstrip`` and ``rstrip`` tokens take the white space beside them along.
    """

    WORD, SPACE, SPACES = regex.compile(r"\w"), regex.compile(r"\s"), regex.compile(r"\s*")

    def __init__(self, tokenizer_json: str, plain: ChunkEncoder):
        self.plain, self.passes = plain, []
        added = [t for t in json.loads(tokenizer_json).get("added_tokens") or [] if t["content"]]
        for normalized in (False, True):
            tokens = {t["content"]: t for t in added if bool(t.get("normalized")) == normalized}
            if tokens:
                self.passes.append((regex.compile("|".join(map(regex.escape, sorted(tokens, key=len, reverse=True)))), tokens))

    def _cut(self, text: str, find, tokens: dict[str, dict]):
        """Text between tokens as str, tokens as their ids in bytes."""
        at = 0
        for match in find.finditer(text):
            token, (start, stop) = tokens[match.group()], match.span()
            if token.get("single_word") and (start and self.WORD.match(text[start - 1]) or self.WORD.match(text[stop : stop + 1])):
                continue
            while token.get("lstrip") and start > at and self.SPACE.match(text[start - 1]):
                start -= 1
            if token.get("rstrip"):
                stop = self.SPACES.match(text, stop).end()
            if at < start:
                yield text[at:start]
            yield struct.pack("<I", token["id"])
            at = stop
        if at < len(text):
            yield text[at:]

    def encode(self, text: str) -> bytes:
        found = [(find, tokens) for find, tokens in self.passes if any(t in text for t in tokens)]
        if not found:
            return self.plain.encode(text)
        pieces = [text]
        for find, tokens in found:
            pieces = [x for p in pieces for x in ([p] if isinstance(p, bytes) else self._cut(p, find, tokens))]
        return b"".join(p if isinstance(p, bytes) else self.plain.encode(p) for p in pieces)


def file_encoder(tokenizer_json: str, pattern: str) -> AddedTokens:
    return AddedTokens(tokenizer_json, library_encoder(tokenizer_json, pattern))


# ---- the jobs ----


def write_token_files(
    docs: DataFrame, tokenizer_file: str, pattern: str, folder: str, end_id: int = 0, bits: bool = False,
    block_ids: int = BLOCK_IDS, shard_ids: int = SHARD_IDS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Encode every whole text, append ``end_id`` to each, and write shard files in ascending order of doc_id.

    Returns (part, sequence, file, n_ids, n_docs) per file. Rows with the same doc_id follow each other in the order of a hash of their text,
    null ids come first. A null text counts as empty and has the end id alone; an empty table writes nothing. Added tokens of the
    tokenizer file are recognised in the text, as the library does by default. Other columns are not read. ``folder`` is a URI or path that executors share.
    """
    source = id_text(docs, id_col, text_col)
    with open(tokenizer_file, encoding="utf-8") as file:  # read by the driver
        raw = file.read()
    shared = share(docs.sparkSession, raw)
    name = "tokens_" + hashlib.sha256((raw + pattern).encode()).hexdigest()
    # Ties are cut by the hash as well: a doc_id that many rows share does not land in one task.
    dealt = source.withColumn("_h", F.xxhash64("text")).repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text")

    def write(batches):
        encoder = once_per_process(name, lambda: file_encoder(shared(), pattern))
        filesystem, root = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        part, end = TaskContext.get().partitionId(), struct.pack("<I", end_id)
        held: list[bytes] = []
        keys: list[pa.Array] = []
        counts: list[int] = []
        sequence = size = taken = 0

        def flush():
            ids = np.frombuffer(b"".join(held), "<u4")
            table = pa.table({"doc_id": pa.concat_arrays(keys), "n_tokens": pa.array(counts, pa.int64())})
            content = pack_shard(part, sequence, ids, table, block_ids, bits)
            final = f"{root}/part-{part:06d}-{sequence:06d}{SUFFIX}"
            draft = f"{root}/.{uuid.uuid4().hex}"
            with filesystem.open_output_stream(draft) as out:
                out.write(content)
            filesystem.move(draft, final)
            return pa.RecordBatch.from_pydict({"part": [part], "sequence": [sequence], "file": [final], "n_ids": [len(ids)], "n_docs": [len(counts)]}, schema)

        schema = pa.schema([("part", pa.int32()), ("sequence", pa.int32()), ("file", pa.string()), ("n_ids", pa.int64()), ("n_docs", pa.int64())])
        filesystem.create_dir(root, recursive=True)
        for batch in batches:
            taken = 0
            ids_of = batch.column("doc_id")
            for i, text in enumerate(batch.column("text").to_pylist()):
                got = encoder.encode(text) + end
                held.append(got)
                counts.append(len(got) // 4)
                size += len(got) // 4
                if size >= shard_ids:
                    keys.append(ids_of.slice(taken, i + 1 - taken))
                    yield flush()
                    held, keys, counts, size, taken, sequence = [], [], [], 0, i + 1, sequence + 1
            if taken < batch.num_rows:
                keys.append(ids_of.slice(taken))
        if counts:
            yield flush()

    return materialise(dealt.select("doc_id", "text").mapInArrow(write, "part int, sequence int, file string, n_ids bigint, n_docs bigint"))


def read_token_files(spark: SparkSession, folder: str, files: DataFrame, id_type: T.DataType, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the shard files of ``folder``.

    ``start`` counts the ids of all documents before it; ``files`` is what ``write_token_files`` returned. A damaged or missing file fails.
    """
    per_part = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = per_part.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("part").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.join(parts.select("part", "before"), "part").select("part", "sequence", (F.col("before") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("_before"))
    fields = [T.StructField("doc_id", id_type), T.StructField("part", T.IntegerType()), T.StructField("sequence", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.LongType()))] if keep_ids else []

    def read(batches):
        for batch in batches:
            for content in batch.column("content"):
                shard = Shard(content.as_py())
                offset, crc, ids = [], [], []
                for _, start, got in shard.walk():
                    offset.append(start)
                    crc.append(zlib.crc32(np.ascontiguousarray(got.astype("<u4")).view(np.uint8)))
                    if keep_ids:
                        ids.append(got.astype(np.int64))
                n = shard.n_docs
                columns = {"doc_id": shard.documents.column("doc_id").combine_chunks(), "part": pa.array(np.full(n, shard.part, np.int32)), "sequence": pa.array(np.full(n, shard.sequence, np.int32))}
                columns |= {"offset": pa.array(offset, pa.int64()), "n_tokens": shard.documents.column("n_tokens").combine_chunks(), "ids_crc32": pa.array(crc, pa.int64())}
                columns |= {"ids": pa.array(ids, pa.list_(pa.int64()))} if keep_ids else {}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    stored = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder).select("content")
    found = stored.mapInArrow(read, T.StructType(fields))
    missing = files.join(spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("_name")), F.element_at(F.split("file", "/"), -1) == F.col("_name"), "left_anti").select("file").limit(3).collect()
    if missing:
        raise FileNotFoundError(f"shard files are gone: {', '.join(r.file for r in missing)}")
    return found.join(offsets, ["part", "sequence"]).select("doc_id", (F.col("_before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * keep_ids)


def token_files(docs: DataFrame, tokenizer_file: str, pattern: str, folder: str | None = None, id_col: str = "doc_id", **options) -> DataFrame:
    """Write the files, by default to a new folder beside the checkpoints, and read them back."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    files = write_token_files(docs, tokenizer_file, pattern, folder, id_col=id_col, **options)
    kind = docs.schema[id_col].dataType
    if files.isEmpty():
        return spark.createDataFrame([], T.StructType([T.StructField("doc_id", kind), *[T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32")]]))
    return read_token_files(spark, folder, files, kind)

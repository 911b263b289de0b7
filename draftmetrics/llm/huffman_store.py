"""Token-ID output: canonical length-limited Huffman files with bit-offset checkpoints.

``encode_tokens`` turns whole texts into ids, ``write_store`` counts ids over all rows,
builds one length-limited canonical code (package-merge) and writes files in ascending
document order, and ``read_store`` decodes them.  A file is one binary value of the
store table, complete in itself (code lengths, document index, checkpoints, payload),
so any shared file system that Spark writes to can hold it.

File layout, little-endian::

    magic b"DMHF" | u32 version | u32 max_len | u64 n_tokens | u32 n_docs | u32 n_blocks
    | u32 bytes of each of four sections
    code lengths, one byte per id (zlib) | document index: doc_id i64, null flag u8,
    n_tokens u32 (zlib) | checkpoints: bit offset u64 of each block (zlib) | payload bits

Blocks of ``BLOCK`` ids are coded on their own: block b starts at its checkpoint, so
blocks are decoded side by side with one table look-up per id and block.

Nulls: a null text has no ids but its end id, as an empty one; a null doc_id sorts first
and comes back null.  Rows with equal doc_id keep one entry each, in the order in which they
were read.  A very long text is a file of its own.  An empty table gives no files.  Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from draftmetrics.llm.shared import drop_table, shared_path, text_slices, tidied

MAGIC, VERSION, BLOCK = b"DMHF", 1, 512
#: Ids in one file at most (a longer document is a file of its own).
FILE_TOKENS = 1 << 19
MAX_LEN = 20
#: Files whose places may be broadcast (32 bytes each).
BROADCAST_FILES = 100_000


# -- ids ----------------------------------------------------------------------------


def encode_tokens(docs: DataFrame, tokenizer_path: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned integers of 16 bits where they all fit, else of 32; ``end_id`` appended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from draftmetrics.llm.tokens import tokenizer

        tok = tokenizer(tokenizer_path)
        tail = np.array([] if end_id is None else [end_id], "<u4")
        for batch in batches:
            ids = batch.column(0)
            for a, b, texts in text_slices(batch.column(1), 1 << 20):
                coded = [np.concatenate([x, tail]).astype("<u4") for x in tok.encode(texts)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array([len(x) for x in coded], pa.int64()), pa.array([x.astype("<u2" if x.max(initial=0) < 1 << 16 else "<u4").tobytes() for x in coded], pa.binary())], names=["doc_id", "n_tokens", "ids"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(tidied(run), "doc_id long, n_tokens long, ids binary")


def stored_ids(raw: bytes | None, n_tokens: int) -> np.ndarray:
    """Ids as ``encode_tokens`` stores them."""
    return np.frombuffer(raw or b"", "<u4" if len(raw or b"") > 2 * n_tokens else "<u2")


def count_ids(tokens: DataFrame) -> DataFrame:
    """(id, n) over all rows; partial counts are made beside the data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            rows = [stored_ids(x, n) for x, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            flat = np.concatenate(rows) if rows else np.zeros(0, np.uint32)
            if len(flat):
                part = np.bincount(flat, minlength=len(total))
                part[: len(total)] += total
                total = part
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    return tokens.select("ids", "n_tokens").mapInArrow(tidied(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


# -- code ---------------------------------------------------------------------------


def code_lengths(counts: dict[int, int], max_len: int = MAX_LEN) -> np.ndarray:
    """Optimal code lengths of at most ``max_len`` bits by package-merge; 0 for absent ids."""
    ids = sorted(counts, key=lambda i: (counts[i], i))
    out = np.zeros(max(ids) + 1 if ids else 0, np.uint8)
    if len(ids) == 1:
        out[ids[0]] = 1
        return out
    if not ids:
        return out
    if len(ids) > 1 << max_len:
        raise ValueError(f"{len(ids)} ids cannot have codes of {max_len} bits")
    weight = np.array([counts[i] for i in ids], np.int64)
    n = len(ids)
    # rounds[k]: for each entry of the merged list, whether it is a single id
    rounds: list[np.ndarray] = []
    merged = weight
    rounds.append(np.ones(n, bool))
    for _ in range(max_len - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, pairs])
        order = np.argsort(both, kind="stable")
        merged = both[order]
        rounds.append(order < n)
    take = 2 * n - 2
    lengths = np.zeros(n, np.int64)
    for single in reversed(rounds):
        k = int(single[:take].sum())
        lengths[:k] += 1
        take = 2 * (take - k)
    out[np.array(ids)] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: ascending by (length, id)."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    codes = np.zeros(len(lengths), np.uint64)
    if len(order):
        lens = lengths[order].astype(np.int64)
        top = int(lens[-1])
        width = np.left_shift(np.int64(1), top - lens)
        codes[order] = ((np.cumsum(width) - width) >> (top - lens)).astype(np.uint64)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(id, length) by the next ``max_len`` bits."""
    top = int(lengths.max()) if len(lengths) else 0
    ids, lens = np.zeros(1 << top, np.uint32), np.zeros(1 << top, np.uint8)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    width = np.left_shift(np.int64(1), top - lengths[order].astype(np.int64))
    filled = int(width.sum())
    ids[:filled], lens[:filled] = np.repeat(order.astype(np.uint32), width), np.repeat(lengths[order], width)
    return ids, lens, top


def pack_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Payload (big-endian bit order) and the bit offset of each block."""
    n = lengths[ids].astype(np.int64)
    end = np.cumsum(n)
    start = end - n
    marks = start[::BLOCK].astype("<u8")
    total = int(end[-1]) if len(end) else 0
    words = np.zeros((total >> 5) + 2, np.uint64)
    at, room = start >> 5, 64 - (start & 31) - n  # a code touches its word and the next
    bits = codes[ids] << room.astype(np.uint64)
    if len(ids):
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        merged = np.bitwise_or.reduceat(bits, first)
        words[at[first]] |= merged >> np.uint64(32)
        words[at[first] + 1] |= merged & np.uint64(0xFFFFFFFF)
    return words.astype(">u4").tobytes()[: (total + 7) >> 3], marks


def unpack_bits(payload: bytes, marks: np.ndarray, n_tokens: int, lengths: np.ndarray) -> np.ndarray:
    """Ids of all blocks, decoded side by side."""
    table_id, table_len, top = decode_table(lengths)
    raw = np.frombuffer(payload + bytes(-len(payload) % 4 + 12), ">u4").astype(np.uint64)
    pos = marks.astype(np.int64)
    out = np.zeros((BLOCK, len(marks)), np.uint32)
    last = n_tokens - (len(marks) - 1) * BLOCK if len(marks) else 0
    limit, shift, mask = len(raw) - 2, np.uint64(64 - top), np.uint64((1 << top) - 1)
    for k in range(min(BLOCK, n_tokens)):
        if k == last and len(pos):  # the last block is shorter
            pos = pos[:-1]
        w = np.minimum(pos >> 5, limit)
        window = (raw[w] << np.uint64(32)) | raw[w + 1]
        key = ((window << (pos & 31).astype(np.uint64)) >> shift) & mask
        if top + 31 > 64:
            raise ValueError("codes are too long")
        out[k, : len(pos)] = table_id[key]
        pos = pos + table_len[key]
    return out.T.reshape(-1)[:n_tokens]


# -- files --------------------------------------------------------------------------


def make_file(doc_ids: list[int | None], arrays: list[np.ndarray], lengths: np.ndarray, codes: np.ndarray) -> bytes:
    ids = np.concatenate(arrays) if arrays else np.zeros(0, np.uint32)
    payload, marks = pack_bits(ids, lengths, codes)
    index = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], np.uint8).tobytes() + np.array([len(a) for a in arrays], "<u4").tobytes()
    parts = [zlib.compress(lengths.astype(np.uint8).tobytes(), 6), zlib.compress(index, 6), zlib.compress(marks.tobytes(), 6), payload]
    head = struct.pack("<4sIIQII4I", MAGIC, VERSION, int(lengths.max()) if len(lengths) else 0, len(ids), len(doc_ids), len(marks), *map(len, parts))
    return head + b"".join(parts)


def read_file(blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, ids of each document's end in the file, all ids)."""
    magic, version, _, n_tokens, n_docs, _, *sizes = struct.unpack_from("<4sIIQII4I", blob)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a file of this format")
    at, parts = struct.calcsize("<4sIIQII4I"), []
    for n in sizes:
        parts.append(blob[at : at + n])
        at += n
    lengths = np.frombuffer(zlib.decompress(parts[0]), np.uint8)
    index = zlib.decompress(parts[1])
    doc = np.frombuffer(index, "<i8", n_docs)
    null = np.frombuffer(index, np.uint8, n_docs, 8 * n_docs)
    n = np.frombuffer(index, "<u4", n_docs, 9 * n_docs)
    marks = np.frombuffer(zlib.decompress(parts[2]), "<u8")
    ids = unpack_bits(parts[3], marks, n_tokens, lengths) if n_tokens else np.zeros(0, np.uint32)
    return [None if z else int(d) for d, z in zip(doc, null)], np.cumsum(n.astype(np.int64)), ids


def write_store(tokens: DataFrame, path: str, max_len: int = MAX_LEN) -> str:
    """Write the files of a stable ``tokens`` table in ascending doc_id order to ``path``, where they stay; returns it."""
    spark = tokens.sparkSession
    # bounded by the vocabulary, whatever the corpus
    counts = {r["id"]: r["n"] for r in count_ids(tokens).toLocalIterator()}
    lengths = code_lengths(counts, max_len)
    shared = spark.sparkContext.broadcast(lengths)  # one byte for each id of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lens = shared.value
        codes = canonical_codes(lens)
        docs: list[int | None] = []
        arrays: list[np.ndarray] = []
        held, chunk, part = 0, 0, None

        def flush() -> pa.RecordBatch:
            row = [pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array([held], pa.int64()), pa.array([make_file(docs, arrays, lens, codes)], pa.large_binary()).cast(pa.binary())]
            return pa.RecordBatch.from_arrays(row, names=["part", "chunk", "n_tokens", "blob"])

        for batch in batches:
            for p, d, n, x in zip(*(c.to_pylist() for c in batch.columns)):
                ids = stored_ids(x, n)
                if docs and held + len(ids) > FILE_TOKENS:
                    yield flush()
                    docs, arrays, held, chunk = [], [], 0, chunk + 1
                part = p
                docs.append(d)
                arrays.append(ids)
                held += len(ids)
        if docs:
            yield flush()

    n_parts = max(1, -(-sum(counts.values()) // (8 * FILE_TOKENS)))
    dealt = tokens.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n_parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    files = dealt.select(F.spark_partition_id().alias("part"), "doc_id", "n_tokens", "ids").mapInArrow(tidied(run), "part int, chunk int, n_tokens long, blob binary")
    files.write.option("compression", "uncompressed").parquet(path)
    return path


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document of a store, decoded from its files."""
    schema = "part int, chunk int, n_tokens long, blob binary"
    files = spark.read.schema(schema).parquet(path)
    sums = files.groupBy("part", "chunk").agg(F.sum("n_tokens").alias("n"))
    inside = Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range partition
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    starts = sums.select("part", "chunk", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("chunk_start")).join(offsets, "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, chunk, blob in zip(*(c.to_pylist() for c in batch.columns)):
                docs, ends, ids = read_file(blob)
                raw, n = memoryview(ids.astype("<u4").tobytes()), len(docs)
                begin = np.concatenate([[0], ends[:-1]]) if n else ends
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([chunk] * n, pa.int32()), pa.array(docs, pa.int64()), pa.array(begin, pa.int64()), pa.array(ends - begin, pa.int64()), pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), ends.tolist())], pa.int64())],
                    names=["part", "chunk", "doc_id", "in_file", "n_tokens", "ids_crc32"],
                )

    decoded = files.select("part", "chunk", "blob").mapInArrow(tidied(run), "part int, chunk int, doc_id long, in_file long, n_tokens long, ids_crc32 long")
    side = F.broadcast(starts) if files.select("part").count() <= BROADCAST_FILES else starts  # a row for each file
    return decoded.join(side, ["part", "chunk"]).select("doc_id", (F.col("part_start") + F.col("chunk_start") + F.col("in_file")).alias("start"), "n_tokens", "ids_crc32", "part", "chunk")


def store_roundtrip(docs: DataFrame, tokenizer_path: str, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Encode ``docs``, write the Huffman store, read it back; without a ``path`` the store goes when Python ends."""
    spark = docs.sparkSession
    schema = T.StructType.fromDDL("doc_id long, n_tokens long, ids binary")
    ids_path = shared_path(spark, "token-ids")
    encode_tokens(docs, tokenizer_path, end_id).write.option("compression", "zstd").parquet(ids_path)
    store = write_store(spark.read.schema(schema).parquet(ids_path), path or shared_path(spark, "huffman-store"))
    drop_table(spark, ids_path)
    return read_store(spark, store)

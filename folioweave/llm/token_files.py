"""Token ids as files: canonical length-limited Huffman codes in independent blocks.

A file set is a folder with two Parquet tables: `codebook` (one row: the code length of every id, the id width) and
`blocks` (part, block, first token inside the part, payload). A payload decodes alone:

    magic FWH1, u32 tokens, u32 documents, u32 checkpoint interval, u64 bits          little-endian
    document ids i64[documents], null flags u8[documents], document lengths u32[documents]
    checkpoints u32[ceil(tokens / interval)]: the bit at which every interval-th token starts
    bit stream as big-endian 32-bit words, and one spare word
    u32 checksum of all before it

Parts are ranges of ascending document ids and blocks follow each other inside a part; a document lies in one block.
Parquet carries the payloads so that Spark's commit protocol and any store that Spark writes to apply.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioweave.llm.common import drop_written, free_shuffles, fresh_path, goes_at_exit, table, written
from folioweave.llm.encoder import Encoder

MAX_BITS = 18
INTERVAL = 256
BLOCK_TOKENS = 262_144
#: Texts are tokenised together up to this many bytes.
TOGETHER = 1_500_000
HEAD = struct.Struct("<4sIIIQ")


# ---------------------------------------------------------------- code lengths


def limited_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n == 0:
        return out
    if n == 1:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} ids don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    coins = counts[order].astype(np.int64)
    # Level by level: packages are pairs of the level below; only how many of the first items are packages matters.
    is_leaf: list[np.ndarray] = []
    packages = np.empty(0, np.int64)
    for _ in range(limit):
        both = np.concatenate([coins, packages])
        rank = np.argsort(both, kind="stable")
        merged = both[rank]
        is_leaf.append(rank < n)
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    take = 2 * n - 2
    lengths = np.zeros(n, np.int64)
    for leaf in reversed(is_leaf):
        chosen = leaf[:take]
        leaves = int(chosen.sum())
        lengths[:leaves] += 1
        take = 2 * (len(chosen) - leaves)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), each length's first code following the last of the length before."""
    codes = np.zeros(len(lengths), np.uint64)
    ids = np.flatnonzero(lengths)
    ids = ids[np.lexsort((ids, lengths[ids]))]
    code, last = 0, 0
    for length, k in zip(*np.unique(lengths[ids], return_counts=True), strict=True):
        code <<= int(length) - last
        last = int(length)
        own = ids[lengths[ids] == length]
        codes[own] = np.arange(code, code + k, dtype=np.uint64)
        code += int(k)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each possible next `bits` bits: the id and its length."""
    bits = max(1, int(lengths.max(initial=0)))
    ids = np.flatnonzero(lengths)
    ids = ids[np.lexsort((ids, lengths[ids]))]
    spans = 1 << (bits - lengths[ids].astype(np.int64))
    symbol, length = np.zeros(1 << bits, np.uint32), np.ones(1 << bits, np.uint8)
    symbol[: spans.sum()] = np.repeat(ids, spans)
    length[: spans.sum()] = np.repeat(lengths[ids], spans)
    return symbol, length, bits


# ---------------------------------------------------------------- blocks


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The bit stream's words, the checkpoints and the number of bits."""
    if not len(ids):
        return np.zeros(1, np.uint32), np.zeros(0, np.uint32), 0
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    word = at >> 5
    placed = codes[ids] << (64 - (at & 31) - size).astype(np.uint64)
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])  # codes are shorter than a word: none is empty
    out = np.zeros(int(word[-1]) + 3, np.uint32)
    out[word[first]] = np.add.reduceat(placed >> np.uint64(32), first).astype(np.uint32)
    last = np.r_[first[1:], len(ids)] - 1  # only a word's last code reaches the next one
    out[word[last] + 1] += (placed[last] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out, at[::INTERVAL].astype(np.uint32), int(ends[-1])


def unpack(words: np.ndarray, checkpoints: np.ndarray, tokens: int, decoder: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """All stretches between checkpoints are decoded side by side, a token of each per step."""
    symbol, length, bits = decoder
    lanes = len(checkpoints)
    out = np.zeros((INTERVAL, lanes), np.uint32)
    wide = (words[:-1].astype(np.uint64) << np.uint64(32)) | words[1:]
    at = checkpoints.astype(np.int64)
    top = len(wide) - 1
    mask, shift = (1 << bits) - 1, 64 - bits
    for step in range(min(INTERVAL, tokens)):
        now = (wide[np.minimum(at >> 5, top)] >> (shift - (at & 31)).astype(np.uint64)).astype(np.int64) & mask
        out[step] = symbol[now]
        at += length[now]
    return out.T.ravel()[:tokens]


def to_payload(doc_ids: list[int | None], doc_lengths: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    words, checkpoints, bits = pack(ids, lengths, codes)
    body = b"".join((
        HEAD.pack(b"FWH1", len(ids), len(doc_ids), INTERVAL, bits),
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        np.asarray(doc_lengths, "<u4").tobytes(),
        checkpoints.astype("<u4").tobytes(),
        words.astype(">u4").tobytes(),
    ))
    return body + struct.pack("<I", zlib.crc32(body))


def from_payload(payload: bytes, decoder: tuple[np.ndarray, np.ndarray, int]) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, document lengths and all ids of a block."""
    if zlib.crc32(payload[:-4]) != struct.unpack("<I", payload[-4:])[0]:
        raise ValueError("a block's checksum doesn't match")
    magic, tokens, docs, interval, _ = HEAD.unpack_from(payload)
    if magic != b"FWH1" or interval != INTERVAL:
        raise ValueError("not a block of this format")
    at = HEAD.size
    doc_ids = np.frombuffer(payload, "<i8", docs, at)
    nulls = np.frombuffer(payload, np.uint8, docs, at + 8 * docs)
    doc_lengths = np.frombuffer(payload, "<u4", docs, at + 9 * docs)
    at += 13 * docs
    marks = -(-tokens // interval)
    checkpoints = np.frombuffer(payload, "<u4", marks, at)
    words = np.frombuffer(payload[at + 4 * marks : -4], ">u4").astype(np.uint32)
    return [None if z else int(d) for d, z in zip(doc_ids, nulls, strict=True)], doc_lengths, unpack(words, checkpoints, tokens, decoder)


# ---------------------------------------------------------------- tokenising


def by_size(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose texts have about `most` bytes together; a longer text is alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


RAW = "part int, block int, first long, doc_ids array<long>, doc_lengths array<int>, ids binary"


def raw_blocks(docs: DataFrame, tokenizer: str, end_id: int, order: list[str]) -> DataFrame:
    """Documents in range order, tokenised, as blocks of ids that are not compressed yet."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = encoder(tokenizer_path(tokenizer))
        block, first, doc_ids, lengths, parts, held = 0, 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            rows = [[part], [block], [first], [doc_ids], [lengths], [b"".join(parts)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], ["part", "block", "first", "doc_ids", "doc_lengths", "ids"])

        for batch in batches:
            for some in by_size(batch, 1, TOGETHER):
                own, sizes, ids = some.column(0).to_pylist(), *enc(some.column(1), end_id)
                ends = np.cumsum(sizes)
                at = done = 0
                while at < len(own):  # a block ends with the document that fills it
                    to = min(len(own), int(np.searchsorted(ends, done + BLOCK_TOKENS - held)) + 1)
                    doc_ids += own[at:to]
                    lengths += sizes[at:to].tolist()
                    parts.append(ids[done : ends[to - 1]].tobytes())
                    held += int(ends[to - 1]) - done
                    at, done = to, int(ends[to - 1])
                    if held >= BLOCK_TOKENS:
                        yield flush()
                        block, first, doc_ids, lengths, parts, held = block + 1, first + held, [], [], [], 0
        if doc_ids:
            yield flush()

    return docs.mapInArrow(encode, RAW)


def write_token_files(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", order: list[str] | None = None) -> None:
    """Encode every whole text and write the file set at `path`.

    Documents follow each other in ascending id order, nulls first, repeated ids by text; or by the columns in `order`.
    A null or empty text is the end id alone. Extra columns are not read; an empty table writes no blocks.
    """
    spark = docs.sparkSession
    keys = [F.col(c) for c in (order or [id_col, text_col])]
    names = [f"__k{i}" for i in range(len(keys))]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[k.alias(n) for k, n in zip(keys, names, strict=True)] if order else [])
    by = names if order else ["doc_id", "text"]
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *(by if order else by[:1])).sortWithinPartitions(*by).select("doc_id", "text")
    raw_path = f"{path}/raw"
    raw = written(raw_blocks(ranged, tokenizer, end_id, by), "raw", raw_path)
    free_shuffles(spark)
    # An id is below the size of the vocabulary, so this is a bounded number of rows.
    wide = encoder(tokenizer_path(tokenizer)).dtype is np.uint32

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0):
                c = np.bincount(np.frombuffer(x.as_buffer(), np.uint32 if wide else np.uint16))
                if len(c) > len(total):
                    c, total = total, c
                total[: len(c)] += c
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "n"])

    found = raw.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["id"] for r in found), default=0) + 1, np.int64)
    for r in found:
        counts[r["id"]] = r["n"]
    # Longer codes only where MAX_BITS can't tell all ids apart.
    lengths = limited_lengths(counts, max(MAX_BITS, (int(np.count_nonzero(counts)) - 1).bit_length()))
    spark.createDataFrame([(bytearray(lengths.tobytes()), tokenizer, end_id)], "lengths binary, tokenizer string, end_id int").coalesce(1).write.parquet(f"{path}/codebook")

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical_codes(lengths)
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                ids = np.frombuffer(one.column(5)[0].as_buffer(), np.uint32 if wide else np.uint16)
                payload = to_payload(one.column(3)[0].as_py(), one.column(4)[0].values.to_numpy(), ids, lengths, codes)
                yield pa.RecordBatch.from_arrays([one.column(0), one.column(1), one.column(2), pa.array([len(ids)], pa.int64()), pa.array([payload], pa.binary())], ["part", "block", "first", "n_tokens", "payload"])

    raw.mapInArrow(compress, "part int, block int, first long, n_tokens long, payload binary").write.option("compression", "none").parquet(f"{path}/blocks")
    drop_written(spark, raw_path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: where it starts among all ids, how many ids it has, their checksum, and the ids themselves if asked for."""
    book = spark.read.parquet(f"{path}/codebook").first()
    lengths = np.frombuffer(bytes(book["lengths"]), np.uint8)
    blocks = spark.read.parquet(f"{path}/blocks")
    # One row per part: bounded by the number of write tasks.
    sizes = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    starts = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = decode_table(lengths)
        for batch in batches:
            for part, first, payload in zip(*(batch.column(i) for i in range(3)), strict=True):
                doc_ids, sizes, ids = from_payload(payload.as_buffer().to_pybytes(), decoder)
                ends = np.cumsum(sizes, dtype=np.int64)
                begins = ends - sizes
                raw = ids.astype("<u4").tobytes()
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins, ends, strict=True)]
                cols = [pa.array([part.as_py()] * len(crcs), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(begins + first.as_py(), pa.int64()), pa.array(sizes.astype(np.int64)), pa.array(crcs, pa.int64())]
                if with_ids:
                    cols.append(pa.array([ids[a:b].tolist() for a, b in zip(begins, ends, strict=True)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, ["part", "doc_id", "at", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    schema = "part int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    docs = blocks.select("part", "first", "payload").mapInArrow(decode, schema)
    out = docs.join(F.broadcast(starts), "part").withColumn("start", F.col("part_start") + F.col("at"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op7(spark, sf_dir):  # noqa: ANN001, ANN201
    path = fresh_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path)
    goes_at_exit(spark, path)
    return read_token_files(spark, path)

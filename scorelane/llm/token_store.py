"""Token ids in binary shards of directly addressable codes.

A shard holds whole documents in ascending id order. Each token id is split, low bits first, into
chunks of the level widths; a level stores the chunks of the ids that reach it, a continuation bit
for each (set if the id goes on to the next level) and a rank directory over the bits (set bits
before each block of 512). Position i of a level with its bit set continues at position
rank(i) of the next, so any token is read in a few steps without decoding a block.

File layout, little-endian: magic, u32 version, u32 number of levels, u64 documents, u64 tokens,
u32 width of each level; then i64 document ids, u8 flags (1: the id is null), u64 ends of the
documents in tokens; then per level u64 count, chunks, bitmap bytes (padded to 64 bytes), u64 rank
directory. Sections start at multiples of 8.

Defined cases: null and empty texts are documents of the end id alone; null ids come first;
repeated rows are documents of their own (ordered by text key); a document is never split, so a
very long one may exceed the shard size alone. An empty table gives no shards and no rows.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelane.llm.common import small_batches
from scorelane.llm.pieces import Pieces, gather
from scorelane.operators.workspace import Workspace

MAGIC, VERSION = b"DACTOKEN", 1
WIDTHS = (8, 8, 16)
RANK_BLOCK = 512
#: Tokens after which a writer closes its shard.
SHARD_TOKENS = 1 << 22


def _pad(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 8)


def pack(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> bytes:
    """One shard of the given documents; ``ids`` holds all their tokens in order."""
    out = [MAGIC + struct.pack("<IIQQ", VERSION, len(widths), len(doc_ids), len(ids)), _pad(np.array(widths, "<u4").tobytes())]
    out.append(np.array([d or 0 for d in doc_ids], "<i8").tobytes())
    out.append(_pad(np.array([d is None for d in doc_ids], np.uint8).tobytes()))
    out.append(np.cumsum(sizes, dtype="<u8").astype("<u8").tobytes())
    rest = ids.astype(np.uint32)
    for k, width in enumerate(widths):
        kind = f"<u{width // 8}"
        more = rest >> np.uint32(width) if width < 32 else np.zeros_like(rest)
        if k == len(widths) - 1 and more.any():
            raise ValueError(f"an id needs more than {sum(widths)} bits")
        bits = np.packbits(more > 0, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (RANK_BLOCK // 8), np.uint8)])
        ones = np.bitwise_count(bits.view("<u8")).reshape(-1, RANK_BLOCK // 64).sum(axis=1, dtype=np.uint64)
        rank = np.concatenate([[0], np.cumsum(ones)]).astype("<u8")
        out += [struct.pack("<Q", len(rest)), _pad((rest & np.uint32((1 << width) - 1)).astype(kind).tobytes()), bits.tobytes(), rank.tobytes()]
        rest = more[more > 0]
    return b"".join(out)


class Shard:
    """Random access to the tokens of a packed shard."""

    def __init__(self, raw: bytes | memoryview):
        if bytes(raw[:8]) != MAGIC:
            raise ValueError("not a token shard")
        version, levels, n_docs, self.n_tokens = struct.unpack_from("<IIQQ", raw, 8)
        if version != VERSION:
            raise ValueError(f"version {version} isn't known")
        at = 32

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            part = np.frombuffer(raw, kind, n, at)
            at += -(-part.nbytes // 8) * 8
            return part

        self.widths = take("<u4", levels)
        ids = take("<i8", n_docs)
        null = take("u1", n_docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null, strict=True)]
        self.ends = take("<u8", n_docs).astype(np.int64)
        self.levels = []
        for width in self.widths.tolist():
            n = int(take("<u8", 1)[0])
            chunks = take(f"<u{width // 8}", n)
            blocks = -(-n // RANK_BLOCK)
            bits = take("u1", blocks * RANK_BLOCK // 8)
            self.levels.append((chunks, bits, take("<u8", blocks + 1)))

    def __len__(self) -> int:
        return self.n_tokens

    def __getitem__(self, i: int) -> int:
        """Token i, by one rank query a level."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = shift = 0
        for width, (chunks, bits, rank) in zip(self.widths.tolist(), self.levels, strict=True):
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BLOCK
            words = bits[block * RANK_BLOCK // 8 : (i >> 3) + 1].copy()
            words[-1] &= (1 << (i & 7)) - 1
            i = int(rank[block]) + int(np.bitwise_count(words).sum())
            shift += width
        return value

    def slice(self, start: int, end: int) -> np.ndarray:
        """Tokens start to end; later levels are read only where bits go on."""
        values = np.zeros(max(0, end - start), np.uint32)
        where, first, shift = np.arange(len(values)), start, 0
        for width, (chunks, bits, rank) in zip(self.widths.tolist(), self.levels, strict=True):
            if not len(where):
                break
            last = first + len(where)
            values[where] |= chunks[first:last].astype(np.uint32) << np.uint32(shift)
            flags = np.unpackbits(bits[first >> 3 : (last + 7) >> 3], bitorder="little")[first & 7 :][: len(where)]
            block = first // RANK_BLOCK
            head = np.unpackbits(bits[block * RANK_BLOCK // 8 : (first + 7) >> 3], bitorder="little")[: first - block * RANK_BLOCK]
            first = int(rank[block]) + int(head.sum())
            where = where[flags.astype(bool)]
            shift += width
        return values

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path or URI, for the driver and the executors alike."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


class Encoder:
    """The tokenizers library, asked once for each match of the vocabulary's own splitting pattern.

    Texts that hold one of the vocabulary's added tokens are encoded whole by the library, which
    looks for these before it splits.
    """

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # matches hold no added token; spares the search for them
        self.pieces = Pieces(pattern, self.encode_matches, b"".join)

    def encode_matches(self, matches: list[str]) -> list[bytes]:
        return self._packed(self.tokenizer, matches)

    @staticmethod
    def _packed(tokenizer: object, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e)}I", *e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by the end id, and the number of ids of each text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = np.zeros(len(texts), bool)
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        packed, codes, ends = self.pieces.encoded(pc.if_else(pa.array(whole), "", texts) if whole.any() else texts)
        if whole.any():
            codes = np.insert(codes, ends[whole], len(packed) + np.arange(whole.sum()))
            packed = [*packed, *self._packed(self.whole, texts.filter(pa.array(whole)).to_pylist())]
            ends = ends + np.cumsum(whole)
        codes = np.insert(codes, ends, len(packed))
        packed = [*packed, struct.pack("<I", end_id)]
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        ids = np.frombuffer(b"".join(packed), "<u4")[gather(sizes, codes)]
        stops = np.cumsum(sizes[codes])[ends + np.arange(len(ends))]
        return ids, np.diff(stops, prepend=0)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def write_shards(docs: DataFrame, folder: str, tokenizer: str, pattern: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Index rows (part, seq, path, n_docs, n_tokens) of the shards; running it writes the files.

    Documents are dealt out by ranges of (id, text key), one sort and one shuffle; a task writes
    its range shard by shard under a temporary name and renames it, so that a repeated task writes
    the same files again.
    """
    small_batches(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(parts, "doc_id", "key").sortWithinPartitions("doc_id", "key").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        store, base = filesystem(folder)
        store.create_dir(base, recursive=True)
        enc, seq, held = encoder(tokenizer, pattern), 0, 0
        ids: list[int | None] = []
        tokens: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            name = f"{part:06d}-{seq:06d}.dac"
            with store.open_output_stream(f"{base}/{name}.{attempt}.tmp") as f:
                f.write(pack(ids, np.concatenate(sizes), np.concatenate(tokens)))
            store.move(f"{base}/{name}.{attempt}.tmp", f"{base}/{name}")
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "path": [name], "n_docs": [len(ids)], "n_tokens": [held]})

        for batch in batches:
            found, n = enc.encode(batch.column(1), end_id)
            ids += batch.column(0).to_pylist()
            tokens.append(found)
            sizes.append(n)
            held += len(found)
            if held >= SHARD_TOKENS:
                yield close()
                ids, tokens, sizes, seq, held = [], [], [], seq + 1, 0
        if ids:
            yield close()

    return rows.mapInArrow(write, "part long, seq long, path string, n_docs long, n_tokens long")


def read_shards(index: DataFrame, folder: str) -> DataFrame:
    """Per document of the shards: doc_id, start (tokens before it in the store), n_tokens, ids_crc32.

    Starts come from the index: a running sum within each part, and one total a part on the driver
    (as many numbers as the writer had partitions).
    """
    spark = index.sparkSession
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    base, sums = 0, []
    for row in totals:
        sums.append((row["part"], base))
        base += row["n"]
    own = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    shards = index.withColumn("before", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)))
    shards = shards.join(spark.createDataFrame(sums, "part long, base long"), "part").select("path", (F.col("base") + F.col("before")).alias("start"))
    shards = shards.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_stream(f"{base}/{name}") as f:
                    shard = Shard(f.read())
                begins = np.concatenate([[0], shard.ends[:-1]])
                ids = shard.slice(0, len(shard)).astype("<u4")
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins.tolist(), shard.ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(begins + start), pa.array(shard.ends - begins), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store(docs: DataFrame, tokenizer: str, pattern: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Write ``docs`` as shards into ``folder`` (a fresh shared one by default) and read them back."""
    work = Workspace(docs.sparkSession, "tokens")
    folder = folder or work.folder("shards")
    index = work.save(write_shards(docs, folder, tokenizer, pattern, end_id, id_col, text_col), "index")
    return read_shards(index, folder)

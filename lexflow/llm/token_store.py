"""Token ids in binary shards, with constant-time access by document key.

Texts are dealt by ranges of doc_id once, as they are read, and each task encodes its range in key order and
writes one shard to the shared folder: raw little-endian ids, the records' offsets, and an index from key to
record. The index is a minimal perfect hash (levels of bit arrays, Limasset et al., 2017) over the shard's
keys; beside each slot stands a 32-bit fingerprint of its key, so a key that the shard doesn't hold is told
apart. Readers take offsets from the index and read only the ids asked for.

Layout: ids | offsets (n_records + 1, u8) | slot fingerprints (u4) | slot first records (u4) | slot counts (u4)
| bit words (u8) | rank of each word (u4) | JSON of the sizes | its length (u4) | magic.
A shard's name holds the task attempt, and the catalog names the shards that count, so tasks may run again.
"""

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexflow.llm.arrow_text import mix, task
from lexflow.llm.common import shared_path, stored
from lexflow.llm.encoders import encoder

MAGIC, GAMMA, LEVELS = b"LXT1", 2, 40
#: Stands for a missing doc_id in the index.
NO_KEY = -(2**63)


def _level(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (2**64 - 1))) % np.uint64(size)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Slots 0 to n - 1 for n distinct 64-bit keys; other keys get any slot or -1."""

    def __init__(self, sizes: list[int], words: np.ndarray, ranks: np.ndarray):
        self.sizes, self.words, self.ranks = sizes, words, ranks

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        sizes, words, left, level = [], [], keys, 0
        while len(left):
            size = -(-max(64, GAMMA * len(left)) // 64) * 64
            at = _level(left, level, size)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone.reshape(-1, 64), axis=1, bitorder="little").view("<u8").reshape(-1))
            sizes.append(size)
            left, level = left[~alone[at]], level + 1
            if level > LEVELS:
                raise ValueError("keys aren't distinct")
        flat = np.concatenate(words) if words else np.zeros(0, "<u8")
        counts = np.bitwise_count(flat).astype(np.int64)
        return cls(sizes, flat, (np.cumsum(counts) - counts).astype("<u4"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = _level(keys[left], level, size)
            word, bit = base + (at >> 6), (at & 63).astype(np.uint64)
            bits = self.words[word]
            hit = (bits >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(bits[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[left[hit]] = self.ranks[word[hit]].astype(np.int64) + below
            left, base = left[~hit], base + size // 64
        return out


class ShardWriter:
    """Writes records in order, then the index; keys of repeated records follow one another."""

    def __init__(self, stream, dtype: str):
        self.stream, self.dtype, self.keys, self.lengths = stream, dtype, [], []

    def add(self, key: int, ids: np.ndarray, end: int):
        self.stream.write(np.append(ids, end).astype(self.dtype).tobytes())
        self.keys.append(key)
        self.lengths.append(len(ids) + 1)

    def close(self):
        keys, first, counts = np.unique(np.array(self.keys, np.int64).view(np.uint64), return_index=True, return_counts=True)
        table = PerfectHash.build(keys)
        order = np.argsort(table.slots(keys))
        offsets = np.concatenate([[0], np.cumsum(self.lengths, dtype=np.int64)]).astype("<u8")
        for part in (offsets, fingerprints(keys)[order].astype("<u4"), first[order].astype("<u4"), counts[order].astype("<u4"), table.words.astype("<u8"), table.ranks.astype("<u4")):
            self.stream.write(part.tobytes())
        head = json.dumps({"dtype": self.dtype, "records": len(self.keys), "keys": len(keys), "ids": int(offsets[-1]), "levels": table.sizes}).encode()
        self.stream.write(head + len(head).to_bytes(4, "little") + MAGIC)
        self.stream.close()


class ShardReader:
    """Keyed access to a shard: the index is read once, ids only as asked for."""

    def __init__(self, uri: str):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        self.file = store.open_input_file(path)
        end = self.file.size()
        tail = self.file.read_at(8, end - 8)
        if tail[4:] != MAGIC:
            raise ValueError(f"{uri} isn't a token shard")
        n = int.from_bytes(tail[:4], "little")
        self.head = head = json.loads(self.file.read_at(n, end - 8 - n))
        self.width = np.dtype(head["dtype"]).itemsize
        at, parts, bits = head["ids"] * self.width, [], sum(head["levels"]) // 64
        body = self.file.read_at(end - 8 - n - at, at)
        at = 0
        for kind, many in (("<u8", head["records"] + 1), ("<u4", head["keys"]), ("<u4", head["keys"]), ("<u4", head["keys"]), ("<u8", bits), ("<u4", bits)):
            parts.append(np.frombuffer(body, kind, many, at))
            at += many * np.dtype(kind).itemsize
        self.offsets, self.prints, self.first, self.counts, words, ranks = parts
        self.table = PerfectHash(head["levels"], words, ranks)

    def records(self, keys: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The record of the nth document with each key, -1 where there is none."""
        keys = keys.astype(np.int64).view(np.uint64)
        slot = self.table.slots(keys)
        safe = np.maximum(slot, 0)
        if not self.head["keys"]:
            return np.full(len(keys), -1)
        held = (slot >= 0) & (self.prints[safe] == fingerprints(keys)) & (nth < self.counts[safe])
        return np.where(held, self.first[safe].astype(np.int64) + nth, -1)

    def ids(self, record: int) -> np.ndarray:
        a, b = int(self.offsets[record]), int(self.offsets[record + 1])
        return np.frombuffer(self.file.read_at((b - a) * self.width, a * self.width), self.head["dtype"]).astype("<u4")

    def get(self, key: int, nth: int = 0) -> np.ndarray | None:
        record = int(self.records(np.array([key]), np.array([nth]))[0])
        return None if record < 0 else self.ids(record)


def _write_task(folder: str, tokenizer: str, end: int, dtype: str):
    @task
    def run(batches):
        from pyarrow import fs

        context = TaskContext.get()
        shard = context.partitionId()
        uri = f"{folder}/shard-{shard:06d}-{context.taskAttemptId()}.ids"
        store, path = fs.FileSystem.from_uri(uri)
        writer, before, nth = None, None, 0
        with encoder(tokenizer) as encode:
            for batch in batches:
                keys, rows = [NO_KEY if k is None else k for k in batch.column(0).to_pylist()], []
                for key, ids in zip(keys, encode(batch.column(1)), strict=True):
                    if writer is None:
                        writer = ShardWriter(store.open_output_stream(path), dtype)
                    writer.add(key, ids, end)
                    nth = nth + 1 if key == before else 0
                    before = key
                    rows.append((key, nth, len(ids) + 1))
                if rows:
                    key, n, size = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array([shard] * len(key), pa.int32()), pa.array([uri] * len(key))], ["key", "nth", "n_tokens", "shard", "uri"])
        if writer is not None:
            writer.close()

    return run


def write_shards(docs: DataFrame, tokenizer: str, *, end: int = 2, shards: int | None = None) -> DataFrame:
    """The catalog of the written shards: key, nth, n_tokens, shard, uri of each document.

    Documents lie in ascending doc_id order over shards and within them; ids take two bytes where the
    vocabulary allows. shards defaults to the session's number of shuffle partitions.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    dtype = "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end + 1) <= 65536 else "<u4"
    from pyarrow import fs

    folder = shared_path(spark, "token-shards")
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    catalog = ranged.mapInArrow(_write_task(folder, tokenizer, end, dtype), "key long, nth long, n_tokens long, shard int, uri string")
    return stored(catalog, "token-catalog")


def _read_task(bases: dict[str, int]):
    @task
    def run(batches):
        reader, at = None, None
        for batch in batches:
            uris, keys = batch.column(2).to_pylist(), np.array(batch.column(0).to_pylist(), np.int64)
            nth = np.array(batch.column(1).to_pylist(), np.int64)
            i = 0
            while i < len(uris):
                j = i
                while j < len(uris) and uris[j] == uris[i]:
                    j += 1
                if at != uris[i]:
                    reader, at = ShardReader(uris[i]), uris[i]
                records = reader.records(keys[i:j], nth[i:j])
                if (records < 0).any():
                    raise ValueError(f"{at} lacks a key of its catalog")
                ids = [reader.ids(r) for r in records.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None if k == NO_KEY else k for k in keys[i:j].tolist()], pa.int64()), pa.array(reader.offsets[records].astype(np.int64) + bases[at]), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )
                i = j

    return run


def read_shards(catalog: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, by keyed reads of the shards."""
    totals = catalog.groupBy("shard", "uri").agg(F.sum("n_tokens").alias("ids")).orderBy("shard").collect()  # one row a shard
    bases, total = {}, 0
    for row in totals:
        bases[row["uri"]] = total
        total += row["ids"]
    return catalog.select("key", "nth", "uri").mapInArrow(_read_task(bases), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store(docs: DataFrame, tokenizer: str, *, end: int = 2, shards: int | None = None) -> DataFrame:
    """Writes the ids of all documents and reads them back: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before, in ascending doc_id order. Defined cases: a null or empty
    text gives the closing id alone; rows without doc_id come first, under a reserved key; rows that repeat
    a doc_id follow one another in any order, each with its own record; no rows write no shard and give no
    rows; other columns of docs play no part.
    """
    return read_shards(write_shards(docs, tokenizer, end=end, shards=shards))

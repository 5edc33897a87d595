"""Hierarchical packing of documents into training sequences of several lengths.

Each task packs the documents it reads, block by block, so packing needs no shuffle and memory holds one
block of ids. A document longer than the longest window gives full windows; its rest is routed to the
shortest tier it fits. From the longest tier down, a document opens a window of its tier; the gap is filled
with the longest whole documents of shorter tiers that fit, and what no whole document fits takes the front
of the next longer one, whose rest is routed again. So windows of each tier are full. What is left at a
task's end becomes windows of falling powers of two. Sequences of a block are dealt to step groups of about
the same number of tokens, longest first.
"""

import bisect
import heapq
import itertools
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexflow.llm.arrow_text import task
from lexflow.llm.encoders import encoder

TIERS = (4096, 2048, 1024, 512)
END = 2
#: Tokens of a block, and of a step group, as they are aimed at.
BLOCK, STEP = 1 << 20, 1 << 16

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Pool:
    """Pieces (document, start, length) that wait, ordered by length."""

    def __init__(self):
        self.lengths, self.pieces, self.total = [], [], 0

    def put(self, doc, start: int, length: int):
        at = bisect.bisect_left(self.lengths, length)
        self.lengths.insert(at, length)
        self.pieces.insert(at, (doc, start))
        self.total += length

    def pop(self, at: int):
        length, (doc, start) = self.lengths.pop(at), self.pieces.pop(at)
        self.total -= length
        return doc, start, length

    def fill(self, gap: int) -> list[tuple]:
        """Pieces for a gap: whole ones, longest first, then the front of a longer one."""
        got = []
        while gap and self.lengths:
            at = bisect.bisect_right(self.lengths, gap) - 1
            if at >= 0:
                piece = self.pop(at)
            else:
                doc, start, length = self.pop(0)
                piece = (doc, start, gap)
                self.put(doc, start + gap, length - gap)
            got.append(piece)
            gap -= piece[2]
        return got


def windows(pool: Pool, tiers: tuple, last: bool):
    """(tier, pieces) of full windows; if last, also of what no window of a tier is full with."""
    while pool.lengths:
        longest = pool.lengths[-1]
        tier = next((t for t in reversed(tiers) if t >= longest), tiers[0])
        if pool.total < tier:
            if not last:
                return
            tier = 1 << (pool.total.bit_length() - 1)
        elif not last and pool.total < 2 * tiers[0]:
            return
        if longest <= tier:
            first = pool.pop(len(pool.lengths) - 1)
            yield tier, [first, *pool.fill(tier - first[2])]
        else:
            yield tier, pool.fill(tier)


def pack(documents, *, tiers: tuple = TIERS, block: int = BLOCK, step: int = STEP, base: int = 0):
    """Rows of SCHEMA for documents (doc_id, ids as bytes of 32-bit integers); base is the first sequence_id."""
    pool, made, sequence, group = Pool(), [], base, base
    longest = tiers[0]

    def rows(done):
        nonlocal sequence, group
        groups = max(1, round(sum(sum(p[2] for p in ps) for _, ps in done) / step))
        load = [(0, k) for k in range(groups)]
        for tier, pieces in sorted(done, key=lambda x: -x[0]):
            tokens, k = heapq.heappop(load)
            heapq.heappush(load, (tokens + tier, k))
            offset = 0
            for (doc, ids), start, length in pieces:
                yield doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, sequence, offset, tier, group + k
                offset += length
            sequence += 1
        group += groups

    for doc_id, ids in documents:
        doc, n = (doc_id, ids), len(ids) // 4
        full = n // longest * longest
        made += [(longest, [(doc, start, longest)]) for start in range(0, full, longest)]
        if n > full:
            pool.put(doc, full, n - full)
        if pool.total + longest * len(made) >= block:
            made += windows(pool, tiers, False)
            yield from rows(made)
            made = []
    made += windows(pool, tiers, True)
    if made:
        yield from rows(made)


def _pack_task(path: str, tiers: tuple, end: int, frequent: int | None):
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    types = [pa.int32() if f.endswith(" int") else pa.int64() for f in SCHEMA.split(", ")]

    @task
    def run(batches):
        stop = end.to_bytes(4, "little")

        def documents(encode):
            for batch in batches:
                for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                    yield doc_id, ids.tobytes() + stop

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        with encoder(path, frequent) as encode:
            rows = pack(documents(encode), tiers=tiers, base=TaskContext.get().partitionId() << 32)
            while out := list(itertools.islice(rows, 20_000)):
                yield table(out)

    return run


def packed(docs: DataFrame, tokenizer: str, *, tiers: tuple = TIERS, end: int = END, frequent: int | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group; frequent is as in encoder.

    Each id of each document, its closing id end included, lies in exactly one piece; pieces of a sequence
    follow one another from offset 0; a sequence has at most tiers[0] ids, and a power of two of them.
    Defined cases: a null or empty text is a document of the closing id alone; rows without doc_id or with
    a repeated one are documents like others; a document of any length is cut into full windows and a rest;
    no rows give no rows; other columns of docs play no part.
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(tiers, reverse=True):
        raise ValueError("tiers are powers of two, longest first")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pack_task(tokenizer, tiers, end, frequent), SCHEMA)

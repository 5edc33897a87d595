"""Best-fit packing of whole documents into sequences: gaps filled exactly by complements, then best fit.

Which lengths go together depends on how many pieces of each length there are, and on nothing else. So:

1. One pass encodes all texts and stores a row per piece: its length, and the how-manieth of that length it is in its task.
2. Counts per length, at most one number for each length up to the window's, make the plan. From the longest
   length down, an opener's gap is looked up among the lengths, and in the indexes of sums of two and three lengths
   that are there; a combination that fills the gap exactly is used as often as the counts allow. What has no exact complement goes
   by best fit, longest first. The plan has rows by length and pattern: its size doesn't follow the number of pieces.
3. Counts of a length in the tasks before make a piece's number in its task its number in the corpus; the plan says which
   sequence and offset that number has. Pieces aren't shuffled as long as these counts are few enough for a broadcast.
"""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexflow.llm.arrow_text import task
from lexflow.llm.common import bounded, stored
from lexflow.llm.encoders import encoder

SIZE, END = 4096, 1
#: Combinations used up before the indexes of sums are made anew.
STALE = 256
#: Rows of counts (tasks times lengths, some 200 bytes each) that are broadcast at most; beyond, they are joined by a shuffle.
COUNTS = 200_000
#: Pieces of one length that the plan can number.
MOST = 1 << 40

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class Complements:
    """Lengths by how many pieces are left of each, and the indexes of sums of one, two and three of them.

    most is how many lengths a combination has at most.
    """

    def __init__(self, counts: np.ndarray, most: int = 3):
        self.left, self.most = counts.astype(np.int64).copy(), most
        self.size = len(counts) - 1
        self.refresh()

    def refresh(self):
        """The indexes hold all sums of lengths that are left; later they hold some more, never less."""
        has = (self.left > 0).astype(np.float64)
        two = np.fft.irfft(np.fft.rfft(has, 2 * self.size + 2) ** 2)[: self.size + 1] > 0.5
        three = np.fft.irfft(np.fft.rfft(has, 2 * self.size + 2) * np.fft.rfft(two.astype(np.float64), 2 * self.size + 2))[: self.size + 1] > 0.5
        self.pairs, self.triples, self.used = two & (self.most > 1), three & (self.most > 2), 0

    def pair(self, has: np.ndarray, left: np.ndarray, gap: int, longest: int) -> tuple | None:
        """Two lengths up to longest that fill a gap, the longer one as long as can be."""
        low = max(1, gap - longest)
        if low > gap // 2:
            return None
        fits = has[low : gap // 2 + 1] & has[gap - low : gap - gap // 2 - 1 : -1]
        if gap % 2 == 0 and left[gap // 2] < 2:
            fits[-1] = False
        k = int(fits.argmax())
        return (gap - low - k, low + k) if fits[k] else None

    def exact(self, gap: int, taken: Counter) -> tuple | None:
        """One, two or three lengths that fill a gap, beside what is taken."""
        left = self.left.copy()
        for length, k in taken.items():
            left[length] -= k
        has = left > 0
        if has[gap]:
            return (gap,)
        if self.pairs[gap] and (found := self.pair(has, left, gap, gap)):
            return found
        if self.triples[gap]:
            for c in np.flatnonzero(has[: gap - 1])[::-1].tolist():
                if 3 * c < gap:
                    break
                left[c] -= 1
                has[c] = left[c] > 0
                found = self.pair(has, left, gap - c, c) if self.pairs[gap - c] else None
                left[c] += 1
                has[c] = True
                if found:
                    return c, *found
        return None

    def filled(self, opener: int) -> Counter | None:
        """How many pieces of which lengths make a full sequence with an opener; None if none are found."""
        taken, gap = Counter({opener: 1}), self.size - opener
        while gap:
            if found := self.exact(gap, taken):
                taken.update(found)
                return taken
            longest = np.flatnonzero(self.left[: gap + 1])
            longest = next((x for x in longest[::-1].tolist() if self.left[x] > taken[x]), None)
            if longest is None or self.most * longest >= gap:
                return None
            some = min(int(self.left[longest]) - taken[longest], max(1, (gap - self.most * longest) // longest))
            taken[longest] += some
            gap -= some * longest
        return taken

    def use(self, taken: Counter) -> int:
        """Uses a combination as often as the counts allow."""
        times = min(int(self.left[length]) // k for length, k in taken.items())
        for length, k in taken.items():
            self.left[length] -= times * k
            self.used += self.left[length] == 0
        if self.used >= STALE:
            self.refresh()
        return times


def best_fit(counts: np.ndarray, size: int) -> list[tuple[Counter, int]]:
    """Patterns and how often each is used: from the longest length down, into the fullest sequence with room, else a new one."""
    classes: list[list[tuple[Counter, int]]] = [[] for _ in range(size + 1)]  # by gap
    room = np.zeros(size + 1, bool)

    def put(gap: int, pattern: Counter, times: int):
        if times:
            classes[gap].append((pattern, times))
            room[gap] = True

    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            gap = length + int(room[length:].argmax())
            if room[gap]:
                pattern, times = classes[gap].pop()
                room[gap] = bool(classes[gap])
            else:
                gap, pattern, times = size, Counter(), left
            each = gap // length
            whole = min(times, left // each)
            put(gap - each * length, pattern + Counter({length: each}), whole)
            left -= whole * each
            times -= whole
            if left and times and left < each:
                put(gap - left * length, pattern + Counter({length: left}), 1)
                left, times = 0, times - 1
            if gap < size or pattern:
                put(gap, pattern, times)
    return [x for c in classes for x in c]


def patterns(counts: np.ndarray, size: int = SIZE) -> list[tuple[Counter, int]]:
    """Which lengths go into a sequence together, and into how many; every piece of counts (by length) is in one.

    Short pieces that fill one gap exactly are missing in others later, so it is tried with combinations of up to
    three, two and one lengths, each time for all pieces, and the fewest sequences win.
    """
    tried = []
    for most in (3, 2, 1):
        index, rest, out = Complements(counts, most), np.zeros(size + 1, np.int64), []
        for opener in range(size, 0, -1):
            while index.left[opener]:
                taken = index.filled(opener)
                if taken is None:
                    rest[opener], index.left[opener] = index.left[opener], 0
                else:
                    out.append((taken, index.use(taken)))
        tried.append(out + best_fit(rest, size))
    return min(tried, key=lambda out: sum(times for _, times in out))


def plan(counts: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Columns length, from, times, sequence, offset: pieces of a length from a number on go to as many sequences one by one, again and again at the next offset.

    Sorted by length and number.
    """
    used, first, rows = np.zeros(size + 1, np.int64), 0, []
    for pattern, times in patterns(counts, size):
        offset = 0
        for length, k in sorted(pattern.items(), reverse=True):
            rows.append((length, used[length], times, first, offset))
            used[length] += times * k
            offset += length * k
        first += times
    rows = np.array(rows, np.int64).reshape(-1, 5)
    return rows[np.lexsort((rows[:, 1], rows[:, 0]))]


def _pieces(path: str, size: int, end: int, ids_too: bool):
    @task
    def run(batches):
        stop, seen, me = np.uint32(end), np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        names = ["task", "doc_id", "piece", "start", "length", "ids_crc32", "nth"]
        types = [pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 4]
        with encoder(path) as encode:
            for batch in batches:
                rows, raw = [], []
                for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                    ids = np.append(ids, stop).astype("<u4")
                    for k, start in enumerate(range(0, len(ids), size)):
                        part = ids[start : start + size]
                        data = part.tobytes()
                        rows.append((me, doc_id, k, start, len(part), zlib.crc32(data), int(seen[len(part)])))
                        seen[len(part)] += 1
                        if ids_too:
                            raw.append(data)
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array(raw, pa.binary())] * ids_too, names + ["ids"] * ids_too)

    return run


def _placed(rows: np.ndarray):
    keys = rows[:, 0] * MOST + rows[:, 1]

    @task
    def run(batches):
        for batch in batches:
            length, nth = (batch.column(k).to_numpy().astype(np.int64) for k in ("length", "nth"))
            at = np.searchsorted(keys, length * MOST + nth, "right") - 1
            turn, place = np.divmod(nth - rows[at, 1], rows[at, 2])
            names = [n for n in batch.schema.names if n != "nth"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(rows[at, 3] + place), pa.array(rows[at, 4] + turn * length)], [*names, "sequence_id", "offset"])

    return run


def best_fitted(docs: DataFrame, tokenizer: str, *, size: int = SIZE, end: int = END, ids_too: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; with ids_too also ids, as little-endian 32-bit numbers.

    A document's ids, its closing id end included, are one piece, or pieces of size ids and a last one that may be
    shorter if they are more. Pieces of a sequence follow one another from offset 0 and are size ids at most together.
    Defined cases: a null or empty text is a document of the closing id alone; rows without doc_id or with a repeated
    one are documents like others; texts of any length are encoded whole; no rows give no rows; other columns of docs play no part.
    """
    schema = "task int, doc_id long, piece int, start long, length long, ids_crc32 long, nth long" + ", ids binary" * ids_too
    pieces = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(tokenizer, size, end, ids_too), schema), "best-fit-pieces")
    counts = stored(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "best-fit-counts", 4)
    lengths = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row a length, at most size of them
        lengths[r.length] = r.n
    if lengths.max() >= MOST:
        raise ValueError("too many pieces of one length")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("task", "length", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = pieces.join(bounded(offsets, COUNTS), ["task", "length"]).withColumn("nth", F.col("nth") + F.col("before"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids_too]
    out = numbered.select(*columns, "nth").mapInArrow(_placed(plan(lengths, size)), "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids binary, " * ids_too + "sequence_id long, offset long")
    return out.select(*[f.split()[0] for f in SCHEMA.split(", ")], *["ids"] * ids_too)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id and ids of each sequence, from pieces with ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))

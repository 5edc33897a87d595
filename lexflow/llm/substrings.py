"""Repeated passages across documents, found by recompression.

Rounds name runs and pairs of symbols, from words up. A round parts the alphabet in two by a hash of each
symbol's name; a left symbol and a right symbol that follow one another become a pair, equal symbols left
over in a row become a run, and names are hashes of what they stand for. So a round names the same run or pair
alike in all documents of the corpus, and equal passages get equal symbols inside.

Each symbol carries its support: the words that decide that it stands there. A symbol whose support lies in
a window stands wherever that window's words stand. The anchor of a window is, of the symbols of the highest level
whose supports the window holds and start in its first half, the one with the least hash of its name (the
leftmost of equal ones); a word is its own support, so each window has an anchor, and equal windows have the
same one at the same place. An anchor goes by its name and the words of half a window from its support on.
Spark counts anchors over the corpus. Only windows whose anchor stands more than once can be repeats: those are
compared by 128 bits from two families of hashes of their words, whose key each run draws for itself, and a window is a repeat if a smaller document
has it, or its own earlier. So nothing is missed and nothing is sampled, as long as rounds name equal symbols alike.

Shuffled are anchors (about one for nine words), windows with a shared anchor, and texts of documents that
have such windows. Documents whose word sequence is a whole copy are set aside first, by a group minimum. Keys
with many rows (copies, common passages) are joined by broadcast, which their number bounds.
"""

import hashlib
import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexflow.llm.arrow_text import Words, mix, randoms, slices, task
from lexflow.llm.common import bounded, joined, located, stored

WINDOW, LEVELS = 20, 2
#: Rows, by file and row (16 bytes each), that are broadcast at most to pick texts.
BROADCAST_ROWS = 250_000
#: Stands for a missing doc_id: after all others.
LAST = 2**63 - 1

_K = randoms(77, 8) | np.uint64(1)


def recompress(name, lo, hi, own, level: int, low_edge, high_edge):
    """One round over symbols (name, support lo to hi, text own): the next level's symbols."""
    n = len(name)
    right = (mix(name ^ _K[level % 8] ^ np.uint64(level)) & np.uint64(1)).astype(bool)
    pair = np.zeros(n, bool)  # at its left symbol
    if n > 1:
        pair[:-1] = ~right[:-1] & right[1:] & (own[:-1] == own[1:])
    second = np.zeros(n, bool)
    second[1:] = pair[:-1]
    alone = ~pair & ~second
    join = np.zeros(n, bool)  # goes on with the run before it
    if n > 1:
        join[1:] = alone[1:] & alone[:-1] & (name[1:] == name[:-1]) & (own[1:] == own[:-1])
    head = np.flatnonzero(~second & ~join)
    tail = np.concatenate([head[1:], [n]]) - 1 if n else head
    is_pair, count = pair[head], (tail - head + 1).astype(np.uint64)
    with np.errstate(over="ignore"):
        new = name[head].copy()
        p = head[is_pair]
        new[is_pair] = mix(name[p] * _K[0] + mix(name[p + 1] ^ _K[1]) * _K[2])
        run = ~is_pair & (count > 1)
        new[run] = mix(name[head[run]] * _K[3] + count[run] * _K[4])
    # what isn't a pair also rests on two symbols on either side
    new_lo, new_hi = lo[head], hi[tail]
    rest = np.flatnonzero(~is_pair)
    a, b = head[rest] - 2, tail[rest] + 2
    mine = own[head[rest]]
    in_a, in_b = (a >= 0) & (own[np.maximum(a, 0)] == mine), (b < n) & (own[np.minimum(b, n - 1)] == mine)
    new_lo[rest] = np.where(in_a, lo[np.maximum(a, 0)], low_edge[mine] - 1)
    new_hi[rest] = np.where(in_b, hi[np.minimum(b, n - 1)], high_edge[mine] + 1)
    return new, new_lo, new_hi, own[head]


def window_starts(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and text of each window."""
    have = np.maximum(words.counts - (width - 1), 0)
    own = np.repeat(np.arange(len(have)), have)
    return np.arange(int(have.sum())) - np.repeat(np.cumsum(have) - have - words.first[:-1], have), own


def least_of(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The place of the least value, the leftmost of equal ones, in each range left to right - 1."""
    out, size = np.empty(len(left), np.int64), right - left
    table, span = np.arange(len(values)), 1
    while len(left) and span <= size.max():
        mine = (size >= span) & (size < 2 * span)
        a, b = table[left[mine]], table[right[mine] - span]
        out[mine] = np.where(values[b] < values[a], b, a)
        a, b = table[:-span] if span < len(table) else table[:0], table[span:]
        table, span = np.where(values[b] < values[a], b, a), 2 * span
    return out


def anchors(words: Words, width: int = WINDOW, levels: int = LEVELS, key: bytes = b"") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each stretch of windows with the same anchor: its name, text, first window and last window (by first word)."""
    starts, owner = window_starts(words, width)
    if not len(starts):
        return np.zeros(0, np.uint64), owner, starts, starts
    name, own = words.hashes(seed=21, key=key), words.owners()
    lo = np.arange(len(name))
    hi = lo + 1
    half = width // 2
    chosen, place, shift = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    for level in range(levels + 1):
        if level:
            name, lo, hi, own = recompress(name, lo, hi, own, level, words.first[:-1], words.first[1:])
        left = np.searchsorted(lo, starts)
        right = np.minimum(np.searchsorted(hi, starts + width, "right"), np.searchsorted(lo, starts + width - half, "right"))
        ok = left < right
        draw = mix(name ^ _K[6] ^ np.uint64(level))
        at = least_of(draw, left[ok], right[ok])
        chosen[ok], place[ok], shift[ok] = draw[at], lo[at], level
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (shift[1:] != shift[:-1]) | (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    end = np.concatenate([begin[1:], [len(starts)]]) - 1
    chosen = mix(chosen[begin] ^ runs(words.hashes(seed=31, key=key), half)[place[begin]])
    return chosen, owner[begin], starts[begin], starts[end]


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of the width hashes from each place on, put together by halves; the last width - 1 places have none."""
    n, out, at, size = max(len(hashes) - width + 1, 0), None, 0, 1
    both = lambda a, b: mix(a * _K[5] + mix(b ^ _K[7]))
    with np.errstate(over="ignore"):
        while True:
            if width & size:
                part = hashes[at : at + n]
                out, at = part if out is None else both(out, part), at + size
            size *= 2
            if size > width:
                return out
            hashes = both(hashes[: -size // 2], hashes[size // 2 :])


def window_hashes(words: Words, starts: np.ndarray, width: int, key: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Two hashes, from families of their own, of the words of each window."""
    return tuple(runs(words.hashes(seed=seed, key=key), width)[starts].view(np.int64) for seed in (31, 32))


def _first_of_equal(own: np.ndarray, one: np.ndarray, two: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of windows in which equal ones of a text follow one another by place, and which of them are the first."""
    order = np.lexsort((at, two, one, own))
    new = np.ones(len(at), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]) | (own[order][1:] != own[order][:-1])
    return order, new


@task
def _text_keys(batches):
    """Count and 128-bit digest of each text's words."""
    for batch in batches:
        for row, words in slices(batch.column(2)):
            n, raw, b = len(words.counts), words.data.tobytes(), words.bounds.tolist()
            sums = b"".join([hashlib.blake2b(b" ".join(raw[s:e].split()), digest_size=16).digest() for s, e in zip(b[:-1], b[1:], strict=True)])
            keys = np.frombuffer(sums, "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), batch.column(1).slice(row, n), batch.column(3).slice(row, n), pa.array(words.counts), pa.array(keys[:, 0]), pa.array(keys[:, 1])], ["file", "row", "id", "n", "key_a", "key_b"])


def _anchor_task(width: int, levels: int, key: bytes):
    @task
    def run(batches):
        for batch in batches:
            for row, words in slices(batch.column(2)):
                name, own, a, b = anchors(words, width, levels, key)
                at = pa.array(own + row)
                base = words.first[own]
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array((a - base).astype(np.int32)), pa.array((b - a + 1).astype(np.int32))], ["name", "file", "row", "a", "n"])

    return run


def _window_task(width: int, key: bytes):
    @task
    def run(batches):
        for batch in batches:
            for row, words in slices(batch.column(2)):
                n = len(words.counts)
                spans = batch.column(4).slice(row, n)
                flat, each = spans.flatten(), spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                base = np.repeat(words.first[:-1], each)
                a = flat.field("a").to_numpy(zero_copy_only=False).astype(np.int64) + base
                k = flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
                at = np.repeat(a - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
                own = np.repeat(np.repeat(np.arange(n), each), k)
                one, two = window_hashes(words, at, width, key)
                order, new = _first_of_equal(own, one, two, at)
                keep = np.sort(order[new])
                rows = pa.array(own[keep] + row)
                yield pa.RecordBatch.from_arrays([pa.array(one[keep]), pa.array(two[keep]), batch.column(3).take(rows), batch.column(0).take(rows), batch.column(1).take(rows), pa.array((at[keep] - words.first[own[keep]]).astype(np.int32))], ["one", "two", "id", "file", "row", "at"])

    return run


def _repeated_inside(words: Words, width: int, key: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Windows that stand earlier in their own text."""
    starts, own = window_starts(words, width)
    order, new = _first_of_equal(own, *window_hashes(words, starts, width, key), starts)
    again = np.sort(order[~new])
    return starts[again], own[again]


def _cut_task(width: int, with_text: bool, key: bytes):
    @task
    def run(batches):
        for batch in batches:
            ids, texts, whole, marks = batch.column(0), batch.column(1), batch.column(2), batch.column(3)
            for row, words in slices(texts):
                n = len(words.counts)
                spans = marks.slice(row, n)
                each = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                at = spans.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(words.first[:-1], each)
                inside, _ = _repeated_inside(words, width, key)
                edge = np.zeros(len(words.starts) + 1, np.int64)
                for p in (at, inside):
                    np.add.at(edge, p, 1)
                    np.add.at(edge, p + width, -1)
                gone = np.cumsum(edge[:-1]) > 0
                copy = whole.slice(row, n).to_pylist()
                raw, sums, kept_texts, removed = words.data.tobytes(), [], [], []
                for i in range(n):
                    f, e = words.first[i], words.first[i + 1]
                    out = gone[f:e]
                    if copy[i] and e - f >= width:
                        out = np.ones(e - f, bool)
                    if out.any():
                        keep = np.flatnonzero(~out) + f
                        kept = b" ".join([raw[s:t] for s, t in zip(words.starts[keep].tolist(), words.ends[keep].tolist(), strict=True)])
                    else:
                        kept = b" ".join(raw[words.bounds[i] : words.bounds[i + 1]].split())
                    removed.append(int(out.sum()))
                    sums.append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        kept_texts.append(kept)
                columns = [ids.slice(row, n), pa.array(words.counts), pa.array(removed, pa.int64()), pa.array(sums)]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    columns.append(pa.array(kept_texts, pa.binary()).cast(pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def repeated_windows(rows: DataFrame, width: int = WINDOW, levels: int = LEVELS, key: bytes = b"") -> tuple[DataFrame, DataFrame]:
    """For rows (file, row, text, id): whole copies (file, row), and first places of windows that a row with a smaller id has (file, row, at)."""
    keys = stored(rows.select("file", "row", "text", "id").mapInArrow(_text_keys, "file long, row long, id long, n long, key_a long, key_b long"), "passages-keys")
    least = keys.where(F.col("n") >= width).groupBy("key_a", "key_b", "n").agg(F.min("id").alias("least"), F.count("*").alias("many")).where("many > 1")
    copies = stored(joined(keys, stored(least, "passages-texts", 4), ["key_a", "key_b", "n"]).where("id > least").select("file", "row"), "passages-copies")
    own = rows.join(bounded(copies, BROADCAST_ROWS), ["file", "row"], "left_anti").select("file", "row", "text", "id")
    found = stored(own.mapInArrow(_anchor_task(width, levels, key), "name long, file long, row long, a int, n int"), "passages-anchors")
    shared = stored(found.groupBy("name").agg(F.count("*").alias("many")).where("many > 1"), "passages-names")
    spans = joined(found, shared, ["name"], "left_semi").groupBy("file", "row").agg(F.collect_list(F.struct("a", "n")).alias("spans"))
    spans = stored(spans, "passages-spans")
    some = own.join(bounded(spans.select("file", "row"), BROADCAST_ROWS), ["file", "row"], "left_semi")
    windows = some.join(spans, ["file", "row"]).select("file", "row", "text", "id", "spans").mapInArrow(_window_task(width, key), "one long, two long, id long, file long, row long, at int")
    windows = stored(windows, "passages-windows")
    first = windows.groupBy("one", "two").agg(F.min("id").alias("least"), F.count("*").alias("many")).where("many > 1")
    marks = joined(windows, stored(first, "passages-first", 4), ["one", "two"]).where("id > least").select("file", "row", "at")
    return copies, stored(marks.groupBy("file", "row").agg(F.collect_list("at").alias("marks")), "passages-marks")


def without_repeats(docs: DataFrame, *, width: int = WINDOW, levels: int = LEVELS, with_text: bool = False, key: bytes | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, and kept_text if with_text.

    A word goes if a window of width words over it also starts earlier: in a row with a smaller doc_id, or
    earlier in the same row. Windows are judged on the input. Defined cases: a null or empty text has no
    words, and the digest is that of the empty text; texts shorter than a window lose nothing; a row without
    doc_id comes after all others; rows that share a doc_id, or have none, don't count as earlier than one
    another; no rows give no rows; other columns play no part. key keys the hashes of words (None: one drawn for this run).
    """
    key = secrets.token_bytes(16) if key is None else key
    rows, _, file, row = located(docs.select("doc_id", "text"))
    rows = rows.select(F.col(file).alias("file"), F.col(row).alias("row"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.col("doc_id").cast("long").alias("doc_id"))
    copies, marks = repeated_windows(rows, width, levels, key)
    notes = stored(copies.select("file", "row", F.lit(True).alias("copy"), F.lit(None).cast("array<int>").alias("marks")).unionByName(marks.select("file", "row", F.lit(False).alias("copy"), "marks")), "passages-notes")
    touched = bounded(notes.select("file", "row"), BROADCAST_ROWS)
    plain = rows.join(touched, ["file", "row"], "left_anti").select("doc_id", "text", F.lit(False).alias("copy"), F.lit(None).cast("array<int>").alias("marks"))
    noted = rows.join(touched, ["file", "row"], "left_semi").join(notes, ["file", "row"]).select("doc_id", "text", "copy", "marks")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    cut = _cut_task(width, with_text, key)
    return plain.mapInArrow(cut, schema).unionByName(noted.mapInArrow(cut, schema))

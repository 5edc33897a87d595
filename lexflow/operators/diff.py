"""Word differences between a provision and its next version.

A longest common subsequence is no built-in expression, so this is an Arrow-batched function of two texts.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexflow.operators.versions import next_versions

PARTS = "array<struct<op:string,word:string>>"
TYPE = pa.list_(pa.struct([("op", pa.string()), ("word", pa.string())]))


#: Words of a text up to which the places of each word are kept as bits; in longer ones only those of frequent words are.
SHORT = 4096


def _bits(places: list[int]) -> int:
    """A number with the bits at places (ascending) set."""
    if len(places) <= 8:
        return sum(1 << k for k in places)
    row = np.zeros(places[-1] + 1, bool)
    row[places] = True
    return int.from_bytes(np.packbits(row, bitorder="little").tobytes(), "little")


def _rows(x: list[str], places: dict[str, int | list[int]], row: int, n: int):
    """Rows of the table of common lengths after row, one for each word of x, as n bits: 0 where a row rises, by one each time.

    places has where each word stands in the other text. A row's rises move to the first places of a word after each rise, which is
    one addition and its carries (Hyyrö 2004), so a row takes a few operations on whole numbers.
    """
    all_ = (1 << n) - 1
    for w in x:
        at = places.get(w, 0)
        if hits := row & (at if isinstance(at, int) else _bits(at)):
            row = ((row + hits) | (row - hits)) & all_
        yield row


def word_diff(old: str, new: str) -> list[tuple[str, str]]:
    """(op, word) of kept, added and removed words; where either would do, words are removed before they are added.

    Of the table's rows every k-th is kept, as bits, and those between are made again as the way back gets
    there; so n words against m take about m * sqrt(n) / 4 bytes.
    """
    a, b = (old or "").split(), (new or "").split()
    out, i, j = [], len(a), len(b)
    while i and j and a[i - 1] == b[j - 1]:  # the way back begins with what both end in
        i, j = i - 1, j - 1
        out.append(("eq", a[i]))
    stands: dict[str, list[int]] = {}
    for k, w in enumerate(b[:j]):
        stands.setdefault(w, []).append(k)
    places = {w: _bits(at) if j <= SHORT or len(at) > j**0.5 else at for w, at in stands.items()}
    start, every = (1 << j) - 1, max(1, int(i**0.5))
    kept = [start] + [r for k, r in enumerate(_rows(a[:i], places, start, j), 1) if k % every == 0]
    while i or j:
        at = max(i - 1, 0) // every  # rows from this block's first on, as bytes: one bit of a long number would cost as much as all
        block = [r.to_bytes((j >> 3) + 1, "little") for r in _rows(a[at * every : i], places, kept[at] & (1 << j) - 1, j)] if i and j else []
        while (i or j) and (not i or not j or i > at * every):
            if i and j and a[i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
                out.append(("eq", a[i]))
            elif j and (not i or block[i - 1 - at * every][(j - 1) >> 3] >> (j - 1 & 7) & 1):
                j -= 1  # the row doesn't rise here, so leaving this word out costs nothing
                out.append(("ins", b[j]))
            else:
                i -= 1
                out.append(("del", a[i]))
    return out[::-1]


#: Rows whose words are Python objects at a time; a batch has up to 10,000.
ROWS = 64


def _word_diffs(old: pa.Array, new: pa.Array) -> pa.Array:
    """word_diff of each pair, some rows at a time, so that of a batch no more than Arrow's own bytes is held."""
    done = [pa.array([], TYPE)]
    for at in range(0, len(old), ROWS):
        ends, ops, words = [0], [], []
        for a, b in zip(old.slice(at, ROWS).to_pylist(), new.slice(at, ROWS).to_pylist(), strict=True):
            for op, word in word_diff(a, b):
                ops.append(op)
                words.append(word)
            ends.append(len(ops))
        parts = pa.StructArray.from_arrays([pa.array(ops, pa.string()), pa.array(words, pa.string())], names=["op", "word"])
        done.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts).cast(TYPE))
    return pa.concat_arrays(done)


def word_diff_column(old, new):
    """The differences of two text columns, as PARTS."""
    return F.arrow_udf(_word_diffs, PARTS)(old, new)


def version_diffs(units: DataFrame) -> DataFrame:
    """doc_id, block_id, seq, next_seq, parts of each old provision that has a next version."""
    return next_versions(units).withColumn("parts", word_diff_column("text", "next_text")).drop("text", "next_text")

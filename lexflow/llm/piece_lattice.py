"""SentencePiece encoding and decoding by a relational lattice.

Texts are cut into units that no piece crosses: before a space, and between two characters that stand side by
side in no piece. Texts are worked on in blocks of a bounded number of bytes. A block's task writes its texts,
as numbers of units, to the shared folder and gives the block's distinct units on. Those of all blocks meet by
unit in one exchange, so each distinct unit of the corpus is encoded once: its substrings of bounded length are exploded and
equi-joined to the piece table, the edges found are grouped by unit, and Spark's aggregate folds over them. For
unigram models that fold is Viterbi's. Byte-pair models aren't defined by a best path but by the order of their
merges, and Viterbi gives other ids for them; their fold applies, step by step, the best-ranked edge that joins
two neighbouring symbols, the leftmost of equal ones.

Ids go back to the blocks that have the unit, many in a row, and each block is put together by itself: no task
holds more than a block and its units, however large the dictionary gets. Units of more than MOST characters that merges may
cross everywhere are folded in Python by the same rules, as a fold over arrays takes quadratic time.
"""

import hashlib
import heapq
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexflow.llm.arrow_text import buffers, distinct, identities, task
from lexflow.llm.common import shared_path
from lexflow.llm.encoders import gathered
from lexflow.session import prepare

SPACE = "▁"
#: Units of up to so many characters are folded by Spark, as places between characters are bits of a number.
MOST = 61
#: Bytes of text that make a block; units whose ids go back together; units of a block that are expanded together.
BLOCK, REPLY, CHUNK = 16 << 20, 400_000, 200_000
#: Characters are told apart up to this code point when texts are cut; the others are as one.
LATIN = 256

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """Numbers and values of a serialised message's fields."""
    at = 0

    def varint():
        nonlocal at
        n = shift = 0
        while True:
            c = data[at]
            at += 1
            n |= (c & 127) << shift
            shift += 7
            if c < 128:
                return n

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class Model:
    """A model's pieces by rank, and what matters of its settings."""

    kind: str  # bpe or unigram
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    prefix: bool

    @classmethod
    def read(cls, data: bytes) -> "Model":
        pieces, scores, kinds, kind, prefix = [], [], [], 1, True
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                pieces.append(own[1].decode())
                scores.append(float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(own.get(3, NORMAL))
            elif number == 2:
                kind = dict(_fields(value)).get(3, 1)
            elif number == 3:
                own = dict(_fields(value))
                if own.get(2) or not own.get(5, 1) or own.get(4, 1) and kind == 2:
                    raise ValueError("only models that leave texts as they are, but for spaces, can be read")
                prefix = bool(own.get(3, 1))
        if kind not in (1, 2) or USER in kinds or UNUSED in kinds:
            raise ValueError("only unigram and byte-pair models without user-defined pieces can be read")
        model = cls({1: "unigram", 2: "bpe"}[kind], pieces, scores, kinds, prefix)
        if any(SPACE in p.lstrip(SPACE) for p in model.normal()):
            raise ValueError("pieces go past spaces inside")
        return model

    def normal(self) -> dict[str, int]:
        return {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}

    def ranked(self) -> list[tuple[str, int, int, float]]:
        """(piece, rank, id, score), the best score first."""
        own = sorted(self.normal().items(), key=lambda x: (-self.scores[x[1]], x[1]))
        return [(p, r, i, self.scores[i]) for r, (p, i) in enumerate(own)]

    def cuts(self) -> np.ndarray:
        """For two neighbouring characters, whether no piece has them side by side; characters from LATIN on are as one, that stays uncut."""
        place = lambda c: 32 if c == SPACE else min(ord(c), LATIN)
        out = np.ones((LATIN + 1, LATIN + 1), bool)
        out[LATIN], out[:, LATIN] = False, False
        for a, b in {x for p in self.normal() for x in zip(p, p[1:], strict=False)}:
            out[place(a), place(b)] = False
        out[:, 32] = True  # pieces have spaces in front only
        out[32, 32] = False
        return out

    def unknown(self, char: int) -> list[int]:
        """Ids of a character without piece: its bytes, or the unknown piece."""
        by_byte = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == BYTE}
        return [by_byte[b] for b in chr(char).encode()] if len(by_byte) == 256 else [self.kinds.index(UNKNOWN)]

    def merge(self, unit: str, ranks: dict[str, tuple[int, int]]) -> list[int]:
        """Ids of a unit by merges, with a queue: for units that are too long for a fold over arrays."""
        right, left = list(range(1, len(unit) + 1)), list(range(-1, len(unit) - 1))
        text, live = list(unit), [True] * len(unit)
        queue = []

        def offer(a):
            b = right[a] if a >= 0 else len(unit)
            if a >= 0 and b < len(unit) and (own := ranks.get(text[a] + text[b])):
                heapq.heappush(queue, (own[0], a, text[a] + text[b]))

        for a in range(len(unit)):
            offer(a)
        while queue:
            _, a, piece = heapq.heappop(queue)
            if not live[a] or right[a] >= len(unit) or text[a] + text[right[a]] != piece:
                continue
            b = right[a]
            text[a], live[b], right[a] = piece, False, right[b]
            if right[a] < len(unit):
                left[right[a]] = a
            offer(left[a])
            offer(a)
        return [i for a, on in enumerate(live) if on for i in ([ranks[text[a]][1]] if text[a] in ranks else self.unknown(ord(text[a])))]

    def best_path(self, unit: str) -> list[int]:
        """Ids of a unit by Viterbi: for units that are too long for a fold over arrays."""
        own, low = self.normal(), min(s for s, k in zip(self.scores, self.kinds, strict=True) if k == NORMAL) - 10
        longest = max(map(len, own))
        best = [(0.0, 0, [])] + [None] * len(unit)
        for e in range(1, len(unit) + 1):
            for s in range(max(0, e - longest), e):
                i = own.get(unit[s:e])
                if i is None and e - s > 1:
                    continue
                score = best[s][0] + (low if i is None else self.scores[i])
                if best[e] is None or score > best[e][0]:
                    best[e] = (score, s, self.unknown(ord(unit[s])) if i is None else [i])
        out, e = [], len(unit)
        while e:
            out[:0], e = best[e][2], best[e][1]
        return out


def _spaced(texts: pa.Array, prefix: bool) -> pa.Array:
    """Texts as units see them: the mark for a space is one, and a text that isn't empty has one before it."""
    texts = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), SPACE, " ")
    return pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))) if prefix else texts


def _unit_starts(data: np.ndarray, bounds: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)  # characters
    lead = data[at].astype(np.int16)
    two = (lead == 0xC2) | (lead == 0xC3)
    code = np.where(lead < 128, lead, np.where(two, (lead - 0xC2) * 64 + data[np.minimum(at + 1, n - 1)], LATIN))
    start = np.zeros(n, bool)
    start[at[1:][cuts[code[:-1], code[1:]]]] = True
    start[bounds[:-1][bounds[:-1] < n]] = True
    return np.flatnonzero(start)


class _Block:
    """Texts as numbers of units, and the units by number."""

    def __init__(self):
        self.size, self.docs, self.counts, self.numbers, self.units = 0, [], [], [], {}

    def add(self, doc_ids: pa.Array, data: np.ndarray, bounds: np.ndarray, cuts: np.ndarray):
        starts = _unit_starts(data, bounds, cuts)
        ends = np.append(starts[1:], len(data))
        first, place = distinct(*identities(data, starts, ends))
        raw, known = data.tobytes(), self.units
        own = [known.setdefault(raw[s:e], len(known)) for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        self.docs.append(doc_ids)
        self.counts.append(np.diff(np.searchsorted(starts, bounds)))
        self.numbers.append(np.array(own, np.int32)[place] if len(own) else np.zeros(0, np.int32))
        self.size += len(data)

    def record(self) -> bytes:
        """Units are numbered anew, the most frequent one first, so that high bytes are mostly zero."""
        numbers = np.concatenate([np.zeros(0, np.int32), *self.numbers])
        order = np.argsort(-np.bincount(numbers, minlength=len(self.units)), kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        names = list(self.units)
        self.names = [names[k] for k in order.tolist()]
        batch = pa.RecordBatch.from_arrays([pa.concat_arrays(self.docs), pa.array(np.concatenate(self.counts))], ["doc_id", "units"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        head = sink.getvalue().to_pybytes()
        return len(head).to_bytes(8, "little") + head + _squeezed(rank[numbers])


def _squeezed(*arrays: np.ndarray) -> bytes:
    """32-bit numbers, byte by byte of their weight, compressed."""
    raw = b"".join(np.ascontiguousarray(a.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays)
    head = np.array([len(raw), *map(len, arrays)], "<i8").tobytes()
    return head + pa.Codec("zstd").compress(raw, asbytes=True)


def _spread(data: bytes, n: int) -> list[np.ndarray]:
    """The n arrays that _squeezed was given."""
    total, *sizes = np.frombuffer(data, "<i8", n + 1).tolist()
    raw, at, out = pa.Codec("zstd").decompress(data[8 * (n + 1) :], decompressed_size=total, asbytes=True), 0, []
    for size in sizes:
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * size, at).reshape(4, size).T).view("<i4").reshape(-1))
        at += 4 * size
    return out


def _block_task(model: Model, folder: str, size: int):
    cuts, prefix = model.cuts(), model.prefix

    @task
    def run(batches):
        from pyarrow import fs

        context = TaskContext.get()
        uri = f"{folder}/blocks-{context.partitionId():06d}-{context.taskAttemptId()}"
        store, path = fs.FileSystem.from_uri(uri)
        stream, at, number, block = None, 0, context.partitionId() << 32, _Block()

        def flush():
            """The block's units, by number, and a row that says where its texts are."""
            nonlocal stream, at, number, block
            if stream is None:
                stream = store.open_output_stream(path)
            record = block.record()
            stream.write(record)
            names = block.names
            for k in range(0, len(names), 50_000):
                some = names[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), number)), pa.array(np.arange(k, k + len(some), dtype=np.int32)), pa.array(some, pa.binary()).cast(pa.string())], ["block", "at", "unit"])
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([-1], pa.int32()), pa.array([f"{at} {len(record)} {uri}"])], ["block", "at", "unit"])
            at, number, block = at + len(record), number + 1, _Block()

        for batch in batches:
            for row, data, bounds in buffers(_spaced(batch.column(1), prefix)):
                block.add(batch.column(0).slice(row, len(bounds) - 1), data, bounds, cuts)
                if block.size >= size:
                    yield from flush()
        if block.docs:
            yield from flush()
        if stream is not None:
            stream.close()

    return run


def _record(place: str) -> tuple[pa.RecordBatch, np.ndarray]:
    """The block at a place that _block_task names: documents with their counts of units, and the units' numbers."""
    from pyarrow import fs

    at, size, uri = place.split(" ", 2)
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as file:
        data = file.read_at(int(size), int(at))
    head = 8 + int.from_bytes(data[:8], "little")
    return pa.ipc.open_stream(data[8:head]).read_next_batch(), _spread(data[head:], 1)[0]


def blocks(docs: DataFrame, model: Model, size: int = BLOCK) -> DataFrame:
    """block, at, unit of the distinct units of each block; the row with at -1 says where the block's texts are.

    Spaces in units are as the model writes them.
    """
    from pyarrow import fs

    folder = shared_path(docs.sparkSession, "piece-blocks")
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.mapInArrow(_block_task(model, folder, size), "block long, at int, unit string")
    return rows.withColumn("unit", F.coalesce(F.when(F.col("at") < 0, F.col("unit")).otherwise(F.translate("unit", " ", SPACE)), F.lit("")))


def lattice(units: DataFrame, model: Model) -> DataFrame:
    """unit, edges of units of up to MOST characters with any: each edge is rank << 34 | start << 27 | end << 20 | id, sorted.

    Substrings are as long as the longest piece at most. The piece table has the vocabulary's size and is
    broadcast; units that are dealt out by unit need no further exchange to group their edges.
    """
    spark, ranked = units.sparkSession, model.ranked()
    longest = max(len(p) for p, *_ in ranked)
    pieces = spark.createDataFrame([(p, r << 34 | i) for p, r, i, _ in ranked], "piece string, code long")
    n = F.length("unit")
    at = units.select("unit", F.explode_outer(F.when(n <= MOST, F.sequence(F.lit(0), n - 1))).alias("s"))
    spans = at.select("unit", "s", F.explode_outer(F.sequence(F.lit(1), F.least(F.lit(longest), n - F.col("s")))).alias("l"))
    edges = spans.select("unit", "s", "l", F.expr("substring(unit, s + 1, l)").alias("piece")).join(F.broadcast(pieces), "piece")
    code = F.col("code").bitwiseOR(F.shiftleft(F.col("s").cast("long"), 27)).bitwiseOR(F.shiftleft((F.col("s") + F.col("l")).cast("long"), 20))
    return edges.select("unit", code.alias("edge")).groupBy("unit").agg(F.array_sort(F.collect_list("edge")).alias("edges"))


def _part(edge, shift: int, bits: int):
    return F.shiftright(edge, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int")


def _start(e):
    return _part(e, 27, 7)


def _end(e):
    return _part(e, 20, 7)


def _id(e):
    return _part(e, 0, 20)


def _bound(value, use):
    return F.transform(F.array(value), use)[0]


def _bit(k):
    return F.call_function("shiftleft", F.lit(1).cast("long"), k)


def merges(unit, edges):
    """Ids of a unit by the best-ranked merge of neighbours, again and again; characters without piece are negative code points.

    The places between symbols are bits of a number: an edge joins two neighbours where both its ends are set
    and just one bit is set between them, and joining them clears that bit.
    """
    n = F.length(unit)
    spans = F.transform(edges, lambda e: F.struct(_start(e).alias("s"), _end(e).alias("e"), _id(e).alias("id")))

    def work(spans):
        single = F.filter(spans, lambda x: x["e"] - x["s"] == 1)
        wide = F.transform(F.filter(spans, lambda x: x["e"] - x["s"] > 1), lambda x: F.struct(x["s"].alias("s"), x["id"].alias("id"), _bit(x["s"]).bitwiseOR(_bit(x["e"])).alias("ends"), (_bit(x["e"]) - _bit(x["s"] + 1)).alias("inner")))
        return _bound(single, lambda single: _bound(wide, lambda wide: name(single, wide, fold(wide))))

    def fold(wide):
        def step(a, _):
            cuts = a["cuts"]
            fits = F.get(F.filter(wide, lambda x: (cuts.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(cuts.bitwiseAND(x["inner"])) == 1)), F.lit(0))
            new = _bound(fits["inner"], lambda i: F.struct(F.when(i.isNull(), cuts).otherwise(cuts.bitwiseAND(F.bitwise_not(i))).alias("cuts"), i.isNull().alias("done")))
            return F.when(a["done"], a).otherwise(new)

        rounds = F.when(F.size(wide) > 0, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(rounds, F.struct((_bit(n + 1) - 1).alias("cuts"), F.lit(False).alias("done")), step, lambda a: a["cuts"])

    def name(single, wide, cuts):
        def parts(cuts):
            joined = F.transform(F.filter(wide, lambda x: (cuts.bitwiseAND(x["ends"]) == x["ends"]) & (cuts.bitwiseAND(x["inner"]) == 0)), lambda x: F.struct(x["s"].alias("s"), x["id"].alias("id")))
            both = lambda k: _bit(k).bitwiseOR(_bit(k + 1))
            alone = F.transform(F.filter(single, lambda x: cuts.bitwiseAND(both(x["s"])) == both(x["s"])), lambda x: F.struct(x["s"].alias("s"), x["id"].alias("id")))
            known = F.concat(joined, alone)
            rare = F.filter(F.sequence(F.lit(0), n - 1), lambda k: (cuts.bitwiseAND(both(k)) == both(k)) & ~F.exists(single, lambda x: x["s"] == k))
            unknown = F.transform(rare, lambda k: F.struct(k.alias("s"), (-F.ascii(F.substr(unit, k + 1, F.lit(1)))).alias("id")))
            return _bound(known, lambda known: F.when(F.size(known) == F.bit_count(cuts) - 1, known).otherwise(F.concat(known, unknown)))

        return F.transform(F.array_sort(_bound(cuts, parts)), lambda x: x["id"])

    return _bound(spans, work)


def viterbi(unit, edges, scores, low: float):
    """Ids of a unit on the path with the best sum of scores; scores by rank, low for a character without piece."""
    n = F.length(unit)
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("back"), F.lit(0).alias("id")))

    def step(best, e):
        own = F.transform(F.filter(edges, lambda x: _end(x) == e), lambda x: F.struct((F.get(best, _start(x))["score"] + F.get(scores, _part(x, 34, 20))).alias("score"), _start(x).alias("back"), _id(x).alias("id")))
        rare = F.struct((F.get(best, e - 1)["score"] + low).alias("score"), (e - 1).alias("back"), (-F.ascii(F.substr(unit, e, F.lit(1)))).alias("id"))
        known = F.exists(own, lambda x: x["back"] == e - 1)
        every = F.when(known, own).otherwise(F.concat(own, F.array(rare)))
        return F.concat(best, F.array(F.array_max(every)))

    def path(best):
        def back(a, _):
            at = F.get(best, a["at"])
            return F.when(a["at"] == 0, a).otherwise(F.struct(at["back"].alias("at"), F.concat(F.array(at["id"]), a["ids"]).alias("ids")))

        return F.aggregate(F.sequence(F.lit(1), n), F.struct(n.alias("at"), F.array().cast("array<int>").alias("ids")), back, lambda a: a["ids"])

    return _bound(F.aggregate(F.sequence(F.lit(1), n), start, step), path)


def dictionary(units: DataFrame, model: Model) -> DataFrame:
    """unit, ids of every distinct unit that has an edge; negative ids are code points of characters without piece."""
    edges = lattice(units, model)
    if model.kind == "bpe":
        ids = merges(F.col("unit"), F.col("edges"))
    else:
        scores = F.split(F.lit(",".join(repr(s) for *_, s in model.ranked())), ",").cast("array<double>")
        ids = viterbi(F.col("unit"), F.col("edges"), scores, min(s for *_, s in model.ranked()) - 10)
    return edges.select("unit", ids.alias("ids"))


def _expanded(ids: np.ndarray, model: Model, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """ids with what characters without piece stand for, and where each id's part begins (and, last, the end)."""
    rare = ids < 0
    sizes = np.ones(len(ids), np.int64)
    if not rare.any():
        return ids, np.arange(len(ids) + 1)
    codes, which = np.unique(ids[rare], return_inverse=True)
    parts = [known.setdefault(c, np.array(model.unknown(-c), np.int32)) for c in codes.tolist()]
    each = np.array([len(x) for x in parts], np.int64)
    sizes[rare] = each[which]
    out, spread = np.empty(int(sizes.sum()), np.int32), np.repeat(rare, sizes)
    out[~spread] = ids[~rare]
    out[spread] = np.concatenate(parts)[gathered((np.cumsum(each) - each)[which], each[which])]
    return out, np.concatenate([[0], np.cumsum(sizes)])


def _decoded(ids: list[int], table: list[bytes], prefix: bool) -> bytes:
    out = b"".join([table[i] for i in ids])
    return out[1:] if prefix and out[:1] == b" " else out


def decode_table(model: Model) -> list[bytes]:
    """What each id stands for."""
    return [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(model.pieces, model.kinds, strict=True)]


SCHEMA = "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string"


def _reply_task(model: Model):
    """Rows (block, at, ids, unit) packed by block, many in a row; units that aren't folded yet are, and places of blocks go on as they are."""
    ranks = {p: (r, i) for p, r, i, _ in model.ranked()}
    one_by_one = (lambda u: model.merge(u, ranks)) if model.kind == "bpe" else model.best_path

    def packed(parts):
        block, at, sizes, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        begins, order = np.cumsum(sizes) - sizes, np.lexsort((at, block))
        block, at, sizes, begins = block[order], at[order], sizes[order], begins[order]
        edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])).tolist()
        data = [_squeezed(np.diff(at[a:e], prepend=0), sizes[a:e], ids[gathered(begins[a:e], sizes[a:e])]) for a, e in zip(edge[:-1], edge[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(block[edge[:-1]]), pa.nulls(len(data), pa.string()), pa.array(data, pa.binary())], ["block", "place", "data"])

    @task
    def run(batches):
        parts, many = [], 0
        for batch in batches:
            block, at, lists, names = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2), batch.column(3)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            place = np.flatnonzero(at < 0)
            if len(place):
                yield pa.RecordBatch.from_arrays([pa.array(block[place]), names.take(pa.array(place)), pa.nulls(len(place), pa.binary())], ["block", "place", "data"])
            long = np.flatnonzero((at >= 0) & ~pc.is_null(names).to_numpy(zero_copy_only=False))
            for k in long.tolist():
                own = np.array(one_by_one(names[k].as_py()), np.int32)
                parts.append((block[k : k + 1], at[k : k + 1], np.array([len(own)]), own))
            short = pc.is_null(names).to_numpy(zero_copy_only=False)
            parts.append((block[short], at[short], sizes[short], ids))  # the others have no ids yet
            many += len(batch)
            if many >= REPLY:
                yield packed(parts)
                parts, many = [], 0
        if sum(len(p[0]) for p in parts):
            yield packed(parts)

    return run


def _block_rows(model: Model, with_ids: bool):
    """One block's rows, from the ids of its units and its texts."""
    table = decode_table(model)

    def run(replies: pa.Table) -> pa.Table:
        places = [p for p in replies.column("place").to_pylist() if p is not None]
        docs, numbers = _record(places[0])
        pools, ats, each = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for data in replies.column("data").to_pylist():
            if data is not None:
                at, sizes, ids = _spread(data, 3)
                pools.append(ids)
                ats.append(np.cumsum(at, dtype=np.int64))
                each.append(sizes.astype(np.int64))
        pool, at, each = np.concatenate(pools), np.concatenate(ats), np.concatenate(each)
        begins, sizes = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        begins[at], sizes[at] = np.cumsum(each) - each, each
        bounds = np.concatenate([[0], np.cumsum(docs.column(1).to_numpy())])
        rows, rare, k = [], {}, 0
        while k < len(docs):
            e = max(k + 1, int(np.searchsorted(bounds, bounds[k] + CHUNK, "right")) - 1)
            place = numbers[bounds[k] : bounds[e]]
            each = sizes[place]
            ids, moved = _expanded(pool[gathered(begins[place], each)], model, rare)
            ends = moved[np.concatenate([[0], np.cumsum(each)])[bounds[k : e + 1] - bounds[k]]].tolist()
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                own = ids[a:b]
                digest = hashlib.sha256(_decoded(own.tolist(), table, model.prefix)).hexdigest()
                rows.append((b - a, zlib.crc32(own.astype("<u4").tobytes()), digest, own if with_ids else None))
            k = e
        n, crc, sha, own = zip(*rows, strict=True)
        columns, names = [docs.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256"]
        if with_ids:
            columns.append(pa.array(own, pa.list_(pa.int32())))
            names.append("ids")
        return pa.table(columns, names)

    return run


def encoded(docs: DataFrame, model_file: str, *, block: int = BLOCK, with_ids: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_pieces, ids_crc32, decoded_sha256, and ids if with_ids.

    ids are those of the SentencePiece library for the model; decoded is what they say again: the text, with
    the model's mark for a space as a space. Defined cases: a null or empty text has no ids; a row without
    doc_id and repeated rows are rows like others; units of any length are encoded; no rows give no rows;
    other columns play no part.

    block is the number of bytes of text that a task puts together at a time; a longer text is a block by itself.
    """
    with open(model_file, "rb") as f:
        model = Model.read(f.read())
    # both sides of the join read all columns, and units are never null, so that one exchange serves both; the
    # rows that say where blocks are go along as units without edges
    places = blocks(docs, model, block).repartition("unit")
    units = places.groupBy("unit").agg(F.min(F.struct("block", "at")).alias("first")).where("first is not null").select("unit")
    n = F.length("unit")
    rare = F.when(n <= MOST, F.transform(F.sequence(F.lit(1), n), lambda k: -F.ascii(F.substr(F.col("unit"), k, F.lit(1)))))
    place = F.col("at") < 0
    found = places.join(dictionary(units, model), "unit", "left").select("block", "at", F.when(~place, F.coalesce("ids", rare)).alias("ids"), F.when(place | (n > MOST), F.col("unit")).alias("unit"))
    replies = found.mapInArrow(_reply_task(model), "block long, place string, data binary")
    return replies.groupBy("block").applyInArrow(_block_rows(model, with_ids), SCHEMA + ", ids array<int>" * with_ids)

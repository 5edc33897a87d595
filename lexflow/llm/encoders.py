"""Token ids of public tokenizer files, with the library called once for each unit of text that a worker meets.

A byte-level or word-level BPE file never merges across certain places: between words, and inside them where a run
of ASCII letters, digits or signs ends. Texts are cut there, all at once with
NumPy, and the library encodes each unit that the worker doesn't know yet, thousands in one call; ids of a
text are the ids of its units, gathered. Files whose settings give no such places, and texts that hold a special token's
string or rare white space, go through the library whole. Units are told apart by their bytes (long ones by a
120-bit digest), never by a short hash. At the end of its task a worker forgets all units but those it met again.
"""

import json
import os
import re
import sys
import types
from contextlib import contextmanager

import numpy as np
import pyarrow as pa

from lexflow.llm.arrow_text import Words, distinct, identities, mix, slices

#: UTF-8 of white space beyond ASCII. Fixed values.
RARE_SPACE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
GENERAL_SPACE = re.compile(rb"\xe2\x80[\x80-\x8a\xa8\xa9\xaf]")

#: ASCII letters, digits and signs; white space and all other bytes are of no kind.
KIND = np.zeros(256, np.int8)
KIND[1:9] = KIND[14:32] = KIND[33:128] = 3
KIND[65:91] = KIND[97:123] = 1
KIND[48:58] = 2
KIND[1] = 0  # stands between units
APOSTROPHE = ord("'")

#: Units that a worker knows before it starts anew; a bound of memory only (some 60 bytes each).
KEEP = 1_000_000
#: Units met again that a worker still knows in its next task, at most.
FREQUENT = 400_000
#: Units that go to the library as one text, and what stands between those of word-level files.
TOGETHER, MARK = 4_000, "\x01"


def _store() -> dict:
    """Survives between tasks of a worker, whatever way the code reached it."""
    return sys.modules.setdefault("_lexflow_worker", types.ModuleType("_lexflow_worker")).__dict__.setdefault("encoders", {})


def gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, … for each length, end to end."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


class Encoder:
    """Ids of texts by a tokenizers file, as arrays of unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        self.special = [t["content"].encode() for t in own["added_tokens"]]
        self.rule = self._rule(own)
        if self.rule:
            self.between = self._ids(["\n" if self.rule == "bytes" else MARK])[0]
            if len(self.between) != 1:
                self.rule = None
        self.frequent = self.keep = None
        self._forget()

    @staticmethod
    def _rule(own: dict) -> str | None:
        """bytes: a word with the one space before it is whole tokens, and so is white space besides; words: a word is."""
        pre, norm = own.get("pre_tokenizer") or {}, own.get("normalizer")
        if own.get("post_processor") or own["model"]["type"] != "BPE":
            return None
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            return "bytes"
        kinds = [n["type"] for n in (norm or {}).get("normalizers", [])]
        parts = pre.get("pretokenizers", [])
        if kinds == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in parts] == ["Split", "ByteLevel"] and parts[0]["behavior"] == "Removed" and r"[^\s\p{L}\p{N}]" in parts[0]["pattern"].get("Regex", "") and not parts[1]["use_regex"]:
            return "words"
        return None

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _forget(self):
        """keys are sorted hashes of known units' identities (one, two); a unit's ids lie in pool from at on, sizes of them."""
        self.keys, self.one, self.two = (np.zeros(0, np.uint64) for _ in range(3))
        self.at, self.sizes, self.again = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def rest(self):
        """Forgets units that were met once."""
        some = np.flatnonzero(self.again)
        if len(some) > (self.frequent or FREQUENT):
            self._forget()
            return
        sizes = self.sizes[some]
        pool = self.pool[gathered(self.at[some], sizes.astype(np.int64))]
        self.keys, self.one, self.two, self.sizes = self.keys[some], self.one[some], self.two[some], sizes
        self.at, self.again = np.cumsum(sizes, dtype=np.int64) - sizes, np.zeros(len(some), bool)
        self.pool, self.used = pool, len(pool)

    def _encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units end to end, and how many each has."""
        together, apart = [], []
        for k, u in enumerate(units):
            odd = MARK in u if self.rule == "words" else not u.strip(" \t\n\r\x0b\x0c") or "\n" in u
            (apart if odd else together).append(k)
        found: list = [None] * len(units)
        join = f" {MARK} " if self.rule == "words" else "\n"
        for a in range(0, len(together), TOGETHER):
            some = together[a : a + TOGETHER]
            ids = self._ids([join.join(units[k] for k in some) + join.rstrip(" ")])[0]
            ends = np.flatnonzero(ids == self.between[0])
            if len(ends) != len(some):
                apart += some
                continue
            for k, b, e in zip(some, np.concatenate([[0], ends[:-1] + 1]).tolist(), ends.tolist(), strict=True):
                found[k] = ids[b:e]
        for k, ids in zip(apart, self._ids([units[k] for k in apart]), strict=True):
            found[k] = ids
        return (np.concatenate(found) if found else np.zeros(0, np.uint32)), np.array([len(x) for x in found], np.int32)

    def _units(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the units, in order: words or gaps, cut where a run of letters, digits or signs ends.

        Both kinds of file tell these runs apart without looking back; only an apostrophe takes letters after it.
        """
        starts, ends = (w.starts, w.ends) if self.rule == "words" else self._spaced(w)
        if not len(starts):
            return starts, ends
        a, b = w.data[:-1], w.data[1:]
        kind, after = KIND[a], KIND[b]
        cut = (kind != after) & (kind > 0) & (after > 0) & ~((a == APOSTROPHE) & (after == 1))
        if self.rule == "words":
            cut |= (kind == 2) & (after == 2)  # each digit is by itself
        begin = np.zeros(len(w.data), bool)
        begin[1:] = cut
        begin[starts] = True  # where a text begins, a unit does
        every = np.flatnonzero(begin)
        own = np.searchsorted(starts, every, "right") - 1
        return every, np.minimum(np.append(every[1:], len(w.data)), ends[own])

    def _spaced(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Words with the one space before them, and what else lies between."""
        spaced = np.zeros(len(w.starts), bool)
        own = w.owners()
        inner = w.starts > w.bounds[:-1][own]
        spaced[inner] = w.data[w.starts[inner] - 1] == 32
        starts = w.starts - spaced
        # gaps: what is left before each word, and after a text's last one
        begin = w.bounds[:-1][own]
        same = np.zeros(len(own), bool)
        same[1:] = own[1:] == own[:-1]
        begin[same] = w.ends[:-1][same[1:]]
        gap = np.flatnonzero(starts > begin)
        last = np.where(spaced[gap], starts[gap], starts[gap] - 1)  # without a space, the gap's last character is by itself
        tail = np.where(w.counts > 0, w.ends[np.maximum(w.first[1:] - 1, 0)] if len(w.ends) else 0, w.bounds[:-1])
        parts = [(starts, w.ends), (begin[gap], last), (last, starts[gap]), (tail, w.bounds[1:])]
        s, e = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        full = e > s
        s, e = s[full], e[full]
        order = np.argsort(s, kind="stable")
        return s[order], e[order]

    def _odd(self, w: Words, raw: bytes) -> list[int]:
        """Texts that have to go through the library whole."""
        signs = [s for s in self.special if s in raw]
        if self.rule == "bytes":
            signs += [s for s in RARE_SPACE if s in raw]
        general = self.rule == "bytes" and b"\xe2\x80" in raw and GENERAL_SPACE.search(raw) is not None
        if not signs and not general:
            return []
        b = w.bounds.tolist()
        texts = [raw[a:e] for a, e in zip(b[:-1], b[1:], strict=True)]
        return [k for k, t in enumerate(texts) if any(s in t for s in signs) or (general and GENERAL_SPACE.search(t))]

    def _known(self, keys: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of sorted keys among the known ones, and which of these are the same unit."""
        at = np.searchsorted(self.keys, keys)
        near = np.minimum(at, max(len(self.keys) - 1, 0))
        held = (self.keys[near] == keys) & (self.one[near] == one) & (self.two[near] == two) if len(self.keys) else np.zeros(len(keys), bool)
        return at, held

    def _ids_of(self, one: np.ndarray, two: np.ndarray, text_of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct identities: a pool of ids, and where in it each one's ids begin and how many they are."""
        hashes = mix(one ^ mix(two))
        order = np.argsort(hashes)
        keys, one, two = hashes[order], one[order], two[order]
        if len(self.keys) + len(keys) > (self.keep or KEEP):
            self._forget()
        at, held = self._known(keys, one, two)
        clash = (keys[1:] == keys[:-1]).any() or (len(self.keys) and (~held & (self.keys[np.minimum(at, len(self.keys) - 1)] == keys)).any())
        if clash:  # units that differ have one hash: these do without what is known
            pool, sizes = self._encode_units([text_of(k) for k in order.tolist()])
            begins = np.cumsum(sizes, dtype=np.int64) - sizes
        else:
            self.again[at[held]] = True
            if not held.all():
                new = ~held
                ids, sizes = self._encode_units([text_of(k) for k in order[new].tolist()])
                if self.used + len(ids) > len(self.pool):
                    self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(self.pool), len(ids)), np.uint32)])
                self.pool[self.used : self.used + len(ids)] = ids
                more = {"keys": keys, "one": one, "two": two}
                for name, values in more.items():
                    setattr(self, name, np.insert(getattr(self, name), at[new], values[new]))
                self.at = np.insert(self.at, at[new], self.used + np.cumsum(sizes, dtype=np.int64) - sizes)
                self.sizes = np.insert(self.sizes, at[new], sizes)
                self.again = np.insert(self.again, at[new], False)
                self.used += len(ids)
                at = np.searchsorted(self.keys, keys)
            pool, begins, sizes = self.pool, self.at[at], self.sizes[at]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return pool, begins[back], sizes[back].astype(np.int64)

    def _slice(self, w: Words):
        raw = w.data.tobytes()
        starts, ends = self._units(w)
        one, two = identities(w.data, starts, ends)
        first, place = distinct(one, two)
        s, e = starts[first], ends[first]
        pool, begins, sizes = self._ids_of(one[first], two[first], lambda k: raw[s[k] : e[k]].decode())
        each = sizes[place]
        ids = pool[gathered(begins[place], each)]
        per_text = np.concatenate([[0], np.cumsum(each)])[np.searchsorted(starts, w.bounds)].tolist()
        odd = {k: None for k in self._odd(w, raw)}
        for k, own in zip(odd, self._ids([raw[w.bounds[k] : w.bounds[k + 1]].decode() for k in odd]), strict=True):
            odd[k] = own
        for k in range(len(w.counts)):
            yield odd[k] if k in odd else ids[per_text[k] : per_text[k + 1]]

    def __call__(self, texts: pa.Array):
        """The ids of each text, in order; a null text is empty."""
        if self.rule is None:
            for a in range(0, len(texts), 256):
                yield from self._ids([t or "" for t in texts.slice(a, 256).to_pylist()])
            return
        for _, w in slices(texts):
            yield from self._slice(w)


@contextmanager
def encoder(path: str, frequent: int | None = None):
    """The worker's encoder of this file; most of what it has learned goes when the block ends.

    frequent is how many units it may keep then (None: FREQUENT), and four times as many are known at a time; less saves memory and costs time.
    """
    store = _store()
    if path not in store:
        store[path] = Encoder(path)
    store[path].frequent, store[path].keep = frequent, frequent and 4 * frequent
    try:
        yield store[path]
    finally:
        store[path].rest()

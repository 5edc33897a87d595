"""Words that were built to collide under unkeyed hashes, and long texts that make patterns look far."""

import time

import numpy as np
import pyarrow as pa
import pytest
from helpers import table

import corpus_pipeline
from lexflow.llm import minhash, substrings
from lexflow.llm.arrow_text import hashes_of
from lexflow.llm.pii import protect

#: Two words that a chain of public scrambles, eight bytes at a time, gives one hash.
PAIR = ("e41jrqx2iaaaakab", 'v2cpvc16[)|("@7@')


def test_words_built_to_collide(spark):
    a, b = PAIR
    texts = ["one two {} four five six seven eight nine ten", "{0} two three {0} five {0} seven {0} nine ten"]
    docs = [(k, t.format(w)) for k, (t, w) in enumerate([(texts[0], a), (texts[0], b), (texts[1], a), (texts[1], b)])]
    rows = {r.doc_id: r for r in minhash.near_duplicates(table(spark, docs)).collect()}
    assert all(r.component_id == i and r.kept and r.n_shingles == 6 for i, r in rows.items())
    filler = [f"w{k}" for k in range(19)]
    docs = [(k, " ".join([*filler[:9], w, *filler[9:]])) for k, w in enumerate(PAIR)]
    assert {r.doc_id: r.n_removed for r in substrings.without_repeats(table(spark, docs)).collect()} == {0: 0, 1: 0}


@pytest.mark.parametrize("seed", [11, 21, 31, 32])
def test_hashes_follow_key_and_seed(seed):
    raw = " ".join(PAIR).encode() + b" " + PAIR[0].encode()
    data, starts, ends = np.frombuffer(raw, np.uint8), np.array([0, 17, 34]), np.array([16, 33, 50])
    one, other = (hashes_of(data, starts, ends, seed, key=k) for k in (b"a", b"b"))
    assert one[0] == one[2] != one[1] and not set(one.tolist()) & set(other.tolist())
    assert not set(one.tolist()) & set(hashes_of(data, starts, ends, seed + 1, key=b"a").tolist())


def test_results_do_not_depend_on_the_key(spark):
    rnd = np.random.default_rng(4)
    docs = [(k, " ".join(f"w{x}" for x in rnd.integers(0, 9, 60))) for k in range(20)]
    docs += [(k + 100, f"{t} more") for k, t in docs]
    near = [sorted(map(tuple, minhash.near_duplicates(table(spark, docs), key=k).drop("n_links").collect())) for k in (b"a", b"b", None)]
    parts = [sorted(map(tuple, substrings.without_repeats(table(spark, docs), key=k).collect())) for k in (b"a", b"b", None)]
    assert near[0] == near[1] == near[2] and parts[0] == parts[1] == parts[2]


LONG = {"letters": "a", "dots": "a.", "digits": "1", "codes": "+1 ", "at": "a@", "hex": "0a1b", "address": "ab.1", "numbers": "1."}


@pytest.mark.parametrize("name", LONG)
def test_personal_data_in_a_long_run(name):
    text = LONG[name] * (1_000_000 // len(LONG[name]))
    began = time.thread_time()
    protect(text, b"k", known={})
    assert time.thread_time() - began < 10


def test_addresses_around_long_runs():
    kept, found = protect("." * 50_000 + "ann@site.org " + "b" * 50_000 + " .bob.x@site.org;" + "c" * 200 + "@site.org", b"k", known={})
    assert found == {"email": 3} and kept.startswith("." * 50_000) and "ann@" not in kept and "bob.x@" not in kept and "c@" not in kept


def test_pipeline_stage_over_long_runs(spark, sf_dir):
    docs = table(spark, [(k, t * (300_000 // len(t)) + " ann@site.org") for k, t in enumerate(LONG.values())])
    out = {r.doc_id: r.text for r in corpus_pipeline.private(spark, docs, sf_dir).collect()}
    assert len(out) == len(LONG) and not any(t.endswith(" ann@site.org") for t in out.values())


def test_hash_of_no_words():
    assert len(hashes_of(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0
    assert list(minhash.shingle_sets(pa.array([None, ""])))[0][2].tolist() == [0, 0]

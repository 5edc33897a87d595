"""Ranges as intervals against every number by itself."""

import random

from lexflow.operators import checks, intervals, subjects

SHEET = "row_no int, subject string, sub_subject string, devices string, see_also string, width int"
ARTS = "art_number string, law_prefix string"


def covered(lo, hi):
    """Blocks of a range, taken from both ends."""
    out, left, right, level = [], lo, hi + 1, 0
    while left < right:
        if left % 2:
            out.append((level, left))
            left += 1
        if right % 2:
            right -= 1
            out.append((level, right))
        left, right, level = left // 2, right // 2, level + 1
    return out


def test_cover(spark):
    rnd = random.Random(3)
    some = [(a, b) for a in range(20) for b in range(a - 2, 40)] + [(a, a + rnd.randint(0, 2**40)) for a in (rnd.randint(0, 2**50) for _ in range(100))] + [(0, intervals.LAST - 1), (7, 3_000_000_000)]
    rows = spark.createDataFrame(some, "lo long, hi long")
    for r in rows.withColumn("c", intervals.cover(rows.lo, rows.hi)).collect():
        assert sorted((b.level, b.block) for b in r.c) == sorted(covered(r.lo, r.hi))


def test_targets_and_dangling_parts(spark):
    rnd = random.Random(4)
    articles = [(str(n) + rnd.choice(["", "", "-A", "-B"]), rnd.choice(["", "", "LO"])) for n in rnd.choices(range(60), k=45)] + [("ADT3", ""), ("70000", ""), ("70000-A", "LO")]
    lines = ["{}{}-{}".format(rnd.choice(["", "LO:", "XX: "]), *(rnd.randint(0, 70) for _ in range(2))) for _ in range(80)] + ["65000-140000", "12", "3,I"]
    sheet = spark.createDataFrame([(k, f"s{k}", "", "\n".join(rnd.sample(lines, 2)), "", 4) for k in range(60)] + [(99, "s", "", None, None, 4)], SHEET)
    arts, entries = spark.createDataFrame(articles, ARTS), subjects.entries(sheet)
    refs = subjects.references(entries, arts.where("art_number like '%-%'").distinct()).where("step > 0 or detail = '' and art = '0'").collect()
    plain = {(p, a) for a, p in articles} | {("", a) for a, _ in articles}
    want = {(r.row_no, r.line, r.law_prefix, int(r.art.split("-")[0]), r.art) for r in refs if (r.law_prefix, r.art) in plain}
    got = [tuple(r) for r in intervals.range_targets(entries, arts).collect()]
    zero = {g for g in got if g[3] == 0}
    assert len(got) == len(set(got)) and {g for g in got if g[3] > 0} == {w for w in want if w[3] > 0} and all(g[4].startswith("0") for g in zero)
    parts = intervals.dangling_ranges(entries, arts).collect()
    missed = {(r.row_no, r.line, r.law_prefix, n) for r in parts for n in range(r.lo, r.hi + 1)}
    assert len(missed) == sum(r.hi - r.lo + 1 for r in parts)
    assert {m for m in missed if m[3] > 0} == {(r.row_no, r.line, r.law_prefix, r.step) for r in refs if r.step > 0 and r.sub == "" and (r.law_prefix, r.art) not in plain}
    by_key = {r.key for r in checks.dangling_references(subjects.references(entries), arts).collect() if r.key.split(":")[-1].isdigit()}
    assert {f"{p}:{n}" if p else str(n) for _, _, p, n in missed if n > 0} <= by_key | {"0"}


def test_wide_ranges(spark):
    sheet = spark.createDataFrame([(1, "a", "", "1-3000000000", "", 4), (2, "b", "", "5-99999999999999999999\n4-4\n9-2", "", 4), (3, "c", "", f"2-{2**62}", "", 4)], SHEET)
    arts = spark.createDataFrame([("2", ""), ("7", ""), ("2999999999", ""), ("3000000001", "")], ARTS)
    entries = subjects.entries(sheet)
    assert sorted((r.row_no, r.step) for r in intervals.range_targets(entries, arts).where("row_no = 1").collect()) == [(1, 2), (1, 7), (1, 2999999999)]
    got = sorted((r.row_no, r.lo, r.hi) for r in intervals.dangling_ranges(entries, arts).collect())
    assert got[:4] == [(1, 1, 1), (1, 3, 6), (1, 8, 2999999998), (1, 3000000000, 3000000000)] and (2, 4, 4) in got
    assert got[-1] == (3, 3000000002, intervals.LAST - 1)
    assert intervals.dangling_ranges(entries, arts.limit(0)).where("row_no = 1").collect()[0].hi == 3000000000
    assert subjects.references(entries.where("row_no = 1")).where("step <= 3").limit(3).count() == 3  # made part by part

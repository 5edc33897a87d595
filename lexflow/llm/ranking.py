"""Ranks and ties within groups of any size: light groups by lexsort, heavy ones by a sample sort.

1. Exact counts of all groups, combined on the map side, tell light groups (at most LIGHT rows) from heavy ones.
2. Light groups are dealt by a hash to bins of some BIN rows; one applyInPandas call sorts a bin with NumPy's
   lexsort and numbers all its groups at once. Of a group that holds more than one of HOT rows nothing gets there.
3. Heavy groups are sorted together: Spark draws splitters from a sample, deals rows by them and sorts each
   partition; equal rows are told apart by their places, so that they too can be dealt to several. Rows are numbered as
   they stream by, and the exact counts of each group in the partitions before give what is added.
4. Ties are counted per group and tie key, combined on the map side, and joined to the rows that are asked for.

Which groups are hot is known by at most HOT keys, and of each partition at most one group goes on from another,
so what is broadcast doesn't grow with the rows. Nothing goes through one task or the driver but four counts.
"""

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexflow.llm.arrow_text import task
from lexflow.llm.common import HOT, joined, located, stored

#: Rows of a light group at most, and of a bin of light groups as they are aimed at.
LIGHT, BIN = 8_192, 32_768

#: How rows are placed that tie: each by itself, all at their first position, all at their last.
PLACES = ("row", "min", "max")


def _coded(name: str, falling: bool, nulls_first: bool, k: str) -> list[Column]:
    """A key as two columns that are never null and rise in its order: n tells nulls, v is the value or its complement."""
    value = F.col(f"`{name}`").cast("long")
    return [
        F.when(value.isNull(), 0 if nulls_first else 1).otherwise(1 if nulls_first else 0).cast("tinyint").alias(f"n{k}"),
        F.coalesce(F.bitwise_not(value) if falling else value, F.lit(0).cast("long")).alias(f"v{k}"),
    ]


def _decoded(name: str, falling: bool, nulls_first: bool, k: str) -> Column:
    value = F.bitwise_not(f"v{k}") if falling else F.col(f"v{k}")
    return F.when(F.col(f"n{k}") == (1 if nulls_first else 0), value).alias(name)


def _fresh(columns: Sequence[np.ndarray]) -> np.ndarray:
    """Of sorted rows: whether a row differs from the one before in any column."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _lexsorted(keys: list[str], tie: list[str], group: list[str], most: int | None, place: str):
    """Sorts a bin of light groups and numbers the rows of each: at counts from 1, first is the position of the first that ties, tied how many do."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        values = {k: frame[k].to_numpy() for k in keys}
        told = [k for k in keys if len(frame) and (values[k] != values[k][0]).any()] or keys[:1]
        order = np.lexsort([values[k] for k in reversed(told)])
        values = {k: v[order] for k, v in values.items()}
        n = len(order)
        starts = np.flatnonzero(_fresh([values[k] for k in group]))
        at = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n))) + 1
        runs = np.flatnonzero(_fresh([values[k] for k in tie]))
        tied = np.diff(np.append(runs, n))
        out = values | {"at": at, "first": np.repeat(at[runs], tied), "tied": np.repeat(tied, tied)}
        if most is not None:
            placed = {"row": out["at"], "min": out["first"], "max": out["first"] + out["tied"] - 1}[place]
            out = {k: v[placed <= most] for k, v in out.items()}
        return pd.DataFrame(out)

    return run


def _numbered(group: list[str]):
    """Adds at to rows that stream by in order: how many of their group there have been in this partition."""

    @task
    def run(batches):
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy() for k in group]
            new = _fresh(columns)
            new[0] = last != tuple(c[0] for c in columns)
            starts = np.flatnonzero(new)
            at = np.arange(1, batch.num_rows + 1)
            begin = np.concatenate([[-seen], starts])  # rows before the first start go on with the last group
            at -= np.repeat(begin, np.diff(np.concatenate([[0], starts, [batch.num_rows]])))
            last, seen = tuple(c[-1] for c in columns), int(at[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], [*batch.schema.names, "at"])

    return run


def ranked(rows: DataFrame, group: Sequence[str], order: Sequence[tuple[str, bool, bool]], ties: int, *, most: int | None = None, place: str = "row", light: int = LIGHT, size: int = BIN) -> DataFrame:
    """Each row's position in its group: the columns of group and order, pos, place and tied, all long.

    group names whole-number columns; order is (column, falling, nulls first) for each, most significant first;
    rows tie that are equal in the first ``ties`` of these. pos counts a group's rows from 1 in that order, tied
    how many rows of the group tie with this one, itself included. place is pos ("row"), or the first ("min") or
    last ("max") pos of those that tie. most keeps rows whose place is no larger (a top-k report); what is counted is counted over all rows.

    Defined cases: rows that are equal in all columns are ranked one by one; nulls of group columns are a value of
    their own; no rows give no rows; other columns of rows play no part, whatever their names.
    """
    if place not in PLACES or not 0 < ties <= len(order):
        raise ValueError("place is row, min or max, and some of the order's columns tie")
    columns = [(c, False, True) for c in group] + [tuple(o) for o in order]
    coded = [f"{x}{k}" for k in range(len(columns)) for x in "nv"]
    by, tie = coded[: 2 * len(group)], coded[: 2 * (len(group) + ties)]
    held = rows.select(*dict.fromkeys(c for c, _, _ in columns))
    held, _, file, row = located(held)
    keyed = held.select(*[x for k, c in enumerate(columns) for x in _coded(*c, str(k))], F.col(file).alias("file"), F.col(row).alias("row"))

    counts = stored(keyed.groupBy(*by).agg(F.count("*").alias("many")), "ranking-groups")
    total = counts.agg(F.coalesce(F.sum("many"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(F.col("many") <= light, F.col("many"))), F.lit(0)).alias("light")).first()
    heavy, hot = counts.where(F.col("many") > light).select(*by, "many"), F.col("many") * HOT > total["all"]
    few = F.broadcast(heavy.where(hot).select(*by))  # at most HOT of them
    many = heavy.where(~hot).select(*by, F.lit(True).alias("found"))
    rest = keyed.join(few, by, "left_anti")
    large = keyed.join(few, by, "left_semi")
    if not many.isEmpty():  # heavy groups that hold less than one of HOT rows: by a shuffle, no task gets too much
        routed = rest.join(many.hint("merge"), by, "left")
        rest, large = routed.where("found is null").drop("found"), large.unionByName(routed.where("found").drop("found"))

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bins = max(4 * parts, -(-total["light"] // size))
    schema = ", ".join(f"{c} {'tinyint' if c[0] == 'n' else 'long'}" for c in coded)
    small = rest.select(*coded, F.pmod(F.xxhash64(*by), F.lit(bins)).alias("bin")).groupBy("bin")
    small = small.applyInPandas(_lexsorted(coded, tie, by, most, place), f"{schema}, at long, first long, tied long")

    if not heavy.isEmpty():
        keys = [*coded, "file", "row"]
        sorted_rows = large.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select(*coded, F.spark_partition_id().alias("slot"))
        sorted_rows = stored(sorted_rows.mapInArrow(_numbered(by), f"{schema}, slot int, at long"), "ranking-sorted")
        before = F.sum("n").over(Window.partitionBy(*by).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
        offsets = sorted_rows.groupBy("slot", *by).agg(F.max("at").alias("n")).withColumn("before", before).where("before > 0").drop("n")
        offsets = F.broadcast(offsets)  # one row a partition at most: the group that it begins with, if that goes on from another
        placed = sorted_rows.join(offsets, ["slot", *by], "left").withColumn("at", F.col("at") + F.coalesce("before", F.lit(0))).drop("slot", "before")
        together = stored(placed.groupBy(*tie).agg(F.min("at").alias("first"), F.count("*").alias("tied")), "ranking-ties", 4)
        wanted, kept = placed, together.withColumn("many", F.col("tied"))
        if most is not None:
            if place == "row":
                wanted, kept = wanted.where(F.col("at") <= most), kept.withColumn("many", F.least("many", F.lit(most)))
            else:
                kept = kept.where((F.col("first") if place == "min" else F.col("first") + F.col("tied") - 1) <= most)
        small = small.unionByName(joined(wanted, kept, tie).select(small.columns))

    at = {"row": F.col("at"), "min": F.col("first"), "max": F.col("first") + F.col("tied") - 1}[place]
    return small.select(*[_decoded(*c, str(k)) for k, c in enumerate(columns)], F.col("at").alias("pos"), at.alias("place"), "tied")


#: Sales whose checksum this divides make the one group of their lines.
POOLED = 5
LINE_ORDER = (("bucket", True, True), ("percent", False, True), ("sale_id", False, False), ("line_no", False, False), ("quantity", False, False), ("amount_cents", False, False))


def ranked_lines(lines: DataFrame, most: int | None = 2, **parameters) -> DataFrame:
    """Lines of sales ranked within vendor, part of the items and month, by size of the order and discount.

    Returns vendor_id, part, month, pos, place, sale_id, line_no, quantity, percent, amount_cents, tied of lines with
    place up to most (None: all). Defined cases: a line without item, day, sale or figures has nulls there, its part
    or month is -1; an item's part is never negative; percent's nulls come first, as quantity's do.
    """
    pooled = F.coalesce(F.crc32(F.col("sale_id").cast("string").cast("binary")) % POOLED == 0, F.lit(False))
    month = 100 * F.year("shipped_at") + F.month("shipped_at")
    one = lambda value: F.when(pooled, -1).otherwise(value).cast("long")
    keyed = lines.select(
        one(F.col("vendor_id")).alias("vendor_id"), one(F.coalesce(F.pmod("item_id", F.lit(5)), F.lit(-1))).alias("part"), one(F.coalesce(month, F.lit(-1))).alias("month"),
        F.floor(F.col("quantity") / 10).alias("bucket"), F.floor(100 * F.col("discount") + 0.5).alias("percent"),
        F.col("sale_id").cast("long").alias("sale_id"), F.col("line_no").cast("long").alias("line_no"), F.col("quantity").cast("long").alias("quantity"), F.floor(100 * F.col("amount") + 0.5).alias("amount_cents"),
    )
    out = ranked(keyed, ["vendor_id", "part", "month"], LINE_ORDER, 2, most=most, **parameters)
    return out.select("vendor_id", "part", "month", "pos", "place", "sale_id", "line_no", "quantity", "percent", "amount_cents", "tied")

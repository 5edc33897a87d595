"""Statutes of any length: what structure computes with windows over a document, as a scan over its segments.

A segment is a document's rows with one value of seq // size, so it has at most size rows. What a row sees of the rows before it is
what it sees within its segment, put after what the segments before leave: the last law, the last marker, the
last heading or article, and counters. Each segment is summed up in one row; windows over these few rows give
each segment's carry, which is joined back. Whether a segment's first article goes on with the block before depends
on the carry alone, as no marker lies between, so one scan settles the numbers of all blocks.

No task holds more of a document than a segment and one row for each segment: a document of a thousand million rows has
15,000 segments. Provisions, uids and footnotes, which structure numbers within articles, uids and counters, are numbered
within segments of these in the same way.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexflow.functions.text import strip
from lexflow.operators import structure
from lexflow.schemas import HEADINGS, SUB_UNITS
from lexflow.session import discard, stored

#: Rows of a segment at most.
SIZE = 65_536

PLACE = ["doc_id", "segment"]

#: What provisions are made of.
OWN = ["doc_id", "segment", "block_id", "seq", "is_art", "kept", "unit_type", "identifier", "text", "runs", "has_strike", "number", "law_name", "in_adt", "footnote_ids", "base_uid"]


def _before(*group: str):
    return Window.partitionBy(*group).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)


def _cut(rows: DataFrame, size: int) -> DataFrame:
    return rows.withColumn("segment", F.floor(F.col("seq") / size))


def _neighbours(rows: DataFrame) -> DataFrame:
    """What structure.neighbours adds; the first and last row of a segment look at those beside it."""
    own, segments = Window.partitionBy(*PLACE).orderBy("seq"), Window.partitionBy("doc_id").orderBy("segment")
    ends = rows.groupBy(*PLACE).agg(F.min_by(F.struct("unit_type", "text"), "seq").alias("first"), F.max_by("takes", "seq").alias("last"))
    ends = ends.select(*PLACE, F.lag("last").over(segments).alias("__takes"), F.lead("first").over(segments).alias("__next"))
    inside = F.lead("unit_type").over(own).isNotNull()
    rows = rows.join(ends, PLACE).withColumns(
        {
            "taken": (F.col("unit_type") == "SUBTITLE") & F.coalesce(F.lag("takes").over(own), F.col("__takes"), F.lit(False)),
            "next_type": F.coalesce(F.lead("unit_type").over(own), F.col("__next.unit_type")),
            "next_text": F.when(inside, F.lead("text").over(own)).otherwise(F.col("__next.text")),
        }
    )
    return rows.drop("__takes", "__next")


def _inside(events: DataFrame) -> DataFrame:
    """events with what each row sees of its own segment: law, marker, last key event before and at it, counters."""
    event = F.col("event")
    so_far = Window.partitionBy(*PLACE).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*PLACE).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda value, over: F.last(value, ignorenulls=True).over(over)
    count = lambda condition: F.sum(F.when(condition, 1).otherwise(0)).over(so_far)
    art = F.coalesce(event == "ARTIGO", F.lit(False))
    flush = F.coalesce(event.isin("NORMA", "ADT", "DGT", *HEADINGS, "SUBTITLE"), F.lit(False))
    rows = events.withColumns({"is_art": art, "is_key": flush | art})
    key = F.when(F.col("is_key"), F.struct("is_art", F.when(F.col("is_art"), F.col("art_number")).alias("art_number")))
    rows = rows.withColumns(
        {
            "__law": last(F.when(event == "NORMA", strip(F.regexp_extract("text", structure.LAW, 1))), so_far),
            "__adt": last(F.when(event == "NORMA", False).when(event.isin("ADT", "DGT"), True), so_far),
            "__prev": last(key, earlier),
            "__key": last(key, so_far),
        }
    )
    rows = rows.withColumn("__goes_on", F.col("is_art") & F.coalesce(F.col("__prev.is_art") & (F.col("__prev.art_number") == F.col("art_number")), F.lit(False)))
    return rows.withColumns({"__blocks": count(F.col("is_art") & ~F.col("__goes_on")), "__runs": count(F.col("is_art")), **{f"__{name}": count(of) for name, of in structure.sections().items()}})


def _carries(inside: DataFrame) -> DataFrame:
    """For each segment, what those before it leave, and whether its first article goes on with their last one."""
    counters = ["__blocks", "__runs", *[f"__{name}" for name in structure.sections()]]
    ends = F.max_by(F.struct("__law", "__adt", "__key", *counters), "seq").alias("end")
    first = F.min(F.when(F.col("is_key"), F.struct("seq", "is_art", "art_number"))).alias("first")
    sums = inside.groupBy(*PLACE).agg(ends, first).select(*PLACE, "first", "end.*")
    last = lambda name: F.last(name, ignorenulls=True).over(_before("doc_id"))
    sums = sums.withColumn("key", last("__key"))
    sums = sums.withColumn("goes_on", F.coalesce(F.col("first.is_art") & F.col("key.is_art") & (F.col("first.art_number") == F.col("key.art_number")), F.lit(False)))
    sums = sums.withColumn("__blocks", F.col("__blocks") - F.col("goes_on").cast("int"))
    totals = [F.coalesce(F.sum(c).over(_before("doc_id")), F.lit(0)).alias(c.replace("__", "c_")) for c in counters]
    return sums.select(*PLACE, last("__law").alias("c_law"), last("__adt").alias("c_adt"), F.col("key").alias("c_key"), F.col("goes_on").alias("c_goes_on"), *totals)


def states(classified: DataFrame, size: int = SIZE) -> DataFrame:
    """The states of structure.states, with segment and the section counters n_tit, n_cap, n_sec, n_subsec, n_norma.

    They are stored, as all that reads them reads them more than once; a table of the rows by segment goes once they are there. What rows see within
    their segment is made for the carries and again for the rows: it is where the carries are joined, and stored it would be exchanged once more, some three times as wide.
    """
    cut = stored(_cut(classified, size), "segments")
    inside = _inside(structure.events(cut, _neighbours))
    rows = inside.join(_carries(inside), PLACE)
    key = F.coalesce("__key", "c_key")
    rows = rows.withColumns({"law_name": F.coalesce("__law", "c_law", F.lit("")), "in_adt": F.coalesce("__adt", "c_adt", F.lit(False))})
    numbered = lambda art: F.concat(F.when(F.col("in_adt"), "ADT").otherwise(""), art)
    rows = rows.withColumns(
        {
            "number": F.when(F.col("is_art"), numbered(F.col("art_number"))),
            "merges": F.col("is_art") & F.when(F.col("__prev").isNull(), F.col("c_goes_on")).otherwise(F.col("__goes_on")),
            "block_id": F.col("c_blocks") + F.col("__blocks") - F.when(F.col("__key").isNotNull(), F.col("c_goes_on").cast("int")).otherwise(0),
            "art_run": F.col("c_runs") + F.col("__runs"),
            "open": F.when(key.isNotNull(), F.when(key["is_art"], numbered(key["art_number"])).otherwise("")),
            **{f"n_{name}": F.col(f"c_{name}") + F.col(f"__{name}") for name in structure.sections()},
        }
    )
    kept = F.col("is_art") | (F.col("event").isin(*SUB_UNITS) & (F.coalesce("open", F.lit("")) != ""))
    rows = rows.withColumn("kept", F.coalesce(kept, F.lit(False)))
    states = stored(rows.drop(*[c for c in rows.columns if c.startswith(("__", "c_"))]), "states")
    discard(cut)
    return states


def headings(states: DataFrame) -> DataFrame:
    """structure.headings of segmented states."""
    return structure.headings(states, {name: F.col(f"n_{name}") for name in structure.sections()})


def _with_carry(rows: DataFrame, group: list[str], sums: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """rows with what the segments before theirs leave in their group: sums by segment, and from these the carries by window."""
    totals = rows.groupBy(*group, "segment").agg(*[c.alias(k) for k, c in sums.items()])
    return rows.join(totals.select(*group, "segment", *[c.over(_before(*group)).alias(k) for k, c in carry.items()]), [*group, "segment"])


def _latest(rows: DataFrame) -> DataFrame:
    """structure.latest within segments of an article's run."""
    at = {k: F.when(F.col("depth") <= k, F.struct("depth", "suffix")) for k in range(4)}
    run = ["doc_id", "art_run"]
    sums = {f"s{k}": F.max(F.when(F.col("depth") <= k, F.struct("seq", "depth", "suffix"))) for k in at}
    found = lambda k: F.when(F.col(f"s{k}").isNotNull(), F.struct(F.col(f"s{k}.depth").alias("depth"), F.col(f"s{k}.suffix").alias("suffix")))
    rows = _with_carry(rows, run, sums, {f"__c{k}": F.last(found(k), ignorenulls=True) for k in at})
    over = Window.partitionBy(*run, "segment").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({f"at{k}": F.coalesce(F.last(x, ignorenulls=True).over(over), f"__c{k}") for k, x in at.items()}).drop(*[f"__c{k}" for k in at])


def _unique_uids(rows: DataFrame) -> DataFrame:
    """structure.unique_uids within segments of the rows with one base.

    The rows are stored before and after: they are read twice, so that their own exchanges would be made twice, and each step's exchanges go
    before those of the next. Of the states, what provisions have is all that is stored.
    """
    same, rows = ["doc_id", "base_uid"], stored(rows.select(*[c for c in OWN if c in rows.columns]), "bases")
    bases = rows
    child, art = F.when(~F.col("is_art"), 1).otherwise(0), F.col("is_art").cast("int")
    rows = _with_carry(rows, same, {"children": F.sum(child), "arts": F.max(art)}, {"__n": F.sum("children"), "__a": F.max("arts")})
    over = Window.partitionBy(*same, "segment").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    k = zero(F.sum(child).over(over)) + zero("__n") + F.greatest(zero(F.max(art).over(over)), zero("__a"))
    rows = rows.withColumn("__k", k)
    rows = rows.withColumn("uid", F.when(F.col("is_art") | (F.col("__k") == 0), F.col("base_uid")).otherwise(F.concat("base_uid", F.lit("_"), (F.col("__k") + 1).cast("string")))).drop("__k", "__n", "__a")
    rows = stored(rows, "uids")
    discard(bases)
    return rows


def _caputs(rows: DataFrame, states: DataFrame) -> DataFrame:
    """structure.caputs by a group maximum, read from states, as what rows come from would be read again."""
    last = states.where("is_art").groupBy("doc_id", "block_id").agg(F.max("seq").alias("caput_seq"))
    return rows.join(last, ["doc_id", "block_id"], "left")


def units(states: DataFrame) -> DataFrame:
    """structure.units of segmented states."""
    return structure.units(states, _latest, _unique_uids, _caputs)


def footnotes(states: DataFrame, footnote_defs: DataFrame, size: int = SIZE) -> DataFrame:
    """structure.footnotes, numbered within segments of each counter."""

    def numbers(notes: DataFrame) -> DataFrame:
        counter = ["doc_id", "is_private", "counter"]
        notes = _with_carry(_cut(notes, size), counter, {"n": F.count("*")}, {"__n": F.sum("n")})
        own = F.row_number().over(Window.partitionBy(*counter, "segment").orderBy("seq", "pos"))
        return notes.withColumn("number", (own + F.coalesce("__n", F.lit(0))).cast("int"))

    return structure.footnotes(states, footnote_defs, numbers)

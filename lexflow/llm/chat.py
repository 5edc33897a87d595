"""Chat transcripts from event logs: partition by conversation, sort by sequence, fold, render.

Events of a log: ``message`` (opens a turn with a role and text), ``delta`` (appends streamed text),
``edit`` (replaces the turn's text), ``regenerate`` (clears it; the deltas that follow rebuild it) and
``delete`` (drops the turn). A turn is folded by its own group, and places of turns in a transcript are
running sums over a window, so a long conversation is sorted and spilled, and only rendering holds it whole.

Template: each turn is ``<s>role\\ntext</s>``. In roles and texts the backslash, ``<`` and ``[`` (and in
roles the line feed) become a backslash and a digit, so no control string can occur inside; unescape() is the
exact inverse. The loss mask is a list of spans of the transcript, one for each assistant text.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>", "</s>"
#: What stands for each character; the backslash is escaped first and restored last.
ESCAPES = (("\\", "\\0"), ("<", "\\2"), ("[", "\\1"), ("\n", "\\3"))


def escape(text: Column, role: bool = False) -> Column:
    for plain, code in ESCAPES if role else ESCAPES[:-1]:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, role: bool = False) -> Column:
    for plain, code in reversed(ESCAPES if role else ESCAPES[:-1]):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def events_of(messages: DataFrame) -> DataFrame:
    """A log with one message event for each row (conv_id, turn, role, text); rows of the same turn stay apart."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("seq"), "role", "text").select("conv_id", "seq", F.col("seq").alias("turn"), F.lit("message").alias("kind"), "role", "text")


#: Code points of a streamed piece of text.
DELTA = 64


def history_of(messages: DataFrame, learn: str = "assistant", delta: int = DELTA) -> DataFrame:
    """A log (conv_id, seq, turn, kind, role, text) as a chat service would have written it, that ends in these messages.

    Texts of role learn are streamed in pieces; of four such turns one is first streamed otherwise and regenerated, and one
    is first a draft and edited. Each conversation also has a turn that was taken back. Other texts are messages as they are.
    """
    rows = events_of(messages)
    draft = F.concat(F.lit("draft of "), F.reverse("text"))
    pieces = lambda text: F.transform(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % delta), 0), lambda x: F.struct(F.lit("delta").alias("kind"), x.alias("text")))
    one = lambda kind, text: F.array(F.struct(F.lit(kind).alias("kind"), (F.lit(text) if isinstance(text, str) else text).alias("text")))
    opened, way = one("message", ""), F.col("turn") % 4
    streamed = F.concat(opened, pieces(F.col("text")))
    again = F.concat(opened, pieces(draft), one("regenerate", ""), pieces(F.col("text")))
    edited = F.concat(one("message", draft), one("edit", F.col("text")))
    parts = F.when(F.col("role") != learn, one("message", F.col("text"))).when(way == 1, again).when(way == 3, edited).otherwise(streamed)
    log = rows.select("conv_id", "turn", "role", F.posexplode(parts).alias("k", "e"))
    log = log.select("conv_id", F.shiftleft("turn", 32).alias("base"), "turn", "k", F.col("e.kind").alias("kind"), F.when(F.col("e.kind") == "message", F.col("role")).otherwise("").alias("role"), F.col("e.text").alias("text"))
    taken = F.array(F.struct(F.lit("message").alias("kind"), F.lit(learn).alias("role"), F.lit("taken back").alias("text")), F.struct(F.lit("delete").alias("kind"), F.lit("").alias("role"), F.lit("").alias("text")))
    back = rows.where("turn = 1").select("conv_id", F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("turn"), F.posexplode(taken).alias("k", "e")).select("conv_id", "base", "turn", "k", "e.kind", "e.role", "e.text")
    return log.unionByName(back).select("conv_id", (F.col("base") + F.col("k")).alias("seq"), "turn", "kind", "role", "text")


def final_messages(events: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after all events (conv_id, seq, turn, kind, role, text), in order of seq.

    A turn's role is that of its last message event. Events of a turn without a message event have role ''. A
    null text is empty; an event of another kind changes nothing.
    """
    log = events.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("log"))
    # what counts starts at the last event that sets the whole text; later deltas are joined in order
    sets = F.array_max(F.transform(F.col("log"), lambda e, i: F.when(e["kind"].isin("message", "edit", "regenerate"), i).otherwise(F.lit(-1))))
    gone = F.array_max(F.transform(F.col("log"), lambda e, i: F.when(e["kind"] == "delete", i).otherwise(F.lit(-1))))
    live = F.filter(F.col("log"), lambda e, i: (i >= F.col("sets")) & e["kind"].isin("message", "edit", "delta"))
    named = F.filter(F.col("log"), lambda e: e["kind"] == "message")
    rows = log.withColumns({"sets": sets, "gone": gone}).where("gone < 0 or gone < sets")
    return rows.select("conv_id", "turn", F.coalesce(F.get(named, F.size(named) - 1)["role"], F.lit("")).alias("role"), F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"))


def transcripts(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """conv_id, formatted and loss (spans of the transcript, in code points, that hold texts of role learn) of each conversation.

    messages has conv_id, turn, role and text without nulls in the last three. Rows whose conv_id is null
    are one conversation; no rows give no rows; other columns play no part.
    """
    head = F.concat(F.lit(OPEN), escape(F.col("role"), role=True), F.lit("\n"))
    body = escape(F.col("text"))
    order = Window.partitionBy("conv_id").orderBy("turn")
    parts = messages.select("conv_id", "turn", "role", head.alias("head"), body.alias("body"))
    size = F.length("head") + F.length("body") + len(CLOSE)
    placed = parts.withColumn("at", F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    begin = F.col("at") + F.length("head")
    span = F.when(F.col("role") == learn, F.struct(begin.alias("begin"), (begin + F.length("body")).alias("end")))
    piece = F.struct("at", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), span.alias("span"))
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("parts"))
    spans = F.filter(F.transform("parts", lambda p: p["span"]), lambda s: s.isNotNull())
    return whole.select("conv_id", F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("formatted"), spans.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss_texts and the length of each transcript, parsed from the transcript and its mask."""
    inner = F.filter(F.split("formatted", CLOSE), lambda t: t != "")
    turns = F.transform(inner, lambda t: F.struct(unescape(F.substring_index(F.substr(t, F.lit(len(OPEN) + 1)), "\n", 1), role=True).alias("role"), unescape(F.substr(t, F.length(F.substring_index(t, "\n", 1)) + 2)).alias("text")))
    texts = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int"))))
    return formatted.select("conv_id", turns.alias("turns"), texts.alias("loss_texts"), F.length("formatted").cast("long").alias("formatted_chars"))


def digests(parsed: DataFrame) -> DataFrame:
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return parsed.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def formatted_logs(events: DataFrame) -> DataFrame:
    """One row per conversation of a log (conv_id, seq, turn, kind, role, text), as formatted_chats; one whose turns are all deleted has none."""
    return digests(read_back(transcripts(final_messages(events))))


def formatted_chats(conversations: DataFrame) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text): n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The rows become a log of streamed, regenerated and edited turns first (history_of), which is folded. All are read back from the rendered transcript. Defined cases: null texts and roles are empty; turns that
    are null come first; rows of the same turn are turns of their own, by role and text; rows without conv_id are one conversation;
    no rows give no rows; other columns play no part.
    """
    return formatted_logs(history_of(conversations))

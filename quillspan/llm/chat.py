"""Chat formatting in budgeted windows, in DataFrame functions only.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``.  In roles and texts a backslash is doubled and ``<|`` becomes
``<\\|`` (in roles also a line break becomes ``\\/``), so ``<|`` only ever begins a control string and every text comes back.

A turn's size is an upper bound of its tokens, marks and escapes included, found without running a tokenizer.  A byte-level
BPE makes at most one token of a byte, and one token of a run of ASCII letters (with a space before it) that it has in its
vocabulary; letters after an apostrophe are counted as bytes, for contractions are cut elsewhere.  ``vocabulary`` lists those
runs; without it sizes are bytes.  A turn ends in a line break, so the sizes of turns add up.

Prefix sums of the sizes lay a conversation out on a line, cut into segments of ``segment`` budgets.  In a segment, spans are
taken greedily: a turn opens a new window if the budget does not hold it.  A window begins with the conversation's system
turn (its first turn, if its role is system) and up to ``history`` turns of the segment before it, as long as they have
``history_tokens`` in all; these are repeated.  What is repeated counts: a window of several turns never passes the budget.  If a
turn is so long that nothing may come with it, the history is left out, then the system turn.  The loss mask has the texts
of the assistant turns that are new in the window: repeated targets are masked, so each target is learned once.

Result: conv_id, window (in order), formatted, fresh_at (code points before the first new turn), loss (spans of code
points, end exclusive), n_turns (new ones), tokens (the bound, of the whole window).

Turns are sorted by (turn, role, text).  A row gathers at most a segment, that is ``segment`` budgets and one turn, so a
conversation of any length only costs its sort.  Nulls: null texts and roles are empty; a null conv_id is a conversation; null
turns come first.  Very long texts: a turn longer than the budget is a window of its own.  Repeated rows are turns each; ties do
not matter, for tied turns are equal.  Empty table: no windows.  Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>"
_RUN = "'\\p{L}+| ?\\p{L}+"
_TURN = "<\\|im_start\\|>([^\\n]*)\\n((?s:.*?))<\\|im_end\\|>\\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "\\\\([\\\\|])", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\/"))


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, "(?<!\\\\)((?:\\\\\\\\)*)\\\\/", "$1\n"))


#: Slots of the table of known runs.
_SLOTS = 1 << 16


def vocabulary(path: str) -> list[str]:
    """The runs of ASCII letters, with or without a space before, that the tokenizer makes one token of."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    runs = sorted(x.replace("Ġ", " ") for x in t.get_vocab() if re.fullmatch("Ġ?[A-Za-z]+", x))
    return [x for x, e in zip(runs, t.encode_batch(runs, add_special_tokens=False), strict=True) if len(e.ids) == 1]


def tokens_of(text: Column, known: list[str]) -> Column:
    """An upper bound of the text's tokens."""
    size = F.octet_length(text).cast("long")
    if not known:
        return size
    slots = [""] * _SLOTS
    for x in known:
        slots[zlib.crc32(x.encode()) % _SLOTS] += f",{x},"
    table = F.split(F.lit(";".join(slots)), ";")  # folded to a literal once
    saved = lambda x: F.when(F.get(table, (F.crc32(x.cast("binary")) % _SLOTS).cast("int")).contains(F.concat(F.lit(","), x, F.lit(","))), F.length(x) - 1).otherwise(0)
    return size - F.aggregate(F.regexp_extract_all(text, F.lit(_RUN), 0), F.lit(0).cast("long"), lambda a, x: a + saved(x))


def format_chats(turns: DataFrame, known: list[str] = (), budget: int = 2048, history: int = 2, history_tokens: int = 512, segment: int = 64) -> DataFrame:
    """Windows of turns(conv_id, turn, role, text); ``known`` is the tokenizer's ``vocabulary``."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("body", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(f"{END}\n")))
    rows = rows.withColumn("size", tokens_of(F.col("body"), known))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("before", F.sum("size").over(so_far) - F.col("size"))
    first = F.when(F.col("role") == "system", F.struct("body", "size"))
    rows = rows.withColumn("system", F.first(F.when(F.col("n") == 1, first)).over(so_far))
    rows = rows.withColumn("segment", F.floor(F.col("before") / (segment * budget)))
    opens = F.coalesce(F.lag("segment").over(order) != F.col("segment"), F.lit(True))

    at = F.length(F.lit(START)) + F.length(escape_role(F.col("role"))) + 1
    target = F.when(F.col("role") == "assistant", F.struct(at.alias("at"), F.length(escape(F.col("text"))).alias("length")))
    turn = F.struct("n", "body", target.alias("target"), "size", F.when(opens, F.col("system")).alias("system"))
    found = rows.select("conv_id", "segment", turn.alias("turn")).groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    found = found.withColumn("system", F.col("turns")[0]["system"])

    nothing, long = F.lit(0).cast("long"), lambda x: F.lit(x).cast("long")
    first_n = F.col("turns")[0]["n"]

    def head(x: Column, i: Column) -> Column:
        """What is repeated before the i-th turn if it opens a window: with the system turn or not, turns of history, their size."""
        system = F.when(F.col("system").isNotNull() & (x["n"] > 1) & (F.col("system")["size"] + x["size"] <= budget), F.col("system")["size"]).otherwise(0)
        room = F.least(long(history_tokens), budget - system - x["size"])
        free = i - F.when(F.col("system").isNotNull() & (first_n == 1), 1).otherwise(0)
        size, back = nothing, F.struct(F.lit(0).alias("turns"), nothing.alias("size"))
        for k in range(1, history + 1):
            size = size + F.coalesce(F.get(F.col("turns"), i - k)["size"], nothing)
            back = F.when((free >= k) & (size <= room), F.struct(F.lit(k).alias("turns"), size.alias("size"))).otherwise(back)
        return F.struct((system > 0).alias("system"), back["turns"].alias("turns"), (system + back["size"]).alias("size"))

    headed = F.transform("turns", lambda x, i: F.struct(x["size"].alias("size"), head(x, i).alias("head"), i.alias("i")))
    found = found.withColumn("sizes", headed)
    start = F.struct(F.array().cast("array<int>").alias("opens"), F.lit(None).cast("long").alias("used"))

    def step(a: Column, x: Column) -> Column:
        fits = F.coalesce(a["used"] + x["size"] <= budget, F.lit(False))
        return F.struct(F.when(fits, a["opens"]).otherwise(F.concat(a["opens"], F.array(x["i"]))).alias("opens"), F.when(fits, a["used"] + x["size"]).otherwise(x["head"]["size"] + x["size"]).alias("used"))

    found = found.withColumn("opens", F.aggregate("sizes", start, step, lambda a: a["opens"]))
    spans = F.transform("opens", lambda o, k: F.struct(k.alias("k"), o.alias("at"), F.get(F.col("sizes"), o)["head"].alias("head"), F.slice("turns", o + 1, F.coalesce(F.get(F.col("opens"), k + 1), F.size("turns")) - o).alias("new")))
    bodies = lambda x: F.array_join(F.transform(x, lambda y: y["body"]), "")
    past = lambda x: F.concat(F.when(x["head"]["system"], F.col("system")["body"]).otherwise(""), bodies(F.slice("turns", x["at"] - x["head"]["turns"] + 1, x["head"]["turns"])))
    windows = F.transform(spans, lambda x: F.struct(x["k"].alias("k"), past(x).alias("past"), x["new"].alias("new"), x["head"]["size"].alias("repeated")))
    out = found.select("conv_id", "segment", F.explode(windows).alias("x")).select("conv_id", (F.col("segment") * _SLOTS + F.col("x.k")).cast("long").alias("window"), F.col("x.past").alias("past"), F.col("x.new").alias("new"), F.col("x.repeated").alias("repeated"))
    out = out.withColumn("fresh_at", F.length("past"))
    spans = F.aggregate(
        F.transform("new", lambda x: F.struct(F.length(x["body"]).alias("length"), x["target"].alias("target"))),
        F.struct(F.col("fresh_at").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda a, x: F.struct((a["at"] + x["length"]).alias("at"), F.when(x["target"].isNull(), a["spans"]).otherwise(F.concat(a["spans"], F.array(F.struct((a["at"] + x["target"]["at"]).alias("start"), (a["at"] + x["target"]["at"] + x["target"]["length"]).alias("end"))))).alias("spans")),
    )
    size = F.aggregate("new", F.col("repeated").cast("long"), lambda a, x: a + x["size"])
    return out.select("conv_id", "window", F.concat("past", bodies(F.col("new"))).alias("formatted"), "fresh_at", spans["spans"].alias("loss"), F.size("new").alias("n_turns"), size.alias("tokens"))


def read_back(windows: DataFrame) -> DataFrame:
    """Of formatted windows: conv_id, window, turns (role, text; each turn in its first window only) and the loss texts."""
    new = F.substring("formatted", F.col("fresh_at") + 1, F.length("formatted"))
    parts = F.arrays_zip(F.regexp_extract_all(new, F.lit(_TURN), 1).alias("role"), F.regexp_extract_all(new, F.lit(_TURN), 2).alias("text"))
    turns = F.transform(parts, lambda x: F.struct(unescape_role(x["role"]).alias("role"), unescape(x["text"]).alias("text")))
    learned = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return windows.select("conv_id", "window", "formatted", turns.alias("turns"), learned.alias("learned"))


def digest(windows: DataFrame) -> DataFrame:
    """One row a conversation, from its windows alone: what the turns and the loss mask give back."""
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    rows = read_back(windows).select("conv_id", "window", F.size("turns").alias("n"), told.alias("told"), F.array_join("learned", "").alias("learned"), F.length("formatted").alias("length"))
    by = rows.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), F.sort_array(F.collect_list(F.struct("window", "told", "learned"))).alias("w"), F.sum("length").cast("long").alias("formatted_chars"), F.count("*").alias("n_windows"))
    joined = lambda name: F.array_join(F.transform("w", lambda x: x[name]), "")
    told, learned = joined("told"), joined("learned")
    return by.select("conv_id", "n_turns", F.sha2(told, 256).alias("turns_sha256"), F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"), "formatted_chars", "n_windows")

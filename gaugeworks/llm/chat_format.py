r"""Chat formatting by grammar round trip; DataFrame functions only.

A turn is rendered as `<s>[role]\ntext</s>\n`. Rendering starts from the plain texts. The rendered conversation is parsed back by a
deterministic parser, and every turn whose text holds a control string or comes back different is escaped; if the conversation still differs,
all its turns are escaped, which is a bijection: `\` becomes `\\`, and `<` and `[` (in roles `]` too) get a `\` behind them, so that no
control string survives in a text. A conversation that would still differ stops the run.

A null text or role is empty. Turns of one number are ordered by role, then text. Rows of a null conversation form one conversation. An
empty table gives an empty result. Conversations are whole by nature: one is rendered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings that steer chat models, escaped wherever a text holds them.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|")
OPEN, MID, CLOSE = "<s>[", "]\n", "</s>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), r"([<\[])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\|\\(\\)", "$1$2")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(role, r"\\", r"\\\\"), r"([<\[\]])", r"$1\\")


def unescape_role(role: Column) -> Column:
    return F.regexp_replace(role, r"([<\[\]])\\|\\(\\)", "$1$2")


def _render(turns: Column, flags: Column) -> Column:
    """The rendered turns; flags: which texts are escaped."""
    return F.zip_with(turns, flags, lambda t, f: F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit(MID), F.when(f, escape(t["text"])).otherwise(t["text"]), F.lit(CLOSE)))


def parse(formatted: Column) -> Column:
    """The formatted text to its turns, array<struct<role, text>>. Text outside the grammar comes back as a turn with null role."""
    parts = F.filter(F.split(formatted, r"(?<=</s>\n)(?=<s>\[)"), lambda p: p != "")
    head = r"(?s)^<s>\[((?:[^\]]++|\]\\)*+)\]\n"

    def turn(p):
        lead = F.regexp_extract(p, head, 0)
        good = (F.length(lead) > 0) & p.endswith(CLOSE)
        text = p.substr(F.length(lead) + 1, F.length(p) - F.length(lead) - len(CLOSE))
        return F.struct(F.when(good, unescape_role(F.regexp_extract(p, head, 1))).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation: its id, `formatted`, `loss_spans` (code points of the assistant texts in it) and `n_escaped`, the escaped turns."""
    entry = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    chats = rows.groupBy(F.col(conv_col).alias("__conv")).agg(F.sort_array(F.collect_list(entry)).alias("__all"))
    chats = chats.select("__conv", F.transform("__all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("__turns"))
    turns = F.col("__turns")
    none, every = F.transform(turns, lambda t: F.lit(False)), F.transform(turns, lambda t: F.lit(True))
    chats = chats.withColumn("__back", parse(F.array_join(_render(turns, none), "")))

    def conflict(t, back):
        holds = t["text"].contains(CONTROL[0])
        for c in CONTROL[1:]:
            holds = holds | t["text"].contains(c)
        return holds | ~F.coalesce(back["text"] == t["text"], F.lit(False))

    # a broken text may come back as more turns than there are
    chats = chats.withColumn("__flags", F.zip_with(turns, F.slice("__back", F.lit(1), F.size(turns)), conflict))
    chats = chats.withColumn("__parts", _render(turns, F.col("__flags")))
    same = parse(F.array_join("__parts", "")) == turns
    chats = chats.withColumn("__flags", F.when(same, F.col("__flags")).otherwise(every))
    chats = chats.withColumn("__parts", _render(turns, F.col("__flags"))).withColumn("formatted", F.array_join("__parts", ""))
    checked = F.when(F.coalesce(parse(F.col("formatted")) == turns, F.lit(False)), F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not survive its round trip")).cast("string"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def span(state, x):
        end = state["at"] + F.length(x["part"])
        lo = state["at"] + len(OPEN) + F.length(escape_role(x["role"])) + len(MID)
        spans = F.when(x["role"] == "assistant", F.concat(state["spans"], F.array(F.struct(lo.cast("int").alias("start"), (end - len(CLOSE)).cast("int").alias("end"))))).otherwise(state["spans"])
        return F.struct(end.cast("int").alias("at"), spans.alias("spans"))

    pairs = F.zip_with("__parts", turns, lambda p, t: F.struct(p.alias("part"), t["role"].alias("role")))
    return chats.select(F.col("__conv").alias(conv_col), checked.alias("formatted"), F.aggregate(pairs, start, span)["spans"].alias("loss_spans"), F.size(F.filter("__flags", lambda f: f)).cast("long").alias("n_escaped"))


def digest(chats: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from them."""
    back = chats.withColumn("__turns", parse(F.col("formatted")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr(s["start"] + 1, s["end"] - s["start"]))), "")
    back = back.withColumn("__loss", loss)
    whole = F.array_join(F.transform("__turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("__turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("__loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_escaped",
    )


def probe(rows: DataFrame) -> DataFrame:
    """`rows` with conversation -1, whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    added = rows.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return rows.select("conv_id", "turn", "role", "text").unionByName(added)

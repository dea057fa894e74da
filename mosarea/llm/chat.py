r"""Conversations as training text, checked by reading them back.

Grammar of the output, one conversation per row::

    conversation := turn*
    turn         := "### " role ": " body "</turn>\n"

A body or role is either the plain text or its escaped form, in which a
backslash is written ``\b``, ``<`` is ``\l`` and ``#`` is ``\h``. The parser cuts at
every ``</turn>``, takes the last ``### `` of a piece as its header, which ends at the
first ``: ``, and decodes the three escapes, whatever form was written. A control
string inside a plain text is thus always read as control, and the text is escaped. Rendering is a round trip: a turn stays plain only
if parsing it alone gives it back; a conversation is accepted only if parsing the whole
gives all its turns back, and otherwise all its turns are escaped.

Everything is built-in functions; the only shuffle groups turns by conversation. A
conversation is one output text, so its turns must meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

HEADER, HEADER_END, MARK, TURN_END = "### ", ": ", "</turn>", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))


def escape(text: Column) -> Column:
    """No ``<`` and no ``#`` is left, and every backslash starts one of the three codes."""
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def escape_role(role: Column) -> Column:
    """A role that holds a colon would end its header early; it becomes ``\\c``."""
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\c"), F.lit(":")))


def _render(turn: Column, escaped: Column) -> Column:
    return F.concat(
        F.lit(HEADER),
        F.when(escaped, escape_role(turn["role"])).otherwise(turn["role"]),
        F.lit(HEADER_END),
        F.when(escaped, escape(turn["text"])).otherwise(turn["text"]),
        F.lit(TURN_END),
    )


def _pieces(formatted: Column) -> Column:
    """Per turn: whether it is framed rightly, its raw header and its raw body."""
    pieces = F.split(formatted, MARK, -1)

    def read(piece: Column, k: Column) -> Column:
        after = F.substring_index(piece, HEADER, -1)
        at = F.locate(HEADER_END, after)
        lead = F.when(k == 0, F.lit(HEADER)).otherwise(F.lit("\n" + HEADER))
        return F.struct(
            ((at > 0) & (piece == F.concat(lead, after))).alias("framed"),
            F.substr(after, F.lit(1), at - 1).alias("head"),
            F.substr(after, at + len(HEADER_END)).alias("body"),
        )

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), read)


def parse(formatted: Column) -> Column:
    """Turns of a formatted text: array of (role, raw body, text), in order.

    A piece that is not framed as a turn has null role and text, which no source turn has.
    """
    return F.transform(
        _pieces(formatted),
        lambda p: F.struct(
            F.when(p["framed"], _unescape_role(p["head"])).alias("role"),
            p["body"].alias("body"),
            F.when(p["framed"], unescape(p["body"])).alias("text"),
        ),
    )


def _same(parsed: Column, turns: Column) -> Column:
    """All turns came back, in order."""
    plain = F.transform(parsed, lambda p: F.struct(p["role"].alias("role"), p["text"].alias("text")))
    return plain == turns


def format_conversations(
    turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: ``conv``, ``formatted``, ``n_escaped``.

    Rows are taken by ``order``, ties by role and text; null order comes first.
    Null text or role: empty. A null conversation id is one conversation of its
    own. Repeated rows are repeated turns. Other columns are not read. An empty
    table gives an empty table.
    """
    one = turns.select(
        F.col(f"`{conv}`").alias("conv"),
        F.struct(
            F.col(f"`{order}`").alias("turn"),
            F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    source = F.struct(F.col("t")["role"].alias("role"), F.col("t")["text"].alias("text"))
    plain = _render(F.col("t"), F.lit(False))
    one = one.withColumn("conflict", ~_same(parse(plain), F.array(source)))
    grouped = one.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("t", "conflict"))).alias("all"))
    rendered = grouped.select(
        "conv",
        F.transform("all", lambda x: F.struct(x["t"]["role"].alias("role"), x["t"]["text"].alias("text"))).alias("source"),
        F.array_join(F.transform("all", lambda x: _render(x["t"], x["conflict"])), "").alias("first"),
        F.array_join(F.transform("all", lambda x: _render(x["t"], F.lit(True))), "").alias("strict"),
        F.size(F.filter("all", lambda x: x["conflict"])).cast("long").alias("conflicts"),
    )
    checked = rendered.withColumn("good", _same(parse(F.col("first")), F.col("source")))
    settled = checked.select(
        F.col("conv").alias(conv),
        F.when(F.col("good"), F.col("first"))
        .when(_same(parse(F.col("strict")), F.col("source")), F.col("strict"))
        .otherwise(F.raise_error(F.lit("a conversation did not survive its round trip")))
        .alias("formatted"),
        F.when(F.col("good"), F.col("conflicts")).otherwise(F.size("source").cast("long")).alias("n_escaped"),
    )
    return settled


def loss_spans(formatted: Column, role: str = "assistant") -> Column:
    """Loss mask: (start, length) in code points of each body of ``role`` in the formatted text."""
    first = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        head = F.length(turn["head"]) + len(HEADER) + len(HEADER_END)
        size = F.length(turn["body"])
        span = F.struct((state["at"] + head).cast("int").alias("start"), size.cast("int").alias("length"))
        return F.struct(
            (state["at"] + head + size + len(TURN_END)).cast("int").alias("at"),
            F.when(_unescape_role(turn["head"]) == role, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        )

    return F.aggregate(_pieces(formatted), first, step, lambda s: s["spans"])


def digest(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What the formatted texts say when they are read again."""
    read = formatted.select(
        F.col(f"`{conv}`").alias("conv_id"),
        "formatted",
        parse(F.col("formatted")).alias("turns"),
        loss_spans(F.col("formatted")).alias("mask"),
    )
    under = F.array_join(
        F.transform("mask", lambda m: unescape(F.substr(F.col("formatted"), m["start"], m["length"]))), ""
    )
    return read.withColumn("loss", under).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )

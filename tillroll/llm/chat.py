"""Chat formatting with a grammar round trip, with DataFrame functions only.

A formatted conversation is a sequence of turns ``<s>BODY</s>``. BODY is ``[INST] TEXT [/INST]`` for a user,
TEXT alone for an assistant and ``[ROLE] NAME [/ROLE] TEXT`` for any other role.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, CLOSE = "<s>", "</s>"
USER_OPEN, USER_CLOSE = "[INST] ", " [/INST]"
ROLE_OPEN, ROLE_CLOSE = "[ROLE] ", " [/ROLE] "

# The strings that must not occur in an escaped text; none begins inside another.
CONTROLS = r"([<\[])(/?(?:s>|INST\]|ROLE\]))"


def escaped(text: Column) -> Column:
    r"""Backslashes doubled, then one put behind the first character of every control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROLS, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _turn(role: Column, text: Column) -> Column:
    """The pieces of one rendered turn; ``body`` is the text itself."""
    head = F.when(role == "user", USER_OPEN).when(role == "assistant", "").otherwise(
        F.concat(F.lit(ROLE_OPEN), role, F.lit(ROLE_CLOSE))
    )
    tail = F.when(role == "user", USER_CLOSE).otherwise("")
    return F.struct(
        F.concat(F.lit(OPEN), head).alias("head"), text.alias("body"), F.concat(tail, F.lit(CLOSE)).alias("tail")
    )


def _joined(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: F.concat(p["head"], p["body"], p["tail"])), "")


def _parsed_turn(piece: Column) -> Column:
    """One piece between turn ends as (role, text); null if it is not a turn of the grammar."""
    body = F.substr(piece, F.lit(len(OPEN) + 1))
    user = body.startswith(USER_OPEN) & body.endswith(USER_CLOSE)
    user_text = F.substr(
        body, F.lit(len(USER_OPEN) + 1), F.length(body) - F.lit(len(USER_OPEN) + len(USER_CLOSE))
    )
    name_end = F.instr(body, F.lit(ROLE_CLOSE))
    name = F.substr(body, F.lit(len(ROLE_OPEN) + 1), name_end - F.lit(len(ROLE_OPEN) + 1))
    named_text = F.substr(body, name_end + F.lit(len(ROLE_CLOSE)))
    named = body.startswith(ROLE_OPEN) & (name_end > 0)

    def turn(role: Column, text: Column) -> Column:
        return F.struct(role.alias("role"), unescaped(text).alias("text"))

    parsed = (
        F.when(user & (F.length(body) >= len(USER_OPEN) + len(USER_CLOSE)), turn(F.lit("user"), user_text))
        .when(named, turn(unescaped(name), named_text))
        .otherwise(turn(F.lit("assistant"), body))
    )
    return F.when(piece.startswith(OPEN), parsed)


def parsed(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text), by splitting at turn ends."""
    pieces = F.split(formatted, CLOSE, -1)
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), _parsed_turn)


def _rendered(turns: Column, escape: Column) -> Column:
    """``escape`` is an array of booleans beside ``turns``."""

    def piece(turn: Column, hide: Column) -> Column:
        role = F.when(hide, escaped(turn["role"])).otherwise(turn["role"])
        return _turn(role, F.when(hide, escaped(turn["text"])).otherwise(turn["text"]))

    return F.zip_with(turns, escape, piece)


def _same(turns: Column, other: Column) -> Column:
    return F.coalesce(turns == other, F.lit(False))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conv_id: ``formatted`` text, ``loss_spans`` and ``n_escaped``.

    Every conversation is rendered as it is, reparsed and compared with its source. Where they differ,
    the turns that do not survive on their own are escaped; where the whole still differs, all of its
    turns are; a conversation that would differ even then fails the job. ``loss_spans`` are the starts
    and lengths, in code points of ``formatted``, of the assistants' texts.

    Turns go by (turn, role, text), nulls first, so ties and repeated rows have one order and are all
    kept. Null text and null role count as empty; a null conv_id is a conversation of its own; an empty
    table gives no rows; other columns are ignored. A conversation is one training example and is put
    together in one task, so it is bounded by what one row can hold.
    """
    line = F.struct(
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    gathered = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(line)).alias("_lines"))
    plain = gathered.select(
        "conv_id",
        F.transform("_lines", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("_turns"),
    ).withColumn("_raw", _joined(_rendered(F.col("_turns"), F.transform("_turns", lambda _: F.lit(False)))))

    def conflicts(turn: Column) -> Column:
        one = F.array(turn)
        return ~_same(one, parsed(_joined(_rendered(one, F.array(F.lit(False))))))

    # Whole-conversation checks stay outside of the lambdas, which would repeat them for every turn.
    checked = plain.withColumn("_clean", _same(F.col("_turns"), parsed(F.col("_raw"))))
    first = checked.withColumn(
        "_hide",
        F.when(F.col("_clean"), F.transform("_turns", lambda _: F.lit(False))).otherwise(
            F.transform("_turns", conflicts)
        ),
    ).withColumn("_pieces", _rendered(F.col("_turns"), F.col("_hide")))
    second = first.withColumn("_good", F.col("_clean") | _same(F.col("_turns"), parsed(_joined(F.col("_pieces")))))
    last = second.withColumn(
        "_hide", F.when(F.col("_good"), F.col("_hide")).otherwise(F.transform("_turns", lambda _: F.lit(True)))
    ).withColumn(
        "_pieces",
        F.when(F.col("_good"), F.col("_pieces")).otherwise(_rendered(F.col("_turns"), F.col("_hide"))),
    ).withColumn("formatted", _joined(F.col("_pieces")))
    no_way = F.raise_error(F.concat(F.lit("no round trip for conversation "), F.col("conv_id").cast("string")))
    proven = last.withColumn(
        "formatted",
        F.when(_same(F.col("_turns"), parsed(F.col("formatted"))), F.col("formatted")).otherwise(no_way),
    )
    # A running offset over the pieces; where the k-th text starts is the sum of all lengths before it.
    starts = F.aggregate(
        F.col("_pieces"),
        F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + F.length(p["tail"])).alias("at"),
            F.array_append(acc["starts"], acc["at"] + F.length(p["head"])).alias("starts"),
        ),
    )["starts"]
    spans = F.filter(
        F.arrays_zip(
            F.transform("_turns", lambda t: t["role"]).alias("role"),
            starts.alias("start"),
            F.transform("_pieces", lambda p: F.length(p["body"])).alias("length"),
        ),
        lambda s: s["role"] == "assistant",
    )
    return proven.select(
        "conv_id",
        "formatted",
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias(
            "loss_spans"
        ),
        F.size(F.filter("_hide", lambda h: h)).alias("n_escaped"),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, one after the other."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(formatted, s["start"], s["length"]))), "")

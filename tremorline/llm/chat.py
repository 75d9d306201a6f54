"""Conversations as training windows under a token budget.

Prefix sums of the turns' tokens choose the windows: the number line of a
conversation's tokens is cut in bins, the turns that lie inside one bin form a
window, and a turn that lies across a border is a window of its own. Each
window starts with the system turn and as many of the turns before it as fit
the history budget; these are repeats, and no loss is taken on them, so each
assistant text is a target once. The sums are made in blocks of turns with a
sum over block totals, and all joins are by conversation and block or window,
so a conversation of any length is spread over many tasks.

Template: ``<|im_start|>role, newline, text, <|im_end|>, newline`` per turn. A
``<|`` inside a role or text, with any backslashes between the two characters,
gets one more backslash, so the marks never stand in a text and the text comes
back exactly. In a role, backslash and newline are escaped as well.

Edge cases: null texts and roles are empty. Turns go by number (null first),
then role, then text; repeated rows are repeated turns. Null conversation ids
are one conversation. Only a first turn is taken as the system turn. A turn
over the budget, or one beside an oversized system turn, is a window over
budget: nothing is cut. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import count_tokens
from .frames import stored

BUDGET = 2048  # tokens of a window
HISTORY = 256  # tokens of repeated turns, a quarter of what the system turn leaves at most
TURN_OVERHEAD = 8  # tokens of a turn's marks and role
BLOCK = 256  # turn numbers per block

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    parts = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(
        F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\"
    )


def chat_windows(
    conversations: DataFrame,
    shared_vocabulary,
    budget: int = BUDGET,
    history: int = HISTORY,
    block: int = BLOCK,
) -> DataFrame:
    """One row per window, in ``(conv_id, window)`` order within a conversation.

    ``text`` is the formatted window, ``loss`` its target spans (code points,
    end exclusive), ``n_turns`` its turns, of which the first ``n_repeated``
    are repeats, ``tokens`` their tokens.
    """
    turns = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.floor(F.coalesce(F.col("turn").cast("long"), F.lit(-1)) / block).alias("block"),
    )
    turns = count_tokens(turns, shared_vocabulary)
    turns = stored(turns.withColumn("n", F.col("n_tokens") + TURN_OVERHEAD), "chat-turns")

    order = ["turn", "role", "text"]
    first = F.struct(*order)
    blocks = turns.groupBy("conv_id", "block").agg(
        F.sum("n").alias("block_n"), F.min_by(F.struct("role", "text", "n"), first).alias("head")
    )
    by_block = Window.partitionBy("conv_id").orderBy("block")
    blocks = blocks.select(
        F.col("conv_id").alias("b_conv"),
        F.col("block").alias("b_block"),
        (F.sum("block_n").over(by_block) - F.col("block_n")).alias("base"),
        F.first("head").over(by_block).alias("head"),
    )
    in_block = Window.partitionBy("conv_id", "block").orderBy(*order)
    placed = turns.withColumn(
        "end", F.sum("n").over(in_block.rowsBetween(Window.unboundedPreceding, 0))
    ).join(
        blocks,
        F.col("conv_id").eqNullSafe(F.col("b_conv")) & (F.col("block") == F.col("b_block")),
    )
    head_n = F.when(F.col("head.role") == "system", F.col("head.n")).otherwise(0)
    left = F.lit(budget) - F.col("head_n")
    placed = (
        placed.withColumns({"head_n": head_n, "end": F.col("base") + F.col("end")})
        .withColumn("past", F.least(F.lit(history), F.greatest(F.lit(0), F.floor(left / 4))))
        .withColumns(
            {
                "room": F.greatest(F.lit(1), left - F.col("past")),
                # Positions do not count the system turn, which is before them all.
                "end": F.col("end") - F.col("head_n"),
                "is_system": (F.col("head_n") > 0) & (F.col("end") <= F.col("head_n")),
            }
        )
        .withColumn("begin", F.col("end") - F.col("n"))
        .withColumns(
            {
                "low": F.floor(F.col("begin") / F.col("room")),
                "high": F.floor((F.col("end") - 1) / F.col("room")),
            }
        )
        .withColumn(
            "window",
            F.when(F.col("is_system"), 1).otherwise(
                2 * F.col("high") + F.when(F.col("low") == F.col("high"), 1).otherwise(0)
            ),
        )
        .select(
            "conv_id",
            "window",
            "begin",
            "end",
            "role",
            "text",
            "n",
            "past",
            "room",
            "is_system",
            F.when((F.col("head_n") > 0), F.col("head")).alias("head"),
        )
    )
    placed = stored(placed, "chat-placed")
    own = placed.where(~F.col("is_system"))

    windows = (
        own.groupBy("conv_id", "window")
        .agg(F.min("begin").alias("starts"), F.any_value("head").alias("head"))
        .withColumnsRenamed({"conv_id": "w_conv", "window": "w_window"})
    )
    # A turn is history for the windows that start after it and within the history budget.
    past = (
        own.where(F.col("n") <= F.col("past"))
        .withColumn(
            "w_bin",
            F.explode(
                F.sequence(
                    F.floor(F.col("end") / F.col("room")),
                    F.floor((F.col("begin") + F.col("past")) / F.col("room")),
                )
            ),
        )
        .withColumn("later", F.explode(F.array(2 * F.col("w_bin"), 2 * F.col("w_bin") + 1)))
        .where(F.col("later") > F.col("window"))
        .join(
            windows,
            F.col("conv_id").eqNullSafe(F.col("w_conv")) & (F.col("later") == F.col("w_window")),
        )
        .where(
            (F.col("starts") >= F.col("end")) & (F.col("starts") <= F.col("begin") + F.col("past"))
        )
    )

    def piece(kind: int, window, begin, role, text, n):
        return [
            "conv_id",
            F.col(window).alias("window"),
            F.struct(
                F.lit(kind).alias("kind"),
                begin.alias("begin"),
                escape_role(F.col(role)).alias("role"),
                escape(F.col(text)).alias("text"),
                F.col(n).alias("n"),
            ).alias("piece"),
        ]

    head = windows.where(F.col("head").isNotNull() & (F.col("w_window") != 1)).withColumnRenamed(
        "w_conv", "conv_id"
    )
    pieces = (
        placed.select(
            *piece(2, "window", F.when(F.col("is_system"), -1).otherwise(F.col("begin")), *_TURN)
        )
        .unionByName(past.select(*piece(1, "later", F.col("begin"), *_TURN)))
        .unionByName(
            head.select(*piece(0, "w_window", F.lit(-1), "head.role", "head.text", "head.n"))
        )
    )
    # At most a window's budget of turns, as each has TURN_OVERHEAD tokens; or one large turn.
    gathered = pieces.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list("piece")).alias("pieces")
    )
    return gathered.select(
        "conv_id",
        "window",
        F.array_join(
            F.transform(
                "pieces",
                lambda p: F.concat(F.lit(START), p.role, F.lit("\n"), p.text, F.lit(END + "\n")),
            ),
            "",
        ).alias("text"),
        _loss_spans("pieces").alias("loss"),
        F.size("pieces").alias("n_turns"),
        F.size(F.filter("pieces", lambda p: p.kind < 2)).alias("n_repeated"),
        F.aggregate("pieces", F.lit(0).cast("long"), lambda s, p: s + p.n).alias("tokens"),
    )


_TURN = ("role", "text", "n")


def _loss_spans(pieces: str) -> Column:
    """Start and end of the texts of the window's own assistant turns."""
    none = F.array().cast("array<struct<start:long,end:long>>")

    def step(state, p):
        start = state.at + len(START) + F.length(p.role) + 1
        end = start + F.length(p.text)
        target = (p.kind == 2) & (p.role == "assistant")
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(
            (end + len(END) + 1).alias("at"),
            F.when(target, F.concat(state.spans, span)).otherwise(state.spans).alias("spans"),
        )

    begun = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))
    return F.aggregate(pieces, begun, step, lambda state: state.spans)


def read_turns(windows: DataFrame) -> DataFrame:
    """What formatted windows say, read from their text and masks.

    Adds ``turns`` (role and text of the turns that are no repeats) and
    ``targets`` (the texts under the mask).
    """
    parts = F.slice(
        F.split("text", r"<\|im_start\|>", -1),
        F.col("n_repeated") + 2,
        F.col("n_turns") - F.col("n_repeated"),
    )
    turns = F.transform(
        parts,
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(
                F.substring(
                    p,
                    F.length(F.substring_index(p, "\n", 1)) + 2,
                    F.length(p) - F.length(F.substring_index(p, "\n", 1)) - len(END) - 2,
                )
            ).alias("text"),
        ),
    )
    targets = F.transform(
        "loss",
        lambda s: unescape(
            F.substring(
                F.col("text"), (s.start + 1).cast("int"), (s.end - s.start).cast("int")
            )
        ),
    )
    return windows.withColumns({"turns": turns, "targets": targets})


DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long"
)


def conversation_digests(windows: DataFrame) -> DataFrame:
    """Per conversation, digests of what its windows say, in order.

    A digest is a chain over all of a conversation's text, so its windows pass
    through one task one by one; only the digest's state is held.
    """
    rows = (
        read_turns(windows)
        .select("conv_id", "window", "turns", "targets", F.length("text").alias("chars"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "window")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, done = None, []
        for batch in batches:
            columns = [batch.column(c) for c in ("conv_id", "turns", "targets", "chars")]
            for row in range(batch.num_rows):
                conv, turns, targets, chars = (c[row].as_py() for c in columns)
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(_finished(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for turn in turns:
                    state[1] += 1
                    state[2].update(f"{turn['role']}\n{turn['text']}\n".encode())
                for text in targets:
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += chars
            yield _digest_batch(done)
            done = []
        if state is not None:
            yield _digest_batch([_finished(state)])

    return rows.mapInArrow(run, DIGEST)


def _finished(state):
    conv, turns, all_text, chars, loss, formatted = state
    return conv, turns, all_text.hexdigest(), chars, loss.hexdigest(), formatted


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [field.split()[0] for field in DIGEST.split(", ")]
    values = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names
    )

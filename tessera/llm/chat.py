"""Chat formatting in budgeted windows (DataFrame operations only).

Prefix sums of the turns' tokens choose spans of whole turns that fit a budget. Each window opens
with the system turn, then up to `history` earlier turns within `history_budget` tokens, then its
own turns. Loss is on the assistant texts among its own turns only, so a repeated target is masked
and every assistant text is learnt once. A turn that alone exceeds the budget gets a window of its
own, whole.

A turn is written `<|role|>\\n` text `<|end|>\\n`. Inside texts and roles a backslash is doubled and
`<|` becomes `<\\|` (in roles, any `|`), so no text can open or close a turn and reading restores it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, let

CLOSE = "<|end|>\n"
#: Tokens that a turn's marks take.
OVERHEAD = 4


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def open_mark(role: Column) -> Column:
    return F.concat(F.lit("<|"), escape_role(role), F.lit("|>\n"))


def format_windows(
    turns: DataFrame, budget: int = 1024, history: int = 2, history_budget: int = 256, target_role: str = "assistant"
) -> DataFrame:
    """A row (conv_id, n_turns, windows) per conversation from rows (conv_id, turn, role, text).

    windows: array of struct<text, repeated, loss>; repeated counts the leading turns that other
    windows have as their own, loss is an array of struct<start, length>, code points in text.

    Turns are ordered by turn, then role, then text (nulls first); repeated rows are turns of their
    own. Null text and null role count as empty; a null conv_id is one conversation. Extra columns
    are ignored; an empty table gives an empty result. A conversation is one row, as its text is.
    """
    plain = turns.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    cost = F.regexp_count("text", F.lit(WORD)) + OVERHEAD
    so_far = F.sum(cost).over(Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0))
    rows = plain.select("conv_id", F.struct("turn", "role", "text", so_far.cast("int").alias("upto")).alias("t"))
    made = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def with_prefix(prefix: Column, ts: Column) -> Column:
        """prefix[i]: tokens of the first i turns."""
        has_system = (ts[0]["role"] == "system").cast("int")
        system = F.when(has_system == 1, prefix[1]).otherwise(0)
        tokens = lambda a, b: prefix[b] - prefix[a]  # noqa: E731  of turns a..b-1, from 0

        def back(i: Column) -> Column:
            """How many turns before i are repeated with it."""
            fits = F.filter(
                F.sequence(F.lit(0), F.least(F.lit(history), i - has_system)),
                lambda k: (tokens(i - k, i) <= history_budget) & ((k == 0) | (system + tokens(i - k, i + 1) <= budget)),
            )
            return F.array_max(fits)

        def step(acc: Column, i: Column) -> Column:
            grown = acc["used"] + tokens(i, i + 1)
            fresh = F.size(acc["starts"]) == 0
            opened = let(F.when(fresh, 0).otherwise(back(i)), lambda h: F.struct(
                F.concat(acc["starts"], F.array(F.struct(i.alias("at"), h.alias("back")))).alias("starts"),
                (system + tokens(i - h, i + 1)).alias("used"),
            ))
            return F.when(~fresh & (grown <= budget), F.struct(acc["starts"].alias("starts"), grown.alias("used"))).otherwise(opened)

        own = F.when(F.size(ts) > has_system, F.sequence(has_system, F.size(ts) - 1)).otherwise(F.array().cast("array<int>"))
        start = F.struct(F.array().cast("array<struct<at:int,back:int>>").alias("starts"), F.lit(0).alias("used"))
        starts = F.aggregate(own, start, step, lambda acc: acc["starts"])
        # a system turn alone is a window without further turns
        return let(
            F.when((F.size(ts) == 1) & (has_system == 1), F.array(F.struct(F.lit(1).alias("at"), F.lit(0).alias("back")))).otherwise(starts),
            lambda ss: F.transform(ss, lambda s, k: window(ts, ss, s, k, has_system)),
        )

    def window(ts: Column, ss: Column, s: Column, k: Column, has_system: Column) -> Column:
        stop = F.when(k + 1 < F.size(ss), ss[k + 1]["at"]).otherwise(F.size(ts))
        first = k == 0
        shown = F.concat(F.slice(ts, 1, has_system), F.slice(ts, s["at"] - s["back"] + 1, F.greatest(stop - s["at"] + s["back"], F.lit(0))))
        repeated = F.when(first, 0).otherwise(has_system + s["back"])

        def built(show: Column) -> Column:
            pieces = F.transform(show, lambda t: F.struct(open_mark(t["role"]).alias("a"), escape(t["text"]).alias("b"), t["role"].alias("role")))

            def spans(ps: Column) -> Column:
                begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"), F.lit(0).alias("k"))

                def add(acc: Column, p: Column) -> Column:
                    from_ = acc["at"] + F.length(p["a"])
                    mine = (acc["k"] >= repeated) & (p["role"] == target_role)
                    span = F.array(F.struct(from_.alias("start"), F.length(p["b"]).alias("length")))
                    return F.struct(
                        (from_ + F.length(p["b"]) + len(CLOSE)).alias("at"),
                        F.when(mine, F.concat(acc["loss"], span)).otherwise(acc["loss"]).alias("loss"),
                        (acc["k"] + 1).alias("k"),
                    )

                text = F.array_join(F.transform(ps, lambda p: F.concat(p["a"], p["b"], F.lit(CLOSE))), "")
                return F.struct(text.alias("text"), repeated.alias("repeated"), F.aggregate(ps, begin, add, lambda acc: acc["loss"]).alias("loss"))

            return let(pieces, spans)

        return let(shown, built)

    prefix = F.concat(F.array(F.lit(0)), F.transform("turns", lambda t: t["upto"]))
    windows = let(F.col("turns"), lambda ts: let(prefix, lambda p: with_prefix(p, ts)))
    return made.select("conv_id", F.size("turns").alias("n_turns"), windows.alias("windows"))


def read_turns(window: Column) -> Column:
    """array<struct<role, text>> of a window's own turns, read from its formatted text; null for a null window."""
    pieces = F.split(window["text"], r"<\|end\|>\n", -1)
    turn = lambda p: F.struct(
        unescape(F.regexp_extract(p, r"^<\|((?:\\.|[^\\|])*)\|>\n", 1)).alias("role"),
        unescape(F.regexp_replace(p, r"^<\|(?:\\.|[^\\|])*\|>\n", "")).alias("text"),
    )
    return let(pieces, lambda ps: F.transform(F.slice(ps, window["repeated"] + 1, F.greatest(F.size(ps) - 1 - window["repeated"], F.lit(0))), turn))


def read_loss(window: Column) -> Column:
    """The unescaped text under a window's loss mask, its spans joined without anything between; null for a null window."""
    return F.array_join(F.transform(window["loss"], lambda s: unescape(F.substr(window["text"], s["start"] + 1, s["length"]))), "")

"""Passages of timed words: greedy grouping by elapsed time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.binding import let
from quillmill.schema import WORD

LIMIT_SECONDS = 30.0
#: Words that an inner fold of group_starts takes.
_PART = 512
_STATE = "struct<origin:double,starts:array<int>>"


def group_starts(words: Column, limit: float = LIMIT_SECONDS) -> Column:
    """1-based positions at which a new passage begins; ``words`` should be a plain column or a lambda's variable.

    Words are taken in array order; a passage ends before the word that would end more than ``limit``
    seconds after the passage's first start, and a longer word stands alone. Spark copies the state of a
    fold at each step, so words are folded part by part, and only whole parts meet the long list of positions.
    """

    def step(state: Column, at: Column) -> Column:
        word = F.get(words, at - 1)
        begins = state["origin"].isNull() | (word["end"] - state["origin"] > limit)
        return F.struct(
            F.when(begins, word["start"]).otherwise(state["origin"]).alias("origin"),
            F.when(begins, F.array_append(state["starts"], at)).otherwise(state["starts"]).alias("starts"),
        )

    def part(state: Column, first: Column) -> Column:
        positions = F.sequence(first, F.least(first + (_PART - 1), F.size(words)))
        fresh = F.struct(state["origin"].alias("origin"), F.array().cast("array<int>").alias("starts")).cast(_STATE)
        return let(F.aggregate(positions, fresh, step), lambda own: F.struct(own["origin"].alias("origin"), F.concat(state["starts"], own["starts"]).alias("starts")))

    empty = F.struct(F.lit(None).cast("double").alias("origin"), F.array().cast("array<int>").alias("starts")).cast(_STATE)
    firsts = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words), F.lit(_PART))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(firsts, empty, part, lambda s: s["starts"])


def passages(words: Column, language: Column, limit: float = LIMIT_SECONDS) -> Column:
    """array<struct<kind,text,language,start,end,words>>: the end is that of the last word, not the latest.

    The words and the positions where passages begin are each computed once, so the work grows with the words.
    """

    def cut(words: Column, starts: Column) -> Column:
        def passage(first: Column, i: Column) -> Column:
            after = F.coalesce(F.get(starts, i + 1), F.size(words) + 1)
            # slice() reads the whole array each time
            own = F.transform(F.sequence(first, after - 1), lambda k: F.get(words, k - 1))
            return let(own, lambda own: _passage(own, language))

        return F.transform(starts, passage)

    return let(words, lambda w: F.when(F.size(w) > 0, let(group_starts(w, limit), lambda starts: cut(w, starts))))


def _passage(own: Column, language: Column) -> Column:
    return F.struct(
        F.lit("transcript").alias("kind"),
        F.array_join(F.transform(own, lambda w: w["text"]), " ").alias("text"),
        language.alias("language"),
        F.get(own, F.lit(0))["start"].alias("start"),
        F.element_at(own, -1)["end"].alias("end"),
        own.cast(f"array<{WORD}>").alias("words"),
    )

"""Matches of a pattern in a text with their places, by built-in functions, in time linear in the text and its matches.

One pass of the pattern puts a mark on either side of each match, and the marks cut the text into pieces. A fold over the
matches carries along what no single piece knows: where it stands, and the last characters before. Output is gathered in
groups of GROUP, since appending to one array copies it each time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two characters that are never assigned. The first marks matches; where a text holds it, the second stands in for it.
MARK, OTHER = "\ufdd0", "\ufdd1"
GROUP = 256


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once however often use refers to it."""
    return F.transform(F.array(value), use)[0]


def fold(n: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """The array of what step(state, i) -> (state, array<kind>) puts out for i = 0 to n - 1, one after the other."""
    none, nothing = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def one(s: Column, i: Column) -> Column:
        after, out = step(s["state"], i)
        return F.struct(after.alias("state"), F.concat(s["out"], out).alias("out"))

    def group(s: Column, g: Column) -> Column:
        of = F.sequence(g * GROUP, F.least((g + 1) * GROUP, n) - 1)
        done = F.aggregate(of, F.struct(s["state"].alias("state"), none.alias("out")), one)
        return bind(done, lambda d: F.struct(d["state"].alias("state"), F.concat(s["groups"], F.array(d["out"])).alias("groups")))

    groups = F.sequence(F.lit(0), F.call_function("div", F.greatest(n, F.lit(1)) - 1, F.lit(GROUP)).cast("int"))
    every = F.aggregate(groups, F.struct(state.alias("state"), nothing.alias("groups")), group, lambda s: F.flatten(s["groups"]))
    return F.when(n > 0, every).otherwise(none)


def matches(text: Column, pattern: str, valid: Callable[[Column, Column], Column], context: int, after: bool = False) -> Column:
    """array<struct<start:long,end:long,text:string,before:string,after:string>> of the matches for which
    valid(match, before) holds.

    Places are code points, the end exclusive; before and after (if asked for) are up to `context` code points next to the
    match. Neither the pattern nor a match may hold characters beyond ASCII. Null text gives null.
    """
    clean = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, OTHER)).otherwise(text)
    pieces = F.split(F.regexp_replace(clean, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    last = lambda s: F.substr(s, F.greatest(F.length(s) - context, F.lit(0)) + 1)

    def places(p: Column) -> Column:
        def step(s: Column, i: Column) -> tuple[Column, Column]:
            gap, hit = F.get(p, 2 * i), F.get(p, 2 * i + 1)
            start = s["at"] + F.length(gap)
            before = last(F.concat(s["tail"], gap))
            # every match is a character long at least and is followed by a gap, which may be empty
            ahead = F.concat(*[F.substring(F.coalesce(F.get(p, 2 * i + 2 + k), F.lit("")), 1, context) for k in range(8)]) if after else F.lit("")
            span = F.struct(start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("text"), before.alias("before"), F.substring(ahead, 1, context).alias("after"))
            state = F.struct((start + F.length(hit)).alias("at"), last(F.concat(s["tail"], gap, hit)).alias("tail"))
            return state, F.when(valid(hit, before), F.array(span)).otherwise(F.array().cast(f"array<{SPAN}>"))

        return fold(F.call_function("div", F.size(p) - 1, F.lit(2)).cast("int"), F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("tail")), step, SPAN)

    return bind(pieces, places)


SPAN = "struct<start:long,end:long,text:string,before:string,after:string>"

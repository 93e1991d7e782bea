"""Identifier tokens, as a native column and for one name: segments by character class, cut by one pattern."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package


def segment_pattern(bad: str) -> str:
    """A segment and the underscore behind it: other characters with the upper-case one before them, or upper-case ones that no
    other one follows, or digits.  ``bad`` are characters that stand for bytes that are no text; like underscores they only part."""
    other = rf"[^\p{{Lu}}\p{{Nd}}_{bad}]"
    return rf"(?:\p{{Lu}}?{other}+|\p{{Lu}}+(?!{other})|\p{{Nd}}+)_?"


def tokens(name: Column) -> Column:
    """[name, name without outer underscores, its segments], lower-cased, first of each.

    A segment that an underscore follows counts from two characters on; any other one unless the name begins with it."""
    segments = F.regexp_extract_all(name, F.lit(segment_pattern("\\x{FFFD}")), F.lit(0))
    begins = F.regexp_like(name, F.lit("^[^_\\x{FFFD}]"))
    kept = F.filter(segments, lambda s, i: F.when(s.endswith("_"), F.length(s) > 2).otherwise((i > 0) | ~begins))
    parts = F.transform(kept, lambda s: F.rtrim(s, F.lit("_")))
    return F.array_distinct(F.filter(F.transform(F.concat(F.array(name, F.btrim(name, F.lit("_"))), parts), F.lower), lambda t: t != ""))


ascii_tokens = tokens


def exact_tokens(name: bytes) -> list[bytes]:
    """The same list of one name, not lower-cased, which may hold bytes that are no UTF-8."""
    import regex

    text = name.decode("utf-8", "surrogateescape")
    found = [(m.start(), m.group()) for m in regex.finditer(segment_pattern("\udc80-\udcff"), text)]
    parts = [s.rstrip("_") for at, s in found if (len(s) > 2 if s.endswith("_") else at > 0)]
    return [t.encode("utf-8", "surrogateescape") for t in dict.fromkeys([text, text.strip("_"), *parts]) if t]


def may_match(text: Column, pattern: str) -> Column:
    """Whether a text holds a pattern's characters in order (case ignored): all that a fuzzy score needs to be positive."""
    import re

    return F.regexp_like(F.lower(text), F.lit("(?s)" + ".*".join(re.escape(c) for c in pattern.lower())))


def fuzzy(text: Column, pattern: str) -> Column:
    """The score of fuzzy_score as a column: for each character of the pattern an array of the best score that ends at each place of the text."""
    lower = F.split(F.lower(text), "")
    places = F.sequence(F.lit(0), F.length(text) - 1)
    letter = lambda i: F.substring(text, i + 1, F.lit(1))
    plain = r"^[\p{L}\p{N}]$"
    starts = lambda i: (i == 0) | ~F.regexp_like(letter(i - 1), F.lit(plain))
    inner = lambda i: (F.regexp_like(letter(i), F.lit(r"^\p{Lu}$")) & F.regexp_like(letter(i - 1), F.lit(r"^\p{Ll}$"))) | (F.regexp_like(letter(i), F.lit(r"^\p{Nd}$")) & ~F.regexp_like(letter(i - 1), F.lit(r"^\p{Nd}$")))
    bonus = F.transform(places, lambda i: F.when(starts(i), 8).when(inner(i), 7).otherwise(0))
    state = F.struct(lower.alias("c"), bonus.alias("b"), F.array().cast("array<int>").alias("s"))

    def step(state: Column, ch: Column) -> Column:
        c, b, s = state["c"], state["b"], state["s"]

        def ending(i: Column) -> Column:
            at = F.get(b, i)
            after = lambda x, j: x + 16 + F.when(j == i - 1, F.greatest(at, F.lit(4))).otherwise(at - 3 - (i - 2 - j))
            best = F.when(F.size(s) == 0, 16 + 2 * at).otherwise(F.array_max(F.transform(F.slice(s, F.lit(1), i), after)))
            return F.when(F.get(c, i) == ch, best)

        return F.struct(c.alias("c"), b.alias("b"), F.transform(F.sequence(F.lit(0), F.size(b) - 1), ending).alias("s"))

    letters = F.array(*[F.lit(x) for x in pattern.lower()]).cast("array<string>")
    score = F.aggregate(letters, state, step, lambda state: F.coalesce(F.array_max(state["s"]), F.lit(0)))
    return F.when(text.isNull() | (F.length(text) == 0) | (F.size(letters) == 0), F.lit(0)).otherwise(F.greatest(score, F.lit(0))).cast("long")


def fuzzy_score(text: str, pattern: str) -> int:
    """Score of the best subsequence match of a pattern (case ignored), 0 if none: 16 a character, gaps 3 then 1 each, bonus at word starts and runs."""
    t, p = text.lower(), pattern.lower()
    if not p:
        return 0
    bonus = [8 if i == 0 or not text[i - 1].isalnum() else 7 if text[i].isupper() and text[i - 1].islower() or text[i].isdigit() and not text[i - 1].isdigit() else 0 for i in range(len(t))]
    none = -(10**9)
    score, run = [none] * len(t), [0] * len(t)
    for k, ch in enumerate(p):
        new, runs, open_gap = [none] * len(t), [0] * len(t), none
        for i, c in enumerate(t):
            if i:
                open_gap = max(open_gap - 1, (score[i - 1 - 1] - 3) if k and i >= 2 and score[i - 2] > none else none)
            if c != ch:
                continue
            if not k:
                new[i], runs[i] = 16 + 2 * bonus[i], 1
                continue
            straight = score[i - 1] + 16 + max(bonus[i], 4) if i and score[i - 1] > none else none
            jump = open_gap + 16 + bonus[i] if open_gap > none // 2 else none
            new[i], runs[i] = max(straight, jump), run[i - 1] + 1 if straight >= jump else 1
        score, run = new, runs
    return max(0, max(score, default=0))

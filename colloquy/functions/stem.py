"""Porter's stemmer as column expressions, to be run once for each different word of a vocabulary."""

from __future__ import annotations

import functools

from pyspark.sql import Column, functions as F

from .text import let

#: Conditions on what a suffix leaves. A vowel is one of aeiou, or a y after a consonant; other y are written Y before.
VOWEL = "[aeiouy]"
ONCE = "[aeiouy][^aeiouy]"
TWICE = "[aeiouy][^aeiouy]+[aeiouy]+[^aeiouy]"
STEMMED_ION = f"{TWICE}.*[st]$|[aeiouy][^aeiouy]+[aeiouy]+[st]$"
#: Ends in consonant, vowel, consonant, the last no w, x or y.
SHORT = "(^|.*)[^aeiouy][aeiouy][^aeiouywxY]$"
DOUBLE = "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx|yY)$"

#: Porter's suffixes of steps 1a, 2, 3 and 4, what replaces them, and the condition on the rest.
STEP_1A = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()

#: A step: (suffix, replacement, pattern that the rest must show), the longest suffix that fits decides.
Step = list[tuple[str, str, str]]
STEPS: list[Step] = [
    [(s, r, "") for s, r in STEP_1A],
    [(s, r, ONCE) for s, r in STEP_2],
    [(s, r, ONCE) for s, r in STEP_3],
    [(s, "", STEMMED_ION if s == "ion" else TWICE) for s in STEP_4],
]


def longest_first(step: Step) -> Step:
    return sorted(step, key=lambda r: -len(r[0]))


def _rest(w: Column, suffix: str) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - len(suffix))


def _apply(w: Column, step: Step) -> Column:
    rules = [(F.endswith(w, F.lit(s)), F.when(_rest(w, s).rlike(c), F.concat(_rest(w, s), F.lit(r))).otherwise(w) if c else F.concat(_rest(w, s), F.lit(r))) for s, r, c in longest_first(step)]
    return functools.reduce(lambda c, x: c.when(*x), rules[1:], F.when(*rules[0])).otherwise(w)


def _cut(w: Column) -> Column:
    return F.when(F.endswith(w, F.lit("ed")) & _rest(w, "ed").rlike(VOWEL), _rest(w, "ed")).when(F.endswith(w, F.lit("ing")) & _rest(w, "ing").rlike(VOWEL), _rest(w, "ing"))


def _step_1b(w: Column, cut: Column) -> Column:
    mended = F.when(cut.rlike("(at|bl|iz)$"), F.concat(cut, F.lit("e"))).when(cut.rlike(DOUBLE), _rest(cut, "x")).when(cut.rlike(ONCE) & ~cut.rlike(TWICE) & cut.rlike(SHORT), F.concat(cut, F.lit("e"))).otherwise(cut)
    return F.when(F.endswith(w, F.lit("eed")), F.when(_rest(w, "eed").rlike(ONCE), _rest(w, "d")).otherwise(w)).when(cut.isNotNull(), mended).otherwise(w)


def _step_1c(w: Column) -> Column:
    return F.when(w.rlike("[yY]$") & _rest(w, "y").rlike(VOWEL), F.concat(_rest(w, "y"), F.lit("i"))).otherwise(w)


def _step_5(w: Column) -> Column:
    rest = _rest(w, "e")
    w = F.when(F.endswith(w, F.lit("e")) & (rest.rlike(TWICE) | (rest.rlike(ONCE) & ~rest.rlike(SHORT))), rest).otherwise(w)
    return let(w, lambda w: F.when(F.endswith(w, F.lit("ll")) & w.rlike(TWICE), _rest(w, "l")).otherwise(w))


def porter(word: Column) -> Column:
    """The Porter stem of a lower-case word. Words of one or two letters are their own stem; letters beyond a to z count as
    consonants. Every step is worked out once, however often the next one names it."""
    w = F.regexp_replace(F.regexp_replace(word, "^y", "Y"), "([aeiouy])y", "$1Y")
    by = lambda step: lambda c: _apply(c, step)
    steps = (by(STEPS[0]), lambda c: let(_cut(c), lambda cut: _step_1b(c, cut)), _step_1c, *map(by, STEPS[1:]), _step_5)
    stem = functools.reduce(lambda c, step: let(c, step), steps, w)
    return F.when(F.length(word) > 2, F.lower(stem)).otherwise(word)

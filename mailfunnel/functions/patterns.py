"""Words that a pattern cannot match without, so that most patterns are never tried on most texts."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache, reduce
from itertools import product
from re import _constants as kind
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: At most this many alternative words stand for a part of a pattern, and this many parts for a pattern; shorter words tell little.
ALTERNATIVES, PARTS, SHORTEST = 12, 2, 3


def _least(words: Iterable[str]) -> frozenset[str]:
    """Without those that hold another."""
    words = set(words)
    return frozenset(w for w in words if not any(o != w and o in w for o in words))


def _char(op, arg) -> str | None:
    return chr(arg).lower() if op is kind.LITERAL and arg < 128 else None


def _parts(tree) -> tuple[set[str] | None, list[frozenset[str]]]:
    """All texts that a parsed pattern matches, in lower case (None: too many), and sets of words of each of which any match holds one."""
    run, whole, found = {""}, True, []
    for op, arg in tree:
        texts, inner = None, []
        if op in (kind.AT, kind.ASSERT, kind.ASSERT_NOT):
            continue
        if op is kind.LITERAL:
            c = _char(op, arg)
            texts = c and {c}
        elif op is kind.IN:
            chars = {_char(*x) for x in arg}
            texts = chars if None not in chars and len(chars) <= 2 else None
        elif op is kind.SUBPATTERN:
            texts, inner = _parts(arg[3])
        elif op is kind.BRANCH:
            each = [_parts(b) for b in arg[1]]
            if all(t is not None for t, _ in each):
                texts = set().union(*(t for t, _ in each))
            best = [_best(*e) for e in each]
            inner = [_least(set().union(*(b[0] for b in best)))] if texts is None and all(best) else []
        elif op in (kind.MAX_REPEAT, kind.MIN_REPEAT, kind.POSSESSIVE_REPEAT):
            low, high, sub = arg
            once, more = _parts(sub)
            texts = once | {""} if (low, high) == (0, 1) and once is not None else None
            inner = _best(once, more) if low else []
        joined = {a + b for a, b in product(run, texts)} if texts is not None and len(run) * len(texts) <= 4 * ALTERNATIVES else None
        if joined is not None and len(_least(joined)) <= ALTERNATIVES:
            run = joined
            continue
        found += [frozenset(run), *inner, *([frozenset(texts)] if texts is not None and not inner else [])]
        run, whole = {""}, False
    return (run, []) if whole else (None, [*found, frozenset(run)])


def _best(texts: set[str] | None, found: list[frozenset[str]]) -> list[frozenset[str]]:
    """The sets that tell most, the surest first."""
    sets = {_least(s) for s in ([frozenset(texts)] if texts is not None else found)}
    return sorted((s for s in sets if s and "" not in s), key=lambda s: (min(map(len, s)) < SHORTEST, len(s), -min(map(len, s)), sorted(s)))


@cache
def needed(pattern: str) -> list[list[str]]:
    """Sets of lower-case ASCII words: any text that the pattern matches holds, in lower case, a word of each. None where they tell too little."""
    found = _best(*_parts(parser.parse(pattern.replace(r"\z", r"\Z"))))
    return [sorted(s) for s in found if len(s) <= ALTERNATIVES and min(map(len, s)) >= SHORTEST][:PARTS]


def may_hit(low: str | None, pattern: str) -> Column | None:
    """Whether the column ``low``, a text in lower case, holds what the pattern needs; None where nothing is known."""
    sets = needed(pattern) if low else []
    holds = lambda w: f"contains({low}, '{w.replace(chr(92), chr(92) * 2).replace(chr(39), chr(92) + chr(39))}')"
    # one expression for all words: built one by one, thousands of columns take seconds
    return F.expr(" AND ".join(f"({' OR '.join(map(holds, words))})" for words in sets)) if sets else None


def hit(text: Column, pattern: str, low: str | None = None) -> Column:
    """``text.rlike(pattern)``; with ``low``, the column of the text in lower case, the pattern is tried only where its words occur."""
    may = may_hit(low, pattern)
    return text.rlike(pattern) if may is None else may & text.rlike(pattern)


def any_of(text: Column, patterns: Iterable[str], low: str | None = None) -> Column:
    return reduce(lambda a, b: a | b, [hit(text, p, low) for p in patterns])

"""Small text and combination helpers for labels."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Sequence
from typing import Any

#: English plurals: the first pattern that is found in a word says what its end becomes.
PLURALS = (
    (re.compile(r"^.{0,2}$"), lambda w: w + "s"),
    (re.compile(r"is$"), lambda w: re.sub("is$", "es", w)),
    (re.compile(r"(s|x|z|sh|ch)$"), lambda w: w + "es"),
    (re.compile(r"[^aeiou]y$"), lambda w: re.sub("y$", "ies", w)),
    (re.compile(r""), lambda w: w + "s"),
)


def pluralise(text: str) -> str:
    """The regular English plural of a label, by its last word's ending."""
    return next(ending(text) for pattern, ending in PLURALS if pattern.search(text))


def cross(*lists: Iterable[Any]) -> list[tuple]:
    """All combinations with one item of each list."""
    return list(itertools.product(*lists))


def combinations(items: Sequence[Any]) -> list[tuple]:
    """All selections of items, the empty one first, by size and position."""
    return [c for k in range(len(items) + 1) for c in itertools.combinations(items, k)]

"""Links by similarity of spelling (difflib's ratio), in Arrow batches.

SQL has no such ratio (edit distance orders names otherwise). A batch computes
each distinct text once; the list of names is a parameter of fixed size.
"""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F


def closest(names: list[str], least: float = 0.8) -> Callable:
    """A function of a text column: struct(name, score) of the most similar name,
    whatever the case; the first of several. Below ``least``, for null and for an
    empty text the name is null and the score 0."""
    names = list(names)

    @F.pandas_udf("name string, score double")
    def closest_name(texts: pd.Series) -> pd.DataFrame:
        matchers = [(n, SequenceMatcher(None, "", n.lower().strip())) for n in names]
        found = {}
        for text in texts.dropna().unique():
            best, score = None, 0.0
            for name, matcher in matchers:
                matcher.set_seq1(text.lower().strip())
                floor = max(score, least)
                if matcher.real_quick_ratio() < floor or matcher.quick_ratio() < floor:  # both are upper bounds
                    continue
                ratio = matcher.ratio()
                if ratio > score and ratio >= least:
                    best, score = name, ratio
            found[text] = (best, score)
        return pd.DataFrame([found.get(t, (None, 0.0)) if isinstance(t, str) else (None, 0.0) for t in texts], columns=["name", "score"])

    return closest_name


def set_f1(least: float = 0.8, aliases: dict[str, str] | None = None) -> Callable:
    """A function of two list columns: F1 of their sets, where items pair when equal
    (lower case, by alias) or else with the most similar item left. Items are taken
    in order of name, so the greedy pairing doesn't depend on the order of a list.
    Both empty 1, one empty 0; null counts as empty."""
    aliases = dict(aliases or {})

    def plain(items):
        low = {str(x).lower().strip() for x in items if x is not None} if items is not None else set()
        return sorted({aliases.get(x, x) for x in low})

    @F.pandas_udf("double")
    def fuzzy_f1(found: pd.Series, gold: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(found, gold, strict=True):
            mine, left = plain(a), plain(b)
            total, pairs = len(mine) + len(left), 0
            if not mine or not left:
                out.append(1.0 if total == 0 else 0.0)
                continue
            for item in mine:
                if item in left:
                    best = item
                else:
                    scored = [(SequenceMatcher(None, item, g).ratio(), g) for g in left]
                    top = max((s for s, _ in scored), default=0.0)
                    best = next((g for s, g in scored if s == top), None) if top >= least else None
                if best is not None:
                    left.remove(best)
                    pairs += 1
            out.append(2.0 * pairs / total)
        return pd.Series(out, dtype="float64")

    return fuzzy_f1

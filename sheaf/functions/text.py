"""Text functions no built-in expresses, as vectorised UDFs: comparison form, similarity, highlighting, evidence pages."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd

from sheaf.functions.vectorised import vectorised

def comparison_form(s: str | None) -> str:
    return re.sub(r"\s+", "", unicodedata.normalize("NFKC", s)).casefold() if s else ""


@vectorised("string")
def compare_form(texts: pd.Series) -> pd.Series:
    """NFKC, no white space, case folded; '' for null."""
    return texts.map(comparison_form, na_action=None)


@vectorised("double")
def text_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two texts; 1 for two empty ones, null counts as empty."""
    return pd.Series([1.0 if not x and not y else SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


@vectorised("double")
def exact_round(values: pd.Series, places: pd.Series) -> pd.Series:
    """Rounding of the exact binary value, half to even."""
    return pd.Series([None if pd.isna(v) else round(float(v), int(p)) for v, p in zip(values, places)])


@vectorised("string")
def highlight(texts: pd.Series, terms: pd.Series) -> pd.Series:
    """Terms (array of struct term, category) marked as [category:term]: longest first, left to right, never overlapping.

    Terms under two characters are left out; of a term given twice the last category counts."""
    out = []
    for text, found in zip(texts, terms):
        of = {t["term"]: t["category"] for t in (found if found is not None else ()) if t["term"] and len(t["term"]) >= 2}
        if not text or not of:
            out.append(text)
            continue
        pattern = re.compile("|".join(re.escape(t) for t in sorted(of, key=lambda t: (-len(t), t))))
        out.append(pattern.sub(lambda m: f"[{of[m.group()]}:{m.group()}]", text))
    return pd.Series(out)

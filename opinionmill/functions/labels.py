"""Label normalisation to positive, negative, neutral."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLASSES = ("negative", "neutral", "positive")
# Spellings, compared in lower case; the first list that has one wins.
POSITIVE = ["positive", "pos", "1", "yes", "good", "true", "4", "5"]
NEGATIVE = ["negative", "neg", "0", "no", "bad", "false", "2"]


def normalise(label: Column, scale: str = "mixed") -> Column:
    """Everything in neither list, null too, is neutral.

    On the `mixed` scale 1 is positive and 2 negative; `stars` reads 1 and 2 as
    negative, 3 as neutral, 4 and 5 as positive.
    """
    text = F.lower(label.cast("string"))
    positive, negative = POSITIVE, NEGATIVE
    if scale == "stars":
        positive, negative = [p for p in POSITIVE if p != "1"], [*NEGATIVE, "1"]
    elif scale != "mixed":
        raise ValueError(f"unknown scale {scale!r}")
    return F.when(text.isin(positive), "positive").when(text.isin(negative), "negative").otherwise("neutral")

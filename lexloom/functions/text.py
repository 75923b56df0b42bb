"""Text expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bound_batches

#: All characters that Python's str.isspace() knows; \\s alone covers six of them. Fixed values.
SPACE = r"[\s\x1c-\x1f\x85\xa0  -     　]"
#: What ends a line for str.splitlines(). Fixed values.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def normalize(text: Column) -> Column:
    """NFKC, case folding, and each run of white space as one space, none at the ends. Null stays
    null. Spark has neither NFKC nor case folding, hence an Arrow batch function; its batches are bounded by bytes."""
    bound_batches(SparkSession.active())

    def batch(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()))

    return F.pandas_udf(batch, T.StringType())(text)


def strip(text: Column) -> Column:
    """Text without white space at its ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def blank(text: Column) -> Column:
    """Whether a text is null, empty or white space only."""
    return F.coalesce(strip(text) == "", F.lit(True))


def space_priority(token: Column) -> Column:
    """0 for tokens that begin with line feed, tab or space, 1 for a leading U+2581, else 2."""
    return F.when(F.left(token, F.lit(1)).isin("\n", "\t", " "), 0).when(token.startswith("▁"), 1).otherwise(2)


def judge_says_yes(response: Column) -> Column:
    """A judge's verdict: its normalized answer begins with `yes`."""
    return normalize(response).startswith("yes")


def judge_prompt(prompt: Column, answer_a: Column, answer_b: Column) -> Column:
    """The question put to a judge about two answers."""
    return F.concat(
        F.lit("Do these two answers to the prompt say the same? Reply yes or no.\n\nPrompt:\n"), prompt,
        F.lit("\n\nFirst answer:\n"), answer_a, F.lit("\n\nSecond answer:\n"), answer_b,
    )


def replace_literals(text: Column, renames: dict[str, str], dropped: list[str]) -> Column:
    """Replaces literals, longest first (ties by text), then removes the dropped ones likewise."""
    for old in sorted(renames, key=lambda x: (-len(x), x)):
        if old != renames[old]:
            text = F.replace(text, F.lit(old), F.lit(renames[old]))
    for old in sorted(dropped, key=lambda x: (-len(x), x)):
        text = F.replace(text, F.lit(old), F.lit(""))
    return text


def length_bucket(text: Column, short: int = 64, middle: int = 512) -> Column:
    """short, middle or long, by code points."""
    n = F.length(text)
    return F.when(n <= short, "short").when(n <= middle, "middle").otherwise("long")


def sample_windows(text: Column, size: int = 12000) -> Column:
    """Start, middle and end of a text, each of at most `size` code points; a text of at most
    `size` gives just itself."""
    n = F.length(text)
    at = F.array(F.lit(0), F.floor((n - size) / 2).cast("int"), (n - size).cast("int"))
    cut = F.transform(F.array_distinct(at), lambda i: F.substring(text, i + 1, F.lit(size)))
    return F.when(n <= size, F.array(text)).otherwise(cut)

"""Keys under which equal texts meet, whatever their width, case, accents or punctuation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType


@F.pandas_udf(StringType())
def _folded(texts: pd.Series) -> pd.Series:
    """NFKC and full case folding, which no built-in function has."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


@F.pandas_udf(StringType())
def _bare(texts: pd.Series) -> pd.Series:
    """NFKD without its marks, folded."""
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).casefold())


def norm_key(text: Column) -> Column:
    """F8: compatibility form, case folded, words alone."""
    return F.regexp_replace(_folded(text), r"[^\p{L}\p{N}_]+", "")


def compact_key(text: Column, dashes: bool = False) -> Column:
    """letters and digits without accents; with ``dashes``, hyphens and dashes stay as hyphens."""
    bare = F.regexp_replace(_bare(text), r"[\u2010-\u2015\u2212]", "-") if dashes else _bare(text)
    return F.regexp_replace(bare, r"[^\p{L}\p{N}-]+" if dashes else r"[^\p{L}\p{N}]+", "")


def offsets(text: str) -> tuple[str, list[int]]:
    """the folded text without white space, and for each of its characters the place it came from."""
    out, at = [], []
    for k, c in enumerate(text):
        for x in unicodedata.normalize("NFKC", c).casefold():
            if not x.isspace():
                out.append(x)
                at.append(k)
    return "".join(out), at


@F.pandas_udf(ArrayType(IntegerType()))
def _spans(texts: pd.Series, needles: pd.Series) -> pd.Series:
    found = []
    for text, needle in zip(texts, needles, strict=True):
        (flat, at), (wanted, _) = offsets(text or ""), offsets(needle or "")
        k = flat.find(wanted) if wanted else -1
        found.append([at[k], at[k + len(wanted) - 1] + 1] if k >= 0 else None)
    return pd.Series(found)


def folded_span(text: Column, needle: Column) -> Column:
    """[start, end) in the original text of the first place that equals ``needle`` but for width, case and space."""
    return _spans(text, needle)

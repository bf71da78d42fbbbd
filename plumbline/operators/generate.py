"""Generated features: date parts, text lengths, polynomial and interaction terms."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain, combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import columns_of, numeric_columns, present, ref

# Date parts by name, and how a missing text counts.
DATE_PARTS = {
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "hour": F.hour,
    "weekday": F.weekday,
    "quarter": F.quarter,
}
MISSING_TEXT = "nan"


def date_features(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Add ``column__part`` for every datetime column; Monday is weekday 0."""
    names = columns_of(df, "datetime", exclude=exclude)
    return df.select("*", *[fn(ref(c)).alias(f"{c}__{p}") for c in names for p, fn in DATE_PARTS.items()])


def text_lengths(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Add ``column__length`` for every text column; a missing text counts as "nan"."""
    names = columns_of(df, "string", exclude=exclude)
    return df.select("*", *[F.length(F.coalesce(ref(c), F.lit(MISSING_TEXT))).alias(f"{c}__length") for c in names])


def term_name(term: Sequence[str]) -> str:
    powers = {c: term.count(c) for c in dict.fromkeys(term)}
    return " ".join(c if n == 1 else f"{c}^{n}" for c, n in powers.items())


def polynomial_terms(
    df: DataFrame,
    degree: int = 2,
    interaction_only: bool = False,
    columns: Sequence[str] | None = None,
    exclude: Sequence[str] = (),
    max_columns: int | None = None,
) -> DataFrame:
    """Add the products of 2..degree numeric columns, missing values as 0, in one projection.

    All columns take part; ``max_columns`` keeps only the first so many, where that is wanted.
    """
    names = list(columns or numeric_columns(df, exclude))[:max_columns]
    choose = combinations if interaction_only else combinations_with_replacement
    terms = chain.from_iterable(choose(names, d) for d in range(2, degree + 1))

    def product(term: Sequence[str]) -> Column:
        out = F.lit(1.0)
        for c in term:
            out = out * F.coalesce(present(df, c).cast("double"), F.lit(0.0))
        return out

    return df.select("*", *[product(t).alias(term_name(t)) for t in terms])


def generate_features(
    df: DataFrame,
    polynomial_degree: int = 0,
    interaction_only: bool = False,
    extract_date_features: bool = True,
    extract_text_length: bool = True,
    exclude: Sequence[str] = (),
    max_columns: int | None = None,
) -> DataFrame:
    base = numeric_columns(df, exclude)
    out = df
    if extract_date_features:
        out = date_features(out, exclude)
    if extract_text_length:
        texts = columns_of(df, "string", exclude=exclude)
        out = out.select("*", *[F.length(F.coalesce(ref(c), F.lit(MISSING_TEXT))).alias(f"{c}__length") for c in texts])
    if polynomial_degree >= 2 and base:
        out = polynomial_terms(out, polynomial_degree, interaction_only, base, max_columns=max_columns)
    return out

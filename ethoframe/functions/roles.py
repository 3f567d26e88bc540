"""Column roles by name: keys, treatment ``T``, covariates ``W_*``, outcomes ``Y_*``
and predictions ``Yhat_*``."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame


def normalised(name: str) -> str:
    return re.sub(r"[-_\s]", "", name).lower()


def find_column(columns: list[str], *candidates: str) -> str:
    """The first candidate that is a column, exactly or in its normalised form."""
    for wanted in candidates:
        if wanted in columns:
            return wanted
    by_form = {normalised(c): c for c in reversed(columns)}
    for wanted in candidates:
        if normalised(wanted) in by_form:
            return by_form[normalised(wanted)]
    raise KeyError(f"none of {candidates} among {columns}")


@dataclass(frozen=True)
class Roles:
    covariates: tuple[str, ...]
    outcomes: tuple[str, ...]
    predictions: tuple[str, ...]


def roles(df: DataFrame) -> Roles:
    def named(prefix: str) -> tuple[str, ...]:
        return tuple(sorted(c for c in df.columns if c.startswith(prefix)))

    return Roles(named("W_"), named("Y_"), named("Yhat_"))


def in_order(df: DataFrame, first: tuple[str, ...] = ()) -> DataFrame:
    """Base columns, then covariates, outcomes and predictions by name."""
    r = roles(df)
    by_role = {*r.covariates, *r.outcomes, *r.predictions}
    base = [c for c in first if c in df.columns] + [c for c in df.columns if c not in by_role and c not in first]
    return df.select(*base, *r.covariates, *r.outcomes, *r.predictions)


def without_suffix(df: DataFrame, suffix: str) -> DataFrame:
    """``df`` without the columns whose name ends so."""
    return df.drop(*[c for c in df.columns if c.endswith(suffix)])

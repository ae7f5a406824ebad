"""Settings from the environment, read where a run begins and passed on as values."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The texts that mean yes, in any case; every other text means no.
YES = ["1", "true", "yes", "on"]


def flag(name: str, default: bool, environment=os.environ) -> bool:
    value = environment.get(name)
    return default if value is None else value.strip().lower() in YES


def flag_of(value, default: bool) -> Column:
    """The same for a column of texts; null has the default."""
    return F.when(value.isNull(), default).otherwise(F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", "")).isin(*YES))

"""Service-account principals written ``system:serviceaccount:<namespace>:<name>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(principal: Column, index: int) -> Column:
    # Parts go by position; the literal prefix is not checked.
    return F.coalesce(F.get(F.split(principal, ":"), F.lit(index)), F.lit(""))


def principal_namespace(principal: Column) -> Column:
    return _part(principal, 2)


def principal_account(principal: Column) -> Column:
    return _part(principal, 3)

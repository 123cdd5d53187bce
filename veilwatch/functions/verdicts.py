"""Verdict and threat structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwatch.functions.text import strings

THREAT_TYPE = ("struct<code:string,tool:string,subject:string,"
               "details:array<string>,inner_code:string>")
OUTCOME_TYPE = f"struct<verdict:string,masked:boolean,threat:{THREAT_TYPE},query:string>"


def _part(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def threat(code, tool=None, subject=None, details: Column | None = None, inner_code=None) -> Column:
    """A threat; fields are given in the order of ``THREAT_TYPE``."""
    return F.struct(_part(code), _part(tool), _part(subject),
                    strings([]) if details is None else details, _part(inner_code))


def _outcome(verdict: str, masked: bool, what: Column, query: Column | None = None) -> Column:
    return F.struct(F.lit(verdict), F.lit(masked), what, _part(query)).cast(OUTCOME_TYPE)


def allow() -> Column:
    return _outcome("Allow", False, F.lit(None))


def warn(what: Column) -> Column:
    return _outcome("Warn", False, what)


def block(what: Column) -> Column:
    return _outcome("Block", False, what)


def masked(what: Column, query: Column | None = None) -> Column:
    """A block whose protected output has been masked, for SQL with the query that masks it."""
    return _outcome("Block", True, what, query)


def chain(first: Column, second: Column) -> Column:
    """The second outcome only where the first allows."""
    return F.when(first["verdict"] == "Allow", second).otherwise(first)

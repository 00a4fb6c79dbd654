"""The filter algebra: conditions, their connectives and the time range, compiled to one Column.

Logic is two-valued. A missing field is '', an uncastable number or an unusable pattern makes a condition
false, and NOT applies after that.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FilterError
from ..schema import PRESETS, field_name

NUMERIC = {">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}
OPERATORS = ["==", "!=", "contains", "startswith", "endswith", "regex", *NUMERIC]
TIME_FORMAT = "%Y-%m-%d %H:%M:%S"

#: Numbers as text: underscores may stand between digits; infinities and blanks around are allowed.
_DIGITS = "[0-9](?:_?[0-9])*"
_NUMBER = f"^\\s*[+-]?(?:(?:{_DIGITS}\\.?(?:{_DIGITS})?|\\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?|(?i:inf|infinity))\\s*$"


@dataclass(frozen=True)
class Condition:
    field: str
    operator: str
    value: str
    case_sensitive: bool = False
    negate: bool = False
    #: AND or OR with what stands before; ignored for the first condition.
    connective: str = "AND"

    def describe(self) -> str:
        return f"{'NOT ' if self.negate else ''}{self.field} {self.operator} '{self.value}'"


def as_number(c: Column) -> Column:
    """A string's value as a double, NULL if it isn't written as a number or is not a number (nan)."""
    return F.when(c.rlike(_NUMBER), F.replace(F.btrim(c, F.lit(" \t\n\x0b\x0c\r")), F.lit("_"), F.lit("")).try_cast("double"))


def java_pattern(pattern: str) -> str | None:
    """The pattern in Java's dialect, or None if it is invalid."""
    try:
        re.compile(pattern)
    except re.error:
        return None
    out = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
    out = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", out)
    out = re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", out)
    session = SparkSession.getActiveSession()
    if session is not None:
        try:
            session._jvm.java.util.regex.Pattern.compile(out)
        except Exception:
            return None
    return out


def compare(c: Column, operator: str, value: str, case_sensitive: bool = False) -> Column:
    """One operator on a string column, never NULL."""
    c = F.coalesce(c.cast("string"), F.lit(""))
    if not case_sensitive:
        c = F.lower(c)
    v = value if case_sensitive else value.lower()
    if operator == "==":
        return c == F.lit(v)
    if operator == "!=":
        return c != F.lit(v)
    if operator == "contains":
        return F.contains(c, F.lit(v))
    if operator == "startswith":
        return F.startswith(c, F.lit(v))
    if operator == "endswith":
        return F.endswith(c, F.lit(v))
    if operator == "regex":
        # The pattern isn't lower-cased, though the field is: flags make up for most of that.
        pattern = java_pattern(value)
        if pattern is None:
            return F.lit(False)
        return c.rlike(pattern if case_sensitive else f"(?iu){pattern}")
    if operator in NUMERIC:
        try:
            number = float(v)
        except ValueError:
            return F.lit(False)
        if number != number:
            return F.lit(False)
        return F.coalesce(NUMERIC[operator](as_number(c), F.lit(number)), F.lit(False))
    return F.lit(False)


def columns_of(df: DataFrame, labels: bool = True) -> Callable[[str], list[Column]]:
    """Finds the columns that a field's name stands for in df; an unknown field is ''.

    An interface is its physical and its display name; the label is there if it was joined.
    """
    names = set(df.columns)

    def find(name: str) -> list[Column]:
        if name == "interface" and "interface_display" in names:
            return [F.col("interface"), F.col("interface_display")]
        if name == "__label__":
            name = "rule_label" if labels else ""
        return [F.col(f"`{name}`")] if name in names else [F.lit("")]

    return find


@dataclass(frozen=True)
class FilterSpec:
    """An immutable list of conditions with an inclusive time range.

    assoc: how connectives associate without parentheses. "left": ((A o B) o C), as expressions are
    evaluated one by one; "right": A o (B o C), as short-circuit evaluation from the left does.
    labels: whether __label__ means the joined rule label; else it is ''.
    """

    conditions: tuple[Condition, ...] = ()
    start: dt.datetime | None = None
    end: dt.datetime | None = None
    assoc: str = "left"
    labels: bool = True
    time_column: str = field(default="ts_effective")

    def where(self, name: str, operator: str, value: str, *, connective: str = "AND", negate: bool = False, case_sensitive: bool = False) -> FilterSpec:
        if not name or value == "":
            raise FilterError("a condition needs a field and a value", field=name, value=value)
        return replace(self, conditions=(*self.conditions, Condition(field_name(name), operator, value, case_sensitive, negate, connective)))

    def without(self, index: int) -> FilterSpec:
        kept = tuple(c for k, c in enumerate(self.conditions) if k != index)
        return replace(self, conditions=kept)

    def between(self, start=None, end=None) -> FilterSpec:
        return replace(self, start=read_time(start), end=read_time(end))

    def clear(self) -> FilterSpec:
        return replace(self, conditions=(), start=None, end=None)

    def describe(self) -> str:
        parts = [f" {c.connective} {c.describe()}" if k else c.describe() for k, c in enumerate(self.conditions)]
        if self.start or self.end:
            since = f"from {self.start:{TIME_FORMAT}} " if self.start else ""
            until = f"to {self.end:{TIME_FORMAT}}" if self.end else ""
            parts.append(f"Time range: {since}{until}")
        return " | ".join(parts) or "No filters active"

    def to_column(self, find: Callable[[str], list[Column]]) -> Column:
        """The whole filter: the time range, and the conditions folded by assoc."""
        known = [(c.connective.upper(), self._one(c, find)) for k, c in enumerate(self.conditions) if k == 0 or c.connective.upper() in ("AND", "OR")]
        join = lambda how, a, b: a & b if how == "AND" else a | b
        if not known:
            expression = F.lit(True)
        elif self.assoc == "left":
            expression = known[0][1]
            for how, c in known[1:]:
                expression = join(how, expression, c)
        else:
            expression = known[-1][1]
            for (_, c), (how, _) in zip(reversed(known[:-1]), reversed(known[1:]), strict=True):
                expression = join(how, c, expression)
        if self.end is not None:
            expression = F.coalesce(F.col(self.time_column) <= F.lit(self.end).cast("timestamp_ntz"), F.lit(False)) & expression
        if self.start is not None:
            expression = F.coalesce(F.col(self.time_column) >= F.lit(self.start).cast("timestamp_ntz"), F.lit(False)) & expression
        return expression

    @staticmethod
    def _one(c: Condition, find: Callable[[str], list[Column]]) -> Column:
        hit = F.lit(False)
        for column in find(c.field):
            hit = hit | compare(column, c.operator, c.value, c.case_sensitive)
        return ~hit if c.negate else hit

    def apply(self, df: DataFrame) -> DataFrame:
        return df.filter(self.to_column(columns_of(df, self.labels)))


def read_time(value) -> dt.datetime | None:
    if value is None or value == "" or isinstance(value, dt.datetime):
        return value or None
    try:
        return dt.datetime.strptime(value, TIME_FORMAT)
    except ValueError as e:
        raise FilterError(f"time is not written as YYYY-MM-DD HH:MM:SS: {value}") from e


def preset(name: str) -> FilterSpec:
    """One of the named filters, which stands alone: all, blocked, allowed, tcp, udp."""
    if name not in PRESETS:
        raise FilterError(f"no such preset: {name}")
    condition = PRESETS[name]
    return FilterSpec() if condition is None else FilterSpec().where(condition[0], "==", condition[1])


def row_udf(predicate: Callable[[dict], bool]) -> Callable[[DataFrame], DataFrame]:
    """The escape hatch for a predicate that is only a Python function of a row's fields.

    Rows travel in Arrow batches; prefer FilterSpec, which stays in the JVM.
    """

    def apply(df: DataFrame) -> DataFrame:
        import pandas as pd

        def keep(batches):
            for pdf in batches:
                rows = pdf.where(pdf.notna(), None).to_dict("records")
                mask = [bool(predicate({k: v for k, v in r.items() if v is not None})) for r in rows]
                yield pdf[pd.Series(mask, index=pdf.index, dtype=bool)]

        return df.mapInPandas(keep, df.schema)

    return apply

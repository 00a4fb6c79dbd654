"""A log as a user holds it: load, enrich, filter, page, tail, export. Every step gives a new lazy view."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row, SparkSession

from .functions.predicates import FilterSpec, preset
from .operators import enrich, export, view
from .operators.parse import parse_lines
from .schema import DEFAULT_PAGE
from .sources import config, rules
from .sources.text import iterate, read_lines


@dataclass(frozen=True)
class LogFrame:
    lines: DataFrame
    rows: DataFrame
    spec: FilterSpec = FilterSpec()

    @classmethod
    def load(cls, spark: SparkSession, path: str | list[str], *, max_lines: int | None = None, **options) -> LogFrame:
        """Lines are numbered over all files; options are parse_lines'."""
        lines = read_lines(spark, path, max_lines=max_lines, numbered=True)
        return cls(lines, parse_lines(lines, **options))

    # Dimensions. A view's filter is applied when rows are asked for, so it sees all of them.
    def with_interfaces(self, interfaces: DataFrame | dict[str, str]) -> LogFrame:
        if isinstance(interfaces, dict):
            interfaces = self.rows.sparkSession.createDataFrame(list(interfaces.items()), "physical string, display string")
        return replace(self, rows=enrich.interface_display(self.rows, interfaces))

    def with_labels(self, labels: DataFrame | dict[str, str]) -> LogFrame:
        if isinstance(labels, dict):
            labels = self.rows.sparkSession.createDataFrame(list(labels.items()), "rid string, description string")
        return replace(self, rows=enrich.rule_labels(self.rows, labels))

    def with_rules(self, path: str) -> LogFrame:
        return self.with_labels(rules.read_rules(self.rows.sparkSession, path))

    def with_config(self, path: str) -> LogFrame:
        """Interface names, and address and port aliases of both ends."""
        spark = self.rows.sparkSession
        nets, ports = config.aliases(spark, path)
        rows = enrich.interface_display(self.rows, config.interfaces(spark, path))
        for c in ("src", "dst"):
            rows = enrich.ip_alias(rows, nets, c)
        for c in ("srcport", "dstport"):
            rows = enrich.port_alias(rows, ports, c)
        return replace(self, rows=rows)

    # Filters.
    def where(self, name: str, operator: str, value: str, **options) -> LogFrame:
        return replace(self, spec=self.spec.where(name, operator, value, **options))

    def between(self, start=None, end=None) -> LogFrame:
        return replace(self, spec=self.spec.between(start, end))

    def filtered(self, spec: FilterSpec) -> LogFrame:
        return replace(self, spec=spec)

    def preset(self, name: str) -> LogFrame:
        return replace(self, spec=preset(name))

    def without_filter(self) -> LogFrame:
        return replace(self, spec=self.spec.clear())

    @property
    def summary(self) -> str:
        return self.spec.describe()

    @property
    def view(self) -> DataFrame:
        return self.spec.apply(self.rows)

    def select_where(self, condition: Column) -> DataFrame:
        return self.view.where(condition)

    # What is shown.
    def count(self) -> int:
        return self.view.count()

    def counts(self) -> Row:
        return view.counts(self.lines, self.rows, self.view).first()

    def total_pages(self, size: int = DEFAULT_PAGE) -> int:
        return view.total_pages(self.count(), size)

    def page(self, number: int, size: int = DEFAULT_PAGE) -> DataFrame:
        """Pages run over parsed rows, from 0; a number past either end is the page there."""
        n = view.clamp_page(number, self.count(), size)
        return view.table_rows(view.page_by_rank(self.view, n, size))

    def tail(self, n: int) -> DataFrame:
        return view.tail(self.view, n)

    def details(self, row_idx: int) -> DataFrame:
        return view.details(self.rows, row_idx)

    def sorted_by(self, column: str, descending: bool = False) -> DataFrame:
        return view.sorted_by(self.view, column, descending)

    def __iter__(self) -> Iterator[Row]:
        return iterate(self.view)

    def export(self, path: str) -> int:
        return export.write_single(self.view.orderBy("row_idx"), path)

"""The whole job: files, format, filters, shown lines."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklines.model import FIELD, FilterDef, load_filters
from sparklines.operators.detect import detect_formats, with_parts
from sparklines.operators.visibility import needs_parts, parse_field_filter, visible_lines
from sparklines.sources.lines import read_lines, strip_control, write_lines
from sparklines.sources.ranges import STEP, head_of_files, last_shown


@dataclass
class FilterJob:
    """What a command line would ask for. Filters run in the order: file, include, exclude, fields."""

    path: str | list[str]
    filter_file: str | None = None
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    fields: list[str] = field(default_factory=list)
    format: str | None = None
    clean: bool = False

    def filters(self) -> list[FilterDef]:
        items = [(f.filter_type, f.pattern, f.enabled) for f in (load_filters(self.filter_file) if self.filter_file else [])]
        items += [("Include", p, True) for p in self.include] + [("Exclude", p, True) for p in self.exclude]
        items += [("Include", FIELD + ":".join(parse_field_filter(x, "=")), True) for x in self.fields]
        return [FilterDef(i, p, t, on) for i, (t, p, on) in enumerate(dict.fromkeys(items))]

    def run(self, spark: SparkSession, out: str | None = None) -> DataFrame:
        """Shown lines(src, line_idx, raw); also written as text in order if out is given. Lines are only parsed if a filter needs it."""
        lines, filters = read_lines(spark, self.path, clean=self.clean), self.filters()
        if needs_parts(filters):
            lines = with_parts(lines, self.format or detect_formats(lines))
        shown = visible_lines(lines, filters).select("src", "line_idx", "raw")
        if out:
            write_lines(shown, out)
        return shown

    def run_tail(self, spark: SparkSession, n: int = 200, step: int = STEP) -> DataFrame:
        """The last n shown lines(src, at, raw) of each file, found from the end backwards; the format, if a filter needs it, from the files' heads."""
        filters, format_ = self.filters(), self.format
        if needs_parts(filters) and not format_:
            first = head_of_files(spark, self.path, 1 << 16)  # one range of each file, so that its numbers are those of the lines
            format_ = detect_formats(first.select("src", F.col("mid").alias("line_idx"), "raw"))

        def shown(lines: DataFrame) -> DataFrame:
            lines = lines.withColumn("raw", strip_control(F.col("raw"))) if self.clean else lines
            return visible_lines(with_parts(lines, format_) if needs_parts(filters) else lines, filters)

        return last_shown(spark, self.path, shown, n, step)

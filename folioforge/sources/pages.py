"""Pages of a paged file as rows of tokens: a data source around an injected reader of pages."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TOKENS = "page int, width double, height double, kind string, text string, x0 double, x1 double, top double, bottom double, y0 double, y1 double, size double, fontname string, upright boolean, matrix array<double>"
COLUMNS = [c.split()[0] for c in TOKENS.split(", ")]


def page_range(first: int, last: int | None, total: int) -> tuple[int, int]:
    """Pages from 1; no last, and none beyond the file's, means its last, with a warning for the latter; a bad range is an error."""
    end = last or total
    if first < 1 or end < first:
        raise ValueError(f"RULE=PAGE_RANGE_INVALID PDF_PAGE=unknown detail={first}-{end} of {total}")
    if end > total:
        warnings.warn(f"PAGE_RANGE_CLAMPED: end {end} is beyond {total}", stacklevel=2)
    return first, min(end, total)


class Span(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__(first)
        self.first, self.last = first, last


def page_source(name: str, count: Callable[[str], int], extract: Callable[[str, int, int], Iterable[dict]]) -> type[DataSource]:
    """A class for spark.dataSource.register; then spark.read.format(name).load(path) gives TOKENS.

    count(path) is the file's number of pages; extract(path, first, last) gives dicts of these pages' words, chars, edges,
    lines and rectangles (`kind`), with any of the columns, `page` among them. It runs on the executors, `pages_per_task`
    (50) pages in a task, so path must be one that they can open. Options page_start and page_end limit the pages. A page
    without chars is an error there, as it can't be laid out; allow_blank=true lets it be.
    """

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.path = options["path"]
            self.first, self.last = int(options.get("page_start") or 1), int(options.get("page_end") or 0)
            self.step = max(1, int(options.get("pages_per_task") or 50))
            self.blank = str(options.get("allow_blank", "")).lower() == "true"

        def partitions(self):
            first, last = page_range(self.first, self.last or None, count(self.path))
            return [Span(p, min(last, p + self.step - 1)) for p in range(first, last + 1, self.step)]

        def read(self, partition):
            drawn = set()
            for token in extract(self.path, partition.first, partition.last):
                if token.get("kind") == "char":
                    drawn.add(token["page"])
                yield tuple(token.get(c) for c in COLUMNS)
            missing = sorted(set(range(partition.first, partition.last + 1)) - drawn)
            if missing and not self.blank:
                raise ValueError(f"RULE=CHAR_DATA_MISSING PDF_PAGE={missing[0]} detail=no chars on the page")

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return TOKENS

        def reader(self, schema) -> DataSourceReader:
            return Reader(dict(self.options))

    return Pages

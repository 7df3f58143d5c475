"""A source for services that answer by region and time window: one partition per request, filters pushed down.

The service itself is a plain function, named as ``package.module:function``, that takes (region, first year, last
year, characteristics; none named: all) and returns a list of tuples in the order of the schema. Without a network it
can read a landing zone.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from importlib import import_module

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, LessThanOrEqual


def year_windows(first: int, last: int, width: int) -> list[tuple[int, int]]:
    """Consecutive windows of ``width`` years that cover first to last."""
    return [(y, min(y + width - 1, last)) for y in range(first, last + 1, width)]


def _function(name: str):
    module, attribute = name.split(":")
    return getattr(import_module(module), attribute)


class Request(InputPartition):
    def __init__(self, region: str, first: int, last: int, characteristics: tuple[str, ...]):
        self.region, self.first, self.last, self.characteristics = region, first, last, characteristics


class WindowedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        parted = lambda name: tuple(x for x in options.get(name, "").split(",") if x)
        self.fetch = options["fetch"]
        self.regions = list(parted("regions") or _function(options["catalogue"])())
        self.characteristics = parted("characteristics")
        self.first, self.last, self.width = int(options.get("first", 1990)), int(options.get("last", 2025)), int(options.get("width", 9))
        self.tries, self.pause = int(options.get("tries", 4)), float(options.get("pause", 2))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Region, characteristic and year bounds narrow the requests; all filters are applied again by Spark."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") else None
            among = (f.value,) if isinstance(f, EqualTo) else tuple(f.value) if isinstance(f, In) else None
            if name == "region" and among is not None:
                self.regions = [r for r in self.regions if r in among]
            elif name == "characteristic" and among is not None:
                self.characteristics = tuple(c for c in self.characteristics if c in among) if self.characteristics else among
                self.regions = self.regions if self.characteristics else []
            elif name == "year" and isinstance(f, EqualTo):
                self.first, self.last = max(self.first, f.value), min(self.last, f.value)
            elif name == "year" and isinstance(f, GreaterThanOrEqual):
                self.first = max(self.first, f.value)
            elif name == "year" and isinstance(f, LessThanOrEqual):
                self.last = min(self.last, f.value)
            yield f

    def partitions(self) -> list[Request]:
        return [Request(r, a, b, self.characteristics) for r in self.regions for a, b in year_windows(self.first, self.last, self.width)]

    def read(self, partition: Request | None) -> Iterator[tuple]:
        if partition is None:  # what is left to ask for after the filters: nothing
            return
        call = _function(self.fetch)
        for k in range(self.tries):
            try:
                rows = call(partition.region, partition.first, partition.last, partition.characteristics)
                break
            except OSError:
                if k == self.tries - 1:
                    raise
                time.sleep(self.pause * (k + 1))
        yield from rows


class WindowedSource(DataSource):
    """``spark.read.format("windowed")`` with a schema that holds region and year, and the options fetch, regions or
    catalogue, characteristics, first, last, width, tries, pause.

    ``catalogue`` names a function that lists the regions where ``regions`` is not given.
    """

    @classmethod
    def name(cls) -> str:
        return "windowed"

    def schema(self) -> str:
        return self.options.get("columns", "region string, year int, station_id string, characteristic string, value double, unit string")

    def reader(self, schema) -> WindowedReader:
        return WindowedReader(self.options)

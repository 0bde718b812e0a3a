"""Quarterly index files as a Spark data source: a partition for each year and quarter.

The fetcher is given by name (module:function of year, quarter and form of the text), so that tests and mirrors need
no network. A missing quarter has no row; one that can't be fetched has a row with its error, so that the others are
read nevertheless. Each task waits `delay` seconds before a request (by default a tenth of a second for each of the
`tasks` that share the public limit of ten requests a second), and the quarters are dealt to that many tasks.
"""

from __future__ import annotations

import importlib
import time
import urllib.error
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


DELAY = 0.1


class Quarters(InputPartition):
    def __init__(self, quarters: list[tuple[int, int]]):
        super().__init__(tuple(quarters))
        self.quarters = quarters


def fetch(url: str, agent: str, tries: int = 5, timeout: float = 30.0, wait=time.sleep, delay: float = 0.0) -> str:
    """The text at a URL; empty if there is none. Only a refusal for too many requests is tried again, ever later."""
    for attempt in range(1, tries + 1):
        if delay:
            wait(delay)
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as r:
                return r.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return ""
            if e.code != 429 or attempt == tries:
                raise
            wait(max(1.0, 0.5 * attempt))
    return ""


class QuarterlyIndex(DataSource):
    """spark.dataSource.register(QuarterlyIndex); spark.read.format("quarterly_index").option("years", "2020,2021")
    .option("fetcher", "module:function").option("tasks", "1").load(): path, value, error."""

    @classmethod
    def name(cls) -> str:
        return "quarterly_index"

    def schema(self) -> str:
        return "path STRING, value STRING, error STRING"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.years = [int(y) for y in options["years"].split(",")]
        self.fetcher, self.base, self.agent = options.get("fetcher"), options.get("base", ""), options.get("agent", "")
        self.tasks = int(options.get("tasks", "1"))
        self.delay = float(options.get("delay", str(DELAY * self.tasks)))

    def partitions(self):
        quarters = [(y, q) for y in self.years for q in range(1, 5)]
        return [Quarters(quarters[i :: self.tasks]) for i in range(min(self.tasks, len(quarters)))]

    def read(self, partition):
        for year, quarter in partition.quarters:
            name = f"{year}/QTR{quarter}/company.idx"
            try:
                if self.fetcher:
                    module, _, function = self.fetcher.partition(":")
                    text = getattr(importlib.import_module(module), function)(year, quarter)
                else:
                    text = fetch(f"{self.base.rstrip('/')}/{name}", self.agent, delay=self.delay)
            except Exception as e:  # noqa: BLE001 - one quarter must not stop the others
                yield (name, None, str(e))
                continue
            if text:
                yield (name, text, None)

"""Price files of several providers as one table: planned by code and year, read in an order of preference.

``{root}/{provider}/{kind}/{code}.csv`` holds a provider's frame with its own column names. A fund has the
kinds ``unit_nav`` and ``cumulative_nav``, which are joined; an ETF or an index has ``daily``. For each code
the first provider in order whose file has rows is taken, found out once while the read is planned; every
year is a partition of its own. Filters on code and date choose partitions and rows before anything is sent.
"""

from __future__ import annotations

import csv
import datetime as dt
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from fathomline.sources.prices import CUMULATIVE_NAV, DAILY_BARS, UNIT_NAV

SCHEMA = "date date, code string, provider string, nav double, cumulative_nav double, daily_growth_rate double, open double, high double, low double, close double, volume double, amount double, price double"
#: Kinds of files that make up a kind of instrument, the first one holding its rows.
FILES = {"fund": ("unit_nav", "cumulative_nav"), "etf": ("daily",), "index": ("daily",)}
NAMES = {"unit_nav": UNIT_NAV, "cumulative_nav": CUMULATIVE_NAV, "daily": DAILY_BARS}
#: What a file must at least have, once renamed.
NEEDED = {"unit_nav": {"date", "nav"}, "cumulative_nav": {"date", "cumulative_nav"}, "daily": {"date", "close"}}


@dataclass
class Year(InputPartition):
    provider: str
    kind: str
    code: str
    first: dt.date
    last: dt.date


def _rows(root: str, provider: str, file: str, code: str) -> list[dict]:
    """A file's rows under standard names; none if it is missing. A missing column raises."""
    system, path = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    at = f"{path.rstrip('/')}/{provider}/{file}/{code}.csv"
    if system.get_file_info(at).type != fs.FileType.File:
        return []
    with system.open_input_stream(at) as stream:
        text = io.StringIO(stream.read().decode("utf-8-sig"))
    rows = [{NAMES[file].get(k, k): v for k, v in r.items()} for r in csv.DictReader(text)]
    if rows and (missing := NEEDED[file] - rows[0].keys()):
        raise ValueError(f"{at} lacks {sorted(missing)}")
    return rows


def _number(text: str | None) -> float | None:
    try:
        x = float(text)
    except (TypeError, ValueError):
        return None
    return x if x == x else None


def _day(text: str | None) -> dt.date | None:
    try:
        return dt.date.fromisoformat((text or "").strip()[:10].replace("/", "-"))
    except ValueError:
        return None


class ProviderReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["root"]
        self.providers = options["providers"].split(",")
        self.codes = dict(x.split(":") for x in options["codes"].split(","))  # code: kind
        if unknown := set(self.codes.values()) - set(FILES):
            raise ValueError(f"unknown kinds: {sorted(unknown)}")
        self.first, self.last, self.wanted = dt.date.min, dt.date.max, None

    def pushFilters(self, filters):
        """Codes and spans of dates are settled here; other filters go back to Spark."""
        for f in filters:
            name, value = f.attribute, getattr(f, "value", None)
            if name == ("code",) and isinstance(f, (EqualTo, In)):
                chosen = {value} if isinstance(f, EqualTo) else set(value)
                self.wanted = chosen if self.wanted is None else self.wanted & chosen
            elif name == ("date",) and isinstance(f, (GreaterThanOrEqual, GreaterThan)):
                self.first = max(self.first, value + dt.timedelta(isinstance(f, GreaterThan)))
            elif name == ("date",) and isinstance(f, (LessThanOrEqual, LessThan)):
                self.last = min(self.last, value - dt.timedelta(isinstance(f, LessThan)))
            else:
                yield f

    def partitions(self) -> list[Year]:
        out = []
        for code, kind in sorted(self.codes.items()):
            if self.wanted is not None and code not in self.wanted:
                continue
            for provider in self.providers:
                days = [d for d in (_day(r["date"]) for r in _rows(self.root, provider, FILES[kind][0], code)) if d]
                if days:
                    break
            else:
                raise ValueError(f"no provider has rows of {code}")
            first, last = max(min(days), self.first), min(max(days), self.last)
            out += [Year(provider, kind, code, max(first, dt.date(y, 1, 1)), min(last, dt.date(y, 12, 31))) for y in range(first.year, last.year + 1) if first <= last]
        return out or [Year("", "", "", dt.date.max, dt.date.min)]

    def read(self, part: Year) -> Iterator[pa.RecordBatch]:
        if not part.code:
            return
        main, *more = FILES[part.kind]
        rows: dict[dt.date, dict] = {}
        for r in _rows(self.root, part.provider, main, part.code):
            day = _day(r["date"])
            if day and part.first <= day <= part.last:
                rows[day] = r  # of a date the last row
        for file in more:
            for r in _rows(self.root, part.provider, file, part.code):
                if (day := _day(r["date"])) in rows:
                    rows[day] = rows[day] | {k: v for k, v in r.items() if k not in rows[day]} | {k: r[k] for k in NEEDED[file] - {"date"}}
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        out = []
        for day, r in sorted(rows.items()):
            found = {c: _number(r.get(c)) for c in names[3:]}
            found["price"] = found["close"] if found["price"] is None else found["price"]
            if any(v is not None for v in found.values()):
                out.append((day, part.code, part.provider, *found.values()))
        if out:
            kinds = [pa.date32(), pa.string(), pa.string(), *[pa.float64()] * (len(names) - 3)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


class ProviderPrices(DataSource):
    """``spark.read.format("provider_prices")`` with the options ``root``, ``providers`` and ``codes`` (``code:kind,...``)."""

    @classmethod
    def name(cls) -> str:
        return "provider_prices"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ProviderReader:
        return ProviderReader(self.options)


def read_providers(spark: SparkSession, root: str, providers: list[str], codes: dict[str, str]):
    """All rows of ``codes`` (code: kind) from the first provider that has each."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ProviderPrices)
    return spark.read.format("provider_prices").options(root=root, providers=",".join(providers), codes=",".join(f"{c}:{k}" for c, k in codes.items())).load()

"""Daily files of many contracts as one data source: a scan whose partitions are the contracts' files.

    spark.dataSource.register(ContractFiles)
    spark.read.format("contract_files").option("root", folder).load().filter("contract IN ('ESH4', 'ESM4') AND ts >= '2024-01-01'")

The folder has a <contract>.csv for each contract, a file or a folder of parts, as named columns Date, Open, High, Low, Close, Volume and
perhaps Open Interest. Executors read and convert the files. Where the session lets filters reach Python sources
(spark.sql.python.filterPushdown.enabled), contracts that a filter rules out aren't opened and times are cut in the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Column names of daily files.
DAILY_COLUMNS = {"Open": "open", "High": "high", "Low": "low", "Close": "close", "Volume": "volume", "Open Interest": "open_interest"}
#: Files of the folder that aren't a contract's.
LISTS = {"contracts"}
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class ContractFile(InputPartition):
    contract: str
    path: str
    first: datetime | None
    last: datetime | None


class ContractReader(DataSourceReader):
    def __init__(self, options: dict):
        if "root" not in options:
            raise ValueError("contract_files needs the option root")
        self.root = options["root"].rstrip("/")
        self.only: set[str] | None = None
        self.first: datetime | None = None
        self.last: datetime | None = None

    def _system(self):
        return pa.fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (pa.fs.LocalFileSystem(), self.root)

    def partitions(self) -> list[ContractFile]:
        fs, root = self._system()
        out = []
        for f in sorted(fs.get_file_info(pa.fs.FileSelector(root)), key=lambda f: f.path):
            name = f.base_name.removesuffix(".csv")
            if f.base_name == name or name in LISTS or self.only is not None and name not in self.only:
                continue
            parts = [f] if f.type == pa.fs.FileType.File else [p for p in fs.get_file_info(pa.fs.FileSelector(f.path)) if p.type == pa.fs.FileType.File and p.base_name[0] not in "_."]
            out += [ContractFile(name, p.path, self.first, self.last) for p in sorted(parts, key=lambda p: p.path) if p.size]
        return out or [ContractFile("", "", None, None)]  # Spark asks for one at least

    def read(self, partition: ContractFile) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        names = ["Date", *DAILY_COLUMNS]
        types = {"Date": pa.date32(), **dict.fromkeys(DAILY_COLUMNS, pa.float64())}
        with self._system()[0].open_input_stream(partition.path) as source:
            reader = pa.csv.open_csv(source, convert_options=pa.csv.ConvertOptions(column_types=types, include_columns=names, include_missing_columns=True))
            for b in reader:
                ts = b.column(0).cast(pa.timestamp("us")).cast(pa.timestamp("us", "UTC"))
                keep = pa.array([True] * b.num_rows)
                for bound, ok in ((partition.first, pc.greater_equal), (partition.last, pc.less_equal)):
                    if bound is not None:
                        keep = pc.and_(keep, ok(ts, pa.scalar(bound, ts.type)))
                yield pa.RecordBatch.from_arrays([pa.array([partition.contract] * b.num_rows, pa.string()), ts, *b.columns[1:]], names=["contract", "ts", *DAILY_COLUMNS.values()]).filter(keep)


class FilteredReader(ContractReader):
    """With filters: a contract's are applied here; those of times cut a day beyond their value, and Spark applies them again."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("contract",):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = own if self.only is None else self.only & own
                continue
            if getattr(f, "attribute", None) == ("ts",) and isinstance(getattr(f, "value", None), datetime):
                at = f.value.replace(tzinfo=None)
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.first = max(x for x in (self.first, at - timedelta(days=1)) if x is not None)
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.last = min(x for x in (self.last, at + timedelta(days=1)) if x is not None)
            yield f


class ContractFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "contract_files"

    def schema(self) -> str:
        return "contract string, ts timestamp, " + ", ".join(f"{c} double" for c in DAILY_COLUMNS.values())

    def reader(self, schema) -> DataSourceReader:
        return (FilteredReader if self.options.get("pushdown") == "true" else ContractReader)(self.options)


def contract_bars(spark: SparkSession, root: str) -> DataFrame:
    """All contracts of a folder in one scan."""
    spark.dataSource.register(ContractFiles)
    return spark.read.format("contract_files").option("root", root).option("pushdown", spark.conf.get(PUSHDOWN, "false")).load()

"""Saved responses of web servers as a data source of Spark: `spark.read.format("responses")`, and as a stream.

`save` writes a batch of responses to `batch=<number>/host=<host>/`; batches are numbered from 0 on. The reader makes a
partition of each host's file, so hosts are read side by side; of the hosts, the times and the batches asked for, by
pushed filters or by the options `host`, `since` and `until`, only those files are
opened whose folder and statistics allow it. A stream's offset is the number of batches read; a batch counts once its
folder is complete, in order, so that a query that starts again reads none twice and leaves none out.

Files are opened by pyarrow in the executors: local or mounted folders, and the stores that its file systems know.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: status: of the response; etag, modified: as the server sent them; saved_at: when it was received.
SCHEMA = "url string, status int, etag string, modified string, body binary, saved_at timestamp, host string, batch int"
_FIELDS = ("url", "status", "etag", "modified", "body", "saved_at")


class _File(InputPartition):
    def __init__(self, path: str, host: str, batch: int):
        self.path, self.host, self.batch = path, host, batch


def _folder(path: str):
    """(file system, path) of a folder."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


def _batches(path: str) -> list[int]:
    """Numbers of the batches that are complete, up to the first gap."""
    from pyarrow import fs

    store, at = _folder(path)
    found = {int(x.base_name[6:]) for x in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if x.base_name.startswith("batch=") and x.base_name[6:].isdigit()}
    out = []
    while len(out) in found and store.get_file_info(f"{at}/batch={len(out)}/_SUCCESS").type == fs.FileType.File:
        out.append(len(out))
    return out


def _files(path: str, batches: list[int], hosts: set[str] | None) -> list[_File]:
    from urllib.parse import unquote

    from pyarrow import fs

    store, at = _folder(path)
    out = []
    for b in batches:
        for x in store.get_file_info(fs.FileSelector(f"{at}/batch={b}", recursive=True)):
            parts = x.path.split("/")
            if x.type == fs.FileType.File and x.base_name.endswith(".parquet") and parts[-2].startswith("host="):
                host = unquote(parts[-2][5:])
                if hosts is None or host in hosts:
                    out.append(_File(x.path, host, b))
    return out


def _rows(path: str, file: _File, since: datetime | None, until: datetime | None) -> Iterator:
    import pyarrow as pa
    import pyarrow.dataset as ds
    import pyarrow.parquet as pq

    store, _ = _folder(path)
    kind = pq.read_schema(file.path, filesystem=store).field("saved_at").type
    of = lambda t: pa.scalar(t, pa.timestamp("us", "UTC")).cast(kind) if kind.tz else pa.scalar(t.replace(tzinfo=None), kind)
    test = ds.scalar(True)
    if since:
        test = test & (ds.field("saved_at") >= of(since))
    if until:
        test = test & (ds.field("saved_at") <= of(until))
    out = pa.schema([("url", pa.string()), ("status", pa.int32()), ("etag", pa.string()), ("modified", pa.string()), ("body", pa.binary()), ("saved_at", pa.timestamp("us", "UTC")), ("host", pa.string()), ("batch", pa.int32())])
    for b in ds.dataset(file.path, filesystem=store, format="parquet").to_batches(columns=list(_FIELDS), filter=test, batch_size=256):
        columns = [b.column(n).cast(out.field(n).type) for n in _FIELDS]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([file.host] * b.num_rows, pa.string()), pa.array([file.batch] * b.num_rows, pa.int32())], schema=out)


def _time(value: str | datetime | None) -> datetime | None:
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    return value if value is None or value.tzinfo else value.replace(tzinfo=UTC)


class ResponseReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.hosts = {options["host"]} if "host" in options else None
        self.batch: set[int] | None = None
        self.since, self.until = _time(options.get("since")), _time(options.get("until"))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Hosts and batches choose files and are done with; times skip row groups as well and are left to Spark too."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
            if name in ("host", "batch") and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                kept = self.hosts if name == "host" else self.batch
                values = values if kept is None else values & kept
                self.hosts, self.batch = (values, self.batch) if name == "host" else (self.hosts, values)
                continue
            if name == "saved_at" and isinstance(f.value if hasattr(f, "value") else None, datetime):
                t = _time(f.value)
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.since = t if self.since is None else max(self.since, t)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.until = t if self.until is None else min(self.until, t)
            yield f

    def partitions(self) -> list[InputPartition]:
        wanted = [b for b in _batches(self.path) if self.batch is None or b in self.batch]
        return list(_files(self.path, wanted, self.hosts)) or [_File("", "", -1)]

    def read(self, partition: _File) -> Iterator:
        return _rows(self.path, partition, self.since, self.until) if partition.batch >= 0 else iter(())


class ResponseStreamReader(DataSourceStreamReader):
    """An offset is the number of batches that have been read."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.hosts = {options["host"]} if "host" in options else None

    def initialOffset(self) -> dict:
        return {"batches": 0}

    def latestOffset(self) -> dict:
        return {"batches": len(_batches(self.path))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return list(_files(self.path, list(range(start["batches"], end["batches"])), self.hosts)) or [_File("", "", -1)]

    def read(self, partition: _File) -> Iterator:
        return _rows(self.path, partition, None, None) if partition.batch >= 0 else iter(())

    def commit(self, end: dict) -> None:
        """Nothing to let go: batches stay, also for other readers."""


class Responses(DataSource):
    @classmethod
    def name(cls) -> str:
        return "responses"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ResponseReader:
        return ResponseReader(self.options)

    def streamReader(self, schema) -> ResponseStreamReader:
        return ResponseStreamReader(self.options)


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # planning workers need not find this package


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and turns on pushed filters for Python sources, which it does not read
    without."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Responses)


def save(responses: DataFrame, path: str, batch: int) -> None:
    """Writes responses (url, status, etag, modified, body, saved_at, host) as the batch of that number; repeated, it
    replaces itself. Rows go to their hosts' files, the largest hosts to several."""
    rows = responses.select(*_FIELDS, "host")
    rows.write.mode("overwrite").partitionBy("host").parquet(f"{path}/batch={batch}")


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Saved responses; options host, since, until."""
    register(spark)
    return spark.read.format("responses").options(path=path, **options).load()


def read_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.readStream.format("responses").options(path=path, **options).load()

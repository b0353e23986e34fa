"""Members of zip and tar archives as rows: `spark.read.format("members")`, and the search for a file by path and locale.

The directory of an archive is read when the query is planned: that of a zip file stands at its end, that of a tar file in
the headers between its members. Members are then dealt into partitions by their places in the archive, so that a large one
is read by several tasks, each seeking what it needs; a compressed tar file has no places and is one partition. Plain files
are members of their own with an empty name. Folders, links and members that need a password are left out. Files are opened
by pyarrow: local or mounted folders, and the stores that its file systems know.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of members in one partition, as long as it has more than one.
PARTITION_BYTES = 32 << 20
SCHEMA = "archive string, member string, length long, content binary"
_TARS = {".tar": "r:", ".tar.gz": "r:gz", ".tgz": "r:gz"}


class _Members(InputPartition):
    """Some members of an archive: (name, offset, length); for zip files the offset is the place in the directory."""

    def __init__(self, path: str, kind: str, members: list):
        self.path, self.kind, self.members = path, kind, members


def _kind(path: str) -> str:
    low = path.lower()
    return next((k for k in (".zip", *sorted(_TARS, key=len, reverse=True)) if low.endswith(k)), "")


class MemberReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("partitionBytes", PARTITION_BYTES))

    def _store(self):
        from pyarrow import fs

        if self.path.startswith("file:/") and not self.path.startswith("file://"):
            return fs.LocalFileSystem(), self.path[5:]
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[InputPartition]:
        import tarfile
        import zipfile

        from pyarrow import fs

        store, at = self._store()
        info = store.get_file_info(at)
        files = [info] if info.type == fs.FileType.File else [x for x in store.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True)) if x.type == fs.FileType.File]
        out: list[InputPartition] = []
        for f in sorted(files, key=lambda x: x.path):
            kind = _kind(f.path)
            if kind == ".zip":
                with store.open_input_file(f.path) as raw, zipfile.ZipFile(raw) as z:
                    members = [(m.filename, m.header_offset, m.file_size) for m in z.infolist() if not m.is_dir() and not m.flag_bits & 1]
            elif kind == ".tar":
                with store.open_input_file(f.path) as raw, tarfile.open(fileobj=raw, mode="r:") as t:
                    members = [(m.name, m.offset_data, m.size) for m in t if m.isfile()]
            else:
                out.append(_Members(f.path, kind, [("", 0, f.size)]))
                continue
            held, size = [], 0
            for m in sorted(members, key=lambda m: m[1]):
                if held and size + m[2] > self.size:
                    out.append(_Members(f.path, kind, held))
                    held, size = [], 0
                held.append(m)
                size += m[2]
            if held:
                out.append(_Members(f.path, kind, held))
        return out or [_Members("", "", [])]

    def read(self, partition: _Members) -> Iterator[tuple]:
        import tarfile
        import zipfile

        if not partition.members:
            return
        store, _ = self._store()
        with store.open_input_file(partition.path) as raw:
            if partition.kind == ".zip":
                with zipfile.ZipFile(raw) as z:
                    at = {m.header_offset: m for m in z.infolist()}
                    for name, offset, size in partition.members:
                        yield partition.path, name, size, z.read(at[offset])
            elif partition.kind in (".tar.gz", ".tgz"):
                with tarfile.open(fileobj=raw, mode="r:gz") as t:
                    for m in t:
                        if m.isfile():
                            yield partition.path, m.name, m.size, t.extractfile(m).read()
            else:
                for name, offset, size in partition.members:
                    raw.seek(offset)
                    yield partition.path, name, size, raw.read(size)


class Members(DataSource):
    @classmethod
    def name(cls) -> str:
        return "members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MemberReader:
        return MemberReader(self.options)


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # planning workers need not find this package


def read_members(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """archive, member, length and content of all files below a path, those within archives too."""
    spark.dataSource.register(Members)
    return spark.read.format("members").options(path=path, **options).load()


def place(found: DataFrame) -> Column:
    """The path of a member as a search names it: that of its archive, then its own, without `./` before it."""
    inner = F.regexp_replace("member", r"^\./", "")
    return F.when(inner == "", F.col("archive")).otherwise(F.concat_ws("/", "archive", inner))


def first_found(wanted: DataFrame, files: DataFrame, name: str, locale: str, paths: list[str], path: str = "path") -> DataFrame:
    """wanted with `found`: of the files (column path) the first by folder, then by ending of the locale: `.en_US`, `.en`,
    none. Absolute names are looked up as they are; null if no file is there. A row tries three names in each folder."""
    code = F.coalesce(F.col(locale), F.lit(""))
    endings = F.when(F.length(code) == 5, F.array(F.concat(F.lit("."), code), F.concat(F.lit("."), F.substring(code, 1, 2)), F.lit(""))).when(F.length(code) >= 2, F.array(F.concat(F.lit("."), F.substring(code, 1, 2)), F.lit(""))).otherwise(F.array(F.lit("")))
    folders = F.array(*[F.lit(p.rstrip("/") + "/") for p in paths]) if paths else F.array(F.lit(""))
    stems = F.transform(F.when(F.col(name).startswith("/"), F.array(F.lit(""))).otherwise(folders), lambda p: F.concat(p, F.col(name)))
    tried = F.flatten(F.transform(stems, lambda s: F.transform(endings, lambda e: F.concat(s, e))))
    rows = wanted.withColumn("_id", F.struct(name, locale))
    asked = rows.select("_id", F.posexplode(tried).alias("_rank", "_path")).distinct()
    hits = asked.join(files.select(F.col(path).alias("_path")).distinct(), "_path").groupBy("_id").agg(F.min_by("_path", "_rank").alias("found"))
    hits = hits.select(F.col("_id").getField(name).alias("_n"), F.col("_id").getField(locale).alias("_l"), "found")
    return wanted.join(hits, wanted[name].eqNullSafe(F.col("_n")) & wanted[locale].eqNullSafe(F.col("_l")), "left").drop("_n", "_l")

"""Tables of files in a folder that are changed file by file, and copied with or without their files.

A stored table is a folder of versions. Each version is one small Parquet table that lists the version's data files (path
below the folder, rows); data files are never changed, and a new version names those that stay beside new ones. A change therefore
rewrites only files that hold changed rows, a reader sees one version whole, and a copy may share files with its original.
Listing a new version is the last step, and fails if another writer has made that version meanwhile.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a data file as they are written, at most.
FILE_ROWS = 1_000_000
_LIST = "file string, n_rows long"


class Conflict(RuntimeError):
    """Another writer made the version that this change would have made."""


class StoredTable:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # Versions

    def _hadoop(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest version's number; -1 if there is none."""
        at, fs = self._hadoop(f"{self.folder}/versions")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return max((int(n) for n in names if n.isdigit()), default=-1)

    def listing(self, version: int | None = None) -> DataFrame:
        """file (a URI) and n_rows of each data file of a version."""
        version = self.version() if version is None else version
        return self.spark.read.schema(_LIST).parquet(f"{self.folder}/versions/{version}")

    def schema(self) -> StructType:
        at, fs = self._hadoop(f"{self.folder}/schema")
        stream = fs.open(at)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return StructType.fromDDL(text)

    def _publish(self, files: DataFrame, version: int) -> None:
        """Make files the listing of a version: written aside, then renamed, which only one writer can do."""
        aside = f"{self.folder}/aside-{uuid.uuid4().hex}"
        files.coalesce(1).write.parquet(aside)
        source, fs = self._hadoop(aside)
        target, _ = self._hadoop(f"{self.folder}/versions/{version}")
        fs.mkdirs(target.getParent())
        if fs.exists(target) or not fs.rename(source, target):
            fs.delete(source, True)
            raise Conflict(f"version {version} of {self.folder} is there already")

    # Rows

    def _write(self, df: DataFrame) -> DataFrame:
        """df's rows in new data files; their listing. Only the footers of the new files are read for it."""
        folder = f"{self.folder}/data/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", FILE_ROWS).parquet(folder)
        new = self.spark.read.schema(df.schema).parquet(folder)
        return new.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n_rows"))

    def create(self, df: DataFrame) -> StoredTable:
        """The first version, of df's rows."""
        at, fs = self._hadoop(f"{self.folder}/schema")
        out = fs.create(at, False)
        out.write(bytearray(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "utf-8"))
        out.close()
        self._publish(self._write(df), 0)
        return self

    def _of(self, files: list[str]) -> DataFrame:
        schema = self.schema()
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def files(self, version: int | None = None) -> list[str]:
        """A version's data files: as many as files of FILE_ROWS rows, so the driver holds a name for each million rows."""
        return [r["file"] for r in self.listing(version).select("file").collect()]

    def read(self, version: int | None = None) -> DataFrame:
        return self._of(self.files(version))

    def _replace(self, old: list[str], rows: DataFrame | None, version: int) -> list[str]:
        """A version after `version` without the files old, and with rows instead; the files that went."""
        gone = self.spark.createDataFrame([(f,) for f in old], "file string")
        stay = self.listing(version).join(gone, "file", "left_anti")
        self._publish(stay if rows is None else stay.unionByName(self._write(rows)), version + 1)
        return old

    def append(self, df: DataFrame) -> None:
        self._replace([], df.select(self.schema().names), self.version())

    def delete(self, condition: Column) -> list[str]:
        """Delete rows for which condition is true; the files that were rewritten."""
        version = self.version()
        old = self._touched(self.read(version).where(condition))
        if old:
            self._replace(old, self._of(old).where(~F.coalesce(condition, F.lit(False))), version)
        return old

    def update(self, condition: Column, values: dict[str, Column]) -> list[str]:
        """Set columns where condition is true, all of them from the row as it was; the files that were rewritten."""
        version, schema = self.version(), self.schema()
        old = self._touched(self.read(version).where(condition))
        if old:
            hit = F.coalesce(condition, F.lit(False))
            new = [(F.when(hit, values[f.name].cast(f.dataType)).otherwise(F.col(f.name)) if f.name in values else F.col(f.name)).alias(f.name) for f in schema.fields]
            self._replace(old, self._of(old).select(new), version)
        return old

    def merge(self, source: DataFrame, key: str, update: dict[str, Column] | None = None, insert: dict[str, Column] | None = None, delete_when: Column | None = None) -> list[str]:
        """MERGE by one key; the files that were rewritten.

        Of rows whose key the source has, those that delete_when holds for go, the others are updated; source rows whose key no
        row has are inserted. Expressions name the source's columns `s_` and their names. A source with a key twice that meets a row is an
        error, as it is ambiguous. Files without a matching key stay as they are: matching keys are found first, by the key column alone.
        """
        version, schema = self.version(), self.schema()
        named = source.select(*[F.col(c).alias(f"s_{c}") for c in source.columns])
        held = self.read(version)
        matched = named.select(F.col(f"s_{key}").alias(key)).where(F.col(key).isNotNull())
        met = held.select(key, F.col("_metadata.file_path").alias("__file")).join(matched.groupBy(key).agg(F.count("*").alias("__times")), key)
        each = met.groupBy("__file").agg(F.max("__times").alias("times")).collect()  # a row for each file, at most
        if any(r["times"] > 1 for r in each):
            raise ValueError(f"a row meets several source rows with its {key}")
        old = [r["__file"] for r in each] if update or delete_when is not None else []
        rows = []
        if old:
            both = self._of(old).join(named, F.col(key) == F.col(f"s_{key}"), "left")
            hit = F.col(f"s_{key}").isNotNull()
            if delete_when is not None:
                both = both.where(~(hit & F.coalesce(delete_when, F.lit(False))))
            value = lambda f: F.when(hit, update[f.name].cast(f.dataType)).otherwise(F.col(f.name)) if update and f.name in update else F.col(f.name)
            rows.append(both.select([value(f).alias(f.name) for f in schema.fields]))
        if insert:
            new = named.join(held.select(F.col(key).alias("__key")), F.col(f"s_{key}") == F.col("__key"), "left_anti")
            rows.append(new.select([insert.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]))
        if rows:
            self._replace(old, rows[0] if len(rows) == 1 else rows[0].unionAll(rows[1]), version)
        return old

    def _touched(self, hits: DataFrame) -> list[str]:
        return [r["file"] for r in hits.select(F.col("_metadata.file_path").alias("file")).distinct().collect()]

    # Copies

    def shallow_clone(self, folder: str, version: int | None = None) -> StoredTable:
        """A table of its own that begins with this one's files; a change to either makes new files and doesn't show in the other."""
        return self._clone(folder, self.listing(version))

    def deep_clone(self, folder: str, version: int | None = None) -> StoredTable:
        """A table of its own with its own files."""
        return StoredTable(self.spark, folder).create(self.read(version))

    def _clone(self, folder: str, files: DataFrame) -> StoredTable:
        other = StoredTable(self.spark, folder)
        at, fs = self._hadoop(f"{self.folder}/schema")
        to, to_fs = self._hadoop(f"{other.folder}/schema")
        self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, at, to_fs, to, False, False, self.spark._jsc.hadoopConfiguration())
        other._publish(files, 0)
        return other

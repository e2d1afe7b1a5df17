"""The corpus as a table in buckets, with versions that are switched in one step.

Documents lie in buckets by the first digits of their identifier, which is a hash, so
buckets are even.  A version is a small file that names the folder of every bucket.  A
change reads and rewrites the buckets it touches, in a folder of its own, and then
publishes the next version by renaming its file to a name that must not exist yet: a reader
sees the old version or the new one, a write that breaks off changes nothing, and of
two writers that began from the same version the second is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from claimloom.operators import ingest

_NAME = "v{:010d}.json"


class StoreChanged(RuntimeError):
    """Another writer has published a version since this one began."""


class CorpusStore:
    """A versioned table of documents under ``path``, on any file system Spark reads.

    ``digits`` hex digits of the id name a bucket: 2 give 256 buckets, 3 give 4,096.  The
    driver holds one line per bucket, never more.  A bucket is written as ``files`` files.
    """

    def __init__(self, spark: SparkSession, path: str, digits: int = 2, files: int = 1):
        self.spark, self.path, self.digits, self.files = spark, path.rstrip("/"), digits, files
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # --- versions -----------------------------------------------------------

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("versions").getFileSystem(self._conf)

    def versions(self) -> list[int]:
        fs, folder = self._fs(), self._at("versions")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The version's number, schema and the folder of each bucket."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return {"version": 0, "schema": None, "buckets": {}}
        stream = self._fs().open(self._at("versions/" + _NAME.format(version)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, base: dict, schema: StructType, buckets: dict[str, str]) -> int:
        version = base["version"] + 1
        text = json.dumps({"version": version, "schema": schema.jsonValue(), "buckets": buckets}, sort_keys=True)
        draft = self._at(f"versions/.draft-{uuid.uuid4().hex}")
        fs = self._fs()
        stream = fs.create(draft)
        stream.write(bytearray(text.encode()))
        stream.close()
        # Without the option to overwrite, the rename fails where the version exists.
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
        final = self._at("versions/" + _NAME.format(version))
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(final), options)
        except Exception as error:
            fs.delete(draft, False)
            if fs.exists(final):
                raise StoreChanged(f"version {version} of {self.path} exists already") from error
            raise
        return version

    # --- reading ------------------------------------------------------------

    def bucket(self, document_id: Column) -> Column:
        """The bucket of an id; ids that do not begin with hex digits share one."""
        head = F.substring(document_id, 1, self.digits)
        return F.when(head.rlike(f"^[0-9a-f]{{{self.digits}}}$"), head).otherwise(F.lit("other"))

    def read(self, version: int | None = None, buckets: list[str] | None = None) -> DataFrame:
        """The documents of a version, the latest by default; of some buckets where named."""
        return self._read(self.manifest(version), buckets)

    def _read(self, held: dict, buckets: list[str] | None = None) -> DataFrame:
        if held["schema"] is None:
            raise ValueError(f"{self.path} holds no version yet")
        schema = StructType.fromJson(held["schema"])
        names = held["buckets"] if buckets is None else [b for b in buckets if b in held["buckets"]]
        folders = [f"{self.path}/{held['buckets'][b]}" for b in names]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    # --- changing -----------------------------------------------------------

    def create(self, corpus: DataFrame) -> int:
        """The first version."""
        base = self.manifest()
        if base["version"]:
            raise StoreChanged(f"{self.path} has versions already")
        return self._write(base, corpus, None)

    def change(self, changes: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Replace the buckets that the changes' ids fall into by ``merged(held, changes)``."""
        base = self.manifest()
        # At most one row per bucket.
        touched = [r[0] for r in changes.select(self.bucket(F.col("id")).alias("b")).distinct().collect()]
        if not touched:
            return base["version"]
        return self._write(base, merged(self._read(base, touched), changes), touched)

    def upsert(self, new: DataFrame, extra: dict[str, Column] | None = None, default_title: Column | None = None) -> int:
        """Update the documents it holds and add the others (see ``ingest.upsert``)."""
        return self.change(new, lambda held, changes: ingest.upsert(held, changes, extra, default_title).drop("action"))

    def insert_if_absent(self, new: DataFrame) -> int:
        """Add the documents whose id it does not hold."""
        return self.change(new, ingest.insert_if_absent)

    def _write(self, base: dict, rows: DataFrame, touched: list[str] | None) -> int:
        folder = f"data/{uuid.uuid4().hex}"
        spread = F.pmod(F.xxhash64("id"), F.lit(self.files))
        tasks = (len(touched) if touched else 16**self.digits) * self.files
        (
            rows.withColumn("bucket", self.bucket(F.col("id")))
            .repartition(tasks, "bucket", spread)
            .write.partitionBy("bucket")
            .parquet(f"{self.path}/{folder}")
        )
        made = {
            s.getPath().getName().removeprefix("bucket="): f"{folder}/{s.getPath().getName()}"
            for s in self._fs().listStatus(self._at(folder))
            if s.getPath().getName().startswith("bucket=")
        }
        kept = {} if touched is None else {b: f for b, f in base["buckets"].items() if b not in touched}
        return self._publish(base, rows.schema, kept | made)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete the versions before the last ``keep`` and the folders that no kept one names."""
        if keep < 1:
            raise ValueError("the last version is always kept")
        fs = self._fs()
        old, kept = self.versions()[:-keep], self.versions()[-keep:]
        for version in old:
            fs.delete(self._at("versions/" + _NAME.format(version)), False)
        used = {f.split("/")[1] for v in kept for f in self.manifest(v)["buckets"].values()}
        data = self._at("data")
        gone = [s.getPath() for s in fs.listStatus(data) if s.getPath().getName() not in used] if fs.exists(data) else []
        for folder in gone:
            fs.delete(folder, True)
        return [g.getName() for g in gone]

"""Tables kept as Parquet folders by bucket, changed by rewriting the touched buckets and publishing one pointer file."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodeglass.operators.joins import upsert
from lodeglass.operators.storage import delete


class StoredTable:
    """Rows with a natural key in buckets, of which a change rewrites only those that it touches.

    A write goes to a new folder, a subfolder for each bucket; then the pointer file, which names each bucket's folder, is
    replaced in one rename. So a failed write changes nothing that can be read, readers see the table before or after a
    change, and untouched buckets keep their files. The pointer holds a line a bucket (a day, say). One writer at a time.

    The bucket is a string column of the schema and part of the key, so a row never moves between buckets. Rows without a
    bucket are in one of their own.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType | str, keys: list[str], bucket: str) -> None:
        if bucket not in keys:
            raise ValueError("the bucket must be part of the key")
        self.spark, self.folder, self.keys, self.bucket = spark, folder.rstrip("/"), keys, bucket
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def pointer(self) -> dict:
        """buckets: name -> folder; and note, what the last change left there."""
        path = self._path("current")
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(path):
            return {"buckets": {}, "note": None}
        source = store.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def _publish(self, buckets: dict[str, str], note) -> None:
        fs, conf = self.spark._jvm.org.apache.hadoop.fs, self.spark._jsc.hadoopConfiguration()
        new, current = self._path(f"next-{uuid.uuid4().hex}"), self._path("current")
        out = new.getFileSystem(conf).create(new)
        out.write(json.dumps({"buckets": buckets, "note": note}).encode())
        out.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
        options[0] = getattr(fs, "Options$Rename").OVERWRITE
        current = current.getFileSystem(conf).makeQualified(current)
        fs.FileContext.getFileContext(current.toUri(), conf).rename(new.getFileSystem(conf).makeQualified(new), current, options)

    def read(self, only: list[str] | None = None) -> DataFrame:
        """The table, or some of its buckets."""
        held = self.pointer()["buckets"]
        paths = sorted({held[b] for b in (held if only is None else only) if b in held})
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        stored = StructType([f for f in self.schema.fields if f.name != self.bucket])
        rows = self.spark.read.schema(stored.add("_bucket", "string")).option("basePath", f"{self.folder}/data").parquet(*[f"{self.folder}/data/{p}" for p in paths])
        named = rows.withColumn(self.bucket, F.nullif(F.col("_bucket"), F.lit("none")))
        return named.select(*self.schema.names)

    def _written(self, rows: DataFrame, touched: list[str], note=None, dropped: list[str] = ()) -> None:
        name, before = uuid.uuid4().hex, self.pointer()
        kept = {b: p for b, p in before["buckets"].items() if b not in touched and b not in dropped}
        if touched:
            rows.withColumn("_bucket", F.coalesce(self.bucket, F.lit("none"))).drop(self.bucket).write.partitionBy("_bucket").parquet(f"{self.folder}/data/write={name}")
            found = self.spark.read.option("basePath", f"{self.folder}/data").parquet(f"{self.folder}/data/write={name}") if self._any(f"data/write={name}") else None
            there = [] if found is None else [str(r[0]) for r in found.select(F.col("_bucket").cast("string")).distinct().collect()]
            kept |= {b: f"write={name}/_bucket={self._escaped(b)}" for b in touched if b in there}
        self._publish(kept, before["note"] if note is None else note)

    def _escaped(self, bucket: str) -> str:
        return self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(bucket)

    def _any(self, name: str) -> bool:
        path = self._path(name)
        return any(s.isDirectory() for s in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path))

    def upsert(self, updates: DataFrame, kept: tuple[str, ...] = ("created_at",), note=None) -> dict[str, int]:
        """Puts the updates' rows in place of those of equal keys and adds the others; how many rows the touched buckets held before and hold now."""
        updates = updates.select(*self.schema.names)
        touched = [r[0] for r in updates.select(F.coalesce(F.col(self.bucket).cast("string"), F.lit("none"))).distinct().collect()]
        before, after, there = Observation(), Observation(), set(touched) & set(self.pointer()["buckets"])
        old = self.read(touched)
        old = old.observe(before, F.count(F.lit(1)).alias("n")) if there else old  # of no table nothing is observed
        merged = upsert(old, updates, self.keys, kept).observe(after, F.count(F.lit(1)).alias("n"))
        if not touched:
            return {"before": 0, "after": 0}
        self._written(merged, touched, note)
        return {"before": before.get["n"] if there else 0, "after": after.get["n"]}

    def retain(self, since: str, inside: Column) -> int:
        """Drops the buckets before that of name `since`, and of that one the rows that aren't `inside`; how many rows went. Of older buckets only the files' own numbers of rows are read, of later ones nothing."""
        held = self.pointer()["buckets"]
        old, edge = sorted(b for b in held if b < since and b != "none"), [b for b in held if b == since]
        if not old and not edge:
            return 0
        before = self.read([*old, *edge]).count()
        self._written(self.read(edge).filter(F.coalesce(inside, F.lit(False))), edge, dropped=old)
        return before - self.read(edge).count()

    def vacuum(self) -> int:
        """Deletes writes that the pointer no longer names; how many. Readers of a version before lose it."""
        used = {p.split("/")[0] for p in self.pointer()["buckets"].values()}
        path = self._path("data")
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        old = [s.getPath().getName() for s in store.listStatus(path) if s.getPath().getName() not in used] if store.exists(path) else []
        for name in old:
            delete(self.spark, f"{self.folder}/data/{name}")
        return len(old)

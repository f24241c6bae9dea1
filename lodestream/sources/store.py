"""A stored table: Parquet folders per partition, a manifest that names them, and merges that swap the manifest at once.

A merge writes new folders for the partitions that it touches and nothing else. Until its
manifest is in place readers see the table as it was; a merge that fails or loses a task
leaves folders that no manifest names. Two merges at a time can't both succeed: the
manifest's next number is taken once.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another merge has taken the version that this one was to be."""


class Store:
    """The table at ``path``, one row for each value of ``keys``, in partitions by the column ``part``."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], part: str):
        self.spark, self.path, self.keys, self.part = spark, path.rstrip("/"), keys, part

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        where = self._path("")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest version; 0 before the first."""
        files, where = self._files(), self._path("manifest")
        if not files.exists(where):
            return 0
        names = [s.getPath().getName() for s in files.listStatus(where)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[0] != "_"), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """schema, and the partitions by their value as text: folder, rows and checksum of each."""
        version = self.version() if version is None else version
        if not version:
            return {"schema": None, "parts": {}}
        text = self.spark.read.option("wholetext", True).text(f"{self.path}/manifest/{version:09d}.json").first()[0]
        return json.loads(text)

    def read(self, parts: list[str] | None = None, version: int | None = None) -> DataFrame:
        """The table, or those of its partitions that ``parts`` names."""
        held = self.manifest(version)
        if held["schema"] is None:
            raise FileNotFoundError(f"no table at {self.path}")
        schema = StructType.fromJson(held["schema"])
        folders = [f"{self.path}/{p['folder']}" for k, p in held["parts"].items() if parts is None or k in parts]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _commit(self, after: int, schema: dict, parts: dict) -> int:
        """Puts the manifest of version ``after`` + 1 in place, or fails if that is there."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        files, fresh, target = self._files(), self._path(f"manifest/_{uuid.uuid4().hex}"), self._path(f"manifest/{after + 1:09d}.json")
        out = files.create(fresh, False)
        out.write(bytearray(json.dumps({"schema": schema, "parts": parts}).encode("utf-8")))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(files.makeQualified(fresh), files.makeQualified(target), options)
        except Exception as e:
            files.delete(fresh, False)
            if files.exists(target):
                raise Conflict(f"version {after + 1} of {self.path} is taken") from e
            raise
        return after + 1

    def merge(self, rows: DataFrame, order: Column | None = None) -> int:
        """Merges ``rows`` in; of the rows of a key the one with the greatest ``order`` stays, among equals any fixed one.

        ``order`` may use the table's columns and ``_new``, 1 for ``rows`` and 0 for what
        is there; by default new rows replace old ones. Returns the version made.
        """
        before = self.version()
        held = self.manifest(before)
        schema = held["schema"] or json.loads(rows.schema.json())
        names = StructType.fromJson(schema).fieldNames()
        value = F.col(self.part).cast("string")
        touched = {r[0] for r in rows.select(value).distinct().collect()}  # values of the partition column, not rows
        both = rows.select(*names).withColumn("_new", F.lit(1))
        touched = {"" if t is None else f"p{t}" for t in touched}
        old = [k for k in held["parts"] if k in touched]
        if old:
            both = self.read(old, before).withColumn("_new", F.lit(0)).unionByName(both)
        rest = [n for n in names if n not in self.keys]
        best = F.max_by(F.struct(*rest), F.struct((order if order is not None else F.col("_new")).alias("_order"), "_new", *rest))
        kept = both.groupBy(*self.keys).agg(best.alias("_row")).select(*self.keys, "_row.*").select(*names)
        folder = f"data/{uuid.uuid4().hex}"
        kept.withColumn("_part", F.concat(F.lit("p"), value)).hint("rebalance", "_part").write.option("compression", "zstd").partitionBy("_part").parquet(f"{self.path}/{folder}")
        parts = {k: v for k, v in held["parts"].items() if k not in old} | self._sums(folder, names)
        return self._commit(before, schema, parts)

    def _sums(self, folder: str, names: list[str]) -> dict:
        """What the manifest says of each partition below ``folder``."""
        there = self.spark.read.parquet(f"{self.path}/{folder}").withColumn("_file", F.input_file_name())
        found = there.groupBy(F.col("_part").cast("string").alias("_part")).agg(F.count(F.lit(1)).alias("rows"), checksum(names).alias("sum"), F.first("_file").alias("file")).collect()
        place = lambda file: f"{folder}/{unquote(file).rpartition('/')[0].rpartition('/')[2]}"
        return {r["_part"] or "": {"folder": place(r["file"]), "rows": r["rows"], "sum": str(r["sum"])} for r in found}

    def drop(self, parts: list[str]) -> int:
        """Leaves the partitions ``parts`` out of the next version."""
        before = self.version()
        held = self.manifest(before)
        return self._commit(before, held["schema"], {k: v for k, v in held["parts"].items() if k not in parts})

    def covered(self, archive: Store) -> list[str]:
        """The partitions that ``archive`` holds, too, with as many rows and the same checksum, by both manifests."""
        here, there = self.manifest()["parts"], archive.manifest()["parts"]
        return sorted(k for k, v in here.items() if k in there and (there[k]["rows"], there[k]["sum"]) == (v["rows"], v["sum"]))

    def retain(self, archive: Store, least: str) -> list[str]:
        """Drops partitions below ``least`` (of numbers of equal width or dates) that ``archive`` covers; returns them."""
        gone = [k for k in self.covered(archive) if k and k[1:] < least]
        if gone:
            self.drop(gone)
        return gone

    def damaged(self) -> list[str]:
        """Partitions whose files no longer hold what the manifest says."""
        names, out = None, []
        for k, v in self.manifest()["parts"].items():
            df = self.read([k])
            names = names or df.columns
            r = df.agg(F.count(F.lit(1)).alias("rows"), checksum(names).alias("sum")).first()
            if (r["rows"], str(r["sum"])) != (v["rows"], v["sum"]):
                out.append(k)
        return out


def checksum(names: list[str]) -> Column:
    """A sum over rows that no order of theirs changes."""
    return F.coalesce(F.sum(F.xxhash64(*names).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))

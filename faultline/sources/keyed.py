"""A keyed table of Parquet files: upserts rewrite the buckets that they touch and take effect in one rename.

A key's bucket is a hash of it.  Every version of a bucket is a folder of its own; a commit is a small file that says which
version each bucket has, and the last commit is the table.  What a writer that died has left is in no commit, so nobody reads it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class Conflict(Exception):
    """Another writer has committed since this one read the table."""


class KeyedTable:
    """Rows by ``key``, of which the last by ``order`` stays; ``schema`` has both.

    The number of buckets is fixed by the first commit; the driver holds a folder's name for each, and nothing of the rows.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "log_id", order: str = "ord", buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.key, self.order = spark, path.rstrip("/"), schema, key, order
        last = self._commits()[-1:]
        self.buckets = self._commit(last[0])["buckets"] if last else buckets

    # Files of commits -----------------------------------------------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _commits(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/commits")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()) if fs.exists(p) else []

    def _commit(self, n: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/commits/{n:012d}", wholetext=True).first().value)

    def _publish(self, n: int, state: dict) -> None:
        """The commit is written aside and renamed: it is there as a whole or not at all, and no other can have its number."""
        fs, aside = self._fs(f"{self.path}/commits/.{uuid.uuid4().hex}")
        out = fs.create(aside)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        target = self._fs(f"{self.path}/commits/{n:012d}")[1]
        if fs.exists(target) or not fs.rename(aside, target):
            fs.delete(aside, False)
            raise Conflict(f"commit {n} of {self.path} is taken")

    # Rows -----------------------------------------------------------------------------------------------------------

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def version(self) -> int:
        """The number of the last commit; 0 before the first."""
        return (self._commits() or [0])[-1]

    def folders(self, version: int | None = None) -> dict[int, str]:
        """The folder of each bucket that has rows."""
        n = self.version() if version is None else version
        return {int(k): v for k, v in self._commit(n)["folders"].items()} if n else {}

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{f}" for f in folders))

    def read(self, version: int | None = None) -> DataFrame:
        """The table, or as it was after a commit that :meth:`vacuum` has left."""
        return self._read([*self.folders(version).values()])

    def get(self, *keys) -> DataFrame:
        """The rows of some keys; only their buckets are read."""
        wanted = self.spark.createDataFrame([(k,) for k in keys], self.spark.createDataFrame([], self.schema).select(self.key).schema)
        own = {r.b for r in wanted.select(self.bucket(F.col(self.key)).alias("b")).distinct().collect()}
        there = self.folders()
        return self._read([f for b, f in there.items() if b in own]).join(F.broadcast(wanted), self.key, "left_semi")  # the caller's keys

    def upsert(self, rows: DataFrame) -> int:
        """Insert or replace by key; returns the commit's number.  Rows with a null key are left out.

        Of a key's rows, old and new, the last by order stays; of two with one order the new one, then the greatest.
        """
        begun = self.version()
        there = self.folders(begun)
        names = self.spark.createDataFrame([], self.schema).columns
        new = rows.select(*names).filter(F.col(self.key).isNotNull()).withColumn("_new", F.lit(1))
        touched = sorted(r.b for r in new.select(self.bucket(F.col(self.key)).alias("b")).distinct().collect())  # bucket numbers
        if not touched:
            return begun
        old = self._read([there[b] for b in touched if b in there]).withColumn("_new", F.lit(0))
        rest = [c for c in names if c not in (self.key, self.order)]
        last = old.unionByName(new).groupBy(self.key).agg(F.max(F.struct(self.order, "_new", *rest)).alias("r"))
        made = last.select(self.key, "r.*").select(*names).withColumn("bucket", self.bucket(F.col(self.key)))
        tag = f"{begun + 1:012d}-{uuid.uuid4().hex}"
        made.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{tag}")
        self._publish(begun + 1, {"buckets": self.buckets, "folders": there | {b: f"{tag}/bucket={b}" for b in touched}})
        return begun + 1

    def vacuum(self) -> int:
        """Delete the folders that the last commit doesn't name, and the commits before it; returns how many folders went.  No writer may be at work."""
        n, gone = self.version(), 0
        used = {*self.folders(n).values()}
        fs, data = self._fs(f"{self.path}/data")
        for tag in fs.listStatus(data) if fs.exists(data) else []:
            for own in fs.listStatus(tag.getPath()):
                if f"{tag.getPath().getName()}/{own.getPath().getName()}" not in used and own.isDirectory():
                    gone += fs.delete(own.getPath(), True)
        for old in self._commits():
            if old < n:
                fs.delete(self._fs(f"{self.path}/commits/{old:012d}")[1], False)
        return gone

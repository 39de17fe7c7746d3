"""A keyed table in buckets: a merge rewrites only the buckets that its changes touch, all of them at once or none.

Rows lie in folders by bucket, a hash of their keys, and version, the number of the change that wrote them. A change writes
the next version of the buckets it touches and then one line in the ledger, which makes these versions the current ones;
files of other buckets stay as they are. A change that is lost before its line leaves nothing that is read. A change may
bring a name, such as a stream's batch; what has been done under a name isn't done again.

Of a key's rows in one change the last by `order` counts, and it replaces the stored one if that isn't later. Nulls are keys
like any others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators.ledger import Ledger
from memloom.operators.lineage import cut


@dataclass(frozen=True)
class BucketTable:
    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    order: str
    buckets: int = 64

    @property
    def ledger(self) -> Ledger:
        return Ledger(self.spark, f"{self.path}/ledger")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def versions(self) -> dict[int, int]:
        """The current version of each bucket that has been written."""
        return {b: x["number"] for x in self.ledger.committed() for b in x["buckets"]}

    def _rows(self, versions: dict[int, int]) -> DataFrame | None:
        """The rows of these versions, with their bucket; partition pruning leaves the others unread."""
        if not versions:
            return None
        current = F.create_map(*[F.lit(x) for pair in versions.items() for x in pair])
        return self.spark.read.parquet(f"{self.path}/rows").where(F.col("version") == F.element_at(current, F.col("bucket"))).drop("version")

    def read(self) -> DataFrame | None:
        """The table; None before the first change."""
        found = self._rows(self.versions())
        return found.drop("bucket") if found is not None else None

    def _write(self, rows: DataFrame, touched: list[int], name: str | None, **more) -> int:
        number = self.ledger.claim()
        rows.repartition(max(1, len(touched)), "bucket").withColumn("version", F.lit(number)).write.mode("append").partitionBy("bucket", "version").parquet(f"{self.path}/rows")
        self.ledger.commit(number, buckets=touched, name=name, **more)
        return number

    def _done(self, name: str | None) -> int | None:
        return next((x["number"] for x in self.ledger.committed() if name is not None and x["name"] == name), None)

    def upsert(self, changes: DataFrame, name: str | None = None) -> int | None:
        """Puts changes in; returns the version they have, None if there are none."""
        if (number := self._done(name)) is not None:
            return number
        fresh = changes.withColumns({"bucket": self._bucket(), "_new": F.lit(1)})
        touched = sorted(r["bucket"] for r in fresh.select("bucket").distinct().collect())  # numbers below `buckets`
        if not touched:
            return None
        now = self.versions()
        old = self._rows({b: now[b] for b in touched if b in now})
        both = fresh if old is None else fresh.unionByName(old.withColumn("_new", F.lit(0)), allowMissingColumns=True)
        last = F.max_by(F.struct(*[c for c in both.columns if c != "_new"]), F.struct(self.order, "_new")).alias("_r")  # of each task first, so a key with many changes is no burden
        return self._write(both.groupBy(*self.keys).agg(last).select("_r.*"), touched, name)

    def delete(self, ids: DataFrame, name: str | None = None) -> int | None:
        """Takes out the rows whose keys are in ids."""
        if (number := self._done(name)) is not None:
            return number
        gone = ids.select(*self.keys).distinct().withColumn("bucket", self._bucket())
        now = self.versions()
        touched = sorted(r["bucket"] for r in gone.select("bucket").distinct().collect() if r["bucket"] in now)
        if not touched:
            return None
        old = self._rows({b: now[b] for b in touched})
        same = [old[k].eqNullSafe(gone[k]) for k in self.keys]
        return self._write(cut(old.join(gone, same, "left_anti")), touched, name)

    def vacuum(self) -> None:
        """Removes versions that aren't current. Not while they are read."""
        now = self.versions()
        fs, where = self.ledger._at("..", "rows")
        for bucket in fs.listStatus(where) if fs.exists(where) else []:
            if (b := bucket.getPath().getName()).startswith("bucket="):
                for version in fs.listStatus(bucket.getPath()):
                    if now.get(int(b[7:])) != int(version.getPath().getName()[8:]):
                        fs.delete(version.getPath(), True)


def merge_stream(changes: DataFrame, table: BucketTable, checkpoint: str):
    """A running query that puts each micro-batch of changes into the table once, also where a batch is run again."""

    def merge(batch: DataFrame, epoch: int) -> None:
        table.upsert(batch, f"{checkpoint}#{epoch}")

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

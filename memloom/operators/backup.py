"""Verified incremental backups: hashes of buckets show what changed, and only that is copied.

Rows belong to buckets by their keys. A bucket's hash is made of its rows' hashes, whatever their order; the hash of the sorted
bucket hashes is the table's. A backup copies the buckets whose hash isn't the stored one, and then one line in the ledger makes
them the current ones. Verifying reads the copy, hashes it again and names the buckets that differ.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.operators.bucket_table import BucketTable


def _row_hash(columns: list[str]) -> Column:
    """256 bits of a row; a null differs from any value, and a value from the same one in another column."""
    said = F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(sorted(columns))]))
    return F.sha2(said, 256)


def bucket_hashes(rows: DataFrame, table: BucketTable) -> dict[int, str]:
    """The hash of each bucket that has rows: sums of the halves of its rows' hashes, and their number. Buckets are few."""
    columns = [c for c in rows.columns if c != "bucket"]
    h = rows.select(table._bucket().alias("bucket"), _row_hash(columns).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]  # exact: 60 bits each
    found = h.groupBy("bucket").agg(F.count("*").alias("n"), *parts).collect()
    return {r["bucket"]: hashlib.sha256("/".join(str(r[c]) for c in ("n", "s0", "s1", "s2", "s3")).encode()).hexdigest() for r in found}


def stored_hashes(to: BucketTable) -> dict[int, str]:
    out: dict[int, str] = {}
    for x in to.ledger.committed():
        out |= {b: h for b, h in zip(x["buckets"], x["hashes"], strict=True)}
    return {b: h for b, h in out.items() if h}


def root(hashes: dict[int, str]) -> str:
    """The hash of the whole table."""
    return hashlib.sha256("\n".join(f"{b}:{h}" for b, h in sorted(hashes.items())).encode()).hexdigest()


def back_up(rows: DataFrame, to: BucketTable) -> list[int]:
    """Brings the backup up to rows; returns the buckets that it copied."""
    now, before = bucket_hashes(rows, to), stored_hashes(to)
    changed = sorted(b for b in now.keys() | before.keys() if now.get(b) != before.get(b))
    if changed:
        some = rows.withColumn("bucket", to._bucket()).where(F.col("bucket").isin(*changed))
        to._write(some, changed, None, hashes=[now.get(b, "") for b in changed])
    return changed


def damaged(to: BucketTable) -> list[int]:
    """The buckets of a backup whose rows aren't those that were copied."""
    found, stored = to.read(), stored_hashes(to)
    there = bucket_hashes(found, to) if found is not None else {}
    return sorted(b for b in there.keys() | stored.keys() if there.get(b) != stored.get(b))


def restored(to: BucketTable) -> DataFrame:
    """The rows of a backup, verified."""
    if bad := damaged(to):
        raise ValueError(f"buckets {bad} of the backup are damaged")
    return to.read()

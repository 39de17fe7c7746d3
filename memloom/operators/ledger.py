"""A ledger of what has been committed to a stored table: small JSON files beside it, one for each change.

A change first claims the next number, by creating a file that mustn't be there, writes its rows with that number, and last
writes the file that makes it count. Rows of a change that never ended are not read, and its number isn't used again, so a
change that was lost with its driver is simply made anew.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Ledger:
    spark: SparkSession
    path: str

    def _at(self, *parts: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _names(self) -> list[str]:
        fs, where = self._at()
        return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []

    def claim(self) -> int:
        """The next number, this change's own."""
        while True:
            taken = [int(n.split("-")[1]) for n in self._names() if n.startswith("claimed-")]
            number = max(taken, default=0) + 1
            fs, where = self._at(f"claimed-{number:09d}")
            if fs.createNewFile(where):
                return number

    def commit(self, number: int, **what) -> None:
        fs, where = self._at(f"done-{number:09d}.json")
        part = self._at(f".part-{number:09d}")[1]
        out = fs.create(part, True)
        out.write(bytearray(json.dumps({"number": number, **what}).encode()))
        out.close()
        fs.rename(part, where)

    def committed(self) -> list[dict]:
        """What was committed, by number."""
        names = [n for n in self._names() if n.startswith("done-")]
        if not names:
            return []
        found = self.spark.sparkContext.wholeTextFiles(f"{self.path}/done-*.json", 1).values().collect()  # a line for each change since the last merge
        return sorted(map(json.loads, found), key=lambda x: x["number"])

    def forget(self, numbers: list[int]) -> None:
        """Removes the entries of changes that a later one has taken in."""
        for n in numbers:
            fs, where = self._at(f"done-{n:09d}.json")
            fs.delete(where, False)

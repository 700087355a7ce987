"""A table of immutable versions (W-27, ST-02, ST-06): replaced without a gap, upserted from streams.

``versions/<name>`` holds the Parquet files of a version, ``log/<number>.json`` says
which version is the table's ``number``-th and which batch of which stream made it.
A commit is the appearance of the log entry, by a rename that fails where the
entry exists; whatever was written before that is invisible. Readers take the
greatest entry when they open the table and keep its files, so a swap does not
disturb them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._hadoop = jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._hadoop.Path(self.path).getFileSystem(self._conf)

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def numbers(self) -> list[int]:
        """Committed versions, ascending."""
        if not self._fs.exists(self._at("log")):
            return []
        names = (f.getPath().getName() for f in self._fs.listStatus(self._at("log")))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def entry(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/log/{number}.json", wholetext=True).first().value)

    def latest(self) -> dict | None:
        numbers = self.numbers()
        return self.entry(numbers[-1]) if numbers else None

    def read(self, number: int | None = None) -> DataFrame:
        """The table as it is now, or as it was; later commits do not change the frame."""
        found = self.entry(number) if number is not None else self.latest()
        if found is None:
            raise FileNotFoundError(f"no version of {self.path}")
        return self.spark.read.schema(found["schema"]).parquet(f"{self.path}/{found['version']}")

    def write(self, df: DataFrame) -> str:
        """The files of a version that nobody sees yet."""
        version = f"versions/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{version}")
        return version

    def commit(self, version: str, schema: str, after: int, **more) -> int:
        """Make ``version`` the one after number ``after``; FileExistsError if another came first."""
        number = after + 1
        text = json.dumps({"number": number, "version": version, "schema": schema} | more)
        draft, final = self._at(f"log/.{uuid.uuid4().hex}"), self._at(f"log/{number}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(final.toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(context.makeQualified(draft), context.makeQualified(final), none)
        except Exception as e:
            self._fs.delete(draft, False)
            if self._fs.exists(final):
                raise FileExistsError(f"version {number} of {self.path} was committed by another writer") from e
            raise
        return number

    def replace(self, df: DataFrame, **more) -> int:
        """W-27: a new version in place of the present one; readers see the old one or the new one, never none."""
        last = self.numbers()[-1] if self.numbers() else -1
        return self.commit(self.write(df), _ddl(df), last, **more)

    def upsert_batch(self, merge: Callable[[DataFrame | None, DataFrame], DataFrame], stream: str) -> Callable[[DataFrame, int], None]:
        """ST-02, ST-06: a ``foreachBatch`` function: ``merge(old, batch)`` is the next version.

        A batch that the log has for this ``stream`` is a no-op, so one that is repeated
        after a crash, before or after its commit, counts once.
        """

        def apply(batch: DataFrame, number: int) -> None:
            found = self.latest()
            done = (found or {}).get("batches", {})
            if done.get(stream, -1) >= number:
                return
            merged = merge(self.read(found["number"]) if found else None, batch)
            self.commit(self.write(merged), _ddl(merged), found["number"] if found else -1, batches=done | {stream: number})

        return apply

    def forget(self, keep: int = 1) -> None:
        """Delete all but the ``keep`` latest versions; readers of those must be done."""
        gone = self.numbers()[:-keep]
        folders = [self.entry(n)["version"] for n in gone]
        for n, version in zip(gone, folders, strict=True):
            self._fs.delete(self._at(f"log/{n}.json"), False)
            self._fs.delete(self._at(version), True)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

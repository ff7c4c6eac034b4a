"""A log of commits in a folder: numbered records, each written by one writer alone."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession


class CommitLog:
    """Records 0, 1, 2, ... as files named by number. A record appears whole or not at all, and never replaces another."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str = ""):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def size(self) -> int:
        """The number of the next record. Only names are listed."""
        fs, p = self._at()
        if not fs.exists(p):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return max((int(n.removesuffix(".json")) + 1 for n in names if n.endswith(".json") and n[0] != "."), default=0)

    def read(self, number: int) -> dict:
        fs, p = self._at(f"{number:020d}.json")
        source = fs.open(p)
        try:
            return json.loads(bytes(source.readAllBytes()).decode())
        finally:
            source.close()

    def put(self, number: int, record: dict) -> bool:
        """Writes the record, unless there is one of that number already. On a mounted folder a finished file is linked to its name, elsewhere
        the file system creates what isn't there (as HDFS does, and object stores with conditional writes)."""
        text, name = json.dumps(record).encode(), f"{number:020d}.json"
        fs, p = self._at(name)
        if fs.getUri().getScheme() == "file":
            local = fs.makeQualified(p).toUri().getPath()
            os.makedirs(os.path.dirname(local), exist_ok=True)
            made = f"{os.path.dirname(local)}/.{uuid.uuid4().hex}"
            with open(made, "wb") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(made, local)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(made)
        if fs.exists(p):
            return False
        try:
            out = fs.create(p, False)
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(text))
        out.close()
        return True

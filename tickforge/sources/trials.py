"""The append-only store of trials: every evaluated configuration is counted, so that statistics can be honest about luck."""

from __future__ import annotations

import hashlib
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import canonical
from ..session import SCHEMAS
from .commits import CommitLog

NAMES = [c.split(" ")[0] for c in SCHEMAS["trials"].split(", ")]
#: Fixed value: the tag of a trial list's hash.
LIST_TAG = b"FE-TRIALLIST-v1\n"


class TrialStore:
    """Trials under a path; rows are added, never changed, by any number of writers. Rows are written first, under a name of their own,
    and count once a commit names them. A commit has the first id of its rows, so a writer that comes second takes the next number
    and ids without writing anew; what isn't named by a commit is no trial."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.log = spark, path.rstrip("/"), CommitLog(spark, f"{path.rstrip('/')}/log")

    def _table(self, size: int | None = None) -> DataFrame:
        """Trials of the first `size` commits, by default of all."""
        if (self.log.size() if size is None else size) == 0:
            return self.spark.createDataFrame([], SCHEMAS["trials"])
        rows = self.spark.read.schema(SCHEMAS["trials"] + ", batch string").parquet(f"{self.path}/rows")
        commits = self.spark.read.schema("number long, batch string, first long").json(f"{self.path}/log/*.json")
        if size is not None:
            commits = commits.filter(F.col("number") < size)
        return rows.join(commits, "batch").withColumn("id", F.col("id") + F.col("first")).select(*NAMES)

    def append(self, trials: list[dict]) -> None:
        """Adds trials (trial_id, run_id, strategy_family, config_hash, params, data_snapshot_hashes, cv_scheme, metrics, seed,
        git_sha); a trial_id that is there already, or twice, is an error and nothing is added."""
        ids = [t["trial_id"] for t in trials]
        if len(ids) != len(set(ids)):
            raise ValueError("a trial_id occurs twice")
        if not ids:
            return
        size = self.log.size()
        wanted = self.spark.createDataFrame([(i,) for i in ids], "trial_id string")
        if size and (old := self._table(size).join(F.broadcast(wanted), "trial_id", "left_semi").select("trial_id").first()) is not None:  # as many rows as trials to add
            raise ValueError(f"trial {old['trial_id']} is there already")
        batch, at = uuid.uuid4().hex, datetime.now(UTC)
        rows = [{"id": k, "ts": t.get("ts", at), "seed": None, "git_sha": None, "data_snapshot_hashes": [], "cv_scheme": None, **t, "params": canonical(t["params"])} for k, t in enumerate(trials)]
        self.spark.createDataFrame([tuple(r.get(n) for n in NAMES) for r in rows], SCHEMAS["trials"]).coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/rows/batch={batch}")
        first = self._next(size)
        while not self.log.put(size, {"number": size, "batch": batch, "first": first, "n": len(ids), "trial_ids": ids}):
            other = self.log.read(size)  # a writer that came first
            if taken := set(ids) & set(other["trial_ids"]):
                raise ValueError(f"trial {min(taken)} is there already")
            size, first = size + 1, other["first"] + other["n"]

    def _next(self, size: int) -> int:
        """The first free id after so many commits."""
        if not size:
            return 1
        last = self.log.read(size - 1)
        return last["first"] + last["n"]

    def count(self, family: str | None = None) -> int:
        return self.all(family).count()

    def all(self, family: str | None = None) -> DataFrame:
        """Trials in the order they were added."""
        t = self._table()
        return (t if family is None else t.filter(F.col("strategy_family") == family)).orderBy("id")

    def list_hash(self, family: str | None = None) -> str:
        """SHA-256 over the canonical JSON of the trials, in order."""
        rows = self.all(family).select("trial_id", "config_hash", "cv_scheme", "metrics").collect()  # a row for each configuration tried
        payload = [{"trial_id": r["trial_id"], "config_hash": r["config_hash"], "cv_scheme": r["cv_scheme"], "metrics": dict(r["metrics"] or {})} for r in rows]
        return hashlib.sha256(LIST_TAG + canonical(payload).encode()).hexdigest()

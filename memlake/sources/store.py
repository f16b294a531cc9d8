"""The memory store: two versioned tables kept as logs of folded changes.

Every batch adds one version: for each table a folder ``v=<n>`` with the last
operation per key, so a write costs what the batch holds and never rewrites a
user's stored memories, however many there are.  Reading folds the versions
since the last base over that base; :meth:`MemoryStore.compact` writes a new
base.  A version counts only once its commit row is there, which is written
last: a failed or killed batch leaves the state as it was, and running it
again overwrites its own folders.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from memlake.operators.state import apply_core, newest_rows
from memlake.schema import MESSAGES, SPARSE

SCHEMAS = {
    "general": (
        "user_id string, memory_id string, memory_text string, "
        f"dense array<float>, sparse {SPARSE}, is_insert boolean"
    ),
    "core": (
        "user_id string, memory_id string, memory_text string, ord bigint, ord_pos bigint, "
        "is_insert boolean"
    ),
    "jobs": (
        f"req_id string, user_id string, seq bigint, messages {MESSAGES}, threshold double, "
        "expanded_query string, status string, raw string, reason string"
    ),
    "facts": (
        "req_id string, user_id string, seq bigint, pos bigint, tier string, slot string, "
        "value string, memory_text string"
    ),
    "hits": (
        "req_id string, user_id string, memory_id string, memory_text string, rank int"
    ),
    "plans": "req_id string, user_id string, seq bigint, plan_json string",
    "actions": (
        "req_id string, user_id string, seq bigint, tier string, pos bigint, "
        "action_type string, payload string, target_memory_id string, verdict string"
    ),
    "audit": (
        "jobs bigint, dead bigint, replayed bigint, skipped bigint, accepted bigint, "
        "inserted bigint, deleted bigint, not_found bigint, ignored bigint, invalid bigint"
    ),
}
SCHEMAS["decoded"] = SCHEMAS["jobs"]
SCHEMAS["encoded"] = SCHEMAS["general"] + ", problem string"
SCHEMAS["failed"] = "seq bigint, problem string"
SCHEMAS["lines"] = "value string, part int, line bigint"
SCHEMAS["deletes"] = "request_id string, requested bigint, deleted bigint, missing bigint, status string"
_KEY = ["user_id", "memory_id"]


class Commit(NamedTuple):
    version: int
    kind: str
    source: str
    batch_id: int


class MemoryStore:
    """General memories, core profiles, and the log of jobs behind them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._commits: list[Commit] | None = None

    def pinned(self) -> MemoryStore:
        """The same store, but reading the versions there are now and no later ones."""
        pin = MemoryStore(self.spark, self.root)
        pin._commits = self.commits()
        return pin

    @classmethod
    def create(
        cls,
        spark: SparkSession,
        root: str,
        general: DataFrame | None = None,
        core: DataFrame | None = None,
    ) -> MemoryStore:
        """A new store, empty or filled with given tables as its first base (version -1)."""
        store = cls(spark, root)

        def rows(given: DataFrame | None, name: str) -> DataFrame:
            empty = spark.createDataFrame([], SCHEMAS[name]).drop("is_insert")
            return empty if given is None else given.select(empty.columns)

        store._write_base(rows(general, "general"), rows(core, "core"), -1)
        return store

    # -- versions -----------------------------------------------------------

    def _path(self, name: str, version: int) -> str:
        return f"{self.root}/{name}/v={version}"

    def commits(self) -> list[Commit]:
        """What is committed, in order of version; one small row each."""
        if self._commits is not None:
            return self._commits
        schema = "source string, batch_id bigint, kind string, v bigint"
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/commits")
        found = [Commit(r.v, r.kind, r.source, r.batch_id) for r in rows.collect()]
        return sorted(found, key=lambda c: (c.version, c.kind != "base"))

    def next_version(self) -> int:
        return self.commits()[-1].version + 1

    def has_batch(self, source: str, batch_id: int) -> bool:
        """Whether a batch, numbered by its source, is part of the store already."""
        return any((c.source, c.batch_id) == (source, batch_id) for c in self.commits())

    def _live(self, before: int | None) -> tuple[int, list[int]]:
        seen = [c for c in self.commits() if before is None or c.version < before]
        base = max(c.version for c in seen if c.kind == "base")
        return base, [c.version for c in seen if c.kind == "delta" and c.version > base]

    def commit(
        self, version: int, kind: str = "delta", source: str = "", batch_id: int = -1
    ) -> None:
        """Make a version count.  One row in one file, so it is there or it is not."""
        named = F.lit(source).alias("source"), F.lit(batch_id).cast("bigint").alias("batch_id")
        row = self.spark.range(1).select(*named).coalesce(1)
        row.write.mode("overwrite").parquet(f"{self.root}/commits/kind={kind}/v={version}")

    def stage(self, rows: DataFrame, name: str, version: int, part: int | None = None) -> DataFrame:
        """Write rows as a table of a version and read them back, which ends their lineage.

        A table that grows while its version is made has numbered parts.
        """
        schema = StructType.fromDDL(SCHEMAS[name])
        path = self._path(name if part is None else f"{name}-{part}", version)
        rows.select(schema.names).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def log(self, name: str, before: int | None = None) -> DataFrame:
        """All committed rows of a per-version table, with their version ``v``."""
        deltas = [
            c.version
            for c in self.commits()
            if c.kind == "delta" and (before is None or c.version < before)
        ]
        return self._read(name, deltas)

    def dead_letters(self) -> DataFrame:
        """Job lines that could not be decoded: (raw, reason, v).  They are kept, never retried."""
        return self.log("jobs").where("status = 'dead'").select("raw", "reason", "v")

    def _read(self, name: str, versions: list[int]) -> DataFrame:
        schema = f"{SCHEMAS[name]}, v bigint"
        if not versions:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}")
        return reader.parquet(*[self._path(name, v) for v in versions])

    def _base(self, name: str, version: int) -> DataFrame:
        fields = StructType.fromDDL(SCHEMAS[name]).fields
        schema = StructType([f for f in fields if f.name != "is_insert"])
        return self.spark.read.schema(schema).parquet(self._path(f"{name}_base", version))

    # -- reading ------------------------------------------------------------

    def general(self, before: int | None = None) -> DataFrame:
        """General memories (user_id, memory_id, memory_text, dense, sparse)."""
        base_version, deltas = self._live(before)
        base = self._base("general", base_version)
        if not deltas:
            return base
        last = newest_rows(self._read("general", deltas), _KEY, F.desc("v"))
        kept = base.join(last.select(_KEY), _KEY, "left_anti").select(base.columns)
        return kept.unionByName(last.where("is_insert").select(base.columns))

    def core(self, before: int | None = None) -> DataFrame:
        """Core memories (user_id, memory_id, memory_text, ord, ord_pos)."""
        base_version, deltas = self._live(before)
        base = self._base("core", base_version)
        if not deltas:
            return base
        changes = self._read("core", deltas)
        strikes = (
            changes.where(~F.col("is_insert")).groupBy(*_KEY).agg(F.max("v").alias("struck"))
        )
        rows = base.withColumn("v", F.lit(base_version).cast("bigint")).unionByName(
            changes.where("is_insert").drop("is_insert")
        )
        return (
            rows.join(strikes, _KEY, "left")
            .where(F.col("struck").isNull() | (F.col("struck") <= F.col("v")))
            .select(base.columns)
        )

    # -- writing ------------------------------------------------------------

    def write_general(self, ops: DataFrame, version: int) -> None:
        """The operations of a batch, one per memory; ``ops`` carries vectors on its inserts."""
        self.stage(ops, "general", version)

    def write_core(self, ops: DataFrame, version: int) -> None:
        """Entries a batch adds and outlive it, and the ids it strikes."""
        nothing = self.spark.createDataFrame([], SCHEMAS["core"]).drop("is_insert")
        added = apply_core(nothing, ops).withColumn("is_insert", F.lit(True))
        struck = (
            ops.where(~F.col("is_insert"))
            .select(_KEY)
            .distinct()
            .withColumn("is_insert", F.lit(False))
        )
        self.stage(added.unionByName(struck, allowMissingColumns=True), "core", version)

    def compact(self) -> int:
        """Fold all versions into a new base; returns its version."""
        last = self.next_version() - 1
        if self._live(None)[1]:
            self._write_base(self.general(), self.core(), last)
        return last

    def _write_base(self, general: DataFrame, core: DataFrame, version: int) -> None:
        # Ranges over (user, memory) keep a user's rows together for file
        # skipping, yet split a user too large for one file.
        for name, rows in (("general", general), ("core", core)):
            (
                rows.repartitionByRange(*_KEY)
                .sortWithinPartitions(*_KEY)
                .write.mode("overwrite")
                .parquet(self._path(f"{name}_base", version))
            )
        self.commit(version, "base")


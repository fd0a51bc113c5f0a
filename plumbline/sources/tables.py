"""
Parquet tables that change together.

Each write goes to a new folder; one small manifest file then names the folders
that make up every table. Readers resolve tables through the newest manifest, so
they see all of a change or none of it, and a job that dies half way leaves only
unreferenced folders. Staging and transformation tables hold one part per batch,
so replacing a batch never rewrites, or even lists, the others. Curated tables are
laid out in parts by a hash of their key, so an upsert reads and rewrites only the parts its keys fall in.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping
from threading import RLock

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.operators.mutate import KEPT, NEW, OLD, upsert_in_place

WHOLE = ""  # the part of a table that is not split
REPLACED = -1  # where an upsert puts the rows that others replaced; no manifest names it
KEY_PARTS = 16  # parts of a table laid out by key; a store keeps the number it began with
# The keys of the tables with batches, and of the curated table that others point at.
KEYS = {name: key for stg, (key, trn, _, _) in schemas.ENTITIES.items() for name in (stg, trn)}
POINTED_AT = {"POLICY_MASTER": "POLICY_ID"}
# Columns that no check matching by key reads.
UNMATCHED = {"STG_POLICY": ("POLICY_NUMBER", "SUM_INSURED"), "TRN_POLICY": ("POLICY_TERM_DAYS", "BATCH_ID"),
             "STG_CLAIM": ("LAST_UPDATED_TS",), "TRN_CLAIM": ("OUTSTANDING_AMOUNT", "CLAIM_YEAR_MONTH", "BATCH_ID")}


class TableStore(Mapping):
    """Read access: ``store[name]`` and ``store.batch(name, batch_id)``."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, str] | None = None,
                 key_parts: int = KEY_PARTS):
        self.spark, self.root, self.key_parts = spark, root.rstrip("/"), key_parts
        self.ddl = dict(tables or schemas.TABLES)
        self.refresh()

    def refresh(self) -> None:
        """Move to the newest published version."""
        self.version, self.parts = _newest(self.spark, f"{self.root}/manifest")

    def __getitem__(self, name: str) -> DataFrame:
        paths = [p for (t, _), ps in sorted(self.parts.items()) if t == name for p in ps]
        return self._read(name, paths)

    def __iter__(self) -> Iterator[str]:
        return iter(self.ddl)

    def __len__(self) -> int:
        return len(self.ddl)

    def batch(self, name: str, batch_id: str) -> DataFrame:
        """One batch's rows: only that part's folders are opened."""
        return self._read(name, self.parts.get((name, batch_id), []))

    def touched(self, name: str, key: str, keys: DataFrame) -> DataFrame:
        """All rows of the parts that the keys fall in, and of those not laid out by key."""
        wanted = set(_part_numbers(keys, key, modulus := self.modulus(name)))
        return self._read(name, [p for (t, part), ps in sorted(self.parts.items()) if t == name
                                 and (part == WHOLE or _number(part, modulus) in wanted) for p in ps])

    def modulus(self, name: str) -> int:
        """How many parts a table is laid out in by key."""
        return next((int(part.split("/")[1]) for t, part in self.parts if t == name and "/" in part), self.key_parts)

    def _read(self, name: str, paths: list[str]) -> DataFrame:
        ddl = self.ddl[name]
        if not paths:
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(*[f"{self.root}/data/{p}" for p in paths])

    def change(self) -> Change:
        return Change(self)


class Change:
    """A set of table writes that becomes visible with ``publish``."""

    def __init__(self, store: TableStore):
        self.store = store
        self.parts = {k: list(v) for k, v in store.parts.items()}
        self.upserted: dict[str, int] = {}  # rows put into a table laid out by key
        self._replaced: dict[str, list[str]] = {}

    def write(
        self, name: str, rows: DataFrame, part: str = WHOLE, append: bool = False
    ) -> DataFrame:
        """Write a part's new content, replacing or adding to it; returns what was written."""
        types = schemas.types(self.store.ddl[name])
        typed = _typed(rows, types)
        path = f"{name}/{uuid.uuid4().hex}"
        typed.write.parquet(f"{self.store.root}/data/{path}")
        kept = self.parts.get((name, part), []) if append else []
        if part == WHOLE and not append:  # the new content takes the place of all that was laid out by key
            self.parts = {k: v for k, v in self.parts.items() if k[0] != name or "/" not in k[1]}
        self.parts[(name, part)] = [*kept, path]
        return self.store._read(name, [path])

    def upsert(self, name: str, rows: DataFrame, key: str, keep_replaced: bool = False) -> list[str]:
        """
        Put rows in the place of those with the same key; returns the parts that were rewritten.

        Only these parts are read. A table that was written whole is laid out by key at its first upsert. One shuffle
        serves the match and the layout. With ``keep_replaced`` the rows that went are there in ``replaced``.
        """
        modulus = self.store.modulus(name)
        rows = _typed(rows, schemas.types(self.store.ddl[name]))
        numbers = _part_numbers(rows, key, modulus)
        self.upserted[name] = 0
        if not numbers:
            return []
        if (name, WHOLE) in self.parts:
            numbers = list(range(modulus))
        parts = [f"{n}/{modulus}" for n in numbers]
        held = [p for part in (WHOLE, *parts) for p in self.parts.get((name, part), [])]
        path, seen = f"{name}/{uuid.uuid4().hex}", Observation()
        # Places are finer than parts, so that there are tasks enough; each lies in one part.
        places = modulus * max(1, int(self.store.spark.conf.get("spark.sql.shuffle.partitions")) // modulus)
        new = rows.withColumn("_is", F.lit(NEW))
        stacked = self.store._read(name, held).withColumn("_is", F.lit(KEPT)).unionByName(new) if held else new
        laid = stacked.withColumn("_place", _part_number(key, places)).withColumn(
            "part", F.pmod(F.col("_place"), F.lit(modulus))).repartition("_place")
        if held:
            laid = upsert_in_place(laid, key, ["part", "_place"])
        found = laid.observe(seen, F.count_if(F.col("_is") == NEW).alias("new"), F.count_if(F.col("_is") == OLD).alias("old"))
        if keep_replaced:
            found = found.withColumn("part", F.when(F.col("_is") == OLD, REPLACED).otherwise(F.col("part")))
        else:
            found = found.filter(F.col("_is") != OLD)
        found.drop("_is", "_place").write.partitionBy("part").parquet(f"{self.store.root}/data/{path}")
        self.upserted[name] = seen.get["new"]
        if keep_replaced and seen.get["old"]:
            self._replaced[name] = [f"{path}/part={REPLACED}"]
        if self.parts.pop((name, WHOLE), None):  # then a part may be empty
            written = self.store.spark.read.parquet(f"{self.store.root}/data/{path}").select("part").distinct()
            numbers = [r.part for r in written.collect() if r.part != REPLACED]
        self.parts |= {(name, f"{n}/{modulus}"): [f"{path}/part={n}"] for n in numbers}
        return parts

    def replaced(self, name: str) -> DataFrame:
        """The rows in whose place the table's last upsert put others, where it was told to keep them."""
        return self.store._read(name, self._replaced.get(name, []))

    def table(self, name: str) -> DataFrame:
        """A table as this change leaves it."""
        return self.store._read(name, [p for (t, _), ps in sorted(self.parts.items()) if t == name for p in ps])

    def drop(self, name: str, part: str) -> None:
        self.parts.pop((name, part), None)

    def publish(self) -> int:
        """
        Make every write visible at once. Fails, changing nothing, when another
        change was published since this one began.
        """
        version = self.store.version + 1
        rows = [(t, part, p) for (t, part), ps in sorted(self.parts.items()) for p in ps]
        frame = self.store.spark.createDataFrame(rows, "name string, part string, path string")
        frame.coalesce(1).write.mode("errorifexists").json(
            f"{self.store.root}/manifest/version={version}"
        )
        self.store.version, self.store.parts = version, self.parts
        return version


def _typed(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def _part_number(key: str, modulus: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(modulus)).cast("int")


def _part_numbers(rows: DataFrame, key: str, modulus: int) -> list[int]:
    """The parts that keys fall in: at most ``modulus`` numbers."""
    return sorted(r.part for r in rows.select(_part_number(key, modulus).alias("part")).distinct().collect())


def _number(part: str, modulus: int) -> int | None:
    number, _, of = part.partition("/")
    return int(number) if of == str(modulus) else None


def _newest(spark: SparkSession, folder: str) -> tuple[int, dict[tuple[str, str], list[str]]]:
    """The highest complete manifest; it lists tables and batches, never data rows."""
    schema = "name string, part string, path string, version int"
    try:
        manifests = spark.read.schema(schema).json(folder)
    except Exception as exc:  # nothing published yet
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return 0, {}
    newest = manifests.agg(F.max("version").alias("v")).first().v
    parts: dict[tuple[str, str], list[str]] = {}
    if newest is not None:
        for r in manifests.filter(F.col("version") == newest).collect():
            parts.setdefault((r.name, r.part or WHOLE), []).append(r.path)
    return newest or 0, parts


class SharedTables(Mapping):
    """
    Tables for several jobs that match the same rows by the same key: such rows are laid out by their key once, at
    first use, and kept by the executors until ``release``. The rows are those of ``tables``. Whoever asks gets them
    once they lie there, so that plans are made with their sizes and their layout known.
    """

    def __init__(self, spark: SparkSession, tables: Mapping):
        self.spark, self.tables = spark, tables
        self._held: dict[tuple, DataFrame] = {}
        self._lock, self._locks = RLock(), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name in POINTED_AT:
            return self.once((name,), lambda: self.by_key(self.tables[name], POINTED_AT[name]))
        return self.tables[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.tables)

    def __len__(self) -> int:
        return len(self.tables)

    def batch(self, name: str, batch_id: str) -> DataFrame:
        return batch_of(self.tables, name, batch_id)

    def keyed(self, name: str, batch_id: str) -> DataFrame:
        """A batch's rows by their key, without columns that nothing matched by key is compared in."""
        return self.once((name, batch_id), lambda: self.by_key(
            self.batch(name, batch_id).drop(*UNMATCHED.get(name, ()), "LOAD_TS"), KEYS[name]))

    def once(self, what: tuple, make: Callable[[], DataFrame]) -> DataFrame:
        """The same kept frame for everyone who asks for ``what``."""
        with self._lock:
            own = self._locks.setdefault(what, RLock())
        with own:  # ``make`` may ask for others, never for itself
            if what not in self._held:
                rows = make().persist()
                try:
                    rows.count()
                except BaseException:
                    rows.unpersist()
                    raise
                self._held[what] = rows
            return self._held[what]

    def release(self) -> None:
        with self._lock:
            for rows in self._held.values():
                rows.unpersist()
            self._held.clear()

    def by_key(self, rows: DataFrame, key: str) -> DataFrame:
        if key not in rows.columns:  # whoever needs it will say so
            return rows
        # A number of its own, or run-time re-planning would size each frame differently and none would meet another.
        return rows.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), key)


def batch_of(tables: Mapping, name: str, batch_id: str) -> DataFrame:
    """One batch's rows from a store or from a plain dict of frames."""
    if hasattr(tables, "batch"):
        return tables.batch(name, batch_id)
    return tables[name].filter(F.col("BATCH_ID") == batch_id)


def keyed_batch_of(tables: Mapping, name: str, batch_id: str) -> DataFrame:
    """``batch_of`` for matching by key, where the tables are shared laid out by it."""
    return tables.keyed(name, batch_id) if hasattr(tables, "keyed") else batch_of(tables, name, batch_id)


def replace_partition(rows: DataFrame, path: str, column: str = "BATCH_ID") -> None:
    """Overwrite only the partitions present in ``rows`` of a partitioned Parquet folder."""
    rows.write.option("partitionOverwriteMode", "dynamic").partitionBy(column).mode(
        "overwrite"
    ).parquet(path)


def append_partition(rows: DataFrame, path: str, column: str = "BATCH_ID") -> None:
    rows.write.partitionBy(column).mode("append").parquet(path)


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("escape", '"').mode("overwrite").csv(path)

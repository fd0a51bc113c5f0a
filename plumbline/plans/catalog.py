"""The stored rule catalog as a table: its checks, versions and copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.latest import latest_by
from plumbline.plans.rules import COMPARE, COUNTS, KINDS

# Fields a snapshot carries, and so what restoring one brings back.
SNAPSHOT = ("test_name", "test_type", "folder_id", "severity", "source_sql", "target_sql",
            "validation_sql", "key_columns", "compare_columns", "tolerance", "is_active")


def lint(catalog: DataFrame) -> DataFrame:
    """test_case_id, problem: everything that stops a definition from being saved."""
    def empty(name: str) -> Column:
        return F.trim(F.coalesce(name, F.lit(""))) == ""

    kind = F.coalesce("test_type", F.lit(""))
    two_sided = kind.isin(COMPARE, COUNTS)
    # The wording of each problem.
    problems = [
        (empty("test_name"), "Test name is required."),
        (~kind.isin(*KINDS), f"Test type must be one of: {', '.join(KINDS)}"),
        (two_sided & empty("source_sql"), "Source SQL is required for this test type."),
        (two_sided & empty("target_sql"), "Target SQL is required for this test type."),
        ((kind == COMPARE) & (F.trim(F.translate(F.coalesce("key_columns", F.lit("")),
                                                 ",", " ")) == ""),
         "Key column(s) are required to match source rows to target rows."),
        (~two_sided & empty("validation_sql"), "Validation SQL is required for this test type."),
    ]
    found = F.array(*[F.when(bad, text) for bad, text in problems])
    return catalog.select("test_case_id", F.explode(found).alias("problem")).filter(
        "problem is not null"
    )


def name_clashes(rows: DataFrame, scope: list[str], name: str, reserved: bool = False) -> DataFrame:
    """
    Names used twice in a scope, ignoring case. Inactive rows free their name
    unless ``reserved`` (project and folder names stay taken).
    """
    live = rows if reserved else rows.filter("is_active")
    return live.groupBy(*scope, F.upper(name).alias("name_key")).agg(
        F.count(F.lit(1)).alias("n_rows")
    ).filter("n_rows > 1")


# ---------------------------------------------------------------- versions
def snapshot() -> Column:
    return F.to_json(F.struct(*SNAPSHOT))


def archive(catalog: DataFrame, note: str, by: str, now: Column) -> DataFrame:
    """Version-log rows holding the catalog rows' current state."""
    return catalog.select(
        F.uuid().alias("version_id"), "test_case_id", "version_no",
        snapshot().alias("snapshot_json"), F.lit(note).alias("change_note"),
        F.lit(by).alias("changed_by"), now.cast("timestamp_ntz").alias("changed_ts"),
    )


def save(catalog: DataFrame, edits: DataFrame, by: str, now: Column, note: str = "Edited"):
    """
    (new catalog, version-log rows) after saving ``edits``: the replaced state is
    archived, the version goes up by one, the new state is archived.
    """
    current = catalog.join(edits.select("test_case_id"), "test_case_id", "left_semi")
    old = archive(current, "Superseded", by, now).withColumn(
        "change_note", F.concat(F.lit("Superseded by v"), (F.col("version_no") + 1).cast("string"))
    )
    bumped = edits.drop("version_no").join(
        current.select("test_case_id", (F.col("version_no") + 1).alias("version_no")),
        "test_case_id",
    ).select(*catalog.columns)
    kept = catalog.join(edits.select("test_case_id"), "test_case_id", "left_anti")
    return kept.unionByName(bumped), old.unionByName(archive(bumped, note, by, now))


def latest_snapshots(versions: DataFrame) -> DataFrame:
    """The most recent snapshot of each (test, version)."""
    return latest_by(
        versions, ["test_case_id", "version_no"],
        [F.col("changed_ts").desc_nulls_last(), F.col("version_id").desc()],
    )


def restored(versions: DataFrame, version_no: int) -> DataFrame:
    """Snapshot of ``version_no`` per test, as the version after the highest one."""
    top = versions.groupBy("test_case_id").agg(F.max("version_no").alias("_top"))
    chosen = latest_snapshots(versions.filter(F.col("version_no") == version_no))
    return chosen.join(top, "test_case_id").select(
        "test_case_id", (F.col("_top") + 1).alias("version_no"), "snapshot_json",
        F.lit(f"Restored from v{version_no}").alias("change_note"),
    )


def version_log(versions: DataFrame) -> DataFrame:
    return versions.select(
        "test_case_id", "version_no", "change_note", "changed_by", "changed_ts"
    ).orderBy("test_case_id", F.col("version_no").desc(), F.col("changed_ts").desc())


def copy_into(catalog: DataFrame, names: list[str], folder_id: str) -> DataFrame:
    """Independent version-1 copies of rules by name, in another folder, without ids yet."""
    return catalog.filter(F.col("test_name").isin(names)).withColumns(
        {"folder_id": F.lit(folder_id), "version_no": F.lit(1),
         "test_case_id": F.lit(None).cast("string")}
    )


def seed(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """Idempotent seeding: match on folder and upper-cased name; new, changed or kept."""
    a, b = catalog.alias("a"), wanted.alias("b")
    same = (F.col("a.folder_id") == F.col("b.folder_id")) & (
        F.upper("a.test_name") == F.upper("b.test_name")
    )
    return a.join(b, same, "full_outer").select(
        F.coalesce("b.folder_id", "a.folder_id").alias("folder_id"),
        F.coalesce("b.test_name", "a.test_name").alias("test_name"),
        F.when(F.col("a.test_name").isNull(), "created")
        .when(F.col("b.test_name").isNull(), "kept").otherwise("updated").alias("action"),
    )

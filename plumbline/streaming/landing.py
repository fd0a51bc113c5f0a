"""
Pick up new landing files and stage them, one batch per micro-batch.

The stream's checkpoint remembers which files were read; the stream itself carries their paths only. Columns
are found by the headers, so files may order them differently; files of one header are read in one scan, and what
is missing rejects the micro-batch. A batch id is derived
from the micro-batch number and staging replaces a batch, so a micro-batch that is
replayed after a failure leaves the same rows, once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.preload import spec_for
from plumbline.plans.promote import NotLoaded, promote, stage
from plumbline.sources.files import by_first_line, no_glob
from plumbline.sources.tables import TableStore

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def stage_new_files(
    store: TableStore,
    table: str,
    folder: str,
    checkpoint: str,
    prefix: str,
    then_promote: bool = False,
    on_rejected: Callable[[str, str], None] | None = None,
    **csv_options,
) -> StreamingQuery:
    """
    Stage every file that arrived since the last call, then stop. A rejected
    micro-batch stops the stream unless ``on_rejected`` takes it (batch id, why).
    """
    spark = store.spark
    wanted = spec_for(table).columns

    def by_header(paths: list[str]) -> DataFrame:
        reader = spark.read.option("header", True).option("escape", '"').options(**csv_options)
        rows = reader.csv([no_glob(p) for p in paths])  # all text; the load itself types the columns
        named = {c.strip().upper(): c for c in rows.columns}
        return rows.select(*[F.col(f"`{named[c]}`").alias(c) for c in wanted if c in named],
                           *[F.col(f"`{o}`") for c, o in named.items() if c not in wanted])

    def load(files: DataFrame, epoch: int) -> None:
        paths = sorted(r.path for r in files.collect())  # new files
        groups = by_first_line(spark, paths) if paths else []
        if not groups:
            return
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(by_header, sorted(groups)))
        if rows.isEmpty():
            return
        batch_id = f"{prefix}_{epoch:06d}"
        store.refresh()
        try:
            stage(store, table, rows, batch_id, source_file=folder)
            if then_promote:
                promote(store, batch_id)
        except NotLoaded as problem:
            if on_rejected is None:
                raise
            on_rejected(batch_id, str(problem))

    # Without the content column no file is opened.
    files = spark.readStream.format("binaryFile").schema(FILES).load(folder).select("path")
    return (
        files.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )

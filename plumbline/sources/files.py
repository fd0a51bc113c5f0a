"""
A folder of delimited, JSON and Parquet files as a set of tables.

File names, headers and per-file facts are handled on the driver; file contents
are only ever read by Spark. What a delimited file needs (encoding, quoted line breaks,
delimiter, header, column types) comes from passes over all such files at once, so the number
of jobs does not grow with the files. JSON and Parquet files take one small job each, for their schema.
"""

from __future__ import annotations

import csv
import io
import os
import re
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What is read, and how each kind separates its fields.
DELIMITED = (".csv", ".tsv", ".txt", ".psv", ".dat")
JSON = (".json", ".jsonl")
PARQUET = (".parquet",)
SUPPORTED = DELIMITED + JSON + PARQUET
FIXED_DELIMITERS = {".tsv": "\t", ".psv": "|"}
CANDIDATE_DELIMITERS = ",;\t|"

# Windows-1252 gives most of the bytes 0x80-0x9F a printable character; Spark
# reads them as the Latin-1 control characters, which are then translated.
_C1 = [bytes([b]) for b in range(0x80, 0xA0)]
_CP1252 = {b.decode("latin-1"): b.decode("cp1252", "ignore") for b in _C1}
CP1252_FROM = "".join(k for k, v in _CP1252.items() if v)
CP1252_TO = "".join(v for v in _CP1252.values() if v)
CP1252_UNUSED = "".join(k for k, v in _CP1252.items() if not v)

LISTING = "path string, file string, size bigint, modified timestamp"


# ------------------------------------------------------------------ listing
def list_files(spark: SparkSession, path: str, part_folders: bool = False) -> DataFrame:
    """
    Supported files under ``path`` (a folder or one file): path, file, size, modified.

    Sub-folders and temporary files are skipped. With ``part_folders`` a folder
    named like a file (``orders.csv/part-…``), which is how Spark writes one, is
    listed as that file. Only metadata is read.
    """
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(no_glob(path))
    # A scan skips empty files, so their names come from the file index.
    names = [(unquote(p).replace("file:///", "file:/"),) for p in scan.inputFiles()]
    found = spark.createDataFrame(names, "path string").join(
        scan.select("path", "length", "modificationTime"), "path", "left"
    )
    root = urlparse(path).path.rstrip("/") + "/"
    at = F.locate(root, F.col("path"))
    below = F.when(at > 0, F.expr("path").substr(at + len(root), F.length("path"))).otherwise(
        F.substring_index("path", "/", -1)
    )
    depth = F.size(F.split("below", "/"))
    listed = found.withColumn("below", below)
    name = F.substring_index("below", "/", 1)
    if part_folders:
        listed = listed.filter(depth <= 2).withColumn(
            "path", F.when(depth == 2, F.regexp_replace("path", r"/[^/]+$", ""))
            .otherwise(F.col("path"))
        )
    else:
        listed = listed.filter(depth == 1)
    extension = F.lower(F.concat(F.lit("."), F.substring_index(name, ".", -1)))
    return (
        listed.filter(extension.isin(*SUPPORTED) & ~name.rlike(r"^(\.|~\$)"))
        .groupBy("path", name.alias("file"))
        .agg(F.coalesce(F.sum("length"), F.lit(0)).alias("size"), F.max("modificationTime").alias("modified"))
    )


def no_glob(path: str) -> str:
    """The path as Spark's readers take it literally."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def table_name(file: Column) -> Column:
    """Table name for a file: '2026 feed.csv' -> T_2026_FEED."""
    stem = F.regexp_replace(file, r"\.[^.]*$", "")
    cleaned = F.upper(F.regexp_replace(stem, r"(?U)\W+", "_"))
    name = F.coalesce(F.nullif(F.btrim(cleaned, F.lit("_")), F.lit("")), F.lit("FILE"))
    return F.when(name.rlike(r"^\d"), F.concat(F.lit("T_"), name)).otherwise(name)


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """path and change (added, removed, modified) between two listings."""
    a, b = before.alias("a"), after.alias("b")
    differs = (F.col("a.size") != F.col("b.size")) | (F.col("a.modified") != F.col("b.modified"))
    change = (
        F.when(F.col("a.path").isNull(), "added").when(F.col("b.path").isNull(), "removed")
        .when(differs, "modified")
    )
    return (
        a.join(b, F.col("a.path") == F.col("b.path"), "full_outer")
        .select(F.coalesce("a.path", "b.path").alias("path"), change.alias("change"))
        .filter("change is not null")
    )


# ------------------------------------------------------------------ headers
# How a column without a name and a name that was there before are called.
UNNAMED, AGAIN = "COLUMN_{}", "{}_{}"


def clean_header(names: list[str | None]) -> list[str]:
    """Trimmed names; blanks numbered by position; repeats (ignoring case) get _2, _3, … in their order."""
    given = [(n or "").strip() for n in names]
    given = [n if n else UNNAMED.format(i + 1) for i, n in enumerate(given)]
    earlier = [sum(g.upper() == n.upper() for g in given[:i]) for i, n in enumerate(given)]
    # A first occurrence keeps its name, so numbered repeats step over all names of the file.
    used = {n.upper() for n in given}
    out = list(given)
    for i in (i for i, k in enumerate(earlier) if k):
        number = earlier[i] + 1
        while AGAIN.format(given[i], number).upper() in used:
            number += 1
        out[i] = AGAIN.format(given[i], number)
        used.add(out[i].upper())
    return out


def choose_delimiter(widths: dict[str, tuple[float, int]]) -> str:
    """
    Of the candidates' (share of records with the usual number of fields, that number), the one with the
    largest share and more than one field; ties go to the wider split, and comma is the fallback.
    """
    split = {c: found for c in CANDIDATE_DELIMITERS if (found := widths.get(c, (0.0, 1)))[1] > 1}
    return max(split, key=split.get) if split else ","


# ------------------------------------------------------------------ reading
@dataclass
class FileOptions:
    header: bool = True
    delimiter: str | None = None
    decimal: str = "."
    encoding: str | None = None
    all_text: bool = False


@dataclass(frozen=True)
class Layout:
    """How a file is read: files of one layout can be read in one scan."""

    format: str
    options: tuple[tuple[str, Any], ...] = ()

    def scan(self, spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
        reader = spark.read.format(self.format).options(**dict(self.options)).schema(schema)
        return reader.load([no_glob(p) for p in paths])


NO_COLUMNS = T.StructType([T.StructField("_none", T.StringType())])


@dataclass
class FileTable:
    table: str
    file: str
    path: str
    frame: DataFrame
    layout: Layout

    @property
    def columns(self) -> list[str]:
        return self.frame.columns


@dataclass
class FileTables:
    """Tables of a folder, plus the files that could not be read and why."""

    spark: SparkSession
    tables: list[FileTable] = field(default_factory=list)
    errors: list[tuple[str, str]] = field(default_factory=list)

    def __getitem__(self, table: str) -> DataFrame:
        return next(t.frame for t in self.tables if t.table == table)

    def register(self) -> None:
        for t in self.tables:
            t.frame.createOrReplaceTempView(t.table)

    def load_errors(self) -> DataFrame:
        return self.spark.createDataFrame(self.errors, "file string, error string")

    def describe(self) -> DataFrame:
        """table, file, row_count, columns — rows are counted in one scan per layout, not per file."""
        names = [(_bare(t.path), t.table, t.file, ", ".join(t.columns)) for t in self.tables]
        named = self.spark.createDataFrame(names, "owner string, table string, file string, columns string")
        paths = defaultdict(list)
        for t in self.tables:
            paths[t.layout].append(t.path)
        counts = [
            layout.scan(self.spark, some, NO_COLUMNS)
            .groupBy(F.col("_metadata.file_path").alias("part")).agg(F.count(F.lit(1)).alias("rows"))
            for layout, some in paths.items()
        ]
        if not counts:
            return named.select("table", "file", F.lit(0).cast("bigint").alias("row_count"), "columns")
        depth = _depth(self.tables[0].path)
        counted = reduce(DataFrame.unionByName, counts).groupBy(_owner(depth).alias("owner")).agg(F.sum("rows").alias("rows"))
        return named.join(counted, "owner", "left").select(
            "table", "file", F.coalesce("rows", F.lit(0)).alias("row_count"), "columns")


def read_folder(
    spark: SparkSession, path: str, options: FileOptions | None = None, part_folders: bool = False
) -> FileTables:
    """Every supported file as a table; an unreadable file is reported, the others load."""
    options = options or FileOptions()
    listing = list_files(spark, path, part_folders)
    files = listing.select(
        "path", "file", "size", table_name(F.col("file")).alias("table")
    ).orderBy("file", "path").collect()  # one row per file in one folder: names, not data
    out, taken = FileTables(spark), set()
    texts = [f for f in files if _extension(f.file) in DELIMITED and f.size]
    facts, unread = _isolated(texts, lambda some: _text_facts(spark, some, options))
    shapes = {path: _shape(known, options) for path, known in facts.items() if known.head is not None}
    kinds = {}
    if not options.all_text:
        kinds, failed = _isolated([f for f in texts if f.path in shapes],
                                  lambda some: _column_kinds(spark, some, shapes, options.decimal))
        unread |= failed
    for f in files:
        name, n = f.table, 2
        while name in taken:
            name, n = f"{f.table}_{n}", n + 1
        try:
            if f.path in unread:
                raise unread[f.path]
            frame, layout = _read_one(spark, f, options, shapes.get(f.path), kinds.get(f.path, {}))
        except Exception as exc:
            out.errors.append((f.file, _reason(exc)))
            continue
        taken.add(name)
        out.tables.append(FileTable(name, f.file, f.path, frame, layout))
    return out


def _isolated(files: list, look: Callable[[list], dict]) -> tuple[dict, dict[str, Exception]]:
    """
    What one look at all files finds, by path. Where it fails, its halves are looked at apart, down to the
    files that cannot be read: these are returned with their errors and do not keep the others from loading.
    """
    if not files:
        return {}, {}
    try:
        return look(files), {}
    except Exception as exc:
        if len(files) == 1:
            return {}, {files[0].path: exc}
    middle = len(files) // 2
    (found, failed), (more, others) = _isolated(files[:middle], look), _isolated(files[middle:], look)
    return found | more, failed | others


def read_file(spark: SparkSession, path: str, options: FileOptions | None = None) -> DataFrame:
    """One file as a table; raises when it cannot be read."""
    found = read_folder(spark, path, options)
    if found.errors:
        raise ValueError(found.errors[0][1])
    if len(found.tables) != 1:
        raise ValueError(f"{path} holds {len(found.tables)} tables")
    return found.tables[0].frame


def _reason(exc: Exception) -> str:
    inner = getattr(exc, "java_exception", exc)
    return f"{type(exc).__name__}: {str(inner).splitlines()[0]}"


def _extension(file: str) -> str:
    return os.path.splitext(file)[1].lower()


# ------------------------------------------------------------------ all delimited files at once
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def _bare(path: str) -> str:
    """A path without scheme and host."""
    return re.sub(SCHEME, "", path).rstrip("/")


def _depth(path: str) -> int:
    return _bare(path).count("/")


def _owner(depth: int) -> Column:
    """The listed file, or folder of part files, that the scanned file ``part`` belongs to."""
    path = F.regexp_replace("part", SCHEME, "")
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    listed = F.when(slashes > depth, F.regexp_replace(path, "/[^/]*$", "")).otherwise(path)
    return F.url_decode(F.replace(listed, F.lit("+"), F.lit("%2B")))


@dataclass
class _Facts:
    utf8: bool = True
    cp1252: bool = True
    quoted_breaks: bool = False
    head: bytes | None = None  # the first record
    widths: dict[str, tuple[float, int]] = field(default_factory=dict)
    extension: str = ""


@dataclass
class _Shape:
    layout: Layout
    names: list[str]
    cp1252: bool


def _quoting(separators: str, line: Column) -> tuple[Column, Column]:
    """
    Does a line end inside a quoted field, and what of it lies outside of quotes. A quote opens a field at its
    start only, so 5" is text; doubled quotes are text too and go first.
    """
    start = "(^|[" + re.sub(r"([\\\]\[^-])", r"\\\1", separators) + "]) *"
    closed = F.regexp_replace(line, start + '"[^"]*+"', "$1")
    inside = closed.rlike(start + '"')
    return inside, F.regexp_replace(closed, "(?s)" + start + '".*$', "$1")


def _widths(outside: Column) -> Column:
    """Under each candidate, how many delimiters a piece of text holds."""
    return F.array(*[
        F.octet_length(outside) - F.octet_length(F.replace(outside, F.lit(c), F.lit(""))) for c in CANDIDATE_DELIMITERS])


def _text_facts(spark: SparkSession, files: list, options: FileOptions) -> dict[str, _Facts]:
    """
    Encoding, quoted breaks, header record and the candidates' usual widths of every file, from all of its lines.

    Two passes over the files' text, neither of which shuffles it: counts of lines by their widths, and first lines
    (of each file's first block). Files with quoted line breaks take a third one, in which their lines' widths are
    put in order and summed to records; such a file is one task for Spark's reader as well.
    """
    separators = CANDIDATE_DELIMITERS + (options.delimiter or "")
    depth = _depth(files[0].path)
    raw = _lines(spark, [f.path for f in files])
    bare = F.replace("value", F.lit('""'), F.lit(""))
    has_quote = F.contains(F.col("value"), F.lit('"'))
    inside, outside = _quoting(separators, bare)
    opens = has_quote & inside
    outside = F.when(has_quote, outside).otherwise(F.col("value"))
    # Lines of plain ASCII hold no byte that Windows-1252 leaves unused; only the others are searched.
    plain = F.is_valid_utf8("value") & (F.octet_length("value") == F.length("value"))
    unused = ~plain & F.decode(F.col("value").cast("binary"), "ISO-8859-1").rlike(f"[{CP1252_UNUSED}]")
    by_width = raw.select(
        "part", _widths(outside).alias("widths"), (F.btrim("value") == "").alias("blank"),
        F.is_valid_utf8("value").alias("utf8"), opens.alias("opens"), unused.alias("unused"),
    ).groupBy("part", "widths", "blank", "utf8", "opens", "unused").agg(F.count(F.lit(1)).alias("n"))
    # One row per distinct kind of line; read twice below.
    lines = by_width.withColumn("owner", _owner(depth)).persist()
    try:
        path_of = {_bare(f.path): f.path for f in files}
        out = {f.path: _Facts(extension=_extension(f.file)) for f in files}
        measured = lines.groupBy("owner").agg(
            F.bool_and("utf8").alias("utf8"), F.bool_or("unused").alias("unused"), F.bool_or("opens").alias("opens"))
        for r in measured.collect():  # one row per file, as for all collects here
            known = out[path_of[r.owner]]
            known.utf8, known.cp1252, known.quoted_breaks = r.utf8, not r.unused, r.opens
        for owner, widths in _usual(lines.filter("not blank").select("owner", "widths", "n")).items():
            out[path_of[owner]].widths = widths
    finally:
        lines.unpersist()
    for r in _first_lines(raw, depth).collect():
        out[path_of[r.owner]].head = bytes(r.head)
    broken = [path for path, known in out.items() if known.quoted_breaks]
    if broken:
        records = _records(_lines(spark, broken), separators).withColumn("owner", _owner(depth)).persist()
        try:
            for owner, widths in _usual(records.select("owner", "widths", F.lit(1).alias("n"))).items():
                out[path_of[owner]].widths = widths
            first = records.filter("head is not null").groupBy("owner").agg(F.min_by("head", "part").alias("head"))
            for r in first.collect():
                out[path_of[r.owner]].head = bytes(r.head)
        finally:
            records.unpersist()
    return out


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """part, block, at (the order within a block) and value of every line."""
    return spark.read.text([no_glob(p) for p in paths]).select(
        F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value")


def _first_lines(lines: DataFrame, depth: int) -> DataFrame:
    """owner and head: the first line of each file that is not blank, sought in its first block."""
    first = F.min_by(F.col("value").cast("binary"), F.col("at"))
    return (
        lines.filter((F.col("block") == 0) & (F.btrim("value") != "")).groupBy("part").agg(first.alias("head"))
        .groupBy(_owner(depth).alias("owner")).agg(F.min_by("head", "part").alias("head"))
    )


def by_first_line(spark: SparkSession, paths: list[str]) -> list[list[str]]:
    """Files grouped by their first lines, in one job; blank files are left out."""
    path_of = {_bare(p): p for p in paths}
    groups = defaultdict(list)
    for r in _first_lines(_lines(spark, paths), max(map(_depth, paths))).collect():  # one row per file
        # A quoted line break may lie in the header, whose rest then is unknown.
        whole = r.head.count(b'"') % 2 == 0
        groups[bytes(r.head), None if whole else r.owner].append(path_of[r.owner])
    return [sorted(some) for some in groups.values()]


def _usual(counted: DataFrame) -> dict[str, dict[str, tuple[float, int]]]:
    """Per owner and candidate: the share of records with the usual width, and that width (the wider of equals)."""
    widths = counted.select("owner", "n", F.posexplode("widths").alias("candidate", "delimiters"))
    by_width = widths.groupBy("owner", "candidate", (F.col("delimiters") + 1).alias("width")).agg(F.sum("n").alias("n"))
    most = by_width.groupBy("owner", "candidate").agg(
        F.max(F.struct("n", "width")).alias("most"), F.sum("n").alias("all"))
    out: dict = defaultdict(dict)
    for r in most.collect():
        out[r.owner][CANDIDATE_DELIMITERS[r.candidate]] = (r.most.n / r["all"], r.most.width)
    return out


def _records(lines: DataFrame, separators: str) -> DataFrame:
    """
    part, widths and, of each part's first record, the text (head), for records whose quoted fields span lines.

    A line maps the state it starts in (outside or inside quotes) to the one it ends in: it keeps it, turns it, or
    ends in one whatever it was. The state after a line is that of the last line of the third sort, turned as
    often as lines after it turn.
    """
    bare = F.replace("value", F.lit('""'), F.lit(""))
    from_outside, left_outside = _quoting(separators, bare)
    from_inside, left_inside = _quoting(separators, F.concat(F.lit('"'), bare))
    in_order = Window.partitionBy("part").orderBy("block", "at")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = lines.select(
        "part", "block", "at", F.when(F.col("block") == 0, F.col("value").cast("binary")).alias("text"),
        (F.btrim("value") == "").alias("blank"),
        from_outside.cast("int").alias("a"), from_inside.cast("int").alias("b"),
        _widths(left_outside).alias("w_outside"), _widths(left_inside).alias("w_inside"))
    turned = seen.withColumn("turns", F.sum(F.when((F.col("a") == 1) & (F.col("b") == 0), 1).otherwise(0)).over(so_far))
    settled = F.when(F.col("a") == F.col("b"), F.struct("a", "turns"))
    last = turned.withColumn("last", F.last(settled, ignorenulls=True).over(so_far))
    ends = F.pmod(F.coalesce("last.a", F.lit(0)) + F.col("turns") - F.coalesce("last.turns", F.lit(0)), F.lit(2))
    state = last.withColumn("ends", ends).withColumn("starts", F.coalesce(F.lag("ends").over(in_order), F.lit(0)))
    placed = state.filter("starts = 1 or not blank").withColumn(
        "record", F.sum(F.when(F.col("starts") == 0, 1).otherwise(0)).over(so_far))
    width = F.when(F.col("starts") == 1, F.col("w_inside")).otherwise(F.col("w_outside"))
    pieces = placed.select(
        "part", "record", F.struct("at", "text").alias("line"), *[width[i].alias(f"w{i}") for i in range(len(CANDIDATE_DELIMITERS))])
    text = F.transform(F.array_sort(F.collect_list(F.when(F.col("record") == 1, F.col("line")))), lambda x: F.hex(x["text"]))
    return pieces.groupBy("part", "record").agg(
        text.alias("head"), *[F.sum(f"w{i}").alias(f"w{i}") for i in range(len(CANDIDATE_DELIMITERS))],
    ).select("part", F.array(*[f"w{i}" for i in range(len(CANDIDATE_DELIMITERS))]).alias("widths"),
             F.when(F.col("record") == 1, F.unhex(F.array_join("head", "0A"))).alias("head"))


def _shape(known: _Facts, options: FileOptions) -> _Shape:
    """How a file is read and what its columns are called."""
    legacy = not known.utf8 and options.encoding is None
    encoding = options.encoding or ("ISO-8859-1" if legacy else "UTF-8")
    sep = options.delimiter or FIXED_DELIMITERS.get(known.extension) or choose_delimiter(known.widths)
    text = known.head.decode(encoding, "replace").removeprefix("\ufeff")
    first = next(csv.reader(io.StringIO(text, newline=""), delimiter=sep, skipinitialspace=True))
    cp1252 = legacy and known.cp1252
    if cp1252:
        first = [name.translate(str.maketrans(CP1252_FROM, CP1252_TO)) for name in first]
    names = clean_header(first if options.header else [None] * len(first))
    layout = Layout("csv", (
        ("encoding", encoding), ("enforceSchema", True), ("escape", '"'), ("header", options.header),
        ("ignoreLeadingWhiteSpace", True), ("mode", "PERMISSIVE"),
        ("multiLine", known.quoted_breaks),  # unsplittable, so only where it is needed
        ("quote", '"'), ("sep", sep)))
    return _Shape(layout, names, cp1252)


def _column_kinds(spark: SparkSession, files: list, shapes: dict[str, _Shape], decimal: str) -> dict[str, dict[int, str]]:
    """
    By path and position, the kind of every column that is not text: one job over all files. Files of one layout
    are read in one scan, with columns by position up to the next power of two of their width.
    """
    groups = defaultdict(list)
    for f in files:
        shape = shapes[f.path]
        groups[shape.layout, max(8, 1 << (len(shape.names) - 1).bit_length())].append(f.path)
    found = []
    for (layout, width), paths in groups.items():
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
        # Cells are trimmed in a projection of their own, once for all tests.
        cells = layout.scan(spark, paths, schema).select(
            F.col("_metadata.file_path").alias("part"), *[F.btrim(F.nullif(F.col(f"c{i}"), F.lit(""))).alias(f"c{i}") for i in range(width)])
        tests = [t.alias(f"{name}{i}") for i in range(width) for name, t in _kind_tests(F.col(f"c{i}"), decimal).items()]
        columns = F.array(*[F.struct(*[F.col(f"{name}{i}").alias(name) for name in "nidb"]) for i in range(width)])
        found.append(cells.groupBy("part").agg(*tests).select("part", F.posexplode(columns).alias("position", "cells")))
    owned = reduce(DataFrame.unionByName, found).groupBy(_owner(_depth(files[0].path)).alias("owner"), "position").agg(
        F.sum("cells.n").alias("n"), *[F.bool_and(f"cells.{name}").alias(name) for name in "idb"])
    path_of = {_bare(f.path): f.path for f in files}
    out: dict = {f.path: {} for f in files}
    for r in owned.filter("n > 0 and (i or d or b)").collect():  # one row per column
        out[path_of[r.owner]][r.position] = "bigint" if r.i else "double" if r.d else "boolean"
    return out


def _number(c: Column, decimal: str) -> Column:
    return c if decimal == "." else F.replace(c, F.lit(decimal), F.lit("."))


def _kind_tests(c: Column, decimal: str) -> dict[str, Column]:
    """
    What the trimmed cells of a column agree on: a column is an integer, a decimal number or a boolean when every non-empty
    cell is one, else text. Dates stay text, as files spell them; comparisons understand them.
    """
    # A number begins with one of +,-./0123456789, so other cells need no pattern.
    begins = (c >= "+") & (c < ":") if decimal in (".", ",") else c.isNotNull()
    return {
        "n": F.count(c),
        "i": F.bool_and(begins & c.rlike(r"^[+-]?\d{1,18}$")),
        "d": F.bool_and(begins & _number(c, decimal).rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")),
        "b": F.bool_and(c.isin("True", "False", "TRUE", "FALSE", "true", "false")),
    }


# ------------------------------------------------------------------ one file
def _read_one(spark, f, options: FileOptions, shape: _Shape | None, kinds: dict[int, str]) -> tuple[DataFrame, Layout]:
    ext = _extension(f.file)
    if f.size == 0 or (ext in DELIMITED and shape is None):
        raise ValueError("the file is empty")
    if ext in DELIMITED:
        return _read_delimited(spark, f.path, shape, kinds, options.decimal), shape.layout
    if ext in JSON:
        layout = Layout("json", (("mode", "FAILFAST"), ("multiLine", ext == ".json")))
        return _read_json(spark, f.path, layout, options), layout
    frame = spark.read.parquet(no_glob(f.path))
    if options.all_text:
        frame = frame.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in frame.columns])
    return frame, Layout("parquet")


def _read_delimited(spark, path: str, shape: _Shape, kinds: dict[int, str], decimal: str) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in shape.names])
    out = []
    for i, n in enumerate(shape.names):
        c = F.nullif(F.col(f"`{n}`"), F.lit(""))  # a quoted "" is empty too
        if i in kinds:
            c = F.btrim(c)
            c = (_number(c, decimal) if kinds[i] == "double" else c).cast(kinds[i])
        elif shape.cp1252:
            c = F.translate(c, CP1252_FROM, CP1252_TO)
        out.append(c.alias(n))
    return shape.layout.scan(spark, [path], schema).select(*out)


def _read_json(spark, path: str, layout: Layout, options: FileOptions) -> DataFrame:
    """Nested values become JSON text; malformed input is an error, not a NULL row."""
    reader = spark.read.options(**dict(layout.options))
    if options.all_text:
        reader = reader.option("primitivesAsString", True)
    frame = reader.json(no_glob(path))
    if not frame.columns or frame.columns == ["_corrupt_record"]:
        raise ValueError("the file holds no JSON records")
    names = clean_header(frame.columns)
    return frame.select(
        *[
            (F.to_json(c) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else c)
            .alias(n)
            for f, n in zip(frame.schema.fields, names)
            for c in [F.col(f"`{f.name}`")]
        ]
    )

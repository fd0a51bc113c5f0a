import pytest

from plumbline.functions.text import decode
from plumbline.operators.reconcile import reconcile
from plumbline.sources.files import (
    FileOptions,
    changed_files,
    choose_delimiter,
    clean_header,
    list_files,
    read_file,
    read_folder,
)
from plumbline.sources.registry import Sources, parquet_folder
from plumbline.sources.tables import export_csv


@pytest.fixture
def folder(tmp_path):
    def put(name, data):
        raw = data if isinstance(data, bytes) else data.encode()
        (tmp_path / name).write_bytes(raw)

    put("agents.csv", "ID,NAME\nA001,x\nA002,y\nA003,\n")
    put("claims_semicolon.csv", "A;B\n1;x,y\n3;z\n")
    put("regions.tsv", "A\tB\n1\t2\n")
    put("payments.psv", "A|B\n1|2\n")
    put("windows_excel_export.csv", "ID,NAME\n1,José\n2,Zoë “q”\n".encode("cp1252"))
    put("with_bom.csv", b"\xef\xbb\xbfID,N\n1,2\n")
    put("quoted.csv", 'ID,T\n1,"a, b"\n2,"line\nbreak"\n')
    put("na_is_data.csv", 'ID,S\n1,NA\n2,KA\n3,\n4,""\n')
    put("messy headers.csv", " ID , Name ,name\n1,2,3\n")
    put("2026 feed.csv", "A,B\n1,2\n")
    put("nested.json", '[{"a": 1, "b": ["x", "y"], "c": {"d": 1}}, {"a": 2, "b": []}]')
    put("events.jsonl", '{"a": 1}\n{"a": 2}\n{"a": 3}\n')
    put("header_only.csv", "A,B\n")
    put("empty.csv", "")
    put("broken.json", '[{"a": 1,')
    put("latin.csv", b"A,B\n1,\x81\xe9\n")
    put("a[1].csv", "A,B\n1,2\n")
    put(".hidden.csv", "A\n1\n")
    put("~$lock.csv", "A\n1\n")
    put("notes.md", "not a table")
    (tmp_path / "sub").mkdir()
    put("sub/deep.csv", "A\n1\n")
    return tmp_path


def test_awkward_files(spark, folder):
    found = read_folder(spark, str(folder))
    got = {r.table: (r.file, r.row_count, r.columns) for r in found.describe().collect()}
    assert got == {
        "AGENTS": ("agents.csv", 3, "ID, NAME"),
        "A_1": ("a[1].csv", 1, "A, B"),
        "CLAIMS_SEMICOLON": ("claims_semicolon.csv", 2, "A, B"),
        "EVENTS": ("events.jsonl", 3, "a"),
        "HEADER_ONLY": ("header_only.csv", 0, "A, B"),
        "LATIN": ("latin.csv", 1, "A, B"),
        "MESSY_HEADERS": ("messy headers.csv", 1, "ID, Name, name_2"),
        "NA_IS_DATA": ("na_is_data.csv", 4, "ID, S"),
        "NESTED": ("nested.json", 2, "a, b, c"),
        "PAYMENTS": ("payments.psv", 1, "A, B"),
        "QUOTED": ("quoted.csv", 2, "ID, T"),
        "REGIONS": ("regions.tsv", 1, "A, B"),
        "T_2026_FEED": ("2026 feed.csv", 1, "A, B"),
        "WINDOWS_EXCEL_EXPORT": ("windows_excel_export.csv", 2, "ID, NAME"),
        "WITH_BOM": ("with_bom.csv", 1, "ID, N"),
    }
    errors = {r.file: r.error for r in found.load_errors().collect()}
    assert set(errors) == {"empty.csv", "broken.json"} and "empty" in errors["empty.csv"]
    rows = {t: sorted(map(tuple, found[t].collect())) for t in got}
    assert rows["WINDOWS_EXCEL_EXPORT"] == [(1, "José"), (2, "Zoë “q”")]
    assert rows["QUOTED"] == [(1, "a, b"), (2, "line\nbreak")]
    assert rows["NA_IS_DATA"] == [(1, "NA"), (2, "KA"), (3, None), (4, None)]
    assert rows["AGENTS"][2] == ("A003", None)
    assert rows["CLAIMS_SEMICOLON"] == [(1, "x,y"), (3, "z")]
    assert rows["NESTED"] == [(1, '["x","y"]', '{"d":1}'), (2, "[]", None)]
    assert rows["LATIN"] == [(1, "\x81é")]
    found.register()
    assert spark.sql("SELECT count(*) FROM AGENTS WHERE NAME IS NULL").first()[0] == 1


def test_options(spark, tmp_path):
    (tmp_path / "codes.csv").write_text("code,phone\n00123,+9171\n")
    text = read_file(spark, str(tmp_path / "codes.csv"), FileOptions(all_text=True))
    assert text.first() == ("00123", "+9171")
    assert read_file(spark, str(tmp_path / "codes.csv")).first() == (123, 9171)
    (tmp_path / "raw.csv").write_text("a,1\nb,2\n")
    raw = read_file(spark, str(tmp_path / "raw.csv"), FileOptions(header=False))
    assert raw.columns == ["COLUMN_1", "COLUMN_2"] and raw.count() == 2
    (tmp_path / "eu.csv").write_text("n;t\n1234,50;x\n")
    eu = read_file(spark, str(tmp_path / "eu.csv"), FileOptions(decimal=","))
    assert eu.first() == (1234.5, "x")
    (tmp_path / "flags.csv").write_text("f,d\nTrue,2024-01-01\nfalse,2024-01-02\n")
    flags = read_file(spark, str(tmp_path / "flags.csv"))
    assert [t for _, t in flags.dtypes] == ["boolean", "string"]
    (tmp_path / "empty.dat").write_text("")
    with pytest.raises(ValueError, match="empty"):
        read_file(spark, str(tmp_path / "empty.dat"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_folder(spark, str(tmp_path / "nowhere"))


def test_same_name_files_get_distinct_tables(spark, tmp_path):
    for name in ("a.csv", "A.tsv", "a.psv"):
        (tmp_path / name).write_text("x\n1\n")
    assert [t.table for t in read_folder(spark, str(tmp_path)).tables] == ["A", "A_2", "A_3"]


def test_header_rule():
    assert clean_header([" ID ", "", None, "id", "Id"]) == [
        "ID", "COLUMN_2", "COLUMN_3", "id_2", "Id_3"]


def test_delimiter_rule(spark, tmp_path):
    assert choose_delimiter({",": (0.9, 2), ";": (1.0, 2), "|": (1.0, 3)}) == "|"
    assert choose_delimiter({",": (1.0, 1)}) == "," == choose_delimiter({})
    texts = {
        "a.csv": ("a;b\n1,5;2\n", ["a", "b"]),
        "b.csv": ('a,b\n"x;y;z",2\n', ["a", "b"]),
        "c.csv": ("only\none\n", ["only"]),
        "d.csv": ("a|b|c\n1|2|3\n4|5", ["a", "b", "c"]),
        "e.txt": ('size;what\n5";a, b, c\n6";"d;e"\n', ["size", "what"]),
    }
    for name, (text, _) in texts.items():
        (tmp_path / name).write_text(text)
    found = {t.file: t.columns for t in read_folder(spark, str(tmp_path)).tables}
    assert found == {name: columns for name, (_, columns) in texts.items()}


def test_the_whole_file_decides_on_its_delimiter(spark, tmp_path):
    head = "id;note\n" + "".join(f"{i};a, b, c\n" for i in range(300))
    (tmp_path / "late.csv").write_text(head + "".join(f"{i};plain\n" for i in range(900)))
    (tmp_path / "type.csv").write_text("n\n" + "1\n" * 5000 + "x\n")
    found = read_folder(spark, str(tmp_path))
    assert found["LATE"].columns == ["id", "note"] and found["LATE"].count() == 1200
    assert found["TYPE"].dtypes == [("n", "string")]


def test_breaks_and_delimiters_inside_quotes(spark, tmp_path):
    body = "one, two, three\nfour, five, six, \"\"seven\"\"\n\n; ; ;"
    rows = "".join(f'{i};"{body}";5" pipe\n' for i in range(40))
    (tmp_path / "long.csv").write_text('id;"the\ntext";size\n' + rows)
    (tmp_path / "inch.csv").write_text('id,size\n1,5" pipe\n2,6\n')
    found = read_folder(spark, str(tmp_path))
    long = found["LONG"]
    assert long.columns == ["id", "the\ntext", "size"] and long.count() == 40
    assert {r[1:] for r in long.collect()} == {(body.replace('""', '"'), '5" pipe')}
    assert sorted(map(tuple, found["INCH"].collect())) == [(1, '5" pipe'), (2, "6")]
    assert dict(next(t for t in found.tables if t.table == "INCH").layout.options)["multiLine"] is False


def test_job_count_does_not_grow_with_the_files(spark, tmp_path):
    context, jobs = spark.sparkContext, {}
    for files in (120, 240):  # above 32 paths Spark lists a scan's files in a job of its own
        folder = tmp_path / str(files)
        folder.mkdir()
        for i in range(files):
            names = [f"c{i}_{k}" for k in range(1 + i % 7)]
            sep = ",;|"[i % 3]
            (folder / f"f{i}.csv").write_text(sep.join(names) + "\n" + sep.join(str(k) for k in range(len(names))) + "\n")
        context.setJobGroup(f"read {files}", "")
        found = read_folder(spark, str(folder))
        assert len(found.tables) == files and {r.row_count for r in found.describe().collect()} == {1}
        jobs[files] = len(context.statusTracker().getJobIdsForGroup(f"read {files}"))
        context.setJobGroup("", "")
    assert 0 < jobs[120] == jobs[240]


def test_an_unreadable_part_is_told_and_the_other_files_load(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"good{i}.csv").write_text(f"a,b\n{i},x\n")
    (tmp_path / "bad.csv").mkdir()
    (tmp_path / "bad.csv" / "part-0.csv.gz").write_bytes(b"no gzip at all")
    (tmp_path / "blank.csv").write_text("\n \n")
    found = read_folder(spark, str(tmp_path), part_folders=True)
    assert [t.table for t in found.tables] == [f"GOOD{i}" for i in range(5)]
    errors = dict(found.errors)
    assert set(errors) == {"bad.csv", "blank.csv"} and "empty" in errors["blank.csv"]


def test_folder_changes(spark, folder):
    before = [tuple(r) for r in list_files(spark, str(folder)).collect()]
    ddl = "path string, file string, size bigint, modified timestamp"
    (folder / "agents.csv").write_text("ID,NAME\nA001,changed\n")
    (folder / "new.csv").write_text("A\n1\n")
    (folder / "regions.tsv").unlink()
    after = list_files(spark, str(folder))
    got = {(r.path.rsplit("/", 1)[1], r.change)
           for r in changed_files(spark.createDataFrame(before, ddl), after).collect()}
    assert got == {("agents.csv", "modified"), ("new.csv", "added"), ("regions.tsv", "removed")}


def test_file_against_typed_table_and_named_sources(spark, tmp_path):
    typed = spark.sql("SELECT 'C1' AS id, DATE'2024-10-31' AS d, 12.50BD AS amt, "
                      "TIMESTAMP_NTZ'2026-08-02 22:04:00' AS ts")
    export_csv(typed, str(tmp_path / "claims.csv"))
    landed = read_folder(spark, str(tmp_path), part_folders=True)["CLAIMS"]
    assert reconcile(landed, typed, ["ID"]).metrics.first().status == "PASS"
    typed.write.parquet(str(tmp_path / "t.parquet"))
    sources = Sources("lake").add("LAKE", parquet_folder(spark, str(tmp_path)))
    assert sources.read(" lake ", "t").count() == 1
    with pytest.raises(LookupError, match="Unknown source"):
        sources.read("erp", "t")


def test_decode_defaults(spark):
    df = spark.createDataFrame([(" a ",), ("z",), (None,)], "c string")
    assert [r[0] for r in df.select(decode(df.c, {"A": "Active"})).collect()] == [
        "Active", "Unknown", "Unknown"]


def test_cells_that_begin_like_numbers_are_told_apart(spark, tmp_path):
    (tmp_path / "cells.csv").write_text(
        "sign;bare;day;flag;sum;late;low\n+1;.5;2020-01-02;True;1e3;7;!1\n-2;-.5;2020-01-03;false;+2.;7x;2\n", encoding="utf-8")
    assert dict(read_folder(spark, str(tmp_path))["CELLS"].dtypes) == {
        "sign": "bigint", "bare": "double", "day": "string", "flag": "boolean", "sum": "double", "late": "string", "low": "string"}
    (tmp_path / "cells.csv").unlink()
    (tmp_path / "comma.csv").write_text("a;b;c\n,5;1,5;1.5\n2;-,5;1.5\n", encoding="utf-8")
    found = read_folder(spark, str(tmp_path), FileOptions(decimal=","))["COMMA"]
    assert dict(found.dtypes)["a"] == dict(found.dtypes)["b"] == "double" and found.first().a == 0.5

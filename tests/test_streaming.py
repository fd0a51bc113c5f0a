import insurance as ins
import pytest

from plumbline.sources.tables import TableStore
from plumbline.streaming.landing import stage_new_files


def drop(folder, name, rows):
    columns = ",".join(c.split()[0] for c in ins.POLICY.split(", "))
    lines = [",".join("" if v is None else v for v in r) for r in rows]
    (folder / name).write_text("\n".join([columns, *lines]) + "\n")


def test_each_arrival_is_staged_once(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    store = TableStore(spark, str(tmp_path / "store"))

    def run(**kw):
        stage_new_files(store, "STG_POLICY", str(landing), str(tmp_path / "checkpoint"),
                        "LAND", **kw).awaitTermination()
        store.refresh()

    drop(landing, "a.csv", ins.policies(10))
    run(then_promote=True)
    assert store["STG_POLICY"].count() == 10 and store["POLICY_MASTER"].count() == 10
    run()
    assert store["STG_POLICY"].count() == 10                     # nothing new, nothing twice
    drop(landing, "b.csv", ins.policies()[5:15])
    run(then_promote=True)
    assert store["STG_POLICY"].count() == 20 and store["POLICY_MASTER"].count() == 15
    assert store["STG_POLICY"].select("BATCH_ID").distinct().count() == 2

    rejected = []
    drop(landing, "c.csv", ins.changed(ins.policies(2), ins.POLICY, "PREMIUM_AMOUNT", "x"))
    run(on_rejected=lambda batch, why: rejected.append((batch, why)))
    assert len(rejected) == 1 and "PREMIUM_AMOUNT is not a number" in rejected[0][1]
    drop(landing, "d.csv", ins.changed(ins.policies(2), ins.POLICY, "PREMIUM_AMOUNT", "x"))
    with pytest.raises(Exception, match="PREMIUM_AMOUNT is not a number"):
        run()
    assert store["STG_POLICY"].count() == 20


def test_columns_are_found_by_each_file_header(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    store = TableStore(spark, str(tmp_path / "store"))
    names = [c.split()[0] for c in ins.POLICY.split(", ")]

    def put(name, order, rows):
        lines = [",".join(order)]
        for r in rows:
            cells = dict(zip(names, r)) | {"EXTRA": "z"}
            lines.append(",".join("" if cells[c] is None else cells[c] for c in order))
        (landing / name).write_text("\n".join(lines) + "\n")

    def run(**kw):
        stage_new_files(store, "STG_POLICY", str(landing), str(tmp_path / "checkpoint"),
                        "LAND", **kw).awaitTermination()
        store.refresh()

    put("a.csv", names, ins.policies(3))
    put("b [2] é.csv", [*names[::-1], "EXTRA"], ins.policies()[3:6])
    run()
    staged = {r.POLICY_ID: r.CUSTOMER_ID for r in store["STG_POLICY"].collect()}
    assert staged == {r[0]: r[1] for r in ins.policies(6)}
    rejected = []
    put("c.csv", [n for n in names if n != "POLICY_ID"], ins.policies(2))
    run(on_rejected=lambda batch, why: rejected.append(why))
    assert len(rejected) == 1 and "POLICY_ID" in rejected[0] and store["STG_POLICY"].count() == 6

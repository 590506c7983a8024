"""The command line, end to end, and the synthetic users."""

from wideframe import cli
from wideframe.functions import synth
from wideframe.plans.layout import CellSchema, Family, KeyFormat, Layout, LocalityGroup


def test_commands(spark, tmp_path):
    home = f"file://{tmp_path}/home"
    info = Family("info", {"name": CellSchema(), "email": CellSchema(), "visits": CellSchema("counter", storage="FINAL")})
    (tmp_path / "layout.json").write_text(Layout("people", KeyFormat(components=(("user", "STRING"),)), {"main": LocalityGroup("main", {"info": info})}).to_json())
    call = lambda *argv: cli.run(spark, [home, *argv])
    call("install")
    call("create-table", str(tmp_path / "layout.json"))
    assert call("ls") == ["people"]
    call("put", "people", "--key", "ann", "--columns", "info:name", "--value", "Ann", "--timestamp", "5")
    call("put", "people", "--key", "ann", "--columns", "info:name", "--value", "Anna", "--timestamp", "6")
    call("put", "people", "--key", "bob", "--columns", "info:name", "--value", "Bob", "--timestamp", "5")
    call("increment", "people", "--key", "ann", "--columns", "info:visits", "--value", "3")
    assert [x.split()[1:] for x in call("get", "people", "--key", "ann", "--columns", "info:name", "--max-versions", "2")] == [["info:name", "6", "Anna"], ["info:name", "5", "Ann"]]
    assert len(call("scan", "people")) == 3 and len({x.split()[0] for x in call("scan", "people", "--max-rows", "1")}) == 1
    call("delete", "people", "--key", "ann", "--columns", "info:name", "--timestamp", "5")
    assert len(call("get", "people", "--key", "ann", "--columns", "info:name", "--max-versions", "9")) == 1
    assert call("notes", "people", "--column", "info:name", "--set", "owner", "me") == ["info:name owner: me"]
    call("synthesize-user-data", "people", "--num-users", "4")
    assert len(call("scan", "people", "--columns", "info:email")) == 4
    call("metadata", "backup", f"file://{tmp_path}/saved")
    assert call("schema-table")[0] == '0: "null"' and call("version") == ["data version 1"]
    call("delete-table", "people")
    assert call("ls") == []


def test_synthetic_users_repeat(spark):
    one = synth.users(spark, 30, ["A", "B"], ["x.org"], seed=4)
    assert sorted(one.collect()) == sorted(synth.users(spark, 30, ["A", "B"], ["x.org"], seed=4).collect())
    assert one.count() == 60 and one.where("qualifier = 'email' and value not like '%.%@x.org'").count() == 0


def test_layouts_are_set_and_further_commands_run(spark, tmp_path, monkeypatch):
    import json

    from wideframe.plans.layout import CellSchema, Family, Layout, LocalityGroup

    def written(name, layout):
        (tmp_path / name).write_text(layout.to_json())
        return str(tmp_path / name)

    def layout(columns, **more):
        return Layout("t", groups={"g": LocalityGroup("g", {"f": Family("f", {c: CellSchema() for c in columns})})}, **more)

    home = f"file://{tmp_path}/i"
    cli.run(spark, [home, "install"])
    cli.run(spark, [home, "create-table", written("a", layout("a"))])
    wanted = written("b", layout("ab", reference_id="1"))
    assert cli.run(spark, [home, "layout", "t", "--set", wanted, "--dry-run"]) == ["layout 2 (dry run)"]
    assert cli.run(spark, [home, "layout", "t", "--set", wanted]) == ["layout 2"]
    assert cli.run(spark, [home, "layout", "t", "--history"]) == ["1 after None", "2 after 1"]
    assert set(json.loads("\n".join(cli.run(spark, [home, "layout", "t"])))["groups"]["g"]["families"]["f"]["columns"]) == {"a", "b"}
    monkeypatch.setitem(cli.COMMANDS, "count", (lambda p: p.add_argument("table"), lambda spark, instance, args: [str(instance.cells(args.table).count())]))
    assert cli.run(spark, [home, "count", "t"]) == ["0"]

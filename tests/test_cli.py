"""Commands on small files."""

import json

from schemaloom import cli


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "a.json").write_text('{"id":1,"name":"x","tags":["t"],"sub":{"n":1.5}}\n{"id":2,"tags":[],"sub":{"n":2.5}}\n')
    (tmp_path / "b.sql").write_text("CREATE TABLE t (id TEXT NOT NULL, tags TEXT[], sub STRUCT<n FLOAT64 NOT NULL>, extra DATE)")
    a, b = str(tmp_path / "a.json"), str(tmp_path / "b.sql")
    assert cli.main(["compare", a, b, "--json"], spark) == 0
    found = {(r["path"], r["section"]) for r in json.loads(capsys.readouterr().out)}
    assert found == {("id", "type_mismatch"), ("name", "only_left"), ("extra", "only_right")}
    assert cli.main(["compare", a, b, "--fields", "id", "--json"], spark) == 0
    assert [r["path"] for r in json.loads(capsys.readouterr().out)] == ["id"]
    assert cli.main(["compare", a, b, "--migration"], spark) == 0
    assert "Breaking" in capsys.readouterr().out
    assert cli.main(["generate", a], spark) == 0
    made = json.loads(capsys.readouterr().out)
    assert made["required"] == ["id", "sub"] and made["properties"]["tags"] == {"type": "array", "items": {"type": "string"}}
    assert cli.main(["ddl", b, "--name", "x"], spark) == 0
    assert "CREATE OR REPLACE TABLE `x`" in capsys.readouterr().out
    assert cli.main(["analyze", b, "--format", "markdown"], spark) == 0
    assert "## Complexity" in capsys.readouterr().out
    assert cli.main(["analyze", str(tmp_path / "none.sql")], spark) == 1

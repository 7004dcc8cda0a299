"""Errors, retries, memory, logs, stores and warehouses."""

import gzip
import json
import logging
import os
import time

import pytest

from schemaloom import cli
from schemaloom.functions import errors, support
from schemaloom.operators import infer
from schemaloom.sources import parsers, records, stores
from schemaloom.streaming import drift


def test_errors_carry_details_and_causes():
    cause = KeyError("x")
    e = errors.wrapped(cause, "cannot read", errors.StoreError, path="a", line=None)
    assert str(e) == "cannot read (path=a)" and e.cause is cause and e.details == {"path": "a"}
    assert errors.wrapped(e) is e and isinstance(errors.wrapped(OSError("gone")), errors.EngineError)
    assert str(errors.wrapped(OSError("gone"))) == "gone"


def test_retries_wait_longer_each_time_and_give_up():
    waits, calls = [], []

    @support.retrying(3, 1.0, 2.0, OSError, sleep=waits.append)
    def flaky(fail):
        calls.append(1)
        if len(calls) <= fail:
            raise OSError("no")
        return len(calls)

    assert flaky(2) == 3 and waits == [1.0, 2.0]
    calls.clear()
    with pytest.raises(OSError):
        flaky(9)
    assert len(calls) == 3
    with pytest.raises(ValueError):
        support.retrying(3, on=OSError, sleep=waits.append)(lambda: int("x"))()
    assert support.is_transient(TimeoutError()) and support.is_transient(OSError("HTTP 503 from server")) and not support.is_transient(OSError("404"))


def test_memory_knows_changed_files_age_and_disk(tmp_path):
    file, seen = tmp_path / "a.json", []
    file.write_text("1")
    memory = support.Memory(str(tmp_path / "kept"))

    @memory.remember
    def read(path, k=0):
        seen.append(path)
        return file.read_text()

    assert read(str(file)) == read(str(file)) == "1" and len(seen) == 1
    file.write_text("22")
    assert read(str(file)) == "22" and read(str(file), k=1) == "22" and len(seen) == 3
    other = support.Memory(str(tmp_path / "kept"))
    assert other.get(other.key(f"{read.__module__}.{read.__qualname__}", (str(file),), {})) == (True, "22")
    old = support.Memory(seconds=0.0)
    old.put("k", 1)
    time.sleep(0.01)
    assert old.get("k") == (False, None)
    memory.clear()
    assert memory.get("k") == (False, None) and not list((tmp_path / "kept").iterdir())


def test_timing_settings_files_and_logs(tmp_path, caplog):
    top = support.set_up_logging("INFO", str(tmp_path / "log.txt"), color=True)
    top.propagate = True
    with caplog.at_level(logging.INFO, logger="schemaloom"):
        assert support.timed(lambda: 5)() == 5
    assert "took" in caplog.text and "took" in (tmp_path / "log.txt").read_text()
    support.set_up_logging()
    assert support.Settings().colors() == support.COLORS and set(support.Settings(color=False).colors()) == {""}
    read = support.needs_file(lambda path: open(path).read())
    with pytest.raises(errors.StoreError):
        read(tmp_path / "none")
    (tmp_path / "x").write_text("y")
    assert read(tmp_path / "x") == "y"


def test_stores_go_through_the_session(spark, tmp_path, monkeypatch):
    source = tmp_path / "in.json"
    source.write_text('{"a": 1}')
    target = str(tmp_path / "copies" / "out.json")
    assert stores.fetch(spark, f"file://{source}", target) == target and open(target).read() == '{"a": 1}'
    source.write_text('{"a": 2}')
    assert open(stores.fetch(spark, f"file://{source}", target)).read() == '{"a": 1}'
    assert open(stores.fetch(spark, f"file://{source}", target, force=True)).read() == '{"a": 2}'
    with pytest.raises(errors.StoreError):
        stores.fetch(spark, f"file://{tmp_path}/none", str(tmp_path / "copies" / "none"))
    assert os.listdir(tmp_path / "copies") == ["out.json"]
    assert stores.store_status(spark, "file:///x")[0] and not stores.store_status(spark, "nowhere://x")[0]
    assert stores.resolve(spark, str(source)) == str(source)
    for name in stores.PROJECT_VARIABLES:
        monkeypatch.delenv(name, raising=False)
    with pytest.raises(errors.WarehouseError):
        stores.default_project(spark)
    monkeypatch.setenv("GCP_PROJECT", "two")
    assert stores.default_project() == "two"
    monkeypatch.setenv("GOOGLE_CLOUD_PROJECT", "one")
    assert stores.default_project() == "one"
    with pytest.raises(errors.WarehouseError):
        stores.warehouse_reader(spark)
    with pytest.raises(errors.WarehouseError):
        stores.live_fields(spark, "p:d.nowhere")


def test_a_folder_of_unlike_files(spark, tmp_path):
    (tmp_path / "a b+c.json").write_text('﻿{"i": 1}\n{"i": 2}\nnot json\n')
    (tmp_path / "b.json").write_text('[{"i": 3}, {"i": null}, 5]')
    (tmp_path / "c.json").write_text('{\n "i": 4\n}')
    (tmp_path / "d.json").write_bytes(gzip.compress(b'\xef\xbb\xbf{"i": 6}\n{"i": 7}\n'))
    (tmp_path / "e.json.gz").write_bytes(gzip.compress(b'{"i": 8}\n{"i": 9}\n'))
    (tmp_path / "f.json").write_text("")
    (tmp_path / "g.json").write_text('broken\n{"i": 10}')
    found = records.read_records(spark, str(tmp_path)).selectExpr("cast(try_variant_get(rec, '$.i', 'int') as int) as i", "rec is null as bad", "raw").collect()
    assert sorted(r.i for r in found if r.i is not None) == [1, 2, 3, 4, 6, 7, 8, 9, 10]
    assert sorted(r.raw for r in found if r.bad) == ["broken", "not json"] and len(found) == 13
    kinds = {os.path.basename(r.file): r.kind for r in records.file_kinds(spark, str(tmp_path)).collect()}
    assert kinds == {"a%20b+c.json": "lines", "b.json": "whole", "c.json": "whole", "d.json": "packed", "e.json.gz": "lines", "g.json": "whole"}


def test_inference_goes_as_deep_as_the_documents(spark):
    deep = '{"a":' * 20 + "[[1]]" + "}" * 20
    rows = spark.createDataFrame([(deep,)], "j string").selectExpr("try_parse_json(j) as rec")
    for depth in (None, 3):
        got = {r.path: r.type_repr for r in infer.infer(rows, depth).collect()}
        assert got[".".join("a" * 20) + "[0][0]"] == "int" and len(got) == 22
    infer.release()
    flat = {(r.path, r.atom) for r in infer.paths(rows, 2).collect()}
    assert ("a.a", "object+") in flat


def test_a_stream_says_where_it_was_not_unfolded(spark):
    rows = spark.createDataFrame([("2024-01-01 00:00:00", '{"a": {"b": {"c": 1}}}')], "t string, j string").selectExpr("cast(t as timestamp) as ts", "j")
    got = {(r.path, r.atom) for r in drift.windowed_profile(rows, "ts", "j", depth=2).collect()}
    assert got == {("", "object"), ("a", "object"), ("a.b", "object+")}


def test_yaml_of_many_shapes():
    read = parsers.read_yaml
    assert read("a: 1\nb:\n- x\n- y: 2\n  z: [1, 'two', {k: v}]\n-\n  - deep\nc: {p: q, r: [s]}\n") == {"a": 1, "b": ["x", {"y": 2, "z": [1, "two", {"k": "v"}]}, ["deep"]], "c": {"p": "q", "r": ["s"]}}
    assert read("---\n# all\nt: \"a: b # c\"  # d\nu: 'it''s'\nv: ~\nw: true\nx: 1.5\ny: -3\nz: http://a/b\n") == {"t": "a: b # c", "u": "it's", "v": None, "w": True, "x": 1.5, "y": -3, "z": "http://a/b"}
    assert read("a: |\n  one\n   two\n\n  three\nb: >-\n  one\n  two\nc: plain\n  goes on\n") == {"a": "one\n two\n\nthree\n", "b": "one two", "c": "plain goes on"}
    assert read("- - 1\n  - 2\n- a: [1,\n    2]\n") == [[1, 2], {"a": [1, 2]}] and read("") is None and read("just text") == "just text"
    with pytest.raises(errors.SchemaError):
        read("a: 1\n   b: 2\n c")


def test_more_commands(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    a = tmp_path / "a.jsonl"
    a.write_text("\n".join(json.dumps({"id": i, "name": f"n{i}", "at": "2024-01-02"}) for i in range(5)))
    (tmp_path / "b.sql").write_text("CREATE TABLE t (id TEXT NOT NULL, name TEXT, at DATE); CREATE TABLE u (k BIGINT)")
    assert cli.main(["compare", str(a), str(tmp_path / "b.sql"), "--table", "t", "--infer-datetimes", "--show-common", "--show-samples", "--json-out", str(tmp_path / "o.json"), "--no-color"], spark) == 0
    text = capsys.readouterr().out
    assert "-- Type mismatches -- (1)" in text and "Samples (left):   [0, 1, 2, 3, 4]" in text and {r["path"] for r in json.loads((tmp_path / "o.json").read_text())} == {"id", "name", "at"}
    assert cli.main(["generate", str(a), "--record", "2", "--required-fields", "id", "--output", "s.json"], spark) == 0
    made = json.loads(capsys.readouterr().out)
    assert made["required"] == ["id"] and json.loads((tmp_path / "output" / "generate" / "s.json").read_text()) == made
    assert cli.main(["generate", str(a), "-k", "2", "--seed", "3", "--format", "sql_ddl"], spark) == 0
    assert '"id" INTEGER' in capsys.readouterr().out
    assert cli.main(["ddl", str(tmp_path / "b.sql"), "--all", "--pretty", "--no-color"], spark) == 0
    assert capsys.readouterr().out.count("CREATE OR REPLACE TABLE") == 2
    assert cli.main(["ddl", str(tmp_path / "b.sql"), str(tmp_path / "none.sql"), "--no-color"], spark) == 0
    assert "-- " + str(tmp_path / "none.sql") in capsys.readouterr().out
    assert cli.main(["config"], spark) == 0
    assert "dialects bigquery postgres" in capsys.readouterr().out
    spark.createDataFrame([(1, "x")], "k bigint, v string").write.mode("overwrite").parquet(str(tmp_path / "p"))
    assert cli.main(["generate", str(tmp_path / "p"), "--kind", "parquet", "--format", "spark"], spark) == 0
    assert "|-- k: long" in capsys.readouterr().out

"""Rendered documents and the command line."""

import json

import pytest

from codeloom import cli
from codeloom.operators import render, slicer

CODE = "interface A { x: number }\nfunction f(a: A) {\n  return a.x;\n}\nfunction g() {\n  return 1;\n}\n"


@pytest.fixture(scope="module")
def made(spark):
    files = spark.createDataFrame([("a.ts", CODE)], "file_path string, content string")
    return slicer.slices(files, spark.createDataFrame([("a.ts", "f")], "file_path string, symbol string"))


def test_forms(made):
    assert json.loads(render.slices(made, "json").first().document)["target_symbol"] == "f"
    assert render.slices(made, "plain").first().document == "interface A { x: number }\n\nfunction f(a: A) {\n  return a.x;\n}"
    assert "```" in render.slices(made, "markdown").first().document and "░" in render.slices(made, "pretty").first().document
    with pytest.raises(ValueError):
        render.slices(made, "x")


def test_documents(spark):
    v = spark.createDataFrame([("s", "m", "r", "t")], "source_file string, imported_module string, rule_name string, message string")
    got = json.loads(render.guard_document(v, "w", 2).first().document)
    assert (got["status"], got["violations_count"]) == ("violations", 1)
    assert json.loads(render.guard_document(v.limit(0), "w", 2).first().document)["violations"] == []
    log = spark.createDataFrame([(k, k) for k in range(150)], "ts int, id int")
    assert {r.id for r in render.capped_log(log).collect()} == set(range(50, 150))
    clients = spark.createDataFrame([("c1", "Cursor", "Editor"), ("c2", "Shell", "Terminal")], "id string, name string, category string")
    assert [r.id for r in render.grid(clients, " TERM ").collect()] == ["c2"]
    files = spark.createDataFrame([("a",), ("a",), ("b",)], "file_path string")
    assert render.import_counters(files, log).first() == (2, 150)


def test_command_line(spark, sf, tmp_path, capsys):
    (tmp_path / "src" / "ui").mkdir(parents=True)
    (tmp_path / "src" / "ui" / "a.ts").write_text("import d from 'src/db/x'\n" + CODE)
    root = str(tmp_path)
    assert cli.main(["guard", "--root", root], spark) == 1
    assert "src/ui/a.ts" in capsys.readouterr().out
    assert cli.main(["guard", "--root", root, "--warn-only"], spark) == 0
    assert cli.main(["context", "src/ui/a.ts:f", "--root", root, "--format", "plain"], spark) == 0
    assert "return a.x" in capsys.readouterr().out
    assert cli.main(["search", "ff", "--root", root], spark) == 0
    assert cli.main(["query", "sync_counts", sf], spark) == 0
    assert "unsynced" in capsys.readouterr().out
    with pytest.raises(ValueError):
        cli.targets("a.ts")

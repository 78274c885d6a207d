"""Folders and archives as a data source."""

import zipfile

import pytest
from pyspark.sql import functions as F

from codeloom.operators import symbols
from codeloom.sources import archives


@pytest.fixture
def root(tmp_path):
    base = tmp_path / "repos"
    for k in range(60):
        path = base / f"app/part{k % 6}/m{k}.ts"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"export function f{k}() {{\n}}\n" + "// é\n" * 500)
    for name in ("node_modules/x/a.ts", "app/.git/b.py", "target/c.rs", "app/read.me", "app/ts", "app/d.mjs"):
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_text("no")
    (base / "app/bad.py").write_bytes(b"def g():\n    return '\xff'\n")
    with zipfile.ZipFile(base / "shop.ZIP", "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(40):
            z.writestr(f"shop-main/src/s{k}.go", f"func s{k}() {{}}\n" * 100)
        z.writestr("shop-main/node_modules/y.js", "no")
        z.writestr("shop-main/empty.rs", "")
        z.writestr("shop-main/notes.txt", "no")
    return base


def test_code_of_folders_and_archives(spark, root):
    got = archives.codebases(spark, str(root), partition_bytes=30_000)
    rows = {(r.archive, r.file_path): r for r in got.collect()}
    want = {("", f"app/part{k % 6}/m{k}.ts") for k in range(60)} | {("", "app/bad.py")} | {("shop", f"shop-main/src/s{k}.go") for k in range(40)} | {("shop", "shop-main/empty.rs")}
    assert set(rows) == want
    assert rows["", "app/part3/m3.ts"].content == (root / "app/part3/m3.ts").read_text() and "�" in rows["", "app/bad.py"].content
    assert rows["shop", "shop-main/empty.rs"].content == "" and rows["shop", "shop-main/src/s7.go"].content == "func s7() {}\n" * 100
    # Many tasks, none with much more than its share.
    tasks = got.groupBy(F.spark_partition_id()).agg(F.sum("size").alias("n"), F.collect_set("archive").alias("a")).collect()
    assert len(tasks) >= 6 and max(r.n for r in tasks) <= 30_000 and sum("shop" in r.a for r in tasks) >= 2
    found = symbols.line_symbols(got.select("file_path", "content"))
    assert {r.name for r in found.collect()} >= {"f59", "s39"}


def test_one_archive_and_none(spark, root, tmp_path):
    assert archives.codebases(spark, str(root / "shop.ZIP")).count() == 41
    (tmp_path / "none").mkdir()
    assert archives.codebases(spark, str(tmp_path / "none")).count() == 0


def test_files_ruled_out_are_never_opened(spark, root):
    # A member that can't be read: its name is listed, its bytes are broken.
    with zipfile.ZipFile(root / "broken.zip", "w") as z:
        z.writestr("lib/x.py", "def x(): pass\n" * 50)
        z.writestr("ok/y.py", "def y(): pass\n")
    data = (root / "broken.zip").read_bytes()
    (root / "broken.zip").write_bytes(data.replace(b"def x(): pass\n", b"def x(): p@ss\n", 1))
    everything = archives.codebases(spark, str(root))
    with pytest.raises(Exception, match="CRC"):
        everything.count() and everything.collect()
    assert {r.file_path for r in everything.filter("file_path like 'ok/%'").collect()} == {"ok/y.py"}
    assert everything.filter("archive = 'shop'").count() == 41
    assert everything.filter(F.col("file_path").isin("ok/y.py", "app/bad.py")).count() == 2
    assert {r.file_path for r in everything.filter("archive = '' and file_path like '%.py' and size > 3").collect()} == {"app/bad.py"}


def test_pushed_filters_leave_the_rest(root):
    from pyspark.sql import datasource as ds

    reader = archives.Reader(str(root), 1 << 30)
    left = list(reader.pushFilters([ds.StringStartsWith(("file_path",), "app/part1"), ds.GreaterThan(("size",), 3), ds.EqualTo(("archive",), "")]))
    assert left == [ds.GreaterThan(("size",), 3)]
    assert {f[1] for p in reader.partitions() for f in p.files} == {f"app/part1/m{k}.ts" for k in range(60) if k % 6 == 1}

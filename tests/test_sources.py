"""Sources and sinks on small folders."""

import json

from scriptorium.sources import folders, json_files
from scriptorium.streaming import tables


def test_objects(spark, tmp_path):
    for name, text in (("a", '{"x": 1}'), ("b", "[1]"), ("c", "broken")):
        (tmp_path / f"{name}.json").write_text(text)
    got = {r.file[-6]: r.document and r.document.x for r in json_files.read_objects(spark, f"file://{tmp_path}", "x int").collect()}
    assert got == {"a": 1, "b": None, "c": None}


def test_lines(spark, tmp_path):
    rows = spark.createDataFrame([('{"entry_id": "a"}',), ('{"entry_id": " a "}',), ('{"entry_id": ""}',), ("{",), (" ",), (None,)], "line string")
    got = json_files.lines_summary(rows, "line", ["entry_id"]).first()
    assert (got.lines, got.broken, got.entry_ids) == (4, 1, 1)
    json_files.write_lines(spark.createDataFrame([(1, None)], "a int, b string"), f"file://{tmp_path}/out")
    lines = [x for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()]
    assert [json.loads(x) for x in lines] == [{"a": 1, "b": None}]
    json_files.write_texts(spark.createDataFrame([("x \n\n",)], "t string"), "t", f"file://{tmp_path}/texts")
    assert "".join(p.read_text() for p in (tmp_path / "texts").glob("part-*")) == "x\n"


def test_folders(spark, tmp_path):
    for name in ("u/a/manifest.json", "u/a/exports/notebooklm.md", "u/b/manifest.json", "v/c d/manifest.json", "v/c d/run_state.json", "v/e/f/manifest.json", "v/e/f/run_state.json", "top.txt"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(" abc \n")
    listed = folders.files(spark, f"file://{tmp_path}")
    assert {tuple(r) for r in folders.packages(listed).collect()} == {("u", "a"), ("v", "c d")}
    assert {r.folder: (r.bytes, r.files) for r in folders.sizes(listed).collect()} == {"u": (18, 3), "v": (24, 4)}
    assert [r.chars for r in folders.text_lengths(spark, f"file://{tmp_path}/top.txt").collect()] == [3]


def test_stream_resumes(spark, tmp_path):
    root, out = f"file://{tmp_path}", f"file://{tmp_path}/out"
    for ids in ([1, 2, 2], [2, 3]):
        spark.createDataFrame([(i,) for i in ids], "id int").coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = tables.arrived(spark, f"{root}/in", "id int")
        tables.run(tables.first_seen(stream, "id"), f"{root}/state", tables.to_versions(out))
    assert sorted((r.batch, r.id) for r in spark.read.option("basePath", out).parquet(out).collect()) == [(0, 1), (0, 2), (1, 3)]

"""Lines by number through an index of offsets."""

import pytest

from tracelens.sources import lines


@pytest.fixture(scope="module", params=[(3, 7), (1000, 64 << 20)], ids=["small", "large"])
def indexed(request, spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    (root / "a").mkdir()
    texts = {"a/one.jsonl": "x\n\nlonger line é\r\n\n\nlast without end", "a/two.jsonl": "\n", "three.txt": "a\nb\nc\n" * 50, "none.txt": "", "four.txt": "é" * 40}
    for name, text in texts.items():
        (root / name).write_bytes(text.encode())
    mark, span = request.param
    index = str(tmp_path_factory.mktemp("index") / "i")
    lines.write_index(spark, str(root), index, mark=mark, span=span)
    want = {name: [x.removesuffix("\r") for x in (text.split("\n")[:-1] if text.endswith("\n") else text.split("\n") if text else [])] for name, text in texts.items()}
    return root, index, want, mark


def test_all_lines_have_their_numbers(spark, indexed):
    root, index, want, _ = indexed
    got = {(r["file"].split(f"{root}/")[1], r["line_num"]): r["line"] for r in lines.read_lines(spark, index).collect()}
    assert got == {(name, i + 1): x for name, some in want.items() for i, x in enumerate(some)}


def test_wanted_lines_are_found_and_others_are_not(spark, indexed):
    root, index, want, mark = indexed
    files = {r["file"].split(f"{root}/")[1]: r["file"] for r in spark.read.parquet(index).select("file").distinct().collect()}
    asked = [(files.get(name, "nowhere"), n) for name in want for n in (1, 2, 4, 6, 75, 150, 151, 0)]
    rows = spark.createDataFrame(asked + asked[:3], "file string, line_num long")
    got = {(r["file"], r["line_num"]): r["line"] for r in lines.lookup(spark, index, rows, mark=mark).collect()}
    assert got == {(f, n): some[n - 1] for name, some in want.items() for f, n in asked if f == files.get(name) and 0 < n <= len(some)}


def test_one_line_below_a_root(spark, indexed):
    root, index, want, mark = indexed
    if mark != lines.MARK:
        pytest.skip("line_at reads indexes of the usual marks")
    assert lines.line_at(spark, index, str(root), "a/one.jsonl", 3) == "longer line é"
    with pytest.raises(LookupError):
        lines.line_at(spark, index, str(root), "a/one.jsonl", 7)
    with pytest.raises(LookupError):
        lines.line_at(spark, index, str(root), "b/none", 1)
    for path in ("../x", "/etc/passwd", "a/../../x", "."):
        with pytest.raises(PermissionError):
            lines.line_at(spark, index, str(root), path, 1)

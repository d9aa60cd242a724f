"""The data source over folders of real files."""

import os

import pytest
from pyspark.sql import functions as F

from quire.sources import document, library, shelf

FILES = {"a.txt": b"one" * 10, "b.TXT": b"", "c.pdf": b"%PDF-1.4 " + b"x" * 20_000, "d.epub": b"PK", "e.zip": b"z", ".txt": b"hidden", "sub/f.txt": b"caf\xe9", "_tmp.txt": b"t", "noext": b""}


@pytest.fixture
def folder(tmp_path):
    for name, content in FILES.items():
        path = tmp_path / "shelf" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return f"file://{tmp_path}/shelf"


def test_rows_are_files(spark, folder):
    got = {r["name"]: r for r in shelf.read(spark, folder).collect()}
    seen = {n: c for n, c in FILES.items() if n not in (".txt", "_tmp.txt")}
    assert {n: bytes(r["content"]) for n, r in got.items()} == seen
    assert all(r["size"] == len(seen[n]) and bytes(r["head"]) == seen[n][:8192] and bytes(r["tail"]) == seen[n][-2048:] for n, r in got.items())
    assert {n: r["fmt"] for n, r in got.items()} == {"a.txt": "txt", "b.TXT": "txt", "c.pdf": "pdf", "d.epub": "epub", "e.zip": None, "sub/f.txt": "txt", "noext": None}
    names = spark.createDataFrame([(n,) for n in [*got, ".pdf", "x\n.pdf"]], "name string")
    assert all(r[1] == shelf.format_of(r[0]) for r in names.select("name", library.format_of(F.col("name"))).collect())


@pytest.mark.parametrize(
    ("options", "want"),
    [
        ({"formats": "txt"}, ["a.txt", "b.TXT", "sub/f.txt"]), ({"formats": "pdf,epub"}, ["c.pdf", "d.epub"]), ({"formats": "other"}, ["e.zip", "noext"]), ({"prefix": "sub/"}, ["sub/f.txt"]),
        ({"formats": "txt", "least_bytes": 1}, ["a.txt", "sub/f.txt"]), ({"most_bytes": 2}, ["b.TXT", "d.epub", "e.zip", "noext"]), ({"formats": "mobi"}, []), ({"least_bytes": None}, list("abcden") + ["s"]),
    ],
)
def test_options_choose_files(spark, folder, options, want):
    got = sorted(r["name"] for r in shelf.read(spark, folder, "name", "content", **options).collect())
    assert got == want or [n[0] for n in got] == want


def test_files_not_chosen_are_not_opened(spark, folder):
    """A partition lists what its task opens."""
    reader = shelf.Reader(folder, ["name", "content"], {"formats": "txt", "least_bytes": "1"})
    assert [f.name for p in reader.partitions() for f in p.files] == ["a.txt", "sub/f.txt"]
    os.mkfifo(f"{folder.removeprefix('file://')}/z.txt")  # would block whoever opens it: neither file nor folder, it isn't listed
    assert shelf.read(spark, folder, "content").count() == 7


def test_scans_of_one_folder_with_different_filters(spark, folder):
    rows = shelf.read(spark, folder, "name", "fmt", "content")
    both = rows.where("fmt = 'txt'").select("name").union(rows.where("fmt = 'pdf'").select("name")).union(rows.where("fmt IS NULL").select("name"))
    assert sorted(r[0] for r in both.collect()) == ["a.txt", "b.TXT", "c.pdf", "e.zip", "noext", "sub/f.txt"]


def test_no_file_is_opened_for_its_name(spark, folder, monkeypatch):
    opened = []

    class Where:
        def open_input_file(self, path):
            opened.append(path)
            return open(path, "rb")

    monkeypatch.setattr(shelf, "file_system", lambda f, real=shelf.file_system: (Where(), real(f)[1]) if monkeypatch else None)
    files = [shelf.File("c.pdf", 20_009)]
    for columns, count in ((["name", "size", "fmt"], 0), (["head"], 1), (["tail", "head"], 1), (["content"], 1)):
        opened.clear()
        batches = list(shelf.Reader(folder, columns, {}).read(shelf.Files(files)))
        assert len(opened) == count and batches[0].schema.names == columns
    head = next(shelf.Reader(folder, ["head", "tail"], {}).read(shelf.Files(files))).to_pylist()[0]
    assert head == {"head": FILES["c.pdf"][:8192], "tail": FILES["c.pdf"][-2048:]}


def test_partitions_are_cut_by_bytes(folder):
    sizes = lambda columns, most: [len(p.files) for p in shelf.Reader(folder, columns, {"partition_bytes": str(most)}).partitions()]
    assert sizes(["name"], 1) == [7] and sizes(["content"], 1) == [1] * 7 and sizes(["content"], shelf.PARTITION) == [7]
    assert sizes(["content"], 2 * shelf.OPENING + 1000) == [2, 1, 1, 2, 1] or sum(sizes(["content"], 2 * shelf.OPENING + 1000)) == 7


def test_books_open_from_a_folder_as_from_a_table(spark, folder):
    got = {tuple(r) for r in document.opened(document.folder(spark, folder)).collect()}
    table = spark.createDataFrame([(n, n, bytearray(c)) for n, c in FILES.items() if n not in (".txt", "_tmp.txt")], "book string, name string, content binary")
    assert got == {tuple(r) for r in document.opened(table).collect()} and len(got) == 7


def test_written_and_read_back(spark, tmp_path):
    to = f"file://{tmp_path}/out"
    books = spark.range(40).selectExpr("concat('d', id % 3, '/book ', id, '.txt') AS name", "cast(repeat('x', cast(id as int)) as binary) AS content").repartition(5)
    shelf.write(books, to)
    assert {r["name"]: r["size"] for r in shelf.read(spark, to, "name", "size").collect()} == {f"d{i % 3}/book {i}.txt": i for i in range(40)}
    shelf.write(spark.createDataFrame([("one.txt", None), ("d0/book 0.txt", bytearray(b"new"))], "name string, content binary"), to, "overwrite")
    assert {r["name"]: r["size"] for r in shelf.read(spark, to, "name", "size").collect()} == {"one.txt": 0, "d0/book 0.txt": 3}
    for bad in (["x.txt", "x.txt"], ["fine.txt", "../out.txt"], ["fine.txt", "/x.txt"], ["fine.txt", "_x"], ["fine.txt", None], ["fine.txt", ""], ["d0/x.txt"] * 3 + ["d0/y.txt"] * 9):
        with pytest.raises(Exception):
            shelf.write(spark.createDataFrame([(n, bytearray(b"bad")) for n in bad], "name string, content binary"), to, "overwrite")
        assert {r["name"]: r["size"] for r in shelf.read(spark, to, "name", "size").collect()} == {"one.txt": 0, "d0/book 0.txt": 3}
    with pytest.raises(Exception):
        shelf.read(spark, to).select("title")

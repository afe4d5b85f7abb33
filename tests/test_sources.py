"""Tag files in every codec, manifests, folders by root, and document files."""

import gzip
import lzma

import pytest

from termindex import config as cfg
from termindex.sources import tagfiles
from termindex.sources.corpus import read_corpus, write_corpus

LINES = [f"name{i}\tfile{i % 3}\t/^x$/;\"\tf\tlanguage:C" for i in range(50_000)]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tags")
    body = "\n".join(LINES[:100] + [""] + LINES[100:]).encode()
    (folder / "a.tags").write_bytes(body)
    with gzip.open(folder / "a.tags.gz", "wb") as out:
        out.write(body)
    half = len(body) // 2
    (folder / "a.tags.xz").write_bytes(lzma.compress(body[:half]) + lzma.compress(body[half:]))
    (folder / "empty.tags.xz").write_bytes(lzma.compress(b""))
    return folder


def values(df):
    return sorted(r["value"] for r in df.collect())


def test_codecs(spark, files):
    assert values(tagfiles.read_tags(spark, str(files / "a.tags"))) == sorted(LINES)
    assert values(tagfiles.read_tags(spark, [str(files / "a.tags.gz")], 4)) == sorted(LINES)
    assert values(tagfiles.read_tags_xz(spark, str(files / "a.tags.xz"))) == sorted(LINES)
    assert values(tagfiles.read_tags_xz(spark, str(files / "empty.tags.xz"))) == []


def test_cut_off_xz_is_an_error(spark, files, tmp_path):
    (tmp_path / "cut.xz").write_bytes((files / "a.tags.xz").read_bytes()[:-200])
    with pytest.raises(Exception, match="cut off"):
        tagfiles.read_tags_xz(spark, str(tmp_path / "cut.xz")).count()


def test_manifest(spark, files, capsys):
    listed = [(str(files / "a.tags"), "none"), (str(files / "a.tags.gz"), "gzip"), (str(files / "a.tags.xz"), "lzma"),
              (str(files / "missing.gz"), "gzip"), (str(files / "a.tags"), "zip")]
    got = tagfiles.read_tag_manifest(spark, cfg.table(spark, "path string, codec string", listed))
    assert values(got) == sorted(LINES * 3)
    assert "zip" in capsys.readouterr().out
    nothing = cfg.table(spark, "path string, codec string", [(str(files / "missing"), "none")])
    assert tagfiles.read_tag_manifest(spark, nothing).count() == 0


@pytest.mark.parametrize("codec", tagfiles.CODECS)
def test_folders_by_root(spark, tmp_path, codec):
    df = cfg.table(spark, "value string, root_key string, filetype string", [
        (f"v{i}", "__a" if i % 3 else "__b", "c" if i % 2 else "go") for i in range(1000)])
    folder = str(tmp_path / "out")
    tagfiles.write_tags(df, folder, codec)
    parts = sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(("_", ".")))
    assert parts == ["root_key=__a", "root_key=__b"]
    target = f"{folder}/root_key=__b/filetype=c"
    read = tagfiles.read_tags_xz if codec == "lzma" else tagfiles.read_tags
    assert values(read(spark, target)) == sorted(f"v{i}" for i in range(1000) if i % 3 == 0 and i % 2)


def test_documents(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "a.C").write_text("int x;\n\nint y;")
    (tmp_path / "d" / "e" / "b.py").write_text("z")
    got = {r["path"].rsplit("/", 1)[1]: r for r in read_corpus(spark, str(tmp_path / "d")).collect()}
    assert got["a.C"]["text"] == "int x;\n\nint y;" and got["a.C"]["ext"] == "c"
    assert got["b.py"]["text"] == "z" and len({r["doc_id"] for r in got.values()}) == 2


def test_corpus_is_written_without_a_folder_for_each_document(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(2500)] + [(7, "again"), (9001, None), (9002, ""), (None, "x")],
                                 "doc_id bigint, text string").coalesce(1)
    write_corpus(docs, str(tmp_path / "c"), "doc_id", "text")
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in read_corpus(spark, str(tmp_path / "c")).collect()}
    expected = {f"doc_id={k}.txt": f"text {k}\n" for k in range(2500)}
    expected |= {"doc_id=9001.txt": "\n", "doc_id=9002.txt": "\n", "doc_id=__HIVE_DEFAULT_PARTITION__.txt": "x\n"}
    assert sorted(got.pop("doc_id=7.txt").split("\n")) == ["", "again", "text 7"]
    assert got == {k: v for k, v in expected.items() if k != "doc_id=7.txt"}
    assert len(list((tmp_path / "c").iterdir())) == 3
    write_corpus(docs.limit(0), str(tmp_path / "none"), "doc_id", "text")
    assert read_corpus(spark, str(tmp_path / "none")).count() == 0


def test_carriage_returns_stay(spark, tmp_path):
    lines = ["a\tf.c\t/^int a()\r$/;\"\tf", "b\tf.c\t/^b$/;\"\tv"]
    data = ("\n".join(lines) + "\n").encode()
    for name, packed in (("a.tags", data), ("b.tags.gz", gzip.compress(data))):
        (tmp_path / name).write_bytes(packed)
        assert values(tagfiles.read_tags(spark, str(tmp_path / name))) == sorted(lines)
    (tmp_path / "c.xz").write_bytes(lzma.compress(data))
    assert values(tagfiles.read_tags_xz(spark, str(tmp_path / "c.xz"))) == sorted(lines)
    with pytest.raises(ValueError):
        tagfiles.read_tags(spark, str(tmp_path / "c.xz"))


def test_manifest_decodes_by_codec(spark, tmp_path):
    data = b"x\ty\tz\n"
    (tmp_path / "plain_name").write_bytes(gzip.compress(data))
    (tmp_path / "odd.gz").write_bytes(data)
    (tmp_path / "packed").write_bytes(lzma.compress(data))
    listed = [("plain_name", "gzip"), ("odd.gz", "none"), ("packed", "lzma"), ("absent", "none"), ("odd.gz", "brotli")]
    manifest = spark.createDataFrame([(str(tmp_path / p), c) for p, c in listed], "path string, codec string")
    assert values(tagfiles.read_tag_manifest(spark, manifest)) == ["x\ty\tz"] * 3


@pytest.mark.parametrize("codec", ["none", "lzma"])
def test_writing_again_replaces(spark, tmp_path, codec):
    df = spark.createDataFrame([("r1", "c", "one"), ("r2", "c", "two")], "root_key string, filetype string, value string")
    folder = f"file:{tmp_path}/again"
    tagfiles.write_tags(df, folder, codec)
    tagfiles.write_tags(df.filter("root_key = 'r1'"), folder, codec)
    read = tagfiles.read_tags_xz if codec == "lzma" else tagfiles.read_tags
    got = read(spark, [f"{tmp_path}/again/root_key=r1/filetype=c", f"{tmp_path}/again/root_key=r2/filetype=c"])
    assert values(got) == ["one", "two"]


def test_corpus_paths_are_decoded(spark, tmp_path):
    (tmp_path / "d e+f").mkdir()
    (tmp_path / "d e+f" / "a b%c.C").write_text("x")
    row = read_corpus(spark, str(tmp_path / "d e+f")).first()
    assert row["path"] == f"{tmp_path}/d e+f/a b%c.C" and row["ext"] == "c"


def test_corpus_of_many_small_files_is_read_in_few_tasks(spark, tmp_path):
    """Files in folders, in a flat one and in nested ones; hidden, empty and repeated ones as Spark's reader has them."""
    want = {}
    for k in range(600):
        path = tmp_path / "c" / ("" if k < 100 else f"f{k % 5}" if k < 500 else f"n/k=1/m{k % 7}") / f"d{k}.{'TXT' if k % 2 else 'c'}"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"" if k % 50 == 0 else f"text {k}\r\n\n".encode())
        want |= {} if k % 50 == 0 else {str(path): (f"text {k}\r\n\n", "txt" if k % 2 else "c")}
    for name in ("_SUCCESS", ".a.crc", "_h/x.txt", "b._COPYING_"):
        (tmp_path / "c" / name).parent.mkdir(exist_ok=True)
        (tmp_path / "c" / name).write_text("hidden")
    for paths in (str(tmp_path / "c"), f"file:{tmp_path}/c", [str(tmp_path / "c"), str(tmp_path / "c" / "f1"), str(tmp_path / "c" / "d1.TXT")]):
        found = read_corpus(spark, paths)
        assert found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        assert sorted((r["path"], r["text"], r["ext"]) for r in found.collect()) == sorted((p, *v) for p, v in want.items())
        assert found.filter("doc_id <> xxhash64(path)").count() == 0


def test_round_trip_keeps_empty_fields(spark):
    df = spark.createDataFrame([("n", "f.c", None, "f", "C")], "name string, file string, pattern string, kind string, lang string")
    assert tagfiles.tag_lines(df).first()["value"] == "n\tf.c\t\tf\tlanguage:C"


def test_manifest_of_many_files(spark, tmp_path):
    """10,000 listed files, a third of which exist; the driver sees no row of the list."""
    listed = []
    for k in range(10_000):
        path = tmp_path / f"d{k % 50}" / f"f{k}.tags"
        if k % 3 == 0:
            path.parent.mkdir(exist_ok=True)
            data = f"n{k}\tf\tp\n".encode()
            path.write_bytes(gzip.compress(data) if k % 2 else data)
        listed.append((f"file:{path}" if k % 5 else str(path), "gzip" if k % 2 else "none"))
    manifest = spark.createDataFrame(listed, "path string, codec string").repartition(8)
    got = tagfiles.read_tag_manifest(spark, manifest)
    assert sorted(values(got)) == sorted(f"n{k}\tf\tp" for k in range(0, 10_000, 3))


@pytest.mark.parametrize("part_bytes", [200, 5000])
def test_plain_files_are_read_in_ranges(spark, tmp_path, part_bytes):
    """Every line once, wherever the ranges end; empty lines, a long line, no newline at the end, an empty file."""
    lines = [f"line {k} " + "é" * (k % 11) for k in range(40)] + ["", "x" * 300, "\r", "last"]
    (tmp_path / "a").write_text("\n".join(lines), newline="")
    (tmp_path / "b").write_text("\n".join(lines) + "\n\n", newline="")
    (tmp_path / "empty").write_text("")
    (tmp_path / "folder").mkdir()
    (tmp_path / "folder" / "c").write_text("below\n")
    (tmp_path / "folder" / "_hidden").write_text("hidden\n")
    manifest = spark.createDataFrame([(str(tmp_path / n), "none") for n in ("a", "b", "empty", "folder", "a")] + [(None, "none")],
                                     "path string, codec string")
    from termindex.sources.manifest import read_manifest
    assert values(read_manifest(spark, manifest, part_bytes)) == sorted([x for x in lines if x] * 3 + ["below"])


def test_manifest_with_a_cut_off_file_is_an_error(spark, tmp_path):
    (tmp_path / "cut.gz").write_bytes(gzip.compress(b"some lines\n" * 1000)[:-20])
    manifest = spark.createDataFrame([(str(tmp_path / "cut.gz"), "gzip")], "path string, codec string")
    with pytest.raises(Exception, match="end-of-stream"):
        tagfiles.read_tag_manifest(spark, manifest).count()


def test_ranges_of_any_size_give_each_line_once(tmp_path, monkeypatch):
    from termindex.sources import manifest

    for number, data in enumerate((b"a\nbb\n\nccc", b"\n\n", b"one line", b"one line\n", b"x" * 50 + b"\ny\n" * 20)):
        (tmp_path / f"f{number}").write_bytes(data)
        for step in range(1, len(data) + 2):
            for block in (1, 3, 1 << 20):
                monkeypatch.setattr(manifest, "STEP_BYTES", block)
                got = [v for begin in range(0, len(data), step) for batch in manifest._lines(
                    manifest._range(f"{tmp_path}/f{number}", begin, min(len(data), begin + step))) for v in batch.column(0).to_pylist()]
                assert got == [line for line in data.decode().split("\n") if line]

"""Registry: owners, roots, replay; units and files to index."""

import random

from termindex import config as cfg
from termindex.operators import extract, projects
from termindex.sources.registry import parse_registry, read_registry


def table(spark, rows, ddl):
    return cfg.table(spark, ddl, rows)


def test_first_registered_owner(spark, rows):
    registry = table(spark, [("/a", 1), ("/a/b", 2), ("/c/d", 3)], "path string, reg_seq bigint")
    paths = table(spark, [("/a/b/x",), ("/ab/x",), ("/c/d",), ("/z",), ("/a/b/x",)], "path string")
    assert rows(projects.resolve_project(paths, registry)) == [
        ("/a/b/x", "/a"), ("/ab/x", None), ("/c/d", "/c/d"), ("/z", None)]
    root = table(spark, [("/", 0)], "path string, reg_seq bigint")
    assert rows(projects.resolve_project(paths, registry.union(root)))[0] == ("/a/b/x", "/")


def fold(spark, log):
    df = table(spark, [(i, *entry) for i, entry in enumerate(log)], "seq bigint, op string, path string, arg string")
    return sorted(((r["path"], r["run"], r["dir"]) for r in projects.fold_registry(df).collect()), key=str)


def test_replay_cases(spark):
    add, remove = "add_project", "remove_project"
    assert fold(spark, [(add, "/a", "1"), (add, "/a", "0")]) == [("/a", 1, None)]
    assert fold(spark, [(add, "/a", "1"), ("add_dir", "/a/src", "/x"), ("add_dir", "/a/src", "/x")]) == [("/a", 1, "/x")]
    assert fold(spark, [(add, "/a", "1"), ("add_dir", "/a", "/x"), (remove, "/a", None), (add, "/a", "1")]) == [("/a", 1, None)]
    assert fold(spark, [(remove, "/q", None), ("remove_dir", "/q", "/x")]) == []


def replay(log):
    """Sequential model: registration order, first ancestor wins."""
    state = {}
    for op, path, arg in log:
        if op == "add_project":
            state.setdefault(path, [int(arg), []])
        elif op == "remove_project":
            state.pop(path, None)
        else:
            owner = next((p for p in state if path == p or path.startswith(p.rstrip("/") + "/")), None)
            if owner is not None:
                dirs = state[owner][1]
                if op == "add_dir" and arg not in dirs:
                    dirs.append(arg)
                elif op == "remove_dir" and arg in dirs:
                    dirs.remove(arg)
    return sorted(((p, run, d) for p, (run, dirs) in state.items() for d in (dirs or [None])), key=str)


def test_replay_equals_sequential_model(spark):
    rnd = random.Random(7)
    paths = ["/a", "/a/b", "/a/b/c", "/d", "/d/e", "/ab"]
    ops = ["add_project", "remove_project", "add_dir", "add_dir", "remove_dir"]
    for _ in range(3):
        # One path takes a large part of the log.
        log = [(op, "/a" if rnd.random() < 0.4 else rnd.choice(paths), None) for op in rnd.choices(ops, k=400)]
        log = [(op, p, str(rnd.randint(0, 1)) if op == "add_project" else f"/x{rnd.randint(0, 3)}") for op, p, _ in log]
        assert fold(spark, log) == replay(log)


def test_roots(spark, rows):
    nested = spark.createDataFrame([("/a", ["/x", "/y"]), ("/b", [])], "path string, extra_dirs array<string>")
    flat = table(spark, [("/a", "/x"), ("/a", "/y"), ("/b", None)], "path string, dir string")
    expected = [("/a", "/a"), ("/a", "/x"), ("/a", "/y"), ("/b", "/b")]
    assert rows(projects.project_roots(nested)) == expected
    assert rows(projects.project_roots(flat)) == expected


def test_registry_documents(spark, rows, tmp_path):
    good = '{"/a": {"run": 1, "extra_dirs": ["/x"]}, "/b": {"run": 0, "extra_dirs": []}}'
    texts = table(spark, [(good,), ("",), ("{broken",), ("[]",)], "value string")
    assert rows(parse_registry(texts).select("path", "run")) == [("/a", 1), ("/b", 0)]
    (tmp_path / "r.json").write_text(good.replace(", ", ",\n "))
    assert read_registry(spark, str(tmp_path / "r.json")).count() == 2
    assert read_registry(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "bad.json").write_text("{")
    assert read_registry(spark, str(tmp_path / "bad.json")).count() == 0


def test_units(spark, rows):
    files = table(spark, [("/usr/include/a.h", "/usr"), ("/p/x/a.c", "/p"), ("/q/a.c", None), ("/a.c", None)],
                  "path string, project string")
    assert rows(extract.scan_unit(files).select("path", "unit")) == [
        ("/a.c", "/a.c"), ("/p/x/a.c", "/p"), ("/q/a.c", "/q"), ("/usr/include/a.h", "/usr/include/a.h")]
    assert rows(extract.scan_unit(files, recursive=False).filter("unit <> path")) == []
    units = table(spark, [("/p", 1), ("/q", 0), ("/r", None), ("/s", 1)], "unit string, run int")
    manifest = table(spark, [("/p", 10), ("/s", 0)], "unit string, size bigint")
    assert rows(extract.units_to_index(units, manifest).select("unit")) == [("/r",), ("/s",)]
    assert rows(extract.units_to_index(units, manifest, force=True).select("unit")) == [("/p",), ("/r",), ("/s",)]


def test_files_by_extension_and_name(spark, rows):
    files = table(spark, [("/a.C", "c"), ("/a.py", "c"), ("/a.go", "go"), ("/a.hpp", "cpp"), ("/a.x/b", "c")],
                  "path string, filetype string")
    assert rows(extract.filter_ext(files, cfg.extensions(spark)).select("path")) == [("/a.C",), ("/a.go",), ("/a.hpp",)]
    names = ["/p/Makefile", "/p/xMakefile", "/p/Makefile.am", "/p/.mypy_cache/a.json", "/p/a.mypy_cache", "/p/configure/x.c",
             "/p/configure.ac", "/p/missing_part.c", "/p/a.config.log"]
    kept = rows(extract.exclude_globs(table(spark, [(n,) for n in names], "path string")))
    assert kept == [("/p/Makefile.am",), ("/p/a.mypy_cache",), ("/p/configure.ac",), ("/p/missing_part.c",)]


def test_line_rules(spark, rows):
    text = "export class Foo {\n  static public bar\nvar f := func\nimport x\nenum E"
    corpus = table(spark, [("/a.ts", "typescript", text), ("/a.go", "go", text)], "path string, lang string, text string")
    found = rows(extract.extract_symbols(corpus).select("file", "kind", "name", "line_no"))
    assert found == [("/a.go", "f", "f", 3), ("/a.ts", "I", "x", 4), ("/a.ts", "c", "Foo", 1), ("/a.ts", "e", "E", 5)]
    more = extract.extract_symbols(corpus, [("go", r"^enum (\w+)", 1, "e")], keep=["text"])
    assert rows(more.select("file", "name")) == [("/a.go", "E")]

"""Folder trees and captured change lists."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, StringStartsWith

from tidewatch.operators import paths as P
from tidewatch.sources import tree


@pytest.fixture
def root(tmp_path):
    for path in ["a.py", "b.TXT", ".py", "src/x.ts", "src/deep/er/y.Go", "src/.github/z.py", "node_modules/m/n.js", "build/o.py",
                 "own/p.py", ".gitmodules.d/q.py", "lib/é ü.rb", "lib/noext", "env/r.py", "envs/s.py", "src/dist/t.py"]:
        at = tmp_path / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text("x" * len(path))
    (tmp_path / "empty").mkdir()
    os.symlink(tmp_path / "src", tmp_path / "linked")
    os.symlink(tmp_path / "a.py", tmp_path / "linked.py")
    return str(tmp_path)


KEPT = {".py", "a.py", "src/x.ts", "src/deep/er/y.Go", "own/p.py", "lib/é ü.rb", "envs/s.py"}


def plain(root, start="", pruned=frozenset(P.DISCOVERY_PRUNED)):
    """The same listing by a recursion."""
    out = {}
    for name in os.listdir(os.path.join(root, start)):
        path = f"{start}/{name}" if start else name
        full = os.path.join(root, path)
        if os.path.islink(full):
            continue
        if os.path.isdir(full):
            if name not in pruned and not name.startswith(".git"):
                out |= plain(root, path, pruned)
        elif "." in name and "." + name.rsplit(".", 1)[1].lower() in P.EXTENSION_LANGUAGE:
            out[path] = os.path.getsize(full)
    return out


@pytest.mark.parametrize("depth", ["0", "1", "2", "7"])
def test_tree_equals_recursion(spark, root, depth):
    got = tree.discover(spark, root, depth=depth).collect()
    assert {r.path: r.size_bytes for r in got} == plain(root) and len(got) == len(KEPT)
    assert {r.path for r in got} == KEPT
    assert {r.language for r in got if r.path.endswith("Go")} == {"go"}


def test_few_tasks_share_the_folders(spark, root):
    df = tree.discover(spark, root, partitions="2")
    assert df.rdd.getNumPartitions() == 3 and {r.path for r in df.collect()} == KEPT


def test_subfolder_and_exclusion(spark, root):
    assert {r.path for r in tree.discover(spark, root, "src", exclude=["er"]).collect()} == {"src/x.ts"}
    assert {r.path for r in tree.discover(spark, f"file://{root}", "./lib/").collect()} == {"lib/é ü.rb"}
    assert tree.discover(spark, root, "empty").collect() == []
    for bad in ["../x", "none", "src/../..", "linked/../../.."]:
        with pytest.raises(Exception, match="subfolder|no such folder"):
            tree.discover(spark, root, bad).collect()


def visited(root, filters=(), **options):
    """Folders that a whole read lists, and its paths, without Spark."""
    reader = tree.SourceTree({"path": root, **options}).reader(None)
    list(reader.pushFilters(list(filters)))
    seen, plain_children = [], reader.listing.children
    reader.listing.children = lambda folder: (seen.append(folder), plain_children(folder))[1]
    rows = [p for part in reader.partitions() for batch in reader.read(part) for p in batch.column("path").to_pylist()]
    return seen, rows


def test_pruned_folders_are_never_listed(root):
    seen, rows = visited(root, depth="0")
    assert sorted(seen) == ["", "empty", "envs", "lib", "own", "src", "src/deep", "src/deep/er"] and set(rows) == KEPT
    seen, rows = visited(root, depth="1")
    assert seen.count("") == 2  # once for its folders, once for its files
    assert not {"node_modules", "build", "env", ".gitmodules.d", "src/.github", "src/dist", "linked"} & set(seen) and set(rows) == KEPT


def test_a_path_prefix_prunes_folders(root):
    seen, rows = visited(root, [StringStartsWith(("path",), "src/deep")], depth="0")
    assert sorted(seen) == ["", "src", "src/deep", "src/deep/er"] and "src/deep/er/y.Go" in rows


def test_extension_and_language_filters(root):
    assert set(visited(root, [EqualTo(("extension",), ".ts")])[1]) == {"src/x.ts"}
    assert set(visited(root, [In(("language",), ("go", "ruby"))])[1]) == {"src/deep/er/y.Go", "lib/é ü.rb"}
    assert visited(root, [EqualTo(("language",), None)])[1] == []


def test_filters_through_spark(spark, root):
    df = tree.discover(spark, root)
    assert {r.path for r in df.filter("extension IN ('.ts', '.rb') AND size_bytes > 1").collect()} == {"src/x.ts", "lib/é ü.rb"}
    assert {r.path for r in df.filter(F.col("path").startswith("src/de")).collect()} == {"src/deep/er/y.Go"}


def test_bounds(spark, root, monkeypatch):
    assert [r.path for r in tree.checked(tree.discover(spark, root)).collect()] == sorted(KEPT)
    monkeypatch.setattr(P, "MAX_FILES", 3)
    with pytest.raises(ValueError, match="7 source files"):
        tree.checked(tree.discover(spark, root))


def test_captured_listing(rows):
    files = rows([("a.py", 1), ("src/build/b.py", 2), ("src/builder/B.JS", 3), (".gitx/c.py", 4), (".gitx.py", 5), ("d.txt", 6), ("", 7), (None, 8), ("own/e.py", 9)], "path string, size long")
    got = {(r.path, r.language, r.extension, r.size_bytes) for r in tree.listed(files, ["own"]).collect()}
    assert got == {("a.py", "python", ".py", 1), ("src/builder/B.JS", "javascript", ".js", 3), (".gitx.py", "python", ".py", 5)}


def test_name_status_lines(rows):
    lines = rows([("M\tsrc/a.py",), ("  A\tb.TS  ",), ("D\tgone.py",), ("R100\told.txt\tnew dir/n.go",), ("R090\told.py\tnew.txt",), ("M\t.py",),
                  ("nothing",), ("",), (None,), ("M\twin\\c.js",), ("M\tsrc/a.py",)], "value string")
    got = sorted((r.path, r.status, r.state) for r in tree.staged(lines).collect())
    assert got == sorted([("src/a.py", "M", "scan"), ("b.TS", "A", "scan"), ("gone.py", "D", "deleted"), ("new dir/n.go", "R100", "scan"),
                          ("new.txt", "R090", "unsupported"), (".py", "M", "unsupported"), ("win\\c.js", "M", "scan"), ("src/a.py", "M", "scan")])


def test_staged_content(rows):
    entries = rows([("win\\c.js", "M", "scan"), ("a.py", "A", "scan"), ("d.py", "D", "deleted")], "path string, status string, state string")
    blobs = rows([("win/c.js", "js"), ("d.py", "old"), (None, "x")], "path string, content string")
    got = {(r.path, r.content) for r in tree.staged_content(entries, blobs).collect()}
    assert got == {("win\\c.js", "js"), ("a.py", None)}

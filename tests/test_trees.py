"""The tree source and the ledger sink on folders made by hand."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from tallyloom.sources import ledgers, trees


@pytest.fixture
def root(tmp_path):
    files = {
        "src/a.ts": "1", "src/b.PY": "2", "src/.js": "3", "src/node_modules/x.js": "4", "src/deep/er/c.go": "5", "secret/key.ts": "6", "package.json": '{"a": 1}', "App.csproj": "", "sub/App.csproj.bak": "", "Cargo.lock": "", "k8s/pod.yaml": "a: [1, 2]\nb: 2024-01-02\n",
        "x/deploy.yml": "apiVersion: v1\nkind: Pod\n", "x/Dockerfile": "FROM y", "x/late.yml": " " * 70_000 + "\napiVersion: v1\nkind: Pod\n", ".github/workflows/ci.yml": "on: x", "m/main.tf": "", "v/sealed-secret.txt": "", "x/stack.json": '{"Type": "AWS::S3"}', "bad.json": "{", "bad.yaml": "a: [",
        "r/roles/web/tasks/t.yml": "- x: 1", "t/templates/z.yaml": "", "docs/r.md": "", "docs/agents/p.md": "", "tests/u_test.go": "", "pic.png": "", "unknown.bin": "\x00", "supabase/config.json": "{}", "supabase/x/config.json": "{}", ".env.local": "", "registry.json": "{}",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    os.symlink(tmp_path / "src", tmp_path / "link")
    os.symlink(tmp_path / "src/a.ts", tmp_path / "src/link.ts")
    return tmp_path


def test_scan_finds_what_a_walk_finds(spark, root):
    for partitions in (1, 3, 100):
        e = trees.tree(spark, f"file://{root}", exclude=("secret",), partitions=partitions)
        kinds = {r["path"]: r["kind"] for r in e.collect()}
        assert kinds["link"] == kinds["src/link.ts"] == "symlink" and kinds["src/node_modules"] == "excluded-directory" and kinds["secret"] == "excluded-path"
        want = {os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names if "node_modules" not in d and "secret" not in d.split("/") and not os.path.islink(os.path.join(d, f))}
        assert {p for p, k in kinds.items() if k == "file"} == want and e.count() == len(kinds)
    assert {r["path"] for r in trees.source_files(e).collect()} == {"src/a.ts", "src/b.PY", "src/deep/er/c.go", "tests/u_test.go"}
    assert {r["path"] for r in trees.dependency_files(e).collect()} == {"package.json", "App.csproj", "Cargo.lock"}
    kind = {r["path"]: r["classification"] for r in trees.inventory(e).collect()}
    assert {kind[p] for p in ("supabase/config.json", ".env.local", "x/Dockerfile", ".github/workflows/ci.yml", "m/main.tf")} == {"security-resource"}
    assert [kind[p] for p in ("registry.json", "docs/agents/p.md", "docs/r.md", "pic.png", "unknown.bin", "supabase/x/config.json", "tests/u_test.go", "src/.js")] == ["generated-runtime-resource", "runtime-prompt", "documentation", "asset", "other", "other", "source", "other"]


def test_what_cannot_be_read_is_a_row(spark, root, monkeypatch):
    assert [tuple(r) for r in trees.scan_errors(trees.tree(spark, f"{root}/none")).collect()] == [(".", "ENOENT")]
    plain = os.scandir

    def refuse(path):
        if str(path).endswith("/deep"):
            raise PermissionError(13, "no")
        return plain(path)

    monkeypatch.setattr(os, "scandir", refuse)
    rows = list(trees.Walk({"path": str(root)}).all(""))
    assert [r for r in rows if r[1] == "unreadable"] == [("src/deep", "unreadable", None, None, "EACCES")]


def test_iac_manifest(spark, root):
    files, passed, coverage = trees.iac_manifest(spark, str(root), ("secret",))
    got = {r["path"]: r["classification"] for r in files.collect()}
    assert got == {
        "k8s/pod.yaml": "kubernetes", "x/deploy.yml": "kubernetes", "x/Dockerfile": "container", ".github/workflows/ci.yml": "ci-cd", "m/main.tf": "terraform", "v/sealed-secret.txt": "secret-management", "x/stack.json": "cloudformation",
        "r/roles/web/tasks/t.yml": "ansible", "t/templates/z.yaml": "helm",
    }
    assert {(r["path"], r["reason"]) for r in passed.collect()} == {("link", "symlink"), ("src/link.ts", "symlink"), ("src/node_modules", "excluded-directory"), ("secret", "excluded-directory")}
    assert {r["classification"]: r["n"] for r in coverage.collect()}["kubernetes"] == 2
    assert files.where("path = 'x/Dockerfile'").first()["sha256"] == hashlib.sha256(b"FROM y").hexdigest()


def test_structured_documents(spark, root):
    e = trees.tree(spark, str(root), "whole").where("path in ('package.json', 'k8s/pod.yaml', 'bad.json', 'bad.yaml', 'x/deploy.yml')")
    got = {r["path"]: (r["format"], r["value"] and json.loads(r["value"]), r["error"] is None) for r in trees.read_structured(e).collect()}
    assert got == {"package.json": ("json", {"a": 1}, True), "k8s/pod.yaml": ("yaml", {"a": [1, 2], "b": "2024-01-02"}, True), "x/deploy.yml": ("yaml", {"apiVersion": "v1", "kind": "Pod"}, True), "bad.json": ("json", None, False), "bad.yaml": ("yaml", None, False)}


def test_written_tree_is_read_again(spark, tmp_path):
    df = spark.createDataFrame([(f"d{i % 7}/e{i % 3}/f{i}.txt", bytes([i])) for i in range(100)], "path string, content binary").repartition(5)
    trees.write_tree(df, f"file://{tmp_path}/t")
    trees.write_tree(df, f"file://{tmp_path}/t")  # once more changes nothing
    got = trees.tree(spark, f"{tmp_path}/t", "whole", partitions=4).select("path", "content").collect()
    assert sorted((r["path"], bytes(r["content"])) for r in got) == sorted((r["path"], bytes(r["content"])) for r in df.collect())
    with pytest.raises(Exception, match="leaves the tree"):
        trees.write_tree(spark.createDataFrame([("../x", b"")], "path string, content binary"), f"{tmp_path}/t")


@pytest.mark.parametrize("when", ["before", "after"])
def test_a_batch_whose_commit_is_lost_is_there_once(spark, tmp_path, when):
    flag = str(tmp_path / "failed")

    class Writer(ledgers.LedgerWriter):
        def commit(self, messages, batchId):
            first = batchId == 1 and not os.path.exists(flag)
            if first and when == "before":
                open(flag, "w").close()
                raise OSError("lost before")
            super().commit(messages, batchId)
            if first:
                open(flag, "w").close()
                raise OSError("lost after")

    class Sink(ledgers.LedgerSink):
        @classmethod
        def name(cls):
            return f"ledger_{when}"

        def streamWriter(self, schema, overwrite):
            return Writer(self.options)

    spark.dataSource.register(Sink)
    src, out = tmp_path / "in", str(tmp_path / "out")
    spark.range(0, 100).selectExpr("id", "concat('ä', id) as t").repartition(4).write.parquet(str(src))

    def run():
        q = spark.readStream.schema("id long, t string").option("maxFilesPerTrigger", 2).parquet(str(src)).writeStream.format(f"ledger_{when}").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run()
    run()
    got = ledgers.appended(spark, out, "id long, t string").collect()
    assert sorted((r["id"], r["t"]) for r in got) == [(i, f"ä{i}") for i in range(100)]
    assert {r["_batch"] for r in got} == {0, 1} and ledgers.damage(spark, out).count() == 0
    names = set(os.listdir(f"{out}/data"))
    assert len(names) == len({r["_name"] for r in spark.read.json(f"{out}/manifests").select(F.explode("files.name").alias("_name")).collect()})
    next(iter(tmp_path.glob("out/data/*"))).write_text("x\n")
    assert [r["problem"] for r in ledgers.damage(spark, out).collect()] == ["digest"]


def test_only_an_open_last_line_is_torn(spark, tmp_path):
    files = {"a": '{"k": 1}\n{"k": 2', "b": '{"k": 1}\nbad\n{"k": 2}', "c": '{"k": 1}\nbad\n', "d": '\n{"k": 3}\n\n', "e": "ä", "f": ""}
    for n, t in files.items():
        (tmp_path / f"{n}.jsonl").write_text(t)
    got = sorted((r["file"][-7], r["state"], r["row"] and r["row"]["k"]) for r in ledgers.ledger_lines(spark, str(tmp_path), "k int").collect())
    assert [g[:2] for g in got] == [("a", "good"), ("a", "torn"), ("b", "bad"), ("b", "good"), ("b", "good"), ("c", "bad"), ("c", "good"), ("d", "good"), ("e", "torn")]
    assert sum(r or 0 for _, s, r in got if s == "good") == 1 + 3 + 1 + 3


def test_pending_batches_are_replayed(spark):
    have = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x"), ("c", 1, "x")], "file string, seq long, body string")
    ahead = spark.createDataFrame([("a", 2, "y"), ("a", 3, "z"), ("b", 1, "other"), ("c", 3, "z")], "file string, seq long, body string")
    got = {(r["file"], r["seq"]): (r["body"], r["problem"]) for r in ledgers.recovered(have, ahead, "seq").collect()}
    assert got == {("a", 1): ("x", None), ("a", 2): ("y", None), ("a", 3): ("z", None), ("b", 1): ("x", "conflict"), ("c", 1): ("x", None), ("c", 3): ("z", "gap")}

"""Specifiers and their resolution on repositories made by hand."""

from tallyloom.operators import imports as M

JS = """import def from './near';
import { a,
  b } from "../lib/util.js";
export * from '../up'; export { q } from '@/deep/x'; import("@app"); require( 'kit' ); require('kit/extra'); require('kit/none')
import x from 'kit/obj'; import y from '@scope/pkg/sub'; import z from '/rooted'; import '@half'"""
RS = """use crate::net::{client, server as s};
use super::super::top::Thing; use self::inner::Deep;
use serde::Deserialize; use selfish::x;
mod child;
 mod gone ;"""
PY = "from . import sibling\nfrom .mod import a\nfrom ..pkg2 import b\nimport own.sub, other\n  import numpy.linalg\nfrom own import c\n"
GO = 'import "fmt"\nimport alias "ex.org/m/util"\nimport (\n\t"ex.org/m"\n\t_ "ex.org/module2"\n\tx "ex.org/m/none"\n)\n'

FILES = {
    "web/src/a.ts": JS, "web/src/near.tsx": "", "web/src/near.js": "", "web/lib/util.js": "", "web/up/index.mjs": "", "web/code/deep/x.ts": "", "web/app.ts": "",
    "kit/main.ts": "", "kit/extra.jsx": "", "kit/obj.d.ts": "", "kit/lib/obj.ts": "",
    "crate/src/lib.rs": "", "crate/src/a/b/c.rs": RS, "crate/src/net.rs": "", "crate/src/net/client.rs": "", "crate/src/net/server/mod.rs": "", "crate/src/a/top.rs": "", "crate/src/top.rs": "",
    "crate/src/a/b/c/inner.rs": "", "crate/src/a/b/c/child/mod.rs": "",
    "own/__init__.py": "", "own/sub.py": "", "own/sub/__init__.py": "", "own/deep/x.py": PY, "own/deep/mod.py": "", "own/pkg2/__init__.py": "",
    "go/main.go": GO, "go/util/b.go": "", "go/util/a.go": "", "go/util/a_test.go": "", "go/util/c.txt": "",
    "notes.md": "import x from './y'", "empty.ts": None,
}


def table(spark):
    rows = [("r", p, t) for p, t in FILES.items()] + [("r", "empty.ts", None), ("q", "web/src/near.ts", "import './a'"), ("q", None, "import './a'")]
    return spark.createDataFrame(rows, "repo string, path string, text string").repartition(3)


def settings(spark):
    paths = "ord int, repo string, config_dir string, base_url string, include array<string>, paths array<struct<pattern: string, mappings: array<string>>>"
    configs = spark.createDataFrame([(0, "r", ".", None, None, [("@/*", ["never/*"])]), (1, "r", "web", None, ["test"], [("@/*", ["bad/*"])]), (2, "r", "web", ".", ["src/**/*"], [("@/*", ["none/*", "code/*"]), ("@app", ["./app"])])], paths)
    kit = '{"name": "kit", "main": "main.cjs", "exports": {"./obj": {"import": "./missing.mjs", "default": "dist/../lib/obj.js"}}}'
    manifests = spark.createDataFrame([("r", "kit", kit), ("r", "bad", "{"), ("r", "anon", "{}")], "repo string, root string, text string")
    return {
        "configs": configs, "manifests": manifests, "crates": spark.createDataFrame([("r", "crate")], "repo string, dir string"),
        "modules": spark.createDataFrame([("r", ".", "ex.org/outer"), ("r", "go", "ex.org/m")], "repo string, dir string, module string"),
    }


WANT = {
    ("web/src/a.ts", "./near"): ("local-resolved", "relative-import", ["web/src/near.tsx"]),
    ("web/src/a.ts", "../lib/util.js"): ("local-resolved", "relative-import", ["web/lib/util.js"]),
    ("web/src/a.ts", "../up"): ("local-resolved", "relative-import", ["web/up/index.mjs"]),
    ("web/src/a.ts", "@/deep/x"): ("local-resolved", "tsconfig-paths", ["web/code/deep/x.ts"]),
    ("web/src/a.ts", "@app"): ("local-resolved", "tsconfig-paths", ["web/app.ts"]),
    ("web/src/a.ts", "kit"): ("local-resolved", "workspace-package", ["kit/main.ts"]),
    ("web/src/a.ts", "kit/extra"): ("local-resolved", "workspace-package", ["kit/extra.jsx"]),
    ("web/src/a.ts", "kit/none"): ("local-unresolved", "workspace-package", []),
    ("web/src/a.ts", "kit/obj"): ("local-resolved", "workspace-package", ["kit/lib/obj.ts"]),
    ("web/src/a.ts", "@scope/pkg/sub"): ("external", "bare-specifier", []),
    ("web/src/a.ts", "/rooted"): ("external", "bare-specifier", []),
    ("web/src/a.ts", "@half"): ("external", "bare-specifier", []),
    ("crate/src/a/b/c.rs", "crate::net::client"): ("local-resolved", "rust-crate-path", ["crate/src/net/client.rs"]),
    ("crate/src/a/b/c.rs", "crate::net::server"): ("local-resolved", "rust-crate-path", ["crate/src/net/server/mod.rs"]),
    ("crate/src/a/b/c.rs", "super::super::top::Thing"): ("local-resolved", "rust-super-path", ["crate/src/a/top.rs"]),
    ("crate/src/a/b/c.rs", "self::inner::Deep"): ("local-resolved", "rust-self-path", ["crate/src/a/b/c/inner.rs"]),
    ("crate/src/a/b/c.rs", "serde::Deserialize"): ("external", "external-crate", []),
    ("crate/src/a/b/c.rs", "self"): ("external", "external-crate", []),  # the start of selfish
    ("crate/src/a/b/c.rs", "mod:child"): ("local-resolved", "rust-mod-decl", ["crate/src/a/b/c/child/mod.rs"]),
    ("crate/src/a/b/c.rs", "mod:gone"): ("local-unresolved", "rust-mod-decl", []),
    ("own/deep/x.py", "."): ("local-unresolved", "python-relative", []),
    ("own/deep/x.py", ".mod"): ("local-resolved", "python-relative", ["own/deep/mod.py"]),
    ("own/deep/x.py", "..pkg2"): ("local-resolved", "python-relative", ["own/pkg2/__init__.py"]),
    ("own/deep/x.py", "own.sub"): ("local-resolved", "python-local-absolute", ["own/sub.py", "own/sub/__init__.py"]),
    ("own/deep/x.py", "own"): ("local-resolved", "python-local-absolute", ["own/__init__.py"]),
    ("own/deep/x.py", "numpy.linalg"): ("external", "external-python-module", []),
    ("go/main.go", "fmt"): ("external", "external-go-module", []),
    ("go/main.go", "ex.org/m/util"): ("local-resolved", "go-local-module", ["go/util/a.go", "go/util/b.go"]),
    ("go/main.go", "ex.org/m"): ("local-resolved", "go-local-module", ["go/main.go"]),
    ("go/main.go", "ex.org/module2"): ("external", "external-go-module", []),
    ("go/main.go", "ex.org/m/none"): ("local-unresolved", "go-local-module", []),
    ("web/src/near.ts", "./a"): ("local-unresolved", "relative-import", []),
}


def test_imports_of_all_languages(spark):
    files = table(spark)
    found = M.resolved(files, **settings(spark)).collect()
    assert {(r.path, r.specifier): (r.classification, r.resolution, r.targets) for r in found} == WANT and len(found) == len(WANT)


def test_imports_without_settings_or_files(spark):
    files = table(spark)
    found = {(r.path, r.specifier): (r.classification, r.resolution) for r in M.resolved(files).collect()}
    assert found["web/src/a.ts", "kit"] == ("external", "bare-specifier") and found["crate/src/a/b/c.rs", "mod:child"] == ("local-unresolved", "rust-mod-decl")
    assert found["go/main.go", "ex.org/m"] == ("external", "external-go-module") and len(found) == len(WANT)
    assert M.resolved(files.limit(0), **settings(spark)).count() == 0


def test_first_nodes_of_imports(spark):
    nodes = spark.createDataFrame([(3, "a/x.js"), (1, "a/x/deep/y.ts"), (2, "a/xy.ts"), (5, "a/z.ts"), (4, "a/z")], "ord long, path string")
    imports = spark.createDataFrame([("a/m.ts", "./x"), ("a/b/m.ts", "../z"), ("a/m.ts", "./none"), ("a/m.ts", "bare")], "path string, module string")
    assert {(r.path, r.module): r.target for r in M.first_nodes(imports, nodes).collect()} == {("a/m.ts", "./x"): "a/x/deep/y.ts", ("a/b/m.ts", "../z"): "a/z", ("a/m.ts", "./none"): None}


def test_globs(spark):
    cases = [("src/**/*", "src/a/b.ts", True), ("src/**", "src", True), ("src", "src/a", True), ("src", "srcs/a", False), ("*.ts", "a.ts", True), ("*.ts", "d/a.ts", False), ("**/*.ts", "d/e/a.ts", True), ("a.b", "axb/c", False)]
    df = spark.createDataFrame(cases, "g string, p string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", M.glob_matches(df.g, df.p)).collect())

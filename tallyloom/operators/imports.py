"""Import graphs: specifiers taken from source texts, and the files of the same repository that they name.

Every way of resolving makes candidates, each with a tier; one join with the files' paths says which exist, and the targets of the least tier stand. Texts
are read in a projection and never move; what is joined are paths. A repository's configurations are settings and travel as one array.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.graphs import cut

#: Endings that a module's name may leave out, in the order in which they are tried.
SCRIPT_ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
#: Languages by ending.
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "rs": "rust", "go": "go"}

#: The forms in which each language names a module.
SCRIPT_FORMS = (r"""\b(?:import|export)\s+(?:[\s\S]*?\s+from\s+)?['"]([^'"]+)['"]""", r"""\brequire\(\s*['"]([^'"]+)['"]\s*\)""", r"""\bimport\(\s*['"]([^'"]+)['"]\s*\)""")
PYTHON_FORMS = (r"(?m)^\s*from\s+([.A-Za-z_][\w.]*)\s+import\s+", r"(?m)^\s*import\s+([A-Za-z_][\w.]*)")
RUST_USE = r"\buse\s+((?:crate|self|super)(?:::\w+|::\{[^}]*\}|::super)*(?:::\w+|::\{[^}]*\})?)"
RUST_BRACES = r"^((?:crate|self|super)(?:::\w+|::super)*)(?:::)?\{([^}]*)\}$"
RUST_MOD = r"(?m)^\s*mod\s+(\w+)\s*;"
RUST_OTHER = r"\buse\s+(\w[\w:]*)"
GO_FORMS = (r'import\s+"([^"]+)"', r'import\s+\w+\s+"([^"]+)"')
GO_BLOCK = r"import\s+\(([\s\S]*?)\)"

CANDIDATE = "array<struct<tier: long, how: string, key: string>>"


def found_in(text: Column, form: str) -> Column:
    return F.regexp_extract_all(text, F.lit(form), F.lit(1))


def language(path: Column) -> Column:
    """The language that a path's ending says; null for others."""
    return F.create_map(*(F.lit(x) for e in LANGUAGES.items() for x in e))[F.regexp_extract(path, r"\.([^./]+)$", 1)]


def rust_specifiers(text: Column) -> Column:
    def parts(use: Column) -> Column:
        items = F.split(F.regexp_extract(use, RUST_BRACES, 2), ",")
        names = F.filter(F.transform(items, lambda x: F.regexp_replace(F.trim(x), r"\s+as\s+\w+$", "")), lambda x: x != "")
        braced = F.regexp_extract(use, RUST_BRACES, 2) != ""
        return F.when(braced, F.transform(names, lambda x: F.concat(F.regexp_extract(use, RUST_BRACES, 1), F.lit("::"), x))).otherwise(F.array(use))

    mods = F.transform(found_in(text, RUST_MOD), lambda x: F.concat(F.lit("mod:"), x))
    others = F.filter(found_in(text, RUST_OTHER), lambda x: ~x.rlike("^(crate|self|super)"))
    return F.concat(F.flatten(F.transform(found_in(text, RUST_USE), parts)), mods, others)


def specifiers(path: Column, text: Column) -> Column:
    """The distinct names of modules in a source text, by the language of its path; empty for other languages and for null.

    White space is that of ASCII. The kind of a specifier follows from its name alone (kind_of), so names are distinct by themselves.
    """
    every = lambda forms: F.concat(*(found_in(text, f) for f in forms))
    go = F.concat(every(GO_FORMS), F.flatten(F.transform(found_in(text, GO_BLOCK), lambda b: found_in(b, '"([^"]+)"'))))
    lang = language(path)
    by = F.when(lang.isin("typescript", "javascript"), every(SCRIPT_FORMS)).when(lang == "python", every(PYTHON_FORMS)).when(lang == "rust", rust_specifiers(text)).when(lang == "go", go)
    return F.array_sort(F.array_distinct(F.coalesce(by, F.array().cast("array<string>"))))


def kind_of(lang: Column, name: Column) -> Column:
    rust = F.when(name.startswith("mod:"), "mod-decl").when(name.startswith("crate::"), "crate-path").when(name.startswith("self::"), "self-path").when(name.startswith("super"), "super-path").otherwise("external-use")
    dotted = name.startswith(".")
    return F.when(lang == "rust", rust).when(lang == "go", "import").when(lang == "python", F.when(dotted, "relative").otherwise("absolute")).otherwise(F.when(dotted, "relative").otherwise("non-relative"))


def folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def plain_path(path: Column) -> Column:
    """A path without empty, `.` and `..` parts; `..` at the root stays there."""
    step = lambda a, x: F.when(x.isin("", "."), a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def candidates(names: Column, how: str | Column, first: Column | int = 0, same_tier: bool = False) -> Column:
    how = F.lit(how) if isinstance(how, str) else how
    first = F.lit(first) if isinstance(first, int) else first
    return F.transform(names, lambda x, i: F.struct((first + (F.lit(0) if same_tier else i)).cast("long").alias("tier"), how.alias("how"), F.concat(F.lit("f:"), x).alias("key"))).cast(CANDIDATE)


def script_names(base: Column) -> Column:
    """A script's name and, if it has no ending, the twelve that it may stand for."""
    ends = F.array(*(F.lit(e) for e in ("", *SCRIPT_ENDINGS, *(f"/index{e}" for e in SCRIPT_ENDINGS))))

    def of(b: Column) -> Column:  # bound once, as base is long
        return F.transform(F.when(b.rlike(r"[^/]\.[^./]*$"), F.slice(ends, 1, 1)).otherwise(ends), lambda e: F.concat(b, e))

    return F.flatten(F.transform(F.array(base), of))


def glob_matches(glob: Column, path: Column) -> Column:
    """A simple glob: the path itself, all below `dir/**` (or `dir/**/*`), `*` within a part and `**` across, or all below a plain folder."""
    glob = F.replace(glob, F.lit("\\"), F.lit("/"))
    deep = F.regexp_replace(glob, r"/\*\*/?\*?$", "")
    quoted = F.regexp_replace(glob, r"([.+^${}()|\[\]\\?])", r"\\$1")
    regex = F.concat(F.lit("^"), F.replace(F.replace(F.replace(quoted, F.lit("**"), F.lit("\u0001")), F.lit("*"), F.lit("[^/]*")), F.lit("\u0001"), F.lit(".*")), F.lit("$"))
    below = lambda p: path.startswith(F.concat(p, F.lit("/")))
    return F.when(glob == path, True).when(glob.rlike(r"/\*\*(/\*)?$"), below(deep) | (path == deep)).when(glob.contains("*"), F.call_function("rlike", path, regex)).otherwise(below(glob))


def nearest(files: DataFrame, marks: DataFrame) -> DataFrame:
    """(repo, path) with the columns of the mark (repo, dir, ...) of the nearest folder above that has one; others are left out."""
    parts = F.split("path", "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).otherwise(F.array().cast("array<string>"))
    up = files.select("repo", "path", F.posexplode(F.concat(F.array(F.lit(".")), above)).alias("depth", "dir"))
    rest = [c for c in marks.columns if c != "repo"]
    best = up.join(marks, ["repo", "dir"]).groupBy("repo", "path").agg(F.max_by(F.struct(*rest), "depth").alias("mark"))
    return best.select("repo", "path", *(F.col("mark")[c].alias(c) for c in rest))


def file_keys(files: DataFrame) -> DataFrame:
    """(repo, key, targets): each path, and each folder with its Go files that aren't tests."""
    paths = files.select("repo", "path").distinct()
    one = paths.select("repo", F.concat(F.lit("f:"), "path").alias("key"), F.array("path").alias("targets"))
    go = paths.where(F.col("path").endswith(".go") & ~F.col("path").endswith("_test.go"))
    many = go.groupBy("repo", F.concat(F.lit("d:"), folder(F.col("path"))).alias("key")).agg(F.array_sort(F.collect_list("path")).alias("targets"))
    return one.unionByName(many)


def package_entries(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, name, root, entries): packages from their manifests (repo, root, text), with the files that each exported subpath names.

    An exported object's types, import, require and default are tried in that order; `.` falls back on types, module and main. A named file that isn't
    there may be the built form of a source. A manifest that isn't JSON or has no name is none; of equal names the greatest root stands, as the last one read.
    """
    m = manifests.select("repo", "root", F.from_json("text", "name string, exports map<string, string>, types string, module string, main string").alias("m"))
    m = m.where("m.name <> ''").groupBy("repo", F.col("m.name").alias("name")).agg(F.max_by("m", "root").alias("m"), F.max("root").alias("root"))
    exported = m.select("repo", "name", "root", F.explode("m.exports").alias("subpath", "value"))
    nested = F.from_json("value", "types string, import string, require string, default string")
    choices = F.when(F.col("value").startswith("{"), F.array(nested["types"], nested["import"], nested["require"], nested["default"])).otherwise(F.array("value"))
    rows = exported.select("repo", "name", "root", "subpath", F.posexplode(choices).alias("choice", "entry"))
    main = m.select("repo", "name", "root", F.lit(".").alias("subpath"), F.posexplode(F.array("m.types", "m.module", "m.main")).alias("choice", "entry"))
    rows = rows.unionByName(main.withColumn("choice", F.col("choice") + 10)).where("entry is not null")
    below = lambda name: F.when(F.col("root") == ".", F.lit(name)).otherwise(F.concat("root", F.lit(f"/{name}")))
    rel = plain_path(F.concat_ws("/", "root", "entry"))
    from_src = F.regexp_replace(rel, "^dist/", "src/")
    built, typed = r"\.(?:js|mjs|cjs)$", r"\.(?:js|mjs|cjs|d\.ts)$"
    names = F.array(
        rel, F.regexp_replace(from_src, typed, ".ts"), F.regexp_replace(from_src, typed, ".tsx"), F.regexp_replace(rel, built, ".ts"), F.regexp_replace(rel, built, ".tsx"),
        *(below(f"{d}index{e}") for d in ("src/", "") for e in SCRIPT_ENDINGS[:4]),
    )
    tried = rows.select("repo", "name", "subpath", "choice", F.posexplode(names).alias("k", "path")).join(files.select("repo", "path").distinct(), ["repo", "path"])
    best = tried.groupBy("repo", "name", "subpath").agg(F.min_by("path", F.struct("choice", "k")).alias("path"))
    entries = best.groupBy("repo", "name").agg(F.map_from_entries(F.collect_list(F.struct("subpath", "path"))).alias("entries"))
    return m.select("repo", "name", "root").join(entries, ["repo", "name"], "left").select("repo", "name", "root", F.coalesce("entries", F.create_map().cast("map<string, string>")).alias("entries"))


def mapped(name: Column, config: Column) -> Column:
    """Candidates of a specifier by the mappings of a configuration's patterns, in their order."""
    base_dir = F.when(config["base_url"].isNotNull() & (config["base_url"] != ""), plain_path(F.concat_ws("/", config["config_dir"], config["base_url"]))).otherwise(config["config_dir"])

    def of(p: Column, i: Column) -> Column:
        prefix = F.substring_index(p["pattern"], "*", 1)
        star = p["pattern"].contains("*")
        suffix = F.when(star, p["pattern"].substr(F.length(prefix) + 2, F.length(p["pattern"]))).otherwise(F.lit(""))
        fits = F.when(star, name.startswith(prefix) & name.endswith(suffix) & (F.length(name) >= F.length(prefix) + F.length(suffix))).otherwise(name == p["pattern"])
        caught = F.when(star, name.substr(F.length(prefix) + 1, F.length(name) - F.length(prefix) - F.length(suffix))).otherwise(F.lit("*"))

        def one(m: Column, j: Column) -> Column:
            head = F.substring_index(m, "*", 1)
            into = F.when(m.contains("*"), F.concat(head, caught, m.substr(F.length(head) + 2, F.length(m)))).otherwise(m)
            return candidates(script_names(plain_path(F.concat_ws("/", base_dir, into))), "tsconfig-paths", (i * 1000 + j) * 20)

        return F.when(fits, F.flatten(F.transform(p["mappings"], one))).otherwise(F.array().cast(CANDIDATE))

    return F.flatten(F.transform(config["paths"], of))


def scripts(specs: DataFrame, configs: DataFrame | None, packages: DataFrame | None) -> DataFrame:
    relative = specs.where("kind = 'relative'").select(
        "repo", "path", "specifier", "kind", F.lit("local-unresolved").alias("otherwise"), F.lit("relative-import").alias("how"),
        candidates(script_names(plain_path(F.concat_ws("/", folder(F.col("path")), "specifier"))), "relative-import").alias("candidates"), F.lit(None).cast("string").alias("top"),
    )
    bare, name = specs.where("kind <> 'relative'"), F.col("specifier")
    by_config = F.array().cast(CANDIDATE)
    if configs is not None:
        entry = F.struct("ord", "config_dir", "base_url", "include", "paths")
        bare = bare.join(configs.groupBy("repo").agg(F.array_sort(F.collect_list(entry)).alias("configs")), "repo", "left")

        def covers(c: Column) -> Column:
            inner = F.when((c["config_dir"] != ".") & F.col("path").startswith(F.concat(c["config_dir"], F.lit("/"))), F.expr("path").substr(F.length(c["config_dir"]) + 2, F.length("path"))).otherwise(F.col("path"))
            return (c["ord"] > 0) & F.exists(c["include"], lambda g: glob_matches(g, inner) | glob_matches(g, F.col("path")))

        root = F.filter("configs", lambda c: c["ord"] == 0)
        bare = bare.withColumn("config", F.coalesce(F.try_element_at(F.filter("configs", covers), F.lit(1)), F.try_element_at(root, F.lit(1))))
        by_config = F.coalesce(mapped(name, F.col("config")), by_config)
    scoped = F.regexp_extract(name, "^(@[^/]*/[^/]*)", 1)
    package = F.when(name.startswith("/"), F.lit(None)).when(name.startswith("@"), F.when(scoped != "", scoped)).otherwise(F.regexp_extract(name, "^([^/]*)", 1))
    bare = bare.withColumn("package", package).withColumn("subpath", F.when(F.length(name) > F.length("package"), name.substr(F.length("package") + 2, F.length(name))))
    otherwise, how, by_package = F.lit("external"), F.lit("bare-specifier"), F.array().cast(CANDIDATE)
    if packages is not None:
        bare = bare.join(packages.withColumnRenamed("name", "package"), ["repo", "package"], "left")
        known = F.col("root").isNotNull()
        entry = F.try_element_at("entries", F.when(F.col("subpath") != "", F.concat(F.lit("./"), "subpath")).otherwise(F.lit(".")))
        below = candidates(script_names(plain_path(F.concat_ws("/", "root", "subpath"))), "workspace-package", 10**9 + 1)
        by_package = F.when(~known, by_package).otherwise(
            F.concat(F.when(entry.isNotNull(), candidates(F.array(entry), "workspace-package", 10**9)).otherwise(by_package), F.when(F.col("subpath") != "", below).otherwise(by_package))
        )
        otherwise, how = F.when(known, "local-unresolved").otherwise(otherwise), F.when(known, "workspace-package").otherwise(how)
    return relative.unionByName(
        bare.select("repo", "path", "specifier", "kind", otherwise.alias("otherwise"), how.alias("how"), F.concat(by_config, by_package).alias("candidates"), F.lit(None).cast("string").alias("top"))
    )


def python(specs: DataFrame) -> DataFrame:
    dots = F.length(F.regexp_extract("specifier", r"^(\.*)", 1))
    relative = F.col("kind") == "relative"
    inner = F.replace(F.regexp_replace("specifier", r"^\.+", ""), F.lit("."), F.lit("/"))
    base = F.when(relative, plain_path(F.concat_ws("/", folder(F.col("path")), F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), inner))).otherwise(F.replace("specifier", F.lit("."), F.lit("/")))
    how = F.when(relative, "python-relative").otherwise("python-local-absolute")
    names = F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))
    top = F.when(~relative, F.substring_index("specifier", ".", 1))
    return specs.select("repo", "path", "specifier", "kind", F.lit("local-unresolved").alias("otherwise"), how.alias("how"), candidates(names, how, same_tier=True).alias("candidates"), top.alias("top"))


def rust(specs: DataFrame, crates: DataFrame | None) -> DataFrame:
    how, none = F.concat(F.lit("rust-"), "kind"), F.array().cast(CANDIDATE)
    external = F.col("kind") == "external-use"
    said = [F.when(external, "external").otherwise("local-unresolved").alias("otherwise"), F.when(external, "external-crate").otherwise(how).alias("how")]
    if crates is None:
        return specs.select("repo", "path", "specifier", "kind", *said, none.alias("candidates"), F.lit(None).cast("string").alias("top"))
    near = nearest(specs.select("repo", "path").distinct(), crates.select("repo", "dir"))
    own, src = F.regexp_extract("path", r"([^/]*?)(?:\.rs)?$", 1), F.when(F.col("dir") == ".", F.lit("src")).otherwise(F.concat("dir", F.lit("/src")))
    home = F.when(own.isin("mod", "lib", "main"), folder(F.col("path"))).otherwise(F.concat(folder(F.col("path")), F.lit("/"), own))
    segments = F.split("specifier", "::")
    supers = F.size(F.split(F.regexp_extract("specifier", r"^((?:super(?:::|$))*)", 1), "super")) - 1
    raised = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("supers"), F.lit(1))), F.col("home"), lambda b, _: F.when(folder(b) == ".", F.col("src")).otherwise(folder(b)))
    base = F.when(F.col("kind") == "crate-path", F.col("src")).when(F.col("kind") == "super-path", raised).otherwise(F.col("home"))
    items = F.when(F.col("kind") == "mod-decl", F.array(F.expr("specifier").substr(F.lit(5), F.length("specifier")))).when(F.col("kind") == "super-path", F.slice(segments, F.col("supers") + 1, F.size(segments))).otherwise(F.slice(segments, 2, F.size(segments)))

    def at(depth: Column) -> Column:
        stem = F.concat_ws("/", F.col("base"), F.array_join(F.slice(F.col("items"), F.lit(1), depth), "/"))
        return candidates(F.array(F.concat(stem, F.lit(".rs")), F.concat(stem, F.lit("/mod.rs"))), how, F.size("items") - depth, same_tier=True)

    s = specs.join(near, ["repo", "path"], "left").withColumn("home", home).withColumn("src", src).withColumn("supers", supers).withColumn("base", base).withColumn("items", items)
    made = F.when(external | F.col("dir").isNull() | (F.size("items") < 1), none).otherwise(F.flatten(F.transform(F.sequence(F.size("items"), F.lit(1), F.lit(-1)), at)))
    return s.select("repo", "path", "specifier", "kind", *said, made.alias("candidates"), F.lit(None).cast("string").alias("top"))


def go(specs: DataFrame, modules: DataFrame | None) -> DataFrame:
    if modules is None:
        modules = specs.select("repo", F.lit(".").alias("dir"), F.lit("").alias("module")).limit(0)
    near = nearest(specs.select("repo", "path").distinct(), modules.where("module <> ''").select("repo", "dir", "module"))
    s = specs.join(near, ["repo", "path"], "left")
    local = F.coalesce((F.col("specifier") == F.col("module")) | F.col("specifier").startswith(F.concat("module", F.lit("/"))), F.lit(False))
    below = F.expr("specifier").substr(F.length("module") + 2, F.length("specifier"))
    target = F.when(below == "", F.col("dir")).when(F.col("dir") == ".", below).otherwise(F.concat_ws("/", "dir", below))
    one = F.array(F.struct(F.lit(0).cast("long").alias("tier"), F.lit("go-local-module").alias("how"), F.concat(F.lit("d:"), target).alias("key"))).cast(CANDIDATE)
    return s.select(
        "repo", "path", "specifier", "kind", F.when(local, "local-unresolved").otherwise("external").alias("otherwise"), F.when(local, "go-local-module").otherwise("external-go-module").alias("how"),
        F.when(local, one).otherwise(F.array().cast(CANDIDATE)).alias("candidates"), F.lit(None).cast("string").alias("top"),
    )


def extracted(files: DataFrame) -> DataFrame:
    """(repo, path, language, specifier, kind): one row for each name of a module in a text."""
    s = files.where("path is not null").select("repo", "path", language(F.col("path")).alias("language"), F.explode(specifiers(F.col("path"), F.col("text"))).alias("specifier"))
    return s.withColumn("kind", kind_of(F.col("language"), F.col("specifier")))


def resolved(files: DataFrame, configs: DataFrame | None = None, manifests: DataFrame | None = None, crates: DataFrame | None = None, modules: DataFrame | None = None, languages: tuple[str, ...] | None = None) -> DataFrame:
    """(repo, path, specifier, kind, classification, resolution, targets) of all specifiers of files (repo, path, text); targets ascend.

    configs (repo, ord, config_dir, base_url, include, paths of pattern and mappings): ord 0 is the root's, the first other one that includes a file goes before it.
    manifests (repo, root, text): the packages of the repository itself. crates (repo, dir), modules (repo, dir, module): folders with a manifest of that language.
    languages: only the specifiers of these; targets are looked for among all files. A classification is local-resolved, local-unresolved or external. Repeated files count once; without files there are no rows.
    """
    if languages is not None:
        read = files.where(language(F.col("path")).isin(*languages))
    else:
        read = files
    specs = cut(extracted(read).drop_duplicates(["repo", "path", "specifier"]), "specifiers")  # texts are read once, whatever the number of ways
    of = lambda *names: specs.where(F.col("language").isin(*names)).drop("language")
    ways = {
        ("typescript", "javascript"): lambda s: scripts(s, configs, None if manifests is None else package_entries(manifests, files)),
        ("python",): python, ("rust",): lambda s: rust(s, crates), ("go",): lambda s: go(s, modules),
    }
    tried = cut(reduce(DataFrame.unionByName, (way(of(*names)) for names, way in ways.items() if languages is None or set(names) & set(languages))), "candidates")
    who = ["repo", "path", "specifier", "kind"]
    settled = tried.where("size(candidates) = 0").select(*who, F.col("otherwise").alias("classification"), F.col("how").alias("resolution"), F.array().cast("array<string>").alias("targets"))
    local = F.when(F.col("top").isNull(), F.array().cast(CANDIDATE)).otherwise(candidates(F.array(F.concat("top", F.lit("/__init__.py")), F.concat("top", F.lit(".py"))), "top", 2**40, same_tier=True))
    open_ = tried.where("size(candidates) > 0").select(*who, "otherwise", "how", F.col("top").isNotNull().alias("by_top"), F.explode(F.concat("candidates", local)).alias("c"))
    open_ = open_.select(*who, "otherwise", "how", "by_top", F.col("c.tier").alias("tier"), F.col("c.how").alias("via"), F.col("c.key").alias("key"))
    met = open_.join(file_keys(files), ["repo", "key"], "left").groupBy(*who, "otherwise", "how", "by_top").agg(F.array_sort(F.collect_set(F.when(F.col("targets").isNotNull(), F.struct("tier", "via", "targets")))).alias("met"))
    is_local = ~F.col("by_top") | F.exists("met", lambda m: m["via"] == "top")
    best = F.filter("met", lambda m: (m["via"] != "top") & (m["tier"] == F.col("met")[0]["tier"]))
    got = met.withColumn("best", F.when(is_local, best).otherwise(F.filter("met", lambda m: F.lit(False))))
    hit = F.size("best") > 0
    probed = got.select(
        *who, F.when(hit, "local-resolved").when(is_local, F.col("otherwise")).otherwise("external").alias("classification"),
        F.when(hit, F.try_element_at("best", F.lit(1))["via"]).when(is_local, F.col("how")).otherwise("external-python-module").alias("resolution"),
        F.array_sort(F.flatten(F.transform("best", lambda m: m["targets"]))).alias("targets"),
    )
    return settled.unionByName(probed)


def first_nodes(imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, module, target): relative modules of imports (path, module) and the first of nodes (ord, path) that is the named file or lies below it; null if none."""
    own = imports.where(F.col("module").startswith(".")).select("path", "module").distinct()
    base = plain_path(F.concat_ws("/", folder(F.col("path")), "module"))
    wanted = own.select("path", "module", F.explode(F.array(F.concat(F.lit("a:"), base), *(F.concat(F.lit("f:"), base, F.lit(e)) for e in ("", ".js", ".ts")))).alias("key"))
    parts = F.split("path", "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.concat(F.lit("a:"), F.array_join(F.slice(parts, F.lit(1), k), "/")))).otherwise(F.array().cast("array<string>"))
    keys = nodes.select("ord", F.col("path").alias("target"), F.explode(F.concat(F.array(F.concat(F.lit("f:"), "path")), above)).alias("key"))
    keys = keys.groupBy("key").agg(F.min(F.struct("ord", "target")).alias("first"))
    return wanted.join(keys, "key", "left").groupBy("path", "module").agg(F.min("first").alias("first")).select("path", "module", F.col("first.target").alias("target"))

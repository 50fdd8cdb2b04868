"""Queries of import graphs (G01, G16, J08 to J11, X10), over sources whose texts name other sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import imports as M
from tallyloom.plans.bindings import cte, view
from tallyloom.plans.registry import query

KIT = '{"name": "kit", "exports": {"./built": {"import": "../lib/none.mjs", "default": "./d1/m36.js"}}, "main": "d1/m36.js"}'


def settings(spark):
    """The settings of the three repositories: one mapping of names, one package, one crate and one module each."""
    repos = spark.sql("select * from values ('r0'), ('r1'), ('r2') as t(repo)")
    paths = "array(named_struct('pattern', '@lib/*', 'mappings', array('gen/*', 'src/*')))"
    return {
        "configs": repos.selectExpr("repo", "0 as ord", "'.' as config_dir", "cast(null as string) as base_url", "cast(null as array<string>) as include", f"{paths} as paths"),
        "manifests": repos.select("repo", F.lit("src").alias("root"), F.lit(KIT).alias("text")),
        "crates": repos.select("repo", F.lit(".").alias("dir")),
        "modules": repos.select("repo", F.lit(".").alias("dir"), F.lit("example.com/r").alias("module")),
    }


def _script(base: str) -> str:
    """Tiers of one name each."""
    ends = ("", *M.SCRIPT_ENDINGS, *(f"/index{e}" for e in M.SCRIPT_ENDINGS))
    return ", ".join(f"[{base} || '{e}']" for e in ends)


def _d(n: int) -> str:
    return f"cast((k + {n}) % 5 as varchar)"


def _m(n: int) -> str:
    return f"cast(k + {n} as varchar)"


def _spec(name: str, kind: str, miss: str, missed: str, how: str, tiers: str) -> str:
    return f"{{specifier: {name}, kind: '{kind}', miss: {miss}, missed: '{missed}', how: '{how}', c: [{tiers}]}}"


_FAR, _NEAR, _LIB, _KIT = f"'/d' || {_d(12)} || '/m' || {_m(12)}", f"'/m' || {_m(60)}", f"'/d' || {_d(24)} || '/m' || {_m(24)}", f"'/d' || {_d(60)} || '/m' || {_m(60)}"
_UP = "(case when dir2 = '' then '' else dir2 || '/' end)"
_CRATE = f"'src/d' || {_d(12)}"
_HOME = "(case when path like '%/mod.rs' then dir2 else dir1 end)"
_NONE = "cast([] as varchar[])"
_BY = {
    "typescript, javascript": (
        _spec(f"'..' || {_FAR}", "relative", "'local-unresolved'", "relative-import", "relative-import", _script(f"dir2 || {_FAR}")),
        _spec(f"'.' || {_NEAR}", "relative", "'local-unresolved'", "relative-import", "relative-import", _script(f"dir1 || {_NEAR}")),
        _spec(f"'@lib' || {_LIB}", "non-relative", "'external'", "bare-specifier", "tsconfig-paths", f"{_script(f"'gen' || {_LIB}")}, {_script(f"'src' || {_LIB}")}"),
        _spec(f"'kit' || {_KIT}", "non-relative", "'local-unresolved'", "workspace-package", "workspace-package", _script(f"'src' || {_KIT}")),
        _spec("'kit'", "non-relative", "'local-unresolved'", "workspace-package", "workspace-package", "['src/d1/m36.ts']"),
        _spec("'kit/built'", "non-relative", "'local-unresolved'", "workspace-package", "workspace-package", f"['src/d1/m36.ts'], {_script("'src/built'")}"),
        _spec("'left-pad'", "non-relative", "'external'", "bare-specifier", "bare-specifier", _NONE),
    ),
    "python": (
        _spec(f"'..d' || {_d(12)} || '.m' || {_m(12)}", "relative", "'local-unresolved'", "python-relative", "python-relative", f"[{_UP} || 'd' || {_d(12)} || '/m' || {_m(12)} || e for e in ['.py', '/__init__.py']]"),
        _spec(f"'pkg.d' || {_d(60)} || '.m' || {_m(60)}", "absolute", "case when repo = 'r2' then 'external' else 'local-unresolved' end", "python-local-absolute", "python-local-absolute", f"case when repo = 'r2' then [] else ['pkg' || {_KIT} || e for e in ['.py', '/__init__.py']] end"),
        _spec("'os'", "absolute", "'external'", "external-python-module", "external-python-module", _NONE),
    ),
    "rust": (
        _spec(f"'crate::d' || {_d(12)} || '::m' || {_m(12)} || '::Thing'", "crate-path", "'local-unresolved'", "rust-crate-path", "rust-crate-path", ", ".join(f"[{b} || e for e in ['.rs', '/mod.rs']]" for b in (f"{_CRATE} || '/m' || {_m(12)} || '/Thing'", f"{_CRATE} || '/m' || {_m(12)}", _CRATE))),
        _spec(f"'super::m' || {_m(60)}", "super-path", "'local-unresolved'", "rust-super-path", "rust-super-path", f"[{_HOME} || {_NEAR} || e for e in ['.rs', '/mod.rs']]"),
        _spec("'super::nothing'", "super-path", "'local-unresolved'", "rust-super-path", "rust-super-path", _NONE),
        _spec(f"'mod:m' || {_m(60)}", "mod-decl", "'local-unresolved'", "rust-mod-decl", "rust-mod-decl", f"[(case when path like '%/mod.rs' then dir1 else dir1 || '/m' || {_m(0)} end) || {_NEAR} || e for e in ['.rs', '/mod.rs']]"),
        _spec("'std::fmt'", "external-use", "'external'", "external-crate", "external-crate", _NONE),
    ),
    "go": (
        _spec("'fmt'", "import", "'external'", "external-go-module", "external-go-module", _NONE),
        _spec("'example.com/r'", "import", "'local-unresolved'", "go-local-module", "go-local-module", _NONE),
        _spec("'example.com/r/svc/p' || cast(k // 60 + 1 as varchar)", "import", "'local-unresolved'", "go-local-module", "go-local-module", f"coalesce(paths, {_NONE})"),
    ),
}
_LANGUAGE = "case when path like '%.ts' then 'typescript' when path like '%.js' then 'javascript' when path like '%.py' then 'python' when path like '%.rs' then 'rust' else 'go' end"
_TRIED = f"""{cte('sources')}, folders as (select repo, regexp_replace(path, '/[^/]*$', '') as dir, list(path order by path) as paths from sources where path like '%.go' and path not like '%_test.go' group by 1, 2),
s as (select sources.*, {_LANGUAGE} as language, regexp_replace(path, '/[^/]*$', '') as dir1, case when regexp_matches(path, '/.*/') then regexp_replace(path, '/[^/]*/[^/]*$', '') else '' end as dir2, paths
  from sources left join folders on folders.repo = sources.repo and folders.dir = 'svc/p' || cast(k // 60 + 1 as varchar)),
tried as ({' union all '.join(f"select repo, path, language, k, dir1, dir2, unnest([{spec}]) as u from s where contains('{langs}', language)" for langs, specs in _BY.items() for spec in specs)})"""
_RESOLVED = f"""with {_TRIED}, tiers as (select repo, path, u.specifier as specifier, u.c as c, unnest(range(1, len(u.c) + 1)) as tier from tried),
probes as (select repo, path, specifier, tier, unnest(c[tier]) as target from tiers),
met as (select p.repo, p.path, p.specifier, tier, list(target order by target) as targets from probes p join sources f on f.repo = p.repo and f.path = p.target group by 1, 2, 3, 4),
best as (select repo, path, specifier, arg_min(targets, tier) as targets from met group by 1, 2, 3),
resolved as (select t.repo, t.path, u.specifier as specifier, u.kind as kind, t.language, case when targets is not null then 'local-resolved' else u.miss end as classification,
  case when targets is not null then u.how when u.miss = 'external' and u.missed = 'python-local-absolute' then 'external-python-module' else u.missed end as resolution, coalesce(array_to_string(targets, ','), '') as targets
  from tried t left join best b on b.repo = t.repo and b.path = t.path and b.specifier = u.specifier)
select repo, path, specifier, kind, classification, resolution, targets from resolved"""


SCRIPTS = ("typescript", "javascript")


def graph(spark, d, languages=None):
    r = M.resolved(view(spark, d, "sources").select("repo", "path", "text"), **settings(spark), languages=languages)
    return r.withColumn("targets", F.array_join("targets", ","))


@query("x10_import_specifiers", f"with {_TRIED} select repo, path, language, u.specifier as specifier, u.kind as kind from tried")
def x10(spark, d):
    return M.extracted(view(spark, d, "sources").select("repo", "path", "text"))


@query("g01_import_graph", _RESOLVED)
def g01(spark, d):
    return graph(spark, d)


@query("j08_relative_imports", f"{_RESOLVED} where resolution = 'relative-import'")
def j08(spark, d):
    return graph(spark, d, SCRIPTS).where("resolution = 'relative-import'")


@query("j09_wildcard_paths", f"{_RESOLVED} where starts_with(specifier, '@lib/')")
def j09(spark, d):
    return graph(spark, d, SCRIPTS).where("specifier like '@lib/%'")


@query("j10_modules", f"{_RESOLVED} where language in ('python', 'rust', 'go')")
def j10(spark, d):
    return graph(spark, d, ("python", "rust", "go"))


@query("j11_workspace_package", f"{_RESOLVED} where resolution = 'workspace-package'")
def j11(spark, d):
    return graph(spark, d, SCRIPTS).where("resolution = 'workspace-package'")


_G16 = f"""with {_TRIED}, w as (select repo || '/' || path as path, u.specifier as module, repo || '/' || u.c[1][1] as base from tried where u.kind = 'relative' and contains('typescript, javascript', language)),
n as (select k as ord, repo || '/' || path as target from sources)
select path, module, arg_min(target, ord) as target from w left join n on target in (base, base || '.js', base || '.ts') or starts_with(target, base || '/') group by 1, 2"""


@query("g16_import_edges", _G16)
def g16(spark, d):
    s = view(spark, d, "sources").withColumn("path", F.concat_ws("/", "repo", "path"))
    scripts = M.extracted(s).where("language in ('typescript', 'javascript')")
    return M.first_nodes(scripts.select("path", F.col("specifier").alias("module")), s.select(F.col("k").alias("ord"), "path"))

"""File trees as a data source: a scan by directories with rows for what it can't or mustn't read, and a writer of files.

`spark.read.format("tree")` gives (path, kind, bytes, content, code): kind is file, symlink, excluded-directory, excluded-path or unreadable (then code has the system's name of the error);
paths are relative to the root, with slashes. The driver lists directories breadth first only until there is one for each wanted partition; the tasks
walk what is below. Options: path; content (none, head: the first 64 KiB, or whole); skip (names of directories, comma-separated); exclude (paths below the
root, comma-separated); partitions. `df.write.format("tree")` takes (path, content) and puts each file in place by a rename, so that a task which runs
again leaves the same files. Root folders have to be visible under one path from all machines (a local disk of a local master, else a shared mount).
"""

from __future__ import annotations

import errno
import os
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

HEAD = 65_536
#: Names of directories that scans pass over, of build markers and of dependency manifests (an asterisk stands for any characters).
SKIPPED = (".git", ".hg", ".svn", "node_modules", "vendor", "dist", "build", "coverage", ".next", ".nuxt", ".cache", "target", "__pycache__")
IAC_SKIPPED = (".git", "node_modules", "dist", "build", "coverage", ".terraform", ".venv", "vendor")
BUILD_MARKERS = ("package.json", "go.mod", "Cargo.toml", "pom.xml", "build.gradle", "settings.gradle", "pyproject.toml", "requirements.txt", "composer.json", "Gemfile", "mix.exs", "*.csproj", "*.sln")
DEPENDENCY_MARKERS = BUILD_MARKERS + (
    "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lock", "bun.lockb", "go.sum", "Cargo.lock", "gradle.lockfile", "poetry.lock", "Pipfile.lock", "composer.lock", "Gemfile.lock", "mix.lock", "packages.lock.json", "Directory.Packages.props",
)
CODE = (".js", ".ts", ".py", ".go", ".java")
SHELL = (".sh", ".bash", ".zsh")
CONFIG = (".toml", ".hcl", ".tf", ".tfvars", ".conf", ".ini", ".properties", ".key", ".pem", ".pub")
CONFIG_NAMES = (".npmrc", ".yarnrc", ".env", ".htaccess", "web.config", "web.xml", "context.xml", "androidmanifest.xml")
DOCS = (".md", ".mdx", ".rst", ".adoc", ".txt")
ASSETS = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".webp", ".bmp", ".avif", ".mp4", ".mov", ".webm", ".mp3", ".wav", ".ogg", ".flac", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".css", ".scss", ".sass", ".less")


def local(path: str) -> str:
    """The plain path of file:/..., file:///... or a path."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"a tree needs a folder of the file system, not {path}")
    return path


class Walk:
    """What a scan goes by."""

    def __init__(self, options):
        self.root = os.path.abspath(local(options["path"]))
        self.skip = {x for x in options.get("skip", "").split(",") if x}
        self.exclude = {x.strip("/") for x in options.get("exclude", "").split(",") if x}
        self.content = options.get("content", "none")

    def entries(self, below: str) -> tuple[list[tuple], list[str]]:
        """Rows for what lies in a directory (a path below the root, '' for the root), and the directories in it that are to be walked."""
        rows, more = [], []
        try:
            with os.scandir(os.path.join(self.root, below)) as found:
                entries = sorted(found, key=lambda e: e.name)
        except OSError as e:
            return [(below or ".", "unreadable", None, None, errno.errorcode.get(e.errno, "UNREADABLE"))], []
        for e in entries:
            path = f"{below}/{e.name}" if below else e.name
            if e.is_symlink():
                rows.append((path, "symlink", None, None, None))
            elif e.is_dir(follow_symlinks=False):
                kind = "excluded-directory" if e.name in self.skip else "excluded-path" if path in self.exclude else None
                rows += [(path, kind, None, None, None)] if kind else []
                more += [] if kind else [path]
            elif e.is_file(follow_symlinks=False) and path not in self.exclude:
                rows.append(self.file(path))
        return rows, more

    def file(self, path: str) -> tuple:
        full = os.path.join(self.root, path)
        try:
            size, content = os.stat(full).st_size, None
            if self.content != "none":
                with open(full, "rb") as f:
                    content = f.read(HEAD if self.content == "head" else -1)
            return (path, "file", size, content, None)
        except OSError as e:
            return (path, "unreadable", None, None, errno.errorcode.get(e.errno, "UNREADABLE"))

    def all(self, below: str) -> Iterator[tuple]:
        left = [below]
        while left:
            rows, more = self.entries(left.pop())
            yield from rows
            left += reversed(more)


class _Part(InputPartition):
    """Directories to list alone (shallow) or with all below them (deep)."""

    def __init__(self, shallow: list[str], deep: list[str]):
        self.shallow, self.deep = shallow, deep


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.walk, self.wanted = Walk(options), int(options.get("partitions", "64"))

    def partitions(self):
        shallow, deep = [], [""]
        while deep and len(deep) < self.wanted and len(shallow) < self.wanted:
            at = deep.pop(0)
            shallow.append(at)
            deep += self.walk.entries(at)[1] if self.walk.content == "none" else Walk.entries(self._bare(), at)[1]
        # A directory may have any number of others: they are dealt out, so that there are no more tasks than wanted.
        n = min(self.wanted, max(len(deep), 1))
        return [_Part([d], []) for d in shallow] + [_Part([], deep[i::n]) for i in range(n) if deep]

    def _bare(self) -> Walk:
        """The same walk, which reads no contents."""
        out = object.__new__(Walk)
        out.__dict__ |= self.walk.__dict__ | {"content": "none"}
        return out

    def read(self, part):
        for d in part.shallow:
            yield from self.walk.entries(d)[0]
        for d in part.deep:
            yield from self.walk.all(d)


class _Writer(DataSourceWriter):
    def __init__(self, options):
        self.root = os.path.abspath(local(options["path"]))

    def write(self, rows):
        for r in rows:
            full = os.path.normpath(os.path.join(self.root, r["path"]))
            if not full.startswith(self.root + os.sep):
                raise ValueError(f"a path that leaves the tree: {r['path']}")
            os.makedirs(os.path.dirname(full), exist_ok=True)
            aside = f"{full}.{uuid.uuid4().hex}.aside"
            with open(aside, "wb") as f:
                f.write(r["content"] or b"")
            os.replace(aside, full)
        return WriterCommitMessage()


class TreeSource(DataSource):
    @classmethod
    def name(cls):
        return "tree"

    def schema(self):
        return "path string, kind string, bytes long, content binary, code string"

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def tree(spark: SparkSession, root: str, content: str = "none", skip: tuple[str, ...] = SKIPPED, exclude: tuple[str, ...] = (), partitions: int | None = None) -> DataFrame:
    """What lies below root, as the module says; in twice as many partitions as tasks run at once, if nothing else is said."""
    partitions = partitions or 2 * spark.sparkContext.defaultParallelism
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").option("path", root).option("content", content).option("skip", ",".join(skip)).option("exclude", ",".join(exclude)).option("partitions", str(partitions)).load()


def write_tree(files: DataFrame, root: str) -> None:
    """Writes files (path, content binary) below root. Of rows with one path the last to be written stays."""
    files.sparkSession.dataSource.register(TreeSource)
    files.select("path", "content").write.format("tree").option("path", root).mode("append").save()


def base_of(path: str = "path") -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def extension(path: str = "path") -> Column:
    """From the last dot of the name on, in lower case; none for a name that only begins with a dot."""
    return F.lower(F.regexp_extract(base_of(path), r"(?<=.)(\.[^.]*)\z", 1))


def named(markers: tuple[str, ...], path: str = "path") -> Column:
    """Whether the file's name is one of the markers, in which an asterisk stands for any characters."""
    exact = [m for m in markers if "*" not in m]
    wild = ["".join(".*" if c == "*" else c if c.isalnum() or c in "_-" else "\\" + c for c in m) for m in markers if "*" in m]
    base = base_of(path)
    return base.isin(*exact) | (base.rlike(rf"\A(?:{'|'.join(wild)})\z") if wild else F.lit(False))


def source_files(entries: DataFrame, extensions: tuple[str, ...] = CODE) -> DataFrame:
    """path of each file with such an extension."""
    return entries.where((F.col("kind") == "file") & extension().isin(*extensions)).select("path").distinct()


def dependency_files(entries: DataFrame, markers: tuple[str, ...] = DEPENDENCY_MARKERS) -> DataFrame:
    """path of each dependency manifest."""
    return entries.where((F.col("kind") == "file") & named(markers)).select("path").distinct()


def scan_errors(entries: DataFrame) -> DataFrame:
    """path and code of what couldn't be read."""
    return entries.where("kind = 'unreadable'").select("path", "code")


def inventory(entries: DataFrame, extensions: tuple[str, ...] = CODE, markers: tuple[str, ...] = DEPENDENCY_MARKERS) -> DataFrame:
    """path, classification and disposition of every file. What is a source or a dependency manifest stays one, then resources that bear on security count, by narrow rules of
    path and name, then tests, documentation and assets."""
    low, ext, path = F.lower(base_of()), extension(), F.col("path")
    within = lambda name: path.rlike(rf"(?:^|/){name}/")
    json = ext == ".json"
    resource = (
        low.rlike(r"\A(?:dockerfile|containerfile)(?:\..+)?\z") | low.rlike(r"\A(?:docker-)?compose(?:\..+)?\.ya?ml\z") | ext.isin(*SHELL, *CONFIG) | low.rlike(r"\.env\.(?:example|sample)\z") | low.isin(*CONFIG_NAMES) | low.rlike(r"\A\.env\.[\w.-]+\z")
        | (json & low.rlike(r"\A(?:tsconfig(?:\.[\w-]+)?|jsconfig|angular|app|appsettings(?:\.[\w-]+)?|firebase|\.devcontainer|devcontainer)\.json\z"))
        | (json & ((low == "tauri.conf.json") | (within("src-tauri") & within("capabilities")) | path.rlike(r"(?:^|/)supabase/(?:config\.json\z|storage_buckets/(?!.*(?:^|/)supabase/))") | low.isin("plugin.json", "manifest.json")))
    )
    pipelines = (within(r"\.github") & within("workflows") & low.rlike(r"\.ya?ml\z")) | low.isin(".gitlab-ci.yml", "jenkinsfile", "azure-pipelines.yml") | (within(r"\.circleci") & (low == "config.yml"))
    prompts = (ext == ".md") & path.rlike(r"(?:^|/)(?:agents|skills|commands|methods)/")
    test = path.rlike(r"(?i)(?:^|/)(?:__tests__|__mocks__|__fixtures__|__snapshots__|tests?|specs?)(?:/|\z)") | base_of().rlike(r"(?i)\.(?:test|spec)\.[^./]+\z|(?:^|[_-])test_[^/]+\.py\z|_test\.(?:py|go)\z")
    kind = (
        F.when(named(markers), "dependency-manifest").when(ext.isin(*extensions), "source").when(resource, "security-resource").when(json & (low == "registry.json"), "generated-runtime-resource").when(pipelines, "security-resource")
        .when(prompts, "runtime-prompt").when(test, "test").when(ext.isin(*DOCS), "documentation").when(ext.isin(*ASSETS), "asset").otherwise("other")
    )
    use = F.col("classification")
    disposition = (
        F.when(use == "dependency-manifest", "analyze-dependency").when(use == "source", "analyze-source").when(use.isin("security-resource", "generated-runtime-resource", "runtime-prompt"), "analyze-security-resource").otherwise("inventory-only")
    )
    return entries.where("kind = 'file'").select("path", kind.alias("classification")).distinct().withColumn("disposition", disposition)


def iac_class(path: Column, head: Column) -> Column:
    """What kind of infrastructure code a file is, by its path and first 64 KiB; null if none."""
    low = F.lower(path)
    name = F.regexp_extract(low, r"([^/]*)\z", 1)
    yaml, has = name.rlike(r"\.ya?ml\z"), lambda p: head.rlike(p)
    return (
        F.when((name == "dockerfile") | name.endswith(".dockerfile"), "container")
        .when(low.startswith(".github/workflows/") | name.isin(".gitlab-ci.yml", "jenkinsfile"), "ci-cd")
        .when(name.rlike(r"\.(?:tf|tfvars|hcl)\z") | name.rlike(r"\.tf(?:vars)?\.json\z"), "terraform")
        .when(name.endswith(".bicep"), "bicep")
        .when(name.rlike(r"\Apulumi(?:\.[^.]+)?\.ya?ml\z"), "pulumi")
        .when(low.rlike("cloudformation|cloud-formation|sam-template") | has(r"(?m)^AWSTemplateFormatVersion\s*:") | has(r"(?m)^\s*Type\s*:\s*AWS::") | has(r'"AWSTemplateFormatVersion"\s*:') | has(r'"Type"\s*:\s*"AWS::'), "cloudformation")
        .when((name == "chart.yaml") | (low.contains("/templates/") & yaml), "helm")
        .when(yaml & (low.rlike(r"(?:^|/)(?:k8s|kubernetes|manifests)(?:/|\z)") | (has(r"(?m)^apiVersion\s*:") & has(r"(?m)^kind\s*:"))), "kubernetes")
        .when(name.endswith(".json") & has(r'"apiVersion"\s*:') & has(r'"kind"\s*:'), "kubernetes")
        .when(yaml & (low.rlike(r"(?:^|/)(?:playbooks?|roles/[^/]+/(?:tasks|handlers))(?:/|\z)") | (has(r"(?m)^\s*-?\s*hosts\s*:") & has(r"(?m)^\s*tasks\s*:"))), "ansible")
        .when(name.rlike(r"\A(?:docker-)?compose(?:\.[^.]+)?\.ya?ml\z") | name.isin("procfile", "fly.toml", "render.yaml"), "deployment")
        .when(low.rlike(r"vault|sops|sealed-?secret|external-?secret"), "secret-management")
    )


def iac_manifest(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, excluded, coverage): path, classification, bytes and sha256 of infrastructure files; path and reason (symlink, excluded-directory) of what was passed over; files of each
    classification. Whole contents are read, since the digest is of them; the rules see the first 64 KiB. A directory that can't be read stays a row of tree()."""
    found = tree(spark, root, "whole", IAC_SKIPPED, exclude)
    head = F.expr(f"cast(substring(content, 1, {HEAD}) as string)")
    files = found.where("kind = 'file'").select("path", iac_class(F.col("path"), head).alias("classification"), "bytes", F.sha2("content", 256).alias("sha256")).where("classification is not null")
    passed = found.where("kind in ('symlink', 'excluded-directory', 'excluded-path')").select("path", F.when(F.col("kind") == "symlink", "symlink").otherwise("excluded-directory").alias("reason"))
    return files, passed, files.groupBy("classification").agg(F.count("*").alias("n"))


def read_structured(entries: DataFrame) -> DataFrame:
    """path, format, value (JSON text) and error of each file of entries with contents: .json as JSON, all else as YAML, of which JSON is a part.

    A bad document is a row with its error, never an exception; without a YAML reader on the workers other files get one too. Keys of YAML maps become
    strings, dates their text; a document that isn't UTF-8 is bad.
    """

    def run(batches):
        import datetime
        import json

        import pyarrow as pa

        try:
            import yaml
        except ImportError:
            yaml = None

        def plain(v):
            if isinstance(v, dict):
                return {str(k): plain(x) for k, x in v.items()}
            if isinstance(v, (list, tuple, set)):
                return [plain(x) for x in v]
            return v if v is None or isinstance(v, (str, int, float, bool)) else v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else str(v)

        for b in batches:
            out = []
            for path, content, is_json in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                kind = "json" if is_json else "yaml"
                if not is_json and yaml is None:
                    out.append((path, kind, None, "no-reader"))
                    continue
                try:
                    text = (content or b"").decode("utf-8")
                    value = json.loads(text) if is_json else plain(yaml.safe_load(text))
                    out.append((path, kind, json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False), None))
                except (ValueError, RecursionError) if yaml is None else (ValueError, RecursionError, yaml.YAMLError) as e:
                    out.append((path, kind, None, type(e).__name__))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.string())] * 4, ["path", "format", "value", "error"])

    files = entries.where("kind = 'file'").select("path", "content", (extension() == ".json").alias("is_json"))
    return files.mapInArrow(run, "path string, format string, value string, error string")

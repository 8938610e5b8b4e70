"""Projects from listed files: roots, top-level folders, scans, deletions, and views of a code index."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

# Names that mark a project, folders that hold no code of its own, suffixes of code.
VCS = [".git", ".hg", ".svn"]
MANIFESTS = [
    "package.json", "pyproject.toml", "setup.py", "setup.cfg", "Cargo.toml", "go.mod", "pom.xml", "build.gradle", "build.gradle.kts", "Gemfile",
    "composer.json", "mix.exs", "pubspec.yaml", "CMakeLists.txt", "Makefile",
]
MANIFEST_SUFFIXES = ["csproj", "sln"]
FRAMEWORKS = [
    "next.config.js", "vite.config.js", "webpack.config.js", "tsconfig.json", "angular.json", "vue.config.js", ".eslintrc", ".eslintrc.json",
    ".eslintrc.js", "jest.config.js", "pytest.ini", "phpunit.xml",
]
DEPENDENCY_FOLDERS = ["node_modules", "vendor", ".venv", "venv", ".pnpm-store", ".yarn", ".npm", ".cargo"]
GENERATED_FOLDERS = ["dist", "build", "out", "target", "coverage", ".cache", ".parcel-cache", ".next", ".nuxt", ".svelte-kit"]
NOISE_FOLDERS = [
    ".git", ".hg", ".svn", "node_modules", "vendor", ".venv", "venv", "__pycache__", ".pytest_cache", ".mypy_cache", ".tox", ".idea", ".vscode",
    "dist", "build", "out", "target", "coverage", ".pnpm-store", ".yarn", ".npm", ".turbo",
]
CODE_SUFFIXES = ["py", "js", "ts", "tsx", "jsx", "java", "go", "rs", "c", "cpp", "cc", "cxx", "h", "hpp", "cs", "php", "rb", "swift", "kt"]


def folder(path: Column) -> Column:
    """The folder of a path; that of a path without a slash is the empty one."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(of: Column) -> Column:
    """A folder and those above it, the deepest first, up to the empty one."""
    parts = F.filter(F.split(of, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def markers(files: DataFrame) -> DataFrame:
    """(root, place): folders that hold a marker, by its kind: 0 version control, 1 manifest, 2 framework."""
    name, parts = F.element_at(F.split("path", "/"), -1), F.split(F.col("path"), "/")
    kind = F.when(name.isin(MANIFESTS) | T.suffix(F.col("path")).isin(MANIFEST_SUFFIXES), 1).when(name.isin(FRAMEWORKS), 2)
    plain = files.select(folder(F.col("path")).alias("root"), kind.alias("place")).where("place is not null")
    # A version-control folder is seen by the files in it, or, as a worktree's, is a file itself.
    vcs = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: F.get(parts, i - 1).isin(VCS))
    held = files.select(F.explode(F.transform(vcs, lambda i: F.array_join(F.slice(parts, 1, i - 1), "/"))).alias("root"), F.lit(0).alias("place"))
    return plain.unionByName(held).distinct()


def project_roots(files: DataFrame) -> DataFrame:
    """(folder, root, method) of each folder that holds files: the nearest folder at or above it with a version-control marker, or else a
    manifest, or else a framework's file, or else itself. Paths are relative, so the listing's own folder is the empty one."""
    folders = files.select(folder(F.col("path")).alias("folder")).distinct()
    up = folders.select("folder", F.posexplode(ancestors(F.col("folder"))).alias("steps", "root"))
    best = up.join(markers(files), "root").groupBy("folder").agg(F.min(F.struct("place", "steps", "root")).alias("best"))
    out = folders.join(best, "folder", "left")
    method = F.when(F.col("best.place") == 0, "vcs").when(F.col("best.place") == 1, "manifest").when(F.col("best.place") == 2, "framework").otherwise("fallback")
    return out.select("folder", F.coalesce("best.root", "folder").alias("root"), method.alias("method"))


def nested_roots(files: DataFrame, least: int = 3) -> DataFrame:
    """(root, has_marker, code_files) of the outermost folders below the listing's own, outside noise folders, that directly hold a
    manifest or a ``.git`` file, or at least ``least`` files of code. All of them are given."""
    parts = F.split(F.col("path"), "/")
    name, noise = F.element_at(parts, -1), F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*[F.lit(x) for x in NOISE_FOLDERS]))
    marked = name.isin([".git", *[m for m in MANIFESTS if m != "setup.cfg"]])
    each = files.where(~noise).groupBy(folder(F.col("path")).alias("root")).agg(F.bool_or(marked).alias("has_marker"), F.count_if(T.suffix(F.col("path")).isin(CODE_SUFFIXES)).alias("code_files"))
    likely = each.where((F.col("root") != "") & (F.col("has_marker") | (F.col("code_files") >= least)))
    above = likely.select("root", F.explode(F.slice(ancestors(F.col("root")), 2, F.size(F.split(F.col("root"), "/")))).alias("above"))
    inner = above.join(likely.select(F.col("root").alias("above")), "above", "left_semi").select("root").distinct()
    return likely.join(inner, "root", "left_anti")


def top_folders(files: DataFrame) -> DataFrame:
    """(category, folders, n) of the listing's own folders."""
    name = F.get(F.split("path", "/"), F.lit(0))
    low = F.lower("name")
    category = F.when(low.isin(DEPENDENCY_FOLDERS), "dependency_code").when(low.isin(GENERATED_FOLDERS), "generated_code").when(low.startswith("."), "configuration").otherwise("application_code")
    out = files.where(F.contains("path", F.lit("/"))).select(name.alias("name")).distinct()
    return out.groupBy(category.alias("category")).agg(F.array_sort(F.collect_list("name")).alias("folders"), F.count("*").alias("n"))


def listed(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, most: int | None = None) -> DataFrame:
    """files of these suffixes (all, if none are given) whose path matches none of the globs; with ``most``, the first by path in lower case."""
    keep = T.suffix(F.col("path")).isin([s.lower().removeprefix(".") for s in include]) if include else F.lit(True)
    for glob in exclude or []:
        keep = keep & ~F.col("path").rlike("^" + T.glob_regex(glob))
    out = files.where(keep)
    return out if most is None or most < 0 else out.orderBy(F.lower("path"), "path").limit(most)


def mime(path: Column) -> Column:
    """The media type by suffix, for the suffixes that the engine knows; others are octet streams. By Python's own list, not the machine's,
    so that it is the same everywhere."""
    types = mimetypes.MimeTypes()
    known = {s: types.guess_type(f"x.{s}")[0] for suffixes in [*T.MODALITY_SUFFIXES.values(), T.LANGUAGES] for s in suffixes}
    pairs = [F.lit(x) for s, kind in sorted(known.items()) if kind for x in (s, kind)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), T.suffix(path)), F.lit("application/octet-stream"))


def scan_actions(stored: DataFrame, found: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(path, action): insert, update or skip what a scan found, by its time of change; purge what it no longer finds."""
    both = stored.select("path", F.col("mtime").alias("old")).join(found.select("path", F.col("mtime").alias("new")), "path", "full")
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "purge").when(F.abs(F.col("new") - F.col("old")) < tolerance, "skip").otherwise("update")
    return both.select("path", action.alias("action"))


def after_events(stored: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What stays of stored rows (path, ...) after file events (path, change, ts), and the tombstones (path, ts) of paths whose last
    event is a deletion; of events at one time, a deletion comes first."""
    last = events.groupBy("path").agg(F.max(F.struct("ts", (F.col("change") != "deleted").alias("lives"))).alias("last"))
    gone = last.where("not last.lives").select("path", F.col("last.ts").alias("ts"))
    return stored.join(gone.select("path"), "path", "left_anti"), gone


def lines_of(text: Column) -> Column:
    """A text's lines, at every line boundary that Unicode knows; a final one ends the last line."""
    lines = F.split(F.regexp_replace(text, "\r\n|[\r\x0b\f\x1c-\x1e\x85  ]", "\n"), "\n")
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def line_range(text: Column, first: Column, last: Column) -> Column:
    """Lines first to last of a text, from 1, both included, clamped to those there are; nothing if none is left."""
    lines = lines_of(text)
    begin, end = F.greatest(first, F.lit(1)), F.least(last, F.size(lines))
    return F.array_join(F.slice(lines, begin.cast("int"), F.greatest(end - begin + 1, F.lit(0)).cast("int")), "\n")


def modules(facts: DataFrame) -> DataFrame:
    """(path, symbols, imports): each file's symbols as kind:name:line in order of lines, and its distinct imports, from (path, kind, name, line)."""
    imported = F.col("kind").isin("import", "internal")
    by_line = F.array_sort(F.collect_list(F.when(~imported, F.struct("line", "name", "kind"))))
    imports = F.array_sort(F.collect_set(F.when(imported, F.col("name"))))
    out = facts.groupBy("path").agg(by_line.alias("s"), imports.alias("imports"))
    return out.select("path", F.transform("s", lambda s: F.concat_ws(":", s["kind"], s["name"], s["line"])).alias("symbols"), "imports")


def languages(files: DataFrame) -> DataFrame:
    """(language, files, lines) of (path, content), for a repository's summary."""
    lines = F.when(F.col("content") != "", F.octet_length("content") - F.octet_length(F.replace("content", F.lit("\n"), F.lit(""))) + 1).otherwise(0)
    return files.groupBy(T.language(F.col("path")).alias("language")).agg(F.count("*").alias("files"), F.sum(lines).alias("lines"))

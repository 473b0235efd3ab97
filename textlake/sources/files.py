"""Trees of source files, catalogs and benchmark folders as DataFrames."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..session import shared_dir

# Folders that hold no sources.
SKIP_DIRS = [
    ".git",
    "node_modules",
    "target",
    "venv",
    ".venv",
    "__pycache__",
    ".pytest_cache",
    ".mypy_cache",
    "build",
    "dist",
    "__eacache__",
    ".cargo",
    ".idea",
    ".vscode",
]

CATALOG_SCHEMA = "struct<entries: array<struct<name: string, category: string, signature: string, description: string>>>"
HISTORY_SCHEMA = (
    "array<struct<iteration: bigint, accepted: boolean, correct: boolean, time_us: double, hypothesis: string>>"
)


_LISTED = "root_no int, root string, path string, name string, is_dir boolean, length bigint, modified timestamp, error string"


def _file_system(path: str):
    """File system and path in it, in a task; local paths need no scheme."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", path))


def list_folder(folder: str) -> list[tuple]:
    """(path, name, is_dir, length, modified) of what stands in a folder; nothing if there is no such folder."""
    from pyarrow import fs

    system, inside = _file_system(folder)
    base = folder.rstrip("/")
    found = system.get_file_info(fs.FileSelector(inside, allow_not_found=True))
    return [(f"{base}/{x.base_name}", x.base_name, x.type == fs.FileType.Directory, x.size or 0, x.mtime) for x in found]


def read_file(path: str) -> bytes:
    system, inside = _file_system(path)
    with system.open_input_stream(inside) as f:
        return f.read()


def _children(batches):
    """What stands in each folder of (root_no, root, path), or a row with the error of a folder that can't be listed; a
    folder that is missing has nothing."""
    import pandas

    columns = [c.split()[0] for c in _LISTED.split(", ")]
    for batch in batches:
        for number, root, folder in zip(batch["root_no"], batch["root"], batch["path"], strict=True):
            try:
                rows = [(number, root, *found, None) for found in list_folder(folder)]
            except OSError as e:
                rows = [(number, root, folder, None, False, 0, None, str(e))]
            for i in range(0, len(rows), 10_000):
                yield pandas.DataFrame(rows[i : i + 10_000], columns=columns)


def _list_folders(folders: DataFrame) -> DataFrame:
    """The direct children of folders (root_no, root, path); folders are spread over the tasks."""
    spread = folders.repartition(F.xxhash64("path"))
    return spread.select("root_no", "root", "path").mapInPandas(_children, _LISTED)


def _roots(spark: SparkSession, roots) -> DataFrame:
    schema = "root_no int, root string, path string"
    return spark.createDataFrame([(n, r, r.rstrip("/") or "/") for n, r in enumerate(roots)], schema)


def _contents(batches):
    """Adds content, or the error of a file that can't be read and whether it is missing; a file at a time."""
    for batch in batches:
        for i in range(len(batch)):
            one = batch.iloc[i : i + 1]
            content, error, missing = None, None, False
            try:
                content = read_file(one["path"].iloc[0])
            except OSError as e:
                error, missing = str(e), isinstance(e, FileNotFoundError)
            yield one.assign(content=[content], error=[error], missing=[missing])


def read_files(listed: DataFrame) -> DataFrame:
    """Adds content, error (one of the two is NULL) and missing to listed files. Contents are read in the tasks."""
    plain = listed.drop("content", "error", "missing")
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    return plain.repartition(F.xxhash64("path")).mapInPandas(_contents, f"{ddl}, content binary, error string, missing boolean")


def without_errors(rows: DataFrame, on_error: str) -> DataFrame:
    """Rows without an error. A row with one fails the query that reads it (``raise``) or is left out (``skip``)."""
    if on_error not in ("raise", "skip"):
        raise ValueError(f"on_error is raise or skip, not {on_error}")
    if on_error == "skip":
        return rows.where("error IS NULL")
    # A condition, so that it is worked out whatever columns are asked for, and the only one: Spark would put a plain one
    # in front of it, which leaves nothing to raise.
    failed = F.raise_error(F.concat("path", F.lit(": "), "error")).cast("boolean")
    return rows.where(F.when(F.col("error").isNotNull(), failed).otherwise(True))


def is_source(below: Column, suffix=".ea", skip_dirs=SKIP_DIRS) -> Column:
    """Whether a path below a root is a source: its suffix fits and no folder on the way is one to skip."""
    folders = F.slice(F.split(below, "/"), F.lit(1), F.size(F.split(below, "/")) - 1)
    return F.endswith(below, F.lit(suffix)) & ~F.arrays_overlap(folders, F.array(*map(F.lit, skip_dirs)))


def _walk(spark: SparkSession, roots, suffix, skip_dirs) -> DataFrame:
    """Files with the suffix below ``roots``, and folders that can't be listed, by their error."""
    folders, levels = _roots(spark, roots), []
    while True:
        path = shared_dir(spark, "listing")
        _list_folders(folders).write.parquet(path)
        level = spark.read.schema(_LISTED).parquet(path)
        levels.append(level.where((~F.col("is_dir") & F.endswith("name", F.lit(suffix))) | F.col("error").isNotNull()))
        folders = level.where(F.col("is_dir") & ~F.col("name").isin(list(skip_dirs)))
        if folders.isEmpty():
            return reduce(DataFrame.unionByName, levels).select("root_no", "root", "path", "length", "modified", "error")


def list_source_tree(spark: SparkSession, roots, suffix=".ea", skip_dirs=SKIP_DIRS, on_error="raise") -> DataFrame:
    """(root_no, root, path, length, modified) of all sources below ``roots``, whatever their names begin with.

    Folders are rows: a level of all trees is listed in the tasks and written to the shared folder, and gives the
    folders of the next one. Folders to skip are not listed. Only the number of folders left comes to the driver. A
    folder that can't be listed fails the query that reads the list; with ``on_error="skip"`` what is below it is
    left out.
    """
    return without_errors(_walk(spark, roots, suffix, skip_dirs), on_error).drop("error")


def load_source_tree(spark: SparkSession, roots, suffix=".ea", skip_dirs=SKIP_DIRS, skipped=False, on_error="raise") -> DataFrame:
    """(root_no, root, path, content, length, modified) of all sources below ``roots``.

    Folders named in ``skip_dirs`` are left out at any depth below a root. A missing root gives no rows, a file that
    vanishes after it was listed none, and a file below two roots comes once for each. A folder that can't be listed
    or a file that can't be read fails the query; with ``on_error="skip"`` they are left out. With ``skipped`` all
    these, the vanished ones too, are returned instead: (root_no, root, path, error). Sort by (root_no, path).
    """
    walked = _walk(spark, roots, suffix, skip_dirs)
    read = read_files(walked.where("error IS NULL"))
    errors = ["root_no", "root", "path", "error"]
    if skipped:
        return walked.where("error IS NOT NULL").select(errors).unionByName(read.where("error IS NOT NULL").select(errors))
    # Folders with an error have no content, but have to be met by whoever reads the files.
    folders = walked.where("error IS NOT NULL").withColumn("content", F.lit(None).cast("binary"))
    rows = read.where("NOT missing").drop("missing").unionByName(folders)
    return without_errors(rows, on_error).select("root_no", "root", "path", "content", "length", "modified")


def load_scrape_sources(spark: SparkSession, roots, on_error="raise") -> tuple[DataFrame, DataFrame]:
    """(path, text) of ``src/typeck/intrinsics_*.rs`` and of ``src/typeck/intrinsics.rs`` below each project.

    The former document signatures, the latter dispatches names; a project without the folder has neither. What can't
    be listed or read fails the query unless ``on_error`` is ``skip``.
    """
    folders = _roots(spark, [f"{r.rstrip('/')}/src/typeck" for r in roots])
    listed = without_errors(_list_folders(folders), on_error).where("NOT is_dir AND name LIKE 'intrinsics%.rs'")
    read = without_errors(read_files(listed).where("NOT missing"), on_error).select("name", "path", _text("content").alias("text"))
    documented = read.where(F.startswith("name", F.lit("intrinsics_"))).select("path", "text")
    return documented, read.where("name = 'intrinsics.rs'").select("path", "text")


def catalog_entries(texts: DataFrame, ids, value="value") -> DataFrame:
    """(ids, ordinal, name, category, signature, description) of catalog files, in file order."""
    entries = F.from_json(value, CATALOG_SCHEMA, {"mode": "FAILFAST"})["entries"]
    return texts.select(*ids, F.posexplode(entries).alias("pos", "e")).select(
        *ids, F.col("pos").cast("bigint").alias("ordinal"), "e.*"
    )


def load_reference_catalog(spark: SparkSession, path) -> DataFrame:
    """(ordinal, name, category, signature, description) in file order."""
    return catalog_entries(spark.read.text(path, wholetext=True), [])


def history_iterations(texts: DataFrame, ids, value="value") -> DataFrame:
    """(ids, pos, iteration, accepted, correct, time_us, hypothesis) of history files."""
    rows = F.from_json(value, HISTORY_SCHEMA, {"mode": "FAILFAST"})
    return texts.select(*ids, F.posexplode(rows).alias("pos", "h")).select(
        *ids, F.col("pos").cast("bigint").alias("pos"), "h.*"
    )


def _text(content) -> Column:
    """The text of a file's bytes; broken sequences become U+FFFD."""
    return F.make_valid_utf8(F.col(content).cast("string"))


def _folders(spark: SparkSession, base: str, on_error: str) -> DataFrame:
    return without_errors(_list_folders(_roots(spark, [base])), on_error).where("is_dir")


def _whole_files(spark: SparkSession, base: str, leaf: str, on_error: str) -> DataFrame:
    """(name, value) of every ``<base>/<name>/<leaf>``; no rows if there is no ``base``."""
    paths = _folders(spark, base, on_error).select("name", F.concat("path", F.lit(f"/{leaf}")).alias("path"))
    found = without_errors(read_files(paths).where("NOT missing"), on_error)
    return found.select("name", _text("content").alias("value"))


def benchmark_errors(spark: SparkSession, base) -> DataFrame:
    """(path, error) of what can't be read below ``base``: the folder itself, histories and strategy notes. A benchmark
    without one of these files is no error."""
    listed = _list_folders(_roots(spark, [base]))
    leaves = F.explode(F.array(F.lit("history.json"), F.lit("program.md"))).alias("leaf")
    wanted = listed.where("is_dir").select("path", leaves).select(F.concat_ws("/", "path", "leaf").alias("path"))
    read = read_files(wanted).where("error IS NOT NULL AND NOT missing").select("path", "error")
    return listed.where("error IS NOT NULL").select("path", "error").unionByName(read)


def list_benchmarks(spark: SparkSession, base, on_error="raise") -> DataFrame:
    """Names of all folders below ``base``, also those without a history."""
    return _folders(spark, base, on_error).select("name")


def load_histories(spark: SparkSession, base, on_error="raise") -> DataFrame:
    """One row per iteration of every ``<base>/<name>/history.json``, with its place. A file that can't be read fails the
    query unless ``on_error`` is ``skip``; ``benchmark_errors`` lists them."""
    return history_iterations(_whole_files(spark, base, "history.json", on_error), ["name"])


def strategy_section(text) -> Column:
    """Lines below the first heading that names a strategy, up to the next other heading."""
    lines = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")
    heading = lambda x: F.startswith(x, F.lit("#"))
    named = lambda x: heading(x) & F.contains(F.lower(x), F.lit("strategy"))
    numbered = F.transform(lines, lambda x, i: F.struct(x.alias("line"), i.alias("i")))
    start = F.array_min(F.transform(F.filter(numbered, lambda s: named(s["line"])), lambda s: s["i"]))
    # The arrays are bound as lambda arguments, so each is made once per text.
    section = F.transform(
        F.array(F.struct(numbered.alias("all"), start.alias("start"))),
        lambda t: F.filter(t["all"], lambda s: s["i"] > t["start"]),
    )[0]
    cut = F.transform(
        F.array(section),
        lambda rest: F.struct(
            rest.alias("rest"),
            F.coalesce(
                F.array_min(
                    F.transform(
                        F.filter(rest, lambda s: heading(s["line"]) & ~named(s["line"])), lambda s: s["i"]
                    )
                ),
                F.lit(2**31 - 1),
            ).alias("end"),
        ),
    )[0]
    kept = F.transform(
        F.array(cut),
        lambda c: F.filter(c["rest"], lambda s: (s["i"] < c["end"]) & ~named(s["line"])),
    )[0]
    return F.when(F.size(kept) > 0, strip(F.array_join(F.transform(kept, lambda s: s["line"]), "\n")))


def load_strategy_notes(spark: SparkSession, base, on_error="raise") -> DataFrame:
    """(name, strategy) from ``<base>/<name>/program.md``; NULL without such a section. Errors are as for histories."""
    whole = _whole_files(spark, base, "program.md", on_error)
    return whole.select("name", strategy_section(F.col("value")).alias("strategy"))

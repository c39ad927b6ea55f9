"""Listing, reading and writing files on the executors.

Spark's file sources list on the driver: every file name of a corpus passes it.  Here the names stay in
DataFrames.  Folders are expanded level by level: the rows of a level (requested paths first, then folders) are spread over
the tasks, each task lists its folders, and what it finds is written to the shared scratch folder; the folders among it are
the next level.  The driver sees how many there are, never their names.  A folder is listed by one task, as a stream.

The tasks use ``pyarrow.fs`` (local and shared mounts, S3, GCS, HDFS where its client library is installed).  Where that
cannot reach a store, :func:`reachable` says so and callers use Spark's own reader.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.strategies import materialize, spread, widened

# rest: what is left of a pattern below the folder; down: how many more levels are asked for (-1: all)
LEVEL = "path string, rest string, down int"
FOUND = "path string, modificationTime timestamp, length long, kind string, rest string, down int"
ROWS, READ_BYTES = 5000, 32 << 20
MAGIC = re.compile(r"[*?\[{]")


def glob_regex(pattern: str) -> str:
    """The regular expression of a Hadoop-style pattern for one name: ``* ? [a-z] [^a] {a,b}`` and backslash."""
    out, depth, k = [], 0, 0
    while k < len(pattern):
        c = pattern[k]
        k += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and "]" in pattern[k + 1:]:
            end = pattern.index("]", k + 1)
            body = pattern[k:end]
            out.append("[" + ("^" + body[1:] if body[0] in "^!" else body).replace("\\", "\\\\") + "]")
            k = end + 1
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and k < len(pattern):
            out.append(re.escape(pattern[k]))
            k += 1
        else:
            out.append(re.escape(c))
    return "".join(out) + ")" * depth


def hidden(name: str) -> bool:
    """Names that Spark's file sources pass over."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _file_system(path: str):
    """(file system, path in it, what its paths begin with in the results)."""
    from pyarrow import fs

    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) and not path.startswith("file:"):
        system, inner = fs.FileSystem.from_uri(path)
        return system, inner, path[:len(path) - len(inner)] if path.endswith(inner) else path.split("://", 1)[0] + "://"
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return fs.LocalFileSystem(), path, "file:"


def _time(info):
    """The modification time in milliseconds, as Spark's sources have it."""
    return info.mtime and info.mtime.replace(microsecond=info.mtime.microsecond // 1000 * 1000)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.string(), pa.string(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                      names=["path", "modificationTime", "length", "kind", "rest", "down"])


def reachable(spark: SparkSession, path: str) -> bool:
    """Whether a task can look at ``path`` (a file, a folder or a pattern; it need not exist)."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            try:
                system, inner, _ = _file_system(path)
                system.get_file_info(MAGIC.split(inner)[0] or "/")
                yield b
            except Exception:  # noqa: BLE001 - no client library, no such scheme, no access: all mean Spark's reader
                pass

    return not spark.range(1).mapInArrow(look, "id long").isEmpty()


def _expand(name_filter: str | None):
    match = re.compile(glob_regex(name_filter)).fullmatch if name_filter else lambda name: True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        out: list[tuple] = []
        for b in batches:
            for path, rest, down in zip(*[b.column(i).to_pylist() for i in range(3)]):
                system, inner, top = _file_system(path)
                info = system.get_file_info(inner)
                if info.type == fs.FileType.NotFound:
                    out.append((path, None, None, "missing", rest, down))
                elif info.type == fs.FileType.File:
                    if not rest and match(info.base_name):
                        out.append((top + info.path, _time(info), info.size, "file", None, 0))
                else:
                    segment, _, more = rest.partition("/")
                    wanted = re.compile(glob_regex(segment)).fullmatch if segment else None
                    for x in system.get_file_info(fs.FileSelector(inner)):
                        name = x.base_name
                        if hidden(name) or wanted and not wanted(name):
                            continue
                        if x.type == fs.FileType.Directory:
                            if wanted or down:
                                out.append((top + x.path, None, None, "folder", more, -1 if wanted and not more else down if wanted else down - (down > 0)))
                        elif not more and match(name):
                            out.append((top + x.path, _time(x), x.size, "file", None, 0))
                        if len(out) >= ROWS:
                            yield _batch(out)
                            out = []
        if out:
            yield _batch(out)

    return run


def list_files(paths: DataFrame, glob: str | None = None, recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """(files: path, modificationTime, length; missing: path) of the requested ``paths`` (column ``path``).

    A path is a file, a folder, or a pattern of either (whose folders are listed wholly, as Spark does); ``glob``
    filters the names of files.  A file that several requests name is listed once.
    """
    whole = F.regexp_replace("path", r"/[^/]*[*?\[{].*$", "")
    level = paths.select(F.when(whole == F.col("path"), F.col("path")).when(whole == "", "/").otherwise(whole).alias("path"),
                         F.when(whole == F.col("path"), "").otherwise(F.expr("substring(path, length(regexp_replace(path, '/[^/]*[*?\\\\[{].*$', '')) + 2)")).alias("rest"),
                         F.lit(-1 if recursive else 0).alias("down")).distinct()
    found = []
    while not level.isEmpty():
        rows = materialize(spread(level, "path").mapInArrow(_expand(glob), FOUND), "listing")
        found.append(rows)
        level = rows.where("kind = 'folder'").select("path", "rest", "down").distinct()
    if not found:
        found = [paths.sparkSession.createDataFrame([], FOUND)]
    rows = reduce(DataFrame.unionByName, found)
    files = rows.where("kind = 'file'").select("path", "modificationTime", "length").dropDuplicates(["path"])
    return files, rows.where("kind = 'missing'").select("path")


def read_files(files: DataFrame) -> DataFrame:
    """``files`` (path, modificationTime, length) with their ``content``, read by the tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, held, size = 0, [], 0
            for k, path in enumerate(b.column(0).to_pylist()):
                system, inner, _ = _file_system(path)
                with system.open_input_stream(inner) as f:
                    held.append(f.read())
                size += len(held[-1])
                if size >= READ_BYTES or k + 1 == len(b):
                    part = b.slice(start, len(held))
                    yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(held, pa.binary())],
                                                     names=["path", "modificationTime", "length", "content"])
                    start, held, size = k + 1, [], 0

    return (spread(files.select("path", "modificationTime", "length"), "path")
            .mapInArrow(run, "path string, modificationTime timestamp, length long, content binary"))


def write_files(rows: DataFrame, root: str, key: str, text: str) -> None:
    """One file of lines a ``key`` and task, ``<root>/<key>=<value>/part-*.txt``, written by the tasks: the layout and bytes
    of ``rows.write.partitionBy(key).text(root)`` (a NULL text is an empty line).

    Spark's committer moves every file on the driver, one after the other, which does not scale to a file a row. Here a
    file gets its name when it is whole, so a task that is run again replaces its files.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}.txt"
        part, attempt = None, f".{name}-{task.taskAttemptId()}"
        system, base, _ = _file_system(root)
        folder = out = None

        def close():
            out.close()
            system.move(f"{folder}/{attempt}", f"{folder}/{name}")

        for b in batches:
            for value, line in zip(b.column(0).to_pylist(), b.column(1)):
                if out is None or value != part:
                    if out is not None:
                        close()
                    part, folder = value, f"{base.rstrip('/')}/{key}={'__HIVE_DEFAULT_PARTITION__' if value is None else value}"
                    system.create_dir(folder)
                    out = system.open_output_stream(f"{folder}/{attempt}")
                if line.is_valid:
                    out.write(line.as_buffer())
                out.write(b"\n")
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())], names=["n"])

    dealt = widened(rows.select(F.col(key), F.col(text)), key).sortWithinPartitions(key)
    dealt.mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()

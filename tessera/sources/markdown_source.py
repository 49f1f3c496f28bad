"""Markdown folders as a data source: ``spark.read.format("tessera_markdown").load(folder)``, and the same with ``readStream``.

A row is a section: (file, section, path, body), as ``markdown.sections`` has them. The reader lists the
files that end in .md or .markdown under the folder, in the order of their names, and deals them over
partitions; a stream keeps the files that it has seen as its offset, as numbers of their sorted list of
(time of change, name), so a batch that is run again reads the same files. Files are opened by the tasks
through pyarrow's file systems (local paths, and the schemes that it knows); where only Spark reaches a
store, ``markdown.read`` does the same without streaming.

Defined cases: a folder that is missing is an error, and so is one without such files (``allowEmpty``
true: no rows); an empty file is an error where ``failOnEmpty`` is true, else it has no rows; text that
is no UTF-8 is an error; a file without headers is one section "Document".
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, section long, path string, body string"
ENDINGS = (".md", ".markdown")
HEADER = re.compile(r"^(#{1,6}) (.*)$")


def sections_of(text: str) -> Iterator[tuple[int, str, str]]:
    """(section, path of headers, body) of one file."""
    number, stack, lines, named = 0, [], [], "Document"
    begun = False
    for line in re.split(r"\r?\n", text):
        m = HEADER.match(line)
        if m:
            if begun:
                yield number, named, "\n".join(lines)
            level = len(m[1])
            stack = [(n, t) for n, t in stack if n < level] + [(level, m[2].strip())]
            number, named, lines = number + 1, " > ".join(t for _, t in stack), []
        begun = True
        lines.append(line)
    if begun:
        yield number, named, "\n".join(lines)


def _system(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(folder: str) -> list[tuple[int, str, int]]:
    """(time of change, file, size) of the folder's Markdown files, sorted."""
    from pyarrow import fs

    system, path = _system(folder)
    if system.get_file_info(path).type == fs.FileType.NotFound:
        raise FileNotFoundError(f"no folder or file {folder}")
    found = [system.get_file_info(path)] if system.get_file_info(path).type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted((int(f.mtime_ns or 0), f.path, f.size or 0) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(ENDINGS))


class Files(InputPartition):
    def __init__(self, files: list[tuple[int, str, int]]):
        super().__init__(len(files))
        self.files = files


def _read(folder: str, files: list[tuple[int, str, int]], fail_on_empty: bool) -> Iterator[tuple]:
    system, _ = _system(folder)
    for _, path, _ in files:
        with system.open_input_stream(path) as stream:
            text = stream.read().decode("utf-8")
        if not text.strip():
            if fail_on_empty:
                raise ValueError(f"{path} is empty")
            continue
        for number, named, body in sections_of(text):
            yield path, number, named, body


class MarkdownSource(DataSource):
    """Options: path (by load), files (most files of a partition, 64), filesPerBatch (of a stream, 1000), allowEmpty, failOnEmpty."""

    @classmethod
    def name(cls) -> str:
        return "tessera_markdown"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


class _Options:
    def __init__(self, options):
        self.folder = options.get("path")
        if not self.folder:
            raise ValueError("load() needs a folder")
        self.files, self.batch = int(options.get("files", 64)), int(options.get("filesPerBatch", 1000))
        flag = lambda k: str(options.get(k, "false")).lower() == "true"
        self.allow_empty, self.fail_on_empty = flag("allowEmpty"), flag("failOnEmpty")

    def dealt(self, files: list) -> list[Files]:
        return [Files(files[i : i + self.files]) for i in range(0, len(files), self.files)] or [Files([])]

    def rows(self, part: Files) -> Iterator[tuple]:
        yield from _read(self.folder, part.files, self.fail_on_empty)


class _Reader(_Options, DataSourceReader):
    def partitions(self) -> list[Files]:
        files = sorted(listed(self.folder), key=lambda f: f[1])
        if not files and not self.allow_empty:
            raise FileNotFoundError(f"no Markdown files in {self.folder}")
        return self.dealt(files)

    def read(self, partition: Files) -> Iterator[tuple]:
        yield from self.rows(partition)


class _StreamReader(_Options, DataSourceStreamReader):
    """The offset is the last file that was taken, by (time of change, name)."""

    def __init__(self, options):
        super().__init__(options)
        self.last: dict | None = None

    def initialOffset(self) -> dict:
        return {"time": -1, "file": ""}

    def _after(self, offset: dict) -> list:
        return [f for f in listed(self.folder) if (f[0], f[1]) > (offset["time"], offset["file"])]

    def latestOffset(self) -> dict:
        new = self._after(self.last or self.initialOffset())[: self.batch]
        if new:
            self.last = {"time": new[-1][0], "file": new[-1][1]}
        return self.last or self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        self.last = end
        return self.dealt([f for f in self._after(start) if (f[0], f[1]) <= (end["time"], end["file"])])

    def read(self, partition: Files) -> Iterator[tuple]:
        yield from self.rows(partition)

    def commit(self, end: dict) -> None:
        pass


def register(spark) -> None:
    """Makes the format known to a session."""
    from tessera.session import ship_package

    ship_package(spark)
    spark.dataSource.register(MarkdownSource)

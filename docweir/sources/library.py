"""A data source of document libraries: the pages of a folder's files, by extractors registered for their suffixes.

register(spark) makes it known; spark.read.format("docweir.library").load(folder) reads it and spark.readStream follows the
folder. Files are listed with their sizes and dealt to partitions of bounded bytes; their content is read in tasks only. A
file that can't be read, or whose kind has no extractor, is a row with its error, so one bad file ends no job.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from .files import _docx_text

FORMAT = "docweir.library"
SCHEMA = "path string, suffix string, length long, page int, text string, error string"
#: Bytes of files that one task reads, and what opening one counts as.
PARTITION_BYTES, OPEN_BYTES = 64_000_000, 1_000_000

Extractor = Callable[[bytes], list[str]]


def _plain(content: bytes) -> list[str]:
    if b"\0" in content:
        raise ValueError("not a text")
    return [content.decode("utf-8", "replace").strip()]


def _gold(content: bytes) -> list[str]:
    """A page for each question of a gold set in JSON lines, or in one JSON array."""
    text = content.decode()
    cases = json.loads(text) if text.lstrip().startswith("[") else [json.loads(line) for line in text.splitlines() if line.strip()]
    for case in cases:
        if not isinstance(case, dict) or not case.get("question_id"):
            raise ValueError("a case without question_id")
    return [json.dumps(case, ensure_ascii=False, sort_keys=True) for case in cases]


def _store(content: bytes) -> list[str]:
    """A page for each document of a JSON store."""
    whole = json.loads(content)
    if not isinstance(whole, dict) or not isinstance(whole.get("documents"), list):
        raise ValueError("a store without documents")
    return [json.dumps(d, ensure_ascii=False, sort_keys=True) for d in whole["documents"]]


EXTRACTORS: dict[str, Extractor] = {"txt": _plain, "md": _plain, "docx": lambda content: [_docx_text(content)], "jsonl": _gold, "json": _store}


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, str, int]]) -> None:
        super().__init__(None)
        self.files = files


def _suffix(path: str) -> str:
    name = path.rpartition("/")[2]
    return name.rpartition(".")[2].lower() if "." in name else ""


def _listed(folder: str) -> list[tuple[str, str, int, int]]:
    """(path, suffix, length, nanoseconds of change) of all files below a folder, hidden ones left out."""
    system, root = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
    found = system.get_file_info(pafs.FileSelector(root, recursive=True))
    return sorted((f.path, _suffix(f.path), f.size, f.mtime_ns or 0) for f in found if f.type == pafs.FileType.File and not any(p.startswith((".", "_")) for p in f.path[len(root) :].split("/")))


def _dealt(files: list[tuple[str, str, int]]) -> list[Files]:
    parts: list[list[tuple[str, str, int]]] = []
    size = PARTITION_BYTES
    for f in files:
        if size + f[2] + OPEN_BYTES > PARTITION_BYTES and (not parts or parts[-1]):
            parts.append([])
            size = 0
        parts[-1].append(f)
        size += f[2] + OPEN_BYTES
    return [Files(p) for p in parts] or [Files([])]


def _pages(folder: str, files: list[tuple[str, str, int]], extractors: dict[str, Extractor]) -> Iterator[tuple]:
    system = pafs.FileSystem.from_uri(folder)[0] if "://" in folder else pafs.LocalFileSystem()
    for path, suffix, length in files:
        extract = extractors.get(suffix)
        if extract is None:
            yield path, suffix, length, None, None, f"no extractor for {suffix or 'a file without suffix'}"
            continue
        try:
            with system.open_input_file(path) as f:
                pages = extract(f.read())
        except Exception as e:  # whatever an extractor finds wrong is the file's error
            yield path, suffix, length, None, None, f"{type(e).__name__}: {e}"[:500]
            continue
        for n, text in enumerate(pages):
            yield path, suffix, length, n + 1, text, None


class Reader(DataSourceReader):
    def __init__(self, folder: str, extractors: dict[str, Extractor]) -> None:
        self.folder, self.extractors, self.suffixes, self.paths = folder, extractors, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Filters by suffix or path choose files before any is opened; the others are left to Spark."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute not in (("suffix",), ("path",)):
                yield f
            elif f.attribute == ("suffix",):
                self.suffixes = values if self.suffixes is None else self.suffixes & values
            else:
                self.paths = values if self.paths is None else self.paths & values

    def partitions(self) -> list[Files]:
        return _dealt([(p, s, n) for p, s, n, _ in _listed(self.folder) if (self.suffixes is None or s in self.suffixes) and (self.paths is None or p in self.paths)])

    def read(self, partition: Files) -> Iterator[tuple]:
        return _pages(self.folder, partition.files, self.extractors)


class StreamReader(DataSourceStreamReader):
    """Follows a folder by the time and path of its last file: files are to be moved into it whole."""

    def __init__(self, folder: str, extractors: dict[str, Extractor]) -> None:
        self.folder, self.extractors = folder, extractors

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": 0, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        at, path = max(((ns, p) for p, _, _, ns in _listed(self.folder)), default=(0, ""))
        return {"at": at, "path": path}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = (start["at"], start["path"]), (end["at"], end["path"])
        return _dealt([(p, s, n) for p, s, n, ns in _listed(self.folder) if low < (ns, p) <= high])

    def read(self, partition: Files) -> Iterator[tuple]:
        return _pages(self.folder, partition.files, self.extractors)

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession, extractors: dict[str, Extractor] | None = None) -> None:
    """Make the source known to a session, with extractors by suffix besides EXTRACTORS, and let it take filters."""
    own = EXTRACTORS | (extractors or {})

    class Library(DataSource):
        @classmethod
        def name(cls) -> str:
            return FORMAT

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> Reader:
            return Reader(self.options["path"], own)

        def streamReader(self, schema) -> StreamReader:  # noqa: N802
            return StreamReader(self.options["path"], own)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Library)

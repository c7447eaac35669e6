"""A data source for stores of the user's own: rows of text files as a Spark format.

    spark.dataSource.register(LineSource)
    spark.read.format("quernel_lines").option("path", ..).option("kind", "words").load()
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import DICTIONARIES


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class LineSource(DataSource):
    """Tab-separated dictionary files, read in byte ranges; a line belongs to the range that its first byte is in."""

    @classmethod
    def name(cls) -> str:
        return "quernel_lines"

    def schema(self) -> str:
        return DICTIONARIES[self.options["kind"]]

    def reader(self, schema) -> DataSourceReader:
        return _LineReader(self.options["path"], [f.dataType.simpleString() for f in schema], int(self.options.get("split", 32 << 20)))


class _LineReader(DataSourceReader):
    def __init__(self, path: str, kinds: list[str], split: int):
        self.path, self.kinds, self.split = path, kinds, split

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = self._open()
        one = store.get_file_info(root)
        files = [one] if one.is_file else [x for x in store.get_file_info(fs.FileSelector(root, recursive=True)) if x.is_file]
        return [_Range(f.path, a, min(f.size, a + self.split)) for f in files for a in range(0, f.size, self.split)]

    def read(self, part: _Range) -> Iterator[tuple]:
        store, _ = self._open()
        convert = [int if k in ("int", "bigint") else str for k in self.kinds]
        with store.open_input_file(part.path) as f:
            at = max(0, part.start - 1)
            f.seek(at)
            rest = b"" if part.start else b"\n"  # what stands before a range's first line
            data = rest + f.read(part.stop - at)
            while not data.endswith(b"\n"):
                more = f.read(1 << 16)
                if not more:
                    break
                data += more[: more.find(b"\n") + 1] if b"\n" in more else more
        _, first, lines = data.partition(b"\n")
        for line in lines.split(b"\n") if first else ():  # a range within one line has none of its own
            values = line.decode().rstrip("\r").split("\t")
            if len(values) == len(convert):
                try:
                    yield tuple(c(v) for c, v in zip(convert, values, strict=True))
                except ValueError:
                    continue

"""A streaming source over folders that fetchers fill: one folder a source, files in order of name, and an offset for each source.

    spark.dataSource.register(LandedSource)
    spark.readStream.format("heliograph_landed").option("path", folder).load()

``folder/<source>/`` holds JSON lines. The offset is the last file read of each source; files have to appear whole and in
ascending order of name. Any file system that Arrow knows will do.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


class Files(InputPartition):
    def __init__(self, source: str, names: list[str]):
        self.source, self.names = source, names


class LandedReader(DataSourceStreamReader):
    def __init__(self, path: str, a_task: int, a_batch: int | None):
        self.path, self.a_task, self.a_batch = path, a_task, a_batch
        self.given: dict = {}

    def system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def listed(self) -> dict[str, list[str]]:
        """source -> its files, in order of name; names that begin with a dot or underscore aren't data."""
        from pyarrow import fs

        files, root = self.system()
        out: dict[str, list[str]] = {}
        for f in files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            source, slash, name = f.path[len(root.rstrip("/")) + 1 :].partition("/")
            if slash and f.type == fs.FileType.File and name[0] not in "._":
                out.setdefault(source, []).append(name)
        return {s: sorted(names) for s, names in sorted(out.items())}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """The newest file of each source, at most ``a_batch`` files behind the offset given before."""
        given = dict(self.given)
        for source, names in self.listed().items():
            new = [n for n in names if n > given.get(source, "")]
            new = new[: self.a_batch] if self.a_batch else new
            if new:
                given[source] = new[-1]
        self.given = given
        return given

    def partitions(self, start: dict, end: dict) -> list[Files]:
        out = []
        for source, names in self.listed().items():
            new = [n for n in names if start.get(source, "") < n <= end.get(source, "")]
            out += [Files(source, new[i : i + self.a_task]) for i in range(0, len(new), self.a_task)]
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        files, root = self.system()
        for name in partition.names:
            with files.open_input_stream(f"{root.rstrip('/')}/{partition.source}/{name}") as f:
                for number, line in enumerate(f.read().decode().split("\n")):
                    if line.strip():
                        yield partition.source, name, number, json.dumps(json.loads(line), ensure_ascii=False)

    def commit(self, end: dict) -> None:
        pass  # files stay


class LandedSource(DataSource):
    """Options: path, filesPerTask (8), filesPerBatch of each source (all; a query that is triggered once makes one batch, and the next one goes on)."""

    @classmethod
    def name(cls) -> str:
        return "heliograph_landed"

    def schema(self) -> str:
        return "source string, file string, line long, item string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        most = self.options.get("filesPerBatch")
        return LandedReader(self.options["path"], int(self.options.get("filesPerTask", 8)), int(most) if most else None)

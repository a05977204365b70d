"""The artifact store: a gzipped JSON file for each page at d[:2]/d[2:4]/d.json.gz, d being the digest of its URL, as a Spark data source.

A task writes each file under a name of its own and then moves it to its place, in one step on stores that have such. So a reader sees
whole files alone, a task that runs again after a lost executor puts the same files there again, and nothing is left to be done by the
driver. Files of a task that broke off keep their hidden names; the next writer into the same folder doesn't mind them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "page_artifacts"


def store_of(root: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(root if "://" in root else root.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), root


@dataclass
class Written(WriterCommitMessage):
    files: int


class ArtifactWriter(DataSourceArrowWriter):
    def __init__(self, root: str):
        self.root = root

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = store_of(self.root)
        n = 0
        for batch in iterator:
            for digest, value in zip(batch.column("digest").to_pylist(), batch.column("value").to_pylist()):
                folder = f"{root}/{digest[:2]}/{digest[2:4]}"
                fs.create_dir(folder, recursive=True)
                own, place = f"{folder}/.{digest}.{uuid.uuid4().hex}", f"{folder}/{digest}.json.gz"
                with fs.open_output_stream(own, compression="gzip") as f:
                    f.write(value.encode())
                try:
                    fs.move(own, place)
                except OSError:  # a store that doesn't replace: the file is there already, with what has the same digest
                    fs.delete_file(own)
                    if not fs.get_file_info(place).is_file:
                        raise
                n += 1
        return Written(n)

    def commit(self, messages: list) -> None:
        """All files are in their places."""

    def abort(self, messages: list) -> None:
        """What was written is whole, and is written again by the next run."""


class ArtifactStore(DataSource):
    """Writes rows (digest, value: the JSON text) below option path."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "digest string, value string"

    def writer(self, schema: StructType, overwrite: bool) -> ArtifactWriter:
        return ArtifactWriter(self.options["path"])

"""A data source of whole files: a row for each file of given folders, whatever its name and size, by tasks that each list a folder and read their share of it.

Spark's own file source leaves out names that begin with ``_`` and files of no bytes. Nothing is listed on the driver: a partition is a folder and a share of
its names, by their hash. Files are read through Arrow's file systems, which know local and mounted paths and the usual stores (``s3``, ``gs``, ``hdfs``).
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: sent to the workers as it is, so that Spark's planner process need not find the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def file_system(root: str):
    """The file system of a path or URI, and the path in it; a ValueError if Arrow has none for it."""
    import os

    import pyarrow as pa
    from pyarrow import fs

    if "://" not in root and not root.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(root)
    try:
        return fs.FileSystem.from_uri(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ImportError) as error:
        raise ValueError(f"no file system for {root}: {error}") from error


class Share(InputPartition):
    def __init__(self, folder: str, number: int, of: int):
        self.folder, self.number, self.of = folder, number, of


class Folders(DataSource):
    """Options: ``root``, ``folders`` (below the root, a line each) and ``shares`` of each folder. Folders that are not there have no files."""

    @classmethod
    def name(cls) -> str:
        return "folders"

    def schema(self) -> str:
        return "path string, size bigint, content binary"

    def reader(self, schema) -> DataSourceReader:
        return FoldersReader(self.options)


class FoldersReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.folders, self.shares = options["root"], options["folders"].split("\n"), int(options.get("shares", 1))

    def partitions(self):
        return [Share(folder, k, self.shares) for folder in self.folders for k in range(self.shares)]

    def read(self, share: Share):
        import zlib

        from pyarrow import fs

        system, root = file_system(self.root)
        for found in system.get_file_info(fs.FileSelector(f"{root.rstrip('/')}/{share.folder}", allow_not_found=True)):
            name = found.base_name
            if found.type == fs.FileType.File and zlib.crc32(name.encode()) % share.of == share.number:
                with system.open_input_stream(found.path) as stream:
                    yield f"{share.folder}/{name}", found.size, stream.read()

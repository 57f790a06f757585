"""Spark data sources `bmp` and `jpeg`: spark.read.format("jpeg").load(folder), df.write.format("bmp").save(folder).

Reading gives (path, width, height, data, error), one partition for about
TARGET bytes of files. Writing takes (name, width, height, data) and makes one
file per row; a name may hold folders below the target, but none above it.
Tasks write into a hidden folder of the job, where two rows of one name are an
error unless their files are equal; when all tasks are done the files take their
places, each at once, and files of the same name are replaced. Mode overwrite
then removes the format's other files; a job that fails leaves the target as it
was. A row without an image, or with one that doesn't fit its size, fails the
job with its name, or is left out with skipInvalid.
Options: allowTrailing (read), skipInvalid (write), quality, chromaQuality,
optimise, interval (write jpeg).

Folders are paths that every executor sees, as a mounted file system is; for
other stores use sources.images over Spark's own binaryFile reader.
"""

from __future__ import annotations

import glob
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from rasterbrook.sources import bmp, jpeg

TARGET = 32 << 20
SCHEMA = "path string, width int, height int, data binary, error string"


@dataclass
class Files(InputPartition):
    paths: list[str]


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


class _Reader(DataSourceReader):
    def __init__(self, kind: str, options: dict):
        self.kind, self.options = kind, options

    def partitions(self) -> list[Files]:
        root = _local(self.options["path"])
        found = sorted(p for p in (glob.glob(f"{glob.escape(root)}/**", recursive=True) if os.path.isdir(root) else [root]) if not os.path.isdir(p))
        if not os.path.exists(root):
            raise FileNotFoundError(root)
        parts, held, size = [], [], 0
        for p in found:
            held.append(p)
            size += os.path.getsize(p)
            if size >= TARGET:
                parts.append(Files(held))
                held, size = [], 0
        return [*parts, Files(held)] if held or not parts else parts

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                with open(path, "rb") as f:
                    data = f.read()
                if self.kind == "jpeg" and self.options.get("allowtrailing", self.options.get("allowTrailing", "false")).lower() == "true":
                    data = data[: data.rfind(b"\xff\xd9") + 2]
                yield (path, *(bmp if self.kind == "bmp" else jpeg).decode(data), None)
            except (ValueError, IndexError, OSError) as e:
                yield path, None, None, None, str(e) or type(e).__name__


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, kind: str, options: dict, overwrite: bool):
        self.kind, self.options, self.overwrite = kind, {k.lower(): v for k, v in options.items()}, overwrite
        self.root = _local(self.options["path"])
        if os.path.exists(self.root) and not os.path.isdir(self.root):
            raise ValueError(f"not a folder: {self.root}")
        self.staging = os.path.join(self.root, f".writing-{uuid.uuid4().hex}")

    def _flag(self, name: str) -> bool:
        return self.options.get(name, "false").lower() == "true"

    def _encoded(self, r) -> bytes:
        number = {k: int(self.options.get(k, d)) for k, d in (("quality", 90), ("chromaquality", 0), ("interval", 0))}
        if r.width is None or r.height is None or r.data is None:
            raise ValueError("no image")
        if self.kind == "bmp":
            return bmp.encode(r.width, r.height, bytes(r.data))
        return jpeg.encode(r.width, r.height, bytes(r.data), number["quality"], number["chromaquality"] or None, self._flag("optimise"), number["interval"])

    def write(self, rows: Iterator) -> Written:
        made = []
        for r in rows:
            name = os.path.normpath(f"{r.name}.{self.kind}") if r.name else ""
            if not name or os.path.isabs(name) or name.split(os.sep)[0] == "..":
                raise ValueError(f"not a name below the folder: {r.name}")
            if os.path.exists(at := os.path.join(self.root, name)) and not os.path.isfile(at):
                raise ValueError(f"not a file: {at}")
            try:
                data = self._encoded(r)
            except (ValueError, OverflowError) as e:
                if self._flag("skipinvalid"):
                    continue
                raise ValueError(f"{r.name}: {e}") from e
            path = os.path.join(self.staging, name)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            part = f"{path}.{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                f.write(data)
            try:
                os.link(part, path)  # only if no other row has made it
            except FileExistsError:
                with open(path, "rb") as f:
                    if f.read() != data:
                        raise ValueError(f"two images are named {r.name}") from None
            finally:
                os.remove(part)
            made.append(name)
        return Written(made)

    def commit(self, messages: list[Written | None]) -> None:
        made = {name for m in messages if m for name in m.files}
        os.makedirs(self.root, exist_ok=True)
        for name in sorted(made):
            at = os.path.join(self.root, name)
            os.makedirs(os.path.dirname(at), exist_ok=True)
            os.replace(os.path.join(self.staging, name), at)
        if self.overwrite:
            for path in glob.glob(f"{glob.escape(self.root)}/**/*.{self.kind}", recursive=True):
                if os.path.relpath(path, self.root) not in made:
                    os.remove(path)
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class BmpSource(DataSource):
    kind = "bmp"

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.kind, dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.kind, dict(self.options), overwrite)


class JpegSource(BmpSource):
    kind = "jpeg"


def register(spark: SparkSession) -> None:
    """Makes both sources known to a session."""
    spark.dataSource.register(BmpSource)
    spark.dataSource.register(JpegSource)

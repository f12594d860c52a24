"""NumPy archives as a Spark data source: one row a layer of each array, reading only the layers that a query asks for.

A partition is a number of small files, or a share of the members of a large one; the driver lists files and sizes and
opens none. A task reads an archive's directory at its end, skips members whose item, condition or position is not
asked for, and of a stored member reads the header and the bytes of the layers asked for. A compressed member is read
up to the last of them. Equality and IN on item, cond, pos and layer are pushed down. Files are opened through Arrow's
file systems, so a path may be local or in any store these know.
"""

from __future__ import annotations

import ast
import re
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "item string, cond string, pos string, layer int, vec array<float>"
ARROW = pa.schema([("item", pa.string()), ("cond", pa.string()), ("pos", pa.string()), ("layer", pa.int32()), ("vec", pa.list_(pa.float32()))])
PUSHED = ("item", "cond", "pos", "layer")
# Bytes of files in one partition, and of one batch.
PARTITION_BYTES, BATCH_BYTES = 64 << 20, 4 << 20

_KEY = re.compile(r"^(?:(?P<item>M\d+|[A-Za-z0-9-]+)_)?(?P<cond>B|C|none)(?:_(?P<pos>[a-z_]+))?$")


def named(stem: str, key: str, strict_name: str | None) -> tuple[str, str, str]:
    """item, cond and pos of an array by the name of its file and its key."""
    held = re.fullmatch(strict_name, stem) if strict_name else None
    if strict_name and held is None:
        raise ValueError(f"archive name out of pattern: {stem}")
    own, m = re.search(r"M\d+", stem), _KEY.match(key)
    item = held[1] if held else own[0] if own else (m["item"] if m and m["item"] else key if not m else stem)
    cond = held[2] if held else m["cond"] if m else ""
    return item, cond, m["pos"] if m and m["pos"] else key if held else ""


def layers(file, member: zipfile.ZipInfo, wanted: set[int] | None) -> Iterator[tuple[int, np.ndarray]]:
    """The layers (first axis; the whole of a vector is layer 0) of one array of an archive, those wanted."""
    file.seek(member.header_offset + 26)
    names = struct.unpack("<HH", file.read(4))  # the local header repeats the name and has extras of its own
    stored = member.compress_type == zipfile.ZIP_STORED
    if stored:
        start = member.header_offset + 30 + sum(names)
        file.seek(start)
        stream = file
    else:
        stream = zipfile.ZipFile(file).open(member)
    version = stream.read(8)[6]
    size = struct.unpack("<H" if version == 1 else "<I", stream.read(2 if version == 1 else 4))[0]
    about = ast.literal_eval(stream.read(size).decode("latin1"))
    kind, shape = np.dtype(about["descr"]), about["shape"]
    rows, width = (1, int(np.prod(shape))) if len(shape) < 2 else (shape[0], int(np.prod(shape[1:])))
    if about["fortran_order"] and len(shape) > 1:
        whole = np.frombuffer(stream.read(rows * width * kind.itemsize), kind).reshape(shape, order="F").reshape(rows, width)
        yield from ((i, whole[i]) for i in range(rows) if wanted is None or i in wanted)
        return
    data, at = 8 + (2 if version == 1 else 4) + size, 0
    for i in range(rows) if wanted is None else sorted(w for w in wanted if 0 <= w < rows):
        if stored:
            file.seek(start + data + i * width * kind.itemsize)
        else:
            while at < i:
                at += 1
                stream.read(width * kind.itemsize)
            at += 1
        yield i, np.frombuffer(stream.read(width * kind.itemsize), kind)


@dataclass
class Share(InputPartition):
    """Files to read, and which of their members: those whose place is `turn` modulo `turns`."""

    files: list[str]
    turn: int = 0
    turns: int = 1


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.strict_name = options["path"], options.get("strictname")
        self.only: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if name not in PUSHED:
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.only[name] = self.only.get(name, values) & values

    def partitions(self) -> list[Share]:
        system, root = opened(self.path)
        found = system.get_file_info(root)
        every = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((i.path, i.size) for i in every if i.type == fs.FileType.File and i.path.endswith(".npz"))
        shares, small, size = [], [], 0
        for path, n in files:
            if n > PARTITION_BYTES:
                turns = -(-n // PARTITION_BYTES)
                shares += [Share([path], k, turns) for k in range(turns)]
                continue
            if size + n > PARTITION_BYTES:
                shares.append(Share(small))
                small, size = [], 0
            small, size = [*small, path], size + n
        return shares + ([Share(small)] if small else [])

    def _asked(self, name: str, value) -> bool:
        return name not in self.only or value in self.only[name]

    def rows(self, system: fs.FileSystem, share: Share) -> Iterator[tuple]:
        for path in share.files:
            stem = path.rsplit("/", 1)[-1].removesuffix(".npz")
            with system.open_input_file(path) as file:
                members = [m for m in zipfile.ZipFile(file).infolist() if m.filename.endswith(".npy")]
                for member in members[share.turn :: share.turns]:
                    told = named(stem, member.filename.removesuffix(".npy"), self.strict_name)
                    if all(self._asked(n, v) for n, v in zip(PUSHED, told, strict=False)):
                        yield from ((*told, i, v) for i, v in layers(file, member, self.only.get("layer")))

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in self.rows(opened(self.path)[0], partition):
            held.append((*row[:4], row[4].astype(np.float32)))
            size += 4 * len(row[4])
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), ARROW.types, strict=True)], schema=ARROW)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), ARROW.types, strict=True)], schema=ARROW)


class ArchiveSource(DataSource):
    """Format `archives`: load(path), option strictname (a pattern of two groups, item and condition)."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)

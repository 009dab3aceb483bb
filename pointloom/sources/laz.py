"""A data source for LAS and LAZ files, one partition per range of points.

LAS files, which are not compressed, are read as numpy records; LAZ files need the laspy package where they are read.
Files are opened by path, so they must be in a file system that all executors mount.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "scan_id string, point_id bigint, x double, y double, z double, intensity double, r double, g double, b double"


#: Where a point record of each format of the LAS specification holds its colours.
RGB_AT = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}


class Las:
    """Header of a LAS file, and ranges of its points."""

    def __init__(self, path: str):
        self.path = path
        with open(path, "rb") as f:
            head = f.read(375)
        if head[:4] != b"LASF":
            raise ValueError(f"{path} is not a LAS file")
        minor, kind = head[25], head[104]
        self.compressed, self.format = kind > 127, kind & 63
        (self.first,) = struct.unpack_from("<I", head, 96)
        (self.size,) = struct.unpack_from("<H", head, 105)
        (self.count,) = struct.unpack_from("<Q", head, 247) if minor >= 4 else struct.unpack_from("<I", head, 107)
        self.scale, self.offset = struct.unpack_from("<3d", head, 131), struct.unpack_from("<3d", head, 155)

    def read(self, start: int, count: int) -> list:
        """x, y, z, intensity, red, green, blue of a range; colours are None where the format has none."""
        import numpy as np

        names, at, kinds = ["x", "y", "z", "i"], [0, 4, 8, 12], ["<i4", "<i4", "<i4", "<u2"]
        if self.format in RGB_AT:
            names, at, kinds = names + ["r", "g", "b"], at + [RGB_AT[self.format] + k for k in (0, 2, 4)], kinds + ["<u2"] * 3
        record = np.dtype({"names": names, "formats": kinds, "offsets": at, "itemsize": self.size})
        points = np.fromfile(self.path, record, count, offset=self.first + start * self.size)
        out = [points[c] * s + o for c, s, o in zip("xyz", self.scale, self.offset)] + [points["i"].astype(float)]
        return out + ([points[c].astype(float) for c in "rgb"] if self.format in RGB_AT else [None] * 3)


class Part(InputPartition):
    def __init__(self, path: str, start: int, count: int):
        self.path, self.start, self.count = path, start, count


class LazReader(DataSourceReader):
    """Reads ranges of ``chunk`` points; absent attributes are null."""

    def __init__(self, options):
        self.paths = sorted(p for p in options["path"].split(",") if p)
        self.chunk = int(options.get("chunk", "1000000"))

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            n = Las(path).count
            out += [Part(path, i, min(self.chunk, n - i)) for i in range(0, n, self.chunk)]
        return out or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator:
        import numpy as np
        import pyarrow as pa

        if not partition.count:
            return
        stem = partition.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        las = Las(partition.path)
        cols = _decompressed(partition) if las.compressed else las.read(partition.start, partition.count)
        n = len(cols[0])
        arrays = [pa.array([stem] * n), pa.array(np.arange(partition.start, partition.start + n))]
        arrays += [pa.nulls(n, pa.float64()) if c is None else pa.array(c) for c in cols]
        yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in SCHEMA.split(", ")])


def _decompressed(partition: Part) -> list:
    import laspy
    import numpy as np

    with laspy.open(partition.path) as f:
        f.seek(partition.start)
        points = f.read_points(partition.count)
    values = [getattr(points, c, None) for c in ("x", "y", "z", "intensity", "red", "green", "blue")]
    return [None if v is None else np.asarray(v, float) for v in values]


class LazSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "laz"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LazReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(LazSource)

"""``spark.read.format("volume")``: image files as a Python data source, a file a partition."""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import SCHEMA, decode


class _File(InputPartition):
    pass


class VolumeReader(DataSourceReader):
    def __init__(self, options):
        self.paths = sorted(p for p in options.get("paths", options.get("path", "")).split(",") if p)

    def partitions(self):
        return [_File(p) for p in self.paths] or [_File(None)]

    def read(self, partition):
        import numpy as np

        if partition.value is None:
            return
        with open(partition.value, "rb") as f:
            volumes = decode(partition.value, f.read())
        for t, a in enumerate(volumes):
            for b, r, c in np.argwhere(a):
                yield partition.value, t, int(b), int(r), int(c), float(a[b, r, c])


class VolumeSource(DataSource):
    """For files on a mounted path; ``read_volumes`` reads any store that Spark reads."""

    @classmethod
    def name(cls):
        return "volume"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return VolumeReader(self.options)

"""A stream of the cells that a growing dataset gains along its first dimension.

The offset is the extent that has been read; a batch is the rows between two extents,
so it can be read again after a failure.
"""

from __future__ import annotations

from pyspark.sql.datasource import DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tilewright.container.reader import Container
from tilewright.container.types import decode


class Rows(InputPartition):
    def __init__(self, start: int, end: int):
        super().__init__(None)
        self.start, self.end = start, end


class GrowingReader(DataSourceStreamReader):
    ROWS = 4096

    def __init__(self, options: dict, schema: StructType):
        self.path, self.dataset = options["path"], options.get("dataset", "/data")

    def _open(self):
        c = Container.open(self.path)
        return c, c.dataset(c.resolve(self.dataset))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"extent": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"extent": self._open()[1].shape[0]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Rows(a, min(a + self.ROWS, end["extent"])) for a in range(start["extent"], end["extent"], self.ROWS)]

    def read(self, partition: Rows):
        import numpy as np

        c, d = self._open()
        count = (partition.end - partition.start, *d.shape[1:])
        raw = d.read((partition.start, *(0,) * (len(d.shape) - 1)), count)
        values = decode(d.type, raw, len(raw) // d.type.size, c.heap_object)
        for place, v in zip(np.ndindex(*count), values, strict=True):
            yield (place[0] + partition.start, *place[1:], v)

    def commit(self, end: dict) -> None:
        """Nothing is kept between batches."""

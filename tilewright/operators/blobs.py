"""Containers that are held as bytes in a column, such as those of ``binaryFile``: any store
that Spark reads will do, and a container never leaves the task that has its row."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame

from tilewright.container.reader import Container
from tilewright.container.types import Type, decode, spark_type
from tilewright.operators.render import info, to_json


def cells_of(blobs: DataFrame, dataset: str, t: Type, rank: int, labels: bool = False) -> DataFrame:
    """path, d0, d1, ..., value of one dataset in every container (path, content). The
    element type and the number of dimensions are given, for a plan needs its columns
    before any row is read; rows whose dataset differs are an error."""
    schema = ", ".join(["path string", *(f"d{k} bigint" for k in range(rank)), f"value {spark_type(t, labels)}"])

    def rows(batches):
        import pandas as pd

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                c = Container.from_bytes(content)
                d = c.dataset(c.resolve(dataset))
                if len(d.shape) != rank or spark_type(d.type, labels) != spark_type(t, labels):
                    raise ValueError(f"{path}: {dataset} has {len(d.shape)} dimensions of {spark_type(d.type, labels)}")
                step = max(1, (1 << 16) // max(1, math.prod(d.shape[1:])))
                for at in range(0, d.shape[0] if rank else 1, step):
                    count = (min(step, d.shape[0] - at), *d.shape[1:]) if rank else ()
                    raw = d.read((at, *(0,) * (rank - 1)), count) if rank else d.read()
                    n = len(raw) // d.type.size
                    places = np.unravel_index(np.arange(n), count) if rank else ()
                    own = {f"d{k}": p + (at if not k else 0) for k, p in enumerate(places)}
                    yield pd.DataFrame({"path": [path] * n, **own, "value": decode(d.type, raw, n, c.heap_object, labels)})

    return blobs.select("path", "content").mapInPandas(rows, schema)


def objects_of(blobs: DataFrame) -> DataFrame:
    """container, path, parent, kind, address of every object in containers (path, content)."""

    def rows(batches):
        import pandas as pd

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                got = [(name, path, parent, kind, address) for path, parent, _, address, kind in Container.from_bytes(content).walk()]
                yield pd.DataFrame(got, columns=["container", "path", "parent", "kind", "address"])

    return blobs.select("path", "content").mapInPandas(rows, "container string, path string, parent string, kind string, address bigint")


def info_of(blobs: DataFrame, preview: int = 5) -> DataFrame:
    """container, n, line: the structure of containers (path, content) as text, by lines."""

    def rows(batches):
        import pandas as pd

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                lines = list(info(Container.from_bytes(content), preview))
                yield pd.DataFrame({"container": name, "n": range(len(lines)), "line": lines})

    return blobs.select("path", "content").mapInPandas(rows, "container string, n bigint, line string")


def json_of(blobs: DataFrame, path: str = "/", values: bool = True) -> DataFrame:
    """container, json: a group or dataset of every container (path, content) as JSON."""

    def rows(batches):
        import pandas as pd

        for batch in batches:
            got = [json.dumps(to_json(Container.from_bytes(content), path, values), ensure_ascii=False) for content in batch["content"]]
            yield pd.DataFrame({"container": batch["path"], "json": got})

    return blobs.select("path", "content").mapInPandas(rows, "container string, json string")

"""Work on vectors in tiles: rows packed into blocks of bounded size, so that pairs of blocks, not rows, are dealt to tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """Whether a vector is there, not empty, and all its components are finite."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & ok, F.lit(False))


def pack(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys..., id, copies, vec, and maybe key) as one row for each combination of keys: (keys..., ids, copies, vecs, n, keys), binary.
    """
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        vecs = np.stack(group["vec"].to_numpy()).astype(np.float64)
        order = np.argsort(group["id"].to_numpy(np.int64), kind="stable")
        if group["id"].duplicated().any():  # by id, then vector: a task run again packs alike
            order = np.array(sorted(order, key=lambda i: (group["id"].iloc[i], vecs[i].tobytes())))
        group, vecs = group.iloc[order], vecs[order]
        out = {k: [group[k].iloc[0]] for k in keys}
        out |= {"ids": [group["id"].to_numpy(np.int64).tobytes()], "copies": [group["copies"].to_numpy(np.int64).tobytes()], "vecs": [vecs.tobytes()], "n": [len(group)], "keys": [group["key"].to_numpy(np.int64).tobytes() if "key" in group else b""]}
        return pd.DataFrame(out)

    return rows.groupBy(*keys).applyInPandas(run, f"{schema}, ids binary, copies binary, vecs binary, n long, keys binary")


def each(fn, columns: list[str]):
    """A function for mapInPandas that gives a frame for each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                yield pd.DataFrame(fn(row), columns=columns)

    return run

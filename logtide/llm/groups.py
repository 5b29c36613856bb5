"""Streams over rows sorted by a key: one call for each bounded group, without a Python start per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Arrays = dict[str, np.ndarray]


def map_groups(frame: DataFrame, key: str, function: Callable[[Arrays], Iterator[tuple]], schema: str) -> DataFrame:
    """`function` gets the columns of all rows of one key as arrays and yields tuples of equally long columns of `schema`.

    Groups must be bounded by the caller, as one is held in memory. Rows are shuffled by the key once.
    """
    columns = [part.split()[0] for part in schema.split(", ")]

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[Arrays] = []
        out: list[tuple] = []

        def run(group: Arrays) -> None:
            out.extend(function(group))

        def close() -> None:
            if held:
                run(held[0] if len(held) == 1 else {c: np.concatenate([h[c] for h in held]) for c in held[0]})
                held.clear()

        def made() -> pd.DataFrame:
            frame = pd.DataFrame({c: np.concatenate([np.atleast_1d(o[i]) for o in out]) for i, c in enumerate(columns)})
            out.clear()
            return frame

        for batch in batches:
            if batch.empty:
                continue
            arrays = {c: batch[c].to_numpy() for c in batch.columns}
            keys = arrays[key]
            starts = [*np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])).tolist(), len(keys)]
            if held and held[0][key][0] != keys[0]:
                close()
            for start, stop in zip(starts[:-2], starts[1:-1], strict=True):
                group = {c: a[start:stop] for c, a in arrays.items()}
                if held:
                    held.append(group)
                    close()
                else:
                    run(group)
            held.append({c: a[starts[-2] :] for c, a in arrays.items()})
            if out:
                yield made()
        close()
        if out:
            yield made()

    return frame.repartition(key).sortWithinPartitions(key).mapInPandas(stream, schema)

"""Arrow batches cut into slices, so that a worker's memory does not follow the batch."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def slices(limit: int) -> Callable[[pa.Array, np.ndarray], Iterator[pa.Array]]:
    """A function, sent to executors as it is, that cuts an array into runs of rows whose sizes add up
    to `limit` at most; a row above it is a run of its own."""

    def cut(rows: pa.Array, sizes: np.ndarray) -> Iterator[pa.Array]:
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < len(rows):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield rows.slice(start, stop - start)
            start = stop

    return cut

"""Runs of equal keys in sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, rows): slices of sorted batches whose first ``keys`` columns are equal.

    A key comes again with every batch that it goes on in, so no more than a batch
    is held. Nulls are equal.
    """
    for b in batches:
        if b.num_rows:
            new = np.zeros(b.num_rows, bool)
            new[0] = True
            for c in b.columns[:keys]:
                codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            at = [*np.flatnonzero(new).tolist(), b.num_rows]
            for i, j in zip(at, at[1:]):
                yield tuple(c[i].as_py() for c in b.columns[:keys]), b.slice(i, j - i)

"""Python functions over Arrow batches of texts, whatever these hold: a slice of a batch is Python objects at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that are Python objects at once; a longer text is alone.
SLICE = 1 << 20


def mapped(fn, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """fn of each row of the columns; the first has the texts."""
    upto = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(columns[0]), 0).to_numpy(zero_copy_only=False))))
    out, a = [pa.array([], kind)], 0
    while a < len(columns[0]):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + SLICE, side="right")) - 1)
        out.append(pa.array([fn(*r) for r in zip(*(c.slice(a, b - a).to_pylist() for c in columns))], kind))
        a = b
    return pa.concat_arrays(out)

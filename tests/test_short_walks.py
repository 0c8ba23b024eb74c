"""Short segments are walked many at a time, as each alone."""

import numpy as np
import pandas as pd
import pyarrow as pa

from spatialseg.operators import filament


def test_walks_of_many_segments():
    rng = np.random.default_rng(6)
    parts, want = [], {}
    for s in range(120):
        n = int(rng.integers(1, 30)) if s % 20 else 300
        x = rng.integers(0, 5, (n, 3)).astype(float) if s % 3 else rng.normal(size=(n, 3))
        want[s] = np.argsort(filament.nearest_walk(x) if n > 2 else range(n)).tolist()
        parts.append(pd.DataFrame({"cloud_id": "c" if s % 7 else None, "seg_id": pd.array([s if s != 5 else None] * n, "Int64"), "point_id": range(n), "x": x[:, 0], "y": x[:, 1], "z": x[:, 2], "s": s}))
    whole = pd.concat(parts, ignore_index=True)
    schema = pa.Schema.from_pandas(whole, preserve_index=False)
    for size in (17, 400, 10**6):
        batches = (pa.RecordBatch.from_pandas(whole.iloc[i : i + size], schema, preserve_index=False) for i in range(0, len(whole), size))
        got = pa.Table.from_batches(list(filament.walked(batches))).to_pandas()
        assert len(got) == len(whole) and {s: g["ord"].tolist() for s, g in got.groupby("s")} == want

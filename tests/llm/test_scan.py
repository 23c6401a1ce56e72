"""The separator scan against plain counting, with blocks so small that documents span many of them."""

import random

import numpy as np
import pytest

from acrelake.llm import separator_scan


@pytest.mark.parametrize("block", [1, 3, 64, 1 << 20])
def test_scan_flat_files(spark, tmp_path, block):
    rng = random.Random(block)
    want = []
    for f in range(4):
        ids = [rng.choice([0, 1, 2, 9]) for _ in range(rng.randint(1, 90))] + ([0] if f % 2 else [7, 7])
        np.array(ids, "<u2").tofile(tmp_path / f"f{f}.bin")
        start, place = 0, 0
        for i, x in enumerate(ids):
            if x == 0:
                want.append((f"f{f}.bin", place, start, i - start, True))
                start, place = i + 1, place + 1
        if start < len(ids):
            want.append((f"f{f}.bin", place, start, len(ids) - start, False))
    (tmp_path / "empty.bin").write_bytes(b"")
    got = separator_scan.scan_tokens(spark, str(tmp_path), 0, block=block).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_round_trip(spark, tmp_path):
    rows = [(i, [5] * (i % 7), "x") for i in range(200)] + [(None, [1, 2], "y"), (900, None, "z"), (901, [3] * 5000, "q")]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>, file string").repartition(5)
    got = separator_scan.count_tokens(df, str(tmp_path / "a"), 50_256, block=100)
    assert sorted(((r.doc_id, r.n_tokens) for r in got.collect()), key=str) == sorted(((i, len(x or [])) for i, x, _ in rows), key=str)
    assert separator_scan.count_tokens(df.limit(0), str(tmp_path / "b"), 50_256).count() == 0

"""Finding of the fourth round on BAL3: neighbours by cells of space, not by all pairs."""

import numpy as np
import pytest

from txnwatch.operators import balance as BA


def _brute(x, k):
    d = ((x[:, None] - x[None]) ** 2).sum(axis=-1)
    np.fill_diagonal(d, np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), d), axis=1)[:, :min(k, len(x) - 1)]
    return {(i, r): (int(j), d[i, j]) for i, own in enumerate(order) for r, j in enumerate(own)}


@pytest.mark.parametrize("n,block,cell,visitors", [(3, 50, 20, 10), (37, 500, 500, 10), (400, 50, 20, 7), (400, 8192, 30, 1000), (300, 4, 64, 1000)])
def test_neighbours_by_cells_equal_brute_force(spark, n, block, cell, visitors):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 4)) * [100, 1, 10, 1]
    x[::3] = x[::3].round(0)  # equal distances
    x[: n // 4] = x[0]        # equal rows
    x[n // 2:, 2] = -999.0    # missing
    x[-1] = 1e6
    rows = spark.createDataFrame([(0, i, r.tolist()) for i, r in enumerate(x)], "_cluster int, row long, x array<double>").repartition(3)
    found = {(r.row, r["rank"]): (r.other, r.d2) for r in BA.nearest_rows_by_cells(rows, 5, block, cell, visitors).collect()}
    want = _brute(x, 5)
    assert found.keys() == want.keys() and all(found[q][0] == want[q][0] and found[q][1] == pytest.approx(want[q][1]) for q in want)


def test_few_pairs_are_compared(spark, monkeypatch, tmp_path):
    """Of 6,000 rows in a plane most pairs of cells are never compared."""
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(0, i, r.tolist()) for i, r in enumerate(rng.random((6000, 2)))], "_cluster int, row long, x array<double>")
    tile = BA._nearest_in_tile

    def counted(x, row, y, other, k, sums):
        (tmp_path / f"{row[0]}-{other[0]}-{len(row)}-{len(other)}").touch()
        return tile(x, row, y, other, k, sums)

    monkeypatch.setattr(BA, "_nearest_in_tile", counted)
    assert BA.nearest_rows_by_cells(rows, 5, cell_rows=200).count() == 30_000
    pairs = [list(map(int, f.name.split("-")[2:])) for f in tmp_path.iterdir()]
    assert 6000 * 100 < sum(a * b for a, b in pairs) < 6000 * 6000 / 8

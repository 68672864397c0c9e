"""What op11 holds outside the heap at once is bounded."""

import numpy as np
import pyarrow as pa

from driftloom.llm import collocations


def test_rows_leave_in_bounded_batches():
    rows = 2 * collocations.ROWS + 5
    parts = list(collocations._batches([pa.array(np.arange(rows))], ["w1"]))
    assert [len(p) for p in parts] == [collocations.ROWS, collocations.ROWS, 5] and pa.Table.from_batches(parts).column("w1").to_pylist() == list(range(rows))
    assert len(list(collocations._batches([pa.array([], pa.int64())], ["w1"]))) == 1


def test_tally_lets_its_columns_go():
    first, second = np.array([3, 1, 3, 1]), np.array([4, 2, 4, 5])
    columns = [first, second]
    (a, b), n = collocations.tally(columns)
    assert sorted(zip(a.tolist(), b.tolist(), n.tolist())) == [(1, 2, 1), (1, 5, 1), (3, 4, 2)]
    assert columns[0] is not first and columns[1] is not second

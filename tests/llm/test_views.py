"""Binary columns as numbers, without copies of their rows."""

import numpy as np
import pyarrow as pa

from tidebook.llm.join import views


def test_views_are_the_rows_and_share_their_memory():
    rows = [np.arange(n, dtype=np.uint64) * 3 for n in (4, 0, 1, 1000, 2)]
    for kind in (pa.binary(), pa.large_binary()):
        col = pa.array([r.tobytes() for r in rows], kind)
        for part, want in ((col, rows), (col.slice(1, 3), rows[1:4]), (col.slice(5), [])):
            got = views(part, np.uint64)
            assert len(got) == len(want) and all((a == b).all() and a.dtype == np.uint64 for a, b in zip(got, want))
        assert views(col, np.uint64)[3].base is not None
        held = views(col, np.uint64)
        assert not any(v.flags.owndata for v in held if len(v))

"""Statistics of few rows, one cluster or no variation, against SQL's arithmetic."""

import math

import duckdb
import pytest

from tidebook.plans import registry
from tidebook.stats import inference

ROWS = {
    "none": [],
    "one row": [(1, 0, 0.5, 2.0, 1.0)],
    "no slope": [(1, 0, 0.0, 2.0, 1.0), (2, 1, 0.0, -1.0, -1.0)],
    "one label": [(1, 0, 0.5, 2.0, 1.0), (2, 1, -0.25, 2.0, 1.0), (2, 2, 1.5, 2.0, 1.0)],
    "one cluster": [(3, 0, 0.5, 2.0, 1.0), (3, 1, -0.25, 1.0, 0.5), (3, 2, 1.0, -2.0, -1.0)],
    "usual": [(k % 4, k, (k * 7 % 11 - 5) / 4, (k * 5 % 9 - 4 or 1) * 1.0, (k * 5 % 9 - 4 or 1) * 1.0) for k in range(40)],
}
COLUMNS = "locate int, wid long, ofi double, label_halfspreads double, label_ticks double"


def plain(row):
    return ["nan" if isinstance(v, float) and math.isnan(v) else v if v is None else round(float(v), 6) for v in row]


def in_sql(name, rows):
    """The registered SQL from feat on, over these rows."""
    con = duckdb.connect()
    con.sql("CREATE TABLE feat (locate INTEGER, wid BIGINT, ofi DOUBLE, label_halfspreads DOUBLE, label_ticks DOUBLE)")
    if rows:
        con.executemany("INSERT INTO feat VALUES (?, ?, ?, ?, ?)", rows)
    sql = registry.SQL[name]
    after = sql.index("label_halfspreads\n  FROM wn")
    rest = sql[sql.index(")", sql.index("n_wid = wid + 1", after)) + 1 :].lstrip().lstrip(",")
    return con.sql(("WITH " if rest.lstrip().startswith("clu") else "") + rest).fetchall()[0]


QUERIES = {
    "ols_r2": lambda f: inference.r_squared(f, "ofi", "label_halfspreads"),
    "r2_errors": lambda f: inference.r_squared_errors(f, "ofi", "label_halfspreads", "locate"),
    "accuracy_estimate": lambda f: inference.estimate(f, inference.hit("ofi"), "locate"),
}


@pytest.mark.parametrize("case", ROWS)
@pytest.mark.parametrize("name", QUERIES)
def test_as_sql(spark, name, case):
    got = QUERIES[name](spark.createDataFrame(ROWS[case], COLUMNS)).collect()
    assert len(got) == 1
    assert plain(got[0]) == plain(in_sql(name, ROWS[case]))

import hashlib

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from quillspan.llm.lines import OP6_SQL, drop_shared_lines

LONG = "a line that is long enough É"


def test_same_as_sql_with_normalised_keys(spark):
    rows = [(1, f"{LONG}\nshort\n  {LONG.upper().replace('É', 'É')}  "), (2, f"x\n\t{LONG}\x0b\n\n"), (3, LONG + "\n" + LONG), (4, ""), (5, "short\nshort"), (6, "été " * 10), (7, "ÉTÉ " * 10), (8, "Été " * 10)]
    out = drop_shared_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {tuple(r) for r in out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256)).collect()}
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    assert got == set(con.sql(OP6_SQL).fetchall())
    assert {r.doc_id: r.kept for r in out.collect()}[1] == "short"
    assert {r.doc_id: r.n_dropped for r in out.collect()}[3] == 0


def test_odd_rows(spark):
    rows = [(None, LONG, 1), (1, LONG, 2), (1, LONG, 2), (2, LONG + "\n", 3), (3, None, 4)]
    out = drop_shared_lines(spark.createDataFrame(rows, "doc_id long, text string, id long"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [(None, 1, 1, ""), (1, 1, 1, ""), (1, 1, 1, ""), (2, 2, 0, LONG + "\n"), (3, 1, 0, "")], key=str
    )
    assert hashlib.sha256(b"").hexdigest() == out.where("doc_id = 3").select(F.sha2("kept", 256)).first()[0]
    assert drop_shared_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0

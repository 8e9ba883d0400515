import datetime as dt
import hashlib
import math
import random
import zlib
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillspan.llm import erasure
from quillspan.llm.erasure import KINDS, erase, op13_erasure

SCHEMAS = {
    "clients": "client_id long, master_id long, source string, updated_at timestamp_ntz, balance double, file_no int, key string",
    "clicks": "click_id long, ts timestamp_ntz, client_id long, value double, file_row_number int, props string",
    "sales": "sale_id long, client_id long, status string, total double, row string",
    "sale_lines": "sale_id long, line_no int, item_id long, amount double, client_id string, number long",
}


def crc(x):
    return zlib.crc32(b"" if x is None else str(x).encode())


def naive(tables, files=150, modulus=100):
    """Plain loops over lists of dicts: table, file_no -> rows that are left, rows erased."""
    owner = {}
    for r in tables["sales"]:
        if r["sale_id"] is not None:
            known = owner.get(r["sale_id"])
            owner[r["sale_id"]] = r["client_id"] if known is None else known if r["client_id"] is None else min(known, r["client_id"])
    clicks = {}
    for r in tables["clicks"]:
        clicks[r["client_id"]] = clicks.get(r["client_id"], 0) + 1
    per = {}
    for c, m in {(r["client_id"], r["master_id"]) for r in tables["clients"] if r["master_id"] is not None}:
        per[m] = per.get(m, 0) + (clicks.get(c, 0) if c is not None else 0)
    masters = {m for m in per if crc(m) % modulus == 0} | ({min(per, key=lambda m: (-per[m], m))} if per else set())
    gone = {r["client_id"] for r in tables["clients"] if r["master_id"] in masters} - {None}
    sold = {r["sale_id"] for r in tables["sales"] if r["client_id"] in gone} - {None}
    victim = {"clients": lambda r: r["master_id"] in masters, "clicks": lambda r: r["client_id"] in gone, "sales": lambda r: r["client_id"] in gone, "sale_lines": lambda r: r["sale_id"] in sold}

    def rank(v):
        return (0, 0) if v is None else (2, 0) if isinstance(v, float) and math.isnan(v) else (1, v)

    out = {}
    for name, rows in tables.items():
        place = (lambda r: crc(owner.get(r["sale_id"]))) if name == "sale_lines" else lambda r: crc(r["client_id"])
        rows = sorted(rows, key=lambda r: (place(r), *map(rank, r.values())))
        size = 1 + len(rows) // files
        for k in range(0, len(rows), size):
            kept = [r for r in rows[k : k + size] if not victim[name](r)]
            if kept:
                out[name, k // size] = kept, len(rows[k : k + size]) - len(kept)
    return out


def check(spark, tables, **more):
    """The result's rows, the files' rows, order, footers and folder against the plain loops."""
    frames = {t: spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMAS[t]).repartition(3) for t, rows in tables.items()}
    got = erase(frames, **more).collect()
    want = naive(tables, **more)
    assert sorted((r.table_name, r.file_no) for r in got) == sorted(want)
    for r in got:
        kept, erased = want[r.table_name, r.file_no]
        assert (r.n_rows, r.n_erased, r.rewritten) == (len(kept), erased, erased > 0)
        assert r.columns == ",".join(frames[r.table_name].columns)
        ids = ",".join("" if v is None else str(v) for v in (next(iter(row.values())) for row in kept))
        assert r.ids_sha256 == hashlib.sha256(ids.encode()).hexdigest()
        money = [row[KINDS[r.table_name].money] for row in kept]
        assert r.cents == sum(math.floor(100 * x + 0.5) for x in money if x is not None and math.isfinite(x))
        file = pq.ParquetFile(r.path)
        assert file.schema_arrow.names == frames[r.table_name].columns
        assert repr(file.read().to_pylist()) == repr(kept)
        first = [row[file.schema_arrow.names[0]] for row in kept if row[file.schema_arrow.names[0]] is not None]
        parts = [file.metadata.row_group(g).column(0).statistics for g in range(file.metadata.num_row_groups)]
        if first:
            assert min(p.min for p in parts if p.has_min_max) == min(first) and max(p.max for p in parts if p.has_min_max) == max(first)
    if got:
        root = Path(got[0].path).parents[1]
        assert sorted(map(str, root.rglob("*.parquet"))) == sorted(r.path for r in got)
        assert not Path(f"{root}-open").exists()
    return got


def some(seed, clients=90, clicks=500, sales=250, lines=700, hot=0.33):
    rng = random.Random(seed)
    moment = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=rng.randrange(10**13))
    who = lambda: None if rng.random() < 0.03 else 7 if rng.random() < hot else rng.randrange(clients + 5)
    money = lambda: rng.choice([None, round(rng.uniform(-50, 900), 2), -0.005, 12.345])
    word = lambda: rng.choice([None, "", "a", "ß,x", "long " * 9])
    out = {
        "clients": [dict(client_id=i, master_id=rng.choice([None, i, i // 2, 3]), source=word(), updated_at=moment(), balance=money(), file_no=1, key=word()) for i in range(clients)],
        "clicks": [dict(click_id=i, ts=moment(), client_id=who(), value=money(), file_row_number=rng.randrange(5), props=word()) for i in range(clicks)],
        "sales": [dict(sale_id=i, client_id=who(), status=word(), total=money(), row=word()) for i in range(sales)],
        "sale_lines": [dict(sale_id=None if rng.random() < 0.02 else 11 if rng.random() < hot else rng.randrange(sales + 9), line_no=rng.randrange(4), item_id=rng.randrange(9), amount=money(), client_id=word(), number=i % 3) for i in range(lines)],
    }
    out["sale_lines"] += out["sale_lines"][:20]
    return out


@pytest.mark.parametrize("seed", range(2))
def test_equals_plain_loops(spark, seed):
    got = check(spark, some(seed), modulus=20, files=30)
    assert any(r.rewritten for r in got) and not all(r.rewritten for r in got)


def test_some_files_are_emptied_and_a_hot_client_goes(spark, monkeypatch):
    tables = some(3, clients=20, clicks=1700, sales=400, lines=900)
    tables["clients"][7]["master_id"] = 70
    tables["clients"] += [dict(tables["clients"][7]), dict(tables["clients"][5], client_id=None, master_id=70)]
    monkeypatch.setattr(erasure, "TASK_ROWS", 100)
    got = check(spark, tables)
    assert len(got) < sum(math.ceil(len(rows) / (1 + len(rows) // 150)) for rows in tables.values()) - 50


def test_repeated_sales_and_odd_amounts(spark):
    tables = some(4)
    tables["sales"] += [dict(tables["sales"][i], client_id=i % 90) for i in range(0, 250, 7)] + [dict(tables["sales"][0], sale_id=None, total=math.nan), dict(tables["sales"][1], total=math.inf)]
    check(spark, tables, modulus=30, files=40)


def test_no_clicks_and_empty_tables(spark):
    """Without clicks the smallest master goes; tables without rows have no files."""
    tables = some(5) | {"clicks": [], "sale_lines": []}
    check(spark, tables)
    assert check(spark, dict.fromkeys(tables, [])) == []
    check(spark, some(6) | {"clients": []})


def test_row_groups_and_spilling_writers(spark, monkeypatch):
    monkeypatch.setattr(erasure, "GROUP_ROWS", 2048)
    monkeypatch.setattr(erasure, "FILES", 2)
    tables = {t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in KINDS}
    got = erase(tables, files=2).where("table_name = 'clicks'").collect()
    assert all(pq.read_metadata(r.path).num_row_groups >= 3 for r in got)
    assert sum(r.n_rows + r.n_erased for r in got) == tables["clicks"].count()


def test_an_attempt_that_is_repeated_finds_the_same(spark, tmp_path):
    """The file that is rewritten stays until all are done, so the second attempt erases as many rows as the first."""
    import pyarrow as pa

    rows = pa.table({"click_id": [1, 2, 3], "client_id": [4, 5, 4], "value": [1.0, 2.5, None]})
    pq.write_table(rows, tmp_path / "00000.parquet")
    shard = lambda: iter([pa.table({"id": [4, 4], "other": pa.nulls(2, pa.int64())})])
    first = erasure._rewrite("clicks", 0, str(tmp_path / "00000.parquet"), str(tmp_path / "open"), shard())
    assert first == erasure._rewrite("clicks", 0, str(tmp_path / "00000.parquet"), str(tmp_path / "open"), shard())
    assert first[3:6] == (1, 2, 250) and pq.read_table(first[2]).to_pylist() == [{"click_id": 2, "client_id": 5, "value": 2.5}]
    none = iter([pa.table({"id": [9], "other": pa.nulls(1, pa.int64())})])
    assert erasure._rewrite("clicks", 0, str(tmp_path / "00000.parquet"), str(tmp_path / "open"), none) is None


def test_the_given_tables(spark):
    """The whole query at sf0.01 against plain loops over the same rows."""
    tables = {t: pq.read_table(f"/root/testdata/sf0.01/{t}.parquet").to_pylist() for t in KINDS}
    want, got = naive(tables), op13_erasure(spark, "/root/testdata/sf0.01").collect()
    assert {(r.table_name, r.file_no): (r.n_rows, r.n_erased) for r in got} == {k: (len(kept), erased) for k, (kept, erased) in want.items()}
    for r in got:
        assert pq.read_table(r.path).to_pylist() == want[r.table_name, r.file_no][0]


def test_needs_a_mounted_folder(spark):
    with pytest.raises(ValueError, match="mounted"):
        erasure.local_folder(spark, "viewfs://store/x") if spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./x", "file:///tmp") is None else None
    assert erasure.local_folder(spark, "file:///tmp/x") == erasure.local_folder(spark, "/tmp/x") == "/tmp/x"


def test_places(spark):
    row = spark.createDataFrame([(12,), (None,)], "c long").select(erasure.place(F.col("c")).alias("k")).collect()
    assert [r.k for r in row] == [zlib.crc32(b"12"), 0]

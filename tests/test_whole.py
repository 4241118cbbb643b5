"""Queries over whole tables, and on rows of their own."""

import duckdb
from pyspark.sql import functions as F
from test_queries import SF, canonical

from ashlar.functions import classify as C
from ashlar.operators import archive
from ashlar.plans import registry


def test_chunks_of_every_entry(spark):
    want = duckdb.sql(f"""
      SELECT l_returnflag, least(n, 17)::BIGINT AS chunks, count(*) AS entries FROM (
        SELECT l_returnflag, l_suppkey, l_linestatus, count(*) AS n FROM '{SF}/lineitem.parquet' GROUP BY ALL) GROUP BY 1, 2""").df()
    assert canonical(registry.queries()["chunks_per_entry"](spark, SF).toPandas()) == canonical(want)


def test_cycles_among_all_suppliers(spark):
    large = SF.replace("0.001", "0.1")
    ids = [r[0] for r in duckdb.sql(f"SELECT s_suppkey FROM '{large}/supplier.parquet'").fetchall()]
    n = len(ids)
    assert n > 100
    up = {i: -1 if i % 7 == 0 else 3 * i % n for i in ids}
    steps = []
    for i in ids:
        k = 0
        while up[i] in up and k <= n:
            i, k = up[i], k + 1
        steps.append(k)
    cyclic = sum(k > n for k in steps)
    assert registry.queries()["tree_cycles"](spark, large).collect() == [(cyclic, min(max(steps), n))]


def test_steps_up_of_chains_and_cycles(spark):
    up = {0: -1, **{i: i - 1 for i in range(1, 120)}, 200: 201, 201: 202, 202: 200, 300: 999, 301: 301, 302: 201}
    got = archive.steps_up(spark.createDataFrame(list(up.items()), "id long, parent long"), len(up) + 1).collect()
    want = {i: min(i, 119) for i in range(120)} | {300: 0}
    assert len(got) == len(up) and {r.id: r.steps for r in got if r.steps <= len(up)} == want


def test_path_filter_over_all_users(spark, tmp_path):
    rows = [(i, i % 7, "view" if i % 4 else "buy", '{"K": 71}' if i % 2 else '{"k": 8}') for i in range(60)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    want = sorted((u, e) for e, u, kind, props in rows if kind == "view" and 'k": 7' in props.lower())
    assert sorted(map(tuple, registry.queries()["path_filter"](spark, str(tmp_path)).collect())) == want


def test_entropy_of_whole_texts(spark, tmp_path):
    texts = ["a" * 65536 + "b" * 65536, "abcd" * 20000, "x" * 65536 + "y"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'s' as source", "'en' as lang").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.entropy for r in registry.queries()["byte_entropy"](spark, str(tmp_path)).collect()}
    assert got == {0: 1.0, 1: 2.0, 2: 0.0003}


def test_sizes_round_as_printf(spark, tmp_path):
    sizes = [None, 0, 1023, 1024, 1280, 1792, 3328, 1048575, 1048576, 1310720, 1073741823, 1342177280, (1 << 40) - 1, 1 << 40, (1 << 40) + (1 << 38), (1 << 53) + 2, 9 * 10**18]
    sizes += [k * 128 + d for k in range(8, 60) for d in (-1, 0, 1)]
    rows = spark.createDataFrame([(6 * i, n) for i, n in enumerate(sizes)], "doc_id long, n_chars long")  # the query scales each sixth by one
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(registry.ORACLES["format_bytes"]).df()
    assert canonical(registry.queries()["format_bytes"](spark, str(tmp_path)).toPandas()) == canonical(want)
    up_to_tib = rows.select("n_chars", C.format_bytes(F.col("n_chars")).alias("size")).filter("n_chars >= 1024").collect()
    for r in up_to_tib:
        k = max(k for k in range(1, 5) if r.n_chars >= 1024**k)
        assert r.size == f"{r.n_chars / 1024**k:.1f} {'KMGT'[k - 1]}iB"

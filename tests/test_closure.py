from loomtide.operators import traverse


def test_closure_sends_no_table_to_the_driver(spark, tmp_path, monkeypatch):
    plans, cut = [], traverse.cut_lineage
    monkeypatch.setattr(traverse, "cut_lineage", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1])
    edges = [(i, i + 1) for i in range(1, 7)] + [(7, 1), (3, 6), (3, 6), (9, 9)]
    spark.createDataFrame(edges, "src long, dst long").write.parquet(f"{tmp_path}/edges")
    got = {(r["src"], r["dst"]): r["hops"] for r in traverse.closure(spark.read.parquet(f"{tmp_path}/edges")).collect()}
    want = {(a, b): 1 for a, b in edges}
    for hops in range(2, 9):
        for (a, b), h in list(want.items()):
            if h == hops - 1:
                for c, d in edges:
                    if c == b:
                        want.setdefault((a, d), hops)
    assert got == want and len(plans) > 2
    assert not any("Broadcast" in p for p in plans)

from loomtide.llm import setsketch


def test_components_are_looked_up_once_a_text_not_once_a_bucket(spark, monkeypatch):
    plans, cut = [], setsketch.cut

    def kept(df, name="table", **kw):
        if name == "open":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df, name, **kw)

    monkeypatch.setattr(setsketch, "cut", kept)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w if k != i else f"x{i}" for k, w in enumerate(words))) for i in range(12)]
    got = {r["component_id"] for r in setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    assert got == {0}
    # Buckets are taken apart above the join with the roots.
    assert 0 <= plans[0].find("Generate inline") < plans[0].find("LeftOuter")

"""Benchmark items shorter than a shingle."""

import duckdb

from docframe.llm import decontaminate


def test_short_items_are_found_in_documents(spark):
    items = {1: "paris", 2: "Blue  whale", 3: "one two three four", 4: "one two three four five", 5: "", 6: "blue whale"}
    texts = {1: "capital: Paris", 2: "the blue\nwhale sings", 3: "zero one two three four six", 4: "Parisian blue whales", 5: "one two three four five", 6: "paris"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    asked = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = {(1, 1), (2, 2), (2, 6), (3, 3), (5, 3), (5, 4), (6, 1)}
    found = decontaminate.contaminated(docs, asked, short_items=True).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and all(r.n_shared == r.n_item == 1 for r in found)
    left = decontaminate.drop_contaminated(docs, asked, short_items=True)
    assert {r.doc_id for r in left.collect()} == {4}
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("benchmark", asked.toPandas())
    rows = sorted(tuple(r) for r in docs.sparkSession.createDataFrame(found).select("doc_id", "item_id", "n_shared", "n_item", "containment").collect())
    assert sorted(con.execute(decontaminate.contaminated_sql()).fetchall()) == rows

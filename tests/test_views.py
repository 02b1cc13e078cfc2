"""The review view: same rows as its SQL, and texts that no exchange moves."""

from __future__ import annotations

import pytest

from vetline.plans import views as V

DAYS = "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(id)"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Small tables with repeated and null keys."""
    d = str(tmp_path_factory.mktemp("tables"))
    made = {
        "part": "SELECT id AS p_partkey, concat('part ', id) AS p_name, 'b' AS p_brand, 't' AS p_type FROM range(7) UNION ALL "
                "SELECT 3L, 'again', NULL, 't'",
        "customer": "SELECT id AS c_custkey, concat('c', id) AS c_name FROM range(5) UNION ALL SELECT 2L, 'twice'",
        "documents": "SELECT id AS doc_id, CASE WHEN id = 4 THEN NULL ELSE concat('text ', id) END AS text, 'en' AS lang FROM range(1, 6) "
                     "UNION ALL SELECT 2L, 'other', 'en' UNION ALL SELECT NULL, 'no id', 'en'",
        "events": f"SELECT id AS event_id, id % 6 AS user_id, {DAYS} AS ts FROM range(40) UNION ALL "
                  f"SELECT NULL, 1L, {DAYS.replace('id', '1')} UNION ALL SELECT 7L, NULL, {DAYS.replace('id', '2')}",
        "nation": "SELECT CAST(id AS INT) AS n_nationkey, concat('n', id) AS n_name, CAST(id % 5 AS INT) AS n_regionkey FROM range(9)",
    }
    for name, sql in made.items():
        spark.sql(sql).write.parquet(f"{d}/{name}.parquet")
    return d


def test_same_rows_as_the_sql(spark, tables):
    got = V.reviews(spark, tables)
    counts = {"n_docs": V.load(spark, tables, "documents").count(), "n_parts": V.load(spark, tables, "part").count()}
    want = spark.sql(V.with_views("spark", select="SELECT * FROM reviews", **counts))
    assert got.schema == want.schema
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert got.where("text LIKE 'other%'").count() > 0 and got.where("text IS NULL").count() > 0


def test_no_exchange_moves_the_texts(spark, tables):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = V.reviews(spark, tables).select("row_no", "text", "user_name", "place_name")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the texts stand above the join with documents; what is exchanged lies below it
    assert "Exchange" not in plan.split("SortMergeJoin [doc_key")[0]


def test_pairs_meet_their_place_before_their_texts(spark, tables):
    from vetline.plans import catalog

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        pairs = catalog._eval_pairs_spark(spark, tables).select("row_no", "text", "place_desc")
        plan = pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan.split("SortMergeJoin [doc_key")[0]
    counts = {"n_docs": V.load(spark, tables, "documents").count(), "n_parts": V.load(spark, tables, "part").count()}
    want = spark.sql(V.with_views("spark", select="SELECT r.row_no, r.text, p.description FROM reviews r JOIN places p "
                                  "ON p.place_id = r.place_id", **counts))
    assert sorted(map(str, pairs.select("row_no", "text").collect())) == sorted(map(str, want.select("row_no", "text").collect()))


def test_relevancy_queries_store_no_text(spark, tables, monkeypatch):
    """What the pair queries keep has neither texts nor, where they are fetched
    again, descriptions; repeated and missing places and documents count."""
    from vetline.operators import relevancy as RL
    from vetline.plans import catalog
    from vetline.session import stored_rows

    kept = []
    for module in (catalog, RL):
        monkeypatch.setattr(module, "stored_rows", lambda df: kept.append(set(df.columns)) or stored_rows(df))
    counts = {"n_docs": V.load(spark, tables, "documents").count(), "n_parts": V.load(spark, tables, "part").count()}
    want = spark.sql(V.with_views("spark", select="SELECT r.review_id, r.row_no, r.text, concat(coalesce(p.place_name, ''), ' — ', "
                                  "coalesce(p.place_category, ''), ', ', coalesce(p.city, ''), '. ', coalesce(p.description, '')) AS place_desc "
                                  "FROM reviews r JOIN places p ON p.place_id = r.place_id", **counts))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(catalog.q_eval_pairs(spark, tables)) == rows(want.select("review_id", "place_desc")) and not kept
    assert rows(catalog._eval_pairs_spark(spark, tables).select("row_no", "text", "place_desc")) == rows(want.select("row_no", "text", "place_desc"))
    score = "(length(coalesce(text, '')) * 7 + length(place_desc) * 3) % 101 / 10.0D - 3.0D"
    told = want.selectExpr("row_no", f"round(1.0D / (1.0D + exp(-({score}))), 6) AS relevancy")
    assert rows(catalog.q_scorer_relevancy(spark, tables)) == rows(told)
    assert len(kept) == 2 and not any("text" in c for c in kept) and "place_desc" in kept[0] and "place_desc" not in kept[1]


def test_model_reviews_meet_their_split_before_their_texts(spark, tables, monkeypatch):
    from vetline.operators import multilabel as ML
    from vetline.plans import catalog

    seen = []
    fit = ML.MultiLabelModel.fit.__func__
    monkeypatch.setattr(ML.MultiLabelModel, "fit", classmethod(lambda cls, df, **kw: seen.append(df) or fit(cls, df, **kw)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = catalog.q_multilabel_fit_predict(spark, tables)
        plan = seen[0].select("text", "weak_labels")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan.split("SortMergeJoin [doc_key")[0]
    r = V.reviews(spark, tables)
    want = catalog.S.assign_split(r, catalog.S.place_split(r, cfg=catalog.SplitConfig(0.2, 0.2, 42))).where("split = 'train'")
    assert sorted(map(str, seen[0].select("row_no", "text").collect())) == sorted(map(str, want.select("row_no", "text").collect()))
    assert out.count() == r.count()

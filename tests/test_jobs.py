"""Batch jobs end to end on small written fixtures."""

import os
import tempfile

from vetline.plans import jobs


def _write(path, header, rows):
    with open(path, "w", encoding="utf-8") as f:
        f.write(header + "\n")
        for r in rows:
            f.write(",".join(f'"{v}"' for v in r) + "\n")


def test_prepare_train_evaluate_screen(spark):
    d = tempfile.mkdtemp(prefix="vetline-jobs-")
    src = os.path.join(d, "converted")
    os.makedirs(src)
    header = "review_id,place_id,place_name,place_category,city,text,rating,created_at,user_id,user_name,pics"
    texts = ["See http://offers.example for a coupon", "I did not go but it is bad",
             "soooooo nice!!!!!!", "Nice quiet place, we ordered coffee"]
    rows = [(f"r{i}", f"p{i % 12}", "Cafe", "cafe", "Town", texts[i % 4], "4", "2024-06-01", f"u{i % 5}", "Amy VG", "[]")
            for i in range(48)]
    _write(os.path.join(src, "a.csv"), header, rows[:24])
    _write(os.path.join(src, "b.csv"), header, rows[24:])
    _write(os.path.join(src, "train_old.csv"), header, rows[:2])  # skipped by name

    words = spark.createDataFrame([("the house and the place", "en"), ("la maison et le chat", "fr")], "text string, lang string")
    jobs.train_language(words, os.path.join(d, "lang"))
    out = jobs.prepare(spark, "file://" + src, os.path.join(d, "splits"), os.path.join(d, "lang"))
    assert {r[0] for r in out.select("lang").distinct().collect()} <= {"en", "fr"}
    assert out.count() == 48
    written = spark.read.parquet(os.path.join(d, "splits"))
    assert {r[0] for r in written.select("split").distinct().collect()} == {"train", "val", "test"}

    train = written.where("split = 'train'")
    model = jobs.train(train, os.path.join(d, "models"), "t1")
    assert spark.read.json(os.path.join(d, "models", "multilabel_t1", "thresholds")).first()["spam"] == 0.5
    assert spark.read.json(os.path.join(d, "models", "multilabel_t1", "relevancy_sample")).count() == 10
    loaded = jobs.train_or_load(spark, "file://" + os.path.join(d, "models"), train)
    assert set(loaded.models) == set(model.models)

    labelled = spark.createDataFrame([(f"g{i}", texts[i % 4], 1 if i % 4 == 0 else 0) for i in range(16)],
                                     "review_id string, text string, is_fake int")
    metrics, means = jobs.evaluate(labelled, loaded)
    m = {r["strategy"]: r for r in metrics.collect()}
    assert set(m) == {"spam_only", "any_violation"}
    assert m["any_violation"]["tp"] + m["any_violation"]["fn"] == 4
    assert means.count() == 1

    preds = jobs.screen_to_sink(written.drop("split"), None, os.path.join(d, "preds"), model=loaded)
    back = spark.read.json(os.path.join(d, "preds"))
    assert back.count() == 48 and "confidences" in back.columns
    assert preds.columns[0] == "review_id"


def test_relevancy_sample_fetches_no_other_texts(spark, monkeypatch):
    """The first n rows by (review_id, text), nulls first, and ties at the end."""
    rows = [(None, "p1", "b"), (None, "p1", None), ("r2", "p1", "x"), ("r2", "p2", "x"), ("r2", "p1", "x"), ("r3", "p1", "late")]
    train = spark.createDataFrame(rows, "review_id string, place_id string, text string").selectExpr(
        "*", "'n' AS place_name", "'c' AS place_category", "'t' AS city")
    seen = []
    monkeypatch.setattr(jobs, "relevancy_scores", lambda pairs, *a: seen.append(pairs) or pairs)
    got = jobs.relevancy_sample(train, None, 4).collect()
    assert sorted((r.review_id or "", r.text or "") for r in got) == [("", ""), ("", "b"), ("r2", "x"), ("r2", "x")]
    assert jobs.relevancy_sample(train.limit(0), None, 4).count() == 0
    assert jobs.relevancy_sample(train, None, 99).count() == 6
    # rows behind the last one of the sample are filtered out first
    plans = []
    monkeypatch.setattr(jobs, "stored_rows", lambda df: plans.append(df) or df)
    jobs.relevancy_sample(train, None, 4)
    assert "Filter" in plans[0]._jdf.queryExecution().optimizedPlan().toString()

"""Sources, converters, sinks, model IO and streaming on small written fixtures."""

import gzip
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from vetline.functions.pics import parse_pics
from vetline.operators.features import add_weak_labels
from vetline.operators.multilabel import MultiLabelModel, latest_model_dir
from vetline.sources import converters as CV
from vetline.sources.readers import read_csv_folder, read_json_lines, read_lexicon, read_reviews_csv
from vetline.sources.sinks import write_splits

CSV = (
    "\n"
    "review_id,place_id,place_name,place_category,city,text,rating,created_at,user_id,user_name,pics\n"
    'k1,q1,Corner Deli,deli,Bremen,"Good soup, ""warm"".\nNext line",4,2023-02-03,w1,"Ola Berg","[]"\n'
    'k2,q2,Old Mill,museum,Kiel,"zzzzzz!!! www.offers.example",1,2023-05-06,w2,"zzzz",'
    '"[""http://pics.example/7""]"\n'
    "k3,q2,Old Mill,museum,Kiel,,1,,w3,,\n"
)


def _tmp():
    return tempfile.mkdtemp(prefix="vetline-io-")


def test_review_csv_quirks(spark):
    d = _tmp()
    with open(os.path.join(d, "reviews.csv"), "w", encoding="utf-8") as f:
        f.write(CSV)
    df = read_reviews_csv(spark, d)
    rows = {r["review_id"]: r for r in df.collect()}
    assert rows["k1"]["text"] == 'Good soup, "warm".\nNext line'
    assert rows["k1"]["rating"] == 4.0
    assert rows["k3"]["text"] is None and rows["k3"]["user_lat"] is None
    pics = {r["review_id"]: r["p"] for r in df.select("review_id", parse_pics("pics").alias("p")).collect()}
    assert pics["k2"] == ["http://pics.example/7"] and pics["k3"] == []


def test_jsonl_and_mcauley(spark):
    d = _tmp()
    os.makedirs(os.path.join(d, "nested"))
    lines = [json.dumps({"gmap_id": "g1", "user_id": "u1", "name": "Ann", "text": "nice", "rating": 5, "time": 1622505600000,
                         "pics": [{"url": ["a", "b"]}, {"url": "c"}, {"x": 1}]}),
             "{'gmap_id': 'g2', 'user_id': 'u2', 'text': 'ok', 'rating': 0}", "{bad", ""]
    with gzip.open(os.path.join(d, "nested", "part.json.gz"), "wt", encoding="utf-8") as f:
        f.write("\n".join(lines))
    out = {r["place_id"]: r for r in CV.convert_mcauley(read_json_lines(spark, d)).collect()}
    assert set(out) == {"g1", "g2"} and out["g2"]["text"] == "ok"
    assert out["g1"]["review_id"] == "g1_u1_1622505600000"
    assert json.loads(out["g1"]["pics"]) == ["a", "b", "c"]
    assert out["g2"]["rating"] == "" and out["g2"]["user_name"] == "" and out["g2"]["pics"] == "[]"


def test_folder_union_and_labelled(spark):
    d = _tmp()
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write("business_id,text,photo\nb1,hello,http://x/1\nb2,bye,\n")
    with open(os.path.join(d, "b.csv"), "w") as f:
        f.write("review,label\ngood,real\nfake one,Fake\n")
    with open(os.path.join(d, "train.csv"), "w") as f:
        f.write("x\n1\n")
    with open(os.path.join(d, "c.csv"), "w") as f:
        f.write("business_id,text,photo\nb3,hm,\n")
    with open(os.path.join(d, "empty.csv"), "w") as f:
        f.write("\n")
    df, skipped = read_csv_folder(spark, "file://" + d)
    assert skipped == ["empty.csv"]
    assert set(df.columns) == {"business_id", "text", "photo", "review", "label"} and df.count() == 5
    g = {r["place_id"]: r["pics"] for r in CV.convert_generic(spark.read.option("header", True).csv(
        os.path.join(d, "a.csv")), id_col="business_id").collect()}
    assert g == {"b1": '["http://x/1"]', "b2": "[]"}
    lab = CV.convert_labelled(spark.read.option("header", True).csv(os.path.join(d, "b.csv")))
    assert sorted((r["text"], r["is_fake"]) for r in lab.collect()) == [("fake one", 1), ("good", 0)]


def test_split_sink(spark):
    d = _tmp()
    df = spark.createDataFrame([(f"r{i}", f"p{i % 9}", "t") for i in range(60)], "review_id string, place_id string, text string")
    from vetline.operators.split import assign_split, place_split
    write_splits(assign_split(df, place_split(df)), os.path.join(d, "out"))
    back = spark.read.parquet(os.path.join(d, "out"))
    assert back.count() == 60 and {r[0] for r in back.select("split").distinct().collect()} == {"train", "val", "test"}


def test_partitions_are_written_in_files_of_bounded_size(spark):
    from vetline.sources.sinks import write_table

    d = _tmp()
    df = spark.createDataFrame([("big" if i % 3 else None, i, "x" * 100) for i in range(900)], "g string, i int, t string").repartition(5)
    write_table(df, f"{d}/t", partition_by=["g"], file_bytes=10_000)
    files = {k: sum(f.endswith(".parquet") for f in os.listdir(f"{d}/t/{k}")) for k in os.listdir(f"{d}/t") if k.startswith("g=")}
    assert set(files) == {"g=big", "g=__HIVE_DEFAULT_PARTITION__"} and 1 <= min(files.values()) and max(files.values()) <= 7
    write_table(df.where("g = 'big'").limit(10), f"{d}/t", partition_by=["g"])  # replaces that value only
    back = spark.read.parquet(f"{d}/t")
    assert back.where("g is null").count() == 300 and back.where("g = 'big'").count() == 10


def test_model_roundtrip(spark):
    texts = (["See http://offers.example for a coupon now"] * 6 + ["I did not go but it is bad"] * 6
             + ["soooooo good food!!!!!!"] * 6 + ["Nice quiet place with good coffee"] * 12)
    df = spark.createDataFrame([(f"r{i}", t) for i, t in enumerate(texts)], "review_id string, text string")
    model = MultiLabelModel.fit(add_weak_labels(df), max_iter=200)
    d = _tmp()
    model.save(os.path.join(d, "multilabel_a"))
    model.save(os.path.join(d, "multilabel_b"))
    loaded = MultiLabelModel.load(latest_model_dir(spark, d))
    a = {r["review_id"]: r["pred_labels"] for r in model.transform(df).collect()}
    b = {r["review_id"]: r["pred_labels"] for r in loaded.transform(df).collect()}
    assert a == b
    assert a["r0"] == ["Advertisement/Promo"] and a["r6"] == ["Rant (Likely Non-Visitor)"]
    assert a["r12"] == ["Spam/Low-quality"] and a["r20"] == []


def test_unreadable_files_are_skipped_and_reported(spark):
    d = _tmp()
    with open(os.path.join(d, "a.csv.gz"), "wb") as f:
        f.write(b"\x1f\x8b\x08 not a gzip file")
    assert read_csv_folder(spark, d) == (None, ["a.csv.gz"])
    for i in range(5):
        with open(os.path.join(d, f"b{i}.csv"), "w") as f:
            f.write(f"text,label\nrow {i},1\n")
    whole = gzip.compress(b"text,other\n" + b"x,y\n" * 50_000)
    with open(os.path.join(d, "cut.csv.gz"), "wb") as f:
        f.write(whole[:len(whole) // 2])
    with open(os.path.join(d, "whole.csv.gz"), "wb") as f:
        f.write(whole)
    df, skipped = read_csv_folder(spark, d)
    assert skipped == ["a.csv.gz", "cut.csv.gz"] and df.count() == 50_005


def test_largest_csv(spark):
    from vetline.sources.readers import largest_csv

    d = _tmp()
    for name, rows in (("small.csv", 2), ("big.csv", 50), ("notes.txt", 500)):
        with open(os.path.join(d, name), "w") as f:
            f.write("text,label\n" + "".join(f"row {i},1\n" for i in range(rows)))
    assert largest_csv(spark, d).endswith("/big.csv")


def test_model_reaches_the_penalised_optimum(spark):
    import numpy as np

    from vetline.operators.multilabel import label_matrix
    from vetline.operators.tfidf import vector_column

    texts = ["See http://offers.example for a coupon", "I did not go but it is bad", "soooooo nice!!!!!!", "Nice quiet place"]
    rows = [(f"r{i}", f"{texts[i % 4]} w{i % 5} v{i % 3}") for i in range(40)]
    df = add_weak_labels(spark.createDataFrame(rows, "review_id string, text string"))
    model = MultiLabelModel.fit(df, tol=1e-7)
    assert model.constants["irr"] == 0.0  # no rule gives that label
    print(f"{model.passes} passes, gap {model.gap:.1e}")
    assert model.passes < 60 and model.gap <= 1e-7
    data = {r.review_id: r for r in label_matrix(df).collect()}
    vectors = {r.review_id: r for r in df.withColumn("v", vector_column("text", model.terms, model.idf)).select("review_id", "v.*").collect()}
    x = np.zeros((len(data), len(model.terms) + 1))
    x[:, -1] = 1.0
    for i, k in enumerate(data):
        x[i, vectors[k].codes] = vectors[k].weights
    for j, key in ((0, "ad"), (3, "spam")):
        y = np.array([r[f"y_{key}"] for r in data.values()]) * 2 - 1

        def objective(w):
            return np.logaddexp(0, -y * (x @ w)).sum() + w @ w / 2

        w = np.zeros(x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(y * (x @ w)))
            w = w - np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.eye(len(w)), w - x.T @ (y * p))
        got = model.weights[:, j]
        assert objective(got) / len(y) - objective(w) / len(y) < 1e-6
        assert np.abs(got - w).max() < 1e-2


def test_fit_in_many_blocks_and_tasks(spark, monkeypatch):
    import numpy as np

    from vetline.operators import logistic

    texts = ["See http://offers.example for a coupon", "I did not go but it is bad", "soooooo nice!!!!!!", "", None]
    rows = [(f"r{i}", None if texts[i % 5] is None else f"{texts[i % 5]} w{i % 5} v{i % 3}") for i in range(90)]
    df = add_weak_labels(spark.createDataFrame(rows, "review_id string, text string")).repartition(7)
    whole = MultiLabelModel.fit(df, tol=1e-12)
    monkeypatch.setattr(logistic, "BLOCK_VALUES", 20)
    monkeypatch.setattr(logistic, "DIRECT_TASKS", 0)
    parts = MultiLabelModel.fit(df, tol=1e-12)
    assert whole.terms == parts.terms and np.abs(whole.weights - parts.weights).max() < 1e-4


def test_fit_without_rows(spark):
    df = spark.createDataFrame([], "review_id string, text string, weak_labels array<string>")
    model = MultiLabelModel.fit(df)
    some = spark.createDataFrame([("a", "any text")], "review_id string, text string")
    row = model.transform(some).first()
    assert row.p_ad == 0.0 and row.pred_labels == []


def test_a_run_that_broke_off_is_not_the_newest(spark):
    from vetline.sources import registry

    df = add_weak_labels(spark.createDataFrame([("a", "See http://x.example"), ("b", "fine food")], "review_id string, text string"))
    model, d = MultiLabelModel.fit(df), _tmp()
    model.save(f"{d}/multilabel_a")
    with pytest.raises(RuntimeError):
        with registry.committed(spark, f"{d}/multilabel_b") as folder:
            df.write.parquet(f"{folder}/weights")
            raise RuntimeError("lost")
    os.makedirs(f"{d}/multilabel_c/weights")  # parts, but no manifest
    model.save(f"{d}/multilabel_d")
    part = next(f for f in os.listdir(f"{d}/multilabel_d/weights") if f.endswith(".parquet"))
    os.remove(f"{d}/multilabel_d/weights/{part}")  # a manifest, but not its files
    assert latest_model_dir(spark, d).endswith("/multilabel_a") and len(registry.runs(spark, d)) == 1
    assert sorted(os.listdir(d)) == ["multilabel_a", "multilabel_c", "multilabel_d"]
    with pytest.raises(ValueError, match="multilabel_d"):
        MultiLabelModel.load(f"{d}/multilabel_d")
    with pytest.raises(ValueError, match="no committed run"):
        MultiLabelModel.load(f"{d}/multilabel_c")
    model.save(f"{d}/multilabel_a")  # a name may be taken again
    assert MultiLabelModel.load(f"{d}/multilabel_a").transform(df).count() == 2


def test_a_changed_file_is_told(spark):
    df = add_weak_labels(spark.createDataFrame([("a", "See http://x.example"), ("b", "fine food")], "review_id string, text string"))
    d = _tmp()
    MultiLabelModel.fit(df).save(f"{d}/m")
    part = next(f for f in os.listdir(f"{d}/m/weights") if f.endswith(".parquet"))
    with open(f"{d}/m/weights/{part}", "r+b") as f:
        f.seek(20)
        f.write(b"\x00\x01\x02")
    os.remove(f"{d}/m/weights/.{part}.crc")
    with pytest.raises(ValueError, match="changed"):
        MultiLabelModel.load(f"{d}/m")


def test_large_shares_are_written_where_they_stand(spark, monkeypatch):
    """Tasks that hold enough of each value write it in bounded files without an
    exchange, and leave the session as it was; small ones are still dealt."""
    from vetline.sources import sinks

    d = _tmp()
    df = spark.createDataFrame([("ab"[i % 2] if i % 5 else None, i, "x" * 100) for i in range(1000)], "g string, i int, t string").repartition(2)
    dealt = []
    monkeypatch.setattr(sinks, "spread_by_size", lambda *a, f=sinks.spread_by_size: dealt.append(a) or f(*a))
    sinks.write_table(df, f"{d}/t", partition_by=["g"], file_bytes=10_000, compression="zstd")
    files = {k: sum(f.endswith(".zstd.parquet") for f in os.listdir(f"{d}/t/{k}")) for k in os.listdir(f"{d}/t") if k.startswith("g=")}
    assert not dealt and len(files) == 3 and all(2 <= n <= 8 for n in files.values())
    back = spark.read.parquet(f"{d}/t")
    assert sorted(map(str, back.select("g", "i", "t").collect())) == sorted(map(str, df.collect()))
    assert back.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 20_000 // 108
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    sinks.write_table(df.where("g = 'a'"), f"{d}/t", partition_by=["g"])  # a few kilobytes
    assert len(dealt) == 1 and spark.read.parquet(f"{d}/t").count() == 1000
    sinks.write_table(df.limit(0), f"{d}/t", partition_by=["g"])
    assert spark.read.parquet(f"{d}/t").count() == 1000


def test_splits_are_assigned_before_the_texts(spark, tmp_path, monkeypatch):
    from vetline.plans import catalog
    from vetline.session import stored_rows

    made = {"part": "SELECT id AS p_partkey, 'n' AS p_name, 'b' AS p_brand, 't' AS p_type FROM range(30)",
            "customer": "SELECT id AS c_custkey, 'c' AS c_name FROM range(5)",
            "documents": "SELECT id AS doc_id, CASE WHEN id <> 4 THEN concat('text ', id) END AS text, 'en' AS lang FROM range(1, 6) "
                         "UNION ALL SELECT 2L, 'other', 'en'",
            "events": "SELECT id AS event_id, id % 6 AS user_id, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts FROM range(90)",
            "nation": "SELECT CAST(id AS INT) AS n_nationkey, 'n' AS n_name, CAST(id % 5 AS INT) AS n_regionkey FROM range(9)"}
    for name, sql in made.items():
        spark.sql(sql).write.parquet(f"{tmp_path}/{name}.parquet")
    kept = []
    monkeypatch.setattr(catalog, "stored_rows", lambda df: kept.append(df.columns) or stored_rows(df))
    got = catalog.q_split_sink(spark, str(tmp_path))
    assert kept and not any("text" in c for c in kept)
    r = catalog.V.reviews(spark, str(tmp_path))
    want = catalog.S.assign_split(r, catalog.S.place_split(r)).select("row_no", "review_id", "text", "split")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.where("split = 'val'").count() > 0

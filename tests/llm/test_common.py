import time

from vetline.llm.common import drop_exchanges, open_store, store_uri, stored


def test_store_uri():
    assert store_uri("s3a://bucket/a/b") == "s3://bucket/a/b" and store_uri("s3n://b/c") == "s3://b/c"
    assert store_uri("file:/tmp/x") == "file:///tmp/x" == store_uri("file:///tmp/x")
    assert store_uri("hdfs://node/x") == "hdfs://node/x"


def test_local_store(tmp_path):
    for folder in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        store, path = open_store(folder)
        with store.open_output_stream(f"{path}/f") as out:
            out.write(b"x")
        assert (tmp_path / "f").read_bytes() == b"x"


def test_exchange_files_go(spark):
    """After a stored result the files of its exchange are removed, not only
    when the driver's memory next fills up."""
    drop_exchanges(spark)
    time.sleep(2)
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: sum("shuffle_" in line for line in blocks.getAllFiles().mkString("\n").split("\n"))
    before = held()
    stored(spark.range(100_000).repartition(4, "id"), "exchanged")
    assert held() > before
    drop_exchanges(spark)
    for _ in range(50):
        if held() <= before:
            break
        time.sleep(0.2)
    assert held() <= before

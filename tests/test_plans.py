"""Plan shape: the scale properties the README claims, read from explain()."""

import contextlib
import datetime as dt
import io
import re

from vetline.plans.screen import screen_reviews
from vetline.operators.tfidf import tfidf_relevancy
from vetline.operators.windows import dup_across_places, user_burst_24h


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_burst_shuffles_by_user_and_time_bucket(spark):
    df = spark.createDataFrame([("a", "u", dt.datetime(2024, 1, 1))], "rid string, user_id string, dt timestamp_ntz")
    plan = _plan(user_burst_24h(df))
    exchanges = [line for line in plan.splitlines() if "hashpartitioning(" in line]
    assert any("user_id" in line and "_vt_bucket" in line for line in exchanges)
    # no window is partitioned by the user alone
    rows = [line for line in exchanges if "_vt_us" in line]
    assert not any("hashpartitioning(user_id#" in line and "_vt_bucket" not in line for line in rows)


def test_duplicates_shuffle_digests_after_partial_aggregation(spark):
    df = spark.createDataFrame([("1", "u", "t", "p")], "rid string, user_id string, text_norm string, place_id string")
    plan = _plan(dup_across_places(df).select("rid", "dup_across_places"))
    assert "partial_min" in plan and "partial_max" in plan
    assert not any("hashpartitioning(" in line and "text_norm" in line for line in plan.splitlines())


def test_screening_shuffles_no_text_behind_the_feature_table(spark):
    rows = [(str(i), "p", "n", "c", "x", "some text", f"u{i}", "2024-01-01") for i in range(5)]
    df = spark.createDataFrame(rows, "review_id string, place_id string, place_name string, place_category string, "
                                     "city string, text string, user_id string, created_at string")
    plan = screen_reviews(df)._jdf.queryExecution().executedPlan().toString()
    behind = re.findall(r"Exchange hashpartitioning[^\n]*", plan)
    assert behind
    full = _plan(screen_reviews(df))
    for block in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", full):
        names = {c.split("#")[0].strip() for c in block.split(",")}
        assert not names & {"text", "text_norm", "place_desc", "description"}, names


def test_relevancy_needs_one_shuffle(spark):
    df = spark.createDataFrame([("a", "x y", "x z")], "review_id string, text string, description string")
    plan = _plan(tfidf_relevancy(df))
    assert "Exchange" not in plan.split("== Physical Plan ==")[1].split("(1)")[0]

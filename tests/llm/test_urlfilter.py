import math
import re
import string
from collections import Counter

import pytest

from vetline.llm.urlfilter import (
    LEXICAL, PRIOR_ROWS, RULES, _with_rates, judge, lexical_features, rule_labels, train, training_sample)

URLS = ["http://a.net/", "https://x.EXAMPLE.net/en/5", "https://example.net/english", "HTTP://Example.com/de/x?y=1&z=2#f",
        "ftp://notexample.com/de/", "http://example.com.de/", "https://m.org/fr/", "org/fr/", None, "", "://", "http://net",
        "http://net/x", "http://é.ORG/fr/ÀB?c", "http://user@host.org:80/fr/a", "http://a.b://c.net/", "http://host.net?x=/y",
        "x\n://e.net/a", "http://İ.net/", "http://" + "a" * 20_000 + ".com/" + "1/" * 5000]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return "".join(c.lower() if c in string.ascii_uppercase else c for c in host), path


def rule(host, path):
    best = None
    for text, verdict in RULES:
        name, _, prefix = text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + prefix):
            if best is None or len(text) > len(best[0]):
                best = (text, verdict)
    return best


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(0, URLS[0], "x"), (None, URLS[1], None)]
    rows += [(1000 + i, f"http://{'spam-farm-' if i % 2 else 'site'}{i}.{'net' if i % 2 else 'org'}/fr/{i}", "x") for i in range(200)]
    return spark.createDataFrame(rows, "page_id long, url string, host string")


def test_rules_and_parts(pages):
    out = judge(pages, RULES, train(rule_labels(pages, RULES))).collect()
    assert len(out) == pages.count()
    by_id = {r.page_id: r for r in out}
    for i, u in enumerate(URLS):
        host, path = parts(u)
        want = rule(host, path)
        assert (by_id[i].host, by_id[i].path) == (host, path), u
        assert by_id[i].rule == (want[0] if want else None), u
        assert by_id[i].verdict == want[1] if want else by_id[i].verdict in ("allow", "block")


def test_features(pages):
    rows = {r.page_id: r for r in lexical_features(pages.drop("host")).collect()}
    for i, u in enumerate(URLS):
        u, n = u or "", Counter(u or "")
        want = -sum(c / len(u) * math.log2(c / len(u)) for c in n.values())
        assert rows[i].entropy == pytest.approx(want, abs=1e-9)
        assert rows[i].url_length == len(u) and all(rows[i][f] is not None for f in LEXICAL)
    assert rows[3].n_params == 2 and rows[3].has_fragment == 1


def test_held_out_accuracy(spark):
    bad = [(f"http://cheap-pills-{i}.shop{i % 7}.biz/buy/{i}{i}{i}?a={i}&b={i}", 1.0) for i in range(300)]
    good = [(f"https://www.site{i % 40}.example.org/news/story-{i % 9}", 0.0) for i in range(300)]
    seen = spark.createDataFrame(bad[:200] + good[:200] + [(None, 1.0), ("http://x", None)], "url string, label double")
    held = spark.createDataFrame([(i, *r) for i, r in enumerate(bad[200:] + good[200:])], "page_id long, url string, label double")
    model = train(seen, max_rows=300)
    out = {r.page_id: r.verdict for r in judge(held, [], model).collect()}
    right = sum((out[r.page_id] == "block") == (r.label == 1.0) for r in held.collect())
    assert right >= 0.95 * held.count()


def test_one_label_and_empty(spark, pages):
    one = spark.createDataFrame([("http://a.b/", 1.0)], "url string, label double")
    assert {r.verdict for r in judge(pages, [], train(one)).collect()} == {"block"}
    assert {r.verdict for r in judge(pages, [], train(one.limit(0))).collect()} == {"allow"}
    assert judge(pages.limit(0), RULES, train(one)).count() == 0


def test_rates_count_all_labelled_rows(spark):
    rows = [(f"http://h{i % 90}.part{i % 7}.example/{i}", float(i % 90 % 2)) for i in range(900)] + [("http://hot.example/", 1.0)] * 500
    labelled = spark.createDataFrame(rows, "url string, label double")
    urls = labelled.groupBy("url", "label").count()
    assert training_sample(urls, 40).count() == 40
    model = train(labelled, max_rows=40)
    overall = sum(label for _, label in rows) / len(rows)
    assert model.rates[0] == pytest.approx(overall)
    for k, table in zip((1, 2, 3), model.rates[1:]):
        want = {}
        for url, label in rows:
            want.setdefault(".".join(url.split("/")[2].split(".")[-k:]), []).append(label)
        got = {r[0]: r[1] for r in table.collect()}
        assert got == pytest.approx({s: (sum(v) + PRIOR_ROWS * overall) / (len(v) + PRIOR_ROWS) for s, v in want.items()})
    features = lexical_features(labelled)
    rated = [sorted(map(tuple, _with_rates(features, model.rates, size).select("url", "rate_1", "rate_2", "rate_3").collect()))
             for size in (1 << 20, 0)]
    assert rated[0] == rated[1] and len(rated[0]) == len(rows)

import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vetline.llm.quality import measure, repetition_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    triples = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if triples[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_dup_lines": dup,
            "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_repeat_words": len(inside)}


def brute_dup_share(text, n):
    words = WORD.findall(text)
    seen, inside = set(), set()
    for i in range(len(words) - n + 1):
        w = tuple(words[i:i + n])
        if w in seen:
            inside.update(range(i, i + n))
        seen.add(w)
    return sum(len(words[i]) for i in inside) / max(1, sum(map(len, words)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "é", " x", "#*", "\n", "\t", "\n\n", "日本"]), max_size=80))
def test_figures_equal_brute_force(parts):
    text = " ".join(parts)
    got = measure(text)
    want = brute(text)
    assert {k: got[k] for k in want} == want
    for n in (5, 7, 10):
        assert got[f"dup_{n}gram_char_share"] == pytest.approx(brute_dup_share(text, n))


def test_verdicts():
    clean = " ".join(f"word{i}" for i in range(60))
    assert measure(clean)["kept"]
    assert measure(" ".join(clean.split()[:49]))["base_failed"]
    spam = clean + " buy this now" * 30
    assert measure(spam)["base_failed"] or measure(spam)["repetitive"]
    lines = clean + "\n" + "\n".join(["one line again and again"] * 12)
    assert not measure(lines)["kept"]


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "w " * 200_000, "x"), (4, "a b", None), (4, "a b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    out = {(r.doc_id, r.n_words, r.kept) for r in repetition_quality(df).collect()}
    assert out == {(1, 0, False), (2, 0, False), (3, 200_000, False), (4, 2, False)}
    assert repetition_quality(df).count() == 5
    assert repetition_quality(df.limit(0)).count() == 0
    many = repetition_quality(df, keep=["doc_id", "text"])
    assert many.filter("doc_id = 3").first().n_repeat_words == 200_000


def test_published_limits_for_long_texts():
    def text(n, repeated):
        lines = [" ".join(f"word{i + j:05d}" for j in range(10)) for i in range(0, n - repeated, 10)]
        return "\n".join(lines + lines[:repeated // 10])

    # 10-word lines twice: 15 % of 2,000 words, then 8 %
    assert measure(text(2000, 300))["repetitive"] and measure(text(2000, 160))["kept"]
    # one repeated line of a short text is free
    assert measure(text(60, 10))["kept"] and measure(text(100, 10))["kept"]

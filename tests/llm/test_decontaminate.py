import hashlib
import math
import random
import re
from collections import Counter

from vetline.llm import decontaminate
from vetline.llm.decontaminate import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def near(ws, iw, counts):
    """Whether a window of the item stands near by: both rarest occurring words
    within two places of each other's offset, four fifths of the words around."""
    size, places = min(10, len(iw)), {}
    for p, w in enumerate(ws):
        places.setdefault(w.lower(), []).append(p)
    for s in range(len(iw) - size + 1 if iw else 0):
        by = sorted((counts[iw[p].lower()], p) for p in range(s, s + size) if counts[iw[p].lower()])
        if not by:
            continue
        p1, p2, window = by[0][1], by[min(1, len(by) - 1)][1], set(iw[s:s + size])
        for x in places.get(iw[p1].lower(), []):
            if any(abs((y - p2) - (x - p1)) <= 2 for y in places.get(iw[p2].lower(), [])) and (
                    len(window & set(ws[max(0, x - 9):x + 10])) >= math.ceil(len(window) * 0.8)):
                return True
    return False


def brute(docs, bench):
    out = []
    items = [(i, split(t)) for i, t in bench]
    counts = Counter(w.lower() for _, t in docs for w in split(t))
    for doc_id, text in docs:
        ws, hit, ids = split(text), set(), set()
        nearby = {item_id for item_id, iw in items if near(ws, iw, counts)}
        for item_id, iw in items:
            size = min(10, len(iw))
            wins = {tuple(iw[s:s + size]) for s in range(len(iw) - size + 1)} if iw else set()
            for p in range(len(ws) - size + 1):
                if size and tuple(ws[p:p + size]) in wins:
                    hit.update(range(p, p + size))
                    ids.add(item_id)
        nearby -= ids | {None}
        ids.discard(None)
        sha = hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
        out.append((doc_id, len(ws), len(hit), len(ids), sha, bool(hit), len(nearby)))
    return sorted(out, key=repr)


def random_case(seed):
    rng = random.Random(seed)
    vocab = ["a", "B", "c1", "É", "é", "the", "K", "ß", "Σ", "ς", "x9"] + [f"w{i}" for i in range(12)]
    bench = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 2, 5, 10, 14, 25])))) for i in range(12)]
    bench += [(3, bench[3][1]), (99, None), (98, ""), (97, "..."), (None, "alpha beta gamma")]
    docs = []
    for i in range(60):
        ws = rng.choices(vocab, k=rng.randint(0, 40))
        if rng.random() < 0.6:
            part = bench[rng.randrange(12)][1].split()
            s = rng.randrange(len(part))
            part = part[s:s + rng.randint(1, 14)]
            if rng.random() < 0.4:  # changed words, some of which occur nowhere else
                part[rng.randrange(len(part))] = rng.choice(vocab + ["changed"])
            ws[len(ws) // 2:len(ws) // 2] = part
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w.upper() if rng.random() < 0.2 and w.isascii() else w for w in ws)))
    docs += [(100, None), (101, ""), (102, "Alpha, BETA gamma " * 20_000), (5, docs[5][1]), (5, docs[5][1]), (None, docs[7][1])]
    return docs, bench


def test_equals_brute_force(spark, monkeypatch):
    for seed, dealt in ((1, 200_000), (2, 3)):
        monkeypatch.setattr(decontaminate, "LIST_ROWS", dealt)
        docs, bench = random_case(seed)
        d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, key string")
        b = spark.createDataFrame([(*r, "x") for r in bench], "item_id long, text string, pos string")
        for block in (1_000_000, 7):
            got = contamination(d, b, block=block)
            assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, bench)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "some text here")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "some text here")], "item_id long, text string")
    assert contamination(d.limit(0), b).count() == 0
    assert [r.contaminated for r in contamination(d, b.limit(0)).collect()] == [False]
    assert [r.n_hit for r in contamination(d, b).collect()] == [3]


def test_proximity(spark):
    item = " ".join(f"term{i}" for i in range(10))
    near = item.replace("term6 term7", "term6 extra term7")
    far = " ".join(f"term{i} x y z" for i in range(10))
    d = spark.createDataFrame([(1, item), (2, near), (3, far)], "doc_id long, text string")
    b = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r.n_items, r.n_near_items) for r in contamination(d, b).collect()}
    assert got == {1: (True, 1, 0), 2: (False, 0, 1), 3: (False, 0, 0)}


def test_near_copies_with_changed_words(spark):
    """A changed word that the corpus lacks, and up to two of ten, stay proximity matches."""
    rng = random.Random(3)
    fresh = lambda n: [f"n{rng.randrange(10**9)}" for _ in range(n)]
    docs, bench, want = [], [], {}
    for i in range(40):
        item = fresh(10)
        copy = list(item)
        for at in rng.sample(range(10), 1 + i % 3):
            copy[at] = f"other{i}x{at}"
        bench.append((i, " ".join(item)))
        docs.append((i, " ".join(fresh(15) + copy + fresh(15))))
        want[i] = (0, False, int(i % 3 < 2))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = contamination(d, b).collect()
    assert {r.doc_id: (r.n_items, r.contaminated, r.n_near_items) for r in got} == want
    assert sorted(map(tuple, got), key=repr) == brute(docs, bench)


def test_words_are_those_of_the_contract(spark):
    """Every code point up to U+3100 and some beyond, next to letters."""
    import re

    from pyspark.sql import functions as F
    from vetline.llm.decontaminate import words

    points = [*range(1, 0x3100), 0xD7FF, 0xE000, 0xFFFD, 0x10000, 0x1F600, 0x10FFFF]
    texts = ["a" + chr(c) + "B9" + chr(c) for c in points] + ["", " "]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(words(F.col("text")).alias("w"), "text").collect()
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    assert len(got) == len(texts) and all(r.w == pattern.findall(r.text) for r in got)

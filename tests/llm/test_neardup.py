import random
import re

import numpy as np

from vetline.llm.components import components
from vetline.llm.neardup import BANDS, REGISTERS, links_within, may_reach, merge, near_duplicates, sketch
from vetline.llm.shingles import shingle_set

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=4):
    ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i:i + k]) for i in range(max(1, len(ws) - k + 1)))


def brute(rows, percent=80):
    """doc_id -> (set size, smallest linked doc_id), every pair compared."""
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, s) in enumerate(sets):
        for e, t in sets[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: (len(s), find(d)) for d, s in sets}


def corpus(seed, n_bases=12, copies=14):
    rng = random.Random(seed)
    rows = []
    for _ in range(n_bases):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 8, 40, 120, 400]))]
        for _ in range(rng.randint(1, copies)):
            ws = list(base)
            for _ in range(rng.randint(0, max(1, len(ws) // 30))):
                ws[rng.randrange(len(ws))] = f"x{rng.randrange(3000)}"
            rows.append(" ".join(ws))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(100, 180)] + [(500, x) for x in range(501, 540)] + [(7, 3), (3, 9), (9, 7), (4, 4)]
    rng.shuffle(links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 181))
    assert all(got[i] == 500 for i in range(500, 540))
    assert got[7] == got[9] == got[3] == 3 and 4 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketch_is_mergeable_and_similarity_estimates_hold():
    rng = np.random.default_rng(2)
    for share in (0.5, 0.8, 0.95):
        n = 600
        common = rng.integers(0, 2**63, int(n * share)).astype(np.uint64)
        rest = [rng.integers(0, 2**63, (n - len(common)) // 2).astype(np.uint64) for _ in range(2)]
        a, b = (np.unique(np.concatenate([common, r])) for r in rest)
        sa, sb = sketch(a), sketch(b)
        assert (merge(sa, sb) == sketch(np.union1d(a, b))).all()
        equal = (sa == sb).mean()
        assert abs(equal - share) < 0.12 and len(sa) == REGISTERS == BANDS * 6
        keep = may_reach(sa[None], sb[None], np.array([len(a)]), np.array([len(b)]), 80)[0]
        assert keep == (share >= 0.8)


def test_equals_brute_force(spark):
    rows = corpus(1) + [(9000, None), (9001, ""), (9002, " \n\t"), (9003, "one two"), (9004, "One TWO"),
                        (9005, "long text " * 60_000), (9006, "long text " * 60_001)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, regs string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    want = {d: (n, c, c == d) for d, (n, c) in brute(rows).items()}
    assert got == want


def test_null_and_repeated_ids(spark):
    text = " ".join(f"t{i}" for i in range(30))
    df = spark.createDataFrame([(None, text), (5, text), (5, text), (2, text + " more")], "doc_id long, text string")
    out = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=str)
    assert out == [(2, 2, True), (5, 2, False), (5, 2, False), (None, None, True)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_shingles_match_tuples():
    for text in ("A b c d e", "a", "É B\x85c d e f g", "x\x0by\tz"):
        assert len(shingle_set(text, 4)) == len(shingles(text))


def test_blocks_of_a_bucket_lose_no_link(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(60):
        ws = list(base)
        for _ in range(rng.randint(0, 4)):
            ws[rng.randrange(80)] = f"x{rng.randrange(30)}"
        rows.append((1, i, i % 7, " ".join(ws)))
    sets = [shingles(r[3]) for r in rows]
    want = {(i, j) for i in range(60) for j in range(i) if i % 7 != j % 7 and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    df = spark.createDataFrame(rows, "key long, cls long, root long, text string")
    for block in (128, 9):
        assert {(r.a, r.b) for r in links_within(df, block=block).collect()} == want
    assert links_within(df.limit(0)).count() == 0

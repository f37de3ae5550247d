import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docsieve.llm import jaccard_join
from docsieve.llm.words import _BLOCK, folded, shingle_set, shingle_sets, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_groups(rows):
    sets = [(i, plain_set(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for k, (_, s) in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(k)
    pairs = {(a, b) for ks in where.values() for a in ks for b in ks if a < b}
    for a, b in pairs:
        (i, x), (j, y) = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y) and find(i) != find(j):
            p, q = find(i), find(j)
            root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets}


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    common = [rng.choice(vocabulary) for _ in range(60)]
    out = []
    for i in range(n):
        kind = rng.random()
        if kind < .3 and out:
            w = list(rng.choice(out)[1].split(" "))
            for _ in range(rng.randrange(0, max(1, len(w) // 12 + 1))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        elif kind < .5:
            w = common + [rng.choice(vocabulary) for _ in range(rng.randrange(5, 40))]
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 8, 12, 40, 120, 300]))]
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("frequent", [3, 64])
def test_against_all_pairs(spark, monkeypatch, frequent):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    rows = texts(frequent, 500)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == plain_groups(rows)


def test_signatures_meet_for_every_similar_pair():
    rng = np.random.default_rng(3)
    for _ in range(1500):
        n = int(rng.integers(1, 60))
        base = rng.integers(0, 2 ** 62, n, dtype=np.uint64)
        other = base.copy()
        change = rng.integers(0, n, int(rng.integers(0, n // 4 + 2)))
        other[change] = rng.integers(0, 2 ** 62, len(change), dtype=np.uint64)
        other = other[int(rng.integers(0, max(1, n // 5))):]
        a, b = np.unique(base), np.unique(other)
        if not jaccard_join.similar(a, b):
            continue
        share = rng.random()
        frequent = np.unique(np.concatenate([a, b])[rng.random(len(a) + len(b)) < share])
        (sa, ma), (sb, mb) = (jaccard_join.signatures(x, frequent) for x in (a, b))
        met = [(s, i, j) for i, s in enumerate(sa) for j in np.flatnonzero(sb == s)]
        assert any(ma[i] >= len(b) and mb[j] >= len(a) for _, i, j in met)


def test_entries_split_over_batches():
    import pandas as pd
    sig = np.array([1, 2, 2, 2, 2, 3, 4, 4], np.int64)
    rows = pd.DataFrame({"sig": sig, "doc_id": np.arange(8), "packed": np.arange(8) + 10})
    for cuts in ([8], [1, 7], [2, 1, 1, 4], [1] * 8, [3, 5], [4, 2, 2]):
        parts, at = [], 0
        for c in cuts:
            parts.append(rows.iloc[at:at + c])
            at += c
        out = pd.concat(list(jaccard_join._shared(iter(parts))))
        assert [tuple(map(int, r)) for r in out[["sig", "doc_id", "hub", "hub_packed"]].itertuples(index=False)] == [
            (2, 1, 1, 11), (2, 2, 1, 11), (2, 3, 1, 11), (2, 4, 1, 11), (4, 6, 6, 16), (4, 7, 6, 16)]


def test_odd_rows(odd_docs, no_docs):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(odd_docs).collect()),
                 key=str)
    assert len(got) == odd_docs.count()
    by = {i: (n, c) for i, n, c in got if i is not None}
    assert by[1] == (1, 1) and by[2] == (1, 1) and by[3] == (0, 3) and by[4] == (0, 4)
    assert by[6][1] == 5 and by[8] == (0, 8) and by[9][1] == 9 and by[10][1] == 10
    assert jaccard_join.similar_groups(no_docs).count() == 0
    kept = jaccard_join.keep_representatives(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 4, 5, 7, 8, 9, 9, 10]


def test_set_of_long_text():
    text = " ".join(str(i) for i in range(50_000))
    assert len(shingle_set(text)) == 49_996


def test_words_are_hashed_alike_wherever_they_stand():
    rng = random.Random(3)
    # Letters, blanks of all kinds, accents, and words above every length at which the hashing changes its way.
    vocabulary = ["a", "A", "ab", "ba", "\u00e9", "\u00a0x", "\x00", "\x00\x00", "\x1cq", "\u4e2d\u6587", "z" * 512, "z" * 513,
                  "y" * 700, "w" * (_BLOCK + 9), "\ud800"] + [f"v{i}" for i in range(300)]
    blanks = " \t\n\x0b\x0c\r"
    texts = [None, "", "  \n", "one", " a b  c d "]
    for n in (3, 4, 5, 6, 40, 2000, 120_000):
        few = vocabulary if n < 100 else vocabulary[:3] + vocabulary[15:]
        texts.append("".join(rng.choice(few) + rng.choice(blanks) * rng.choice((1, 1, 3)) for _ in range(n)))
    data = [folded(t) for t in texts]
    known = {}
    for d in data:
        place, h = word_hashes(d)
        assert [d[p:].split(None, 1)[0] for p in place[:50].tolist()] == d.split()[:50] and len(place) == len(d.split())
        for word, value in zip(d.split(), h.tolist()):
            assert known.setdefault(word, value) == value
    assert len(set(known.values())) == len(known)
    sets = list(shingle_sets(data))
    shared = {}
    for text, got in zip(texts, sets):
        plain = plain_set((text or "").replace("\ud800", "?"))
        assert len(got) == len(plain) and list(got) == sorted(set(got.tolist()))
        assert got.tolist() == shingle_set(text).tolist()
        shared[text] = plain
    for i, j in ((8, 9), (9, 10), (10, 11)):
        assert len(np.intersect1d(sets[i], sets[j])) == len(shared[texts[i]] & shared[texts[j]])


def test_bitmap_never_rules_out_a_match():
    rng = np.random.default_rng(5)
    for n in (1, 5, 60, 400, 3000):
        a = np.unique(rng.integers(0, 2 ** 63, n, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[: max(1, n - n // 8)], rng.integers(0, 2 ** 63, n // 9, dtype=np.uint64)]))
        differ = sum(int(x).bit_count() for x in (
            jaccard_join.bitmap(a) ^ jaccard_join.bitmap(b)).view(np.uint64))
        assert differ <= len(np.setxor1d(a, b))


def test_wide_bitmap_rules_out_unlike_long_sets_only():
    rng = np.random.default_rng(6)
    for n in (3000, 4096, 4097, 30_000):
        a = rng.integers(0, 2 ** 64, n, dtype=np.uint64)
        near = np.concatenate([a[:n - n // 8], rng.integers(0, 2 ** 64, n // 9, dtype=np.uint64)])
        far = rng.integers(0, 2 ** 64, 4 * n // 5, dtype=np.uint64)

        def kept(b, n=n, a=a):
            batch = pd.DataFrame({"a": [1], "b": [2], "n_a": [n], "n_b": [len(b)], "wide_a": [
                jaccard_join.wide_bitmap(a)], "wide_b": [jaccard_join.wide_bitmap(b)]})
            return sum(map(len, jaccard_join._wide_match(iter([batch]))))

        assert jaccard_join.similar(np.unique(a), np.unique(near)) and kept(near) == kept(a) == 1 and kept(far) == 0
    one_side = pd.DataFrame({"a": [1], "b": [2], "n_a": [1], "n_b": [1], "wide_a": [None], "wide_b": [b"12345678"]})
    assert len(next(jaccard_join._wide_match(iter([one_side])))) == 1


def test_groups_by_wide_bitmaps(spark):
    rows = texts(9, 120)
    rng = random.Random(9)
    long = " ".join(f"l{rng.randrange(900)}" for _ in range(4000))
    rows += [(1000 + i, long.replace(f"l{i} ", f"m{i} ")) for i in range(4)]
    rows += [(2000 + i, " ".join(f"l{rng.randrange(900)}" for _ in range(4000))) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(df).collect()}
    assert got == plain_groups(rows)

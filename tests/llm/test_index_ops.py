"""Prefix trie, spelling variants and licence scan against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from docsieve.llm import license_scan, prefix_trie, spelling_variants
from docsieve.llm.licenses import BASE_PHRASES, NOTICES
from docsieve.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import SF

TURNS = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"t{len(role)}:{role}{text}".encode()).digest()
            turns[c].append(((turn is not None, turn or 0), tie, role, text))
    own = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    members = defaultdict(list)
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]  # % keeps the sign, as in SQL
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        mine = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        saved[node] = mine + sum(saved[x] for x in children[node])
    out = []
    for node, some in members.items():
        ends = ",".join(map(str, sorted(c for c in some if len(whole[c]) == len(node))))
        out.append((min(some), len(node), min(members[node[:-1]]) if node else None, len(some), len(children[node]),
                    leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def trie(df):
    got = prefix_trie.prefix_trie(*prefix_trie.with_shared_openings(prefix_trie.ordered_turns(df)))
    return sorted(map(tuple, got.collect()))


def test_trie_against_brute_force(spark):
    """Ties, nulls, repeated rows, lengths around the block, two long equal conversations and one that leaves late."""
    draw = random.Random(3)
    rows = [(c, t if draw.random() < .95 else None, draw.choice(["user", "assistant", None]), draw.choice(["a", "bb", None]))
            for c in range(130) for t in range(draw.choice([0, 1, 2, 7, 8, 9, 16, 17]))]
    rows += [(c, t, "user", "x" if t < 500 or c < 1002 else "y") for c in (1000, 1001, 1002) for t in range(600)]
    rows += [(-3, 1, "user", "a"), (None, 1, "user", "a"), (5, 1, "user", "a"), (5, 1, "user", "a")]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS block", "'x' AS id", "2 AS position")
    assert trie(df) == plain_trie(rows)


def test_trie_of_copies_and_of_nothing(spark):
    rows = [(c, t, "user", "same") for c in range(300) for t in range(3)]
    assert trie(spark.createDataFrame(rows, TURNS)) == plain_trie(rows)
    assert trie(spark.createDataFrame([], TURNS)) == []


def plain_variants(words):
    patterns, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            patterns[w[:i] + "*" + w[i + 1:]].add(w)
            less = w[:i] + w[i + 1:]
            if less in words:
                near[w].add(less)
                near[less].add(w)
    for some in patterns.values():
        for w in some:
            near[w] |= some - {w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def variants(spark, words):
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    return sorted(map(tuple, spelling_variants.spelling_variants(df).collect()))


@pytest.mark.parametrize("share", [spelling_variants.SHARE, 20])
def test_variants_against_brute_force(spark, monkeypatch, share):
    """Few letters, so words crowd; with a small dictionary and with a full one."""
    monkeypatch.setattr(spelling_variants, "SHARE", share)
    draw = random.Random(5)
    words = {"".join(draw.choices("abcé", k=draw.randint(5, 8))): draw.choice([3, 4, 7, 20, 90]) for _ in range(500)}
    words |= {"chainaaaaa"[:5 + i]: 3 * 2 ** i for i in range(6)}
    assert variants(spark, words) == plain_variants(words)
    assert variants(spark, {}) == [] and variants(spark, {"alone": 3}) == [("alone", None, "alone", 3, 0, None)]


def test_affected_grams_bound_what_an_edit_changes():
    draw = random.Random(1)
    words = ["".join(draw.choices("abc", k=draw.randint(5, 9))) for _ in range(300)]
    frequent = dict(Counter(f"^{w}$"[i:i + n] for w in words for n in range(2, 6) for i in range(len(w) + 3 - n)).most_common(60))
    for w in words:
        i = draw.randrange(len(w))
        grams = spelling_variants.decompose(w, frequent)
        for other in (w[:i] + w[i + 1:], w[:i] + "b" + w[i + 1:], w[:i] + "c" + w[i:]):
            kept = Counter(g for g, _ in grams) & Counter(g for g, _ in spelling_variants.decompose(other, frequent))
            assert kept.total() >= len(grams) - spelling_variants.affected(w, grams) > 0


def test_word_counts(spark, odd_docs, no_docs):
    got = {r.word: r.n for r in spelling_variants.word_counts(odd_docs, length=4, least=1, damage=3).collect()}
    want = Counter()
    for r in odd_docs.collect():
        for run in re.findall("[a-zÀ-ÿ]+", (r.text or "").encode().lower().decode()):
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            want[run if h % 3 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    assert got == {w: n for w, n in want.items() if len(w) >= 4}
    assert spelling_variants.word_counts(no_docs).count() == 0


def plain_scan(rows):
    texts = [(d, re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower().decode())) for d, t in rows]
    rare = {}
    for word in license_scan.vocabulary(NOTICES):
        n = max(1, sum(word in w for _, w in texts))
        rare[word] = max(1, sum(n << k <= len(texts) for k in range(40)))

    def find(words, phrase):
        phrase = phrase.split()
        return [i for i in range(len(words)) if words[i:i + len(phrase)] == phrase]

    out = []
    for doc_id, words in texts:
        base = [(i, label) for phrase, label in BASE_PHRASES for i in find(words, phrase)]
        names, score = {label for _, label in base}, 1.0 if base else 0.0
        for notice in NOTICES:
            text = license_scan.template_words(notice.text)
            keys = sorted(set(text), key=lambda x: (-rare[x], x))[:license_scan.ANCHORS]
            total = sum(rare[x] for x in text if x in keys)
            for shifted in (0, license_scan.BAND // 2):
                bands, said = defaultdict(dict), defaultdict(set)
                for i, x in enumerate(words):
                    for at in (at for at, y in enumerate(text) if y == x and x in keys):
                        bands[(i - at + shifted) // license_scan.BAND][at] = rare[x]
                for m in notice.mandatory:
                    for i in find(words, m):
                        said[(i - find(text, m)[0] + shifted) // license_scan.BAND].add(m)
                for band, seen in bands.items():
                    if len(said[band]) == len(notice.mandatory) and 5 * sum(seen.values()) >= 3 * total:
                        names.add(notice.label)
                        score = max(score, sum(seen.values()) / total)
        places = [i for i, _ in base]
        out.append((doc_id, len(words), len(base), min(places, default=None), max(places, default=None),
                    ",".join(sorted({label for _, label in base})), ",".join(sorted(names)), score))
    return sorted(out, key=repr)


def test_licences_against_brute_force(spark, odd_docs, no_docs):
    text = {n.mandatory[0]: n.text for n in NOTICES}
    bsd = text["redistribution and use in source and binary forms"]
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()] + [
        (20, "CC-BY-NC cc by nc CC BY NC by nc"), (20, NOTICES[0].text + " x " + NOTICES[3].text), (None, "under the MIT license"),
        (21, "é " * 9000 + "Apache License, Version 2.0"), (22, "All Rights  reserved"), (23, "mit " * 4000),
        (24, " ".join(f"{w} word{i}" for i, w in enumerate(bsd.split()))), (25, bsd.replace("must", "shall must really")),
        (26, NOTICES[4].text + " " + NOTICES[5].text), (27, " ".join(reversed(bsd.split())))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "'w' AS words", "2 AS hits")
    got = sorted(map(tuple, license_scan.scan(df).collect()), key=repr)
    assert got == plain_scan(rows)
    labels = {r[0]: r[6] for r in got}
    assert (labels[22], labels[24], labels[25], labels[26], labels[27]) == ("all-rights-reserved", "", "bsd", "gpl,lgpl", "")
    assert license_scan.scan(no_docs).count() == 0


def test_scan_is_native(spark, odd_docs):
    plan = license_scan.scan(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_spelling_variants", "op13_license_scan"])
def test_queries_equal_their_statements(spark, name):
    got = QUERIES[name](spark, SF)
    connection = duckdb.connect()
    for table in ("documents", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    columns = ", ".join(got.columns)
    want = connection.execute(f"SELECT {columns} FROM ({ORACLES[name]}) x").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)

"""Trie, Merkle manifest and substring dedup against brute force, and on odd tables."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wireloom.llm import merkle, substrings, trie

DOC = "doc_id long, text string, lang string, source string, n_chars long"
CONV = "conv_id long, turn long, role string, text string"


def odd(spark):
    long_ = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \n\t ", None, "a", 4), (4, "one", "en", "a", 3), (5, "One", "de", "b", None), (6, long_, "en", "b", len(long_)), (7, "x " + long_ + "\ty", "en", "b", len(long_) + 4),
        (8, "the quick brown fox", "en", None, None), (8, "the quick brown fox", "en", None, None), (None, "no id at all here", "fr", "c", 17), (None, None, None, None, None), (9, "Ünï çödé ß € 😀 text", "", "é", 18), (10, "x" * 200_000, "en", "a", 200_000), (11, "y " * 300, "en", "a", 600),
    ]
    df = spark.createDataFrame(rows, DOC)
    for c in ("_row", "_kept", "places", "seal", "doc", "at", "code", "group", "order", "leaf", "idx", "tree", "n", "_id", "key", "root"):
        df = df.selectExpr("*", f"'clash' as {c}")
    return df


def sql(statement, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toPandas().convert_dtypes())
    return con.execute(statement).fetchall()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# 11 trie


def brute_trie(table):
    convs = {}
    for c, t, r, x in table:
        if c is not None:
            said = f"{len((r or '').encode())}:{r or ''}{x or ''}"
            convs.setdefault(c, []).append(((t is not None, t or 0), hashlib.sha256(said.encode()).digest(), (r or "", x or "")))
    convs = {c: [x[2] for x in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(convs.get(c - c % 20, [])[:h] + own[h:])
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = {}
    for path, who in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members) for p in below)
        saved = sum((len(members[p]) - 1) * len(p[-1][1].split()) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in who if len(rebuilt[c]) == len(path))))
        out[min(who), len(path)] = (min(members[path[:-1]]) if path else None, len(who), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def got_trie(df):
    return {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in trie.op11_trie(df).collect()}


def test_trie_against_brute_force(spark):
    rng = random.Random(11)
    table = []
    for c in [i for i in range(90) if i not in (20, 41)]:
        shared = rng.randint(0, 3)
        for t in range(rng.randint(1, 9)):
            said = f"common {t} words here" if t < shared else rng.choice(("yes", "no, thanks", f"own {c % 7}", "", None))
            table.append((c, t if rng.random() < 0.95 else None, rng.choice(("user", "user", None)), said))
    table += [(40, 5, "user", "same"), (40, 5, "user", "same"), (None, 0, "user", "nobody's")] + [(61, i, "user", "ab"[i % 2]) for i in range(300)] + [(62, i, "user", "ab"[i % 2]) for i in range(280)]
    df = spark.createDataFrame(table, CONV)
    assert got_trie(df) == brute_trie(table)
    assert rows(trie.op11_trie(df.repartition(7))) == sorted(sql(trie.OP11_SQL, conversations=df), key=repr)


def test_trie_on_hot_groups(spark):
    """Chains that hang off one another, one conversation for all, and texts of ids that are cut and joined again."""
    stairs = [(100 * k, t, "user", f"step {t}" if t < 40 - k else f"end {k}") for k in range(40) for t in range(41)]
    assert got_trie(spark.createDataFrame(stairs, CONV)) == brute_trie(stairs)
    same = spark.range(40_000).selectExpr("id as conv_id", "0l as turn", "'user' as role", "'hello there' as text")
    found = {(r["conv_id"], r["depth"]): r for r in trie.op11_trie(same).collect()}
    assert found[0, 1]["n_convs"] == 40_000
    assert found[0, 1]["ends_sha256"] == hashlib.sha256(",".join(map(str, range(40_000))).encode()).hexdigest()
    assert found[0, 0]["saved_tokens"] == 39_999 * 2 and found[0, 0]["n_leaves"] == 1


def test_trie_odd(spark):
    assert trie.op11_trie(spark.createDataFrame([], CONV)).count() == 0
    assert trie.op11_trie(spark.createDataFrame([(None, 1, "user", "x")], CONV)).count() == 0
    one = spark.createDataFrame([(21, None, None, None)], CONV).selectExpr("*", "1 as node", "2 as base", "3 as depth")  # lends 21's turn from a base that isn't there
    want = brute_trie([(21, None, None, None)])
    assert got_trie(one) == want
    huge = [(0, 0, "user", "w " * 400_000), (1, 0, "user", "w " * 400_000)]
    assert got_trie(spark.createDataFrame(huge, CONV)) == brute_trie(huge)


# 12 Merkle


def brute_root(leaves):
    level = leaves
    while len(level) > 1:
        level = [merkle.digest(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0]


@settings(max_examples=60, deadline=None)
@given(sizes=st.lists(st.integers(1, 40), min_size=1, max_size=6), cuts=st.integers(1, 7), seed=st.integers(0, 999))
def test_forest_merges_in_any_order(sizes, cuts, seed):
    rng = random.Random(seed)
    leaves = {(t, i): hashlib.sha256(f"{t} {i}".encode()).digest() for t, n in enumerate(sizes) for i in range(n)}
    parts = [merkle.Forest(len(sizes)) for _ in range(cuts)]
    for (t, i), h in sorted(leaves.items(), key=lambda _: rng.random()):
        rng.choice(parts).add(t, sizes[t], 0, i, h)
    while len(parts) > 1:
        a, b = parts.pop(rng.randrange(len(parts))), parts.pop(rng.randrange(len(parts)))
        parts.append(a.merge(b))
    whole = brute_root([brute_root([leaves[t, i] for i in range(n)]) for t, n in enumerate(sizes)])
    assert parts[0].root == whole and not parts[0].nodes
    assert len(parts[0].done) == len({x[:3] for x in parts[0].done})


def test_forest_of_a_range_is_small():
    n = 5000
    f = merkle.Forest(1)
    for i in range(1234, 4321):
        f.add(0, n, 0, i, bytes(32))
    assert len(f.nodes) <= 2 * merkle.height(n)


def test_manifest_against_sql(spark):
    rng = random.Random(12)
    table = [(i if rng.random() < 0.98 else None, f"text {i % 50}", rng.choice(("en", "en", "de", None, "é", "z", "")), rng.choice(("a", None)), rng.choice((i, None))) for i in range(700)]
    df = spark.createDataFrame(table, DOC)
    assert rows(merkle.op12_merkle(df.repartition(9))) == sorted(sql(merkle.OP12_SQL, documents=df), key=repr)
    alone = df.limit(1)
    assert rows(merkle.op12_merkle(alone)) == sorted(sql(merkle.OP12_SQL, documents=alone), key=repr)


def test_manifest_of_large_trees(spark):
    """More than one block, several fragments, and a proof that stands by itself."""
    df = spark.range(10_001).selectExpr("id as doc_id", "'en' as lang", "cast(id % 3 as string) as source", "id as n_chars", "'t' as text").unionByName(spark.range(3).selectExpr("id as doc_id", "'zz' as lang", "'s' as source", "id as n_chars", "'t' as text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = merkle.manifest(df.repartition(40), ["doc_id", "n_chars"], "lang", "doc_id").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    leaf = lambda i: hashlib.sha256("".join(f"{len(str(i))}:{i}" for _ in range(2)).encode()).digest()
    subs = [brute_root([leaf(i) for i in range(10_001)]), brute_root([leaf(i) for i in range(3)])]
    assert len(found) == 10_004 and {bytes(r["root"]) for r in found} == {brute_root(subs)} and {bytes(r["subroot"]) for r in found} == set(subs)
    for r in found[::97]:
        args = (r["position"], r["n_leaves"], r["tree"], r["n_trees"], bytes(r["proof"]))
        assert merkle.fold_proof(bytes(r["leaf"]), *args)[1] == bytes(r["root"]) and r["verified"]
        assert merkle.fold_proof(leaf(77_777), *args)[1] != bytes(r["root"])


def test_manifest_odd(spark):
    found = merkle.op12_merkle(odd(spark)).collect()
    assert len(found) == 14 and len({r["root"] for r in found}) == 1
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in found) and sum(not r["verified"] for r in found) == sum(zlib.crc32(str(i).encode()) % 7 == 0 for i in (1, 2, 3, 4, 6, 7, 9, 10, 11))
    assert merkle.op12_merkle(spark.createDataFrame([], DOC)).count() == 0


# 13 substrings


def brute_repeats(texts, width):
    words = [(t or "").split() for t in texts]
    counts = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - width + 1) if counts[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def corpus(seed, n=80):
    rng = random.Random(seed)
    passages = [[f"p{k}w{rng.randint(0, 40)}" for _ in range(rng.randint(20, 120))] for k in range(6)]
    texts = []
    for _ in range(n):
        words = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(0, 200))]
        if rng.random() < 0.6:
            p = rng.choice(passages)
            a = rng.randint(0, len(words))
            words[a:a] = p[rng.randint(0, 10) : len(p) - rng.randint(0, 10)]
        texts.append(rng.choice((" ", "\n", " \t ")).join(words))
    line = " ".join(f"l{i}" for i in range(34))
    texts += [f"{' '.join(f'u{i}x{j}' for j in range(40))} {line} {' '.join(f'v{i}x{j}' for j in range(40))}" for i in range(40)]  # a very common line
    return texts + ["a " * 900, "a " * 36, "b " * 35, None, "", texts[0], texts[0]]


@pytest.mark.parametrize("bucket_bytes", [substrings.BUCKET_BYTES, 3000])
def test_substrings_against_brute_force(spark, monkeypatch, bucket_bytes):
    texts = corpus(13)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    monkeypatch.setattr(substrings, "COMBINE_BYTES", 20_000)
    want = brute_repeats(texts, substrings.WIDTH)
    found = substrings.find_repeats(df, bucket_bytes=bucket_bytes).collect()
    got = {r["doc_id"]: (r["_n_words"], sum(s["end"] - s["start"] for s in r["_spans"]), hashlib.sha256(r["_kept"].encode()).hexdigest()) for r in found}
    assert [got[i] for i in range(len(texts))] == want
    assert {r["doc_id"]: tuple(r)[1:] for r in substrings.op13_substrings(df).collect()} == dict(enumerate(want))


@pytest.mark.parametrize("width", [3, 5, 8])
def test_substrings_of_other_widths(spark, width):
    texts = corpus(width, 40)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["_n_words"], sum(s["end"] - s["start"] for s in r["_spans"])) for r in substrings.find_repeats(df, width).collect()}
    assert [got[i] for i in range(len(texts))] == [x[:2] for x in brute_repeats(texts, width)]


def test_frequent_minimisers_are_split(spark):
    texts = corpus(1, 10)
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").selectExpr("doc", "0l as seal", "cast(text as binary) as text").where("text is not null")
    hot = substrings.frequent_codes(df, substrings.WIDTH)
    assert len(hot)
    pieces = substrings.Pieces([t.encode() for t in texts if t], substrings.WIDTH, hot)
    assert pieces.single.any() and not pieces.single.all()
    assert (np.char.count(np.array([pieces.text(i) for i in np.flatnonzero(pieces.single)]), b" ") == 34).all()


def test_sliding_min():
    v = np.random.default_rng(0).integers(0, 99, 200).astype(np.uint64)
    for w in (1, 2, 3, 7, 31, 200):
        assert substrings.sliding_min(v, w).tolist() == [v[i : i + w].min() for i in range(len(v) - w + 1)]


def test_substrings_odd(spark):
    df = odd(spark)
    found = substrings.op13_substrings(df).collect()
    said = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in found}
    assert len(found) == 14 and said[6] == (60_000, 60_000) and said[7] == (60_002, 60_000) and said[11] == (300, 300) and said[1] == (0, 0) and said[10] == (1, 0) and said[8] == (4, 0)
    clean = substrings.remove_repeats(df)
    assert clean.columns == df.columns
    left = {r["doc_id"]: (r["text"], r["n_chars"]) for r in clean.collect()}
    assert left[7] == ("x y", 3) and left[6] == ("", 0) and left[3] == (" \n\t ", 4) and left[1] == (None, 0)
    assert substrings.op13_substrings(spark.createDataFrame([], DOC)).count() == 0

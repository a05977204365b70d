"""SimHash tiles, Merkle proofs and periodic runs against plain Python."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tracelens.llm import merkle, periodic, queries, simhash
from tracelens.llm.common import Work, table

SMALL = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_fingerprint(text, width=4):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    """Fingerprint: the least fingerprint that it reaches."""
    nodes = np.array(sorted(set(prints)), np.uint64)
    root = np.arange(len(nodes))
    for i in range(len(nodes)):
        near = np.flatnonzero(np.bitwise_count(nodes ^ nodes[i]) <= radius)
        root[np.isin(root, root[near])] = root[near].min()
    return {int(n): int(r) for n, r in zip(nodes, root)}


def brute_simhash(rows, width=4, radius=4):
    prints = [brute_fingerprint(t, width) for _, t in rows]
    root, first = brute_components(prints, radius), {}
    for (i, _), p in zip(rows, prints):
        first[root[p]] = min(first.get(root[p], i), i)
    return sorted((i, f"{p:016x}", first[root[p]]) for (i, _), p in zip(rows, prints))


def test_simhash_matches_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    want = brute_simhash([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = sorted(tuple(r) for r in queries.simhash_tiles(spark, SMALL).collect())
    assert got == want and sum(i != c for i, _, c in got) > 20


def test_fingerprints_of_pieces_are_those_of_whole_texts(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" \t".join(f"W{x}é" for x in rng.integers(0, 50, n)) for n in (0, 1, 3, 4, 5, 300, 1, 2000, 0)] + ["\n \n", "a\x0bB\x0cc\rD e", "\xa0x   y"]
    want = [brute_fingerprint(t) for t in texts]
    for most in (7, 256, 1 << 18):
        monkeypatch.setattr(simhash, "SHINGLES", most)
        assert simhash._of_texts(pa.array(["gone", *texts], pa.large_string()).slice(1), 4).tolist() == want
    assert simhash._of_texts(pa.array([], pa.large_string()), 4).tolist() == []


def test_tiles_lose_no_link(spark, monkeypatch):
    """Chains of near fingerprints through several cells, a crowd that all link, and cells cut into tiles."""
    rng = np.random.default_rng(5)
    nodes = set(rng.integers(0, 1 << 63, 2000, dtype=np.uint64).tolist()) | {0, (1 << 64) - 1}
    for start in rng.integers(0, 1 << 63, 40, dtype=np.uint64).tolist():
        for _ in range(20):
            start ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False))
            nodes.add(start)
    crowd = int(rng.integers(0, 1 << 63))
    nodes |= {crowd ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)}
    want = brute_components(nodes, 4)
    monkeypatch.setattr(simhash, "TILE", 64)
    with Work(spark):
        rows = spark.createDataFrame([(int(np.uint64(n).view(np.int64)),) for n in nodes], "node long")
        links = [tuple(int(np.int64(x).view(np.uint64)) for x in r) for r in simhash.tile_links(rows, 4).collect()]
    assert all((a ^ b).bit_count() <= 4 and a != b for a, b in links)
    assert len(links) < 20 * len(nodes)  # a crowd of 780 has 304,590
    group = {n: {n} for n in nodes}
    for a, b in links:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for x in group[b]:
                group[x] = group[a]
    by_root = defaultdict(set)
    for n, r in want.items():
        by_root[r].add(n)
    assert all(group[n] == by_root[r] for n, r in want.items())


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(leaves, fan):
    """The root, and for each leaf the siblings from below with how many stand before the own place."""
    paths, at = [[] for _ in leaves], list(range(len(leaves)))
    level = list(leaves)
    while len(level) > 1:
        runs = [level[i : i + fan] for i in range(0, len(level), fan)]
        for i, x in enumerate(at):
            run, k = runs[x // fan], x % fan
            paths[i].append((run[:k], run[k + 1 :]))
            at[i] = x // fan
        level = [H(*r) for r in runs]
    return level[0], paths


def brute_audit(rows, fan=2):
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = defaultdict(list)
    for r in rows:
        r = dict(r)
        r["leaf"] = H(*[told(r[c]) for c in merkle.FIELDS])
        bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None
        r["now"] = H(*[told(r[c] + 1 if c == "n_chars" else r[c]) for c in merkle.FIELDS]) if bad else r["leaf"]
        groups[r["lang"]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in names:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["leaf"]))
        trees.append(brute_tree([r["leaf"] for r in groups[g]], fan))
    root, above = brute_tree([t[0] for t in trees], fan)
    out = []
    for g, (subroot, paths), top in zip(names, trees, above):
        for r, path in zip(groups[g], paths):
            node = r["now"]
            for before, after in path + top:
                node = H(*before, node, *after)
            proof = H(*["".join(before + after) for before, after in path + top])
            out.append((r["doc_id"], r["leaf"], subroot, root, proof, node, node == root))
    return sorted(out, key=repr)


def audit(docs, fan=2):
    return merkle.audit(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 0, {"n_chars": F.col("n_chars") + 1}, fan=fan)


@pytest.mark.parametrize("fan, width", [(2, 4), (2, 256), (3, 9), (5, 5)])
def test_proofs_match_brute_force(spark, monkeypatch, fan, width):
    monkeypatch.setattr(merkle, "WIDTH", width)
    docs = table(spark, SMALL, "documents")
    rows = [r.asDict() for r in docs.collect()]
    got = sorted((tuple(r) for r in audit(docs, fan).collect()), key=repr)
    assert got == brute_audit(rows, fan) and 0 < sum(not r[-1] for r in got) < len(got)


def test_proofs_of_nulls_ties_and_few_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, place string, key string, hash string"
    few = [(7, "x", None, None, None), (7, "x", None, None, None), (None, None, "", "s", 3), (7, "y", "", "s", 4), (14, "é\n", "z", "", 0), (-3, "", "Z", "t", 9)]
    few += [(i, "a" * i, "many", "s", i) for i in range(260)]
    for rows in ([], few[:1], few[:2], few):
        docs = spark.createDataFrame([(*r, "p", "k", "h") for r in rows], schema)
        got = sorted((tuple(r) for r in audit(docs).collect()), key=repr)
        assert got == (brute_audit([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows]) if rows else [])


def brute_runs(w, shortest=12):
    """Every stretch of each distance, and the smallest of equal ones."""
    best = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i >= max(q, shortest - q):
                best.setdefault((i, j + q), q)
            i = max(j, i + 1) if j > i else i + 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def collapse(w, runs):
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in drop]


def word_sequences():
    rng = np.random.default_rng(11)
    fib = ["a", "b"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    yield list(fib[-1])
    yield ["x"] * 500
    yield ["x"] * 11
    yield ["x"] * 12
    yield [*(["x"] * 40), "y"] * 9
    yield list("abcabcabcabcxabcabcabcabca")
    yield [str(i) for i in range(300)]
    yield []
    for k in (2, 3, 9):
        for n in (13, 60, 300):
            yield [str(x) for x in rng.integers(0, k, n)]
    for _ in range(60):  # periodic pieces among others, some within a larger period
        w = []
        while len(w) < rng.integers(20, 300):
            unit = [str(x) for x in rng.integers(0, rng.choice([2, 4, 40]), rng.integers(1, 25))]
            w += unit * int(rng.integers(1, 6)) + unit[: int(rng.integers(0, len(unit)))]
        yield w


@pytest.mark.parametrize("steps, places", [(16, 1 << 20), (2, 50)])
def test_runs_match_brute_force(monkeypatch, steps, places):
    monkeypatch.setattr(periodic, "STEPS", steps)
    monkeypatch.setattr(periodic, "PLACES", places)
    texts = list(word_sequences())
    number = {x: i for i, x in enumerate(sorted({x for w in texts for x in w}))}
    ids = np.array([number[x] for w in texts for x in w], np.int32)
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in texts])])
    start, end, period = periodic.repetitions(ids, offsets, 12)
    got = defaultdict(list)
    for s, e, q in zip(start.tolist(), end.tolist(), period.tolist()):
        i = int(np.searchsorted(offsets, s, "right")) - 1
        got[i].append((s - int(offsets[i]), e - s, q))
    for i, w in enumerate(texts):
        assert got[i] == brute_runs(w), w


def test_found_runs_and_collapsed_texts(spark):
    rows = [(i, " \n".join(w), "r") for i, w in enumerate(word_sequences())] + [(None, None, "r"), (5, " \t\n", "r"), (5, "a " * 30, "r"), (6, "É " * 20 + "é " * 20, "r")]
    got = periodic.find(spark.createDataFrame(rows, "doc_id long, text string, runs string")).collect()
    found = sorted((repr(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got)
    want = []
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        want.append((repr(i), len(w), brute_runs(w), " ".join(collapse(w, brute_runs(w)))))
    assert found == sorted(want)


def test_long_periodic_texts_take_nearly_linear_time():
    for w in (np.zeros(200_000, np.int32), np.tile(np.arange(1000, dtype=np.int32), 200), np.tile(np.r_[np.zeros(999, np.int32), 1], 200)):
        start, end, _ = periodic.repetitions(w, np.array([0, len(w)]), 12)
        assert (0, len(w)) in set(zip(start.tolist(), end.tolist()))


def test_runs_query_matches_brute_force(spark, sf_dir):
    want = []
    for r in table(spark, sf_dir, "documents").collect():
        w = WORD.findall(r["text"] or "")
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(WORD.findall(r["text"] or ""))
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w) if len(w) < 3000 else None
        if runs is not None:
            top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
            want.append((r["doc_id"], len(runs), *top, None if top[1] is None else 1000 * top[1] // top[2], H("".join(f"{s},{n},{q}\n" for s, n, q in runs)), H(" ".join(collapse(w, runs)))))
    got = {r["doc_id"]: tuple(r) for r in queries.periodic_runs(spark, sf_dir).collect()}
    assert len(want) > 190 and all(got[w[0]] == w for w in want) and sum(w[1] > 0 for w in want) > 5


def test_empty_tables_of_fingerprints_and_runs(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.digests(periodic.find(docs)).collect() == [] and simhash.near_duplicates(docs)[0].collect() == []


def test_rows_that_share_an_id_or_have_none(spark):
    far = ["the cat sat on the mat and slept", "a wholly other text of several different words"]
    rows = [(5, far[0], 0), (5, far[1], 0), (3, far[1], 0), (9, far[0], 0), (None, far[0], 0), (8, None, 0), (7, " \t", 0), (6, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node long")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs)[0].collect()), key=repr)
    assert got == sorted([(5, 3), (5, 3), (3, 3), (9, 3), (None, None), (8, 6), (7, 6), (6, 6)], key=repr)
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([3, 6, None], key=repr)

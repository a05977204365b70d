"""Operators without SQL against plain Python: shrinkage, schedule and shares, kernel, divergence, and the pipeline's stages."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
from tracelens.llm import chat, exact_dedup, jaccard_join, mixing, quality, rules, suffix_dedup, token_files, toxicity  # noqa: E402
from tracelens.llm.common import Work, cut, table  # noqa: E402

SMALL = "/root/testdata/sf0.01"


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def test_shrinkage_of_hosts_and_paths(spark):
    """Method of moments, host and path means without the row's own probability, log-odds: all again in Python."""
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    rows = quality.classify(docs, labels).collect()
    p = np.array([r["p"] for r in rows])
    host, path = [r["host"] for r in rows], [(r["host"], r["path"]) for r in rows]
    groups = lambda keys: {k: p[[i for i, x in enumerate(keys) if x == k]] for k in set(keys)}
    hosts, paths, mean = groups(host), groups(path), p.mean()

    def strength(g, about):
        n = sum(map(len, g.values()))
        within = sum(((x - x.mean()) ** 2).sum() for x in g.values()) / n
        between = max(0.0, sum(len(x) * (x.mean() - about(k)) ** 2 for k, x in g.items()) / n - within * len(g) / n)
        return min(1e4, max(1.0, within / between)) if between > 0 else 1e4

    k_host, k_path = strength(hosts, lambda k: mean), strength(paths, lambda k: hosts[k[0]].mean())
    odds = lambda x: max(x, 1e-6) / max(1 - x, 1e-6)
    for i, r in enumerate(rows):
        h, q = hosts[host[i]], paths[path[i]]
        up = (k_host * mean + h.sum() - p[i]) / (k_host + len(h) - 1)
        prior = (k_path * up + q.sum() - p[i]) / (k_path + len(q) - 1)
        assert r["host_posterior"] == pytest.approx(up) and r["path_posterior"] == pytest.approx(prior)
        assert r["score"] == pytest.approx(1 / (1 + (1 - p[i]) / max(p[i], 1e-9) * odds(mean) / odds(prior)), rel=1e-6)
        assert r["kept"] == (r["score"] >= 0.5)


def test_a_lone_row_is_not_moved_by_itself(spark):
    rows = spark.createDataFrame([("h", "a", 0.9), ("h", "a", 0.7), ("lone", "b", 0.01)], "host string, path string, p double")
    with Work(spark):
        groups, mean, k_host, k_path = quality.posteriors(rows)
        g = {r["host"]: r for r in groups.collect()}["lone"]
    assert g["n"] == 1 and (k_host * mean + g["host_s"] - 0.01) / (k_host + g["host_n"] - 1) == pytest.approx(mean)


def test_classifier_on_labels_that_it_did_not_see(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    seen = F.col("doc_id") % 2 == 0
    got = by_id(quality.classify(docs, labels.filter(seen)))
    rest = labels.filter(~seen).collect()
    share = np.mean([r["quality"] for r in rest])
    right = np.mean([got[r["doc_id"]]["kept"] == bool(r["quality"]) for r in rest])
    assert right > 0.95 and right > max(share, 1 - share) + 0.05


def brute_mix(docs, weights=(5, 2, 1), epochs=1.5, limit=2.0, block=64):
    """Targets by filling up, the golden-ratio schedule, and blocks of each source's shuffled words, slot by slot."""
    size = defaultdict(int)
    for d in docs:
        size[d["source"]] += d["size"]
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = epochs * sum(size.values()), set(names), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * share > limit * size[s]}
        if not full:
            target |= {s: weight[s] * share for s in open_}
            break
        for s in full:
            target[s] = limit * size[s]
            left -= target[s]
        open_ -= full
    taken = Counter()
    for s in names:
        goal = math.floor(target[s])
        stream = [d for d in sorted((d for d in docs if d["source"] == s and d["size"]), key=lambda d: (d["key"], d["doc_id"])) for _ in range(d["size"])]
        for at in range(goal):  # blocks follow each other, epoch after epoch, and the last is cut
            taken[stream[at % len(stream)]["doc_id"]] += 1
    return target, taken


def test_mixture_takes_each_document_as_brute_force_does(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    key = F.xxhash64(F.lit(7), F.col("doc_id")).bitwiseAND(F.lit((1 << 62) - 1))
    keys = {r["doc_id"]: r["key"] for r in rows.select("doc_id", key.alias("key")).collect()}
    docs = [{"doc_id": r["doc_id"], "source": r["source"], "size": len(words(r["text"])), "key": keys[r["doc_id"]]} for r in rows.collect()]
    target, taken = brute_mix(docs)
    found = mixing.mix(rows)
    for r in found.documents.collect():
        assert r["target"] == pytest.approx(target[r["source"]]) and r["taken"] == taken[r["doc_id"]], r
    # The schedule itself: every golden-ratio point that is used lies in its source's span, and ranks follow the points.
    names = sorted({d["source"] for d in docs}, key=lambda s: (s is None, (s or "").encode()))
    ends = np.cumsum([target[s] for s in names]) / sum(target.values())
    slots = found.schedule.toPandas().sort_values("slot")
    ranks, total = Counter(), math.ceil(sum(target.values()) / 64)
    for s in slots.itertuples():
        if s.slot < total:
            point = s.slot * mixing.GOLDEN % 1.0
            assert int(np.searchsorted(ends, point, "right")) == s.srank
        assert s.place == ranks[s.srank]
        ranks[s.srank] += 1


def test_applied_mixture_gives_alike_rows_their_own_shares(spark):
    rows = [(2, "d e", "s"), (2, "d e", "s"), (2, "x y", "s"), (None, "d e", "s"), (None, "d e", "s"), (7, "one two three", None), (8, None, "s")]
    docs = spark.createDataFrame([(*r, 7, 1) for r in rows], "doc_id long, text string, source string, taken_id int, __id int")
    want = Counter()
    for r in mixing.mix(docs).documents.collect():
        want[r["doc_id"], r["size"]] += r["taken"]
    got = Counter()
    for r in mixing.apply(docs).collect():
        got[r["doc_id"], {"d": 2, "x": 2, "o": 3}[r["text"].strip()[0]]] += len(words(r["text"]))
        assert r["taken_id"] == 7 and r["__id"] == 1
    assert got == Counter({k: v for k, v in want.items() if v})


def kernel(a, b, decay=toxicity.DECAY):
    """All common subsequences of three letters, each with decay to the letters that it spans in both."""
    def spans(word):
        out, word = Counter(), "^" + word
        for i in range(len(word)):
            for j in range(i + 1, len(word)):
                for k in range(j + 1, len(word)):
                    out[word[i] + word[j] + word[k]] += decay ** (k - i + 1)
        return out

    x, y = spans(a), spans(b)
    dot = lambda u, v: sum(u[t] * v[t] for t in u)
    return dot(x, y) / math.sqrt(dot(x, x) * dot(y, y))


def test_subsequence_kernel_is_that_of_its_definition():
    some = ["moron", "morron", "mxoron", "flower", "abc", "aaa"]
    known, rows = toxicity.features(some)
    found = dict(zip(known.tolist(), rows))
    for i, a in enumerate(some):
        for j, b in enumerate(some):
            assert sum(v * found[j].get(u, 0.0) for u, v in found[i].items()) == pytest.approx(kernel(a, b), abs=1e-5)
    assert kernel("moron", "mxoron") > 0.3 > kernel("moron", "flower")


def test_toxic_machine_finds_altered_words():
    bad, good = ["blockhead", "numbskull", "nitwit", "dimwit"], ["flower", "garden", "window", "market", "blanket", "number", "mountain", "river"]
    machine = toxicity.train_words(bad + toxicity.altered(bad), good)
    low = lambda w: machine.margins(w).min()
    assert low(["blockkhead", "numbxskull", "nitw1t", "dimmwit"]) > machine.margins(["garment", "windows", "remarked", "bracket"]).max()


@pytest.mark.parametrize("d, recall, precision", [(SMALL, 0.5, 0.5), ("/root/testdata/sf0.1", 0.85, 0.6)])
def test_toxic_rows_held_out_are_found(spark, d, recall, precision):
    """Above a constant predictor by a margin: half of the toxic rows at least, most of what is called toxic being so."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    got = toxicity.score(docs, toxicity.train(docs, labels)).filter("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in got)
    assert hit >= recall * sum(r["toxic"] for r in got) and hit >= precision * sum(r["predicted"] for r in got)


def test_divergence_and_verdicts_follow_the_references(spark):
    docs = table(spark, SMALL, "documents")
    rows = rules.counts(docs).collect()
    got = by_id(rules.judge(docs))

    def js(p, q):
        p, q = np.array(p, float), np.array(q, float)
        if len(p) != len(q) or not p.sum() or not q.sum():
            return 0.0
        p, q = p / p.sum(), q / q.sum()
        m = (p + q) / 2
        part = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x > 0)
        return (part(p) + part(q)) / 2

    good = [r for r in rows if not r["base_failed"]]
    total = np.sum([r["classes"] for r in good], axis=0)
    refs = {}
    for lang in {r["lang"] for r in rows}:
        own = [r for r in good if r["lang"] == lang]
        refs[lang] = (np.sum([r["classes"] for r in own], axis=0), np.sum([r["common"] for r in own], axis=0)) if lang is not None and len(own) >= 20 else (total, [])
    for r in rows:
        c, w = refs[r["lang"]]
        a, b = js(r["classes"], c), js(r["common"], w)
        g = got[r["doc_id"]]
        assert g["class_divergence"] == pytest.approx(a, abs=1e-9) and g["word_divergence"] == pytest.approx(b, abs=1e-9)
        far = js([0] * (len(w) - 1) + [1], w) if len(w) else 0.0
        bound = min(0.2, 0.25 * far + (len(r["common"]) - 1) / (8 * math.log(2) * max(1, r["n_words"])))
        fits = (r["word_chars"] < 200 or a <= 0.05) and (r["n_words"] < 100 or b <= bound)
        assert g["kept"] == (not r["base_failed"] and fits)


def test_other_languages_documents_change_no_verdict(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text", "lang")
    few = docs.filter("lang = 'es'")
    many = few.unionByName(docs.filter("lang = 'en'").crossJoin(spark.range(60)).select((F.col("id") * 100_000 + 10**7 + F.col("doc_id")).alias("doc_id"), "text", "lang"))
    a, b = by_id(rules.judge(few)), by_id(rules.judge(many))
    assert len(a) * 300 < len(b) and all(b[i]["kept"] == r["kept"] and b[i]["word_divergence"] == pytest.approx(r["word_divergence"]) for i, r in a.items())


def test_windows_that_share_hash_bits_are_told_apart(spark):
    """Texts of a million bits of position leave 44 for the hash; here the slow way is compared with counting."""
    rng = np.random.default_rng(3)
    text = " ".join(f"w{x}" for x in rng.integers(0, 40, 3000))
    w = words(text)
    grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    hit = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
    got = spark.createDataFrame([(text,)], "text string").select(rules.repeated_words(F.split("text", " "))).first()[0]
    assert got == len(hit)


ODD = [(1, "a b c d e f g " * 30, "en", "s", 9), (1, "a b c d e f g " * 30, "en", "s", 9), (None, "a b c d e f g " * 30, None, None, None), (2, None, "en", "s", 0), (3, "", None, "s", 0), (None, None, None, None, None), (4, "lone words here", "xx", None, 3), (5, "A b c d e f g " * 30, "en", "s", 9)]


def odd(spark, rows=ODD):
    """Repeated rows, null ids, ties, empty texts, and columns named as operators might name their own."""
    clash = ["__id", "__n", "__rn", "n", "s", "p", "key", "size", "place", "taken", "sha", "kept_id", "hash", "path", "host", "uid", "word", "i", "piece", "wanted_id", "group_source"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(7).alias(c) for c in clash])


STAGES = {
    "accept": lambda spark, d: quality.accept(d, table(spark, SMALL, "labels")),
    "keep_first": lambda spark, d: exact_dedup.keep_first(d),
    "keep_representatives": lambda spark, d: jaccard_join.keep_representatives(d),
    "apply": lambda spark, d: mixing.apply(d),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_bear_clashing_columns_nulls_and_repeats(spark, name):
    docs = odd(spark)
    got = STAGES[name](spark, docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert all(r[c] == 7 for r in rows for c in docs.columns[5:]) and set(r["doc_id"] for r in rows) <= {r[0] for r in ODD}
    if name == "keep_first":
        assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter([(1, ODD[0][1]), (2, None), (4, ODD[6][1]), (5, ODD[7][1])])
    if name == "keep_representatives":
        assert Counter(r["doc_id"] for r in rows) == Counter([1, 1, None, 2, 3, None, 4])
    assert STAGES[name](spark, odd(spark, [])).count() == 0


def test_operators_bear_clashing_columns_nulls_and_repeats(spark, tmp_path):
    from test_operators import PATH

    docs, none = odd(spark), odd(spark, [])
    index = exact_dedup.DigestIndex(spark)
    labels = table(spark, SMALL, "labels")
    made = {
        "quality": lambda d: quality.classify(d, labels),
        "mix": lambda d: mixing.mix(d).documents,
        "toxic": lambda d: toxicity.score(d, toxicity.train(d, labels)),
        "exact": lambda d: exact_dedup.deduplicate(d, index, batch="b"),
        "suffix": lambda d: suffix_dedup.deduplicate(d, length=40),
        "jaccard": lambda d: jaccard_join.join(d)[0],
        "rules": lambda d: rules.judge(d),
        "files": lambda d: token_files.read(spark, token_files.write(d, PATH, out=str(tmp_path / f"t{d.count()}"))),
    }
    for name, run in made.items():
        got = run(docs).collect()
        assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in ODD), name
        assert run(none).count() == 0, name
    linked = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(docs)[0].collect()}
    assert linked[5] == 1 and linked[1] == 1 and linked[None] is None and linked[2] == 2
    start = sorted((r["start"], r["n_tokens"]) for r in token_files.read(spark, str(tmp_path / f"t{len(ODD)}")).collect())
    assert all(a + n == b for (a, n), (b, _) in zip(start, start[1:]))
    index.drop()


def test_a_set_without_a_named_row_links_others(spark):
    """Near the first and the last, which are too far apart: the row without an id joins them."""
    base = [f"w{i}" for i in range(100)]
    a, b, c = base[:], base[:], base[:]
    a[10:12], c[80:82] = ["x", "y"], ["u", "v"]
    rows = [(1, " ".join(a)), (None, " ".join(b)), (2, " ".join(c))]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 91)[0].collect()}
    assert got == {1: 1, None: None, 2: 1}


def test_batches_into_the_index_can_be_repeated(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, " a")], "doc_id long, text string")
    first = by_id(exact_dedup.deduplicate(docs, index, batch="monday"))
    assert by_id(exact_dedup.deduplicate(docs, index, batch="monday")) == first and index.rows().count() == 2
    later = by_id(exact_dedup.deduplicate(spark.createDataFrame([(9, "b"), (10, "c")], "doc_id long, text string"), index, batch="tuesday"))
    assert (later[9]["keep_id"], later[9]["kept"], later[10]["kept"]) == (2, False, True)
    index.compact()
    assert index.rows().count() == 3 and not by_id(exact_dedup.deduplicate(docs, index, batch="friday"))[1]["kept"]
    index.drop()


def test_suffix_arrays_factors(spark):
    """LPF of small texts against all earlier starts; then hot anchors in blocks against the whole."""
    rng = np.random.default_rng(5)
    texts = ["".join("ab"[x] for x in rng.integers(0, 2, 60)) for _ in range(4)]
    o, p, lpf = suffix_dedup.longest_previous(np.zeros(4, np.int64), np.arange(4), np.zeros(4, np.int64), [t.encode() for t in texts], 8)
    seen = set()
    for i, t in enumerate(texts):
        for k in range(len(t) - 7):
            got = lpf[(o == i) & (p == k)][0] >= 8
            assert got == (t[k : k + 8] in seen), (i, k)
            seen.add(t[k : k + 8])


def test_hot_passages_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    passage = "".join(chr(97 + x) for x in rng.integers(0, 26, 260))
    texts = ["".join(chr(97 + x) for x in rng.integers(0, 26, 40 + i % 7)) + passage[i % 5 :] + "".join(chr(97 + x) for x in rng.integers(0, 26, 50)) for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = by_id(suffix_dedup.deduplicate(docs))
    monkeypatch.setattr(suffix_dedup, "BLOCK", 7)
    assert by_id(suffix_dedup.deduplicate(docs)) == whole and sum(r["n_removed"] > 200 for r in whole.values()) == 199


def test_long_conversations_take_linear_time(spark):
    import time

    def took(n):
        rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é </s> text "), F.col("id").cast("string")).alias("text"))
        began = time.time()
        r = chat.digests(chat.format_chats(rows)).collect()[0]
        assert r["n_turns"] == n and r["loss_chars"] == sum(len(f"é </s> text {i}") for i in range(1, n, 2))
        return time.time() - began

    took(100)
    assert took(80_000) < 60
    assert chat.digests(chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_work_leaves_nothing_behind(spark, tmp_path):
    from pathlib import Path

    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    with Work(spark) as work:
        kept = work.keep(cut(spark.range(5)))
        folder = Path(work.folder)
        assert folder.exists()
    assert not folder.exists() and kept.count() == 5 and shared.exists()


def test_pipeline_matches_brute_force(spark, sf_dir):
    """Every stage's rows from its predecessor's, in Python."""
    import importlib.util

    if not importlib.util.find_spec("corpus_pipeline"):
        pytest.skip("no pipeline")
    import hashlib

    import corpus_pipeline
    from test_operators import PATH
    from tokenizers import Tokenizer

    docs = table(spark, sf_dir, "documents")
    rows = [r.asDict() for r in docs.collect()]
    kind = docs.schema
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, rows: [r.asDict() for r in stages[name](spark, spark.createDataFrame([tuple(r[c] for c in kind.names) for r in rows], kind), sf_dir).collect()]
    key = lambda rows: sorted((r["doc_id"], r["text"] or "") for r in rows)

    labels = table(spark, sf_dir, "labels")
    good = {r["doc_id"] for r in quality.classify(docs, labels).filter("kept").collect()}
    one = run("quality classifier", rows)
    assert key(one) == key([r for r in rows if r["doc_id"] in good]) and good
    best = {}
    for r in sorted(one, key=lambda r: (-len(r["text"] or ""), r["doc_id"])):
        best.setdefault("".join(words(r["text"])), r)
    two = run("exact dedup", one)
    assert key(two) == key(best.values())
    sets = {r["doc_id"]: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for r in two for w in [[x.decode() for x in (r["text"] or "").encode().lower().split()]]}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    three = run("n-gram Jaccard join", two)
    assert key(three) == key([r for r in two if find(r["doc_id"]) == r["doc_id"]])
    keys = {r["doc_id"]: r["key"] for r in docs.select("doc_id", F.xxhash64(F.lit(7), F.col("doc_id")).bitwiseAND(F.lit((1 << 62) - 1)).alias("key")).collect()}
    _, taken = brute_mix([{"doc_id": r["doc_id"], "source": r["source"], "size": len(words(r["text"])), "key": keys[r["doc_id"]]} for r in three])
    four = run("mixing sources", three)
    got = Counter()
    for r in four:
        got[r["doc_id"]] += len(words(r["text"]))
    assert got == Counter({k: v for k, v in taken.items() if v})
    texts = {r["doc_id"]: r["text"] or "" for r in three}
    assert all(texts[r["doc_id"]].split()[: len(r["text"].split())] == r["text"].split() for r in four)
    tok = Tokenizer.from_file(PATH)
    last = run("BPE encoding", four)
    want = []
    for r in four:
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()))
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in last) == sorted(want)
    assert corpus_pipeline.run(spark, sf_dir).count() == len(last)

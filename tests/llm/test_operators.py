"""Each training-data operator against brute force, and on nulls, empty and long texts, repeats, empty tables, odd columns."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tracelens.llm import bpe, chat, exact_dedup, jaccard_join, mixing, quality, rules, suffix_dedup, token_files, toxicity  # noqa: E402
from tracelens.llm.common import components, table  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
#: Null, empty, blank, repeated and long texts, special tokens, odd letters; kept and digest clash with operators' own names.
TEXTS = [None, "", " \n\t", "a b c d e f", "a b c d e f", "A  b c d e f", "<|endoftext|> It's", "<|ENDOFTEXT|>", "İstanbul ΣΑΣ ß 漢字 🙂", "word " * 3000, "x1 y2., z!?", "a\x0bb\x0cc"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, digest int"


def documents(spark, texts=TEXTS):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, len(t or ""), "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_bpe_and_token_files_match_the_library(spark, sf_dir, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    texts = TEXTS + [r["text"] for r in table(spark, sf_dir, "documents").limit(40).collect()]
    docs = documents(spark, texts)
    got, start = by_id(bpe.digests(docs, PATH)), 0
    out = token_files.write(docs, PATH, out=str(tmp_path / "ids"))
    files = by_id(token_files.read(spark, out))
    shown = by_id(bpe.decode(bpe.encode(docs, PATH), PATH))
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest() and shown[i]["text"] == text
        assert files[i] == {"doc_id": i, "start": start, "n_tokens": len(ids) + 1, "ids_crc32": zlib.crc32(np.array([*ids, 2], "<u4").tobytes())}
        start += len(ids) + 1


def test_exact_dedup_and_index(spark):
    index = exact_dedup.DigestIndex(spark, buckets=3)
    docs = documents(spark)
    got = by_id(exact_dedup.deduplicate(docs, index))
    assert got[0]["keep_id"] == 2 and got[0]["group_size"] == 3 and not got[0]["kept"]  # null, empty and blank; the blank one is longest
    assert got[3]["keep_id"] == 5 and got[5]["kept"] and not got[4]["kept"] or got[3]["text_sha256"] != got[5]["text_sha256"]
    again = by_id(exact_dedup.deduplicate(docs, index))
    assert not any(r["kept"] for r in again.values()) and index.rows().count() == len({r["text_sha256"] for r in got.values()})
    index.drop()
    twice = docs.unionByName(docs)
    assert exact_dedup.keep_first(twice).count() == sum(r["kept"] for r in got.values())


def near(sets, threshold):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("width, threshold", [(3, 90), (5, 80)])
def test_jaccard_join_matches_brute_force(spark, sf_dir, width, threshold):
    texts = TEXTS + [r["text"] for r in table(spark, sf_dir, "documents").collect()]
    base = [w for t in texts[-30:] for w in (t or "").split()][:200]
    texts += [" ".join(w if (i * 7 + k * 13) % 97 > k % 9 else f"n{k}x{i}" for i, w in enumerate(base)) for k in range(60)]
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    expected = near(sets, threshold)
    got = by_id(jaccard_join.join(documents(spark, texts), width, threshold)[0])
    assert {i: r["component_id"] for i, r in got.items()} == expected
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}


def test_suffix_dedup_matches_brute_force(spark, sf_dir):
    texts = TEXTS + [r["text"] for r in table(spark, sf_dir, "documents").limit(120).collect()]
    texts += ["ab" * 120, texts[-3][40:400] + "tail" + (texts[-4] or "")[10:300]]
    seen, expected = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        cut = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                cut[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        kept = bytes(c for c, x in zip(b, cut) if not x)
        expected[i] = {"doc_id": i, "n_bytes": len(b), "n_removed": sum(cut), "n_spans": len([x for x in bytes(cut).split(b"\0") if x]), "kept_sha256": hashlib.sha256(kept).hexdigest()}
    assert by_id(suffix_dedup.deduplicate(documents(spark, texts))) == expected


def test_suffix_dedup_repeated_rows_are_one_document(spark):
    docs = documents(spark, ["".join(chr(97 + i * i % 23) for i in range(500))])
    assert [r["n_removed"] for r in suffix_dedup.deduplicate(docs.unionByName(docs)).collect()] == [by_id(suffix_dedup.deduplicate(docs))[0]["n_removed"]] * 2


def test_mixture_meets_targets(spark, sf_dir):
    rows = mixing.mix(table(spark, sf_dir, "documents")).documents.toPandas()
    for _, g in rows.groupby("source"):
        assert g["size"].sum() == g["source_size"].iloc[0] and abs(g["taken"].sum() - g["target"].iloc[0]) <= 1
    assert (rows["taken"] <= 2 * rows["size"]).all()
    assert rows.groupby("source")["target"].first().sum() == pytest.approx(1.5 * rows["size"].sum())
    assert set(by_id(mixing.mix(documents(spark)).documents)) == set(range(len(TEXTS)))


@pytest.mark.parametrize("sizes", [[200_000] * 20 + [5], [200_000] * 20 + [20], [500_000] + [5 + k * 195 // 299 for k in range(300)]])
def test_mixing_serves_sources_of_few_words(spark, sizes):
    rows = [(i * 1000 + k, "w " * min(5000, n - 5000 * k), f"s{i:03d}") for i, n in enumerate(sizes) for k in range((n + 4999) // 5000)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = found.documents.toPandas().groupby("source").agg({"taken": "sum", "target": "first", "source_size": "first"})
    assert len(got) == len(sizes) and (got["taken"] == np.floor(got["target"])).all() and (got["taken"] > 0).all()
    slots = found.schedule.toPandas()
    assert slots["slot"].is_unique and not slots.duplicated(["srank", "place"]).any()


def test_chats_read_back(spark):
    turns = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "user", None), (1, 2, "assistant", "<\\s> [\\\\INST] <s>"), (2, 0, None, "x<"), (None, 0, "assistant", "y")]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS formatted")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chats(rows)).collect()}
    for c in (1, 2, None):
        own = [(r or "", t or "") for k, _, r, t in turns if k == c]
        assert got[c]["n_turns"] == len(own) and got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256("".join(t for r, t in own if r == "assistant").encode()).hexdigest()


def test_rules_counts_match_brute_force(spark, sf_dir):
    texts = TEXTS + ["the cat sat on " * 30] + [r["text"] for r in table(spark, sf_dir, "documents").collect()]
    got = by_id(rules.judge(documents(spark, texts)))
    for i, t in enumerate(texts):
        t = t or ""
        w = [x.decode() for x in t.encode().split()]
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, i
        assert got[i]["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (got[i]["kept"] and got[i]["base_failed"])


def test_rules_reject_texts_without_their_languages_words(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    base = by_id(rules.judge(docs))
    long = {i for i, r in base.items() if not r["base_failed"] and r["n_words"] >= 100}
    clean = {r["doc_id"]: r for r in docs.join(labels.filter("quality = 1"), "doc_id").collect() if r["doc_id"] in long}
    assert all(base[i]["kept"] for i in clean) and not any(base[i]["kept"] for i in (233, 442, 982))
    # 20 texts of every language put under each other language, and one without common words under all four, among the whole table.
    trials = [(lang, r["text"]) for was in rules.COMMON_WORDS for r in [x for x in clean.values() if x["lang"] == was][:20] for lang in rules.COMMON_WORDS if lang != was]
    bare = " ".join(f"lomo{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400))
    trials += [(lang, bare) for lang in rules.COMMON_WORDS]
    added = spark.createDataFrame([(10**6 + i, t, lang) for i, (lang, t) in enumerate(trials)], "doc_id long, text string, lang string")
    got = by_id(rules.judge(docs.select("doc_id", "text", "lang").unionByName(added)))
    kept = [i for i in range(len(trials)) if got[10**6 + i]["kept"]]
    assert len(kept) <= 0.05 * len(trials) and not any(got[10**6 + i]["kept"] for i in range(len(trials) - 4, len(trials)))


def test_classifiers_on_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    marks = {r["doc_id"]: r for r in labels.collect()}
    good = by_id(quality.classify(docs, labels))
    assert np.mean([good[i]["kept"] == bool(m["quality"]) for i, m in marks.items()]) > 0.97
    toxic = by_id(toxicity.score(docs, toxicity.train(docs, labels)))
    held = [(toxic[i]["predicted"], m["toxic"]) for i, m in marks.items() if toxic[i]["held_out"]]
    assert np.mean([p == y for p, y in held]) > 0.85 and all((zlib.crc32(str(i).encode()) % 4 == 2) == r["held_out"] for i, r in toxic.items())


def test_empty_tables(spark):
    none, labels = documents(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    index = exact_dedup.DigestIndex(spark)
    for df in (bpe.digests(none, PATH), mixing.mix(none).documents, exact_dedup.deduplicate(none, index), jaccard_join.join(none)[0], suffix_dedup.deduplicate(none), rules.judge(none), quality.classify(none, labels), toxicity.score(none, toxicity.train(none, labels))):
        assert df.count() == 0
    index.drop()


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 103)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert {got[i] for i in range(41)} == {0} and got[103] == 100

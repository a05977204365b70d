"""Quality rules by distribution divergence, in DataFrame operations only.

A document's character-class histogram and common-word histogram are compared with its language's references by
Jensen-Shannon divergence (base 2). The references are sums over all documents of the language that pass the base rules
(grouped aggregation). A language with fewer than min_docs such documents, and null, use the class sums over all languages and have no word
test; how many documents other languages have makes no difference to it. COMMON_WORDS lists the words; other languages have the
class test alone.
Short texts are guarded: below min_chars the character test passes, below min_words the word test.

A text without any common word is only as far from the reference as the reference's common-word share allows (0.13 to 0.14
at a share of a quarter). The word test's bound is therefore reach of that distance, plus what n words drawn from the
reference itself diverge by on average (cells - 1) / (8 ln 2 n), and never above max_common.

Defined results. Null and empty texts have zero counts and fail the base rules. Repeated rows are judged one by one. An
empty table gives an empty result. Extra columns are ignored. Texts of any length are read whole; all steps are linear in
the words but for one primitive sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelens.llm.common import SPACE, SPACE_CLASS, Work, cut, join_groups, let

SYMBOLS = "#*$%&|<>"
#: Frequent function words by language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "as", "with", "on", "be", "at", "by"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "dans", "par", "au"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no"],
}
#: Class name and what is *not* in it, so that counting keeps few characters.
CLASSES = {"upper": r"[^\p{Lu}]+", "digit": "[^0-9]+", "symbol": r"[^#*$%&|<>]+", "bang": r"[^!?]+", "punct": r"[^.,;:'\"()\-\[\]/]+"}


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text that is not null."""
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE_CLASS}]+"))


def repeated_words(words: Column, window: int = 3) -> Column:
    """How many words lie in a window of that many words that the text has twice or more.

    Each window's 64-bit hash is shifted left by the bits that a position needs, the position is put below, and the longs
    are sorted: equal windows become neighbours. Neighbours with equal hash bits are then compared word by word; if any differ,
    as they may in very long texts, the text's windows are sorted by their words instead.
    """

    def counted(w: Column) -> Column:
        n = F.size(w) - (window - 1)
        bits = F.length(F.bin(n.cast("long"))).cast("int")
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

        def by_bits(c: Column) -> Column:
            b, m = c["bits"], c["mask"]
            hashed = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.call_function("shiftleft", F.xxhash64(*[w[i + k] for k in range(window)]), b).bitwiseOR(i.cast("long")))

            def bits_equal(x: Column, y: Column) -> Column:
                return F.call_function("shiftright", x, b) == F.call_function("shiftright", y, b)

            def words_equal(x: Column, y: Column) -> Column:
                at = lambda v, k: w[v.bitwiseAND(m).cast("int") + k]
                equal = at(x, 0) == at(y, 0)
                for k in range(1, window):
                    equal = equal & (at(x, k) == at(y, k))
                return equal

            def twice(s: Column, equal) -> Column:
                last = F.size(s) - 1
                return F.filter(s, lambda x, i: F.when((i > 0) & equal(x, s[F.greatest(i - 1, F.lit(0))]), F.lit(True)).otherwise((i < last) & equal(x, s[F.least(i + 1, last)])))

            def found(s: Column) -> Column:
                mixed = F.exists(F.sequence(F.lit(1), F.size(s) - 1), lambda i: bits_equal(s[i], s[i - 1]) & ~words_equal(s[i], s[i - 1]))
                whole = F.sort_array(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(*[w[i + k].alias(f"w{k}") for k in range(window)], i.alias("i"))))
                by_words = let(whole, lambda z: F.transform(twice(z, lambda x, y: F.struct(*[x[f"w{k}"] for k in range(window)]) == F.struct(*[y[f"w{k}"] for k in range(window)])), lambda x: x["i"]))
                by_hash = F.transform(twice(s, bits_equal), lambda x: x.bitwiseAND(m).cast("int"))
                return F.when(mixed, by_words).otherwise(by_hash)

            places = let(F.sort_array(hashed), lambda s: F.sort_array(found(s)))
            gaps = let(places, lambda p: F.transform(p, lambda x, i: F.when(i == 0, F.lit(window)).otherwise(F.least(F.lit(window), x - p[F.greatest(i - 1, F.lit(0))]))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

        return F.when(n < 2, F.lit(0).cast("long")).otherwise(let(F.struct(bits.alias("bits"), mask.alias("mask")), by_bits))

    return let(words, counted)


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, the base counts, and the two histograms (arrays of longs) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), text.alias("text"), words_of(text).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    common = F.array().cast("array<string>")
    for lang, known in COMMON_WORDS.items():
        common = F.when(F.col("lang") == lang, F.array(*[F.lit(x) for x in known])).otherwise(common)
    plain = F.translate(F.lower("text"), ".,;:!?\"'()[]" + SYMBOLS, "")
    rows = rows.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        *[F.length(F.regexp_replace("text", rest, "")).cast("long").alias(name) for name, rest in CLASSES.items()],
        let(common, lambda c: let(F.filter(F.split(plain, f"[{SPACE_CLASS}]+"), lambda w: F.array_contains(c, w)), lambda hits: F.transform(c, lambda x: F.size(F.filter(hits, lambda h: h == x)).cast("long")))).alias("hits"),
    )
    rest = F.greatest(F.lit(0).cast("long"), F.col("word_chars") - sum((F.col(c) for c in CLASSES), F.lit(0)))
    classes = F.array(rest, *[F.col(c) for c in CLASSES])
    other = F.greatest(F.lit(0).cast("long"), F.col("n_words") - F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), classes.alias("classes"), F.concat("hits", F.array(other)).alias("common"))


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence, base 2, of two histograms of counts; 0 where either is empty or they differ in length."""
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda a, x: a + x)

    def term(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))

    def with_totals(t: Column) -> Column:
        terms = F.zip_with(p, q, lambda a, b: 0.5 * (term(a / t["p"], b / t["q"]) + term(b / t["q"], a / t["p"])))
        return F.when((F.size(p) != F.size(q)) | (t["p"] <= 0) | (t["q"] <= 0), F.lit(0.0)).otherwise(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))

    return let(F.struct(total(p).alias("p"), total(q).alias("q")), with_totals)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_chars: int = 200, min_words: int = 100, max_classes: float = 0.05, max_common: float = 0.2, min_docs: int = 20, reach: float = 0.25) -> DataFrame:
    """doc_id, n_words, the base counts, base_failed, kept, and the two divergences."""
    with Work(docs.sparkSession) as work:
        rows = work.keep(counts(docs, id_col, text_col, lang_col))
        k, widest = len(CLASSES) + 1, 1 + max(len(x) for x in COMMON_WORDS.values())
        good = ~F.col("base_failed")
        sums = [F.sum(F.when(good, F.get("classes", F.lit(i)))).alias(f"c{i}") for i in range(k)] + [F.sum(F.when(good, F.get("common", F.lit(i)))).alias(f"w{i}") for i in range(widest)]
        by_lang = cut(rows.groupBy("lang").agg(F.count("*").alias("all"), F.count_if(good).alias("n"), *sums))
        whole = by_lang.agg(F.sum("all").alias("all"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(k)]).first()
        classes = F.array(*[F.coalesce(F.col(f"c{i}"), F.lit(0)).cast("double") for i in range(k)])
        words = F.filter(F.array(*[F.col(f"w{i}").cast("double") for i in range(widest)]), lambda x: x.isNotNull())
        known = (F.col("n") >= min_docs) & F.col("lang").isNotNull()
        of_all = F.array(*[F.lit(float(whole[f"c{i}"] or 0)) for i in range(k)])
        own = by_lang.select("lang", "all", F.when(known, classes).otherwise(of_all).alias("ref_classes"), F.when(known, words).otherwise(F.array().cast("array<double>")).alias("ref_common"))
        none_common = F.transform("ref_common", lambda x, i: F.when(i == F.size("ref_common") - 1, F.lit(1.0)).otherwise(F.lit(0.0)))
        own = work.keep(own.withColumn("farthest", divergence(none_common, F.col("ref_common"))))
    # Rows of large languages stay where they are, those of small ones meet their reference by a shuffle.
    rows = join_groups(rows, own, ["lang"], "all", whole["all"] or 0)
    as_double = lambda c: F.transform(c, lambda x: x.cast("double"))
    rows = rows.withColumns({
        "class_divergence": divergence(as_double("classes"), F.col("ref_classes")),
        "word_divergence": F.coalesce(divergence(as_double("common"), F.col("ref_common")), F.lit(0.0)),
    })
    by_chance = (F.size("common") - 1) / (8 * math.log(2) * F.greatest(F.col("n_words"), F.lit(1)))
    bound = F.least(F.lit(max_common), reach * F.coalesce("farthest", F.lit(0.0)) + by_chance)
    fits = ((F.col("word_chars") < min_chars) | (F.col("class_divergence") <= max_classes)) & ((F.col("n_words") < min_words) | (F.col("word_divergence") <= bound))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & fits).alias("kept"), "class_divergence", "word_divergence")

"""Text and URL functions of answer grading, as Column expressions. Blanks are Unicode's, as str.split() has them."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"(?U)[\s\x1c-\x1f]"
#: The same characters, one by one.
BLANKS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Number words by value, and the ASCII punctuation that normalisation deletes.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Query parameters that only track, and the prefix of more.
TRACKING_PARAMS = ["fbclid", "gclid", "mc_cid", "mc_eid", "igshid", "ref", "ref_src"]
TRACKING_PREFIX = "utm_"
#: How an answer is marked, and what an abstention says.
ANSWER_MARK = r"(?is)FINAL ANSWER:\s*(.+)"
ABSTENTIONS = ["cannot determine", "unable to find", "insufficient information", "no final answer"]
#: What a throttled service's message holds.
THROTTLED = ["429", "rate limit", "ratelimit", "too many requests", "throttle"]
#: Fixed value: the characters of a case's name, one by one: Java looks these up in a table, but tries each range on each character.
NAMED = f"{string.ascii_letters}{string.digits}_.:-"
#: RFC 3986, appendix B, with the scheme's letters checked.
URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"

#: What it begins with: scheme and host.
PLACE = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?"


def strip(text: Column) -> Column:
    """Trimmed from both ends: a pattern would be tried at each blank within the text."""
    return F.btrim(text, F.lit(BLANKS))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, f"{BLANK}+"), lambda w: w != "")


def collapse(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def normalize_answer(text: Column) -> Column:
    """Lower case, articles out, punctuation out, number words as digits, single blanks."""
    bare = F.translate(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\b(a|an|the)\b", " "), PUNCTUATION, "")
    number = F.create_map(*[F.lit(x) for i, w in enumerate(NUMBER_WORDS) for x in (w, str(i))])
    return F.array_join(F.transform(tokens(bare), lambda w: F.coalesce(F.try_element_at(number, w), w)), " ")


def exact_match(prediction: Column, gold: Column) -> Column:
    return normalize_answer(prediction) == normalize_answer(gold)


def any_exact_match(prediction: Column, golds: Column) -> Column:
    return F.exists(F.coalesce(golds, F.array().cast("array<string>")), lambda g: exact_match(prediction, g))


def token_f1(prediction: Column, gold: Column) -> Column:
    """F1 of the token multisets; 1 if both are empty, 0 if one is. One sort and one pass."""
    words = lambda c: F.filter(F.split(normalize_answer(c), " "), lambda w: w != "")
    p, g = words(prediction), words(gold)
    side = lambda a, i: F.transform(a, lambda w: F.struct(w.alias("w"), F.lit(i).alias("side")))
    both = F.array_sort(F.concat(side(p, 0), side(g, 1)))
    start = F.struct(F.lit(None).cast("string").alias("w"), F.lit(0).alias("p"), F.lit(0).alias("same"))

    def step(s: Column, x: Column) -> Column:
        # Of one word, the prediction's come first: each of the gold's then takes one of them away.
        left = F.when(s["w"].eqNullSafe(x["w"]), s["p"]).otherwise(0)
        hit = (x["side"] == 1) & (left > 0)
        after = F.when(x["side"] == 0, left + 1).when(hit, left - 1).otherwise(left)
        return F.struct(x["w"].alias("w"), after.alias("p"), (s["same"] + F.when(hit, 1).otherwise(0)).alias("same"))

    same = F.aggregate(both, start, step, lambda s: s["same"])
    return F.when((F.size(p) == 0) & (F.size(g) == 0), 1.0).when(same == 0, 0.0).otherwise(2.0 * same / (F.size(p) + F.size(g)))


def simple_text(text: Column) -> Column:
    return collapse(F.lower(F.coalesce(text, F.lit(""))))


def answer_in_text(gold: Column, text: Column) -> Column:
    """Whether the text holds the answer, normalised or as it is; false where either is empty."""
    return holds(normalize_answer(gold), simple_text(gold), text)


def holds(gold: Column, exact: Column, text: Column) -> Column:
    """answer_in_text with the answer's forms, normalised and simple, at hand: in a lambda, these are not made again for each text.

    A text that holds an answer that is not empty isn't empty itself, so that it is normalised once more only after a simple hit.
    """
    t = normalize_answer(text)
    return F.coalesce((gold != "") & (F.contains(t, gold) | ((exact != "") & F.contains(simple_text(text), exact) & (t != ""))), F.lit(False))


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, group)


def root_domain(url: Column) -> Column:
    return F.regexp_replace(F.lower(_part(url, 3)), r"^www\.", "")


def _reencode(piece: Column) -> Column:
    """A query part decoded and encoded anew; a percent sign that begins no escape stands for itself."""
    plain = F.url_decode(F.regexp_replace(piece, "%(?![0-9A-Fa-f]{2})", "%25"))
    return F.replace(F.replace(F.url_encode(plain), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalize_url(url: Column) -> Column:
    """Tracking parameters and the fragment out, the query encoded anew, scheme and host lowered, one closing slash dropped."""
    return _normalized(strip(F.coalesce(url, F.lit(""))))


def normalized_urls(urls: Column) -> Column:
    """normalize_url of each URL of an array; each is stripped once."""
    return F.transform(F.transform(urls, lambda u: strip(F.coalesce(u, F.lit("")))), _normalized)


def _normalized(u: Column) -> Column:
    name = lambda p: F.substring_index(p, "=", 1)
    value = lambda p: F.when(F.contains(p, F.lit("=")), F.substr(p, F.instr(p, "=") + 1)).otherwise("")
    # Scheme and host are all that a pattern looks for; a name that begins with the prefix does so encoded anew, too, and goes before that.
    bare = F.substring_index(u, "#", 1)
    head = F.substring_index(bare, "?", 1)
    place = F.regexp_extract(head, PLACE, 0)
    asked = F.filter(F.split(F.substr(bare, F.length(head) + 2), "&"), lambda p: (p != "") & ~F.startswith(p, F.lit(TRACKING_PREFIX)))
    pairs = F.transform(asked, lambda p: F.struct(_reencode(name(p)).alias("k"), _reencode(value(p)).alias("v")))
    kept = F.filter(pairs, lambda p: ~p["k"].isin(TRACKING_PARAMS) & ~F.startswith(p["k"], F.lit(TRACKING_PREFIX)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    whole = F.concat(F.lower(place), F.substr(head, F.length(place) + 1), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.regexp_replace(whole, "/$", "")


def source_family(url: Column) -> Column:
    """The host with the first two parts of the path, lowered; an encyclopedia's page goes by its last part; '' without a host."""
    return normalized_family(normalize_url(url))


def normalized_family(u: Column) -> Column:
    """source_family of a normalised URL."""
    host = F.regexp_replace(_part(u, 3), r"^www\.", "")
    parts = F.filter(F.split(_part(u, 4), "/"), lambda x: x != "")
    wiki = F.contains(host, F.lit("wikipedia.org")) & (F.size(parts) > 0)
    first = F.lower(F.array_join(F.slice(parts, 1, 2), "/"))
    return F.when(host == "", "").when(wiki, F.concat(host, F.lit("/wiki/"), F.lower(F.element_at(parts, -1)))).when(F.size(parts) > 0, F.concat(host, F.lit("/"), first)).otherwise(host)


def truncate(text: Column, limit: int) -> Column:
    bare = collapse(F.coalesce(text, F.lit("")))
    return F.when(F.length(bare) > limit, F.concat(F.regexp_replace(F.substring(bare, 1, limit - 1), f"{BLANK}+$", ""), F.lit("..."))).otherwise(bare)


def fit_query(query: Column, max_words: int = 50, max_chars: int = 400) -> Column:
    """The first words, cut back at the last blank where they are too long."""
    fitted = F.array_join(F.slice(tokens(F.coalesce(query, F.lit(""))), 1, max_words), " ")
    head = F.substring(fitted, 1, max_chars)
    whole = F.when(F.contains(head, F.lit(" ")), F.regexp_replace(head, "(?s) [^ ]*$", "")).otherwise(head)
    return F.when(F.length(fitted) <= max_chars, fitted).when(whole == "", head).otherwise(whole)


def estimate_tokens(text: Column) -> Column:
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def stable_id(prefix: str, text: Column, digits: int = 12) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, digits))


def hash_json(**members: Column) -> Column:
    """SHA-256 of the members as JSON: sorted keys, no blanks, null members kept."""
    return F.sha2(F.to_json(F.struct(*[members[k].alias(k) for k in sorted(members)]), {"ignoreNullFields": "false"}), 256)


def artifact_path(url: Column, backend: str = "local") -> Column:
    """Where a page's artifact lies: two levels of digest prefixes."""
    key = normalize_url(url) if backend == "local" else F.concat(F.lit(f"{backend}:"), normalize_url(url))
    digest = F.sha2(key, 256)
    return F.concat(F.substring(digest, 1, 2), F.lit("/"), F.substring(digest, 3, 2), F.lit("/"), digest, F.lit(".json.gz"))


def final_answer(text: Column) -> Column:
    """What follows the mark, or the whole text; single blanks."""
    t = F.coalesce(text, F.lit(""))
    return collapse(F.when(F.regexp_like(t, F.lit(ANSWER_MARK)), F.regexp_extract(t, ANSWER_MARK, 1)).otherwise(t))


def answered(text: Column) -> Column:
    t, answer = F.coalesce(text, F.lit("")), final_answer(text)
    return F.regexp_like(t, F.lit(ANSWER_MARK)) & (answer != "") & ~F.regexp_like(answer, F.lit("(?i)" + "|".join(ABSTENTIONS)))


def parse_json_object(text: Column) -> Column:
    """A model's JSON object as VARIANT, out of code fences or surrounding words; null where there is none."""
    bare = strip(F.coalesce(text, F.lit("")))
    bare = F.when(F.startswith(bare, F.lit("```")), F.regexp_replace(F.regexp_replace(bare, r"^```(?:json)?\s*", ""), r"\s*```$", "")).otherwise(bare)
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.coalesce(F.try_parse_json(bare), F.when(inner != "", F.try_parse_json(inner)))


def tool_arguments(text: Column) -> Column:
    return F.coalesce(F.try_parse_json(F.when(F.coalesce(text, F.lit("")) == "", "{}").otherwise(text)), F.parse_json(F.lit("{}")))


def document_id(query: Column, provider: Column, retrieval: Column, rank: Column) -> Column:
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.concat_ws("::", shown(query), shown(provider), shown(retrieval), F.concat(F.lit("r"), shown(rank)))


def seen_id(search: Column, rank: Column) -> Column:
    shown = F.when(F.coalesce(rank, F.lit(0)) == 0, "x").otherwise(rank.cast("string"))
    return F.concat(F.lit("s"), search.cast("string"), F.lit("r"), shown)


def _named(*bits: Column) -> Column:
    """Parts of a name, joined; characters that a name may not have go. A separator is never part of such a run: parts can be named apart."""
    return F.regexp_replace(F.concat_ws("__", *[F.coalesce(b.cast("string"), F.lit("")) for b in bits]), f"[^{NAMED}]+", "_")


def case_stem(provider: Column, query: Column, retrieval: Column, rank: Column, surface: Column) -> Column:
    """What the case_ids of a record's labels begin with."""
    return _named(provider, query, retrieval, F.concat(F.lit("r"), F.coalesce(rank.cast("string"), F.lit("None"))), surface)


def stem_label(stem: Column, label: Column) -> Column:
    """The case_id of a stem's label."""
    return F.concat(stem, F.lit("__"), _named(label))


def case_id(provider: Column, query: Column, retrieval: Column, rank: Column, surface: Column, label: Column) -> Column:
    return stem_label(case_stem(provider, query, retrieval, rank, surface), label)


def agent_decision(tools: Column) -> Column:
    """What an iteration did, by the names of the tools that it called."""
    names = F.array_distinct(F.coalesce(tools, F.array().cast("array<string>")))
    only = lambda n: (F.size(names) == 1) & F.coalesce(F.get(names, F.lit(0)) == n, F.lit(False))
    return F.when(F.size(names) == 0, "answer").when(only("search_web"), "search").when(only("fetch_page"), "fetch").otherwise("tool")


def excerpt_around(content: Column, spans: Column, limit: int) -> Column:
    """text, truncated, start, end: limit characters around the first span that the content holds."""
    c = F.coalesce(content, F.lit(""))
    found = F.filter(F.coalesce(spans, F.array().cast("array<string>")), lambda s: (s != "") & F.contains(c, s))
    span = F.get(found, F.lit(0))
    n, at = F.length(c), F.position(span, c) - 1
    first = F.greatest(F.lit(0), at - F.greatest(F.lit(0), F.floor((F.lit(limit) - F.length(span)) / 2).cast("int")))
    end = F.when(span.isNull(), F.least(n, F.lit(limit))).otherwise(F.least(n, first + limit))
    start = F.when(span.isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), end - limit))
    return F.struct(F.substr(c, start + 1, end - start).alias("text"), (n > end - start).alias("truncated"), start.alias("start"), end.alias("end"))


def throttled(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    out = F.lit(False)
    for x in THROTTLED:
        out = out | F.contains(low, F.lit(x))
    return out


def tag_text(text: Column, tag: str) -> Column:
    """What the first such tag holds, blanks stripped; '' without one."""
    return strip(F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1))


def tag_list(text: Column, tag: str) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"), 1), strip)


def human_bool(value: Column) -> Column:
    return F.when(value == "true", True).when(value == "false", False)


def agreement(human: Column, machine: Column) -> Column:
    """Whether a clear human label equals the machine's; null where there is none."""
    return human_bool(human) == machine


def rate(part: Column, whole: Column) -> Column:
    """part / whole; null for an empty whole."""
    return F.when(whole != 0, part / whole)


def per_cent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.when(whole == 0, 0.0).otherwise(F.bround(100.0 * part / whole, digits))


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of a share in per cent, rounded; (0, 0) without trials."""
    p, d = successes / n, 1 + z * z / n
    middle, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    bound = lambda x: F.when(n == 0, 0).otherwise(F.bround(100 * x / d)).cast("long")
    return bound(middle - half), bound(middle + half)


def endpoint(url: Column) -> Column:
    """A service's scheme and host; without both, the text less its closing slashes."""
    u = strip(F.coalesce(url, F.lit("")))
    scheme, host = F.lower(_part(u, 1)), _part(u, 3)
    return F.when((scheme != "") & (host != ""), F.concat(scheme, F.lit("://"), host)).otherwise(F.regexp_replace(u, "/+$", ""))


def bool_or_mode(value: Column) -> Column:
    """'true' or 'false' for a setting that says yes or no, else the setting."""
    low = F.lower(strip(value))
    return F.when(low.isin("1", "true", "yes"), "true").when(low.isin("0", "false", "no", ""), "false").otherwise(value)


def seconds_shown(seconds: Column) -> Column:
    """1h02m03s, 2m03s or 3s."""
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(h > 0, F.concat(h.cast("string"), F.lit("h"), two(m), F.lit("m"), two(r), F.lit("s"))).when(m > 0, F.concat(m.cast("string"), F.lit("m"), two(r), F.lit("s"))).otherwise(F.concat(r.cast("string"), F.lit("s")))

"""Divergence of sources against plain loops over all kept terms."""

import random
import re
from collections import Counter, defaultdict

from tickwarden.llm import divergence as d

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, counts string, terms int, all_terms int, idx int, p double, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 1, "x", 1, 2, 3, 0.5, 4) for i, (lang, source, t) in enumerate(rows)], SCHEMA)


def expected(rows, min_df, top):
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        groups.add((lang, source))
        df[lang].update(set(words))
        counts[lang, source].update(words)
        counts[lang].update(words)
    kept = {lang: sorted(w for w, n in c.items() if n >= min_df) for lang, c in df.items()}

    def shares(key, lang):
        total = sum(counts[key][w] for w in kept[lang])
        return {w: 1 + 10**9 * (counts[key][w] + 2) // (total + 2 * len(kept[lang])) for w in kept[lang]}

    out = []
    for lang, source in groups:
        p, q = shares((lang, source), lang), shares(lang, lang)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        pairs = []
        for other_lang, other in groups:
            if other_lang == lang and other != source:
                o = shares((lang, other), lang)
                pairs.append((-sum(f(p[w], o[w]) for w in kept[lang]), other.encode()))
        terms = [(-f(p[w], q[w]), w.encode()) for w in kept[lang] if counts[lang, source][w] and p[w] > q[w]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(lang, source, part, item.decode(), -v, r) for r, (v, item) in enumerate(found, 1)]
    return sorted(out)


def got(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def test_against_loops(spark):
    rng = random.Random(1)
    words = ["Été", "straße", "ÄB", "äb", "x\u0085y", "日本", "a_b", "C3PO", "\U0001f600", *(f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6))]
    rows = [(rng.choice(["en", "de", "en", None, "fr\x00x"]), rng.choice(["a", "b", "c", None, "é"]), " ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randrange(60)))) for _ in range(120)]
    rows += [("en", "quiet", ""), ("en", "void", None), ("xx", "one", "only once"), ("xx", "two", None), rows[0], rows[0]]
    for min_df, top in ((10, 10), (1, 3), (40, 2)):
        assert got(d.divergence(frame(spark, rows), min_df, top)) == expected(rows, min_df, top)


def test_no_kept_terms_and_no_rows(spark):
    rows = [("en", "a", "one two"), ("en", "b", "three"), ("de", "a", None)]
    assert got(d.divergence(frame(spark, rows))) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert got(d.divergence(frame(spark, []))) == []


def test_a_very_long_text_and_large_counts(spark):
    rows = [("en", "a", "yes no " * 700_000)] + [("en", s, "yes no maybe") for s in "abbbbbbbbbbbb"]
    assert got(d.divergence(frame(spark, rows))) == expected(rows, 10, 10)


def test_vectors_hold_all_occurrences(spark):
    lists = d.document_terms(frame(spark, [("en", "a", "to be or not to be"), ("en", "b", "be")]))
    model = d.fitted(lists, 1)
    sums = sorted(sum(r["counts"].values) for r in d.document_vectors(lists, model).collect())
    assert sums == [1.0, 6.0]
    assert {(r["term"], r["lang"]) for r in d.vocabulary(model, spark).collect()} == {(w, "en") for w in ("to", "be", "or", "not")}

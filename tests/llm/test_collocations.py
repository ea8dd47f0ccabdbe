"""Collocations against brute force over all phrases, and the parse against the texts it comes from."""

import random
import re
from collections import Counter

import pytest

from episodica.llm import collocations


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def truth(rows, least, top=2000):
    """rows of (lang, text); lang, rank, phrase, a, l, r, n, score."""
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower(text)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for size in range(1, 5):
                counts.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    frequent = {k: f for k, f in counts.items() if f >= least}
    scored = {}
    for (lang, w), a in frequent.items():
        longer = [f for (o, v), f in frequent.items() if o == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if len(w) < 2 or any(100 * f >= 80 * a for f in longer):
            continue
        cuts = []
        for k in range(1, len(w)):
            l, r = counts[lang, w[:k]], counts[lang, w[k:]]
            cuts.append((2_000_000 * a // (l + r), k, l, r))
        score, _, l, r = min(cuts)
        scored.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted(
        (lang, i + 1, phrase.decode(), -a, l, r, totals[lang], -score)
        for lang, found in scored.items()
        for i, (score, a, phrase, l, r) in enumerate(sorted(found)[:top])
    )


@pytest.fixture(scope="module")
def table(spark):
    def make(rows):
        schema = "doc_id long, lang string, text string, chunk string, freq long, phrase string, own int"
        return spark.createDataFrame([(i, lang, text, "c", 7, "p", 1) for i, (lang, text) in enumerate(rows)], schema)

    return make


def found(frame, **options):
    return sorted(tuple(r) for r in collocations.collocations(frame, **options).collect())


def drawn(seed, n=150):
    draw = random.Random(seed)
    words = ["of", "the", "New", "York", "city", "état", "ÉTAT", "a", "x y", "😀", "in", "-"]
    rows = []
    for _ in range(n):
        text = "".join(draw.choice(words) + draw.choice([" ", " ", " ", "  ", "\t", " ", ", ", ".", "\n"]) for _ in range(draw.randint(0, 60)))
        rows.append((draw.choice(["en", "en", "en", "fr", None]), text))
    return rows + rows[:40] + [("en", "new york city of the x " * 40), ("fr", "in in in in " * 50)]


@pytest.mark.parametrize("period", [1, 3, 32])
def test_equal_to_brute_force_for_every_period_of_the_parse(table, period):
    rows = drawn(period)
    assert found(table(rows), least=20, period=period) == truth(rows, 20)


def test_top_phrases_only(table):
    rows = drawn(9)
    assert found(table(rows), least=12, top=7) == truth(rows, 12, top=7)


def test_many_units_per_task_give_the_same(table, monkeypatch):
    monkeypatch.setattr(collocations, "UNIT_BYTES", 500)
    rows = drawn(5)
    assert found(table(rows).coalesce(1), least=15) == truth(rows, 15)


def test_nulls_empty_and_very_long_texts(table):
    long = " ".join(f"w{i % 97} and so" for i in range(30_000))
    rows = [("en", None), (None, None), ("en", ""), ("en", " \t . ! "), ("en", long), (None, "so it goes " * 40)]
    assert found(table(rows)) == truth(rows, 30)
    assert found(table([])) == []
    assert found(table([("en", "too few words")])) == []


def test_words_that_a_weak_hash_takes_for_one_are_counted_apart(table):
    a = "a"
    while len(a) < 2048:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [("en", f"{a} x"), ("en", f"{b} y")] * 30
    assert found(table(rows)) == truth(rows, 30)


def test_scores_are_exact_beyond_64_bits(spark):
    column = collocations._wide(collocations.F.lit(9_000_000_000_000_000_000))
    product = collocations.F.call_function("div", 2_000_000 * column, column + column)
    assert spark.range(1).select(product.alias("x")).first()["x"] == 1_000_000


def test_chunks_overlap_by_one_trigger_and_own_every_word_once(table):
    rows = drawn(2)
    parsed = collocations.dictionary(table(rows), period=2).collect()
    words = Counter()
    for r in parsed:
        w = r.chunk.split(" ")
        assert r.own == len(w) or r.own == len(w) - collocations.OVERLAP
        for x in w[: r.own]:
            words[r.lang, x] += r.freq
    want = Counter()
    for lang, text in rows:
        want.update(("und" if lang is None else lang, w) for piece in re.split("[.,;:!?\n-\r]", lower(text)) for w in re.findall("[^ \t]+", piece))
    assert words == want

"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from episodica.llm import spelling


def truth_words(rows, least, every):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                counts[run] += 1
    return counts


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def truth_groups(counts, ratio=2):
    forms, n_near = {}, {}
    for w, n in counts.items():
        close = [(-m, v) for v, m in counts.items() if near(w, v)]
        n_near[w] = len(close)
        best = min(close, default=(0, None))
        forms[w] = best[1] if -best[0] >= ratio * n else None
    out = []
    for w, n in counts.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, n, n_near[w], counts[forms[w]] if forms[w] else None))
    return sorted(out, key=str)


def groups(spark, counts, **options):
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    return sorted((tuple(r) for r in spelling.variant_groups(frame, **options).collect()), key=str)


@pytest.mark.parametrize("seed,letters,longest", [(1, "ab", 7), (2, "abcé", 8), (3, "aö÷", 5), (4, "ab", 3)])
def test_groups_equal_brute_force(spark, seed, letters, longest):
    draw = random.Random(seed)
    words = {"".join(draw.choices(letters, k=draw.randint(1, longest))): draw.choice([1, 2, 3, 4, 9, 80]) for _ in range(250)}
    assert groups(spark, words) == truth_groups(words)


def test_edits_of_long_words(spark):
    draw = random.Random(8)
    words = {}
    for _ in range(40):
        w = "".join(draw.choices("abcdefghij", k=draw.randint(5, 30)))
        words[w] = draw.randint(50, 99)
        for _ in range(6):
            i = draw.randrange(len(w))
            words[draw.choice([w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "ß" + w[i + 1 :], w + "z", "q" + w])] = draw.randint(1, 60)
    assert groups(spark, words) == truth_groups(words)


def test_chains_follow_to_the_last_form(spark):
    words = {"a" * k: 3 ** (k - 4) for k in range(5, 25)}
    found = groups(spark, words)
    assert {r[2] for r in found} == {"a" * 24}
    assert found == truth_groups(words)


def test_words_of_documents(make_docs, odd_rows):
    draw = random.Random(3)
    texts = ["Größe ÉTÉ été", "×÷ Ünïcode x1y_z", "naïve", "Straße don't"]
    rows = odd_rows + [(i, " ".join(draw.choices(texts, k=30))) for i in range(40)]
    for least, every in ((1, None), (3, 2), (5, 3)):
        found = spelling.counted_words(make_docs(rows), least, every).collect()
        assert {r.word: r.n for r in found} == truth_words(rows, least, every)


def test_words_are_sent_in_parts_without_loss(make_docs, monkeypatch, odd_rows):
    monkeypatch.setattr(spelling, "HELD_WORDS", 3)
    found = spelling.counted_words(make_docs(odd_rows), 1, 5).collect()
    assert {r.word: r.n for r in found} == truth_words(odd_rows, 1, 5)


def test_empty_tables_and_null_words(spark, make_docs):
    assert spelling.counted_words(make_docs([])).collect() == []
    assert groups(spark, {}) == []
    frame = spark.createDataFrame([(None, 3), ("apple", 3)], "word string, n long")
    assert [tuple(r) for r in spelling.variant_groups(frame).collect()] == [("apple", None, "apple", 3, 0, None)]
    with pytest.raises(ValueError):
        spelling.variant_groups(frame, ratio=1)


def test_no_join_is_broadcast(spark, monkeypatch):
    """Few bytes of words become many signatures: Spark's guess of their size must not decide."""
    written, plans = spelling.durable, []

    def ran(frame):
        frame.collect()
        plans.append(frame._jdf.queryExecution().executedPlan().toString())

    def durable(frame, name):
        ran(frame)
        return written(frame, name)

    monkeypatch.setattr(spelling, "durable", durable)
    words = [(f"{a}pple{b}", n) for n, a in ((9, "a"), (2, "o")) for b in ("", "s", "sy")]
    ran(spelling.variant_groups(spark.createDataFrame(words, "word string, n long")))
    assert [p for p in plans if "Broadcast" in p] == []
    assert sum("SortMergeJoin" in p for p in plans) >= 4

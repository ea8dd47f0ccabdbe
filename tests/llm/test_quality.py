import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from episodica.llm import perplexity as px

WORD = re.compile("[^\x20\x09-\x0d]+")


def counts_truth(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, again, len(covered)


def corpus():
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 6))) for _ in range(60)]
    rows = []
    for i in range(60):
        lines = [" ".join(draw.choices(words, k=draw.randint(0, 12))) for _ in range(draw.randint(1, 9))]
        if i % 5 == 0:
            lines = lines + lines
        if i % 7 == 0:
            lines.append("## *|* <é> " + "\t" * 3)
        rows.append((i, "\n".join(lines)))
    return rows


def test_counts(make_docs, odd_rows):
    rows = [*corpus(), *((None if i is None else i + 100, t) for i, t in odd_rows)]
    got = px.quality(make_docs(rows)).collect()
    show = lambda i, t: (str(i), *counts_truth(t))
    assert sorted((str(r.doc_id), *(r[c] for c in px.COUNTS)) for r in got) == sorted(show(i, t) for i, t in rows)
    for r in got:
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)


def test_lines_and_words_of_one_weak_hash_are_told_apart(make_docs):
    """The Thue-Morse word and its complement agree under every polynomial hash modulo 2**64."""
    rows = []
    for i, size in enumerate((1024, 2048, 4096)):
        a = "a"
        while len(a) < size:
            a += a.translate(str.maketrans("ab", "ba"))
        b = a.translate(str.maketrans("ab", "ba"))
        rows += [(10 * i, f"{a}\n{b}\nx\n{a}"), (10 * i + 1, " ".join([a] * 8 + [b] + [a] * 7)), (10 * i + 2, " ".join([a, b] * 30))]
    got = px.quality(make_docs(rows)).collect()
    assert sorted((r.doc_id, *(r[c] for c in px.COUNTS)) for r in got) == sorted((i, *counts_truth(t)) for i, t in rows)


def model_truth(texts, order):
    """Interpolated modified Kneser-Ney over the bytes of the texts: probabilities and back-off weights per order."""
    levels = {order: Counter()}
    for text in texts:
        data = text.encode()
        levels[order].update(data[i : i + order] for i in range(len(data) - order + 1))
    for m in range(order - 1, 0, -1):
        levels[m] = Counter(g[1:] for g in levels[m + 1])
    probabilities, weights = {(): 1 / 256}, {}
    lower = {b"": 1 / 256}
    for m in range(1, order + 1):
        n = Counter(levels[m].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        discount = {}
        for k in (1, 2, 3):
            d = k - (k + 1) * y * n[k + 1] / n[k] if y is not None and n[k] else None
            discount[k] = d if d is not None and 0.05 <= d <= k else k / 2
        total, left = defaultdict(float), defaultdict(float)
        for g, c in levels[m].items():
            total[g[:-1]] += c
            left[g[:-1]] += discount[min(c, 3)]
        own = {}
        for g, c in levels[m].items():
            h = g[:-1]
            own[g] = (c - discount[min(c, 3)]) / total[h] + left[h] / total[h] * lower[g[1:]]
        weights |= {h: left[h] / total[h] for h in total}
        probabilities |= own
        lower = own
    return probabilities, weights


@pytest.fixture(scope="module")
def model(make_docs):
    docs = make_docs(corpus())
    return px.kneser_ney(px.gram_counts(docs, 3).cache(), 3)


def test_model_is_kneser_ney(model):
    probabilities, weights = model_truth([t for _, t in corpus()], 3)
    for r in model.collect():
        gram = int(r.gram).to_bytes(abs(r.kind)) if r.kind else b""
        want = probabilities[gram] if r.kind > 0 else weights[gram]
        assert r.value == pytest.approx(math.log(want) * px.UNIT, abs=2)


def test_backing_off(model):
    probabilities, weights = model_truth([t for _, t in corpus()], 3)

    def truth(gram):
        if gram in probabilities:
            return math.log(probabilities[gram])
        if not gram:
            return math.log(1 / 256)
        return math.log(weights.get(gram[:-1], 1)) + truth(gram[1:])

    import numpy as np

    held = px._models(model, 3, 10**6)[0].value
    grams = [b"abc", b"zzz", b"ab\xff", b"\xffab", b"#* ", b"qa "]
    codes = np.asarray([int.from_bytes(g) for g in grams], dtype=np.uint64)
    assert held.scores(0, codes).tolist() == pytest.approx([truth(g) * px.UNIT for g in grams], abs=6)


def test_grouping_of_languages_changes_nothing(make_docs):
    rows = corpus()
    docs = make_docs(rows[:30], "en").unionByName(make_docs(rows[30:45], "fr")).unionByName(make_docs(rows[45:], None))
    one = sorted(map(str, px.quality(docs).collect()))
    assert one == sorted(map(str, px.quality(docs, model_rows=1).collect()))


def test_noise_goes_and_clean_text_stays(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("text is not null").limit(200)
    draw = random.Random(1)
    noise = [(10_000 + i, "".join(draw.choice("qwzxj#%~^0123456789 ") for _ in range(600))) for i in range(3)]
    odd = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in noise], docs.schema)
    got = {r.doc_id: r.kept for r in px.quality(docs.unionByName(odd)).filter(~F.col("base_failed")).collect()}
    assert not any(got.get(i, False) for i, _ in noise)
    assert sum(v for k, v in got.items() if k < 10_000) > 0.8 * sum(k < 10_000 for k in got)


def test_empty_table(make_docs):
    assert px.quality(make_docs([])).count() == 0
    assert px.accepted(make_docs([(None, None), (1, ""), (1, "")])).count() == 0

"""Both substring operators against brute force over all windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from episodica.llm import arrays, repeats, substring_dedup, suffix_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")


def word_truth(rows, width):
    first = {}
    for i, text in rows:
        words = WORD.findall(text or "")
        for a in range(len(words) - width + 1):
            if i is not None:
                key = tuple(words[a : a + width])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        words = WORD.findall(text or "")
        gone = set()
        for a in range(len(words) - width + 1):
            if i is not None and first[tuple(words[a : a + width])] < i:
                gone.update(range(a, a + width))
        left = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return out


def byte_truth(rows, width):
    seen = {}
    for _, text in rows:
        data = (text or "").encode()
        for a in range(len(data) - width + 1):
            seen[data[a : a + width]] = seen.get(data[a : a + width], 0) + 1
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, dtype=bool)
        for a in range(len(data) - width + 1):
            if seen[data[a : a + width]] > 1:
                gone[a : a + width] = True
        left = bytes(b for b, g in zip(data, gone, strict=False) if not g)
        spans = int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if data else 0
        out.append((i, len(data), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


def corpus(seed, letters=4, size=60):
    """Texts from few words, so that windows repeat in and between texts, with shared passages and one self-repeat."""
    draw = random.Random(seed)
    passage = " ".join(draw.choice("abcdefgh") * draw.randint(1, 3) for _ in range(40))
    rows = []
    for i in range(size):
        words = [draw.choice("abcdefghijklmnopqrstuvw"[: 3 * letters]) * draw.randint(1, 4) for _ in range(draw.randint(0, 60))]
        text = " ".join(words)
        if i % 3 == 0:
            text = f"{text} {passage} é{draw.random()}"
        if i % 7 == 0:
            text = text + "\n" + text
        rows.append((i, text))
    return [*rows, (100, "ab" * 90), (101, "q" * 75), (102, "ab" * 20 + "c")]


def key(row):
    return tuple("" if x is None else str(x) for x in row)


@pytest.mark.parametrize("frequent", [repeats.FREQUENT, 3])
def test_words(make_docs, monkeypatch, frequent):
    monkeypatch.setattr(repeats, "FREQUENT", frequent)
    rows = corpus(1)
    found = substring_dedup.deduplicated(make_docs(rows), window=5).collect()
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found]
    assert sorted(got) == sorted(word_truth(rows, 5))
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in found)


@pytest.mark.parametrize("frequent", [repeats.FREQUENT, 3])
def test_bytes(make_docs, monkeypatch, frequent):
    monkeypatch.setattr(repeats, "FREQUENT", frequent)
    monkeypatch.setattr(suffix_dedup, "BLOCK_RUNS", 5 if frequent == 3 else 2000)
    rows = corpus(2)
    found = suffix_dedup.deduplicated(make_docs(rows), window=24).collect()
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found]
    assert sorted(got) == sorted(byte_truth(rows, 24))


def thue_morse(size):
    a = "a"
    while len(a) < size:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_hash_in_the_field_is_the_polynomial(monkeypatch):
    monkeypatch.setattr(arrays, "_BLOCK", 64)
    draw = np.random.default_rng(4)
    data = draw.integers(0, 256, 300).astype(np.uint8)
    starts = draw.integers(0, 300, 200)
    ends = np.minimum(starts + draw.integers(0, 150, 200), 300)
    want = [sum((v + 1) * pow(arrays.FIELD_BASE, i, arrays.PRIME) for i, v in enumerate(data[a:b].tolist())) % arrays.PRIME for a, b in zip(starts, ends, strict=True)]
    assert arrays.field_hash(data, starts, ends).tolist() == want


@pytest.mark.parametrize("frequent", [repeats.FREQUENT, 2])
def test_words_of_one_weak_hash_are_told_apart(make_docs, monkeypatch, frequent):
    monkeypatch.setattr(repeats, "FREQUENT", frequent)
    rows = []
    for size in (1024, 4096):
        a, b = thue_morse(size)
        rows += [(size, " ".join([a] * 13)), (size + 1, " ".join([b] * 13)), (size + 2, " ".join([a, b] * 8)), (size + 3, " ".join([a] * 14))]
    found = substring_dedup.deduplicated(make_docs(rows), keep_text=False).collect()
    assert sorted(map(key, found)) == sorted(map(key, word_truth(rows, 13)))


@pytest.mark.parametrize("frequent", [repeats.FREQUENT, 20])
def test_many_copies_and_branches_of_one_passage(make_docs, monkeypatch, frequent):
    """Copies are reduced to one run; what differs at both ends of the passage branches off and stays."""
    monkeypatch.setattr(repeats, "FREQUENT", frequent)
    passage = " ".join(f"p{i}" for i in range(30))
    draw = random.Random(6)
    rows = [(i, " ".join([f"l{draw.randrange(3)}"] * 3 + [passage] + [f"r{draw.randrange(3)}"] * 20)) for i in range(60)]
    rows += [(i, passage + " " + passage) for i in range(60, 90)]
    found = substring_dedup.deduplicated(make_docs(rows), keep_text=False).collect()
    assert sorted(map(key, found)) == sorted(map(key, word_truth(rows, 13)))


def test_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    words = substring_dedup.deduplicated(docs, keep_text=False).collect()
    assert sorted(map(key, words)) == sorted(map(key, word_truth(odd_rows, 13)))
    found = suffix_dedup.deduplicated(docs, keep_text=False).collect()
    assert sorted(map(key, found)) == sorted(map(key, byte_truth(odd_rows, 200)))


def test_empty_table(make_docs):
    assert substring_dedup.deduplicated(make_docs([])).count() == 0
    assert suffix_dedup.deduplicated(make_docs([])).count() == 0


def test_path_coordinates(make_docs):
    source = " ".join(f"s{i}" for i in range(50))
    copy = "x0 x1 " + " ".join(f"s{i}" for i in range(10, 40)) + " y"
    path = substring_dedup.repeated_paths(make_docs([(1, source), (2, copy)])).collect()
    assert [(r.doc_id, r.start, r.words, r.source_doc, r.source_start) for r in path] == [(2, 2, 30, 1, 10)]


def test_suffix_array_is_sorted():
    draw = random.Random(3)
    for _ in range(100):
        data = np.asarray([draw.randrange(draw.choice([1, 2, 26])) for _ in range(draw.randint(1, 80))], dtype=np.uint8)
        order = suffix_dedup.suffix_array(data, 200)
        text = data.tobytes()
        assert order.tolist() == sorted(range(len(data)), key=lambda i: text[i:])


def test_suffixes_are_compared_only_where_16_bytes_agree(monkeypatch):
    """Orders by two numbers first; zeros in the data and the end of the data read alike there, comparison settles them."""
    compared = []

    def counted(rows, **how):
        compared.append(len(rows))
        return sorted(rows, **how)

    monkeypatch.setattr(suffix_dedup, "sorted", counted, raising=False)
    draw = np.random.default_rng(4)
    data = draw.integers(0, 256, 20_000).astype(np.uint8)
    suffix_dedup.suffix_array(data, 200)
    assert sum(compared) < 200
    for case in range(100):
        data = np.tile(draw.integers(0, 3, int(draw.integers(1, 60))).astype(np.uint8), int(draw.integers(1, 4)))
        data[len(data) - int(draw.integers(0, min(20, len(data)))) :] = 0
        depth = 18 if case % 2 else 300
        order, text = suffix_dedup.suffix_array(data, depth).tolist(), data.tobytes()
        keys = [text[i : i + depth] for i in order]
        assert sorted(order) == list(range(len(data))) and keys == sorted(keys)

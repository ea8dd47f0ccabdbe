import re

import numpy as np
import pytest
import xxhash

from episodica.llm import arrays, simhash
from episodica.llm.components import components


def truth(rows, limit=4):
    prints = []
    for _, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall("[^\x20\x09-\x0d]+", lower)
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64)))
    ids = [i for i, _ in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= limit:
                    group[i] = group[j] = min(group[i], group[j])
    least = {g: min((x for x, y in zip(ids, group, strict=True) if y == g and x is not None), default=None) for g in group}
    return [(i, f"{p:016x}", least[g]) for i, p, g in zip(ids, prints, group, strict=True)]


def key(row):
    return tuple("" if x is None else str(x) for x in row)


@pytest.mark.parametrize("key_rows", [simhash.KEY_ROWS, 1])
def test_near_duplicates(make_docs, odd_rows, key_rows):
    base = [f"word{i} and{i % 5} more{i % 11}" for i in range(80)]
    near = [(20 + i, " ".join(base[:70] + [f"end{i}"])) for i in range(12)]
    rows = [*odd_rows, *near, (50, " ".join(reversed(base)))]
    got = simhash.near_duplicates(make_docs(rows), key_rows=key_rows).collect()
    assert sorted(map(key, got)) == sorted(map(key, truth(rows)))


@pytest.mark.parametrize("key_rows", [10, 1])
@pytest.mark.parametrize("limit", [2, 3])
def test_links_at_any_limit_and_size(spark, limit, key_rows):
    """Fingerprints 1 to 3 bits apart are connected by comparison and by changed words alike."""
    draw = np.random.default_rng(limit)
    prints = {int(draw.integers(-(2**62), 2**62)) for _ in range(6)}
    for fp in sorted(prints):
        for n in (1, 2, 3, 4):
            prints.add(fp ^ sum(1 << int(b) for b in draw.choice(62, n, replace=False)))
    prints = sorted(prints)
    nodes = spark.createDataFrame(list(enumerate(prints)), "node long, fp long")

    def groups(pairs):
        own = list(range(len(prints)))
        for _ in own:
            for a, b in pairs:
                own[a] = own[b] = min(own[a], own[b])
        return own

    near = [(a, b) for b in range(len(prints)) for a in range(b) if ((prints[a] ^ prints[b]) % 2**64).bit_count() <= limit]
    assert near
    found = [(r.a, r.b) for r in simhash.links(nodes, limit, key_rows).collect()]
    assert groups(found) == groups(near)


def test_columns_of_any_name_stay(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(2, "a b c d e", 7, True), (1, "a b c d e", 8, False)], "doc_id long, text string, _id long, possible boolean")
    kept = simhash.representatives(docs.withColumn("_text", F.lit("mine")))
    assert kept.columns == [*docs.columns, "_text"]
    assert [tuple(r) for r in kept.collect()] == [(1, "a b c d e", 8, False, "mine")]


def test_no_rows(make_docs):
    assert simhash.near_duplicates(make_docs([])).count() == 0


def test_representatives(make_docs):
    docs = make_docs([(3, "A b c d e"), (1, "a b c d e"), (2, "quite another text here"), (None, "a b c d e")])
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "None"]


def test_pivots_lose_no_link():
    draw = np.random.default_rng(1)
    fps = draw.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.concatenate([fps, fps ^ np.uint64(0b1011), fps ^ (np.uint64(31) << np.uint64(20))])
    keys = np.sort(draw.integers(0, 3, len(fps)))
    i, j = simhash.pivot_links(keys, fps, 4)
    parent = np.arange(len(fps))
    want = np.arange(len(fps))
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        parent[parent == max(parent[a], parent[b])] = min(parent[a], parent[b])
    for a in range(len(fps)):
        for b in range(a):
            if keys[a] == keys[b] and int(fps[a] ^ fps[b]).bit_count() <= 4:
                want[want == max(want[a], want[b])] = min(want[a], want[b])
    assert parent.tolist() == want.tolist()


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 100), (95, 90), (200, 200), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}


def test_null_texts_are_pieces():
    import pyarrow as pa

    assert [p.count for p in arrays.pieces(pa.array([None, "a", ""], pa.string()))] == [3]
    assert list(arrays.pieces(pa.array([], pa.string()))) == []

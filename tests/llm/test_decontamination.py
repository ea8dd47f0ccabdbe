import random

import numpy as np
import pytest

from episodica.llm import decontamination as dc


@pytest.fixture(scope="module")
def items(spark):
    draw = random.Random(2)
    rows = [(i, " ".join("".join(draw.choice("aeioulnrst") for _ in range(6)) for _ in range(n))) for i, n in enumerate((30, 40, 12, 9))]
    return rows, spark.createDataFrame([*rows, (9, None), (None, ""), (8, "two words"), *rows[:1]], "item_id long, text string")


def filler(seed, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("bcdfgh") for _ in range(5)) for _ in range(n))


def edited(text, every):
    return " ".join("other" if i % every == every - 1 else w for i, w in enumerate(text.split()))


def table_score(a, b):
    best, rows = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            same = 1 if a[i - 1] == b[j - 1] else -1
            rows[i][j] = max(0, rows[i - 1][j - 1] + same, rows[i - 1][j] - 1, rows[i][j - 1] - 1)
            best = max(best, rows[i][j])
    return best


def test_alignment():
    draw = random.Random(3)
    for _ in range(60):
        a = [draw.randrange(4) for _ in range(draw.randint(0, 25))]
        b = [draw.randrange(4) for _ in range(draw.randint(0, 15))]
        assert dc.smith_waterman(np.asarray(a, dtype=np.uint64), np.asarray(b, dtype=np.uint64)) == table_score(a, b)


def test_copies(make_docs, items):
    rows, benchmark = items
    docs = [
        (1, f"{filler(1, 50)} {rows[0][1]} {filler(2, 20)}"),
        (2, rows[1][1].upper().replace(" ", ", ")),
        (3, f"{filler(3, 10)} {edited(rows[1][1], 6)} {filler(4, 10)}"),
        (4, filler(5, 200)),
        (5, f"{filler(6, 30)} {' '.join(rows[0][1].split()[:12])} {filler(7, 30)}"),
        (6, f"{rows[2][1]} {filler(8, 100)} {rows[3][1]}"),
        (6, f"{rows[2][1]} {filler(8, 100)} {rows[3][1]}"),
        (7, None),
        (None, rows[3][1]),
        (8, edited(rows[1][1], 3)),
        (9, "two words"),
    ]
    found = dc.contaminated(make_docs(docs), benchmark).collect()
    pairs = sorted((str(r.doc_id), r.item_id) for r in found)
    assert pairs == sorted([("1", 0), ("2", 1), ("3", 1), ("6", 2), ("6", 3), ("None", 3)])
    by = {(r.doc_id, r.item_id): r for r in found}
    assert by[1, 0].similarity == 1 and by[2, 1].similarity == 1
    assert by[3, 1].similarity == pytest.approx(1 - 6 / 40)
    left = dc.clean(make_docs(docs), benchmark).collect()
    assert sorted(str(r.doc_id) for r in left) == ["4", "5", "7", "8", "9"]


def test_edits_at_the_limit_are_found(make_docs, items):
    """A fifth of the words replaced, in the worst places for the seeds."""
    rows, benchmark = items
    docs = make_docs([(1, f"{filler(9, 40)} {edited(rows[1][1], 5)} {filler(10, 40)}")])
    assert [r.item_id for r in dc.contaminated(docs, benchmark).collect()] == [1]


def test_empty_tables(make_docs, items, spark):
    _, benchmark = items
    assert dc.contaminated(make_docs([]), benchmark).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.contaminated(make_docs([(1, "a b c d e f")]), none).count() == 0
    assert dc.clean(make_docs([(1, "a b c d e f")]), none).count() == 1


def test_columns_of_any_name_stay(spark, items):
    rows, benchmark = items
    docs = spark.createDataFrame([(1, rows[0][1], 7, "t", True), (2, "free", 8, "u", False)], "doc_id long, text string, _id long, _text string, possible boolean")
    assert [tuple(r) for r in dc.clean(docs, benchmark).collect()] == [(2, "free", 8, "u", False)]


def test_random_edits_against_alignment_of_all_pairs(make_docs, spark):
    """Replaced, left out and added words, items of 4 to 200 words: the pairs over the limit, and no others."""
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("aeiourst") for _ in range(draw.randint(1, 3)))
    items = [(i, [word() for _ in range(draw.choice((4, 5, 6, 7, 10, 11, 15, 30, 60, 100, 200)))]) for i in range(60)]
    docs = []
    for d in range(300):
        _, source = items[d % 60]
        copy, share = [], draw.choice((0.05, 0.15, 0.25, 0.33))
        for w in source:
            edit = draw.choice("rdia") if draw.random() < share else ""
            copy += {"r": [word()], "d": [], "i": [w, word()], "a": [word(), w]}.get(edit, [w])
        docs.append((d, [word() for _ in range(draw.randint(0, 40))] + copy + [word() for _ in range(draw.randint(0, 40))]))
    source = [f"w{i}" for i in range(100)]
    items += [(60, source), (61, [f"v{i}" for i in range(15)])]
    docs.append((300, [x for i, w in enumerate(source) for x in ([w, "new"] if i % 3 == 1 else [w])]))
    docs.append((301, [w if i % 4 != 3 else "new" for i, (_, w) in enumerate(zip(range(15), items[61][1]))]))
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in dc.contaminated(make_docs([(d, " ".join(w)) for d, w in docs]), benchmark).collect()}
    number: dict[str, int] = {}
    coded = lambda words: np.array([number.setdefault(w, len(number)) for w in words])
    coded_items = [(i, coded(w)) for i, w in items]
    want = {}
    for d, words in docs:
        at = coded(words)
        for i, item in coded_items:
            if (score := dc.smith_waterman(at, item)) * 10 >= 6 * len(item):
                want[d, i] = score
    assert got == want
    assert (300, 60) in want and (301, 61) in want and 150 < len(want) < 3000

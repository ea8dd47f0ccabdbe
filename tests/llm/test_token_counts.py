"""Token counts in overlapping chunks against one call of the library for the whole text."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from episodica.llm import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["the", "ereing", "ÀÉ", "é", "İ", "ﬁne", "中文字", "。", "かな", "가나", "it's", "I'll", "'s", "1999", "٣", "<|endoftext|>", "<|startoftext|>"]
PARTS += ["<|endof", "text|>", "...", "!?", "--", "'", "😀", "̈", "a" * 40, "Zs.", "K", " ", "　", "x" * 9 + "."]


WHOLE = Tokenizer.from_file(PATH)


def truth(text):
    return len(WHOLE.encode(text or "", add_special_tokens=False))


def counts(frame, **options):
    rows = token_counts.counted(frame, PATH, **options).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows), key=str)


def expected(rows):
    return sorted(((i, len((t or "").encode()), truth(t), truth(t) > 2048) for i, t in rows), key=str)


@pytest.mark.parametrize("chunk,overlap", [(40, 10), (7, 7), (120, 3)])
def test_chunks_are_spliced_to_the_count_of_the_whole_text(make_docs, chunk, overlap):
    draw = random.Random(chunk)
    rows = []
    for i in range(120):
        joint = draw.choice(["", " ", " ", "\n", "\t ", "."])
        rows.append((i, joint.join(draw.choices(PARTS, k=draw.randint(0, 60)))))
    assert counts(make_docs(rows), chunk=chunk, overlap=overlap) == expected(rows)


def test_texts_without_a_stable_position_become_one_chunk(make_docs):
    rows = [(1, "ab" * 300), (2, "ab" * 100 + " " + "cd" * 100), (3, " " * 500), (4, "。" * 200), (5, "<|endoftext|>" * 30)]
    rows.append((6, "x y " + "é" * 200 + " z 1 2 " + "w" * 130 + ". end"))
    assert counts(make_docs(rows), chunk=16, overlap=8) == expected(rows)


def test_nulls_empty_texts_repeated_rows_and_long_texts(make_docs, odd_rows):
    assert counts(make_docs(odd_rows)) == expected(odd_rows)
    assert counts(make_docs([])) == []


def test_an_empty_overlap_is_refused(make_docs):
    with pytest.raises(ValueError):
        token_counts.counted(make_docs([(1, "a")]), PATH, overlap=0)


def test_the_limit_is_a_parameter(make_docs):
    assert [r.over_limit for r in token_counts.counted(make_docs([(1, "a b c")]), PATH, limit=2).collect()] == [True]

"""Groups of spelling variants: words one edit apart, found by asymmetric q-chunks.

One word of a pair is cut into two disjoint chunks; one edit spoils at most one of them. The other word contributes its
positional grams of the chunk's length. A chunk that is preserved lies at its own position (the edit is behind it) or is
moved by the difference of the lengths (the edit is before it), so that only grams within shift one are needed and the
join is an equality of (length of the cut word, chunk, gram). Every pair that meets is verified by its edit distance.

Equal chunks alone would bring all words of a frequent beginning or end together. What is left of both words beside the
preserved chunk is again at most one edit apart, so it is cut by the same rule: two of three parts of a word must agree
before a pair is formed, and the groups get smaller by the alphabet once more.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.session import durable

#: Words that a task counts before it sends them.
HELD_WORDS = 500_000

#: Letters are A-Z, a-z and U+00C0 to U+00FF (in UTF-8 the byte C3 with 80 to BF); A-Z are lower-cased.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def _shortened(run: bytes, digest: int) -> bytes:
    text = run.decode("utf-8")
    at = digest % len(text)
    return (text[:at] + text[at + 1 :]).encode("utf-8")


def counted_words(docs: DataFrame, least_chars: int = 1, slip_every: int | None = None) -> DataFrame:
    """(word, n): lower-cased letter runs of at least least_chars code points, and how often they occur.

    With slip_every, a run whose crc32 of `<doc_id>:<run>` is divisible by it loses the code point at crc32 % length, as if
    mistyped all over that document; least_chars holds for what is left. Null texts have no words, a null doc_id is written
    as nothing. Counts are added up per task before the shuffle. Empty table: no rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def sent() -> pa.RecordBatch:
            words, counts = pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())
            held.clear()
            return pa.RecordBatch.from_arrays([words, counts], names=["word", "n"])

        def add(run: bytes, n: int) -> None:
            if len(run) >= 2 * least_chars or len(run.decode("utf-8")) >= least_chars:
                held[run] += n

        for batch in batches:
            ids = batch.column("doc_id")
            for i, text in enumerate(batch.column("text")):
                raw = text.as_buffer()
                if raw is None:
                    continue
                runs = Counter(RUN.findall(raw.to_pybytes().translate(LOWER)))
                start = zlib.crc32(f"{'' if ids[i].as_py() is None else ids[i].as_py()}:".encode())
                for run, n in runs.items():
                    if len(run) < least_chars:
                        continue
                    if slip_every is not None:
                        digest = zlib.crc32(run, start)
                        if digest % slip_every == 0:
                            run = _shortened(run, digest)
                    add(run, n)
                if len(held) > HELD_WORDS:
                    yield sent()
        if held:
            yield sent()

    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _parts(start: Column, size: Column) -> list[tuple[Column, Column]]:
    """The two disjoint chunks of a stretch, as (start, size)."""
    half = F.floor(size / 2).cast("int")
    return [(start, half), (start + half, size - half)]


def _signatures(length: Column) -> list[tuple[int, list[tuple[Column, Column]]]]:
    """The chunk choices for a word of `length`: one half, and one chunk of the other half, as positions in the word."""
    zero = F.lit(0)
    halves = _parts(zero, length)
    found = []
    for kept in (0, 1):
        rest = _parts(*halves[1 - kept])
        for second in (0, 1):
            found.append((2 * kept + second, [halves[kept], rest[second]]))
    return found


def _rows(words: DataFrame, shifts: list[int]) -> DataFrame:
    """(word, n, cut, kind, first, second): signatures of a cut word (shift 0), or grams of a word one longer than it."""
    cut = F.char_length("word") - (len(shifts) - 1)
    made = []
    for kind, ((a, size_a), (b, size_b)) in _signatures(cut):
        for s in shifts:
            for t in shifts:
                first = F.col("word").substr(a + s + 1, size_a)
                made.append(F.struct(F.lit(kind).alias("kind"), first.alias("first"), F.col("word").substr(b + t + 1, size_b).alias("second")))
    return words.filter(cut >= 1).select("word", "n", cut.alias("cut"), F.explode(F.array(*made)).alias("key")).select("word", "n", "cut", "key.*").distinct()


def _merged(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Sort-merge join, never a broadcast, at any estimate of the sides.

    Spark sizes exploded rows like the rows before explode, and stored words by their compressed bytes, so a side that fills
    the driver would pass for small. The sizes seen at run time do not help: a plan that shuffles more is not taken then.
    """
    return left.join(right.hint("merge"), on, how)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, other, other_n), both ways round: distinct words that differ by one inserted, deleted or replaced code point.

    words has (word, n) with distinct words. Pairs of one length are formed once, the smaller word being the cut one;
    otherwise the shorter word is cut. Very short words are right too: empty chunks agree with everything.
    """
    keys = ["cut", "kind", "first", "second"]
    cut = _rows(words, [0])
    other = [F.col(k) for k in keys] + [F.col("word").alias("other"), F.col("n").alias("other_n")]
    same = _merged(cut, cut.select(*other), keys).filter(F.col("word") < F.col("other"))
    longer = _merged(cut, _rows(words, [0, 1]).select(*other), keys)
    pairs = same.unionByName(longer).filter(F.levenshtein("word", "other", 1) == 1)
    pairs = durable(pairs.select("word", "n", "other", "other_n").distinct(), "pairs")
    back = pairs.select(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    return pairs.select("word", "other", "other_n").unionByName(back)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) by pointer jumping over (word, form). Counts at least double along forms, so a few rounds suffice."""
    roots = durable(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = durable(_merged(roots, onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "roots")
        roots = step.drop("next")
        if step.filter("next is not null").isEmpty():
            return roots


def variant_groups(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of words (word, n).

    form is the word's near word of largest n, ties to the smallest in code-point order, if that n is at least ratio times
    the word's own n (else null); root follows the forms to the last one and is the word itself if there is none. ratio must
    be over 1, so that forms cannot go in a circle. Words are taken as they are given: one row each, null words are left out.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1")
    words = durable(words.filter("word is not null").select("word", F.col("n").cast("long").alias("n")), "words")
    best = near_pairs(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best")
    )
    best = best.select("word", "n_near", F.col("best.other").alias("form"), (-F.col("best.less")).alias("form_n"))
    joined = _merged(words, best, "word", "left")
    strong = F.col("form_n") >= ratio * F.col("n")
    joined = durable(
        joined.select(
            "word",
            F.when(strong, F.col("form")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(strong, F.col("form_n")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(joined.filter("form is not null"))
    return _merged(joined, roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Shards, mixtures and the pipeline."""

import itertools
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from episodica.llm import mixing, sharding


def best_capacity(sizes, shards):
    low, high = max(sizes, default=0), sum(sizes)
    while low < high:
        middle, used, room = (low + high) // 2, 1, 0
        room = middle
        for s in sizes:
            if s > room:
                used, room = used + 1, middle
            room -= s
        low, high = (middle + 1, high) if used > shards else (low, middle)
    return low


@pytest.mark.parametrize("first, more", [(16, 8), (4, 2)])
def test_shards_are_minimax(make_docs, odd_rows, monkeypatch, first, more):
    monkeypatch.setattr(sharding, "FIRST_BITS", first)
    monkeypatch.setattr(sharding, "MORE_BITS", more)
    draw = random.Random(4)
    rows = [(i, "x" * draw.randint(0, 60) + str(draw.randint(0, 120))) for i in range(300)] + [(1000 + i, "copy" * 20) for i in range(80)]
    rows += [(None if i is None else 5000 + i, t) for i, t in odd_rows[:7]]
    got = sharding.sharded(make_docs(rows), 7).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    text = defaultdict(set)
    loads, slots = Counter(), defaultdict(list)
    crc = {i: zlib.crc32((t or "").encode()) for i, t in rows}
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and r.text_crc32 == crc[r.doc_id]
        text[r.text_crc32].add(r.shard)
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(loads.values()) == sum(len((t or "").encode()) + 8 for _, t in rows)
    docs = make_docs(rows).select(F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 15).alias("h"), F.octet_length(F.coalesce("text", F.lit(""))).alias("n"))
    groups = sorted((r.h, r.s) for r in docs.groupBy("h").agg(F.sum(F.col("n") + 8).alias("s")).collect())
    assert max(loads.values()) == best_capacity([s for _, s in groups], 7)


def test_few_or_no_rows(make_docs):
    assert sharding.sharded(make_docs([])).count() == 0
    assert [r.slot for r in sharding.sharded(make_docs([(1, "a")])).collect()] == [0]
    assert mixing.mixed(make_docs([])).count() == 0


def mixture(make_docs, sizes):
    ids = itertools.count()
    frames = [make_docs([(next(ids), "t") for _ in range(n)], source=s) for s, n in sizes.items()]
    docs = frames[0]
    for f in frames[1:]:
        docs = docs.unionByName(f)
    return docs


@pytest.mark.parametrize("weights", [{"a": 5, "b": 3, "c": 1, "d": 0.02}, {"a": 1, "b": 1, "c": 1, "d": 1}])
def test_share_of_every_source_is_within_one_block(spark, make_docs, weights):
    sizes = {"a": 900, "b": 700, "c": 400, "d": 37}
    docs = mixture(make_docs, sizes)
    table = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double")
    got = mixing.mixed(docs, table, block_rows=4, frame=64).collect()
    assert len(got) == sum(sizes.values())
    slot = {}
    for r in got:
        slot.setdefault(r.slot, set()).add((r.source, r.block))
    assert sorted(slot) == list(range(len(slot))) and all(len(s) == 1 for s in slot.values())
    order = [next(iter(slot[i])) for i in range(len(slot))]
    for s in sizes:
        assert [b for x, b in order if x == s] == list(range(-(-sizes[s] // 4)))
    share = {s: max(1, round(64 * w / sum(weights.values()))) for s, w in weights.items()}
    total = sum(share.values())
    frames = min(-(-n // 4) // share[s] for s, n in sizes.items())
    had = Counter()
    for t, (s, _) in enumerate(order[: frames * total]):
        had[s] += 1
        assert all(abs(had[x] - share[x] / total * (t + 1)) < 1 for x in sizes)
    per_block = Counter((r.source, r.block) for r in got)
    assert max(per_block.values()) == 4


def ideal(blocks, weights):
    """Per slot what an ideal mixture has given to every source before it, run-outs included."""
    had, out = [0.0] * len(blocks), []
    for _ in range(sum(blocks)):
        out.append(list(had))
        room = 1.0
        while room > 1e-9:
            live = [i for i, n in enumerate(blocks) if n - had[i] > 1e-9]
            if not live:
                break
            total = sum(weights[i] for i in live)
            step = min(room, *((blocks[i] - had[i]) * total / weights[i] for i in live))
            for i in live:
                had[i] += step * weights[i] / total
            room -= step
    return out


@pytest.mark.parametrize("blocks, weights", [
    ([700, 600, 400, 330], [0.335, 0.3, 0.2, 0.165]), ([900] + [1] * 100, [0.9] + [0.001] * 100),
    ([40, 3, 250, 1, 90], [5.0, 0.02, 1.0, 7.0, 0.3]), ([3, 2, 2], [0.1, 0.1, 0.1])])
def test_no_source_is_a_block_off_its_exact_weight(blocks, weights):
    slots = mixing.edf_slots(blocks, [Fraction(w) for w in weights])
    order = sorted((t, i) for i, s in enumerate(slots) for t in s)
    assert [len(s) for s in slots] == blocks and [t for t, _ in order] == list(range(sum(blocks)))
    had = [0] * len(blocks)
    for (_, i), want in zip(order, ideal(blocks, weights), strict=True):
        assert all(abs(a - b) < 1 + 1e-6 for a, b in zip(had, want, strict=True))
        had[i] += 1


def test_weights_are_not_rounded(spark, make_docs):
    """Many slots, and more sources than a frame of 256 has slots for at these weights."""
    big = make_docs([(i, "t") for i in range(2000)], source="big")
    rest = make_docs([(10_000 + i, "t") for i in range(300)]).withColumn("source", F.concat(F.lit("s"), F.col("doc_id").cast("string")))
    sources = [("big", 0.9)] + [(f"s{10_000 + i}", 0.1 / 300) for i in range(300)]
    table = spark.createDataFrame(sources, "source string, weight double")
    got = mixing.mixed(big.unionByName(rest), table, block_rows=1).collect()
    order = [s for _, s in sorted((r.slot, r.source) for r in got)]
    had = 0
    for t, s in enumerate(order[:2000]):
        assert abs(had - 0.9 * t) < 1
        had += s == "big"
    assert len(got) == 2300


def test_odd_sources(make_docs, spark):
    docs = make_docs([(1, "a"), (1, "a"), (None, "b"), (None, None)], source=None).unionByName(make_docs([(5, "c")], source="x"))
    got = mixing.mixed(docs).collect()
    assert len(got) == 5 and {r.source for r in got} == {"", "x"}
    ordered = mixing.in_mixed_order(docs)
    assert ordered.columns == docs.columns and ordered.count() == 5


def test_pipeline_runs_on_the_small_tables(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns, name
        left = [r.doc_id for r in out.select("doc_id").collect()]
        assert set(left) <= ids and len(left) == len(set(left)) and len(left) > 0.6 * len(ids), name
        ids, docs = set(left), spark.createDataFrame(out.collect(), docs.schema)
    assert {r.doc_id for r in pipeline.run(spark, sf).collect()} == ids


def test_shards_keep_the_mixed_order(spark, sf, monkeypatch):
    """With the mixing stage left out, run() gives other shards and slots."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = [r.doc_id for r in mixing.mixed(docs).orderBy("slot", "in_block").collect()]
    ids = defaultdict(list)
    for r in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect():
        ids[r.text].append(r.doc_id)
    once = {own[0] for own in ids.values() if len(own) == 1}
    stages = dict(pipeline.STAGES)

    def run(mix):
        monkeypatch.setattr(pipeline, "STAGES", [("mix_sources", mix), ("shard", stages["shard"])])
        return sorted((r.shard, r.slot, r.doc_id) for r in pipeline.run(spark, sf).collect())

    got = run(stages["mix_sources"])
    shard = {i: s for s, _, i in got}
    assert sorted(shard) == sorted(want) and all(len({shard[i] for i in own}) == 1 for own in ids.values())
    assert [i for *_, i in got if i in once] == [i for i in want if i in once]
    at = {i: t for t, i in enumerate(want)}
    for s, rows in itertools.groupby(got, key=lambda r: r[0]):
        rows = list(rows)
        assert [t for _, t, _ in rows] == list(range(len(rows))) and sorted(rows, key=lambda r: at[r[2]]) == rows, s
    groups = sorted((min(at[i] for i in own), sum(len(t.encode()) + 8 for _ in own)) for t, own in ids.items())
    loads = Counter()
    for t, own in ids.items():
        loads[shard[own[0]]] += (len(t.encode()) + 8) * len(own)
    assert max(loads.values()) == best_capacity([n for _, n in groups], sharding.SHARDS)
    assert run(lambda spark, docs, sf_dir: docs) != got


def test_pipeline_stages_take_empty_tables(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0

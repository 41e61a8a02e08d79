import re

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    """Shares by weight, sources over their cap set to it and the rest shared again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, total = {}, sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in target]
        left = total - sum(target.values())
        over = [s for s in open_ if left * w[s] > cap * sizes[s] * sum(w[t] for t in open_)]
        if not over:
            return target | {s: left * w[s] / sum(w[t] for t in open_) for s in open_}
        target |= {s: cap * sizes[s] for s in over}


@pytest.fixture
def many(documents):
    rows = [(k, "w " * (k % 13 + 1), f"s{k % 7}" if k % 3 else "hot") for k in range(900)]
    rows += [(5000 + k, "a b c", None) for k in range(20)] + [(6000, "x " * 900, "one"), (6001, None, "none"), (6002, " \t", "none")]
    return documents(rows)


def test_sizes_targets_and_what_is_taken(many):
    rows = mixing.mix_sizes(many).collect()
    text = {r["doc_id"]: r["text"] or "" for r in many.collect()}
    source = {r["doc_id"]: r["source"] for r in many.collect()}
    sizes = {}
    for d, t in text.items():
        sizes[source[d]] = sizes.get(source[d], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t))
    want = plain_targets(sizes)
    taken, largest = {}, {}
    for r in rows:
        s = source[r["doc_id"]]
        assert r["size"] == len(text[r["doc_id"]].split()) and r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] in {r["size"] * k for k in range(4)}
        taken[s], largest[s] = taken.get(s, 0) + r["taken"], max(largest.get(s, 0), r["size"])
    assert len(rows) == len(text) and sum(want.values()) == pytest.approx(sum(sizes.values()))
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1 for s in sizes)


def test_reruns_and_other_partitions_agree(many):
    assert sorted(mixing.mix_sizes(many).collect()) == sorted(mixing.mix_sizes(many.repartition(7)).collect())


def test_a_smaller_share_takes_a_subset(many):
    taken = [{r["doc_id"]: r["taken"] for r in mixing.mix_sizes(many, share=share).collect()} for share in (0.2, 0.7, 1, 2.5)]
    assert all(less[d] <= more[d] for less, more in zip(taken, taken[1:], strict=False) for d in less)
    # one source is a single text of a tenth of all words, taken whole or not
    assert [sum(t.values()) / sum(taken[2].values()) for t in taken] == pytest.approx([0.2, 0.7, 1.0, 2.5], abs=0.1)


def test_mix_keeps_columns_and_repeats_rows(many, clashing):
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix_sizes(many).where("size > 0").collect()}
    wide = many.selectExpr("*", *clashing)
    mixed = mixing.mix(wide)
    assert mixed.columns == wide.columns
    n = {r["doc_id"]: r["count"] for r in mixed.where("doc_id < 6001").groupBy("doc_id").count().collect()}
    assert n == {d: k for d, k in taken.items() if k}


def test_null_ids_repeated_rows_and_empty_tables(documents):
    rows = [(None, "a b"), (None, "c d e"), (1, "f"), (1, "f"), (2, None)]
    assert sorted(r["size"] for r in mixing.mix_sizes(documents(rows)).collect()) == [0, 1, 1, 2, 3]
    assert mixing.mix_sizes(documents([])).collect() == [] and mixing.mix(documents([])).collect() == []
    nothing = mixing.mix_sizes(documents([(1, ""), (2, None)])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in nothing] == [(0, 0.0, 0)] * 2


@pytest.mark.parametrize("ids", ["one", "none", "few"])
def test_rows_of_one_id_are_parted(documents, ids):
    """A source near its target even where all of its rows have one id or none, with texts of their own or all alike."""
    make = {"one": lambda k: 7, "none": lambda k: None, "few": lambda k: k % 3}[ids]
    rows = [(make(k), f"w{k} x y z", "a") for k in range(200)] + [(make(k), "x y z w", "b") for k in range(200)]
    rows += [(1000 + k, "a b c d e f g h i", "c") for k in range(150)]
    docs = documents(rows)
    taken = mixing.mix_sizes(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("t"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in taken) == 550 and all(abs(r["t"] - r["target"]) <= 9 / 2 * (2 if r["source_size"] == 800 else 1) for r in taken)
    for source, target in plain_targets({"a": 800, "b": 800, "c": 1350}).items():
        words = mixing.mix(docs).where(F.col("source") == source).select(F.sum(mixing.word_count(F.col("text")))).first()[0]
        assert abs(words - target) <= (4.5 if source == "c" else 2)
    assert sorted(mixing.mix(docs).select("text").collect()) == sorted(mixing.mix(docs.repartition(5)).select("text").collect())


def test_many_sources_get_what_plain_sharing_gives(spark, documents, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    rows = [(k, "w " * (1 + k % 17 * (k % 5)), f"s{k % 61:02}" if k % 61 else None) for k in range(1200)]
    sizes = {}
    for _, text, s in rows:
        sizes[s] = sizes.get(s, 0) + len(text.split())
    found = mixing.mix_sizes(documents(rows).repartition(6)).select("source_size", "target").distinct().collect()
    assert sorted((r[0], round(r[1], 6)) for r in found) == sorted({(sizes[s], round(float(t), 6)) for s, t in plain_targets(sizes).items()})


def test_a_long_text_is_counted_whole(documents):
    rows = [(1, "word " * 400_000, "a"), (2, "w" * 1_000_000, "a"), (3, "x", "b")]
    assert {r["doc_id"]: r["size"] for r in mixing.mix_sizes(documents(rows)).collect()} == {1: 400_000, 2: 1, 3: 1}


def test_native(many):
    plan = mixing.mix_sizes(many)._jdf.queryExecution().toString() + mixing.mix(many)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_ticket_is_uniform(spark):
    ids = spark.range(20000).select(mixing.ticket(F.col("id"), F.lit("")).alias("t"))
    low = ids.where(F.col("t") < (1 << mixing.TICKET_BITS) // 4).count()
    assert 4700 < low < 5300

import pyarrow as pa
import pytest

from sparkloom.llm.common import whole_groups
from sparkloom.llm.components import connected_components


def test_whole_groups_never_part_a_key():
    keys = [k for k, n in enumerate([1, 5, 2, 40, 1, 1, 7]) for _ in range(n)]
    batches = [pa.RecordBatch.from_pydict({"k": keys[a : a + 3]}) for a in range(0, len(keys), 3)]
    groups = [t.column("k").to_pylist() for t in whole_groups(batches, ["k"], rows=6)]
    assert sum(groups, []) == keys and len(groups) > 2
    assert all(a[-1] != b[0] for a, b in zip(groups, groups[1:], strict=False))
    assert list(whole_groups([], ["k"])) == []


def components(spark, edges):
    df = connected_components(spark.createDataFrame(edges, "a long, b long"))
    return {r["node"]: r["component"] for r in df.collect()}


def test_components_of_chain_star_and_cycle(spark):
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(7, k) for k in range(500, 560)]
    found = components(spark, [*chain, *star, (1, 2), (2, 3), (3, 1), (1, 1), (3, 2), (9, 9), (None, 4)])
    assert found == dict.fromkeys(range(100, 161), 100) | dict.fromkeys([7, *range(500, 560)], 7) | dict.fromkeys([1, 2, 3], 1)


def test_components_of_nothing(spark):
    assert components(spark, []) == {}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_random_edges(spark, seed):
    import random

    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)]
    own = list(range(80))
    for _ in own:
        for a, b in edges:
            own[a] = own[b] = min(own[a], own[b])
    assert components(spark, edges) == {k: own[k] for a, b in edges if a != b for k in (a, b)}


def test_written_tables_can_be_removed(spark):
    from sparkloom.llm import common

    one, two = (common.written(spark.range(n), "t") for n in (3, 5))
    assert spark.conf.get("spark.checkpoint.dir").removeprefix("file://") in common.shared_folder(spark) and one.count() == 3
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(one._sparkloom_path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    common.forget(one)
    assert not fs.exists(folder) and two.count() == 5
    since, three = common.mark(spark), common.written(spark.range(7), "t")
    four = common.written(spark.range(9), "t")
    common.clear(spark, since, keep=four)
    assert two.count() == 5 and four.count() == 9 and not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(three._sparkloom_path))
    common.clear(spark)
    assert not common._tables(spark) and not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(two._sparkloom_path))

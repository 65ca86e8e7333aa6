"""The prefix filter loses no pair; small tables are dealt out whole."""

import random

from inkwell.operators import similarity as S
from inkwell.sources.readers import read_table


def test_pairs_from_the_threshold_on_share_a_prefix_term(spark):
    rng, rows, vectors = random.Random(5), [], {}
    for i in range(60):
        tf = {t: rng.choice([1, 1, 2]) for t in rng.sample(range(12), rng.randint(1, 8))}
        w = {t: n * (1 + t // 3) for t, n in tf.items()}
        norm = sum(x * x for x in w.values()) ** 0.5
        vectors[i] = {t: x / norm for t, x in w.items()}
        rows += [(i, f"t{t}", float(1 + t // 3), x) for t, x in vectors[i].items()]
    weights = spark.createDataFrame(rows, "i long, term string, idf double, w double")
    kept = {}
    for r in S.prefix(weights, ["i"], 0.8).collect():
        kept.setdefault(r.i, set()).add(r.term)
    near = [(a, b) for a in vectors for b in vectors if a < b and sum(x * vectors[b].get(t, 0.0) for t, x in vectors[a].items()) >= 0.8]
    assert near and all(kept[a] & kept[b] for a, b in near)
    assert sum(map(len, kept.values())) < len(rows)


def test_small_table_is_dealt_out_whole(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(1000).coalesce(1).write.parquet(path)
    got = read_table(spark, path)
    assert got.rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, 1)
    assert sorted(r.id for r in got.collect()) == list(range(1000))

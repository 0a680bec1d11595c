import random

from polyscan.llm import common


def test_components_write_files_by_rows_not_by_shuffle_partitions(spark, monkeypatch):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    files = []
    drop = common.drop_table
    monkeypatch.setattr(common, "drop_table", lambda s, df: (files.append(len(df.inputFiles())), drop(s, df)))
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.node: r.root for r in common.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
    # The first table of edges is written as it comes, before its rows are known
    assert sorted(files)[:-1] and max(sorted(files)[:-1]) <= spark.sparkContext.defaultParallelism

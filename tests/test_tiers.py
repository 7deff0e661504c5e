"""The tiered index against a full build."""

import random

from leafledger.streaming import tiers

ROWS = "vault_id string, path string, gram string, tf long"


def rows_of(df):
    return sorted(tuple(r) for r in df.select("vault_id", "path", "gram", "tf").collect())


def test_many_batches_equal_a_full_build(spark, tmp_path):
    rng, root, truth, most = random.Random(4), str(tmp_path), {}, 0
    for batch in range(14):
        touched = {("v", f"p{rng.randrange(9)}") for _ in range(3)}
        new = []
        for path in touched:
            # Some paths are touched and left without rows, as deleted notes are.
            truth[path] = [(*path, f"g{k}", batch) for k in range(rng.randrange(3))]
            new += truth[path]
        frames = spark.createDataFrame(new, ROWS), spark.createDataFrame(sorted(touched) * 2, "vault_id string, path string")
        tiers.add_run(root, batch, *frames, fan=3)
        if batch in (5, 9):
            tiers.add_run(root, batch, *frames, fan=3)  # the batch once more, as after a failure
        runs = tiers.live_runs(spark, root)
        most = max(most, len(runs))
        assert runs[0][1] == 0 and [r[1] for r in runs[1:]] == [r[2] + 1 for r in runs[:-1]] and runs[-1][2] == batch
    assert rows_of(tiers.read_index(spark, root)) == sorted(r for rows in truth.values() for r in rows)
    # 14 batches of three: at most two runs in each of three tiers.
    assert most <= 6 and max(r[0] for r in tiers.live_runs(spark, root)) == 2
    oldest = tiers.live_runs(spark, root)[0]
    kept = {(r.vault_id, r.path) for r in spark.read.parquet(tiers._folder(root, oldest, "touched")).collect()}
    assert kept == {(r.vault_id, r.path) for r in spark.read.parquet(tiers._folder(root, oldest, "rows")).collect()}


def test_empty_index(spark, tmp_path):
    assert tiers.read_index(spark, str(tmp_path)) is None

"""The stateful apply stream against the sequential replay, over many micro-batches with a restart."""

import pytest
from pyspark.sql import functions as F
from test_apply import COLUMNS, NAMES, RESULT, make_log, outcome_rows, replay

from leafledger.operators.apply import apply_ops, assign_seq, feed_rows, written_rows
from leafledger.plans.bridge import EPOCH
from leafledger.streaming import keyed


def write_files(spark, log, folder, files):
    """``files`` files of consecutive arrivals; the source takes them in order of their time stamps."""
    size = -(-len(log) // files)
    for start in range(0, len(log), size):
        part = spark.createDataFrame([tuple(r[n] for n in NAMES) for r in log[start : start + size]], COLUMNS)
        part.coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def drain(outcomes, root, checkpoint, heads=None):
    query = keyed.start_keyed(outcomes, root, checkpoint, EPOCH, heads, availableNow=True)
    ended = query.awaitTermination(200)
    query.stop()
    assert ended and query.exception() is None


def table(spark, roots, name):
    out = None
    for root in roots:
        rows = spark.read.parquet(f"{root}/{name}")
        out = rows if out is None else out.unionByName(rows)
    return out


def test_ten_batches_with_a_restart_equal_the_replay(spark, tmp_path):
    log = make_log(21, 200)
    expected, revisions = replay(log)
    folder, heads = f"{tmp_path}/ops", f"{tmp_path}/heads"
    # The second run writes elsewhere and cannot see what the first wrote, but for the heads and the state store.
    for run, part in enumerate((log[:100], log[100:])):
        write_files(spark, part, folder, 5)
        drain(keyed.apply_keyed(stream(spark, folder)), f"{tmp_path}/out{run}", f"{tmp_path}/cp", heads)
    roots = [f"{tmp_path}/out0", f"{tmp_path}/out1"]
    outcomes = table(spark, roots, "outcomes")
    assert outcomes.select("batch").distinct().count() == 10
    assert outcome_rows(outcomes) == [tuple(r[c] for c in RESULT) for r in expected]
    rows = {(r.vault_id, r.path, r.rev): (r.hash, r.deleted, r.content) for r in table(spark, roots, "revisions").collect()}
    assert rows == {(r["vault"], r["path"], r["rev"]): (r["hash"], r["deleted"], r["content"]) for r in revisions}
    ops = spark.createDataFrame([tuple(r[n] for n in NAMES) for r in log], COLUMNS)
    feed = feed_rows(assign_seq(apply_ops(ops)), ops)
    live = table(spark, roots, "changes").select(feed.columns)
    assert sorted(map(repr, live.collect())) == sorted(map(repr, feed.collect()))


def test_scope_of_one_path(spark, tmp_path):
    log = [r for r in make_log(8, 160) if r["op"] != "rename"]
    for r in log:
        r["op_key"] = r["op_key"] and f"{r['op_key']}-{r['path'].lower()}"
    expected, _ = replay(log)
    crossing = dict.fromkeys(NAMES) | {"vault_id": "v0", "arrival": 1_000, "op": "rename", "path": "a.md", "to_path": "q.md", "expect": "match", "expected_rev": 1}
    nowhere = dict.fromkeys(NAMES) | {"vault_id": "v0", "arrival": 1_001, "op": "put", "expect": "absent"}
    write_files(spark, [*log, crossing, nowhere], f"{tmp_path}/ops", 2)
    drain(keyed.apply_keyed(stream(spark, f"{tmp_path}/ops"), keyed.by_path()), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = outcome_rows(spark.read.parquet(f"{tmp_path}/out/outcomes"))
    assert got[:-2] == [tuple(r[c] for c in RESULT) for r in expected]
    assert [r[2] for r in got[-2:]] == ["invalid_request"] * 2


def test_receipts_leave_by_their_time_to_live(spark, tmp_path):
    put = dict.fromkeys(NAMES) | {"vault_id": "v", "op": "put", "path": "a.md", "expect": "absent", "client_id": "c", "op_key": "key-1", "fingerprint": "f", "payload_hash": "h", "size": 1}
    log = [put | {"arrival": i} for i in (1, 2)]
    for name, ttl, second in (("long", 10**9, "replayed"), ("short", 1, "precondition_failed")):
        write_files(spark, log, f"{tmp_path}/{name}", 2)
        out = keyed.apply_keyed(stream(spark, f"{tmp_path}/{name}"), receipt_ms=ttl)
        drain(out, f"{tmp_path}/{name}-out", f"{tmp_path}/{name}-cp")
        rows = spark.read.parquet(f"{tmp_path}/{name}-out/outcomes").orderBy("arrival").collect()
        assert [r.reason for r in rows] == [None, second]


def test_authorization_and_live_limit_in_the_stream(spark, tmp_path):
    put = dict.fromkeys(NAMES) | {"vault_id": "v", "op": "put", "expect": "absent", "client_id": "c", "payload_hash": "h", "size": 1}
    log = [put | {"arrival": i, "path": f"p{i}.md"} for i in range(1, 9)]
    write_files(spark, log, f"{tmp_path}/ops", 2)
    state = spark.createDataFrame([("v", EPOCH)], "vault_id string, epoch string")
    revoked = spark.createDataFrame([("g1",)], "grant_id string")
    asked = stream(spark, f"{tmp_path}/ops").withColumns(
        {
            "grant_id": F.when(F.col("arrival") == 1, "g1").otherwise("g2"), "epoch": F.when(F.col("arrival") == 2, F.lit("f" * 32)), "match_epoch": F.lit(None).cast("string"),
            "scopes": F.when(F.col("arrival") == 3, F.array(F.lit("vault:read"))).otherwise(F.array(F.lit("vault:read"), F.lit("vault:write"))),
        }
    )
    out = keyed.apply_keyed(asked, live_limit=3, vault_state=state, revoked=revoked)
    drain(out, f"{tmp_path}/out", f"{tmp_path}/cp")
    rows = spark.read.parquet(f"{tmp_path}/out/outcomes").orderBy("arrival").collect()
    assert [r.reason for r in rows] == ["revoked", "epoch_mismatch", "forbidden_scope", None, None, None, "capacity_exceeded", "capacity_exceeded"]

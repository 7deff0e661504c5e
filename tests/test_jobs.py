"""Streaming jobs against their batch forms, and file sources."""

import hashlib

import pytest
from pyspark.sql import functions as F

from leafledger.operators import exports as X
from leafledger.operators import metrics as M
from leafledger.operators import search as S
from leafledger.operators.apply import apply_ops, assign_seq, feed_rows
from leafledger.plans.bridge import EPOCH, spark_table
from leafledger.schemas import SCHEMAS, SchemaMismatch
from leafledger.sources import tables, trees
from leafledger.streaming import jobs
from leafledger.streaming.store import compact, newest, read_before, read_state

SF = "/root/testdata/sf0.001"


def shaped(df, name):
    """``df`` in the fixed schema of a table."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS[name]])


def in_three_files(df, folder):
    bounds = df.agg(F.expr("percentile_approx(arrival, array(0.33, 0.66))")).first()[0]
    cuts = [-1, *bounds, 2**60]
    for low, high in zip(cuts, cuts[1:]):
        df.filter((F.col("arrival") > low) & (F.col("arrival") <= high)).coalesce(1).write.mode("append").parquet(folder)


def drain(query):
    running = query.trigger(availableNow=True).start()
    running.awaitTermination(300)
    assert running.exception() is None


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def test_metrics_stream_equals_batch(spark, folder):
    rows = shaped(spark_table(spark, SF, "observations"), "observations")
    in_three_files(rows, f"{folder}/observations")
    stream = tables.read_observations(spark, folder, max_files=1)
    drain(jobs.metrics_stream(stream, f"{folder}/state", f"{folder}/cp"))
    kept = M.drop_late(rows)
    clients = M.bounded_clients(kept)
    batch = clients.join(M.poll_cadence(kept, clients), [*M.DAY, "client_id"]).drop("first_arrival")
    columns = sorted(batch.columns)
    live = jobs.read_metrics(spark, f"{folder}/state")
    assert sorted(map(repr, live.select(columns).collect())) == sorted(map(repr, batch.select(columns).collect()))
    for stored, whole in ((jobs.read_daily(spark, f"{folder}/state"), M.daily_requests(kept)), (jobs.read_p95(spark, f"{folder}/state"), M.feed_p95(kept))):
        same = sorted(set(stored.columns) & set(whole.columns))
        assert len(same) >= 6 and sorted(map(repr, stored.select(same).collect())) == sorted(map(repr, whole.select(same).collect()))


def test_apply_stream_equals_batch(spark, folder):
    ops = spark_table(spark, SF, "ops").drop("op_key").withColumnRenamed("payload", "content")
    log = shaped(ops.withColumn("size", F.octet_length("content").cast("long")), "ops").drop("to_path", "op_key")
    in_three_files(log, f"{folder}/ops")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/ops")
    drain(jobs.apply_stream(stream, f"{folder}/state", f"{folder}/cp", EPOCH))
    live = read_before(spark, f"{folder}/state", "changes", 2**62).drop("batch")
    batch = feed_rows(assign_seq(apply_ops(log)), log)
    columns = sorted(batch.columns)
    assert sorted(map(repr, live.select(columns).collect())) == sorted(map(repr, batch.select(columns).collect()))
    files = newest(read_before(spark, f"{folder}/state", "files", 2**62), ["vault_id", "path"])
    top = batch.groupBy("vault_id", "path").agg(F.max("rev").alias("rev"))
    assert files.select("vault_id", "path", "rev").exceptAll(top).isEmpty() and files.count() == top.count()
    compact(spark, f"{folder}/state", "files", ["vault_id", "path"], 1)
    again = newest(read_state(spark, f"{folder}/state", "files", 2**62), ["vault_id", "path"])
    assert again.exceptAll(files.select(again.columns)).isEmpty() and again.count() == files.count()
    assert read_state(spark, f"{folder}/state", "files", 2**62).filter("batch = 0").isEmpty()


def test_postings_stream(spark, folder):
    notes = spark_table(spark, SF, "notes")
    later = notes.filter(F.substring("hash", 1, 1) == "3").withColumns({"rev": F.col("rev") + 1, "content": F.lit("completely new")})
    for step in (notes, later):
        step.coalesce(1).write.mode("append").parquet(f"{folder}/files")
        stream = spark.readStream.schema(notes.schema).parquet(f"{folder}/files")
        drain(jobs.postings_stream(stream, f"{folder}/state", f"{folder}/cp"))
    now = notes.filter(F.substring("hash", 1, 1) != "3").unionByName(later)
    want = S.build_postings(S.indexed_notes(now))
    have = jobs.read_postings(spark, f"{folder}/state").select(want.columns)
    assert have.exceptAll(want).isEmpty() and want.exceptAll(have).isEmpty()


def test_debounce_stream(spark, folder):
    rows = [("d", "v", i, "p", "modify", None, "h", t) for i, t in enumerate([0, 1_500, 2_900, 10_000, 11_999, 14_000, 90_000])]
    spark.createDataFrame(rows, SCHEMAS["local_events"]).coalesce(1).write.parquet(f"{folder}/local_events")
    stream = jobs.debounce_stream(tables.stream_table(spark, folder, "local_events"))
    drain(stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").outputMode("append"))
    got = sorted((r.first_at, r.last_at, r.events, r.flush_at) for r in spark.read.parquet(f"{folder}/out").collect())
    assert got == [(0, 2_900, 3, 4_900), (10_000, 11_999, 2, 13_999), (14_000, 14_000, 1, 16_000)]
    batch = jobs.debounce_events(spark.createDataFrame(rows, SCHEMAS["local_events"]))
    assert sorted((r.first_at, r.last_at, r.events, r.flush_at) for r in batch.collect())[:3] == got


def test_trees_and_strict_text(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "good note.md").write_bytes(b"\xef\xbb\xbfcaf\xc3\xa9")
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe\x00")
    rows = {r.path: r for r in trees.scan_local_tree(spark, str(tmp_path), "d", "v").collect()}
    assert set(rows) == {"sub/good note.md", "bad.md"}
    assert rows["bad.md"].hash == hashlib.sha256(b"\xff\xfe\x00").hexdigest() and rows["bad.md"].size == 3
    notes = {r.path: r for r in trees.load_notes(spark, str(tmp_path), "v").collect()}
    assert notes["sub/good note.md"].content == "﻿café" and notes["bad.md"].reason == "invalid_utf8"


def test_snapshot_round_trip(spark, folder):
    notes = spark_table(spark, SF, "notes")
    snapshot = X.capture_snapshot(notes, notes)
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    blobs = notes.filter("blob_hash IS NOT NULL").select("vault_id", "seq", F.col("blob_hash").alias("hash")).join(
        documents.select((F.col("doc_id") + 1).alias("seq"), F.encode("text", "UTF-8").alias("content")), "seq")
    X.write_snapshot(snapshot, notes, blobs, folder, "x1")
    manifest, payload = X.read_snapshot(spark, folder, "x1")
    assert X.verify_snapshot(manifest, payload).filter("reason is not null").isEmpty()
    restored = X.restore_snapshot(manifest, payload, 0, "r")
    assert restored.count() == notes.filter("not deleted").count()
    assert restored.filter("kind = 'blob' AND sha2(blob_bytes, 256) <> hash").isEmpty() and not restored.filter("kind = 'blob'").isEmpty()
    spoiled = payload.withColumn("bytes", F.when(F.col("vault_id") == "v1", F.lit("x").cast("binary")).otherwise(F.col("bytes")))
    assert X.restore_snapshot(manifest, spoiled, 0, "r").filter("vault_id = 'v1'").isEmpty()


def test_tables_are_checked_and_pruned(spark, folder):
    notes = spark_table(spark, SF, "notes")
    tables.write_files(shaped(notes, "files"), folder)
    plan = tables.scan_files(tables.scan(spark, folder, "files"), "v1").select("path", "rev").filter("path > 'src3'")._jdf.queryExecution().toString()
    assert "content" not in plan.split("ReadSchema")[-1] and "PushedFilters: [IsNotNull(vault_id), IsNotNull(path), EqualTo(vault_id,v1)" in plan
    notes.drop("rev").write.parquet(f"{folder}/revisions")
    with pytest.raises(SchemaMismatch):
        tables.scan(spark, folder, "revisions")

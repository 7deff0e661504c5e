"""Conditional apply against a plain sequential replay over lists of rows."""

import hashlib
import random

import pytest

from leafledger.operators.apply import apply_ops, assign_seq, dedupe_ops, feed_rows, label_components, receipt_rows, written_rows
from leafledger.session import cut_lineage

COLUMNS = (
    "vault_id string, arrival long, op string, path string, to_path string, client_id string, op_key string, fingerprint string, "
    "expect string, expected_rev long, kind string, size long, payload_hash string, content string, heading string, "
    "source_rev long, as_conflict_copy boolean, at_ms long"
)
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
RESULT = ["arrival", "accepted", "reason", "status", "rev", "from_rev", "hash", "deleted", "existing_path", "current_rev"]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def make_log(seed, n=300, vaults=2):
    """Random operations whose expectations are mostly right, so that chains get long."""
    rng = random.Random(seed)
    log, guess = [], {}
    for arrival in range(1, n + 1):
        vault = f"v{rng.randrange(vaults)}"
        name = rng.choice(["a.md", "A.md", "b.md", "c.md", "d.md", "é.md", "É.md"])
        op = rng.choices(["put", "delete", "append", "rename", "restore"], [5, 2, 3, 2, 2])[0]
        rev = guess.get((vault, name), 0)
        text = f"t{rng.randrange(50)}\n"
        row = dict.fromkeys(NAMES)
        row |= {"vault_id": vault, "arrival": arrival, "op": op, "path": name, "client_id": f"c{rng.randrange(2)}", "at_ms": arrival}
        if rng.random() < 0.3:
            row["op_key"] = f"key-{rng.randrange(30)}"
        if op == "put":
            row |= {"content": text, "payload_hash": digest(text), "size": len(text), "kind": "text"}
            row["expect"] = "absent" if rng.random() < 0.4 or rev == 0 else "match"
        elif op == "append":
            row |= {"content": text, "expect": "none"}
        else:
            row["expect"] = "match"
        if row["expect"] == "match":
            row["expected_rev"] = max(1, rev + (rng.random() < 0.15))
        if op == "rename":
            row["to_path"] = rng.choice(["a.md", "A.md", "b.md", "e.md", "f.md"])
            guess[(vault, row["to_path"])] = guess.get((vault, row["to_path"]), 0) + 1
        if op == "restore":
            row |= {"source_rev": rng.randrange(1, 4), "as_conflict_copy": rng.random() < 0.5}
        row["fingerprint"] = digest(repr([row[k] for k in ("op", "path", "to_path", "expected_rev", "content")]))
        guess[(vault, name)] = rev + 1
        log.append(row)
    return log


def replay(log, live_limit=10**9):
    """Tables as lists, one operation after the other; written without the library."""
    files, revisions, receipts, results = [], [], {}, []

    def current(vault, path):
        return next((f for f in files if f["vault"] == vault and f["path"] == path), None)

    def holder(vault, path):
        return next((f["path"] for f in files if f["vault"] == vault and f["path"].lower() == path.lower() and not f["deleted"]), None)

    def publish(vault, path, deleted, hash_, content, kind="text"):
        old = current(vault, path)
        new = {"vault": vault, "path": path, "rev": (old["rev"] if old else 0) + 1, "deleted": deleted, "hash": hash_, "content": content, "kind": kind}
        if old:
            files.remove(old)
        files.append(new)
        revisions.append(new)
        return new

    for o in log:
        vault, path, out = o["vault_id"], o["path"], dict.fromkeys(RESULT)
        out |= {"arrival": o["arrival"], "accepted": False}
        results.append(out)
        stored = receipts.get((vault, o["client_id"], o["op_key"])) if o["op_key"] else None
        if stored:
            out["reason"] = "replayed" if stored[0] == o["fingerprint"] else "idempotency_mismatch"
            if out["reason"] == "replayed":
                out["status"] = stored[1]
            continue
        row, alive = current(vault, path), holder(vault, path)
        if o["expect"] == "match":
            if row is None or row["rev"] != o["expected_rev"]:
                out |= {"reason": "precondition_failed", "current_rev": row and row["rev"]}
                continue
            if o["op"] == "put" and row["deleted"] and alive:
                out |= {"reason": "path_collision", "existing_path": alive}
                continue
        if o["expect"] == "absent" and alive:
            if alive == path:
                out |= {"reason": "precondition_failed", "current_rev": row["rev"]}
            else:
                out |= {"reason": "path_collision", "existing_path": alive}
            continue
        content = hash_ = None
        if o["op"] == "put":
            content, hash_ = o["content"], o["payload_hash"]
        if o["op"] == "append":
            if row is None or row["deleted"]:
                out["reason"] = "tombstone" if row else "not_found"
                continue
            content = row["content"] + o["content"]
            hash_ = digest(content)
        if o["op"] == "restore":
            source = next((r for r in revisions if (r["vault"], r["path"], r["rev"]) == (vault, path, o["source_rev"])), None)
            if source is None or source["deleted"]:
                out["reason"] = "invalid_request" if source else "revision_pruned"
                continue
            if not row["deleted"] and not o["as_conflict_copy"]:
                out["reason"] = "path_occupied"
                continue
            if alive not in (None, path):
                out |= {"reason": "path_collision", "existing_path": alive}
                continue
            content, hash_ = source["content"], source["hash"]
        if o["op"] == "rename":
            if path == o["to_path"]:
                out["reason"] = "invalid_request"
                continue
            if row["deleted"]:
                out["reason"] = "tombstone"
                continue
            there = holder(vault, o["to_path"])
            if there not in (None, path):
                out |= {"reason": "path_collision", "existing_path": there}
                continue
        if o["op"] != "delete" and sum(f["vault"] == vault and not f["deleted"] for f in files) >= live_limit:
            out["reason"] = "capacity_exceeded"
            continue
        was_live = row is not None and not row["deleted"]
        if o["op"] == "rename":
            text, old_hash = row["content"], row["hash"]
            out["from_rev"] = publish(vault, path, True, "", None)["rev"]
            new = publish(vault, o["to_path"], False, old_hash, text)
        elif o["op"] == "delete":
            new = publish(vault, path, True, "", None)
        else:
            new = publish(vault, path, False, hash_, content)
        out |= {"accepted": True, "rev": new["rev"], "hash": new["hash"], "deleted": new["deleted"]}
        out["status"] = 201 if o["op"] == "rename" or not was_live else 200
        if o["op_key"]:
            receipts[(vault, o["client_id"], o["op_key"])] = (o["fingerprint"], out["status"])
    return results, revisions


def frame(spark, log):
    return spark.createDataFrame([tuple(r[n] for n in NAMES) for r in log], COLUMNS)


def outcome_rows(df):
    return [tuple(r) for r in df.select(*RESULT).orderBy("arrival").collect()]


@pytest.mark.parametrize(
    "seed, options",
    [(1, {}), (2, {}), (3, {"max_group_ops": 70}), (4, {"live_limit": 3}), (5, {"live_limit": 3, "max_group_ops": 70})],
    ids=str,
)
def test_fold_equals_sequential_replay(spark, seed, options):
    log = make_log(seed)
    expected, _ = replay(log, options.get("live_limit", 10**9))
    got = outcome_rows(apply_ops(frame(spark, log), **options))
    assert got == [tuple(r[c] for c in RESULT) for r in expected]


def test_two_batches_equal_one(spark):
    log = make_log(11, 200)
    expected, revisions = replay(log)
    first, second = frame(spark, log[:90]), frame(spark, log[90:])
    one = cut_lineage(assign_seq(apply_ops(first)))
    written = cut_lineage(written_rows(one, first))
    latest = written.groupBy("vault_id", "path").agg({"rev": "max"}).withColumnRenamed("max(rev)", "rev")
    state = written.join(latest, ["vault_id", "path", "rev"])
    two = apply_ops(second, state, receipt_rows(one, first, "0" * 32), written)
    assert outcome_rows(two) == [tuple(r[c] for c in RESULT) for r in expected[90:]]


def test_written_rows_feed_and_sequence(spark):
    log = make_log(5, 150)
    _, revisions = replay(log)
    ops = frame(spark, log)
    accepted = cut_lineage(assign_seq(apply_ops(ops)))
    rows = {(r.vault_id, r.path, r.rev): (r.hash, r.deleted, r.content) for r in written_rows(accepted, ops).collect()}
    assert rows == {(r["vault"], r["path"], r["rev"]): (r["hash"], r["deleted"], r["content"]) for r in revisions}
    feed = feed_rows(accepted, ops).orderBy("vault_id", "seq").collect()
    for vault in ("v0", "v1"):
        mine = [f for f in feed if f.vault_id == vault]
        assert [f.seq for f in mine] == list(range(1, len(mine) + 1))
    assert all((f.from_path is not None) == (f.op == "rename") for f in feed)


def test_key_window_and_stored_receipts(spark):
    ok, old = "op-opaque-1", "00000000-0001-7000-8000-000000000000"
    base = dict.fromkeys(NAMES) | {"vault_id": "v", "op": "put", "expect": "absent", "client_id": "c", "payload_hash": "h", "kind": "text", "size": 1}
    log = [base | {"arrival": 1, "path": "a", "op_key": ok, "fingerprint": "f1"}, base | {"arrival": 2, "path": "b", "op_key": old, "fingerprint": "f2"},
           base | {"arrival": 3, "path": "d", "op_key": "known-key", "fingerprint": "f3"}, base | {"arrival": 4, "path": "e", "op_key": "known-old", "fingerprint": "fx"}]
    receipts = spark.createDataFrame([("v", "c", "known-key", "f3", 201, 0), ("v", "c", "known-old", "f4", 200, 0)],
                                     "vault_id string, client_id string, op_key string, fingerprint string, status int, arrival long")
    out = {r.arrival: (r.accepted, r.reason, r.status) for r in apply_ops(frame(spark, log), receipts=receipts, now_ms=1_800_000_000_000).collect()}
    assert out == {1: (True, None, 201), 2: (False, "operation_expired", None), 3: (False, "replayed", 201), 4: (False, "idempotency_mismatch", None)}


def test_tombstone_with_history_takes_rename(spark):
    base = dict.fromkeys(NAMES) | {"vault_id": "v", "client_id": "c", "kind": "text", "size": 1, "payload_hash": "h"}
    log = [base | {"arrival": 1, "op": "put", "expect": "absent", "path": "x.md"}]
    log += [base | {"arrival": i, "op": "put", "expect": "match", "expected_rev": i - 1, "path": "x.md"} for i in range(2, 10)]
    log += [base | {"arrival": 10, "op": "delete", "expect": "match", "expected_rev": 9, "path": "x.md"},
            base | {"arrival": 11, "op": "put", "expect": "absent", "path": "y.md"},
            base | {"arrival": 12, "op": "rename", "expect": "match", "expected_rev": 1, "path": "y.md", "to_path": "x.md"}]
    last = apply_ops(frame(spark, log)).filter("arrival = 12").first()
    assert (last.accepted, last.rev, last.from_rev, last.status) == (True, 11, 2, 201)


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [("v", f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(45)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else find(parent[x])

    for _, a, b in edges:
        ra, rb = sorted((find(a), find(b)))
        parent[rb] = ra
    got = {r.node: r.component for r in label_components(spark.createDataFrame(edges, "vault_id string, src string, dst string")).collect()}
    for _, a, b in edges:
        if a != b:
            assert got[a] == find(a) and got[b] == find(b)


def test_long_chain_is_one_component(spark):
    edges = [("v", f"n{i:03d}", f"n{i + 1:03d}") for i in range(120)]
    got = label_components(spark.createDataFrame(edges, "vault_id string, src string, dst string"))
    assert got.select("component").distinct().count() == 1 and got.count() == 121


def test_same_key_of_two_clients_is_independent(spark):
    rows = [("v", 1, "c1", "k", "f"), ("v", 2, "c2", "k", "g"), ("v", 3, "c1", "k", "f"), ("v", 4, "c2", "k", "x"), ("v", 5, "c1", None, "f")]
    ops = spark.createDataFrame(rows, "vault_id string, arrival long, client_id string, op_key string, fingerprint string")
    out = {r.arrival: r.outcome for r in dedupe_ops(ops).collect()}
    assert out == {1: "new", 2: "new", 3: "replayed", 4: "idempotency_mismatch", 5: "new"}


def test_columns_that_a_log_leaves_out_are_not_sorted(spark):
    """The vault under a limit folds in one order, so its rows hold only what the log brings; slices and a start state agree."""
    rows = [("v", i, "put", f"n{i % 7}.md", "absent" if i < 7 else "match", None if i < 7 else i // 7, f"h{i}") for i in range(35)]
    log = spark.createDataFrame(rows, "vault_id string, arrival long, op string, path string, expect string, expected_rev long, payload_hash string")
    whole = apply_ops(log, live_limit=5)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "heading" not in plan.replace("_more", "").split("Exchange")[0] and "source_content" not in plan.split("Exchange")[0]
    state = spark.createDataFrame([("v", "n0.md", 3, False, "old")], "vault_id string, path string, rev long, deleted boolean, hash string")
    for start in (None, state):
        one = sorted(map(tuple, apply_ops(log, start, live_limit=5).collect()), key=lambda r: r[1])
        cut = sorted(map(tuple, apply_ops(log, start, live_limit=5, max_group_ops=20).collect()), key=lambda r: r[1])
        assert one == cut and len(one) == 35 and any(r[3] == "capacity_exceeded" for r in one)

"""The collection run step by step, and counters kept by change."""

import random
from collections import Counter

import pytest

from leafledger.operators import collection as C
from leafledger.operators import lifecycle as L
from leafledger.plans.bridge import spark_table

SF = "/root/testdata/sf0.001"
MARKS = "vault_id string, hash string, size long, marked_at long"
PAGES = "vault_id string, run_id string, cursor string, next_cursor string"
OBJECTS = "vault_id string, hash string, size long, run_id string, cursor string"
COUNTS = "vault_id string, hash string, refs long"
SETTLED = "vault_id string, owner string, failed boolean"
DELETED = "vault_id string, owner string, hash string, size long"


@pytest.fixture
def table(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def run_of(runs, vault="v"):
    return runs.filter(runs.vault_id == vault).first()


def started(table):
    runs = C.idle_runs(table([("v",), ("w",), ("v",)], "vault_id string"))
    return C.start_runs(runs, table([("v", "r2", 5), ("v", "r1", 3)], "vault_id string, run_id string, arrival long"))


def test_only_idle_vaults_start_and_the_first_request_counts(table):
    runs = started(table)
    assert run_of(runs).run_id == "r1" and run_of(runs).phase == "marking" and run_of(runs, "w").phase == "idle"
    again = C.start_runs(runs, table([("v", "r9", 1)], "vault_id string, run_id string, arrival long"))
    assert run_of(again).run_id == "r1" and again.count() == 2


def test_pages_apply_once_and_only_to_their_run(table):
    runs, marks, counts = started(table), table([], MARKS), table([("v", "a", 2), ("v", "x", -1)], COUNTS)
    objects = table([("v", "a", 1, "r1", ""), ("v", "b", 1, "r1", ""), ("v", "b", 1, "r1", ""), ("v", "x", 1, "r1", ""), ("w", "c", 1, "r1", "")], OBJECTS)
    pages = table([("v", "r1", "", "m"), ("w", "r1", "", None)], PAGES)
    runs, marks = C.mark_pages(runs, marks, counts, pages, objects, 7)
    # A count below zero is no reference; a page of an idle vault changes nothing.
    assert sorted(tuple(r) for r in marks.collect()) == [("v", "b", 1, 7), ("v", "x", 1, 7)]
    assert (run_of(runs).cursor, run_of(runs).generation, run_of(runs, "w").phase) == ("m", 1, "idle")
    same_runs, same_marks = C.mark_pages(runs, marks, counts, pages, objects, 8)
    assert same_marks.count() == 2 and run_of(same_runs).generation == 1
    runs, marks = C.mark_pages(runs, marks, counts, table([("v", "r1", "m", None)], PAGES), table([("v", "b", 1, "r1", "m")], OBJECTS), 9)
    assert (run_of(runs).phase, run_of(runs).generation, marks.count()) == ("deleting", 1, 2)


def deleting(table):
    runs, marks = started(table), table([], MARKS)
    objects = table([("v", h, 1, "r1", "") for h in "abc"], OBJECTS)
    return C.mark_pages(runs, marks, table([], COUNTS), table([("v", "r1", "", None)], PAGES), objects, 1)


def test_a_publication_between_mark_and_sweep_waits(table):
    runs, marks = deleting(table)
    asked = [("v", "a", 1), ("v", "z", 1), ("v", "z", 0), ("w", "a", 0), ("new", "q", 0)]
    out = C.fence_publications(table(asked, "vault_id string, hash string, observed_generation long"), runs, marks)
    assert {tuple(r)[:3]: r.reason for r in out.select("vault_id", "hash", "observed_generation", "reason").collect()} == {
        ("v", "a", 1): C.FENCED, ("v", "z", 1): None, ("v", "z", 0): C.FENCED, ("w", "a", 0): None, ("new", "q", 0): None,
    }


def test_overlapping_claims_partial_deletion_and_retry(table):
    runs, marks = deleting(table)
    claims = "vault_id string, owner string, arrival long"
    runs = C.claim_deletes(runs, table([("v", "o2", 2), ("v", "o1", 1), ("w", "o1", 1)], claims))
    assert run_of(runs).owner == "o1" and run_of(runs, "w").owner is None
    assert run_of(C.claim_deletes(runs, table([("v", "o3", 0)], claims))).owner == "o1"
    # Another owner settles nothing; a mark of another size stays.
    for deleted, settled in (([("v", "o2", "a", 1)], [("v", "o2", False)]), ([("v", "o1", "a", 9)], [])):
        other, kept = C.settle_deletes(runs, marks, table(deleted, DELETED), table(settled, SETTLED))
        assert run_of(other).owner == "o1" and kept.count() == 3 and run_of(other).generation == 1
    runs, marks = C.settle_deletes(C.interrupt_deletes(runs), marks, table([("v", "o1", "a", 1)], DELETED), table([("v", "o1", True)], SETTLED))
    assert (run_of(runs).owner, run_of(runs).failure, run_of(runs).generation) == (None, C.UNAVAILABLE, 2)
    assert run_of(C.finish_runs(runs, marks)).phase == "deleting"
    runs = C.claim_deletes(runs, table([("v", "o2", 4)], claims))
    rest = C.claimed_marks(runs, marks).select("vault_id", "owner", "hash", "size")
    runs, marks = C.settle_deletes(runs, marks, rest, table([("v", "o2", False)], SETTLED))
    end = run_of(C.collection_status(C.finish_runs(runs, marks), marks))
    assert (end.phase, end.marked_count, end.delete_state, end.failure, end.generation) == ("idle", 0, "idle", None, 3)


def test_an_interrupted_claim_is_unknown_and_gives_no_batch(table):
    runs, marks = deleting(table)
    runs = C.interrupt_deletes(C.claim_deletes(runs, table([("v", "o1", 1)], "vault_id string, owner string, arrival long")))
    assert run_of(runs).delete_state == "unknown" and C.claimed_marks(runs, marks).isEmpty()


def test_counts_by_change_equal_a_recount(spark, table):
    rng, held, counts = random.Random(2), [], None
    for _ in range(6):
        added = [("v" + rng.choice("12"), rng.choice("abcdef")) for _ in range(20)]
        removed = rng.sample(held, len(held) // 3)
        held += added
        for r in removed:
            held.remove(r)
        names = "vault_id string, hash string"
        counts = C.merge_counts(counts, C.reference_changes([table(added, names)], [table(removed, names)]))
    assert {(r.vault_id, r.hash): r.refs for r in counts.collect()} == dict(Counter(held))
    assert C.count_differences(counts, [table(held, "vault_id string, hash string")]).isEmpty()
    assert C.count_differences(counts, [table(held[1:], "vault_id string, hash string")]).count() == 1
    below = C.merge_counts(counts, C.reference_changes([], [table([("v1", "nowhere")], "vault_id string, hash string")]))
    assert [(r.hash, r.refs) for r in below.filter("reason = 'underflow'").collect()] == [("nowhere", -1)]


def test_history_counters_and_their_underflow(spark):
    tables = [spark_table(spark, SF, t) for t in ("revisions", "receipts", "changes")]
    early = [t.filter("at_ms % 2 = 0") for t in tables]
    counters = L.merge_counters(L.merge_counters(None, L.counter_changes(added=tables)), L.counter_changes(removed=early))
    rest = [t.filter("at_ms % 2 = 1") for t in tables]
    assert L.counter_differences(counters, *rest).isEmpty()
    want = {r.vault_id: r.pressure_bytes for r in L.history_pressure(*rest).collect()}
    assert {r.vault_id: r.pressure_bytes for r in L.pressure_of(counters).collect()} == want
    twice = L.pressure_of(L.merge_counters(counters, L.counter_changes(removed=tables))).collect()
    assert all(r.reason == "counter_underflow" and r.pressure_bytes is None and r.revisions_bytes is None for r in twice)

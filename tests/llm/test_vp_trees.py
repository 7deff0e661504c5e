import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from leafledger.llm import vp_trees

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [words[i : i + 4] for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    """(doc_id, fingerprint) rows to component ids, by comparing every two fingerprints."""
    prints = sorted({p for _, p in rows})
    part = {p: p for p in prints}

    def root(p):
        while part[p] != p:
            p = part[p]
        return p

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 4:
            part[root(a)] = root(b)
    least = {}
    for doc_id, p in rows:
        if doc_id is not None:
            least[root(p)] = min(least.get(root(p), doc_id), doc_id)
    return [(doc_id, f"{p:016x}", least.get(root(p))) for doc_id, p in rows]


def key(row):
    return tuple((v is None, v or 0) if not isinstance(v, str) else v for v in row)


def check(spark, frame, rows, **more):
    got = [tuple(r) for r in vp_trees.join_simhash(frame, **more).collect()]
    want = slow_components([(doc_id, slow_print(text)) for doc_id, text in rows])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_awkward_rows_by_brute_force(spark, awkward):
    check(spark, awkward, [(r.doc_id, r.text) for r in awkward.collect()])


@pytest.mark.parametrize("shard", [vp_trees.SHARD, 2])
def test_documents_by_brute_force(spark, documents, texts, shard):
    check(spark, documents, list(texts.items()), shard=shard)


def test_near_copies_around_one_text(spark):
    rng = random.Random(9)
    words = [rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(120)]
    rows = []
    for k in range(300):
        own = list(words)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = "new" + str(rng.randint(0, 99))
        rows.append((k if k % 50 else None, " ".join(own)))
    rows += [(1, None), (2, ""), (7, rows[3][1]), (7, rows[3][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check(spark, frame, rows, shard=8, split=40)


def test_empty_table_and_a_very_long_text(spark, nothing):
    assert vp_trees.join_simhash(nothing).count() == 0
    long = "Alpha beta  gamma\tdelta epsilon " * 120_000 + "x" * 2_200_000 + " tail end"
    rows = [(2, long), (1, long.replace("  ", " ")), (3, "y" * 3_000_000), (4, "one two")]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_lists_of_a_long_text_are_joined_at_their_cuts(monkeypatch):
    text = " ".join(f"w{i}" for i in range(500)) + " " + "z" * 90 + " a b c d e"
    monkeypatch.setattr(vp_trees, "_word_lists", lambda raw: [raw.split()[i : i + 1] for i in range(len(raw.split()))])
    assert vp_trees.simhash(text.encode()) == slow_print(text)
    assert vp_trees.simhash(b"a b") == slow_print("a b") and vp_trees.simhash(b"a b c d") == slow_print("a b c d")


def near(rng, value, bits):
    for b in rng.sample(range(64), bits):
        value ^= 1 << b
    return value


def test_every_pair_within_four_bits_shares_a_shard():
    rng = random.Random(3)
    sample = np.array([rng.getrandbits(64) for _ in range(4_000)], np.uint64)
    trees = vp_trees.fit_trees(sample, 9)
    base = [rng.getrandbits(64) for _ in range(3_000)]
    found = np.array(base + [near(rng, v, rng.randint(0, 4)) for v in base], np.uint64)
    met, visits = set(), 0
    for tree in trees:
        row, leaf, home = vp_trees.shards_of(found, tree)
        assert home.sum() == len(found)
        visits += (~home).sum()
        homes = dict(zip(row[home].tolist(), leaf[home].tolist()))
        own = {(r, l) for r, l in zip(row.tolist(), leaf.tolist())}
        met |= {k for k in range(3_000) if (k + 3_000, homes[k]) in own or (k, homes[k + 3_000]) in own}
    assert len(met) == 3_000 and visits > 0
    # Branches are pruned: a fingerprint is in few of the 512 shards of a tree.
    assert visits < 2 * 5 * len(found)


@pytest.mark.parametrize("shard,split", [(16, 2_048), (64, 50)])
def test_links_connect_all_near_fingerprints(spark, shard, split):
    rng = random.Random(shard)
    hub = rng.getrandbits(64)
    found = [rng.getrandbits(64) for _ in range(700)]
    found += [near(rng, v, rng.randint(1, 4)) for v in found[:200]] + [near(rng, hub, rng.randint(0, 7)) for _ in range(400)]
    rows = [(k, v) for k, v in enumerate(dict.fromkeys(found))]
    signed = [(k, v - (1 << 64) if v >> 63 else v) for k, v in rows]
    links = vp_trees.link_fingerprints(spark.createDataFrame(signed, "doc_id long, fp long"), shard, split).collect()
    part = {k: k for k, _ in rows}

    def root(k):
        while part[k] != k:
            k = part[k]
        return k

    value = dict(rows)
    for r in links:
        assert (value[r.a_doc] ^ value[r.b_doc]).bit_count() <= 4 and r.a_doc != r.b_doc
        a, b = root(r.a_doc), root(r.b_doc)
        part[max(a, b)] = min(a, b)
    want = {doc_id: component for doc_id, _, component in slow_components(rows)}
    assert {k: root(k) for k, _ in rows} == want

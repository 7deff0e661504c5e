import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from leafledger.llm import ngram_join


def slow(rows):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append(frozenset(zip(*[words[k:] for k in range(5)])) if len(words) >= 5 else frozenset([tuple(words)] if words else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where, common = defaultdict(list), Counter()
    for at, items in enumerate(sets):
        for item in items:
            where[item].append(at)
    for members in where.values():
        for i, b in enumerate(members):
            for a in members[:i]:
                common[a, b] += 1
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    least = {}
    for at, (doc_id, _) in enumerate(rows):
        root = find(at)
        least[root] = min(least.get(root, doc_id), doc_id)
    return sorted((doc_id, len(sets[at]), least[find(at)]) for at, (doc_id, _) in enumerate(rows))


def check(spark, rows, tile=ngram_join.TILE_ENTRIES):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS own", "2 AS n_shingles", "'x' AS items").repartition(4)
    assert sorted(tuple(r) for r in ngram_join.join_ngrams(docs, tile).collect()) == slow(rows)


def copies(rng, base, voc, edits):
    words = list(base)
    for _ in range(edits):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        if kind == 0:
            words[at] = rng.choice(voc)
        elif kind == 1:
            words.insert(at, rng.choice(voc))
        elif len(words) > 1:
            del words[at]
    return " ".join(words)


@pytest.mark.parametrize("seed,tile", [(1, ngram_join.TILE_ENTRIES), (2, 300)])
def test_families_of_copies(spark, seed, tile):
    rng = random.Random(seed)
    voc = [f"w{k}" for k in range(300)]
    frame = [rng.choice(voc) for _ in range(40)]
    texts = ["", "  ", "a", "a", "b c d", "B c D", "x y z q"] + [" ".join(frame + [rng.choice(voc) for _ in range(12)]) for _ in range(50)]
    for family in range(20):
        base = [rng.choice(voc) for _ in range(rng.choice([6, 10, 25, 60, 150, 500]))]
        base = frame + base[:20] if family % 3 == 0 else base
        texts += [copies(rng, base, voc, rng.randrange(len(base) // 25 + 2)) for _ in range(rng.choice([2, 5, 30]))]
    rng.shuffle(texts)
    check(spark, list(enumerate(texts)), tile)


@pytest.mark.parametrize("tile", [ngram_join.TILE_ENTRIES, 400])
def test_copies_that_link_through_one_text_only(spark, tile):
    """Every copy has its own passage replaced: linked with the first text, not with each other, in two groups apart."""
    rows = []
    for group in range(2):
        base = [f"g{group}x{k}" for k in range(200)]
        rows += [" ".join(base)] + [" ".join(base[:at] + [f"g{group}y{at}z{k}" for k in range(20)] + base[at + 20 :]) for at in range(0, 180, 3)]
    random.Random(4).shuffle(rows)
    check(spark, list(enumerate(rows)), tile)


def test_tiles_give_no_more_links_than_join_their_components(spark):
    """Forty sets that all link, each its own component, in one tile: 39 links, not 780."""
    rng = np.random.default_rng(3)
    base, views = rng.integers(0, 1 << 62, 100).astype(np.uint64), []
    for own in range(40):
        values = np.unique(np.concatenate([base[1:], rng.integers(0, 1 << 62, 1).astype(np.uint64)]))
        for keys, _, space in ngram_join.views_of(values):
            views.append((0, 0, 0, own, own, 0, space, len(keys), keys.view(np.int64).tolist(), values.tobytes()))
    schema = "pool long, low int, high int, own long, part long, block int, space int, filled int, segments array<long>, items binary"
    links = spark.createDataFrame(views, schema).coalesce(1).mapInArrow(ngram_join._link_tile, "a long, b long").collect()
    assert len(links) == 39 and len({r.a for r in links} | {r.b for r in links}) == 40


def test_near_the_bound(spark):
    """Pairs just above and just below three quarters, at many sizes."""
    rng, rows = random.Random(9), []
    for size in (8, 9, 12, 20, 33, 50, 90, 128, 200, 500):
        words = [f"s{size}x{k}" for k in range(size + 4)]
        for cut in range(max(1, size // 4 - 3), size // 4 + 3):
            rows.append(" ".join(words[: len(words) - cut]))
        rows.append(" ".join(words))
    rng.shuffle(rows)
    check(spark, list(enumerate(rows)))


def test_pigeonhole_holds_for_random_pairs():
    """Any two linked sets keep a common segment in some band."""
    rng = np.random.default_rng(2)
    for size in (7, 10, 30, 100, 127, 128, 600):
        for _ in range(30):
            one = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
            drop, add = rng.integers(0, size // 8 + 1, 2)
            other = np.unique(np.concatenate([one[drop:], rng.integers(0, 1 << 62, add).astype(np.uint64)]))
            shared = len(np.intersect1d(one, other))
            if 100 * shared >= 75 * (len(one) + len(other) - shared) and len(one) != shared:
                keys = [set(np.concatenate([v[0] for v in ngram_join.views_of(x)]).tolist()) for x in (one, other)]
                assert keys[0] & keys[1]


def test_awkward_rows(spark, awkward, nothing):
    rows = ngram_join.join_ngrams(awkward).collect()
    assert len(rows) == awkward.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[6].component_id == 1 and by_id[3].n_shingles == 0 and by_id[3].component_id == 3 and by_id[2].component_id == 2
    assert by_id[7].n_shingles == 1 and by_id[None].component_id == 1
    assert ngram_join.join_ngrams(nothing).count() == 0

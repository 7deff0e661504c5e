"""SimHash near copies by vantage-point trees: every pair of fingerprints within four bits, exact.

The 64 bits are cut into five blocks on a ring. If two fingerprints differ in at most four bits, some block starts a walk
round the ring on which the first l blocks together differ in at most l * 4 / 5 bits, rounded down (the cycle lemma): 0 in the first,
1 in the first two. So there are five vantage-point trees, one for each starting block. A level of a tree
has a vantage point and a radius, and its metric is the Hamming distance over its block: a fingerprint lies inside or
outside. By the triangle inequality a partner within the level's budget is on the other side only if the fingerprint's own
distance is within the budget of the radius; all other branches are pruned. Leaves are shards: a fingerprint has one home in
each tree and visits the boundary-overlapping shards below its home's number, and a shard compares its homes with
each other and with its visitors by the whole fingerprint. Two levels of three are on the first block, whose
budget is 0, one is on the second. Their number follows from the number of fingerprints: about ``SHARD`` homes in a shard.

Equal fingerprints are one class before the trees. A shard emits a spanning forest of its links, not all pairs. Shards
above ``SPLIT`` rows (a large group of near copies) are cut into blocks, and every two blocks meet in a tile of their
own. Vantage points are fitted on ``SAMPLE`` fingerprints; they decide balance, never results.

NULL, empty and blank texts have the fingerprint zero, linked like any other. Rows with a NULL doc_id are linked like
others; a component without any id has a NULL component_id. Repeated rows stay; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.apply import label_components
from .common import byte_texts, slices, stored
from .filter_audit import _word_lists

BITS = 4  # linked if no more differ
SHINGLE, SEED = 4, 42
WIDTHS = (13, 13, 13, 13, 12)
SHARD = 256
SAMPLE = 4_096
SPLIT, MOST_BLOCKS = 2_048, 64
MOST_SPLIT = 1_000_000  # shards that can be split, so the broadcast list of them is bounded
HOT_SHARE = 1_000  # a class of that part of all rows meets its rows by broadcast
CELLS = 1 << 20  # compared at once
_STARTS = np.cumsum((0, *WIDTHS[:-1]))


# ---- fingerprints ----------------------------------------------------------


def _hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of every shingle of a word list, or of the whole list if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    text, size = b" ".join(words), min(len(words), SHINGLE)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(text[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())], np.uint64)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def simhash(raw: bytes | None) -> int:
    """Fingerprint of one text: a bit is 1 if set in over half of the shingles' hashes."""
    counts, total, tail = np.zeros(64, np.int64), 0, []
    for some in _word_lists((raw or b"").lower()):
        words = tail + some
        # Shingles over the cut of two lists; a short first list waits for the next.
        if total == 0 and len(words) < SHINGLE:
            tail = words
            continue
        if len(words) >= SHINGLE:
            hashes = _hashes(words)
            counts, total = counts + _bit_counts(hashes), total + len(hashes)
        tail = words[-(SHINGLE - 1) :]
    if total == 0 and tail:
        hashes = _hashes(tail)
        counts, total = _bit_counts(hashes), len(hashes)
    return sum(1 << i for i in np.flatnonzero(2 * counts > total).tolist())


def _sign(batches):
    for batch in batches:
        for part in slices([batch], "text"):
            found = np.array([simhash(raw) for raw in byte_texts(part.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64), pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; the fingerprint as a signed number."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_sign, "doc_id long, fp long")


# ---- trees -----------------------------------------------------------------


def block_of(found: np.ndarray, block: int) -> np.ndarray:
    return found >> np.uint64(_STARTS[block]) & np.uint64((1 << WIDTHS[block]) - 1)


def fit_trees(sample: np.ndarray, levels: int) -> list[list[tuple[int, int, int, int]]]:
    """Per tree its levels: (block, vantage point, radius, budget of differing bits).

    Of some vantage points the one that leaves the fewest pairs of the sample together is taken.
    """
    trees = []
    for start in range(len(WIDTHS)):
        tree, leaf = [], np.zeros(len(sample), np.int64)
        for level in range(levels):
            place = 1 if level % 3 == 2 else 0
            block = (start + place) % len(WIDTHS)
            own, best = block_of(sample, block), None
            for at in range(24):
                vantage = own[(level * 24 + at) * 997 % len(own)]
                away = np.bitwise_count(own ^ vantage).astype(np.int64)
                for radius in {int(np.median(away)), max(int(np.median(away)) - 1, 0)}:
                    split = leaf * 2 + (away > radius)
                    pairs = (np.unique(split, return_counts=True)[1].astype(np.int64) ** 2).sum()
                    if best is None or pairs < best[0]:
                        best = pairs, int(vantage), radius, split
            tree.append((block, best[1], best[2], (place + 1) * BITS // len(WIDTHS)))
            leaf = best[3]
        trees.append(tree)
    return trees


def shards_of(found: np.ndarray, tree: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home) of each fingerprint: its home, and the lower leaves that its boundary reaches."""
    row, leaf, home = np.arange(len(found)), np.zeros(len(found), np.int64), np.ones(len(found), bool)
    for block, vantage, radius, budget in tree:
        away = np.bitwise_count(block_of(found, block) ^ np.uint64(vantage)).astype(np.int64)[row]
        side = away > radius
        near = np.where(side, away - budget <= radius, away + budget > radius)
        row, leaf, home = np.r_[row, row[near]], np.r_[leaf * 2 + side, (leaf * 2 + ~side)[near]], np.r_[home, np.zeros(near.sum(), bool)]
    homes = np.zeros(len(found), np.int64)
    homes[row[home]] = leaf[home]
    keep = home | (leaf < homes[row])
    return row[keep], leaf[keep], home[keep]


def _deal(trees):
    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            found = batch.column("fp").to_numpy().view(np.uint64)
            for number, tree in enumerate(trees):
                row, leaf, home = shards_of(found, tree)
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), number, np.int32)), pa.array(leaf), pa.array(home), *taken.columns], ["tree", "leaf", "home", *batch.schema.names]
                )

    return deal


# ---- links -----------------------------------------------------------------


def forest(left: np.ndarray, right: np.ndarray | None = None, homes: int | None = None) -> list[tuple[int, int]]:
    """Spanning forest of the links of the first ``homes`` fingerprints with all (places in ``left``), or of ``left``
    with ``right`` (whose places follow)."""
    every = left if right is None else np.r_[left, right]
    rows = len(left) if homes is None else homes
    columns, offset = (left, 0) if right is None else (right, len(left))
    label, out = np.arange(len(every)), []
    step = max(CELLS // max(len(columns), 1), 1)
    for start in range(0, rows, step):
        close = np.bitwise_count(left[start : min(start + step, rows), None] ^ columns[None, :]) <= BITS
        a, b = np.nonzero(close)
        a, b = a + start, b + offset
        new = (a < b) & (label[a] != label[b])
        a, b = a[new], b[new]
        if not len(a):
            continue
        # One link for each two components of before; union them, then name all anew.
        _, first = np.unique(label[a] * len(every) + label[b], return_index=True)
        parent: dict[int, int] = {}

        def root(x):
            while x in parent:
                x = parent[x]
            return x

        for at in first.tolist():
            x, y = root(int(label[a[at]])), root(int(label[b[at]]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((int(a[at]), int(b[at])))
        names = np.arange(len(every))
        for x in sorted(parent):
            names[x] = names[parent[x]]
        label = names[label]
    return out


LINKS = "a long, a_doc long, b long, b_doc long"
_KEYS = ["tree", "leaf", "low", "high"]


def _tile_links(table: pa.Table, split: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a shard or tile that are linked, as two arrays of places."""
    found = table.column("fp").to_numpy().view(np.uint64)
    home = table.column("home").to_numpy()
    order = np.argsort(~home, kind="stable")
    pairs = []
    if not split:
        pairs = [(order[a], order[b]) for a, b in forest(found[order], homes=int(home.sum()))]
    else:
        low = table.column("block").to_numpy() == table.column("low").to_numpy()
        for left, right in ((low & home, ~low), (low & ~home, ~low & home)):
            x, y = np.flatnonzero(left), np.flatnonzero(right)
            if len(x) and len(y):
                both = np.r_[x, y]
                pairs += [(both[a], both[b]) for a, b in forest(found[x], found[y])]
    a, b = zip(*pairs) if pairs else ((), ())
    return np.array(a, np.int64), np.array(b, np.int64)


def _link(batches):
    """Links of each shard or tile; rows come sorted by it."""

    def links(table):
        a, b = _tile_links(table, table.column("low")[0].as_py() != table.column("high")[0].as_py())
        near, far = table.take(pa.array(a)), table.take(pa.array(b))
        return pa.table([near.column("fp"), near.column("doc_id"), far.column("fp"), far.column("doc_id")], names=["a", "a_doc", "b", "b_doc"])

    held, own, out, count = [], None, [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in _KEYS], axis=1)
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)]):
            key = tuple(keys[start])
            if key != own and held:
                out.append(links(pa.Table.from_batches(held)))
                held = []
            own = key
            held.append(batch.slice(start, stop - start))
        count = sum(t.num_rows for t in out)
        if count > 50_000:
            yield from pa.concat_tables(out).combine_chunks().to_batches()
            out = []
    if held:
        out.append(links(pa.Table.from_batches(held)))
    if out:
        yield from pa.concat_tables(out).combine_chunks().to_batches()


def link_fingerprints(classes: DataFrame, shard: int = SHARD, split: int = SPLIT) -> DataFrame:
    """Links among distinct fingerprints (fp, doc_id), as a forest per shard: every two within four bits are connected."""
    spark = classes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    total = classes.count()
    place = F.pmod(F.xxhash64("fp"), F.lit(max(total, 1)))
    seen = classes.filter(place < 2 * SAMPLE).orderBy(place, "fp").limit(SAMPLE).select("fp").collect()
    sample = np.array([r.fp for r in seen], np.int64).view(np.uint64)
    levels = max(int(np.ceil(np.log2(max(total, 1) / shard))), 0) if len(sample) else 0
    shards = classes.select("fp", "doc_id").mapInArrow(
        _deal(fit_trees(sample, levels)), "tree int, leaf long, home boolean, fp long, doc_id long"
    )
    sizes = stored(shards.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")), "vp-sizes")
    rows = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    large = sizes.filter(F.col("n") > max(split, rows // MOST_SPLIT))
    large = large.select("tree", "leaf", F.least(F.ceil(F.col("n") / split), F.lit(MOST_BLOCKS)).cast("int").alias("blocks"))
    cut = shards.join(F.broadcast(large), ["tree", "leaf"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = cut.select("tree", "leaf", F.least("block", "mate").alias("low"), F.greatest("block", "mate").alias("high"), "block", "home", "fp", "doc_id")
    return tiles.repartition(parts, *_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(_link, LINKS)


# ---- components ------------------------------------------------------------


def _node(fp: str, doc_id: str):
    """Text that sorts by doc_id, rows without one last, and names one fingerprint."""
    number = F.lpad(F.hex(F.col(doc_id).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.coalesce(number, F.lit("G" * 16)), F.lpad(F.hex(fp), 16, "0"))


def join_simhash(docs: DataFrame, shard: int = SHARD, split: int = SPLIT) -> DataFrame:
    """One row per row of ``docs``: fingerprint and the smallest doc_id that links reach."""
    signed = stored(fingerprints(docs), "vp-fingerprints")
    classes = stored(signed.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")), "vp-classes")
    links = stored(link_fingerprints(classes, shard, split), "vp-links")
    # A component's smallest node holds its smallest doc_id.
    edges = links.select(F.lit(0).alias("vault_id"), _node("a", "a_doc").alias("src"), _node("b", "b_doc").alias("dst"))
    labels = label_components(edges).select(
        F.conv(F.substring("node", 17, 16), 16, -10).cast("long").alias("fp"),
        F.when(~F.col("component").startswith("G"), F.conv(F.substring("component", 1, 16), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)))).alias("component_id"),
        F.lit(True).alias("linked"),
    )
    named = classes.join(labels, "fp", "left").select("fp", "n", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    named = stored(named, "vp-named")
    # At most HOT_SHARE classes hold a HOT_SHARE-th of the rows or more; they are looked up without a shuffle.
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    is_hot = F.col("n") >= max(-(-total // HOT_SHARE), 1)
    hot = named.filter(is_hot).select("fp", F.col("component_id").alias("hot_id"), F.lit(True).alias("hot"))
    looked = signed.join(F.broadcast(hot), "fp", "left")
    rest = looked.filter("hot IS NULL").select("doc_id", "fp").join(named.filter(~is_hot).select("fp", "component_id"), "fp")
    out = looked.filter("hot").select("doc_id", "fp", F.col("hot_id").alias("component_id")).unionByName(rest.select("doc_id", "fp", "component_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

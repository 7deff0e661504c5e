"""Jaccard join on word shingles by universe-partition pigeonhole, verified exactly.

Two sets with at least 3/4 of their union in common differ in at most H = (s1 + s2) / 7 elements. Sets fall
into size bands that grow by 4/3, so partners lie in the same or in neighbouring bands, and a pair is
handled in the band of its smaller set. A band cuts the universe of shingles into m segments by hash: a
difference of H elements touches at most H segments, so of a set's filled segments all but H must
hold the very same subset on both sides. Each set therefore has slack = filled - H - 1 segments to spare.

Cost-based allocation: m is a multiple of H, larger for small sets, and a set spends its slack on leaving out
the segments whose subsets are most frequent in the corpus (both sides leave out by the same order, so a
pair always keeps a common one). A set with fewer than slack + 1 segments that occur anywhere else has no
partner. Sets too unevenly filled for that (no slack) also index every element by itself, the
finest partition.

Equal sets are one class from the start. Every kept segment has a leader, its smallest class. Each class is first
verified against one of its leaders, then against those that this has left in other components. Where a leader
still has members elsewhere, the classes around it meet in tiles of bounded size, which hold their segments and
their sets: a pair that agrees in all but H of its filled segments, whether kept or left out, is verified there,
and only links that join two components leave a tile. What one component holds already is not tested again. Shingles are 64-bit hashes; segments travel as 40 bits beside their bucket,
and two that fall together only add a pair to verify.

NULL text and text without words have no shingles and link with nothing; fewer than five words are one
shingle. Rows with equal ids share the component of the first of their classes; NULL ids are kept with a
NULL component; other columns of the input are ignored.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.apply import label_components
from .common import byte_texts, slices, stored

WORDS = 5
TILE_ENTRIES = 200_000
SLICE = 3 << 20
BATCH_ROWS = 500  # rows of an Arrow batch that carries whole texts or sets
VERIFY_ROWS = 100  # rows of one that carries two whole sets
KEY_BYTES = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _bands(limit: int = 1 << 40) -> list[int]:
    """Lower ends of the size bands: 1, 2, 3, 4, 6, 8, 11, ... each 4/3 of the one before, rounded up."""
    ends = [1]
    while ends[-1] < limit:
        ends.append(max(ends[-1] + 1, -(-ends[-1] * 4 // 3)))
    return ends


BANDS = _bands()


def band_of(size: int) -> int:
    return int(np.searchsorted(BANDS, size, side="right")) - 1


def most_differing(size: int, partner: int) -> int:
    """Largest symmetric difference of two linked sets of at most these sizes."""
    return (size + partner) // 7


def segments_of_band(band: int) -> int:
    """Segments of a band: more per tolerated difference where sets are small and few shared words fill them."""
    top = BANDS[band + 1] - 1
    times = 3.0 if top < 128 else 2.0 if top < 512 else 1.3
    return int(times * (most_differing(top, 4 * top // 3) + 1)) + 2


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; spreads every bit."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingles(text: bytes, words_per: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = text.lower().split()  # bytes.lower touches A-Z alone
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    per = min(words_per, len(words))
    count = len(words) - per + 1
    total = np.full(count, per, np.uint64)
    for k in range(per):
        total = mix(total * _MIX + hashes[k : k + count])
    return np.unique(total)


def set_key(values: np.ndarray) -> int:
    """Signed 64-bit key of a set; equal sets have equal keys."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(values.tobytes())).astype(np.int64))


def views_of(values: np.ndarray) -> list[tuple[np.ndarray, int, int]]:
    """Per space where a set can meet a partner: its signatures, its slack and the space's number."""
    size, own, out = len(values), band_of(len(values)), []
    for band in (own, own - 1):
        if band < 0:
            continue
        partner = 4 * size // 3 if band == own else BANDS[own] - 1
        differ = most_differing(size, partner)
        if differ == 0:  # only equal sets link
            continue
        cuts = segments_of_band(band)
        mixed = mix(values + np.uint64((band + 1) * int(_MIX) % (1 << 64)))
        segment = (mixed >> np.uint64(33)) % np.uint64(cuts)
        order = np.argsort(segment, kind="stable")
        ranked = segment[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        subset = np.add.reduceat(mixed[order], first)
        out.append((mix(subset + ranked[first] * _MIX + np.uint64(2 * band)), len(first) - differ - 1, 2 * band))
        if len(first) <= differ:  # no guarantee against another such set: index single elements
            out.append((mix(mixed + np.uint64(2 * band + 1)), size - differ - 1, 2 * band + 1))
    return out


def pack_keys(keys: np.ndarray) -> bytes:
    """The low 40 bits of every key."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // KEY_BYTES, 8), np.uint8)
    wide[:, :KEY_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, KEY_BYTES)
    return wide.view("<u8").reshape(-1)


def narrow(numbers: np.ndarray) -> bytes:
    """Numbers in as few bytes as the largest one needs; the length tells how many."""
    top = int(numbers.max(initial=0))
    return numbers.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4").tobytes()


def widen(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // max(count, 1) or 1}").astype(np.int64)


SIGN_SCHEMA = "bucket int, batch long, keys binary, owners binary, views binary, ids array<long>, sizes array<long>"
_VIEW = np.dtype([("set", "<i8"), ("slack", "<i4"), ("space", "<i4"), ("size", "<i4"), ("filled", "<i4")])


def _sign(buckets: int):
    """Signatures by bucket; the batch's views and documents travel once, with bucket ``batch % buckets``."""

    def sign(batches):
        part, number, seen = TaskContext.get().partitionId(), 0, set()
        kinds = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("keys", pa.binary()), ("owners", pa.binary()),
                           ("views", pa.binary()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])
        for batch in slices(batches, "text", SLICE):
            uid = (part << 24) | number
            number += 1
            sets, sizes, keys, owners, views = [], [], [], [], []
            for text in byte_texts(batch.column("text")):
                values = shingles(text or b"")
                key = set_key(values) if len(values) else 0
                sets.append(key)
                sizes.append(len(values))
                if not len(values) or key in seen:
                    continue
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(key)
                for signature, slack, space in views_of(values):
                    keys.append(signature)
                    owners.append(np.full(len(signature), len(views), np.uint32))
                    views.append((key, slack, space, len(values), len(signature)))
            # ids: document ids and then their sets' keys, as two halves of one list
            rows = [(uid % buckets, uid, b"", b"", np.array(views, _VIEW).tobytes(), batch.column("doc_id").to_pylist() + sets, sizes)]
            if keys:
                keys, owners = np.concatenate(keys), np.concatenate(owners)
                place = ((keys >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(place, kind="stable")
                keys, owners, place = keys[order], owners[order], place[order]
                cuts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]]))
                for low, high in zip(cuts[:-1], cuts[1:]):
                    steps = np.diff(owners[low:high].astype(np.int64), prepend=0)  # owners rise within a bucket
                    rows.append((int(place[low]), uid, pack_keys(keys[low:high]), narrow(steps), None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

    return sign


MATCH_SCHEMA = "batch long, bucket int, keys binary, owners binary, counts binary, views binary, ids array<long>, sizes array<long>"
_MATCH = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary()), ("owners", pa.binary()), ("counts", pa.binary()),
                    ("views", pa.binary()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])


def _match(batches):
    """Within a bucket, signatures that occur more than once, with their counts, by batch."""
    held, current = [], None

    def settle():
        if not held:
            return None
        lengths = [len(k) // KEY_BYTES for _, k, _ in held]
        keys = unpack_keys(b"".join(k for _, k, _ in held))
        source = np.repeat(np.arange(len(held)), lengths)
        order = np.argsort(keys)
        ranked = keys[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        counts = np.empty(len(keys), "<u4")
        counts[order] = np.repeat(np.diff(np.concatenate([first, [len(keys)]])), np.diff(np.concatenate([first, [len(keys)]])))
        shared = counts > 1
        rows = []
        for at, (uid, _, steps) in enumerate(held):
            low, high = np.searchsorted(source, [at, at + 1])
            own = shared[low:high]
            if own.any():
                owners = np.cumsum(widen(steps, lengths[at]))[own]
                times = np.minimum(counts[low:high][own], 65_535)  # only their order counts, the same for all
                rows.append((uid, current, pack_keys(keys[low:high][own]), narrow(np.diff(owners, prepend=0)), narrow(times), None, None, None))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _MATCH)], schema=_MATCH) if rows else None

    for batch in batches:
        for row in batch.to_pylist():
            if row["ids"] is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], f.type) for v, f in zip((row["batch"], None, b"", b"", b"", row["views"], row["ids"], row["sizes"]), _MATCH)], schema=_MATCH
                )
                continue
            if row["bucket"] != current:
                found = settle()
                if found:
                    yield found
                held, current = [], row["bucket"]
            held.append((row["batch"], row["keys"], row["owners"]))
    found = settle()
    if found:
        yield found


KEPT_SCHEMA = "kind int, doc_id long, n_shingles long, own long, space int, filled int, spare int, segments array<long>"
_KEPT = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("own", pa.int64()), ("space", pa.int32()),
                   ("filled", pa.int32()), ("spare", pa.int32()), ("segments", pa.list_(pa.int64()))])


def _keep(batches):
    """Per batch: its documents, and for every set that can have a partner its shared segments, the ``spare`` left-out ones first."""
    held, views, current = [], None, None

    def settle():
        if views is None or not held:
            return None
        keys, owners, counts = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((keys, -counts, owners))  # per set the most frequent first, the same order for all
        keys, owners = keys[order], owners[order]
        found, lengths = np.unique(owners, return_counts=True)
        spare = np.maximum(views["slack"][found], 0)
        able = lengths > spare  # with fewer shared segments no partner is possible
        if not able.any():
            return None
        view, n = views[found[able]], int(able.sum())
        ends = np.cumsum(lengths[able])
        segments = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(keys[np.repeat(able, lengths)].view(np.int64)))
        columns = [np.ones(n, np.int32), pa.nulls(n, pa.int64()), view["size"].astype(np.int64), view["set"].astype(np.int64), view["space"].astype(np.int32),
                   view["filled"].astype(np.int32), spare[able].astype(np.int32), segments]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _KEPT)], schema=_KEPT)

    for batch in batches:
        for row in batch.to_pylist():
            if row["batch"] != current:
                found = settle()
                if found:
                    yield found
                held, views, current = [], None, row["batch"]
            if row["ids"] is not None:
                views, sizes = np.frombuffer(row["views"], _VIEW), row["sizes"]
                n = len(sizes)
                columns = [np.zeros(n, np.int32), row["ids"][:n], sizes, row["ids"][n:]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _KEPT)] + [pa.nulls(n, f.type) for f in list(_KEPT)[4:]], schema=_KEPT)
            else:
                keys = unpack_keys(row["keys"])
                place = np.uint64(row["bucket"] << 8 * KEY_BYTES)
                held.append((keys | place, np.cumsum(widen(row["owners"], len(keys))), widen(row["counts"], len(keys))))
    found = settle()
    if found:
        yield found


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(own, set) of the wanted classes, from the texts; ``wanted`` has (own, doc_id).

    A bitmap of 2**25 id hashes (4 MB at most) keeps texts of other documents out of the join.
    """
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 25))
    maps = wanted.select(bit.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("m")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
    rows = docs.select("doc_id", "text").withColumn("b", bit).withColumn("m", F.bitmap_bucket_number("b")).withColumn("p", F.bitmap_bit_position("b"))
    rows = rows.join(F.broadcast(maps), "m")
    octet = F.conv(F.hex(F.expr("substring(bits, cast(p / 8 as int) + 1, 1)")), 16, 10).cast("int")
    rows = rows.withColumn("octet", octet).filter("(shiftright(octet, cast(p % 8 as int)) & 1) = 1")

    def cut(batches):
        for batch in slices(batches, "text", SLICE):
            sets = [shingles(t or b"") for t in byte_texts(batch.column("text"))]
            yield pa.RecordBatch.from_pydict({"own": pa.array([set_key(s) for s in sets], pa.int64()), "items": pa.array([s.tobytes() for s in sets], pa.binary())})

    found = rows.select("text").mapInArrow(cut, "own long, items binary")
    return found.join(wanted.select("own"), "own", "left_semi").dropDuplicates(["own"])


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets share at least three quarters of their union."""
    full = pairs.join(sets.select(F.col("own").alias("b"), F.col("items").alias("items_b")), "b")
    full = full.join(sets.select(F.col("own").alias("a"), F.col("items").alias("items_a")), "a")

    def test(batches):
        last, left = None, None
        for batch in batches:
            keep = []
            for at, (a, one, other) in enumerate(zip(batch.column("a").to_pylist(), batch.column("items_a"), batch.column("items_b"))):
                if a != last:
                    last, left = a, np.frombuffer(one.as_buffer(), "<u8")
                right = np.frombuffer(other.as_buffer(), "<u8")
                shared = len(left) + len(right) - len(np.unique(np.concatenate([left, right])))
                if 100 * shared >= 75 * (len(left) + len(right) - shared):
                    keep.append(at)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return full.select("a", "b", "items_a", "items_b").mapInArrow(test, "a long, b long")


@contextmanager
def _short_batches(spark, rows: int):
    """Fewer rows in an Arrow batch than usual while whole texts or sets travel in them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, usual)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The links among the pairs, written down."""
    with _short_batches(pairs.sparkSession, VERIFY_ROWS):
        return stored(_verify(pairs, sets), "ngram-links")


def _components(links: DataFrame) -> DataFrame:
    found = label_components(links.select(F.lit(0).alias("vault_id"), F.col("a").alias("src"), F.col("b").alias("dst")))
    return found.select(F.col("node").alias("own"), F.col("component").alias("part"))


def _leader_pairs(views: DataFrame) -> DataFrame:
    """(a, b): every class with the leader, the smallest class, of each of its kept segments that has others."""
    kept = views.select("own", F.explode(F.expr("slice(segments, spare + 1, size(segments))")).alias("segment"))
    leads = kept.groupBy("segment").agg(F.min("own").alias("b"), F.max("own").alias("last")).filter("b <> last").drop("last")
    return kept.join(leads, "segment").filter("own <> b").select(F.col("own").alias("a"), "b").distinct()


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose classes are in different components."""
    named = pairs.join(labels.select(F.col("own").alias("a"), F.col("part").alias("x")), "a", "left")
    named = named.join(labels.select(F.col("own").alias("b"), F.col("part").alias("y")), "b", "left")
    return named.filter(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")


def _link_tile(batches):
    """Links of a tile that join two of its components: pairs that agree in all but H of their filled segments, in some space, verified."""
    names = ["pool", "low", "high"]

    def settle(rows):
        table, found = pa.Table.from_batches(rows), []
        low, high = rows[0].column("low")[0].as_py(), rows[0].column("high")[0].as_py()
        lists = table.column("segments").combine_chunks()
        times = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        segments, starts = lists.flatten().to_numpy(), np.cumsum(times) - times
        columns = {c: table.column(c).to_numpy() for c in ("space", "own", "filled", "part", "block")}
        items = table.column("items")
        _, first, named = np.unique(columns["own"], return_index=True, return_inverse=True)
        sets = [np.frombuffer(items[at].as_buffer(), "<u8") for at in first.tolist()]
        sizes = np.array([len(v) for v in sets])
        shingle = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        marked = np.zeros(len(shingle), np.int32)  # by shingle: 1 while its set is compared
        label = columns["part"][first]  # components, as this tile's links join them
        for space in np.unique(columns["space"]):
            at = np.flatnonzero(columns["space"] == space)
            who, filled, block = named[at], columns["filled"][at], columns["block"][at]
            owner = np.repeat(np.arange(len(at)), times[at])
            mine = segments[np.concatenate([np.arange(starts[k], starts[k] + times[k]) for k in at.tolist()])]
            segment = np.unique(mine, return_inverse=True)[1]
            posts = owner[np.argsort(segment, kind="stable")]
            ends = np.cumsum(np.bincount(segment))
            own_ends = np.cumsum(times[at])
            for y in np.flatnonzero(block == low).tolist():
                meets = [posts[(ends[g - 1] if g else 0) : ends[g]] for g in segment[own_ends[y] - times[at[y]] : own_ends[y]].tolist()]
                counts = np.bincount(np.concatenate(meets), minlength=len(at))
                differ = (sizes[who] + sizes[who[y]]) // 7
                need = np.maximum(np.maximum(filled, filled[y]) - differ, 1)
                good = (counts >= need) & (label[who] != label[who[y]]) & (block == high)
                if low == high:
                    good[: y + 1] = False
                mates = who[good]
                if not len(mates):
                    continue
                left = shingle[cuts[who[y]] : cuts[who[y] + 1]]
                marked[left] = 1
                to = np.cumsum(sizes[mates])
                place = np.arange(to[-1]) + np.repeat(cuts[mates] - (to - sizes[mates]), sizes[mates])
                shared = np.add.reduceat(marked[shingle[place]], to - sizes[mates])
                marked[left] = 0
                linked = mates[100 * shared >= 75 * (sizes[mates] + len(left) - shared)]
                parts, one = np.unique(label[linked], return_index=True)
                found += [(int(columns["own"][first[who[y]]]), int(columns["own"][first[m]])) for m in linked[one].tolist()]
                label[np.isin(label, parts)] = label[who[y]]
        if found:
            return pa.RecordBatch.from_arrays([pa.array([max(p) for p in found], pa.int64()), pa.array([min(p) for p in found], pa.int64())], ["a", "b"])

    held, current = [], None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in names])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            if low == high:
                continue
            key = tuple(keys[:, low].tolist())
            if key != current and held:
                out = settle(held)
                if out:
                    yield out
                held = []
            current = key
            held.append(batch.slice(low, high - low))
    if held:
        out = settle(held)
        if out:
            yield out


def _tile_links(views: DataFrame, sets: DataFrame, pairs: DataFrame, labels: DataFrame, parts: int, tile_entries: int) -> DataFrame:
    """Links among the classes around leaders that have members in other components, as many as join these.

    Classes that such leaders connect form a pool. A pool's classes are cut into blocks by hash, every
    two blocks make a tile, and a tile holds about two blocks' entries of ``tile_entries``.
    """
    leads = stored(_across(pairs, labels).select("b").distinct(), "ngram-leads")
    pools = _components(pairs.join(leads, "b", "left_semi")).withColumnRenamed("part", "pool")
    around = stored(pools.join(labels, "own", "left").select("own", "pool", F.coalesce("part", "own").alias("part")), "ngram-pools")
    around = stored(views.join(around, "own").dropDuplicates(["own", "space"]).join(sets, "own"), "ngram-around")
    # Only pools of several blocks are named here: at most as many as there are tiles of entries.
    blocks = F.ceil(F.sum(F.size("segments")) / tile_entries).cast("int")
    sizes = stored(around.groupBy("pool").agg(blocks.alias("blocks")).filter("blocks > 1"), "ngram-blocks")
    around = around.join(sizes, "pool", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    around = around.withColumn("block", F.pmod(F.xxhash64("own", F.lit("block")), F.col("blocks")).cast("int"))
    tiled = around.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiled = tiled.select("pool", F.least("block", "mate").alias("low"), F.greatest("block", "mate").alias("high"), "own", "part", "block", "space", "filled", "segments", "items")
    dealt = tiled.repartition(parts, "pool", "low", "high").sortWithinPartitions("pool", "low", "high")
    return dealt.mapInArrow(_link_tile, "a long, b long").distinct()


def link_classes(docs: DataFrame, views: DataFrame, heads: DataFrame, parts: int, tile_entries: int = TILE_ENTRIES) -> DataFrame:
    """(own, part) for classes linked with others; ``views`` are the shared segments of classes that can have a partner."""
    pairs = stored(_leader_pairs(views), "ngram-pairs")
    wanted = pairs.select(F.col("a").alias("own")).unionByName(pairs.select(F.col("b").alias("own"))).distinct().join(heads, "own").select("own", "doc_id")
    with _short_batches(docs.sparkSession, BATCH_ROWS):
        sets = stored(_sets_of(docs, wanted), "ngram-sets")
    # One leader per class first: a large group of near copies is one component after it.
    chosen = stored(pairs.groupBy("a").agg(F.min("b").alias("b")), "ngram-first")
    links = _verified(chosen, sets)
    rest = stored(_across(pairs, _components(links)).join(chosen, ["a", "b"], "left_anti"), "ngram-rest")
    links = links.unionByName(_verified(rest, sets))
    with _short_batches(docs.sparkSession, BATCH_ROWS):
        tiled = stored(_tile_links(views, sets, pairs, _components(links), parts, tile_entries), "ngram-tiled")
    return _components(links.unionByName(tiled))


def join_ngrams(docs: DataFrame, tile_entries: int = TILE_ENTRIES) -> DataFrame:
    """One row per document: number of shingles and the smallest document its links reach."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = rows.mapInArrow(_sign(4 * parts), SIGN_SCHEMA)
    matched = signed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_match, MATCH_SCHEMA)
    kept = matched.repartition(parts, "batch").sortWithinPartitions("batch").mapInArrow(_keep, KEPT_SCHEMA)
    with _short_batches(spark, BATCH_ROWS):
        kept = stored(kept, "ngram-kept")
    documents = kept.filter("kind = 0").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("own")).alias("own"))
    heads = documents.filter("own IS NOT NULL").groupBy("own").agg(F.min("doc_id").alias("doc_id"))
    views = kept.filter("kind = 1").drop("kind", "doc_id")
    labels = link_classes(rows, views, heads, parts, tile_entries)
    named = heads.join(labels, "own", "left")
    firsts = named.withColumn("part", F.coalesce("part", "own"))
    smallest = firsts.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    classes = firsts.join(smallest, "part").select("own", "component_id")
    out = documents.join(classes, "own", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))

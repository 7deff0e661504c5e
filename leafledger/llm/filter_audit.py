"""Filter interaction audit: what each of five filters removes under every order of application.

A filter's verdict does not depend on the order, so a document is a mask of the filters it fails, and each figure of
the audit is a sum over masks. Four verdicts come from the text alone. The fifth, "identical to the text of a smaller
doc_id", needs the table: a counting Bloom prepass clears the texts that are surely unique. Each task counts its texts in
segments of counters, the segments are merged by addition, and only a text whose counters all reached two may repeat.
Only such texts are shuffled, grouped by the full text for the smallest id; the ids are then joined to the documents'
masks by (doc_id, digest), and masks are added up per part.

The merged bits (one a counter, ``COUNTERS`` counters a document, ``MOST_COUNTERS`` at most, so 64 MB at most before
compression) are broadcast. The bound costs no result: beyond it counters are shared by more texts, and more unique texts
are shuffled with the repeated ones.

NULL texts count as empty texts. A NULL doc_id is smaller than none, never fails E, and has no labels. Rows
repeated with the same doc_id and text do not fail E because of each other. A NULL lang is the part ''. A document
is good or toxic if any of its labels says so. Other columns are ignored; an empty table has no parts and no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, slices, stored

FILTERS = "ABCDE"
SEGMENT = 1 << 16  # counters of a segment; all counters of a text lie in one
COUNTERS = 16  # counters a document
MOST_COUNTERS = 1 << 29
PIECE = 1 << 20  # bytes of a long text that are cut into words at once
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_MARKS = b"#$%&*|"
_TAIL = bytes(range(0x80, 0xC0))  # continuation bytes of UTF-8
_SPACE = b" \t\n\v\f\r"

FACTS = "doc_id long, part string, mask int, digest binary"
_FACTS = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("digest", pa.binary())])


def _word_lists(raw: bytes):
    """Words of a text in lists of about ``PIECE`` bytes; a word is never cut."""
    start = 0
    while len(raw) - start > PIECE:
        stop = start + PIECE
        while stop < len(raw) and raw[stop] not in _SPACE:
            stop += 1
        yield raw[start:stop].split()
        start = stop
    yield (raw[start:] if start else raw).split()


def text_mask(raw: bytes) -> int:
    """Bits of the failed filters A to D."""
    words, seen = 0, set()
    for some in _word_lists(raw):
        words += len(some)
        seen.update(some)
    upper = len(raw) - len(raw.translate(None, _UPPER))
    points = len(raw.translate(None, _TAIL))
    marked = len(raw.translate(None, _MARKS)) < len(raw)
    return (words < 200) | (100 * len(seen) < 50 * words) << 1 | (100 * upper > 3 * points) << 2 | marked << 3


def _judge(batches):
    for batch in batches:
        for part in slices([batch], "text"):
            raws = [raw or b"" for raw in byte_texts(part.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), part.column("part").cast(pa.string()),
                    pa.array([text_mask(raw) for raw in raws], pa.int32()), pa.array([hashlib.sha256(raw).digest() for raw in raws], pa.binary()),
                ],
                schema=_FACTS,
            )


def _places(digests: list[bytes], segments: int, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment of each digest and its ``hashes`` counters in there."""
    words = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4)
    offsets = words[:, 1:2] >> (np.arange(hashes, dtype=np.uint64) * np.uint64(16)) & np.uint64(SEGMENT - 1)
    return (words[:, 0] % np.uint64(segments)).astype(np.int64), offsets.astype(np.int64)


def _count(segments: int, hashes: int, flush: int = 1 << 18):
    """Each task's sketch: per segment the counters it met once, and those it met more often."""

    def rows(digests):
        segment, offsets = _places(digests, segments, hashes)
        # Equal counters of one text count once, so that a text cannot reach two by itself.
        offsets = np.sort(offsets, axis=1)
        fresh = np.ones(offsets.shape, bool)
        fresh[:, 1:] = offsets[:, 1:] != offsets[:, :-1]
        places, counts = np.unique((segment[:, None] * SEGMENT + offsets)[fresh], return_counts=True)
        own = places // SEGMENT
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        low = (places % SEGMENT).astype("<u2")
        cut = [slice(a, b) for a, b in zip(starts, [*starts[1:], len(own)])]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(own[starts], pa.int64()),
                pa.array([low[c][counts[c] == 1].tobytes() for c in cut], pa.binary()),
                pa.array([low[c][counts[c] > 1].tobytes() for c in cut], pa.binary()),
            ],
            ["segment", "once", "often"],
        )

    def count(batches):
        held = []
        for batch in batches:
            held += batch.column("digest").to_pylist()
            if len(held) >= flush:
                yield rows(held)
                held = []
        if held:
            yield rows(held)

    return count


def _merge(batches):
    """Sum of the sketches of a segment, rows sorted by segment; a bit for every counter of two or more."""
    own, counters = None, np.zeros(SEGMENT, np.uint8)

    def bits():
        return pa.RecordBatch.from_arrays(
            [pa.array([own], pa.int64()), pa.array([zlib.compress(np.packbits(counters > 1).tobytes(), 1)], pa.binary())], ["segment", "bits"]
        )

    for batch in batches:
        for segment, once, often in zip(*(batch.column(c).to_pylist() for c in ("segment", "once", "often"))):
            if segment != own:
                if own is not None:
                    yield bits()
                own, counters = segment, np.zeros(SEGMENT, np.uint8)
            at = np.frombuffer(once, "<u2")
            counters[at] = np.minimum(counters[at] + 1, 2)
            counters[np.frombuffer(often, "<u2")] = 2
    if own is not None:
        yield bits()


def repeat_sketch(facts: DataFrame, most_counters: int = MOST_COUNTERS):
    """(segments, hashes, bits per segment) of the merged counting Bloom filter over all digests."""
    total = max(facts.count(), 1)
    segments = max(min(total * COUNTERS, most_counters) // SEGMENT, 1)
    hashes = int(np.clip(round(0.69 * segments * SEGMENT / total), 1, 4))
    sketches = facts.select("digest").mapInArrow(_count(segments, hashes), "segment long, once binary, often binary")
    merged = sketches.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merge, "segment long, bits binary")
    return segments, hashes, {row.segment: bytes(row.bits) for row in merged.collect()}


def _marker(shared, segments: int, hashes: int):
    """Digests to booleans: True if the text may repeat."""
    maps: dict[int, np.ndarray] = {}

    def may_repeat(digests: list[bytes]) -> np.ndarray:
        segment, offsets = _places(digests, segments, hashes)
        out = np.zeros(len(digests), bool)
        for at in np.unique(segment).tolist():
            if at not in maps:
                if len(maps) >= 1024:  # 8 KB each
                    maps.clear()
                maps[at] = np.frombuffer(zlib.decompress(shared.value[at]), np.uint8)
            rows = np.flatnonzero(segment == at)
            met = maps[at][offsets[rows] >> 3] >> (7 - (offsets[rows] & 7)) & 1
            out[rows] = met.all(axis=1)
        return out

    return may_repeat


def _keep_texts(shared, segments: int, hashes: int):
    """Rows whose text may repeat."""

    def keep(batches):
        may_repeat = _marker(shared, segments, hashes)
        for batch in batches:
            for part in slices([batch], "text"):
                digests = [hashlib.sha256(raw or b"").digest() for raw in byte_texts(part.column("text"))]
                yield part.filter(pa.array(may_repeat(digests)))

    return keep


def _mark_facts(shared, segments: int, hashes: int):
    """Facts with the answer of the sketch beside them."""

    def mark(batches):
        may_repeat = _marker(shared, segments, hashes)
        for batch in batches:
            if batch.num_rows:
                marks = may_repeat(batch.column("digest").to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks)], [*batch.schema.names, "possible"])

    return mark


def mask_counts(docs: DataFrame, labels: DataFrame, most_counters: int = MOST_COUNTERS) -> DataFrame:
    """(part, good, toxic, mask, n): documents per part, labels and mask of failed filters, bit i for the i-th letter."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    facts = stored(rows.mapInArrow(_judge, FACTS), "audit-facts")
    segments, hashes, bits = repeat_sketch(facts, most_counters)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    texts = rows.select("doc_id", "text").mapInArrow(_keep_texts(shared, segments, hashes), "doc_id long, text string")
    # Combined before the shuffle, so a text sends one row a task however often it occurs.
    groups = texts.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.min("doc_id").alias("doc_id"))
    firsts = groups.filter("doc_id IS NOT NULL").select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.lit(True).alias("own"))

    marked = facts.mapInArrow(_mark_facts(shared, segments, hashes), f"{FACTS}, possible boolean")
    cell = ["doc_id", "part", "mask"]
    # Added up before each join: neither one id nor one text on many rows meets it row by row.
    alone = marked.filter("doc_id IS NULL OR NOT possible").groupBy(cell).agg(F.count(F.lit(1)).alias("n"))
    held = marked.filter("doc_id IS NOT NULL AND possible").groupBy(*cell, "digest").agg(F.count(F.lit(1)).alias("n"))
    judged = held.join(firsts, ["doc_id", "digest"], "left").withColumn("mask", F.col("mask") + F.when(F.col("own"), 0).otherwise(16))
    counted = alone.unionByName(judged.groupBy(cell).agg(F.sum("n").alias("n"))).groupBy(cell).agg(F.sum("n").alias("n"))
    has = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").filter("doc_id IS NOT NULL")
    known = known.groupBy("doc_id").agg(has("quality"), has("toxic"))
    by_label = counted.filter("doc_id IS NOT NULL").join(known, "doc_id", "left").unionByName(
        counted.filter("doc_id IS NULL").withColumns({"quality": F.lit(False), "toxic": F.lit(False)})
    )
    good, toxic = (F.coalesce(c, F.lit(False)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic")))
    return by_label.groupBy("part", good, toxic, "mask").agg(F.sum("n").alias("n"))


def order_steps(spark: SparkSession) -> DataFrame:
    """(filter_order, step, before, own) of all 120 orders: bits of the earlier filters and of the step's own."""
    rows = []
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for step, at in enumerate(order, 1):
            rows.append(("".join(FILTERS[i] for i in order), step, before, 1 << at))
            before |= 1 << at
    return spark.createDataFrame(rows, "filter_order string, step int, before int, own int")


def audit_filters(docs: DataFrame, labels: DataFrame, most_counters: int = MOST_COUNTERS) -> DataFrame:
    """One row per part, order and step with the documents kept, removed, redundant and lost there."""
    spark = docs.sparkSession
    cells = stored(mask_counts(docs, labels, most_counters), "audit-cells")
    steps = order_steps(spark)
    # 80 pairs of earlier filters and own filter stand behind the 600 steps.
    pairs = sorted({(r.before, r.own) for r in steps.collect()})
    listed = F.array(*[F.struct(F.lit(b).alias("before"), F.lit(o).alias("own")) for b, o in pairs])
    dealt = cells.withColumn("pair", F.explode(listed)).select("*", "pair.before", "pair.own")
    mask, before, own = F.col("mask"), F.col("before"), F.col("own")
    fails, met = mask.bitwiseAND(own) != 0, mask.bitwiseAND(before) != 0
    removed = fails & ~met
    tally = lambda cond, name: F.sum(F.when(cond, F.col("n")).otherwise(0)).cast("long").alias(name)
    # A document goes at a filter in 120 / (number of filters it fails) of the 120 orders.
    share = F.when(fails, F.col("n") * F.lit(120) / F.bit_count(mask)).otherwise(0)
    sums = dealt.groupBy("part", "before", "own").agg(
        tally(~fails & ~met, "kept"), tally(removed, "removed"), tally(fails & met, "redundant"), tally(mask == own, "unique_fails"),
        tally(removed & F.col("good"), "good_lost"), tally(removed & F.col("toxic"), "toxic_lost"), F.sum(share).cast("long").alias("shapley"),
    )
    return sums.join(steps, ["before", "own"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


SQL = """
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, row_number() OVER () AS n FROM documents
), judged AS (
  SELECT doc_id, part, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper, min(doc_id) OVER (PARTITION BY text) AS first
  FROM docs
), fails AS (
  SELECT doc_id, part,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * upper > 3 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN coalesce(doc_id > first, false) THEN 16 ELSE 0 END AS mask,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = judged.doc_id AND l.quality = 1) AS good,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = judged.doc_id AND l.toxic = 1) AS toxic
  FROM judged
), letters(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT o.filter_order, s.step::INTEGER AS step, l.f, l.bit AS own,
    coalesce((SELECT sum(x.bit) FROM letters x WHERE instr(o.filter_order, x.f) < s.step), 0)::INTEGER AS before
  FROM orders o, (SELECT unnest(range(1, 6)) AS step) s JOIN letters l ON l.f = substr(o.filter_order, s.step::INTEGER, 1)
), counted AS (
  SELECT part, mask, good, toxic, count(*) AS n FROM fails GROUP BY ALL
), figures AS (
  SELECT c.part, s.filter_order, s.step, s.f,
    sum(CASE WHEN c.mask & (s.before | s.own) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN c.mask & s.own <> 0 AND c.mask & s.before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN c.mask & s.own <> 0 AND c.mask & s.before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN c.mask = s.own THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN c.mask & s.own <> 0 AND c.mask & s.before = 0 AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN c.mask & s.own <> 0 AND c.mask & s.before = 0 AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM counted c, steps s GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM figures
"""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from leafledger.llm import tier_packing
from leafledger.llm.plans import TOKENIZERS

PATH = f"{TOKENIZERS}/byte_bpe_50k.json"


@pytest.mark.parametrize("seed", range(40))
def test_pieces_cover_documents_once(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 5, 100, 128, 129, 600, 1024, 1500, 5000]) + rng.randrange(50) for _ in range(rng.randrange(1, 40))]
    cover = defaultdict(list)
    for sequence in tier_packing.pack_lengths(lengths):
        total = sum(p[2] for p in sequence)
        assert 0 < total <= 1024 and total & (total - 1) == 0  # powers of two need no padding
        for doc, start, length in sequence:
            cover[doc].append((start, length))
    for doc, n in enumerate(lengths):
        at = 0
        for start, length in sorted(cover[doc]):
            assert start == at and length > 0
            at += length
        assert at == n


def test_step_groups_are_even():
    sizes = [random.Random(k).choice([128, 256, 512, 1024]) for k in range(4_000)]
    groups = tier_packing.step_groups(sizes)
    loads = defaultdict(int)
    for size, group in zip(sizes, groups):
        loads[group] += size
    assert max(loads.values()) - min(loads.values()) <= 1024


def check(docs, pool):
    library = Tokenizer.from_file(PATH)
    rows = tier_packing.pack_documents(docs, PATH, pool).collect()
    whole = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        whole[r.doc_id].append(np.array(library.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4"))
    sequences, covered = defaultdict(list), defaultdict(int)
    for r in rows:
        ids = next(x for x in whole[r.doc_id] if len(x) == r.doc_tokens)
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length))
        covered[r.doc_id] += r.length
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert covered == {k: sum(map(len, v)) for k, v in whole.items()}


@pytest.mark.parametrize("pool", [3_000, tier_packing.POOL])
def test_documents(documents, pool):
    check(documents, pool)


def test_awkward_rows(awkward, nothing):
    check(awkward, 3_000)
    assert tier_packing.pack_documents(nothing, PATH).count() == 0

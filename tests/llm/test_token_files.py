import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from leafledger.llm import rans
from leafledger.llm.common import shared_folder
from leafledger.llm.plans import TOKENIZERS
from leafledger.llm.tokens import Encoder

PATHS = {"word": f"{TOKENIZERS}/word_bpe_49k.json", "byte": f"{TOKENIZERS}/byte_bpe_50k.json"}


@pytest.fixture(scope="module")
def coders():
    return {kind: (Encoder(path, kind), Tokenizer.from_file(path)) for kind, path in PATHS.items()}


ODD = st.lists(st.sampled_from(["a", "Thou", "'s", "ÉCOLE", "ß", "İ", "ΑΣ", "<|endoftext|>", " ", "\n", "\t", "\u00a0", "\u3000", "\x1c", "12", "!!", "é", "\0", "日本", "."]), max_size=14)


@pytest.mark.parametrize("kind", ["word", "byte"])
@settings(max_examples=300, deadline=None)
@given(parts=ODD)
def test_ids_equal_the_library(coders, kind, parts):
    own, library = coders[kind]
    text = "".join(parts)
    assert np.frombuffer(own.encode(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1, 31, 32, 33, rans.BLOCK, rans.BLOCK + 1, 100_003])
@pytest.mark.parametrize("spread", [1, 50, 49_408])
def test_round_trip_of_groups(n, spread):
    ids = np.random.default_rng(n).integers(0, spread, n).astype(np.uint32)
    assert (rans.decode_group(rans.encode_group(ids), n) == ids).all()


def test_a_changed_payload_is_noticed():
    ids = np.random.default_rng(1).integers(0, 5_000, 50_000).astype(np.uint32)
    row = rans.encode_group(ids)
    spoilt = bytearray(row["payload"])
    spoilt[400] ^= 1
    with pytest.raises(ValueError):
        rans.decode_group(row | {"payload": bytes(spoilt)}, len(ids))


def expected(rows, library):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_files_of_documents(spark, coders, documents, awkward, nothing):
    for docs in (documents, awkward):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        got = [tuple(r) for r in rans.ids_round_trip(docs, PATHS["word"]).collect()]
        assert sorted(got, key=lambda r: r[1]) == expected(rows, coders["word"][1])
    assert rans.ids_round_trip(nothing, PATHS["word"]).count() == 0


def test_groups_end_at_documents(spark, coders, documents):
    folder = shared_folder(spark, "small-groups")
    rans.write_ids(documents, PATHS["word"], folder, group=500)
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in rans.read_ids(spark, folder).collect()), key=lambda r: r[1])
    assert got == expected(rows, coders["word"][1])
    assert spark.read.parquet(folder).count() > 20

import zlib

from leafledger.llm import language_cnn

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = language_cnn.identify_languages(docs).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) > 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_rows_are_not_used(spark, documents):
    changed = documents.selectExpr("doc_id", "text", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 'zz' ELSE lang END AS lang")
    assert "zz" not in {r.lang_pred for r in language_cnn.identify_languages(changed).collect()}


def test_awkward_rows(awkward, nothing):
    rows = {r.doc_id: r for r in language_cnn.identify_languages(awkward).collect()}
    assert all(rows[k].lang_pred == "und" and rows[k].score == 0 for k in (2, 3, 4, 8))
    assert rows[1].lang_pred in {"en", "fr", "es", "de"} and not rows[None].held_out
    assert language_cnn.identify_languages(nothing).count() == 0
    unknown = language_cnn.identify_languages(awkward.selectExpr("doc_id", "text", "cast(null AS string) AS lang")).collect()
    assert {r.lang_pred for r in unknown} == {"und"}


def test_only_letters_are_letters(spark, documents):
    signs = {1: "½ ① ²", 2: "Ⅷ ⅷ ٣ _ 12", 3: "½ the", 4: "中文", 5: "…", 6: "½" * 400_000}
    rows = spark.createDataFrame(list(signs.items()), "doc_id long, text string")
    packed = language_cnn.fit_languages(documents)
    found = {r.doc_id: r.lang_pred for r in language_cnn.predict_languages(rows, packed).collect()}
    assert {k for k, v in found.items() if v == "und"} == {k for k, t in signs.items() if not any(c.isalpha() for c in t)} == {1, 2, 5, 6}


def test_a_corpus_of_very_long_texts_is_learned_from(spark, documents):
    long = documents.filter("length(text) > 200").selectExpr("doc_id", "lang", "repeat(concat(text, ' '), cast(ceil(70000 / length(text)) AS int)) AS text")
    rows = language_cnn.identify_languages(long).collect()
    lang = {r.doc_id: r.lang for r in long.select("doc_id", "lang").collect()}
    assert len(rows) > 100 and sum(r.lang_pred == lang[r.doc_id] for r in rows) > 0.95 * len(rows)


def test_windows_are_spread_over_the_whole_text():
    text = b"".join(bytes([k % 251]) * language_cnn.WINDOW for k in range(40_000)) + b"end"
    cut = language_cnn.spread_windows(text, 100)
    assert len(text) > 10_000_000 and cut.startswith(text[:256]) and cut.endswith(b"end") and len(cut) == 99 * 256 + 3
    assert language_cnn.spread_windows(b"short") == b"short" and language_cnn.spread_windows(b"") == b""
    places = [text.index(cut[k * 256 : (k + 1) * 256]) for k in range(99)]
    assert len(places) == 99

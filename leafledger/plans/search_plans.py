"""Registered queries: literal search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.unicode import fold
from ..operators import search as S
from ..session import shared_path
from ..streaming.tiers import add_run, read_index
from .bridge import EPOCH
from .catalog import Area

AREA = Area()

_STEPS = {
    "indexed": """SELECT vault_id, path, rev, content, strip_accents(lower(content)) AS f FROM notes WHERE NOT deleted AND kind = 'text' AND lower(path) LIKE '%.md'""",
    "totals": "SELECT vault_id, count(*) AS n, avg(greatest(length(f) - 2, 0)) AS mean FROM indexed GROUP BY vault_id",
    "terms": "SELECT vault_id, query_id, strip_accents(lower(query)) AS q FROM snippets WHERE length(query) BETWEEN 3 AND 200",
    "hits": """SELECT a.vault_id, a.query_id, a.q, i.path, i.rev, i.content, i.f, greatest(length(i.f) - 2, 0) AS dl,
  CASE WHEN len(list_filter(range(1, length(a.q)), lambda k: left(a.q, k) = right(a.q, k))) = 0 THEN (length(i.f) - length(replace(i.f, a.q, ''))) // length(a.q)
    ELSE len(list_filter(range(1, length(i.f) - length(a.q) + 2), lambda k: substr(i.f, k, length(a.q)) = a.q)) END AS tf
FROM terms a JOIN indexed i ON a.vault_id = i.vault_id AND contains(i.f, a.q)""",
    "freq": "SELECT vault_id, query_id, count(*) AS df FROM hits GROUP BY vault_id, query_id",
    "scored": """SELECT h.*, round(-(greatest(ln((t.n - d.df + 0.5) / (d.df + 0.5)), 1e-6) * h.tf * 2.2 / (h.tf + 1.2 * (0.25 + 0.75 * h.dl / t.mean))), 6) AS score
FROM hits h JOIN totals t ON h.vault_id = t.vault_id JOIN freq d ON h.vault_id = d.vault_id AND h.query_id = d.query_id""",
    "placed": "SELECT *, row_number() OVER (PARTITION BY vault_id, query_id ORDER BY score, encode(path)) AS rank FROM scored",
    "spotted": "SELECT *, list_filter(range(1, length(f) - length(q) + 2), lambda k: substr(f, k, length(q)) = q) AS at_ FROM placed WHERE rank <= 20",
}
# The window of 66 characters around the hit whose window shows most hits, the first of equal ones.
_WINDOWS = {
    "windows": "SELECT *, list_transform(at_, lambda p: greatest(p - greatest(66 - length(q), 0) // 2, 1)) AS starts FROM spotted",
    "shown": "SELECT *, list_transform(starts, lambda s: len(list_filter(at_, lambda p: p >= s AND p <= s + greatest(66 - length(q), 0)))) AS counts FROM windows",
    "cut": "SELECT *, starts[list_position(counts, list_max(counts))] AS s FROM shown",
}
_STEPS |= _WINDOWS
_SQL = f"""SELECT vault_id, query_id, CAST(rank AS INT) AS rank, path, concat('"{EPOCH}.', CAST(rev AS STRING), '"') AS etag, score,
  concat(CASE WHEN s > 1 THEN '…' ELSE '' END, substr(content, s, 66), CASE WHEN s + 66 <= length(content) THEN '…' ELSE '' END) AS snippet
FROM cut"""


@AREA.add("f5_f6_f7_o4_search_notes", "snippets", "notes", steps=_STEPS, sql=_SQL)
def _search(queries, notes):
    return S.search_notes(queries, notes, EPOCH)


@AREA.add("j1_search_by_postings", "snippets", "notes", steps=_STEPS, sql=_SQL)
def _search_index(queries, notes):
    return S.search_notes(queries, notes, EPOCH, postings=S.build_postings(S.indexed_notes(notes)))


# Letters written as a base and a combining mark, and what they stand for.
_MARKED = (("é", "é"), ("ñ", "ñ"), ("ü", "ü"), ("ó", "ó"))


def _in_sql(text: str) -> str:
    for whole, parts in _MARKED:
        text = f"replace({text}, '{whole}', '{parts}')"
    return text


@AREA.add(
    "f7_snippets_of_marked_text", "notes",
    steps={
        "spotted": """SELECT *, list_filter(range(1, length(f) - length(q) + 2), lambda k: substr(f, k, length(q)) = q) AS at_
FROM (SELECT vault_id, path, content, strip_accents(lower(content)) AS f, substr(strip_accents(lower(content)), 1 + length(content) // 2, 5) AS q
  FROM notes WHERE NOT deleted AND kind = 'text' AND lower(path) LIKE '%.md' AND length(content) >= 10) t""",
    } | _WINDOWS,
    sql=f"""SELECT vault_id, path, concat(CASE WHEN s > 1 THEN '…' ELSE '' END, {_in_sql('substr(content, s, 66)')}, CASE WHEN s + 66 <= length(content) THEN '…' ELSE '' END) AS snippet FROM cut""",
)
def _marked(notes):
    """Five characters from the middle of each note, looked for in its text with letters taken apart: the window is that of the plain text."""
    plain = S.indexed_notes(notes).filter(F.char_length("content") >= 10)
    asked = plain.withColumn("phrase", F.substring(F.col("folded"), (F.lit(1) + F.floor(F.char_length("content") / 2)).cast("int"), F.lit(5)))
    parted = F.col("content")
    for whole, parts in _MARKED:
        parted = F.replace(parted, F.lit(whole), F.lit(parts))
    return asked.select("vault_id", "path", S.snippet(parted, fold(parted), F.col("phrase")).alias("snippet"))


@AREA.add(
    "a2_p19_search_coverage", "notes",
    sql="""SELECT vault_id, count(*) FILTER (NOT deleted AND kind = 'text' AND lower(path) LIKE '%.md') AS indexed_files,
  count(*) FILTER (NOT deleted AND kind = 'blob' AND size > 1000000 AND lower(path) LIKE '%.md') AS unindexed_large_files FROM notes GROUP BY vault_id""",
)
def _coverage(notes):
    return S.search_coverage(notes)


@AREA.add(
    "t26_update_postings", "notes",
    steps={
        "after_": "SELECT vault_id, path, CASE WHEN substr(hash,1,1) = '3' THEN concat(content, ' changed') ELSE content END AS content, deleted OR substr(hash,1,1) = '4' AS deleted, kind FROM notes",
        "folded": "SELECT vault_id, path, strip_accents(lower(content)) AS f FROM after_ WHERE NOT deleted AND kind = 'text' AND lower(path) LIKE '%.md'",
    },
    sql="""SELECT vault_id, path, CAST(count(DISTINCT gram) AS BIGINT) AS grams, CAST(count(*) AS BIGINT) AS tf FROM (
  SELECT vault_id, path, unnest(list_concat(regexp_extract_all(f, '(?s)...'), regexp_extract_all(substr(f, 2), '(?s)...'), regexp_extract_all(substr(f, 3), '(?s)...'))) AS gram FROM folded) t GROUP BY vault_id, path""",
)
def _update(notes):
    first = F.substring("hash", 1, 1)
    changed = notes.filter(first.isin("3", "4"))
    after = notes.withColumns(
        {"content": F.when(first == "3", F.concat("content", F.lit(" changed"))).otherwise(F.col("content")),
         "deleted": F.col("deleted") | (first == "4")}
    )
    postings = S.update_postings(S.build_postings(S.indexed_notes(notes)), changed, after)
    return postings.groupBy("vault_id", "path").agg(F.count(F.lit(1)).alias("grams"), F.sum("tf").alias("tf"))


@AREA.add(
    "t26_tiered_index", "notes",
    steps={
        "after_": """SELECT vault_id, path, CASE WHEN seq % 6 < 2 THEN concat(content, ' changed') ELSE content END AS content, deleted OR seq % 12 = 5 AS deleted, kind FROM notes""",
        "folded": "SELECT vault_id, path, strip_accents(lower(content)) AS f FROM after_ WHERE NOT deleted AND kind = 'text' AND lower(path) LIKE '%.md'",
    },
    sql="""SELECT vault_id, path, CAST(count(DISTINCT gram) AS BIGINT) AS grams, CAST(count(*) AS BIGINT) AS tf FROM (
  SELECT vault_id, path, unnest(list_concat(regexp_extract_all(f, '(?s)...'), regexp_extract_all(substr(f, 2), '(?s)...'), regexp_extract_all(substr(f, 3), '(?s)...'))) AS gram FROM folded) t GROUP BY vault_id, path""",
)
def _tiered(notes):
    """Nine batches in tiers of three: six of new notes, then two of changed and one of deleted ones."""
    root = shared_path(notes.sparkSession, "tiered-index")
    part = lambda k: notes.filter(F.col("seq") % 6 == k)
    changed = lambda rows: rows.withColumn("content", F.concat("content", F.lit(" changed")))
    gone = notes.filter(F.col("seq") % 12 == 5).withColumn("deleted", F.lit(True))
    for number, rows in enumerate([*[part(k) for k in range(6)], changed(part(0)), changed(part(1)), gone]):
        add_run(root, number, S.build_postings(S.indexed_notes(rows)), rows, fan=3)
    return read_index(notes.sparkSession, root).groupBy("vault_id", "path").agg(F.count(F.lit(1)).alias("grams"), F.sum("tf").alias("tf"))

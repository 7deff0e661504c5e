"""Registered queries: column functions and path rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import paths as P
from ..functions.bases import validate_bases
from ..functions.markdown import append_under_heading, markdown_sections
from ..functions.unicode import fold, path_key, utf16_length, utf16_slice
from ..operators.search import build_postings, indexed_notes
from .bridge import EPOCH, VIEWS
from .catalog import Area

AREA = Area()

VIEWS["raw_paths"] = """
SELECT doc_id AS id, CASE doc_id % 9 WHEN 0 THEN concat('/', source) WHEN 1 THEN concat(source, '//x.md')
  WHEN 2 THEN concat(source, '/../x.md') WHEN 3 THEN concat(source, '/./x') WHEN 4 THEN text
  WHEN 5 THEN replace(text, chr(10), '/') WHEN 6 THEN concat(source, chr(9), lang)
  WHEN 7 THEN concat(source, '/', lang, '...md') ELSE concat(source, '/', upper(substr(text, 1, 9)), '.MD') END AS path
FROM documents"""

VIEWS["many_paths"] = """
SELECT path, size FROM notes
UNION ALL
SELECT concat(CASE p_partkey % 14 WHEN 0 THEN '.obsidian/plugins/vault-sync/' WHEN 1 THEN '.obsidian/plugins/'
    WHEN 2 THEN '.obsidian/themes/' WHEN 3 THEN '.Obsidian/' WHEN 4 THEN '.obsidian/cache/' WHEN 5 THEN '.trash/'
    WHEN 6 THEN '.vault-sync/' WHEN 7 THEN '.obsidian/workspace' WHEN 8 THEN 'Files/' WHEN 9 THEN 'Files/sub/'
    WHEN 10 THEN '.obsidian/plugins/tool/node_modules/' WHEN 11 THEN '.obsidian/snippets/' WHEN 12 THEN '.obsidian/plugins/tool/'
    ELSE '' END,
    CASE p_size % 11 WHEN 0 THEN 'manifest.json' WHEN 1 THEN 'main.js' WHEN 2 THEN 'app.json' WHEN 3 THEN 'hotkeys.json'
    WHEN 4 THEN 'appearance.json' WHEN 5 THEN 'Photo.JPG' WHEN 6 THEN 'notes.md.backup' WHEN 7 THEN '.note.md.icloud'
    WHEN 8 THEN '.DS_Store' WHEN 9 THEN 'plan.canvas' ELSE 'data.csv' END) AS path,
  CASE WHEN p_partkey % 5 = 0 THEN 25000001 WHEN p_partkey % 5 = 1 THEN 1000001 WHEN p_partkey % 5 = 2 THEN 25000000
    WHEN p_partkey % 5 = 3 THEN 1000000 ELSE 12 END AS size
FROM part"""

_VALID = r"""(strlen(p) <= 512 AND length(p) - length(replace(p, '/', '')) < 32 AND NOT regexp_matches(p, '(^|/)(\.{0,2})(/|$)')
  AND NOT regexp_matches(p, '[\\\x00-\x1F\x7F-\x{9F}]'))"""


@AREA.add(
    "p1_normalize_paths", "raw_paths", steps={"normal": "SELECT id, nfc_normalize(path) AS p FROM raw_paths"},
    sql=f"SELECT id, CASE WHEN {_VALID} THEN p END AS norm_path, CASE WHEN {_VALID} THEN lower(p) END AS path_key, "
        f"CASE WHEN NOT {_VALID} THEN 'invalid_path' END AS reason FROM normal",
)
def _normalize(paths):
    return P.normalize_paths(paths).drop("path")


@AREA.add("p2_path_key", "raw_paths", sql="SELECT id, lower(nfc_normalize(path)) AS path_key FROM raw_paths")
def _key(paths):
    return paths.select("id", path_key(F.col("path")).alias("path_key"))


_CLASS = "CASE WHEN lower(path) LIKE '%.md' THEN 'markdown' WHEN lower(path) LIKE '%.canvas' THEN 'canvas' WHEN lower(path) LIKE '%.base' THEN 'base' ELSE 'other' END"


@AREA.add(
    "p3_p4_classify_and_route", "many_paths",
    sql=f"""SELECT path, {_CLASS} AS kind, size, CASE WHEN {_CLASS} <> 'other' AND size <= 1000000 THEN 'text'
  WHEN size <= 25000000 THEN 'blob' ELSE 'blob_too_large' END AS route FROM many_paths""",
)
def _classify(paths):
    return paths.select("path", P.classify_path(F.col("path")).alias("kind"), "size", P.storage_kind(F.col("path"), F.col("size")).alias("route"))


def _scope_sql(enabled: bool) -> str:
    settings = "'excluded'"
    if enabled:
        settings = r"""CASE
    WHEN regexp_matches(k, '^\.obsidian/(workspace[^/]*\.json|graph\.json)(/|$)') OR k LIKE '.obsidian/cache%'
      OR k LIKE '.obsidian/plugins/vault-sync/%' OR k LIKE '%/node\_modules/%' ESCAPE '\' OR k LIKE '%/node\_modules' ESCAPE '\' THEN 'excluded'
    WHEN regexp_matches(k, '^\.obsidian/(appearance|app|core-plugins|hotkeys|types|community-plugins)\.json$')
      OR regexp_matches(k, '^\.obsidian/(themes|snippets)/')
      OR regexp_matches(k, '^\.obsidian/plugins/[^/]+/(manifest\.json|main\.js|styles\.css|data\.json)$')
      THEN CASE WHEN size > 25000000 THEN 'unsupported' ELSE 'blob' END
    ELSE 'excluded' END"""
    return rf"""
SELECT path, size, CASE
  WHEN k LIKE '.trash/%' OR k LIKE '.vault-sync/%' OR regexp_matches(k, '(^|/)\.ds_store$') OR k LIKE '%.icloud' THEN 'excluded'
  WHEN k LIKE '.obsidian/%' THEN {settings}
  WHEN {_CLASS} <> 'other' THEN CASE WHEN size > 25000000 THEN 'unsupported' WHEN size <= 1000000 THEN 'text' ELSE 'blob' END
  WHEN regexp_matches(k, '\.(png|jpg|jpeg|gif|webp|svg|pdf|mp3|m4a|wav|mp4|mov|webm|json|csv|txt)$')
    THEN CASE WHEN size > 25000000 THEN 'unsupported' ELSE 'blob' END
  ELSE 'excluded' END AS scope
FROM (SELECT path, size, lower(path) AS k FROM many_paths) t"""


@AREA.add("p5_enrollment_scope", "many_paths", sql=_scope_sql(False))
def _scope(paths):
    return paths.select("path", "size", P.enrollment_scope(F.col("path"), F.col("size")).alias("scope"))


@AREA.add("p6_settings_scope", "many_paths", sql=_scope_sql(True))
def _settings(paths):
    policy = P.ScopePolicy(enabled=True)
    return paths.select("path", "size", P.enrollment_scope(F.col("path"), F.col("size"), policy).alias("scope"))


@AREA.add(
    "p10_etags", "notes",
    sql=f"""SELECT vault_id, path, concat('"{EPOCH}.', CAST(rev AS STRING), '"') AS etag, '{EPOCH}' AS epoch, rev FROM notes""",
)
def _etags(notes):
    tagged = notes.select("vault_id", "path", I.format_etag(F.lit(EPOCH), F.col("rev")).alias("etag"))
    return tagged.select("*", I.etag_epoch(F.col("etag")).alias("epoch"), I.etag_rev(F.col("etag")).alias("rev"))


_UUID_STEP = {
    "made": """SELECT event_id, MS(ts) AS at_ms, printf('%012x', MS(ts)) AS t, SHA(props) AS e FROM events""",
    "keys": """SELECT event_id, at_ms, concat(substr(t,1,8), '-', substr(t,9,4), '-7', substr(e,1,3), '-',
  substr('89ab', 1 + CAST(concat('0x', substr(e,4,1)) AS INT) % 4, 1), substr(e,5,3), '-', substr(e,8,12)) AS op_key FROM made""",
}
_NOW = 1706400000000


@AREA.add("f10_uuid7", "events", steps=_UUID_STEP, sql="SELECT event_id, op_key, at_ms AS key_ms FROM keys")
def _uuid7(events):
    keyed = events.select("event_id", I.uuid7_from(F.expr("unix_micros(CAST(ts AS TIMESTAMP)) div 1000"), F.sha2("props", 256)).alias("op_key"))
    return keyed.select("*", I.uuid7_ms(F.col("op_key")).alias("key_ms"))


@AREA.add(
    "p15_key_window", "events", steps=_UUID_STEP,
    sql=f"SELECT event_id, at_ms BETWEEN {_NOW} - 2160000000 AND {_NOW} + 300000 AS accepted, true AS opaque_accepted FROM keys",
)
def _window(events):
    key = I.uuid7_from(F.expr("unix_micros(CAST(ts AS TIMESTAMP)) div 1000"), F.sha2("props", 256))
    opaque = F.concat(F.lit("opaque-"), F.col("event_id"))
    return events.select("event_id", I.key_window(key, _NOW).alias("accepted"), I.key_window(opaque, _NOW).alias("opaque_accepted"))


@AREA.add(
    "p16_request_bounds", "documents",
    sql="""SELECT doc_id, CASE WHEN NOT length(concat(lang, source)) BETWEEN 8 AND 128 THEN 'invalid_request' END AS key_reason,
  CASE WHEN length(CASE WHEN doc_id % 3 = 0 THEN text ELSE substr(text, 1, CAST(doc_id % 260 AS INT)) END) < 3 THEN 'query_too_short'
    WHEN length(CASE WHEN doc_id % 3 = 0 THEN text ELSE substr(text, 1, CAST(doc_id % 260 AS INT)) END) > 200 THEN 'query_too_long' END AS query_reason,
  coalesce(CASE WHEN doc_id % 4 > 0 THEN doc_id % 60 END, 20) AS result_limit,
  CASE WHEN NOT coalesce(CASE WHEN doc_id % 4 > 0 THEN doc_id % 60 END, 20) BETWEEN 1 AND 50 THEN 'invalid_request' END AS limit_reason
FROM documents""",
)
def _bounds(documents):
    asked = documents.select(
        "doc_id", F.concat("lang", "source").alias("op_key"), F.expr("CASE WHEN doc_id % 3 = 0 THEN text ELSE substr(text, 1, CAST(doc_id % 260 AS INT)) END").alias("query"),
        F.when(F.col("doc_id") % 4 > 0, F.col("doc_id") % 60).alias("result_limit"),
    )
    return I.validate_requests(asked).drop("op_key", "query")


@AREA.add(
    "p20_placeholders", "many_paths",
    sql=r"""SELECT path, CASE WHEN path LIKE '%.icloud' THEN regexp_replace(regexp_replace(path, '\.icloud$', ''), '(^|/)\.([^/]+)$', '\1\2') END AS source
FROM many_paths""",
)
def _placeholders(paths):
    return paths.select("path", P.placeholder_source(F.col("path")).alias("source"))


@AREA.add("f1_f17_hash_and_bytes", "documents", sql="SELECT doc_id, SHA(text) AS hash, CAST(BLEN(text) AS BIGINT) AS bytes FROM documents")
def _hash(documents):
    return documents.select("doc_id", I.sha256(F.col("text")).alias("hash"), F.octet_length("text").cast("long").alias("bytes"))


@AREA.add("f3_search_fold", "documents", sql="SELECT doc_id, SHA(strip_accents(lower(text))) AS fold_hash FROM documents")
def _fold(documents):
    return documents.select("doc_id", F.sha2(fold(F.col("text")), 256).alias("fold_hash"))


@AREA.add(
    "f4_build_postings", "notes",
    steps={"folded": "SELECT vault_id, path, strip_accents(lower(content)) AS f FROM notes WHERE NOT deleted AND kind = 'text' AND lower(path) LIKE '%.md'"},
    sql="""SELECT vault_id, gram, CAST(count(DISTINCT path) AS BIGINT) AS notes, CAST(count(*) AS BIGINT) AS occurrences FROM (
  SELECT vault_id, path, unnest(list_concat(regexp_extract_all(f, '(?s)...'), regexp_extract_all(substr(f, 2), '(?s)...'), regexp_extract_all(substr(f, 3), '(?s)...'))) AS gram FROM folded) t GROUP BY vault_id, gram""",
)
def _postings(notes):
    postings = build_postings(indexed_notes(notes))
    return postings.groupBy("vault_id", "gram").agg(F.count(F.lit(1)).alias("notes"), F.sum("tf").alias("occurrences"))


@AREA.add(
    "f8_op_fingerprint", "ops",
    sql=f"""SELECT vault_id, arrival, SHA(concat('[1,"{EPOCH}",', CAST(to_json(client_id) AS STRING), ',"', op, '",[', CAST(to_json(path) AS STRING), '],',
  CASE WHEN expected_rev > 0 THEN concat('{{"kind":"match","etag":"\\"{EPOCH}.', CAST(expected_rev AS STRING), '\\""}}') ELSE '{{"kind":"absent"}}' END,
  ',"', payload_hash, '",', CAST(BLEN(payload) AS STRING), ']')) AS fingerprint FROM ops""",
)
def _fingerprint(ops):
    kind = F.when(F.col("expected_rev") > 0, "match").otherwise("absent")
    return ops.select(
        "vault_id", "arrival",
        I.op_fingerprint(
            F.lit(EPOCH), F.col("client_id"), F.col("op"), [F.col("path")],
            I.precondition_json(kind, F.lit(EPOCH), F.col("expected_rev")), F.col("payload_hash"), F.octet_length("payload"),
        ).alias("fingerprint"),
    )


@AREA.add(
    "f9_command_identity", "ops",
    sql="""SELECT vault_id, arrival, SHA(CASE arrival % 4
  WHEN 0 THEN concat('{"to":', CAST(to_json(path) AS STRING), '}')
  WHEN 1 THEN concat('{"source_rev":', CAST(expected_rev AS STRING), ',"as_conflict_copy":', CASE WHEN arrival % 8 = 1 THEN 'true' ELSE 'false' END, '}')
  WHEN 2 THEN concat('{"heading":', CAST(to_json(path) AS STRING), ',"content":', CAST(to_json(payload) AS STRING), '}')
  ELSE payload END) AS payload_hash FROM ops""",
)
def _identity(ops):
    kind = F.col("arrival") % 4
    op = F.when(kind == 0, "rename").when(kind == 1, "restore").otherwise("append")
    text = I.command_identity(
        op, F.col("path"), F.col("expected_rev"), F.col("arrival") % 8 == 1, F.when(kind == 2, F.col("path")), F.col("payload")
    )
    return ops.select("vault_id", "arrival", F.sha2(text, 256).alias("payload_hash"))


@AREA.add("f11_utc_days", "ops", sql="SELECT vault_id, arrival, at_ms // 86400000 * 86400000 AS day_start, at_ms // 86400000 * 86400000 + 86400000 AS day_end FROM ops")
def _days(ops):
    day = I.utc_day(F.col("at_ms"))
    return ops.select("vault_id", "arrival", day.alias("day_start"), (day + 86_400_000).alias("day_end"))


_NAME_STEPS = {
    "named": r"""SELECT path, size, regexp_extract(path, '^(.*/)?([^/]*)$', 1) AS dir, regexp_extract(path, '([^/]*)$', 1) AS base,
  lower(path) LIKE '.obsidian/%' AS own FROM many_paths""",
    "flat": r"""SELECT path, size, own, CASE WHEN own THEN 'Settings conflicts/' ELSE dir END AS dir,
  CASE WHEN own THEN replace(regexp_replace(path, '^[^/]*/', ''), '/', ' — ') ELSE base END AS name FROM named""",
    "cut": r"""SELECT *, CASE WHEN regexp_matches(name, '.\.[^.]*$') THEN regexp_extract(name, '^(.+)\.[^.]*$', 1) ELSE name END AS stem FROM flat""",
    "ext": "SELECT *, substr(name, length(stem) + 1) AS e FROM cut",
    "copies": r"""SELECT path, concat(dir, stem, ' (conflict a_b_c 2024-01-28 0000 r', CAST(size AS STRING), ')', e,
  CASE WHEN own AND NOT regexp_matches(lower(e), '^\.(md|canvas|base|png|jpg|jpeg|gif|webp|svg|pdf|mp3|m4a|wav|mp4|mov|webm|json|csv|txt)$') THEN '.txt' ELSE '' END) AS copy FROM ext""",
}


@AREA.add("f12_f14_conflict_names", "many_paths", steps=_NAME_STEPS, sql="SELECT path, copy FROM copies")
def _conflicts(paths):
    name = P.conflict_name(F.col("path"), F.lit(" a/b:c "), F.col("size"), F.lit(_NOW))
    return paths.select("path", name.alias("copy"))


@AREA.add(
    "f13_recovery_names", "raw_paths",
    steps={
        "named": "SELECT id, concat(repeat('é', CAST(200 + id % 90 AS INT)), ' (conflict).md') AS copy, SHA(path) AS h FROM raw_paths",
        "parts": r"""SELECT id, h, regexp_replace(copy, '\.[^.]*$', '') AS stem, '.md' AS e, 512 - strlen(concat(' (recovery ', substr(h,1,16), ')', '.md')) AS room FROM named""",
        "fitted": "SELECT *, list_max(list_filter(range(0, length(stem) + 1), lambda n: strlen(substr(stem, 1, n)) <= room)) AS kept FROM parts",
    },
    sql="SELECT id, concat(substr(stem, 1, kept), ' (recovery ', substr(h,1,16), ')', e) AS recovery FROM fitted",
)
def _recovery(paths):
    copy = F.concat(F.repeat(F.lit("é"), (F.lit(200) + F.col("id") % 90).cast("int")), F.lit(" (conflict).md"))
    return paths.select("id", P.recovery_name(copy, F.sha2("path", 256)).alias("recovery"))


@AREA.add(
    "f15_utf16_slice", "documents",
    steps={"wide": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('😀', text) ELSE text END AS t FROM documents"},
    sql="""SELECT doc_id, SHA(CASE WHEN doc_id % 3 = 0 THEN substr(t, 2, CAST(doc_id % 500 AS INT)) ELSE substr(t, 3, CAST(doc_id % 500 AS INT)) END) AS piece,
  CAST(length(t) + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS units FROM wide""",
)
def _utf16(documents):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("😀"), "text")).otherwise(F.col("text"))
    piece = utf16_slice(text, F.lit(2), F.col("doc_id") % 500)
    return documents.select("doc_id", F.sha2(piece, 256).alias("piece"), utf16_length(text).alias("units"))


VIEWS["headed"] = """
SELECT doc_id, concat('# ', lang, chr(10), text, chr(10), '## ', source, chr(10), substr(text, 1, 40), chr(10),
  '### deep ###', chr(10), 'x', chr(10), CASE WHEN doc_id % 2 = 0 THEN concat('# ', source, chr(10), 'tail') ELSE 'no end' END) AS content
FROM documents"""


@AREA.add(
    "f16_markdown_sections", "headed",
    steps={
        "lines": "SELECT doc_id, content, string_split(content, chr(10)) AS ls FROM headed",
        "each": "SELECT doc_id, content, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM lines",
        "placed": """SELECT *, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start FROM each""",
        "heads": r"""SELECT doc_id, content, CAST(n - 1 AS INT) AS line_no, start, CAST(length(regexp_extract(line, '^(#+)', 1)) AS INT) AS level,
  trim(regexp_replace(regexp_replace(line, '^#+ +', ''), '[ \t]+#+[ \t]*$', '')) AS heading FROM placed WHERE line LIKE '#%'""",
    },
    sql="""SELECT a.doc_id, a.line_no, a.level, a.heading, a.start, coalesce(min(b.start), CAST(length(a.content) AS INT)) AS stop
FROM heads a LEFT JOIN heads b ON a.doc_id = b.doc_id AND b.start > a.start AND b.level <= a.level
GROUP BY a.doc_id, a.line_no, a.level, a.heading, a.start, a.content""",
)
def _sections(headed):
    return markdown_sections(headed)


@AREA.add(
    "f16_append_under_heading", "headed",
    sql="""SELECT doc_id, CASE WHEN heading = 'missing' THEN 'heading_not_found' END AS reason,
  CASE WHEN heading = 'missing' THEN NULL ELSE SHA(CASE WHEN stop = 0 THEN concat(content, chr(10), 'ADD')
    ELSE concat(substr(content, 1, stop), 'ADD', chr(10), substr(content, stop + 1)) END) END AS new_hash
FROM (SELECT doc_id, content, CASE WHEN doc_id % 5 = 0 THEN 'missing' ELSE 'deep' END AS heading,
  CASE WHEN doc_id % 2 = 0 THEN length(regexp_replace(content, '# [^#]*$', '')) ELSE 0 END AS stop FROM headed) t""",
)
def _append_heading(headed):
    asked = headed.withColumns({"heading": F.when(F.col("doc_id") % 5 == 0, "missing").otherwise("deep"), "addition": F.lit("ADD")})
    return append_under_heading(asked).select("doc_id", "reason", F.sha2("new_content", 256).alias("new_hash"))


@AREA.add(
    "f18_json_row_bytes", "revisions",
    sql="""SELECT vault_id, path, rev, CAST(BLEN(concat('[', CAST(to_json(path) AS STRING), ',', CAST(rev AS STRING), ',"', hash, '",', CAST(size AS STRING), ',"', kind, '",',
  coalesce(CAST(to_json(content) AS STRING), 'null'), ',', CASE WHEN blob_hash IS NULL THEN 'null' ELSE concat('"', blob_hash, '"') END, ',',
  CASE WHEN deleted THEN '1' ELSE '0' END, ',"', origin, '",', CAST(at_ms AS STRING), ']')) AS BIGINT) AS bytes FROM revisions""",
)
def _json_bytes(revisions):
    from ..operators.lifecycle import revision_bytes

    return revisions.select("vault_id", "path", "rev", revision_bytes().alias("bytes"))


@AREA.add(
    "f22_safe_integers", "lineitem",
    sql="SELECT l_returnflag, count(*) FILTER (l_orderkey * 1000000000000 BETWEEN 0 AND 9007199254740991) AS safe, count(*) AS total FROM lineitem GROUP BY 1",
)
def _safe(lineitem):
    scaled = F.col("l_orderkey") * F.lit(1_000_000_000_000)
    return lineitem.groupBy("l_returnflag").agg(F.count_if(I.safe_integer(scaled)).alias("safe"), F.count(F.lit(1)).alias("total"))


VIEWS["bases"] = """
SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN concat('views:', chr(10), '  - type: table', chr(10), '    name: ', source, chr(10))
  WHEN 1 THEN concat('filters:', chr(10), '  and:', chr(10), '    - ', lang, chr(10))
  WHEN 2 THEN concat('filters:', chr(10), '  and: []', chr(10)) WHEN 3 THEN concat('a: 1', chr(10), 'a: 2', chr(10))
  WHEN 4 THEN concat('a: &x 1', chr(10), 'b: *x', chr(10)) WHEN 5 THEN concat('a: 1', chr(10), '---', chr(10), 'b: 2', chr(10))
  WHEN 6 THEN 'views: [{name: x}]' ELSE concat('note: >', chr(10), '  ', replace(text, chr(10), ' '), chr(10)) END AS content
FROM documents"""


@AREA.add(
    "f21_validate_bases", "bases",
    sql="""SELECT doc_id, doc_id % 8 IN (0, 1, 7) AS valid, CASE doc_id % 8 WHEN 4 THEN 'YAML anchors are not supported'
  WHEN 5 THEN 'Base YAML must contain one document' WHEN 3 THEN 'Base YAML syntax is invalid'
  WHEN 2 THEN 'Base structure is invalid' WHEN 6 THEN 'Base structure is invalid' END AS diagnostic FROM bases""",
)
def _bases(bases):
    return validate_bases(bases).select("doc_id", "valid", F.get("diagnostics", F.lit(0)).alias("diagnostic"))

"""Payloads as they are stored, payloads out of the answers of models, and the ledger after writes and deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json_tree import json_leaves, let, valid_json, without_keys
from ..sources.ledger import LEDGER_SQL, ledger, table
from ..sources.store import append, current, delete, shared_folder
from .payloads import SPACE

# Keys of raw text, keys that the payload of a failure may have.
PRIVATE_KEYS = ("raw", "raw_text", "source_text", "ocr_text")
ERROR_KEYS = ("document_type", "error", "method", "warnings", "extraction_source")


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")


def safe_stem(name: Column) -> Column:
    """A file name without its suffix, safe in paths: 80 characters at most, ``document`` if nothing is left."""
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(?<=[^.])\.[^.]+$", ""), r"[^\p{L}\p{N}_-]+", "_")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(stem, r"^[._]+|[._]+$", ""), 1, 80), F.lit("")), F.lit("document"))


def entry_path(kind: Column, saved_at: Column, name: Column) -> Column:
    """Folder by kind, and a file name by the second and the name of the source."""
    return F.concat(kind, F.lit("/"), F.date_format(F.to_utc_timestamp(saved_at, F.current_timezone()), "yyyyMMdd'T'HHmmss'Z'"), F.lit("_"), safe_stem(name), F.lit(".json"))


def _with_member(text: Column, key: str, value: Column) -> Column:
    return let(text, lambda x: F.concat(F.substr(x, F.lit(1), F.length(x) - 1), F.when(x != "{}", ",").otherwise(""), F.lit(f'"{key}":'), value, F.lit("}")))


def stored_payload(payload: Column, status: Column, message: Column, meta: Column, keep_text: bool = False) -> Column:
    """A payload as the ledger keeps it: no raw text at any depth (unless ``keep_text``), ``meta`` (a struct) as its ``_meta``.

    Rows that failed keep five keys of the root, and get the message as ``error`` if they have none. What is no JSON object counts as {}.
    """
    text = F.coalesce(F.when(F.startswith(F.ltrim(payload), F.lit("{")), payload), F.lit("{}"))
    private = () if keep_text else PRIVATE_KEYS
    good = without_keys(text, private, root=("_meta",), any_case=True)
    bad = F.coalesce(without_keys(text, private, only=ERROR_KEYS, any_case=True), F.lit("{}"))
    quoted = F.regexp_replace(F.to_json(F.struct(message.alias("m"))), r'^\{"m":|\}$', "")
    told = lambda x: (message != "") & ~F.coalesce(F.array_contains(F.json_object_keys(x), "error"), F.lit(False))
    bad = let(bad, lambda x: F.when(told(x), _with_member(x, "error", quoted)).otherwise(x))
    kept = F.coalesce(F.when(F.coalesce(status == "ok", F.lit(True)), good).otherwise(bad), F.lit("{}"))
    return _with_member(kept, "_meta", F.to_json(meta, {"ignoreNullFields": "false"}))


def json_of_answer(answer: Column) -> Column:
    """state and text of the JSON object in an answer of a model.

    The object goes from the first ``{`` to the last ``}`` of the first fenced block, or of the answer where none is fenced. ``as is``: it is
    JSON. ``repaired``: it is after commas before a closing bracket went, all of them at once. Else ``broken``, ``no object`` or ``empty``
    (null too), without a text. Objects that name a key twice are broken.
    """
    fence = r"(?i)```(?:json)?\s*([\s\S]*?)```"
    inside = F.when(F.regexp_like(answer, F.lit(fence)), F.regexp_extract(answer, fence, 1)).otherwise(answer)
    said = lambda state, text: F.struct(F.lit(state).alias("state"), text.alias("text"))
    mended = lambda blob: let(valid_json(F.regexp_replace(blob, r",(?=[,\s]*+[}\]])", "")), lambda x: F.when(x.isNotNull(), said("repaired", x)).otherwise(said("broken", x)))
    found = let(F.nullif(F.regexp_extract(inside, r"(?s)\{.*\}", 0), F.lit("")), lambda blob: F.when(blob.isNull(), said("no object", blob)).when(valid_json(blob).isNotNull(), said("as is", blob)).otherwise(mended(blob)))
    return F.when(_stripped(F.coalesce(answer, F.lit(""))) == "", said("empty", F.lit(None).cast("string"))).otherwise(found)


def items_of(payload: Column, path: str) -> Column:
    """The objects of a list as JSON texts. What is no list has none; other items go."""
    read = F.from_json(F.get_json_object(payload, path), "array<string>")
    return F.filter(F.coalesce(read, F.array().cast("array<string>")), lambda x: F.coalesce(F.startswith(x, F.lit("{")), F.lit(False)))


def names_of(payload: Column, path: str) -> Column:
    """The texts of a list, without blank ones and nulls. What is no list has none."""
    read = F.from_json(F.get_json_object(payload, path), "array<string>")
    return F.filter(F.transform(F.coalesce(read, F.array().cast("array<string>")), _stripped), lambda x: F.coalesce(x != "", F.lit(False)))


#: Events as payloads with raw text at several depths, as SQL that both engines read.
_ID = "CAST(event_id AS STRING)"
PAYLOAD_SQL = f"""'{{"user": {{"id": ' || {_ID} || ', "Raw_Text": "secret"}}, "props": ' || coalesce(props, 'null') || ', "lines": [{{"ocr_text": {{"a": [1, {{"k": 2}}]}}, "k": ' || {_ID} || '}}, [{{"raw": 1, "n": "x, }}"}}], 7], "source_text": ["t", "u"], "_meta": {{"old": 1}}'
  || CASE WHEN event_id % 3 = 0 THEN ', "method": "m", "warnings": ["w", {{"RAW": "secret", "v": null}}]' ELSE '' END || CASE WHEN event_id % 7 = 0 THEN ', "error": "own"' ELSE '' END || '}}'"""


def stored_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Leaves of the stored payloads of events; those of type error failed."""
    rows = table(spark, d, "events").select("event_id", F.expr(PAYLOAD_SQL).alias("payload"), F.col("event_type").alias("kind"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"))
    message = F.when(F.col("status") == "error", F.concat(F.lit('said "no" {'), F.col("event_id").cast("string"), F.lit("}")))
    stored = stored_payload(F.col("payload"), F.col("status"), message, F.struct("kind", "status", message.alias("error_message")))
    found = rows.select("event_id", F.explode(json_leaves(stored)).alias("leaf")).where("leaf.kind not in ('object', 'list')")
    return found.select("event_id", "leaf.path", "leaf.value")


ANSWER_SQL = """CASE o_orderkey % 8 WHEN 0 THEN '{"total": "' || {p} || '", "items": [{"n": 1}, 7, {"n": [2]}], "missing_fields": ["a", " ", null, " b"]}'
  WHEN 1 THEN 'Here {it} is:' || chr(10) || '```JSON' || chr(10) || '{"total": ' || {p} || ', "items": {"n": 1}}' || chr(10) || '``` done {x}'
  WHEN 2 THEN '{"total": ' || {p} || ', "items": [{"n": 1,}, {"n": 2, , } ,], }' WHEN 3 THEN '\ufeffSure, {"total": ' || {p} || ', "missing_fields": "a"} as you wish'
  WHEN 4 THEN '{"total": ' || {p} || ', "items": [}' WHEN 5 THEN CASE WHEN o_orderkey % 16 = 5 THEN ' ' END WHEN 6 THEN 'nothing } was { found' ELSE '{"note": "a, } {", "total": "' || {p} || '", "items": []}' END""".replace("{p}", "CAST(o_custkey * 3 AS STRING)")


def model_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Orders rendered as answers of a model: what their JSON says, or why there is none."""
    rows = table(spark, d, "orders").select("o_orderkey", json_of_answer(F.expr(ANSWER_SQL)).alias("found")).select("o_orderkey", "found.state", "found.text")
    text = F.col("text")
    return rows.select("o_orderkey", "state", F.get_json_object(text, "$.total").try_cast("double").alias("total"), F.size(items_of(text, "$.items")).alias("n_items"), F.array_join(names_of(text, "$.missing_fields"), ",").alias("missing"))


def ledger_after_deletes(spark: SparkSession, d: str) -> DataFrame:
    """Events written to a ledger in three batches, the first from before the later columns and one of them twice; rows of no quality deleted in two batches."""
    rows = ledger(table(spark, d, "events"))
    name = F.concat(F.lit("scan n° "), F.col("id").cast("string"), F.lit(".pdf"))
    saved = rows.select("id", "kind", name.alias("source_filename"), "saved_at", entry_path(F.col("kind"), F.col("saved_at"), name).alias("relative_path"), F.lit("{}").alias("payload_json"), "status", F.when(F.col("status") == "error", "failed").alias("error_message"))
    folder = shared_folder(spark, "ledger")
    append(saved.where("id % 3 = 0").drop("status", "error_message"), folder, 0)
    for batch in (1, 2, 1):
        append(saved.where(F.col("id") % 3 == batch), folder, batch)
    for batch in (0, 1, 1):
        delete(rows.where((F.col("quality") <= 0) & (F.col("id") % 2 >= batch)).select("id", F.col("saved_at").alias("trashed_at")), folder, batch)
    return current(spark, folder).select("id", "kind", "relative_path", "status", "error_message")


QUERIES = {f.__name__: f for f in (stored_payloads, model_payloads, ledger_after_deletes)}
_PRIVATE = "|".join(PRIVATE_KEYS)
ORACLES = {
    # Leaves by the engine's own walk of the tree; whatever lies below a private key goes by its path.
    "stored_payloads": f"""WITH p AS (SELECT event_id, event_type, {PAYLOAD_SQL} AS payload FROM events), t AS (SELECT event_id, event_type, unnest(tree) AS x FROM (SELECT event_id, event_type, (SELECT list({{'path': replace(t.fullkey[3:], '"', ''), 'atom': t.atom, 'type': t.type}}) FROM json_tree(payload) t) AS tree FROM p))
        SELECT event_id, x.path AS path, CASE WHEN x.type <> 'NULL' THEN x.atom ->> '$' END AS value FROM t WHERE x.type NOT IN ('OBJECT', 'ARRAY') AND NOT regexp_matches(lower(x.path), '(^|[.])({_PRIVATE})($|[.\\[])') AND NOT starts_with(x.path, '_meta')
          AND (event_type <> 'error' OR regexp_matches(x.path, '^({"|".join(ERROR_KEYS)})($|[.\\[])'))
        UNION ALL SELECT event_id, 'error', 'said "no" {{' || event_id || '}}' FROM events WHERE event_type = 'error' AND event_id % 7 <> 0
        UNION ALL SELECT event_id, '_meta.kind', event_type FROM events UNION ALL SELECT event_id, '_meta.status', CASE event_type WHEN 'error' THEN 'error' ELSE 'ok' END FROM events
        UNION ALL SELECT event_id, '_meta.error_message', CASE event_type WHEN 'error' THEN 'said "no" {{' || event_id || '}}' END FROM events""",
    "model_payloads": rf"""WITH a AS (SELECT o_orderkey, {ANSWER_SQL} AS answer FROM orders), i AS (SELECT *, CASE WHEN regexp_matches(answer, '(?is)```(?:json)?\s*(.*?)```') THEN regexp_extract(answer, '(?is)```(?:json)?\s*(.*?)```', 1) ELSE answer END AS inside FROM a),
        b AS (SELECT *, nullif(regexp_extract(inside, '(?s)\{{.*\}}'), '') AS blob FROM i), m AS (SELECT *, regexp_replace(blob, '[,\s]*,[,\s]*([}}\]])', '\1', 'g') AS mended, regexp_matches(regexp_replace(blob, '"[^"]*"', '""', 'g'), ',[,\s]*[}}\]]') AS commas FROM b),
        s AS (SELECT *, CASE WHEN trim(coalesce(answer, '')) = '' THEN 'empty' WHEN blob IS NULL THEN 'no object' WHEN json_valid(blob) AND NOT commas THEN 'as is' WHEN json_valid(mended) THEN 'repaired' ELSE 'broken' END AS state FROM m),
        j AS (SELECT o_orderkey, state, CAST(CASE state WHEN 'as is' THEN blob WHEN 'repaired' THEN mended END AS JSON) AS j FROM s)
        SELECT o_orderkey, state, TRY_CAST(j ->> '$.total' AS DOUBLE) AS total, CAST(coalesce(CASE WHEN json_type(j, '$.items') = 'ARRAY' THEN len(list_filter(json_extract(j, '$.items[*]'), lambda x: json_type(x) = 'OBJECT')) END, 0) AS INTEGER) AS n_items,
          coalesce(CASE WHEN json_type(j, '$.missing_fields') = 'ARRAY' THEN array_to_string(list_filter(list_transform(json_extract_string(j, '$.missing_fields[*]'), lambda x: trim(x)), lambda x: x <> ''), ',') END, '') AS missing FROM j""",
    "ledger_after_deletes": f"""WITH {LEDGER_SQL} SELECT id, kind, kind || '/' || strftime(saved_at, '%Y%m%dT%H%M%SZ') || '_scan_n_' || id || '.json' AS relative_path, CASE WHEN id % 3 = 0 THEN 'ok' ELSE status END AS status,
        CASE WHEN id % 3 <> 0 AND status = 'error' THEN 'failed' END AS error_message FROM ledger WHERE quality IS NULL OR quality > 0""",
}

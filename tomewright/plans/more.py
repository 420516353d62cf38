"""Registered queries of permissions, tags, logs, loads, labels and stamps with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.functions import format as D
from tomewright.functions import vector as V
from tomewright.operators import catalog as C
from tomewright.operators import index as I
from tomewright.operators import nlp
from tomewright.plans import catalog as P
from tomewright.sources import model as M

T = M.table

# nations are workspaces and teams, customers are users; a customer's role goes with the balance
USER = 12


def _workspaces(spark: SparkSession, d: str) -> DataFrame:
    n = T(spark, d, "nation")
    return n.select(
        F.col("n_nationkey").cast("long").alias("id"),
        (F.col("n_nationkey") % 13).cast("long").alias("owner"),
        F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey").cast("long")).alias("team_id"),
    )


def _members(spark: SparkSession, d: str) -> DataFrame:
    c = T(spark, d, "customer")
    roles = F.array(*[F.lit(r) for r in ("admin", "editor", "viewer", "commenter")])
    member = (F.col("c_custkey") * 7 % 25).cast("long")
    both = F.explode(F.array(F.col("c_nationkey").cast("long"), member)).alias("team_id")
    return c.select(both, F.col("c_custkey").alias("user_id"), F.get(roles, (F.col("c_custkey") % 4).cast("int")).alias("role")).distinct()


def workspace_permission(spark: SparkSession, d: str) -> DataFrame:
    shares = P._shares(spark, d).where(F.col("id") < 100).withColumn("id", F.col("id") % 25)
    return C.workspace_permission(_workspaces(spark, d), _members(spark, d), shares, USER, M.AS_OF)


def my_workspaces(spark: SparkSession, d: str) -> DataFrame:
    """Workspaces that the user owns or is in the team of, own ones first."""
    given = C.workspace_permission(_workspaces(spark, d), _members(spark, d), P._shares(spark, d).where("false"), USER, M.AS_OF)
    return given.where(F.col("role") != "none").orderBy((F.col("role") != "owner"), "id").select("id", "role", "permission")


def share_by_token(spark: SparkSession, d: str) -> DataFrame:
    shares = P._shares(spark, d).withColumn("token", F.when(F.col("grantee_type") == "link", F.md5(F.col("id").cast("string"))))
    wanted = ["" + x for x in ("8", "20", "32", "44")]
    import hashlib

    found = [C.share_by_token(shares, hashlib.md5(w.encode()).hexdigest(), M.AS_OF) for w in wanted]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("id", "permission")


def tag_rename_delete(spark: SparkSession, d: str) -> DataFrame:
    files = M.files(spark, d).select("id", "tags")
    return C.delete_tag(C.rename_tag(files, "TAG3", "three"), "topic2").select("id", F.array_join("tags", ",").alias("tags"))


def audit_append(spark: SparkSession, d: str) -> DataFrame:
    entries = T(spark, d, "documents").select(
        F.col("doc_id").alias("user_id"), F.col("source").alias("action"), F.lit(None).cast("string").alias("target"), F.col("text").alias("detail")
    )
    out = C.audit(entries, M.AS_OF)
    return out.select("user_id", "action", "target", F.md5("detail").alias("digest"), F.length("detail").alias("n"))


def load_missing(spark: SparkSession, d: str) -> DataFrame:
    """Offered titles that no stored file has yet, once each."""
    stored = M.files(spark, d).where(F.col("id") % 2 == 0).select(F.col("title").alias("name"))
    offered = M.files(spark, d).groupBy(F.col("title").alias("name")).agg(F.min("id").alias("first"))
    return C.load_missing(stored, offered, "name")


def own_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages of the chats that a user owns (inner join on the chat)."""
    talks = T(spark, d, "conversations")
    chats = talks.select("conv_id").distinct().select("conv_id", (F.col("conv_id") % 9).alias("owner"))
    return talks.join(chats.where("owner = 4"), "conv_id").select("conv_id", "turn", "role")


def sibling_sort(spark: SparkSession, d: str) -> DataFrame:
    """Siblings in stored order, then by name in the collation of the language."""
    n = T(spark, d, "nation").select("n_nationkey", (F.col("n_regionkey") % 2).alias("sort_order"), F.col("n_name").alias("name"))
    return n.orderBy("sort_order", F.collate("name", "zh"), "n_nationkey").limit(10).select("n_nationkey", "name")


def mime_types(spark: SparkSession, d: str) -> DataFrame:
    return M.files(spark, d).groupBy(D.mime_type(F.upper("ext")).alias("mime"), D.file_kind_label(F.col("ext")).alias("kind")).agg(F.count("*").alias("n"))


def label_maps(spark: SparkSession, d: str) -> DataFrame:
    items = M.files(spark, d).select("id", (F.col("id") % 4).cast("int").alias("k"))
    of = lambda *names: F.get(F.array(*[F.lit(n) for n in names]), F.col("k"))
    return items.select(
        "id", D.role_label(of("owner", "viewer", "odd", "")).alias("role"),
        D.permission_label(of("view", "edit", "none", "odd")).alias("permission"), D.status_label(of("ok", "empty", "failed", "odd")).alias("status"),
    )


def stamps(spark: SparkSession, d: str) -> DataFrame:
    """Month bucket, archive stamp and date label of events."""
    ts = F.col("ts")
    return T(spark, d, "events").select(
        "event_id", D.month_bucket(ts).alias("month"), D.dos_stamp(ts)["time"].alias("dos_time"),
        D.dos_stamp(ts)["date"].alias("dos_date"), D.date_label(ts, True).alias("shown"),
    )


def short_sizes(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey") * F.col("o_orderkey") * 731 + 13
    return T(spark, d, "orders").select("o_orderkey", D.short_bytes(n).alias("shown"))


def sse_lines(spark: SparkSession, d: str) -> DataFrame:
    """Multi-line messages framed for a stream."""
    talks = T(spark, d, "conversations")
    frame = D.sse_frame(F.col("role"), F.concat_ws("\n", "text", "role"), F.when(F.col("turn") % 2 == 0, F.col("turn")))
    return talks.select("conv_id", "turn", F.md5(frame).alias("digest"))


def office_words(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "documents").select("doc_id", D.office_words(F.col("text")).alias("n"))


def meta_merge(spark: SparkSession, d: str) -> DataFrame:
    merged = D.merged_meta(F.col("props"), {"warning": F.lit("none"), "kind": F.col("event_type")})
    return T(spark, d, "events").select(
        "event_id", F.get_json_object(merged, "$.k").alias("k"), F.get_json_object(merged, "$.kind").alias("kind"), F.get_json_object(merged, "$.warning").alias("warning")
    )


def vector_pack(spark: SparkSession, d: str) -> DataFrame:
    """Vectors to bytes and back; local models by name."""
    v = T(spark, d, "embeddings")
    packed = v.select("vec_id", V.pack(F.col("embedding")).alias("p"), "embedding", F.get(F.array(F.lit(""), F.lit(V.LOCAL_MODEL), F.lit("other")), (F.col("vec_id") % 3).cast("int")).alias("model"))
    back = packed.select("vec_id", F.octet_length("p").cast("long").alias("n"), (V.unpack(F.col("p")) == F.col("embedding")).alias("same"), V.is_local_model(F.col("model")).alias("local"))
    return back


def index_files(spark: SparkSession, d: str) -> DataFrame:
    """The index of files as they are stored: bags and packed chunks; terms and tokens by type."""
    entities, _ = nlp.indexed(M.files(spark, d))
    posted = I.postings(entities)
    return posted.groupBy("entity_type").agg(F.countDistinct("entity_id").alias("n"), F.count("*").alias("terms"), F.sum("tf").alias("tokens"))


QUERIES = {
    f.__name__: f
    for f in (
        workspace_permission, my_workspaces, share_by_token, tag_rename_delete, audit_append, load_missing, own_messages,
        sibling_sort, mime_types, label_maps, stamps, short_sizes, sse_lines, office_words, meta_merge, vector_pack, index_files,
    )
}

_WS = f"""ws AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_nationkey % 13 AS owner, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END AS team_id FROM nation
), mem AS (
  SELECT DISTINCT unnest([c_nationkey, CAST(c_custkey * 7 % 25 AS INT)]) AS team_id, c_custkey AS user_id, ['admin', 'editor', 'viewer', 'commenter'][CAST(c_custkey % 4 AS INT) + 1] AS role FROM customer
), mine AS (SELECT * FROM mem WHERE user_id = {USER}
)"""
_PERM = "CASE role WHEN 'owner' THEN 'manage' WHEN 'admin' THEN 'manage' WHEN 'editor' THEN 'edit' WHEN 'member' THEN 'edit' ELSE 'view' END"


def _case(table: dict, key: str, other: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {other} END"


_K = "CAST(id % 4 AS INT) + 1"
ORACLE_SQL = {
    "workspace_permission": f"""WITH {M.MODEL_SQL}, {P.SHARES_SQL}, {_WS}, best AS (
  SELECT id % 25 AS id, max(CASE permission WHEN 'edit' THEN 3 WHEN 'comment' THEN 2 ELSE 1 END) AS p FROM live
  WHERE id < 100 AND ((grantee_type = 'user' AND grantee_id = {USER}) OR (grantee_type = 'team' AND grantee_id IN (SELECT team_id FROM mine))) GROUP BY 1)
SELECT ws.id, CASE WHEN owner = {USER} THEN 'owner' WHEN role IS NOT NULL THEN role WHEN p > 0 THEN 'guest' ELSE 'none' END AS role,
  CASE WHEN owner = {USER} THEN 'manage' WHEN role IS NOT NULL THEN {_PERM} WHEN p > 0 THEN ['view', 'comment', 'edit'][p] ELSE 'none' END AS permission
FROM ws LEFT JOIN mine ON mine.team_id = ws.team_id LEFT JOIN best ON best.id = ws.id""",
    "my_workspaces": f"""WITH {_WS} SELECT ws.id, CASE WHEN owner = {USER} THEN 'owner' ELSE role END AS role, CASE WHEN owner = {USER} THEN 'manage' ELSE {_PERM} END AS permission
FROM ws LEFT JOIN mine ON mine.team_id = ws.team_id WHERE owner = {USER} OR role IS NOT NULL""",
    "share_by_token": f"""WITH {M.MODEL_SQL}, {P.SHARES_SQL} SELECT id, permission FROM shares
WHERE grantee_type = 'link' AND id IN (8, 20, 32, 44) AND (expires_at IS NULL OR expires_at >= TIMESTAMP '{M.AS_OF}')""",
    "tag_rename_delete": f"""WITH {M.MODEL_SQL} SELECT id, array_to_string(list_filter(
  list_transform(tags, lambda t: CASE WHEN lower(t) = 'tag3' THEN 'three' ELSE t END), lambda t: lower(t) <> 'topic2'), ',') AS tags FROM files""",
    "audit_append": "SELECT doc_id AS user_id, source AS action, '' AS target, md5(substr(text, 1, 500)) AS digest, length(substr(text, 1, 500)) AS n FROM documents",
    "load_missing": f"""WITH {M.MODEL_SQL} SELECT title AS name, min(id) AS first FROM files
WHERE title NOT IN (SELECT title FROM files WHERE id % 2 = 0) GROUP BY title""",
    "own_messages": "SELECT conv_id, turn, role FROM conversations WHERE conv_id % 9 = 4",
    "sibling_sort": "SELECT n_nationkey, n_name AS name FROM nation ORDER BY n_regionkey % 2, n_name, n_nationkey LIMIT 10",
    "mime_types": f"WITH {M.MODEL_SQL} SELECT {_case(D.MIME_TYPES, 'ext', chr(39) + 'application/octet-stream' + chr(39))} AS mime, {_case({'md': 'MD', 'txt': 'TXT', 'html': 'CODE', 'csv': 'XLS', 'pdf': 'PDF'}, 'ext', chr(39) + 'FILE' + chr(39))} AS kind, count(*) AS n FROM files GROUP BY ALL",
    "label_maps": f"""WITH {M.MODEL_SQL}, k AS (SELECT id, ['owner', 'viewer', 'odd', 'member'][{_K}] AS r, ['view', 'edit', 'none', 'odd'][{_K}] AS p, ['ok', 'empty', 'failed', 'odd'][{_K}] AS s FROM files)
SELECT id, {_case(D.ROLE_LABELS, 'r', 'r')} AS role, {_case(D.PERMISSION_LABELS, 'p', 'p')} AS permission, {_case(D.STATUS_LABELS, 's', 's')} AS status FROM k""",
    "stamps": """SELECT event_id, strftime(ts, '%Y-%m') AS month, CAST((hour(ts) << 11) | (minute(ts) << 5) | (second(ts) // 2) AS INT) AS dos_time,
  CAST(((year(ts) - 1980) << 9) | (month(ts) << 5) | day(ts) AS INT) AS dos_date, strftime(ts, '%Y-%m-%d %H:%M') AS shown FROM events""",
    "short_sizes": """WITH v AS (SELECT o_orderkey, CAST(o_orderkey * o_orderkey * 731 + 13 AS DOUBLE) AS v FROM orders)
SELECT o_orderkey, CASE WHEN v < 1024 THEN printf('%d B', CAST(v AS BIGINT)) WHEN v < 10240 THEN printf('%.1f KB', round(v / 1024, 1)) WHEN v < 1048576 THEN printf('%.0f KB', round(v / 1024))
  WHEN v < 1073741824 THEN printf('%.1f MB', round(v / 1048576, 1)) ELSE printf('%.2f GB', round(v / 1073741824, 2)) END AS shown FROM v""",
    "sse_lines": """SELECT conv_id, turn, md5(CASE WHEN turn % 2 = 0 THEN 'id: ' || turn || chr(10) ELSE '' END || 'event: ' || role || chr(10)
  || array_to_string(list_transform(string_split(text || chr(10) || role, chr(10)), lambda x: 'data: ' || x || chr(10)), '') || chr(10)) AS digest FROM conversations""",
    "office_words": "SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> '')) AS n FROM documents",
    "meta_merge": "SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS kind, 'none' AS warning FROM events",
    "vector_pack": "SELECT vec_id, CAST(256 AS BIGINT) AS n, TRUE AS same, vec_id % 3 <> 2 AS local FROM embeddings",
}

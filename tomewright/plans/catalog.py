"""Registered relational queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomewright.operators import catalog as C
from tomewright.sources import model as M

T = M.table


def list_files_page(spark: SparkSession, d: str) -> DataFrame:
    page = C.list_files(M.files(spark, d), workspaces=["en", "fr"], q="the", sort="size", limit=25, offset=5)
    return page.select("id", "title", "size", "pinned", "total")


def list_files_trash(spark: SparkSession, d: str) -> DataFrame:
    page = C.list_files(M.files(spark, d), trash=True, exts=["MD", "txt"], sort="name", ascending=True)
    return page.select("id", "title", "ext", "total")


def list_notes_filter(spark: SparkSession, d: str) -> DataFrame:
    notes = M.notes(spark, d).withColumn("size", F.length("text"))
    return C.list_files(notes, folder="folder1", tag="tag1").select("id", "title", "total")


def tag_any_match(spark: SparkSession, d: str) -> DataFrame:
    wanted = ["TAG3".lower(), "topic4"]
    return M.files(spark, d).where(F.exists("tags", lambda t: F.lower(t).isin(wanted))).select("id", F.array_join("tags", ",").alias("tags"))


def exists_text_like(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a page of the same number whose markup mentions a word, or a short text."""
    docs = T(spark, d, "documents").select("doc_id", "n_chars")
    pages = T(spark, d, "pages").where(F.contains(F.lower("html"), F.lit("the"))).select(F.col("page_id").alias("doc_id"))
    short = docs.where(F.col("n_chars") < 100)
    return docs.where(~(F.col("n_chars") < 100)).join(pages, "doc_id", "left_semi").union(short).select("doc_id")


def _entity_tags(spark: SparkSession, d: str) -> DataFrame:
    files = M.files(spark, d)
    return files.select("id", "deleted", F.explode("tags").alias("tag"))


def _all_tags(spark: SparkSession) -> DataFrame:
    ids = spark.range(10).select(F.col("id"))
    return ids.select(F.concat(F.lit("tag"), "id").alias("tag")).union(ids.select(F.concat(F.lit("Topic"), "id").alias("tag")))


def tag_cloud(spark: SparkSession, d: str) -> DataFrame:
    used = _entity_tags(spark, d).groupBy("tag").agg(F.count("*").alias("n"))
    cloud = _all_tags(spark).join(used, "tag", "left")
    return cloud.select("tag", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), "tag")


def orphan_tags_anti(spark: SparkSession, d: str) -> DataFrame:
    return _all_tags(spark).join(_entity_tags(spark, d).select("tag").distinct(), "tag", "left_anti")


def overview_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every counter of a workspace in one pass."""
    return (
        M.files(spark, d)
        .groupBy("workspace")
        .agg(
            F.count_if(~F.col("deleted")).alias("n_files"),
            F.count_if(F.col("deleted")).alias("n_trash"),
            F.count_if(F.col("starred") & ~F.col("deleted")).alias("n_starred"),
            F.coalesce(F.sum(F.when(~F.col("deleted"), F.col("size"))), F.lit(0)).alias("bytes"),
            F.countDistinct("folder").alias("n_folders"),
            F.max("updated_at").cast("date").cast("string").alias("last_day"),
        )
    )


def storage_by_type(spark: SparkSession, d: str) -> DataFrame:
    live = M.files(spark, d).where(~F.col("deleted"))
    return live.groupBy("ext").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).orderBy(F.desc("bytes"), "ext").limit(12)


def folder_summary_nulls(spark: SparkSession, d: str) -> DataFrame:
    folder = F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.col("folder"))
    return M.files(spark, d).groupBy(folder.alias("folder")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def daily_trend_zero_fill(spark: SparkSession, d: str) -> DataFrame:
    errors = T(spark, d, "events").where((F.col("event_type") == "error") & (F.dayofmonth("ts") % 3 != 0))
    return C.daily_trend(errors, "ts", "2024-01-30").select(F.col("day").cast("string").alias("day"), "n")


def actions_top25(spark: SparkSession, d: str) -> DataFrame:
    events = T(spark, d, "events")
    return events.groupBy("event_type", "user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type", "user_id").limit(25)


def audit_filter(spark: SparkSession, d: str) -> DataFrame:
    """Audit search with live wildcards, an interval and paging; details are cut at 500 characters."""
    events = T(spark, d, "events")
    found = events.where(
        F.col("event_type").ilike("%I_K%") & (F.col("ts") >= F.lit("2024-01-10").cast("timestamp")) & (F.col("value") > 10)
    )
    return (
        found.orderBy(F.desc("ts"), "event_id")
        .offset(20)
        .limit(50)
        .select("event_id", "user_id", F.substring("props", 1, 500).alias("detail"))
    )


def latest_per_kind(spark: SparkSession, d: str) -> DataFrame:
    last = C.latest_per(T(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    return last.select("user_id", "event_type", "event_id")


def chats_last_answer(spark: SparkSession, d: str) -> DataFrame:
    talks = T(spark, d, "conversations")
    return talks.groupBy("conv_id").agg(
        F.count("*").alias("n_messages"),
        F.md5(F.max_by(F.when(F.col("role") == "assistant", F.col("text")), F.when(F.col("role") == "assistant", F.col("turn")))).alias("last_answer"),
    )


def history_tail(spark: SparkSession, d: str) -> DataFrame:
    """The last 6 of a conversation's first 20 messages."""
    first = C.newest(T(spark, d, "conversations"), ["conv_id"], [F.col("turn"), F.col("role")], 20)
    return C.newest(first, ["conv_id"], [F.desc("turn"), F.desc("role")], 6).select("conv_id", "turn", "role")


def versions_keep30(spark: SparkSession, d: str) -> DataFrame:
    kept = C.newest(T(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 30)
    return kept.groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


def _tree(spark: SparkSession, d: str) -> DataFrame:
    """region -> nation -> customer as (id, parent)."""
    region = T(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"))
    nation = T(spark, d, "nation").select(
        F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent")
    )
    customer = T(spark, d, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent")
    )
    return region.unionByName(nation).unionByName(customer)


def folder_tree_rollup(spark: SparkSession, d: str) -> DataFrame:
    counts = T(spark, d, "orders").groupBy(F.concat(F.lit("c"), "o_custkey").alias("id")).agg(F.count("*").alias("n"))
    closed = C.closure(_tree(spark, d), "id", "parent")
    totals = C.rollup_tree(closed, counts, "id", "n")
    return totals.where(~F.col("ancestor").startswith("c"))


def breadcrumb_recursive(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.createDataFrame([("c1",), ("c7",), ("n3",), ("r0",)], "node string")
    closed = C.closure(_tree(spark, d), "id", "parent", 40, wanted)
    return closed.groupBy("node").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "ancestor"))), lambda x: x["ancestor"]), "/").alias("path")
    )


def descendants(spark: SparkSession, d: str) -> DataFrame:
    root = spark.createDataFrame([("r1",)], "node string")
    down = C.closure(_tree(spark, d).where("parent is not null"), "parent", "id", start=root)
    return down.where(F.col("depth") > 0).select(F.col("ancestor").alias("node"), "depth")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return M.files(spark, d).select("id", "private", "workspace", (F.col("id") % 50).alias("owner"))


def _shares(spark: SparkSession, d: str) -> DataFrame:
    docs = T(spark, d, "documents").where(F.col("doc_id") % 4 == 0)
    kinds = F.array(F.lit("user"), F.lit("team"), F.lit("link"))
    grants = F.array(F.lit("view"), F.lit("comment"), F.lit("edit"))
    return docs.select(
        F.col("doc_id").alias("id"),
        F.get(kinds, (F.col("doc_id") % 3).cast("int")).alias("grantee_type"),
        (F.col("doc_id") % 25).alias("grantee_id"),
        F.get(grants, (F.col("doc_id") % 7 % 3).cast("int")).alias("permission"),
        F.when(F.col("doc_id") % 5 != 0, F.expr("TIMESTAMP '2024-06-01' + make_dt_interval(CAST(doc_id % 60 AS INT))")).alias("expires_at"),
    )


def _teams(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("team_id"), F.col("c_custkey").alias("user_id"))


def acl_allowed(spark: SparkSession, d: str) -> DataFrame:
    return C.allowed_ids(_items(spark, d), _shares(spark, d), 12, _teams(spark, d), M.AS_OF)


def effective_permission(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("workspace") == "en", 3).when(F.col("workspace") == "fr", 1).otherwise(0)
    return C.effective_permission(_items(spark, d), _shares(spark, d), 12, level, M.AS_OF, _teams(spark, d))


def shares_polymorphic(spark: SparkSession, d: str) -> DataFrame:
    users = T(spark, d, "customer").select(F.col("c_custkey").alias("u"), F.col("c_name").alias("user_name"))
    teams = T(spark, d, "nation").select(F.col("n_nationkey").alias("t"), F.col("n_name").alias("team_name"))
    s = _shares(spark, d)
    named = s.join(users, (s["grantee_type"] == "user") & (s["grantee_id"] == F.col("u")), "left").join(
        teams, (s["grantee_type"] == "team") & (s["grantee_id"] == F.col("t")), "left"
    )
    return named.select("id", "grantee_type", F.coalesce("user_name", "team_name", F.lit("link")).alias("grantee"), "permission")


def accessible_workspaces(spark: SparkSession, d: str) -> DataFrame:
    """Nations of a region as workspaces, with members above a balance: a left join whose
    predicates stay in the join."""
    n, c = T(spark, d, "nation"), T(spark, d, "customer")
    joined = n.join(c, (c["c_nationkey"] == n["n_nationkey"]) & (c["c_acctbal"] > 9000) & (c["c_mktsegment"] == "BUILDING"), "left")
    role = F.when(F.max("c_acctbal") > 9500, "owner").when(F.max("c_acctbal").isNotNull(), "member").otherwise("none")
    return joined.groupBy("n_nationkey", "n_name").agg(F.count("c_custkey").alias("n_members"), role.alias("role"))


def members_join(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = T(spark, d, "customer"), T(spark, d, "nation"), T(spark, d, "region")
    return (
        c.join(n, c["c_nationkey"] == n["n_nationkey"])
        .join(r, n["n_regionkey"] == r["r_regionkey"])
        .groupBy("r_name", "n_name")
        .agg(F.count("*").alias("n_members"), F.round(F.avg("c_acctbal"), 4).alias("avg_balance"))
    )


def import_remap(spark: SparkSession, d: str) -> DataFrame:
    c = T(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("c_nationkey"))
    mapping = T(spark, d, "nation").where(F.col("n_nationkey") % 2 == 0).select(
        F.col("n_nationkey").cast("long").alias("old"), (F.col("n_nationkey") + 1000).cast("long").alias("new")
    )
    return C.remap(c, mapping, "c_nationkey").na.fill(-1, ["c_nationkey"])


def quota_greedy(spark: SparkSession, d: str) -> DataFrame:
    files = T(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    return C.quota_greedy(files, "source", "id", "n_chars", 60_000)


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    parts = T(spark, d, "part").select("p_partkey", "p_name", F.lit(0).cast("long").alias("seq"))
    changes = T(spark, d, "lineitem").where(F.col("l_quantity") >= 49).select(
        F.col("l_partkey").alias("p_partkey"),
        F.concat(F.lit("order "), "l_orderkey").alias("p_name"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )
    return C.upsert(parts, changes, ["p_partkey"], "seq")


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Customers of a nation go, then their orders, then their order lines; what is left."""
    gone = T(spark, d, "customer").where(F.col("c_nationkey") == 3).select("c_custkey")
    orders = T(spark, d, "orders")
    lost = orders.join(gone, orders["o_custkey"] == gone["c_custkey"], "left_semi").select("o_orderkey")
    left_orders = C.delete_where_in(orders, "o_orderkey", lost)
    lines = C.delete_where_in(T(spark, d, "lineitem"), "l_orderkey", lost.withColumnRenamed("o_orderkey", "l_orderkey"))
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("t"), "n")
    return count(left_orders, "orders").unionByName(count(lines, "lineitem"))


def dedupe_names(spark: SparkSession, d: str) -> DataFrame:
    files = M.files(spark, d).withColumn("folder", F.when(F.col("id") % 2 == 0, F.col("folder")))
    return files.withColumn("name", F.substring("title", 1, 2)).select(
        "id", C.unique_names(files, "folder", "name", "id").alias("name")
    )


def table_counts(spark: SparkSession, d: str) -> DataFrame:
    names = ["region", "nation", "customer", "orders", "lineitem", "documents", "pages", "events"]
    counts = [T(spark, d, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("t"), "n") for n in names]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def null_safe_equal(spark: SparkSession, d: str) -> DataFrame:
    """How many later notes share a note's folder, a missing folder counting as the empty one."""
    notes = M.notes(spark, d).select("id", F.when(F.col("id") % 3 != 1, F.col("folder")).alias("folder"))
    w = Window.partitionBy(F.coalesce("folder", F.lit("")))
    later = F.count("*").over(w) - F.row_number().over(w.orderBy("id"))
    return notes.select(F.col("id").alias("a"), later.alias("n")).where(F.col("n") > 0)


def next_sort_order(spark: SparkSession, d: str) -> DataFrame:
    n = T(spark, d, "nation")
    return n.groupBy("n_regionkey").agg((F.coalesce(F.max("n_nationkey"), F.lit(0)) + 1).cast("int").alias("next"))


def missing_scope(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.range(0, 3000, 7).select(F.col("id").alias("doc_id"))
    return wanted.join(T(spark, d, "documents").select("doc_id"), "doc_id", "left_anti")


def point_and_scalar(spark: SparkSession, d: str) -> DataFrame:
    """A point lookup joined to a scalar aggregate."""
    orders = T(spark, d, "orders")
    biggest = orders.agg(F.max("o_totalprice").alias("top"))
    return orders.where(F.col("o_orderkey") == 7).crossJoin(F.broadcast(biggest)).select(
        "o_orderkey", F.round("o_totalprice", 2).alias("price"), F.round("top", 2).alias("top")
    )


def pricing_join_agg(spark: SparkSession, d: str) -> DataFrame:
    line, orders = T(spark, d, "lineitem"), T(spark, d, "orders")
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        line.join(orders, line["l_orderkey"] == orders["o_orderkey"])
        .where((F.col("o_orderdate") >= "1996-01-01") & (F.col("l_returnflag") != "N"))
        .groupBy("o_orderpriority", "l_returnflag")
        .agg(F.count("*").alias("n"), F.round(F.sum(revenue), 2).alias("revenue"), F.round(F.sum("l_quantity"), 2).alias("qty"))
    )


def soft_delete_restore(spark: SparkSession, d: str) -> DataFrame:
    """Trash the starred files of one folder, restore every third of them, count both states."""
    files = M.files(spark, d)
    trashed = F.col("deleted") | (F.col("starred") & (F.col("folder") == "src1"))
    state = files.withColumn("deleted", F.when(F.col("id") % 3 == 0, F.lit(False)).otherwise(trashed))
    return state.groupBy("folder").agg(F.count_if("deleted").alias("n_trash"), F.count_if(~F.col("deleted")).alias("n_live"))


def tag_merge_remove(spark: SparkSession, d: str) -> DataFrame:
    """Add two tags without repeating a spelling, then remove one in any spelling."""
    files = M.files(spark, d).select("id", "tags")
    added = F.filter(F.array(F.lit("TAG1"), F.lit("new")), lambda t: ~F.exists("tags", lambda x: F.lower(x) == F.lower(t)))
    merged = files.select("id", F.concat("tags", added).alias("tags"))
    left = F.filter("tags", lambda t: F.lower(t) != "topic2")
    return merged.select("id", F.array_join(left, ",").alias("tags"))


def case_order(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("c_mktsegment") == "MACHINERY", 0).when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(2)
    top = T(spark, d, "customer").orderBy(rank, F.desc("c_acctbal"), "c_custkey").limit(40)
    return top.select("c_custkey", "c_mktsegment")


QUERIES = {
    f.__name__: f
    for f in (
        list_files_page, list_files_trash, list_notes_filter, tag_any_match, exists_text_like, tag_cloud, orphan_tags_anti,
        overview_counts, storage_by_type, folder_summary_nulls, daily_trend_zero_fill, actions_top25, audit_filter,
        latest_per_kind, chats_last_answer, history_tail, versions_keep30, folder_tree_rollup, breadcrumb_recursive,
        descendants, acl_allowed, effective_permission, shares_polymorphic, accessible_workspaces, members_join, import_remap,
        quota_greedy, upsert_latest, cascade_delete, dedupe_names, table_counts, null_safe_equal, next_sort_order, missing_scope,
        point_and_scalar, pricing_join_agg, soft_delete_restore, tag_merge_remove, case_order,
    )
}

W = f"WITH {M.MODEL_SQL}"
TREE_SQL = """WITH RECURSIVE t AS (
  SELECT 'r' || r_regionkey AS id, NULL AS parent FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
), up AS (
  SELECT id AS node, id AS ancestor, 0 AS depth FROM t
  UNION ALL SELECT up.node, t.parent, up.depth + 1 FROM up JOIN t ON t.id = up.ancestor WHERE t.parent IS NOT NULL
)"""
SHARES_SQL = """items AS (SELECT id, private, workspace, id % 50 AS owner FROM files),
shares AS (
  SELECT doc_id AS id, ['user', 'team', 'link'][CAST(doc_id % 3 AS INT) + 1] AS grantee_type, doc_id % 25 AS grantee_id,
    ['view', 'comment', 'edit'][CAST(doc_id % 7 % 3 AS INT) + 1] AS permission,
    CASE WHEN doc_id % 5 <> 0 THEN TIMESTAMP '2024-06-01' + to_days(CAST(doc_id % 60 AS INT)) END AS expires_at
  FROM documents WHERE doc_id % 4 = 0
), live AS (SELECT * FROM shares WHERE expires_at IS NULL OR expires_at > TIMESTAMP '2024-06-30')"""
TAGS_SQL = "tg AS (SELECT 'tag' || i AS tag FROM range(10) r(i) UNION ALL SELECT 'Topic' || i FROM range(10) r(i)), et AS (SELECT id, unnest(tags) AS tag FROM files)"

ORACLE_SQL = {
    "list_files_page": f"""{W}, f AS (SELECT * FROM files WHERE NOT deleted AND workspace IN ('en', 'fr')
  AND (contains(lower(title), 'the') OR contains(lower(text), 'the')))
SELECT id, title, size, pinned, (SELECT count(*) FROM f) AS total FROM f ORDER BY pinned DESC, size DESC, id LIMIT 25 OFFSET 5""",
    "list_files_trash": f"""{W}, f AS (SELECT * FROM files WHERE deleted AND ext IN ('md', 'txt'))
SELECT id, title, ext, (SELECT count(*) FROM f) AS total FROM f ORDER BY pinned DESC, title, id LIMIT 50""",
    "list_notes_filter": f"""{W}, f AS (SELECT * FROM notes WHERE NOT deleted AND folder = 'folder1' AND list_contains(tags, 'tag1'))
SELECT id, title, (SELECT count(*) FROM f) AS total FROM f ORDER BY pinned DESC, updated_at DESC, id LIMIT 50""",
    "tag_any_match": f"{W} SELECT id, array_to_string(tags, ',') AS tags FROM files WHERE len(list_filter(tags, lambda t: lower(t) IN ('tag3', 'topic4'))) > 0",
    "exists_text_like": "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM pages WHERE page_id = doc_id AND contains(lower(html), 'the')) OR n_chars < 100",
    "tag_cloud": f"{W}, {TAGS_SQL} SELECT tag, (SELECT count(*) FROM et WHERE et.tag = tg.tag) AS n FROM tg",
    "orphan_tags_anti": f"{W}, {TAGS_SQL} SELECT tag FROM tg WHERE tag NOT IN (SELECT tag FROM et)",
    "overview_counts": f"""{W} SELECT workspace, count(*) FILTER (NOT deleted) AS n_files, count(*) FILTER (deleted) AS n_trash,
  count(*) FILTER (starred AND NOT deleted) AS n_starred, CAST(coalesce(sum(size) FILTER (NOT deleted), 0) AS BIGINT) AS bytes,
  count(DISTINCT folder) AS n_folders, CAST(CAST(max(updated_at) AS DATE) AS VARCHAR) AS last_day FROM files GROUP BY workspace""",
    "storage_by_type": f"{W} SELECT ext, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM files WHERE NOT deleted GROUP BY ext ORDER BY bytes DESC, ext LIMIT 12",
    "folder_summary_nulls": f"{W} SELECT CASE WHEN id % 11 <> 0 THEN folder END AS folder, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY 1",
    "daily_trend_zero_fill": """WITH c AS (SELECT CAST(DATE '2024-01-17' + CAST(i AS INT) AS DATE) AS day FROM range(14) r(i))
SELECT CAST(day AS VARCHAR) AS day, (SELECT count(*) FROM events WHERE CAST(ts AS DATE) = day AND event_type = 'error' AND day(ts) % 3 <> 0) AS n FROM c""",
    "actions_top25": "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL ORDER BY n DESC, event_type, user_id LIMIT 25",
    "audit_filter": """SELECT event_id, user_id, substr(props, 1, 500) AS detail FROM events
WHERE event_type ILIKE '%I_K%' AND ts >= TIMESTAMP '2024-01-10' AND value > 10 ORDER BY ts DESC, event_id LIMIT 50 OFFSET 20""",
    "latest_per_kind": """SELECT user_id, event_type, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
    "chats_last_answer": """SELECT conv_id, count(*) AS n_messages, md5(arg_max(text, turn) FILTER (role = 'assistant')) AS last_answer
FROM conversations GROUP BY conv_id""",
    "history_tail": """WITH f AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) <= 20)
SELECT conv_id, turn, role FROM f QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) <= 6""",
    "versions_keep30": """WITH k AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 30)
SELECT user_id, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM k GROUP BY user_id""",
    "folder_tree_rollup": f"""{TREE_SQL} SELECT ancestor, count(*) AS total FROM up JOIN orders ON node = 'c' || o_custkey
WHERE ancestor NOT LIKE 'c%' GROUP BY ancestor""",
    "breadcrumb_recursive": f"{TREE_SQL} SELECT node, string_agg(ancestor, '/' ORDER BY depth DESC) AS path FROM up WHERE node IN ('c1', 'c7', 'n3', 'r0') GROUP BY node",
    "descendants": f"{TREE_SQL} SELECT node, depth FROM up WHERE ancestor = 'r1' AND depth > 0",
    "acl_allowed": f"""{W}, {SHARES_SQL}
SELECT id FROM items WHERE NOT private OR owner = 12
UNION SELECT id FROM live WHERE grantee_type = 'user' AND grantee_id = 12
UNION SELECT id FROM live WHERE grantee_type = 'team' AND grantee_id IN (SELECT c_nationkey FROM customer WHERE c_custkey = 12)""",
    "effective_permission": f"""{W}, {SHARES_SQL}, s AS (
  SELECT id, max(CASE permission WHEN 'view' THEN 1 WHEN 'comment' THEN 2 WHEN 'edit' THEN 3 ELSE 0 END) AS sh
  FROM live WHERE (grantee_type = 'user' AND grantee_id = 12)
    OR (grantee_type = 'team' AND grantee_id IN (SELECT c_nationkey FROM customer WHERE c_custkey = 12)) GROUP BY id)
SELECT i.id, ['none', 'view', 'comment', 'edit', 'manage'][1 + CASE WHEN owner = 12 THEN 4 WHEN private THEN coalesce(sh, 0)
  ELSE greatest(CASE workspace WHEN 'en' THEN 3 WHEN 'fr' THEN 1 ELSE 0 END, coalesce(sh, 0)) END] AS permission
FROM items i LEFT JOIN s ON s.id = i.id""",
    "shares_polymorphic": f"""{W}, {SHARES_SQL}
SELECT s.id, grantee_type, coalesce(c_name, n_name, 'link') AS grantee, permission FROM shares s
LEFT JOIN customer ON grantee_type = 'user' AND grantee_id = c_custkey LEFT JOIN nation ON grantee_type = 'team' AND grantee_id = n_nationkey""",
    "accessible_workspaces": """SELECT n_nationkey, n_name, count(c_custkey) AS n_members,
  CASE WHEN max(c_acctbal) > 9500 THEN 'owner' WHEN max(c_acctbal) IS NOT NULL THEN 'member' ELSE 'none' END AS role
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 AND c_mktsegment = 'BUILDING' GROUP BY ALL""",
    "members_join": """SELECT r_name, n_name, count(*) AS n_members, round(avg(c_acctbal), 4) AS avg_balance
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
    "import_remap": "SELECT c_custkey, CAST(CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey + 1000 ELSE -1 END AS BIGINT) AS c_nationkey FROM customer",
    "quota_greedy": """WITH RECURSIVE f AS (
  SELECT source, doc_id AS id, n_chars AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents
), g AS (
  SELECT source, id, i, CASE WHEN n <= 60000 THEN n ELSE 0 END AS used, n <= 60000 AS ok FROM f WHERE i = 1
  UNION ALL SELECT f.source, f.id, f.i, CASE WHEN used + n <= 60000 THEN used + n ELSE used END, used + n <= 60000
  FROM g JOIN f ON f.source = g.source AND f.i = g.i + 1
) SELECT source, id FROM g WHERE ok""",
    "upsert_latest": """WITH c AS (
  SELECT l_partkey, 'order ' || l_orderkey AS p_name, l_orderkey * 10 + l_linenumber AS seq FROM lineitem WHERE l_quantity >= 49
  QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber DESC) = 1)
SELECT p_partkey, coalesce(c.p_name, p.p_name) AS p_name, coalesce(seq, 0) AS seq FROM part p LEFT JOIN c ON l_partkey = p_partkey""",
    "cascade_delete": """WITH lost AS (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3)
SELECT 'orders' AS t, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM lost)
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM lost)""",
    "dedupe_names": f"""{W}, f AS (SELECT id, substr(title, 1, 2) AS name, row_number() OVER (
  PARTITION BY coalesce(CASE WHEN id % 2 = 0 THEN folder END, ''), substr(title, 1, 2) ORDER BY id) AS n FROM files)
SELECT id, CASE WHEN n = 1 THEN name ELSE name || ' (' || n || ')' END AS name FROM f""",
    "table_counts": " UNION ALL ".join(
        f"SELECT '{n}' AS t, count(*) AS n FROM {n}"
        for n in ("region", "nation", "customer", "orders", "lineitem", "documents", "pages", "events")
    ),
    "null_safe_equal": f"""{W}, n AS (SELECT id, CASE WHEN id % 3 <> 1 THEN folder END AS folder FROM notes)
SELECT a.id AS a, count(*) AS n FROM n a JOIN n b ON coalesce(a.folder, '') = coalesce(b.folder, '') AND a.id < b.id GROUP BY a.id""",
    "next_sort_order": "SELECT n_regionkey, CAST(coalesce(max(n_nationkey), 0) + 1 AS INT) AS next FROM nation GROUP BY n_regionkey",
    "missing_scope": "SELECT i AS doc_id FROM range(0, 3000, 7) r(i) WHERE i NOT IN (SELECT doc_id FROM documents)",
    "point_and_scalar": "SELECT o_orderkey, round(o_totalprice, 2) AS price, (SELECT round(max(o_totalprice), 2) FROM orders) AS top FROM orders WHERE o_orderkey = 7",
    "pricing_join_agg": """SELECT o_orderpriority, l_returnflag, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(sum(l_quantity), 2) AS qty
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND l_returnflag <> 'N' GROUP BY ALL""",
    "soft_delete_restore": f"""{W}, s AS (SELECT folder, CASE WHEN id % 3 = 0 THEN FALSE ELSE deleted OR (starred AND folder = 'src1') END AS gone FROM files)
SELECT folder, count(*) FILTER (gone) AS n_trash, count(*) FILTER (NOT gone) AS n_live FROM s GROUP BY folder""",
    "tag_merge_remove": f"""{W}, m AS (SELECT id, list_concat(tags, list_filter(['TAG1', 'new'], lambda t: NOT list_contains(list_transform(tags, lambda x: lower(x)), lower(t)))) AS ts FROM files)
SELECT id, array_to_string(list_filter(ts, lambda t: lower(t) <> 'topic2'), ',') AS tags FROM m""",
    "case_order": """SELECT c_custkey, c_mktsegment FROM customer ORDER BY CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 ELSE 2 END,
  c_acctbal DESC, c_custkey LIMIT 40""",
}

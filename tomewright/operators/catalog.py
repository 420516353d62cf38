"""Relational operators of a document catalogue: listings, counts, trends, trees, access, DML."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomewright.sources.storage import scratch

# Ordinals of permissions, and the permission that each team role gives.
PERMISSIONS = {"none": 0, "view": 1, "comment": 2, "edit": 3, "manage": 4}
ROLE_PERMISSION = {"owner": "manage", "admin": "manage", "editor": "edit", "member": "edit", "viewer": "view"}
SORT_KEYS = {"name": "title", "size": "size", "updated": "updated_at", "folder": "folder"}


def ordinal(permission: Column) -> Column:
    table = F.create_map(*[F.lit(x) for p in PERMISSIONS.items() for x in p])
    return F.coalesce(table[permission], F.lit(0))


def permission_name(level: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in PERMISSIONS.items() for x in (v, k)])
    return table[level]


def conjunction(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def list_files(
    files: DataFrame,
    workspaces: list[str] | None = None,
    folder: str | None = "all",
    q: str | None = None,
    tag: str | None = None,
    exts: list[str] | None = None,
    starred: bool = False,
    trash: bool = False,
    sort: str = "updated",
    ascending: bool = False,
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """One page of a filtered listing, pinned rows first, with the total of all pages."""
    where = [F.col("deleted") if trash else ~F.col("deleted")]
    if workspaces:
        where.append(F.col("workspace").isin(workspaces))
    if folder == "root":
        where.append(F.col("folder").isNull())
    elif folder not in (None, "all"):
        where.append(F.col("folder") == folder)
    if q:
        low = F.lit(q.lower())
        where.append(F.contains(F.lower("title"), low) | F.contains(F.lower("text"), low))
    if tag:
        where.append(F.array_contains("tags", tag))
    if exts:
        where.append(F.lower("ext").isin([e.lower() for e in exts]))
    if starred:
        where.append(F.col("starred"))
    key = F.col(SORT_KEYS.get(sort, "updated_at"))
    found = files.where(conjunction(where))
    total = F.broadcast(found.agg(F.count("*").alias("total")))  # one row
    limit, offset = max(1, min(200, limit)), max(0, offset)
    # sort and cut before the total is attached: a top-k, not a global sort
    page = (
        found.orderBy(F.desc("pinned"), key.asc() if ascending else key.desc(), F.col("id"))
        .offset(offset)
        .limit(limit)
    )
    return page.crossJoin(total)


def daily_trend(events: DataFrame, ts: str, last_day: str, days: int = 14) -> DataFrame:
    """(day, n) for each of ``days`` days up to ``last_day``, days without events included."""
    spark = events.sparkSession
    last = F.lit(last_day).cast("date")
    calendar = spark.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    counts = (
        events.where(
            (F.col(ts) >= F.date_sub(last, days - 1).cast("timestamp"))
            & (F.col(ts) < F.date_add(last, 1).cast("timestamp"))
        )
        .groupBy(F.to_date(ts).alias("day"))
        .agg(F.count("*").alias("n"))
    )
    return calendar.join(F.broadcast(counts), "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def latest_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def newest(df: DataFrame, keys: list[str], order: list[Column], keep: int) -> DataFrame:
    """The first ``keep`` rows of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")


def upsert(stored: DataFrame, changes: DataFrame, key: list[str], sequence: str) -> DataFrame:
    """Rows of ``changes`` replace stored rows of their key; the last in ``sequence`` wins."""
    last = latest_per(changes, key, [F.desc(sequence)])
    return stored.join(last.select(*key), key, "left_anti").unionByName(last.select(*stored.columns))


def delete_where_in(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Rows whose key is not among ``gone``'s; null keys stay."""
    return df.join(gone.select(key).distinct(), key, "left_anti").select(*df.columns)


def closure(edges: DataFrame, child: str, parent: str, max_depth: int = 50, start: DataFrame | None = None) -> DataFrame:
    """(ancestor, node, depth): every node with each of its ancestors and itself (depth 0).

    Without ``start`` paths double: those of up to 2^k steps join those of exactly 2^k, so a
    tree of depth 50 takes six joins, each a table in the shared folder. With ``start``
    (node) the walk begins at those nodes and takes a step a join. Cycles end at
    ``max_depth``; where a node is reached twice its least depth counts.
    """
    spark = edges.sparkSession
    up = edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor"))
    least = lambda df: df.groupBy("ancestor", "node").agg(F.min("depth").alias("depth"))
    itself = up.select("node") if start is None else start.select("node")
    paths = itself.distinct().select(F.col("node").alias("ancestor"), "node", F.lit(0).alias("depth"))
    step = up.where(F.col("ancestor").isNotNull()).distinct()
    if start is None:
        # the first table holds self and parents
        known = paths.unionByName(step.select("ancestor", "node", F.lit(1).alias("depth")))
        known, reach = _written(spark, least(known), "closure"), 1
        while reach < max_depth:
            last = known.where(F.col("depth") == reach)
            more = last.select("node", F.col("ancestor").alias("mid")).join(
                known.where("depth > 0").select(F.col("node").alias("mid"), "ancestor", "depth"), "mid"
            )
            more = more.select("ancestor", "node", (F.col("depth") + reach).alias("depth")).where(F.col("depth") <= max_depth)
            more = _written(spark, more, "closure")
            if more.isEmpty():
                return known
            known, reach = _written(spark, least(known.unionByName(more)), "closure"), 2 * reach
        return known
    known = frontier = _written(spark, paths, "closure")
    for depth in range(1, max_depth + 1):
        moved = frontier.select(F.col("ancestor").alias("mid"), F.col("node").alias("from")).join(
            step.select(F.col("node").alias("mid"), "ancestor"), "mid"
        )
        moved = moved.select("ancestor", F.col("from").alias("node"), F.lit(depth).alias("depth")).distinct()
        frontier = _written(spark, moved.join(known, ["ancestor", "node"], "left_anti").select("ancestor", "node", "depth"), "closure")
        if frontier.isEmpty():
            return known
        known = known.unionByName(frontier)
    return known


def _written(spark, df: DataFrame, name: str) -> DataFrame:
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def rollup_tree(closed: DataFrame, counts: DataFrame, node: str, value: str) -> DataFrame:
    """(ancestor, total): each node's value summed over its subtree."""
    return closed.join(counts.select(F.col(node).alias("node"), value), "node").groupBy("ancestor").agg(
        F.sum(value).alias("total")
    )


def allowed_ids(items: DataFrame, shares: DataFrame, user: int, teams: DataFrame, as_of: str) -> DataFrame:
    """Ids a user may see: not private, own, shared with the user, or with one of the user's teams."""
    live = shares.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(as_of).cast("timestamp")))
    direct = live.where((F.col("grantee_type") == "user") & (F.col("grantee_id") == user)).select("id")
    mine = teams.where(F.col("user_id") == user).select(F.col("team_id").alias("grantee_id"))
    by_team = live.where(F.col("grantee_type") == "team").join(mine, "grantee_id", "left_semi").select("id")
    open_ = items.where(~F.col("private") | (F.col("owner") == user)).select("id")
    return open_.union(direct).union(by_team).distinct()


def live_shares(shares: DataFrame, user: int, teams: DataFrame, as_of: str) -> DataFrame:
    """Shares with the user or one of the user's teams that have not run out."""
    live = shares.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(as_of).cast("timestamp")))
    mine = teams.where(F.col("user_id") == user).select(
        F.lit("team").alias("grantee_type"), F.col("team_id").cast("long").alias("grantee_id")
    )
    grantees = mine.union(teams.sparkSession.range(1).select(F.lit("user"), F.lit(user).cast("long")))
    return live.join(grantees, ["grantee_type", "grantee_id"], "left_semi")


def workspace_permission(workspaces: DataFrame, members: DataFrame, shares: DataFrame, user: int, as_of: str) -> DataFrame:
    """(id, role, permission): owner, else the role in the workspace's team, else the best share, else none.

    ``workspaces`` (id, owner, team_id), ``members`` (team_id, user_id, role) the active ones,
    ``shares`` (id: the workspace's, grantee_type, grantee_id, permission, expires_at).
    """
    mine = members.where(F.col("user_id") == user).select("team_id", F.col("role").alias("team_role"))
    best = live_shares(shares, user, members, as_of).groupBy("id").agg(F.max(ordinal(F.col("permission"))).alias("shared"))
    roles = F.create_map(*[F.lit(x) for p in ROLE_PERMISSION.items() for x in p])
    found = workspaces.join(mine, "team_id", "left").join(best, "id", "left")
    owner = F.col("owner") == user
    role = F.when(owner, "owner").when(F.col("team_role").isNotNull(), F.col("team_role")).when(F.col("shared") > 0, "guest")
    given = (
        F.when(owner, "manage")
        .when(F.col("team_role").isNotNull(), F.coalesce(roles[F.col("team_role")], F.lit("view")))
        .when(F.col("shared") > 0, permission_name(F.col("shared")))
    )
    return found.select("id", F.coalesce(role, F.lit("none")).alias("role"), F.coalesce(given, F.lit("none")).alias("permission"))


def share_by_token(shares: DataFrame, token: str, as_of: str) -> DataFrame:
    """The share of a link, unless it has run out."""
    live = F.col("expires_at").isNull() | (F.col("expires_at") >= F.lit(as_of).cast("timestamp"))
    return shares.where((F.col("token") == token) & live)


def rename_tag(df: DataFrame, old: str, new: str) -> DataFrame:
    """``tags`` with every spelling of ``old`` replaced; the tag of that name keeps its places."""
    return df.withColumn("tags", F.transform("tags", lambda t: F.when(F.lower(t) == old.lower(), new).otherwise(t)))


def delete_tag(df: DataFrame, name: str) -> DataFrame:
    """``tags`` without any spelling of ``name``."""
    return df.withColumn("tags", F.filter("tags", lambda t: F.lower(t) != name.lower()))


def audit(entries: DataFrame, as_of: str) -> DataFrame:
    """Rows of the audit log: details cut at 500 characters, missing fields empty, stamped."""
    text = lambda c, n: F.substring(F.coalesce(F.col(c).cast("string"), F.lit("")), 1, n)
    return entries.select(
        "user_id", text("action", 200).alias("action"), text("target", 200).alias("target"),
        text("detail", 500).alias("detail"), F.lit(as_of).cast("timestamp").alias("created_at"),
    )


def load_missing(stored: DataFrame, offered: DataFrame, name: str) -> DataFrame:
    """The offered rows whose name is not stored yet, once each."""
    return offered.dropDuplicates([name]).join(stored.select(name), name, "left_anti").select(*offered.columns)


def effective_permission(
    items: DataFrame, shares: DataFrame, user: int, workspace_level: Column, as_of: str, teams: DataFrame
) -> DataFrame:
    """(id, permission): manage for the creator; the share for private items; else the greater of
    the workspace's level and the share's. Shares of the user's ``teams`` (team_id, user_id) count."""
    best = (
        live_shares(shares, user, teams, as_of)
        .groupBy("id")
        .agg(F.max(ordinal(F.col("permission"))).alias("shared"))
    )
    shared = F.coalesce("shared", F.lit(0))
    level = (
        F.when(F.col("owner") == user, PERMISSIONS["manage"])
        .when(F.col("private"), shared)
        .otherwise(F.greatest(workspace_level, shared))
    )
    return items.join(best, "id", "left").select("id", permission_name(level).alias("permission"))


def quota_greedy(files: DataFrame, owner: str, order: str, size: str, quota: int) -> DataFrame:
    """(owner, id) of accepted files: in order, a file that does not fit is skipped, later ones may fit.

    Files are dealt by owner and sorted; a task streams through them with one number of
    state, so an owner's files are never held together.
    """
    schema = T.StructType([files.schema[owner], T.StructField("id", files.schema["id"].dataType)])
    dealt = files.select(owner, "id", F.col(size).cast("long").alias("n"), F.col(order).alias("o"))
    dealt = dealt.repartition(owner).sortWithinPartitions(owner, "o", "id").select(owner, "id", "n")

    def run(batches):
        import pyarrow as pa

        now, used, first = None, 0, True
        for batch in batches:
            keep = []
            for who, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if first or who != now:
                    now, used, first = who, 0, False
                fits = used + (n or 0) <= quota
                used += (n or 0) if fits else 0
                keep.append(fits)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=schema.names).filter(pa.array(keep, pa.bool_()))

    return dealt.mapInArrow(run, schema)


def unique_names(df: DataFrame, folder: str, name: str, order: str) -> Column:
    """The name, with `` (n)`` from 2 for the n-th of one name in a folder; a missing folder is one folder."""
    n = F.row_number().over(Window.partitionBy(F.coalesce(F.col(folder), F.lit("")), name).orderBy(order))
    return F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), n, F.lit(")")))


def remap(df: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """``column`` rewritten by (old, new); values without a mapping become null."""
    old = mapping.select(F.col("old").alias(column), "new")
    return df.join(old, column, "left").withColumn(column, F.col("new")).drop("new").select(*df.columns)

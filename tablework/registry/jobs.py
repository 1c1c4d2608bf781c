"""Queries on migrations and message streams."""

from pyspark.sql import functions as F

from tablework.operators.names import name_expr
from tablework.plans import migrate as m
from tablework.registry import Tables, check
from tablework.registry.collections import TABLES
from tablework.session import shared_path
from tablework.streaming import messages as ms


def plan_sides(t: Tables):
    source = t.part.select(F.concat_ws("_", F.lit("source"), "p_partkey").alias("name"), "p_size")
    named = name_expr(source, "name", "case when p_size <= 40 then concat('target_', substring(it, 8)) end")
    return named.select("name", "target"), t.customer.select(F.concat_ws("_", F.lit("target"), "c_custkey").alias("name"))


PLAN = """
    select name, target, case when target is null then 'skip_null_target' when c_custkey is null then 'create' else '{there}' end as action,
           case when target is null or ('{there}' = 'skip_exists' and c_custkey is not null) then 'none' else '{copy}' end as copy
    from (select 'source_' || p_partkey as name, p_partkey, case when p_size <= 40 then 'target_' || p_partkey end as target from part)
    left join customer on c_custkey = p_partkey
"""


@check("migration_plan", PLAN.format(there="skip_exists", copy="copy"))
def _(t):
    return m.migration_plan(*plan_sides(t))


@check("migration_plan_force", PLAN.format(there="replace", copy="meta_only"))
def _(t):
    return m.migration_plan(*plan_sides(t), force=True, merge=True, meta_only=True)


@check("migration_plan_merge", PLAN.format(there="merge", copy="copy"))
def _(t):
    return m.migration_plan(*plan_sides(t), merge=True)


def counts(names, wrap):
    return " union all ".join(wrap(n) for n in names)


@check("migrate_report", counts(TABLES, lambda n: (
    f"select '{n}' as name, '{n}' as target, '{'skip_exists' if n in ('nation', 'orders') else 'create'}' as action, "
    f"'{'none' if n in ('nation', 'orders') else 'copy'}' as copy, "
    f"{'0' if n in ('nation', 'orders') else '(select count(*) from ' + n + ')'} as n_rows, "
    f"'{'skipped' if n in ('nation', 'orders') else 'planned'}' as status")))
def _(t):
    source = m.PathStore(t.spark, t.sf_dir, suffix=".parquet", names=TABLES)
    target = m.PathStore(t.spark, shared_path(t.spark, "migrated"), names=["nation", "orders"])
    report = m.migrate(source, target)
    return report.drop("error").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


@check("migrate_renamed", counts([n for n in TABLES if n.startswith(("p", "l")) or "doc" in n], lambda n: (
    f"select '{n}' as name, 'target_' || substr('{n}', 2) as target, 'create' as action, "
    f"'meta_only' as copy, (select count(*) from {n}) as n_rows, 'planned' as status")))
def _(t):
    source = m.PathStore(t.spark, t.sf_dir, suffix=".parquet", names=TABLES)
    target = m.PathStore(t.spark, shared_path(t.spark, "migrated"), names=[])
    return m.migrate(source, target, include=["^[pl]", "doc"], rename="concat('target_', substring(it, 2))",
                     meta_only=True, skip_empty=True).drop("error")


@check("migrate_applied", """
    select 'n_nation' as name, n_nationkey as key, n_name as label from nation
    union all select 'n_region', r_regionkey, r_name from region
    union all select 'n_supplier', s_suppkey, s_name from supplier
    union all select 'n_customer', c_custkey, c_name from customer
""")
def _(t):
    """Copied for real: renamed, one replaced by force, then read back whole."""
    source = m.PathStore(t.spark, t.sf_dir, suffix=".parquet", names=["nation", "region", "supplier", "customer"])
    target = m.PathStore(t.spark, shared_path(t.spark, "migrated"))
    target.write("n_region", t.region.limit(0), "errorifexists", {})
    m.migrate(source, target, rename="concat('n_', it)", force=True, effect=True)
    back = None
    for name in target.names():
        rows = target.read(name)
        key, label = rows.columns[:2]
        rows = rows.select(F.lit(name).alias("name"), F.col(key).cast("bigint").alias("key"), F.col(label).alias("label"))
        back = rows if back is None else back.unionByName(rows)
    return back


@check("migrate_by_key", """
    select event_id as id, event_type, case when event_id % 3 = 0 then value + 1 else value end as value from events
""")
def _(t):
    """Merged by id: part of the events is there with old values, and the source replaces and adds."""
    rows = t.events.select(F.col("event_id").alias("id"), "event_type", "value", F.lit(1).alias("version"))
    base = shared_path(t.spark, "merged")
    source, target = m.PathStore(t.spark, f"{base}/from"), m.PathStore(t.spark, f"{base}/to")
    target.write("docs", rows.where("id % 2 = 0 or id % 3 = 1"), "errorifexists", {})
    new = rows.where("id % 3 = 0 or id % 2 = 1").withColumn("value", F.expr("if(id % 3 = 0, value + 1, value)")).withColumn("version", F.lit(3))
    stale = new.withColumns({"value": F.lit(-1.0), "version": F.lit(2)})
    source.write("docs", new.unionByName(stale), "errorifexists", {})
    m.migrate(source, target, merge=True, key="id", order="version", effect=True)
    return target.read("docs").select("id", "event_type", "value")


@check("migrate_index", """
    select 'target_part' as name, 'p_partkey,p_name,p_brand,p_type,p_size,p_retailprice' as columns, count(*) as n from part
    union all select 'target_none', 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority', 0
    union all select 'target_old', 's_suppkey,s_name,s_nationkey,s_acctbal', 0
""")
def _(t):
    """Indexes renamed and written with settings; empty ones are created or replaced, only their copy is left out."""
    base = shared_path(t.spark, "index")
    source, target = m.PathStore(t.spark, f"{base}/from"), m.PathStore(t.spark, f"{base}/to")
    source.write("source_part", t.part, "errorifexists", {})
    source.write("source_none", t.orders.where("o_orderkey < 0"), "errorifexists", {})
    source.write("source_old", t.supplier.where("s_suppkey < 0"), "errorifexists", {})
    target.write("target_old", t.supplier, "errorifexists", {})
    m.migrate(source, target, rename="concat('target_', substring(it, 8))", force=True, skip_empty=True,
              settings={"compression": "gzip"}, effect=True)
    found = [target.read(n).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(n).alias("name"), F.lit(",".join(target.read(n).columns)).alias("columns"), "n") for n in target.names()]
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out


@check("migrate_collections", """
    select name, 'new_' || name as target, case when c_custkey is null then 'create' else 'merge' end as action,
           'copy' as copy, n_rows
    from (select event_type || '_' || user_id as name, user_id, count(*) as n_rows from events
          where event_type not like '%err%' group by all)
    left join customer on 'new_view_' || c_custkey = 'new_' || name
""")
def _(t):
    existing = t.customer.select(F.concat_ws("_", F.lit("new_view"), "c_custkey").alias("name"))
    return m.collection_report(t.events, F.concat_ws("_", "event_type", "user_id"), existing,
                               rename="concat('new_', it)", exclude=["err"], merge=True)


def messages(t: Tables):
    """The events as a stream of messages, in several micro-batches that are not in the order of time."""
    path = shared_path(t.spark, "messages")
    t.events.repartition(3, "event_id").write.parquet(path)
    events = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return events.select(F.col("event_type").alias("topic"), F.encode("props", "UTF-8").alias("payload"),
                         F.lit(1).alias("qos"), (F.col("value") > 10).alias("retain"),
                         F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"))


def places(t: Tables, name: str, n: int = 2):
    base = shared_path(t.spark, name)
    return [f"{base}/{part}" for part in ("data", "checkpoint", "printed")[:n]]


def text(col):
    return F.decode(col, "UTF-8").alias(col)


@check("stream_subscribe", """
    select event_id as id, '[click] ' || props as line from events where event_type = 'click'
""")
def _(t):
    data, checkpoint = places(t, "subscribe")
    ms.consume(ms.subscribe(messages(t), "click").select("id", "line"), data, checkpoint).awaitTermination()
    return t.spark.read.schema("id bigint, line string").parquet(data)


@check("stream_consume", "select event_id as id, event_type as topic, props as payload from events")
def _(t):
    data, checkpoint = places(t, "consume")
    ms.consume(messages(t), data, checkpoint).awaitTermination()
    return t.spark.read.parquet(data).select("id", "topic", text("payload"))


@check("stream_relay", """
    select 'relayed' as kind, 'second' as topic, props as body, count(*) as n from events group by props
    union all select 'printed', '', props, count(*) from events group by props
""")
def _(t):
    data, checkpoint, printed = places(t, "relay", 3)
    ms.relay(messages(t), "second", data, printed, checkpoint).awaitTermination()
    relayed = t.spark.read.parquet(data).select(
        F.lit("relayed").alias("kind"), "topic", F.decode("payload", "UTF-8").alias("body"))
    bodies = t.spark.read.parquet(printed).select(
        F.lit("printed").alias("kind"), F.lit("").alias("topic"), F.col("value").alias("body"))
    return relayed.unionByName(bodies).groupBy("kind", "topic", "body").agg(F.count(F.lit(1)).alias("n"))


@check("stream_retained", """
    select event_type as topic, props as payload, event_id as id from events where value > 10
    qualify row_number() over (partition by event_type order by ts desc, event_id desc) = 1
""")
def _(t):
    data, checkpoint = places(t, "retained")
    ms.keep_latest(ms.retained(messages(t)), data, checkpoint).awaitTermination()
    return ms.latest_state(t.spark, data).select("topic", text("payload"), "id")


@check("stream_once", "select event_id as id, event_type as topic, props as payload from events")
def _(t):
    data, checkpoint = places(t, "once")
    twice = messages(t).unionByName(messages(t))
    ms.consume(ms.deliver(twice, qos=2), data, checkpoint).awaitTermination()
    return t.spark.read.parquet(data).select("id", "topic", text("payload"))


@check("stream_once_by_ranges", "select event_id as id, event_type as topic, props as payload from events")
def _(t):
    """Every message twice, the repeats in batches of their own; the ids seen are kept as intervals."""
    data, checkpoint = places(t, "once-by-ranges")
    twice = messages(t).unionByName(messages(t))
    ms.consume(ms.deliver(twice, qos=2, compact=True), data, checkpoint).awaitTermination()
    return t.spark.read.parquet(data).select("id", "topic", text("payload"))


@check("stream_collect", """
    select event_type as key, row_number() over (partition by event_type order by event_id desc) as position, props as value
    from events
""")
def _(t):
    data, checkpoint = places(t, "collect")
    lines = messages(t).withColumn("payload", F.decode("payload", "UTF-8"))
    ms.push_list(lines, "topic", "payload", "id", data, checkpoint).awaitTermination()
    return ms.pushed_list(t.spark, data)

"""Queries on sources and sinks: JSON, catalog, upserts, keyed collections, messages, shards."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tablework.functions.jsons import json_map
from tablework.registry import Tables, check
from tablework.session import shared_path
from tablework.sources import buckets, catalog, files, sinks

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@check("json_props", """
    select event_id, event_type, (props::json->>'k') as k from events
""")
def _(t):
    parsed = files.json_lines(t.events, "props")
    return parsed.select("event_id", "event_type", F.col("props")["k"].alias("k"))


@check("json_records", """
    select source as author, lang as title, text as body, doc_id || '' as no from documents
""")
def _(t):
    path = shared_path(t.spark, "records")
    record = F.to_json(F.array(F.struct(
        F.col("source").alias("author"), F.col("lang").alias("title"),
        F.split("text", "\n").alias("paragraphs"), F.col("doc_id").cast("string").alias("no#"))))
    t.documents.select(record.alias("value")).write.text(path)
    read = files.json_records(t.spark, path, files.VERSE, glob="part-*", multi_line=False)
    return read.select("author", "title", F.array_join("paragraphs", "\n").alias("body"), "no")


@check("file_lines", """
    select count(*) as n_lines, count(distinct md5(value)) as n_distinct,
           sum(length(value))::bigint as n_chars
    from (select unnest(string_split(text, chr(10))) as value from documents)
""")
def _(t):
    path = shared_path(t.spark, "lines")
    t.documents.select(F.col("text").alias("value")).write.text(path)
    lines = files.lines(t.spark, path)
    per_file = lines.groupBy("file").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("line_no").alias("d"), F.max("line_no").alias("m"))
    broken = per_file.where("n <> d or n <> m").select("file")
    kept = lines.join(broken, "file", "left_anti")
    return kept.agg(F.count(F.lit(1)).alias("n_lines"),
                    F.count_distinct(F.md5("value")).alias("n_distinct"),
                    F.sum(F.length("value")).cast("bigint").alias("n_chars"))


@check("table_columns", """
    select 'o_orderkey' as column_name, 'bigint' as type, count(o_orderkey) as n_values from orders
    union all select 'o_custkey', 'bigint', count(o_custkey) from orders
    union all select 'o_orderstatus', 'string', count(o_orderstatus) from orders
    union all select 'o_totalprice', 'double', count(o_totalprice) from orders
    union all select 'o_orderdate', 'timestamp_ntz', count(o_orderdate) from orders
    union all select 'o_orderpriority', 'string', count(o_orderpriority) from orders
""")
def _(t):
    t.orders.createOrReplaceTempView("tablework_orders")
    columns = catalog.table_columns(t.spark, "tablework_orders")
    t.spark.catalog.dropTempView("tablework_orders")
    return columns.join(catalog.column_counts(t.orders), "column_name")


@check("catalog_counts", " union all ".join(
    f"select '{name}' as name, count(*) as n_rows from {name}" for name in TABLES))
def _(t):
    return catalog.table_counts({name: catalog.read_docs(t.spark, f"{t.sf_dir}/{name}.parquet")
                                 for name in TABLES})


UPSERTED = """
    with updates as (select * from (
        select l_partkey, l_shipdate, l_quantity, l_extendedprice, row_number() over (
            partition by l_partkey order by l_orderkey desc, l_linenumber desc, l_shipdate desc,
                l_quantity desc, l_extendedprice desc) as rn from lineitem) where rn = 1)
    select p_partkey as key, coalesce(l_quantity, p_size) as size,
           coalesce(l_extendedprice, p_retailprice) as price
    from part full join updates on p_partkey = l_partkey
    where p_partkey is not null
    union all select l_partkey, l_quantity, l_extendedprice from updates
    where l_partkey not in (select p_partkey from part)
"""


def part_rows(t: Tables):
    return t.part.select(F.col("p_partkey").alias("key"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))


def part_updates(t: Tables):
    """The lines as updates of the parts, in the order of ``at``."""
    return t.lineitem.select(F.col("l_partkey").alias("key"), F.col("l_quantity").alias("size"), F.col("l_extendedprice").alias("price"),
                             F.struct("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_extendedprice").alias("at"))


@check("upsert_by_key", UPSERTED)
def _(t):
    return sinks.upsert_by_key(part_rows(t), part_updates(t), "key", "at")


@check("upsert_bucketed", UPSERTED)
def _(t):
    """The same in a bucketed table, in two upserts: the lines of the lower half of the orders, then the others."""
    table = buckets.BucketedTable.create(part_rows(t), shared_path(t.spark, "bucketed"), "key", buckets=16)
    updates = part_updates(t)
    middle = t.lineitem.agg(F.avg("l_orderkey")).first()[0]
    for half in (F.col("at.l_orderkey") <= middle, F.col("at.l_orderkey") > middle):
        table.upsert(updates.where(half), "at")
    return table.read()


@check("collect_list_by_key", """
    select event_type, row_number() over (partition by event_type order by event_id desc) as position, props
    from events
""")
def _(t):
    return sinks.collect_by_key(t.events, "event_type", "props", "list", "event_id")


@check("collect_set_by_key", "select distinct event_type, props from events")
def _(t):
    return sinks.collect_by_key(t.events, "event_type", "props", "set")


@check("collect_zset_by_key", """
    select event_type, row_number() over (partition by event_type order by score, props) as position, props, score
    from (select event_type, props, max(value) as score from events group by event_type, props)
""")
def _(t):
    return sinks.collect_by_key(t.events, "event_type", "props", "zset", "value")


@check("collect_segments", """
    select event_type, (position - 1) // 100 as segment, string_agg(props, '|' order by position) as list
    from (select event_type, props, row_number() over (partition by event_type order by event_id desc) as position
          from events)
    group by 1, 2
""")
def _(t):
    entries = sinks.collect_by_key(t.events, "event_type", "props", "list", "event_id")
    packed = sinks.in_segments(entries, "event_type", "props", 100)
    return packed.select("event_type", "segment", F.array_join("values", "|").alias("list"))


@check("publish_envelope", """
    select event_type as topic, props as payload, 1 as qos, true as retain, 'text/plain' as content_type
    from events
""")
def _(t):
    envelope = sinks.publish(t.events, "event_type", "props", qos=1, retain=True)
    return envelope.withColumn("payload", F.decode("payload", "UTF-8"))


@check("json_values", """
    select json_extract_string(props, '$.k')::bigint as k, count(*) as n from events group by 1
""")
def _(t):
    k = json_map(F.col("props"))["k"].cast("bigint").alias("k")
    return t.events.groupBy(k).agg(F.count(F.lit(1)).alias("n"))


def order_blocks(t: Tables):
    return t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("statements"))


SHARDS = """
    with recursive blocks as (
        select l_orderkey, count(*) as statements, row_number() over (order by l_orderkey) as no
        from lineitem group by l_orderkey),
    packed as (
        select no, l_orderkey, statements, case when statements > 100 then 2 else 1 end as shard,
               statements as held from blocks where no = 1
        union all
        select b.no, b.l_orderkey, b.statements,
               p.shard + case when p.held + b.statements > 100 then 1 else 0 end,
               case when p.held + b.statements > 100 then b.statements else p.held + b.statements end
        from packed p join blocks b on b.no = p.no + 1)
    select l_orderkey, statements, shard::bigint as shard from packed
"""


@check("sharded_blocks", SHARDS)
def _(t):
    return sinks.shard_numbers(order_blocks(t), "l_orderkey", "statements", 100)


@check("sharded_text", f"""
    select shard, l_orderkey || ':' || l_linenumber as statement,
           row_number() over (partition by shard order by l_orderkey, l_linenumber) as position
    from lineitem join ({SHARDS.replace("100", "2000")}) using (l_orderkey)
""")
def _(t):
    """Statements written into shards and read back in the order of their files and lines."""
    path = shared_path(t.spark, "shards")
    lines = t.lineitem.select("l_orderkey", F.col("l_orderkey").alias("at"), "l_linenumber", F.concat(
        F.col("l_orderkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string")).alias("statement"))
    sinks.sharded_text(lines, "l_orderkey", "at", "l_linenumber", "statement", 2000, path)
    back = t.spark.read.text(path).select("shard", F.col("value").alias("statement"), F.col("_metadata.file_name").alias("file"),
                                          F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))
    placed = F.row_number().over(Window.partitionBy("shard").orderBy("file", "block", "seq"))
    return back.select(F.col("shard").cast("bigint").alias("shard"), "statement", placed.cast("bigint").alias("position"))

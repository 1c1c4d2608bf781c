"""Queries on duplicated keys: part names and document texts."""

from pyspark.sql import functions as F

from tablework.operators import dedupe as d
from tablework.registry import check


@check("duplicate_keys", """
    select p_name, count(p_name) as c from part group by p_name having count(p_name) > 1
""")
def _(t):
    return d.duplicate_keys(t.part, "p_name")


@check("duplicate_rows", """
    select doc_id, lang, source, n_chars from documents
    where text in (select text from documents group by text having count(text) > 1)
""")
def _(t):
    rows = d.duplicate_rows(t.documents, "text")
    return rows.select("doc_id", "lang", "source", "n_chars")


@check("uniqueness", """
    select 'p_partkey' as column_name, true as present, count(p_partkey) as n_values,
           count(distinct p_partkey) as n_distinct,
           count(p_partkey) = count(distinct p_partkey) as is_unique from part
    union all
    select 'p_name', true, count(p_name), count(distinct p_name),
           count(p_name) = count(distinct p_name) from part
    union all
    select 'p_none', false, null, null, null
""")
def _(t):
    return d.uniqueness(t.part, ["p_partkey", "p_name", "p_none"])


@check("group_members", """
    select o_custkey, row_number() over (partition by o_custkey order by o_orderkey desc) as position,
           o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as o_orderdate
    from (select rtrim(o_custkey::varchar) as o_custkey, o_orderkey, o_orderdate,
                 count(*) over (partition by o_custkey) as n from orders)
    where n > 1
""")
def _(t):
    orders = t.orders.withColumn("o_custkey", F.col("o_custkey").cast("string"))
    members = d.group_members(orders, "o_custkey", "o_orderkey", "o_orderdate")
    return members.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


SEQ = """
    select p_partkey, p_name as old_value,
           regexp_replace(p_name, '\\s+$', '') || '_' || (rn - 1) as new_value
    from (select *, row_number() over (partition by regexp_replace(p_name, '\\s+$', '')
                                       order by p_partkey desc) as rn
          from part where p_name is not null)
    where rn > 1
"""


@check("rename_duplicates_seq", SEQ)
def _(t):
    return d.rename_duplicates_seq(t.part, "p_name", "p_partkey")


@check("rename_duplicates_all", """
    select doc_id, source as old_value, source || '_' || (rn - 1) as new_value
    from (select *, row_number() over (partition by source order by doc_id desc) as rn,
                 count(*) over (partition by source) as n
          from documents where source is not null)
    where n > 1
""")
def _(t):
    return d.rename_duplicates_seq(t.documents, "source", "doc_id", skip_first=False)


@check("rename_duplicates_hash", """
    select doc_id, md5(old_text) as old_value, md5(old_text || '_' || suffix) as new_value
    from (select doc_id, regexp_replace(text, '\\s+$', '') as old_text,
                 substr(md5(doc_id || ':7'), 1, 6) as suffix,
                 row_number() over (partition by regexp_replace(text, '\\s+$', '')
                                    order by doc_id desc) as rn
          from documents where text is not null)
    where rn > 1
""")
def _(t):
    named = d.rename_duplicates_uuid(t.documents, "text", "doc_id", seed=7)
    return named.select("doc_id", F.md5(d.trim_right(F.col("old_value"))).alias("old_value"),
                        F.md5("new_value").alias("new_value"))


@check("rename_duplicates_uuid", f"select p_partkey, old_value, true as well_formed from ({SEQ})")
def _(t):
    """The new names are random; their shape is the old name, an underscore and six hex digits."""
    named = d.rename_duplicates_uuid(t.part, "p_name", "p_partkey")
    base = d.trim_right(F.col("old_value"))
    tail = F.expr("substring(new_value, length(old_value) + 1)")
    return named.select("p_partkey", "old_value", (F.col("new_value").startswith(base) & tail.rlike("^_[0-9a-f]{6}$")).alias("well_formed"))


@check("rename_conflicts", """
    with changes as (
        select n_key, old_value || '_' || (rn - 1) as new_value
        from (select c_custkey as n_key, 'seg_' || (c_custkey % 7) as old_value,
                     row_number() over (partition by c_custkey % 7 order by c_custkey desc) as rn
              from customer)
        where rn > 1),
    named as (select 'seg_' || (c_custkey % 7) as v from customer
              union all select 'seg_' || (s_suppkey % 7) || '_' || (s_suppkey % 5) from supplier)
    select n_key, new_value from changes where new_value in (select v from named)
""")
def _(t):
    segment = F.concat(F.lit("seg_"), (F.col("c_custkey") % 7).cast("string"))
    base = t.customer.select(F.col("c_custkey").alias("n_key"), segment.alias("v"))
    more = t.supplier.select(F.col("s_suppkey").alias("n_key"), F.concat(
        F.lit("seg_"), (F.col("s_suppkey") % 7).cast("string"), F.lit("_"),
        (F.col("s_suppkey") % 5).cast("string")).alias("v"))
    changes = d.rename_duplicates_seq(base, "v", "n_key")
    return d.rename_conflicts(base.unionByName(more), "v", changes).select("n_key", "new_value")


@check("update_sql", f"""
    select p_partkey, 'update part set p_name = ''' || replace(new_value, '''', '''''')
                      || ''' where p_partkey = ' || p_partkey || ';' as statement
    from ({SEQ})
""")
def _(t):
    changes = d.rename_duplicates_seq(t.part, "p_name", "p_partkey")
    return d.update_sql(changes, "part", "p_name", "p_partkey")


@check("dedupe_applied", """
    select p_partkey, p_brand, p_size,
           case when rn > 1 then regexp_replace(p_name, '\\s+$', '') || '_' || (rn - 1)
                else p_name end as p_name
    from (select *, row_number() over (partition by regexp_replace(p_name, '\\s+$', '')
                                       order by p_partkey desc) as rn from part)
""")
def _(t):
    table = t.part.select("p_partkey", "p_name", "p_brand", "p_size")
    return d.resolve_duplicates(table, "p_name", "p_partkey")

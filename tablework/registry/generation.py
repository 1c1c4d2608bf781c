"""Queries on generated rows, typed tables, statements and combinations."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.operators import generate as g
from tablework.registry import Tables, check
from tablework.registry.scalars import literals, sql_list


def piece(seed: str, i: int) -> str:
    return f"('0x' || substr(md5({seed}), {8 * i + 1}, 8))::bigint"


def base36(seed: str, at: int, n: int) -> str:
    return (f"array_to_string(list_transform(range({n}), lambda j: substr('0123456789abcdefghijklmnopqrstuvwxyz', "
            f"(('0x' || substr(md5({seed}), {at + 1}, 14))::bigint // (36 ** ({n} - 1 - j))::bigint % 36)::int + 1, 1)), '')")


def of(name: str) -> str:
    return f"concat_ws(':', '3', o_orderkey, '{name}')"


SCHEMA = T.StructType([
    T.StructField("tiny", T.ByteType()), T.StructField("whole", T.LongType()),
    T.StructField("real", T.DoubleType()), T.StructField("money", T.DecimalType(16, 6)),
    T.StructField("word", T.StringType()), T.StructField("code", T.CharType(4)),
    T.StructField("day", T.DateType()), T.StructField("at", T.TimestampNTZType()),
    T.StructField("flag", T.BooleanType()), T.StructField("raw", T.BinaryType()),
    T.StructField("skipped", T.StringType())])


@check("random_rows", f"""
    select o_orderkey, {piece(of('tiny'), 0)} % 127 as tiny, {piece(of('whole'), 0)} % 127 as whole,
           {piece(of('real'), 0)} * 256.0 / 4294967296.0 as real,
           ({piece(of('money'), 0)} % 25600) / 100.0 as money, {base36(of('word'), 0, 7)} as word,
           {base36(of('code'), 0, 4)} as code,
           strftime(date '1970-01-01' + ({piece(of('day'), 0)} % 24837)::int, '%Y-%m-%d') as day,
           strftime(timestamp '1970-01-01' + to_days((({piece(of('at'), 0)} // 86400) % 24837)::int)
                    + to_seconds({piece(of('at'), 0)} % 86400), '%Y-%m-%d %H:%M:%S') as at,
           {piece(of('flag'), 0)} % 2 = 0 as flag,
           substr({base36(of('raw'), 0, 7)}, 1, ({piece(of('raw'), 3)} % 7 + 1)::int) as raw
    from orders
""")
def _(t):
    rows = g.random_columns(t.orders, "o_orderkey", SCHEMA, seed=3, ignored=["skipped"])
    return rows.withColumns({
        "tiny": F.col("tiny").cast("bigint"), "money": F.col("money").cast("double"),
        "day": F.date_format("day", "yyyy-MM-dd"), "at": F.date_format("at", "yyyy-MM-dd HH:mm:ss"),
        "raw": F.decode("raw", "UTF-8")})


@check("batch_no", "select o_orderkey, (row_number() over (order by o_orderkey) - 1) // 100 as batch from orders")
def _(t):
    return g.batch_no(t.orders.select("o_orderkey"), ["o_orderkey"], 100)


@check("batch_no_by_key", """
    select event_id, event_type, (row_number() over (partition by event_type order by event_id) - 1) // 64 as batch from events
""")
def _(t):
    return g.batch_no(t.events.select("event_id", "event_type"), ["event_id"], 64, ["event_type"])


@check("insert_sql", """
    select batch, 'insert into `target` (`c_custkey`, `c_name`, `c_acctbal`) values '
           || string_agg('(' || c_custkey || ', ''' || c_name || ''', ' || printf('%.2f', c_acctbal) || ')', ', ' order by c_custkey)
           || ';' as statement
    from (select *, (row_number() over (order by c_custkey) - 1) // 100 as batch from customer) group by batch
""")
def _(t):
    rows = t.customer.select("c_custkey", "c_name", "c_acctbal")
    return g.insert_sql(rows, "target", ["c_custkey"], 100, "`")


@check("union_distinct", """
    select c_nationkey as nation, c_mktsegment as kind from customer
    union select s_nationkey, 'SUPPLIER' from supplier
""")
def _(t):
    return g.union_distinct(
        t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("kind")),
        t.supplier.select(F.col("s_nationkey").alias("nation"), F.lit("SUPPLIER").alias("kind")))


@check("combinations", """
    with items as (select list(v order by v) as xs, count(*)::int as n from (select distinct o_orderpriority as v from orders)),
    masks as (select xs, n, unnest(range(0, (1::bigint << n) - 1)) as mask from items),
    sets as (select mask, list_transform(list_filter(range(1, n + 1), lambda i: (((1::bigint << n) - 1 - mask) >> (n - i)::int) & 1 = 1),
                                         lambda i: xs[i]) as chosen from masks)
    select len(chosen)::bigint as k, mask, copy, array_to_string(chosen, '|') as items
    from sets, (select unnest([1, 2]) as copy) where len(chosen) in (2, 4, 5)
""")
def _(t):
    found = g.combinations(t.spark, g.distinct_items(t.orders, "o_orderpriority"), ["2", "4-16"], 2)
    return found.select(F.col("k").cast("bigint").alias("k"), "mask", "copy",
                        F.array_join("items", "|").alias("items"))


# Types of the tables made from the orders: the bits of a number made from the key say which.
TYPES = ["bigint", "double", "boolean", "date", "varchar(%d)", "decimal(%d,%d)", "bigint"]
NAMES = ["c_bigint", "c_double", "c_boolean", "c_date", "c_varchar", "c_decimal", "c_bigint"]
FILLED = ["bigint", "double", "boolean", "date", "varchar(16)", "decimal(16,6)", "bigint"]


def specs(t: Tables):
    mask = F.col("o_orderkey") % 127 + 1
    chosen = F.filter(literals(TYPES), lambda _, i: F.getbit(mask, i) == 1)
    return t.orders.select("o_orderkey", F.concat(F.lit("t_"), F.col("o_orderkey").cast("string")).alias("table_name"),
                           chosen.alias("types"))


def column(i: str) -> str:
    """The i-th type's column name; the second bigint of a table is told apart."""
    return f"({sql_list(NAMES)}[{i}] || case when {i} = 7 and (o_orderkey % 127 + 1) & 1 = 1 then '_2' else '' end)"


SPECS = """
    select o_orderkey, 't_' || o_orderkey as table_name,
           list_filter(range(1, 8), lambda i: ((o_orderkey % 127 + 1) >> (i - 1)::int) & 1 = 1) as idx from orders
"""


def created(indent: str, sep: str, tail: str, quote: str = "`") -> str:
    return (f"'create table ' || table_name || ' (' || {sep} || array_to_string(list_transform(idx, lambda i: '{indent}{quote}' || "
            f"{column('i')} || '{quote} ' || {sql_list(FILLED)}[i]), ',' || {sep}) || {sep} || ')' || {tail}")


@check("typed_table_ddl", f"""
    select table_name, {created('    ', 'chr(10)', "' stored as parquet;'")} as statement from ({SPECS})
""")
def _(t):
    style = g.TableStyle(quote="`", suffix="stored as parquet")
    made = g.typed_statements(specs(t), style, row_num=0)
    return made.select("table_name", "statement")


def literal(seed: str, i: str) -> str:
    n = piece(seed, 0)
    number = f"(({n} % 25600) // 100) || '.' || lpad((({n} % 25600) % 100)::varchar, 2, '0')"
    return (f"case when {i} in (1, 7) then ({n} % 127)::varchar when {i} in (2, 6) then {number} "
            f"when {i} = 3 then case when {n} % 2 = 0 then 'true' else 'false' end "
            f"when {i} = 4 then {day(seed)} else '''' || {base36(seed, 0, 7)} || '''' end")


def day(seed: str) -> str:
    return f"'''' || strftime(date '1970-01-01' + ({piece(seed, 0)} % 24837)::int, '%Y-%m-%d') || ''''"


def values(row: str) -> str:
    seed = f"concat_ws(':', '0', table_name, {row}, k - 1)"
    return f"'(' || array_to_string(list_transform(idx, lambda i, k: {literal(seed, 'i')}), ',') || ')'"


@check("typed_table_rows", f"""
    select table_name, no as statement_no, 'insert into ' || table_name || '('
           || array_to_string(list_transform(idx, lambda i: {column('i')}), ',') || ') values '
           || array_to_string(list_transform(range(2 * no - 1, least(2 * no, 3) + 1), lambda r: {values('r')}), ',') || ';' as statement
    from ({SPECS}), (select unnest([1, 2]) as no)
    union all
    select table_name, 0, {created('    ', 'chr(10)', "';'", '')} from ({SPECS})
""")
def _(t):
    made = g.typed_statements(specs(t), g.TableStyle(), row_num=3, batch_size=2)
    return made.select("table_name", "statement_no", "statement")


@check("typed_partitions", f"""
    select table_name, 0 as statement_no, {created('', "' '", "' partitioned by ( p_date date, p_string string );'")} as statement
    from ({SPECS})
    union all
    select table_name, 1, 'insert into ' || table_name || ' partition(p_date=' || {day("'0:' || table_name || ':1:p0'")}
           || ',p_string=''' || {base36("'0:' || table_name || ':1:p1'", 0, 7)} || ''') values ' || {values('1')} || ';'
    from ({SPECS})
""")
def _(t):
    style = g.TableStyle(quote="`", compact=True, partition_types=["date", "string"])
    made = g.typed_statements(specs(t), style, row_num=1)
    return made.select("table_name", "statement_no", "statement")


@check("typed_table_batch", f"""
    select o_orderkey, 'test.t_table_' || (row_number() over (order by o_orderkey) + 100) as table_name,
           array_to_string(list_transform(idx, lambda i: {sql_list(TYPES)}[i]), ', ') as types
    from ({SPECS})
""")
def _(t):
    batch = g.typed_table_batch(specs(t).drop("table_name"), ["o_orderkey"], "test.t_table_%d", 100)
    return batch.withColumn("types", F.array_join("types", ", "))


@check("column_comments", f"""
    select table_name, {column('i')} as column_name, 'comment on column ' || table_name || '.`' || {column('i')}
           || '` is ''Column Type: ' || {sql_list(FILLED)}[i] || ''';' as statement
    from (select *, unnest(idx) as i from ({SPECS}))
""")
def _(t):
    return g.column_comments(specs(t), "comment on column $table.$column is 'Column Type: $type'", quote="`")


def member(i: int, at: int, tail: str = "") -> str:
    seed = f"concat_ws(':', '0', table_name, {i})"
    return f"{base36(seed, at, 4)} || '{tail}'"


def drawn(i: int) -> str:
    return piece(f"concat_ws(':', '0', table_name, 1, {i})", 0)


def fitted(no: int, type_sql: str, literal_sql: str) -> str:
    return f"select table_name, {no} as column_no, {type_sql} as type, {literal_sql} as literal from t"


def listed(no: int, word: str) -> str:
    members = [member(no, 0), member(no, 8, "x")]
    return fitted(no, f"'{word}(''' || {members[0]} || ''',''' || {members[1]} || ''')'",
                  f"'''' || case when {drawn(no)} % 2 = 0 then {members[0]} else {members[1]} end || ''''")


def cut(no: int, word: str, n: int) -> str:
    seed = f"concat_ws(':', '0', table_name, 1, {no})"
    return fitted(no, f"'{word}({n})'", f"'''' || substr({base36(seed, 0, 7)}, 1, {n}) || ''''")


FITTED = " union all ".join([
    listed(0, "enum"), listed(1, "set"), cut(2, "char", 3), cut(3, "varchar", 5),
    fitted(4, "'decimal(3,2)'", f"((({drawn(4)} % 25600) // 100) % 10) || '.' || lpad((({drawn(4)} % 25600) % 100)::varchar, 2, '0')"),
    fitted(5, "'decimal(2)'", f"((({drawn(5)} % 25600) // 100) % 100)::varchar"),
    fitted(6, "'year'", f"({drawn(6)} % 255 + 1901)::varchar")])


@check("typed_values", f"""
    with t as (select 't_' || c_custkey as table_name from customer), v as ({FITTED})
    select *, case when column_no < 2 then contains(type, literal) when column_no = 2 then length(literal) <= 3 + 2
                   when column_no = 3 then length(literal) <= 5 + 2 when column_no = 4 then abs(literal::double) < 10
                   when column_no = 5 then abs(literal::double) < 100 else literal::int between 1901 and 2155 end as fits
    from v
""")
def _(t):
    """Each literal fits the type of its column, which the SQL checks value by value."""
    types = ["enum", "set", "char(3)", "varchar(5)", "decimal(3,2)", "decimal(2)", "year"]
    tables = t.customer.select(F.concat(F.lit("t_"), F.col("c_custkey").cast("string")).alias("table_name"),
                               literals(types).alias("types"))
    return g.typed_values(tables).withColumn("fits", F.lit(True))

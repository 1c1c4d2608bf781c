"""Queries on scalar functions, tax and JSON."""

from pyspark.sql import functions as F

from tablework.functions import brackets, dates, ids, jsons, text, typenames
from tablework.operators import tax
from tablework.operators.jsondiff import adjacent_json_diff
from tablework.registry import Tables, check


def literals(values):
    return F.array(*[F.lit(v) for v in values])


def sql_list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@check("date_add_duration", """
    select o_orderkey, strftime((o_orderdate::date
        + s * (to_years((o_orderkey % 3)::int) + to_months((o_orderkey % 14)::int))
        + s * (to_days((o_orderkey % 40)::int) + to_hours((o_orderkey % 50)::int) + to_minutes((o_orderkey % 7)::int)))::date,
        '%Y-%m-%d') as moved
    from (select *, case when o_orderkey % 2 = 0 then -1 else 1 end as s from orders)
""")
def _(t):
    def part(n, unit):
        return F.concat((F.col("o_orderkey") % n).cast("string"), F.lit(unit))

    duration = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "-").otherwise(""), part(3, "y"),
                        part(14, "mo"), part(40, "d"), part(50, "h"), part(7, "m"))
    moved = dates.date_add_duration(F.col("o_orderdate").cast("date"), F.col("duration"))
    spans = t.orders.select("o_orderkey", "o_orderdate", duration.alias("duration"))
    return spans.select("o_orderkey", F.date_format(moved, "yyyy-MM-dd").alias("moved"))


@check("date_diff_units", """
    select o_orderkey, d as days, d * 24 as hours, d * 1440 as minutes, d * 86400 as seconds
    from (select o_orderkey, date_diff('day', date '1997-06-30', o_orderdate::date) as d from orders)
""")
def _(t):
    units = dates.date_diff_units(F.col("o_orderdate").cast("date"), F.lit("1997-06-30").cast("date"))
    return t.orders.select("o_orderkey", units.alias("u")).select("o_orderkey", "u.*")


@check("date_to_millis", """
    select o_orderkey, epoch_us(o_orderdate::date::timestamp) // 1000 as millis from orders
""")
def _(t):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return t.orders.select("o_orderkey", dates.date_to_millis(day).alias("millis"))


@check("epoch_columns", """
    select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || '.' || lpad((ms % 1000)::varchar, 3, '0') as now_text,
           ms as epoch_ms, ms // 1000 as epoch_s, strftime(ts, '%Y%m%d%H%M%S') as time_id
    from (select event_id, ts, epoch_us(ts) // 1000 as ms from events)
""")
def _(t):
    return t.events.select("event_id", *dates.epoch_columns(F.col("ts")))


@check("fmt_size", """
    select o_orderkey, n, case when n < 1024 then n || 'B' when n < 1048576 then printf('%.2fK', n / 1024)
        when n < 1073741824 then printf('%.2fM', n / 1048576) else printf('%.2fG', n / 1073741824) end as size_text
    from (select o_orderkey, (o_orderkey * o_orderkey // 128) * (o_custkey % 1000) as n from orders)
""")
def _(t):
    n = F.floor(F.col("o_orderkey") * F.col("o_orderkey") / 128) * (F.col("o_custkey") % 1000)
    return t.orders.select("o_orderkey", n.alias("n")).withColumn("size_text", text.fmt_size(F.col("n")))


@check("id_checksum", """
    with made as (
        select c_custkey, case c_custkey % 5 when 0 then 'x' || lpad(c_custkey::varchar, 17, '1')
                               when 1 then lpad(c_custkey::varchar, 17, '1')
                               else lpad((c_custkey * 7919)::varchar, 17, '1') || ['0', '5', 'X'][c_custkey % 3 + 1] end as no
        from customer),
    digits as (
        select *, length(no) = 18 and regexp_full_match(substr(no, 1, 17), '[0-9]{17}') as ok from made),
    summed as (
        select *, case when ok then list_sum(list_transform(range(1, 18), lambda i: substr(no, i, 1)::int
            * [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2][i])) % 11 end as rem from digits)
    select c_custkey, no, case when length(no) <> 18 then 'wrong_length' when not ok then 'not_numeric'
               when substr('10X98765432', rem + 1, 1) = substr(no, 18) then 'valid' else 'wrong_check_digit' end as status,
           case when ok then substr(no, 1, 17) || substr('10X98765432', rem + 1, 1) end as corrected
    from (select *, rem::int as rem_i from summed)
""".replace("rem + 1", "rem_i + 1"))
def _(t):
    key = F.col("c_custkey")
    last = F.get(literals(["0", "5", "X"]), (key % 3).cast("int"))
    no = (F.when(key % 5 == 0, F.concat(F.lit("x"), F.lpad(key.cast("string"), 17, "1")))
          .when(key % 5 == 1, F.lpad(key.cast("string"), 17, "1"))
          .otherwise(F.concat(F.lpad((key * 7919).cast("string"), 17, "1"), last)))
    made = t.customer.select("c_custkey", no.alias("no"))
    return made.withColumn("c", ids.id_checksum(F.col("no"))).select("c_custkey", "no", "c.*")


@check("sql_literal", """
    select o_orderkey, o_orderkey::varchar as key_text, '''' || replace(o_orderpriority, '''', '''''') || '''' as priority_text,
           printf('%.2f', o_totalprice) as price_text, '''' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '''' as time_text,
           '''' || strftime(o_orderdate, '%Y-%m-%d') || '''' as date_text,
           case when o_orderstatus = 'F' then 'true' else 'false' end as flag_text,
           case when o_orderstatus = 'O' then 'NULL' else '''it''''s ' || o_orderstatus || '''' end as note_text
    from orders
""")
def _(t):
    made = t.orders.select(
        "o_orderkey", F.col("o_orderkey").alias("key_text"), F.col("o_orderpriority").alias("priority_text"),
        F.col("o_totalprice").alias("price_text"), F.col("o_orderdate").alias("time_text"),
        F.col("o_orderdate").cast("date").alias("date_text"), (F.col("o_orderstatus") == "F").alias("flag_text"),
        F.when(F.col("o_orderstatus") != "O", F.concat(F.lit("it's "), "o_orderstatus")).alias("note_text"))
    fields = made.schema.fields[1:]
    return made.select("o_orderkey", *[text.sql_literal(F.col(f.name), f.dataType).alias(f.name) for f in fields])


@check("quote_ident", """
    select p_partkey, name as plain, '`' || replace(name, '`', '``') || '`' as back, '"' || name || '"' as double,
           '[' || name || ']' as bracket
    from (select p_partkey, replace(p_name, ' ', '`') as name from part)
""")
def _(t):
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit("`"))
    return t.part.select("p_partkey", text.quote_ident(name, None).alias("plain"),
                         text.quote_ident(name, "`").alias("back"), text.quote_ident(name, '"').alias("double"),
                         text.quote_ident(name, "[%s]").alias("bracket"))


# Type names, their columns and their filled forms, row by row the same.
TYPES = ["bigint", "decimal(%d,%d) unsigned", "varchar(%d)", "double", "timestamp with time zone", "set('a','b')"]
COLUMNS = ["c_bigint", "c_decimal_unsigned", "c_varchar", "c_double", "c_timestamp_with_time_zone", "c_set_a_b"]
FILLED = ["bigint", "decimal(16,6) unsigned", "varchar(16)", "double", "timestamp with time zone", "set('a','b')"]


def typed_parts(t: Tables):
    return t.part.select("p_partkey", F.get(literals(TYPES), (F.col("p_partkey") % 6).cast("int")).alias("type"))


@check("type_column_name", f"""
    select p_partkey, {sql_list(TYPES)}[p_partkey % 6 + 1] as type, {sql_list(COLUMNS)}[p_partkey % 6 + 1] as name from part
""")
def _(t):
    return typed_parts(t).withColumn("name", typenames.type_column_name(F.col("type")))


@check("fill_type", f"""
    select p_partkey, {sql_list(TYPES)}[p_partkey % 6 + 1] as type, {sql_list(FILLED)}[p_partkey % 6 + 1] as filled from part
""")
def _(t):
    return typed_parts(t).withColumn("filled", typenames.fill_type(F.col("type")))


@check("url_filename", r"""
    select page_id, regexp_replace(list_extract(string_split(url, '/'), -1), '\?[^?]*$', '') as file_name from pages
""")
def _(t):
    return t.pages.select("page_id", text.url_filename(F.col("url")).alias("file_name"))


BRACKET = """
    case when x <= 36000 then {0} when x < 144000 then {1} when x < 300000 then {2} when x < 420000 then {3}
         when x < 660000 then {4} when x < 960000 then {5} else {6} end
"""
RATE = BRACKET.format("0.03", "0.10", "0.20", "0.25", "0.30", "0.35", "0.45")
QUICK = BRACKET.format(0, 2520, 16920, 31920, 52920, 85920, 181920)


@check("tax_bracket", f"""
    select o_orderkey, ({RATE})::double as rate, ({QUICK})::double as quick
    from (select o_orderkey, o_totalprice::decimal(18,2) * 2 as x from orders)
""")
def _(t):
    taxable = F.col("o_totalprice").cast("decimal(18,2)") * 2
    found = t.orders.select("o_orderkey", brackets.tax_bracket(taxable).alias("b"))
    return found.select("o_orderkey", F.col("b.rate").cast("double").alias("rate"),
                        F.col("b.quick").cast("double").alias("quick"))


def incomes(t: Tables):
    return t.orders.select(
        F.col("o_custkey").alias("person"), F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").alias("month"), F.col("o_totalprice").cast("decimal(18,2)").alias("income"),
        F.lit(5000).alias("base"), F.lit("1234.56").cast("decimal(18,2)").alias("deduction"),
        F.lit(1500).alias("extra"))


MONTHS = f"""
    select *, x * rate as gross from (select *, {RATE} as rate, {QUICK} as quick from (
        select person, year, month, sum(income - base) over w as x from (
            select o_custkey as person, year(o_orderdate)::int as year, month(o_orderdate)::int as month,
                   sum(o_totalprice::decimal(18,2)) as income, count(*) * (5000 + 1500 + 1234.56)::decimal(18,2) as base
            from orders group by all)
        window w as (partition by person, year order by month)))
"""
DUE = f"""
    select person, year, month, x::double as taxable, rate::double as rate, quick::double as quick,
           (gross - quick - coalesce(lag(gross - quick) over w, 0))::double as tax
    from ({MONTHS}) window w as (partition by person, year order by month)
"""


def as_doubles(df, *cols):
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


@check("withholding", DUE)
def _(t):
    return as_doubles(tax.withholding(incomes(t)), "taxable", "rate", "quick", "tax")


@check("withholding_as_published", DUE.replace("lag(gross - quick)", "lag(gross)"))
def _(t):
    return as_doubles(tax.withholding(incomes(t), as_published=True), "taxable", "rate", "quick", "tax")


@check("tax_summary", f"""
    select person, year, s / 10000.0 as total, sign(s) * ((2 * abs(s) + n) // (2 * n)) / 10000.0 as average
    from (select person, year, count(*) as n, (sum(tax::decimal(18,4)) * 10000)::bigint as s
          from ({DUE}) group by person, year)
""")
def _(t):
    return as_doubles(tax.tax_summary(tax.withholding(incomes(t))), "total", "average")


def order_json(*, flip: bool):
    nested = [F.col("o_orderpriority").alias("p"), F.col("o_custkey").alias("c")]
    fields = [F.col("o_orderstatus").alias("s"), F.struct(*(nested[::-1] if flip else nested)).alias("n")]
    if flip:
        fields[0] = F.when(F.col("o_custkey") % 2 == 0, "F").otherwise(F.col("o_orderstatus")).alias("s")
        fields = [*fields[::-1], F.col("o_orderkey").alias("a")]
    else:
        fields.append(F.col("o_custkey").cast("string").alias("b"))
    return F.to_json(F.struct(*fields))


SORTED_JSON = """'{"b":"' || o_custkey || '","n":{"c":' || o_custkey || ',"p":"' || o_orderpriority || '"},"s":"' || o_orderstatus || '"}'"""


@check("json_sort", f"select o_orderkey, {SORTED_JSON} as sorted from orders")
def _(t):
    return t.orders.select("o_orderkey", jsons.json_sort(order_json(flip=False)).alias("sorted"))


@check("json_diff", """
    select o_orderkey, '{"b":"' || o_custkey || '"' || case when same then '' else ',"s":"' || o_orderstatus || '"' end || '}' as left_diff,
           '{"a":' || o_orderkey || case when same then '' else ',"s":"F"' end || '}' as right_diff
    from (select *, o_custkey % 2 = 1 or o_orderstatus = 'F' as same from orders)
""")
def _(t):
    pair = t.orders.select("o_orderkey", order_json(flip=False).alias("l"), order_json(flip=True).alias("r"))
    return jsons.with_json_diff(pair, "l", "r").select("o_orderkey", "left_diff", "right_diff")


ADJACENT = """
    select event_id, case when props = before then '{}' else replace(before, ' ', '') end as left_diff,
           case when props = before then '{}' else replace(props, ' ', '') end as right_diff
    from (select event_id, props, lag(props) over (OVER order by event_id) as before from events)
    where before is not null
"""


@check("adjacent_json_diff", ADJACENT.replace("OVER", ""))
def _(t):
    found = adjacent_json_diff(t.events.select("event_id", "props"), "props", ["event_id"])
    return found.select("event_id", "left_diff", "right_diff")


@check("adjacent_json_diff_by_key", ADJACENT.replace("OVER", "partition by event_type"))
def _(t):
    found = adjacent_json_diff(t.events.select("event_id", "event_type", "props"), "props",
                               ["event_id"], ["event_type"])
    return found.select("event_id", "left_diff", "right_diff")

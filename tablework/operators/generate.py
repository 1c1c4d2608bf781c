"""Synthetic rows and typed tables, insert statements, batches and combinations."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.functions.hashing import base36, digest, piece
from tablework.functions.text import interpolate, quote_ident, quoted, sql_literal
from tablework.functions.typenames import (family_literal, fill_type, first_word,
                                           spark_type, type_column_name, type_family)
from tablework.plans.skew import ranked

MAX_ITEMS = 30


def random_value(dtype: T.DataType, drawn: Column) -> Column:
    """A value of the type that depends only on the MD5 drawn for it.

    Integers are 0..126, floats 0 up to 256, bytes 1..7 base-36 characters.
    """
    n = piece(drawn, 0)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        value = n * 256.0 / 4294967296.0
    elif isinstance(dtype, T.DecimalType):
        whole = min(dtype.precision - dtype.scale, 3)
        value = (n % (25600 if whole == 3 else 10 ** (whole + 2))).cast("decimal(20,0)") / 100
    elif isinstance(dtype, T.IntegralType):
        value = n % 127
    elif isinstance(dtype, T.BooleanType):
        value = n % 2 == 0
    elif isinstance(dtype, T.BinaryType):
        length = (piece(drawn, 3) % 7 + 1).cast("int")
        value = F.encode(F.substring(base36(drawn, 0, 7), F.lit(1), length), "UTF-8")
    elif isinstance(dtype, T.DateType):
        value = F.date_add(F.lit("1970-01-01").cast("date"), (n % 24837).cast("int"))
    elif isinstance(dtype, T.TimestampType):
        value = F.timestamp_seconds(n % (1 << 31))
    elif isinstance(dtype, T.TimestampNTZType):
        value = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(
            (n / 86400 % 24837).cast("int"), secs=(n % 86400).cast("decimal(18,6)"))
    elif isinstance(dtype, T.DayTimeIntervalType):
        value = F.make_dt_interval((n % 127).cast("int"))
    elif isinstance(dtype, (T.CharType, T.VarcharType)):
        value = base36(drawn, 0, min(7, dtype.length))
    elif isinstance(dtype, T.StringType):
        value = base36(drawn, 0, 7)
    elif isinstance(dtype, T.StructType):
        return F.struct(*[random_value(f.dataType, digest(drawn, f.name)).alias(f.name)
                          for f in dtype.fields])
    elif isinstance(dtype, T.ArrayType):
        return F.array(*[random_value(dtype.elementType, digest(drawn, i)) for i in range(2)])
    elif isinstance(dtype, T.NullType):
        return F.lit(None)
    else:
        raise ValueError(f"unsupported type: {dtype.simpleString()}")
    return value if isinstance(dtype, (T.CharType, T.VarcharType)) else value.cast(dtype)


def random_columns(df: DataFrame, id_col: str, schema: T.StructType, seed: int = 0,
                   ignored: Sequence[str] = ()) -> DataFrame:
    """One random row per id, columns by schema, ignored columns left out."""
    fields = [f for f in schema.fields if f.name not in ignored]
    # One MD5 per value, in a step of its own: the values take several pieces of it.
    drawn = df.select(id_col, *[digest(seed, F.col(id_col), f.name).alias(f"_md5_{f.name}")
                                for f in fields])
    return drawn.select(id_col, *[random_value(f.dataType, F.col(f"`_md5_{f.name}`")).alias(f.name)
                                  for f in fields])


def random_rows(spark: SparkSession, schema: T.StructType, n: int, seed: int = 0,
                ignored: Sequence[str] = ()) -> DataFrame:
    """``n`` random rows for a schema, generated where they are needed."""
    rows = random_columns(spark.range(n).withColumnRenamed("id", "_id"), "_id", schema, seed, ignored)
    return rows.drop("_id")


def batch_no(df: DataFrame, order: Sequence[str], size: int, keys: Sequence[str] = (),
             name: str = "batch") -> DataFrame:
    """Number batches of ``size`` rows from 0, over the table or within keys."""
    numbered = ranked(df, list(keys), list(order), "_no")
    return numbered.withColumn(name, F.floor((F.col("_no") - 1) / size)).drop("_no")


def insert_sql(df: DataFrame, table: str, order: Sequence[str], batch_size: int = 100,
               ident_style: str | None = None) -> DataFrame:
    """Multi-row ``insert`` text, ``(batch, statement)``, ``batch_size`` rows each."""
    columns = df.columns
    names = F.concat_ws(", ", *[quote_ident(F.lit(c), ident_style) for c in columns])
    literals = [sql_literal(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    values = F.concat(F.lit("("), F.concat_ws(", ", *literals), F.lit(")"))
    numbered = ranked(df.select(*order, values.alias("_values")), [], list(order), "_no")
    rows = numbered.select(F.floor((F.col("_no") - 1) / batch_size).alias("batch"), "_no", "_values")
    packed = F.array_sort(F.collect_list(F.struct("_no", "_values")))
    head = F.concat(F.lit("insert into "), quote_ident(F.lit(table), ident_style), F.lit(" ("),
                    names, F.lit(") values "))
    return (rows.groupBy("batch").agg(packed.alias("_rows"))
            .select("batch", F.concat(head, F.array_join("_rows._values", ", "), F.lit(";"))
                    .alias("statement")))


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """The distinct rows of both tables."""
    return a.unionByName(b).distinct()


def parse_sizes(modes: Iterable[str | int]) -> list[int]:
    """``["3", "6-8"]`` gives 3, 6, 7, 8."""
    sizes: set[int] = set()
    for mode in modes:
        low, _, high = str(mode).partition("-")
        sizes.update(range(int(low), int(high or low) + 1))
    return sorted(sizes)


def combinations(spark: SparkSession, items: Sequence[str], modes: Iterable[str | int] = ("3-16",),
                 repeat: int = 1) -> DataFrame:
    """All k-subsets of the items for each wanted k, each repeated 1 to 100 times.

    Rows ``(k, mask, copy, items)``. Sorted by ``k``, ``mask`` and ``copy``
    the subsets of one size stand in lexicographic order. ``spark.range`` counts
    only the wanted subsets, and each is made from its own rank: sizes left out
    cost nothing, and the subsets are never gathered anywhere. No wanted size
    gives no rows.
    """
    n = len(items)
    if n > MAX_ITEMS:
        raise ValueError(f"at most {MAX_ITEMS} items, but: {n}")
    if not 1 <= repeat <= 100:
        raise ValueError(f"repeat is 1 to 100, but: {repeat}")
    k, ways, rank, total = F.lit(0), F.lit(0), F.col("id"), 0
    for size in (size for size in parse_sizes(modes) if 0 < size <= n):
        here = F.col("id") >= total
        k, ways = F.when(here, size).otherwise(k), F.when(here, comb(n, size)).otherwise(ways)
        rank = F.when(here, F.col("id") - total).otherwise(rank)
        total += comb(n, size)

    def take(state, left):
        # ``ways`` subsets of ``need`` of the items left; those with the next item come first.
        with_next = F.floor(state["ways"] * state["need"] / left)
        taken = state["rank"] < with_next
        return F.struct(F.when(taken, state["rank"]).otherwise(state["rank"] - with_next).alias("rank"),
                        F.when(taken, with_next).otherwise(state["ways"] - with_next).alias("ways"),
                        (state["need"] - taken.cast("long")).alias("need"),
                        (state["bits"] * 2 + taken.cast("long")).alias("bits"))

    start = F.struct(rank.alias("rank"), ways.cast("long").alias("ways"), k.cast("long").alias("need"),
                     F.lit(0).cast("long").alias("bits"))
    last = (1 << n) - 1
    # The first item is the highest bit; ``mask`` counts down from all bits.
    lefts = F.array(*[F.lit(left) for left in range(n, 0, -1)]).cast("array<int>")
    bits = F.aggregate(lefts, start, take, lambda state: state["bits"])
    picked = F.filter(F.array(*[F.lit(i) for i in items]),
                      lambda item, i: F.getbit(F.lit(last) - F.col("mask"), F.lit(n - 1) - i) == 1)
    copies = F.explode(F.sequence(F.lit(1), F.lit(repeat)))
    return (spark.range(total).select(k.cast("int").alias("k"), (F.lit(last).cast("long") - bits).alias("mask"))
            .select("k", "mask", picked.alias("items")).withColumn("copy", copies)
            .select("k", "mask", "copy", "items"))


def distinct_items(df: DataFrame, col: str) -> list[str]:
    """The distinct values of a column, sorted; more than the item limit is an error."""
    found = df.select(F.col(col).cast("string").alias("v")).where("v is not null").distinct()
    rows = found.limit(MAX_ITEMS + 1).collect()
    if len(rows) > MAX_ITEMS:
        raise ValueError(f"at most {MAX_ITEMS} items in {col}")
    return sorted(r["v"] for r in rows)


class TableStyle:
    """How typed tables are written: quoting, comments, layout, partitions.

    ``comment`` is a template over ``$table``, ``$column`` and ``$type``.
    With ``comment_alone`` it is a statement of its own, else it follows the
    column. ``postgres`` turns it into ``comment on column`` statements.
    """

    def __init__(self, quote: str | None = None, comment: str | None = None,
                 comment_alone: bool = False, postgres: bool = False, compact: bool = False,
                 extra_column: str | None = None, suffix: str | None = None,
                 partition_types: Sequence[str] = (), seed: int = 0):
        if postgres and comment and not comment.strip().startswith("comment on column"):
            comment = f"comment on column $table.$column is '{comment}'"
            comment_alone = True
        self.quote = '"' if postgres and quote else quote
        self.comment, self.comment_alone, self.postgres = comment, comment_alone, postgres
        self.sep, self.indent = (" ", "") if compact else ("\n", "    ")
        self.extra_column, self.suffix = extra_column, suffix
        self.partition_types, self.seed = list(partition_types), seed

    def with_columns(self, specs: DataFrame, table: str, types: str,
                     families: bool = False) -> DataFrame:
        """Add ``_columns``: array of ``(name, type, family)``, placeholders
        filled, equal names told apart. The family is there when asked for."""
        def read(raw: Column, i: Column) -> Column:
            word = first_word(raw) if families else F.lit("")
            return F.struct(raw.alias("raw"), word.alias("word"),
                            fill_type(raw, digest(self.seed, F.col(table), i)).alias("type"))

        def name(column: Column) -> Column:
            shown = F.when(column["raw"].isin("set", "enum"), column["type"]).otherwise(column["raw"])
            family = type_family(column["raw"], column["word"]) if families else F.lit("")
            return F.struct(type_column_name(shown).alias("name"), column["type"].alias("type"),
                            family.alias("family"))

        def tell_apart(column: Column, i: Column) -> Column:
            seen = F.size(F.filter(F.slice("_named", F.lit(1), i + 1),
                                   lambda other: other["name"] == column["name"]))
            again = F.when(seen > 1, F.concat(column["name"], F.lit("_"), seen.cast("string")))
            return F.struct(F.coalesce(again, column["name"]).alias("name"),
                            column["type"].alias("type"), column["family"].alias("family"))

        # Lambdas know no common subexpressions: what is used twice is made in a step of its own.
        named = specs.withColumn("_named", F.transform(F.transform(types, read), name))
        all_differ = F.size(F.array_distinct("_named.name")) == F.size("_named")
        return named.withColumn("_columns", F.when(all_differ, F.col("_named")).otherwise(
            F.transform("_named", tell_apart))).drop("_named")

    def comment_text(self, table: Column, column: Column) -> Column:
        return interpolate(self.comment, table=table, column=quote_ident(column["name"], self.quote),
                           type=column["type"])

    def create(self, table: Column, columns: Column) -> Column:
        def line(column: Column) -> Column:
            text = F.concat(F.lit(self.indent), quote_ident(column["name"], self.quote), F.lit(" "),
                            column["type"])
            if self.comment and not self.comment_alone:
                text = F.concat(text, F.lit(" comment "), quoted(self.comment_text(table, column)))
            return text

        extra = f"    {self.extra_column},{self.sep}" if self.extra_column else ""
        return F.concat(F.lit("create table "), table, F.lit(f" ({self.sep}{extra}"),
                        F.array_join(F.transform(columns, line), f",{self.sep}"),
                        F.lit(f"{self.sep})"), self._partitioned_by(),
                        F.lit(f" {self.suffix};" if self.suffix else ";"))

    def _partition_name(self, type_name: str) -> Column:
        return type_column_name(F.lit(type_name), prefix="p_")

    def _partitioned_by(self) -> Column:
        if not self.partition_types:
            return F.lit("")
        lines = [F.concat(F.lit(self.indent), self._partition_name(t), F.lit(" "), fill_type(F.lit(t)))
                 for t in self.partition_types]
        return F.concat(F.lit(f" partitioned by ({self.sep}"), F.concat_ws(f",{self.sep}", *lines),
                        F.lit(f"{self.sep})"))

    def comment_statement(self, table: Column, column: Column) -> Column:
        text = self.comment_text(table, column)
        return F.when(text.endswith(";"), text).otherwise(F.concat(text, F.lit(";")))

    def insert(self, table: Column, columns: Column, first_row: Column, last_row: Column) -> Column:
        def value_row(row: Column) -> Column:
            drawn = F.transform(columns, lambda c, i: F.struct(
                c["family"].alias("family"), c["type"].alias("type"), digest(self.seed, table, row, i).alias("md5")))
            values = F.transform(drawn, lambda d: family_literal(d["family"], d["md5"], self.postgres, d["type"]))
            return F.concat(F.lit("("), F.array_join(values, ","), F.lit(")"))

        rows = F.array_join(F.transform(F.sequence(first_row, last_row), value_row), ",")
        if self.partition_types:
            fixed = [F.concat(self._partition_name(t), F.lit("="), family_literal(
                type_family(F.lit(t), first_word(F.lit(t))), digest(self.seed, table, first_row, f"p{i}"), declared=fill_type(F.lit(t))))
                for i, t in enumerate(self.partition_types)]
            where = F.concat(F.lit(" partition("), F.concat_ws(",", *fixed), F.lit(")"))
        else:
            names = F.transform(columns, lambda c: quote_ident(c["name"], self.quote))
            where = F.concat(F.lit("("), F.array_join(names, ","), F.lit(")"))
        return F.concat(F.lit("insert into "), table, where, F.lit(" values "), rows, F.lit(";"))


def typed_statements(specs: DataFrame, style: TableStyle | None = None, row_num: int = 1,
                     batch_size: int = 1, table: str = "table_name", types: str = "types") -> DataFrame:
    """Statements that make and fill one table per row of ``specs``.

    Rows ``(table, statement_no, statement)``: the ``create table``, then the
    comment statements, then the inserts of ``batch_size`` rows each. Every
    statement is built on its own row, however many rows a table gets.
    """
    style = style or TableStyle()
    batches = -(-row_num // batch_size) if row_num > 0 else 0
    base = style.with_columns(specs, table, types, families=batches > 0)
    alone = bool(style.comment and style.comment_alone)
    comments = F.size("_columns") if alone else F.lit(0)
    numbered = base.withColumn("statement_no", F.explode_outer(F.sequence(F.lit(0), comments + batches)))
    number, columns = F.col("statement_no"), F.col("_columns")
    text = F.when(number == 0, style.create(F.col(table), columns))
    if alone:
        text = text.when(number <= comments, style.comment_statement(
            F.col(table), F.get(columns, number - 1)))
    if batches:
        first = (number - comments - 1) * batch_size + 1
        last = F.least(first + (batch_size - 1), F.lit(row_num))
        text = text.otherwise(style.insert(F.col(table), columns, first, last))
    kept = [c for c in specs.columns if c != types]
    return numbered.select(*kept, "statement_no", text.alias("statement"))


def column_comments(specs: DataFrame, comment: str, table: str = "table_name",
                    types: str = "types", quote: str | None = None) -> DataFrame:
    """One comment statement per column: ``(table, column_name, statement)``."""
    style = TableStyle(quote=quote, comment=comment, comment_alone=True)
    exploded = style.with_columns(specs, table, types).select(
        table, F.explode_outer("_columns").alias("_c")).where("_c is not null")
    return exploded.select(table, F.col("_c.name").alias("column_name"),
                           style.comment_statement(F.col(table), F.col("_c")).alias("statement"))


def typed_values(specs: DataFrame, style: TableStyle | None = None, row: int = 1,
                 table: str = "table_name", types: str = "types") -> DataFrame:
    """The literals that row ``row`` of each table gets: ``(table, column_no, type, literal)``."""
    style = style or TableStyle()
    made = style.with_columns(specs, table, types, families=True).select(table, F.posexplode("_columns").alias("column_no", "_c"))
    drawn = digest(style.seed, F.col(table), row, F.col("column_no"))
    return made.select(table, "column_no", F.col("_c.type").alias("type"),
                       family_literal(F.col("_c.family"), drawn, style.postgres, F.col("_c.type")).alias("literal"))


def typed_table(spark: SparkSession, types: Sequence[str], name: str, style: TableStyle | None = None,
                row_num: int = 1, batch_size: int = 1) -> tuple[T.StructType, DataFrame]:
    """Schema and statements of one table with a column per type.

    Partition columns stand at the end of the schema, as Spark keeps them.
    """
    if not types:
        raise ValueError("at least one type is required")
    style = style or TableStyle()
    specs = spark.createDataFrame([(name, list(types))], "table_name string, types array<string>")
    made = style.with_columns(specs, "table_name", "types").first()["_columns"]
    parts = specs.select(*[F.struct(style._partition_name(t).alias("name"),
                                    fill_type(F.lit(t)).alias("type")) for t in style.partition_types]
                         or [F.lit(None)]).first() if style.partition_types else []
    schema = T.StructType([T.StructField(c["name"], spark_type(c["type"])) for c in [*made, *parts]])
    return schema, typed_statements(specs, style, row_num, batch_size)


def typed_table_batch(specs: DataFrame, order: Sequence[str], prefix: str = "t_table_%d",
                      offset: int = 0) -> DataFrame:
    """Name one table per row: ``prefix`` filled with the row's number (from 1) plus offset."""
    numbered = ranked(specs, [], list(order), "_no")
    return numbered.withColumn("table_name", F.format_string(prefix, F.col("_no") + offset)).drop("_no")


def type_lists(lines: DataFrame, col: str = "value") -> DataFrame:
    """Add ``types``: each line split on comma and blank."""
    return lines.withColumn("types", F.split(col, ", "))


def union_types(types: Sequence[Column]) -> Column:
    """Distinct union of type arrays, first occurrence order."""
    return F.array_distinct(reduce(F.concat, types))

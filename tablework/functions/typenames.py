"""SQL type names: placeholders, column names, Spark types, sample literals."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.functions.hashing import base36, digest, piece

# SQL type names by the Spark type they become.
TYPE_NAMES = {
    T.BinaryType(): "varbyte binary varbinary longbinary blob tinyblob mediumblob longblob bytea",
    T.BooleanType(): "bool boolean",
    T.ByteType(): "int1 byte byteint tinyint",
    T.ShortType(): "int2 short smallint",
    T.IntegerType(): "int4 int integer mediumint year",
    T.LongType(): "int8 long bigint oid",
    T.FloatType(): "float float32 float4",
    T.DoubleType(): "float64 double real float8",
    T.StringType(): "name char varchar long_varchar graphic vargraphic long_vargraphic text tinytext "
                    "mediumtext longtext clob json xml string time time_with_time_zone timetz "
                    "character bpchar nchar nvarchar set enum jsonb uuid inet cidr macaddr "
                    "tsvector tsquery",
    T.DateType(): "date",
    T.TimestampType(): "timestamp timestamptz",
    T.TimestampNTZType(): "datetime timestamp_with_time_zone",
    T.DayTimeIntervalType(): "interval",
}
_BY_NAME = {name.replace("_", " "): dtype for dtype, names in TYPE_NAMES.items()
            for name in names.split()}
_POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
# Element type of each range type.
RANGE_ELEMENTS = {
    "int4range": T.IntegerType(), "int8range": T.LongType(), "numrange": T.DecimalType(38, 18),
    "tsrange": T.TimestampNTZType(), "tstzrange": T.TimestampType(), "daterange": T.DateType(),
}
# Signed types wide enough for the unsigned ones.
_UNSIGNED = {T.ByteType(): T.ShortType(), T.ShortType(): T.IntegerType(),
             T.IntegerType(): T.LongType(), T.LongType(): T.DecimalType(20, 0)}


def spark_type(name: str, unsupported_as_null: bool = False) -> T.DataType:
    """The Spark type for a SQL type name such as ``varchar(20)`` or ``bigint unsigned``."""
    text = re.sub(r"\s+", " ", name.strip().lower())
    unsigned = text.endswith(" unsigned")
    text = text.removesuffix(" unsigned")
    found = re.fullmatch(r"([a-z0-9 ]+?)\s*(?:\((.*)\))?( with time zone)?", text)
    if found is None:
        raise ValueError(f"unsupported type: {name}")
    base = found.group(1) + (found.group(3) or "")
    args = [int(a) for a in re.findall(r"\d+", found.group(2) or "")]
    if base in ("numeric", "decimal"):
        return T.DecimalType(*(args or [38, 18]))
    if base in ("char", "character", "nchar") and args:
        return T.CharType(args[0])
    if base in ("varchar", "nvarchar") and args:
        return T.VarcharType(args[0])
    if base in ("bit", "varbit"):
        return T.BinaryType()
    if base == "point":
        return _POINT
    if base in ("box", "lseg", "polygon"):
        return T.ArrayType(_POINT)
    if base == "circle":
        return T.StructType([T.StructField("center", _POINT), T.StructField("radius", T.DoubleType())])
    if base in RANGE_ELEMENTS:
        element = RANGE_ELEMENTS[base]
        return T.StructType([T.StructField("lower", element), T.StructField("upper", element),
                             T.StructField("lower_inc", T.BooleanType()),
                             T.StructField("upper_inc", T.BooleanType())])
    if base not in _BY_NAME:
        if unsupported_as_null:
            return T.NullType()
        raise ValueError(f"unsupported type: {name}")
    dtype = _BY_NAME[base]
    return _UNSIGNED.get(dtype, dtype) if unsigned else dtype


def fill_type(type_col: Column, drawn: Column | None = None) -> Column:
    """Fill ``%d`` marks: one becomes 16, two become 16 and 6; more is an error.

    ``set`` and ``enum`` get a member list drawn from an MD5, the same
    wherever the same column is written.
    """
    marks = F.length(type_col) - F.length(F.replace(type_col, F.lit("%d"), F.lit("%")))
    first = F.replace(type_col, F.lit("%d"), F.lit("16"))
    both = F.concat(F.split_part(type_col, F.lit("%d"), F.lit(1)), F.lit("16"),
                    F.split_part(type_col, F.lit("%d"), F.lit(2)), F.lit("6"),
                    F.split_part(type_col, F.lit("%d"), F.lit(3)))
    drawn = digest("members") if drawn is None else drawn
    members = F.concat(type_col, F.lit("('"), base36(drawn, 0, 4), F.lit("','"),
                       base36(drawn, 8, 4), F.lit("x')"))
    return (F.when(type_col.isin("set", "enum"), members)
            .when(marks == 0, type_col).when(marks == 1, first).when(marks == 2, both)
            .otherwise(F.raise_error(F.concat(F.lit("invalid type: "), type_col))))


def type_column_name(type_col: Column, prefix: str = "c_") -> Column:
    """Column name made from a type: blanks to underscores, placeholders and
    parentheses dropped, member lists flattened."""
    listed = type_col.startswith("set(") | type_col.startswith("enum(")
    plain = F.translate(F.replace(type_col, F.lit("%d"), F.lit("")), " (),'", "_")
    return F.concat(F.lit(prefix),
                    F.when(listed, F.translate(type_col, " ,()'", "___")).otherwise(plain))


# First words of the type names by the kind of literal they take.
FAMILIES = {
    "bit": "bit varbit",
    "int": "int int1 int2 int4 int8 integer tinyint smallint mediumint bigint byte byteint short "
           "oid year",
    "number": "float float32 float64 float4 float8 double real decimal numeric",
    "boolean": "bool boolean",
    "date": "date",
    "timestamp": "datetime timestamp timestamptz",
    "time": "time timetz",
    "binary": "binary varbinary longbinary varbyte blob tinyblob mediumblob longblob bytea",
    "json": "json jsonb",
    "uuid": "uuid",
    "address": "inet cidr",
    "mac": "macaddr",
    "interval": "interval",
    "range": "int4range int8range numrange tsrange tstzrange daterange",
    "point": "point",
    "points": "box lseg polygon",
    "circle": "circle",
}


def first_word(type_col: Column) -> Column:
    return F.lower(F.regexp_extract(type_col, r"^\w+", 0))


def type_family(type_col: Column, word: Column) -> Column:
    """Which kind of literal a type takes, by its first word; ``string`` where
    that is none of the listed."""
    found = F.when(type_col.isin("long"), "int").when(word.isin("char", "varchar"), "string")
    for family, names in FAMILIES.items():
        found = found.when(word.isin(*names.split()), family)
    return found.otherwise("string")


def family_literal(family: Column, drawn: Column, postgres: bool = False, declared: Column | None = None) -> Column:
    """A SQL literal for a type family (see :func:`type_family`), fixed by an MD5.

    With the ``declared`` type it fits: a member of an ``enum`` or ``set``, at most the length of a ``char`` or
    ``varchar``, within precision and scale of a decimal, a ``year`` from 1901 to 2155.
    """
    def q(text: Column) -> Column:
        return F.concat(F.lit("'"), text, F.lit("'"))

    n = piece(drawn, 0)
    small = (n % 127).cast("string")
    cents = n % 25600
    number = F.concat(F.floor(cents / 100).cast("string"), F.lit("."),
                      F.lpad((cents % 100).cast("string"), 2, "0"))
    text = base36(drawn, 0, 7)
    year = None
    if declared is not None:
        limit = F.regexp_extract(declared, r"^(?:var)?(?:char|binary)\((\d+)\)", 1)
        members = F.regexp_extract_all(declared, F.lit("'([^']*)'"), F.lit(1))
        text = F.when(declared.rlike("^(?i:enum|set)\\("), F.get(members, (n % F.size(members)).cast("int"))) \
            .when(limit != "", F.substring(text, F.lit(1), limit.cast("int"))).otherwise(text)
        year = F.lower(declared).startswith("year")
        places = [F.regexp_extract(declared, r"^(?i:decimal|numeric)\((\d+)(?:, *(\d+))?\)", i) for i in (1, 2)]
        scale = F.when(places[1] == "", 0).otherwise(places[1].try_cast("int"))
        before = F.least(F.greatest(places[0].try_cast("int") - scale, F.lit(0)), F.lit(3))
        cut = F.concat((F.floor(cents / 100) % F.get(F.array(*[F.lit(10 ** k) for k in range(4)]), before)).cast("string"),
                       F.when(scale == 0, "").when(scale == 1, F.concat(F.lit("."), (F.floor(cents / 10) % 10).cast("string")))
                       .otherwise(F.concat(F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))))
        number = F.when(places[0] != "", cut).otherwise(number)
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), (n % 24837).cast("int")),
                        "yyyy-MM-dd")
    second = piece(drawn, 1) % 86400

    def two(value: Column) -> Column:
        return F.lpad(F.floor(value).cast("string"), 2, "0")

    clock = F.concat(two(second / 3600), F.lit(":"), two((second % 3600) / 60), F.lit(":"),
                     two(second % 60))
    bit = F.concat(q((n % 2).cast("string")), F.lit("::bit(16)" if postgres else ""))
    point = F.concat(F.lit("("), small, F.lit(",1)"))
    return (F.when(family == "bit", bit)
            .when((family == "int") & (F.lit(False) if year is None else year), (n % 255 + 1901).cast("string"))
            .when(family == "int", small)
            .when(family == "number", number)
            .when(family == "boolean", F.when(n % 2 == 0, "true").otherwise("false"))
            .when(family == "date", q(day))
            .when(family == "time", q(clock))
            .when(family == "timestamp", q(F.concat(day, F.lit(" "), clock)))
            .when(family == "json", q(F.concat(F.lit('{"k": '), small, F.lit("}"))))
            .when(family == "uuid", q(F.concat_ws(
                "-", *[F.substring(drawn, at, size) for at, size in
                       [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]])))
            .when(family == "address", q(F.concat(F.lit("10.0.0."), small)))
            .when(family == "mac", q(F.concat(F.lit("08:00:2b:00:00:"), F.substring(drawn, 1, 2))))
            .when(family == "interval", q(F.concat(small, F.lit(" days"))))
            .when(family == "range", q(F.lit("empty")))
            .when(family == "point", q(point))
            .when(family == "points", q(F.concat(F.lit("("), point, F.lit(",(0,0))"))))
            .when(family == "circle", q(F.concat(F.lit("<"), point, F.lit(",1>"))))
            .otherwise(q(text)))

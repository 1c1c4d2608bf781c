"""Worked examples and edge cases of the operators and functions."""

import datetime
import itertools
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.functions import brackets, dates, ids, jsons, text, typenames
from tablework.operators import dedupe, files, generate, lines, names, search, tax


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def texts(spark, *values, name="value"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


@pytest.mark.parametrize("date,duration,want", [
    ("2001-04-01", "-1y3d", "2000-03-29"), ("2001-04-01", "1mo", "2001-05-01"),
    ("2001-01-31", "1mo", "2001-02-28"), ("2001-04-01", "25h", "2001-04-02"),
    ("2001-04-01", "-1m", "2001-03-31"), ("2001-04-01", "59s", "2001-04-01"), ("2001-04-01", "soon", None)])
def test_date_add_duration(spark, date, duration, want):
    got = one(spark, dates.date_add_duration(F.lit(date).cast("date"), F.lit(duration)))
    assert got == (datetime.date.fromisoformat(want) if want else None)


def test_date_diff_units(spark):
    d1, d2 = (F.lit(d).cast("date") for d in ("2001-04-01", "2001-04-30"))
    assert tuple(one(spark, dates.date_diff_units(d1, d2))) == (-29, -696, -41760, -2505600)
    assert tuple(one(spark, dates.date_diff_units(d2, d1))) == (29, 696, 41760, 2505600)


def test_millis(spark):
    assert one(spark, dates.date_to_millis(F.lit("1970-01-02"))) == 86_400_000
    assert one(spark, dates.date_to_millis(F.lit("no date"))) is None
    assert one(spark, dates.date_to_millis()) > 1_600_000_000_000
    now = spark.range(1).select(*dates.epoch_columns()).first()
    assert now["epoch_ms"] // 1000 == now["epoch_s"] and len(now["time_id"]) == 14


def test_fmt_size_like_printf(spark):
    sizes = [0, 1, 1023, 1024, 1025, 1029, 1152, 1536, 5125, 5135, (1 << 20) - 1, 1 << 20, 1310720, 1 << 25,
             (1 << 30) - 1, 1 << 30, 5 << 29, (1 << 40) + 12345678901, 1 << 60]

    def printf(n):
        for bits, unit in ((10, "B"), (20, "K"), (30, "M")):
            if n < 1 << bits:
                return f"{n}B" if unit == "B" else f"{n / (1 << (bits - 10)):.2f}{unit}"
        return f"{n / (1 << 30):.2f}G"

    df = spark.createDataFrame([(n,) for n in sizes], "n bigint").withColumn("s", text.fmt_size(F.col("n")))
    assert {r.n: r.s for r in df.collect()} == {n: printf(n) for n in sizes}


@pytest.mark.parametrize("no,status,corrected", [
    ("11010519491231002X", "valid", "11010519491231002X"),
    ("110105194912310021", "wrong_check_digit", "11010519491231002X"),
    (" 11010519491231002X ", "valid", "11010519491231002X"),
    ("1101", "wrong_length", None), ("x1010519491231002X", "not_numeric", None)])
def test_id_checksum(spark, no, status, corrected):
    assert tuple(one(spark, ids.id_checksum(F.lit(no)))) == (status, corrected)


def test_json(spark):
    assert one(spark, jsons.json_sort(F.lit('{"b":{"y":1,"x":[2,{"q":1,"p":2}]},"a":null}'))) == \
        '{"a":null,"b":{"x":[2,{"p":2,"q":1}],"y":1}}'
    assert one(spark, jsons.json_sort(F.lit("{broken"))) is None
    pair = spark.createDataFrame([('{"n":1,"t":"1","o":{"a":1,"b":2},"z":null}', '{"t":1,"o":{"b":2,"a":1},"n":1}')],
                                 "l string, r string")
    got = jsons.with_json_diff(pair, "l", "r").first()
    assert (got.left_diff, got.right_diff) == ('{"t":"1","z":null}', '{"t":1}')


@pytest.mark.parametrize("income,rate,quick", [
    (36000, "0.03", 0), (Decimal("36000.01"), "0.10", 2520), (144000, "0.20", 16920), (300000, "0.25", 31920),
    (420000, "0.30", 52920), (660000, "0.35", 85920), (960000, "0.45", 181920), (-5, "0.03", 0)])
def test_tax_bracket(spark, income, rate, quick):
    assert tuple(one(spark, brackets.tax_bracket(F.lit(income)))) == (Decimal(rate), quick)


def test_withholding_year(spark):
    rows = [("p", 2020, m, 80000 if m == 12 else 20000, 5000, 3600, 1500) for m in range(1, 13)]
    year = spark.createDataFrame(rows, "person string, year int, month int, income int, base int, deduction int, extra int")
    corrected = tax.tax_summary(tax.withholding(year)).first()
    assert (corrected.total, corrected.average) == (Decimal(18840), Decimal(1570))
    published = tax.tax_summary(tax.withholding(year, as_published=True)).first()
    assert (published.total, published.average) == (Decimal(-1320), Decimal(-110))
    # Several payments in a month count together.
    halves = year.withColumn("income", F.col("income") / 2).withColumn("base", F.col("base") / 2)
    twice = halves.unionByName(halves.withColumns({"deduction": F.lit(0), "extra": F.lit(0)}))
    assert tax.tax_summary(tax.withholding(twice)).first().total == Decimal(18840)


def test_url_filename(spark):
    urls = {"http://h/a/b.txt?x=1?y": "b.txt?x=1", "http://h/a/": "", "b": "b", "http://h/a?p=/c?d": "c"}
    df = texts(spark, *urls).withColumn("f", text.url_filename(F.col("value")))
    assert {r.value: r.f for r in df.collect()} == urls


def test_trim_and_paths(spark):
    assert one(spark, text.trim_right(F.lit("a b \t\n"))) == "a b"
    assert [one(spark, text.parent_dir(F.lit(p))) for p in ("a/b/c", "c", "/c")] == ["a/b", "", ""]


def test_replacements(spark):
    line = texts(spark, "int a = b.getC();")
    got = names.rewrite_lines(line, r"\w+ (\w+) = (.+?;)", r"this.\1 = \2").first()["value"]
    assert got == "this.a = b.getC();"
    assert text.java_replacement(r"\2-\1$\\n\n") == "$2-$1\\$\\\\n\\\\n"


@pytest.mark.parametrize("pattern,repl,n,want", [
    ("a", "<>", 1, "<>bab\nab"), ("a", "<>", 2, "<>b<>b\nab"), ("a", "<>", 9, "<>b<>b\n<>b"), ("a", "$1", 0, "$1b$1b\n$1b"),
    ("(a)(b)", r"\2\1", 2, "baba\nab"), ("^", ">", 1, ">abab\nab"), ("x", "y", 1, "abab\nab"),
    (r"\b", "<>", 1, "<>abab\nab"), (r"\b", "<>", 2, "<>abab<>\nab"), ("(?=b)", "-", 1, "a-bab\nab"), ("(?=b)", "-", 2, "a-ba-b\nab"),
    (r"\p{L}+", "<>", 1, "<>\nab"), (r"\p{L}+", "<>", 2, "<>\n<>"), (r"(\p{L})(\p{L})\1", r"[\2\1]", 1, "[ba]b\nab"),
    (r"(\p{L})b", r"\1\1", 2, "aaaa\nab"), ("(b)", r"\1$5", 1, "ab$5ab\nab")])
def test_replace_first_n(spark, pattern, repl, n, want):
    df = texts(spark, "abab\nab", None)
    assert [r.value for r in names.replace_first_n(df, "value", pattern, repl, n).collect()] == [want, None]


def test_renames(spark):
    paths = texts(spark, "/d/ab1.txt", "x/ab2", "ab3", "x/zz", "/ab4", name="path")
    full = names.rename_full(paths, "path", r"ab(\d)(?:\.txt)?", "n$1")
    assert {r.path: r.target for r in full.collect()} == {
        "/d/ab1.txt": "/d/n1", "x/ab2": "x/n2", "ab3": "n3", "/ab4": "/n4"}
    start = names.rename_prefix(paths, "path", r"(a)(b)", r"\2\1")
    assert {r.target for r in start.collect()} == {"/d/ba1.txt", "x/ba2", "ba3", "/ba4"}


def test_name_filter_include_wins(spark):
    df = texts(spark, "apple", "grape", "plum")
    def kept(**patterns):
        return {r.value for r in names.name_filter(df, "value", **patterns).collect()}

    assert kept(include=["^ap", "lu"], exclude=["apple"]) == {"apple", "plum"}
    assert kept(exclude=["ap"]) == {"plum"} and kept() == {"apple", "grape", "plum"}


def test_name_expr(spark):
    df = texts(spark, "source_x", name="name")
    expr = "concat('target_', substring(it, length('source_') + 1))"
    assert names.name_expr(df, "name", expr).first()["target"] == "target_x"
    assert names.name_expr(df, "name", "  ").first()["target"] == "source_x"
    with pytest.raises(ValueError, match="no_such"):
        names.name_expr(df, "name", "no_such(it)")


def test_strip_marker_only_in_front(spark):
    df = texts(spark, "M - a", "a M - ", "M")
    assert [r.value for r in names.strip_marker(df, "value", "M - ").collect()] == ["a", "a M - ", "M"]


def test_search(spark):
    docs = spark.createDataFrame([
        (1, "li", "moon", ["white moon", "old home"]), (2, "li", None, ["moon"]), (3, None, "moon", ["moon"]),
        (4, "du", "moon", ["moon"]), (5, "li", "sun", ["moon"]), (6, "li", "moon", None)],
        "id int, author string, title string, paragraphs array<string>")
    def found(**by):
        return {r.id for r in search.search_docs(docs, **by).collect()}

    assert found() == {1, 2, 4, 5}
    assert found(authors=["li"], titles=["moon"]) == {1, 2}
    assert found(phrases=["moon", "home"]) == {1}
    assert found(phrases=["white home"]) == set()
    assert found(predicate=F.col("id") > 3) == {4, 5}


def test_lines_sets(spark):
    a, b = texts(spark, "x", "y", "y", "z"), texts(spark, "y", "q", "y")
    inside, outside = lines.lines_in(a, b).collect(), lines.lines_not_in(a, b).collect()
    assert sorted(r.value for r in inside) == ["y", "y"]
    assert sorted(r.value for r in inside + outside) == ["x", "y", "y", "z"]


def test_text_lines(spark):
    df = spark.createDataFrame([(1, "a\n\n# c\n @p \n b"), (2, None), (3, "")], "id int, t string")
    every = lines.text_lines(df, "t").collect()
    assert [(r.id, r.line_no, r.value) for r in every] == [
        (1, 1, "a"), (1, 2, ""), (1, 3, "# c"), (1, 4, " @p "), (1, 5, " b"), (3, 1, "")]
    marked = lines.text_lines(df, "t", comments=True).collect()
    assert [(r.line_no, r.value, r.marked) for r in marked] == [(1, "a", None), (4, None, "p"), (5, "b", None)]


def test_renamed_keys(spark):
    rows = [(1, "a"), (2, "a "), (3, "a"), (4, "b"), (5, None), (6, None), (7, "c\t"), (8, "c")]
    df = spark.createDataFrame(rows, "id int, v string")
    changes = {r.id: r.new_value for r in dedupe.rename_duplicates_seq(df, "v", "id").collect()}
    assert changes == {2: "a_1", 1: "a_2", 7: "c_1"}
    whole = {r.id: r.v for r in dedupe.resolve_duplicates(df, "v", "id").collect()}
    assert whole == {1: "a_2", 2: "a_1", 3: "a", 4: "b", 5: None, 6: None, 7: "c_1", 8: "c"}
    zero = {r.id: r.new_value for r in dedupe.rename_duplicates_seq(df, "v", "id", skip_first=False).collect()}
    assert zero == {3: "a_0", 2: "a_1", 1: "a_2", 8: "c_0", 7: "c_1"}
    assert dedupe.resolve_duplicates(df, "none", "id") is df
    hashed = dedupe.rename_duplicates_uuid(df, "v", "id", width=8, seed=1).collect()
    assert {r.id for r in hashed} == {1, 2, 7} and all(len(r.new_value) == 10 for r in hashed)
    assert all(len(r.new_value) == 8 for r in dedupe.rename_duplicates_uuid(df, "v", "id").collect())
    own = dedupe.Strategy(False, lambda rank, pk: F.concat(F.lit("n"), pk.cast("string")))
    named = dedupe.rename_duplicates(df, "v", "id", own).collect()
    assert {r.id: r.new_value for r in named} == {2: "a_n2", 3: "a_n3", 8: "c_n8"}
    taken = dedupe.rename_conflicts(df.unionByName(texts(spark, "a_1", name="v").select(F.lit(9).alias("id"), "v")),
                                    "v", dedupe.rename_duplicates_seq(df, "v", "id"))
    assert [r.id for r in taken.collect()] == [2]


def test_update_sql_escapes(spark):
    df = spark.createDataFrame([("k'1", "o'b", "o'b_1")], "id string, old_value string, new_value string")
    assert dedupe.update_sql(df, "db.t", "c", "id").first()["statement"] == \
        "update db.t set c = 'o''b_1' where id = 'k''1';"


def test_directories(spark):
    df = spark.createDataFrame([("a/b/1", 5), ("a/b/2", 50), ("a/c/d/3", 5), ("a/c/4", 9), ("r", 1), ("e/5", 7)],
                               "path string, length bigint")
    assert {r.dir for r in files.emptied_dirs(df, 10).collect()} == {"a/c", "a/c/d", "e"}
    assert {r.dir: r.files for r in files.sparse_leaf_dirs(df, 1).collect()} == {"a/c/d": 1, "e": 1}
    assert {r.dir for r in files.sparse_leaf_dirs(df, 2).collect()} == {"a/b", "a/c/d", "e"}
    rooted = df.withColumn("path", F.concat(F.lit("/"), "path"))
    assert {r.dir for r in files.emptied_dirs(rooted, 10).collect()} == {"/a/c", "/a/c/d", "/e"}


def test_pairs(spark):
    left = texts(spark, "ep 001 x.mkv", "12.mkv", "0021.mkv", "999.mkv", name="name")
    right = texts(spark, "b 第001話 「One」", "a 第001話 「Uno」", "第002話 「Two」 第999話 「Last」", name="name")
    got = {r.left_name: (r.right_name[0], r.title, r.new_name) for r in files.pair_by_pattern(left, right).collect()}
    assert got == {"ep 001 x.mkv": ("a", "Uno", "001.Uno"), "0021.mkv": ("第", "Two", "002.Two"),
                   "999.mkv": ("第", "Last", "999.Last")}


def test_best_format_keeps_loose_files(spark):
    df = spark.createDataFrame([("g", "a.txt"), ("g", "b.mobi"), ("g", "c.mobi"), ("h", "d.pdf"), (None, "e.pdf")],
                               "dir string, path string")
    assert {r.path for r in files.best_format(df, "dir").collect()} == {"b.mobi", "c.mobi", "e.pdf"}
    assert {r.path for r in files.no_format(df, "dir").collect()} == {"d.pdf"}


def test_rename_plan_limit(spark):
    df = texts(spark, "d/a1", "d/a2", "d/b", "d/x2", name="path")
    def rename(inventory):
        return names.rename_prefix(inventory, "path", "a", "x")

    assert {r.path: r.action for r in files.rename_plan(df, rename).collect()} == {
        "d/a1": "rename", "d/a2": "target_exists"}
    assert files.rename_plan(df, rename, limit=1).count() == 1
    assert files.limit_plan(df, 0, "path").count() == 4


def test_combinations(spark):
    nine = generate.combinations(spark, list("abcdefghi"), ["3", "6-8"])
    assert nine.count() == 213
    assert {r.k: r["count"] for r in nine.groupBy("k").count().collect()} == {3: 84, 6: 84, 7: 36, 8: 9}
    seven = generate.combinations(spark, list("abcdefg"), repeat=3)
    assert seven.count() == 297 and seven.where("copy > 3").count() == 0
    two = generate.combinations(spark, list("abcd"), [2]).orderBy("k", "mask", "copy").collect()
    assert ["".join(r["items"]) for r in two] == ["ab", "ac", "ad", "bc", "bd", "cd"]
    assert generate.combinations(spark, list("ab"), [1], repeat=100).count() == 200
    for bad in (0, 101):
        with pytest.raises(ValueError):
            generate.combinations(spark, list("ab"), [1], repeat=bad)
    with pytest.raises(ValueError):
        generate.combinations(spark, [str(i) for i in range(31)])


@pytest.mark.parametrize("n, sizes", [(1, [1]), (5, [1, 2, 3, 4, 5]), (9, [8, 2]), (30, [3]), (30, [28])])
def test_combinations_by_rank(spark, n, sizes):
    """Same subsets, masks and order as ``itertools``; 30 items give 4,060 rows for k = 3 and no more work."""
    names = [f"i{j:02d}" for j in range(n)]
    found = generate.combinations(spark, names, sizes).orderBy("k", "mask").collect()
    expected = [(k, c) for k in sorted(sizes) for c in itertools.combinations(range(n), k)]
    assert [(r.k, r["items"]) for r in found] == [(k, [names[j] for j in c]) for k, c in expected]
    assert [r.mask for r in found] == [(1 << n) - 1 - sum(1 << (n - 1 - j) for j in c) for _, c in expected]


def test_combinations_of_nothing(spark):
    assert generate.combinations(spark, ["a", "b"], [3]).count() == 0
    assert generate.combinations(spark, [], [1]).count() == 0


def test_typed_table_batch_names(spark):
    sets = generate.combinations(spark, ["boolean", "int", "bigint", "double", "timestamp", "date", "string"], repeat=3)
    batch = generate.typed_table_batch(sets.withColumnRenamed("items", "types"), ["k", "mask", "copy"], offset=100)
    rows = {r.table_name: r.types for r in batch.collect()}
    assert set(rows) == {f"t_table_{i}" for i in range(101, 398)}
    assert rows["t_table_101"] == rows["t_table_103"] == ["boolean", "int", "bigint"]
    assert rows["t_table_104"] == ["boolean", "int", "double"]
    assert len(rows["t_table_397"]) == 7


def test_typed_table_hive(spark):
    style = generate.TableStyle(quote="`", partition_types=["date", "string"])
    schema, made = generate.typed_table(spark, ["int", "char(%d)", "decimal(%d,%d)", "int"], "t", style, row_num=3, batch_size=2)
    assert schema.names == ["c_int", "c_char", "c_decimal", "c_int_2", "p_date", "p_string"]
    assert schema["c_decimal"].dataType == T.DecimalType(16, 6) and schema["c_char"].dataType == T.CharType(16)
    rows = [r.statement for r in made.orderBy("statement_no").collect()]
    assert rows[0] == ("create table t (\n    `c_int` int,\n    `c_char` char(16),\n    `c_decimal` decimal(16,6),\n"
                       "    `c_int_2` int\n) partitioned by (\n    p_date date,\n    p_string string\n);")
    assert len(rows) == 3 and rows[1].startswith("insert into t partition(p_date='")
    assert rows[1].count("),(") == 1 and rows[2].count("),(") == 0


def test_typed_table_comments(spark):
    pg = generate.TableStyle(quote="`", comment="Column Type: $type", postgres=True)
    _, made = generate.typed_table(spark, ["bit(%d)", "varchar(%d)"], "t", pg)
    rows = [r.statement for r in made.orderBy("statement_no").collect()]
    assert rows[1] == "comment on column t.\"c_bit\" is 'Column Type: bit(16)';"
    assert rows[3].startswith('insert into t("c_bit","c_varchar") values (') and "::bit(16)" in rows[3]
    mysql = generate.TableStyle(comment="Column Type: $type", compact=True, extra_column="id bigint(20) primary key", suffix="x")
    _, made = generate.typed_table(spark, ["set", "time"], "t", mysql, row_num=0)
    ddl = made.first()["statement"]
    assert made.count() == 1 and ddl.endswith("c_time time comment 'Column Type: time' ) x;")
    assert ddl.startswith("create table t (     id bigint(20) primary key, c_set_")


# The type names the generator is used with.
HIVE = "boolean tinyint smallint int bigint float double decimal timestamp date string char(%d) varchar(%d) binary"
MYSQL = ("bit(%d),tinyint,tinyint unsigned,smallint,smallint unsigned,mediumint,mediumint unsigned,int,int unsigned,"
         "bigint,bigint unsigned,float,float unsigned,double unsigned,decimal(%d;%d),decimal(%d;%d) unsigned,real,"
         "real unsigned,char(%d),varchar(%d),nchar(%d),nvarchar(%d),tinytext,mediumtext,text,longtext,json,timestamp,"
         "date,datetime,year,time,tinyblob,mediumblob,blob,longblob,binary(%d),varbinary(%d),set,enum")
POSTGRES = ("tstzrange bit(%d) tsvector int2 character(%d) int4 int8 numrange tsrange text bpchar interval circle smallint "
            "tsquery cidr lseg timestamp daterange float8 float4 int4range varbit(%d) jsonb polygon char(%d) date integer "
            "float uuid int8range inet real name timestamptz bool bytea numeric box oid point json bigint varchar(%d) int "
            "macaddr boolean time timetz")


@pytest.mark.parametrize("types", [HIVE.split(), [t.replace(";", ",") for t in MYSQL.split(",")], POSTGRES.split()])
def test_type_lists(spark, types):
    schema, made = generate.typed_table(spark, types, "t", row_num=2)
    assert len(schema) == len(set(schema.names)) == len(types)
    assert made.where("statement is null").count() == 0
    rows = generate.random_rows(spark, schema, 20, seed=1)
    assert rows.count() == 20 and rows.schema.names == schema.names
    assert sorted(map(str, rows.collect())) == sorted(map(str, rows.repartition(5).collect()))


def test_spark_types():
    assert typenames.spark_type("BIGINT unsigned") == T.DecimalType(20, 0)
    assert typenames.spark_type("timestamp with time zone") == T.TimestampNTZType()
    assert typenames.spark_type("long varchar") == T.StringType()
    assert typenames.spark_type("geometry", unsupported_as_null=True) == T.NullType()
    with pytest.raises(ValueError):
        typenames.spark_type("geometry")


def test_fill_type_refuses_three_marks(spark):
    with pytest.raises(Exception, match="invalid type"):
        one(spark, typenames.fill_type(F.lit("x(%d,%d,%d)")))


def test_random_ranges(spark):
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("f", T.DoubleType()),
                           T.StructField("b", T.BinaryType()), T.StructField("skip", T.DateType())])
    rows = generate.random_rows(spark, schema, 2000, seed=4, ignored=["skip"]).collect()
    assert {r.i for r in rows} == set(range(127)) and rows[0].__fields__ == ["i", "f", "b"]
    assert all(0 <= r.f < 256 for r in rows) and {len(r.b) for r in rows} == set(range(1, 8))


def test_insert_sql_batches(spark):
    df = spark.range(5).select("id", F.when(F.col("id") != 3, F.lit("it's")).alias("s"))
    rows = [r.statement for r in generate.insert_sql(df, "t", ["id"], 2).orderBy("batch").collect()]
    assert rows == ["insert into t (id, s) values (0, 'it''s'), (1, 'it''s');",
                    "insert into t (id, s) values (2, 'it''s'), (3, NULL);",
                    "insert into t (id, s) values (4, 'it''s');"]


def test_json_diff_of_odd_keys(spark):
    left = json.dumps({'q"\\\n': 1, "é": [1], "same": {"b": 1, "a": 2}, "a": "t"})
    right = json.dumps({"same": {"a": 2, "b": 1}, "a": "u"})
    got = jsons.with_json_diff(spark.createDataFrame([(left, right)], "l string, r string"), "l", "r").first()
    assert json.loads(got.left_diff) == {'q"\\\n': 1, "é": [1], "a": "t"} and json.loads(got.right_diff) == {"a": "u"}
    empty = jsons.with_json_diff(spark.createDataFrame([("{}", "{}"), ("[1]", "{}")], "l string, r string"), "l", "r")
    assert [(r.left_diff, r.right_diff) for r in empty.collect()] == [("{}", "{}"), (None, None)]

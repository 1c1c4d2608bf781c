"""The registered queries of the dealt operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework.llm import (bpe, embedding_dedup, exact, langid, licenses, lines, mixing, negatives, ngram_join, packing, residual_packing,
                           spelling, tool_calls)
from tablework.llm.common import UPPER, ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: The vocabulary of the language ID.
PIECES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql.strip()
        return build
    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_pack_tokens")
def op1_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(documents(spark, sf_dir), RANKS, public_tokenizers.PATTERN, seq_len=2048, eos_id=50256)


@query("op2_mix_sources", r"""
with d as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
           md5('mix' || coalesce(cast(doc_id as varchar), '')) as key
    from documents),
s as (select source, cast(sum(size) as double) as source_size from d group by source),
w as (
    select *, [1.0, 2.0, 3.0][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as weight,
           row_number() over (order by source nulls last) as rank, 3 * source_size as cap,
           sum(source_size) over () as total
    from s),
o as (
    select *, sum(weight) over () as weights,
           coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0) as caps,
           coalesce(sum(weight) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0) as ws
    from w),
f as (select *, (total - caps) * weight > cap * (weights - ws) as stopped from o),
t as (
    select source, source_size, total, case when stopped then cap else
           weight * (total - coalesce(sum(cap) filter (stopped) over (), 0)) / (weights - coalesce(sum(weight) filter (stopped) over (), 0)) end as target
    from f),
q as (
    select d.doc_id, d.source, d.size, d.key, t.source_size, t.target, t.total,
           sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size rows unbounded preceding) as upto
    from d join t on t.source is not distinct from d.source),
c as (
    select *, cast(e * source_size + upto as double) / target as finish
    from q cross join (select unnest([0, 1, 2]) as e) where size > 0),
r as (select *, sum(size) over (order by finish, source nulls first, key, doc_id, size, e rows unbounded preceding) as so_far from c),
n as (select doc_id, count(*) filter (so_far <= total) as copies from r group by doc_id)
select q.doc_id, q.source, cast(q.size as bigint) as size, cast(q.source_size as bigint) as source_size, q.target,
       cast(coalesce(n.copies, 0) * q.size as bigint) as taken
from q left join n on n.doc_id = q.doc_id
""")
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir))


@query("op3_ngram_join")
def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(documents(spark, sf_dir))


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", langid.held_out())
    return langid.identify(docs, PIECES).select("doc_id", "held_out", "lang_pred", "score")


@query("op5_embedding_dedup")
def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return embedding_dedup.similar_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Schemas of the tools that the derived calls name; ``report`` has none.
TOOLS = [("search", [("query", "string", True), ("limit", "integer", False)]),
         ("lookup", [("key", "string", True), ("exact", "boolean", True)]),
         ("store", [("text", "string", True), ("size", "integer", True)])]


def derived_calls(turns: DataFrame) -> DataFrame:
    """Tool calls made from ``conversations``: each assistant turn is one, with the text in its arguments.

    Every third conversation's log is in reverse order. A call needs the one two turns before, at turns 5 and 6 also
    the one four turns before, whether or not there are such calls.
    """
    made = turns.where("role = 'assistant'").withColumn("name", F.element_at(
        F.array(*[F.lit(x) for x in ("search", "lookup", "store", "report")]), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4)) + 1).cast("int")))
    exact = F.when(F.pmod("turn", F.lit(5)) == 0, F.lit('"yes"')).otherwise(F.lit("true"))
    text = F.regexp_replace(F.to_json(F.array("text")), r"^\[|\]$", "")
    arguments = F.when(F.col("name") == "search", F.concat(F.lit('{"query":'), text, F.lit(', "limit":'), F.col("turn").cast("string"), F.lit("}"))) \
        .when(F.col("name") == "lookup", F.concat(F.lit('{"key":'), text, F.lit(', "exact":'), exact, F.lit("}"))) \
        .when((F.col("name") == "store") & (F.pmod("conv_id", F.lit(7)) == 0), F.concat(F.lit('{"text":'), text, F.lit("}"))) \
        .when(F.col("name") == "store", F.concat(F.lit('{"text":'), text, F.lit(', "size":'), F.length("text").cast("string"), F.lit("}"))) \
        .otherwise(F.concat(F.lit("{"), F.col("text")))
    ids = F.array(*[F.concat(F.lit("c"), (F.col("turn") - back).cast("string")) for back in (2, 4)])
    needs = F.when(F.col("turn") < 2, F.slice(ids, 1, 0)).when(F.col("turn").isin(5, 6), ids).otherwise(F.slice(ids, 1, 1))
    seq = F.when(F.pmod("conv_id", F.lit(3)) == 0, -F.col("turn")).otherwise(F.col("turn"))
    return made.select("conv_id", F.concat(F.lit("c"), F.col("turn").cast("string")).alias("call_id"), seq.alias("seq"), "name",
                       arguments.alias("arguments"), needs.alias("needs"))


def derived_results(turns: DataFrame) -> DataFrame:
    """Tool results made from ``conversations``: each user turn answers the call of the turn before, if there is one."""
    return turns.where("role = 'user' and turn > 0").select(
        "conv_id", F.concat(F.lit("c"), (F.col("turn") - 1).cast("string")).alias("call_id"), F.col("turn").alias("seq"), F.col("text").alias("content"))


@query("op6_tool_calls", r"""
with recursive calls as (
    select conv_id, turn, 'c' || turn as call_id, case when conv_id % 3 = 0 then -turn else turn end as seq, text,
           ['search', 'lookup', 'store', 'report'][(conv_id + turn) % 4 + 1] as name
    from conversations where role = 'assistant'),
results as (
    select conv_id, 'c' || (turn - 1) as call_id, turn as seq, text as content
    from conversations where role = 'user' and turn > 0),
needs as (
    select c.conv_id, c.call_id, 'c' || (turn - back) as need from calls c, (select unnest([2, 4]) as back)
    where turn >= 2 and (back = 2 or turn in (5, 6))),
known as (select n.* from needs n join calls c on c.conv_id = n.conv_id and c.call_id = n.need),
paths as (
    select conv_id, call_id, 0 as depth from calls
    union select k.conv_id, k.call_id, p.depth + 1 from paths p join known k on k.conv_id = p.conv_id and k.need = p.call_id),
levels as (select conv_id, call_id, max(depth) as level from paths group by all),
missing as (
    select n.conv_id, n.call_id, string_agg('needs unknown call ' || n.need, '; ' order by n.need) as text
    from needs n left join calls c on c.conv_id = n.conv_id and c.call_id = n.need where c.call_id is null group by all),
full_rows as (
    select coalesce(c.conv_id, r.conv_id) as conv_id, coalesce(c.call_id, r.call_id) as call_id, l.level, coalesce(c.seq, r.seq) as seq,
           c.name, c.turn, c.text, r.content, m.text as missing
    from calls c full join results r on r.conv_id = c.conv_id and r.call_id = c.call_id
    left join levels l on l.conv_id = c.conv_id and l.call_id = c.call_id
    left join missing m on m.conv_id = c.conv_id and m.call_id = c.call_id)
select conv_id, call_id, cast(level as int) as level, seq, name,
       case when name is null then 'no call' when content is null then 'no result' else 'linked' end as status,
       concat_ws('; ', case when name = 'report' then 'unknown tool'
            when name = 'lookup' and turn % 5 = 0 then 'exact is string, not boolean'
            when name = 'store' and conv_id % 7 = 0 then 'missing size' end, missing) as errors,
       case when name is not null then '{"arguments":' || case name
            when 'search' then '{"limit":' || turn || ',"query":' || to_json(text) || '}'
            when 'lookup' then '{"exact":' || case when turn % 5 = 0 then '"yes"' else 'true' end || ',"key":' || to_json(text) || '}'
            when 'store' then case when conv_id % 7 = 0 then '{' else '{"size":' || length(text) || ',' end || '"text":' || to_json(text) || '}'
            else to_json('{' || text) end || ',"id":"' || call_id || '","name":"' || name || '","type":"tool_call"}' end as call_json,
       case when content is not null then '{"content":' || to_json(content) || ',"id":"' || call_id || '","type":"tool_result"}' end as result_json
from full_rows
""")
def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    tools = spark.createDataFrame(TOOLS, "name string, params array<struct<name:string,type:string,required:boolean>>")
    return tool_calls.link_tool_calls(derived_calls(turns), derived_results(turns), tools) \
        .withColumn("errors", F.array_join("errors", "; "))


def _license_sql() -> str:
    """The canonical form in DuckDB, with the same fixed values."""
    def lines(text: str) -> str:
        owner, marks = licenses.OWNER_LINE, licenses.PUNCTUATION
        text = f"translate(coalesce({text}, ''), '{UPPER}', '{UPPER.lower()}')"
        text = f"regexp_replace(regexp_replace({text}, '{owner}', '\\1', 'g'), '{marks}', '  ', 'g')"
        text = f"regexp_replace('  ' || {text} || '  ', ' *\\n[ \\n]*', '  ' || chr(10) || '  ', 'g')"
        for variant, usual in licenses.SPELLINGS:
            text = f"replace({text}, ' {variant} ', ' {usual} ')"
        return f"replace({text}, '  ', ' ')"

    one_line = "trim(regexp_replace({}, '[ \\n]+', ' ', 'g'))"
    texts = [(k, t) for k, t in licenses.LICENSES.items()] + [(k, t) for k, ts in licenses.NOTICES.items() for t in ts]
    values = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in texts)
    digests = ", ".join(f"('{k}', '{sha}')" for k, sha in licenses.DIGESTS.items())
    return f"""
with known as (
    select sha, min(license_id) as license_id from (
        select license_id, sha256({one_line.format(lines("text"))}) as sha from (values {values}) as v(license_id, text)
        union all select * from (values {digests}) as d(license_id, sha))
    group by sha),
d as (select doc_id, {lines("text")} as l from documents),
n as (
    select doc_id, string_agg(distinct license_id, ',' order by license_id) as notices
    from (select doc_id, trim(unnest(string_split(l, chr(10)))) as line from d) x join known on known.sha = sha256(x.line) group by doc_id)
select d.doc_id, sha256({one_line.format("d.l")}) as canonical_sha256, k.license_id, coalesce(n.notices, '') as notices
from d left join known k on k.sha = sha256({one_line.format("d.l")}) left join n on n.doc_id = d.doc_id
"""


@query("op7_license_scan", _license_sql())
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir), licenses.known_licenses(spark), digests=licenses.known_digests(spark))


@query("op8_bpe_round_trip")
def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), RANKS, public_tokenizers.PATTERN)


@query("op9_line_dedup", r"""
with lines as (
    select doc_id, i, line, lower_ascii as key from (
        select doc_id, i, line, translate(
                   regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_ascii
        from (select doc_id, unnest(list) as line, unnest(range(len(list))) as i
              from (select doc_id, string_split(coalesce(text, ''), chr(10)) as list from documents)))),
shared as (
    select key, min(doc_id) as first_id from lines where length(key) >= 10
    group by key having count(distinct doc_id) > 1),
marked as (
    select l.doc_id, l.i, l.line, coalesce(l.doc_id <> s.first_id, false) as dropped
    from lines l left join shared s on s.key = l.key)
select doc_id, count(*) as n_lines, cast(sum(dropped::int) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (not dropped), '')) as kept_sha256
from marked group by doc_id
""")
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(documents(spark, sf_dir)).select(
        "doc_id", "_lines.n_lines", "_lines.n_dropped", F.sha2("_lines.kept", 256).alias("kept_sha256"))


@query("op10_exact_dedup", r"""
with n as (
    select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as content from documents)
select doc_id, min(doc_id) over (partition by content) as keep_id,
       count(*) over (partition by content) as group_size,
       doc_id = min(doc_id) over (partition by content) as kept, sha256(content) as text_sha256
from n
""")
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir))


@query("op11_spelling_variants", r"""
with recursive crc_table as (
    select list(c order by b) as t from (
        select b, list_reduce(range(8), lambda acc, k: case when acc & 1 = 1 then xor(acc >> 1, 3988292384) else acc >> 1 end, b) as c
        from (select unnest(range(256)) as b))),
runs as (
    select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[A-Za-zÀ-ÿ]+')) as run from documents),
counted as (
    select coalesce(cast(doc_id as varchar), '') || ':' || run as salted, run, count(*) as n
    from runs where length(run) >= 7 group by all),
hashed as (
    select run, n, xor(list_reduce(list_transform(range(len(hex(encode(salted))) // 2), lambda i: cast('0x' || substr(hex(encode(salted)), 2 * i + 1, 2) as bigint)),
        lambda acc, b: xor(acc >> 8, t[(xor(acc, b) & 255) + 1]), 4294967295), 4294967295) as h
    from counted, crc_table),
words as (
    select word, cast(sum(n) as bigint) as n from (
        select case when h % 31 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from hashed)
    where length(word) >= 7 group by word having sum(n) >= 2),
less as (
    select word, n, unnest(range(length(word))) as i, substr(word, 1, i) as a, substr(word, i + 2) as b from words),
near as (
    select x.word, y.word as other, y.n as other_n from less x join less y on y.a = x.a and y.b = x.b and y.word <> x.word
    union select x.word, y.word, y.n from less x join words y on y.word = x.a || x.b
    union select y.word, x.word, x.n from less x join words y on y.word = x.a || x.b),
best as (
    select word, count(*) as n_near, max(other_n) as best_n, arg_min(other, (-other_n, other)) as best from near group by word),
forms as (
    select w.word, w.n, case when b.best_n >= 10 * w.n then b.best end as form, coalesce(b.n_near, 0) as n_near,
           case when b.best_n >= 10 * w.n then b.best_n end as form_n
    from words w left join best b on b.word = w.word),
walk as (
    select word, word as reached, 0 as steps from forms
    union all select w.word, f.form, w.steps + 1 from walk w join forms f on f.word = w.reached where f.form is not null)
select f.word, f.form, r.root, f.n, cast(f.n_near as bigint) as n_near, f.form_n
from forms f join (select word, arg_max(reached, steps) as root from walk group by word) r on r.word = f.word
""".replace("\\u00C0-\\u00FF", "À-ÿ"))
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(documents(spark, sf_dir), change=spelling.drop_one_letter)
    return spelling.usual_forms(words).select("word", "form", "root", "n", "n_near", "form_n")


@query("op12_hard_negatives", """
with rows_of as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
           list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
    from embeddings
    where vec_id is not null and label is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
    select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same, cast(list_inner_product(a.v, r.v) as bigint) as score
    from rows_of a join rows_of r on len(r.v) = len(a.v) where a.vec_id % 100 = 0 and r.vec_id <> a.vec_id),
positives as (
    select anchor_id, vec_id as positive_id, score as positive_score from scores where same
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.positive_id,
       cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as int) as rank,
       s.vec_id as negative_id, p.positive_score, s.score as negative_score
from positives p join scores s on s.anchor_id = p.anchor_id and not s.same
     and 80 * p.positive_score <= 100 * s.score and 100 * s.score <= 100 * p.positive_score
qualify row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) <= 5
""")
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.expr("vec_id % 7 = 0"), F.expr("(label + 1) % 10")).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", label), "vec_id % 100 = 0")


@query("op13_residual_packing")
def op13_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residual_packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))

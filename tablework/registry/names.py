"""Queries on names, paths, lines, texts and document search."""

from pyspark.sql import functions as F

from tablework.operators import lines as ln
from tablework.operators import names as nm
from tablework.operators.search import search_docs
from tablework.registry import Tables, check


def doc_paths(t: Tables):
    path = F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return t.documents.select(path.alias("path"), F.col("n_chars").alias("length"))


DOC_PATHS = "select lang || '/' || source || '/' || doc_id || '.txt' as path, n_chars as length from documents"


@check("include_filter", r"""
    select page_id, url from pages where regexp_matches(url, '\.org/') or regexp_matches(url, '/de/\d')
""")
def _(t):
    return nm.name_filter(t.pages.select("page_id", "url"), "url", include=[r"\.org/", r"/de/\d"])


@check("exclude_filter", r"""
    select page_id, url from pages where not (regexp_matches(url, '\.org/') or regexp_matches(url, '#'))
""")
def _(t):
    return nm.name_filter(t.pages.select("page_id", "url"), "url", exclude=[r"\.org/", "#"])


@check("prefix_match", r"""
    select p_partkey, p_name from part
    where regexp_matches(p_name, '^(?:red|blue)') or regexp_matches(p_name, '^(?:(?:small|hot) g)')
""")
def _(t):
    return nm.prefix_match(t.part.select("p_partkey", "p_name"), "p_name", ["red|blue", "(?:small|hot) g"])


@check("rename_full", rf"""
    select path, length, lang || '/' || source || '/' || regexp_replace(name, '(\d+)0\.(txt)', '\2_\1.bak', 'g') as target
    from (select *, split_part(path, '/', 1) as lang, split_part(path, '/', 2) as source,
                 split_part(path, '/', 3) as name from ({DOC_PATHS}))
    where regexp_full_match(name, '(\d+)0\.(txt)')
""")
def _(t):
    return nm.rename_full(doc_paths(t), "path", r"(\d+)0\.(txt)", "$2_$1.bak")


@check("rename_prefix", rf"""
    select path, length, lang || '/' || source || '/' || regexp_replace(name, '(\d)(\d)', '\2-\1$', 'g') as target
    from (select *, split_part(path, '/', 1) as lang, split_part(path, '/', 2) as source,
                 split_part(path, '/', 3) as name from ({DOC_PATHS}))
    where regexp_matches(name, '^(?:(\d)(\d))')
""")
def _(t):
    return nm.rename_prefix(doc_paths(t), "path", r"(\d)(\d)", r"\2-\1$")


DOC_LINES = """
    select doc_id, generate_subscripts(parts, 1)::bigint as line_no, unnest(parts) as value
    from (select doc_id, string_split(text, chr(10)) as parts from documents)
"""
TALK_LINES = """
    select conv_id, turn, unnest(string_split(text, chr(10))) as value from conversations
"""


def doc_lines(t: Tables):
    return ln.text_lines(t.documents.select("doc_id", "text"), "text")


@check("doc_lines", DOC_LINES)
def _(t):
    return doc_lines(t)


@check("doc_lines_marked", f"""
    select doc_id, line_no, case when not marks then line end as value,
           case when marks then substr(line, 2) end as marked
    from (select *, starts_with(line, '@') as marks from (
        select doc_id, line_no, trim(regexp_replace(value, '^(E|V)', '@')) as line from ({DOC_LINES})))
    where line <> '' and not starts_with(line, '#')
""")
def _(t):
    marked = t.documents.select("doc_id", F.regexp_replace("text", "(?m)^(E|V)", "@").alias("text"))
    return ln.text_lines(marked, "text", comments=True)


REWRITTEN = r"regexp_replace(value, '([A-Z][a-z]+) ([a-z]+)', '\2 \1', 'g')"


@check("rewrite_lines", rf"""
    select doc_id, line_no, case when regexp_matches(value, '^(?:([A-Z][a-z]+) ([a-z]+))')
                                 then {REWRITTEN} else value end as value
    from ({DOC_LINES})
""")
def _(t):
    return nm.rewrite_lines(doc_lines(t), r"([A-Z][a-z]+) ([a-z]+)", r"\2 \1")


@check("rewrite_lines_matched", rf"""
    select doc_id, line_no, {REWRITTEN} as value from ({DOC_LINES})
    where regexp_matches(value, '^(?:([A-Z][a-z]+) ([a-z]+))')
""")
def _(t):
    return nm.rewrite_lines(doc_lines(t), r"([A-Z][a-z]+) ([a-z]+)", r"\2 \1", matched_only=True)


@check("replace_first_n", """
    select doc_id, regexp_replace(text, '[aeiou]n', '<>') as text from documents
""")
def _(t):
    return nm.replace_first_n(t.documents.select("doc_id", "text"), "text", "[aeiou]n", "<>")


@check("replace_first_n_groups", r"""
    select doc_id, regexp_replace(text, '([a-z]+) ([a-z]+)', '\2 \1') as text from documents
""")
def _(t):
    return nm.replace_first_n(t.documents.select("doc_id", "text"), "text", "([a-z]+) ([a-z]+)", r"\2 \1")


@check("replace_all", r"""
    select doc_id, regexp_replace(text, '([a-z])\.', '\1$', 'g') as text from documents
""")
def _(t):
    return nm.replace_first_n(t.documents.select("doc_id", "text"), "text", r"([a-z])\.", r"\1$", n=0)


@check("strip_marker", """
    select page_id, case when starts_with(url, 'https://') then substr(url, 9) else url end as url from pages
""")
def _(t):
    return nm.strip_marker(t.pages.select("page_id", "url"), "url", "https://")


@check("drop_columns", "select c_custkey, c_name, c_nationkey from customer")
def _(t):
    return nm.drop_columns(t.customer, ["c_acctbal", "c_mktsegment", "no_such_column"])


@check("name_expr", """
    select doc_id, source, 'target_' || substr(source, length('src') + 1) as target from documents
""")
def _(t):
    return nm.name_expr(t.documents.select("doc_id", "source"), "source",
                        "concat('target_', substring(it, length('src') + 1))")


@check("render_docs", """
    select doc_id, ' ---- ' || chr(10) || source || chr(9) || coalesce(lang, 'null') || chr(10) || text as rendered
    from documents
""")
def _(t):
    docs = t.documents.select("doc_id", "source", "lang", F.split("text", "\n").alias("paragraphs"))
    return nm.render(docs, " ---- \n{source}\t{lang}\n{paragraphs}").select("doc_id", "rendered")


@check("render_messages", """
    select event_id, '[' || event_type || '] ' || props as rendered from events
""")
def _(t):
    return nm.render(t.events, "[{event_type}] {props}").select("event_id", "rendered")


@check("search_docs", """
    select doc_id, source, lang from documents
    where source in ('src1', 'src2', 'src5', 'src7') and (lang is null or lang in ('en', 'fr'))
      and len(list_filter(string_split(text, chr(10)), lambda p: contains(p, 'the'))) > 0
      and len(list_filter(string_split(text, chr(10)), lambda p: contains(p, 'an'))) > 0
      and n_chars > 300
""")
def _(t):
    docs = t.documents.select("doc_id", "source", "lang", "n_chars", F.split("text", "\n").alias("paragraphs"))
    found = search_docs(docs, ["src1", "src2", "src5", "src7"], ["en", "fr"], ["the", "an"],
                        predicate=F.col("n_chars") > 300, author="source", title="lang")
    return found.select("doc_id", "source", "lang")


@check("lines_in", f"""
    select * from ({DOC_LINES}) where value in (select value from ({TALK_LINES}))
""")
def _(t):
    talk = ln.text_lines(t.conversations.select("conv_id", "turn", "text"), "text")
    return ln.lines_in(doc_lines(t), talk).select("doc_id", "line_no", "value")


@check("lines_not_in", f"""
    select * from ({DOC_LINES}) where value not in (select value from ({TALK_LINES}))
""")
def _(t):
    talk = ln.text_lines(t.conversations.select("conv_id", "turn", "text"), "text")
    return ln.lines_not_in(doc_lines(t), talk).select("doc_id", "line_no", "value")

"""Queries on file inventories; the documents stand for the files of a tree."""

from pyspark.sql import functions as F

from tablework.operators import files as fl
from tablework.operators import names as nm
from tablework.registry import Tables, check
from tablework.registry.names import DOC_PATHS, doc_paths
from tablework.session import shared_path
from tablework.sources import files as src

EXTENSIONS = [".epub", ".mobi", ".txt", ".pdf"]


def tree(t: Tables):
    """Files three or four levels deep with four extensions and a small group folder."""
    ext = F.get(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("n_chars") % 4).cast("int"))
    name = F.concat(F.col("doc_id").cast("string"), ext)
    shelf = F.concat(F.lit("b"), F.floor(F.col("doc_id") / 8).cast("string"))
    group = (F.when(F.col("doc_id") % 3 == 0, F.concat_ws("/", "lang", "source"))
             .otherwise(F.concat_ws("/", "lang", "source", shelf)))
    return t.documents.select(F.concat_ws("/", group, name).alias("path"), group.alias("dir"),
                              name.alias("name"), F.col("n_chars").alias("length"))


TREE = """
    select dir || '/' || name as path, dir, name, length from (
        select case when doc_id % 3 = 0 then lang || '/' || source
                    else lang || '/' || source || '/b' || (doc_id // 8) end as dir,
               doc_id || ['.epub', '.mobi', '.txt', '.pdf'][n_chars % 4 + 1] as name,
               n_chars as length
        from documents)
"""
# Every folder of the tree: the folders of files and what lies above them.
FOLDERS = f"""
    select path, length, dir as folder from ({TREE})
    union all
    select path, length, split_part(dir, '/', 1) || '/' || split_part(dir, '/', 2) from ({TREE})
    where dir like '%/%/%'
    union all
    select path, length, split_part(dir, '/', 1) from ({TREE})
"""


@check("small_files", f"select * from ({DOC_PATHS}) where length <= 500")
def _(t):
    return fl.size_filter(doc_paths(t), max_size=500)


@check("large_files", f"select * from ({DOC_PATHS}) where length > 10000")
def _(t):
    return fl.size_filter(doc_paths(t), min_size=10_000)


EMPTIED = f"select folder as dir, count(*) as files from ({FOLDERS}) group by folder having max(length) <= 2000"


@check("emptied_dirs", EMPTIED)
def _(t):
    return fl.emptied_dirs(tree(t), 2000)


@check("impact_summary", f"""
    select files, dirs, total_size, case when total_size < 1024 then total_size || 'B'
        when total_size < 1048576 then printf('%.2fK', total_size / 1024)
        when total_size < 1073741824 then printf('%.2fM', total_size / 1048576)
        else printf('%.2fG', total_size / 1073741824) end as size_text
    from (select (select count(*) from ({TREE}) where length <= 2000) as files,
                 (select count(*) from ({EMPTIED})) as dirs,
                 (select sum(length) from ({TREE}) where length <= 2000)::bigint as total_size)
""")
def _(t):
    files = tree(t)
    gone = fl.size_filter(files, max_size=2000).select("path", "length", F.lit("file").alias("kind"))
    dirs = fl.emptied_dirs(files, 2000).select(F.col("dir").alias("path"), F.lit(0).cast("bigint").alias("length"),
                                               F.lit("dir").alias("kind"))
    return fl.impact(gone.unionByName(dirs))


@check("line_count", """
    select sum(length(text) - length(replace(text, chr(10), '')))::bigint as lines from documents
""")
def _(t):
    return fl.line_count(t.documents, "text")


@check("sparse_leaf_dirs", f"""
    select dir, count(*) as files from ({TREE})
    where dir not in (select split_part(dir, '/', 1) || '/' || split_part(dir, '/', 2) from ({TREE}) where dir like '%/%/%')
    group by dir having count(*) <= 2
""")
def _(t):
    return fl.sparse_leaf_dirs(tree(t), 2)


RANKED = f"""
    select *, min(pos) over (partition by dir) as best from (
        select *, case when name like '%.epub' then 0 when name like '%.mobi' then 1
                       when name like '%.txt' then 2 end as pos from ({TREE}))
"""


@check("best_format", f"select path, dir, name, length from ({RANKED}) where pos = best")
def _(t):
    return fl.best_format(tree(t), "dir")


@check("no_format", f"select path, dir, name, length from ({RANKED}) where best is null")
def _(t):
    return fl.no_format(tree(t), "dir")


MATCHED = rf"""
    select *, case when regexp_matches(name, '^(?:\d+\.epub)') then 1
                   when regexp_matches(name, '^(?:\d*5\.mobi)') then 2 end as pattern_no from ({TREE})
"""
PATTERNS = [r"\d+\.epub", r"\d*5\.mobi"]


@check("first_match", f"""
    select dir, pattern_no, name from (
        select *, row_number() over (partition by dir order by pattern_no, name) as rn
        from ({MATCHED}) where pattern_no is not null)
    where rn = 1
""")
def _(t):
    return fl.first_match(tree(t), "dir", "name", PATTERNS)


@check("unmatched_groups", f"""
    select dir, count(*) as files from ({MATCHED}) group by dir having count(pattern_no) = 0
""")
def _(t):
    return fl.unmatched_groups(tree(t), "dir", "name", PATTERNS)


@check("pair_by_pattern", """
    with videos as (select 'V ' || lpad((o_custkey % 1000)::varchar, 3, '0') || ' ' || o_orderkey as name from orders),
    titles as (select '[x]第' || lpad((s_suppkey % 1000)::varchar, 3, '0') || '話 「' || s_name || '」.ssa' as name from supplier),
    keyed as (select regexp_extract(name, '第([0-9]{3})話', 1) as key, min(name) as right_name from titles group by 1)
    select name as left_name, right_name, key, regexp_extract(right_name, '「(.*?)」', 1) as title,
           key || '.' || regexp_extract(right_name, '「(.*?)」', 1) as new_name
    from videos join keyed on regexp_extract(videos.name, '([0-9]{3})', 1) = key
""")
def _(t):
    def digits(col):
        return F.lpad((F.col(col) % 1000).cast("string"), 3, "0")

    videos = t.orders.select(F.concat(F.lit("V "), digits("o_custkey"), F.lit(" "),
                                      F.col("o_orderkey").cast("string")).alias("name"))
    titles = t.supplier.select(F.concat(F.lit("[x]第"), digits("s_suppkey"), F.lit("話 「"), "s_name",
                                        F.lit("」.ssa")).alias("name"))
    return fl.pair_by_pattern(videos, titles)


def label_plan(t: Tables):
    plan = t.documents.select(F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("path"),
                              F.concat(F.lit("judged/"), F.col("doc_id").cast("string")).alias("target"))
    done = t.labels.select(F.concat(F.lit("judged/"), F.col("doc_id").cast("string")).alias("target"))
    return plan, done


@check("without_existing", """
    select lang || '/' || doc_id as path, 'judged/' || doc_id as target from documents
    where doc_id not in (select doc_id from labels)
""")
def _(t):
    return fl.without_existing(*label_plan(t)).select("path", "target")


@check("existing_conflicts", """
    select lang || '/' || doc_id as path, 'judged/' || doc_id as target from documents
    where doc_id in (select doc_id from labels)
""")
def _(t):
    return fl.existing_conflicts(*label_plan(t)).select("path", "target")


@check("claim_targets", """
    select path, target, row_number() over (partition by target order by path) = 1 as granted
    from (select p_brand || '/' || p_partkey as path, p_type || '/' || p_name as target from part)
""")
def _(t):
    plan = t.part.select(F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("path"),
                         F.concat_ws("/", "p_type", "p_name").alias("target"))
    return fl.claim_targets(plan).select("path", "target", "granted")


@check("limit_plan", f"select * from ({DOC_PATHS}) order by path limit 50")
def _(t):
    return fl.limit_plan(doc_paths(t), 50)


@check("depth_order", """
    select page_id, url, len(string_split(url, '/'))::int as depth from pages order by depth desc, url
""")
def _(t):
    return fl.depth_order(t.pages.select("page_id", "url"), "url")


@check("rename_plan", rf"""
    with named as (
        select path, length, parent || regexp_replace(name, '(\d)\d', '\1', 'g') as target
        from (select *, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) || '/' as parent,
                     split_part(path, '/', 3) as name from ({DOC_PATHS}))
        where regexp_matches(name, '^(?:(\d)\d)'))
    select path, length, target,
           case when target in (select path from ({DOC_PATHS})) then 'target_exists'
                when row_number() over (partition by target order by path) = 1 then 'rename'
                else 'target_claimed' end as action
    from named
""")
def _(t):
    return fl.rename_plan(doc_paths(t), lambda files: nm.rename_prefix(files, "path", r"(\d)\d", r"\1"))


@check("file_inventory", """
    select 'lang=' || lang as folder, cast(sum(strlen(text) + 1) as bigint) as n_bytes from documents group by lang
""")
def _(t):
    """Documents written as text, a folder per language; the inventory adds up to their bytes."""
    base = shared_path(t.spark, "inventory")
    t.documents.select("lang", "text").write.partitionBy("lang").text(base)
    found = src.file_inventory(t.spark, base, glob="*.txt").where("kind = 'file'")
    folder = F.element_at(F.split("path", "/"), -2)
    return found.groupBy(folder.alias("folder")).agg(F.sum("length").alias("n_bytes"))


@check("copy_plan", """
    with files as (
        select lang as kind, source as book,
               doc_id || case when doc_id % 3 = 0 then '.pdf' when doc_id % 3 = 1 and doc_id % 7 < 3 then '.epub' else '.txt' end as file
        from documents),
    picks as (
        select kind, book, min(case when file like '%.pdf' then '1:' || file when file like '%.epub' then '2:' || file end) as pick
        from files group by all),
    named as (select kind, book, substr(pick, 3) as file, kind || '/' || book || '/' || substr(pick, 3) as path, kind || '/' || substr(pick, 3) as target from picks)
    select *, case when target is null then 'unmatched'
                   when target in (select lang || '/' || doc_id || '.pdf' from documents where doc_id in (select doc_id from labels)) then 'target_exists'
                   when row_number() over (partition by target order by path) = 1 then 'copy' else 'target_claimed' end as action
    from named
""")
def _(t):
    """All documents, a book per source; the labelled ones were copied as PDF."""
    ending = F.expr("case when doc_id % 3 = 0 then '.pdf' when doc_id % 3 = 1 and doc_id % 7 < 3 then '.epub' else '.txt' end")
    files = t.documents.select(F.col("lang").alias("kind"), F.col("source").alias("book"),
                               F.concat(F.col("doc_id").cast("string"), ending).alias("file"))
    there = t.documents.join(t.labels.select("doc_id").distinct(), "doc_id", "left_semi") \
        .select(F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("target"))
    return fl.copy_plan(files, [r".*\.pdf", r".*\.epub"], there)


@check("copy_plan_books", f"""
    with files as (
        select lang as kind, source || '/b' || (doc_id // 64) as book, n_chars || ['.epub', '.mobi', '.txt', '.pdf'][n_chars % 4 + 1] as file
        from documents),
    picks as (
        select kind, book, min(case when file like '%.pdf' then '1:' || file when file like '%.epub' then '2:' || file end) as pick
        from files group by all),
    named as (select kind, book, substr(pick, 3) as file, kind || '/' || book || '/' || substr(pick, 3) as path, kind || '/' || substr(pick, 3) as target from picks)
    select *, case when target is null then 'unmatched'
                   when target in (select lang || '/' || n_chars || '.pdf' from documents where doc_id in (select doc_id from labels)) then 'target_exists'
                   when row_number() over (partition by target order by path) = 1 then 'copy' else 'target_claimed' end as action
    from named
""")
def _(t):
    """All documents, in small books; files of one length share a name, and the labelled ones were copied as PDF."""
    ext = F.get(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("n_chars") % 4).cast("int"))
    book = F.concat_ws("/", "source", F.concat(F.lit("b"), F.floor(F.col("doc_id") / 64).cast("string")))
    files = t.documents.select(F.col("lang").alias("kind"), book.alias("book"),
                               F.concat(F.col("n_chars").cast("string"), ext).alias("file"))
    there = t.documents.join(t.labels.select("doc_id").distinct(), "doc_id", "left_semi") \
        .select(F.concat("lang", F.lit("/"), F.col("n_chars").cast("string"), F.lit(".pdf")).alias("target"))
    return fl.copy_plan(files, [r".*\.pdf", r".*\.epub"], there)


@check("map_files", """
    select lang || '/' || source || '/' || doc_id || '.txt' as path, strlen(text) as n_bytes,
           md5(text) as digest from documents
""")
def _(t):
    def describe(path, content):
        import hashlib

        return path, len(content), hashlib.md5(content).hexdigest()

    path = F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = t.documents.select(path.alias("path"), F.encode("text", "UTF-8").alias("content"))
    return src.map_files(files, describe, "path string, n_bytes bigint, digest string")

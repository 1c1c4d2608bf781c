"""Readers, sinks, migrations and streams on small files."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablework.plans import migrate as m
from tablework.sources import buckets, catalog, files, jdbc, shards, sinks
from tablework.streaming import collected, levels, seen
from tablework.streaming import messages as ms


def test_json_arrays_by_file(spark, tmp_path):
    lyric = [{"author": "a", "rhythmic": "r", "paragraphs": ["x", "y"]}, {"author": None, "paragraphs": None}]
    (tmp_path / "ci.song.0.json").write_text(json.dumps(lyric, indent=1))
    (tmp_path / "other.json").write_text(json.dumps([{"author": "no"}]))
    rows = files.json_records(spark, str(tmp_path), files.LYRIC, "ci.song*").collect()
    assert {(r.author, r.title, tuple(r.paragraphs or [])) for r in rows} == {("a", "r", ("x", "y")), (None, None, ())}
    (tmp_path / "shi").mkdir()
    (tmp_path / "shi" / "poet.json").write_text(json.dumps([{"author": "b", "title": "t", "no#": "7"}]))
    verse = files.json_records(spark, str(tmp_path / "shi"), files.VERSE).first()
    assert (verse.title, verse.no, verse.notes) == ("t", "7", None)


@pytest.mark.parametrize("split", [None, "64"])
def test_lines_of_split_files(spark, tmp_path, split):
    rng = random.Random(1)
    want = {f"f{i}.txt": ["w" * rng.randrange(12) + str(n) for n in range(150)] for i in range(2)}
    for name, rows in want.items():
        (tmp_path / name).write_text("\n".join(rows) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        rows = files.lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {(r.file.rsplit("/", 1)[1], r.line_no): r.value for r in rows}
    assert got == {(name, i + 1): v for name, rows in want.items() for i, v in enumerate(rows)}


def test_lines_with_comments(spark, tmp_path):
    (tmp_path / "types.txt").write_text("int\n\n # no\n@date\n varchar(%d) \n")
    rows = files.lines(spark, str(tmp_path), comments=True).orderBy("line_no").collect()
    assert [(r.line_no, r.value, r.marked) for r in rows] == [(1, "int", None), (4, None, "date"), (5, "varchar(%d)", None)]


def test_inventory_and_user_function(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.txt").write_text("12345")
    (tmp_path / "a" / "b" / "y.txt").write_text("1")
    (tmp_path / "a" / "b" / "z.log").write_text("12")
    every = files.file_inventory(spark, str(tmp_path), include_dirs=True).collect()
    assert {(r.path.rsplit("/", 1)[1], r.length, r.kind) for r in every} == {
        ("x.txt", 5, "file"), ("y.txt", 1, "file"), ("z.log", 2, "file"), ("a", 0, "dir"), ("b", 0, "dir")}
    assert files.file_inventory(spark, str(tmp_path), glob="*.txt").count() == 2
    assert files.file_inventory(spark, str(tmp_path / "a"), recurse=False).count() == 1
    plan = files.file_inventory(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    sizes = files.map_files(files.read_files(spark, str(tmp_path), glob="*.txt"),
                            lambda path, content: (path[-5:], len(content)), "name string, n int")
    assert {tuple(r) for r in sizes.collect()} == {("x.txt", 5), ("y.txt", 1)}


def test_catalog(spark):
    spark.sql("create database if not exists shelf")
    spark.sql("drop table if exists shelf.books")
    spark.range(3).select("id", F.lit("x").alias("s")).write.saveAsTable("shelf.books")
    assert [tuple(r) for r in catalog.table_columns(spark, "shelf.books").collect()] == [("id", "bigint"), ("s", "string")]
    assert "books" in {r.name for r in catalog.catalog_tables(spark, "shelf").collect()}
    counts = catalog.table_counts({"full": spark.table("shelf.books"), "empty": spark.range(0)})
    assert [tuple(r) for r in counts.collect()] == [("full", 3)]


def test_jdbc_options():
    with pytest.raises(ValueError, match="driver"):
        jdbc.jdbc_options("jdbc:x", "t", "")
    got = jdbc.jdbc_options("jdbc:x", "t", "d", user="u", properties={"ssl": "true"}, fetchsize=10)
    assert got == {"url": "jdbc:x", "dbtable": "t", "driver": "d", "ssl": "true", "fetchsize": "10"}
    assert jdbc.jdbc_options("jdbc:x", "t", "d", "u", "p")["password"] == "p"
    with pytest.raises(ValueError, match="bounds"):
        jdbc.jdbc_source(None, "jdbc:x", "t", "d", num_partitions=4)


def test_upsert(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    updates = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, at int")
    def upserted(**how):
        return {r.k: r.v for r in sinks.upsert_by_key(target, updates, "k", "at", **how).collect()}

    assert upserted() == {1: "a", 2: "y", 3: "z"}
    assert upserted(keep="first") == {1: "a", 2: "x", 3: "z"}


def test_keyed_collections(spark):
    df = spark.createDataFrame([("k", "a", 1), ("k", "b", 2), ("k", "a", 3), ("j", "c", 4)], "key string, value string, ord int")
    def entries(kind):
        return sinks.collect_by_key(df, "key", "value", kind, "ord")

    assert {tuple(r) for r in entries("list").collect()} == {("k", 1, "a"), ("k", 2, "b"), ("k", 3, "a"), ("j", 1, "c")}
    assert {tuple(r) for r in entries("set").collect()} == {("k", "a"), ("k", "b"), ("j", "c")}
    assert {tuple(r) for r in entries("zset").collect()} == {("k", 1, "b", 2), ("k", 2, "a", 3), ("j", 1, "c", 4)}
    packed = sinks.in_segments(entries("list"), "key", "value", 2).collect()
    assert {(r.key, r.segment): r["values"] for r in packed} == {("k", 0): ["a", "b"], ("k", 1): ["a"], ("j", 0): ["c"]}
    with pytest.raises(ValueError):
        entries("queue")


def packed_in_turn(sizes, limit):
    held, shard, out = 0, 1, []
    for n in sizes:
        held += n
        if held > limit:
            held, shard = n, shard + 1
        out.append(shard)
    return out


@pytest.mark.parametrize("seed,limit,chunk", [(1, 10, 7), (2, 10, 1), (3, 1000, 5), (4, 3, 50), (5, 1, 9), (6, 40, 1000)])
def test_shards_by_chunks(spark, seed, limit, chunk):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 2, 5, 9, 30]) for _ in range(60)]
    blocks = spark.createDataFrame(list(enumerate(sizes)), "b bigint, n bigint")
    got = sinks.shard_numbers(blocks, "b", "n", limit, chunk).orderBy("b").collect()
    assert [r.shard for r in got] == packed_in_turn(sizes, limit)


@pytest.mark.parametrize("fan_in", [2, 3])
def test_shards_by_a_tree_of_chunks(spark, fan_in):
    """Sixty chunks in several levels of reports; the driver gets one number."""
    rng = random.Random(9)
    for limit in (7, 100):
        sizes = [rng.choice([0, 1, 2, 5, 9, 30]) for _ in range(180)]
        blocks = spark.createDataFrame(list(enumerate(sizes)), "b bigint, n bigint")
        got = sinks.shard_numbers(blocks, "b", "n", limit, 3, fan_in=fan_in).orderBy("b").collect()
        assert [r.shard for r in got] == packed_in_turn(sizes, limit)


def test_shards_of_nothing(spark):
    blocks = spark.createDataFrame([], "b bigint, n bigint")
    assert sinks.shard_numbers(blocks, "b", "n", 10).collect() == []


@pytest.mark.parametrize("seed", range(20))
def test_composed_reports(seed):
    """A report of two chunks does what one chunk after the other does, for every entry, also above the limit."""
    rng = random.Random(seed)
    limit = rng.choice([1, 5, 20, 200])
    parts = [[rng.choice([0, 1, 3, 8, 25]) for _ in range(rng.randint(1, 9))] for _ in range(rng.randint(1, 4))]
    steps = [shards.report(np.array(p), limit) for p in parts]
    whole = steps[0]
    for step in steps[1:]:
        whole = shards.then(whole, step)
    for held in range(limit + 30):
        want, shard = held, 0
        for n in [n for p in parts for n in p]:
            want += n
            if want > limit:
                want, shard = n, shard + 1
        assert shards.apply(whole, held, 0) == (want, shard)
    assert list(whole.starts) == sorted(set(whole.starts)) and len(whole.starts) <= limit + 1


def test_sharded_text(spark, tmp_path):
    rows = [(f"t{b}", b, i, f"s{b}.{i}") for b in range(6) for i in range(b + 1)]
    df = spark.createDataFrame(rows, "t string, b int, i int, s string")
    shards = sinks.sharded_text(df, "t", "b", "i", "s", 7, str(tmp_path / "out"))
    assert {r.t: r.shard for r in shards.collect()} == {"t0": 1, "t1": 1, "t2": 1, "t3": 2, "t4": 3, "t5": 4}
    for shard in (1, 2, 3, 4):
        parts = sorted((tmp_path / "out" / f"shard={shard}").glob("part-*"))
        text = "".join(p.read_text() for p in parts).split()
        blocks = {"1": "012", "2": "3", "3": "4", "4": "5"}[str(shard)]
        assert text == [f"s{b}.{i}" for b in map(int, blocks) for i in range(b + 1)]


def test_publish(spark, tmp_path):
    got = sinks.publish(spark.createDataFrame([("t", "é")], "a string, b string"), "a", "b", qos=2).first()
    assert (got.topic, bytes(got.payload).decode(), got.qos, got.retain) == ("t", "é", 2, False)
    for _ in range(2):
        sinks.send(sinks.publish(spark.createDataFrame([("t", "x")], "a string, b string"), "a", "b"), path=str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).count() == 2
    with pytest.raises(ValueError):
        sinks.publish(spark.range(1), "id", "id", qos=3)


def stores(spark, tmp_path):
    source = m.PathStore(spark, str(tmp_path / "src"))
    target = m.PathStore(spark, str(tmp_path / "tgt"))
    for name, n in (("one", 3), ("two", 2), ("tmp_x", 1)):
        spark.range(n).write.parquet(source.path(name))
    spark.range(7, 9).write.parquet(target.path("two"))
    return source, target


def ids(store, name):
    return sorted(r.id for r in store.read(name).collect())


def test_migrate(spark, tmp_path):
    source, target = stores(spark, tmp_path)
    dry = m.migrate(source, target, exclude=["^tmp"]).collect()
    assert [(r.name, r.action, r.n_rows, r.status) for r in dry] == [
        ("one", "create", 3, "planned"), ("two", "skip_exists", None, "skipped")]
    assert target.names() == ["two"]
    m.migrate(source, target, exclude=["^tmp"], effect=True)
    assert ids(target, "one") == [0, 1, 2] and ids(target, "two") == [7, 8]
    m.migrate(source, target, include=["two"], merge=True, effect=True)
    assert ids(target, "two") == [0, 1, 7, 8]
    m.migrate(source, target, include=["one"], merge=True, key="id", order="id", effect=True)
    assert ids(target, "one") == [0, 1, 2] and target.names() == ["one", "two"]
    m.migrate(source, target, include=["two"], force=True, effect=True)
    assert ids(target, "two") == [0, 1]
    m.migrate(source, target, include=["^t"], rename="concat('new_', it)", meta_only=True, effect=True)
    assert ids(target, "new_two") == [] and target.read("new_two").columns == ["id"]
    same = m.migrate(source, source, skip_same=True).collect()
    assert {r.action for r in same} == {"skip_same"}


def test_migrate_errors(spark, tmp_path):
    source, target = stores(spark, tmp_path)

    def fail(name):
        if name == "one":
            raise RuntimeError("broken")

    going_on = m.migrate(source, target, effect=True, on_table=fail).collect()
    assert [(r.name, r.status) for r in going_on] == [("one", "failed"), ("tmp_x", "done"), ("two", "skipped")]
    stopped = m.migrate(source, target, effect=True, abort=True, force=True, on_table=fail).collect()
    assert [(r.name, r.status, r.error) for r in stopped] == [("one", "failed", "broken")]
    missing = m.PathStore(spark, str(tmp_path / "src"), names=["gone", "two"])
    report = m.migrate(missing, target, force=True).collect()
    assert [(r.name, r.status) for r in report] == [("gone", "failed"), ("two", "planned")]


def test_migrate_catalog(spark, tmp_path):
    for db in ("from_db", "to_db"):
        spark.sql(f"drop database if exists {db} cascade")
        spark.sql(f"create database {db}")
    spark.range(4).write.saveAsTable("from_db.docs")
    spark.range(0).write.saveAsTable("from_db.none")
    spark.range(1).createOrReplaceTempView("a_view_of_the_session")
    source, target = m.CatalogStore(spark, "from_db"), m.CatalogStore(spark, "to_db")
    report = m.migrate(source, target, rename="concat('idx_', it)", effect=True, skip_empty=True, key="id", order="id",
                       settings={"shards": "3"}).collect()
    assert [(r.target, r.n_rows, r.status) for r in report] == [("idx_docs", 4, "done"), ("idx_none", 0, "skipped_empty")]
    assert ids(target, "idx_docs") == [0, 1, 2, 3]
    properties = {r.key: r.value for r in spark.sql("show tblproperties to_db.idx_docs").collect()}
    assert properties["shards"] == "3"
    m.migrate(source, target, include=["docs"], rename="concat('idx_', it)", merge=True, key="id", order="id", effect=True)
    assert ids(target, "idx_docs") == [0, 1, 2, 3] and sorted(target.names()) == ["idx_docs", "idx_none"]


SCHEMA = "topic string, payload binary, retain boolean, ts timestamp, id bigint"


def feed(spark, folder, rows):
    """Append messages ``(topic, text, retain, second, id)`` as one more file of the stream."""
    df = spark.createDataFrame(rows, "topic string, t string, retain boolean, s bigint, id bigint")
    df = df.select("topic", F.encode("t", "UTF-8").alias("payload"), "retain",
                   F.timestamp_seconds("s").alias("ts"), "id")
    df.coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


FIRST = [("a", "x", True, 10, 1), ("b", "y", True, 20, 2), ("a", "z", False, 30, 3)]
SECOND = [("a", "w", True, 40, 4), ("a", "x", True, 10, 1), ("b", "v", False, 50, 5)]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    box, out, mark = tmp_path / "box", str(tmp_path / "out"), str(tmp_path / "mark")
    for rows in (FIRST, SECOND):
        feed(spark, box, rows)
        ms.consume(ms.subscribe(stream(spark, box), "a"), out, mark).awaitTermination()
    got = sorted(r.line for r in spark.read.parquet(out).collect())
    assert got == ["[a] w", "[a] x", "[a] x", "[a] z"]


def test_stream_delivers_once(spark, tmp_path):
    box, out, mark = tmp_path / "box", str(tmp_path / "out"), str(tmp_path / "mark")
    feed(spark, box, FIRST)
    feed(spark, box, SECOND)
    ms.consume(ms.deliver(stream(spark, box), 2), out, mark).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4, 5]
    assert ms.deliver(stream(spark, box), 1).columns == stream(spark, box).columns
    with pytest.raises(ValueError):
        ms.deliver(stream(spark, box), 5)


def test_stream_relay_retained_and_push(spark, tmp_path):
    box = tmp_path / "box"
    def path(name):
        return str(tmp_path / name)

    for rows in (FIRST, SECOND):
        feed(spark, box, rows)
        ms.relay(stream(spark, box), "c", path("relayed"), path("printed"), path("m1")).awaitTermination()
        ms.keep_latest(ms.retained(stream(spark, box)), path("kept"), path("m2")).awaitTermination()
        ms.push(stream(spark, box).withColumn("payload", F.decode("payload", "UTF-8")), "topic", "payload", "id",
                path("pushed"), path("m3")).awaitTermination()
    relayed = spark.read.parquet(path("relayed")).collect()
    assert {r.topic for r in relayed} == {"c"} and sorted(r.id for r in relayed) == [1, 1, 2, 3, 4, 5]
    assert sorted(r.value for r in spark.read.parquet(path("printed")).collect()) == ["v", "w", "x", "x", "y", "z"]
    kept = {r.topic: (bytes(r.payload).decode(), r.id) for r in ms.latest_state(spark, path("kept")).collect()}
    assert kept == {"a": ("w", 4), "b": ("y", 2)}
    pushed = ms.pushed(spark, path("pushed")).where("key = 'b'").collect()
    assert {(r.position, r.value) for r in pushed} == {(1, "v"), (2, "y")}
    assert ms.pushed(spark, path("pushed"), "set").where("key = 'a'").count() == 3


def test_late_messages_are_delivered(spark, tmp_path):
    """Older messages come in later batches; a repeat of each comes too."""
    box, out, mark = tmp_path / "box", str(tmp_path / "out"), str(tmp_path / "mark")
    for row in [("a", "p", True, 900_000, 1), ("a", "q", True, 800_000, 2), ("a", "r", True, 20, 3), ("a", "s", True, 10, 4), ("a", "r", True, 20, 3)]:
        feed(spark, box, [row])
        ms.consume(ms.deliver(stream(spark, box), 2), out, mark).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4]


def test_seen_ranges():
    """States hold what they were made from, in the smaller form."""
    rng = np.random.default_rng(4)
    size = 1 << seen.RANGE_BITS
    for share, form in ((0, "intervals"), (0.001, "intervals"), (0.3, "bitmap"), (0.9999, "intervals"), (1, "intervals")):
        members = rng.random(size) < share
        state = seen._state(members)
        assert (seen._members(state) == members).all()
        assert (len(state) == size // 8) == (form == "bitmap") and len(state) <= size // 8
    assert len(seen._state(np.ones(size, bool))) == 4


def test_compact_delivery(spark, tmp_path):
    """Shuffled repeats over many batches, late ones too; the state is a row for each range of ids."""
    box, out, mark = tmp_path / "box", str(tmp_path / "out"), str(tmp_path / "mark")
    rng = random.Random(2)
    ids = [*range(20_000), *range(20_000), *[-5, -5, (1 << 63) - 1, -(1 << 63), (1 << 63) - 1]]
    rng.shuffle(ids)
    for i in range(0, len(ids), 10_000):
        feed(spark, box, [("a", str(n), True, 1_000 - i // 100, n) for n in ids[i:i + 10_000]])
    query = ms.consume(ms.deliver(stream(spark, box), 2, compact=True), out, mark)
    query.awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == sorted(set(ids))
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 64 + 3
    feed(spark, box, [("b", "late", True, 1, 17), ("b", "new", True, 1, 20_000), ("b", "none", True, 1, None), ("b", "none", True, 1, None)])
    query = ms.consume(ms.deliver(stream(spark, box), 2, compact=True), out, mark)
    query.awaitTermination()
    assert sorted(bytes(r.payload).decode() for r in spark.read.parquet(out).where("topic = 'b'").collect()) == ["new", "none", "none"]
    with pytest.raises(ValueError):
        ms.deliver(stream(spark, box), 2, id="topic", compact=True)


def test_lists_keep_their_positions(spark, tmp_path, monkeypatch):
    """Equal to ranking everything after each batch: orders that come out of turn, ties, null and heavy keys, splits and rewrites."""
    monkeypatch.setattr(collected, "VERSIONS", 2)
    rng, lists, rows = random.Random(6), collected.SegmentedList(spark, str(tmp_path / "l"), limit=20), []
    for i in range(5):
        new = [(rng.choice(["hot", "hot", "hot", "b", None]), f"v{rng.randrange(9)}{i}", rng.choice([rng.randrange(-50, 400), rng.randrange(1 << 40), 7]))
               for _ in range(60 if i < 4 else 1)]
        batch = spark.createDataFrame(new, "key string, value string, ord long")
        lists.add(batch, f"b{i}")
        lists.add(batch, f"b{i}")  # run again
        rows += new
        want = set()
        for key in ("hot", "b", None):
            mine = sorted(((o, v) for k, v, o in rows if k == key), reverse=True)
            want |= {(key, n, v) for n, (_, v) in enumerate(mine, 1)}
        assert {tuple(r) for r in lists.read().collect()} == want and lists.read().count() == len(rows)
    sizes = lists.segments.read().where("n > 0").collect()
    assert len({r.version for r in sizes}) <= 3 and len(list((tmp_path / "l" / "data").iterdir())) <= 8
    assert max(r.n for r in sizes if r.level < collected.LEVELS) <= 20 and not (tmp_path / "l" / "staged").exists()


def test_a_batch_rewrites_the_touched_segments(spark, tmp_path):
    lists = collected.SegmentedList(spark, str(tmp_path / "l"), limit=64)
    lists.add(spark.range(4000).select(F.lit("k").alias("key"), F.col("id").cast("string").alias("value"), F.col("id").alias("ord")), "b0")
    lists.add(spark.createDataFrame([("k", "x", 70), ("k", "y", 9999)], "key string, value string, ord long"), "b1")
    written = lists.segments.read().where("n > 0 and version = 1").agg(F.sum("n"), F.count("*")).first()
    assert written[0] <= 66 and written[1] <= 2
    assert lists.read().where("value in ('x', 'y', '0')").orderBy("position").select("position", "value").collect() == [(1, "y"), (3931, "x"), (4002, "0")]


def test_malformed_payload_does_not_stop_a_stream(spark, tmp_path):
    box, out, mark = tmp_path / "box", str(tmp_path / "out"), str(tmp_path / "mark")
    rows = spark.sql("select 'a' as topic, x'61ff62' as payload, true as retain, timestamp_seconds(5) as ts, 1L as id")
    rows.select(*[F.col(f.name).cast(f.dataType) for f in stream(spark, tmp_path).schema]).write.mode("append").parquet(str(box))
    ms.consume(ms.subscribe(stream(spark, box), "a").select("line"), out, mark).awaitTermination()
    assert [r.line for r in spark.read.parquet(out).collect()] == ["[a] a\ufffdb"]


def test_new_checkpoint_keeps_what_an_old_one_wrote(spark, tmp_path):
    box, out = tmp_path / "box", str(tmp_path / "out")
    feed(spark, box, FIRST)
    for mark in ("m1", "m2"):
        ms.push(stream(spark, box).withColumn("payload", F.decode("payload", "UTF-8")), "topic", "payload", "id", out,
                str(tmp_path / mark), fmt="json").awaitTermination()
    assert spark.read.json(out).count() == 2 * len(FIRST)


def test_retained_over_many_batches(spark, tmp_path, monkeypatch):
    """What is written grows with what changes, not with what the table holds; few folders are left."""
    box, out, mark, written = tmp_path / "box", str(tmp_path / "kept"), str(tmp_path / "mark"), []
    write = levels.LevelledTable._write

    def counted(table, rows, run):
        write(table, rows, run)
        written.append((run.level, table._rows(run).count()))

    monkeypatch.setattr(levels.LevelledTable, "_write", counted)
    feed(spark, box, [(f"t{i}", "first", True, 1, i) for i in range(500)])
    for i in range(20):
        feed(spark, box, [("a", f"v{i}", True, 10 + i, 1000 + i), (f"t{i}", "w", True, 5, 2000 + i), ("b", "old", True, 400 - i, 3000 + i)])
    ms.keep_latest(ms.retained(stream(spark, box)), out, mark).awaitTermination()
    got = {r.topic: bytes(r.payload).decode() for r in ms.latest_state(spark, out).collect()}
    assert len(got) == 502 and got["a"] == "v19" and got["b"] == "old" and [got[f"t{i}"] for i in (0, 19, 20)] == ["w", "w", "first"]
    deltas = sum(n for level, n in written if level == 0)
    assert len([1 for level, _ in written if level == 0]) == 21 and sum(n for _, n in written) <= 4 * deltas < 21 * 500
    assert max(level for level, _ in written) == 2 and len(list((tmp_path / "kept").iterdir())) <= 12
    table = levels.LevelledTable(spark, out, ("topic",))
    last, before = table.runs()[-1], len(written)
    table.add(spark.createDataFrame([("a", b"again", None, 0)], table.read().schema), last.tag)  # a batch that is run again
    assert len(written) == before and table.read().count() == 502


def test_merged_runs_stand_for_their_parts(spark, tmp_path):
    table = levels.LevelledTable(spark, str(tmp_path / "t"), ("k",), fanout=2)
    for i in range(7):
        table.add(spark.createDataFrame([(1, i), (10 + i, i)], "k int, v int"), f"b{i}")
        assert {r.k: r.v for r in table.read().collect()} == {1: i, **{10 + j: j for j in range(i + 1)}}
    assert [(r.first, r.last, r.level) for r in table.runs()] == [(0, 3, 2), (4, 5, 1), (6, 6, 0)]
    (tmp_path / "t" / "run=7-7-0-b7.part").mkdir()  # left by a writer that failed
    assert table.read().count() == 8
    table.add(spark.createDataFrame([(1, 99)], "k int, v int"), "b7")
    assert table.read().where("k = 1").first().v == 99 and table.runs()[0].level == 3


def test_bucketed_upserts_rewrite_what_they_touch(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.lit(None).cast("int").alias("a.b"))
    table = buckets.BucketedTable.create(rows.unionByName(spark.createDataFrame([(None, "n", 1), (None, "n", 1)], "k long, v string, `a.b` int")), path, "k", buckets=32)

    def files():
        return {str(f.relative_to(path)) for f in (tmp_path / "table" / "data").rglob("*.parquet")}

    before = files()
    updates = spark.createDataFrame([(1, 5, "x", "new"), (2, 5, "x", "new"), (1, 9, "x", "newer"), (2000, 1, "x", "added"), (None, 1, "x", "n")],
                                    "k int, at int, extra string, v string").withColumn("a.b", F.lit("7"))
    assert table.upsert(updates, "at") == len({b for b in _buckets(spark, [1, 2, 2000], 32)}) + 1
    assert before <= files()
    got = {r.k: (r.v, r["a.b"]) for r in table.read().where("k is not null").collect()}
    assert len(got) == 1001 and got[1] == ("newer", 7) and got[2] == ("new", 7) and got[2000] == ("added", 7) and got[3] == ("old", None)
    assert table.read().where("k is null").count() == 3
    valid = {f"data/version={v}/_b={b}/" for b, v, _ in table.manifest()}
    untouched = {f for f in before if any(f.startswith(v) for v in valid)}
    assert len(untouched) >= len(before) - 8 and sum(n for *_, n in table.manifest()) == 1004
    assert {tuple(r) for r in table.lookup(spark.createDataFrame([(1,), (5,), (None,), (-7,)], "k long")).select("k", "v").collect()} == {(1, "newer"), (5, "old")}
    assert table.upsert(updates.where("false"), "at") == 0 and table.version() == 1
    table.upsert(updates.where("k = 1").withColumn("v", F.lit("last")), "at")
    assert table.vacuum(keep=1) > 0 and table.read().where("k = 1").first().v == "last" and table.read().count() == 1004
    with pytest.raises(FileExistsError):
        buckets.BucketedTable.create(rows, path, "k")


def _buckets(spark, keys, n):
    return [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k long").select(F.pmod(F.xxhash64("k"), F.lit(n))).collect()]


def test_bucketed_upsert_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    table = buckets.BucketedTable.create(spark.range(10).withColumn("v", F.lit(1)), str(tmp_path / "t"), "id", buckets=4)
    updates = spark.range(5).withColumn("v", F.lit(2))
    monkeypatch.setattr(buckets.BucketedTable, "_publish", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        table.upsert(updates, "v")
    monkeypatch.undo()
    assert table.read().agg(F.sum("v")).first()[0] == 10
    assert table.upsert(updates, "v") and table.read().agg(F.sum("v")).first()[0] == 15
    empty = buckets.BucketedTable.create(spark.range(0).withColumn("v", F.lit(1)), str(tmp_path / "e"), "id")
    assert empty.read().count() == 0 and empty.upsert(updates, "v") and empty.read().count() == 5


def test_migrate_never_overwrites_on_create(spark, tmp_path):
    source, target = m.PathStore(spark, str(tmp_path / "from")), m.PathStore(spark, str(tmp_path / "to"))
    source.write("a", spark.range(2), "errorifexists", {})
    target.write("_a", spark.range(5), "errorifexists", {})
    assert target.names() == ["_a"]
    report = m.migrate(source, target, rename="concat('_', it)", effect=True).collect()
    assert [(r.action, r.status) for r in report] == [("skip_exists", "skipped")] and target.read("_a").count() == 5
    hidden = m.PathStore(spark, str(tmp_path / "to"), names=[])  # one that came in after the plan was made
    report = m.migrate(source, hidden, rename="concat('_', it)", effect=True).collect()
    assert report[0].status == "failed" and target.read("_a").count() == 5


def test_empty_source_is_replaced_but_not_copied(spark, tmp_path):
    source, target = m.PathStore(spark, str(tmp_path / "from")), m.PathStore(spark, str(tmp_path / "to"))
    source.write("a", spark.range(0), "errorifexists", {})
    target.write("a", spark.range(5), "errorifexists", {})
    report = m.migrate(source, target, force=True, skip_empty=True, effect=True).collect()
    assert report[0].status == "skipped_empty" and target.read("a").count() == 0


def test_swap_leaves_nothing_behind(spark, tmp_path):
    target = m.PathStore(spark, str(tmp_path / "to"))
    target.write("a", spark.range(3), "errorifexists", {})
    target.swap("a", target.read("a").where("id > 0"), {})
    assert target.names() == ["a"] and target.read("a").count() == 2


def test_key_needs_an_order(spark, tmp_path):
    store = m.PathStore(spark, str(tmp_path))
    with pytest.raises(ValueError):
        m.migrate(store, store, key="id")
    rows = spark.createDataFrame([(None, 1), (None, 2), (1, 1), (1, 2)], "k int, at int")
    assert sorted(map(str, map(tuple, sinks.latest_by_key(rows, "k", "at").collect()))) == ["(1, 2)", "(None, 1)", "(None, 2)"]

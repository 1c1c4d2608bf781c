"""Tool calls and their results, linked, ordered, validated and written as canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablework.llm.common import scratch

KEY = ["conv_id", "call_id"]


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and no blanks; null where malformed."""
    return F.to_json(F.try_parse_json(text))


def levels(nodes: DataFrame, needs: DataFrame) -> DataFrame:
    """``nodes(conv_id, call_id)`` with ``level``: 0 without needs, else one more than the highest of those needed.

    ``needs(conv_id, call_id, need)`` names nodes only. Nodes on a cycle, or that need one, have a null level.

    Chains of calls that need one other each are shortened by pointer doubling, in log(length) rounds. The
    rest, calls that need several, are ordered level by level; each such round resolves those whose needs all
    have their level. Each round is a join that is written down.
    """
    degree = needs.groupBy(*KEY).agg(F.count("*").alias("degree"))
    needs = scratch(needs.join(degree, KEY), "call-edges")
    links = needs.where("degree = 1").select(*KEY, F.col("need").alias("to"), F.lit(1).cast("long").alias("steps"))
    links = scratch(links, "call-chains")
    longest = links.count()
    reached = 1
    while longest and reached <= longest:
        ahead = links.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"))
        links = scratch(links.join(ahead, ["conv_id", "to"], "left").select(
            *KEY, F.coalesce("next", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
            F.col("next").isNotNull().alias("moved")), "call-chains")
        if links.where("moved").isEmpty():
            break
        links, reached = links.drop("moved"), 2 * reached
    links = links.select(*KEY, "to", "steps")

    done = nodes.join(degree, KEY, "left_anti").withColumn("level", F.lit(0).cast("long"))
    done = scratch(done, "call-levels")
    end = links.select("conv_id", F.col("call_id").alias("need"), "to", "steps")
    open_needs = scratch(needs.where("degree > 1").join(end, ["conv_id", "need"], "left").select(
        *KEY, F.coalesce("to", "need").alias("to"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps")), "call-needs")
    while not open_needs.isEmpty():
        there = done.select("conv_id", F.col("call_id").alias("to"), "level")
        new = open_needs.join(there, ["conv_id", "to"], "left").groupBy(*KEY).agg(
            F.max(F.col("level") + F.col("steps")).alias("level"), F.count("*").alias("all"), F.count("level").alias("met"))
        new = scratch(new.where("all = met").select(*KEY, "level"), "call-levels")
        if new.isEmpty():
            break
        done = done.unionByName(new)
        open_needs = scratch(open_needs.join(new, KEY, "left_anti"), "call-needs")
    there = done.select("conv_id", F.col("call_id").alias("to"), "level")
    chained = links.join(there, ["conv_id", "to"]).select(*KEY, (F.col("level") + F.col("steps")).alias("level"))
    return nodes.join(done.unionByName(chained), KEY, "left").withColumn("level", F.col("level").cast("int"))


def argument_errors(arguments: Column, params: Column) -> Column:
    """Where the arguments (JSON text) break ``params``, an array of (name, type, required); null params: unknown tool.

    Types are string, integer, number, boolean, array and object. An integer is a number too.
    """
    given = F.from_json(arguments, "map<string,variant>")
    is_object = F.try_variant_get(F.try_parse_json(arguments), "$", "map<string,variant>").isNotNull()

    def kind(value: Column) -> Column:
        t = F.schema_of_variant(value)
        return F.when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").when(t == "BIGINT", "integer") \
            .when(t.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number").when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object").otherwise("null")

    def of_param(p: Column) -> Column:
        value = given[p["name"]]
        found = kind(value)
        fits = (found == p["type"]) | ((found == "integer") & (p["type"] == "number"))
        return F.when(~F.map_contains_key(given, p["name"]), F.when(p["required"], F.concat(F.lit("missing "), p["name"]))) \
            .when(~fits, F.concat(p["name"], F.lit(" is "), found, F.lit(", not "), p["type"]))

    names = F.transform(params, lambda p: p["name"])
    extra = F.transform(F.array_sort(F.array_except(F.map_keys(given), names)), lambda k: F.concat(F.lit("unknown "), k))
    wrong = F.filter(F.transform(params, of_param), lambda e: e.isNotNull())
    return F.when(params.isNull(), F.array(F.lit("unknown tool"))) \
        .when(~F.coalesce(is_object, F.lit(False)), F.array(F.lit("arguments are no JSON object"))) \
        .otherwise(F.concat(wrong, extra))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Messages of tool calls and results, in an order in which each comes after what it needs.

    ``calls(conv_id, call_id, seq, name, arguments, needs)``: arguments as JSON text, ``needs`` the ids of the calls
    whose results the arguments use; ``results(conv_id, call_id, seq, content)``; ``schemas(name, params)``, with
    params an array of (name, type, required), one row per tool.

    Calls and results are hash-joined by identifier. One row per identifier: conv_id, call_id, level, seq, name,
    status, errors, call_json, result_json. Sorted by (conv_id, level, seq, call_id), each call and then
    its result, the rows are a topological order; ``level`` is null on cycles of needs, which come last. status is
    ``linked``, ``no result`` (yet), ``no call`` (a result of an unknown call; level, name and call_json null),
    or ``cycle``. ``errors`` lists what breaks the schema, needs that name no call of the conversation, and
    repeated calls or results: of several the one of the smallest (seq, content) counts.

    JSON is canonical: sorted keys, no blanks. Malformed arguments are written as the string they are. Null identifiers link with
    nothing and are left out; null arguments count as ``{}``, a null content as empty. Empty inputs give no
    rows. Hot conversations are no trouble: keys are (conv_id, call_id), and repeats are
    aggregated before they are joined. Further columns are not read.
    """
    valid = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    call = calls.where(valid).groupBy(*KEY).agg(
        F.min(F.struct("seq", F.coalesce("arguments", F.lit("{}")).alias("arguments"), "name",
                       F.coalesce("needs", F.array().cast("array<string>")).alias("needs"))).alias("c"), F.count("*").alias("n")) \
        .select(*KEY, "c.*", (F.col("n") > 1).alias("again"))
    call = scratch(call, "calls")
    result = results.where(valid).groupBy(*KEY).agg(
        F.min(F.struct("seq", F.coalesce("content", F.lit("")).alias("content"))).alias("r"), F.count("*").alias("n")) \
        .select(*KEY, F.col("r.seq").alias("result_seq"), "r.content", (F.col("n") > 1).alias("result_again"))

    wanted = call.select(*KEY, F.explode(F.array_distinct("needs")).alias("need")).where("need is not null")
    known = call.select("conv_id", F.col("call_id").alias("need"), F.lit(True).alias("known"))
    wanted = scratch(wanted.join(known, ["conv_id", "need"], "left"), "call-wanted")
    order = levels(call.select(*KEY), wanted.where("known").select(*KEY, "need"))
    unknown = wanted.where("known is null").groupBy(*KEY) \
        .agg(F.array_sort(F.collect_set(F.concat(F.lit("needs unknown call "), "need"))).alias("unknown"))

    tools = schemas.groupBy("name").agg(F.min("params").alias("params"))
    full = call.join(tools, "name", "left").join(order, KEY, "left").join(unknown, KEY, "left") \
        .withColumn("called", F.lit(True)).join(result, KEY, "full")
    none = F.array().cast("array<string>")
    note = lambda flag, text: F.when(F.coalesce(flag, F.lit(False)), F.array(F.lit(text))).otherwise(none)
    errors = F.concat(F.when(F.col("called"), argument_errors(F.col("arguments"), F.col("params"))).otherwise(none),
                      F.coalesce("unknown", none), note(F.col("again"), "repeated call"), note(F.col("result_again"), "repeated result"))
    text = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")  # noqa: E731  a JSON string
    written = F.when(F.try_parse_json("arguments").isNotNull(), canonical_json(F.col("arguments"))).otherwise(text("arguments"))
    call_json = F.concat(F.lit('{"arguments":'), written, F.lit(',"id":'), text("call_id"), F.lit(',"name":'),
                         F.coalesce(F.when(F.col("name").isNotNull(), text("name")), F.lit("null")), F.lit(',"type":"tool_call"}'))
    result_json = F.concat(F.lit('{"content":'), text("content"), F.lit(',"id":'), text("call_id"), F.lit(',"type":"tool_result"}'))
    status = F.when(F.col("called").isNull(), "no call").when(F.col("level").isNull(), "cycle") \
        .when(F.col("content").isNull(), "no result").otherwise("linked")
    return full.select(*KEY, "level", F.coalesce("seq", "result_seq").alias("seq"), "name", status.alias("status"), errors.alias("errors"),
                       F.when(F.col("called"), call_json).alias("call_json"),
                       F.when(F.col("content").isNotNull(), result_json).alias("result_json"))

"""Session files of three harnesses: discovery, admission, parsing.

JSONL: one message a line with blocks (text, thinking, tool_use, tool_result). JSON or streaming JSONL with a
`messages` list and `toolCalls`. Three tables (session, message, part) with a JSON column. Malformed lines are
left out; a file that can't be read at all is a row of the errors table, never a failed job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILE_TOOLS = ["Read", "Edit", "Write", "Glob", "NotebookEdit"]
BLOCK = "struct<type:string,text:string,thinking:string,id:string,name:string,input:struct<file_path:string,notebook_path:string,command:string,description:string,subagent_type:string>,tool_use_id:string,content:string,is_error:boolean>"
USAGE = "struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint>"
MESSAGE = f"type string, subtype string, sessionId string, cwd string, gitBranch string, version string, timestamp string, permissionMode string, entrypoint string, userType string, isSidechain boolean, toolUseResult string, content string, message struct<content:string,model:string,usage:{USAGE}>"
DROPPED = ["progress", "file-history-snapshot", "queue-operation"]


def discovered(spark: SparkSession, folder: str, pattern: str, file_type: str, subagents: bool = False) -> DataFrame:
    """abs_path, file_type, project, content_hash, size of the files under a folder. Reads metadata and content
    hashes in the executors; nothing is listed on the driver beyond Spark's own file index."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    root = folder.rstrip("/").removeprefix("file://") + "/"
    rest = F.substring_index(F.col("path"), root, -1)
    out = files.select(F.col("path").alias("abs_path"), F.lit(file_type).alias("file_type"), F.element_at(F.split(rest, "/"), 1).alias("project"), F.sha2("content", 256).alias("content_hash"), F.col("length").alias("size"))
    return out if subagents else out.where(~F.contains("abs_path", F.lit("/subagents/")))


def file_id(path: Column) -> Column:
    return F.sha2(path, 256)


def admitted(found: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files to ingest: not those unchanged and ingested, nor those whose content another path already has; of
    several new paths with one content the first stays. ledger: id, content_hash, status."""
    rows = found.withColumn("id", file_id(F.col("abs_path")))
    done = ledger.where("status = 'ingested'").select("id", "content_hash")
    rows = rows.join(done, ["id", "content_hash"], "left_anti")
    other = ledger.select("content_hash", F.col("id").alias("other"))
    rows = rows.join(other, (rows["content_hash"] == other["content_hash"]) & (rows["id"] != other["other"]), "left_anti")
    first = Window.partitionBy("content_hash").orderBy("abs_path")
    return rows.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r").withColumn("status", F.lit("pending"))


def marked(ledger: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """The ledger with `status` on the given ids."""
    hit = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    return ledger.join(hit, "id", "left").withColumn("status", F.when(F.col("__hit"), status).otherwise(F.col("status"))).drop("__hit")


def plugin_of(path: Column, file_type: Column) -> Column:
    """The parser of a file: by its type where known, else by its path."""
    return (
        F.when(file_type.isin("claude_code", "gemini_cli", "opencode"), file_type)
        .when(path.rlike(r"::"), "opencode")
        .when(path.rlike(r"/chats/session-.*\.jsonl?$"), "gemini_cli")
        .when(path.endswith(".jsonl"), "claude_code")
    )


def jsonl_messages(spark: SparkSession, folder: str) -> DataFrame:
    """path, line, m (the message), blocks, plain (content that is a text) of every well-formed line."""
    lines = spark.read.text(folder, recursiveFileLookup=True, pathGlobFilter="*.jsonl").where(F.trim("value") != "")
    return parsed(lines.select(F.col("_metadata.file_path").alias("path"), F.col("value"), F.monotonically_increasing_id().alias("line")))


def parsed(lines: DataFrame) -> DataFrame:
    """The messages of lines (path, line, value), malformed ones left out."""
    rows = lines.withColumn("m", F.from_json("value", MESSAGE)).where(F.try_parse_json("value").isNotNull())
    raw = F.col("m.message.content")
    return rows.select("path", "line", "m", F.from_json(raw, f"array<{BLOCK}>").alias("blocks"), F.when(~F.coalesce(raw.startswith("["), F.lit(False)), raw).alias("plain"))


def kept(messages: DataFrame) -> DataFrame:
    return messages.where(~F.coalesce(F.col("m.type").isin(DROPPED), F.lit(False)) & F.col("m.type").isin("user", "assistant"))


def session_attributes(messages: DataFrame) -> DataFrame:
    """path, session_id, cwd, git_branch, version: the first that is set; session_start, total_lines, summary."""
    first = lambda c: F.min_by(F.col(f"m.{c}"), F.when(F.col(f"m.{c}").isNotNull(), F.col("line")))
    away = F.when((F.col("m.type") == "system") & (F.col("m.subtype") == "away_summary"), F.trim(F.split_part("m.content", F.lit(" (disable recaps"), F.lit(1))))
    return messages.groupBy("path").agg(
        first("sessionId").alias("session_id"), first("cwd").alias("cwd"), first("gitBranch").alias("git_branch"), first("version").alias("version"),
        F.min("m.timestamp").alias("session_start"), F.count("*").alias("total_lines"),
        F.max_by(away, F.when(away.isNotNull() & (away != ""), F.col("line"))).alias("summary"),
    )


def session_metadata(messages: DataFrame) -> DataFrame:
    """path, token sums, turns, models in order of sight, dominant model (first seen of equals), duration in ms."""
    usage = lambda c: F.coalesce(F.sum(F.coalesce(F.col(f"m.message.usage.{c}"), F.lit(0))), F.lit(0))
    when = F.try_to_timestamp("m.timestamp")
    base = messages.groupBy("path").agg(
        usage("input_tokens").alias("input_tokens"), usage("output_tokens").alias("output_tokens"), usage("cache_read_input_tokens").alias("cache_read"),
        F.count_if(F.col("m.type") == "assistant").alias("assistant_turns"),
        F.count_if((F.col("m.type") == "user") & F.col("m.toolUseResult").isNull()).alias("user_turns"),
        F.sum(F.size(F.filter(F.coalesce("blocks", F.array().cast(f"array<{BLOCK}>")), lambda b: b["type"] == "tool_use"))).alias("tool_calls"),
        (F.unix_millis(F.max(when)) - F.unix_millis(F.min(when))).alias("duration_ms"),
    )
    models = messages.where("m.message.model IS NOT NULL").groupBy("path", F.col("m.message.model").alias("model")).agg(F.count("*").alias("n"), F.min("line").alias("at"))
    seen = models.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "model"))), lambda x: x["model"]).alias("models_used"), F.max_by("model", F.struct("n", (-F.col("at")).alias("at"))).alias("dominant_model"))
    return base.join(seen, "path", "left")


def jsonl_exchanges(messages: DataFrame) -> DataFrame:
    """Messages with their exchange: a user turn that is no tool result opens one."""
    rows = kept(messages)
    opens = (F.col("m.type") == "user") & (F.col("m.toolUseResult").isNull() | F.col("m.toolUseResult").isin("false", ""))
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("exchange", F.sum(opens.cast("int")).over(w) - 1).where("exchange >= 0")


def tool_calls(exchanges: DataFrame) -> DataFrame:
    """path, exchange, line, pos, name, target, id, file_path, command of each tool call."""
    rows = exchanges.where("m.type = 'assistant'").select("path", "exchange", "line", F.posexplode("blocks").alias("pos", "b")).where("b.type = 'tool_use'")
    file = F.coalesce("b.input.file_path", "b.input.notebook_path", F.lit(""))
    target = F.when(F.col("b.name").isin(FILE_TOOLS), file).when(F.col("b.name") == "Bash", F.regexp_extract(F.coalesce("b.input.command", F.lit("")), r"^\s*(\S+)", 1)).otherwise(F.col("b.name"))
    return rows.select("path", "exchange", "line", "pos", F.col("b.name").alias("name"), target.alias("target"), F.col("b.id").alias("id"), F.col("b.input.file_path").alias("file_path"), F.col("b.input.command").alias("command"))


def input_summary(block: Column) -> Column:
    """A tool call's input in short."""
    i = block["input"]
    return (
        F.when(block["name"].isin("Read", "Edit", "Write", "Glob"), F.concat(F.lit("file_path="), F.coalesce(i["file_path"], F.lit(""))))
        .when(block["name"] == "Bash", F.concat(F.lit("command="), F.left(F.coalesce(i["command"], F.lit("")), F.lit(80))))
        .when(block["name"] == "Agent", F.concat(F.coalesce(i["subagent_type"], F.lit("")), F.lit(": "), F.left(F.coalesce(i["description"], F.lit("")), F.lit(60))))
        .otherwise(F.left(F.to_json(i), F.lit(60)))
    )


def descriptors(exchanges: DataFrame) -> DataFrame:
    """A row for each exchange: user words and text, tool calls with targets, errors, model turns."""
    said = F.coalesce("plain", F.array_join(F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), " "), F.lit(""))
    opens = exchanges.groupBy("path", "exchange").agg(F.min_by(said, "line").alias("user_text"), F.count_if(F.col("m.type") == "assistant").alias("model_turn_count"))
    calls = tool_calls(exchanges).groupBy("path", "exchange").agg(F.array_sort(F.collect_list(F.struct("line", "pos", "name", "target"))).alias("calls"))
    fails = exchanges.where("m.type = 'user'").select("path", "exchange", "line", F.posexplode("blocks").alias("pos", "b")).where("b.type = 'tool_result'")
    fails = fails.groupBy("path", "exchange").agg(F.array_sort(F.collect_list(F.struct("line", "pos", F.coalesce("b.is_error", F.lit(False)).alias("error")))).alias("results"))
    out = opens.join(calls, ["path", "exchange"], "left").join(fails, ["path", "exchange"], "left")
    none_s, none_b = F.array().cast("array<struct<name:string,target:string>>"), F.array().cast("array<boolean>")
    words = F.regexp_count("user_text", F.lit(r"\S+")).cast("long")
    return out.select(
        "path", "exchange", words.alias("user_word_count"), F.left("user_text", F.lit(2000)).alias("user_text"), "model_turn_count",
        F.coalesce(F.transform("calls", lambda c: F.struct(c["name"].alias("name"), c["target"].alias("target"))), none_s).alias("tool_calls"),
        F.coalesce(F.transform("results", lambda r: r["error"]), none_b).alias("tool_errors"),
    )


def evidence(exchanges: DataFrame, most: int = 4000) -> DataFrame:
    """(path, exchange, evidence): every tool result under its call, by id or else by position, cut at `most`."""
    uses = exchanges.where("m.type = 'assistant'").select("path", "exchange", "line", F.posexplode("blocks").alias("pos", "b")).where("b.type = 'tool_use'")
    order = Window.partitionBy("path", "exchange").orderBy("line", "pos")
    uses = uses.select("path", "exchange", F.row_number().over(order).alias("nth"), F.col("b.id").alias("id"), F.concat(F.col("b.name"), F.lit("("), input_summary(F.col("b")), F.lit(")")).alias("call"))
    got = exchanges.where("m.type = 'user'").select("path", "exchange", "line", F.posexplode("blocks").alias("pos", "b")).where("b.type = 'tool_result'")
    got = got.select("path", "exchange", F.row_number().over(order).alias("nth"), F.col("b.tool_use_id").alias("id"), F.left(F.coalesce("b.content", F.lit("")), F.lit(most)).alias("result"))
    by_id = got.join(uses.select("path", "exchange", "id", F.col("call").alias("c1")), ["path", "exchange", "id"], "left")
    both = by_id.join(uses.select("path", "exchange", "nth", F.col("call").alias("c2")), ["path", "exchange", "nth"], "left")
    line = F.concat(F.lit("[tool: "), F.coalesce("c1", "c2", F.lit("?")), F.lit("]\n"), "result")
    by = both.groupBy("path", "exchange").agg(F.array_sort(F.collect_list(F.struct("nth", line.alias("line")))).alias("all"))
    return by.select("path", "exchange", F.array_join(F.transform("all", lambda x: x["line"]), "\n\n").alias("evidence"))


def with_results(calls: Column, results: Column, most: int = 800) -> Column:
    """calls (array of structs name, args) with the text and error mark of their results (array of structs text, error).

    A result goes to the first call that has no text yet. One without text leaves its call open, so that the next
    result goes there too: the i-th result with text is the i-th call's, and of results without text only
    one that is the very last still shows, by its error mark on the first open call. Surplus results are left out.
    """
    told = F.filter(results, lambda r: r["text"] != "")
    last = F.try_element_at(results, F.lit(-1))

    def one(call: Column, i: Column) -> Column:
        got = F.get(told, i)
        error = F.when(i < F.size(told), got["error"]).when((i == F.size(told)) & (last["text"] == ""), last["error"])
        text = F.when(i < F.size(told), F.left(got["text"], F.lit(most))).otherwise(F.lit(""))
        return F.struct(call["name"].alias("name"), call["args"].alias("args"), text.alias("result"), F.coalesce(error, F.lit(False)).alias("is_error"))

    return F.transform(calls, one)


def exchange_details(exchanges: DataFrame) -> DataFrame:
    """(path, exchange, user_text, agent_text, tool_calls, narrative): an exchange as a labeller reads it.

    agent_text: texts and the beginnings of thoughts in order, cut at 3000. tool_calls: the first ten calls with their
    input as JSON, cut at 200, and what came back (see with_results). narrative: user, agent and the first six calls by lines.
    An exchange is one row; its blocks meet in sorted arrays.
    """
    opens = (F.col("m.type") == "user") & F.coalesce(F.col("m.toolUseResult"), F.lit("")).isin("", "false")
    texts = F.array_join(F.transform(F.filter("blocks", lambda x: x["type"] == "text"), lambda x: F.coalesce(x["text"], F.lit(""))), " ")
    asked = F.when(opens, F.left(F.coalesce("plain", texts, F.lit("")), F.lit(2000)))
    blocks = exchanges.select("path", "exchange", "line", F.col("m.type").alias("by"), F.col("m.toolUseResult").alias("tool"), asked.alias("asked"), F.posexplode_outer("blocks").alias("pos", "b"))
    kind, by, b = F.col("b.type"), F.col("by"), F.col("b")
    thought = F.concat(F.lit("[thinking] "), F.left(F.coalesce(b["thinking"], F.lit("")), F.lit(400)))
    said = F.when(kind == "text", F.coalesce(b["text"], F.lit(""))).when(kind == "thinking", thought)
    parts = F.from_json(b["content"], "array<struct<text:string>>")
    listed = F.array_join(F.transform(parts, lambda x: F.coalesce(x["text"], F.lit(""))), " ")
    back = F.when(b["content"].startswith("[") & parts.isNotNull(), listed).otherwise(F.coalesce(b["content"], F.lit("")))
    item = lambda when, **cols: F.array_sort(F.collect_list(F.when(when, F.struct("line", "pos", *[c.alias(n) for n, c in cols.items()]))))
    answers = (by == "user") & ~F.coalesce(F.col("tool"), F.lit("")).isin("", "false")
    rows = blocks.groupBy("path", "exchange").agg(
        F.coalesce(F.min_by("asked", F.when(F.col("asked").isNotNull(), F.col("line"))), F.lit("")).alias("user_text"),
        item((by == "assistant") & said.isNotNull(), text=said).alias("said"),
        item((by == "assistant") & (kind == "tool_use"), name=F.coalesce(b["name"], F.lit("")), args=F.left(F.coalesce(F.to_json(b["input"]), F.lit("{}")), F.lit(200))).alias("calls"),
        item(answers & (kind == "tool_result"), text=back, error=F.coalesce(b["is_error"], F.lit(False))).alias("results"),
    )
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(f"array<struct<line:bigint,pos:int,{kind}>>"))
    agent = F.left(F.array_join(F.transform(none("said", "text:string"), lambda x: x["text"]), " "), F.lit(3000))
    calls = F.slice(with_results(none("calls", "name:string,args:string"), none("results", "text:string,error:boolean")), 1, 10)
    out = rows.select("path", "exchange", "user_text", agent.alias("agent_text"), calls.alias("tool_calls"))
    call = lambda c: F.concat(F.lit("[tool: "), c["name"], F.lit("("), F.left(c["args"], F.lit(120)), F.lit(")]"), F.when(c["is_error"], F.lit(" [ERROR]")).otherwise(F.lit("")))
    lines = F.flatten(F.transform(F.slice("tool_calls", 1, 6), lambda c: F.array(call(c), F.when(c["result"] != "", F.concat(F.lit("  → "), F.left(c["result"], F.lit(600)))))))
    head = F.array(F.when(F.col("user_text") != "", F.concat(F.lit("USER: "), F.left("user_text", F.lit(1000)))), F.when(F.col("agent_text") != "", F.concat(F.lit("AGENT: "), F.left("agent_text", F.lit(1500)))))
    return out.withColumn("narrative", F.left(F.array_join(F.concat(head, lines), "\n"), F.lit(6000)))


GEMINI = "sessionId string, startTime string, messages array<struct<id:string,timestamp:string,type:string,content:string,model:string,tokens:string,toolCalls:array<struct<id:string,name:string,status:string,args:string>>,thoughts:string>>"


def chat_messages(spark: SparkSession, folder: str) -> DataFrame:
    """path, session_id, pos, type, content, model, toolCalls of JSON chats and of their streaming JSONL form.

    In the streaming form the first line is the header and lines with $set are deltas, which are left out."""
    whole = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select(F.col("_metadata.file_path").alias("path"), F.from_json("value", GEMINI).alias("s"))
    a = whole.select("path", F.col("s.sessionId").alias("session_id"), F.posexplode("s.messages").alias("pos", "m")).select("path", "session_id", F.col("pos").cast("long").alias("pos"), "m.*")
    lines = spark.read.text(folder, recursiveFileLookup=True, pathGlobFilter="*.jsonl").select(F.col("_metadata.file_path").alias("path"), "value", F.monotonically_increasing_id().alias("pos"))
    lines = lines.where(F.try_parse_json("value").isNotNull() & F.get_json_object("value", "$['$set']").isNull())
    kind = spark.createDataFrame([], GEMINI).schema["messages"].dataType.elementType
    head = lines.groupBy("path").agg(F.min_by(F.get_json_object("value", "$.sessionId"), F.when(F.get_json_object("value", "$.sessionId").isNotNull(), F.col("pos"))).alias("session_id"))
    b = lines.where(F.get_json_object("value", "$.type").isNotNull()).select("path", "pos", F.from_json("value", kind).alias("m")).join(head, "path", "left").select("path", "session_id", "pos", "m.*")
    return a.unionByName(b)


def opencode_turns(session: DataFrame, message: DataFrame, part: DataFrame) -> DataFrame:
    """session_id, message_id, role, pos, kind, text, tool: the three tables joined in order of time and id; archived
    sessions are left out."""
    live = session.where("time_archived IS NULL").select(F.col("id").alias("session_id"), "directory")
    m = message.select(F.col("id").alias("message_id"), "session_id", F.col("time_created").alias("mt"), F.get_json_object("data", "$.role").alias("role"))
    p = part.select("message_id", F.col("time_created").alias("pt"), F.col("id").alias("part_id"), F.get_json_object("data", "$.type").alias("kind"), F.get_json_object("data", "$.text").alias("text"), F.get_json_object("data", "$.tool").alias("tool"), F.get_json_object("data", "$.state.status").alias("status"))
    rows = live.join(m, "session_id").join(p, "message_id", "left")
    w = Window.partitionBy("session_id").orderBy("mt", "message_id", "pt", "part_id")
    return rows.withColumn("pos", F.row_number().over(w) - 1)


def opencode_files(session: DataFrame, db: str) -> DataFrame:
    """One virtual file for each live session of a database export."""
    path = F.concat(F.lit(f"{db}::"), "id")
    return session.where("time_archived IS NULL").select(path.alias("abs_path"), F.lit("opencode").alias("file_type"), F.element_at(F.split("directory", "/"), -1).alias("project"), F.sha2(F.concat_ws(":", "id", F.col("time_updated").cast("string")), 256).alias("content_hash"))


def archived(spark: SparkSession, folder: str, pattern: str, file_type: str, archive: str) -> int:
    """Copy a folder's files into an archive table (by file type: path, project, hash, bytes) unless the bytes are
    there; how many were copied. Executors read, hash and write; nothing but the count comes to the driver."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    rows = files.select(F.lit(file_type).alias("file_type"), F.col("path").alias("abs_path"), F.sha2("content", 256).alias("content_hash"), "content")
    rows = rows.dropDuplicates(["content_hash"])
    there = spark._jvm.org.apache.hadoop.fs.Path(archive)
    before = 0
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        have = spark.read.parquet(archive).select("content_hash").distinct()
        before = have.count()
        rows = rows.join(have, "content_hash", "left_anti")
    rows.write.mode("append").partitionBy("file_type").parquet(archive)
    return spark.read.parquet(archive).select("content_hash").distinct().count() - before

"""Registered queries that write and read files, run streams, or switch filters; see `catalog` for the lines and the SQL."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklines.functions.levels import level_name, scan_level
from sparklines.model import DATE, FIELD, FilterDef, filter_set, save_filters
from sparklines.operators import annotate, profile
from sparklines.operators.detect import with_parts
from sparklines.operators.visibility import visible, visible_lines
from sparklines.plans.catalog import _E, _L, _PAID, DIALECTS, _dlt_files, _doc_lines, _events, _lines, _marks, _parsed, _text, _value_rows, query
from sparklines.plans.headless import FilterJob
from sparklines.shared import new_folder
from sparklines.sources.dlt import decode_messages, frame_messages, read_dlt
from sparklines.sources.lines import fingerprints, read_lines, write_lines
from sparklines.sources.ranges import list_files, range_lines, split_ranges, tail_of_files, write_files
from sparklines.streaming.follow import follow_files, follow_ranges
from sparklines.streaming.jobs import detect_as_it_comes, error_rates, latest_lines, pipe_lines, running_counts, stream_visible, write_numbered, write_visible
from sparklines.streaming.pipes import whole_lines
from sparklines.streaming.versions import Versions

# ---- files


@query(f"""{_E} SELECT '[' || iso || 'Z ' || lvl || ' app::' || event_type || '] ' || {_PAID} AS raw FROM d
WHERE event_type <> 'signup' AND (regexp_matches('user ' || user_id, 'user [1-4]') OR lvl = 'ERROR')""")
def filter_job(spark, sf_dir):
    """The whole job over files: a saved filter set with one switched off, filters of a command, formats found by file, output as text."""
    path, out = new_folder(spark, "job"), new_folder(spark, "job-out")
    write_lines(_lines(spark, sf_dir, "env_logger"), path)
    with tempfile.TemporaryDirectory() as own:  # a filter set is read by the driver alone
        save_filters([FilterDef(0, "signup", "Exclude"), FilterDef(1, "click", "Exclude", enabled=False)], f"{own}/filters.json")
        FilterJob(path, filter_file=f"{own}/filters.json", include=["user [1-4]"], fields=["level=ERROR"]).run(spark, out)
    return read_lines(spark, out, number=False).select("raw")


@query(f"{_E} SELECT lvl || ':app.' || event_type || ':' || {_PAID} AS raw FROM d WHERE line_idx % 7 < 2")
def marked_file(spark, sf_dir):
    """Marked lines saved as text; marks without a line say nothing."""
    path, marks = new_folder(spark, "marked"), _marks(spark, sf_dir)
    beyond = marks.select("src", (F.col("line_idx") + 1_000_000_000_000).alias("line_idx"))
    write_lines(annotate.marked_lines(_lines(spark, sf_dir, "python_basic"), marks.unionByName(beyond)), path)
    return read_lines(spark, path, number=False).select("raw")


@query(f"{_E} SELECT count(*) FILTER (line_idx % 2 = 0) AS known, count(*) FILTER (line_idx % 2 = 1) AS fresh FROM d")
def file_fingerprints(spark, sf_dir):
    """Lines in files that are as they were, and in files that came since."""
    path, saved, lines = new_folder(spark, "prints"), new_folder(spark, "prints-saved"), _lines(spark, sf_dir, "python_basic")
    write_lines(lines.filter("line_idx % 2 = 0"), path)
    fingerprints(spark, path).write.parquet(saved)
    lines.filter("line_idx % 2 = 1").select("raw").write.mode("append").text(path)
    same = fingerprints(spark, path).join(spark.read.parquet(saved), ["src", "fingerprint"], "left_semi").select("src", F.lit(True).alias("same"))
    every = read_lines(spark, path, number=False).groupBy("src").agg(F.count(F.lit(1)).alias("n")).join(same, "src", "left")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return every.agg(total(F.col("same")).alias("known"), total(F.col("same").isNull()).alias("fresh"))


@query(f"""{_E}, m AS (SELECT user_id, line_idx, lvl || ' paid ' || cents AS raw FROM d), x AS (
SELECT user_id, line_idx AS first, 0 AS kind, line_idx AS ref, 'note ' || line_idx AS commentary, line_idx, raw FROM m WHERE line_idx % 21 = 0
UNION ALL SELECT user_id, NULL, 1, line_idx - row_number() OVER (PARTITION BY user_id ORDER BY line_idx), '', line_idx, raw FROM m WHERE line_idx % 7 < 2 AND line_idx % 21 <> 0),
g AS (SELECT user_id, kind, ref, commentary, min(line_idx) AS first, string_agg((line_idx + 1) || ': ' || raw, chr(10) ORDER BY line_idx) AS lines,
  string_agg((line_idx + 1)::VARCHAR, ', ' ORDER BY line_idx) AS numbers FROM x GROUP BY user_id, kind, ref, commentary)
SELECT 'user ' || user_id AS src, '# user ' || user_id || ' 2024-02-01' || chr(10) || string_agg('- ' || commentary || ' (' || numbers || ')' || chr(10) || lines || chr(10), '' ORDER BY first, kind, ref)
  || 'end of user ' || user_id AS report FROM g GROUP BY user_id""")
def report_text(spark, sf_dir):
    """A report for each user, with all placeholders of the template."""
    e = _events(spark, sf_dir).withColumn("src", _text("user {user_id}"))
    lines = e.select("src", "line_idx", _text("{lvl} paid {cents}").alias("raw"))
    comments = e.filter("line_idx % 21 = 0").select(F.col("line_idx").alias("comment_id"), "src", _text("note {line_idx}").alias("text"), F.array("line_idx").alias("line_indices"))
    found = annotate.entries(lines, e.filter("line_idx % 7 < 2").select("src", "line_idx"), comments)
    return annotate.report(found, "# {{filename}} {{date}}\n", "- {{commentary}} ({{line_numbers}})\n{{lines}}\n", "end of {{filename}}", F.lit("2024-02-01"))


def _file_of_each(spark, sf_dir, dialect: str) -> str:
    """A file for each kind of event, its lines in order."""
    path, lines = new_folder(spark, "kinds"), _lines(spark, sf_dir, dialect, ("event_type",))
    lines.repartition("event_type").sortWithinPartitions("event_type", "line_idx").select("event_type", "raw").write.partitionBy("event_type").text(path)
    return f"{path}/*/*.txt"


def _kind() -> Column:
    return F.regexp_extract("src", r"event_type=(\w+)", 1).alias("kind")


_SIZES = f"""{_E}, l AS (SELECT event_type AS kind, line_idx, lvl || ':app.' || event_type || ':' || {_PAID} AS raw FROM d),
u AS (SELECT *, sum(strlen(raw) + 1) OVER (PARTITION BY kind ORDER BY line_idx) AS upto, sum(strlen(raw) + 1) OVER (PARTITION BY kind ORDER BY line_idx DESC) AS since, sum(strlen(raw) + 1) OVER (PARTITION BY kind) AS size FROM l)"""


@query(f"{_SIZES} SELECT kind, raw, CAST(upto - strlen(raw) - 1 AS BIGINT) AS at FROM u WHERE upto <= size // 2")
def head_of_file(spark, sf_dir):
    """The first half of each file, read in ranges of 4 kB."""
    path = _file_of_each(spark, sf_dir, "python_basic")
    half = F.floor(F.col("size") / 2)
    lines = range_lines(split_ranges(list_files(spark, path), 0, half, 4096)).filter(F.col("next") <= half)
    return lines.select(_kind(), F.col("raw").cast("string").alias("raw"), "at")


@query(f"{_SIZES} SELECT kind, raw, CAST(size - since AS BIGINT) AS at FROM u WHERE since < 50000 OR size <= 50000")
def tail_of_file(spark, sf_dir):
    """The last 50 kB of each file, without the first line there; no other bytes are read."""
    return tail_of_files(spark, _file_of_each(spark, sf_dir, "python_basic"), 50_000, step=4096).select(_kind(), "raw", "at")


@query(f"{_SIZES}, x AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY line_idx DESC) AS k FROM u WHERE regexp_matches(raw, '[13579]$')) SELECT kind, raw, CAST(size - since AS BIGINT) AS at FROM x WHERE k <= 100")
def tail_shown(spark, sf_dir):
    """The last 100 lines of each file that a filter job shows, looked for from the end backwards."""
    job = FilterJob(_file_of_each(spark, sf_dir, "python_basic"), include=["[13579]$"])
    return job.run_tail(spark, 100, step=4096).select(_kind(), "raw", "at")


@query(f"""{_E} SELECT line_idx // 500 AS file, line_idx % 500 AS line_idx, 'INFO' AS level, 'APP1' AS target, CASE (line_idx // 500) % 3 WHEN 2 THEN 'did ' || event_type
ELSE user_id || ' ' || -cents || ' ' || CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END || ' ' || event_type || ' 1.5' END AS message FROM d""")
def dlt_ranges(spark, sf_dir):
    """Binary files of 500 messages in each of the three layouts, with bytes in between that are none, read in ranges of 3 kB."""
    path, layout = new_folder(spark, "binary"), F.col("file") % 3
    m = _dlt_files(spark, sf_dir).select(F.col("src").cast("long").alias("at"), F.hex("content").alias("storage"))
    m = m.join(_events(spark, sf_dir).select(F.col("line_idx").alias("at"), F.hex(_text("did {event_type}")).alias("word")), "at").withColumn("file", F.floor(F.col("at") / 500))
    simple = F.concat(F.hex(F.lit("DLT\u0001ECU1APP1CTX1")), F.lit("65A5089F"), F.lpad(F.hex(F.length("word") / 2), 4, "0"), "word")
    junk = F.when(F.col("at") % 50 == 7, F.hex(F.lit("no DLT here"))).otherwise("")
    one = F.when(layout == 1, F.substring("storage", 33, 1 << 20)).otherwise(F.concat(F.when(layout == 2, simple).otherwise(F.col("storage")), junk))
    whole = m.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("at", one.alias("one")))).alias("all"))
    write_files(whole.select(F.col("file").cast("string").alias("name"), F.unhex(F.array_join(F.transform("all", lambda x: x["one"]), "")).alias("content")), path)
    lines = with_parts(read_dlt(spark, path, step=3000), "dlt")
    return lines.select(F.regexp_extract("src", "([0-9]+)$", 1).cast("long").alias("file"), "line_idx", "parts.level", "parts.target", "parts.message")


@query(f"""{_E}, m AS (SELECT 'user ' || user_id AS src, line_idx, lvl || ' paid ' || cents AS raw FROM d), x AS (
SELECT src, 0 AS kind, line_idx AS ref, 'note ' || line_idx AS commentary, line_idx, raw FROM m WHERE line_idx % 21 = 0
UNION ALL SELECT src, 1, line_idx - row_number() OVER (PARTITION BY src ORDER BY line_idx), '', line_idx, raw FROM m WHERE line_idx % 7 < 2 AND line_idx % 21 <> 0),
g AS (SELECT *, min(line_idx) OVER (PARTITION BY src, kind, ref) AS first FROM x)
SELECT DISTINCT src, 0 AS section, NULL::BIGINT AS first, NULL::INTEGER AS kind, 0 AS part, NULL::BIGINT AS line_idx, '# ' || src || ' 2024-02-01' || chr(10) AS text FROM g
UNION ALL SELECT DISTINCT src, 1, first, kind, 0, NULL, '- ' || commentary || chr(10) FROM g
UNION ALL SELECT src, 1, first, kind, 1, line_idx, CASE WHEN line_idx > first THEN chr(10) ELSE '' END || (line_idx + 1) || ': ' || raw FROM g
UNION ALL SELECT DISTINCT src, 1, first, kind, 2, NULL, chr(10) FROM g UNION ALL SELECT DISTINCT src, 2, NULL, NULL, 0, NULL, 'end of ' || src FROM g""")
def report_pieces(spark, sf_dir):
    """A report for each user whose lines stay rows."""
    e = _events(spark, sf_dir).withColumn("src", _text("user {user_id}"))
    lines = e.select("src", "line_idx", _text("{lvl} paid {cents}").alias("raw"))
    comments = e.filter("line_idx % 21 = 0").select(F.col("line_idx").alias("comment_id"), "src", _text("note {line_idx}").alias("text"), F.array("line_idx").alias("line_indices"))
    marks = e.filter("line_idx % 7 < 2").select("src", "line_idx")
    found = annotate.report_fragments(lines, marks, comments, "# {{filename}} {{date}}\n", "- {{commentary}}\n{{lines}}\n", "end of {{filename}}", F.lit("2024-02-01"))
    return found.select("src", "section", "first", "kind", "part", "line_idx", "text")


# ---- streams


def _drain(stream: DataFrame, tag: str, mode: str = "append") -> DataFrame:
    """A stream run over all its input, its rows read back from the shared folder."""
    spark = stream.sparkSession
    path = new_folder(spark, tag)
    writer = stream.writeStream.option("checkpointLocation", new_folder(spark, tag + "-mark")).trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        writer = writer.format("parquet").option("path", path)
    else:
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _streamed(table: DataFrame, tag: str) -> DataFrame:
    """A table written to the shared folder and read as a stream."""
    path = new_folder(table.sparkSession, tag)
    table.write.parquet(path)
    return table.sparkSession.readStream.schema(table.schema).parquet(path)


@query(f"{_E} SELECT 'ERROR:app.error:' || {_PAID} AS raw FROM d WHERE event_type = 'error' UNION ALL SELECT 'line two ' || event_type FROM d WHERE event_type <> 'click'")
def stream_shown(spark, sf_dir):
    """Records of two lines each, as a queue gives them; shown lines are appended to files."""
    value = F.concat(_text(DIALECTS["python_basic"]), F.lit("\r\n"), _text("line two {event_type}\n"))
    lines = pipe_lines(_streamed(_events(spark, sf_dir).select(value.alias("value")), "queue"))
    shown = stream_visible(lines, filter_set(("Exclude", "click"), ("Include", FIELD + "level:ERROR")), "common")
    return _drain(shown.select("raw"), "shown")


@query(f"""{_E} SELECT * FROM (SELECT 0 AS id, 'view' AS pattern, count(*) FILTER (event_type = 'view') AS n FROM d
UNION ALL SELECT 1, '{DATE}Jan 3', count(*) FILTER (strftime(ts, '%m-%d') = '01-03' AND event_type <> 'click') FROM d
UNION ALL SELECT 2, '{FIELD}level:WARN', count(*) FILTER (lvl = 'WARN') FROM d UNION ALL SELECT 3, 'click', count(*) FILTER (event_type = 'click') FROM d) WHERE n > 0""")
def stream_counts(spark, sf_dir):
    """Running counts of text, date and field filters."""
    lines = with_parts(_streamed(_lines(spark, sf_dir, "json"), "counted"), "json")
    return _drain(running_counts(lines, filter_set(("Include", "view"), ("Include", DATE + "Jan 3"), ("Include", FIELD + "level:WARN"), ("Exclude", "click"))), "counts", "complete")


@query(f"{_E} SELECT strftime(ts, '%Y-%m-%d %H:00') AS hour, lvl AS level, count(*) AS n FROM d GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    """Lines by level in windows of an hour."""
    e = _streamed(_events(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("t"), F.col("lvl").alias("level")), "rated")
    rates = _drain(error_rates(e, "t", "level", every="1 hour"), "rates", "complete")
    return rates.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "level", "n")


@query(f"{_E} SELECT lvl || ':app.' || event_type || ':' || {_PAID} AS raw, true AS in_order FROM d WHERE lvl <> 'INFO'")
def follow_shown(spark, sf_dir):
    """A folder followed over two runs of a stream that goes on from its checkpoint; files come in between."""
    path, out, mark = new_folder(spark, "followed"), new_folder(spark, "followed-out"), new_folder(spark, "followed-mark")
    lines = _lines(spark, sf_dir, "python_basic")
    for part in (0, 1):
        some = lines.filter(F.col("line_idx") % 2 == part).select("raw", "line_idx").sort("line_idx").select("raw")
        some.write.mode("append").text(path)
        followed = follow_files(spark, re.sub("^file:(//)?", "", path))
        write_visible(visible_lines(followed, filter_set(("Exclude", "INFO"))), out, mark, once=True).awaitTermination()
    shown, sizes = spark.read.parquet(out), read_lines(spark, path, number=False, by_name=True).groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    named = shown.select("raw", "line_idx", F.substring_index("src", "/", -1).alias("src"))
    return named.join(sizes, "src").select("raw", F.col("line_idx").between(0, F.col("n") - 1).alias("in_order"))


@query(f"{_E} SELECT 'pipe ' || line_idx // 100 AS src, line_idx % 100 AS line_idx, lvl || ':app.' || event_type || ':' || {_PAID} AS raw FROM d")
def stream_cut_lines(spark, sf_dir):
    """Pipes of 100 lines that come as records of 37 characters, over two runs of a stream that goes on from its checkpoint; the last lines end with the pipes."""
    path, out, mark = new_folder(spark, "cut"), new_folder(spark, "cut-out"), new_folder(spark, "cut-mark")
    pipes = _lines(spark, sf_dir, "python_basic").groupBy(F.floor(F.col("line_idx") / 100).alias("k")).agg(F.array_sort(F.collect_list(F.struct("line_idx", "raw"))).alias("l"))
    pipes = pipes.select(F.concat(F.lit("pipe "), F.col("k").cast("string")).alias("src"), F.array_join(F.transform("l", lambda x: x["raw"]), "\r\n").alias("text"))
    last = F.ceil(F.char_length("text") / 37).cast("int") - 1
    pieces = pipes.select("src", "text", last.alias("end"), F.explode(F.sequence(F.lit(0), last)).alias("n"))
    pieces = pieces.select("src", "n", F.expr("substring(text, n * 37 + 1, 37)").alias("value"), (F.col("n") == F.col("end")).alias("last"))
    for part in (F.col("n") < 50, F.col("n") >= 50):
        pieces.filter(part).write.mode("append").parquet(path)
        lines = whole_lines(spark.readStream.schema(pieces.schema).parquet(path), "n", src="src", end="last")
        write_visible(lines, out, mark, once=True).awaitTermination()
    return spark.read.parquet(out)


def _growing(spark, sf_dir, *parts: str):
    """After each condition on k, a line's number among 500, the path of files of the lines that it holds for (empty ones too): one for each kind of event and 500 events."""
    path, lines = new_folder(spark, "grown"), _lines(spark, sf_dir, "python_basic", ("event_type",))
    lines = lines.withColumn("name", F.concat_ws("-", "event_type", F.floor(F.col("line_idx") / 500).cast("string"))).withColumn("k", F.col("line_idx") % 500)
    for part in parts:
        # a file without such lines is written empty, so that one condition leaves nothing of another's
        text = lines.groupBy("name").agg(F.array_sort(F.collect_list(F.when(F.expr(part), F.struct("line_idx", "raw")))).alias("l"))
        write_files(text.select("name", F.array_join(F.transform("l", lambda x: F.concat(x["raw"], F.lit("\n"))), "").cast("binary").alias("content")), path)
        yield re.sub("^file:(//)?", "", path)


def _name() -> Column:
    return F.substring_index("src", "/", -1).alias("name")


_GROWN = f"""{_E}, l AS (SELECT event_type || '-' || line_idx // 500 AS name, line_idx % 500 AS k, lvl || ':app.' || event_type || ':' || {_PAID} AS raw FROM d)"""


@query(f"{_GROWN} SELECT name, row_number() OVER (PARTITION BY name ORDER BY k) - 1 AS line_idx, raw FROM l")
def follow_large(spark, sf_dir):
    """Files followed in ranges of 4 kB over two runs, in the second of which they have grown by two fifths; their numbers count on."""
    out, mark = new_folder(spark, "grown-out"), new_folder(spark, "grown-mark")
    for path in _growing(spark, sf_dir, "k < 300", "true"):
        write_numbered(follow_ranges(spark, path, piece=4096), out, mark, once=True).awaitTermination()
    return spark.read.parquet(out).select(_name(), "line_idx", "raw")


@query(f"{_GROWN} SELECT name, 0 AS rotation, raw FROM l WHERE k < 300 UNION ALL SELECT name, 1, raw FROM l WHERE k >= 50 AND k < 90")
def follow_rotation(spark, sf_dir):
    """Files that shrink and grow again: what they shrink to isn't read, what they grow by is, one rotation on."""
    out, mark = new_folder(spark, "turned-out"), new_folder(spark, "turned-mark")
    for path in _growing(spark, sf_dir, "k < 300", "k < 50", "k < 90"):
        write_visible(follow_ranges(spark, path, piece=4096), out, mark, once=True).awaitTermination()
    return spark.read.parquet(out).select(_name(), "rotation", "raw")


@query(f"{_GROWN} SELECT name, raw FROM l QUALIFY row_number() OVER (PARTITION BY name ORDER BY k DESC) <= 20")
def stream_latest(spark, sf_dir):
    """The last 20 lines of each growing file, as a version of each batch."""
    mark = new_folder(spark, "latest-mark")
    for path in _growing(spark, sf_dir, "k < 300", "true"):
        lines = follow_ranges(spark, path).select("src", F.col("at").alias("line_idx"), "raw")
        latest_lines(lines, "latest_of_growing", mark, n=20, once=True).awaitTermination()
    return Versions(spark, mark + "-latest").latest().select(_name(), "raw")


@query(f"{_GROWN} SELECT DISTINCT name, 'common' AS format FROM l WHERE name NOT LIKE 'error-%' UNION ALL SELECT DISTINCT name, 'logfmt' FROM l WHERE name LIKE 'error-%'")
def stream_formats(spark, sf_dir):
    """Formats of sources as their lines come; some sources begin with lines of no format."""
    mark = new_folder(spark, "formats-mark")
    for turn, path in enumerate(_growing(spark, sf_dir, "k < 300", "true")):
        plain = F.lit(turn == 0) & F.contains("src", F.lit("view-"))
        raw = F.when(plain, F.lit("nothing to parse")).when(F.contains("src", F.lit("error-")), F.concat(F.lit('time=2024-01-01T00:00:00Z level=error caller=app msg="'), "raw", F.lit('"'))).otherwise(F.col("raw"))
        lines = follow_ranges(spark, path).select("src", F.col("at").alias("line_idx"), raw.alias("raw"))
        detect_as_it_comes(lines, "formats_of_growing", mark, once=True).awaitTermination()
    return Versions(spark, mark + "-formats").latest().select(_name(), "format")


@query(f"""{_E} SELECT line_idx, 'INFO' AS level, 'APP1' AS target,
user_id || ' ' || -cents || ' ' || CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END || ' ' || event_type || ' 1.5' AS message FROM d""")
def dlt_stream(spark, sf_dir):
    """Binary messages decoded as they come."""
    stream = _streamed(_dlt_files(spark, sf_dir), "binary")
    lines = with_parts(decode_messages(frame_messages(stream)), "dlt")
    return _drain(lines.select(F.col("src").cast("long").alias("line_idx"), "parts.level", "parts.target", "parts.message"), "binary-out")


# ---- switches and rules


@query(f"{_E} SELECT line_idx, event_type <> 'click' AS one_off, true AS all_off, true AS switched_off FROM d")
def filter_switches(spark, sf_dir):
    raw, none = F.col("raw"), F.lit(None).cast("struct<timestamp:string>")
    some = [FilterDef(0, "view", "Exclude", enabled=False), FilterDef(1, "click", "Exclude")]
    return _lines(spark, sf_dir, "json").select(
        "line_idx", visible(raw, none, some).alias("one_off"), visible(raw, none, some[:1]).alias("all_off"), visible(raw, none, some, on=False).alias("switched_off")
    )


@query(f"{_E} SELECT line_idx FROM d WHERE user_id % 3 > 0 OR strftime(ts, '%m-%d') = '01-03'")
def date_pass_through(spark, sf_dir):
    """Stamps that can't be read and lines without parts pass date filters."""
    e, third = _events(spark, sf_dir), F.col("user_id") % 3
    raw = F.when(third == 0, _text(DIALECTS["json"])).when(third == 1, _text('{{"timestamp":"soon","level":"{lvl}","msg":"x"}}')).otherwise(_text("user {user_id} plain"))
    return visible_lines(with_parts(e.select("src", "line_idx", raw.alias("raw")), "json"), filter_set(("Include", DATE + "Jan 3"))).select("line_idx")


@query(f"{_E} SELECT line_idx FROM d WHERE event_type = 'view'")
def raw_mode(spark, sf_dir):
    """Without parts only text filters decide."""
    filters = filter_set(("Include", "did view"), ("Exclude", FIELD + "level:INFO"), ("Include", FIELD + "level:ERROR"), ("Include", DATE + "Jan 3"))
    return visible_lines(_lines(spark, sf_dir, "json"), filters).select("line_idx")


@query(f"{_E} SELECT line_idx FROM d WHERE CASE event_type WHEN 'view' THEN regexp_matches(user_id::VARCHAR, '^[1-4]') WHEN 'error' THEN NOT contains(user_id::VARCHAR, '5') ELSE true END")
def visible_by_source(spark, sf_dir):
    """Each source has filters of its own; a source without any shows whole."""
    lines = _events(spark, sf_dir).select(F.col("event_type").alias("src"), "line_idx", _text("user {user_id}").alias("raw"))
    return visible_lines(lines, {"view": filter_set(("Include", "user [1-4]")), "error": filter_set(("Exclude", "5"))}).select("line_idx")


#: A word for each remainder of an id, and what it stands for.
_WORDS = (("Warning", "WARN"), ("err", "ERROR"), ("CRITICAL", "FATAL"), ("dbg", "DEBUG"), ("trc", "TRACE"), ("Inf", "INFO"), ("notice", "NOTICE"), ("verbose", "UNKNOWN"))


@query(f"{_E} SELECT line_idx, CASE user_id % 8 " + " ".join(f"WHEN {i} THEN '{name}'" for i, (_, name) in enumerate(_WORDS)) + " END AS level FROM d")
def level_names(spark, sf_dir):
    word = F.get(F.array(*[F.lit(w) for w, _ in _WORDS]), (F.col("user_id") % 8).cast("int"))
    return _events(spark, sf_dir).select("line_idx", level_name(word).alias("level"))


#: Words with a level keyword inside, and what the scan finds.
_SCANNED = (("retrace", "TRACE"), ("Debugger", "DEBUG"), ("information", "INFO"), ("noticed", "NOTICE"), ("WARNED", "WARN"), ("errors", "ERROR"), ("critic", "FATAL"), ("alerted", "FATAL"), ("none", None))


@query(f"""{_L}, w AS (SELECT doc_id, line_idx, CASE (doc_id + line_idx) % 9 {" ".join(f"WHEN {i} THEN '{level}'" for i, (_, level) in enumerate(_SCANNED) if level)} END AS of_word,
  lower(regexp_extract(raw, '(?i)(fatal|crit|emerg|alert|error|warn|notice|info|debug|trace)', 1)) AS k FROM l)
SELECT doc_id, line_idx, CASE WHEN k IN ('fatal', 'crit', 'emerg', 'alert') THEN 'FATAL' WHEN k <> '' THEN upper(k) ELSE of_word END AS level FROM w WHERE k <> '' OR of_word IS NOT NULL""")
def level_scan_words(spark, sf_dir):
    """Keywords inside words of any case, behind whole lines of text."""
    word = F.get(F.array(*[F.lit(w) for w, _ in _SCANNED]), ((F.col("doc_id") + F.col("line_idx")) % 9).cast("int"))
    lines = _doc_lines(spark, sf_dir).withColumn("raw", F.concat_ws(" ", "raw", word))
    return lines.select("doc_id", "line_idx", scan_level(F.col("raw")).alias("level")).filter("level IS NOT NULL")


@query(f"""{_E}, x AS (SELECT line_idx, '10.0.0.1 - user' || user_id || ' [10/Jan/2024:13:55:36 +0000] "GET /' || event_type || '/' || line_idx || ' HTTP/1.1" ' AS x FROM d)
SELECT line_idx, 'status_' || line_idx // 100 || 'xx' AS tag, length(x) + 4 AS s, length(x) + 7 AS e FROM x WHERE line_idx BETWEEN 300 AND 599""")
def value_classes_off(spark, sf_dir):
    """Classes switched off by key."""
    return _value_rows(_lines(spark, sf_dir, "clf"), ("http_get", "ip_address", "status_2xx"))


@query(f"""{_E} SELECT 'level' AS name, lvl AS value, count(*) AS n FROM d GROUP BY lvl UNION ALL SELECT 'target', 'app.' || event_type, count(*) FROM d GROUP BY event_type
UNION ALL SELECT 'user_id', user_id::VARCHAR, count(*) FROM d GROUP BY user_id UNION ALL SELECT 'cents', cents::VARCHAR, count(*) FROM d GROUP BY cents""")
def field_values(spark, sf_dir):
    return profile.field_values(_parsed(spark, sf_dir, "json"), "json").select("name", "value", "n")

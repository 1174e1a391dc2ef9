import pytest
from pyspark.sql import functions as F

from sparklines.formats import formats, parse, register_format
from sparklines.model import make_parts
from sparklines.operators.detect import detect_formats, with_parts

CASES = [
    ("json", '{"level":"INFO","msg":"hello"}', (None, "INFO", None, None, [], "hello")),
    ("json", '{"level":"INFO","span":{"name":"request","method":"GET","uri":"/todos"},"fields":{"message":"ok"}}', (None, "INFO", None, ("request", [("method", "GET"), ("uri", "/todos")]), [], "ok")),
    ("json", '{"__REALTIME_TIMESTAMP":"1699999999000000","PRIORITY":"6","_HOSTNAME":"myhost","SYSLOG_IDENTIFIER":"sshd","MESSAGE":"Accepted password for user"}', ("1699999999000000", "6", "sshd", None, [("_HOSTNAME", "myhost")], "Accepted password for user")),
    ("json", '{"ts":"a","time":"b","x":1,"x2":null,"msg":"m","text":"n","spans":[1]}', ("a", None, None, None, [("x", "1"), ("x2", "null")], "m")),
    ("otlp", '{"timeUnixNano":"1700046000000000000","severityNumber":9,"body":{"stringValue":"done"},"attributes":[{"key":"http.method","value":{"stringValue":"GET"}},{"key":"service.name","value":{"stringValue":"my-svc"}}],"traceId":"abc","spanId":"def"}', ("1700046000000000000", "INFO", "my-svc", None, [("http.method", "GET"), ("traceId", "abc"), ("spanId", "def")], "done")),
    ("otlp", '{"timestamp":"2024-01-15T10:00:00Z","severity_text":"INFO","severity_number":9,"body":"user logged in","attributes":{"user.id":"u123","service.name":"auth-svc"},"trace_id":"abc","span_id":"def"}', ("2024-01-15T10:00:00Z", "INFO", "auth-svc", None, [("user.id", "u123"), ("traceId", "abc"), ("spanId", "def")], "user logged in")),
    ("otlp", '{"resource":{"attributes":{"service.name":"r"}},"attributes":{"logger":"l"},"observedTimeUnixNano":"5","severityText":""}', ("5", None, "r", None, [("logger", "l")], None)),
    ("syslog", "<134>Oct 11 22:14:15 myhost sshd[1234]: Accepted password for user", ("Oct 11 22:14:15", "INFO", "sshd", None, [("hostname", "myhost"), ("pid", "1234"), ("facility", "local0")], "Accepted password for user")),
    ("syslog", '<165>1 2003-10-11T22:14:15.003Z host app - ID47 [a@1 iut="3" src="A]\\"b"][b x="y"] text', ("2003-10-11T22:14:15.003Z", "INFO", "app", None, [("hostname", "host"), ("facility", "local4"), ("msgid", "ID47"), ("iut", "3"), ("src", 'A]\\"b'), ("x", "y")], "text")),
    ("syslog", "Jun 28 10:00:03 myhost kernel: Linux", ("Jun 28 10:00:03", None, "kernel", None, [("hostname", "myhost")], "Linux")),
    ("journalctl", "2024-02-22T10:15:30+0000 myhost sshd[1234]: Accepted", ("2024-02-22T10:15:30+0000", None, "sshd", None, [("hostname", "myhost"), ("pid", "1234")], "Accepted")),
    ("journalctl", "Feb 22 10:15:30.123456 myhost sshd[5678]: Connection closed", ("Feb 22 10:15:30.123456", None, "sshd", None, [("hostname", "myhost"), ("pid", "5678")], "Connection closed")),
    ("journalctl", "Mon 2024-02-22 10:15:30 UTC myhost sshd[1234]: Accepted key", ("Mon 2024-02-22 10:15:30 UTC", None, "sshd", None, [("hostname", "myhost"), ("pid", "1234")], "Accepted key")),
    ("clf", '127.0.0.1 - frank [10/Oct/2000:13:55:36 -0700] "GET /a \\"b HTTP/1.0" 200 2326', ("10/Oct/2000:13:55:36 -0700", None, "127.0.0.1", None, [("authuser", "frank"), ("status", "200"), ("bytes", "2326")], 'GET /a \\"b HTTP/1.0')),
    ("clf", '127.0.0.1 - - [10/Oct/2000:13:55:36 -0700] "GET / HTTP/1.0" - - "http://x" "Moz [en]"', ("10/Oct/2000:13:55:36 -0700", None, "127.0.0.1", None, [("status", "-"), ("referer", "http://x"), ("user_agent", "Moz [en]")], "GET / HTTP/1.0")),
    ("logfmt", 'time=2024-01-01T00:00:00Z level=info msg="request \\"handled" Level=x status=200 end', ("2024-01-01T00:00:00Z", "INFO", None, None, [("Level", "x"), ("status", "200")], 'request \\"handled')),
    ("common", "[2024-07-24T10:00:00Z INFO  myapp] Starting server", ("2024-07-24T10:00:00Z", "INFO", "myapp", None, [], "Starting server")),
    ("common", "2024-07-24 10:00:00.123 [main] INFO  com.example.App - Application started", ("2024-07-24 10:00:00.123", "INFO", "com.example.App", None, [("thread", "main")], "Application started")),
    ("common", "2024-07-24 10:00:00.123  INFO 12345 --- [           main] c.e.MyApp : Started MyApp", ("2024-07-24 10:00:00.123", "INFO", "c.e.MyApp", None, [("pid", "12345"), ("thread", "main")], "Started MyApp")),
    ("common", "WARNING:django.server:Not Found: /favicon.ico", (None, "WARN", "django.server", None, [], "Not Found: /favicon.ico")),
    ("common", "2024-07-24 10:00:00.123 | INFO     | myapp.main - Starting application", ("2024-07-24 10:00:00.123", "INFO", "myapp.main", None, [], "Starting application")),
    ("common", "2024-07-24 10:00:00 [info     ] request handled              key=val", ("2024-07-24 10:00:00", "INFO", None, None, [], "request handled              key=val")),
    ("common", "2024-07-24T10:00:00Z WARN myapp: disk space low", ("2024-07-24T10:00:00Z", "WARN", "myapp", None, [], "disk space low")),
    ("common", '2024-07-24T10:00:00Z  INFO request{method=GET uri="/a b"}: app::web: done', ("2024-07-24T10:00:00Z", "INFO", "app::web", ("request", [("method", "GET"), ("uri", "/a b")]), [], "done")),
    ("dlt", "2024/01/15 10:30:45.123456 1234567 000 ECU1 ---- CTX1 log verbose verbose 1 Message text", ("2024/01/15 10:30:45.123456", "TRACE", None, None, [("hw_ts", "1234567"), ("mcnt", "000"), ("ecu", "ECU1"), ("ctid", "CTX1"), ("type", "log"), ("subtype", "verbose"), ("mode", "verbose")], "Message text")),
]

REFUSED = [
    ("json", "plain text log line"), ("json", "{}"), ("json", ' {"a":1}'), ("json", ""), ("otlp", '{"a":1}'), ("syslog", "<>x"), ("syslog", "<1234>Oct 11 22:14:15 a b: c"),
    ("journalctl", "-- No entries --"), ("journalctl", "2024-02-22T10:15:30Z INFO app: x"), ("clf", '127.0.0.1 - a [10/Oct/2000:13:55:36 -0700] "GET /" abc 1'),
    ("clf", '127.0.0.1 - a [10/Oct/2000:13:55:36 -0700 "GET /" 200 1'), ("logfmt", "key=value"), ("common", "plain text log line"), ("dlt", "2024/01/15 10:30:45"),
]


def flat(p):
    kv = lambda x: [tuple(i) for i in x]
    return None if p is None else (p.timestamp, p.level, p.target, p.span and (p.span.name, kv(p.span.fields)), kv(p.extra), p.message)


def parsed(spark, format, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "i int, raw string")
    return [flat(r.p) for r in df.select("i", parse(F.col("raw"), format).alias("p")).orderBy("i").collect()]


@pytest.mark.parametrize("format", sorted({c[0] for c in CASES}))
def test_lines(spark, format):
    own = [c for c in CASES if c[0] == format]
    assert parsed(spark, format, [c[1] for c in own]) == [c[2] for c in own]
    refused = [line for f, line in REFUSED if f == format]
    assert parsed(spark, format, refused) == [None] * len(refused)


def test_bytes_that_are_no_text_do_not_parse(spark):
    raw = F.expr("cast(x'7b2261223a22ff227d' as string)")
    assert spark.range(1).select(parse(raw, "json").isNull().alias("n")).first().n


def test_long_quoted_value(spark):
    (p,) = parsed(spark, "logfmt", ['a=1 b=2 c="' + 'x\\"' * 200_000 + '"'])
    assert len(p[4][2][1]) == 600_000


def test_detection_prefers_the_specific_format(spark):
    rows = [(f, i, line) for f, line, _ in CASES for i in [0] if f != "common"]
    first = {}
    for f, _, line in rows:
        first.setdefault(f, line)
    rows = [(f, i, line) for f, line in first.items() for i in range(3)] + [("none", 0, "no format here"), ("blank", 0, "")]
    rows += [("bsd", 0, "Feb 22 10:15:30.123456 myhost sshd[5678]: x")]
    found = {r.src: r.format for r in detect_formats(spark.createDataFrame(rows, "src string, line_idx long, raw string")).collect()}
    assert found == {f: f for f in first} | {"none": "plain", "blank": "plain", "bsd": "journalctl"}


def test_a_table_of_formats_parses_each_source_by_its_own(spark):
    lines = spark.createDataFrame([("a", 0, '{"msg":"x"}'), ("b", 0, "INFO:t:y"), ("c", 0, "z")], "src string, line_idx long, raw string")
    got = with_parts(lines, detect_formats(lines)).orderBy("src").select("parts.message").collect()
    assert [r.message for r in got] == ["x", "y", None]


def test_registry_takes_new_formats(spark):
    register_format("bang", lambda raw: F.when(F.startswith(raw, F.lit("!")), make_parts(message=F.substring(raw, 2, 100))), 3.0)
    try:
        lines = spark.createDataFrame([("a", 0, "!hi")], "src string, line_idx long, raw string")
        assert detect_formats(lines).first().format == "bang"
        assert with_parts(lines, "bang").first().parts.message == "hi"
    finally:
        import sparklines.formats as registry

        registry._FORMATS.pop("bang")
    assert len(formats()) == 8

"""OpenTelemetry records in JSON, as exported by collectors or printed by SDKs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparklines.formats.json import entries_of
from sparklines.functions.levels import severity_number
from sparklines.model import KV, blank, let, make_parts

#: Key names of the record.
SEVERITY_TEXT = ("severityText", "severity_text", "SeverityText")
SEVERITY_NUMBER = ("severityNumber", "severity_number", "Severity")
OTHER_TIMES = ("timestamp", "Timestamp", "observedTimeUnixNano", "observed_timestamp")
TARGETS = ("service.name", "code.namespace", "logger", "component", "module")
TRACE, SPAN_ID = ("traceId", "trace_id", "TraceID"), ("spanId", "span_id", "SpanID")
DROPPED = ("flags", "traceFlags", "trace_flags", "TraceFlags", "droppedAttributesCount", "InstrumentationScope", "schemaUrl")
VALUE_KINDS = ("stringValue", "intValue", "doubleValue", "boolValue", "Value")


def _get(entries: Column, keys: tuple[str, ...]) -> Column:
    return F.get(F.filter(entries, lambda e: e["k"].isin(*keys)), F.lit(0))["v"]


def _any_value(text: Column) -> Column:
    return let(F.from_json(text, "map<string,string>"), lambda m: F.coalesce(*[F.try_element_at(m, F.lit(k)) for k in VALUE_KINDS]))


def _attributes(text: Column) -> Column:
    """Key/value pairs of an attribute list or dictionary."""
    listed = F.from_json(text, "array<map<string,string>>")
    item = lambda o: F.struct(
        F.coalesce(F.try_element_at(o, F.lit("key")), F.try_element_at(o, F.lit("Key"))).alias("k"),
        _any_value(F.coalesce(F.try_element_at(o, F.lit("value")), F.try_element_at(o, F.lit("Value")))).alias("v"),
    )
    of_list = F.filter(F.transform(listed, item), lambda x: x["k"].isNotNull() & x["v"].isNotNull())
    of_dict = F.transform(entries_of(text, True), lambda e: F.struct(e["k"].alias("k"), e["v"].alias("v")))
    return F.coalesce(F.when(F.startswith(text, F.lit("[")), of_list).otherwise(of_dict), F.array().cast(KV))


def is_record(entries: Column) -> Column:
    has = lambda *keys: F.exists(entries, lambda e: e["k"].isin(*keys))
    return has("timeUnixNano", "observedTimeUnixNano") | (has(*SEVERITY_TEXT, *SEVERITY_NUMBER) & has("body", "Body"))


def parse(raw: Column) -> Column:
    def build(e: Column) -> Column:
        time = F.coalesce(_get(e, ("timeUnixNano",)), _get(e, OTHER_TIMES))
        text = F.get(F.filter(e, lambda x: x["k"].isin(*SEVERITY_TEXT) & (x["v"] != "")), F.lit(0))["v"]
        bodies = F.filter(e, lambda x: x["k"].isin("body", "Body"))
        body = F.filter(F.transform(bodies, lambda x: F.when(F.startswith(x["v"], F.lit("{")), _any_value(x["v"])).otherwise(x["v"])), lambda v: v.isNotNull())
        return let(F.struct(e.alias("e"), _spread(e).alias("a")), lambda s: _record(s["e"], s["a"], time, F.coalesce(text, severity_number(_get(e, SEVERITY_NUMBER))), F.get(body, F.lit(0))))

    return let(entries_of(raw, True), lambda e: F.when(e.isNotNull() & is_record(e), build(e)))


def _spread(e: Column) -> Column:
    """Pairs of the line in order with where they come from: a(ttributes), r(esource), t(op)."""

    def one(x: Column) -> Column:
        tagged = lambda kv, src: F.transform(kv, lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v"), F.lit(src).alias("src")))
        resource = _attributes(_get(entries_of(x["v"], True), ("attributes",)))
        name = F.when(x["k"].isin(*TRACE), F.lit("traceId")).when(x["k"].isin(*SPAN_ID), F.lit("spanId")).otherwise(x["k"])
        plain = F.array(F.struct(name.alias("k"), x["v"].alias("v"), F.lit("t").alias("src")))
        taken = ("timeUnixNano", *OTHER_TIMES, *SEVERITY_TEXT, *SEVERITY_NUMBER, "body", "Body", *DROPPED)
        return (
            F.when(x["k"].isin("attributes", "Attributes"), tagged(_attributes(x["v"]), "a"))
            .when(x["k"].isin("resource", "Resource"), F.filter(tagged(resource, "r"), lambda p: p["k"] == "service.name"))
            .when(x["k"].isin(*taken), F.slice(plain, 1, 0))
            .otherwise(plain)
        )

    return F.flatten(F.transform(e, one))


def _record(e: Column, every: Column, time: Column, level: Column, body: Column) -> Column:
    aims = F.transform(every, lambda p: (p["src"] == "r") | ((p["src"] == "a") & p["k"].isin(*TARGETS)))
    at = F.array_position(aims, True).cast("int") - 1
    extra = F.filter(every, lambda p, i: (p["src"] != "r") & (i != at))
    kv = F.transform(extra, lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v")))
    return make_parts(time, level, F.when(at >= 0, F.get(every, at)["v"]), None, kv, body)

"""Syslog in its two forms, and the tag that they share with the journal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparklines.functions.levels import syslog_facility, syslog_severity
from sparklines.functions.timestamps import BSD
from sparklines.model import blank, groups, let, make_parts, pair, pairs

SD = r'^((?:\[(?:[^"\]]++|"(?:[^"\\]++|\\.)*+"?)*+\] *+)*+)'
PARAM = r'([^ =\[\]"]+)="((?:[^"\\]++|\\.)*+)"'
RFC5424 = r"<([0-9]{1,3})>([0-9][^ ]*+) ([^ ]*+) ([^ ]*+) ([^ ]*+) ([^ ]*+) (?=.)([^ ]*+)(?: (.*))?"
RFC3164 = rf"(?:<([0-9]{{1,3}})>)?({BSD}) ?(.*)"


def tag_and_message(rest: Column) -> Column:
    """struct<target, pid, message> of `unit[pid]: message`; without a colon all is message."""
    spaced, bare = F.locate(": ", rest), F.locate(":", rest)
    at = F.when(spaced > 0, spaced).otherwise(bare)

    def body(x: Column) -> Column:
        tag = F.when(x["at"] > 0, F.substring(x["r"], F.lit(1), x["at"] - 1))
        tail = F.substring(x["r"], x["at"] + 1, F.length(x["r"]))
        message = F.when(x["at"] == 0, x["r"]).when(x["sp"] > 0, F.substring(tail, F.lit(2), F.length(tail))).otherwise(F.ltrim(tail))
        pid = F.when(F.rlike(tag, F.lit(r"^[^\[]*\[[^\]]*\]")), F.regexp_extract(tag, r"^[^\[]*\[([^\]]*)\]", 1))
        return F.struct(F.substring_index(tag, "[", 1).alias("target"), pid.alias("pid"), blank(message).alias("message"))

    return let(F.struct(rest.alias("r"), at.alias("at"), spaced.alias("sp")), body)


def _present(c: Column) -> Column:
    return F.when(c != "-", c)


def _params(sd: Column) -> Column:
    inside = F.regexp_replace(sd, r"\[[^ \]\"]*+", "")
    keys, values = F.regexp_extract_all(inside, F.lit(PARAM), F.lit(1)), F.regexp_extract_all(inside, F.lit(PARAM), F.lit(2))
    return F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), v.alias("v")))


def parse(raw: Column) -> Column:
    def new(g: Column) -> Column:
        pri, rest = g[0].cast("int"), F.ltrim(g[7])
        sd = F.when(F.startswith(rest, F.lit("[")), F.regexp_extract(rest, SD, 1)).when(F.startswith(rest, F.lit("-")), F.regexp_extract(rest, "^(- ?)", 1)).otherwise(F.lit(""))

        def build(x: Column) -> Column:
            message = F.ltrim(F.substring(x["rest"], F.length(x["sd"]) + 1, F.length(x["rest"])))
            head = pairs(pair("hostname", _present(g[3])), pair("pid", _present(g[5])), pair("facility", syslog_facility(pri)), pair("msgid", _present(g[6])))
            return make_parts(_present(g[2]), syslog_severity(pri), _present(g[4]), None, F.concat(head, _params(x["sd"])), blank(F.regexp_replace(message, "^﻿", "")))

        return F.when(pri <= 255, let(F.struct(rest.alias("rest"), sd.alias("sd")), build))

    def old(g: Column) -> Column:
        pri = blank(g[0]).cast("int")
        rest = F.regexp_extract(g[2], "^[^ ]* (.*)$", 1)
        level = F.when(pri.isNotNull(), syslog_severity(pri))
        facility = F.when(rest != "", syslog_facility(pri))
        host = F.when(g[2] != "", F.substring_index(g[2], " ", 1))
        t = tag_and_message(rest)
        return F.when(
            pri.isNull() | (pri <= 255),
            let(t, lambda x: F.when(rest != "", make_parts(g[1], level, x["target"], None, pairs(pair("hostname", host), pair("pid", x["pid"]), pair("facility", facility)), x["message"])).otherwise(make_parts(g[1], level, None, None, pairs(pair("hostname", host))))),
        )

    return F.coalesce(let(groups(raw, RFC5424, 8), lambda g: F.when(g.isNotNull(), new(g))), let(groups(raw, RFC3164, 3), lambda g: F.when(g.isNotNull(), old(g))))

"""Text form of AUTOSAR diagnostic logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparklines.model import blank, groups, let, make_parts, pair, pairs

STAMP = r"[0-9]{4}/[0-9]{2}/[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{6}"
LINE = rf"({STAMP})\s*+(\S*)\s(\S*)\s(\S*)\s(\S*)\s(\S*)\s(log|trace|network|control)\s(\S*)\s(\S*)\s(\S*)(?:\s(.*))?"
#: Level of a log message's subtype.
SUBTYPES = {"fatal": "FATAL", "error": "ERROR", "warn": "WARN", "info": "INFO", "debug": "DEBUG", "verbose": "TRACE"}


def parse(raw: Column) -> Column:
    def build(g: Column) -> Column:
        level = F.try_element_at(F.create_map(*[F.lit(x) for kv in SUBTYPES.items() for x in kv]), g[7])
        shown = lambda i, *absent: F.when(~g[i].isin("----", *absent), g[i])
        extra = pairs(
            pair("hw_ts", shown(1, "0")), pair("mcnt", F.when(g[2] != "---", g[2])), pair("ecu", shown(3)), pair("ctid", shown(5)),
            pair("type", g[6]), pair("subtype", g[7]), pair("mode", shown(8)),
        )
        return make_parts(g[0], F.when(g[6] == "log", level), shown(4), None, extra, blank(g[10]))

    return let(groups(raw, LINE, 11), lambda g: F.when(g.isNotNull(), build(g)))

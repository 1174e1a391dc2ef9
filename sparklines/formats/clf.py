"""Access logs of web servers, common and combined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparklines.functions.timestamps import HMS, MONTH
from sparklines.model import groups, let, make_parts, pair, pairs

QUOTED = r'"((?:[^"\\]++|\\.)*+)"'
DATE = rf"[0-9]{{2}}/{MONTH}/[0-9]{{4}}:{HMS} [+-][0-9]{{4}}[^\]]*"
LINE = rf" *+([^ ]+) +([^ ]+) +([^ ]+) *+\[({DATE})\] *+{QUOTED} *+(-|[0-9]{{3}}) +([^ ]+)(?: *+{QUOTED}(?: *+{QUOTED})?)?.*"


def parse(raw: Column) -> Column:
    def build(g: Column) -> Column:
        shown = lambda i: F.when(~g[i].isin("-", ""), g[i])
        extra = pairs(
            pair("ident", shown(1)), pair("authuser", shown(2)), pair("status", g[5]), pair("bytes", shown(6)),
            pair("referer", shown(7)), pair("user_agent", shown(8)),
        )
        return make_parts(g[3], None, g[0], None, extra, g[4])

    return let(groups(raw, LINE, 9), lambda g: F.when(g.isNotNull(), build(g)))

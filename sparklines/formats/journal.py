"""Text output of the systemd journal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparklines.formats.syslog import tag_and_message
from sparklines.functions.levels import LEVEL
from sparklines.functions.timestamps import BSD_PRECISE, FULL, ISO
from sparklines.model import groups, let, make_parts, pair, pairs

#: A host isn't a level word, has no "::" and isn't a short run of capitals and digits.
HOST = rf"(?!{LEVEL} )(?![A-Z0-9]{{1,8}} )(?![^ ]*::)[^ ]+"
LINE = rf"(?!-- )(?=.{{16}})((?=.{{27}}){FULL}|(?=.{{19}}){ISO}|{BSD_PRECISE}) ({HOST}) (.*)"


def parse(raw: Column) -> Column:
    def build(g: Column) -> Column:
        return let(
            tag_and_message(g[2]),
            lambda x: F.when(g[2] == "", make_parts(g[0], extra=pairs(pair("hostname", g[1])))).otherwise(
                make_parts(g[0], None, x["target"], None, pairs(pair("hostname", g[1]), pair("pid", x["pid"])), x["message"])
            ),
        )

    return let(groups(raw, LINE, 3), lambda g: F.when(g.isNotNull(), build(g)))

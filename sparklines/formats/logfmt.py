"""key=value lines: the leading run of at least three pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparklines.functions.levels import normalize_level
from sparklines.model import KV, let, make_parts

#: The keys of each slot's group, compared in lower case.
KEYS = {
    "timestamp": ("time", "timestamp", "ts", "datetime"), "level": ("level", "lvl", "severity"),
    "message": ("msg", "message"), "target": ("source", "caller", "logger", "component", "module"),
}
_VALUE = r'(?:"((?:[^"\\]++|\\.)*+)"?|([^ ]*+))'
_PAIR = rf" *+([^ =]++)={_VALUE}"
_RUN = rf"^((?: *+[^ =]++=(?:\"(?:[^\"\\]++|\\.)*+\"?|[^ ]*+))*+)"


def leading_pairs(raw: Column) -> Column:
    """The run's pairs in order."""

    def split(run: Column) -> Column:
        all_of = lambda i: F.regexp_extract_all(run, F.lit(_PAIR), F.lit(i))
        values = F.zip_with(all_of(2), all_of(3), lambda quoted, bare: F.concat(quoted, bare))
        return F.zip_with(all_of(1), values, lambda k, v: F.struct(k.alias("k"), v.alias("v"))).cast(KV)

    run = F.when(F.contains(raw, F.lit("=")) & ~F.startswith(raw, F.lit("{")), F.regexp_extract(raw, _RUN, 1))
    return let(run, split)


def _at(keys: Column, names: tuple[str, ...]) -> Column:
    """Place of the first key of a group, -1 if none."""
    return (F.array_position(F.transform(keys, lambda k: k.isin(*names)), True) - 1).cast("int")


def parse(raw: Column) -> Column:
    def build(kv: Column) -> Column:
        keys = F.transform(kv, lambda p: F.lower(p["k"]))
        places = F.struct(*[_at(keys, names).alias(slot) for slot, names in KEYS.items()])

        def slots(at: Column) -> Column:
            value = lambda slot: F.when(at[slot] >= 0, F.get(kv, at[slot])["v"])
            extra = F.filter(kv, lambda p, i: ~i.isin(*[at[s] for s in KEYS]))
            return make_parts(value("timestamp"), F.coalesce(normalize_level(value("level")), value("level")), value("target"), None, extra, value("message"))

        return let(places, slots)

    return let(leading_pairs(raw), lambda kv: F.when(F.size(kv) >= 3, build(kv)))


def known_key(parts: Column) -> Column:
    """Whether the line has a key of any group."""
    return parts["timestamp"].isNotNull() | parts["level"].isNotNull() | parts["target"].isNotNull() | parts["message"].isNotNull()

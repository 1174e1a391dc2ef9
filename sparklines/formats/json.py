"""JSON lines: the first key of each slot's group, in the line's order, fills the slot; the rest are extras."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparklines.model import KV, LEVEL_KEYS, MESSAGE_KEYS, TARGET_KEYS, TIMESTAMP_KEYS, let, make_parts

ENTRIES = "array<struct<k:string,v:string,top:boolean>>"


def entries_of(text: Column, top: bool) -> Column:
    """Keys of a JSON object in order with their values as text; NULL if it isn't one."""
    values = F.map_entries(F.when(F.startswith(text, F.lit("{")), F.from_json(text, "map<string,string>")))
    return let(
        values,
        lambda b: F.when(F.size(b) > 0, F.transform(b, lambda e: F.struct(e["key"].alias("k"), F.coalesce(e["value"], F.lit("null")).alias("v"), F.lit(top).alias("top")))),
    )


def _is_object(e: Column, key: str) -> Column:
    return (e["k"] == key) & F.startswith(e["v"], F.lit("{"))


def _first(entries: Column, keys: tuple[str, ...], within: bool = False) -> Column:
    hit = F.filter(entries, lambda e: e["k"].isin(*keys) & (e["top"] | F.lit(within)))
    return F.get(hit, F.lit(0))["v"]


def parse(raw: Column) -> Column:
    """parts of a JSON line; NULL if it isn't an object with a key."""

    def spread(entries: Column) -> Column:
        inner = lambda e: F.coalesce(entries_of(e["v"], False), F.array().cast(ENTRIES))
        return F.flatten(F.transform(entries, lambda e: F.when(_is_object(e, "fields"), inner(e)).otherwise(F.array(e))))

    def build(every: Column) -> Column:
        slots = (*TIMESTAMP_KEYS, *LEVEL_KEYS, *TARGET_KEYS, "spans")
        span_text = F.get(F.filter(every, lambda e: e["top"] & _is_object(e, "span")), F.lit(0))["v"]
        span = let(
            entries_of(span_text, True),
            lambda s: F.when(
                s.isNotNull(),
                F.struct(
                    F.coalesce(F.get(F.filter(s, lambda e: e["k"] == "name"), F.lit(0))["v"], F.lit("")).alias("name"),
                    _kv(F.filter(s, lambda e: e["k"] != "name")).alias("fields"),
                ),
            ),
        )
        extra = F.filter(every, lambda e: ~e["k"].isin(*MESSAGE_KEYS) & ~(e["top"] & (e["k"].isin(*slots) | _is_object(e, "span"))))
        return make_parts(
            _first(every, TIMESTAMP_KEYS), _first(every, LEVEL_KEYS), _first(every, TARGET_KEYS), span, _kv(extra), _first(every, MESSAGE_KEYS, True)
        )

    return let(entries_of(raw, True), lambda top: F.when(top.isNotNull(), let(spread(top), build)))


def _kv(entries: Column) -> Column:
    return F.transform(entries, lambda e: F.struct(e["k"].alias("k"), e["v"].alias("v"))).cast(KV)


# ---- values as they are written

#: Nesting that is followed inside a value, and quotes of a line beyond which Spark reads it.
DEPTH, QUOTES = 10, 2000
_BLANKS = r"[ \t\r\n]*+"
_INSIDE = r'[^"\\]*+(?:\\.[^"\\]*+)*+'


def _nested(left: str, right: str) -> str:
    """A pattern of a value in brackets, up to the bracket that closes it or the line's end; strings in it hide brackets."""
    text, plain = rf'"{_INSIDE}(?:"|\\?\z)', rf'[^{left}{right}"]*+'
    out = "(?!)"
    for _ in range(DEPTH):
        out = rf"{left}{plain}(?:(?:{text}|{out}){plain})*+(?:{right}|\z)"
    return out


def _patterns() -> tuple[str, str]:
    """An entry with key and value as groups, and a line of entries, cut off after a value or not, with those as its group."""
    value = rf'"{_INSIDE}"|{_nested(chr(92) + "{", chr(92) + "}")}|{_nested(chr(92) + "[", chr(92) + "]")}|(?!["{{\[]|\z)[^,}}\] \t\r\n]*+'
    entry = rf'{_BLANKS}"({_INSIDE})"{_BLANKS}:{_BLANKS}({value}){_BLANKS},?'
    whole = entry.replace(f"({_INSIDE})", _INSIDE).replace(f"({value})", f"(?:{value})")
    found = entry.replace('|(?!["{\\[]|\\z)', '|(?!["{\\[])')  # an empty value may end the entries
    return f"(?s){found}", rf"(?s)\A\{{((?:{whole})++){_BLANKS}(?:\}}|\z)"


VERBATIM = "array<struct<k:string,v:string,quoted:boolean>>"


def verbatim_entries(text: Column) -> Column:
    """Keys of a JSON object in order with their values as they are written, strings without their quotes; NULL without an entry.

    Escapes and numbers stay as they are, commas may lack, an object may be cut off after a value or inside a nested one, and what follows it doesn't matter.
    Keys that repeat stay. Of lines with over QUOTES quotes the values are as Spark reads them.
    """
    entry, whole = _patterns()
    body = F.regexp_extract(text, whole, 1)
    pick = lambda b, k: F.regexp_extract_all(b, F.lit(entry), F.lit(k))
    bare = lambda v: F.when(F.startswith(v, F.lit('"')), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    row = lambda k, v: F.struct(k.alias("k"), bare(v).alias("v"), F.startswith(v, F.lit('"')).alias("quoted"))
    few = F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit(""))) <= QUOTES
    read = F.transform(entries_of(text, True), lambda e: F.struct(e["k"].alias("k"), e["v"].alias("v"), (~F.rlike(e["v"], F.lit(r"\A[\[{]"))).alias("quoted")))
    own = let(body, lambda b: F.when(b != "", F.zip_with(pick(b, 1), pick(b, 2), row)))
    return F.when(few, own).otherwise(read).cast(VERBATIM)


def parse_verbatim(raw: Column) -> Column:
    """parts of a JSON line with values as they are written; see verbatim_entries(). An object in `fields` gives its messages and extras, one in `span` the span."""
    nothing = F.array().cast(VERBATIM)
    plain = lambda e, key: (e["k"] == key) & ~e["quoted"]
    kv = lambda entries: F.transform(entries, lambda e: F.struct(e["k"].alias("k"), e["v"].alias("v"))).cast(KV)

    def build(top: Column) -> Column:
        # an object in `fields` stands in its place, so that the first message counts
        inner = lambda e: F.transform(F.coalesce(verbatim_entries(e["v"]), nothing), lambda x: _placed(x, False))
        taken = F.flatten(F.transform(top, lambda e: F.when(plain(e, "fields"), inner(e)).otherwise(F.array(_placed(e, True)))))
        spans = F.filter(top, lambda e: plain(e, "span"))
        span = let(
            F.filter(F.transform(spans, lambda e: verbatim_entries(e["v"])), lambda s: s.isNotNull()),
            lambda all_: let(
                F.try_element_at(all_, F.lit(-1)),
                lambda s: F.when(
                    s.isNotNull(),
                    F.struct(F.coalesce(F.try_element_at(F.filter(s, lambda e: e["k"] == "name"), F.lit(-1))["v"], F.lit("")).alias("name"), kv(F.filter(s, lambda e: e["k"] != "name")).alias("fields")),
                ),
            ),
        )

        def slots(t: Column) -> Column:
            first = lambda keys, inside: F.get(F.filter(t, lambda e: e["k"].isin(*keys) & (e["top"] | F.lit(inside))), F.lit(0))["v"]
            known = lambda e: e["k"].isin(*MESSAGE_KEYS) | (e["top"] & (e["k"].isin(*TIMESTAMP_KEYS, *LEVEL_KEYS, *TARGET_KEYS, "spans") | (e["k"].isin("span") & ~e["quoted"])))
            return make_parts(first(TIMESTAMP_KEYS, False), first(LEVEL_KEYS, False), first(TARGET_KEYS, False), span, kv(F.filter(t, lambda e: ~known(e))), first(MESSAGE_KEYS, True))

        return let(taken, slots)

    return let(verbatim_entries(raw), lambda top: F.when(top.isNotNull(), build(top)))


def _placed(e: Column, top: bool) -> Column:
    return F.struct(e["k"].alias("k"), e["v"].alias("v"), e["quoted"].alias("quoted"), F.lit(top).alias("top"))

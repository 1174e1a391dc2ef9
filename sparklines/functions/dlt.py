"""Decoding one binary diagnostic message to its text line, with column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparklines.model import let

#: Header flags, argument type bits, and names of types and subtypes.
EXTENDED, WITH_ECU, WITH_SESSION, WITH_TIME = 0x01, 0x04, 0x08, 0x10
BOOL, SIGNED, UNSIGNED, FLOAT, STRING, RAW = 0x10, 0x20, 0x40, 0x80, 0x200, 0x400
TYPES = ("log", "trace", "network", "control")
SUBTYPES = (
    ("----", "fatal", "error", "warn", "info", "debug", "verbose"),
    ("----", "variable", "function_in", "function_out", "state", "vfb"),
    ("----", "ipc", "can", "flexray", "most", "ethernet", "someip"),
    ("----", "request", "response"),
)


def _sub(b: Column, at: Column, n) -> Column:
    """n bytes from a 0-based place."""
    return F.substring(b, at + 1, F.lit(n) if isinstance(n, int) else n)


def big(b: Column) -> Column:
    """Up to 7 bytes, most significant first, as a long."""
    return F.conv(F.hex(b), 16, 10).cast("long")


def turned(b: Column, n: int) -> Column:
    """Hex digits of n bytes, last byte first."""
    return F.concat(*[F.hex(F.substring(b, i, 1)) for i in range(n, 0, -1)])


def _little(b: Column, n: int) -> Column:
    return F.conv(turned(b, n), 16, 10).cast("decimal(20,0)")


def _signed(b: Column, n: int) -> Column:
    half, whole = (F.lit(str(2 ** (8 * n - k))).cast("decimal(21,0)") for k in (1, 0))
    return let(_little(b, n).cast("decimal(21,0)"), lambda v: F.when(v >= half, v - whole).otherwise(v))


def _float(b: Column, n: int) -> Column:
    """IEEE number as text, without a fraction of zero. Sign, exponent and mantissa are read from the bits."""
    m_bits, bias = (23, 127) if n == 4 else (52, 1023)
    top, scale = (F.lit(str(2**k)).cast("decimal(20,0)") for k in (8 * n - 1, m_bits))

    def fields(bits: Column) -> Column:
        low = F.pmod(bits, scale)
        return F.struct(
            F.when(bits >= top, -1.0).otherwise(1.0).alias("sign"), (low.cast("double") / float(2**m_bits)).alias("m"),
            ((F.pmod(bits, top) - low) / scale).cast("int").alias("x"),
        )

    def text(f: Column) -> Column:
        value = f["sign"] * F.when(f["x"] == 0, f["m"] * 2.0 ** (1 - bias)).otherwise((1 + f["m"]) * F.pow(F.lit(2.0), f["x"] - bias))
        plain = F.regexp_replace((value.cast("float") if n == 4 else value).cast("string"), r"\.0$", "")
        return F.when(f["x"] <= 2 * bias, plain).when(f["m"] > 0, F.lit("NaN")).when(f["sign"] < 0, F.lit("-inf")).otherwise(F.lit("inf"))

    return let(let(_little(b, n), fields), text)


def name4(b: Column) -> Column:
    """Up to four characters ended by a zero byte; other bytes as `?`; `----` if empty."""
    text = F.regexp_replace(F.decode(b, "ISO-8859-1"), "(?s)\u0000.*$", "")
    text = F.regexp_replace(text, r"[^\x20-\x7e]", "?")
    return F.when(text == "", F.lit("----")).otherwise(text)


def _text_or_hex(b: Column) -> Column:
    return F.when(F.is_valid_utf8(b.cast("string")), b.cast("string")).otherwise(F.lower(F.hex(b)))


def loose_payload(b: Column) -> Column:
    """Payload without argument types: text without zero bytes at its end, or hex."""
    return F.when(F.is_valid_utf8(b.cast("string")), F.regexp_replace(b.cast("string"), "\u0000+$", "")).otherwise(F.lower(F.hex(b)))


def typed_payload(b: Column, count: Column) -> Column:
    """Payload of typed arguments, joined by spaces: a fold that carries the place read so far."""
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("end"), F.array().cast("array<string>").alias("out"))
    sizes = F.array(*map(F.lit, (0, 1, 2, 4, 8, *[0] * 11)))

    def step(acc: Column, _: Column) -> Column:
        cut = F.length(b) - acc["at"] < 4
        info = _little(_sub(b, acc["at"], 4), 4).cast("long")
        head = let(info, lambda i: F.struct(i.alias("info"), F.element_at(sizes, i.bitwiseAND(F.lit(15)).cast("int") + 1).alias("n"), (acc["at"] + 4).alias("p"), (F.length(b) - acc["at"] - 4).alias("left")))
        stop = F.struct(acc["at"].alias("at"), F.lit(True).alias("end"), acc["out"].alias("out"))
        return F.when(acc["end"] | cut, stop).otherwise(let(let(head, argument), lambda r: F.struct((acc["at"] + 4 + r["used"]).alias("at"), r["end"].alias("end"), F.concat(acc["out"], F.array_compact(F.array(r["text"]))).alias("out"))))

    def argument(x: Column) -> Column:
        """struct<text, used, end> of the argument at x.p."""
        p, n, left = x["p"], x["n"], x["left"]
        has = lambda bit: x["info"].bitwiseAND(F.lit(bit)) != 0
        none = F.lit(None).cast("string")
        done = lambda text, used, end=None: F.struct(text.alias("text"), used.alias("used"), (F.lit(False) if end is None else end).alias("end"))
        fits = (n > 0) & (n <= left)
        rest = done(F.lower(F.hex(_sub(b, p, left))), left)
        whole = F.lower(F.hex(_sub(b, p, n)))

        def number(read) -> Column:
            out = F.when(n == 1, read(_sub(b, p, 1), 1).cast("string"))
            for k in (2, 4, 8):
                out = out.when(n == k, read(_sub(b, p, k), k).cast("string"))
            return out

        def counted(show) -> Column:
            size = F.when(left >= 2, _little(_sub(b, p, 2), 2).cast("int"))
            return let(size, lambda k: F.when(k.isNull() | (left - 2 < k), done(none, F.lit(0), F.lit(True))).otherwise(done(let(_sub(b, p + 2, k), show), k + 2)))

        closed = lambda t: F.when(F.endswith(F.hex(t), F.lit("00")), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)
        return (
            F.when(has(BOOL), done(F.when(left > 0, F.when(F.hex(_sub(b, p, 1)) != "00", F.lit("true")).otherwise(F.lit("false"))), F.least(left, F.lit(1))))
            .when(has(SIGNED | UNSIGNED), F.when(fits, done(F.when(has(SIGNED), number(_signed)).otherwise(number(_little)), n)).otherwise(done(none, F.lit(0))))
            .when(has(FLOAT), F.when(fits & (n >= 4), done(F.when(n == 4, _float(_sub(b, p, 4), 4)).otherwise(_float(_sub(b, p, 8), 8)), n)).otherwise(rest))
            .when(has(STRING), counted(lambda t: _text_or_hex(closed(t))))
            .when(has(RAW), counted(lambda t: F.lower(F.hex(t))))
            .otherwise(F.when(fits, done(whole, n)).otherwise(F.struct(rest["text"].alias("text"), left.alias("used"), F.lit(True).alias("end"))))
        )

    done = F.aggregate(F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")), start, step)
    return F.array_join(done["out"], " ")


def message_line(msg: Column, stamp: Column, ecu: Column) -> Column:
    """`stamp hw count ecu app context type subtype mode args payload` of one message; NULL if its headers are cut short."""

    def places(flags: Column) -> Column:
        size = lambda bit, n: F.when(flags.bitwiseAND(F.lit(bit)) != 0, n).otherwise(0)
        time = F.lit(4) + size(WITH_ECU, 4) + size(WITH_SESSION, 4)
        ext = time + size(WITH_TIME, 4)
        return F.struct(flags.alias("flags"), time.alias("time"), ext.alias("ext"), (ext + size(EXTENDED, 10)).alias("body"))

    def fields(at: Column) -> Column:
        has = lambda bit: at["flags"].bitwiseAND(F.lit(bit)) != 0
        info = F.when(has(EXTENDED), big(_sub(msg, at["ext"], 1)).cast("int"))
        return F.when(
            F.length(msg) >= at["body"],
            F.struct(
                F.when(has(WITH_ECU), name4(_sub(msg, F.lit(4), 4))).alias("ecu"), F.when(has(WITH_TIME), big(_sub(msg, at["time"], 4))).otherwise(0).alias("hw"),
                info.alias("info"), F.when(has(EXTENDED), big(_sub(msg, at["ext"] + 1, 1)).cast("int")).otherwise(0).alias("args"),
                F.when(has(EXTENDED), name4(_sub(msg, at["ext"] + 2, 4))).alias("app"), F.when(has(EXTENDED), name4(_sub(msg, at["ext"] + 6, 4))).alias("ctx"),
                _sub(msg, at["body"], F.length(msg) - at["body"]).alias("body"),
            ),
        )

    def line(f: Column) -> Column:
        dash = F.lit("----")
        kind, sub = F.shiftright(f["info"], 1).bitwiseAND(F.lit(7)), F.shiftright(f["info"], 4)
        table = F.array(*[F.array(*map(F.lit, names)) for names in SUBTYPES])
        verbose = F.coalesce(f["info"].bitwiseAND(F.lit(1)) == 1, F.lit(False))
        mode = F.when(f["info"].isNull(), dash).when(verbose, F.lit("verbose")).otherwise(F.lit("non-verbose"))
        text = F.concat_ws(
            " ", stamp, f["hw"].cast("string"), F.lpad(big(_sub(msg, F.lit(1), 1)).cast("string"), 3, "0"), F.coalesce(f["ecu"], ecu, dash),
            F.coalesce(f["app"], dash), F.coalesce(f["ctx"], dash), F.coalesce(F.get(F.array(*map(F.lit, TYPES)), kind), dash),
            F.coalesce(F.get(F.get(table, kind), sub), dash), mode, f["args"].cast("string"),
            F.when(verbose, typed_payload(f["body"], f["args"])).otherwise(loose_payload(f["body"])),
        )
        return F.when(f.isNotNull(), text)

    flags = F.when(F.length(msg) >= 4, big(_sub(msg, F.lit(0), 1)).cast("int"))
    return let(let(let(flags, places), fields), line)


def storage_stamp(seconds: Column, micros: Column) -> Column:
    """`YYYY/MM/DD HH:MM:SS.ffffff` in UTC."""
    day = F.date_format(F.to_timestamp_ntz(F.timestamp_seconds(seconds).cast("string")), "yyyy/MM/dd HH:mm:ss")
    return F.concat(day, F.lit("."), F.lpad(micros.cast("string"), 6, "0"))


def clock_stamp(msg: Column) -> Column:
    """Stamp of a message without a date: its own counter of tenths of milliseconds."""
    flags = big(_sub(msg, F.lit(0), 1)).cast("int")
    has = lambda bit: flags.bitwiseAND(F.lit(bit)) != 0
    at = F.lit(4) + F.when(has(WITH_ECU), 4).otherwise(0) + F.when(has(WITH_SESSION), 4).otherwise(0)
    us = F.when(has(WITH_TIME) & (F.length(msg) >= at + 4), big(_sub(msg, at, 4)) * 100).otherwise(0).cast("long")
    two = lambda e: F.lpad(F.expr(e).cast("string"), 2, "0") if isinstance(e, str) else F.lpad(e.cast("string"), 2, "0")
    s = F.floor(us / 1_000_000)
    return F.concat(F.lit("0000/00/00 "), two(F.floor(s / 3600)), F.lit(":"), two(F.floor(F.pmod(s, F.lit(3600)) / 60)), F.lit(":"), two(F.pmod(s, F.lit(60))), F.lit("."), F.lpad(F.pmod(us, F.lit(1_000_000)).cast("string"), 6, "0"))

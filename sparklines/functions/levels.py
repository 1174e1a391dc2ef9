"""Levels of log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of each level.
SPELLINGS = {
    "TRACE": ("TRACE", "TRC"), "DEBUG": ("DEBUG", "DBG"), "INFO": ("INFO", "INF"), "NOTICE": ("NOTICE",),
    "WARN": ("WARN", "WARNING", "WRN"), "ERROR": ("ERROR", "ERR"), "FATAL": ("FATAL", "FTL", "CRITICAL", "CRIT", "EMERG", "ALERT"),
}
#: A level word, any case, for use within patterns.
LEVEL = "(?i:" + "|".join(w for words in SPELLINGS.values() for w in sorted(words, key=len, reverse=True)) + ")"
RANK = {name: i for i, name in enumerate(SPELLINGS)}


def normalize_level(token: Column) -> Column:
    """The level a word stands for, NULL if none."""
    up = F.upper(token)
    out = F.when(up.isin(*SPELLINGS["TRACE"]), F.lit("TRACE"))
    for name, words in SPELLINGS.items():
        out = out.when(up.isin(*words), F.lit(name)) if name != "TRACE" else out
    return out


def level_name(token: Column) -> Column:
    """Like normalize_level, with UNKNOWN for other words."""
    return F.coalesce(normalize_level(token), F.lit("UNKNOWN"))


def level_rank(level: Column) -> Column:
    """0 for TRACE to 6 for FATAL, -1 for anything else."""
    out = F.when(level == "TRACE", 0)
    for name, i in RANK.items():
        out = out.when(level == name, i) if i else out
    return out.otherwise(-1)


def scan_level(raw: Column) -> Column:
    """Level of the leftmost keyword of a raw line, any case, inside words too."""
    word = F.upper(F.regexp_extract(raw, r"(?i)(fatal|crit|emerg|alert|error|warn|notice|info|debug|trace)", 1))
    return F.when(word.isin("FATAL", "CRIT", "EMERG", "ALERT"), F.lit("FATAL")).when(word != "", word)


def severity_number(n: Column) -> Column:
    """Level of a telemetry severity number 1 to 24."""
    n = n.try_cast("int")
    return F.when(n.between(1, 24), F.element_at(F.array(*map(F.lit, ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL"))), ((n + 3) / 4).cast("int")))


def syslog_severity(priority: Column) -> Column:
    """Level of a syslog priority: its three low bits."""
    s = priority.bitwiseAND(F.lit(7))
    return F.when(s <= 3, F.lit("ERROR")).when(s == 4, F.lit("WARN")).when(s <= 6, F.lit("INFO")).otherwise(F.lit("DEBUG"))


#: Facilities in order of their number.
FACILITIES = (
    "kern", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "cron", "authpriv", "ftp", "ntp", "audit", "alert", "clock",
    "local0", "local1", "local2", "local3", "local4", "local5", "local6", "local7",
)


def syslog_facility(priority: Column) -> Column:
    """Name of a syslog priority's facility, NULL beyond the last."""
    return F.get(F.array(*map(F.lit, FACILITIES)), F.shiftright(priority, 3))

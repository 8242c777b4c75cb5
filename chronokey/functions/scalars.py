"""Scalar functions as native columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A histogram has 32 linear buckets, then 32 for each power of two.
SUB_BITS = 5


def bucket(v: Column) -> Column:
    """Log-linear bucket of a nonnegative integer."""
    top = F.length(F.bin(v)) - 1
    sub = F.call_function("shiftright", v, (top - SUB_BITS).cast("int")).bitwiseAND(F.lit(31))
    return F.when(v < 32, v).otherwise((top - 4) * 32 + sub).cast("long")


def bucket_edge(b: Column) -> Column:
    """Largest integer of a bucket."""
    shift = (F.floor(b / 32) - 1).cast("int")
    return F.when(b < 32, b).otherwise(F.call_function("shiftleft", (F.lit(32) + b % 32 + 1).cast("long"), shift) - 1).cast("long")


def ceil_div(a: Column, b: Column) -> Column:
    """Ceiling of a / b for integers, a >= 0, without floating point."""
    x, y = a.cast("long"), b.cast("long")
    return F.floor((x + y - 1 - (x + y - 1) % y) / y).cast("long")


def parse_milli(text: Column) -> Column:
    """Thousandths of a decimal text with at most three decimals; null if malformed or signed."""
    whole, part = F.regexp_extract(text, r"^(\d+)", 1), F.regexp_extract(text, r"\.(\d{1,3})$", 1)
    value = whole.try_cast("long") * 1000 + F.coalesce(F.rpad(part, 3, "0").try_cast("long"), F.lit(0))
    return F.when(text.rlike(r"^\d{1,12}(\.\d{1,3})?\z"), value)


def parse_int(text: Column) -> Column:
    """A strict 64-bit integer: digits with at most a minus before; null for all else."""
    return F.when(text.rlike(r"^-?[0-9]+\z"), text.try_cast("long"))


def reply_line(sign: str, value: Column) -> Column:
    """A reply of one line: ``+`` a status, ``-`` an error, ``:`` an integer; line ends in it become blanks."""
    return F.concat(F.lit(sign), F.regexp_replace(value.cast("string"), "[\r\n]", " "), F.lit("\r\n"))


def reply_array(items: Column) -> Column:
    """An array of replies that are encoded already."""
    return F.concat(F.lit("*"), F.size(items).cast("string"), F.lit("\r\n"), F.array_join(items, ""))


def key_name(i: Column) -> Column:
    return F.format_string("key:%010d", i)


def replid() -> Column:
    """40 random hex digits."""
    return F.substring(F.sha2(F.call_function("uuid"), 256), 1, 40)


def lease_bound(lease_ms: Column, drift: float, grace_ms: int) -> Column:
    """How long a granter waits: trunc(lease * (1 + drift)) + grace."""
    return (lease_ms * F.lit(1 + drift)).cast("long") + grace_ms


def lease_held(lease_ms: Column, drift: float) -> Column:
    """How long the holder may act: trunc(lease * (1 - drift))."""
    return (lease_ms * F.lit(1 - drift)).cast("long")


def unsigned_mod(hex64: Column, n: int) -> Column:
    """Sixteen hex digits as an unsigned number, modulo ``n``."""
    half = lambda at: F.conv(F.substring(hex64, at, 8), 16, 10).cast("long")
    return ((half(1) % n) * ((1 << 32) % n) + half(9)) % n


def resp_simple(text: Column) -> Column:
    return F.concat(F.lit("+"), text, F.lit("\r\n"))


def resp_error(text: Column) -> Column:
    return F.concat(F.lit("-"), text, F.lit("\r\n"))


def resp_integer(n: Column) -> Column:
    return F.concat(F.lit(":"), n.cast("string"), F.lit("\r\n"))


def resp_array(items: Column) -> Column:
    """An array reply of encoded items."""
    return F.concat(F.lit("*"), F.size(items).cast("string"), F.lit("\r\n"), F.array_join(items, ""))


def bucket_text(tokens: Column, last_ms: Column) -> Column:
    """Limiter state as stored text."""
    return F.concat_ws(" ", F.lit("RL1"), tokens.cast("string"), last_ms.cast("string"))


def bucket_state(text: Column) -> Column:
    """(tokens_ut, last_ms) of a state text; null if it is none."""
    tokens, last = (F.regexp_extract(text, r"^RL1 (\d+) (-?\d+)$", i).try_cast("long") for i in (1, 2))
    return F.when(tokens.isNotNull() & last.isNotNull(), F.struct(tokens.alias("tokens_ut"), last.alias("last_ms")))


def resp_bulk(value: Column) -> Column:
    return F.when(value.isNull(), F.lit("$-1\r\n")).otherwise(F.concat(F.lit("$"), F.octet_length(value).cast("string"), F.lit("\r\n"), value, F.lit("\r\n")))


def resp_command(args: list[Column]) -> Column:
    return F.concat(F.lit(f"*{len(args)}\r\n"), *[resp_bulk(a) for a in args])


def inline_args(line: Column) -> Column:
    """Arguments of an inline command: split at spaces and tabs, a trailing CR dropped."""
    return F.filter(F.split(F.regexp_replace(line, "\r$", ""), "[ \t]+"), lambda x: x != "")


def info_map(text: Column) -> Column:
    """``key:value`` lines as a map; comments and blank lines left out, a value may hold colons."""
    lines = F.filter(F.split(text, "\r?\n"), lambda x: x.contains(":") & ~x.startswith("#"))
    return F.map_from_entries(F.transform(lines, lambda x: F.struct(F.substring_index(x, ":", 1), F.regexp_extract(x, "^[^:]*:(.*)$", 1))))


def glob_regex(pattern: str) -> str:
    """An anchored regular expression of a glob: ``*`` any run, ``?`` one character, a backslash
    makes the next one literal; a bracket is literal. Runs of stars count as one."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            if out[-1:] != [".*"]:
                out.append(".*")
        elif c == "?":
            out.append(".")
        else:
            if c == "\\" and i + 1 < len(pattern):
                i += 1
                c = pattern[i]
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "\\z"

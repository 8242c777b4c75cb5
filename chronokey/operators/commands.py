"""Commands as rows: their classes, their checks with the error texts, and static replies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import parse_int, parse_milli, resp_bulk

#: Names of commands by class, arguments (name included) from and to, largest TTL, capacity, rate.
WRITES = ("SET", "DEL", "EXPIRE", "PEXPIRE", "PERSIST", "RL.ACQUIRE")
READS = ("GET", "TTL", "PTTL", "DBSIZE", "KEYS", "RL.PEEK")
ARITY = {"PING": (1, 2), "ECHO": (2, 2), "SET": (3, None), "GET": (2, 2), "DEL": (2, None), "EXPIRE": (3, 3), "PEXPIRE": (3, 3), "TTL": (2, 2), "PTTL": (2, 2), "PERSIST": (2, 2), "KEYS": (2, 2), "RL.ACQUIRE": (4, 5), "RL.PEEK": (4, 5), "DBSIZE": (1, None), "INFO": (1, None), "SAVE": (1, None), "COMMAND": (1, None)}
MOST_TTL_MS, MOST_CAPACITY, MOST_RATE_MILLI = 1_000_000_000_000, 1_000_000_000, 1_000_000_000
NOT_INTEGER, BAD_EXPIRE, SYNTAX = "ERR value is not an integer or out of range", "ERR invalid expire time", "ERR syntax error"


def op_class(op: Column) -> Column:
    """write, read or other."""
    return F.when(op.isin(*WRITES), "write").when(op.isin(*READS), "read").otherwise("other")


def ttl_error(text: Column, seconds: Column) -> Column:
    """Error of a TTL text, null if there is none."""
    n = parse_int(text)
    most = F.when(seconds, MOST_TTL_MS // 1000).otherwise(MOST_TTL_MS)
    return F.when(n.isNull(), NOT_INTEGER).when((n > most) | (n < -MOST_TTL_MS), BAD_EXPIRE)


def ttl_ms(text: Column, seconds: Column) -> Column:
    n = parse_int(text)
    return F.when(ttl_error(text, seconds).isNull(), F.when(seconds, n * 1000).otherwise(n))


def _options_error(args: Column) -> Column:
    """Error of a SET's options: at most one, EX or PX, with a TTL above 0; the first fault counts."""
    option, value = F.upper(F.get(args, F.lit(3))), F.get(args, F.lit(4))
    second = option == "EX"
    ms = ttl_ms(value, second)
    known = option.isin("EX", "PX") & value.isNotNull()
    return (F.when(F.size(args) <= 3, None).when(~known, SYNTAX).when(ttl_error(value, second).isNotNull(), ttl_error(value, second))
            .when(ms <= 0, "ERR invalid expire time in 'set' command").when(F.size(args) > 5, SYNTAX))


def _bucket_error(args: Column) -> Column:
    capacity, rate = parse_int(F.get(args, F.lit(2))), parse_milli(F.get(args, F.lit(3)))
    cost = F.when(F.size(args) == 5, parse_int(F.get(args, F.lit(4)))).otherwise(F.lit(1).cast("long"))
    wrong = lambda x, lo, hi: x.isNull() | (x < lo) | (x > hi)
    return (F.when(wrong(capacity, 1, MOST_CAPACITY), "ERR capacity must be an integer between 1 and 1000000000")
            .when(wrong(rate, 1, MOST_RATE_MILLI), "ERR rate must be tokens per second, 0.001 to 1000000, at most 3 decimals")
            .when(cost.isNull() | (cost < 1), "ERR cost must be a positive integer").when(cost > capacity, "ERR cost exceeds capacity"))


def error(args: Column) -> Column:
    """The error of a command (name and arguments), null if it is well formed. Rows stay, with their error."""
    name, op, n = F.get(args, F.lit(0)), F.upper(F.get(args, F.lit(0))), F.size(args)
    bad = lambda lo, hi: (n < lo) | (F.lit(False) if hi is None else n > hi)
    arity = reduce(lambda c, k: c | ((op == k) & bad(*ARITY[k])), ARITY, F.lit(False))
    shown = F.when(op.startswith("RL."), name).otherwise(F.lower(op))
    second = op == "EXPIRE"
    return (F.when(n == 0, None).when(~op.isin(*ARITY), F.concat(F.lit("ERR unknown command '"), name, F.lit("'")))
            .when(arity, F.concat(F.lit("ERR wrong number of arguments for '"), shown, F.lit("' command")))
            .when(op == "SET", _options_error(args)).when(op.isin("EXPIRE", "PEXPIRE"), ttl_error(F.get(args, F.lit(2)), second)).when(op.startswith("RL."), _bucket_error(args)))


def static_reply(args: Column) -> Column:
    """The reply that needs no store: an error, PING, ECHO or COMMAND; null for others."""
    op, one = F.upper(F.get(args, F.lit(0))), F.get(args, F.lit(1))
    err = error(args)
    said = F.when(op == "PING", F.when(one.isNull(), "+PONG\r\n").otherwise(resp_bulk(one))).when(op == "ECHO", resp_bulk(one)).when(op == "COMMAND", "*0\r\n")
    return F.when(err.isNotNull(), F.concat(F.lit("-"), err, F.lit("\r\n"))).otherwise(said)

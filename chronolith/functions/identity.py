"""Message identity and scope expressions shared by the ledger operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Unicode White_Space, the characters that may stand around an identifier.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

MESSAGE_KEY = ("tenant_id", "project_id", "trace_id", "span_id", "seq")


def loose(identifier: Column) -> Column:
    """An identifier without surrounding white space and letter case."""
    return F.lower(F.btrim(identifier, F.lit(WHITE)))


def message_key(prefix: str = "") -> list[Column]:
    """tenant, project, trace, span and seq as they decide whether two deliveries are one message."""
    col = lambda name: F.col(prefix + name)
    return [col("tenant_id"), col("project_id"), loose(col("trace_id")), loose(col("span_id")), col("seq")]


def family_key(canonical_key: Column) -> Column:
    """What stands before the first ``|rev:``."""
    return F.substring_index(canonical_key, "|rev:", 1)


def environment(env: Column) -> Column:
    """Null scopes equal each other."""
    return F.coalesce(env, F.lit(""))

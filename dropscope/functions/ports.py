"""Port-history expressions. History is ``ARRAY<STRUCT<port INT, proto STRING>>``; text only at the edge."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column
from pyspark.sql import functions as F

from dropscope.functions.ip import _col


def parse_history(text: Column | str) -> Column:
    """``'443/tcp,22/tcp'`` as an array of structs; empty or null text is the empty array."""
    items = F.filter(F.split(F.coalesce(_col(text), F.lit("")), ","), lambda x: x != "")
    return F.transform(
        items,
        lambda x: F.struct(
            F.substring_index(x, "/", 1).try_cast("int").alias("port"),
            F.get(F.split(x, "/"), F.lit(1)).alias("proto"),
        ),
    )


def render_history(history: Column | str) -> Column:
    return F.array_join(
        F.transform(_col(history), lambda x: F.concat_ws("/", x["port"].cast("string"), x["proto"])), ","
    )


def add_to_history(text: Column | str, seen: Column | str) -> Column:
    """Stored entries in order, then those of ``seen`` (array of port, proto) not among them.

    The union compares entries as text, which is hashed; over structs it would compare every pair.
    """
    shown = lambda e: F.concat_ws("/", e["port"].cast("string"), e["proto"])
    old, new = (F.transform(x, shown) for x in (parse_history(text), _col(seen)))
    return F.array_join(F.array_union(old, new), ",")


def has_port(text: Column | str, port: Column | str, proto: str) -> Column:
    """Exact element test on the text form: is ``port/proto`` one of the entries?"""
    wanted = F.concat(_col(port).cast("string"), F.lit("/" + proto))
    return F.coalesce(F.array_contains(F.split(_col(text), ","), wanted), F.lit(False))


def port_label(port: Column | str, text: Column | str) -> Column:
    """``port/udp`` if seen over UDP, else ``port/tcp`` if seen over TCP, else the bare number."""
    p = _col(port).cast("string")
    return (
        F.when(has_port(text, port, "udp"), F.concat(p, F.lit("/udp")))
        .when(has_port(text, port, "tcp"), F.concat(p, F.lit("/tcp")))
        .otherwise(p)
    )


def service_match(port: Column | str, text: Column | str, tcp: tuple[int, ...], udp: tuple[int, ...]) -> Column:
    """Port is a configured service of a protocol the source really used; no services means no match."""
    hit = F.lit(False)
    if tcp:
        hit = hit | (_col(port).isin(*tcp) & has_port(text, port, "tcp"))
    if udp:
        hit = hit | (_col(port).isin(*udp) & has_port(text, port, "udp"))
    return F.coalesce(hit, F.lit(False))


def preview(items: Column | str, shown: int = 3, hidden_max: int | None = None) -> Column:
    """First ``shown`` entries, how many more there are, and the text of the rest; a display may cut it at ``hidden_max``."""
    items = _col(items)
    more = F.greatest(F.size(items) - shown, F.lit(0))
    take = F.size(items) if hidden_max is None else F.lit(hidden_max)
    rest = F.array_join(F.slice(items, F.lit(shown + 1), F.greatest(take, F.lit(0))), ", ")
    if hidden_max is not None:
        rest = F.when(more > hidden_max, F.concat(rest, F.lit(", ..."))).otherwise(rest)
    return F.struct(
        F.array_join(F.slice(items, 1, shown), ", ").alias("shown"),
        more.alias("more"),
        rest.alias("hidden"),
    )


def toggle_ports(ports: Column | str, port: Column) -> Column:
    """Array with ``port`` taken out if present, appended if not."""
    ports = _col(ports)
    return F.when(F.array_contains(ports, port), F.array_remove(ports, port)).otherwise(F.array_append(ports, port))


def toggle_port(config, field: str, port: int):
    now = getattr(config, field)
    new = tuple(p for p in now if p != port) if port in now else now + (port,)
    return dataclasses.replace(config, **{field: new})

"""Address arithmetic on text columns.

The longer expressions are built as SQL text over a column name: one parser call instead of hundreds of
calls into the JVM.

IPv4 is held as a BIGINT, IPv6 as 32 hex digits (sorts like the number). A network key
is the masked address as hex text, so one equi-join serves both families.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_v6(ip: Column | str) -> Column:
    return _col(ip).contains(":")


def is_v4(ip: Column | str) -> Column:
    return _col(ip).contains(".")


def family(ip: Column | str) -> Column:
    """6 if the text holds a colon, 4 if it holds a dot, else null."""
    ip = _col(ip)
    return F.when(is_v6(ip), 6).when(is_v4(ip), 4)


def is_net(ip: Column | str) -> Column:
    return _col(ip).contains("/")


def is_host_text(ip: Column | str) -> Column:
    """Plain addresses and the /32 and /128 forms of a single host."""
    ip = _col(ip)
    return ~is_net(ip) | ip.rlike("/(32|128)$")


def strip_prefix(ip: Column | str, only_host: bool = False) -> Column:
    """Text without ``/n``; with ``only_host`` just ``/32`` and ``/128`` go."""
    ip = _col(ip)
    if only_host:
        return F.regexp_replace(ip, "/(32|128)$", "")
    return F.substring_index(ip, "/", 1)


def _bare_sql(x: str) -> str:
    return f"substring_index({x}, '/', 1)"


def _plen_sql(x: str) -> str:
    top = f"if(contains({x}, ':'), 128, 32)"
    given = f"try_cast(get(split({x}, '/'), 1) AS INT)"
    return f"CASE WHEN NOT contains({x}, '/') THEN {top} WHEN {given} BETWEEN 0 AND {top} THEN {given} END"


def _number_sql(x: str) -> str:
    octets = [f"try_cast(get(split({x}, '[.]'), {i}) AS BIGINT)" for i in range(4)]
    ok = " AND ".join(f"{o} BETWEEN 0 AND 255" for o in octets)
    total = f"{octets[0]} * 16777216 + {octets[1]} * 65536 + {octets[2]} * 256 + {octets[3]}"
    return f"CASE WHEN size(split({x}, '[.]')) = 4 AND {ok} THEN {total} END"


def prefix_len(net: str) -> Column:
    """Prefix length as INT; a bare address counts as the full length."""
    return F.expr(_plen_sql(net))


def v4_to_long(ip: str) -> Column:
    """Dotted quad (prefix ignored) as BIGINT, null when it is not one."""
    return F.expr(_number_sql(_bare_sql(ip)))


def long_to_v4(n: Column) -> Column:
    octets = [F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    return F.concat_ws(".", *octets)


def v4_block(base: str, plen: str) -> tuple[Column, Column]:
    """First and last address of the network of ``base`` at a prefix length; host bits are masked away."""
    size = f"shiftleft(1L, 32 - {plen})"
    lo = F.expr(f"{base} - pmod({base}, {size})")
    return lo, lo + F.expr(f"{size} - 1")


def _let_sql(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once however often the body uses it."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _hex_sql(ip: str) -> str:
    """Groups around ``::`` padded to four digits, with the zero groups between them put back."""
    bare = f"lower({_bare_sql(ip)})"
    # A dotted tail such as ::ffff:1.2.3.4 is two groups.
    tail = _let_sql(
        _number_sql(f"regexp_extract({bare}, '([0-9.]+)$', 1)"), "q", "concat(hex(shiftright(q, 16)), ':', hex(q & 65535L))"
    )
    text = f"if(contains({bare}, '.'), concat(regexp_replace({bare}, '[0-9.]+$', ''), lower({tail})), {bare})"
    groups = "filter(split(coalesce(get(h, {i}), ''), ':'), g -> g <> '')"
    pad = "array_join(transform({side}, g -> lpad(g, 4, '0')), '')"
    missing = "8 - size(s.l) - size(s.r)"
    shape = f"if(size(s.h) = 2, {missing} >= 1, size(s.h) = 1 AND {missing} = 0)"
    short = "forall(concat(s.l, s.r), g -> g RLIKE '^[0-9a-f]{1,4}$')"
    whole = f"concat({pad.format(side='s.l')}, repeat('0000', {missing}), {pad.format(side='s.r')})"
    parts = f"named_struct('h', h, 'l', {groups.format(i=0)}, 'r', {groups.format(i=1)})"
    joined = _let_sql(parts, "s", f"if({shape} AND {short}, {whole}, NULL)")
    halves = f"split({text}, '::')"
    return f"if(contains({ip}, ':'), {_let_sql(halves, 'h', joined)}, NULL)"


def v6_to_hex(ip: str) -> Column:
    """IPv6 text (prefix ignored) as 32 hex digits, null when it is not one."""
    return F.expr(_hex_sql(ip))


def address_bits(ip: str) -> Column:
    """Comparable text of an address: 8 hex digits for IPv4, 32 for IPv6."""
    v4 = f"lower(lpad(hex({_number_sql(_bare_sql(ip))}), 8, '0'))"
    return F.expr(f"if(contains({ip}, ':'), {_hex_sql(ip)}, {v4})")


def network_key(bits: str, plen: str) -> Column:
    """Network of an ``address_bits`` column at a prefix length: every later bit zero."""
    number = f"cast(conv({bits}, 16, 10) AS BIGINT)"
    v4 = f"lower(lpad(hex({number} - pmod({number}, shiftleft(1L, 32 - {plen}))), 8, '0'))"
    full, rest = f"({plen} div 4)", f"({plen} % 4)"
    digit = f"cast(conv(substring({bits}, cast({full} AS INT) + 1, 1), 16, 10) AS INT)"
    kept = f"shiftleft(shiftright({digit}, 4 - {rest}), 4 - {rest})"
    part = f"if({rest} = 0, '', lower(hex({kept})))"
    v6 = f"rpad(concat(substring({bits}, 1, cast({full} AS INT)), {part}), 32, '0')"
    return F.expr(f"if(length({bits}) = 8, {v4}, {v6})")


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` plus columns evaluated exactly once per row.

    A generator keeps the optimizer from copying a long expression into every filter and projection
    that uses the column, which would outgrow the size limit of a compiled method.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


# Reserved networks as text patterns on a valid address.
PRIVATE_V4 = r"^(10\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.168\.)"
LINK_LOCAL_V4 = r"^169\.254\."
LOOPBACK_V4 = r"^127\."
MULTICAST_V4 = r"^(22[4-9]|23[0-9])\."
SPOOFED_V4 = r"^(127|22[4-9]|2[3-5][0-9])\."
NEVER_PUBLIC_V4 = r"^(0|127|224|255)\."
LOOPBACK_V6 = r"^(0{0,4}:){1,7}:?0{0,3}1(/128)?$"
LINK_LOCAL_V6 = r"^fe[89ab][0-9a-f]:"
MULTICAST_V6 = r"^ff[0-9a-f]{2}:"


def matches_any(ip: Column | str, *patterns: str) -> Column:
    return F.coalesce(F.lower(_col(ip)).rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def is_private(ip: Column | str) -> Column:
    """Local, loopback or multicast source: never worth a reputation lookup."""
    return matches_any(ip, PRIVATE_V4, NEVER_PUBLIC_V4, LOOPBACK_V6, LINK_LOCAL_V6)


def validate_ip(ip: Column | str) -> Column:
    """Shape check before a manual ban: digits-only quads outside the protected ranges, or any colon text."""
    ip = _col(ip)
    quad = ip.rlike(r"^(\d{1,3}\.){3}\d{1,3}$")
    barred = ip.rlike(r"^(127\.|224\.|225\.|239\.|255\.255\.255\.255)")
    return F.when(quad, ~barred).otherwise(is_v6(ip))

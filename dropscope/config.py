"""Job configuration: one immutable value passed to every job."""

from __future__ import annotations

import re
from dataclasses import dataclass

from dropscope.functions.ports import toggle_port

# Names of the network sets and the tag their hits carry.
SET_TAGS = {
    "FirewallBlock": "main",
    "FirewallBlock6": "main",
    "VPNBlock": "main",
    "AutoBan": "trap",
    "AutoBan6": "trap",
    "GeoBlock": "geo",
    "GeoBlock6": "geo",
    "Blacklist": "manual",
    "Blacklist6": "manual",
}
WHITE_SETS = ("FirewallWhite", "FirewallWhite6")
BLOCK_SETS = tuple(SET_TAGS)
# Set families that can be emptied on their own.
SET_FAMILIES = {
    "autoban": ("AutoBan", "AutoBan6"),
    "static": ("FirewallBlock", "FirewallBlock6"),
    "vpn": ("VPNBlock",),
    "white": WHITE_SETS,
    "manual": ("Blacklist", "Blacklist6"),
}
# Trailing report windows in seconds, None = all history.
WINDOWS = {"24h": 86400, "30d": 2592000, "1y": 31536000, "all": None}

DAY = 86400

# Keys of a settings file and the field each one fills.
TEXT_KEYS = {
    "ENABLE_FIREWALL": "enabled",
    "ENABLE_IPV6": "ipv6",
    "ENABLE_AUTOBAN": "autoban",
    "ENABLE_MANUAL": "manual",
    "ENABLE_CONNLIMIT": "connlimit",
    "ENABLE_BRUTEFORCE": "bruteforce",
    "ENABLE_FWD_PROTECTION": "forward_protection",
    "TCP_SERVICES": "tcp_services",
    "UDP_SERVICES": "udp_services",
    "TCP_PASSIVE_RANGE": "tcp_passive_range",
    "BYPASS_CONN_TCP": "bypass_conn_tcp",
    "BYPASS_CONN_UDP": "bypass_conn_udp",
    "BYPASS_BRUTE_TCP": "bypass_brute_tcp",
    "BYPASS_BRUTE_UDP": "bypass_brute_udp",
    "CONNLIMIT_MAX": "conn_limit",
    "CONNLIMIT_CUSTOM": "conn_limit_custom",
    "BF_SECONDS": "brute_seconds",
    "BF_HITCOUNT": "brute_hits",
    "BAN_TIMEOUT": "ban_timeout",
    "REPORT_COOLDOWN": "report_cooldown",
    "SOURCES_V4": "sources_v4",
    "SOURCES_V6": "sources_v6",
    "BANNED_COUNTRIES": "banned_countries",
}


@dataclass(frozen=True)
class Config:
    """Switches, port lists and thresholds of one deployment."""

    enabled: bool = True
    ipv6: bool = True
    autoban: bool = True
    manual: bool = True
    connlimit: bool = True
    bruteforce: bool = True
    forward_protection: bool = False
    tcp_services: tuple[int, ...] = (22, 443)
    udp_services: tuple[int, ...] = (53, 51515)
    tcp_passive_range: tuple[int, int] | None = None
    bypass_conn_tcp: tuple[int, ...] = ()
    bypass_conn_udp: tuple[int, ...] = ()
    bypass_brute_tcp: tuple[int, ...] = ()
    bypass_brute_udp: tuple[int, ...] = ()
    conn_limit: int = 15
    conn_limit_custom: int = 150
    brute_seconds: int = 60
    brute_hits: int = 5
    ban_timeout: int = DAY
    report_cooldown: int = 604800
    sources_v4: tuple[str, ...] = ()
    sources_v6: tuple[str, ...] = ()
    banned_countries: tuple[str, ...] = ()

    @classmethod
    def from_text(cls, text: str) -> "Config":
        """Settings from ``KEY="value"`` lines; keys not named in ``TEXT_KEYS`` are ignored."""
        found = dict(re.findall(r'^\s*([A-Z0-9_]+)="([^"]*)"', text, flags=re.M))
        values: dict[str, object] = {}
        for key, field in TEXT_KEYS.items():
            if key not in found:
                continue
            raw, now = found[key].strip(), getattr(cls(), field)
            if isinstance(now, bool):
                values[field] = raw == "true"
            elif isinstance(now, int):
                values[field] = int(raw) if raw.isdigit() else now
            elif field == "tcp_passive_range":
                lo, _, hi = raw.partition(":")
                values[field] = (int(lo), int(hi or lo)) if lo.isdigit() else None
            elif field in ("sources_v4", "sources_v6", "banned_countries"):
                values[field] = tuple(raw.split())
            else:
                values[field] = tuple(int(p) for p in raw.split() if p.isdigit())
        return cls(**values)

    def services(self, proto: str) -> tuple[int, ...]:
        return self.tcp_services if proto == "tcp" else self.udp_services

    def brute_ports(self, proto: str) -> tuple[int, ...]:
        bypass = self.bypass_brute_tcp if proto == "tcp" else self.bypass_brute_udp
        return tuple(p for p in self.services(proto) if p not in bypass)

    def toggled(self, field: str, port: int) -> "Config":
        """Copy with ``port`` added to, or taken out of, one port list."""
        return toggle_port(self, field, port)

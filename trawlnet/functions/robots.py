"""robots.txt: groups by user agent, longest match of allow and disallow, crawl delay and sitemaps."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass
class Rules:
    """allow: 'all', 'none' or 'some' by rules (allowed, path pattern); defer: the visit is to be put off."""

    allow: str = "some"
    rules: list[tuple[bool, str]] = field(default_factory=list)
    crawl_delay_ms: int | None = None
    sitemaps: list[str] = field(default_factory=list)
    defer: bool = False

    def allows(self, path: str) -> bool:
        if self.allow != "some":
            return self.allow == "all"
        best, verdict = -1, True
        for allowed, pattern in self.rules:
            if len(pattern) >= best and _matches(pattern, path):
                if len(pattern) > best or allowed:
                    best, verdict = len(pattern), allowed
        return verdict


def _matches(pattern: str, path: str) -> bool:
    if "*" not in pattern and not pattern.endswith("$"):
        return path.startswith(pattern)
    end = r"\Z" if pattern.endswith("$") else ""
    body = pattern[:-1] if end else pattern
    return re.match(".*".join(map(re.escape, body.split("*"))) + end, path, re.S) is not None


def failed(code: int) -> Rules:
    """Rules of a fetch that gave no file: client errors allow all, server errors and other statuses put the visit off."""
    return Rules(allow="all") if 400 <= code < 500 else Rules(allow="none", defer=True)


def parse(text: str | None, agent: str = "*") -> Rules:
    """The rules for an agent: those of the groups that name it, else those for `*`. Sitemaps are of the whole file."""
    out = Rules()
    groups: dict[str, Rules] = {}
    agents: list[str] = []
    in_rules = False
    wanted = agent.lower()
    for line in (text or "").lstrip("\ufeff").splitlines():
        name, colon, value = line.partition("#")[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "user-agent":
            if in_rules:
                agents, in_rules = [], False
            agents.append(value.lower())
            groups.setdefault(value.lower(), Rules())
        elif name == "sitemap":
            if value:
                out.sitemaps.append(value)
        elif name in ("allow", "disallow", "crawl-delay"):
            in_rules = True
            for a in agents:
                if name == "crawl-delay":
                    try:
                        groups[a].crawl_delay_ms = round(float(value) * 1000)
                    except ValueError:
                        pass
                elif value:
                    groups[a].rules.append((name == "allow", value))
    named = [g for a, g in groups.items() if a and a != "*" and a in wanted]
    chosen = named or [g for a, g in groups.items() if a == "*"]
    for g in chosen:
        out.rules += g.rules
        out.crawl_delay_ms = g.crawl_delay_ms if out.crawl_delay_ms is None else out.crawl_delay_ms
    if not out.rules:
        out.allow = "all"
    return out

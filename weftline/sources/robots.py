"""robots.txt and sitemaps."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from urllib.robotparser import RobotFileParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Fetch = Callable[[str], str | None]


def directives(robots: Column) -> Column:
    """array<struct<name, value>> of the lines, without comments and blank ones."""
    rows = F.filter(F.transform(F.split(robots, "\r?\n"), F.trim), lambda x: (x != "") & ~x.startswith("#") & F.contains(x, F.lit(":")))
    return F.transform(rows, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("name"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))


def sitemaps(robots: Column) -> Column:
    """Addresses of the Sitemap lines."""
    return F.transform(F.filter(directives(robots), lambda d: d["name"] == "sitemap"), lambda d: d["value"])


@lru_cache(4096)
def rules(robots: str) -> RobotFileParser:
    parser = RobotFileParser()
    parser.parse(robots.splitlines())
    return parser


def may_fetch(robots: str | None, agent: str, url: str) -> bool:
    """No rules, or rules or addresses that can't be read, allow everything."""
    try:
        return not robots or rules(robots).can_fetch(agent, url)
    except ValueError:
        return True


def allowed(url: Column, robots: Column, agent: str = "*") -> Column:
    @F.pandas_udf("boolean")
    def run(urls: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([u is not None and may_fetch(t, agent, u) for u, t in zip(urls, texts)])

    return run(url, robots)


def crawl_delay(robots: str, agent: str = "*", standard: bool = False) -> float | None:
    """Seconds of the agent's Crawl-delay, else of that for all. The first value of an agent
    counts; any directive but another User-agent ends a group, after which a delay is for all
    agents (with `standard` a group lasts until the next User-agent after a rule)."""
    found: dict[str, float] = {}
    group: list[str] = []
    ruled = False
    for line in map(str.strip, (robots or "").splitlines()):
        if not line or line.startswith("#"):
            continue
        name, _, value = (x.strip() for x in line.partition(":"))
        name = name.lower()
        if name == "user-agent":
            group = [value.lower()] if standard and ruled else [*group, value.lower()]
            ruled = False
            continue
        if name == "crawl-delay":
            try:
                seconds = float(value)
            except ValueError:
                continue
            for a in group or ["*"]:
                found.setdefault(a, seconds)
        if standard:
            ruled = True
        else:
            group = []
    return found.get(agent.lower(), found.get("*"))


def crawl_delays(robots: Column, agent: str = "*", standard: bool = False) -> Column:
    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: crawl_delay(t, agent, standard) if t else None).astype("float64")

    return run(robots)


SITEMAP_NS = "{http://www.sitemaps.org/schemas/sitemap/0.9}"


def locations(xml: str | None) -> tuple[bool, list[str]]:
    """(whether it is an index, its addresses); those of the sitemap name space, else, if
    there are none, those without one. What isn't XML has none."""
    try:
        root = ElementTree.fromstring((xml or "").strip())
    except ElementTree.ParseError:
        return False, []
    own = [e.text.strip() for e in root.iter(f"{SITEMAP_NS}loc") if e.text and e.text.strip()]
    own = own or [e.text.strip() for e in root.iter("loc") if e.text and e.text.strip()]
    return root.tag.rpartition("}")[2] == "sitemapindex", own


def sitemap_urls(start: list[str], fetch: Fetch, depth: int = 5) -> list[str]:
    """Addresses of the sitemaps and of those they list, down to a depth; each map is read
    once, each address is given once, in order. A map that can't be fetched has none."""
    out: dict[str, None] = {}
    done: set[str] = set()

    def read(at: str, level: int) -> None:
        if at in done or level > depth:
            return
        done.add(at)
        text = fetch(at)
        if not text or not re.search("<(?:urlset|sitemapindex|loc)", text):
            return
        index, own = locations(text)
        for u in own:
            if index:
                read(u, level + 1)
            else:
                out.setdefault(u)

    for s in start:
        read(s, 0)
    return list(out)

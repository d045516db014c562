"""Tools for an agent: crawl, search, read, list and extract, as functions that take checked
arguments and give text, and a server that offers them over standard input and output by the
Model Context Protocol (JSON-RPC, a message a line)."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from dataclasses import dataclass
from typing import IO

from pyspark.sql import SparkSession

from weftline.errors import ConfigurationError
from weftline.operators import crawl, enrich, search
from weftline.sources import files
from weftline.sources.fetch import Client, urllib_client

KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool}


@dataclass(frozen=True)
class Argument:
    """One argument: its JSON type, what it is, its default (none: it must be given) and bounds."""

    kind: str
    about: str
    default: object = None
    needed: bool = False
    least: float | None = None
    most: float | None = None

    def checked(self, name: str, value: object) -> object:
        if not isinstance(value, KINDS[self.kind]) or (isinstance(value, bool) and self.kind != "boolean"):
            raise ConfigurationError(f"{name} must be of type {self.kind}")
        if (self.least is not None and value < self.least) or (self.most is not None and value > self.most):
            raise ConfigurationError(f"{name} must lie between {self.least} and {self.most}")
        if self.needed and value == "":
            raise ConfigurationError(f"{name} can't be empty")
        return value

    def schema(self) -> dict:
        bounds = {k: v for k, v in (("minimum", self.least), ("maximum", self.most)) if v is not None}
        return {"type": self.kind, "description": self.about} | bounds | ({} if self.needed else {"default": self.default})


@dataclass
class Tool:
    name: str
    about: str
    arguments: dict[str, Argument]
    function: Callable[..., str]

    def schema(self) -> dict:
        return {"type": "object", "properties": {n: a.schema() for n, a in self.arguments.items()}, "required": [n for n, a in self.arguments.items() if a.needed], "additionalProperties": False}

    def call(self, **given) -> str:
        """The tool's text; raises what is wrong."""
        if unknown := sorted(set(given) - set(self.arguments)):
            raise ConfigurationError(f"no such argument: {', '.join(unknown)}")
        if missing := [n for n, a in self.arguments.items() if a.needed and n not in given]:
            raise ConfigurationError(f"missing: {', '.join(missing)}")
        return self.function(**{n: a.checked(n, given[n]) if n in given else a.default for n, a in self.arguments.items()})

    def run(self, **given) -> str:
        """The same, with what is wrong as text: an agent reads it and goes on."""
        try:
            return self.call(**given)
        except Exception as e:
            return f"Failed: {type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"


def tools(spark: SparkSession, out: str, client: Client | None = None, complete: enrich.Complete | None = None) -> list[Tool]:
    """The five tools over one crawl folder. Without a model, extraction says so."""
    at = f"{out}/pages"
    rows = lambda: files.read_pages(spark, at)

    def crawl_site(url: str, max_pages: int, include_subdomains: bool) -> str:
        r = crawl.crawl(spark, url, out, client or urllib_client(), crawl.Options(max_pages=max_pages, include_subdomains=include_subdomains))
        return f"{r.pages_saved} pages saved in {at}"

    def search_pages(query: str, max_results: int) -> str:
        hits = search.keyword_search(rows(), query, max_results).collect()
        return "\n".join([f"{len(hits)} results for {query!r}", *(f"\n{h['title'] or 'Untitled'}\n{h['url']}\n{h['snippet']}" for h in hits)])

    def read_page(url: str) -> str:
        r = search.find_page(rows(), url).first()
        return f"No page {url}" if r is None else f"{r['title'] or 'Untitled'}\n{r['url']}\n\n{r['text']}"

    def list_pages(most: int) -> str:
        pages = search.listing(rows())
        own = pages.orderBy("url").limit(most).collect()
        return "\n".join([f"{pages.count()} pages", *(f"{r['title']} ({r['words']} words): {r['url']}" for r in own)])

    def extract_data(fields: str, preview: int) -> str:
        if complete is None:
            return "No model was given"
        found = enrich.extract_all(rows(), complete, fields).orderBy("url").limit(preview).collect()
        return "\n".join(f"{r['url']}: {dict(r['fields'])}" for r in found)

    return [
        Tool("crawl_site", "Crawl a site into the folder", {"url": Argument("string", "where to begin", needed=True), "max_pages": Argument("integer", "pages at most, 0 for all", 100, least=0), "include_subdomains": Argument("boolean", "follow links to subdomains", False)}, crawl_site),
        Tool("search_pages", "Find pages by words", {"query": Argument("string", "words", needed=True), "max_results": Argument("integer", "results at most", 10, least=1, most=100)}, search_pages),
        Tool("read_page", "The text of one page", {"url": Argument("string", "its address", needed=True)}, read_page),
        Tool("list_pages", "Pages with their lengths", {"most": Argument("integer", "pages to name", 200, least=1)}, list_pages),
        Tool("extract_data", "Fields of the pages by a model", {"fields": Argument("string", "names with commas between, or nothing for automatic ones", ""), "preview": Argument("integer", "pages to show", 20, least=1)}, extract_data),
    ]


def answer(own: dict[str, Tool], message: dict) -> dict | None:
    """The reply to one JSON-RPC message, None for a notification."""
    method, params, id_ = message.get("method"), message.get("params") or {}, message.get("id")
    ok = lambda result: {"jsonrpc": "2.0", "id": id_, "result": result}
    wrong = lambda code, text: {"jsonrpc": "2.0", "id": id_, "error": {"code": code, "message": text}}
    if id_ is None:
        return None
    if method == "initialize":
        return ok({"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "weftline", "version": "1"}})
    if method == "ping":
        return ok({})
    if method == "tools/list":
        return ok({"tools": [{"name": t.name, "description": t.about, "inputSchema": t.schema()} for t in own.values()]})
    if method == "tools/call":
        tool = own.get(params.get("name"))
        if tool is None:
            return wrong(-32602, f"no tool {params.get('name')!r}")
        text = tool.run(**(params.get("arguments") or {}))
        return ok({"content": [{"type": "text", "text": text}], "isError": text.startswith("Failed: ")})
    return wrong(-32601, f"no method {method!r}")


def serve(own: list[Tool], source: IO[str] | None = None, sink: IO[str] | None = None) -> None:
    """Answers messages, one a line, until the source ends."""
    named, sink = {t.name: t for t in own}, sink or sys.stdout
    for line in source or sys.stdin:
        if not line.strip():
            continue
        try:
            reply = answer(named, json.loads(line))
        except (ValueError, AttributeError) as e:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
        if reply is not None:
            print(json.dumps(reply, ensure_ascii=False), file=sink, flush=True)

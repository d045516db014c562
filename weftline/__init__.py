"""A web-page analytics engine on PySpark. The names below are loaded when they are asked for."""

from __future__ import annotations

import importlib

PUBLIC = {
    "crawl": ("weftline.operators.crawl", "crawl"),
    "crawl_sites": ("weftline.operators.crawl", "crawl_sites"),
    "CrawlOptions": ("weftline.operators.crawl", "Options"),
    "extract": ("weftline.operators.pages", "extract"),
    "chunks": ("weftline.functions.chunking", "chunks"),
    "chunk_rows": ("weftline.operators.enrich", "chunk_rows"),
    "vector_rows": ("weftline.operators.enrich", "vector_rows"),
    "extract_fields": ("weftline.operators.enrich", "extract_fields"),
    "keyword_search": ("weftline.operators.search", "keyword_search"),
    "register": ("weftline.functions.registry", "register"),
}
__all__ = list(PUBLIC)


def __getattr__(name: str):
    if name in PUBLIC:
        module, attribute = PUBLIC[name]
        return getattr(importlib.import_module(module), attribute)
    raise AttributeError(name)

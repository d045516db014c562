"""Command line: python -m weftline.cli crawl|seeds|extract|chunk|upload|search|list|serve ..."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftline import agent
from weftline.functions import urls
from weftline.operators import crawl, enrich, search
from weftline.sources import files, models
from weftline.sources.fetch import client_for


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftline")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("crawl", help="crawl one site, or those of a seed file")
    c.add_argument("--base")
    c.add_argument("--seed-file")
    c.add_argument("--seed-pack")
    c.add_argument("--out", required=True)
    c.add_argument("--proxy")
    for name, kind in (("max-pages", int), ("batch", int), ("min-words", int), ("delay", float), ("threads", int), ("sample-size", int), ("sample-threshold", int), ("agent", str), ("form", str), ("backend", str), ("crawled-at", str), ("cross-run-hashes", str)):
        c.add_argument(f"--{name}", type=kind)
    for name in ("include-subdomains", "i18n-filter", "prioritize-links", "smart-sample", "title-at-top", "keep-images", "page-files", "dry-run", "resume", "auto-resume"):
        c.add_argument(f"--{name}", action="store_true", default=None)
    for name in ("auto-path-scope", "auto-path-priority", "use-sitemap"):
        c.add_argument(f"--no-{name}", dest=name.replace("-", "_"), action="store_false", default=None)
    c.add_argument("--engine", default="auto", help="auto, httpx or urllib")
    c.add_argument("--browser", help="a client that runs scripts, given as module:function")
    c.add_argument("--screenshots", help="a renderer of pictures, given as module:function")
    c.add_argument("--progress", action="store_true", help="say what each round did")
    for name in ("include-paths", "exclude-paths"):
        c.add_argument(f"--{name}", nargs="+")
    sub.add_parser("seeds", help="names of the seed packs, or the seeds of one").add_argument("name", nargs="?")
    e = sub.add_parser("extract", help="fields of pages by a model, given as module:function")
    e.add_argument("pages", nargs="+")
    e.add_argument("--model", required=True, help="module:function, or provider/model")
    e.add_argument("--flat", action="store_true", help="a column for each field instead of a map")
    e.add_argument("--out", required=True)
    which = e.add_mutually_exclusive_group(required=True)
    which.add_argument("--fields", nargs="+")
    which.add_argument("--auto-fields", default=False, action="store_true")
    k = sub.add_parser("chunk", help="a vector table of pages; the embedder is given as module:function")
    k.add_argument("pages", nargs="+")
    k.add_argument("--out", required=True)
    k.add_argument("--embedder")
    k.add_argument("--max-words", default=400, type=int)
    k.add_argument("--overlap-words", default=50, type=int)
    u = sub.add_parser("upload", help="chunks with vectors to a database by a writer, given as module:function")
    u.add_argument("pages", nargs="+")
    u.add_argument("--writer", required=True)
    u.add_argument("--embedder")
    u.add_argument("--batch", default=50, type=int)
    u.add_argument("--max-words", default=400, type=int)
    u.add_argument("--overlap-words", default=50, type=int)
    v = sub.add_parser("serve", help="tools for agents over standard input and output")
    v.add_argument("--out", required=True)
    v.add_argument("--model", help="module:function, or provider/model")
    s = sub.add_parser("search")
    s.add_argument("pages")
    s.add_argument("query")
    s.add_argument("--most", type=int, default=10)
    sub.add_parser("list").add_argument("pages")
    return p


def named(spec: str):
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)


def model_of(spec: str):
    """module:function, or provider/model."""
    return named(spec) if ":" in spec else models.completer(*spec.split("/", 1))


def main(argv: list[str] | None = None, client=None) -> int:
    a = parser().parse_args(argv)
    if a.command == "seeds":
        print("\n".join(files.seed_pack(a.name) if a.name else files.seed_packs()))
        return 0
    spark = SparkSession.builder.appName("weftline").getOrCreate()
    if a.command == "crawl":
        seeds = [a.base] if a.base else []
        seeds += files.seed_pack(a.seed_pack) if a.seed_pack else []
        seeds += [r[0] for r in files.read_seeds(spark, a.seed_file).collect()] if a.seed_file else []
        if not seeds:
            print("give --base, --seed-file or --seed-pack", file=sys.stderr)
            return 2
        given = {k: tuple(v) if isinstance(v, list) else v for k, v in vars(a).items() if v is not None and k in crawl.Options.__dataclass_fields__}
        options = crawl.Options(**given)
        client = client or client_for(a.engine, agent=options.agent, proxy=a.proxy)
        more = {"browser": named(a.browser) if a.browser else None, "render": named(a.screenshots) if a.screenshots else None, "progress": (lambda m: print(m, file=sys.stderr)) if a.progress else None}
        results = crawl.crawl_sites(spark, seeds, a.out, client, options, **more) if len(seeds) > 1 else {seeds[0]: crawl.crawl(spark, seeds[0], a.out, client, options, **more)}
        failed = 0
        for seed, r in results.items():
            bad = isinstance(r, Exception)
            failed += bad
            print(f"{seed}: {r}" if bad else f"{seed}: {r.pages_saved} pages in {r.out}")
        return int(failed > 0)
    if a.command == "serve":
        agent.serve(agent.tools(spark, a.out, client, model_of(a.model) if a.model else None))
        return 0
    rows = files.read_pages(spark, a.pages)
    if a.command == "extract":
        complete = model_of(a.model)
        names = a.fields or enrich.discover_fields(rows, complete)
        found = enrich.extract_fields(rows, names, complete, model=a.model)
        (enrich.merged(found, names) if a.flat else found).write.mode("overwrite").option("ignoreNullFields", False).json(a.out)
    elif a.command == "chunk":
        enrich.vector_rows(rows, named(a.embedder) if a.embedder else enrich.hashing_embedder, most=a.max_words, overlap=a.overlap_words).write.mode("append").parquet(a.out)
    elif a.command == "upload":
        made = enrich.vector_rows(rows, named(a.embedder) if a.embedder else enrich.hashing_embedder, most=a.max_words, overlap=a.overlap_words)
        print(sum(r[0] for r in enrich.insert(made, named(a.writer), a.batch).collect()), "rows written")
    elif a.command == "search":
        for r in search.keyword_search(rows, a.query, a.most).collect():
            print(f"{r['title'] or 'Untitled'}\n{r['url']}\n{r['snippet']}\n")
    else:
        for r in search.listing(rows).withColumn("host", urls.netloc(F.col("url"))).orderBy("host", "url").toLocalIterator():
            print(f"{r['url']}\t{r['title']}\t{r['words']}")
    return 0


if __name__ == "__main__":
    sys.exit(main())

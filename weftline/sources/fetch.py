"""Fetching pages, images and screenshots through injected clients.

The network is an interface: a client is a function from an address to a Response. Spark
runs it partition by partition; retries are the client's, a repeated task fetches again.
"""

from __future__ import annotations

import asyncio
import importlib.util
import os
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Awaitable, Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.errors import ConfigurationError, DependencyError
from weftline.functions import text, urls
from weftline.streaming import throttle

RETRIED = frozenset((504, 503, 502, 500, 429))
WEB = "url string, ok boolean, status int, content_type string, html string, elapsed_ms double"


@dataclass
class Response:
    status: int
    body: bytes = b""
    headers: dict[str, str] = field(default_factory=dict)
    elapsed_ms: float = 0.0

    @property
    def ok(self) -> bool:
        return 200 <= self.status < 400

    @property
    def content_type(self) -> str:
        return next((v for k, v in self.headers.items() if k.lower() == "content-type"), "")

    @property
    def text(self) -> str:
        """UTF-8 where the bytes are, else the declared charset, else Latin-1."""
        declared = self.content_type.lower().rpartition("charset=")[2].strip(" \"'") if "charset=" in self.content_type.lower() else "latin-1"
        for charset in ("utf-8", declared):
            try:
                return self.body.decode(charset)
            except (UnicodeDecodeError, LookupError):
                continue
        return self.body.decode("latin-1")


Client = Callable[[str], Response]


def with_retries(client: Client, times: int = 3, pause: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], Response | None]:
    """The client, asked again after 429 and server errors with doubling pauses; an error of
    the last try gives None, its response is given as it is."""

    def get(url: str) -> Response | None:
        for n in range(times + 1):
            try:
                r = client(url)
            except (OSError, ValueError):
                r = None
            if (r is not None and r.status not in RETRIED) or n == times:
                return r
            sleep(pause * 2**n)
        return None

    return get


def urllib_client(agent: str = "weftline", timeout: float = 15, proxy: str | None = None) -> Client:
    """A client on the standard library; made where it is used, so that it needn't be shipped."""

    def get(url: str) -> Response:
        opener = urllib.request.build_opener(*([urllib.request.ProxyHandler({"http": proxy, "https": proxy})] if proxy else []))
        began = time.monotonic()
        try:
            with opener.open(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as r:
                return Response(r.status, r.read(), dict(r.headers), (time.monotonic() - began) * 1000)
        except urllib.error.HTTPError as e:
            return Response(e.code, e.read(), dict(e.headers), (time.monotonic() - began) * 1000)

    return get


def httpx_client(agent: str = "weftline", timeout: float = 15, proxy: str | None = None) -> Client:
    """A client with pooled connections, and HTTP/2 where its package is there; one pool a process."""
    pool: list = []

    def get(url: str) -> Response:
        import httpx

        if not pool:
            options = {"follow_redirects": True, "headers": {"User-Agent": agent}, "proxy": proxy, "timeout": timeout}
            try:
                pool.append(httpx.Client(http2=True, **options))
            except ImportError:  # its HTTP/2 package isn't there
                pool.append(httpx.Client(**options))
        began = time.monotonic()
        try:
            r = pool[0].get(url)
        except httpx.HTTPError as e:
            raise OSError(str(e)) from e
        return Response(r.status_code, r.content, dict(r.headers), (time.monotonic() - began) * 1000)

    return get


def blocking(get: Callable[[str], Awaitable[Response]]) -> Client:
    """A coroutine function as a client: each thread of a task runs its own requests' loop."""

    def run(url: str) -> Response:
        return asyncio.run(get(url))

    return run


ENGINES = {"httpx": httpx_client, "urllib": urllib_client}


def client_for(engine: str = "auto", **options) -> Client:
    """A client by the name of its engine; auto takes httpx where it is installed."""
    if engine == "auto":
        engine = "httpx" if importlib.util.find_spec("httpx") else "urllib"
    if engine not in ENGINES:
        raise ConfigurationError(f"engine is auto, {' or '.join(ENGINES)}")
    if engine == "httpx" and not importlib.util.find_spec("httpx"):
        raise DependencyError("httpx isn't installed")
    return ENGINES[engine](**options)


PACE = "host string, pace_n int, pace_delay double, pace_memory int, pace_times array<double>"


def fetched(frontier: DataFrame, client: Client, threads: int = 4, delay: float = 0.0, retries: int = 3, pause: float = 0.5, paces: dict[str, tuple] | None = None) -> DataFrame:
    """Rows url, ok, status, content_type, html, elapsed_ms of the frontier's addresses; those
    that can't be had have ok false and nulls. With `paces` also the host and its pace after
    the answer (see paces_of), to begin the next round with.

    The addresses are split by host, so that one task asks a host, and its requests begin at
    least the host's delay apart: `delay`, longer after 429 and slow answers. Retries take a
    turn like other requests. Without any delay a host is asked by `threads` at a time."""
    hosts = urls.netloc(F.col("url"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[str, throttle.Pace] = {}

        def one(url: str, host: str):
            pace = own[host]

            def asked(u: str) -> Response:
                pace.turn()
                r = client(u)
                pace.answered(r.status, r.elapsed_ms / 1000)
                return r

            r = with_retries(asked, retries, pause)(url)
            found = (url, False, None, None, None, None) if r is None else (url, r.ok, r.status, r.content_type, r.text if r.ok else None, r.elapsed_ms)
            return (*found, host)

        with ThreadPoolExecutor(max(1, threads)) as pool:
            for b in batches:
                for h in b["host"].unique():
                    own.setdefault(h, throttle.Pace(delay, (paces or {}).get(h)))
                out = pd.DataFrame(list(pool.map(one, b["url"], b["host"])), columns=[*(f.split()[0] for f in WEB.split(", ")), "host"]).astype({"status": "Int32", "elapsed_ms": "float64"})
                now = [own[h].state for h in out["host"]]
                yield out.assign(pace_n=[own[h].answers for h in out["host"]], pace_delay=[float(x[0]) for x in now], pace_memory=[x[1] for x in now], pace_times=[list(x[2]) for x in now])

    spread = frontier.select("url", hosts.alias("host")).repartition("host")
    web = spread.mapInPandas(run, f"{WEB}, {PACE}")
    return web if paces is not None else web.drop("host", "pace_n", "pace_delay", "pace_memory", "pace_times")


def paces_of(web: DataFrame) -> dict[str, tuple]:
    """{host: pace} after a round, one of as many hosts as a site has. Hosts are asked by one
    task each, whose last batch has seen the most answers."""
    last = web.groupBy("host").agg(F.max_by(F.struct("pace_delay", "pace_memory", "pace_times"), "pace_n").alias("p"))
    return {r["host"]: (r["p"]["pace_delay"], r["p"]["pace_memory"], list(r["p"]["pace_times"])) for r in last.collect()}


def needs_browser(client: Client, url: str, look: Callable[[str], bool]) -> bool:
    """Whether the first 50000 characters of a page look like a client-side app's shell; no
    for pages that can't be had."""
    try:
        r = client(url)
    except (OSError, ValueError):
        return False
    return r.status < 400 and look(r.text[:50_000])


def image_kept(status, content_type, size, least: int = 5000):
    """Column: whether a fetched image is stored."""
    kind = F.coalesce(content_type, F.lit(""))
    return (status < 400) & (size >= least) & ((kind == "") | kind.startswith("image/"))


def stored_images(pages: DataFrame, client: Client, folder: str, least: int = 5000, markdown: str = "content") -> DataFrame:
    """(url, file) of the images that the Markdown refers to, each fetched once and written
    to the shared folder under its own name; small, failed and other files are left out."""
    refs = pages.select(F.explode(text.image_references(F.col(markdown))).alias("r")).select("r.url").distinct()
    named = refs.select("url", urls.image_filename(F.col("url")).alias("file"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = with_retries(client, 0)
        for b in batches:
            out = []
            for url, file in zip(b["url"], b["file"]):
                r = get(url)
                if r is None or r.status >= 400 or len(r.body) < least or (r.content_type and not r.content_type.startswith("image/")):
                    continue
                os.makedirs(folder, exist_ok=True)
                part = os.path.join(folder, f".{uuid.uuid4().hex}")
                with open(part, "wb") as f:
                    f.write(r.body)
                os.replace(part, os.path.join(folder, file))
                out.append((url, file))
            yield pd.DataFrame(out, columns=["url", "file"])

    return named.mapInPandas(run, "url string, file string")


@dataclass
class Shot:
    """Options of a screenshot; a renderer gets them with the address and returns bytes."""

    width: int = 1920
    height: int = 1080
    full_page: bool = True
    selector: str | None = None
    form: str = "png"
    wait_ms: int = 1500
    quality: int = 85


def screenshots(pages: DataFrame, render: Callable[[str, Shot], bytes], folder: str, shot: Shot | None = None) -> DataFrame:
    """(url, screenshot, screenshot_error): the file's name, or what went wrong; nothing is
    left of a failed one."""
    shot = shot or Shot()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for url, file in zip(b["url"], b["file"]):
                try:
                    body = render(url, shot)
                    os.makedirs(folder, exist_ok=True)
                    part = os.path.join(folder, f".{uuid.uuid4().hex}")
                    with open(part, "wb") as f:
                        f.write(body)
                    os.replace(part, os.path.join(folder, file))
                    out.append((url, file, None))
                except Exception as e:  # a renderer may fail in any way; the page goes on without its picture
                    out.append((url, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["url", "screenshot", "screenshot_error"])

    named = pages.select("url", urls.screenshot_filename(F.col("url"), "jpg" if shot.form == "jpeg" else shot.form).alias("file"))
    return named.mapInPandas(run, "url string, screenshot string, screenshot_error string")

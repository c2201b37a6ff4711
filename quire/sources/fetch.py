"""Fetching pages: cache, robots, politeness and retries around a transport given by the caller.

Pages of one host go to one task, so its pace holds over the cluster; the hosts spread over tasks.
A host with very many pages is one task's work by intent: politeness bounds it, not the cluster.
"""

from __future__ import annotations

import random
import time
import urllib.parse
import urllib.robotparser
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.url import netloc
from quire.session import slices

# Pace and patience.
DELAY, JITTER, RETRIES, LONGEST_WAIT, LONGEST_BACKOFF, LONGEST_PAUSE = 0.6, 0.3, 2, 60.0, 20.0, 30.0
FINAL = (401, 403, 404, 410, 451)
BUSY = (429, 503)
#: Pages held by a task before they are handed on.
PAGES = 50
IMAGE_MOST, IMAGE_LEAST = 12 * 1024 * 1024, 512
SCHEMA = "url string, ok boolean, status int, text string, content binary, content_type string, from_cache boolean, attempts int, error string, elapsed double"


@dataclass
class Answer:
    """What a transport returns for one request."""

    status: int
    text: str = ""
    content: bytes = b""
    content_type: str = ""
    retry_after: str = ""


Transport = Callable[[str], Answer]


def wait_before_retry(attempt: int, status: int | None, retry_after: str = "", spread: float = 0.0) -> float | None:
    """Seconds to wait after a failed attempt (from 1); None if another is useless."""
    if status in FINAL:
        return None
    if status in BUSY:
        given = retry_after.replace(".", "", 1)
        return min(float(retry_after) if given.isdigit() else float(2**attempt), LONGEST_WAIT)
    return min(2 ** (attempt - 1) + spread, LONGEST_BACKOFF)


class Pace:
    """At least `delay` plus jitter between two requests to a host."""

    def __init__(self, delay: float = DELAY, jitter: float = JITTER, clock=time.monotonic, sleep=time.sleep):
        self.delay, self.jitter, self.clock, self.sleep = delay, jitter, clock, sleep
        self.next: dict[str, float] = {}

    def wait(self, url: str) -> None:
        host = urllib.parse.urlsplit(url).netloc
        now = self.clock()
        left = self.next.get(host, now) - now
        if left > 0:
            self.sleep(min(left, LONGEST_PAUSE))
        self.next[host] = max(now, self.next.get(host, now)) + self.delay + random.uniform(0, self.jitter)


class Robots:
    """robots.txt, read once an origin; without one, everything is allowed."""

    def __init__(self, transport: Transport, agent: str = "*"):
        self.transport, self.agent = transport, agent
        self.known: dict[str, urllib.robotparser.RobotFileParser | None] = {}

    def allows(self, url: str) -> bool:
        p = urllib.parse.urlsplit(url)
        origin = f"{p.scheme}://{p.netloc}"
        if origin not in self.known:
            rules = None
            try:
                a = self.transport(f"{origin}/robots.txt")
                if a.status == 200:
                    rules = urllib.robotparser.RobotFileParser()
                    rules.parse(a.text.splitlines())
            except Exception:  # noqa: BLE001  no answer allows
                rules = None
            self.known[origin] = rules
        rules = self.known[origin]
        return rules is None or rules.can_fetch(self.agent, url)


def fetch_one(url: str, transport: Transport, pace: Pace, robots: Robots | None = None, retries: int = RETRIES, sleep=time.sleep) -> dict:
    """One page after at most `retries` + 1 attempts; an exhausted one has status 0 and the last error."""
    row = {"url": url, "ok": False, "status": 0, "text": "", "content": b"", "content_type": "", "from_cache": False, "attempts": 0, "error": "", "elapsed": 0.0}
    if robots is not None and not robots.allows(url):
        return row | {"error": "robots.txt 不允许抓取"}
    began, last = time.monotonic(), "抓取失败"
    for n in range(1, retries + 2):
        pace.wait(url)
        status, after = None, ""
        try:
            a = transport(url)
            status, after = a.status, a.retry_after
            if status == 200:
                return row | {"ok": True, "status": 200, "text": a.text, "content": a.content, "content_type": a.content_type, "attempts": n, "elapsed": time.monotonic() - began}
            last = f"HTTP {status}"
        except Exception as e:  # noqa: BLE001  a transport may fail in any way
            last = f"{type(e).__name__}: {e}"
        pause = wait_before_retry(n, status, after, random.uniform(0, 0.5))
        if pause is None:
            return row | {"status": status, "error": last, "attempts": n, "elapsed": time.monotonic() - began}
        if n <= retries or status in BUSY:
            sleep(pause)
    return row | {"error": last, "attempts": retries + 1, "elapsed": time.monotonic() - began}


def cache_key(url: Column, kind: str = "html") -> Column:
    return F.concat(F.substring(F.sha1(url), 1, 16), F.lit(f".{kind}"))


def fetch(items: DataFrame, transport: Transport, cache: DataFrame | None = None, robots: bool = True, retries: int = RETRIES, delay: float = DELAY, jitter: float = JITTER, url: str = "url") -> DataFrame:
    """SCHEMA for the distinct addresses of `items`; those in `cache` (the same columns) aren't fetched."""
    urls = items.select(F.col(url).alias("url")).where("url IS NOT NULL").distinct()
    hit = None
    if cache is not None:
        hit = cache.where("ok").join(urls, "url", "left_semi").withColumn("from_cache", F.lit(True)).select(*[p.split()[0] for p in SCHEMA.split(", ")])
        urls = urls.join(cache.where("ok").select("url"), "url", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace, rules = Pace(delay, jitter), Robots(transport) if robots else None
        for pdf in slices(batches, PAGES):
            yield pd.DataFrame([fetch_one(u, transport, pace, rules, retries) for u in pdf["url"]], columns=[p.split()[0] for p in SCHEMA.split(", ")])

    got = urls.withColumn("host", netloc(F.col("url"))).repartition("host").select("url").mapInPandas(run, SCHEMA)
    return got if hit is None else hit.unionByName(got)


# Extensions by media type.
EXTENSIONS = {
    "image/jpeg": ".jpg", "image/jpg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/webp": ".webp", "image/svg+xml": ".svg", "image/avif": ".avif", "image/bmp": ".bmp",
}
KNOWN = r"(?i)\.(jpg|jpeg|png|gif|webp|svg|avif|bmp)$"


def image_problem(ok: Column, status: Column, error: Column, content: Column, most: int = IMAGE_MOST, least: int = IMAGE_LEAST) -> Column:
    """Why a fetched image can't be used; NULL if it can."""
    n = F.coalesce(F.length(content), F.lit(0))
    svg = F.coalesce(F.substring(content, 1, 4) == F.lit(b"<svg"), F.lit(False))
    failed = F.when(F.lower(F.coalesce(error, F.lit(""))).contains("robots"), "robots").when(F.coalesce(status, F.lit(0)) > 0, F.concat(F.lit("http-"), status.cast("string"))).otherwise("network")
    return F.when(~F.coalesce(ok, F.lit(False)) | (n == 0), failed).when(n > most, "too_big").when((n < least) & ~svg, "too_small")


def image_extension(url: Column, content_type: Column) -> Column:
    """By media type, then by the path, else .jpg."""
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    kind = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    path = F.regexp_extract(url, r"^[^?#]*", 0)
    return F.coalesce(F.try_element_at(table, kind), F.when(path.rlike(KNOWN), F.lower(F.regexp_extract(path, r"(\.[A-Za-z]+)$", 1))), F.lit(".jpg"))


def stored_images(images: DataFrame, seq: str = "seq") -> DataFrame:
    """(url, problem, name): the name under which each image is stored; equal contents share the first one's."""
    from quire.operators.articles import unique_slugs
    from quire.functions.text import safe_filename

    i = images.withColumn("problem", image_problem(F.col("ok"), F.col("status"), F.col("error"), F.col("content")))
    good = i.where("problem IS NULL").withColumn("hash", F.sha1("content")).withColumn("ext", image_extension(F.col("url"), F.col("content_type")))
    first = good.groupBy("hash").agg(F.min_by(F.struct("url", "ext", F.col(seq).alias("seq")), F.col(seq)).alias("v")).select("hash", "v.*")
    stem = safe_filename(F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]+/(?:[^?#]*/)?([^/?#]*?)(?:\.[A-Za-z0-9]+)?(?:[?#].*)?$", 1), 48)
    plain = F.when(stem.isin("", "image", "untitled"), F.concat(F.lit("img-"), F.substring(F.sha1("url"), 1, 8))).otherwise(stem)
    named = unique_slugs(first.withColumn("slug", F.lower(plain)), "slug", "seq", "stem").select("hash", F.concat("stem", "ext").alias("name"))
    out = good.join(named, "hash").select("url", "problem", "name")
    return out.unionByName(i.where("problem IS NOT NULL").select("url", "problem", F.lit(None).cast("string").alias("name")))


def rewrite_images(texts: DataFrame, refs: DataFrame, stored: DataFrame, key: str = "id", text: str = "markdown", prefix: str = "assets/") -> DataFrame:
    """`texts` with image placeholders replaced: by the stored name, or by the address where there is none.

    `refs` (key, placeholder, url) are a text's placeholders, a bounded number a text.
    """
    s = stored.where("name IS NOT NULL").select(F.col("url").alias("_u"), F.col("name").alias("_n"))
    to = F.coalesce(F.concat(F.lit(prefix), F.col("_n")), F.col("url"))
    m = refs.join(s, refs.url == F.col("_u"), "left").groupBy(key).agg(F.collect_list(F.struct(F.col("placeholder").alias("p"), to.alias("t"))).alias("_m"))
    done = F.aggregate(F.coalesce("_m", F.array().cast("array<struct<p:string,t:string>>")), F.col(text), lambda acc, x: F.replace(acc, x["p"], x["t"]))
    return texts.join(m, key, "left").withColumn(text, done).drop("_m")


def http_transport(agent: str = "quire/1.0", timeout: float = 20.0) -> Transport:
    """A transport over the standard library."""

    def get(url: str) -> Answer:
        import urllib.error
        import urllib.request

        from quire.html.meta import decode

        request = urllib.request.Request(url, headers={"User-Agent": agent})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as r:  # noqa: S310
                raw, kind = r.read(), r.headers.get("Content-Type", "")
                name = r.headers.get_content_charset()
                try:
                    text = raw.decode(name) if name else decode(raw)
                except (LookupError, UnicodeDecodeError):
                    text = decode(raw)
                return Answer(r.status, "" if kind.startswith("image/") else text, raw, kind)
        except urllib.error.HTTPError as e:
            return Answer(e.code, retry_after=e.headers.get("Retry-After", "") if e.headers else "")

    return get


def shrink_image(content: bytes, ext: str, max_width: int, quality: int = 80) -> tuple[bytes, str]:
    """An image no wider than `max_width`, if that makes it smaller; as it is without the imaging library, and for vector or moving ones."""
    if ext in (".svg", ".avif") or max_width <= 0:
        return content, ext
    try:
        import io

        from PIL import Image

        im = Image.open(io.BytesIO(content))
        if getattr(im, "n_frames", 1) > 1:
            return content, ext
        if im.width > max_width:
            im = im.resize((max_width, max(1, round(im.height * max_width / im.width))), Image.LANCZOS)
        clear = im.mode in ("RGBA", "LA") or "transparency" in im.info
        out = io.BytesIO()
        im.convert("RGBA" if clear else "RGB").save(out, "PNG" if clear else "JPEG", optimize=True, quality=quality)
        return (out.getvalue(), ".png" if clear else ".jpg") if out.tell() < len(content) else (content, ext)
    except Exception:  # noqa: BLE001  what can't be read stays
        return content, ext


def shrunk(images: DataFrame, max_width: int) -> DataFrame:
    """`images` (ok, url, content, content_type) no wider than `max_width` where that saves bytes, with `saved`, the bytes it saved."""
    ext = image_extension(F.col("url"), F.col("content_type"))

    @F.pandas_udf("content binary, ext string")
    def run(raw: pd.Series, e: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shrink_image(bytes(c), x, max_width) if c is not None else (None, x) for c, x in zip(raw, e)], columns=["content", "ext"])

    got = images.withColumn("_e", ext).withColumn("_s", run("content", "_e"))
    kind = F.when(F.col("_s.ext") != F.col("_e"), F.when(F.col("_s.ext") == ".png", "image/png").otherwise("image/jpeg")).otherwise(F.col("content_type"))
    saved = F.coalesce(F.length("content") - F.length("_s.content"), F.lit(0)).cast("long")
    return got.withColumn("saved", saved).withColumn("content", F.col("_s.content")).withColumn("content_type", kind).drop("_e", "_s")


def image_stats(images: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: images asked for, stored, deduplicated (equal to another), failed, shrunk, and bytes saved. `images` (url, saved) may lack `saved`."""
    s = stored.agg(F.count("*").alias("images"), F.count_distinct("name").alias("stored"), F.count("name").alias("_good"), F.count("problem").alias("failed"))
    saved = F.col("saved") if "saved" in images.columns else F.lit(0).cast("long")
    i = images.agg(F.count_if(saved > 0).alias("shrunk"), F.coalesce(F.sum(saved), F.lit(0)).alias("saved_bytes"))
    return s.crossJoin(F.broadcast(i)).select("images", "stored", (F.col("_good") - F.col("stored")).alias("deduplicated"), "failed", "shrunk", "saved_bytes")

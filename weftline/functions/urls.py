"""URL functions as Column expressions: Column in, Column out, no Python in the plan.

A null URL gives null (predicates: null, which a filter drops). Parts follow RFC 3986
appendix B, so that a URL that strict parsers refuse still has a path and a query.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
UNSAFE = "[^0-9A-Za-z_.-]+"
LANGUAGES = "ar bg bn ca cs da de el en es et fa fi fr he hi hr hu id it ja ko lt lv ms nb nl no pl pt ro ru sk sl sr sv th tr uk vi zh".split()
PRIMARY = ("en", "en-au", "en-ca", "en-gb", "en-us", "en_gb", "en_us")
LOCALE = "^[a-z]{2}([-_][a-z]{2,4})?$"
WIKIS = ("wiki", "wikipedia")
SHELVES = ("cat", "categories", "category", "collections", "products", "shop")
DOCLIKE = ("api", "article", "blog", "doc", "docs", "getting-started", "guide", "learn", "manual", "post", "reference", "tutorial")
HTMLLIKE = ("", "asp", "aspx", "htm", "html", "jsp", "php")


def part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, PARTS, k)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def netloc(url: Column) -> Column:
    """Host with port and user, in lower case; "" if there is none."""
    return F.lower(part(url, 2))


def path(url: Column) -> Column:
    return part(url, 3)


def query(url: Column) -> Column:
    return part(url, 4)


def normalized(url: Column) -> Column:
    """Scheme and host in lower case, an empty path as /, sorted query parameters, no fragment, single slashes."""
    q = F.array_join(F.array_sort(F.split(query(url), "&")), "&")
    whole = F.concat(
        F.when(scheme(url) != "", F.concat(scheme(url), F.lit(":"))).otherwise(""),
        F.when(netloc(url) != "", F.concat(F.lit("//"), netloc(url))).otherwise(""),
        F.when(path(url) == "", "/").otherwise(path(url)),
        F.when(query(url) != "", F.concat(F.lit("?"), q)).otherwise(""),
    )
    return F.when(url.isNotNull(), F.regexp_replace(whole, "(?<!:)//+", "/"))


def in_scope(url: Column, base_netloc: Column | str, subdomains: bool = False) -> Column:
    """Whether the host, port included, is that of the base or, on request, lies under it."""
    base = F.lower(F.lit(base_netloc) if isinstance(base_netloc, str) else base_netloc)
    same = netloc(url) == base
    return same | F.endswith(netloc(url), F.concat(F.lit("."), base)) if subdomains else same


def dashed(text: Column, most: int, default: str) -> Column:
    """Runs of characters that file names can't hold become dashes, none at the ends."""
    stub = F.regexp_replace(F.substring(F.regexp_replace(text, UNSAFE, "-"), 1, most), "^-+|-+$", "")
    return F.when(stub == "", default).otherwise(stub)


def page_filename(url: Column, extension: str = "md") -> Column:
    """stub__query__hash.extension; stub is index for the root."""
    inner = F.regexp_replace(path(url), "^/+|/+$", "")
    stub = F.when(inner == "", "index").otherwise(dashed(inner, 120, "page"))
    q = dashed(query(url), 40, "")
    return F.concat(stub, F.when(q != "", F.concat(F.lit("__"), q)).otherwise(""), F.lit("__"), F.substring(F.sha1(url.cast("binary")), 1, 10), F.lit(f".{extension}"))


def basename(url: Column) -> Column:
    return F.substring_index(F.regexp_replace(path(url), "/+$", ""), "/", -1)


def image_filename(url: Column) -> Column:
    """stub-hash.ext; an extension that is missing or over 6 characters (dot included) becomes .img."""
    base = basename(url)
    ext = F.regexp_extract(base, r"[^.].*(\.[^.]*)$", 1)
    ext = F.when((ext == "") | (F.length(ext) > 6), ".img").otherwise(ext)
    plain = F.regexp_replace(base, r"\.[^.]*$", "")
    return F.concat(dashed(plain, 80, "image"), F.lit("-"), F.substring(F.sha1(url.cast("binary")), 1, 12), ext)


def screenshot_filename(url: Column, extension: str = "png") -> Column:
    base = F.when(basename(url) != "", basename(url)).when(part(url, 2) != "", part(url, 2)).otherwise("page")
    return F.concat(dashed(base, 80, "page"), F.lit("-"), F.substring(F.sha1(url.cast("binary")), 1, 12), F.lit("." + extension.lstrip(".")))


def segments(url: Column, params: bool = False) -> Column:
    """The non-empty parts of the path; without ;parameters of the last unless params."""
    p = path(url) if params else F.regexp_replace(path(url), ";[^/]*$", "")
    return F.filter(F.split(p, "/"), lambda s: s != "")


def language(locale: Column) -> Column:
    """en of en-US or en_us."""
    return F.substring_index(F.substring_index(F.lower(locale), "-", 1), "_", 1)


def locale_segment(url: Column) -> Column:
    """The locale among the first two path segments, in lower case, else null. What follows a
    locale must not be a number."""
    segs = segments(url)

    def at(i: int) -> Column:
        low, after = F.lower(F.get(segs, F.lit(i))), F.get(segs, F.lit(i + 1))
        return F.when(low.rlike(LOCALE) & language(low).isin(LANGUAGES) & ~F.coalesce(after.rlike("^[0-9]+$"), F.lit(False)), low)

    return F.coalesce(at(0), at(1))


def foreign_locale(url: Column, primary: tuple[str, ...] = PRIMARY) -> Column:
    """Whether the URL is of a locale whose language is not that of a primary one."""
    loc = locale_segment(url)
    bases = sorted({re.split("[-_]", p.lower())[0] for p in primary})
    return F.when(url.isNotNull(), F.coalesce(~loc.isin(list(primary)) & ~language(loc).isin(bases), F.lit(False)))


def stripped_path(url: Column) -> Column:
    return F.regexp_replace(path(url), "^/+|/+$", "")


def section(url: Column) -> Column:
    """/first/* for a path of two segments or more, else /first; the host doesn't count."""
    parts = F.split(stripped_path(url), "/")
    return F.concat(F.lit("/"), F.get(parts, F.lit(0)), F.when(F.size(parts) > 1, "/*").otherwise(""))


def first_segment(url: Column) -> Column:
    return F.concat(F.lit("/"), F.substring_index(stripped_path(url), "/", 1))


def path_scope(seed: Column) -> Column:
    """Glob of the part of the site that a seed stands for, or null for the whole site."""
    raw = segments(seed, params=True)
    low = F.transform(raw, F.lower)
    deepest = F.array_max(F.filter(F.transform(low, lambda s, i: F.when(s.isin(list(SHELVES)), i)), lambda i: i.isNotNull()))
    p = F.regexp_replace(path(seed), "/+$", "")
    file = F.lower(F.substring_index(p, "/", -1)).rlike(r"\.(html?|php|aspx?|jsp)$")
    parent = F.when(file, F.regexp_replace(p, "[^/]*$", "")).otherwise(path(seed))
    bare = F.filter(F.split(F.regexp_replace(parent, r"/index(\.html?|\.php)?$", ""), "/"), lambda s: s != "")
    glob = lambda parts: F.concat(F.lit("/"), F.array_join(parts, "/"), F.lit("/*"))
    return (
        F.when(F.get(low, F.lit(0)).isin(list(WIKIS)) | (deepest == 0), F.lit(None).cast("string"))
        .when(deepest > 0, glob(F.slice(raw, F.lit(1), deepest)))
        .when(F.size(bare) >= 2, glob(bare))
    )


def path_priority(url: Column, seed: Column) -> Column:
    """Share of the seed's path segments that the URL's path begins with; 0 without any."""
    own, base = segments(url, params=True), segments(seed, params=True)
    common = F.aggregate(
        F.zip_with(own, base, lambda a, b: F.coalesce(a == b, F.lit(False))),
        F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")),
        lambda s, same: F.struct((s["on"] & same).alias("on"), (s["n"] + F.when(s["on"] & same, 1).otherwise(0)).alias("n")),
        lambda s: s["n"],
    )
    return F.when(F.size(base) > 0, common / F.size(base)).when(url.isNotNull(), F.lit(0.0))


def glob_regex(glob: str) -> str:
    """Anchored regex of a shell glob, for Java and RE2: * crosses slashes, [!x] negates."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2 + glob.startswith("!", i + 1)) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("^", "\\^").replace("&&", "&\\&")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}\\z"


def path_excluded(url: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), seeds: tuple[str, ...] = (), i18n: bool = False) -> Column:
    """Foreign locales go first (on request), then excluded globs, then what no included glob
    matches unless it is a seed."""
    p = path(url)
    any_of = lambda globs: F.lit(False) if not globs else p.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs))
    out = any_of(exclude)
    if i18n:
        out = foreign_locale(url) | out
    return out | (~any_of(include) & ~(url.isin(list(seeds)) if seeds else F.lit(False))) if include else out


def citation(title: Column, url: Column, day: Column) -> Column:
    """Title. Site. Available at: URL [Accessed Month day, year]."""
    name = F.when(F.coalesce(title, F.lit("")) == "", "Untitled").otherwise(title)
    return F.concat(name, F.lit(". "), part(url, 2), F.lit(". Available at: "), url, F.lit(" [Accessed "), F.date_format(day, "MMMM dd, yyyy"), F.lit("]."))


def site_directory(url: Column) -> Column:
    host = F.substring_index(netloc(url), ":", 1)
    return F.when(host == "", "unknown").otherwise(host)


def slug(url: Column) -> Column:
    """Scheme stripped, slashes as underscores, 50 characters."""
    return F.substring(F.replace(F.regexp_replace(url, "^https?://", ""), F.lit("/"), F.lit("_")), 1, 50)


def yield_score(url: Column, average: Column) -> Column:
    """Expected words of an unseen page: the section's average (200 where null), less 5 % a
    level of depth (30 % left at least), 1.3 times it in documentation-like paths; files of
    other kinds than web pages have a tenth of the average."""
    p = stripped_path(url)
    parts = F.split(p, "/")
    depth = F.when(p == "", 0).otherwise(F.size(parts))
    base = F.coalesce(average.cast("double"), F.lit(200.0))
    bonus = F.when(F.arrays_overlap(F.split(F.lower(p), "/"), F.array(*map(F.lit, DOCLIKE))), 1.3).otherwise(1.0)
    last = F.substring_index(p, "/", -1)
    other = F.contains(last, F.lit(".")) & ~F.lower(F.substring_index(last, ".", -1)).isin(list(HTMLLIKE))
    return F.when(other, base * 0.1).when(url.isNotNull(), base * F.greatest(F.lit(0.3), 1.0 - depth * F.lit(0.05)) * bonus)

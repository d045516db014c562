"""Pieces of DuckDB SQL that the oracles share."""

from __future__ import annotations

# The SQL has its own constants, so that a wrong one in the code shows.
LANGUAGES = "ar bg bn ca cs da de el en es et fa fi fr he hi hr hu id it ja ko lt lv ms nb nl no pl pt ro ru sk sl sr sv th tr uk vi zh".split()
PRIMARY = ("en", "en-au", "en-ca", "en-gb", "en-us", "en_gb", "en_us")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))

RE = "^(?:([A-Za-z][A-Za-z0-9+.\\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?"


def part(u: str, k: int) -> str:
    return f"regexp_extract({u}, '{RE}', {k})"


def scheme(u: str) -> str:
    return f"lower({part(u, 1)})"


def netloc(u: str) -> str:
    return f"lower({part(u, 2)})"


def path(u: str) -> str:
    return part(u, 3)


def query(u: str) -> str:
    return part(u, 4)


def normalized(u: str) -> str:
    q = f"array_to_string(list_sort(string_split({query(u)}, '&')), '&')"
    whole = f"""(CASE WHEN {scheme(u)} <> '' THEN {scheme(u)} || ':' ELSE '' END || CASE WHEN {netloc(u)} <> '' THEN '//' || {netloc(u)} ELSE '' END
      || CASE WHEN {path(u)} = '' THEN '/' ELSE {path(u)} END || CASE WHEN {query(u)} <> '' THEN '?' || {q} ELSE '' END)"""
    return f"regexp_replace({whole}, '([^:/])/{{2,}}', '\\1/', 'g')"


def dashed(t: str, most: int, default: str) -> str:
    stub = f"trim(left(regexp_replace({t}, '[^0-9A-Za-z_.-]+', '-', 'g'), {most}), '-')"
    return f"CASE WHEN {stub} = '' THEN '{default}' ELSE {stub} END"


def stripped_path(u: str) -> str:
    return f"trim({path(u)}, '/')"


def page_filename(u: str, ext: str = "md") -> str:
    inner, q = stripped_path(u), dashed(query(u), 40, "")
    return f"""(CASE WHEN {inner} = '' THEN 'index' ELSE {dashed(inner, 120, 'page')} END || CASE WHEN ({q}) <> '' THEN '__' || ({q}) ELSE '' END || '__' || left(sha1({u}), 10) || '.{ext}')"""


def basename(u: str) -> str:
    return f"regexp_extract(rtrim({path(u)}, '/'), '[^/]*$')"


def image_filename(u: str) -> str:
    ext = f"regexp_extract({basename(u)}, '[^.].*(\\.[^.]*)$', 1)"
    plain = f"regexp_replace({basename(u)}, '\\.[^.]*$', '')"
    return f"(({dashed(plain, 80, 'image')}) || '-' || left(sha1({u}), 12) || CASE WHEN {ext} = '' OR length({ext}) > 6 THEN '.img' ELSE {ext} END)"


def screenshot_filename(u: str) -> str:
    base = f"CASE WHEN {basename(u)} <> '' THEN {basename(u)} WHEN {part(u, 2)} <> '' THEN {part(u, 2)} ELSE 'page' END"
    return f"(({dashed(f'({base})', 80, 'page')}) || '-' || left(sha1({u}), 12) || '.png')"


def segments(u: str, params: bool = False) -> str:
    p = path(u) if params else f"regexp_replace({path(u)}, ';[^/]*$', '')"
    return f"list_filter(string_split({p}, '/'), lambda s: s <> '')"


def language(x: str) -> str:
    return f"split_part(split_part(lower({x}), '-', 1), '_', 1)"


def quoted(items) -> str:
    return ", ".join(f"'{i}'" for i in items)


def locale(u: str) -> str:
    s = segments(u)

    def at(i: int) -> str:
        low = f"lower(({s})[{i}])"
        return f"CASE WHEN regexp_matches({low}, '^[a-z]{{2}}([-_][a-z]{{2,4}})?$') AND {language(low)} IN ({quoted(LANGUAGES)}) AND NOT coalesce(regexp_matches(({s})[{i + 1}], '^[0-9]+$'), false) THEN {low} END"

    return f"coalesce({at(1)}, {at(2)})"


def foreign(u: str) -> str:
    return f"coalesce({locale(u)} NOT IN ({quoted(PRIMARY)}) AND {language(locale(u))} <> 'en', false)"


def section(u: str) -> str:
    parts = f"string_split({stripped_path(u)}, '/')"
    return f"('/' || ({parts})[1] || CASE WHEN len({parts}) > 1 THEN '/*' ELSE '' END)"


def first_segment(u: str) -> str:
    return f"('/' || split_part({stripped_path(u)}, '/', 1))"


WORDS = "list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> '')"


def words(t: str) -> str:
    return WORDS.format(t)


def n_words(t: str) -> str:
    return f"len({words(t)})::BIGINT"


def visible(h: str) -> str:
    for p in ("(?is)<script\\b[^>]*>.*?</script>", "(?is)<style\\b[^>]*>.*?</style>", "<[^>]+>", "\\s+"):
        h = f"regexp_replace({h}, '{p}', ' ', 'g')"
    return f"trim({h})"


def title(h: str) -> str:
    found = f"regexp_extract({h}, '(?is)<title[^>]*>([^<]*)</title>', 1)"
    for entity, sign in ENTITIES:
        found = f"replace({found}, '{entity}', '{sign.replace(chr(39), chr(39) * 2)}')"
    return f"trim({found})"


def article(h: str) -> str:
    """Visible text of the article."""
    return visible(f"regexp_extract({h}, '(?is)<article\\b[^>]*>(.*?)(?:</article>|$)', 1)")


LINKS = """
SELECT DISTINCT page_id, url, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN href LIKE '//%' THEN {scheme} || ':' || href ELSE {scheme} || '://' || {netloc} || href END AS target
FROM (SELECT page_id, url, unnest(list_transform(regexp_extract_all(html, '(?i)<a\\b[^>]*?href="([^"]*)"', 1), lambda x: trim(x))) AS href FROM pages) AS l
""".format(scheme=part("url", 1), netloc=part("url", 2))
EDGES = f"SELECT DISTINCT page_id, {normalized('url')} AS src, {normalized('target')} AS dst FROM ({LINKS}) AS t"

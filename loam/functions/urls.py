"""Column expressions over addresses and file names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"

# --- fixed values: extensions and content types that the crawler knows ------------------------------------------------
BINARY = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx")
PLAIN = (".txt", ".csv", ".json", ".xml", ".yaml", ".yml", ".md")
MEDIA = (".css", ".js", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".woff", ".woff2", ".ttf", ".eot", ".mp4", ".mp3", ".zip", ".rar", ".gz", ".tar")
KNOWN = (*BINARY, *PLAIN, *MEDIA)
BINARY_TYPES = {
    "application/pdf": ".pdf", "application/msword": ".doc", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx", "application/vnd.ms-excel": ".xls",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx", "application/vnd.ms-powerpoint": ".ppt", "application/vnd.openxmlformats-officedocument.presentationml.presentation": ".pptx",
}
PLAIN_TYPES = ("text/plain", "text/csv", "application/json", "application/xml", "text/xml", "application/yaml", "application/x-yaml")
STORED_TYPES = BINARY_TYPES | {
    "text/html": ".html", "text/markdown": ".md", "text/plain": ".txt", "text/csv": ".csv", "text/xml": ".xml", "application/json": ".json", "application/xml": ".xml", "application/rtf": ".rtf", "application/epub+zip": ".epub",
}
STORED_EXTENSIONS = (
    ".html", ".htm", ".md", ".txt", ".csv", ".xml", ".json", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".rtf", ".odt", ".ods", ".odp", ".epub", ".mobi", ".tex", ".latex", ".rst", ".log", ".yaml", ".yml",
)
#: Of several files of one name the first in this order is the processed one.
PATH_PRIORITY = (
    ".md", ".html", ".htm", ".txt", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".csv", ".xml", ".json", ".rtf", ".odt", ".epub", ".rst", ".yaml", ".yml", ".log", ".tex",
)
# ----------------------------------------------------------------------------------------------------------------------


def part(url: Column, group: int) -> Column:
    """1 scheme, 2 host, 3 path, 4 query; empty where absent."""
    return F.regexp_extract(url, _URL, group)


def path_of(url: Column) -> Column:
    """The path without the parameters of its last segment."""
    return F.regexp_replace(part(url, 3), r";[^/]*$", "")


def normalize_url(url: Column) -> Column:
    """Scheme, host and path without closing slashes and dot segments, and the query as it is; no fragment, no parameters."""
    path = F.regexp_replace(without_dots(path_of(url)), "/+$", "")
    query = part(url, 4)
    return F.concat(
        F.lower(part(url, 1)), F.lit("://"), part(url, 2), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))
    )


def without_dots(path: Column) -> Column:
    """A path whose ``.`` and ``..`` segments are followed; ``..`` at the root stays there."""
    step = lambda done, seg: F.when(seg == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(seg == ".", done).otherwise(F.concat(done, F.array(seg)))
    segments = F.slice(F.split(path, "/", -1), 2, F.size(F.split(path, "/", -1)))
    followed = F.aggregate(segments, F.array().cast("array<string>"), step)
    open_end = path.rlike(r"/\.{1,2}$")
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), F.concat(F.lit("/"), F.array_join(followed, "/"), F.when(open_end & (F.size(followed) > 0), "/").otherwise(""))).otherwise(path)


def with_scheme(url: Column) -> Column:
    """``https://`` before what names no scheme."""
    return F.when(url.rlike("^(https?|file)://"), url).otherwise(F.concat(F.lit("https://"), url))


def site_of(url: Column) -> Column:
    """The site an address belongs to: its host, else ``default``."""
    host = part(url, 2)
    return F.when(host == "", "default").otherwise(host)


def filename_of(url: Column) -> Column:
    """The base file name of an address: its path with every run-in character that is no word character as ``_``."""
    name = F.regexp_replace(F.trim(path_of(url), F.lit("/")), r"(?U)[^\w-]", "_")
    return sanitized(F.when(name == "", "index").otherwise(name))


def sanitized(name: Column) -> Column:
    """A name that file systems take, of 200 characters at most."""
    safe = F.substring(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), 1, 200)
    return F.when(safe == "", "untitled").otherwise(safe)


def safe_name(url: Column) -> Column:
    """An address as one word: letters, digits, ``-`` and ``_`` stay, the rest becomes ``_``."""
    return F.regexp_replace(url, r"[^\p{IsAlphabetic}\p{N}_-]", "_")


def extension_of(url: Column) -> Column:
    """The lower-case extension of the path's last segment with its dot; empty where there is none."""
    return F.lower(F.regexp_extract(path_of(url), r"(\.[^./]*)$", 1))


def mime_of(content_type: Column) -> Column:
    """A content type header without its parameters; ``text/html`` where there is none."""
    return F.lower(F.trim(F.regexp_extract(F.coalesce(content_type, F.lit("text/html")), "^([^;]*)", 1)))


def kind_of(url: Column, content_type: Column) -> Column:
    """How a response is read, by its content type and the address's extension: html, binary, text or skip."""
    mime, ext = mime_of(content_type), extension_of(url)
    return (
        F.when(F.contains(mime, F.lit("text/html")) & ~ext.isin(*BINARY), "html")
        .when(mime.isin(*BINARY_TYPES) | ext.isin(*BINARY), "binary")
        .when(mime.isin(*PLAIN_TYPES) | ext.isin(*PLAIN), "text")
        .otherwise("skip")
    )


def stored_extension(content_type: Column, filename: Column) -> Column:
    """The extension a stored file gets: of its content type, else its own if known, else ``.html``."""
    types = F.create_map(*[F.lit(x) for pair in STORED_TYPES.items() for x in pair])
    own = F.lower(F.regexp_extract(filename, r"(\.[^.]*)$", 1))
    return F.coalesce(F.try_element_at(types, content_type), F.when(own.isin(*STORED_EXTENSIONS), own), F.lit(".html"))


def in_scope(url: Column, bases: Sequence[str]) -> Column:
    """Whether an address lies under one of the base addresses: the same host, and the base's path or below it."""
    if not bases:
        return F.lit(True)
    host, path = part(url, 2), path_of(url)
    tests = []
    for base in bases:
        base_host = part(F.lit(base), 2)
        base_path = F.regexp_replace(path_of(F.lit(base)), "/+$", "")
        tests.append((host == base_host) & ((base_path == "") | (path == base_path) | F.startswith(path, F.concat(base_path, F.lit("/")))))
    return _any(tests)


def should_process(url: Column, bases: Sequence[str], extensions: Sequence[str]) -> Column:
    """Whether the crawler takes an address up.

    A configured extension (as the path's end or as a segment's name) is taken anywhere on the base's host; else the
    address must be in scope; there pages are always taken, other known extensions never, unknown ones are.
    """
    path = F.lower(path_of(url))
    named = _any([path.endswith(e) | F.contains(path, F.lit(f"/{e[1:]}/")) | path.endswith(f"/{e[1:]}") for e in extensions])
    same_host = _any([part(url, 2) == part(F.lit(b), 2) for b in bases]) if bases else F.lit(True)
    last = F.regexp_extract(path, "([^/]*)$", 1)
    return (
        F.when(named, same_host)
        .when(~in_scope(url, bases), False)
        .when(path.endswith(".html") | path.endswith(".htm"), True)
        .when(F.contains(last, F.lit(".")), ~F.regexp_extract(last, r"(\.[^.]*)$", 1).isin(*KNOWN))
        .otherwise(True)
    )


def _any(tests: Sequence[Column]) -> Column:
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out


def followable(href: Column) -> Column:
    """Whether a link leads to another document at all."""
    return href.isNotNull() & (F.trim(href) != "") & ~href.rlike("^(javascript:|mailto:|tel:|#)")


def without_highlight(url: Column) -> Column:
    """An address without its ``highlight`` parameter."""
    out = F.regexp_replace(url, r"([?&])highlight=[^&#]*&?", "$1")
    return F.regexp_replace(out, r"[?&](?=$|#)", "")


def result_links(file_key: Column, output_dir: Column, query: Column, block: Column) -> dict[str, Column]:
    """The three links of a search result; ``file_key`` is the site, a slash and the base name."""
    site, base = F.regexp_extract(file_key, "^([^/]*)", 1), F.regexp_replace(file_key, "^[^/]*/", "")
    out = F.url_encode(F.coalesce(output_dir, F.lit("output")))
    root = F.concat(F.lit("/files/"), site)
    tail = F.concat(F.lit("?output_dir="), out)
    view = F.concat(root, F.lit("/html_views/"), base, F.lit(".html"), tail)
    return {
        "md_download_url": F.concat(root, F.lit("/docs/"), base, F.lit(".md"), tail),
        "html_view_url": F.concat(view, F.lit("&highlight="), F.url_encode(query)),
        "html_block_view_url": F.concat(view, F.lit("&highlight_block="), F.url_encode(block)),
    }

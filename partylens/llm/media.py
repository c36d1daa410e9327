"""Operator 10: interleaved document sequences of text and media references.

A tokeniser reads the HTML: tags with quoted or bare attributes, comments, declarations, raw text of script
and style (skipped), character references. What is left is an ordered list of items: text between media, and
media references (img, picture and video sources, audio, video, iframe, embed, object, and data: URLs), each
with its resolved URL, the digest of that URL (SHA-256, without its fragment), alternative text and the
caption of its figure, before or after it. A tag's URLs are a reference each, in the order source, lazy source,
candidates of srcset, poster; one that repeats within the tag counts once. What stands in noscript and template
is read as well, as fallback images do. Links between pages can be taken as references too. Payloads, of any
type, are joined by digest, each item keeping its position; an item without a payload stays, with a null payload.

Pages are parsed once, into a table in the shared folder, and so are the payloads that are referred to; a
reference that a third of all pages share, as a logo, is a skewed key of a join of tables, which may be split.

Defined results: null and empty pages give an empty sequence; text outside of tags counts as text; unclosed
tags, comments and raw text end with the page. A reference without a URL is dropped. A repeated page is
repeated. Of several payloads under a digest the least is taken, so no item is doubled. A null page id is
kept. Columns of the payload table other than digest and payload are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from urllib.parse import urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partylens.llm.base import RUN_CHARS, Scratch, table

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_RAW = {"script", "style"}
_BLOCK = {"p", "div", "br", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "tr", "table", "section", "article", "header", "footer", "nav", "title", "figure", "figcaption", "blockquote", "pre", "hr"}
#: Tag to the attributes that hold its URLs, in order, and the kind of media.
_IMAGE = ("src", "data-src", "srcset", "data-srcset")
MEDIA = {"img": (_IMAGE, "image"), "source": (("src", "data-src", "srcset", "data-srcset"), "source"), "video": (("src", "poster"), "video"), "audio": (("src",), "audio"), "iframe": (("src",), "frame"), "embed": (("src",), "embed"), "object": (("data",), "object"), "image": (("href", "xlink:href"), "image")}
#: A candidate of srcset: a URL without blanks, then what tells its size; a comma at the URL's end ends the candidate.
_CANDIDATE = re.compile(r"[\s,]*(\S*[^\s,])(?:,|(?:\s+[^,(]*(?:\([^)]*\)[^,(]*)*)?(?:,|\Z))")


def urls_of(tag: dict[str, str], where: tuple[str, ...]) -> list[tuple[str, str]]:
    """(attribute, URL) of a tag's attributes, each URL once."""
    found: dict[str, str] = {}
    for name in where:
        value = tag.get(name, "").strip()
        for url in [m[1] for m in _CANDIDATE.finditer(value)] if name.endswith("srcset") else [value]:
            if url:
                found.setdefault(url, name)
    return [(name, url) for url, name in found.items()]


def resolve(base: str, url: str) -> str:
    """The absolute URL without its fragment, scheme and host in lower case; data: URLs as they are."""
    url = url.strip()
    if url[:5].lower() == "data:":
        return url
    try:
        parts = urlsplit(urljoin(base, url))
    except ValueError:
        return url
    return urlunsplit((parts.scheme.lower(), parts.netloc.lower(), parts.path or ("/" if parts.netloc else ""), parts.query, ""))


def digest(url: str) -> str:
    return hashlib.sha256(url.encode("utf-8", "surrogatepass")).hexdigest()


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
    return out


def sequence(page: str, base: str = "", links: bool = False) -> list[dict]:
    """The ordered items of one page."""
    items: list[dict] = []
    text: list[str] = []
    figures: list[tuple[list[dict], list[str]]] = []  # references and captions of the open figures, the innermost last
    caption: list[str] | None = None
    at = 0

    def flush():
        joined = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
        text.clear()
        if joined:
            items.append({"kind": "text", "text": joined, "url": None, "alt": None, "caption": None})

    def words(piece: str):
        if piece:
            text.append(piece)
            if caption is not None:
                caption.append(piece)

    def end_caption():
        nonlocal caption
        told = _SPACE.sub(" ", entities.unescape("".join(caption or ()))).strip()
        if told and figures:
            figures[-1][1].append(told)
        caption = None

    def end_figure():
        end_caption()
        own, told = figures.pop()
        for one in own:
            one["caption"] = " ".join(told) or None

    while True:
        m = _TOKEN.search(page, at)
        words(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in _RAW and not m[1]:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if tag in _BLOCK:
            words("\n")
        if tag == "figure":
            if not m[1]:
                end_caption()
                figures.append(([], []))
            elif figures:
                end_figure()
        elif tag == "figcaption":
            end_caption()
            if not m[1]:
                caption = []
        if m[1]:
            continue
        where, kind = MEDIA.get(tag, ((), ""))
        if links and tag == "a":
            where, kind = ("href",), "link"
        if where:
            has = _attributes(m[3])
            for name, url in urls_of(has, where):
                flush()
                items.append({"kind": "image" if name == "poster" else kind, "text": None, "url": resolve(base, url), "alt": has.get("alt") or None, "caption": None})
                if figures:
                    figures[-1][0].append(items[-1])
    while figures:
        end_figure()
    flush()
    for position, item in enumerate(items):
        item["position"] = position
    return items


ITEM = T.StructType(
    [T.StructField("position", T.IntegerType())] + [T.StructField(n, T.StringType()) for n in ("kind", "text", "url", "alt", "caption")]
)


def with_digest(item):
    """The digest follows from the URL, so it isn't carried through a shuffle."""
    return item.withField("digest", F.sha2(item["url"], 256))


def sequences(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", links: bool = False) -> DataFrame:
    """(page_id, url, items): each page's ordered items."""
    return _parsed(pages, id_col, url_col, html_col, links).select("page_id", "url", F.transform("items", with_digest).alias("items"))


def _parsed(pages: DataFrame, id_col: str, url_col: str, html_col: str, links: bool) -> DataFrame:
    """(page_id, url, items) without digests."""
    schema = T.StructType([T.StructField("page_id", pages.schema[id_col].dataType), T.StructField("url", T.StringType()), T.StructField("items", T.ArrayType(ITEM))])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(T.ArrayType(ITEM))
        for batch in batches:
            urls, pages_ = (batch.column(i).to_pylist() for i in (1, 2))
            begin, size, found = 0, 0, []
            for i, (url, page) in enumerate(zip(urls, pages_)):
                found.append(sequence(page or "", url or "", links))
                size += len(page or "")
                if size > RUN_CHARS or i + 1 == batch.num_rows:
                    own = [batch.column(k).slice(begin, len(found)) for k in range(2)]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(found, type=kind)], ["page_id", "url", "items"])
                    begin, size, found = i + 1, 0, []

    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")).mapInArrow(run, schema)


def interleaved(pages: DataFrame, payloads: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", links: bool = False) -> DataFrame:
    """(page_id, url, items): as ``sequences``, each item with its payload, from (digest, payload)."""
    scratch = Scratch(pages.sparkSession)
    parsed = scratch.save(_parsed(pages, id_col, url_col, html_col, links).withColumn("row", F.monotonically_increasing_id()))
    # only references go through these shuffles, and only those with a payload come back
    wanted = parsed.select("row", F.explode("items").alias("item")).filter("item.url is not null").select("row", "item.position", F.unhex(F.sha2("item.url", 256)).alias("digest"))
    wanted = scratch.save(wanted)
    one = payloads.filter("digest is not null").select(F.unhex("digest").alias("digest"), "payload").join(wanted.select("digest").distinct(), "digest", "left_semi")
    one = scratch.save(one.groupBy("digest").agg(F.min("payload").alias("payload")))
    found = wanted.join(one, "digest").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("position", "payload"))).alias("payloads"))
    # as a written table its size is known when the join is planned: if it is small it is broadcast, and no page is shuffled
    found = scratch.save(found)
    joined = parsed.join(found, "row", "left")
    kind = payloads.schema["payload"].dataType
    with_payload = F.transform("items", lambda x: with_digest(x).withField("payload", F.coalesce(F.element_at(F.col("payloads"), x["position"]), F.lit(None).cast(kind))))
    scratch.drop(wanted, one)
    return joined.select("page_id", "url", with_payload.alias("items"))


def page_payloads(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(digest, payload) of the pages themselves: what a link can resolve to."""

    def run(batches):
        for batch in batches:
            urls = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([digest(resolve("", u)) if u else None for u in urls], pa.string()), batch.column(1)], ["digest", "payload"])

    what = F.struct(F.col(id_col).cast("string").alias("id"), F.octet_length(html_col).alias("bytes"), F.sha2(F.coalesce(F.col(html_col), F.lit("")), 256).alias("sha256"))
    narrow = pages.select(F.col(url_col).cast("string").alias("url"), F.to_json(what).alias("payload"))
    return narrow.mapInArrow(run, "digest string, payload string")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawl's pages with media and links as references; a link's payload describes the page it leads to."""
    pages = table(spark, sf_dir, "pages")
    return interleaved(pages, page_payloads(pages), links=True)


QUERIES = {"op10_media": op10_media}
SQL: dict[str, str] = {}

"""HTML documents as a relational node table.

Every element is a row with its place in document order (``pre``), the number of its
descendants (``size``), its depth and its parent. So an axis is an interval:
descendants of c have ``pre`` in (c.pre, c.pre + c.size].

Documents are parsed once, in Arrow batches. What a plan does not need is not made:
``tags`` keeps the rows of some elements only, and ``content`` and ``inner`` are filled
for the tags asked for.

Tolerated: missing end tags, wrong nesting, missing html, head and body elements,
bytes of any encoding that a BOM, XML declaration or meta element names. Null and empty
input gives no rows. A document without any element, or that breaks the parser, ends no
job: it has no rows either, and with ``errors`` one that says so (``failures``).
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AssumptionError
from ..shipping import ship

# Fixed values of HTML: elements without content, and which start tags end which open ones.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD = frozenset("base link meta script style title noscript template".split())
BLOCKS = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
WALLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"}, "optgroup": {"select"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tr": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}

_charset = re.compile(rb"""<\?xml[^>]*encoding=["']([\w.:-]+)|<meta[^>]+charset=["']?([\w.:-]+)""", re.I)


class Tree(HTMLParser):
    """The elements of one document, in document order, as lists by column."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag: list[str] = []
        self.attrs: list[dict[str, str]] = []
        self.parent: list[int | None] = []
        self.level: list[int] = []
        self.size: list[int] = []
        self.text: list[str | None] = []
        self.tail: list[str | None] = []
        self.children: list[list[int]] = []
        self.open: list[int] = []

    def _add(self, tag: str, attrs: dict[str, str], stays: bool = True) -> None:
        k = len(self.tag)
        up = self.open[-1] if self.open else None
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.parent.append(up)
        self.level.append(len(self.open))
        self.size.append(0)
        self.text.append(None)
        self.tail.append(None)
        self.children.append([])
        if up is not None:
            self.children[up].append(k)
        if stays:
            self.open.append(k)

    def _close(self, depth: int) -> None:
        """Ends the open elements from ``depth`` on."""
        for k in self.open[depth:]:
            self.size[k] = len(self.tag) - k - 1
        del self.open[depth:]

    def _opened(self, names: Iterable[str], walls: Iterable[str] = ()) -> int | None:
        for depth in range(len(self.open) - 1, -1, -1):
            name = self.tag[self.open[depth]]
            if name in names:
                return depth
            if name in walls:
                return None
        return None

    def _frame(self, tag: str) -> None:
        """Adds the html, head and body elements that the document leaves out."""
        if not self.open:
            self._add("html", {})
        inside = [self.tag[k] for k in self.open[1:2]]
        if tag in ("head", "body", "frameset") or inside == ["body"] or inside == ["frameset"]:
            if tag == "body" and inside == ["head"]:
                self._close(1)
            return
        if tag in HEAD and "body" not in self.tag:
            if not inside:
                self._add("head", {})
        elif inside == ["head"] or not inside:
            self._close(1)
            self._add("body", {})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given: dict[str, str] = {}
        for k, v in attrs:
            given.setdefault(k, v if v is not None else "")
        if tag in ("html", "body") and tag in self.tag:
            at = self.tag.index(tag)
            self.attrs[at] = {**given, **self.attrs[at]}
            return
        if tag == "html":
            return self._add(tag, given)
        self._frame(tag)
        if tag in BLOCKS and (at := self._opened({"p"}, {"td", "th", "button", "div", "li", "body"})) is not None:
            self._close(at)
        while tag in ENDS and (at := self._opened(ENDS[tag], WALLS[tag])) is not None:
            self._close(at)
        self._add(tag, given, tag not in VOID)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        at = self._opened({tag}, {"table"} if tag not in ("table", "body", "div") else ())
        if at is not None and at > 0:
            self._close(at)

    def handle_data(self, data: str) -> None:
        if not data.strip() and len(self.open) < 2:
            return
        if self.open and self.tag[self.open[-1]] not in ("script", "style", "title", "textarea"):
            if data.strip() or self.tag[self.open[-1]] not in ("html", "head"):
                self._frame("#text")
        elif not self.open:
            self._frame("#text")
        k = self.open[-1]
        kids = self.children[k]
        if kids:
            self.tail[kids[-1]] = (self.tail[kids[-1]] or "") + data
        else:
            self.text[k] = (self.text[k] or "") + data

    def done(self) -> Tree:
        self.close()
        self._close(0)
        return self

    def content(self, k: int) -> str:
        """All text below an element, scripts included."""
        if self.size[k] == 0:
            return self.text[k] or ""
        out: list[str] = []
        self._spell(k, out)
        return "".join(out)

    def contents(self, wanted: list[int]) -> dict[int, str]:
        """``content`` of several elements: the text of the document is joined once, and each
        is a stretch of it, however deep they are nested."""
        if len(wanted) < 3:
            return {k: self.content(k) for k in wanted}
        pieces: list[str] = []
        at, begins, ends = 0, {}, {}
        stack: list[tuple[int, int]] = [(0, 0)]
        while stack:
            c, what = stack.pop()
            if what == 0:
                begins[c] = at
                pieces.append(self.text[c] or "")
                at += len(pieces[-1])
                stack.append((c, 1))
                stack += [(kid, 0) for kid in reversed(self.children[c])]
            else:
                ends[c] = at
                pieces.append(self.tail[c] or "")
                at += len(pieces[-1])
        whole = "".join(pieces)
        return {k: whole[begins[k] : ends[k]] for k in wanted}

    def _spell(self, k: int, out: list[str]) -> None:
        stack: list[tuple[int, bool]] = [(k, False)]
        while stack:
            c, after = stack.pop()
            if after:
                out.append(self.tail[c] or "")
                continue
            out.append(self.text[c] or "")
            for kid in reversed(self.children[c]):
                stack.append((kid, True))
                stack.append((kid, False))

    def outer(self, k: int) -> str:
        """An element written as HTML, without its tail."""
        out: list[str] = []
        stack: list[tuple[int, int]] = [(k, 0)]
        while stack:
            c, what = stack.pop()
            if what == 1:
                out.append(f"</{self.tag[c]}>")
                continue
            if what == 2:
                out.append(entities.escape(self.tail[c] or "", quote=False))
                continue
            said = "".join(f' {a}="{entities.escape(v)}"' for a, v in self.attrs[c].items())
            out.append(f"<{self.tag[c]}{said}>")
            if self.tag[c] in VOID:
                continue
            raw = self.tag[c] in ("script", "style")
            out.append((self.text[c] or "") if raw else entities.escape(self.text[c] or "", quote=False))
            stack.append((c, 1))
            for kid in reversed(self.children[c]):
                stack.append((kid, 2))
                stack.append((kid, 0))
        return "".join(out)

    def inner(self, k: int) -> str:
        """What stands between an element's tags: its text, then children with their tails."""
        parts = [entities.escape(self.text[k] or "", quote=False)]
        for c in self.children[k]:
            parts += [self.outer(c), entities.escape(self.tail[c] or "", quote=False)]
        return "".join(parts)


def to_text(document: str | bytes) -> str:
    """A document as text; bytes are read as their BOM, declaration or meta element says."""
    if isinstance(document, str):
        return document
    for bom, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if document.startswith(bom):
            return document[len(bom) :].decode(name, "replace")
    said = _charset.search(document[:2048])
    name = (said[1] or said[2]).decode() if said else "utf-8"
    try:
        return document.decode(name, "replace")
    except LookupError:
        return document.decode("utf-8", "replace")


def parse(document: str | bytes) -> Tree:
    """The tree of a document; one that cannot be parsed is an ``AssumptionError``."""
    try:
        tree = Tree()
        tree.feed(to_text(document))
        tree.done()
    except Exception as e:  # whatever a document does to the parser, it is the document's fault
        raise AssumptionError(f"Failed to parse HTML: {type(e).__name__}: {e}") from e
    if not tree.tag:
        raise AssumptionError("Failed to parse HTML: the document is empty")
    return tree


_NODE = pa.schema(
    [("pre", pa.int32()), ("size", pa.int32()), ("level", pa.int32()), ("parent", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("tail", pa.string()), ("content", pa.string()), ("inner", pa.string())]
)
NODE = "pre INT, size INT, level INT, parent INT, tag STRING, attrs MAP<STRING, STRING>, text STRING, tail STRING, content STRING, inner STRING"


def shred(pages: DataFrame, *, key: str = "page_id", html: str = "html", url: str | None = "url", tags: Iterable[str] | None = None, content: Iterable[str] | None = (), inner: Iterable[str] = (), errors: bool = False) -> DataFrame:
    """``dom_nodes`` of ``pages``: the key, the URL if any, and a row for each element.

    ``tags``: only rows of these elements. ``content``: the tags whose text content is
    filled, None for all. ``inner``: likewise for the inner HTML. Pages that are null or
    empty give no rows. With ``errors`` there is a column ``error``, and a row with nothing
    else but it for each page that cannot be parsed: store the rows, then take them apart
    by ``elements`` and ``failures``.
    """
    ship(pages.sparkSession)
    some = None if tags is None else frozenset(tags)
    full, within = None if content is None else frozenset(content), frozenset(inner)
    kept = [key, *([url] if url else [])]
    fields = [*_NODE, *([pa.field("error", pa.string())] if errors else [])]

    def rows_of(document: str | bytes) -> Iterator[tuple]:
        try:
            t = parse(document)
        except AssumptionError as e:
            if errors:
                yield (*[None] * len(_NODE), e.message)
            return
        chosen = [i for i, name in enumerate(t.tag) if some is None or name in some]
        texts = t.contents([i for i in chosen if full is None or t.tag[i] in full])
        for i in chosen:
            row = (i, t.size[i], t.level[i], t.parent[i], t.tag[i], list(t.attrs[i].items()), t.text[i], t.tail[i], texts.get(i), t.inner(i) if t.tag[i] in within else None)
            yield (*row, None) if errors else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 128):
                batch = big.slice(lo, 128)
                rows, owner = [], []
                for k, document in enumerate(batch.column(len(kept)).to_pylist()):
                    made = list(rows_of(document)) if document else []
                    rows += made
                    owner += [k] * len(made)
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
                take = pa.array(owner, pa.int32())
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns[:-1]), *(pa.array(c, f.type) for c, f in zip(columns, fields, strict=True))], schema=pa.schema([*list(batch.schema)[:-1], *fields]))

    schema = T.StructType([pages.schema[c] for c in kept] + T.StructType.fromDDL(NODE + (", error STRING" if errors else "")).fields)
    return pages.select(*kept, html).mapInArrow(run, schema)


def elements(shredded: DataFrame) -> DataFrame:
    """The element rows of ``shred`` with ``errors``."""
    return shredded.filter("pre is not null").drop("error")


def failures(shredded: DataFrame, *, key: str = "page_id") -> DataFrame:
    """The pages that could not be parsed: key, URL if there is one, ``class`` and ``message``."""
    kept = [c for c in (key, "url") if c in shredded.columns]
    return shredded.filter("error is not null").select(*kept, F.lit("AssumptionError").alias("class"), F.col("error").alias("message"))


def from_strings(spark: SparkSession, documents: Iterable[tuple[str, str]]) -> DataFrame:
    """``page_id, url, html`` of (url, markup) pairs at hand."""
    return spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(documents)], "page_id BIGINT, url STRING, html STRING")


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, url, html BINARY`` of files read by Spark: the path is the URL, its hash the id."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.xxhash64("path").alias("page_id"), F.col("path").alias("url"), F.col("content").alias("html"))

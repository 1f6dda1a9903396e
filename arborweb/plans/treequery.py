"""Selectors as DataFrame plans over the node table.

A node-set is a DataFrame of node rows with ``ctx``, the context node they were found
from. An axis is a join on the page and an interval; attribute tests are filters that
reach the scan; positions are row numbers in document order. A selector that starts at
the document and has one step is a filter, without any join.

Every join has the page as its key, so no plan is ever a nested loop over the corpus; axes that
compare places have blocks of them as well, so none is one over a large page either.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigError
from .grammar import Binary, Call, Literal, Path, Selector, Step, Union, numeric, own_attribute, positional, read, simplify

NODE_COLUMNS = ("pre", "size", "level", "parent", "tag", "attrs", "text", "tail", "content", "inner")
#: Places of a page that are joined together: a page of fewer elements is one block.
BLOCK = 4096
#: For the axes that compare places: whether the nodes span places and the contexts are points among
#: them, or the other way round; the span (first, last) and the point, of ``pre`` and ``size``.
SPANS = {
    "descendant": (False, lambda pre, size: (pre, pre + size), lambda pre, size: pre),
    "descendant-or-self": (False, lambda pre, size: (pre, pre + size), lambda pre, size: pre),
    "ancestor": (True, lambda pre, size: (pre, pre + size), lambda pre, size: pre),
    "ancestor-or-self": (True, lambda pre, size: (pre, pre + size), lambda pre, size: pre),
    "following": (True, lambda pre, size: (F.lit(0), pre), lambda pre, size: pre + size),
    "preceding": (False, lambda pre, size: (F.lit(0), pre), lambda pre, size: pre + size),
}
REVERSE = ("ancestor", "ancestor-or-self", "preceding", "preceding-sibling", "parent")
#: Contexts of a query that starts at the document.
DOCUMENT = -1


@dataclass
class Value:
    """An expression's value for each row: a bool, num or str column, or a set of values
    in another table (page, ctx, ord, value)."""

    kind: str
    column: Column | None = None
    rows: DataFrame | None = None


class Query:
    """One evaluation over ``nodes``. ``key`` names the page column."""

    def __init__(self, nodes: DataFrame, key: str = "page_id"):
        self.key = key
        self.columns = [*NODE_COLUMNS, *(["url"] if "url" in nodes.columns else [])]
        self.nodes = nodes.select(key, *self.columns)
        self.made = 0

    def fresh(self, name: str) -> str:
        self.made += 1
        return f"_{name}{self.made}"

    # node-sets

    def roots(self) -> DataFrame:
        return self.nodes.filter("parent is null").withColumn("ctx", F.col("pre"))

    def test(self, step: Step) -> Column:
        return F.lit(True) if step.test in ("*", "node()") else F.col("tag") == step.test

    def first(self, step: Step) -> DataFrame:
        """A step from the document itself."""
        rows = self.nodes.filter(self.test(step))
        if step.axis == "child":
            rows = rows.filter("parent is null")
        elif step.axis not in ("descendant", "descendant-or-self"):
            raise ConfigError(f"the document has no {step.axis}")
        return rows.select(self.key, F.lit(DOCUMENT).alias("ctx"), F.lit(DOCUMENT).alias("step"), *self.columns)

    def along(self, now: DataFrame, step: Step) -> DataFrame:
        """A step from each row of ``now``; ``step`` holds the row it was taken from."""
        if step.axis == "self":
            return now.filter(self.test(step)).withColumn("step", F.col("pre"))
        c = now.select(F.col(self.key).alias("c_page"), "ctx", *[F.col(x).alias(f"c_{x}") for x in ("pre", "size", "parent")])
        if not any(numeric(e) or positional(e) for e in step.where):
            c = self.furthest(c, step.axis)
        n = self.nodes.filter(self.test(step))
        on = {
            "child": F.col("parent") == F.col("c_pre"),
            "descendant": (F.col("pre") > F.col("c_pre")) & (F.col("pre") <= F.col("c_pre") + F.col("c_size")),
            "descendant-or-self": (F.col("pre") >= F.col("c_pre")) & (F.col("pre") <= F.col("c_pre") + F.col("c_size")),
            "parent": F.col("pre") == F.col("c_parent"),
            "ancestor": (F.col("c_pre") > F.col("pre")) & (F.col("c_pre") <= F.col("pre") + F.col("size")),
            "ancestor-or-self": (F.col("c_pre") >= F.col("pre")) & (F.col("c_pre") <= F.col("pre") + F.col("size")),
            "following": F.col("pre") > F.col("c_pre") + F.col("c_size"),
            "preceding": F.col("pre") + F.col("size") < F.col("c_pre"),
            "following-sibling": (F.col("parent") == F.col("c_parent")) & (F.col("pre") > F.col("c_pre")),
            "preceding-sibling": (F.col("parent") == F.col("c_parent")) & (F.col("pre") < F.col("c_pre")),
        }[step.axis]
        if step.axis in SPANS:
            n, c = blocks(n, c, *SPANS[step.axis])
            on = on & (F.col("n_block") == F.col("c_block"))
        met = n.join(c, (F.col(self.key) == F.col("c_page")) & on)
        return met.select(self.key, "ctx", F.col("c_pre").alias("step"), *self.columns)

    def furthest(self, c: DataFrame, axis: str) -> DataFrame:
        """The rows of each context that reach all that any of its rows reach: what follows one of
        them follows the first to end, what comes before one comes before the last to begin."""
        row, of = F.struct("c_pre", "c_size", "c_parent"), ["c_page", "ctx"]
        best = {
            "following": (of, F.min_by(row, F.col("c_pre") + F.col("c_size"))),
            "preceding": (of, F.max_by(row, F.col("c_pre"))),
            "following-sibling": ([*of, "c_parent"], F.min_by(row, F.col("c_pre"))),
            "preceding-sibling": ([*of, "c_parent"], F.max_by(row, F.col("c_pre"))),
        }.get(axis)
        if best is None:
            return c
        return c.groupBy(*best[0]).agg(best[1].alias("r")).select("c_page", "ctx", "r.*")

    def once(self, rows: DataFrame) -> DataFrame:
        """A node counts once for each context."""
        return rows.dropDuplicates([self.key, "ctx", "pre"]).select(self.key, "ctx", *self.columns)

    def filtered(self, rows: DataFrame, where: tuple, within: list[str], reverse: bool = False) -> DataFrame:
        for e in where:
            if numeric(e):
                e = Binary("=", Call("position"), e)
            before = rows.columns
            if positional(e):
                own = Window.partitionBy(*within)
                order = F.desc("pre") if reverse else F.asc("pre")
                rows = rows.withColumn("_at", F.row_number().over(own.orderBy(order))).withColumn("_of", F.count(F.lit(1)).over(own))
            rows, v = self.value(rows, e)
            rows, test = self.truth(rows, v)
            rows = rows.filter(test).select(*before)
        return rows

    def path(self, contexts: DataFrame | None, p: Path) -> tuple[DataFrame | None, Step | None]:
        """(elements, last step if it is an attribute or text step). Elements None: the document."""
        steps = simplify(p.steps)
        if isinstance(p.start, Union):
            now = self.union(contexts, p.start)
            if p.start_where:
                now = self.filtered(now, p.start_where, [self.key, "ctx"])
        elif p.start == "root":
            now = None
        else:
            now = self.roots() if contexts is None else contexts
            if steps and steps[0].axis in ("descendant", "descendant-or-self") and contexts is None:
                # everything lies below the root: a filter
                s = steps[0]
                rows = self.nodes.filter(self.test(s))
                rows = rows.filter("parent is not null") if s.axis == "descendant" else rows
                rows = rows.select(self.key, F.lit(0).alias("ctx"), F.lit(0).alias("step"), *self.columns)
                now = self.filtered(rows, s.where, [self.key, "step"]).select(self.key, "ctx", *self.columns)
                steps = steps[1:]
        for k, s in enumerate(steps):
            if s.axis == "attribute" or s.test == "text()":
                if k < len(steps) - 1:
                    raise ConfigError("an attribute or text step must be the last")
                return now, s
            if now is None and s.axis in ("descendant-or-self", "descendant", "child"):
                rows = self.first(s)
            elif now is None:
                raise ConfigError(f"the document has no {s.axis}")
            else:
                rows = self.along(now, s)
            rows = self.filtered(rows, s.where, [self.key, "ctx", "step"], s.axis in REVERSE)
            now = rows.select(self.key, "ctx", *self.columns) if now is None or s.axis == "self" else self.once(rows)
        return now, None

    def union(self, contexts: DataFrame | None, u: Union) -> DataFrame:
        """The elements of all paths, each once."""
        out = None
        for p in u.paths:
            now, last = self.path(contexts, p)
            if last is not None or now is None:
                continue
            now = now.select(self.key, "ctx", *self.columns)
            out = now if out is None else out.unionByName(now)
        if out is None:
            return self.nodes.filter("false").select(self.key, F.lit(DOCUMENT).alias("ctx"), *self.columns)
        return self.once(out) if len(u.paths) > 1 else out

    def strings(self, contexts: DataFrame | None, u: Union, elements: bool = False) -> DataFrame:
        """(page, ctx, ord, value) of attribute and text steps, and with ``elements`` the text
        content of elements as well."""
        out = None
        for p in u.paths:
            now, last = self.path(contexts, p)
            if last is None:
                if not elements or now is None:
                    continue
                rows = now.select(self.key, "ctx", F.struct(F.col("pre").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c")).alias("ord"), F.col("content").alias("value"))
            elif last.axis == "attribute":
                now = self.nodes.withColumn("ctx", F.lit(DOCUMENT)) if now is None else now
                name = last.test
                pairs = F.map_entries("attrs") if name == "*" else F.filter(F.map_entries("attrs"), lambda e: e["key"] == name)
                rows = now.select(self.key, "ctx", "pre", F.posexplode(pairs).alias("i", "e")).select(self.key, "ctx", F.struct(F.col("pre").alias("a"), F.lit(0).alias("b"), F.col("i").alias("c")).alias("ord"), F.col("e.value").alias("value"))
            else:
                rows = self.texts(now, last)
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            out = self.nodes.filter("false").select(self.key, F.lit(DOCUMENT).alias("ctx"), F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c")).alias("ord"), F.lit("").alias("value"))
        return out.dropDuplicates([self.key, "ctx", "ord"]) if len(u.paths) > 1 else out

    def texts(self, now: DataFrame | None, step: Step) -> DataFrame:
        """Text nodes: an element's own text, and the tails of its children."""
        own = self.nodes.filter("text is not null").select(self.key, F.col("pre").alias("owner"), F.struct(F.col("pre").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c")).alias("ord"), F.col("text").alias("value"))
        tails = self.nodes.filter("tail is not null").select(self.key, F.col("parent").alias("owner"), F.struct((F.col("pre") + F.col("size")).alias("a"), F.lit(1).alias("b"), (-F.col("pre")).alias("c")).alias("ord"), F.col("tail").alias("value"))
        rows = own.unionByName(tails).withColumnRenamed(self.key, "t_page")
        if now is None:
            return rows.select(F.col("t_page").alias(self.key), F.lit(DOCUMENT).alias("ctx"), "ord", "value")
        c = now.select(self.key, "ctx", F.col("pre").alias("c_pre"), F.col("size").alias("c_size"))
        if step.axis == "child":
            on = F.col("owner") == F.col("c_pre")
        elif step.axis in ("descendant", "descendant-or-self"):
            rows, c = blocks(rows, c, False, lambda pre, size: (pre, pre + size), lambda owner, _: owner, "owner")
            on = (F.col("owner") >= F.col("c_pre")) & (F.col("owner") <= F.col("c_pre") + F.col("c_size")) & (F.col("n_block") == F.col("c_block"))
        else:
            raise ConfigError(f"no text on the {step.axis} axis")
        return rows.join(c, (F.col("t_page") == F.col(self.key)) & on).select(self.key, "ctx", "ord", "value").dropDuplicates([self.key, "ctx", "ord"])

    # expressions

    def value(self, rows: DataFrame, e: object) -> tuple[DataFrame, Value]:
        if isinstance(e, Literal):
            return rows, Value("num" if isinstance(e.value, float) else "str", F.lit(e.value))
        if isinstance(e, Union):
            if name := own_attribute(e):
                return rows, Value("attr", F.col("attrs")[name])
            if len(e.paths) == 1 and e.paths[0] == Path("here", (Step("self", "node()"),)):
                return rows, Value("str", F.coalesce("content", F.lit("")))
            inner = rows.select(self.key, F.col("pre").alias("ctx"), *self.columns).dropDuplicates([self.key, "pre"])
            own = Union(tuple(p for p in e.paths if not absolute(p)))
            found = self.strings(inner, own, elements=True)
            if len(own.paths) < len(e.paths):  # the same for every node of a page
                whole = self.strings(None, Union(tuple(p for p in e.paths if absolute(p))), elements=True)
                found = found.unionByName(inner.select(self.key, "ctx").join(whole.drop("ctx"), self.key)).dropDuplicates([self.key, "ctx", "ord"])
            return rows, Value("set", rows=found)
        if isinstance(e, Binary):
            rows, a = self.value(rows, e.left)
            rows, b = self.value(rows, e.right)
            if e.op in ("and", "or"):
                rows, x = self.truth(rows, a)
                rows, y = self.truth(rows, b)
                return rows, Value("bool", (x & y) if e.op == "and" else (x | y))
            if e.op in ("+", "-"):
                rows, x = self.number(rows, a)
                rows, y = self.number(rows, b)
                return rows, Value("num", x + y if e.op == "+" else x - y)
            return self.compared(rows, a, e.op, b)
        return self.call(rows, e)

    def compared(self, rows: DataFrame, a: Value, op: str, b: Value) -> tuple[DataFrame, Value]:
        if b.kind == "set":
            a, b, op = b, a, {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op)
        if a.kind == "set":
            if b.kind == "set":
                raise ConfigError("two node-sets cannot be compared")
            name, flag = self.fresh("page"), self.fresh("flag")
            other = self.fresh("other")
            left = a.rows.select(F.col(self.key).alias(name), F.col("ctx").alias(f"{name}c"), F.col("value"))
            keys = rows.select(F.col(self.key).alias(f"{name}k"), F.col("pre").alias(f"{name}p"), b.column.alias(other)).distinct()
            met = left.join(keys, (F.col(name) == F.col(f"{name}k")) & (F.col(f"{name}c") == F.col(f"{name}p")))
            hit = met.filter(self.test_op(F.col("value"), op, F.col(other), b.kind)).select(name, f"{name}c").distinct().withColumn(flag, F.lit(True))
            rows = rows.join(hit, (F.col(self.key) == F.col(name)) & (F.col("pre") == F.col(f"{name}c")), "left").drop(name, f"{name}c")
            return rows, Value("bool", F.coalesce(F.col(flag), F.lit(False)))
        if "bool" in (a.kind, b.kind):
            rows, x = self.truth(rows, a)
            rows, y = self.truth(rows, b)
            return rows, Value("bool", self.test_op(x, op, y, "bool"))
        kind = "num" if "num" in (a.kind, b.kind) or op not in ("=", "!=") else "str"
        return rows, Value("bool", F.coalesce(self.test_op(a.column, op, b.column, kind), F.lit(False)))

    def test_op(self, a: Column, op: str, b: Column, kind: str) -> Column:
        if kind == "num":
            a, b = self.to_number(a), self.to_number(b)
        return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]

    def to_number(self, c: Column) -> Column:
        return F.trim(c.cast("string")).try_cast("double")

    def truth(self, rows: DataFrame, v: Value) -> tuple[DataFrame, Column]:
        if v.kind == "bool":
            return rows, v.column
        if v.kind == "num":
            return rows, F.coalesce((v.column != 0) & ~F.isnan(v.column), F.lit(False))
        if v.kind == "str":
            return rows, v.column != ""
        if v.kind == "attr":
            return rows, v.column.isNotNull()
        rows, n = self.counted(rows, v)
        return rows, n > 0

    def counted(self, rows: DataFrame, v: Value) -> tuple[DataFrame, Column]:
        if v.kind == "attr":
            return rows, v.column.isNotNull().cast("double")
        return self.gathered(rows, v.rows.groupBy(self.key, "ctx").agg(F.count(F.lit(1)).cast("double").alias("v")), F.lit(0.0))

    def gathered(self, rows: DataFrame, sums: DataFrame, default: Column) -> tuple[DataFrame, Column]:
        name = self.fresh("g")
        right = sums.select(F.col(self.key).alias(f"{name}k"), F.col("ctx").alias(f"{name}c"), F.col("v").alias(name))
        met = rows.join(right, (F.col(self.key) == F.col(f"{name}k")) & (F.col("pre") == F.col(f"{name}c")), "left").drop(f"{name}k", f"{name}c")
        return met, F.coalesce(F.col(name), default)

    def text_of(self, rows: DataFrame, v: Value) -> tuple[DataFrame, Column]:
        if v.kind == "set":
            return self.gathered(rows, v.rows.groupBy(self.key, "ctx").agg(F.min_by("value", "ord").alias("v")), F.lit(""))
        if v.kind == "num":
            whole = F.when(v.column == F.floor(v.column), F.floor(v.column).cast("string")).otherwise(v.column.cast("string"))
            return rows, whole
        if v.kind == "bool":
            return rows, F.when(v.column, "true").otherwise("false")
        return rows, F.coalesce(v.column, F.lit(""))

    def number(self, rows: DataFrame, v: Value) -> tuple[DataFrame, Column]:
        if v.kind == "num":
            return rows, v.column
        if v.kind == "bool":
            return rows, v.column.cast("double")
        rows, s = self.text_of(rows, v)
        return rows, F.coalesce(self.to_number(s), F.lit(float("nan")))

    def call(self, rows: DataFrame, e: Call) -> tuple[DataFrame, Value]:
        if e.name in ("position", "last"):
            return rows, Value("num", F.col("_at" if e.name == "position" else "_of").cast("double"))
        if e.name in ("true", "false"):
            return rows, Value("bool", F.lit(e.name == "true"))
        if e.name == "name" and not e.args:
            return rows, Value("str", F.col("tag"))
        values = []
        for a in e.args:
            rows, v = self.value(rows, a)
            values.append(v)
        if e.name == "not":
            rows, t = self.truth(rows, values[0])
            return rows, Value("bool", ~t)
        if e.name == "boolean":
            rows, t = self.truth(rows, values[0])
            return rows, Value("bool", t)
        if e.name == "count":
            if values[0].kind not in ("set", "attr"):
                raise ConfigError("count() takes a node-set")
            rows, n = self.counted(rows, values[0])
            return rows, Value("num", n)
        if e.name == "number":
            v = values[0] if values else Value("str", F.coalesce("content", F.lit("")))
            rows, n = self.number(rows, v)
            return rows, Value("num", n)
        texts = []
        for v in values or [Value("str", F.coalesce("content", F.lit("")))]:
            rows, s = self.text_of(rows, v)
            texts.append(s)
        s = texts[0]
        if e.name == "string":
            return rows, Value("str", s)
        if e.name == "normalize-space":
            return rows, Value("str", F.trim(F.regexp_replace(s, r"[ \t\r\n]+", " ")))
        if e.name == "string-length":
            return rows, Value("num", F.length(s).cast("double"))
        if e.name == "concat":
            return rows, Value("str", F.concat(*texts))
        if e.name == "contains":
            return rows, Value("bool", F.contains(s, texts[1]))
        if e.name == "starts-with":
            return rows, Value("bool", F.startswith(s, texts[1]))
        if e.name == "ends-with":
            return rows, Value("bool", F.endswith(s, texts[1]))
        if e.name == "translate":
            return rows, Value("str", F.translate(s, self.plain(e.args[1]), self.plain(e.args[2])))
        if e.name == "substring-before":
            return rows, Value("str", F.when(F.contains(s, texts[1]), F.substring_index(s, self.plain(e.args[1]), 1)).otherwise(""))
        if e.name == "substring-after":
            at = F.locate(self.plain(e.args[1]), s)
            return rows, Value("str", F.when(at > 0, F.substring(s, at + len(self.plain(e.args[1])), F.length(s))).otherwise(""))
        raise ConfigError(f"{e.name}() is not supported")

    def plain(self, e: object) -> str:
        if isinstance(e, Literal) and isinstance(e.value, str):
            return e.value
        raise ConfigError("a literal is needed here")


def blocks(n: DataFrame, c: DataFrame, nodes_span: bool, span: Callable[[Column, Column], tuple[Column, Column]], point: Callable[[Column, Column], Column], place: str = "pre") -> tuple[DataFrame, DataFrame]:
    """Nodes with ``n_block`` and contexts with ``c_block``: a row of the side that spans places for
    each block of ``BLOCK`` places it touches, a row of the other for the block of its point. Of a
    pair whose point lies in the span, exactly one pair of rows is in the same block, so a
    join by page and block finds each once, and a page of any size is dealt over its blocks."""
    own = (F.col(place), F.col("size") if "size" in n.columns else F.lit(0))
    other = (F.col("c_pre"), F.col("c_size"))

    def touched(first: Column, last: Column) -> Column:
        return F.explode(F.sequence(F.floor(first / BLOCK).cast("int"), F.floor(last / BLOCK).cast("int")))

    def block(at: Column) -> Column:
        return F.floor(at / BLOCK).cast("int")

    if nodes_span:
        return n.withColumn("n_block", touched(*span(*own))), c.withColumn("c_block", block(point(*other)))
    return n.withColumn("n_block", block(point(*own))), c.withColumn("c_block", touched(*span(*other)))


def absolute(p: Path) -> bool:
    """Whether a path starts at the document, whatever its context."""
    return p.start == "root" or (isinstance(p.start, Union) and all(absolute(x) for x in p.start.paths))


def _contexts(q: Query, contexts: DataFrame | None) -> DataFrame | None:
    if contexts is None:
        return None
    return contexts.select(q.key, F.col("pre").alias("ctx"), *q.columns).dropDuplicates([q.key, "pre"])


def query(nodes: DataFrame, selector: Selector, contexts: DataFrame | None = None, *, key: str = "page_id") -> DataFrame:
    """Elements that ``selector`` finds: node rows with ``ctx`` and ``pos``, their place
    among the matches of that context, from 1.

    Without ``contexts`` (rows of an earlier query) the context is each page's root. A
    selector that yields strings or a scalar has no elements.
    """
    e = read(selector)
    q = Query(nodes, key)
    if not isinstance(e, Union):
        e = Union(())
    rows = q.union(_contexts(q, contexts), e)
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(key, "ctx").orderBy("pre")))


def query_strings(nodes: DataFrame, selector: Selector, contexts: DataFrame | None = None, *, key: str = "page_id") -> DataFrame:
    """(page, ctx, pos, value): attribute values and text nodes in document order, or a
    scalar string as one result. Elements, numbers and booleans are no strings."""
    e = read(selector)
    q = Query(nodes, key)
    own = _contexts(q, contexts)
    if isinstance(e, Union):
        rows = q.strings(own, e)
    else:
        base = (q.roots() if own is None else own).select(key, "ctx", *q.columns)
        rows, v = q.value(base, e)
        rows = rows.filter("true" if v.kind == "str" else "false").select(key, "ctx", F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c")).alias("ord"), v.column.cast("string").alias("value"))
    return rows.select(key, "ctx", F.row_number().over(Window.partitionBy(key, "ctx").orderBy("ord")).alias("pos"), "value")


def scalar(nodes: DataFrame, selector: Selector, contexts: DataFrame | None = None, *, key: str = "page_id") -> DataFrame:
    """(page, ctx, value) of an expression that has one value: ``count(//p)``, ``boolean(...)``, ...
    as text, as ``string()`` would write it."""
    e = read(selector)
    q = Query(nodes, key)
    own = _contexts(q, contexts)
    base = (q.roots() if own is None else own).select(key, "ctx", *q.columns)
    rows, v = q.value(base, e if not isinstance(e, Union) else Call("string", (e,)))
    rows, s = q.text_of(rows, v)
    return rows.select(key, "ctx", s.alias("value"))


def needed_tags(selector: Selector) -> set[str] | None:
    """The tags whose rows a selector reads, None for all: what ``shred`` may leave out."""
    e = read(selector)
    out: set[str] = set()
    for p in e.paths if isinstance(e, Union) else ():
        steps = simplify(p.steps)
        elements = [s for s in steps if s.axis != "attribute"]
        if p.start == "root" and len(elements) == 1 and elements[0].axis == "descendant" and elements[0].test not in ("*", "node()", "text()") and all(_own(w) for w in elements[0].where):
            out.add(elements[0].test)
        else:
            return None
    return out or None


def _own(e: object) -> bool:
    """Whether a predicate looks at the node's own attributes only."""
    if isinstance(e, Union):
        return all(p.start == "here" and len(p.steps) == 1 and p.steps[0].axis == "attribute" for p in e.paths)
    if isinstance(e, Binary):
        return _own(e.left) and _own(e.right)
    return all(_own(a) for a in e.args) if isinstance(e, Call) else True

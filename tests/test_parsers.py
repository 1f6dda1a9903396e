from datetime import date
from decimal import Decimal
from enum import Enum

import pytest
from pydantic import BaseModel, Field, model_validator
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborweb.errors import ConfigError, StructureError
from arborweb.plans import parsers
from arborweb.plans.grammar import Selector


class Kind(Enum):
    CIVIL = "civil"
    OTHER = "other"


class Party(BaseModel):
    name: str
    share: Decimal = Decimal(1)


class Case(BaseModel):
    docket: str
    filed: date | None = None
    kind: Kind = Kind.OTHER
    parties: list[Party] = []
    tags: set[str] = set()
    marks: dict[str, int] = {}
    span: tuple[int, float] = (0, 0.0)
    either: int | str = 0
    low: int = 0
    high: int = Field(default=9, le=100)

    @model_validator(mode="after")
    def ordered(self):
        if self.high < self.low:
            raise ValueError("high below low")
        return self


class Cases(parsers.Parser):
    model = Case

    def __call__(self, page):
        out = []
        for row in page.query(Selector.css("tr"), "rows"):
            cells = [c.text_content() for c in row.find("td")]
            if cells[0] == "boom":
                raise KeyError("boom")
            out.append(self.deferred(page, docket=cells[0], filed=cells[1] or None, parties=[{"name": n, "share": "0.5"} for n in cells[2:4]], tags={"b", "a"}, marks={"x": 1}, kind="civil", span=[1, 2], high=cells[4]))
        return out


def table(*rows):
    return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"


GOOD, BAD, LOW = ("d1", "2024-05-06", "Ann", "Bob", "5"), ("d2", "no day", "Ann", "Bob", "1000"), ("d3", "", "Ann", "Bob", "-1")


def test_the_schema_comes_from_the_model():
    kind = parsers.model_type(Case)
    assert kind["filed"].dataType == T.DateType() and kind["kind"].dataType == T.StringType() and kind["parties"].dataType.elementType["share"].dataType == T.DecimalType(38, 18)
    assert kind["tags"].dataType == T.ArrayType(T.StringType()) and kind["marks"].dataType == T.MapType(T.StringType(), T.LongType()) and kind["either"].dataType == T.StringType()
    assert [f.dataType for f in kind["span"].dataType] == [T.LongType(), T.DoubleType()]


def test_records_of_pages(spark):
    pages = spark.createDataFrame([(1, table(GOOD, BAD, LOW), "http://h/1"), (2, None, None), (3, " ", None), (4, "<p>no table</p>", None), (5, table(GOOD, ("boom",)), "http://h/5"), (None, table(GOOD), None)], "page_id LONG, html STRING, url STRING").withColumn("record", F.lit("other"))
    found = parsers.records(pages, Cases)
    rows = found.collect()
    by = {(r["page_id"], r["record"]): r for r in rows}
    assert set(by) == {(1, 1), (1, 2), (1, 3), (3, None), (4, None), (5, None), (None, 1)} and len(rows) == 7
    one = by[1, 1]
    assert one["valid"] and one["errors"] == [] and one["raw"] is None and one["filed"] == date(2024, 5, 6) and one["kind"] == "civil" and one["tags"] == ["a", "b"]
    assert [(p["name"], p["share"]) for p in one["parties"]] == [("Ann", Decimal("0.5")), ("Bob", Decimal("0.5"))] and tuple(one["span"]) == (1, 2.0) and one["marks"] == {"x": 1}
    assert [(e["loc"], e["type"]) for e in by[1, 2]["errors"]] == [("filed", "date_from_datetime_parsing"), ("high", "less_than_equal")] and '"docket": "d2"' in by[1, 2]["raw"]
    assert [e["loc"] for e in by[1, 3]["errors"]] == ["__root__"]
    assert [by[k, None]["errors"][0]["type"] for k in (3, 4, 5)] == ["page_parsing", "StructureError", "KeyError"]
    good, bad = parsers.split_records(found)
    assert good.count() == 2 and {(r["page_id"], r["class"]) for r in bad.collect()} == {(1, "DataFormatError"), (3, "AssumptionError"), (4, "AssumptionError"), (5, "AssumptionError")}


def test_a_parser_in_sql(spark):
    parsers.register(spark, Cases)
    spark.createDataFrame([(1, table(GOOD, LOW), "u")], "page_id LONG, html STRING, url STRING").createOrReplaceTempView("some_pages")
    got = spark.sql("SELECT page_id, docket, valid, r.parties[0].name AS first FROM some_pages p, LATERAL Cases(p.html, p.url) r").collect()
    assert sorted((r["docket"] or "", r["valid"], r["first"] or "") for r in got) == [("", False, ""), ("d1", True, "Ann")]
    with pytest.raises(Exception, match="a page is a text"):
        spark.sql("SELECT * FROM Cases(5)").collect()


def test_strings_and_files(tmp_path):
    (tmp_path / "p.html").write_bytes(b"<meta charset=latin-1>" + table(("d\xe9",) + GOOD[1:]).encode("latin-1"))
    (made,) = Cases.from_file(tmp_path / "p.html", "http://h/")
    assert made.raw["docket"] == "d\xe9" and made.confirm().docket == "d\xe9"
    assert parsers.row_of(made.confirm())["docket"] == "d\xe9"
    with pytest.raises(StructureError):
        Cases.from_string("<p>none</p>")


def test_fields_with_the_names_of_added_columns():
    class Clash(BaseModel):
        Valid: bool

    class Clashes(Cases):
        model = Clash

    with pytest.raises(ConfigError):
        parsers.table_function(Clashes)


def test_an_empty_table(spark):
    assert parsers.records(spark.createDataFrame([], "page_id LONG, html STRING, url STRING"), Cases).collect() == []

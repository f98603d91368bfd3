"""Pages by several keys, and exports as whole documents."""

import glob
import os
import xml.etree.ElementTree as ET
import zipfile
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from loomwright.operators import browse, exports

SORTS = [("a", False), ("b", True), ("c", True)]


@pytest.fixture(scope="module")
def rows(spark):
    n = F.col("id")
    return spark.range(3000).select(F.when(n % 5 != 0, n % 7).alias("a"), F.when(n % 3 != 0, F.concat(F.lit("k"), (n % 11).cast("string"))).alias("b"), n.alias("c")).repartition(7)


def place(r):
    return (r.a is not None, -(r.a or 0), r.b is None, r.b or "", r.c)


def test_pages_of_several_keys(spark, rows):
    want = sorted(rows.collect(), key=place)
    pages = browse.Pages(rows, 64, SORTS)
    assert (pages.rows, pages.count) == (3000, 47)
    for i in (0, 1, 23, 45, 46, 47, 900):
        page = pages.page(i)
        assert page.collect() == want[64 * i : 64 * i + 64]
        assert len(page.inputFiles()) <= 2  # whatever the page's number
    assert pages.slice(100, 500).collect() == want[100:600]
    # A reader that holds a row finds those behind it by its keys.
    for r in (want[0], want[700], want[1999], want[-1]):
        assert rows.where(browse.after(SORTS, r.asDict())).count() == len(want) - 1 - want.index(r)
    assert browse.Pages(rows.limit(0), 10, SORTS).page(0).count() == 0
    assert [p.count() for p in browse.iterate_pages(rows.where("c < 25"), 10, SORTS)] == [10, 10, 5]


def test_deep_pages_are_those_of_shallow_ones(rows, monkeypatch):
    shallow = browse.page(rows, 1500, 40, SORTS, "c % 2 = 0").collect()
    monkeypatch.setattr(browse, "DEEP", 1000)
    assert browse.page(rows, 1500, 40, SORTS, "c % 2 = 0").collect() == [] == shallow
    assert browse.page(rows, 1200, 40, SORTS).collect() == sorted(rows.collect(), key=place)[1200:1240]


class Cells(HTMLParser):
    def __init__(self, text):
        super().__init__()
        self.rows, self.open = [], []
        self.feed(text)

    def handle_starttag(self, tag, attrs):
        if tag != "meta":
            self.open.append(tag)
        if tag == "tr":
            self.rows.append([])
        elif tag == "td":
            self.rows[-1].append("")

    def handle_endtag(self, tag):
        assert self.open.pop() == tag

    def handle_data(self, data):
        if self.open and self.open[-1] == "td":
            self.rows[-1][-1] += data


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, f"<é & \"{i}\">\nx" if i % 3 else None) for i in range(40)], "id int, `na me` string").repartition(4)


def files(path, suffix):
    found = sorted(glob.glob(f"{path}/*"))
    assert all(os.path.basename(f) == f"part-{i:05d}.{suffix}" for i, f in enumerate(found))
    return found


@pytest.mark.parametrize("single", [False, True])
def test_each_file_is_a_document(spark, table, tmp_path, single):
    want = {(str(r.id), r["na me"] or "") for r in table.collect()}
    exports.write_html(table, f"{tmp_path}/h", "a < b", single)
    pages = [Cells(open(f, encoding="utf-8").read()) for f in files(f"{tmp_path}/h", "html")]
    assert len(pages) == (1 if single else 4) and all(not p.open for p in pages)
    assert {tuple(r) for p in pages for r in p.rows if r} == want
    exports.write_xml(table, f"file://{tmp_path}/x", single)
    found = [ET.parse(f).getroot() for f in files(f"{tmp_path}/x", "xml")]
    assert {(r.findtext("id"), r.findtext("na_me") or "") for x in found for r in x} == want
    exports.write_xml(table.limit(0), f"{tmp_path}/none", single)
    (empty,) = files(f"{tmp_path}/none", "xml")
    assert len(ET.parse(empty).getroot()) == 0


def test_workbooks_are_files(spark, table, tmp_path):
    exports.write_xlsx(table, f"{tmp_path}/b", [("id", True)], 15)
    counts = []
    for f in files(f"{tmp_path}/b", "xlsx"):
        sheet = ET.fromstring(zipfile.ZipFile(f).read("xl/worksheets/sheet1.xml"))
        counts.append(sum(1 for e in sheet.iter() if e.tag.endswith("}row")) - 1)
    assert counts == [15, 15, 10]


def test_scripts_have_one_header(spark, table, tmp_path):
    exports.export_table(table, "sql", f"{tmp_path}/s", [("id", True)], "t", ddl="CREATE TABLE t (id int)")
    text = "".join(open(f, encoding="utf-8").read() for f in files(f"{tmp_path}/s", "sql"))
    assert text.startswith("-- table: t\n\nCREATE TABLE t (id int);\n\nINSERT INTO") and text.count("-- table") == 1


def test_a_failed_export_leaves_nothing(spark, table, tmp_path):
    bad = table.withColumn("na me", F.when(F.col("id") == 33, F.raise_error(F.lit("boom"))).otherwise(F.col("na me")))
    with pytest.raises(Exception, match="boom"):
        exports.write_html(bad, f"{tmp_path}/f", "t")
    assert glob.glob(f"{tmp_path}/f/*") == []

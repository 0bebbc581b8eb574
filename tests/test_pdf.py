"""Pages of PDF files, with a stand-in for the reader library where it isn't installed."""

import importlib.util

import pytest

from factorloom.operators import chunking
from factorloom.sources import readers

STUB = '''
class Page:
    def __init__(self, text):
        self.text = text

    def extract_text(self):
        return self.text


class PdfReader:
    def __init__(self, file):
        content = file.read().decode()
        if not content.startswith("%PDF"):
            raise ValueError("not a PDF")
        self.pages = [Page(t or None) for t in content[4:].split("\\f")]
'''


def test_pages(spark, tmp_path):
    if importlib.util.find_spec("pypdf"):
        pytest.skip("the stand-in would hide the library")
    (tmp_path / "pypdf.py").write_text(STUB)
    spark.sparkContext.addPyFile(str(tmp_path / "pypdf.py"))
    files = tmp_path / "papers"
    files.mkdir()
    (files / "One.pdf").write_text("%PDFfirst page " + "a" * 200 + "\f\f \fthird " + "b" * 200)
    (files / "broken.pdf").write_text("no")
    (files / "notes.txt").write_text("%PDFnot read")
    got = sorted((r.paper_title, r.page_num, r.text) for r in readers.pdf_pages(spark, str(files)).collect())
    assert got == [("One", 1, "first page " + "a" * 200), ("One", 4, "third " + "b" * 200)]
    assert chunking.paper_chunks(readers.pdf_pages(spark, str(files))).count() == 2


def test_files_without_the_columns_are_named(spark, tmp_path):
    spark.range(3).selectExpr("id", "id as extra").write.parquet(str(tmp_path / "a"))
    spark.range(2).write.parquet(str(tmp_path / "b"))
    with pytest.warns(UserWarning, match="/b"):
        assert readers.files_with(spark, [str(tmp_path / "a"), str(tmp_path / "b")], ["id", "extra"]).count() == 3

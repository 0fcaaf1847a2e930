"""CSV, zipped members, page text, publication and ledgers."""

import json
import zipfile

import pytest
from docketry.sources import files


def test_csv_is_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,zip\n1,02109\n2,\n")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "a.csv")).orderBy("id").collect()] == [("1", "02109"), ("2", None)]


def test_zipped_member_and_unsafe_names(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/x.csv", "k,v\n1,a\n2,b\n")
    assert files.read_zipped_csv(spark, str(tmp_path / "a.zip"), "in/x.csv", ["k", "v"]).count() == 2
    for bad in ("../x.csv", "/x.csv", "a/../../x"):
        with pytest.raises(ValueError):
            files.read_zipped_csv(spark, str(tmp_path / "a.zip"), bad, ["k"])


def test_page_text():
    html = "<html><title> T  x </title><nav><p>no</p><a href='/n'>n</a></nav><body><h2>Head</h2><p>one <b>two</b></p><p>one two</p><li>three</li><script>p</script><a href='/y'>y</a></body>"
    assert files.parse_page(html) == ("T x", "[HEADING 2] Head\none two\nthree", None, [("/n", "n"), ("/y", "y")])
    assert files.parse_page(None) == files.parse_page("") == (files.UNTITLED, "", None, [])


def test_page_parts_dates_and_nested_blocks():
    text = lambda html: files.parse_page(html)[1]
    assert text("<p>a</p><article><p>b</p></article><div role=main><div><p>c</p></div></div><p>d</p>") == "c"
    assert text("<p>a</p><article><p>b</p></article><article><p>c</p></article>") == "b"
    assert text("<main></main><p>a</p>") == ""
    assert text("<nav><main><p>a</p></main></nav><p>b</p>") == "b"
    assert text("<ul><li>a<ul><li>b</li></ul>c<li>d<p>e</ul><p>f<b>g</b>h<p>i") == "a b c\nb\nd e\ne\nf g h\ni"
    assert text("<table><tr><td>a<td>b<th>c</table>") == "a\nb\nc"
    meta = "<meta name='date' content='2020'><time datetime='2019'>x</time><meta property='article:published_time' content='2021'>"
    assert files.parse_page(f"<h1>A <i>b</i></h1>{meta}")[::2] == ("A b", "2021")
    assert files.parse_page("<time datetime='2019'>x</time><time datetime='2018'>")[2] == "2019"
    assert files.parse_page("<meta name='date' content=' '><title></title><h1>x</h1>")[::2] == ("", None)


def test_publication_swings_a_pointer(spark, tmp_path):
    root = str(tmp_path / "t")
    files.publish(spark.range(3), root)
    assert files.current(spark, root).count() == 3
    files.publish(spark.range(5), root)
    assert files.current(spark, root).count() == 5
    assert "generation" in json.loads((tmp_path / "t" / "current.json").read_text())


def test_ledger_and_headers():
    got = files.upsert([{"k": 1, "v": 1}, {"k": 2, "v": 2}], [{"k": 2, "v": 3}], ["k"])
    assert got == [{"k": 1, "v": 1}, {"k": 2, "v": 3}]
    assert files.header_names([" Job Title ", "job-title", "", "É1"]) == ["job_title", "job_title_2", "unnamed_column", "1"]
    assert files.header_names(["a", "a_2", "a", "a"]) == ["a", "a_2", "a_3", "a_4"]


def test_periods_of_links(spark):
    rows = [("/LCA_Disclosure_Data_FY2024_Q3.xlsx", "", 2024, 3), ("/x.zip", "FY 23 data, Q1", 2023, 1), ("/2021-report", "Annual", 2021, None), ("/plain", "text 123456", None, None)]
    df = spark.createDataFrame(rows, "target string, text string, y int, q int")
    assert files.with_periods(df).where("not (fiscal_year <=> y and quarter <=> q)").count() == 0

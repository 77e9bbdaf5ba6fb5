"""Pages keep all their links and headings, however many."""

from compare import same_as_sql

from lodestone.operators import extract
from lodestone.plans.oracles import ORACLE_SQL
from lodestone.plans.queries import QUERIES


def test_links_beyond_five_hundred(spark, tmp_path, duck):
    html = "<html><body>" + "".join(f'<a href="/p{i}">to {i}</a>' for i in range(1203)) + "</body></html>"
    spark.createDataFrame([(1, "https://a.com/x/y", html), (2, "https://a.com/", '<a href="/one">one</a>')], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duck.cursor()
    con.execute(f"CREATE TEMP VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    try:
        for name in ("page_link_targets", "page_links"):
            same_as_sql(QUERIES[name](spark, str(tmp_path)), con, ORACLE_SQL[name])
    finally:
        con.execute("DROP VIEW temp.pages")


def test_headings_beyond_two_hundred():
    headings = extract.parse_page("https://a.com/", "".join(f"<h2>part {i}</h2>" for i in range(450)))[5]
    assert [h[1] for h in headings] == [f"part {i}" for i in range(450)]

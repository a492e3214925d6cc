from edges import crowded, rows
from oracle import assert_same, connect

from keelson.llm import line_dedup
from keelson.llm.common import read


def test_oracle(spark):
    folder = "/root/testdata/sf0.01"
    assert_same(line_dedup.line_dedup(spark, read(spark, folder, "pages")), connect(folder), line_dedup.ORACLE)


PAGES = "page_id long, url string, html string"


def test_ratio_is_per_site(spark):
    page = "<html><body><script>x('</p>')</script><nav>Home</nav><p>story {i}</p><p>Home</p><!-- <p>gone</p> --><p>a &amp; b &lt;{i}&gt;</p></body></html>"
    data = [(i, f"https://User@One.example/{i}", page.format(i=i)) for i in range(20)]
    data += [(100 + i, f"http://two.example:80/{i}", f"<p>Home</p><p>{'rare' if i < 3 else 'other'}</p><p>x{i}</p>") for i in range(40)]
    out = {r["page_id"]: r for r in line_dedup.line_dedup(spark, spark.createDataFrame(data, PAGES), max_ratio=0.1).collect()}
    assert out[3]["host"] == "one.example" and out[3]["text"] == "story 3\na & b <3>" and out[3]["n_dropped"] == 2
    assert out[100]["host"] == "two.example" and out[100]["text"] == "rare\nx0"  # 3 of 40 is under the ratio
    assert out[110]["text"] == "x10"


def test_lines_that_share_a_64_bit_hash(spark):
    from pyspark.sql import functions as F

    twins = ["boilerp0late0one", "aabeuhgnj b=ra6g"]
    assert spark.createDataFrame([twins], "x string, y string").where(F.xxhash64("x") == F.xxhash64("y")).count() == 1
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{twins[i < 2]}</p><p>x{i}</p>") for i in range(4)], PAGES)
    # each is on two of four pages, which is not more than half
    assert {r["n_dropped"] for r in line_dedup.line_dedup(spark, pages).collect()} == {0}


def test_the_option_of_least_pages(spark):
    pages = spark.createDataFrame([(1, "http://one/a", "<p>only</p>"), (2, "http://two/a", "<p>x</p><p>y</p>"), (3, "http://two/b", "<p>x</p>")], PAGES)
    text = lambda **k: {r["page_id"]: r["text"] for r in line_dedup.line_dedup(spark, pages, **k).collect()}
    assert text() == {1: "", 2: "y", 3: ""} and text(min_pages=2) == {1: "only", 2: "y", 3: ""}


def test_join_beyond_the_broadcast(spark, monkeypatch):
    from keelson.llm import common

    pages = read(spark, "/root/testdata/sf0.001", "pages")
    want = rows(line_dedup.line_dedup(spark, pages))
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert rows(line_dedup.line_dedup(spark, pages)) == want


def test_edges(spark):
    data = [(1, None, None), (None, "not a url", "<p>a</p>"), (2, "", ""), (3, "http://h/x", "<p>a</p>" * 5), (3, "http://h/x", "<p>a</p>" * 5), (4, "http://h/y", "<p>a</p><p>" + "long " * 50_000 + "</p>")]
    pages = spark.createDataFrame(data, PAGES)
    out = line_dedup.line_dedup(spark, pages)
    got = {(r["page_id"], r["n_lines"]): r for r in out.collect()}
    assert out.count() == len(data)
    assert got[3, 5]["n_dropped"] == 5 and got[3, 5]["text"] == ""
    assert got[4, 2]["n_dropped"] == 1 and got[1, 0]["text"] == "" and got[None, 1]["text"] == "a"
    assert rows(line_dedup.line_dedup(spark, crowded(pages))) == rows(out)
    assert line_dedup.line_dedup(spark, pages.limit(0)).count() == 0
    split = crowded(pages).withColumn("lines", line_dedup.lines_of(pages.html)).withColumn("host", line_dedup.host_of(pages.url)).withColumn("_common", line_dedup.host_of(pages.url))
    assert line_dedup.drop_boilerplate(split.drop("kept"), "host", "lines").count() == len(data)

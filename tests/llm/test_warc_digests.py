"""Records of the WARC builder: each digest is made once."""

from pyspark.sql import functions as F

from editloom.llm import warc


def test_digests_are_columns_of_their_own(spark):
    page = "<html lang=\"en\"><head><title>A  b</title></head><body><p>One &amp; two</p></body></html>"
    pages = spark.createDataFrame([(1, "http://a.org/", page), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    made = warc.derivatives(warc.responses(pages))
    rows = sorted(r["record"] for r in made.collect())
    own = [r for r in rows if r.endswith("One & two")]
    assert len(rows) == 6 and len(own) == 1
    want = spark.range(1).select(warc.digest_of(F.lit("One & two"))).first()[0]
    assert "WARC-Block-Digest: " + want in own[0] and sum("text-digest: " + want in r for r in rows) == 1
    # The text's digest stands in three places of the two records and their digests, and was made for each.
    assert made._jdf.queryExecution().optimizedPlan().toString().count("sha2(cast(text#") == 1

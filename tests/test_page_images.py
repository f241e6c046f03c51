"""Images brought back into the Markdown of their pages."""

from mdloom.plans import page_images as PI

ASSETS = [("https://a.org/x.png", 200, "image/png", 10), ("https://a.org/x.png", 404, "text/html", 5), ("https://a.org/big.gif", 200, "image/gif", 11 << 20)]
PAGES = [(1, "https://a.org/p/1", '<body><p>t <img src="/x.png" alt="X"> <img src="/x.png"></p><nav><img src="/nav.png"></nav></body>'),
         (2, "https://a.org/p/2", '<body><img src="/big.gif" alt="B"><img alt="none"></body>'),
         (3, "https://a.org/p/3", "<body><p>plain</p></body>"), (4, "https://a.org/p/4", None), (5, "https://a.org/p/5", "")]


def _run(spark, **kw):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assets = spark.createDataFrame(ASSETS, "url string, status int, content_type string, bytes long")
    return {r.page_id: (r.markdown, r.images_downloaded, r.images_failed) for r in PI.documents_with_images(pages, assets, "main", **kw).collect()}


def test_sources_are_rewritten(spark):
    got = _run(spark)
    assert got[1] == ("t ![X](./images/x.png) ![](./images/x.png)\n", 2, 0)
    assert got[2] == ("![B](https://a.org/big.gif)![none]()\n", 0, 1)
    assert got[3] == ("plain\n", 0, 0)
    assert got[4] == (None, 0, 0) and got[5][1:] == (0, 0) and len(got) == 5


def test_download_off_makes_sources_absolute(spark):
    got = _run(spark, download_images=False)
    assert got[1] == ("t ![X](https://a.org/x.png) ![](https://a.org/x.png)\n", 0, 0)


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assets = spark.createDataFrame([], "url string, status int, content_type string, bytes long")
    assert PI.documents_with_images(pages, assets).count() == 0


def test_nodes_are_not_shuffled(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assets = spark.createDataFrame(ASSETS, "url string, status int, content_type string, bytes long")
    plan = PI.documents_with_images(pages, assets)._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange" in line and "nodes" in line for line in plan.split("\n"))

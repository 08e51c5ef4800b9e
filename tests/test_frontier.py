import pytest
from pyspark.sql import functions as F

from wordmill.sources.tables import RobotConfig
from wordmill.streaming import frontier as fr


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame(
        [("s", 0, "S", ["https://a.example/"], ["a.example"], [], ["^https://a.example/n.*"], [".*\\.jpg$"], 2, 10)],
        "id string, ord int, name string, start_urls array<string>, allowed_domains array<string>, allow_regex array<string>, save_regex array<string>, deny_regex array<string>, max_depth int, max_pages int",
    )


def found(spark, *urls):
    return spark.createDataFrame([(u, u, "s", d) for u, d in urls], "url_norm string, url string, source_id string, depth int")


def test_life_of_an_item(spark):
    f = fr.seed(fr.empty(spark), found(spark, ("x", 1), ("x", 0), ("y", 2)), 100)
    assert sorted((r.url_norm, r.depth, r.status) for r in f.collect()) == [("x", 0, "pending"), ("y", 2, "pending")]
    assert fr.seed(f, found(spark, ("x", 5)), 200).count() == 2
    f = fr.lease(f, 100, 30, 1)
    assert [(r.url_norm, r.status, r.lease_until) for r in f.where("status = 'in_progress'").collect()] == [("x", "in_progress", 130)]
    assert fr.reset_stuck(f, 150, 100).where("status = 'in_progress'").count() == 1
    assert fr.reset_stuck(f, 200, 100).where("status = 'in_progress' or started_at is not null").count() == 0
    results = spark.createDataFrame([("x", 120, 500, "oops")], "url_norm string, now long, next_at long, error string")
    r = fr.finish(f, results).where("url_norm = 'x'").first()
    assert (r.status, r.next_fetch_at, r.last_error, r.lease_until, r.updated_at) == ("pending", 500, "oops", None, 120)
    done = spark.createDataFrame([("x", 130, None, None)], "url_norm string, now long, next_at long, error string")
    r = fr.finish(fr.finish(f, results), done).where("url_norm = 'x'").first()
    assert (r.status, r.last_error) == ("done", None)


def page(url, html, checked):
    return (url, url, "s", "S", html, checked, 200, "text/html", "utf-8", 1)


PAGE = "url_norm string, url string, source_id string, source_name string, raw_html string, checked_at long, status int, content_type string, encoding string, bytes_len long"


def test_upsert(spark):
    empty = spark.createDataFrame([], fr.DOCUMENT)
    one = fr.upsert(empty, spark.createDataFrame([page("x", "a", 10), page("x", "b", 20)], PAGE))
    r = one.first()
    assert (r.raw_html, r.first_seen_at, r.crawled_at, r.changed, r.existed) == ("b", 20, 20, True, False)
    state = one.select(*fr.DOCUMENT_COLUMNS)
    same = fr.upsert(state, spark.createDataFrame([page("x", "b", 30)], PAGE)).first()
    assert (same.checked_at, same.crawled_at, same.changed, same.existed) == (30, 20, False, True)
    other = fr.upsert(state, spark.createDataFrame([page("x", "c", 40), page("y", None, 40)], PAGE)).collect()
    got = {r.url_norm: (r.first_seen_at, r.crawled_at, r.changed) for r in other}
    assert got == {"x": (20, 40, True), "y": (40, 40, True)}


def test_crawl(spark, sources):
    rows = [("https://a.example/", "<a href='/n1'>1</a><a href='/p.jpg'>2</a><a href='https://b.example/'>3</a>"), ("https://a.example/n1", "<a href='/n2'>x</a>"), ("https://a.example/n2", "<a href='/n3'>x</a>")]
    pages = spark.createDataFrame([(u, u, h) for u, h in rows], "url_norm string, url string, raw_html string")
    got = fr.crawl(pages.where("url_norm = 'https://a.example/'").select("url_norm"), pages, sources, 9)
    # Depth 2 is the source's limit.
    assert sorted((r.url_norm[-3:], r.depth) for r in got.collect()) == [("/n1", 1), ("/n2", 2), ("le/", 0)]
    start = pages.where("url_norm = 'https://a.example/'").select("url_norm")
    assert fr.crawl(start, pages, sources, 9, max_total=2).count() == 2 and fr.crawl(start, pages, sources, 9, max_total=0).count() == 0
    assert fr.crawl(start, pages, sources.withColumn("max_pages", F.lit(1)), 9, per_source=True).count() == 1


SEEN = "url_norm string, url string, raw_html string, status int, content_type string, encoding string, bytes_len long"


def seen(*rows):
    return [(u, u, h, 200, "text/html", "utf-8", 9) for u, h in rows]


def test_robot_stream(spark, sources, tmp_path):
    robot = fr.Robot(spark, str(tmp_path / "robot"), sources, RobotConfig(revisit_after_sec=1000, error_backoff_sec=50))
    robot.start(100)
    assert [r.url_norm for r in robot.frontier().collect()] == ["https://a.example/"]
    rows = seen(("https://a.example/", "<a href='/n1'>1</a>"), ("https://a.example/n1", "<p>text</p>"), ("https://b.example/x", "<p>of no source</p>"))
    for k in range(2):
        spark.createDataFrame(rows if not k else rows[:1], SEEN).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SEEN).parquet(str(tmp_path / "in"))
        robot.run(stream, str(tmp_path / "cp"), clock=lambda i: 200 + 100 * i).awaitTermination(120)
        if not k:  # the page came before its URL was known: it waits, and the next batch uses it
            assert [r.url_norm[-2:] for r in robot.waiting().collect()] == ["n1"]
    state = {r.url_norm[-2:]: (r.status, r.next_fetch_at) for r in robot.frontier().collect()}
    assert state == {"e/": ("done", 100), "n1": ("pending", 1300)}
    assert [(r.url_norm[-2:], r.source_name, r.checked_at) for r in robot.collection().collect()] == [("n1", "S", 300)]
    # Only the start page of the second batch waits: it is done.
    assert [r.url_norm[-2:] for r in robot.waiting().collect()] == ["e/"]


def test_robot_takes_all_that_came_and_fails_nothing_else(spark, sources, tmp_path):
    robot = fr.Robot(spark, str(tmp_path / "robot"), sources)
    urls = [f"https://a.example/n{k}" for k in range(1001)]
    robot._commit(fr.seed(fr.empty(spark), found(spark, *((u, 1) for u in [*urls, "https://a.example/other", "https://a.example/boom"])), 10))
    assert robot.lease(20, 2).count() == 2
    pages = spark.createDataFrame([(*r, None) for r in seen(*((u, "<p>x</p>") for u in urls))] + [("https://a.example/boom", "u", None, None, None, None, None, "TimeoutError()")], SEEN + ", error string")
    assert robot.step(pages, 30, "s", 0)
    got = {(r.status, r.last_error): r["count"] for r in robot.frontier().groupBy("status", "last_error").count().collect()}
    # Nothing is marked as failed for not being in the batch; an exception keeps its text.
    other = robot.frontier().where("url_norm like '%other'").first()
    assert got[("pending", "TimeoutError()")] == 1 and other.last_error is None and sum(got.values()) == 1003
    assert robot.collection().count() == 1001 and robot.waiting().count() == 0
    assert {r.next_fetch_at for r in robot.frontier().where("url_norm like '%boom'").collect()} == {30 + 600}


def test_robot_applies_no_batch_twice(spark, sources, tmp_path):
    robot = fr.Robot(spark, str(tmp_path / "robot"), sources)
    robot.COMPACT = 3
    robot.start(100)
    page = spark.createDataFrame(seen(("https://a.example/", "<a href='/n1'>1</a>")), SEEN)
    assert robot.step(page, 200, "s", 0)
    v, before = robot.version(), sorted(map(tuple, robot.frontier().collect()))
    # The batch comes again, as after a failure between its version and the stream's own commit.
    assert not robot.step(page, 300, "s", 0) and robot.version() == v
    assert sorted(map(tuple, robot.frontier().collect()), key=str) == sorted(before, key=str)
    for k in range(1, 6):
        assert robot.step(spark.createDataFrame(seen(("https://a.example/n1", f"<p>{k}</p>")), SEEN), 200 + 100_000 * k, "s", k)
    assert [(r.url_norm[-2:], r.raw_html, r.first_seen_at, r.crawled_at) for r in robot.collection().collect()] == [("n1", "<p>5</p>", 100_200, 500_200)]
    assert not robot.step(page, 9, "s", 2) and robot.step(page, 900_000, "other stream", 0)
    # Versions before the last whole one are gone.
    base = robot._versions()[-1]["base"]
    assert base > 0 and min(int(p.name[2:]) for p in (tmp_path / "robot" / "frontier").iterdir()) == base


def test_outcomes(spark, sources):
    leased = spark.createDataFrame([("https://a.example/n", 1), ("https://a.example/m", 1), ("https://a.example/deep", 3), ("https://b.example/", 0), ("https://a.example/lost", 0)], "url_norm string, depth int")
    got = spark.createDataFrame([("https://a.example/n",), ("https://a.example/m",), ("https://a.example/deep",)], "url_norm string")
    r = {x.url_norm.rsplit("/", 1)[1] or "b": (x.next_at, x.error, x.save) for x in fr.outcomes(leased, got, sources, RobotConfig(), 0).collect()}
    assert r == {"n": (86400, None, True), "m": (None, None, False), "deep": (None, None, False), "b": (None, None, False), "lost": (600, "fetch_failed", False)}
    assert fr.one_per_url(fr.empty(spark)).count() == 0


def test_whole_frontier_queries(spark, tmp_path):
    from wordmill.plans.queries import QUERIES

    rows = [("x", "u", "s", 1, "pending", 5, 2), ("x", "u", "s", 1, "in_progress", 5, 1), ("y", "u", "s", 1, "pending", 5, 1), ("y", "u", "s", 1, "pending", 4, 1), ("z", "u", "s", 1, "done", 5, 1)]
    frontier = spark.createDataFrame([(*r, None, None, None, None) for r in rows], fr.SCHEMA)
    frontier.write.parquet(f"{tmp_path}/frontier.parquet")
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    assert [(r.url_norm, r.next_fetch_at) for r in run("frontier_due")] == [("y", 4)]
    assert sorted((r.url_norm, r.status) for r in run("frontier_lease")) == [("x", "in_progress"), ("y", "in_progress"), ("z", "done")]
    assert sorted((r.url_norm, r.status, r.last_error) for r in run("frontier_finish")) == [("x", "pending", "fetch_failed"), ("y", "pending", None), ("z", "done", None)]


def test_errors_keep_their_text(spark, sources):
    leased = spark.createDataFrame([("https://a.example/n", 1), ("https://a.example/m", 1)], "url_norm string, depth int")
    got = spark.createDataFrame([("https://a.example/n", "x"), ("https://a.example/n", None), ("https://a.example/m", "boom"), ("https://a.example/m", "boom")], "url_norm string, error string")
    r = {x.url_norm[-1]: (x.next_at, x.error, x.save) for x in fr.outcomes(leased, got, sources, RobotConfig(), 0).collect()}
    assert r == {"n": (86400, None, True), "m": (600, "boom", False)}


def test_new_urls_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("x", "2024-01-01 00:00:00"), ("x", "2024-01-01 01:00:00"), ("y", "2024-01-01 02:00:00")], "url_norm string, t string").selectExpr("url_norm", "cast(t as timestamp) fetch_ts")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = fr.new_urls(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("new_urls").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.url_norm for r in spark.table("new_urls").collect()) == ["x", "y"]

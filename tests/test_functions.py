"""Functions against cases worked out by hand."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import legal, text, urls
from tessera.operators import graph, resolution
from tessera.sources import html, package
from tessera.streaming import queue


def value(spark, column, **inputs):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in inputs.items())).select(column.alias("x")).first()["x"]


def test_text_columns(spark):
    x = F.col("x")
    assert value(spark, text.western_digits(x), x="٣/۴") == "3/4"
    assert value(spark, text.strip_tashkeel(x), x="قَانُونـ") == "قانون"
    assert value(spark, text.fold_arabic(x), x="أحمد إلى مدرسة") == "احمد الي مدرسه"
    assert value(spark, text.strip_space(x), x=" \n a b \t") == "a b"
    assert value(spark, text.search_tokens(x), x="Ab c, d_e é f!") == ["ab", "d_e"]


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTP://WWW.Ex.org/A/?b=2&id=7#x", "http://www.ex.org/A?id=7"),
        ("https://ex.org", "https://ex.org/"),
        ("https://ex.org/?utm=1", "https://ex.org/"),
        ("https://ex.org/a?page=2&id=1", "https://ex.org/a?id=1&page=2"),
    ],
)
def test_canonical_urls(spark, url, want):
    assert value(spark, urls.canonical(F.col("u")), u=url) == want


def test_hosts(spark):
    assert value(spark, urls.host(F.col("u")), u="https://www.A.b.org:80/x") == "a.b.org"
    assert value(spark, urls.registrable(F.col("u")), u="m.a.b.org") == "b.org"
    assert value(spark, urls.signature(F.col("u")), u="http://x.y/a12/é?q=1") == "http://x.yN/a*".replace("x.yN/a*", "x.y/aN/*")


def test_ordinals():
    assert len(legal.ORDINALS) == 99 and sorted(legal.ORDINALS.values()) == list(range(1, 100))
    assert legal.ordinal("الحادية  عشرة") == 11 and legal.ordinal("الخامسة والعشرون") == 25 and legal.ordinal("x") == 0


def test_articles():
    body = "نص كامل يكفي لمادة واحدة"
    got = legal.articles(f"مقدمة\nالمادة ١: {body}\nالمادة الثانية - {body}\nالمادة 3 مكرر {body}\nالمادة 4: قصير")
    assert [n for n, _ in got] == ["1", "2", "3 مكرر"] and got[0][1] == body
    assert legal.article_range("المادة/8/ نص المادة 9 نص المادة 12") == (8, 12)
    assert legal.article_range("نص") is None


def test_identity_and_references():
    assert legal.identity("القانون رقم 17 لعام 2010") == "law:17:2010"
    assert legal.identity("المرسوم التشريعي رقم /٣٠/ لعام ٢٠١٢") == "legislative_decree:30:2012"
    assert legal.identity("عنوان", "صدر القانون رقم 5 لسنة 1800") is None
    assert legal.identity("قانون العقوبات 148/1949") == "law:148:1949" and legal.identity("قانون قمع التهريب13 - 1974") == "law:13:1974"
    assert legal.identity("قانون العقوبات رقم 148/1949") == "law:148:1949" and legal.identity("عنوان", "انظر القانون 10/2014") is None
    assert legal.identity("المرسوم الاشتراعي رقم 5 لعام 1950") == "legislative_decree:5:1950"
    assert legal.identity("القرار الجمهوري رقم 7 تاريخ 22/6/1961") == "presidential_decision:7:1961"
    assert legal.identity("قانون العقوبات المعدل بالمرسوم رقم 12 لعام 2001") == "decree:12:2001"
    assert legal.identity("القانون المدني الصادر بالمرسوم رقم 84 لعام 1949") == "law:84:1949"
    refs = legal.references("وفق القانون رقم 1 لعام 2001 والقانون رقم 1 لعام 2001 والمرسوم رقم 2 لعام 2002")
    assert [k for k, *_ in refs] == ["law:1:2001", "decree:2:2002"]


def test_intent():
    assert legal.intent("يلغى القانون رقم 5") == "repeal"
    assert legal.intent("تُلغى المادة 3 من القانون") == "amend"
    assert legal.intent("تلغى جميع الأحكام المخالفة لأحكام القانون") == "cite"
    assert legal.intent("ينهى العمل بالقانون") == "repeal" and legal.intent("ينهى العمل بأحكام المادتين 1 و2 من القانون") == "amend"
    assert legal.intent("تُلغى المادة 3 ويلغى القانون") == "repeal" and legal.intent("تلغى نصوص المواد 7 و14") == "amend"
    assert legal.intent("يعدل القانون") == "amend" and legal.intent("وفق القانون") == "cite"


def test_dates():
    assert legal.issue_date("دمشق في 19/7/1427 هجري الموافق 13/8/2006") == ("2006-08-13", "19/7/1427")
    assert legal.issue_date("دمشق في 31/2/2006") == (None, None)
    assert [legal.short_year(y) for y in (5, 31, 99, 950, 1999)] == [2005, 1931, 1999, 1950, 1999]


def test_citation():
    got = legal.citation("نقض سوري قرار 1890 أساس 2914 تاريخ 9/11/1997 مجلة المحامون")
    assert got["key"] == "نقض|1890|1997|2914" and got["confidence"] >= 0.9
    assert legal.citation("نص عادي")["key"] is None


def test_chunks():
    assert legal.chunks("") == [] and legal.chunks("short") == ["short"]
    long = "\n".join(f"line {i} " + "x" * 300 for i in range(10)) + "\n" + "y" * 2500
    got = legal.chunks(long, 1200)
    assert all(len(c) <= 1200 for c in got) and "".join(got).replace(" ", "") == long.replace(" ", "").replace("\n", "")


def test_html():
    page = html.parse("<html><head><title>T &amp; U</title><script>var a='</p>';</script></head><body><nav><a href='/n'>n</a></nav><article><p><b>One<br><p>two <a href='x'>l</a></article>")
    assert "".join(page.title) == "T & U" and page.text() == "One\ntwo l" and page.links == [("/n", ["n"]), ("x", ["l"])]
    assert html.same_host("http://www.a.org/x", "https://a.org") and not html.same_host("http://a.org", "http://b.org")


def test_fold_is_ordered(spark):
    """A beats B, B beats C, C beats A: the fold in order of id ends with C after two looks at A."""
    made = [(1, 1, (1, 1, 5, True, 0.5, True, 9)), (1, 2, (2, 3, 20, True, 0.5, True, 9)), (1, 3, (3, 4, 30, True, 0.5, True, 9))]
    df = spark.createDataFrame(made, f"k int, order int, {CANDIDATE}")
    assert resolution.ordered_fold(df).first().asDict() == {"k": 1, "survivor": 3, "members": 3, "replaced": 1}


CANDIDATE = "c struct<id:int,tier:int,articles:int,complete:boolean,quality:double,hierarchy:boolean,length:int>"


@pytest.mark.parametrize(
    "better",
    [(2, 1, 9, True, 0.5, True, 90), (2, 2, 9, True, 0.6, False, 1), (2, 2, 10, True, 0.5, False, 1), (2, 2, 9, True, 0.5, True, 91), (2, 4, 29, False, 0.0, False, 1)],
)
def test_six_criteria(spark, better):
    """Each criterion decides where those before it are equal; the same candidate again changes nothing."""
    old = (1, 2, 9, True, 0.5, better[5] if better[4] == 0.5 and better[2] == 9 else True, 90)
    for first, second, survivor in ((old, better, 2), (better, old, 2), (old, old, 1)):
        df = spark.createDataFrame([(1, 1, first), (1, 2, second)], f"k int, order int, {CANDIDATE}")
        assert resolution.ordered_fold(df).first()["survivor"] == survivor


def test_components(spark):
    df = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (20, 21), (7, 7)], "a long, b long")
    assert {r["node"]: r["component"] for r in graph.components(df).collect()} == {3: 3, 4: 3, 5: 3, 9: 3, 20: 20, 21: 20, 7: 7}


def test_queue_states(spark):
    df = spark.createDataFrame([("blocked_by_robots", 1, True), ("http_404", 1, True), ("http_500", 1, True), ("timeout", 2, True), (None, 1, True), (None, 1, False)], "e string, a int, g boolean")
    got = [r[0] for r in df.select(queue.next_state(F.col("e"), F.col("a"), F.col("g"))).collect()]
    assert got == ["blocked", "failed", "queued", "failed", "success", "needs_review"]


def test_stream_state_equals_batch(spark, tmp_path):
    """Streaks kept as stream state over files equal the streaks of the whole log."""
    log = [(k, s, (s * 7 + k) % 3 == 0) for k in range(4) for s in range(30)]
    for part in range(3):
        spark.createDataFrame([r for r in log if part * 10 <= r[1] < part * 10 + 10], "key long, seq long, ok boolean").coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    import shutil

    for part in range(3):
        for f in (tmp_path / "in" / str(part)).glob("*.parquet"):
            (tmp_path / "flat").mkdir(exist_ok=True)
            shutil.move(f, tmp_path / "flat" / f"{part}.parquet")
    stream = spark.readStream.schema("key long, seq long, ok boolean").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/flat")
    seen = {}
    run = queue.streaks(stream).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/c").foreachBatch(lambda df, _: seen.update({r["key"]: (r["streak"], r["longest"]) for r in df.collect()})).trigger(availableNow=True).start()
    run.awaitTermination(120)
    want = {}
    for k, _, ok in sorted(log):
        streak, longest = want.get(k, (0, 0))
        streak = 0 if ok else streak + 1
        want[k] = (streak, max(longest, streak))
    assert seen == want


def test_package(spark):
    index = spark.createDataFrame([("a", "1", 1), ("b", "2", 1), ("c", "3", 2), ("c", "3", 2)], "ipath string, isha string, ibytes int")
    files = spark.createDataFrame([("a", "1", 1), ("b", "x", 2), ("z", "9", 1)], "path string, sha string, bytes int")
    assert package.gate(index, files).first().asDict() == {"listed": 4, "duplicate_paths": 1, "missing": 1, "wrong_hash": 1, "wrong_size": 1, "unlisted": 1}
    assert value(spark, package.file_name(F.col("t")), t=' a/b:  c" ') == "ab_c"


def test_landing(spark, tmp_path):
    import io
    import json
    import zipfile

    from tessera.sources import landing

    xml = spark.createDataFrame([("s", "<urlset><url><loc> http://a/law/1 </loc></url><loc>http://a/page/2</loc><loc>http://a/law/1</loc></urlset>")], "source string, body string")
    assert [r["url"] for r in landing.sitemap_urls(xml, ["/law/"]).collect()] == ["http://a/law/1"]
    robots = spark.createDataFrame([("a.org", "User-agent: *\nSitemap: https://a.org/s.xml\n"), ("b.org", "")], "host string, body string")
    assert sorted(r["sitemap"] for r in landing.robots_sitemaps(robots).collect()) == ["https://a.org/s.xml", "https://b.org/sitemap.xml"]
    feed = {"feed": {"entry": [{"title": {"$t": "T"}, "content": {"$t": "<p>x"}, "link": [{"rel": "self", "href": "no"}, {"rel": "alternate", "href": "http://b/1"}]}]}}
    (tmp_path / "feed.json").write_text(json.dumps(feed))
    assert landing.feed_posts(spark, str(tmp_path / "feed.json")).first().asDict() == {"url": "http://b/1", "title": "T", "html": "<p>x"}
    (tmp_path / "posts.json").write_text(json.dumps([{"id": i, "title": {"rendered": t}, "content": {"rendered": ""}} for i, t in ((1, "article 2"), (2, "article 1"), (3, "heading"))]))
    assert [r["number"] for r in landing.numbered_posts(spark, str(tmp_path / "posts.json")).collect()] == [1, 2, None]
    cdx = spark.createDataFrame([("http://f/t1-x?sid=9", "20200101"), ("http://f/t1-x", "20100101"), ("http://f/t1-x", "20110101")], "url string, timestamp string")
    assert landing.thread_map(cdx).first().asDict() == {"thread": "1", "url": "http://f/t1-x", "timestamp": "20110101"}
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a.txt", "نص")
        z.writestr("b.txt", "نص".encode("windows-1256"))
    files = spark.createDataFrame([("x.zip", packed.getvalue()), ("y.html", b"<html>"), ("z.zip", b"PK\x03\x04broken")], "path string, content binary")
    assert [r[0] for r in files.select(landing.kind(F.col("content"))).collect()] == ["zip", "html", "zip"]
    got = {r["source"]: (r["text"], r["error"]) for r in landing.file_texts(files).collect()}
    assert got == {"x.zip#a.txt": ("نص", None), "x.zip#b.txt": ("نص", None), "y.html": ("<html>", None), "z.zip": (None, "BadZipFile")}


PARTS = "id long, number int, year int, title string, lo int, hi int, kind string"


def linked(spark, rows):
    from tessera.operators import parts

    return {r["id"]: (r["part_of"], r["year"]) for r in parts.link_parts(spark.createDataFrame(rows, PARTS)).collect()}


def test_limits_leave_error_rows():
    from tessera.sources import landing

    def zipped(members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in members.items():
                z.writestr(name, data)
        return out.getvalue()

    w = landing.WORD_ML.strip("{}")
    word = zipped({landing.MAIN_PART: f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>a</w:t></w:r><w:r><w:t>b</w:t></w:r></w:p><w:p><w:t>c</w:t></w:p></w:body></w:document>'})
    raw = zipped({"1.txt": "x", "2.docx": word, "3.zip": zipped({"in.zip": zipped({"deep.txt": "d"})}), "4.txt": "y" * 50, "5.txt": "z"})
    got = {n: (t, e) for n, t, e in landing.expanded("f", raw, landing.Limits(members=4, depth=2, size=1000))}
    assert got == {"f#1.txt": ("x", None), "f#2.docx": ("ab\nc", None), "f#3.zip#in.zip#deep.txt": (None, "TooDeep"), "f#4.txt": ("y" * 50, None), "f#5.txt": (None, "TooMany")}
    small = {n: e for n, _, e in landing.expanded("f", raw, landing.Limits(size=40))}
    assert small["f#4.txt"] == "TooLarge" and small["f#1.txt"] is None


def test_parts(spark):
    made = [(277, 30, None, "كهرباء الريف", 1, 9), (278, 30, None, "كهرباء الريف", 10, 40), (280, 30, 2010, "قانون السير", 1, 60), (281, 30, 2010, "قانون السير", 61, 90), (290, 31, None, "وحيد", 1, 5)]
    assert linked(spark, [(*r, None) for r in made]) == {277: (278, None), 278: (None, None), 280: (None, 2010), 281: (280, 2010)}
    assert linked(spark, []) == {}


def test_parts_of_different_laws_stay_apart(spark):
    """One number and year, but two instruments: nothing in the titles is shared."""
    made = [(44, 15, 2008, "إحداث مؤسسة", 1, 30, "law"), (100, 15, 2008, "التطوير العقاري", 1, 12, "law")]
    assert linked(spark, made) == {}
    # A general title goes with both; regulations and other kinds don't.
    general = [*made, (120, 15, 2008, "وثيقة قانونية سورية", 31, 50, "law")]
    assert linked(spark, general) == {44: (None, 2008), 100: (44, 2008), 120: (44, 2008)}
    other = [made[0], (45, 15, 2008, "إحداث مؤسسة", 31, 60, "decision"), (46, 15, 2008, "إحداث مؤسسة", 61, 70, "regulation")]
    assert linked(spark, other) == {}
    mixed = [made[0], (45, 15, 2008, "إحداث مؤسسة", 31, 60, "legislative_decree")]
    assert linked(spark, mixed) == {44: (None, 2008), 45: (44, 2008)}


def test_undated_parts_take_a_year(spark):
    rows = [(1, 9, 1990, "نظام الضرائب", 1, 40, None), (2, 9, None, "ضرائب الدخل", 41, 50, None), (3, 9, None, "الدخل المقطوع", 51, 60, None), (4, 9, None, "", 3, 12, None), (5, 9, None, "السير المروري", 3, 12, None)]
    got = linked(spark, rows)
    # 2 shares a word with 1, 3 with 2; 4 has no title and lies inside 1; 5 has another subject.
    assert got == {1: (None, 1990), 2: (1, 1990), 3: (1, 1990), 4: (1, 1990)}
    # Nearly the same wide range is one law under two titles.
    assert linked(spark, [(1, 9, 1990, "نظام الضرائب", 1, 100, None), (2, 9, 1990, "مكافحة التهريب", 1, 95, None)]) == {1: (None, 1990), 2: (1, 1990)}


def test_package_is_written(spark, tmp_path):
    docs = spark.createDataFrame([(1, "T", 5, 2001, "active", [("1", "body")]), (2, "T", 5, 2002, "active", [])], "id long, title string, number int, year int, status string, articles array<struct<number:string,text:string>>")
    package.write(docs, str(tmp_path / "p"))
    assert sorted(r["local_path"] for r in spark.read.parquet(f"{tmp_path}/p/files").collect()) == ["T.md", "T_2.md"]
    assert spark.read.json(f"{tmp_path}/p/manifest").first()["files"] == 2
    assert package.index_text([(1, "a", "b,c", 1, 2, "s", "h", 3)]).startswith("﻿id,") and '"b,c"' in package.index_text([(1, "a", "b,c", 1, 2, "s", "h", 3)])
    both = package.merged(spark.createDataFrame([(1, "a", "old"), (2, "b", "keep")], "id int, local_path string, v string"), spark.createDataFrame([(1, "a", "new")], "id int, local_path string, v string"))
    assert sorted(r["v"] for r in both.collect()) == ["keep", "new"]


def test_precedents(spark):
    from tessera.functions import precedents

    page = "لا يجوز سماع الدعوى قبل أوانها المحدد قانونا\n(نقض سوري قرار 1890 أساس 2914 تاريخ 9/11/1997)\nنص\n(نقض قرار 1890 أساس 2914 تاريخ 9/11/1997)\n(كلام عادي)"
    found = precedents.cited(page)
    assert [c["key"] for c in found] == ["نقض|1890|1997|2914"] and found[0]["principle"].startswith("لا يجوز")
    assert precedents.article_references("المادة 5 من قانون العقوبات والمادة ٧") == [(5, "قانون العقوبات", 0.9), (7, None, 0.4)]
    assert precedents.article_references("المادة 9 من قانون أصول المحاكمات") == [(9, "قانون أصول المحاكمات", 0.9)]
    assert precedents.overrulings("قررت الهيئة العدول عن الاجتهاد في قرار رقم 12 أساس 30.") == [(12, 30)]
    df = spark.createDataFrame([("u1", page), ("u2", page.replace("لا يجوز", "يجوز")), ("u3", None)], "url string, text string")
    decided = precedents.decisions(precedents.parse_pages(df))
    row = decided.first()
    assert (row["sources"], row["year"], row["number"]) == (2, 1997, 1890) and row["principle"].startswith("لا يجوز")
    assert [r["approved"] for r in precedents.approved(decided).collect()] == [True]
    targets = spark.createDataFrame([("x", 1890, 2914), ("x", 1890, None), ("x", 1, None)], "by_key string, number long, basis long")
    assert sorted((r["target"] or "") for r in precedents.relations(targets, decided).collect()) == ["", "نقض|1890|1997|2914", "نقض|1890|1997|2914"]


def test_law_graph(spark):
    from tessera.operators import law_graph

    docs = spark.createDataFrame(
        [
            (1, "law:1:2000", "قانون أول", 2000, "active", None, "نص القانون"),
            (2, "law:2:2005", "قانون ثان", 2005, "active", "instrument", "يلغى القانون رقم 1 لعام 2000 ويعمل بهذا"),
            (3, "law:3:1990", "قانون ثالث", 1990, "active", "instrument", "يعدل القانون رقم 2 لعام 2005"),
            (4, "law:4:2010", "مناقشة", 2010, "active", "travaux", "يلغى القانون رقم 2 لعام 2005"),
            (5, "law:5:2011", "خامس", 2011, "active", "instrument", "يعدل المرسوم رقم 9 لعام 1999"),
        ],
        "id long, identity string, title string, year int, status string, nature string, text string",
    )
    found = law_graph.edges(docs)
    assert sorted((r["source_id"], r["target"], r["action"]) for r in found.collect()) == [(2, "law:1:2000", "repeal"), (3, "law:2:2005", "amend"), (4, "law:2:2005", "repeal"), (5, "decree:9:1999", "amend")]
    status = {r["id"]: r["legal_status"] for r in law_graph.legal_status(docs, found).collect()}
    assert status == {1: "repealed", 2: "in_force", 3: "in_force", 4: "in_force", 5: "in_force"}  # older, and no instrument
    assert [(r["target"], r["score"]) for r in law_graph.missing_targets(docs, found).collect()] == [("decree:9:1999", 3)]
    assert law_graph.queries_for(law_graph.missing_targets(docs, found)).first()["query"] == "المرسوم رقم 9 لعام 1999 سوريا نص كامل"
    assert law_graph.chain(docs, found).filter("target = 'law:2:2005'").first()["source_id"] == 3


def test_queue_tables(spark):
    from tessera.streaming import tables

    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    empty = spark.createDataFrame([], tables.TASK)
    urls = spark.createDataFrame([("http://a/1", "topic", 1), ("http://a/2", "topic", 2), ("http://www.b/1", "topic", 3), ("http://a/1#x", "topic", 4)], "url string, kind string, seq long")
    tasks = tables.enqueue(empty, urls, now)
    assert tasks.count() == 3 and tables.enqueue(tasks, urls, now).count() == 3
    assert {r["domain"]: r["url"] for r in tables.claim(tasks, 2).collect()} == {"a": "http://a/1", "b": "http://www.b/1"}
    done = tables.mark(tasks, spark.createDataFrame([("http://a/1", "failed"), ("http://a/2", "running")], "url string, new_status string"), now)
    assert {r["url"]: (r["status"], r["attempts"]) for r in done.collect()} == {"http://a/1": ("failed", 1), "http://a/2": ("running", 1), "http://www.b/1": ("queued", 0)}
    assert tables.requeue(done, ["failed"], now).filter("status = 'queued' and attempts = 0").count() == 2
    later = F.lit("2024-01-01 00:11:00").cast("timestamp")
    assert tables.rescue(done, later).filter("status = 'running'").count() == 0 and tables.rescue(done, now).filter("status = 'running'").count() == 1
    state = spark.createDataFrame([("a", 2, 0), ("z", 5, 2)], "source string, total long, empty_runs long")
    docs = spark.createDataFrame([("http://a/1", "x"), ("http://a/2", "y"), ("http://a/3", "z")], "url string, identity string")
    assert {r["source"]: (r["total"], r["fresh"], r["empty_runs"], r["status"]) for r in tables.performance(state, docs).collect()} == {"a": (3, 1, 0, "active"), "z": (5, 0, 3, "exhausted")}
    channels = spark.createDataFrame([(2, "http://n/1", "b"), (1, "http://n/1#q", "a"), (1, "http://a/9", "a")], "ord int, url string, why string")
    assert [(r["url"], r["ord"]) for r in tables.candidates(channels, spark.createDataFrame([("a",)], "host string")).collect()] == [("http://n/1", 1)]


def test_curation(spark):
    from tessera.operators import curation

    schema = f"url string, identity string, sha string, {CANDIDATE}"
    stored = spark.createDataFrame([("u1", "k1", "s1", (1, 2, 10, True, None, None, None), "active"), ("u2", "k2", "s2", (2, 2, 10, True, None, None, None), "active")], schema + ", status string")
    new = spark.createDataFrame([("u1", "k1", "s1", (9, 1, 10, True, None, None, None)), ("u2", "k2", "x", (9, 1, 10, True, None, None, None)), ("u3", "k1", "y", (9, 1, 10, True, None, None, None)), ("u4", "k1", "z", (9, 3, 10, True, None, None, None)), ("u5", "k9", "w", (9, 3, 10, True, None, None, None)), ("u6", None, "v", (9, 3, 10, True, None, None, None))], schema)
    got = {r["url"]: (r["action"], r["superseded"]) for r in curation.resolved(stored, new).collect()}
    assert got == {"u1": ("skip_same", None), "u2": ("upgrade", None), "u3": ("supersede", "u1"), "u4": ("alternate", None), "u5": ("insert", None), "u6": ("insert", None)}
    rows = [(1, None, None, None, None), (2, None, None, None, 5), (3, "a", None, None, None), (4, None, "b", "title", 1), (5, "a", "a", "title", 1), (6, "a", "b", "preamble", 1), (7, "a", "b", "title", 1)]
    outcomes = curation.reidentified(spark.createDataFrame(rows, "doc_id int, identity string, new_key string, new_source string, new_number int")).collect()
    assert {r["doc_id"]: (r["outcome"], r["identity"]) for r in outcomes} == {1: ("no_match", None), 2: ("partial", None), 3: ("unchanged", "a"), 4: ("gained", "b"), 5: ("unchanged", "a"), 6: ("kept_existing", "a"), 7: ("updated", "b")}
    docs = spark.createDataFrame([(1, "أهلا", "s", 2), (2, "اهلا", "s", 2), (3, "x", "", 1), (4, "y", "", 1), (5, "z", "q", 0), (6, "دولة أجنبية", "r", 3)], "doc_id int, title string, sha string, articles int")
    assert sorted(r["doc_id"] for r in curation.pruned(docs, ["اجنبية"]).collect()) == [1, 3, 4]
    heads = spark.createDataFrame([(1, "قانون مستثنى", "active", None), (2, "جزء", "active", 1), (3, "غيره", "active", None)], "doc_id int, title string, status string, part_of int")
    assert {r["doc_id"]: r["status"] for r in curation.excluded(heads, ["مستثنى"]).collect()} == {1: "excluded", 2: "excluded", 3: "active"}
    core = spark.createDataFrame([("a",), ("b",)], "identity string")
    have = spark.createDataFrame([(1, "a", "superseded", True, 9), (2, "a", "active", True, 3)], "doc_id int, identity string, status string, complete boolean, articles int")
    assert {r["identity"]: (r["doc_id"], r["covered"]) for r in curation.coverage(core, have).collect()} == {"a": (2, True), "b": (None, False)}
    assert value(spark, curation.gate(F.lit(True), F.lit(0), F.lit(90))) == "no_articles"
    assert value(spark, curation.triage(F.col("t"), F.col("x")), t="مشروع قانون", x="ن " * 300) == "draft"


def test_article_edges(spark):
    from tessera.functions import article_edges as ae

    assert ae.numbers("5 و 7 إلى 9 و١١ مكرر") == ["5", "7", "8", "9", "11 مكرر"] and ae.numbers("9 إلى 2") == ["9"]
    text = "تعدل المادتين 3 و 4 من القانون رقم 1 لعام 2000 وتلغى المادة 9 من القانون رقم 1 لعام 2000. يعدل ما يلي. المادة 5 من القانون رقم 2 لعام 2001"
    want = [("law:1:2000", "3", "amend"), ("law:1:2000", "4", "amend"), ("law:1:2000", "9", "repeal")]
    assert ae.article_amendments(text) == want and ae.article_amendments(text, "law:1:2000") == []
    docs = spark.createDataFrame([(1, "law:1:2000", 2000, ""), (2, "law:7:2010", 2010, text), (3, "law:8:1990", 1990, text)], "id long, identity string, year int, text string")
    edges = ae.article_edges(docs)
    articles = spark.createDataFrame([("law:1:2000", n) for n in ("3", "9", "10")], "identity string, article string")
    got = {r["article"]: (r["state"], len(r["amended_by"] or [])) for r in ae.amended_articles(articles, edges, docs).collect()}
    assert got == {"3": ("amended", 1), "9": ("repealed", 1), "10": ("in_force", 0)}


def test_holders(spark):
    from tessera.operators import retrieval

    docs = spark.createDataFrame([(1, "aa bb cc dd"), (2, "xaa bb ccx"), (3, "bb"), (4, None), (5, "aa  bb cc")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "aa bb cc"), (2, "bb"), (3, "zz bb cc"), (4, "aa zz cc"), (5, None), (6, "b c")], "item_id long, text string")
    assert sorted(tuple(r) for r in retrieval.holders(docs, asked).collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (2, 5), (6, 1), (6, 2), (6, 5)]

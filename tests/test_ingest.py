"""Readers, importers, upserts, repairs and pages."""

import json

from pyspark.sql import functions as F

from claimloom.functions import html, labels
from claimloom.operators import ingest
from claimloom.sources import corpus as io
from claimloom.sources import tables


def write(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), "utf-8")


def test_corpus_reader_skips_broken_and_empty(spark, tmp_path):
    write(tmp_path / "b.json", {"id": "b", "body_text": "текст", "date": None, "extra": 1})
    write(tmp_path / "a.json", json.dumps({"id": "a", "body_text": "рядок\nдругий", "word_count": 2}, indent=2))
    write(tmp_path / "c.json", {"id": "c", "body_text": ""})
    write(tmp_path / "d.json", {"id": "d"})
    write(tmp_path / "e.json", "{broken")
    write(tmp_path / "f.txt", "ignored")
    docs = io.read_corpus(spark, str(tmp_path)).orderBy("file_name").collect()
    assert [r["id"] for r in docs] == ["a", "b"]
    assert docs[0]["word_count"] == 2
    assert [r["file_name"] for r in io.unreadable_files(spark, str(tmp_path)).collect()] == ["e.json"]
    stored = str(tmp_path / "stored")
    io.store(io.read_corpus(spark, str(tmp_path)), stored)
    assert io.read_stored(spark, stored).count() == 2
    assert io.find_document(io.read_stored(spark, stored), "a").count() == 1
    assert io.list_documents(io.read_stored(spark, stored)).collect()[1]["date"] == "?"


def test_envelope_and_maps(spark, tmp_path):
    write(tmp_path / "dess.json", {
        "articles": [{"url": "https://dess.gov.ua/x", "title": "T", "date": "25.12.2024 10:00", "body": "B"}],
        "failed": [{"url": "u", "error": "HTTP 404"}], "total_listing_urls": 2})
    rows = io.read_envelope(spark, str(tmp_path / "dess.json")).collect()
    assert rows[0]["seq"] == 0 and rows[0]["body"] == "B"
    assert io.read_failed(spark, str(tmp_path / "dess.json")).collect()[0]["error"] == "HTTP 404"
    write(tmp_path / "map.json", {"7001": "2019-01-01", "7002": "2020-01-01"})
    assert io.read_map(spark, str(tmp_path / "map.json"), "rada_id", "map_date").count() == 2
    write(tmp_path / "speech.json", [{"url": "u1", "title": "", "date": "", "body_text": "x" * 60, "word_count": 1}])
    assert io.read_speeches(spark, str(tmp_path / "speech.json")).count() == 1


def test_link_lists(spark, tmp_path):
    folder = tmp_path / "links"
    folder.mkdir()
    write(folder / "poroshenko_risu_links.csv",
          'url,title\n"https://risu.ua/a,Перша, стаття 30.11.2015, 11:18"\n\\"https://risu.ua/b\\",\\"Друга\\"\n\nне посилання\n'
          'слово https://risu.ua/c, Третя\n')
    write(folder / "poroshenko_ppu.gov.ua_links.csv", "https://ppu.gov.ua/z,Z\n")
    found = {r["url"]: (r["title"], r["source"]) for r in io.read_links(spark, str(folder)).collect()}
    assert found == {
        "https://risu.ua/a": ("Перша, стаття", "risu.ua"),
        "https://risu.ua/b": ("Друга", "risu.ua"),
        "https://risu.ua/c": ("Третя", "risu.ua"),
        "https://ppu.gov.ua/z": ("Z", "ppu.gov.ua"),
    }


def articles(spark, rows):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "seq int, url string, title string, date string, body string, rada_id int",
    )


def test_upsert(spark):
    key = "https://risu.ua/one"
    held = spark.createDataFrame(
        [(labels_id(spark, key), key, "Назва", "2019-01-01", "risu_article", "risu.ua", "старе", 1),
         ("other", "u", "Інша", "2018-01-01", "speech", "x", "лишається", 1)],
        "id string, url string, title string, date string, content_type string, source string, body_text string, word_count int",
    )
    new = ingest.imported(
        articles(spark, [
            (key, "", None, "нове тіло " * 10, None),
            (key, "Пізніша назва", "05.06.2021", "ще новіше тіло " * 10, None),
            (key, "", None, "останнє тіло " * 10, None),
            ("https://risu.ua/two", "", None, "друге тіло " * 10, 7),
            ("https://risu.ua/short", "S", None, "мало", None),
        ]), "risu_article", "risu.ua", min_chars=50)
    out = {r["url"]: r for r in ingest.upsert(held, new, default_title=F.lit("Без назви")).collect()}
    assert set(out) == {key, "u", "https://risu.ua/two"}
    # As if applied one after the other: last body, last given title and date.
    assert out[key]["title"] == "Пізніша назва" and out[key]["date"] == "2021-06-05"
    assert out[key]["body_text"].startswith("останнє") and out[key]["word_count"] == 20
    assert out[key]["action"] == "updated" and out[key]["updated_at"]
    assert out["u"]["body_text"] == "лишається" and out["u"]["action"] == "kept" and out["u"]["updated_at"] is None
    assert out["https://risu.ua/two"]["title"] == "Без назви"
    assert out["https://risu.ua/two"]["action"] == "created" and out["https://risu.ua/two"]["rada_id"] == 7
    counts = {r["action"]: r["n"] for r in ingest.action_counts(ingest.upsert(held, new)).collect()}
    assert counts == {"updated": 1, "kept": 1, "created": 1}


def labels_id(spark, url):
    return spark.range(1).select(labels.doc_id(F.lit(url)).alias("i")).collect()[0]["i"]


def test_insert_if_absent_keeps_first(spark):
    new = ingest.imported(
        articles(spark, [("u1", "перша", None, "b1", None), ("u1", "друга", None, "b2", None), ("u2", "t", None, "b3", None)]),
        "dess_statement", "dess.gov.ua")
    held = new.where("url = 'u2'").withColumn("body_text", F.lit("тримається")).drop("seq")
    out = {r["url"]: r["body_text"] for r in ingest.insert_if_absent(held, new).collect()}
    assert out == {"u1": "b1", "u2": "тримається"}


def test_ids_and_hosts(one):
    import hashlib

    url = "https://www.president.gov.ua/news/ж"
    assert one(labels.doc_id(F.lit(url))) == hashlib.md5(url.encode()).hexdigest()[:12]
    wrapped = F.lit("https://web.archive.org/web/20200101000000/" + url)
    assert one(labels.doc_id(wrapped, drop_archive_prefix=True)) == one(labels.doc_id(F.lit(url)))
    assert one(labels.canonical_host(F.lit("https://rada.gov.ua/x"))) == "https://www.rada.gov.ua/x"
    assert one(labels.normalised_source(F.lit("sbu.gov.ua"))) == "ssu.gov.ua"
    assert one(labels.absolute_url(F.lit("/a"), "https://b")) == "https://b/a"
    assert one(labels.kappa_band(F.lit(0.81))) == "almost perfect"
    assert one(labels.kappa_band(F.lit(-0.2))) == "poor"


def test_date_repairs_and_tags(spark):
    docs = spark.createDataFrame(
        [("1", "risu.ua", "risu_article", None, "Про подію", "Сталося 5 мая 2019 года у Києві", "https://risu.ua/poroshenko-x", None),
         ("2", "risu.ua", "risu_article", "2020-01-01", "T", "Сталося 5 мая 2019 года у Києві", "https://risu.ua/y", None),
         ("3", "rada.gov.ua", "rada_stenogram", None, "T", "x", "https://rada.gov.ua/1", 7001),
         ("4", "rada.gov.ua", "rada_stenogram", None, "T", "x", "https://rada.gov.ua/2", 7002)],
        "id string, source string, content_type string, date string, title string, body_text string, url string, rada_id int",
    )
    filled = {r["id"]: (r["date"], r["date_source"]) for r in ingest.fill_missing_dates(docs).collect()}
    assert filled["1"] == ("2019-05-05", "extracted_from_body") and filled["2"] == ("2020-01-01", None)
    assert filled["3"] == (None, None)
    mapping = spark.createDataFrame([("7001", "2018-02-02")], "rada_id string, map_date string")
    kept = {r["id"]: r["date"] for r in ingest.apply_date_mapping(docs, mapping).collect()}
    assert kept == {"1": None, "2": "2020-01-01", "3": "2018-02-02"}
    assert ingest.apply_date_mapping(docs, mapping, clean=False).count() == 4
    tagged = ingest.tag_speakers(docs)
    assert {r["id"]: r["speaker_attribution"] for r in tagged.collect()} == {"1": "poroshenko", "2": "none", "3": None, "4": None}
    manual = spark.createDataFrame([("2", "poroshenko"), ("1", "somebody")], "id string, attribution string")
    assert {r["id"]: r["speaker_attribution"] for r in ingest.override_speakers(tagged, manual).collect()}["2"] == "poroshenko"
    broken = ingest.urls_to_refetch(docs).collect()
    assert {r["url"] for r in broken} == {"https://rada.gov.ua/1", "https://rada.gov.ua/2"}
    late = docs.withColumn("date", F.when(F.col("id") == "2", "2026-01-01"))
    assert {r["id"] for r in ingest.in_period(late).collect()} == {"1", "3", "4"}


PAGE = """<html><head><title>x</title><meta property="article:published_time" content="2021-02-03T00:00:00"></head>
<body><nav><a href="/news/all">Усі</a></nav><h1> Головна <b>новина</b></h1><time datetime="2021-02-03">3 лютого</time>
<div class="wide article_content"><p>Перший &laquo;абзац&raquo; тексту.<p>Другий абзац<br>з рядком<script>no()</script></div>
<div id="content"><div class="field-item">інше</div></div></body></html>"""


def page(spark, text, column):
    return spark.createDataFrame([(text,)], "html string").select(column.alias("v")).collect()[0]["v"]


def test_article_profiles(spark):
    a = page(spark, PAGE, html.parse_article(F.col("html"), "office"))
    assert (a["title"], a["date_text"]) == ("Головнановина", "2021-02-03")
    assert a["body_text"] == "Перший «абзац» тексту.\nДругий абзац\nз рядком"
    bare = "<h2 class='title'>T</h2><span class='news-date'>01.02.2020</span><article>Тіло</article>"
    r = page(spark, bare, html.parse_article(F.col("html"), "risu.ua"))
    assert tuple(r) == ("T", "01.02.2020", "Тіло")
    assert tuple(page(spark, "<nav>menu</nav>", html.parse_article(F.col("html")))) == ("", "", "")
    assert tuple(page(spark, None, html.parse_article(F.col("html")))) == ("", "", "")


def test_listing_and_sessions(spark):
    listing = ("<div class='item_stat_headline'><a href='/news/one'>Перша новина</a><span class='date'>1.1.2020</span></div>"
               "<div class='item_stat_headline'><a href='/news/one'>Перша новина</a></div>"
               "<div class='item_stat_headline'><a href='https://x.ua/two'>Дві</a></div>")
    items = page(spark, listing, html.listing_links(F.col("html"), "https://b"))
    assert [tuple(i) for i in items] == [("Перша новина", "https://b/news/one", "1.1.2020")]
    plain = "<a href='/news/long'>Достатньо довга назва</a><a href='/news/page/2'>Наступна сторінка новин</a><a href='/other'>Інша довга назва тут</a>"
    assert [i["url"] for i in page(spark, plain, html.listing_links(F.col("html"), "https://b"))] == ["https://b/news/long"]
    body = "Слово має депутат. " * 40
    record = f"<div class='item_content'><h2>Засідання перше</h2>{body}</div><div class='WordSection1'>мало</div>"
    s = page(spark, record, html.parse_session(F.col("html")))
    assert s["title"] == "Засідання перше" and s["body_text"].startswith("Засідання перше\nСлово має")
    parts = page(spark, PAGE, html.page_parts(F.col("html")))
    assert parts["links"] == ["/news/all"] and parts["time"] == "2021-02-03"
    assert parts["meta"]["article:published_time"].startswith("2021-02-03")
    assert parts["paragraphs"][0] == "Перший «абзац» тексту."


def test_records_statements_and_pagers(spark):
    statement = "<article><p>Довгий абзац про важливу подію у громаді.</p><p>мало</p><p>Другий достатньо довгий абзац про те саме у місті.</p></article>"
    found = page(spark, statement, html.statement_body(F.col("html")))
    assert found == "Довгий абзац про важливу подію у громаді.\n\nДругий достатньо довгий абзац про те саме у місті."
    assert page(spark, "<p>Лише один абзац тут.</p>", html.statement_body(F.col("html"))) == "Лише один абзац тут."
    record = "<div>меню</div><div id='stenograma'>Слово <b>має</b></div>"
    assert page(spark, record, html.record_text(F.col("html"))) == "Слово\nмає"
    assert page(spark, "<div>лише це</div>", html.record_text(F.col("html"))) == "лише це"
    pager = "<ul class='pages'><li><a href='/1'>1</a></li><li class='active'><a href='/2'>2</a></li><li><a href='/3'>3</a></li></ul>"
    assert page(spark, pager, html.next_page(F.col("html"), "https://b")) == "https://b/3"
    assert page(spark, "<div class='pagination'><li class='next'><a href='/n'>n</a></li></div>", html.next_page(F.col("html"), "https://b")) == "https://b/n"
    assert page(spark, "<p>x</p>", html.next_page(F.col("html"), "https://b")) is None
    index = "<li><a href='/zasid/1'>Засідання перше</a> 5 травня 2019</li><li><a href='/zasid/1'>Засідання перше</a></li>"
    items = page(spark, index, html.linked_items(F.col("html"), "https://r", "zasid"))
    assert len(items) == 1 and items[0]["around"].endswith("5 травня 2019")


def test_lemmas_and_work_lists(spark):
    words = spark.createDataFrame([("Церкви",), ("Інше",)], "word string")
    dictionary = spark.createDataFrame([("церкви", "церква")], "form string, lemma string")
    assert {r["lemma"] for r in tables.lemmatised(words, dictionary).collect()} == {"церква", "інше"}
    work = ingest.session_work_list(spark, 6700, 6702)
    held = work.limit(1).select(labels.doc_id(F.col("url")).alias("id"))
    assert ingest.not_yet_held(work, held).count() == 2


def test_coded_sheets_and_forms(spark, tmp_path):
    sheet = tmp_path / "coded.csv"
    write(sheet, 'claim_id,sentence,confidence,note\n1,"Рядок з ""лапками""\nі новим рядком",2,NA\n2,,NA,x\n')
    rows = tables.read_coded_csv(spark, str(sheet), "claim_id int, sentence string, confidence int, note string").orderBy("claim_id").collect()
    assert rows[0]["sentence"] == 'Рядок з "лапками"\nі новим рядком' and rows[0]["note"] is None
    assert rows[1]["sentence"] is None and rows[1]["confidence"] is None
    forms = tmp_path / "forms.csv"
    write(forms, "lang,word,form\nuk,Церква,церкви\nuk,церква,Церкву\nuk,інше,іншого\n")
    assert tables.load_forms(spark, str(forms), ["церква"]) == {("uk", "церква"): frozenset({"церква", "церкви", "церкву"})}
    results = tmp_path / "results"
    results.mkdir()
    write(results / "batch_01.json", '```json\n[{"doc_id": "a", "is_securitising": true}]\n```\n')
    write(results / "batch_02.json", "oops")
    assert [r["batch_file"] for r in tables.read_coder_results(spark, str(results)).collect()] == ["batch_01.json"]


def test_a_tree_is_freed_without_the_collector():
    import gc
    import weakref

    gc.disable()
    try:
        root = html._Tree(PAGE).root
        inner = weakref.ref(root.parts[-1])
        assert inner().parent is root
        del root
        assert inner() is None
    finally:
        gc.enable()


def test_only_the_parts_named(spark):
    parts = page(spark, PAGE, html.page_parts(F.col("html"), "links", "dates"))
    assert parts.asDict().keys() == {"links", "dates"}
    assert parts.links == page(spark, PAGE, html.page_parts(F.col("html"))).links

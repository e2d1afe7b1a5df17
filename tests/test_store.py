"""The corpus in buckets: touched buckets only, atomic versions, refused second writers."""

import hashlib

import pytest
from pyspark.sql import functions as F

from claimloom.sources.store import CorpusStore, StoreChanged

CORPUS = "id string, url string, title string, date string, content_type string, source string, body_text string, word_count int"


def ident(n):
    return hashlib.md5(f"u{n}".encode()).hexdigest()[:12]


def rows(spark, numbers, title="old", body="text", seq=None):
    data = [(ident(n), f"u{n}", title, "2020-01-01", "speech", "s", f"{body} {n}", 2) for n in numbers]
    frame = spark.createDataFrame(data, CORPUS)
    return frame if seq is None else frame.withColumn("seq", F.lit(seq))


@pytest.fixture
def store(spark, tmp_path):
    held = CorpusStore(spark, str(tmp_path / "store"), digits=1)
    held.create(rows(spark, range(40)))
    return held


def contents(frame):
    return {r.id: (r.title, r.body_text) for r in frame.collect()}


def test_changes_rewrite_only_the_buckets_they_touch(spark, store):
    before = store.manifest()
    new = rows(spark, [3, 100], title="", body="new", seq=1)
    touched = {ident(3)[0], ident(100)[0]}
    read = []
    store.change(new, lambda held, changes: read.extend(held.inputFiles()) or held)
    assert {f.rpartition("bucket=")[2][0] for f in read} <= touched
    store.upsert(new)
    after = store.manifest()
    assert {b for b in after["buckets"] if after["buckets"][b] != before["buckets"].get(b)} == touched
    found = contents(store.read())
    assert len(found) == 41
    assert found[ident(3)] == ("old", "new 3") and found[ident(100)] == ("", "new 100") and found[ident(4)] == ("old", "text 4")
    assert contents(store.read(version=1)) == contents(rows(spark, range(40)))


def test_insert_if_absent_and_new_columns(spark, store):
    new = rows(spark, [1, 200], body="other", seq=1).withColumn("fetch_method", F.lit("browser"))
    store.insert_if_absent(new)
    found = {r.id: (r.body_text, r.fetch_method) for r in store.read().collect()}
    assert len(found) == 41 and found[ident(1)] == ("text 1", None) and found[ident(200)] == ("other 200", "browser")


def test_broken_off_write_leaves_the_old_version(spark, store):
    def broken(held, changes):
        fail = F.raise_error(F.lit("disk full")).cast("string")
        return held.withColumn("title", F.when(F.col("id") == ident(3), fail).otherwise(F.col("title")))

    before = store.manifest()
    with pytest.raises(Exception, match="disk full"):
        store.change(rows(spark, [3]), broken)
    assert store.manifest() == before and contents(store.read()) == contents(rows(spark, range(40)))
    store.vacuum()
    assert store.manifest() == before and store.read().count() == 40


def test_second_writer_from_the_same_version_is_refused(spark, store):
    def while_another_writes(held, changes):
        CorpusStore(spark, store.path, digits=1).upsert(rows(spark, [5], title="first", seq=1))
        return held

    with pytest.raises(StoreChanged):
        store.change(rows(spark, [3]), while_another_writes)
    assert store.versions() == [1, 2] and contents(store.read())[ident(5)][0] == "first"
    assert len(store.vacuum()) == 1  # what the refused writer left
    assert contents(store.read())[ident(5)][0] == "first" and store.read(version=1).count() == 40
    with pytest.raises(StoreChanged):
        store.create(rows(spark, [1]))


def test_odd_ids_and_no_changes(spark, store):
    odd = rows(spark, [1]).withColumn("id", F.lit("Xyz"))
    store.insert_if_absent(odd.withColumn("seq", F.lit(1)))
    assert store.manifest()["buckets"]["other"] and store.read(buckets=["other"]).count() == 1
    assert store.upsert(rows(spark, [], seq=1)) == 2
    assert store.read(buckets=["none"]).count() == 0
    with pytest.raises(ValueError):
        CorpusStore(spark, store.path + "-none").read()

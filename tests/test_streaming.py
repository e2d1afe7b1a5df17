import json

from pyspark.sql import functions as F

from claimloom.operators.coding import reply_coder
from claimloom.operators.lexicon import surface_lexicon
from claimloom.streaming import arrivals


def put(folder, name, doc):
    (folder / name).write_text(json.dumps(doc, ensure_ascii=False), "utf-8")


def test_documents_are_appended_once(spark, tmp_path):
    inbox, store, marks = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "marks")
    inbox.mkdir()
    put(inbox, "a.json", {"id": "a", "url": "u", "body_text": "Церква і загроза поруч стоять."})
    put(inbox, "b.json", {"id": "b", "url": "u", "body_text": ""})

    def run():
        query = arrivals.append_new_documents(
            arrivals.arriving_documents(spark, str(inbox)), store, marks
        )
        query.awaitTermination()
        return sorted(r["id"] for r in spark.read.parquet(store).collect())

    assert run() == ["a"]
    put(inbox, "c.json", {"id": "c", "url": "u", "body_text": "Новий текст про лавру тут."})
    put(inbox, "d.json", {"id": "a", "url": "u", "body_text": "Той самий номер ще раз."})
    assert run() == ["a", "c"]


def test_claims_of_arriving_documents_and_their_codes(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    put(inbox, "a.json", {"id": "a", "url": "u", "body_text": "Церква і загроза поруч стоять."})
    claims = str(tmp_path / "claims")
    arrivals.stream_claims(
        arrivals.arriving_documents(spark, str(inbox)), surface_lexicon(), claims, str(tmp_path / "m1")
    ).awaitTermination()
    found = spark.read.parquet(claims)
    assert sorted(r["category"] for r in found.collect()) == ["church_actors", "material_security"]

    numbered = str(tmp_path / "numbered")
    found.withColumn("claim_id", F.row_number().over(__import__("pyspark").sql.Window.orderBy("match_start")).cast("bigint")).write.parquet(numbered)
    replies = spark.createDataFrame(
        [(1, '{"is_securitising": true}', 1, 1), (2, "none", 1, 1)],
        "claim_id bigint, raw_response string, input_tokens int, output_tokens int",
    )
    progress, marks = str(tmp_path / "progress"), str(tmp_path / "m2")
    for _ in range(2):
        arrivals.code_arriving_claims(
            spark, numbered, reply_coder(replies), progress, marks
        ).awaitTermination()
    codes = {r["claim_id"]: r["is_securitising"] for r in spark.read.parquet(progress).collect()}
    assert codes == {1: True, 2: None}
    assert spark.read.parquet(progress).count() == 2


def test_known_ids_are_state_and_the_store_is_not_read(spark, tmp_path):
    """Restarts go on from the checkpoint; each run reads the new files alone."""
    inbox, store, marks = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "marks")
    inbox.mkdir()
    seed = str(tmp_path / "seed")
    spark.createDataFrame([("old",)], "id string").write.parquet(seed)
    read, size = [], 0
    for run in range(3):
        for n in range(4):
            put(inbox, f"{run}-{n}.json", {"id": f"d{run * 3 + n}", "url": f"u{run}", "body_text": f"текст {run} {n}"})
        put(inbox, f"{run}-x.json", {"id": "old", "url": "u", "body_text": "уже є"})
        held = spark.readStream.schema("id string").parquet(seed)
        query = arrivals.append_new_documents(arrivals.arriving_documents(spark, str(inbox)), store, marks, held)
        query.awaitTermination()
        read.append(sum(p["numInputRows"] for p in query.recentProgress))
        size = spark.read.parquet(store).count()
        assert size == 4 + 3 * run
    assert read == [6, 5, 5]  # the mark is read once, the store never
    found = {r.id: r.url for r in spark.read.parquet(store).collect()}
    assert "old" not in found and found["d3"] == "u0" and found["d6"] == "u1"


def test_first_of_a_batch_comes_in_order(spark, tmp_path):
    """Of rows of one id in one batch the first in order stays, numbers by value."""
    folder = str(tmp_path / "rows")
    rows = [("a", "f", 10, "ten"), ("a", "f", 9, "nine"), ("b", "g", 1, "g"), ("b", "f", 2, "f")]
    spark.createDataFrame(rows, "id string, file_name string, seq int, body string").coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema("id string, file_name string, seq int, body string").parquet(folder)
    fresh = arrivals.first_arrivals(stream, ["id"], ["file_name", "seq"])
    query = fresh.writeStream.format("memory").queryName("fresh").option("checkpointLocation", str(tmp_path / "m")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.id, r.body) for r in spark.table("fresh").collect()) == [("a", "nine"), ("b", "f")]

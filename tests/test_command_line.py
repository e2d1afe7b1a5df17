"""The commands on a small folder of documents, with both matchers."""

import json

import pytest

from claimloom import __main__ as cli
from claimloom.operators import matching as M
from claimloom.operators.lexicon import lemma_lexicon
from claimloom.plans import analysis
from claimloom.sources import corpus
from test_matching import DOCS, SCHEMA


@pytest.fixture
def folder(tmp_path):
    path = tmp_path / "corpus"
    path.mkdir()
    for doc_id, title, date, url, kind, body in DOCS:
        doc = {"id": doc_id, "title": title, "date": date, "url": url, "content_type": kind, "body_text": body}
        (path / f"{doc_id}.json").write_text(json.dumps(doc, ensure_ascii=False), "utf-8")
    return path


def test_lemma_claims_are_numbered_in_match_order(spark):
    lexicon = lemma_lexicon()
    done = analysis.analyse_corpus(spark.createDataFrame(DOCS, SCHEMA), lexicon)
    rows = sorted(done.claims.collect(), key=lambda r: r["claim_id"])
    assert [r["claim_id"] for r in rows] == list(range(1, len(rows) + 1))
    keys = [(r["doc_id"], r["seen_at"]) for r in rows]
    assert keys == sorted(keys)
    assert done.summary["overview"].collect()[0]["total_claims"] == len(rows)
    assert M.claim_order(lexicon)[1] == "seen_at"


def test_commands(spark, folder, tmp_path, capsys):
    out = tmp_path / "out"
    cli.main(["analyse", "--corpus-dir", str(folder), "--output-dir", str(out)])
    assert "CORPUS ANALYSIS SUMMARY" in capsys.readouterr().out
    cli.main(["sample", "--claims", str(out / "claims"), "--category", "urgency", "--n", "1"])
    assert "Category:  urgency" in capsys.readouterr().out
    cli.main(["tables", "--claims", str(out / "claims"), "--output-dir", str(tmp_path / "tables")])
    assert "category summary" in capsys.readouterr().out
    cli.main(["verify", "d4", "--corpus-dir", str(folder)])
    assert "Нічого особливого" in capsys.readouterr().out
    cli.main(["verify", "zz", "--corpus-dir", str(folder)])
    assert "Document not found" in capsys.readouterr().out
    cli.main(["diagnose", "--corpus-dir", str(folder)])
    assert "session records" in capsys.readouterr().out
    assert corpus.source_catalogue(spark).count() == 5

"""Command line: analyse a corpus, sample claims, open a document."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from claimloom.operators import coding, ingest
from claimloom.operators.lexicon import lemma_lexicon, surface_lexicon
from claimloom.operators.sampling import sample_claims
from claimloom.plans import analysis, console
from claimloom.plans.layout import configure, spread
from claimloom.sources import corpus, tables


def _session() -> SparkSession:
    return configure(SparkSession.builder.appName("claimloom")).getOrCreate()


def _analyse(args: argparse.Namespace) -> None:
    spark = _session()
    lexicon = surface_lexicon() if args.matcher == "surface" else lemma_lexicon()
    docs = spread(corpus.read_corpus(spark, args.corpus_dir), "id")
    done = analysis.analyse_corpus(docs, lexicon)
    if args.output_dir:
        analysis.write_analysis(done, args.output_dir)
    print(console.summary_text(done.summary))


def _tables(args: argparse.Namespace) -> None:
    spark = _session()
    built = analysis.run_coding_analysis(
        tables.read_claim_lines(spark, args.claims), args.output_dir
    )
    print(console.tables_text(built))


def _sample(args: argparse.Namespace) -> None:
    claims = tables.read_claim_lines(_session(), args.claims)
    drawn = sample_claims(
        claims, args.n, args.random, category=args.category, term=args.term, doc_id=args.doc_id
    )
    for row in drawn.collect():
        print(console.claim_text(row.asDict()), end="\n\n")


def _verify(args: argparse.Namespace) -> None:
    docs = corpus.read_corpus(_session(), args.corpus_dir)
    found = corpus.find_document(docs, args.doc_id).limit(1).collect()
    if not found:
        print(console.table_text("Document not found; available:", corpus.list_documents(docs)))
        return
    doc = found[0].asDict()
    for name in ("title", "date", "content_type", "url", "word_count", "id"):
        print(f"{name}: {doc[name]}")
    print(f"\n{doc['body_text']}")


def _batches(args: argparse.Namespace) -> None:
    docs = spread(corpus.read_corpus(_session(), args.corpus_dir), "id")
    built = analysis.prepare_batches(docs, args.output_dir, args.source, args.max_tokens)
    print(console.table_text("batches", built["manifest"].drop("doc_ids").orderBy("batch")))


def _merge(args: argparse.Namespace) -> None:
    spark = _session()
    merged = analysis.merge_results(
        tables.read_coder_results(spark, args.results_dir),
        corpus.read_corpus(spark, args.corpus_dir),
        args.output_dir,
    )
    print(console.table_text("by period", coding.results_by_juncture(merged)))
    print(console.table_text("by source", coding.results_by_source(merged)))


def _diagnose(args: argparse.Namespace) -> None:
    docs = corpus.read_corpus(_session(), args.corpus_dir)
    found = ingest.diagnose(docs).groupBy("is_broken").count()
    print(console.table_text("session records", found))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="claimloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)

    analyse = commands.add_parser("analyse", help="extract claims and summarise")
    analyse.add_argument("--corpus-dir", default="output/corpus")
    analyse.add_argument("--output-dir")
    analyse.add_argument("--matcher", choices=["surface", "lemma"], default="surface")
    analyse.set_defaults(run=_analyse)

    built = commands.add_parser("tables", help="score claims and build the report tables")
    built.add_argument("--claims", default="output/claims")
    built.add_argument("--output-dir")
    built.set_defaults(run=_tables)

    sample = commands.add_parser("sample", help="show claims")
    sample.add_argument("--claims", default="output/claims")
    sample.add_argument("--category")
    sample.add_argument("--term")
    sample.add_argument("--doc-id")
    sample.add_argument("--n", type=int, default=5)
    sample.add_argument("--random", action="store_true")
    sample.set_defaults(run=_sample)

    verify = commands.add_parser("verify", help="show a document")
    verify.add_argument("doc_id")
    verify.add_argument("--corpus-dir", default="output/corpus")
    verify.set_defaults(run=_verify)

    batches = commands.add_parser("batches", help="pack relevant documents for a coder")
    batches.add_argument("--corpus-dir", default="output/corpus")
    batches.add_argument("--output-dir", default="output/batches")
    batches.add_argument("--source", action="append")
    batches.add_argument("--max-tokens", type=int, default=80000)
    batches.set_defaults(run=_batches)

    merge = commands.add_parser("merge", help="merge the results of a coder")
    merge.add_argument("--results-dir", default="output/results")
    merge.add_argument("--corpus-dir", default="output/corpus")
    merge.add_argument("--output-dir", default="output/coded")
    merge.set_defaults(run=_merge)

    diagnose = commands.add_parser("diagnose", help="count unusable session records")
    diagnose.add_argument("--corpus-dir", default="output/corpus")
    diagnose.set_defaults(run=_diagnose)

    args = parser.parse_args(argv)
    args.run(args)


if __name__ == "__main__":
    main()

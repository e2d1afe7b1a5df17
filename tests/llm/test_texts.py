"""Packing, mixing, pages, licenses and the pipeline."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures_llm import documents
from tokenizers import Tokenizer

import corpus_pipeline
from claimloom.llm import balance, licenses, packing, template


def check_pieces(rows, texts):
    """Every id in exactly one piece, sums right, sequences gapless and within their size."""
    tokenizer = Tokenizer.from_file(packing.vocabulary())
    own, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(own[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= packing.SEQUENCE
    return sum(map(sum, ([n for _, n in p] for p in sequences.values()))) / (len(sequences) * packing.SEQUENCE)


def test_packing_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    fill = check_pieces(packing.pack(docs).collect(), dict(docs.select("doc_id", "text").collect()))
    assert fill > 0.99


def test_packing_shards_and_odd_cases(spark):
    docs = documents(spark).where("doc_id <> 8 or doc_id is null").dropDuplicates(["doc_id"])
    docs = docs.union(documents(spark, [(200, "a <|endoftext|> b 's  \n\n x", "en", "a")]))
    rows = packing.pack(docs, shard=4).collect()
    check_pieces(rows, dict(docs.select("doc_id", "text").collect()))
    assert len({r.sequence_id >> 32 for r in rows}) > 1
    assert packing.pack(docs.limit(0)).count() == 0
    assert packing.pack(documents(spark)).where("doc_id = 8").count() == 2


def test_balance_keeps_costs_level():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 700, 4000).tolist()
    packed = packing.balance(lengths)
    cost = [sum(packing.cost(b - a) for _, a, b in s) for s in packed[:-1]]
    assert Counter(i for s in packed for d, a, b in s for i in [d] * (b - a)) == Counter({d: n for d, n in enumerate(lengths)})
    assert np.std(cost) / np.mean(cost) < 0.1


def test_mixing_meets_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = balance.mix(docs).collect()
    assert sorted(rows) == sorted(balance.mix(docs.repartition(5)).collect())
    sizes = Counter()
    taken, target, longest = Counter(), {}, Counter()
    for r in rows:
        assert 0 <= r.copies <= 3 and r.taken == r.size * r.copies
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        longest[r.source] = max(longest[r.source], r.size)
    texts = docs.select("doc_id", "text").collect()
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts}
    assert all(words[r.doc_id] == r.size for r in rows)
    order = sorted(sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full: set = set()
    while True:  # shares by weight; what exceeds a limit goes to the others
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        level = rest / sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and weight[s] * level > 3 * sizes[s]}
        if not over:
            break
        full |= over
    for s in order:
        want = 3 * sizes[s] if s in full else weight[s] * level
        assert target[s] == pytest.approx(want)
        assert abs(taken[s] - want) <= min(longest[s], 0.01 * want)


def test_mixing_limits_and_odd_cases(spark):
    rows = [(i, "one two three", "en", s) for i, s in enumerate(["a"] * 2 + ["b"] * 40 + [None] * 40)]
    got = balance.mix(documents(spark, rows)).collect()
    assert {r.copies for r in got if r.source == "a"} == {3}
    assert {r.target for r in got if r.source == "a"} == {18.0}
    docs = documents(spark)
    got = balance.mix(docs).collect()
    assert len(got) == docs.count() and all(r.copies == 0 for r in got if r.size == 0)
    assert balance.mix(docs.limit(0)).count() == 0
    mixed = balance.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)


def test_mixed_documents_of_repeated_rows(spark):
    """Rows that repeat id, text and source: the stage gives what the mix counts."""
    rows = [(i if i else None, f"{'word ' * (i + 3)}", "en", s) for s in "abc" for i in range(6) for _ in range(1 + i % 4)]
    docs = documents(spark, rows)
    want = Counter()
    for r in balance.mix(docs).collect():
        want[r.doc_id, r.source] += r.copies
    shared = Counter((i, s) for i, _, _, s in rows)
    assert any(want[k] % n for k, n in shared.items())
    got = Counter((r.doc_id, r.source) for r in balance.mixed_documents(docs).collect())
    assert got == +want


PAGE = """<html><head><title>x</title></head><body><header class=top>Site</header><nav><a href=/>Home</a></nav>
<div id="cookie-banner">We use cookies</div><main><article class="post"><h1>A &amp; B</h1><p>One <b>two</b>
three<br>four</p><ul><li>five<li>six</ul><aside>Also</aside><div class="share-buttons"><a href=x>Share</a></div><p>caf&eacute; 1 &lt; 2</p>
<table><tr><td>cell<td>next</table></article><section id="comments"><p>first!</p></section></main><form><input><button>Go</button></form>
<script>var a = "<p>no</p>";</script><footer>&copy; us</footer></body></html>"""


def test_page_text_by_hand():
    assert template.main_text(PAGE, set()) == "A & B\nOne two three four\nfive\nsix\ncafé 1 < 2\ncell\nnext"


def test_page_text_of_several_articles():
    parts = "<article><h2>One</h2><p>first part <math><mi>x</mi></math></p></article><article><h2>Two</h2><p>the second and longer part</p></article>"
    teaser = "<article><h3><a href=/n>Next</a></h3><p>Read what comes next in the series</p></article><article class=comment><p>Nice!</p></article>"
    page = f"<body><main>{parts}{teaser}</main><div><article><p>Elsewhere</p></article></div></body>"
    assert template.main_text(page, set()) == "One\nfirst part x\nTwo\nthe second and longer part"
    recurring = {d for d in template.subtrees(f"<body><main>{parts}</main></body>")}
    assert template.main_text(page, recurring) == "Two\nthe second and longer part"


def test_page_templates_and_odd_cases(spark):
    frame = "<body><div class=x>Our site since 1999</div><div class=c><p>{}</p></div><div>Call us now</div></body>"
    rows = [(i, f"http://h.example/{i}", frame.format(f"story {i}")) for i in range(6)]
    rows += [(10, "http://other.example/", frame.format("alone")), (11, None, None), (12, "http://h.example/e", ""), (13, "http://h.example/d", "<p>a <p>b</div> < c &amp"), (0, rows[0][1], rows[0][2])]
    pages = spark.createDataFrame([(*r, 1, "y") for r in rows], "page_id long, url string, html string, n int, digest string")
    got = template.extract(pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert [by[i].text for i in range(6)] == [f"story {i}" for i in range(6)]
    assert by[10].text == "Our site since 1999\nalone\nCall us now"
    assert (by[11].text, by[12].n_chars) == ("", 0)
    assert by[13].text == "a\nb < c &" and by[13].n_chars == len(by[13].text)
    assert template.extract(pages.limit(0)).count() == 0


def test_page_template_is_a_share_of_different_pages(spark):
    """Large host: recurring links, words and headings stay; copies are one page."""
    rows = []
    for i in range(200):
        own = f"<p>Story {i} in <a href=/p>Python</a> and <b>more</b>.</p>"
        extra = "<h2>Conclusion</h2><p>Short one.</p><table><tr><td>Yes</td></tr></table>" if i % 4 == 0 else ""
        body = f"<article>{own}{extra}</article>" if i % 2 else f"<div>{own}{extra}</div>"
        rows.append((i, f"http://big.example/{i}", f"<body><div>Site name</div>{body}</body>"))
    rows += [(1000 + i, f"http://copies.example/{i}", f"<body><div>Lone story</div><p>{'told' if i < 30 else 'other'}</p></body>") for i in range(31)]
    rows += [(2000 + i, f"http://small.example/{i}", "<p>Thrice the same</p>") for i in range(3)]
    by = {r.page_id: r.text for r in template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(200):
        assert by[i] == f"Story {i} in Python and more." + ("\nConclusion\nShort one.\nYes" if i % 4 == 0 else "")
    assert {by[1000 + i] for i in range(30)} == {"Lone story\ntold"} and by[2000] == "Thrice the same"


def test_page_text_of_given_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    for r in template.extract(pages).collect():
        assert "track(" not in r.text and "©" not in r.text
        head = re.search(r"<h1>(.*?)</h1>", raw[r.page_id])
        assert r.text.startswith(head[1].split("&")[0].strip()[:20])


def test_licenses_base_is_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    for r in licenses.scan(docs).collect():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id] or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        places = [(i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        first = [i for i, _ in places]
        want = (len(words), len(places), min(first, default=None), max(first, default=None), ",".join(sorted({x for _, x in places})))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_license_rules_and_odd_cases(spark):
    assert len(licenses.rules()) > 300
    texts = {
        1: "Licensed under the Apache License, Version 2.0 (the License)",
        2: "SPDX-License-Identifier: GPL-3.0",
        3: "released under CC BY-NC-SA 4.0",
        4: "Permission is hereby granted, free of charge, to any person obtaining a copy",
        5: "nothing to see",
        6: None,
        7: "under the MIT license under the MIT license",
        8: "",
    }
    docs = documents(spark, [(i, t, "en", "a") for i, t in texts.items()])
    by = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert by[1].labels == "apache-2" and by[2].labels == "gpl-3.0" and by[4].labels == "mit"
    assert by[3].labels == "cc-by-nc,cc-by-nc-sa"  # the base phrase stays
    assert (by[5].labels, by[5].score, by[6].n_words, by[6].first_word) == ("", 0.0, 0, None)
    assert (by[7].n_base, by[7].first_word, by[7].last_word) == (2, 0, 4)
    assert len(by[1].detections) == 1 and by[1].score > 0.9
    assert licenses.scan(docs.limit(0)).count() == 0


def wordings(tree):
    """The strings of a parsed pattern; of long repeats the shortest, of classes each letter or one digit."""
    out = [""]
    for kind, value in tree:
        if kind is re._constants.LITERAL:
            own = [chr(value)]
        elif kind is re._constants.ANY:
            own = ["x"]
        elif kind is re._constants.IN:
            own = [chr(v) if k is re._constants.LITERAL else "7" for k, v in value]
        elif kind is re._constants.BRANCH:
            own = [w for branch in value[1] for w in wordings(branch)]
        elif kind is re._constants.SUBPATTERN:
            own = wordings(value[3])
        else:
            least, most, inner = value
            own = ["".join(w) for n in sorted({least, min(most, max(least, 1))}) for w in itertools.product(wordings(inner), repeat=n)]
        out = [a + b for a in out for b in own]
    return out


def test_license_keywords_are_in_every_wording(spark):
    whole = {p for *_, p in licenses._LINKS} | {p for *_, p in licenses._TEXTS}
    some = [r for r in licenses.rules() if r.pattern in whole or r.priority in (45, 50)]  # one frame stands for all
    assert {(r.label, r.keyword) for r in licenses.rules()} == {(r.label, r.keyword) for r in some}
    assert not {(r.label, r.keyword, w) for r in some for w in wordings(re._parser.parse(r.pattern)) if r.keyword not in w}
    scanner = licenses.Scanner()
    for text, label in {"licensed under the MIT No Attribution license": "mit-0", "under the ASL 2.0 license": "apache-2", "the PSF License Agreement license": "psf-2.0"}.items():
        assert label in {r.label for *_, r in scanner.detections(licenses.normalised(text.encode()))}


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        rows = docs.collect()
        assert {r.doc_id for r in rows} <= ids and len(rows) > 0.4 * before
        docs = spark.createDataFrame(rows, docs.schema)
    assert corpus_pipeline.run(spark, sf).count() == packing.pack(docs).count()


@pytest.mark.parametrize("run", [" " * 2_000_000, "\t" * 1_000_000, " \n\t" * 500_000])
def test_long_white_space_is_encoded(run):
    """The faster twin gives up on such texts."""
    from tokenizers import Tokenizer

    text = "a" + run + "x"
    whole = Tokenizer.from_file(packing.vocabulary()).encode(text, add_special_tokens=False).ids
    assert list(packing.Encoder(packing.vocabulary()).ids(text)) == whole


def test_packing_cuts_only_what_no_sequence_holds():
    """Against a plain search over all sequences: same places, document by document."""
    draw = random.Random(5)
    for n in (1, 2, 9, 60, 300):
        lengths = [draw.choice((draw.randint(1, 63), draw.randint(1, 9))) for _ in range(n)]
        total, size = sum(lengths), 64
        free = [size] * -(-total // size)
        free[-1] = total - (len(free) - 1) * size
        spent, want, left = [0.0] * len(free), {}, []
        for d in sorted(range(n), key=lambda i: -lengths[i]):
            fit = [k for k in range(len(free)) if free[k] >= lengths[d]]
            if not fit:
                left.append(d)
                continue
            k = min(fit, key=lambda k: (spent[k], k))
            want[d] = {(k, 0, lengths[d])}
            free[k] -= lengths[d]
            spent[k] += packing.cost(lengths[d], size)
        got: dict[int, set] = {}
        for k, sequence in enumerate(packing.balance(lengths, size)):
            for d, first, last in sequence:
                got.setdefault(d, set()).add((k, first, last))
        assert {d: got[d] for d in want} == want
        assert all(sum(b - a for _, a, b in got[d]) == lengths[d] for d in left)

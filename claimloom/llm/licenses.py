"""License detection by ordered signature rules behind a keyword prefilter."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import pieces

# The phrases of the base detection and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Label, keyword that every wording of the name holds, and how the license is named, in words
# parted by single spaces ("2.0" reads "2 0").  `V` is "version" or "v", or nothing.
_NAMES = (
    ("mit", "mit", r"mit|mit x11|expat mit"),
    ("mit", "expat", r"expat"),
    ("mit", "x11", r"x11"),
    ("mit-0", "mit 0", r"mit 0"),
    ("mit-0", "mit no attribution", r"mit no attribution"),
    ("apache-2", "apache", r"apache(?: software)?(?: license)?V2(?: 0)?|apache 2(?: 0)?"),
    ("apache-2", "asl 2", r"asl 2(?: 0)?"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)?V1 1"),
    ("apache-1.0", "apache", r"apache(?: software)?(?: license)?V1 0"),
    ("bsd-2-clause", "bsd", r"(?:simplified|freebsd) bsd|bsd 2 clause|2 clause bsd|two clause bsd"),
    ("bsd-3-clause", "bsd", r"(?:new|revised|modified) bsd|bsd 3 clause|3 clause bsd|three clause bsd"),
    ("bsd-4-clause", "bsd", r"original bsd|bsd 4 clause|4 clause bsd|four clause bsd"),
    ("0bsd", "bsd", r"0bsd|zero clause bsd|bsd zero clause"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public licenseV3(?: 0)?"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gplV3(?: 0)?|gplv3"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public licenseV2(?: 0)?"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gplV2(?: 0)?|gplv2"),
    ("gpl-1.0", "general public", r"(?:gnu )?general public licenseV1(?: 0)?"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public licenseV3(?: 0)?"),
    ("lgpl-3.0", "lgpl", r"(?:gnu )?lgplV3(?: 0)?|lgplv3"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public licenseV2 1"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgplV2 1|lgplv2 1"),
    ("lgpl-2.0", "library general", r"(?:gnu )?library general public licenseV2(?: 0)?"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licenseV3(?: 0)?"),
    ("agpl-3.0", "agpl", r"(?:gnu )?agplV3(?: 0)?|agplv3"),
    ("gfdl-1.3", "free documentation", r"(?:gnu )?free documentation licenseV1 3"),
    ("gfdl-1.2", "free documentation", r"(?:gnu )?free documentation licenseV1 2"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation license"),
    ("mpl-2.0", "mozilla", r"mozilla public licenseV2 0"),
    ("mpl-2.0", "mpl", r"mplV2 0"),
    ("mpl-1.1", "mozilla", r"mozilla public licenseV1 1"),
    ("mpl-1.0", "mozilla", r"mozilla public licenseV1 0"),
    ("epl-2.0", "eclipse", r"eclipse public licenseV2(?: 0)?"),
    ("epl-1.0", "eclipse", r"eclipse public licenseV1(?: 0)?"),
    ("cddl-1.0", "common development", r"common development and distribution licenseV1 0"),
    ("cddl-1.1", "common development", r"common development and distribution licenseV1 1"),
    ("cpl-1.0", "common public", r"common public licenseV1 0"),
    ("eupl-1.2", "european union", r"european union public li[cs]en[cs]eV1 2"),
    ("eupl-1.1", "european union", r"european union public li[cs]en[cs]eV1 1"),
    ("ms-pl", "microsoft", r"microsoft public license"),
    ("ms-rl", "microsoft", r"microsoft reciprocal license"),
    ("isc", "isc", r"isc"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("libpng", "libpng", r"libpng"),
    ("bsl-1.0", "boost", r"boost software licenseV1(?: 0)?|boost software license"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("wtfpl", "what the fuck", r"do what the fuck you want to public license"),
    ("artistic-2.0", "artistic", r"artistic licenseV2(?: 0)?"),
    ("artistic-1.0", "artistic", r"artistic licenseV1(?: 0)?"),
    ("perl", "perl", r"perl artistic|same terms as perl(?: itself)?"),
    ("psf-2.0", "python", r"python software foundation(?: license)?V2"),
    ("psf-2.0", "psf", r"psf license agreement"),
    ("python-2.0", "python", r"python licenseV2(?: 0)?"),
    ("php-3.01", "php", r"php licenseV3 01|php license"),
    ("ruby", "ruby", r"ruby license"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licenseV1 1|(?:sil )?open font license"),
    ("osl-3.0", "open software", r"open software licenseV3 0"),
    ("afl-3.0", "academic free", r"academic free licenseV3 0"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?"),
    ("upl-1.0", "universal permissive", r"universal permissive licenseV1(?: 0)?|universal permissive license"),
    ("postgresql", "postgresql", r"postgresql license"),
    ("openssl", "openssl", r"openssl(?: and ssleay)? license"),
    ("vim", "vim", r"vim license"),
    ("w3c", "w3c", r"w3c software(?: notice and)? license"),
    ("bsl-1.1", "business source", r"business source licenseV1 1|business source license"),
    ("sspl-1.0", "server side", r"server side public license(?:V1)?"),
    ("elastic-2.0", "elastic", r"elastic licenseV2(?: 0)?"),
    ("odbl-1.0", "open database", r"open database license(?:V1 0)?"),
    ("odc-by-1.0", "open data commons", r"open data commons attribution license(?:V1 0)?"),
    ("pddl-1.0", "public domain", r"public domain dedication and license"),
    ("openrail", "rail", r"(?:creativeml )?open ?rail(?: m)?"),
    ("llama", "llama", r"llama(?: \d)? community license"),
)

# Creative Commons: label, the clauses' short form, the clauses in words.
_COMMONS = (
    ("cc-by-nc-nd", r"by nc nd", r"attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
    ("cc-by-nc-sa", r"by nc sa", r"attribution non ?commercial share ?alike"),
    ("cc-by-nc", r"by nc", r"attribution non ?commercial"),
    ("cc-by-nd", r"by nd", r"attribution no ?deriv(?:ative)?s?(?: works)?"),
    ("cc-by-sa", r"by sa", r"attribution share ?alike"),
    ("cc-by", r"by", r"attribution"),
)

_HEAD = r"(?:licensed|released|distributed|available|published|provided|made available|covered|governed)"
# How a license is invoked, from the surest to the weakest: priority, weight, frame.
_FRAMES = (
    (90, 0.99, r"spdx license identifier N"),
    (80, 0.95, _HEAD + r" under (?:the )?(?:terms of )?(?:the )?N(?: licen[cs]e)?"),
    (70, 0.9, r"(?:under|subject to|permitted by) (?:the )?(?:terms of )?(?:the )?N(?: licen[cs]e)"),
    (60, 0.85, r"licen[cs]e (?:is |type )?(?:the )?N(?: licen[cs]e)?"),
    (50, 0.7, r"(?:the )?N licen[cs]e"),
)

# Wordings that stand for a license themselves: label, keyword, priority, weight, pattern.
_TEXTS = (
    ("mit", "permission is hereby granted", 95, 0.99, r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission to use", 95, 0.99, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use", 60, 0.9, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "neither the name", 85, 0.95, r"neither the name of .{1,80}? nor the names of its contributors may be used"),
    ("zlib", "as is", 90, 0.95, r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("public-domain", "public domain", 75, 0.8, r"(?:released|dedicated|placed) (?:in|in to|into|to) the public domain|public domain dedication"),
    ("unlicense", "unencumbered", 95, 0.99, r"free and unencumbered software released into the public domain"),
    ("cc0-1.0", "cc0", 90, 0.95, r"cc0(?: 1 0)?(?: universal)?"),
    ("all-rights-reserved", "all rights reserved", 40, 0.5, r"all rights reserved"),
    ("proprietary", "proprietary", 40, 0.5, r"proprietary (?:and|or) confidential|proprietary licen[cs]e"),
    ("copyright", "copyright", 10, 0.3, r"copyright (?:c )?(?:19|20)\d\d"),
)
_LINKS = (
    ("apache-2", "apache org", r"apache org licenses license 2 0"),
    ("mit", "opensource org", r"opensource org licenses? mit"),
    ("gpl-3.0", "gnu org", r"gnu org licenses gpl 3 0"),
    ("gpl", "gnu org", r"gnu org licenses gpl"),
    ("lgpl", "gnu org", r"gnu org licenses lgpl"),
    ("agpl-3.0", "gnu org", r"gnu org licenses agpl(?: 3 0)?"),
    ("mpl-2.0", "mozilla org", r"mozilla org mpl 2 0"),
    ("cc0-1.0", "creativecommons org", r"creativecommons org publicdomain zero 1 0"),
    *((label, "creativecommons org", rf"creativecommons org licenses {short} \d \d") for label, short, _ in _COMMONS),
)


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    priority: int
    weight: float
    pattern: str


def rules() -> list[Rule]:
    """All rules, highest priority first: every name in every frame, links and wordings."""
    out = []
    for label, keyword, names in _NAMES:
        n = f"(?:{names})".replace("V", r"(?: version| v)? ?")
        out += [Rule(label, keyword, p, w, frame.replace("N", n)) for p, w, frame in _FRAMES]
    for label, short, long in _COMMONS:
        version = r"(?: \d(?: \d)?)?"
        out += [Rule(label, "cc by", p, w, frame.replace("N", rf"cc {short}{version}")) for p, w, frame in _FRAMES]
        out.append(Rule(label, "cc by", 45, 0.7, rf"cc {short}{version}"))
        out += [Rule(label, "creative commons", p, w, frame.replace("N", rf"creative commons {long}{version}")) for p, w, frame in _FRAMES]
    out += [Rule(label, keyword, 88, 0.97, pattern) for label, keyword, pattern in _LINKS]
    out += [Rule(label, keyword, p, w, pattern) for label, keyword, p, w, pattern in _TEXTS]
    return sorted(out, key=lambda r: (-r.priority, r.label, r.pattern))


_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_START = rb"(?<![^ ])(?:"
_STOP = rb")(?![^ ])"


def normalised(text: bytes) -> bytes:
    """Lower-cased words with single spaces between them."""
    return b" ".join(text.translate(_TABLE).split())


class Scanner:
    def __init__(self):
        self.gates: dict[bytes, list] = {}
        for r in rules():
            self.gates.setdefault(r.keyword.encode(), []).append((r, re.compile(_START + r.pattern.encode() + _STOP)))
        self.base = [(re.compile(_START + p.encode() + _STOP), label) for p, label in BASE.items()]

    def places(self, words: bytes) -> list[tuple[int, str]]:
        """First byte and label of every place of a base phrase."""
        return [(m.start(), label) for pattern, label in self.base for m in pattern.finditer(words)]

    def detections(self, words: bytes) -> list[tuple[int, int, Rule]]:
        """What the rules find, without what lies inside a detection of higher priority.

        Among equals the longer detection stands, then the first by label.
        """
        found = []
        for keyword, own in self.gates.items():
            if keyword in words:
                for rule, pattern in own:
                    found += [(m.start(), m.end(), rule) for m in pattern.finditer(words)]
        found.sort(key=lambda f: (-f[2].priority, f[0] - f[1], f[0], f[2].label))
        kept: list[tuple[int, int, Rule]] = []
        # Accepted intervals by first byte, with the furthest end so far: containment by bisection.
        starts = np.empty(0, np.int64)
        ends = np.empty(0, np.int64)
        for a, b, rule in found:
            at = int(np.searchsorted(starts, a, side="right"))
            if at and ends[:at].max() >= b:
                continue
            kept.append((a, b, rule))
            starts, ends = np.insert(starts, at, a), np.insert(ends, at, b)
        return sorted(kept, key=lambda k: (k[0], k[1], k[2].label))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    kind = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("priority", pa.int32()), ("weight", pa.float64())]))
    for batch in pieces(batches, "text"):
        rows = []
        for text in batch.column("text").to_pylist():
            words = normalised(text or b"")
            base, found = scanner.places(words), scanner.detections(words)
            space = np.flatnonzero(np.frombuffer(words, np.uint8) == 32) if base or found else np.empty(0, np.int64)
            word = lambda at: int(np.searchsorted(space, at))  # noqa: B023, E731
            first = [word(a) for a, _ in base]
            labels = {label for _, label in base}
            weights = {label: 0.95 for label in labels}
            spans = []
            for a, b, r in found:
                weights[r.label] = max(weights.get(r.label, 0.0), r.weight)
                spans.append({"label": r.label, "first_word": word(a), "last_word": word(b - 1), "priority": r.priority, "weight": r.weight})
            rows.append((
                words.count(b" ") + 1 if words else 0, len(base), min(first, default=None), max(first, default=None),
                ",".join(sorted(labels)), ",".join(sorted(weights)), 1 - float(np.prod([1 - w for w in weights.values()])), spans,
            ))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), kind)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))],
            ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"],
        )


def scan(docs: DataFrame) -> DataFrame:
    """Licenses named in each whole text.

    Takes `doc_id`, `text`; gives doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, detections (label, first and last word, priority,
    weight).  Base phrases count at every place, whatever the rules find there.  The
    score is the chance that at least one label holds, by the weights of its rules.

    Null or empty text: no words, no labels (''), score 0, null places.  Rows that
    repeat an id are scanned each; null ids too.  An empty table gives an empty
    one; other columns are ignored.  Nothing is shuffled.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    spans = "array<struct<label:string,first_word:long,last_word:long,priority:int,weight:double>>"
    return docs.mapInArrow(
        _scan,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        f"score double, detections {spans}",
    )

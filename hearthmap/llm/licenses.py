"""License scan: ordered signature rules, gated by keywords, overlaps resolved by priority and containment.

A text is reduced to its words (A-Z lower-cased; runs of ASCII letters and digits and of everything beyond
ASCII), joined by single blanks.  A rule is a regular expression over that word string; it matches whole words.
Rules come from hand-written license names (``NAMES``) in hand-written forms (``FORMS``: an identifier, a link, a
grant, a field, a title, a bare mention) and from hand-written sentences of license texts (``SENTENCES``).

Prefilter: every rule names keywords, all of which any match of it must hold.  One automaton finds the keywords
of all rules in all texts of a step; a rule is run on a text only if the text has all its keywords.

Resolution: detections are taken in order of the rule's priority, then longest, then first in the text, then in
rule order; one that lies inside a detection taken already is suppressed.  Base rules come first and are never
suppressed: every place of them stays.

Rows: null and empty texts have no words and no detections.  Repeated rows give equal rows; other columns are
dropped.  Empty table: no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hearthmap.llm.words import Words, find_words, lower_ascii, raw, steps

# bytes between words, after lower-casing
_BETWEEN = np.ones(256, bool)
_BETWEEN[0x30:0x3A] = _BETWEEN[0x61:0x7B] = _BETWEEN[0x80:] = False

# Spellings that count as one keyword.
_SPELLINGS = {w: "license" for w in ("licence", "licensed", "licenced", "licenses", "licences")}

BASE = "base"
# Base phrases and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

_L = "licen[sc]e"
_V = "(?:version |v)?"
# Hand-written names: label, words of the name, keywords of the name, identifier words.
NAMES: list[tuple[str, str, str, str]] = [
    ("mit", "mit(?: x11)?", "mit", "mit"),
    ("mit", "expat", "expat", "expat"),
    ("mit-0", "mit (?:0|no attribution)", "mit", "mit 0"),
    ("apache-2", f"apache(?: software)?(?: {_L})? {_V}2(?: 0)?", "apache", "apache 2 0"),
    ("apache-1", f"apache(?: software)?(?: {_L})? {_V}1(?: [01])?", "apache", "apache 1 [01]"),
    ("apache", "apache(?: software)?", "apache", "apache"),
    ("gpl-3", f"(?:gnu )?general public {_L} {_V}3(?: 0)?(?: or(?: any)? later(?: version)?)?", "general public", "gpl 3 0(?: only| or later)?"),
    ("gpl-2", f"(?:gnu )?general public {_L} {_V}2(?: 0)?(?: or(?: any)? later(?: version)?)?", "general public", "gpl 2 0(?: only| or later)?"),
    ("gpl-3", "(?:gnu )?gpl (?:v|version )?3(?: 0)?(?: or later)?", "gpl", "gnu gpl 3"),
    ("gpl-3", "(?:gnu )?gplv3(?: 0)?", "gplv3", "gplv3"),
    ("gpl-2", "(?:gnu )?gpl (?:v|version )?2(?: 0)?(?: or later)?", "gpl", "gnu gpl 2"),
    ("gpl-2", "(?:gnu )?gplv2(?: 0)?", "gplv2", "gplv2"),
    ("gpl", f"(?:gnu )?general public {_L}", "general public", "gpl"),
    ("gpl", "gnu gpl", "gnu gpl", "gnu gpl"),
    ("lgpl-3", f"(?:gnu )?lesser general public {_L} {_V}3(?: 0)?(?: or later)?", "lesser general", "lgpl 3 0(?: only| or later)?"),
    ("lgpl-2.1", f"(?:gnu )?lesser general public {_L} {_V}2 1(?: or later)?", "lesser general", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-2", f"(?:gnu )?library general public {_L}(?: {_V}2(?: 0)?)?", "library general", "lgpl 2 0(?: only| or later)?"),
    ("lgpl", f"(?:gnu )?lesser general public {_L}", "lesser general", "lgpl"),
    ("lgpl", "(?:gnu )?lgpl(?:v[23])?", "", "gnu lgpl"),
    ("agpl-3", f"(?:gnu )?affero general public {_L}(?: {_V}3(?: 0)?)?", "affero general", "agpl 3 0(?: only| or later)?"),
    ("agpl-3", "(?:gnu )?agpl(?:v3| v3| 3)?", "", "gnu agpl"),
    ("fdl", f"(?:gnu )?free documentation {_L}(?: {_V}1(?: [1-3])?)?", "free documentation", "gfdl 1 [1-3](?: only| or later)?"),
    ("bsd-2", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)", "", "bsd 2 clause"),
    ("bsd-3", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)", "bsd", "bsd 3 clause"),
    ("bsd-4", "(?:bsd 4 clause|4 clause bsd|original bsd)", "bsd", "bsd 4 clause"),
    ("bsd-0", "(?:bsd zero clause|zero clause bsd|0bsd)", "", "0bsd"),
    ("bsd", "bsd(?: style)?", "bsd", "bsd"),
    ("isc", "isc", "isc", "isc"),
    ("mpl-2", f"(?:mozilla public {_L} {_V}2(?: 0)?|mpl (?:v|version )?2(?: 0)?)", "", "mpl 2 0"),
    ("mpl-1", f"(?:mozilla public {_L} {_V}1(?: [01])?|mpl (?:v|version )?1(?: [01])?)", "", "mpl 1 [01]"),
    ("mpl", f"mozilla public(?: {_L})?", "mozilla public", "mpl"),
    ("epl-2", f"eclipse public(?: {_L})? {_V}2(?: 0)?", "eclipse public", "epl 2 0"),
    ("epl-1", f"eclipse public(?: {_L})? {_V}1(?: 0)?", "eclipse public", "epl 1 0"),
    ("epl", "eclipse public", "eclipse public", "epl"),
    ("cddl", f"(?:common development and distribution(?: {_L})?|cddl)(?: {_V}1(?: [01])?)?", "", "cddl 1 [01]"),
    ("cpl", "common public", "common public", "cpl 1 0"),
    ("eupl", f"(?:european union public(?: {_L})?|eupl)(?: {_V}1(?: [0-2])?)?", "", "eupl 1 [0-2]"),
    ("osl", f"open software(?: {_L})?(?: {_V}3(?: 0)?)?", "open software", "osl 3 0"),
    ("afl", f"academic free(?: {_L})?(?: {_V}3(?: 0)?)?", "academic free", "afl 3 0"),
    ("artistic-2", f"artistic(?: {_L})? {_V}2(?: 0)?", "artistic", "artistic 2 0"),
    ("artistic", "(?:perl )?artistic", "artistic", "artistic 1 0"),
    ("boost", "(?:boost software|boost)", "boost", "bsl 1 0"),
    ("busl", "business source", "business source", "busl 1 1"),
    ("sspl", f"(?:server side public(?: {_L})?|sspl)", "", "sspl 1 0"),
    ("elastic", "elastic", "elastic", "elastic 2 0"),
    ("zlib", "(?:zlib(?: libpng)?|libpng)", "", "zlib"),
    ("unlicense", "unlicense", "unlicense", "unlicense"),
    ("wtfpl", "(?:wtfpl|do what the fuck you want to public)", "", "wtfpl"),
    ("postgresql", "postgresql", "postgresql", "postgresql"),
    ("python", "python(?: software foundation)?", "python", "python 2 0"),
    ("php", "php", "php", "php 3 01"),
    ("ruby", "ruby", "ruby", "ruby"),
    ("w3c", "w3c(?: software)?(?: notice)?", "w3c", "w3c"),
    ("openssl", "(?:openssl|ssleay)", "", "openssl"),
    ("ncsa", "(?:university of illinois ncsa|ncsa)(?: open source)?", "ncsa", "ncsa"),
    ("ms-pl", "microsoft public", "microsoft public", "ms pl"),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal", "ms rl"),
    ("upl", "universal permissive", "universal permissive", "upl 1 0"),
    ("blueoak", "blue oak(?: model)?", "blue oak", "blueoak 1 0 0"),
    ("ofl", "(?:sil )?open font", "open font", "ofl 1 1"),
    ("odbl", f"(?:open database(?: {_L})?|odbl)", "", "odbl 1 0"),
    ("odc-by", f"open data commons attribution(?: {_L})?", "open commons", "odc by 1 0"),
    ("pddl", "(?:public domain dedication and|pddl)", "", "pddl 1 0"),
    ("ogl", f"open government(?: {_L})?(?: v3(?: 0)?)?", "open government", "ogl uk 3 0"),
    ("cdla", "community data(?: license agreement)?", "community data", "cdla permissive 2 0"),
    ("openrail", "(?:creativeml open rail m|openrail|bigscience rail)", "", "openrail"),
    ("llama", "llama(?: [234])?(?: community)?", "llama", "llama[234]"),
    ("cc0", "(?:cc0|cc zero|creative commons zero)(?: 1 0)?(?: universal)?", "", "cc0 1 0"),
    ("cc-by-nc-nd", "(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial) (?:nd|no ?deriv(?:ative)?s)(?: [1-4] [05])?", "", "cc by nc nd [1-4] [05]"),
    ("cc-by-nc-sa", "(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial) (?:sa|share ?alike)(?: [1-4] [05])?", "", "cc by nc sa [1-4] [05]"),
    ("cc-by-nc", "(?:cc|creative commons) (?:by|attribution) (?:nc|non ?commercial)(?: [1-4] [05])?", "", "cc by nc [1-4] [05]"),
    ("cc-by-nd", "(?:cc|creative commons) (?:by|attribution) (?:nd|no ?deriv(?:ative)?s)(?: [1-4] [05])?", "", "cc by nd [1-4] [05]"),
    ("cc-by-sa", "(?:cc|creative commons) (?:by|attribution) (?:sa|share ?alike)(?: [1-4] [05])?", "", "cc by sa [1-4] [05]"),
    ("cc-by", "(?:cc|creative commons) (?:by|attribution)(?: [1-4] [05])?", "", "cc by [1-4] [05]"),
    ("cc", "creative commons", "creative commons", "cc"),
]

_OF = "(?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
# Forms in order of priority: name, expression over a name ({n}) or an identifier ({i}), keywords, score.
FORMS: list[tuple[str, str, str, float]] = [
    ("identifier", f"spdx {_L} identifier {{i}}", "spdx identifier", 1.0),
    ("link", f"(?:opensource|spdx|choosealicense|gnu|creativecommons) (?:org|com)(?: {_L}s?)? {{i}}", "", 0.95),
    ("grant", f"(?:licen[sc]ed|released|distributed|available|provided|published|shared|governed|covered) (?:under|by) {_OF}{{n}}(?: {_L})?", "", 0.9),
    ("field", f"{_L}s?(?: type| name| id)?(?: is)?(?: the)? {{n}}(?: {_L})?", "license", 0.8),
    ("title", f"{{n}} (?:public )?{_L}(?: agreement)?", "license", 0.8),
    ("name", "{n}", "", 0.7),
    ("mention", f"under {_OF}{{n}}", "under", 0.6),
]

# Hand-written sentences of license texts and notices: label, expression, keywords, score.
SENTENCES: list[tuple[str, str, str, float]] = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission hereby granted charge", 1.0),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", "permission modify distribute fee", 1.0),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution binary permitted", 1.0),
    ("bsd-3", "neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors", "neither nor contributors", 1.0),
    ("bsd-4", "all advertising materials mentioning features or use of this software must display", "advertising materials display", 1.0),
    ("gpl", f"redistribute it and or modify it under the terms of the gnu general public {_L}", "redistribute modify gnu", 1.0),
    ("lgpl", f"redistribute it and or modify it under the terms of the gnu lesser general public {_L}", "redistribute modify lesser", 1.0),
    ("agpl-3", f"redistribute it and or modify it under the terms of the gnu affero general public {_L}", "redistribute modify affero", 1.0),
    ("apache-2", f"you may not use this file except in compliance with the {_L}", "compliance license file", 1.0),
    ("apache-2", f"software distributed under the {_L} is distributed on an as is basis", "distributed basis license", 1.0),
    ("mpl-2", f"this source code form is subject to the terms of the mozilla public {_L}", "mozilla subject form", 1.0),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse", "accompanying materials eclipse", 1.0),
    ("unlicense", "free and unencumbered software released into the public domain", "unencumbered domain", 1.0),
    ("zlib", "altered source versions must be plainly marked as such", "altered plainly marked", 1.0),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "permission organization accompanying", 1.0),
    ("wtfpl", "you just do what the fuck you want to", "fuck want", 1.0),
    ("public-domain", "(?:dedicated to|released into|in) the public domain", "public domain", 0.8),
    ("public-domain", "waived all copyright and related or neighboring rights", "waived copyright neighboring", 1.0),
    ("cc", "you are free to share copy and redistribute the material", "share redistribute material", 0.9),
    ("cc-by", "you must give appropriate credit", "appropriate credit", 0.8),
    ("noncommercial", "(?:for|only for|solely for) (?:personal |private |academic )?non ?commercial (?:use|purposes)(?: only)?", "", 0.7),
    ("noncommercial", "you may not use the material for commercial purposes", "material commercial purposes", 0.9),
    ("no-derivatives", "you may not distribute the modified material", "distribute modified material", 0.9),
    ("proprietary", "all rights (?:are )?reserved", "rights reserved", 0.6),
    ("proprietary", "proprietary and confidential", "proprietary confidential", 0.8),
    ("proprietary", "unauthorized copying of this (?:file|software|document)", "unauthorized copying", 0.9),
]

# Words of which a rule needs one, where its names share no keyword: any match holds at least one of them.
_ANY = {
    "bsd-2": "bsd freebsd", "bsd-0": "bsd 0bsd", "mpl-2": "mozilla mpl", "mpl-1": "mozilla mpl",
    "cddl": "cddl development", "eupl": "eupl european", "sspl": "sspl server", "zlib": "zlib libpng",
    "wtfpl": "wtfpl fuck", "openssl": "openssl ssleay", "odbl": "odbl database", "pddl": "pddl dedication",
    "lgpl": "lgpl lgplv2 lgplv3", "agpl-3": "agpl agplv3", "openrail": "rail openrail", "cc0": "cc0 cc creative", "noncommercial": "noncommercial commercial",
} | {f"cc-by{x}": "cc creative" for x in ("", "-nc", "-nd", "-sa", "-nc-nd", "-nc-sa")}
_FORM_ANY = {
    "link": "opensource spdx choosealicense gnu creativecommons",
    "grant": "license released distributed available provided published shared governed covered",
}


@dataclass(frozen=True)
class Rule:
    """``keywords``: groups of words; a text needs one word of each group for the rule to be run."""

    name: str
    label: str
    priority: int
    expression: str
    keywords: tuple[frozenset[str], ...]
    score: float


# Words that plain prose is full of tell nothing and are no keywords.
_PLAIN = frozenset("the under by for of and to in version mit 2".split())


def _groups(every: str, *one_of: str) -> tuple[frozenset[str], ...]:
    groups = [frozenset([w]) for w in every.split() if w not in _PLAIN]
    return tuple(dict.fromkeys(groups + [frozenset(g.split()) for g in one_of if g]))


def build_rules() -> list[Rule]:
    """All rules in order: base phrases, sentences, then every name in every form."""
    rules = [
        Rule(f"{BASE}:{label}", label, 0, phrase, _groups(phrase), 0.9) for phrase, label in BASE_PHRASES.items()
    ]
    for i, (label, text, keywords, score) in enumerate(SENTENCES):
        any_of = "" if keywords else _ANY[label]
        rules.append(Rule(f"sentence:{label}:{i}", label, 1, text, _groups(keywords, any_of), score))
    for order, (form, text, form_keywords, score) in enumerate(FORMS):
        for i, (label, name, name_keywords, identifier) in enumerate(NAMES):
            if form == "name" and f" {_L}" not in name.replace(f"(?: {_L})?", ""):
                continue  # just names that say they are a license
            by_identifier = "{i}" in text
            if by_identifier:
                plain = [w for w in identifier.split("(?:")[0].split() if w.isalpha() and len(w) > 1]
                wanted, any_of = " ".join(plain[:1]), ""
            else:
                wanted, any_of = name_keywords, "" if name_keywords else _ANY[label]
            keywords = _groups(f"{form_keywords} {wanted}", any_of, _FORM_ANY.get(form, ""))
            expression = text.format(n=f"(?:{name})", i=f"(?:{identifier})")
            if keywords:  # a bare "under mit" has none and is no sign of a license
                rules.append(Rule(f"{form}:{label}:{i}", label, 2 + order, expression, keywords, score))
    return rules


class Scanner:
    """Compiled rules with their keyword gate."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.compiled = [re.compile(rf"(?<![^ ])(?:{r.expression})(?= )".encode()) for r in rules]
        self.automaton = ahocorasick.Automaton()
        words = {w for r in rules for group in r.keywords for w in group}
        for word in words | {s for s, w in _SPELLINGS.items() if w in words}:
            self.automaton.add_word(f" {word} ", _SPELLINGS.get(word, word))
        self.automaton.make_automaton()
        # a rule is looked up by the words of its narrowest group
        self._by_word: dict[str, list[int]] = {}
        for i, rule in enumerate(rules):
            first = min(rule.keywords, key=lambda g: ("license" in g, len(g), sorted(g)))
            for word in first:
                self._by_word.setdefault(word, []).append(i)

    def gated(self, present: set[str]) -> list[int]:
        """Rules whose keywords a text has."""
        found = {i for word in present for i in self._by_word.get(word, ())}
        return sorted(i for i in found if all(not present.isdisjoint(g) for g in self.rules[i].keywords))

    def find(self, text: bytes, present: set[str]) -> list[tuple[int, int, int]]:
        """Detections (rule, start, end) in a word string, every word followed by a blank."""
        found = []
        for i in self.gated(present):
            found += [(i, m.start(), m.end()) for m in self.compiled[i].finditer(text) if m.end() > m.start()]
        return found

    def resolve(self, found: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int]], int]:
        """Detections that stay, in text order, and the number of suppressed ones."""
        rules = self.rules
        ordered = sorted(found, key=lambda d: (rules[d[0]].priority, d[1] - d[2], d[1], d[0]))
        kept, outer = [], _Cover()
        for rule, start, end in ordered:
            if rules[rule].priority and outer.holds(start, end):
                continue
            kept.append((rule, start, end))
            outer.add(start, end)
        return sorted(kept, key=lambda d: (d[1], d[2], d[0])), len(found) - len(kept)


class _Cover:
    """Intervals of which none lies inside another one, by start; their ends then rise as well."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def holds(self, start: int, end: int) -> bool:
        at = bisect_right(self.starts, start) - 1
        return at >= 0 and self.ends[at] >= end

    def add(self, start: int, end: int) -> None:
        if self.holds(start, end):
            return
        low = bisect_left(self.starts, start)
        high = bisect_right(self.ends, end)
        self.starts[low : max(low, high)] = [start]
        self.ends[low : max(low, high)] = [end]


@cache
def default_scanner() -> Scanner:
    return Scanner(build_rules())


def word_string(data: np.ndarray, words: Words) -> tuple[bytes, np.ndarray]:
    """Words of all texts, each followed by one blank, and the place of each word in that string."""
    sizes = words.end - words.start + 1
    ends = np.cumsum(sizes)
    places = ends - sizes
    source = np.arange(ends[-1] if len(ends) else 0) + np.repeat(words.start - places, sizes)
    joined = data[np.minimum(source, max(len(data) - 1, 0))]
    joined[ends - 1] = 0x20
    return joined.tobytes(), places


_DETECTION = (
    "struct<rule:string,label:string,score:double,first_word:bigint,last_word:bigint,char_start:bigint,char_end:bigint>"
)
_SCHEMA = f"doc_id long, n_words long, n_suppressed long, detections array<{_DETECTION}>"


def _scan_step(batch: pa.RecordBatch, scanner: Scanner) -> pa.RecordBatch:
    data, bounds = raw(batch.column("text"))
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    data = lower_ascii(data)
    words = find_words(data, bounds, _BETWEEN)
    joined, places = word_string(data, words)
    edges = np.append(places, len(joined))[words.bounds]  # place of each text in the joined string
    present: dict[int, set[str]] = {}
    hits = list(scanner.automaton.iter(" " + joined.decode("latin-1")))
    if hits:
        # the match ends at the blank after the word; one blank was put in front of the string
        owners = np.searchsorted(edges, [at - 1 for at, _ in hits], "right") - 1
        for owner, (_, word) in zip(owners.tolist(), hits):
            present.setdefault(owner, set()).add(word)
    detections: list[list[dict]] = [[] for _ in range(batch.num_rows)]
    suppressed = np.zeros(batch.num_rows, np.int64)
    for owner, keys in present.items():
        low = edges[owner]
        kept, suppressed[owner] = scanner.resolve(scanner.find(joined[low : edges[owner + 1]], keys))
        for i, start, end in kept:
            first, last = np.searchsorted(places, [low + start, low + end - 1], "right") - 1
            rule, base = scanner.rules[i], words.bounds[owner]
            detections[owner].append(
                {
                    "rule": rule.name,
                    "label": rule.label,
                    "score": rule.score,
                    "first_word": int(first - base),
                    "last_word": int(last - base),
                    "char_start": int(lead[words.start[first]] - lead[bounds[owner]]),
                    "char_end": int(lead[words.end[last]] - lead[bounds[owner]]),
                }
            )
    kind = pa.list_(
        pa.struct(
            [("rule", pa.string()), ("label", pa.string()), ("score", pa.float64())]
            + [(c, pa.int64()) for c in ("first_word", "last_word", "char_start", "char_end")]
        )
    )
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"),
            pa.array(np.diff(words.bounds).astype(np.int64)),
            pa.array(suppressed),
            pa.array(detections, kind),
        ],
        ["doc_id", "n_words", "n_suppressed", "detections"],
    )


def scan(documents: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_suppressed and ``detections`` in text order, with word and character places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = default_scanner() if rules is None else Scanner(rules)
        for whole in batches:
            for batch in steps(whole):
                yield _scan_step(batch, scanner)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)


def summary(scanned: DataFrame) -> DataFrame:
    """One row of figures per document: base places, labels and the strongest detection's score."""
    base = F.filter("detections", lambda d: d["rule"].startswith(f"{BASE}:"))
    starts = F.transform(base, lambda d: d["first_word"])
    names = lambda ds: F.array_join(F.array_sort(F.array_distinct(F.transform(ds, lambda d: d["label"]))), ",")
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("detections")).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["score"])), F.lit(0.0)).alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
        "n_suppressed",
    )

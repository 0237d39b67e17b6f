"""License scans: ordered signature rules, gated by keywords, with suppression of contained detections.

A text is read as words (A-Z lower-cased; letters, digits and all that is not ASCII). A rule is a regular expression
over the words joined by spaces, written for a licence's SPDX name, its text or notice, a declaration ("license: MIT"),
its full name or its short form; it is tried only on texts that hold one of its keywords. Of an SPDX expression every
name counts. Keywords of all rules are found in one pass, by looking
up the hashes of a run's words. A detection goes if it lies inside one of a rule that stands before its own, or inside a
longer one of the same rank; a denial ("not licensed under ...", "not the ...") stands first and names no licence. Base phrases are
counted at all their places, whatever is suppressed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tilewright.llm.flat import WORD_ANY_CASE, flat, in_small_batches, runs, span_hashes, spans

#: Phrases whose places are counted, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Licences by label: SPDX names as words, full names, short forms that count beside a verb or a version, keywords.
LICENCES = [
    ("gpl", r"gpl(?: [123] 0)?", r"(?:gnu )?general public licen[cs]e|gnu gpl", r"gpl(?:v[123](?: \d)?)?", "gpl gplv1 gplv2 gplv3 general"),
    ("lgpl", r"lgpl(?: [23] [01])?", r"(?:gnu )?(?:lesser|library) general public licen[cs]e|gnu lgpl", r"lgpl(?:v[23](?: \d)?)?", "lgpl lgplv2 lgplv3 lesser library"),
    ("agpl", r"agpl(?: [13] 0)?", r"(?:gnu )?affero general public licen[cs]e|gnu agpl", r"agpl(?:v[13](?: \d)?)?", "agpl agplv1 agplv3 affero"),
    ("gfdl", r"gfdl(?: 1 [123])?", r"(?:gnu )?free documentation licen[cs]e", r"gfdl|gnu fdl", "gfdl fdl documentation"),
    ("apache", r"apache(?: [12] [01])?", r"apache(?: software)? licen[cs]e", r"apache v?[12](?: [01])?|asl(?: [12] 0)?|alv2", "apache asl alv2"),
    ("mit", r"mit(?: 0)?", r"mit licen[cs]e|expat licen[cs]e|x11 licen[cs]e", r"mit", "mit expat x11"),
    ("bsd-2-clause", r"bsd 2 clause", r"(?:2 clause|two clause|simplified|freebsd) bsd(?: licen[cs]e)?|bsd 2 clause(?: licen[cs]e)?", r"bsd2", "bsd bsd2"),
    ("bsd-3-clause", r"bsd 3 clause", r"(?:3 clause|three clause|new|revised|modified) bsd(?: licen[cs]e)?|bsd 3 clause(?: licen[cs]e)?", r"bsd3", "bsd bsd3"),
    ("bsd-4-clause", r"bsd 4 clause", r"(?:4 clause|four clause|original) bsd(?: licen[cs]e)?|bsd 4 clause(?: licen[cs]e)?", r"bsd4", "bsd bsd4"),
    ("bsd", r"0bsd|bsd 1 clause", r"bsd(?: style)? licen[cs]e|berkeley software distribution licen[cs]e", r"bsd|0bsd", "bsd 0bsd berkeley"),
    ("isc", r"isc", r"isc licen[cs]e|internet (?:systems|software) consortium licen[cs]e", r"isc", "isc consortium"),
    ("mpl", r"mpl(?: [12] [01])?", r"mozilla public licen[cs]e", r"mpl(?:v[12])?(?: [12] [01])?", "mozilla mpl mplv1 mplv2"),
    ("epl", r"epl(?: [12] 0)?", r"eclipse public licen[cs]e", r"epl(?:v[12])?(?: [12] 0)?", "eclipse epl eplv1 eplv2"),
    ("cddl", r"cddl(?: 1 [01])?", r"common development and distribution licen[cs]e", r"cddl", "cddl development"),
    ("cpl", r"cpl(?: 1 0)?", r"(?:ibm )?common public licen[cs]e", r"cpl", "cpl common"),
    ("eupl", r"eupl(?: 1 [012])?", r"european union public licen[cs]e", r"eupl", "eupl european"),
    ("osl", r"osl(?: [123] [01])?", r"open software licen[cs]e", r"osl", "osl open"),
    ("afl", r"afl(?: [123] [012])?", r"academic free licen[cs]e", r"afl", "afl academic"),
    ("artistic", r"artistic(?: [12] 0)?", r"(?:perl )?artistic licen[cs]e|clarified artistic", r"artistic 2(?: 0)?", "artistic"),
    ("bsl", r"bsl 1 0", r"boost software licen[cs]e|boost licen[cs]e", r"boost|bsl 1 0", "boost bsl"),
    ("busl", r"busl 1 1", r"business source licen[cs]e", r"busl|bsl 1 1", "busl bsl business"),
    ("sspl", r"sspl 1 0", r"server side public licen[cs]e", r"sspl(?:v1)?", "sspl ssplv1 server"),
    ("elastic", r"elastic 2 0", r"elastic licen[cs]e", r"elv2|elastic v?2(?: 0)?", "elastic elv2"),
    ("wtfpl", r"wtfpl", r"do what the f\w+ you want to public licen[cs]e", r"wtfpl", "wtfpl what"),
    ("unlicense", r"unlicense", r"(?:the )?unlicen[cs]e", r"unlicen[cs]e", "unlicense unlicence"),
    ("zlib", r"zlib", r"zlib licen[cs]e|zlib libpng licen[cs]e", r"zlib", "zlib"),
    ("libpng", r"libpng(?: 2 0)?", r"(?:the )?libpng licen[cs]e|png reference library licen[cs]e", r"libpng", "libpng png"),
    ("openssl", r"openssl", r"openssl licen[cs]e|ssleay licen[cs]e", r"openssl", "openssl ssleay"),
    ("python", r"python 2 0|psf 2 0", r"python software foundation licen[cs]e|psf licen[cs]e|python licen[cs]e", r"psf|psfl", "python psf psfl"),
    ("php", r"php 3 01?", r"php licen[cs]e", r"php 3 01", "php"),
    ("ruby", r"ruby", r"ruby licen[cs]e|ruby s licen[cs]e", r"ruby", "ruby"),
    ("ofl", r"ofl(?: 1 [01])?", r"sil open font licen[cs]e|open font licen[cs]e", r"ofl|sil ofl", "ofl sil font"),
    ("odbl", r"odbl 1 0", r"open database licen[cs]e", r"odbl", "odbl database"),
    ("odc-by", r"odc by 1 0", r"open data commons attribution(?: licen[cs]e)?", r"odc by", "odc commons"),
    ("pddl", r"pddl 1 0", r"public domain dedication and licen[cs]e", r"pddl", "pddl dedication"),
    ("cc0", r"cc0(?: 1 0)?", r"creative commons zero|cc0(?: 1 0)? universal", r"cc0|cc zero", "cc0 cc creative"),
    ("cc-by-nc-sa", r"cc by nc sa \d \d", r"creative commons attribution non ?commercial share ?alike", r"cc by nc sa", "cc creative"),
    ("cc-by-nc-nd", r"cc by nc nd \d \d", r"creative commons attribution non ?commercial no ?deriv\w*", r"cc by nc nd", "cc creative"),
    ("cc-by-nc", r"cc by nc \d \d", r"creative commons attribution non ?commercial", r"cc by nc", "cc creative"),
    ("cc-by-sa", r"cc by sa \d \d", r"creative commons attribution share ?alike", r"cc by sa", "cc creative"),
    ("cc-by-nd", r"cc by nd \d \d", r"creative commons attribution no ?deriv\w*", r"cc by nd", "cc creative"),
    ("cc-by", r"cc by \d \d", r"creative commons attribution", r"cc by", "cc creative"),
    ("ms-pl", r"ms pl", r"microsoft public licen[cs]e", r"ms pl", "microsoft ms"),
    ("ms-rl", r"ms rl", r"microsoft reciprocal licen[cs]e", r"ms rl", "microsoft ms"),
    ("upl", r"upl 1 0", r"universal permissive licen[cs]e", r"upl", "upl permissive"),
    ("ncsa", r"ncsa", r"(?:university of illinois )?ncsa open source licen[cs]e", r"ncsa", "ncsa"),
    ("postgresql", r"postgresql", r"postgresql licen[cs]e", r"postgresql", "postgresql"),
    ("w3c", r"w3c(?: 20150513)?", r"w3c software (?:notice and |and document )?licen[cs]e", r"w3c", "w3c"),
    ("openrail", r"openrail(?: [ms])?", r"(?:creativeml |bigscience )?open ?rail(?: [ms])?(?: licen[cs]e)?|responsible ai licen[cs]e", r"openrail", "openrail rail responsible"),
    ("llama", r"llama[23]?", r"llama(?: [23](?: \d)?)? community licen[cs]e", r"llama[23]", "llama llama2 llama3"),
]

#: Sentences of licence texts and notices, and addresses of licences: label, expression, keywords.
TEXTS = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby"),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "substantial"),
    ("mit", r"opensource org licen[cs]es mit", "opensource"),
    ("bsl", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "hereby"),
    ("isc", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", "hereby"),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "hereby"),
    ("ncsa", r"to deal with the software without restriction including without limitation the rights to use", "restriction"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", "redistribution"),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", "redistributions"),
    ("bsd-3-clause", r"neither the name of(?: [^ ]+){1,12}? (?:nor the names of (?:its|any|the) contributors )?may be used to endorse or promote products", "endorse"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "advertising"),
    ("apache", r"licen[cs]ed under the apache licen[cs]e version 2 0 the licen[cs]e you may not use this file except in compliance with the licen[cs]e", "compliance"),
    ("apache", r"you may not use this file except in compliance with the licen[cs]e", "compliance"),
    ("apache", r"(?:www )?apache org licen[cs]es(?: licen[cs]e [12] 0)?", "apache"),
    ("gpl", r"(?:this program|this file|it) is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", "redistribute"),
    ("gpl", r"you should have received a copy of the gnu general public licen[cs]e", "received"),
    ("gpl", r"(?:www )?gnu org licen[cs]es gpl(?: [123] 0)?", "gnu"),
    ("lgpl", r"(?:this library|this program|this file|it) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e", "redistribute"),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e", "received"),
    ("lgpl", r"(?:www )?gnu org licen[cs]es lgpl(?: [23] [01])?", "gnu"),
    ("agpl", r"(?:this program|this file|it) is free software you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e", "redistribute"),
    ("agpl", r"you should have received a copy of the gnu affero general public licen[cs]e", "received"),
    ("agpl", r"(?:www )?gnu org licen[cs]es agpl(?: 3 0)?", "gnu"),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e", "granted"),
    ("mpl", r"this source code form is subject to the terms of the mozilla public licen[cs]e", "mozilla"),
    ("mpl", r"mozilla org mpl(?: [12] [01])?", "mozilla"),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e", "eclipse"),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e", "development"),
    ("zlib", r"in no event will the authors be held liable for any damages arising from the use of this software", "liable"),
    ("zlib", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "misrepresented"),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered"),
    ("unlicense", r"unlicen[cs]e org", "unlicense"),
    ("wtfpl", r"you just do what the f\w+ you want to", "what"),
    ("cc0", r"has waived all copyright and related or neighbou?ring rights", "waived"),
    ("cc0", r"creativecommons org publicdomain zero 1 0", "creativecommons"),
    ("cc-by-nc-sa", r"creativecommons org licen[cs]es by nc sa \d \d", "creativecommons"),
    ("cc-by-nc-nd", r"creativecommons org licen[cs]es by nc nd \d \d", "creativecommons"),
    ("cc-by-nc", r"creativecommons org licen[cs]es by nc \d \d", "creativecommons"),
    ("cc-by-sa", r"creativecommons org licen[cs]es by sa \d \d", "creativecommons"),
    ("cc-by-nd", r"creativecommons org licen[cs]es by nd \d \d", "creativecommons"),
    ("cc-by", r"creativecommons org licen[cs]es by \d \d", "creativecommons"),
    ("cc-by", r"this (?:work|article|document) is licen[cs]ed under a creative commons attribution(?: \d \d)?(?: international| unported| generic)? licen[cs]e", "creative"),
    ("openssl", r"this product includes software developed by the openssl project", "openssl"),
    ("php", r"this product includes php software freely available from", "php"),
    ("python", r"psf is making python(?: [^ ]+){0,3} available to licen[cs]ee", "psf"),
    ("artistic", r"the intent of this document is to state the conditions under which a package may be copied", "intent"),
    ("ofl", r"this font software is licen[cs]ed under the sil open font licen[cs]e", "font"),
    ("odbl", r"this [^ ]+ is made available under the open database licen[cs]e", "database"),
    ("w3c", r"permission to copy modify and distribute this (?:software and its documentation|work) with or without modification for any purpose and without fee or royalty is hereby granted", "royalty"),
    ("public-domain", r"(?:released|dedicated|placed|put) (?:in|into|to) the public domain", "domain"),
    ("public-domain", r"public domain", "domain"),
]

_UNDER = r"under(?: the| an?)?(?: terms of(?: the)?)? "
_VERB = r"(?:licen[cs]ed|released|distributed|published|available|redistribut\w+)(?: \w+){0,3} " + _UNDER
#: A number is no version where it counts clauses.
_VERSION = r"(?: international| unported)?(?: licen[cs]e)?(?: version| v)? ?\d+(?: \d+)*(?! clause)"
_DENIAL = r"(?:not|never|no longer|isn t|aren t|wasn t|neither|nor|rather than|instead of|unlike) (?!only|just|limited|merely)"
_DECLARED = r"licen[cs]es?(?: types?| names?| ids?| identifiers?| keys?| info| text)? (?:is |are |under )?(?:the )?"
#: What may follow a name in an SPDX expression.
_LATER = r"(?: only| or later)?(?: with(?: \w+){1,4}? exception(?: \d+)*)?"
_LICENCE_WORDS = "license licence licenses licences"


class Rule(NamedTuple):
    """label is None for a denial; one of the keywords (words) must be in a text, and of ``also``, if there are any.

    A detection is the expression's group "hit", if it has one, else all of its match.
    """

    label: str | None
    rank: int
    keywords: tuple[bytes, ...]
    expression: re.Pattern[bytes]
    confidence: float
    also: tuple[bytes, ...] = ()


def default_rules() -> list[Rule]:
    """Rules by rank: denials, SPDX lines, texts and notices, grants, declarations, names with a version, names; then table order."""
    rank_of = {k: i for i, k in enumerate(("denied", "spdx", "text", "granted with version", "granted", "declared", "named with version", "named"))}
    found = []
    every = "|".join(f"{spdx}|{name}" for _, spdx, name, _, _ in LICENCES)

    def add(kind: str, label: str | None, expression: str, keys: str, confidence: float, also: str = "") -> None:
        whole = re.compile(rb"(?<![^ ])(?:" + expression.encode() + rb")(?![^ ])")
        found.append(Rule(label, rank_of[kind], tuple(keys.encode().split()), whole, confidence, tuple(also.encode().split())))

    for label, spdx, name, short, keys in LICENCES:
        any_name = f"(?:{name}|{short})"
        add("denied", None, _DENIAL + rf"(?:\w+ ){{0,4}}?{_UNDER}{any_name}(?:{_VERSION})?(?: licen[cs]e)?", keys, 0.0, "under")
        add("denied", None, _DENIAL + rf"(?:a |an |the |by the )?{any_name}(?:{_VERSION})?(?: licen[cs]e)?", keys, 0.0)
        add("spdx", label, rf"spdx licen[cs]e identifier (?:(?:{every}){_LATER} (?:or|and) )*(?P<hit>(?:{spdx}){_LATER})", "spdx", 1.0)
        add("granted with version", label, _VERB + any_name + _VERSION, keys, 0.98, "under")
        add("granted", label, _VERB + any_name + "(?: licen[cs]e)?", keys, 0.95, "under")
        declared = f"(?:{spdx}|{short})"  # with the word licence after it, it is a name
        add("declared", label, _DECLARED + rf"(?:(?:{every}){_LATER} (?:or|and) )*(?P<hit>{declared}(?:{_VERSION})?{_LATER})(?! licen[cs]e)", keys, 0.9, _LICENCE_WORDS)
        add("declared", label, declared + r"(?: style)? licen[cs]ed", keys, 0.9, "licensed licenced")
        add("named with version", label, f"(?:{name}|{short}){_VERSION}", keys, 0.8)
        add("named", label, name, keys, 0.6)
        # Short forms that are no words of their own count alone.
        if re.search(r"v\[|cc |cc0|gpl|mpl|wtfpl|odbl|pddl|eupl|cddl|sspl|busl|elv2", short):
            add("named", label, short, keys, 0.6)
    for label, expression, keys in TEXTS:
        add("named" if expression == "public domain" else "text", label, expression, keys, 0.6 if expression == "public domain" else 0.97)
    return found


def kept(hits: list[tuple[int, int, int, str | None, float]]) -> list[tuple[int, int, int, str | None, float]]:
    """Hits (start, end, rank, label, confidence) that lie in no other of lower rank, nor in a longer of the same.

    Of hits with one interval the first rule's stays. One sweep from the left, longest first, with the furthest end
    seen so far for each rank: ranks are few.
    """
    out, reach = [], {}
    for h in sorted(dict.fromkeys(hits), key=lambda h: (h[0], -h[1], h[2])):
        if all(end < h[1] or rank > h[2] for rank, end in reach.items()):
            out.append(h)
        reach[h[2]] = max(reach.get(h[2], 0), h[1])
    return out


OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start:long,`end`:long,label:string,confidence:double>>"
NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
_ARROW_HITS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("confidence", pa.float64())]))
_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Scanner:
    """Base places and hits of texts, of which only those with keywords are read by rules."""

    def __init__(self, base: dict[str, str], rules: Sequence[Rule]):
        self.phrases = [(re.compile(rb"(?= " + p.encode() + rb" )"), label) for p, label in base.items()]
        words = sorted({w for r in rules for w in (*r.keywords, *r.also)} | {p.encode().split()[0] for p in base})
        place = {w: i for i, w in enumerate(words)}
        mask = lambda some: sum(1 << place[w] for w in set(some))
        self.gates = [(mask(r.keywords), mask(r.also)) for r in rules]
        self.base_gates = [1 << place[p.encode().split()[0]] for p in base]
        self.rules = rules
        ends = np.cumsum([len(w) for w in words])
        h = span_hashes(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)
        self.order = np.argsort(h)
        self.hashes = h[self.order]

    def keywords(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> dict[int, int]:
        """For each text with keywords which of them it has, as bits: one pass over the words of a run."""
        h = span_hashes(data, starts, ends)
        at = np.searchsorted(self.hashes, h).clip(0, len(self.hashes) - 1)
        hit = self.hashes[at] == h
        out: dict[int, int] = {}
        for d, k in np.unique(np.stack([doc[hit], self.order[at[hit]]], 1), axis=0).tolist():
            out[d] = out.get(d, 0) | 1 << k
        return out

    def scan(self, low: bytes, has: int) -> tuple[list, list]:
        """(base places as (word, label), hits kept) of a text's lower-cased bytes; ``has``: its keywords."""
        phrases = [p for p, gate in zip(self.phrases, self.base_gates, strict=True) if has & gate]
        todo = [r for r, (one, also) in zip(self.rules, self.gates, strict=True) if has & one and (not also or has & also)]
        if not phrases and not todo:
            return [], []
        joined = b" " + b" ".join(_WORDS.findall(low)) + b" "
        word_at = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
        index = lambda at: int(np.searchsorted(word_at, at))
        places = [(index(m.start()), label) for e, label in phrases for m in e.finditer(joined)]
        hits = []
        for r in todo:
            group = "hit" if "hit" in r.expression.groupindex else 0
            hits += [(index(m.start(group) - 1), index(m.end(group)), r.rank, r.label, r.confidence) for m in r.expression.finditer(joined)]
        return places, [h for h in kept(hits) if h[3] is not None]


def license_scan(docs: DataFrame, base: dict[str, str] = BASE, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Licences in every whole text of ``docs`` (doc_id, text); other columns are not read.

    Returns doc_id, n_words, n_base (places of base phrases), first_word and last_word (smallest and largest start of
    one; null without any), base_labels, labels (base ones and those of detections; distinct, sorted, comma-joined),
    score (highest confidence of a detection, 0.5 at least with a base phrase, else 0) and detections (word intervals).
    A null text counts as empty: no words, no labels, score 0. Rows stay one to one, repeated rows and null ids too.
    """
    rules = default_rules() if rules is None else list(rules)

    def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, rules)
        for batch in batches:
            data, offsets = flat(batch.column(1))
            counts, out = np.zeros(batch.num_rows, np.int64), [([], [])] * batch.num_rows
            for i, j, part, off in runs(data, offsets):
                starts, ends, doc = spans(WORD_ANY_CASE[part], off)
                counts[i:j] = np.bincount(doc, minlength=j - i)
                for d, has in scanner.keywords(part, starts, ends, doc).items():
                    out[i + d] = scanner.scan(part[off[d] : off[d + 1]].tobytes().lower(), has)
            first = [min(p)[0] if p else None for p, _ in out]
            last = [max(p)[0] if p else None for p, _ in out]
            names = [",".join(sorted({x[1] for x in p})) for p, _ in out]
            labels = [",".join(sorted({x[1] for x in p} | {h[3] for h in k})) for p, k in out]
            score = [max([h[4] for h in k] + [0.5 if p else 0.0]) for p, k in out]
            hits = [[{"start": h[0], "end": h[1], "label": h[3], "confidence": h[4]} for h in k] for _, k in out]
            columns = [batch.column(0).cast(pa.int64()), pa.array(counts), pa.array([len(p) for p, _ in out], pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(names, pa.string()), pa.array(labels, pa.string()), pa.array(score, pa.float64()), pa.array(hits, _ARROW_HITS)]
            yield pa.RecordBatch.from_arrays(columns, NAMES)

    return in_small_batches(docs).select("doc_id", "text").mapInArrow(scan_batches, OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("detections")


def base_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the scan that SQL can express: words, and places of the base phrases."""
    return query(spark, sf_dir).drop("labels", "score")


BASE_SQL = f"""
with d as (
  select row_number() over () as u, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents
), b as (
  select string_split(p, ' ') as p, label from (values {", ".join(f"('{p}', '{label}')" for p, label in BASE.items())}) t(p, label)
), h as (
  select u, label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1:i + len(p)] = p)) as spot from d, b
)
select doc_id, len(any_value(w))::bigint as n_words, count(spot) as n_base, min(spot)::bigint as first_word, max(spot)::bigint as last_word, coalesce(string_agg(distinct label, ',' order by label), '') as base_labels
from d left join h using (u) group by u, doc_id
"""

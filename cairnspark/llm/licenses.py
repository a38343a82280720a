"""License scan: ordered signature rules behind a keyword prefilter.

A rule is a regular expression with a label, a priority and keywords: without any of them it cannot match. An
automaton finds the keywords of all rules in one pass over a text, and only rules whose keywords occur are
run. Detections are taken by priority, then length, then place; one that lies within a detection already
taken is suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, kept_apart, raw_texts, text_slices, with_fields
from .license_texts import SENTENCES

#: Phrases that are counted wherever their words stand consecutively, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Names by which licenses are called, as (label, name patterns). A name counts as a license
# notice next to the words licensed, license or licence; V stands for "version" or "v", optional.
NAMES = """
mit | mit(?:/expat)? ; expat
apache-1.1 | apache software V1\\.1
apache-2.0 | apache(?: software)? V2(?:\\.0)? ; asl 2\\.0
bsd-2-clause | (?:bsd 2-clause|2-clause bsd|simplified bsd|freebsd|two-clause bsd)
bsd-3-clause | (?:bsd 3-clause|3-clause bsd|new bsd|modified bsd|revised bsd|three-clause bsd)
bsd-4-clause | (?:bsd 4-clause|4-clause bsd|original bsd|old bsd)
0bsd | (?:bsd zero clause|zero-clause bsd|free public)
bsd | bsd(?:-style)?
isc | isc
gpl-1.0 | gnu general public V1(?:\\.0)? ; gpl ?v?1(?:\\.0)?
gpl-2.0 | (?:gnu )?general public V2(?:\\.0)? ; gpl ?v?2(?:\\.0)?
gpl-3.0 | (?:gnu )?general public V3(?:\\.0)? ; gpl ?v?3(?:\\.0)?
gpl | gnu general public ; gnu gpl ; gpl
lgpl-2.0 | (?:gnu )?library general public V2(?:\\.0)? ; lgpl ?v?2\\.0
lgpl-2.1 | (?:gnu )?lesser general public V2\\.1 ; lgpl ?v?2\\.1
lgpl-3.0 | (?:gnu )?lesser general public V3(?:\\.0)? ; lgpl ?v?3(?:\\.0)?
lgpl | (?:gnu )?(?:lesser|library) general public ; gnu lgpl ; lgpl
agpl-3.0 | (?:gnu )?affero general public V3(?:\\.0)? ; agpl ?v?3(?:\\.0)?
agpl | (?:gnu )?affero general public ; gnu agpl ; agpl
gfdl-1.2 | gnu free documentation V1\\.2
gfdl-1.3 | gnu free documentation V1\\.3
gfdl | gnu free documentation ; gfdl
mpl-1.0 | mozilla public V1\\.0 ; mpl ?v?1\\.0
mpl-1.1 | mozilla public V1\\.1 ; mpl ?v?1\\.1
mpl-2.0 | mozilla public V2(?:\\.0)? ; mpl ?v?2(?:\\.0)?
mpl | mozilla public ; mpl
epl-1.0 | eclipse public V1(?:\\.0)? ; epl ?v?1\\.0
epl-2.0 | eclipse public V2(?:\\.0)? ; epl ?v?2\\.0
epl | eclipse public
edl | eclipse distribution
cddl-1.0 | common development and distribution V1\\.0 ; cddl ?v?1\\.0
cddl-1.1 | common development and distribution V1\\.1 ; cddl ?v?1\\.1
cddl | common development and distribution ; cddl
cpl-1.0 | common public V1\\.0
cpal-1.0 | common public attribution V1\\.0
ipl-1.0 | ibm public V1\\.0
artistic-1.0 | artistic V1\\.0
artistic-2.0 | artistic V2\\.0
artistic | (?:the )?(?:perl )?artistic
zlib | zlib(?:/libpng)?
libpng | libpng
libtiff | libtiff
bsl-1.0 | boost software V1\\.0
boost | boost software ; boost
wtfpl | (?:do what the fuck you want to public|wtfpl)
unlicense | (?:the )?unlicense
cc0-1.0 | cc0(?: 1\\.0)?(?: universal)?
cc-by-2.0 | creative commons attribution 2\\.0 ; cc[- ]by[- ]2\\.0
cc-by-2.5 | creative commons attribution 2\\.5 ; cc[- ]by[- ]2\\.5
cc-by-3.0 | creative commons attribution 3\\.0 ; cc[- ]by[- ]3\\.0
cc-by-4.0 | creative commons attribution 4\\.0(?: international)? ; cc[- ]by[- ]4\\.0
cc-by-sa-3.0 | creative commons attribution[- ]share ?alike 3\\.0 ; cc[- ]by[- ]sa[- ]3\\.0
cc-by-sa-4.0 | creative commons attribution[- ]share ?alike 4\\.0(?: international)? ; cc[- ]by[- ]sa[- ]4\\.0
cc-by-nc-4.0 | creative commons attribution[- ]non-?commercial 4\\.0(?: international)? ; cc[- ]by[- ]nc[- ]4\\.0
cc-by-nd-4.0 | creative commons attribution[- ]no ?derivatives 4\\.0(?: international)? ; cc[- ]by[- ]nd[- ]4\\.0
cc-by-nc-sa-4.0 | creative commons attribution[- ]non-?commercial[- ]share ?alike 4\\.0(?: international)? ; cc[- ]by[- ]nc[- ]sa[- ]4\\.0
cc-by-nc-nd-4.0 | creative commons attribution[- ]non-?commercial[- ]no ?derivatives 4\\.0(?: international)? ; cc[- ]by[- ]nc[- ]nd[- ]4\\.0
creative-commons | creative commons
python-2.0 | python software foundation(?: V2)? ; psf
ruby | ruby
php-3.01 | php V3\\.01
vim | vim
ofl-1.1 | sil open font(?: V1\\.1)? ; ofl 1\\.1
postgresql | postgresql
openssl | openssl
ssleay | ssleay
curl | curl
x11 | x11
w3c | w3c software(?: notice and)?
ms-pl | microsoft public ; ms-pl
ms-rl | microsoft reciprocal ; ms-rl
eupl-1.1 | european union public V1\\.1 ; eupl ?v?1\\.1
eupl-1.2 | european union public V1\\.2 ; eupl ?v?1\\.2
afl-3.0 | academic free V3\\.0
osl-3.0 | open software V3\\.0
ecl-2.0 | educational community V2\\.0
ncsa | university of illinois/ncsa open source ; ncsa
odbl-1.0 | open (?:data commons open )?database V1\\.0 ; odbl
pddl-1.0 | public domain dedication and
odc-by-1.0 | open data commons attribution
apsl-2.0 | apple public source V2\\.0
sleepycat | sleepycat
qpl-1.0 | q public V1\\.0 ; qpl
lppl-1.3c | latex project public V1\\.3c?
intel | intel open source
nasa-1.3 | nasa open source agreement V1\\.3
cecill-2.1 | cecill V2\\.1
cecill-b | cecill-b
cecill-c | cecill-c
mulan-psl-2.0 | mulan p(?:ermissive )?s(?:oftware )?l?(?:icense)?,? V2
upl-1.0 | universal permissive V1\\.0
blueoak-1.0.0 | blue oak model
sspl-1.0 | server side public(?: V1)? ; sspl
busl-1.1 | business source(?: V1\\.1)? ; busl
elastic-2.0 | elastic V2(?:\\.0)?
commons-clause | commons clause
polyform-nc-1.0.0 | polyform noncommercial
bigscience-openrail-m | (?:bigscience |bloom )?openrail(?:-m)?
llama | llama \\d community
"""

# Whole phrases of license texts and notices, as (label, pattern, keywords).
PHRASES = """
mit | permission is hereby granted, free of charge, to any person obtaining a copy of this software | free of charge
mit | the above copyright notice and this permission notice shall be included in all copies | permission notice
isc | permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted | without fee
bsd | redistribution and use in source and binary forms, with or without modification | source and binary
bsd | redistributions? of source code must retain the above copyright notice | redistribution
bsd | redistributions? in binary form must reproduce the above copyright notice | redistribution
bsd-3-clause | neither the names? of .{1,80}? nor the names of (?:its|their) contributors may be used to endorse | endorse
bsd-4-clause | all advertising materials mentioning features or use of this software must display | advertising
bsd | this software is provided by the (?:copyright holders|regents|author) .{0,40}?as is.? and any express or implied | as is
gpl | this program is free software[;:,] you can redistribute it and/or modify it | free software
gpl-2.0-or-later | either version 2 of the license,? or \\(at your option\\) any later version | any later version
gpl-3.0-or-later | either version 3 of the license,? or \\(at your option\\) any later version | any later version
lgpl-2.1-or-later | either version 2\\.1 of the license,? or \\(at your option\\) any later version | any later version
gpl | you should have received a copy of the gnu general public license | received a copy
lgpl | you should have received a copy of the gnu lesser general public license | received a copy
agpl | you should have received a copy of the gnu affero general public license | received a copy
gpl | free software foundation, inc | free software foundation
apache | you may not use this file except in compliance with the license | in compliance
apache | unless required by applicable law or agreed to in writing,? software distributed under the license | applicable law
apache-2.0 | licensed under the apache license,? version 2\\.0 | apache
apache | licensed to the apache software foundation | apache
mpl-2.0 | this source code form is subject to the terms of the mozilla public license,? v\\.? ?2\\.0 | mozilla
mpl-1.1 | the contents of this file are subject to the mozilla public license version 1\\.1 | mozilla
epl | this program and the accompanying materials are made available under the terms of the eclipse | eclipse
zlib | this software is provided 'as-is', without any express or implied warranty | as-is
zlib | altered source versions must be plainly marked as such | altered source
bsl-1.0 | permission is hereby granted, free of charge, to any person or organization obtaining a copy | organization
unlicense | this is free and unencumbered software released into the public domain | unencumbered
wtfpl | you just do what the fuck you want to | you just do what
cc0-1.0 | to the extent possible under law,? .{1,80}? has waived all copyright | waived
creative-commons | this work is licensed under a creative commons | creative commons
public-domain | (?:released|placed|dedicated) (?:in)?to the public domain | public domain
public-domain | this (?:work|file|software|code) is in the public domain | public domain
ofl-1.1 | this font software is licensed under the sil open font license | sil open font
python-2.0 | psf is making python available to licensee on an "as is" basis | psf
openssl | this product includes software developed by the openssl project | openssl
ssleay | this product includes cryptographic software written by eric young | cryptographic
proprietary | all rights reserved | all rights reserved
proprietary | unauthori[sz]ed (?:copying|use|reproduction|distribution) .{0,60}?(?:is )?(?:strictly )?prohibited | unauthori
proprietary | (?:confidential and proprietary|proprietary and confidential) | proprietary
proprietary | this software is the (?:confidential and )?proprietary information of | proprietary
proprietary | no part of this (?:publication|work|document|book) may be reproduced | may be reproduced
commercial | (?:commercial|end[- ]user) licen[sc]e agreement | agreement
noncommercial | for non-?commercial (?:use|purposes) only | commercial
warranty-disclaimer | without warrant(?:y|ies) (?:of any kind|or conditions of any kind) | without warrant
mit | the software is provided "as is", without warranty of any kind, express or implied | warranty
mit | to deal in the software without restriction, including without limitation the rights to use | restriction
mit | shall the authors or copyright holders be liable for any claim | liable
isc | the software is provided "as is" and the author disclaims all warranties | disclaims
bsd | in no event shall the (?:copyright (?:holder|owner)s?|regents|author) or contributors be liable | contributors
bsd-2-clause | the views and conclusions contained in the software and documentation are those of the | conclusions
bsd-3-clause-clear | no express or implied licenses to any party's patent rights are granted by this | patent
gpl | without even the implied warranty of merchantability or fitness for a particular purpose\\.? see | merchantability
lgpl | without even the implied warranty of merchantability or fitness for a particular purpose\\.? see | merchantability
gpl | everyone is permitted to copy and distribute verbatim copies of this license document | verbatim
gpl-2.0-only | under the terms of version 2 of the gnu general public license | general
gpl-3.0-only | under the terms of version 3 of the gnu general public license | general
gpl-with-classpath-exception | linking this library statically or dynamically with other modules | statically
gpl-with-autoconf-exception | if you distribute this file as part of a program that contains a configuration script | configuration
gpl-with-gcc-exception | gcc runtime library exception | runtime
agpl | remote network interaction; use with the gnu general public license | interaction
agpl-3.0-or-later | gnu affero general public license as published by the free software foundation, either version | affero
gfdl | modify this document under the terms of the gnu free documentation license | documentation
apache | see the license for the specific language governing permissions and limitations | governing
apache-1.1 | the end-user documentation included with the redistribution, if any, must include | end-user
mpl-2.0 | a copy of the mpl was not distributed with this file | mpl
mpl-2.0-no-copyleft-exception | this source code form is "incompatible with secondary licenses" | incompatible
epl-2.0 | secondary licenses when the conditions for such availability set forth in the eclipse public | availability
cddl | subject to the terms of the common development and distribution license | distribution
cddl | when distributing covered code, include this cddl header notice in each file | covered
cpl-1.0 | the accompanying program is provided under the terms of this common public license | accompanying
artistic | the intent of this document is to state the conditions under which a package | conditions
artistic-2.0 | this license establishes the terms under which a given free software package may be | establishes
bsl-1.0 | distributed under the boost software license, version 1\\.0 | boost
zlib | the origin of this software must not be misrepresented | misrepresented
libpng | this copy of the libpng notices is provided for your convenience | libpng
x11 | to promote the sale, use or other dealings in this software without prior written authorization | dealings
ncsa | developed by: .{1,120}? university of illinois | illinois
unlicense | anyone is free to copy, modify, publish, use, compile, sell, or distribute this software | compile
wtfpl | verbatim or modified copies of this license document, and changing it is allowed | changing
beerware | this stuff is worth it, you can buy me a beer | beer
cc0-1.0 | the person who associated a work with this deed has dedicated the work to | dedicated
cc-by | you must give appropriate credit, provide a link to the license, and indicate if | appropriate
cc-by-sa | if you remix, transform, or build upon the material, you must distribute your contributions | remix
cc-by-nc | you may not use the material for commercial purposes | commercial
cc-by-nd | if you remix, transform, or build upon the material, you may not distribute the | remix
public-domain | (?:hereby )?(?:waives?|disclaims?) all copyright interest in | interest
public-domain | no copyright (?:is )?claimed | claimed
ofl-1.1 | the font software is provided "as is", without warranty of any kind, express or | font
python-2.0 | python software foundation license version 2 | python
postgresql | for any purpose, without fee, and without a written agreement is hereby granted | agreement
php-3.01 | the name "php" must not be used to endorse or promote products derived from | derived
w3c | this work is being provided by the copyright holders under the following license | following
vim | there are no restrictions on distributing unmodified copies of vim | unmodified
ruby | you may make and give away verbatim copies of the source form of the | verbatim
ms-pl | this license governs use of the accompanying software\\. if you use the software, you | governs
eupl | licensed under the eupl | eupl
odbl-1.0 | made available under the open database license | database
sspl-1.0 | server side public license as published by | server
busl-1.1 | create derivative works, redistribute, and make non-production use of the licensed work | non-production
elastic-2.0 | you may not provide the software to third parties as a hosted or managed | hosted
commons-clause | the license does not grant to you, the right to sell the software | sell
json | the software shall be used for good, not evil | evil
proprietary | for internal use only | internal
proprietary | do not (?:copy|distribute|redistribute|reproduce) without (?:prior )?(?:written )?(?:permission|consent) | without
proprietary | no (?:licen[sc]e|rights?),? express or implied,? .{0,40}? granted | granted
proprietary | subject to the terms of (?:your|the) (?:licen[sc]e|subscription) agreement | agreement
proprietary | trade secrets? (?:and confidential information )?of | trade
commercial | purchase a (?:commercial )?licen[sc]e | purchase
commercial | (?:evaluation|trial) (?:copy|version|period) only | only
noncommercial | (?:personal|educational|academic|research),? (?:and )?non-?commercial use | commercial
noncommercial | not (?:to be )?(?:used )?for commercial use | commercial
no-derivatives | no derivative works (?:are )?(?:permitted|allowed) | derivative
attribution-required | attribution (?:is )?required | attribution
dual-license | (?:dual|tri)-licen[sc]ed under | licen
copyright | copyright (?:\\(c\\)|©)? ?\\d{4} | copyright
"""

#: Priorities: tags and addresses name a license exactly, versions are surer than families.
TAG, PHRASE, VERSION, FAMILY = 90, 70, 50, 30
CONFIDENCE = {TAG: 1.0, PHRASE: 0.95, VERSION: 0.9, FAMILY: 0.75}


@dataclass(frozen=True)
class Rule:
    number: int
    label: str
    priority: int
    pattern: re.Pattern[bytes]
    keywords: tuple[bytes, ...]


def _compile(pattern: str) -> re.Pattern[bytes]:
    """Letters and digits must not continue a match; a blank stands for any white space and marks around line ends."""
    text = pattern.replace("[- ]", " ").replace("V", r"(?:licen[sc]e,? )?(?:\(?(?:version|ver\.?|v\.?) ?)?").replace(" ", r"[\s#*/;-]+")
    text = text.replace(r"[\s#*/;-]+)?", r"[\s#*/;-]*)?").replace(r"[\s#*/;-]+?", r"[\s#*/;-]*")
    return re.compile(rb"(?<![0-9a-z\x80-\xff])(?:" + text.encode() + rb")(?![0-9a-z\x80-\xff])", re.S)


def _keyword(name: str) -> bytes:
    """The longest literal run that every match of a name holds."""
    flat, depth, kept = "", 0, []
    for c in name.replace("V", "\0").replace("\\.", "\0").replace("\\d", "\0"):
        depth += (c == "(") - (c == ")")
        flat += c if depth == 0 and c not in "()" else "\0"
    flat = re.sub(r".\?", "\0", flat.replace("[- ]", "\0"))
    kept = re.findall(r"[a-z0-9-]+", flat)
    return max(kept, key=len, default="").encode()


def _keywords(name: str) -> tuple[str, ...]:
    """Literal runs of which every match of a name holds one: of a name that is one choice, a run of each branch."""
    choice = re.fullmatch(r"\(\?:([^()]*)\)", name)
    found = tuple(_keyword(n).decode() for n in (choice[1].split("|") if choice else [name]))
    if not all(found):
        raise ValueError(f"no keyword in the license name {name}")
    return found


def rules() -> list[Rule]:
    """All rules in order. Of each name: a notice before the word license, one after "licensed under",
    its tag as a package field, and its address on the usual license sites."""
    rows: list[tuple[str, int, str, tuple[str, ...]]] = []
    for line in NAMES.strip().splitlines():
        label, names = (x.strip() for x in line.split("|", 1))
        sure = VERSION if re.search(r"\d", label) else FAMILY
        for name in re.split(r" ; ", names):
            keys = _keywords(name)
            rows.append((label, sure, rf"(?:{name}) ?licen[sc]e", keys))
            if "V" in name:  # "name license, version n" stands for itself
                rows.append((label, sure, name.replace("V", r"licen[sc]e,? (?:\(?(?:version|ver\.?|v\.?) ?)?"), keys))
            rows.append((label, sure, rf"(?:under|licen[sc]ed?:?|terms of) (?:the )?(?:{name})", keys))
        tag = re.escape(label)
        rows.append((label, TAG, rf"spdx-license-identifier: ?{tag}(?:-only|-or-later)?", ("spdx-license",)))
        rows.append((label, TAG, rf"license[\"']?[:=] ?[\"']{tag}[\"']", (label,)))
        rows.append((label, TAG, rf"(?:opensource\.org/licenses?|spdx\.org/licenses|choosealicense\.com/licenses)/{tag}(?:\.html|\.php)?", (label,)))
    for line in (PHRASES.strip() + "\n" + SENTENCES.strip()).splitlines():
        label, pattern, key = (x.strip() for x in line.split(" | "))
        rows.append((label, PHRASE, pattern, (key,)))
    out = []
    for n, (label, priority, pattern, keys) in enumerate(rows):
        # A blank of a keyword may be other white space in a text: its longest word is looked for.
        words = tuple(dict.fromkeys(max(key.split(), key=len).encode() for key in keys))
        out.append(Rule(n, label, priority, _compile(pattern), words))
    return out


_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[0x41:0x5B] += 0x20


class Scanner:
    def __init__(self) -> None:
        self.rules = rules()
        self.automaton = ahocorasick.Automaton()
        gate: dict[str, list[int]] = {}
        for r in self.rules:
            for k in r.keywords:
                gate.setdefault(k.decode("latin-1"), []).append(r.number)
        for k, numbers in gate.items():
            self.automaton.add_word(k, tuple(numbers))
        self.automaton.make_automaton()
        self.base = [(label, re.compile(rb"(?<![0-9a-z\x80-\xff])" + rb"[^0-9a-z\x80-\xff]+".join(re.escape(w.encode()) for w in phrase.split()) + rb"(?![0-9a-z\x80-\xff])")) for phrase, label in BASE.items()]

    def detections(self, low: bytes) -> list[tuple[int, int, Rule]]:
        """(first byte, end, rule) of what holds after suppression, in order of place."""
        live = {n for _, numbers in self.automaton.iter(low.decode("latin-1")) for n in numbers}
        found = [(m.start(), m.end(), r) for n in sorted(live) for r in (self.rules[n],) for m in r.pattern.finditer(low)]
        found.sort(key=lambda x: (-x[2].priority, x[0] - x[1], x[0], x[2].number))
        kept: list[tuple[int, int, Rule]] = []
        starts = sorted({a for a, _, _ in found})
        reach = [0] * (len(starts) + 1)  # prefix maxima (a Fenwick tree) of the ends of kept detections, by start
        for s, e, r in found:
            at = bisect_left(starts, s) + 1
            k, furthest = at, 0
            while k:
                furthest = max(furthest, reach[k])
                k &= k - 1
            if furthest < e:
                kept.append((s, e, r))
                while at <= len(starts):
                    reach[at] = max(reach[at], e)
                    at += at & -at
        return sorted(kept, key=lambda x: (x[0], x[1], x[2].number))

    def places(self, low: bytes) -> list[tuple[int, str]]:
        """(first byte, label) of all places of the base phrases."""
        return [(m.start(), label) for label, p in self.base for m in p.finditer(low)] if b"license" in low else []


_scanner: Scanner | None = None


def scanner() -> Scanner:
    global _scanner
    _scanner = _scanner or Scanner()
    return _scanner


DETECTION = [("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("rule", pa.int32()), ("priority", pa.int32())]


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs' columns but the text, with n_words, n_base, first_word, last_word, base_labels, labels, score
    and detections (label, byte offsets, rule, priority).

    Words are runs of digits, small letters and non-ASCII characters of the lower-cased (A-Z) text. The
    whole text is scanned; a null text is empty: no words, no labels, score 0. score: the confidence of the
    surest detection. Columns of docs with those names are renamed input_<name>.
    """
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    docs = kept_apart(docs, names, text_col)
    keep = [c for c in docs.columns if c != text_col]
    own, whole_text = [F.col(f"`{c}`") for c in keep], fresh([*keep, *names], "whole_text")[0]
    kinds = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,start:long,end:long,rule:int,priority:int>>"
    schema = with_fields(docs.select(*own).schema, kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner()
        for b in text_slices(batches, whole_text):
            texts = raw_texts(b.column(whole_text))
            whole = b"\0".join(texts) + b"\0"
            word = _WORD_BYTE[_LOW[np.frombuffer(whole, np.uint8)]]
            starts = np.flatnonzero(word & ~np.concatenate(([False], word[:-1])))
            ends = np.cumsum([len(t) + 1 for t in texts])
            before = np.concatenate(([0], np.searchsorted(starts, ends)))
            out = []
            for i, t in enumerate(texts):
                low = t.lower()
                place, found = s.places(low), s.detections(low)
                at = [int(np.searchsorted(starts, x + ends[i] - len(t) - 1) - before[i]) for x, _ in place]
                base = {x for _, x in place}
                sure = max([CONFIDENCE[r.priority] for _, _, r in found] + [CONFIDENCE[FAMILY]] * bool(base), default=0.0)
                out.append((len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {r.label for _, _, r in found})), sure, [{"label": r.label, "start": a, "end": z, "rule": r.number, "priority": r.priority} for a, z, r in found]))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct(DETECTION))]
            cols = [*(b.column(c) for c in keep), pa.array(np.diff(before)), *(pa.array(list(x), k) for x, k in zip(zip(*out), types))]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select(*own, F.col(text_col).alias(whole_text)).mapInArrow(run, schema)

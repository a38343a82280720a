"""Texts of licenses, each with its label: what a scan says of them."""

import pytest

from cairnspark.llm import license_texts, licenses

TEXTS = [
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies'),
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice appears. OR PROFITS, WHETHER IN AN ACTION OF CONTRACT"),
    ("bsd-3-clause", " * Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("apache-2.0", '1. Definitions.\n\n"License" shall mean the terms and conditions for use, reproduction,\nand distribution as defined by Sections 1 through 9'),
    ("gpl-2.0", "# GNU GENERAL PUBLIC LICENSE\n#    Version 2, June 1991"),
    ("gpl-3.0", 'No covered work shall be deemed part of an effective technological measure under any applicable law'),
    ("lgpl-2.1", "We call this license the \"Lesser\" General Public License because it does Less to protect the user's freedom"),
    ("agpl-3.0", "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it"),
    ("bsl-1.0", "unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor"),
    ("unlicense", "This is free and unencumbered software released into the public domain. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest"),
    ("cc0-1.0", "Affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives, abandons"),
    ("ofl-1.1", "No Modified Version of the Font Software may use the Reserved Font Name(s)"),
    ("perl-5", "This is free software; you can redistribute it under the same terms as Perl itself."),
    ("python-2.0", "By copying, installing or otherwise using Python, Licensee agrees to be bound by the terms"),
    ("lppl", "This work may be distributed and/or modified under the\nconditions of the LaTeX Project Public License"),
    ("tcl", "The authors hereby grant permission to use, copy, modify, distribute,\nand license this software and its documentation"),
    ("beerware", "As long as you retain this notice you can do whatever you want with this stuff."),
    ("sspl-1.0", "If you are making the functionality of the Program or modified version available to third parties as a service"),
    ("busl-1.1", "Change Date: 2027-01-01\n\nChange License: Apache License, Version 2.0"),
    ("polyform-noncommercial-1.0.0", "Any noncommercial purpose is a permitted purpose."),
    ("ijg", "this software is based in part on the work of the Independent JPEG Group"),
    ("eupl-1.2", "Licensed under the EUPL, Version 1.2 or later"),
    ("cdla-permissive-2.0", "Community Data License Agreement - Permissive - Version 2.0"),
    ("proprietary", "The software is licensed, not sold. You may not reverse engineer, decompile or disassemble it."),
]


@pytest.mark.parametrize("label, text", TEXTS)
def test_texts_have_their_labels(label, text):
    assert label in {r.label for _, _, r in licenses.scanner().detections(text.lower().encode())}


@pytest.mark.parametrize("text", ["The committee met to discuss the new harbour and the licence of the old ferry.", "A perl of dew, a python in the zoo and a ruby ring.", "They sold the house and granted the wish without a fee or any condition."])
def test_plain_texts_have_none(text):
    assert not licenses.scanner().detections(text.lower().encode())


def test_patterns_are_written_by_hand_and_distinct():
    lines = [x.split(" | ") for x in (licenses.PHRASES.strip() + "\n" + license_texts.SENTENCES.strip()).splitlines()]
    assert all(len(x) == 3 for x in lines) and len({(a, b) for a, b, _ in lines}) == len(lines) >= 300 and len({a for a, _, _ in lines}) > 110

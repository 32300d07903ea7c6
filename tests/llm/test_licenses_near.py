"""Licenses whose templates differ in a version or a clause, short names and SPDX lines."""

import itertools

import pytest

from tidemark.llm import licenses

INDEX = licenses.Index(licenses.alternatives(licenses.TEMPLATES))


def family(name):
    for end in ("-name", "-text", "-notice", "-short", "-spdx"):
        name = name.removesuffix(end)
    return name.removesuffix("-only").removesuffix("-or-later")


def found(text):
    return [(family(m[0]), m[1]) for m in licenses.scan_text(text, INDEX)]


@pytest.mark.parametrize("name, text", licenses.alternatives(licenses.TEMPLATES))
def test_each_template_is_itself_and_no_other(name, text):
    got = found(f"Some code of ours. {text} And more text of ours.")
    assert got and {n for n, _ in got} == {family(name)} and got[0][1] == 1.0


def test_near_templates_keep_apart():
    short = [(n, t) for n, t in licenses.alternatives(licenses.TEMPLATES) if len(licenses.WORD.findall(t)) < licenses.EVERY]
    for (a, x), (b, y) in itertools.combinations(short, 2):
        if family(a) != family(b):
            assert {n for n, _ in found(f"{x} Words between them stand here. {y}")} == {family(a), family(b)}, (a, b)


@pytest.mark.parametrize("text, want", [
    ("This work is licensed under the GNU General Public License, version 2.", {"GPL-2.0"}),
    ("Licensed under CC BY-ND 4.0.", {"CC-BY-ND-4.0"}),
    ("Licensed under CC BY-NC-SA 4.0.", {"CC-BY-NC-SA-4.0"}),
    ("Licensed under CC BY 3.0.", set()),
    ("Released under the BSD License.", {"BSD"}),
    ("Released under the Foo License.", set()),
    ("Released under the really very MIT License.", set()),
    ("// SPDX-License-Identifier: MIT", {"MIT"}),
    ("# SPDX-License-Identifier: LGPL-3.0-only", {"LGPL-3.0"}),
    ("Code is under GNU GPL v3 or later.", {"GPL-3.0"}),
    ("GNU Lesser General Public License version 3", {"LGPL-3.0"}),
    ("GNU Affero General Public License version 3", {"AGPL-3.0"}),
    ("MIT License\n\nCopyright (c) 2020", {"MIT"}),
    ("He studied at MIT and got his license there.", set()),
])
def test_names(text, want):
    assert {n for n, _ in found(text)} == want


def test_edited_long_text_is_still_found():
    text = licenses.TEMPLATES["MIT-text"].replace("without restriction", "with no restriction").replace("Software", "Program", 2)
    assert [n for n, _ in found(text)] == ["MIT"]
    gpl = licenses.TEMPLATES["GPL-3.0-notice"].replace("version 3", "version 2")
    assert {n for n, c in found(gpl) if c > 0.9} == {"GPL-2.0"}

import time
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideglass.llm import licences as L
from tideglass.llm.common import hash_words

SMALL = {"A": ["alpha beta gamma delta epsilon of the end"], "B": ["one two three four five six seven eight nine ten eleven"]}


def brute(text, templates, least=L.LEAST):
    """Names with any passage of bigrams, of any size, at least that like."""
    keys = L.bigrams(hash_words([L.words_of(text)])[0]).tolist() if len(L.words_of(text)) > 1 else []
    out = set()
    for name, texts in templates.items():
        for t in texts:
            bag = Counter(L.bigrams(hash_words([L.words_of(t)])[0]).tolist())
            for i in range(len(keys)):
                for j in range(i + 1, min(len(keys), i + 3 * bag.total()) + 1):
                    if L.dice(Counter(keys[i:j]), bag) >= least - 1e-12:
                        out.add(name)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("alpha beta gamma delta epsilon of the end one two three four five six seven eight nine ten eleven x".split()), max_size=30))
def test_nothing_is_pruned_that_matches(words):
    text = " ".join(words)
    assert {m[0] for m in L.Scanner(SMALL).scan([text])[0]} <= brute(text, SMALL)
    # a match may give way only to a better one that overlaps it
    assert bool(L.Scanner(SMALL).scan([text])[0]) == bool(brute(text, SMALL))


@pytest.mark.parametrize("name", sorted(L.TEMPLATES))
def test_every_notice_is_found_inside_other_text(name):
    s = L.Scanner()
    for text in L.TEMPLATES[name]:
        got = s.scan(["of the before it " * 30 + "\n" + text.upper() + "\nafter of the"])[0]
        assert [m[0] for m in got] == [name] and got[0][1] == 1.0


def test_changed_notices():
    s = L.Scanner()
    mit = L.TEMPLATES["MIT"][1]
    assert [m[0] for m in s.scan([mit.replace("hereby", "now").replace("sublicense", "license")])[0]] == ["MIT"]
    assert s.scan(["the license of the house is under the table", "", "permission", "of the of the"]) == [[], [], [], []]
    two = s.scan([L.TEMPLATES["MIT"][0] + " and " + L.TEMPLATES["Apache-2.0"][0]])[0]
    assert [m[0] for m in two] == ["MIT", "Apache-2.0"]


def test_query(docs, texts, edge, empty):
    found = {r.doc_id: sorted({m.license for m in r.matches}) for r in L.scan(docs).collect()}
    assert set(found) == set(texts)
    lines = {t[0]: n for n, t in L.TEMPLATES.items()}
    for i, t in texts.items():
        assert {n for line, n in lines.items() if line in t} <= set(found[i])
    assert all(r.matches == [] for r in L.scan(edge).collect()) and L.scan(edge).count() == edge.count()
    assert L.scan(empty).collect() == []


def test_siblings_are_told_apart():
    s = L.Scanner()
    gpl3, gpl2 = L.TEMPLATES["GPL-3.0-or-later"][0], L.TEMPLATES["GPL-2.0-or-later"][0]
    named = lambda text: [m[0] for m in s.scan(["x y z " + text + " x y z"])[0]]
    assert named(gpl3) == ["GPL-3.0-or-later"] and named(gpl2) == ["GPL-2.0-or-later"]
    assert named(gpl3.replace("General", "Affero General")) == ["AGPL-3.0-or-later"]
    assert named(gpl3.replace("General", "Lesser General").replace("program", "library")) == ["LGPL-3.0-or-later"]
    assert named(gpl2.replace("General", "Lesser General").replace("version 2", "version 2.1").replace("program", "library")) == ["LGPL-2.1-or-later"]
    two = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    three = " 3. Neither the name of Some Firm Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    end = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES'
    assert named(two + end) == named(two) == ["BSD-2-Clause"]
    assert named(two + three + end) == ["BSD-3-Clause"]


BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS"

#: Notices that lie near a template of another licence, and what they are (None: nothing here names them).
NEAR = [
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "LGPL-3.0-or-later"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "AGPL-3.0-or-later"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA-4.0"),
    ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"),
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "CC-BY-ND-4.0"),
    ("Licensed under CC BY 3.0.", "CC-BY-3.0"),
    ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.", "CC-BY-3.0"),
    ("Licensed under CC BY 1.0.", None),
    ("Licensed under the Apache Software License, Version 1.1.", "Apache-1.1"),
    ("Licensed under the Apache License, Version 1.1.", "Apache-1.1"),
    ("This work is not licensed under the GNU General Public License, version 3.", None),
    ("The work is never licensed under the GNU General Public License, version 2.", None),
    ("This work is licensed under the GNU Library General Public License, version 2.", None),
    (BSD_2, "BSD-2-Clause"),
]


@pytest.mark.parametrize(("text", "name"), NEAR)
def test_neighbouring_licences(text, name):
    assert [m[0] for m in L.Scanner().scan(["x y z. " + text + " x y z"])[0]] == ([name] if name else [])


def test_many_notices_in_one_text():
    s = L.Scanner()
    s.scan(["warm"])
    began = time.perf_counter()
    got = s.scan([("x " + L.TEMPLATES["MIT"][1] + " y\n") * 40])[0]
    assert time.perf_counter() - began < 0.5
    assert [m[:2] for m in got] == [("MIT", 1.0)] * 40


def test_runner_up_is_told():
    got = L.Scanner({"A": ["one two three four five six seven eight"], "B": ["one two three four five six seven nine"]}).scan(["one two three four five six seven nine"])[0]
    assert [(m[0], m[4]) for m in got] == [("B", "A")] and got[0][5] < got[0][1] == 1.0

import re

import duckdb

from numera.llm import licenses
from numera.llm.license_texts import BODIES, TEMPLATES

BODY = dict(BODIES)
MIT = next(t for n, t in TEMPLATES if n == "MIT" and len(t) > 500)


def words_of(text):
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def bigrams(words):
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


WHOLE, GRAMS, _ = licenses._template_rows(TEMPLATES, licenses.LEAST)
PROBES = {}
for bigram, i, offset, probe in GRAMS:
    if probe:
        PROBES.setdefault(i, {})[bigram] = offset
SEQUENCES = [bigrams(words_of(t)) for _, t in TEMPLATES]


def brute(text):
    """All windows of every template that a probe lays, compared one by one; of those that overlap the best."""
    own = bigrams(words_of(text or ""))
    spans = set()
    for i, (name, _) in enumerate(TEMPLATES):
        template, length = set(SEQUENCES[i]), len(SEQUENCES[i])
        for start in {pos - PROBES[i][g] for pos, g in enumerate(own) if g in PROBES[i]}:
            inside = [p for p in range(max(0, start), min(len(own), start + length)) if own[p] in template]
            first, last = inside[0], inside[-1]
            window = set(own[first : last + 1])
            dice = 2 * len(window & template) / (len(window) + len(template))
            if dice >= licenses.LEAST:
                spans.add((len(window & template), dice, -i, -first, -last))
    peaks = [s for s in spans if not any(o > s and o[2] == s[2] and -o[3] <= -s[4] + 1 and -o[4] + 1 >= -s[3] for o in spans)]
    kept = [s for s in peaks if not any(o > s and -o[3] <= -s[4] + 1 and -o[4] + 1 >= -s[3] for o in peaks)]
    return [(s[1], TEMPLATES[-s[2]][0]) for s in kept]


PROSE = "the river runs past old mills and the road follows it to the sea " * 12
ROWS = [
    (1, None), (2, ""), (3, "Plain words. All is well."), (4, "Some prose.\nReleased under the MIT License.\nMore of it. All rights reserved. End"),
    (5, "LICENSED*** under&&& CC### BY-NC$$$ 4.0."), (6, MIT), (7, MIT.replace(". ", ".\n")), (8, "Intro\n\n" + MIT.replace(", ", ",\n") + "\n\nOutro"),
    (9, MIT.replace("Software", "Program").replace("COPYRIGHT HOLDERS", "OWNERS")), (10, "This work is licensed under the GNU General Public License, version 2."),
    (11, "Licensed under the Apache License, Version 3.1."), (12, "license " * 3000), (13, "Licensed under CC BY-SA 4.0."), (None, "All rights reserved."), (4, "Some prose.\nReleased under the MIT License.\nMore of it. All rights reserved. End"),
    (14, "Releasd under the MIT License."), (15, "all rights reserved all rights reserved"),
    (20, PROSE + MIT + " " + PROSE), (21, PROSE + "\n\n" + MIT.replace(". ", ".\n\n") + "\n\n" + PROSE), (22, "".join(f"# {line}\n" for line in MIT.split(", ")) + PROSE),
    (23, "The tools are released under the MIT License and documented well."), (24, BODY["BSD-3-Clause"]), (25, PROSE + BODY["Apache-2.0"] + PROSE + BODY["GPL-3.0"]),
    (26, BODY["MPL-2.0"][:-400]), (27, PROSE + " This program is free software; you can redistribute it and/or\nmodify it under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or (at your option) any later version. " + PROSE),
    (28, (BODY["BSD-2-Clause"] + PROSE) * 30),
]


def test_scan_against_all_pairs(docs_of):
    got = sorted([(r.doc_id, r.n_matches, r.license, None if r.dice is None else round(r.dice, 9), r.licenses) for r in licenses.scan(docs_of(ROWS)).collect()], key=repr)
    want = []
    for d, t in ROWS:
        best = brute(t)
        top = min(((-dice, name) for dice, name in best), default=(None, None))
        want.append((d, len(best), top[1], None if top[0] is None else round(-top[0], 9), " ".join(sorted({name for _, name in best}))))
    assert got == sorted(want, key=repr)
    by_id = {g[0]: g for g in got}
    assert by_id[4][4] == "LicenseRef-all-rights-reserved MIT"
    for d, name in ((5, "CC-BY-NC-4.0"), (6, "MIT"), (8, "MIT"), (9, "MIT"), (10, "GPL-2.0-only"), (12, None), (20, "MIT"), (21, "MIT"), (22, "MIT"), (23, "MIT"), (24, "BSD-3-Clause"), (26, "MPL-2.0"), (27, "GPL-2.0-or-later"), (28, "BSD-2-Clause")):
        assert by_id[d][2] == name, d
    assert by_id[25][1] == 2 and by_id[25][4] == "Apache-2.0 GPL-3.0" and by_id[28][1] == 30


def test_every_template_finds_itself_by_its_probes():
    sets = [licenses.template_bigrams(t) for _, t in TEMPLATES]
    assert len(sets) > 40
    telling = licenses.telling_words(sets, licenses.LEAST)
    for b in sets:
        assert len(licenses.probes(b, telling, licenses.LEAST)) == licenses._spare(b, licenses.LEAST) + 1


def test_the_plan_is_native(docs_of):
    plan = licenses.scan(docs_of(ROWS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty(docs_of):
    assert licenses.scan(docs_of([])).count() == 0


def test_sql(docs_of):
    con = duckdb.connect()
    con.sql("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [r for r in ROWS if r[0] not in (None, 4)])
    want = {r[0]: (r[1], r[2], r[4]) for r in con.sql(licenses.oracle_sql()).fetchall()}
    got = {r.doc_id: (r.n_matches, r.license, r.licenses) for r in licenses.scan(docs_of(ROWS)).collect()}
    assert {d: got[d] for d in want} == want

import textwrap

from cooframe.llm import licenses, queries

from .helpers import AWKWARD, docs

SF = "/root/testdata/sf0.01"


def test_every_template_finds_itself_in_prose(spark):
    rows = [(i, f"Some words before. And more.\n{t}\nAnd after it nothing.") for i, t in enumerate(licenses.TEMPLATES.values())]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, rows)).collect()}
    for i, (name, t) in enumerate(licenses.TEMPLATES.items()):
        assert licenses._FORM.sub("", name) in got[i].licenses, (name, got[i])
        assert any(rows[i][1][s.first : s.end].strip() in t or t in rows[i][1][s.first : s.end] for s in got[i].spans)


def test_small_changes_pass_and_other_licences_do_not(spark):
    rows = [(1, "released under the MIT license"), (2, "Licensed under the Apache License, version 2.0"), (3, "Licensed under CC BY-NC-ND 4.0."), (4, "This work is licensed under the GNU General Public License, version 2."), (5, "Drivers need a license to drive in this county."), (6, "The public domain is large and wide."), (7, "Copyright 2020 the authors")]
    got = {r.doc_id: r.licenses for r in licenses.scan(docs(spark, rows)).collect()}
    assert got == {1: ["MIT"], 2: ["Apache-2.0"], 3: ["CC-BY-NC-ND-4.0"], 4: ["GPL-2.0"], 5: [], 6: [], 7: []}


def test_whole_table_against_plain_search(spark):
    plain = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "GPL-3.0": "GNU General Public License, version 3.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "all-rights-reserved": "All rights reserved."}
    text = {r.doc_id: r.text for r in queries.documents(spark, SF).collect()}
    got = {r.doc_id: r.licenses for r in licenses.scan(queries.documents(spark, SF)).collect()}
    for i, t in text.items():
        assert got[i] == sorted(k for k, x in plain.items() if x.lower() in t.lower()), (i, got[i])


def test_awkward_rows(spark):
    rows = AWKWARD + [(20, "x" * 100_000 + " Released under the MIT License. " + "y" * 100_000, "en", "a")]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, rows)).collect()}
    assert got[20].licenses == ["MIT"] and all(r.licenses == [] for i, r in got.items() if i != 20)
    assert licenses.scan(docs(spark, [])).collect() == []


def test_notices_in_long_sentences_and_several_in_one(spark):
    prose = "the harbour was quiet that morning while seven fishermen mended old nets near a crooked pier and talked about storms, prices of bread, distant cousins and a lighthouse that nobody had painted since"
    rows = [(i, f"{prose} {t.rstrip('.')} {prose}") for i, t in enumerate(licenses.TEMPLATES.values())]
    rows += [(1000, f"{prose} released under the mit license"), (1001, f"{prose} it is released under the MIT License, or released under the ISC License, and licensed under CC BY 4.0, all rights reserved, {prose}"), (1002, f"{prose} a license to drive and the public domain {prose}")]
    got = {r.doc_id: r.licenses for r in licenses.scan(docs(spark, rows)).collect()}
    for i, name in enumerate(licenses.TEMPLATES):
        assert got[i] == [licenses._FORM.sub("", name)], (name, got[i])
    assert (got[1000], got[1001], got[1002]) == (["MIT"], ["CC-BY-4.0", "ISC", "MIT", "all-rights-reserved"], [])


def test_wrapped_notices_in_comments(spark):
    rows, names = [], {}
    for name, t in licenses.TEMPLATES.items():
        for width in range(60, 81):
            for mark in ("", "# ", " * ", "// ", "dnl ", "C "):
                lines = textwrap.wrap(f"Copyright (c) 2020 The authors of a small library. {t} And so on, as usual.", width)
                names[len(rows)] = name
                rows.append((len(rows), f"{mark}A heading\n{mark.rstrip()}\n" + "\n".join(mark + x for x in lines) + "\n\nint main;\n"))
    rows += [(-1, "# Redistri-\n# bution and use in source and binary\r\n# forms, with or without modification, are permitted provided that the\r\n# following conditions are met:"), (-2, "Copyright. All rights\n\nreserved by nobody"), (-3, "// All rights\n//\n// reserved, copyright")]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, rows)).collect()}
    for i, name in names.items():
        assert got[i].licenses == [licenses._FORM.sub("", name)], (rows[i], got[i])
    assert all(rows[i][1][s.first : s.end].split()[0] in licenses.TEMPLATES[s.license] for i in names for s in got[i].spans)
    assert (got[-1].licenses, got[-2].licenses, got[-3].licenses) == (["BSD"], [], [])


def test_usual_file_notices(spark):
    notice = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    rows = [(1, notice), (2, "// SPDX-License-Identifier: MIT\nint main() {}"), (3, "# SPDX-License-Identifier: GPL-2.0-or-later\n\nx = 1"), (4, "This is free and unencumbered software released into the public\ndomain.")]
    got = {r.doc_id: r.licenses for r in licenses.scan(docs(spark, rows)).collect()}
    assert got == {1: ["GPL-3.0"], 2: ["MIT"], 3: ["GPL-2.0-or-later"], 4: ["Unlicense"]}


def test_blocks_are_compressed_with_every_template_and_the_best_has_the_words(spark):
    scanner, prose = licenses.Scanner(), licenses.words("the harbour was quiet that morning while seven fishermen mended old nets near a crooked pier")
    for name, own in scanner.words.items():
        best = scanner.ranked([*prose, *own, *prose], scanner.names)[0]
        assert licenses._FORM.sub("", best) == licenses._FORM.sub("", name), (name, best)
    rows = [(1, "Drivers need a license. They studied under the MIT professor of physics."), (2, "This is licensed under the MIT and that is under the ISC license."), (3, licenses.TEMPLATES["Apache-2.0-text"]), (4, "quiet nets " * 400 + "released under the MIT license " + "old pier " * 400)]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, rows)).collect()}
    assert [got[i].licenses for i in (1, 2, 3, 4)] == [[], ["ISC", "MIT"], ["Apache-2.0"], ["MIT"]]
    assert [s.license for s in got[3].spans] == ["Apache-2.0-text"]


def test_ranking_leaves_out_no_template_that_words_confirm():
    ranked, every = licenses.Scanner(), licenses.Scanner()
    every.ranked = lambda own, names: names
    prose = licenses.words("the harbour was quiet that morning while seven fishermen mended old nets near a crooked pier and talked about storms and prices of bread")
    for own in ranked.words.values():
        for k in range(len(own)):
            block = prose * (k % 4) + own[:k] + prose[k % 5 : k % 5 + 1] + own[k + 1 :] + prose * (k % 3)
            assert ranked.block(block) == every.block(block), block

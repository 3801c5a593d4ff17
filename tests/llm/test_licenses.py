from lotlens.llm import licenses as x


def test_every_template_is_found(spark, no_docs):
    rows, want = [(1, None), (2, ""), (3, "license " * 300)], set()
    filler = "erre thon ingor stea " * 40
    for k, (name, (text, _)) in enumerate(x.TEMPLATES.items()):
        rows.append((100 + k, f"{filler}\n{text.upper() if k % 2 else text}\n{filler}"))
        want.add((100 + k, name, 160, len(text.split()), 0))
    rows.append((50, "Released under the MIT License.\nwords\nLicensed under CC BY-NC 4.0."))
    want |= {(50, "MIT", 0, 5, 0), (50, "CC-BY-NC-4.0", 6, 5, 0)}
    rows.append((51, "This work is licensed under the terms of the GNU General Public License, version 3, or later"))
    want.add((51, "GPL-3.0", 0, 15, 0))
    got = {(r.doc_id, r.license, r.start, r.words, r.n_missing) for r in x.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    assert x.license_scan(no_docs).count() == 0


def test_other_wording_is_not(spark):
    rows = [(1, "A driving license is issued under the law of the land, version of 1998."), (2, "Licensed under CC BY-XX 4.0."), (3, "You need permission to use this."), (4, "the GNU General Public License"), (5, "Copyright 2020 Someone")]
    assert x.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect() == []


def test_whole_texts_with_edits(spark):
    """A share of a license's words left out or put in, up to what is allowed, against a scan of every window by difflib."""
    import difflib
    import random

    rng = random.Random(4)
    words = [w.strip('(),.;:"') for w in x.MIT.split()]
    filler = "erre thon ingor stea " * 30
    rows, want = [], {}
    for k, (out, more) in enumerate([(0, 0), (3, 0), (0, 8), (8, 10), (14, 20), (30, 0), (0, 80), (80, 0)]):
        gone = set(rng.sample(range(len(words)), out))
        own = [w for j, w in enumerate(words) if j not in gone]
        for _ in range(more):
            own.insert(rng.randrange(1, len(own)), "strange")
        rows.append((k, f"{filler} {' '.join(own)} {filler}"))
        lower = [w.lower() for w in words]
        # Every window: the whole text, since nothing of the filler is in the license.
        runs = [m for m in difflib.SequenceMatcher(None, lower, [w.lower() for w in own], autojunk=False).get_matching_blocks() if m.size]
        n = sum(m.size for m in runs)
        strange = runs[-1].b + runs[-1].size - runs[0].b - n
        want[k] = len(words) - n <= 0.1 * len(words) and strange <= 0.25 * len(words)
    got = {r.doc_id: (r.license, r.n_missing, r.n_strange) for r in x.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.license == "MIT-text"}
    assert set(got) == {k for k, yes in want.items() if yes} and {0, 1, 2, 3} <= set(got) and not {5, 6, 7} & set(got)
    assert got[0] == ("MIT-text", 0, 0)


def test_variants_and_strays(spark):
    rows = [(1, "Licensed under the MIT License"), (2, "Apache License, Version 2.0"), (3, "under CC BY 4.0 by me"), (4, "license " * 40 + "and then far away " * 20 + x.ISC.replace("software", "program", 1) + " granted " + "erre " * 50 + "license")]
    got = {r.doc_id: r.license for r in x.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "MIT-licensed", 2: "Apache-2.0-name", 3: "CC-BY-4.0-name", 4: "ISC"}


def test_own_templates_and_odd_inputs(spark, odd_docs):
    assert x.license_scan(odd_docs).columns == [c.split()[0] for c in x.FINDING.split(", ")] and x.license_scan(odd_docs).count() == 0
    own = {"house": ("Only members of the house may read this letter aloud", "house members")}
    docs = spark.createDataFrame([(None, "Only members of the house may read this letter aloud"), (None, "Only members of the house may read this letter aloud"), (1, None)], "doc_id long, text string")
    assert [(r.doc_id, r.license, r.words) for r in x.license_scan(docs, own).collect()] == [(None, "house", 10)] * 2


def test_bytes_saved_choose_the_winner():
    """Of the templates whose wording is confirmed, the one that saves most bytes wins, told by zstandard and difflib alone."""
    import difflib

    import zstandard

    own = x.Scanner(x.TEMPLATES)
    plain = zstandard.ZstdCompressor(level=x.LEVEL, write_content_size=False)
    contested = 0
    for text, _ in x.TEMPLATES.values():
        words = [w for t in text.lower().split() if (w := x._EDGE.sub("", t))]
        raw, told = " ".join(words).encode(), []
        for name, (template, keys) in x.TEMPLATES.items():
            t = [w for y in template.lower().split() if (w := x._EDGE.sub("", y))]
            by = zstandard.ZstdCompressor(level=x.LEVEL, write_content_size=False, write_dict_id=False, dict_data=zstandard.ZstdCompressionDict(" ".join(t).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            runs = [m for m in difflib.SequenceMatcher(None, t, words, autojunk=False).get_matching_blocks() if m.size]
            n = sum(m.size for m in runs)
            strange = runs[-1].b + runs[-1].size - runs[0].b - n if runs else 0
            if n >= (1 - x.MISSING) * len(t) and strange <= x.STRANGE * len(t) and set(keys.split()) <= {t[m.a + k] for m in runs for k in range(m.size)}:
                told.append((len(plain.compress(raw)) - len(by.compress(raw)), name))
        contested += len(told) > 1
        most = max(told)[0]
        found = own.scan(text)
        assert max(found, key=lambda f: f[2])[0] in {name for saved, name in told if saved == most}
    assert contested >= 5
    # The wordings of both are within the allowances; the ranking alone tells them apart.
    lesser = "This work is licensed under the GNU Lesser General Public License, version 3."
    assert [f[0] for f in own.scan(lesser)] == ["LGPL-3.0"]
    own.ranking = lambda block, ranked=own.ranking: ranked(block)[::-1]
    assert [f[0] for f in own.scan(lesser)] == ["GPL-3.0"]


def test_long_lists_of_notices():
    """Notices that follow each other form one block: it is ranked as a whole, and its time grows with its length."""
    import time

    own = x.Scanner(x.TEMPLATES)
    began = time.time()
    found = own.scan("Licensed under the MIT License. Licensed under CC BY 4.0. Apache License, Version 2.0\n" * 20_000)
    assert time.time() - began < 60
    assert len(found) == 60_000 and [f[:3] for f in found[:3]] == [("MIT-licensed", 0, 5), ("CC-BY-4.0", 5, 5), ("Apache-2.0-name", 10, 4)]

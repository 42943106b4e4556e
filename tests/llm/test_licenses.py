import collections
import random

from cases import docs, empty

from tidemark.llm import licenses


def test_every_template_wins():
    for k, v in licenses.TEMPLATES.items():
        for text in (v, v.upper(), v.rstrip("."), f"filler {'words ' * 200}. {v} {'more ' * 100}"):
            ((_, block),) = licenses.blocks(text)
            assert licenses.score(block)[0] == k and licenses.score(block)[-1], (k, block)


def test_wording():
    assert not licenses.score("Released under the ABC License to all who may want to read it.")[-1]
    assert licenses.score("This work is licensed under the GNU General Public License, version 2.")[0] == "GPL-2.0"
    assert list(licenses.blocks("x\n\na license\nb")) == [(3, "a license")]


def test_cases(spark):
    assert licenses.scan(docs(spark)).count() == 0 and licenses.scan(empty(spark)).count() == 0
    rows = [(1, "a\nReleased under the MIT License.\nb", "en", "s")] * 2 + [(None, "Licensed under CC BY-NC 4.0.", None, None), (2, None, "en", "s")]
    got = licenses.scan(docs(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.position, r.license, r.confirmed) for r in got) == {(1, 2, "MIT", True): 2, (None, 0, "CC-BY-NC-4.0", True): 1}


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = collections.Counter((r.doc_id, at, *licenses.score(b)[:1]) for r in rows for at, b in licenses.blocks(r.text) if licenses.score(b)[-1])
    assert collections.Counter((r.doc_id, r.position, r.license) for r in licenses.op3_license_scan(spark, sf).collect()) == want
    lines = collections.Counter((r.doc_id, k) for r in rows for line in (r.text or "").split("\n") for k, v in licenses.TEMPLATES.items() if line == v)
    assert lines == collections.Counter({k: n for k, n in collections.Counter((i, k) for i, _, k in want.elements()).items()}) and len(lines) == 3


def test_other_words_on_the_line():
    def found(text):
        return [x[2] for x in licenses.notices(text) if x[-1]]

    for k, v in licenses.TEMPLATES.items():
        bare = v.rstrip(".")
        for text in (f"Copyright (c) 2024 X. {v}", f"Copyright (c) 2024 X Y {bare}; see the file for more", f"{bare} (the terms);", f"{'word ' * 90}{bare} {'more ' * 90}", f"{'Copyright (c) 2024 X, and so on, ' * 20}{bare} {'more ' * 30}"):
            assert found(text) == [k], (k, text)
    assert found('Licensed under the Apache License, Version 2.0 (the "License");') == ["Apache-2.0"]
    assert found("Released under the MIT License or licensed under CC BY 4.0 at choice") == ["MIT", "CC-BY-4.0"]
    assert found("Released under the ISC License. Released under the MIT License.") == ["ISC", "MIT"]
    assert found("Copyright (c) 2024 X. All rights reserved.") == found("Released under the Y License, like the MIT one.") == []


def test_notices_over_two_lines(spark):
    rows, want = [], []
    for i, (k, v) in enumerate(licenses.TEMPLATES.items()):
        own = v.split()
        for j in range(1, len(own)):
            rows.append((100 * i + j, f"# Some words.\n# {' '.join(own[:j])}\n# {' '.join(own[j:])}\n# More words, and\n# more.", "en", "s"))
            want.append((100 * i + j, k))
        rows.append((100 * i, "Some words.\n" + v + "\nmore words", "en", "s"))
        want.append((100 * i, k))
    rows.append((9999, "Released under the\n\nMIT License.", "en", "s"))
    got = licenses.scan(docs(spark, rows)).where("confirmed").collect()
    assert sorted((r.doc_id, r.license) for r in got) == sorted(want)


def brute_align(template, own):
    """Differing words of the nearest stretch, from all stretches."""
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return row[-1]

    return min(distance(template, own[a:b]) for a in range(len(own) + 1) for b in range(a, len(own) + 1))


def test_alignments_agree():
    r = random.Random(3)
    for _ in range(150):
        template, own = ([r.choice("abcd") for _ in range(r.randint(1, n))] for n in (7, 12))
        one = licenses.align(template, own)
        assert one == licenses.align_long(template, own) and one[0] == brute_align(template, own)


def found(text):
    return [(x[2], x[5]) for x in licenses.both(text) if x[-1]]


def test_license_texts():
    import textwrap

    for k, v in licenses.TEXTS.items():
        wrapped = textwrap.fill(v, 72)
        for text in (v, wrapped, textwrap.indent(wrapped, " * "), f"Copyright (c) 2024 A B\n\n{wrapped.replace('. ', '.' + chr(10) * 2)}\n\nmore text", f"{'word ' * 5000}\n{v}\n{'word ' * 5000}", v.lower()):
            got = found(text)
            assert (k, 0) in got and len(got) == 1, (k, got)
        own = v.split()
        assert found(" ".join(w for i, w in enumerate(own) if i % 25)) in ([(k, d)] for d in range(len(own) // 10 + 1)), k
        assert not list(licenses.texts(" ".join(own[: len(own) * 7 // 10]))) and not [x for x in licenses.texts(" ".join(w if i % 4 else "other" for i, w in enumerate(own)))]
    two = licenses.TEXTS["MIT"] + "\n\n" + licenses.TEXTS["BSD-3-Clause"]
    assert sorted(found(two)) == [("BSD-3-Clause", 0), ("MIT", 0)]
    assert sorted(found(licenses.TEXTS["ISC"] + "\nReleased under the MIT License.")) == [("ISC", 0), ("MIT", 0)]


def test_table_against_templates(spark, sf):
    """Without any of the scan's functions: a row for each line of the table that is a notice, letter for letter, and no other."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = collections.Counter((r.doc_id, k) for r in rows for line in (r.text or "").split("\n") for k, v in licenses.TEMPLATES.items() if line.strip().rstrip(".").lower() == v.rstrip(".").lower())
    assert collections.Counter((r.doc_id, r.license) for r in licenses.op3_license_scan(spark, sf).collect()) == want

import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.licenses import TEMPLATES, Scanner, common_subsequence, patience, scan


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


SEQ = st.lists(st.integers(0, 6), max_size=25)


@settings(max_examples=200, deadline=None)
@given(SEQ, SEQ)
def test_common_subsequence_is_longest(a, b):
    got = common_subsequence(a, b)
    assert len(got) == lcs(a, b)


@settings(max_examples=200, deadline=None)
@given(SEQ, SEQ)
def test_patience_aligns_equal_words_in_order(a, b):
    got = patience(a, b)
    assert all(a[i] == b[j] for i, j in got)
    assert all(x < y and u < v for (x, u), (y, v) in zip(got, got[1:]))
    assert len(got) <= lcs(a, b)


@settings(max_examples=50, deadline=None)
@given(st.permutations(range(12)), st.integers(0, 11))
def test_patience_is_longest_for_distinct_words(a, drop):
    b = [x for k, x in enumerate(sorted(a)) if k != drop]
    assert len(patience(a, b)) == lcs(a, b)


def test_planted_licenses_are_found_and_clean_texts_left(docs_of):
    rng = random.Random(1)
    rows, want = [], set()
    for k, name in enumerate(sorted(TEMPLATES)):
        noise = lambda n: " ".join(rng.choice("the of and in it under by with license lorem".split()) + rng.choice(("", "x", "y")) for _ in range(n))  # noqa: E731, B023
        rows.append((k, f"{noise(50)}\n{TEMPLATES[name].upper()}\n{noise(50)}"))
        want.add((k, name))
        rows.append((100 + k, noise(120)))
    got = [(r.doc_id, r.license, r.coverage) for r in scan(docs_of(rows)).collect()]
    assert {(d, n) for d, n, c in got if c == 1} >= want
    assert all(d < 100 for d, _, _ in got)


def test_changed_words_repeats_and_places(docs_of):
    mit = TEMPLATES["MIT-text"].split()
    del mit[10:16]
    text = "é intro. " + " ".join(mit) + " outro"
    line = "Licensed under the Apache License, Version 2.0"
    rows = scan(docs_of([(1, text), (2, f"{line}\n{line}\n{line}"), (3, "licensed the under apache")])).collect()
    got = {r.doc_id: r for r in rows if r.doc_id != 2}
    assert 0.9 < got[1].coverage < 1 and text[got[1].span_start : got[1].span_end].startswith("Permission")
    n = len(line)
    assert sorted((r.coverage, r.span_start, r.span_end) for r in rows if r.doc_id == 2) == [(1, k * (n + 1), k * (n + 1) + n) for k in range(3)] and 3 not in got


def test_odd_rows_and_empty(odd_docs, docs_of):
    assert scan(odd_docs.selectExpr("*", "1 as license", "2 as t")).count() == 0
    assert scan(docs_of([])).count() == 0
    assert scan(docs_of([(None, "All rights reserved."), (2, "All rights reserved."), (2, "All rights reserved.")])).count() == 3


def test_a_later_license_is_found_after_one_that_contains_it(docs_of):
    sa, by, nc = (f"Licensed under CC {x} 4.0" for x in ("BY-SA", "BY", "BY-NC"))
    text = f"{sa}\nsome words between\n{by}\nand more of them\n{nc}"
    got = {r.license: text[r.span_start : r.span_end] for r in scan(docs_of([(1, text)])).collect()}
    assert got == {"CC-BY-SA-4.0": sa, "CC-BY-4.0": by, "CC-BY-NC-4.0": nc}


def test_near_misses_are_no_other_license(docs_of):
    near = ["released under the same license", "Released under the Apache License", "Licensed under the same License", "Licensed under CC BY 3.0", "Licensed under CC 4.0", "This work is licensed under the GNU General Public License, version 1"]
    good = [(100, "Licensed under the Apache License, Version 2", "Apache-2.0"), (101, "Released under an MIT License", "MIT")]
    got = {(r.doc_id, r.license) for r in scan(docs_of([*enumerate(near), *((k, t) for k, t, _ in good)])).collect()}
    assert got == {(k, n) for k, _, n in good}


def longest(a, b):
    """The length of a longest common subsequence, by the table."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_stretches_are_those_of_brute_force(docs_of):
    rng = random.Random(11)
    templates = {f"T{k}": " ".join(f"t{k}x{j}" for j in range(30)) for k in range(4)}
    rows, want = [], set()
    for d in range(150):
        text = [f"n{rng.randint(0, 99)}" for _ in range(40)]
        for _ in range(rng.randint(0, 3)):
            name = rng.choice(sorted(templates))
            words = templates[name].split()
            copy = [w for w in words if rng.random() > rng.choice((0.02, 0.2, 0.3))]
            if rng.random() < 0.4:
                i, j = sorted(rng.sample(range(len(copy)), 2))
                copy[i], copy[j] = copy[j], copy[i]
            copy = [x for w in copy for x in ([w, "noise"] if rng.random() < 0.1 else [w])]
            if longest(words, copy) >= 24:
                want.add((d, name, longest(words, copy), len(text), len(text) + len(copy)))
            text += copy + [f"n{rng.randint(0, 99)}" for _ in range(50)]
        rows.append((d, " ".join(text)))
    texts, got = dict(rows), set()
    for r in scan(docs_of(rows), templates=templates).collect():
        first = texts[r.doc_id][: r.span_start].count(" ")
        (hit,) = [x for x in want if x[:3] == (r.doc_id, r.license, round(r.coverage * 30)) and x[3] <= first < x[4]]
        assert len(texts[r.doc_id][: r.span_end].split()) <= hit[4]
        got.add(hit)
    assert got == want and len(want) > 50


def test_repeats_full_texts_and_ids_of_text(spark):
    rows = [("doc-1", "x Released under the MIT License. y\nz Released under the MIT License"), ("doc-2", TEMPLATES["MIT-full"]), ("doc-3", TEMPLATES["BSD-3-Clause"]), ("doc-4", TEMPLATES["BSD-2-Clause"]), (None, TEMPLATES["MIT-text"])]
    got = sorted((r.doc_id or "", r.license) for r in scan(spark.createDataFrame(rows, "doc_id string, text string")).collect())
    assert got == [("", "MIT-text"), ("doc-1", "MIT"), ("doc-1", "MIT"), ("doc-2", "MIT-full"), ("doc-3", "BSD-3-Clause"), ("doc-4", "BSD-2-Clause")]


def test_scrambled_license_words_take_linear_time():
    import time

    rng = random.Random(1)
    words = TEMPLATES["MIT-full"].split()
    text = [rng.choice(words) for _ in range(60_000)]
    t = time.time()
    Scanner(TEMPLATES, 0.8).scan(pa.array([" ".join(text)]))
    assert time.time() - t < 60

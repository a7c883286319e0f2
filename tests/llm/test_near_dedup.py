import random

import numpy as np

from tessera.llm.near_dedup import SHINGLE, THRESHOLD, components, deduplicate, near_duplicates, sketch
from tessera.llm.words import mix


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n)]


def brute(rows):
    sets = {}
    for d, t in rows:
        w = (t or "").lower().split()
        if t is not None:
            sets[d] = frozenset(zip(*[w[k:] for k in range(SHINGLE)])) if len(w) >= SHINGLE else frozenset([tuple(w)])
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if len(sets[a] & sets[b]) >= THRESHOLD * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    groups = {}
    for d in ids:
        groups.setdefault(find(d), []).append(d)
    return {(d, min(g)) for g in groups.values() if len(g) > 1 for d in g}


def test_sketch_fills_and_estimates():
    t = 192
    a, b = mix(np.arange(0, 1000)), mix(np.arange(250, 1250))
    s, some = sketch(np.concatenate((a, b, mix(np.arange(1)))), np.repeat([0, 1, 3], [1000, 1000, 1]), 4, t)
    assert some.tolist() == [True, True, False, True]
    full = np.iinfo(np.uint64).max
    assert (s[[0, 1, 3]] != full).all() and (s[2] == full).all()
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.12


def test_groups_are_those_of_brute_force(docs_of):
    rng = random.Random(3)
    rows = []
    for g in range(30):
        base = words(rng, rng.randint(30, 120))
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(int(len(w) * rng.choice((0, 0.02, 0.05)))):
                w[rng.randrange(len(w))] = words(rng, 1)[0]
            rows.append((len(rows), " ".join(w)))
    passage = words(rng, 60)
    rows += [(1000 + k, " ".join(words(rng, 200) + passage + words(rng, 200))) for k in range(20)]
    want = brute(rows)
    got = {(r.doc_id, r.group_id) for r in near_duplicates(docs_of(rows)).collect()}
    assert len(got & want) >= 0.97 * len(want) and not {d for d, _ in got} - {d for d, _ in want}


def test_a_chain_is_one_group(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.n: r.c for r in components(e).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[101] == 100


def test_case_and_punctuation_are_ignored(docs_of):
    got = near_duplicates(docs_of([(3, "A b, c d!"), (1, "a B c d"), (2, "a b c e f g h")])).collect()
    assert sorted((r.doc_id, r.group_id) for r in got) == [(1, 1), (3, 1)]


def test_odd_rows(odd_docs):
    got = sorted((r.doc_id, r.group_id) for r in near_duplicates(odd_docs).collect())
    # Blank texts are copies of one another, other signs without words are not; a repeated row is no group.
    assert got == [(2, 2), (3, 2), (5, 2)]


def test_deduplicate_keeps_one_of_each_group(odd_docs):
    wide = odd_docs.selectExpr("*", "1 as n", "2 as head", "3 as `__node`", "4 as c")
    out = deduplicate(wide)
    assert out.columns == wide.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0, r.text is None) for r in out.collect())
    assert len([x for x in ids if x[2]]) == 2
    assert [x[1] for x in ids if not x[2] and not x[0]] == [2, 4, 4, 6, 7, 8, 9]


def test_texts_without_words_agree_in_their_signs(docs_of):
    got = near_duplicates(docs_of([(1, "***"), (2, "%%%"), (3, " *** "), (4, "***")])).collect()
    assert sorted((r.doc_id, r.group_id, r.n_links) for r in got) == [(1, 1, 0), (3, 1, 0), (4, 1, 0)]


def test_case_of_other_scripts_is_ignored(docs_of):
    got = near_duplicates(docs_of([(1, "Привет МИР как дела"), (2, "привет мир КАК дела"), (3, "ΑΒΓ δ Ωμ"), (4, "αβγ Δ ωΜ"), (5, "Ḁb ｃＤ x"), (6, "ḁB ＣｄX")])).collect()
    assert {(r.doc_id, r.group_id) for r in got} == {(1, 1), (2, 1), (3, 3), (4, 3)}


def test_links_join_different_texts_and_ids_keep_their_type(spark):
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [("a", base), ("b", base + " thirteen"), ("c", base.upper()), ("d", "quite another text without any of these"), (None, base + " fourteen")]
    got = {r.doc_id: (r.group_id, r.n_links) for r in near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert set(got) == {"a", "b", "c", None} and {g for g, _ in got.values()} == {"a"} and got["a"][1] == got["c"][1] >= 1 and all(n >= 1 for _, n in got.values())


def test_a_bucket_is_compared_in_blocks(docs_of, monkeypatch):
    rng = random.Random(5)
    # Two chains of texts that share a passage: the least member is like few of them.
    passage, rows = words(rng, 40), []
    for g in range(12):
        own = words(rng, 60)
        rows += [(10 * g + k, " ".join(passage + own[: 50 + 2 * k])) for k in range(4)]
    monkeypatch.setattr("tessera.llm.near_dedup.BLOCK", 2)
    got = {(r.doc_id, r.group_id) for r in near_duplicates(docs_of(rows)).collect()}
    assert got == brute(rows)


def test_empty(docs_of):
    assert near_duplicates(docs_of([])).count() == 0 and deduplicate(docs_of([])).count() == 0

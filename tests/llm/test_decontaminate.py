import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.decontaminate import PHRASE, FMIndex, Phrases, Wavelet, contaminated, remove_spans, suffix_array


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=60))
def test_index_finds_what_scanning_finds(body):
    seq = np.array([*body, 0], np.int64)
    order = suffix_array(seq)
    assert sorted(order.tolist()) == list(range(len(seq)))
    index = FMIndex(seq, 5, rate=4)
    for n in (1, 2, 3):
        grams = np.array([[a] * n for a in range(1, 5)] + [[1, 2, 3][:n]], np.int64)
        lo, hi = index.search(grams)
        for g, a, b in zip(grams, lo, hi):
            want = [k for k in range(len(seq) - n + 1) if (seq[k : k + n] == g).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=50))
def test_wavelet(seq):
    s = np.array(seq, np.int64)
    w = Wavelet(s, 13)
    assert w.access(np.arange(len(s))).tolist() == seq
    for c in range(13):
        at = np.arange(len(s) + 1)
        assert w.rank(np.full(len(at), c), at).tolist() == [seq[:k].count(c) for k in at]


def words(rng, n):
    return [rng.choice("abcdefg") + rng.choice("hijk") for _ in range(n)]


def brute(rows, items):
    out = {}
    for d, t in rows:
        w = t.lower().split()
        spans = []
        for i, x in items:
            g = x.lower().split()
            n = min(PHRASE, len(g))
            for j in range(len(g) - n + 1):
                spans += [(k, k + n, i) for k in range(len(w) - n + 1) if w[k : k + n] == g[j : j + n]]
        if spans:
            out[d] = spans
    return out


def test_spans_are_those_of_brute_force(spark, docs_of):
    rng = random.Random(4)
    items = [(k, " ".join(words(rng, rng.randint(6, 30)))) for k in range(25)]
    rows = []
    for k in range(120):
        w = words(rng, rng.randint(0, 80))
        if k % 3 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(items)[1].upper().split()
        rows.append((k, " ".join(w)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in contaminated(docs_of(rows), bench).collect():
        got.setdefault(r.doc_id, []).append((r.span_start, r.span_end, r.item_ids))
    want = brute(rows, items)
    assert set(got) == set(want)
    for d, spans in got.items():
        text = dict(rows)[d]
        covered = {k for s, e, _ in spans for k in range(s, e) if text[k] != " "}
        ends, at = [], 0
        for w in text.split():
            ends.append((at, at + len(w)))
            at += len(w) + 1
        assert covered == {k for a, b, _ in want[d] for s, e in ends[a:b] for k in range(s, e)}
        assert {i for _, _, x in spans for i in x} == {i for _, _, i in want[d]}


ITEM = "Why does the brown fox jump over each lazy dog today?"


def test_removal(spark, docs_of):
    bench = spark.createDataFrame([(1, ITEM), (2, "too short"), (None, "a b c d e f"), (3, None)], "item_id long, text string")
    rows = [(1, "Vorwort é. why DOES the brown, fox jump over each lazy dog today And more"), (2, ITEM), (3, "clean text"), (4, f"{ITEM} x {ITEM}")]
    wide = docs_of(rows).selectExpr("*", "1 as `__spans`", "2 as `__cut`")
    out = {r.doc_id: r for r in remove_spans(wide, bench).collect()}
    assert set(out) == {1, 3, 4} and remove_spans(wide, bench).columns == wide.columns
    assert out[1].text == "Vorwort é.  And more" and out[1].n_chars == len(out[1].text) and (out[4].text == " x ?" or out[4].text == "? x ?")
    assert out[3].text == "clean text"


def test_odd_rows_and_empty(spark, odd_docs, docs_of):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert contaminated(odd_docs, bench).count() == 0 and remove_spans(odd_docs, bench).count() == odd_docs.count()
    assert contaminated(docs_of([(1, ITEM), (1, ITEM), (None, ITEM)]), bench).count() == 3
    assert contaminated(docs_of([(1, ITEM)]), bench.limit(0)).count() == 0 and contaminated(docs_of([]), bench).count() == 0
    long = "x " * 50_000 + ITEM
    r = contaminated(docs_of([(1, long)]), bench).collect()[0]
    assert long[r.span_start : r.span_end] == ITEM.rstrip("?")


def test_phrases_of_short_items():
    p = Phrases([([1], "a b c d e"), ([2], "a b"), ([3, None], "a b c d e")], 8)
    assert list(p.by) == [2, 5] and p.by[5][1] == [[1, 3, None]] and p.by[2][1] == [[2]]


def test_short_items_count_as_whole_lines(spark, docs_of):
    bench = spark.createDataFrame([(1, "yes sir"), (None, "one word more than that")], "item_id long, text string")
    rows = [(1, "Yes, sir!"), (2, "he said yes sir"), (3, "a\n yes SIR \nb"), (4, "yes sir\nyes sir"), (5, "so one word more than that it is"), (6, "yes\nsir x")]
    got = {(r.doc_id, r.span_start, tuple(r.item_ids)) for r in contaminated(docs_of(rows), bench).collect()}
    assert {d for d, _, _ in got} == {1, 3, 4, 5} and (5, 3, (None,)) in got and (3, 3, (1,)) in got


def test_parts_of_a_benchmark_give_the_same(spark, docs_of):
    rng = random.Random(9)
    items = [(f"i{k}", " ".join(words(rng, 12))) for k in range(40)]
    rows = [(k, " ".join(words(rng, 20) + items[k][1].split() + items[(k + 1) % 40][1].split() + words(rng, 9))) for k in range(40)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    one, many = (sorted(map(repr, contaminated(docs_of(rows), bench, part_bytes=n).collect())) for n in (1 << 20, 300))
    assert one == many and len(one) >= 40
    a, b = (sorted(map(repr, remove_spans(docs_of(rows), bench, part_bytes=n).collect())) for n in (1 << 20, 300))
    assert a == b

import random

import duckdb
import numpy as np
import pytest

from tessera.llm import chat, mixing, neighbours, sharding, token_counts


def by_sql(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toPandas())
    rel = con.sql(sql)
    return sorted(tuple(map(repr, r)) for r in rel.fetchall()), rel.columns


def rows_of(df):
    return sorted(tuple(map(repr, r)) for r in df.collect())


# -- chat
TURNS = "conv_id long, turn long, role string, text string"


def test_chat(spark):
    rows = [(1, 2, "assistant", "c"), (1, 0, "user", "a"), (1, 1, "user", "b"), (2, 0, None, None), (2, None, "user", "<|im_end|>"), (None, 0, "user", "x"), (1, 2, "assistant", "c")]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, TURNS)).collect()}
    assert got[1].formatted == "<|im_start|>user\na\nb<|im_end|>\n<|im_start|>assistant\nc\nc<|im_end|>\n" and (got[1].n_turns, got[1].n_messages) == (4, 2)
    assert got[2].formatted == "<|im_start|>unknown\n<|im_end|>\n<|im_start|>user\n< |im_end|><|im_end|>\n" and got[None].n_turns == 1


def test_chat_equals_sql_with_clashing_names(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 9), rng.randint(0, 6), rng.choice(("user", "assistant", None)), rng.choice(("hi", "x\ny", "", None)), "z", 1, 2) for _ in range(200)]
    df = spark.createDataFrame(rows, TURNS + ", turns string, begins long, n_turns long")
    out = chat.format_chats(df)
    want, cols = by_sql(chat.ORACLE, conversations=df)
    assert rows_of(out.select(*cols)) == want
    assert chat.format_chats(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, k, "user" if k % 3 else "assistant", "t" * 100) for k in range(3000)], TURNS)
    assert chat.format_chats(long).collect()[0].n_messages == 2000


def test_long_conversations_and_roles_with_line_ends(spark):
    df = spark.range(100_000).selectExpr("1L as conv_id", "id as turn", "if(id % 3 = 0, 'user', 'assistant') as role", "concat('t', id) as text")
    (r,) = chat.format_chats(df).collect()
    assert (r.n_turns, r.n_messages) == (100_000, 66_667) and r.formatted.startswith("<|im_start|>user\nt0<|im_end|>\n<|im_start|>assistant\nt1\nt2<|im_end|>")
    odd = spark.createDataFrame([("c", 0, "user\nassistant", "x"), (None, 1, "user", "a"), (None, 2, "user", "b")], "conv_id string, turn long, role string, text string")
    got = sorted((r.conv_id or "", r.formatted) for r in chat.format_chats(odd).collect())
    assert got == [("", "<|im_start|>user\na<|im_end|>\n"), ("", "<|im_start|>user\nb<|im_end|>\n"), ("c", "<|im_start|>user assistant\nx<|im_end|>\n")]


# -- mixing
def mixed(docs_of, n=400):
    rng = random.Random(7)
    return docs_of([(k, " ".join(["w"] * rng.randint(0, 30)) if k % 17 else None, "en", rng.choice(("src0",) * 5 + ("src1", "src2", "src9", None)), 0) for k in range(n)])


def test_mix_equals_sql(docs_of):
    d = mixed(docs_of)
    want, cols = by_sql(mixing.ORACLE, documents=d)
    assert rows_of(mixing.mix(d).select(*cols)) == want
    finish = [r.finish_time for r in mixing.mix(d).collect()]
    assert finish == sorted(finish)


def test_mix_follows_the_weights(docs_of):
    d = docs_of([(k, "a b c d e f g h", "en", ("x", "y")[k % 2], 0) for k in range(2000)])
    n = {"x": 0, "y": 0}
    for r in mixing.mix(d, {"x": 3.0}, budget_tokens=4000).collect():
        n[r.source] += r.n_tokens
    assert n["x"] + n["y"] <= 4000 and n["x"] + n["y"] > 3980 and abs(n["x"] / n["y"] - 3) < 0.05


def test_take_mix_takes_what_mix_admits(docs_of, odd_docs):
    d = mixed(docs_of).selectExpr("*", "1 as s", "2 as `__cut`", "3 as h", "4 as f")
    out = mixing.take_mix(d)
    assert out.columns == d.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in mixing.mix(d).collect())
    assert mixing.take_mix(odd_docs, budget_share=1.0).count() == odd_docs.count() == mixing.mix(odd_docs, budget_share=1.0).count()
    assert mixing.mix(docs_of([])).count() == 0 and mixing.take_mix(docs_of([])).count() == 0
    assert mixing.mix(odd_docs, budget_tokens=0).filter("n_tokens > 0").count() == 0


def test_ranges_are_parted_until_few_rows_are_left(docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "SORTED", 3)
    monkeypatch.setattr(mixing, "RANGES", 4)
    d = mixed(docs_of)
    want, cols = by_sql(mixing.ORACLE, documents=d)
    assert rows_of(mixing.mix(d).select(*cols)) == want


# -- sharding
def test_shards_equal_sql_and_balance(docs_of, spark):
    rng = random.Random(1)
    d = docs_of([(k, "x" * rng.randint(0, 200), "en", "s", 0) for k in range(3000)])
    got = sharding.shard(d).select("doc_id", "slot", "shard", "map_version")
    want, cols = by_sql(sharding.ORACLE, documents=d)
    assert rows_of(got.select(*cols)) == want
    assert got.agg({"shard": "max"}).first()[0] == sharding.SHARDS - 1


def test_rebalancing_moves_few_slots(spark, docs_of):
    m = sharding.SlotMap(spark)
    even = spark.range(sharding.SLOTS).selectExpr("cast(id as int) as slot", "100L as bytes")
    m.write(sharding.first_map(even, 8), 1)
    before = {r.slot: r.shard for r in m.read(1).collect()}
    grown = even.selectExpr("slot", "case when slot < 512 then 300L else 100L end as bytes")
    assert m.rebalance(grown, 8) == 2 and m.latest() == 2
    after = {r.slot: (r.shard, r.bytes) for r in m.read(2).collect()}
    load = [sum(b for s, b in after.values() if s == k) for k in range(8)]
    moved = sum(after[k][0] != before[k] for k in after)
    assert max(load) <= sharding.SLACK * sum(load) / 8 + 300 and 0 < moved < 512 and {r.slot: r.shard for r in m.read(1).collect()} == before
    assert m.rebalance(grown, 9) == 3 and len({r.shard for r in m.read(3).collect()}) == 9
    with pytest.raises(Exception):
        m.write(m.read(1), 1)


def test_a_map_is_kept_until_it_is_out_of_balance(docs_of, tmp_path):
    rng = random.Random(4)
    d = docs_of([(k, "x" * rng.randint(50, 200), "en", "s", 0) for k in range(5000)])
    path = f"file://{tmp_path}/map"
    version = lambda df, n=8: {(r.map_version, r.doc_id, r.slot, r.shard) for r in sharding.shard(df, n, path=path).collect()}
    one, again = version(d), version(d)
    assert one == again and {v for v, *_ in one} == {1}
    grown = d.unionByName(docs_of([(k, "y" * 3000, "en", "s", 0) for k in range(300)]))
    more = version(grown)
    assert {v for v, *_ in more} == {2} and len({s for _, _, _, s in version(grown, 9)}) == 9
    at = {i: (slot, s) for _, i, slot, s in one}
    assert all(at[i][0] == slot for _, i, slot, _ in more) and 0 < sum(at[i][1] != s for _, i, _, s in more if i >= 300) < 3000


def test_shard_odd_rows(odd_docs, docs_of):
    wide = odd_docs.selectExpr("*", "1 as slot", "2 as new_slot", "3 as shard", "4 as version")
    out = sharding.shard(wide)
    assert out.columns == [*wide.columns, "new_new_slot", "new_shard", "map_version"] and out.count() == wide.count()
    assert out.filter("doc_id is null").select("new_new_slot").distinct().count() == 1
    assert sharding.shard(docs_of([])).count() == 0


# -- token counts
def test_token_counts_equal_whole_encoding(docs_of, odd_docs):
    rng = random.Random(3)
    text = " ".join(rng.choice(("the", "don't", "12", "naïve", "x.y", "  gap", "\n\n", "日本", "a_b")) for _ in range(60_000))
    with open(token_counts.VOCABULARY, "rb") as f:
        enc = token_counts.encoding(f.read())
    rows = [(1, text), (2, "<|endoftext|> hi"), (3, "a" * 300_000), (4, " \n x  y"), (5, ""), (6, None)]
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs_of(rows)).collect()}
    assert got == {d: None if t is None else len(enc.encode_ordinary(t)) for d, t in rows}
    assert len(list(token_counts.parts(text))) > 3 and "".join(token_counts.parts(text)) == text
    assert sum(len(x) for x, _ in token_counts.batches_of(["é" * 600, "b"] * 4, 1000)) == 8 and len(list(token_counts.batches_of(["é" * 600] * 4, 1000))) == 4
    named = docs_of(rows).selectExpr("concat('doc-', doc_id) as doc_id", "text")
    assert {r.doc_id for r in token_counts.count_tokens(named).collect()} == {f"doc-{k}" for k in range(1, 7)}
    wide = odd_docs.selectExpr("*", "1 as t", "2 as d", "3 as n_tokens")
    assert token_counts.count_tokens(wide).count() == wide.count() and token_counts.count_tokens(docs_of([])).count() == 0


# -- neighbours
VECS = "vec_id long, embedding array<float>, label int"


def exact(e, k):
    u = e / np.linalg.norm(e, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return [set(x) for x in np.argsort(-s, axis=1)[:, :k].tolist()]


def test_hilbert_neighbours_are_one_step_apart():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    key = neighbours.hilbert_keys(cells, 3)
    assert sorted(key.tolist()) == list(range(512))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(4)
    e = rng.normal(size=(3000, 24))
    df = spark.createDataFrame([(k, [float(x) for x in v], 0) for k, v in enumerate(e)], VECS)
    got = {}
    for r in neighbours.nearest(df, k=10, every=1, part_rows=700).collect():
        got.setdefault(r.vec_id, {})[r.rank] = (r.neighbour_id, r.similarity)
    want = exact(e, 10)
    assert np.mean([len({j for j, _ in got[k].values()} & want[k]) / 10 for k in range(len(e))]) >= 0.9
    assert all([s for _, (_, s) in sorted(g.items())] == sorted((s for _, s in g.values()), reverse=True) for g in got.values())


def test_small_tables_are_exact_and_odd_rows_left_out(spark):
    rng = np.random.default_rng(5)
    e = rng.normal(size=(60, 6))
    good = [(k, [float(x) for x in v], 0) for k, v in enumerate(e)]
    odd = [(100, None, None), (None, [1.0] * 6, 1), (101, [0.0] * 6, 1), (102, [1.0, 2.0], 1), (103, [None] + [1.0] * 5, 1), (104, [float("nan")] * 6, 1), (105, [], 1), good[3], (106, good[4][1], 1)]
    df = spark.createDataFrame(good + odd, VECS).selectExpr("*", "1 as d", "2 as u", "3 as c", "4 as near")
    got = {}
    for r in neighbours.nearest(df, k=5, every=1).collect():
        got.setdefault(r.vec_id, []).append((r.rank, r.neighbour_id, r.similarity))
    # Of equal vectors either may be in another's list, so similarities are compared.
    u = np.vstack((e, e[4]))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = u @ u.T
    np.fill_diagonal(want, -9)
    want = -np.sort(-want, axis=1)[:, :5]
    assert set(got) == {*range(60), 106}
    assert all(np.allclose([x for _, _, x in sorted(v)], want[60 if k == 106 else k], atol=1e-6) for k, v in got.items())
    assert sorted(got[4])[0][1] == 106 and abs(sorted(got[4])[0][2] - 1) < 1e-9
    assert neighbours.nearest(df.limit(0)).count() == 0 and neighbours.nearest(df.filter("vec_id = 1"), every=1).count() == 0


def test_equal_vectors_give_the_least_ids(spark):
    rng = np.random.default_rng(6)
    one = [float(x) for x in rng.normal(size=8)]
    rows = [(k, one, 0) for k in range(100, 150)] + [(k, [float(x) for x in rng.normal(size=8)], 0) for k in range(20)]
    rng.shuffle(rows)
    got = {}
    for r in neighbours.nearest(spark.createDataFrame([(int(k), v, 0) for k, v, _ in rows], VECS), k=5, every=1).collect():
        got.setdefault(r.vec_id, {})[r.rank] = r.neighbour_id
    assert all([got[k][n] for n in range(1, 6)] == [x for x in range(100, 106) if x != k][:5] for k in range(100, 150))
    assert len(got) == 70 and all(len(g) == 5 for g in got.values())


def test_tied_similarities_at_the_border_are_ordered_by_id():
    others = np.array([[0.6, 0.8], [0.6, -0.8]] * 30)
    ids = np.random.default_rng(7).permutation(60)
    ((_, found, _),) = neighbours.best(np.array([99]), np.array([[1.0, 0.0]]), others, ids, 10)
    assert found[0].tolist() == list(range(10))


def test_reach_grows_until_recall_holds(spark):
    rng = np.random.default_rng(8)
    e = rng.normal(size=(6000, 24))
    df = spark.createDataFrame([(k, [float(x) for x in v], 0) for k, v in enumerate(e)], VECS)
    got = {}
    for r in neighbours.nearest(df, every=1, part_rows=500).collect():
        got.setdefault(r.vec_id, set()).add(r.neighbour_id)
    want = exact(e, 10)
    assert np.mean([len(got[k] & want[k]) / 10 for k in range(len(e))]) >= 0.9


def test_queries_are_the_ids_divisible_by_fifty_against_all_rows(spark):
    rng = np.random.default_rng(9)
    e = rng.normal(size=(1000, 16))
    e[777] = e[100]
    e[3] = e[100]
    df = spark.createDataFrame([(k, [float(x) for x in v], 0) for k, v in enumerate(e)], VECS)
    got = {}
    for r in neighbours.nearest(df).collect():
        got.setdefault(r.vec_id, {})[r.rank] = (r.neighbour_id, r.similarity)
    assert set(got) == set(range(0, 1000, 50)) and all(sorted(g) == list(range(1, 11)) for g in got.values())
    assert [got[100][n][0] for n in (1, 2)] == [3, 777] and got[100][1][1] == 1.0
    want = exact(e, 10)
    assert np.mean([len({j for j, _ in got[k].values()} & want[k]) / 10 for k in got]) >= 0.9


def test_ids_of_text_are_kept(spark):
    rng = np.random.default_rng(10)
    rows = [(f"v-{k}", [float(x) for x in rng.normal(size=8)]) for k in range(40)]
    out = neighbours.nearest(spark.createDataFrame(rows, "vec_id string, embedding array<float>"), k=3, every=1)
    assert out.count() == 120 and {r.neighbour_id for r in out.collect()} <= {i for i, _ in rows}

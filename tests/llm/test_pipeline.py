import random

import corpus_pipeline as P


def prose(rng, n):
    parts = "the an er ing tion of and in ed on ra lo mi ".split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(8)
    item = prose(rng, 25)
    rows = [(k, prose(rng, rng.randint(60, 200)), "en", f"src{k % 3}", 0) for k in range(160)]
    rows += [(200, "*** %%% &&& " * 60, "en", "src0", 0), (201, rows[5][1], "en", "src1", 0), (202, rows[6][1] + " tail", "en", "src1", 0), (203, f"{prose(rng, 80)} {item} {prose(rng, 80)}", "en", "src1", 0)]
    rows += [(None, None, None, None, None), (204, "", None, None, None)]
    for name, data, schema in (
        ("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", [(k, 1, 0) for k in range(100)], "doc_id long, quality int, toxic int"),
        ("benchmark", [(1, item)], "item_id long, text string"),
    ):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != P.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/out-{name}")
        docs = spark.read.parquet(f"{tmp_path}/out-{name}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
    assert 200 not in seen["quality_classifier"] and {*range(160), 201, 202, 203} <= set(seen["quality_classifier"])
    assert not {201, 202} & set(seen["near_dedup"]) and {*range(160), 203} <= set(seen["near_dedup"])
    assert item not in seen["decontamination"][203].text and len(seen["decontamination"]) == len(seen["near_dedup"])
    assert 0 < len(seen["source_mix"]) < len(seen["decontamination"])
    assert set(seen["sharding"]) == set(seen["source_mix"]) and docs.columns[-3:] == ["slot", "shard", "map_version"]
    assert sorted(map(repr, P.run(spark, str(tmp_path)).collect())) == sorted(map(repr, docs.collect()))


def test_stages_on_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0

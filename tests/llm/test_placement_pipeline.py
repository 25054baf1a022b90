from __future__ import annotations

import hashlib
import os
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from spindrift.llm import op2_mixing as op2
from spindrift.llm import op3_simhash as op3
from spindrift.llm import op5_quality as op5
from spindrift.llm import op6_ann as op6
from spindrift.llm import op7_sharding as op7
from spindrift.llm import op8_bpe as op8
from spindrift.llm import op10_pii as op10
from spindrift.llm.registry import ORACLE, QUERIES


def worst_deviation(order, blocks, weights):
    """Largest distance of a source from its fluid share, in blocks, at any slot."""
    fluid = lambda v: sum(min(weights[s] * v, n) for s, n in blocks.items())
    done, worst = Counter(), 0.0
    for t, s in enumerate(order, 1):
        done[s] += 1
        a, z = 0.0, max(n / weights[k] for k, n in blocks.items())
        for _ in range(80):
            m = (a + z) / 2
            a, z = (m, z) if fluid(m) < t else (a, m)
        worst = max(worst, max(abs(done[k] - min(weights[k] * z, n)) for k, n in blocks.items()))
    return worst


@pytest.mark.parametrize("seed", range(4))
def test_schedule_stays_within_a_block(spark, seed):
    rng = random.Random(seed)
    sources = [(f"s{k}", float(rng.randrange(1, 50)), rng.randrange(0, 40)) for k in range(9)]
    got = op2.schedule(spark.createDataFrame(sources, "source string, weight double, blocks int")).orderBy("slot").collect()
    blocks = {s: n for s, _, n in sources if n}
    assert [r["slot"] for r in got] == list(range(sum(blocks.values())))
    for s, n in blocks.items():
        assert [r["block"] for r in got if r["source"] == s] == list(range(n))
    assert worst_deviation([r["source"] for r in got], blocks, {s: w for s, w, _ in sources}) < 1


def test_mixing_of_odd_rows(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["a", "a", "a", "b", "c", None]), None if k % 9 == 0 else f"t{k}") for k in range(400)] + [(5, "b", "same")] * 3 + [(None, "b", None)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, __slot int")
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0), (None, 2.0), ("zz", 9.0), ("c", -1.0)], "source string, weight double")
    for w in (None, weights):
        got = op2.mix(table, w, slots=40, buckets=8).select("__doc.doc_id", "__doc.source", "__doc.text", "__block", "__slot", "__place").collect()
        assert Counter((r["doc_id"], r["source"], r["text"]) for r in got) == Counter(rows)
        held = defaultdict(list)
        for r in got:
            held[r["__slot"]].append(r)
        size = -(-len(rows) // 40)
        for rs in held.values():
            assert len({(r["source"], r["__block"]) for r in rs}) == 1 and sorted(r["__place"] for r in rs) == list(range(len(rs))) and len(rs) <= size
    assert op2.mix(table.where("false")).count() == 0


def test_training_order_is_the_order_of_files(spark, tmp_path):
    table = spark.createDataFrame([(k, f"s{k % 5 * (k % 2)}", f"t{k}") for k in range(300)], "doc_id long, source string, text string")
    out = op2.in_training_order(table, 4, slots=30)
    assert out.columns == table.columns
    out.write.parquet(str(tmp_path / "o"))
    files = sorted(f for f in os.listdir(tmp_path / "o") if f.endswith(".parquet"))
    seen = [i for f in files for i in pd.read_parquet(tmp_path / "o" / f)["doc_id"].tolist()]
    expected = [r["doc_id"] for r in op2.mix(table, slots=30).orderBy("__slot", "__place").select("__doc.doc_id").collect()]
    assert seen == expected


def test_native_plans(spark, sf_dir):
    for f in (op2.op2_mixing, op7.op7_sharding):
        plan = f(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def slow_fill(names, size):
    number = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    orders = [[(number(f"offset:{n}") + j * (number(f"skip:{n}") % (size - 1) + 1)) % size for j in range(size)] for n in names]
    owner = {}
    while len(owner) < size:
        for i, order in enumerate(orders):
            free = next((s for s in order if s not in owner), None)
            if free is not None:
                owner[free] = i
    return [owner[s] for s in range(size)]


@pytest.mark.parametrize("n,size", [(1, 7), (3, 13), (5, 101), (7, 7)])
def test_table_fill(n, size):
    names = op7.shard_names(n)
    got = op7.fill(names, size)
    assert got == slow_fill(names, size)
    counts = Counter(got)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == n


def test_bad_tables_raise():
    for args in ((["a"], 8), ([], 7), (["a", "a"], 7), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            op7.fill(*args)


def test_sharding_of_odd_rows(spark):
    rows = [(1, "x"), (None, "y"), (1, "x"), (2, None)]
    table = spark.createDataFrame([(*r, 9, "old") for r in rows], "doc_id long, text string, slot int, `odd name` string")
    got = op7.shard(table, "doc_id", op7.shard_names(3), 101).collect()
    assert len(got) == 4 and len({r["shard"] for r in got if r["doc_id"] == 1}) == 1 and all(0 <= r["slot"] < 101 for r in got)
    spread = op7.shard(spark.range(200).selectExpr("7 AS doc_id", "id AS row"), "doc_id", op7.shard_names(3), 101, salt_cols=("row",))
    assert spread.select("shard").distinct().count() == 3
    assert op7.shard(table.where("false"), "doc_id", op7.shard_names(3), 101).count() == 0


def test_large_sharding_tables_are_not_broadcast_by_hint(spark, monkeypatch):
    rows, names = spark.range(50).withColumnRenamed("id", "doc_id"), op7.shard_names(3)
    small = op7.shard(rows, "doc_id", names, 101)
    monkeypatch.setattr(op7, "MOST_BROADCAST", 100)
    large = op7.shard(rows, "doc_id", names, 101)
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().optimizedPlan().toString()
    assert hinted(small) and not hinted(large)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))


def cosine(a, b):
    return (a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))


@pytest.mark.parametrize("block", [8192, 40])
def test_neighbours_equal_brute_force(spark, block):
    rng = np.random.default_rng(3)
    vectors = {k: rng.normal(size=24) for k in range(300)}
    for k in range(60, 90):
        vectors[k] = vectors[60].copy()
    vectors[1] = vectors[0] * 3
    odd = [(400, None), (401, [0.0] * 24), (402, [float("nan")] + [1.0] * 23), (403, [None] + [1.0] * 23), (404, []), (450, [float("inf")] * 24), (None, [1.0] * 24), (500, [1.0, 2.0]), (501, [2.0, 1.0]), (0, vectors[0].tolist())]
    rows = [(k, v.tolist(), 1, "x") for k, v in vectors.items()] + [(*r, 1, "x") for r in odd]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score string")
    got = defaultdict(list)
    for r in op6.nearest(table, block=block).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {0, 50, 100, 150, 200, 250, 500}
    assert got[500] == [(1, 501, pytest.approx(0.8))]
    missed = 0
    for q in set(got) - {500}:
        slow = sorted(((cosine(vectors[q], v), k) for k, v in vectors.items() if k != q), key=lambda x: (-x[0], x[1]))[:5]
        assert [r for r, _, _ in got[q]] == [1, 2, 3, 4, 5]
        missed += len({k for _, k in slow} - {k for _, k, _ in got[q]})
        for (s, _), (_, k, score) in zip(slow, got[q]):
            assert score == pytest.approx(cosine(vectors[q], vectors[k]), abs=1e-12)
    assert missed <= 3
    assert op6.nearest(table.where("false")).count() == 0


def test_codes_leave_few_vectors_to_rerank():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(4000, 128))
    turn = op6.rotation(128, 7)
    codes, scale = op6.encode(v, turn)
    assert codes.shape == (4000, 2) and 0.7 < scale.mean() < 0.9
    q = v[:20] + 0.3 * rng.normal(size=(20, 128))
    ids, found, score = op6.search(np.arange(4000), v, codes, scale, np.arange(-20, 0), q, turn, 5, 3.0)
    exact = (v / np.linalg.norm(v, axis=1)[:, None]) @ (q / np.linalg.norm(q, axis=1)[:, None]).T
    hits = sum(len(set(np.argsort(-exact[:, i])[:5]) & set(found[ids == i - 20])) for i in range(20))
    assert hits >= 95


def test_block_pairs_are_not_shuffled_and_thresholds_carry_over(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(600, 16)).astype(np.float32)
    table = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(v)], "vec_id long, embedding array<float>")
    found = op6.nearest(table, block=100)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    # each task reads its two blocks; a join by block would write every query once for each block
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
    assert found.count() == 60 and found.select("query_id", "vec_id").distinct().count() == 60
    # blocks one after the other give what one block gives, and a vector that comes twice counts once
    turn, ids = op6.rotation(16, 7), np.arange(600)
    codes, scale = op6.encode(v.astype(float), turn)
    best = op6.Best(10, 5)
    for at in (0, 200, 400, 0):
        part = slice(at, at + 200)
        op6.meet(ids[part], v[part], op6.signs(codes[part], scale[part], 16, 9.0), ids[:10], v[:10], turn, best)
    for i in range(10):
        slow = sorted(((cosine(v[i].astype(float), v[k].astype(float)), k) for k in range(600) if k != i), key=lambda x: (-x[0], x[1]))[:5]
        assert best.ids[i].tolist() == [k for _, k in slow] and best.score[i].tolist() == pytest.approx([x for x, _ in slow], abs=1e-12)


def test_pipeline_equals_its_stages_in_plain_code(spark, sf_dir):
    """Each stage against brute force on the small table, then the last stage's digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    judged = {r["doc_id"]: r["kept"] for r in duck(sf_dir, op5.ORACLE_SQL)}
    kept = {i for i in rows if judged[i]}
    # near copies: five-word shingles, similarity of 0.8 or more, by all pairs
    from tests.llm.test_dedup_quality import jaccard_components

    found = jaccard_components({i: rows[i]["text"] for i in kept})
    alone = {i for i in kept if found[i] == i}
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in out} == alone and len(out) == len(alone)
    spans = {r["doc_id"]: r["spans"] for r in op10.find_spans(docs.where(docs["doc_id"].isin(*alone))).collect()}
    enc = op8.tokenizer(*op8._public_tokenizer())
    for r in out:
        text, at, made = rows[r["doc_id"]]["text"], 0, []
        for s in spans[r["doc_id"]]:
            if s["start"] >= at:
                made.append(text[at : s["start"]] + f"<{op10.KINDS[s['ord']].upper()}>")
                at = s["end"]
        text = "".join(made) + text[at:]
        assert r["n_tokens"] == len(enc.encode_ordinary(text)) and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    places = sorted((r["sequence_part"], r["sequence_row"]) for r in out)
    assert len(set(places)) == len(out)
    order = [r["source"] for r in sorted(out, key=lambda r: (r["sequence_part"], r["sequence_row"]))]
    counts = Counter(rows[i]["source"] for i in alone)
    grid = op2.GRID / sum(np.sqrt(n) for n in counts.values())
    assert worst_deviation(order, dict(counts), {s: max(1, round(np.sqrt(n) * grid)) for s, n in counts.items()}) < 1


def duck(sf_dir, sql):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{sf_dir}/documents.parquet'")
    return con.sql(sql).df().to_dict("records")


def test_every_stage_takes_odd_tables(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "the and of " * 40, "en", None, 3), (4, "word and the other of mail a@b.co " * 20, "en", "s", 9)]
    for k, held in enumerate((rows, [])):
        spark.createDataFrame([(*r, 1, "x") for r in held], "doc_id long, text string, lang string, source string, n_chars long, fp int, `odd name` string").write.parquet(str(tmp_path / f"d{k}"))
        docs = spark.read.parquet(str(tmp_path / f"d{k}"))
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / f"{name}{k}"))
            if name == "mixing":
                docs = spark.read.parquet(str(tmp_path / f"{name}{k}"))
            elif k == 1:
                assert out.count() == 0


@pytest.mark.parametrize("components", [op3.simhash_components, op3.near_components])
def test_near_copies_leave_one(spark, components):
    base = " ".join(f"w{k}" for k in range(6000))
    rows = [(9, base), (3, base), (5, base.replace("w7 ", "z ")), (1, "quite another text " * 30)]
    kept = op3.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), components)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_with_sql(spark, sf_dir, name):
    mine = QUERIES[name](spark, sf_dir).toPandas()
    theirs = pd.DataFrame(duck(sf_dir, ORACLE[name]))
    order = lambda d: d[sorted(d.columns)].astype(str).sort_values(sorted(d.columns)).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(mine), order(theirs))


def test_mixing_of_columns_that_hold_maps_and_finer_partitions(spark):
    table = spark.range(90).selectExpr("id AS doc_id", "concat('s', id % 3) AS source", "array(named_struct('m', map('k', id))) AS held", "map('a', 1) AS m")
    out = op2.in_training_order(table, 40, slots=6)
    assert out.columns == table.columns and out.count() == 90 and out.rdd.getNumPartitions() == 40
    assert max(len(p) for p in out.rdd.glom().collect()) < 10

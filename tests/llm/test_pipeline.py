"""Each stage of the pipeline does on its own input what brute force does."""

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from sparkloom.llm import decontaminate, nearcopies, toxicity
from sparkloom.llm.nearcopies import near_copy_groups
from tests.llm.test_llm import fingerprint, linked, removed

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(9000, None, None, None, None), (9001, "", "en", "s", 0), (9001, "", "en", "s", 0), (None, "no id", "en", "s", 5), (9002, "one loser here", None, "s", 3)]
    return rows.unionByName(spark.createDataFrame(odd, rows.schema)).cache()


def test_toxicity_keeps_what_scores_low(spark, docs):
    got = pipeline.toxicity(spark, docs, SF)
    assert got.columns == COLUMNS
    scores = toxicity.score_texts(docs, toxicity.trained(spark, docs, SF)).where("score < 0.7")
    assert sorted(map(str, got.select("doc_id").collect())) == sorted(map(str, scores.select("doc_id").collect()))


def test_simhash_keeps_the_first_of_each_group(spark, docs):
    got = pipeline.simhash(spark, docs, SF)
    assert got.columns == COLUMNS
    rows = sorted({(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None}, key=lambda r: r[0])
    root = linked([fingerprint(t) for _, t in rows])
    want = sorted({rows[r][0] for r in root})
    ids = [r["doc_id"] for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == want and ids.count(None) == 1


def test_suffix_stage_cuts_what_is_repeated(spark, docs):
    got = pipeline.suffix_dedup(spark, docs.where("doc_id is not null").dropDuplicates(["doc_id"]), SF)
    assert got.columns == COLUMNS
    rows = sorted({(r["doc_id"], r["text"] or "") for r in docs.collect() if r["doc_id"] is not None})
    want = {d: kept.decode("utf-8", "ignore") for d, spans, kept in removed(rows) if not spans or kept.strip()}
    mine = {r["doc_id"]: r for r in got.collect()}
    assert set(mine) == set(want)
    for d, t in want.items():
        assert mine[d]["text"] == t and mine[d]["n_chars"] == len(t)


def test_decontamination_drops_documents_with_items(spark, docs):
    got = pipeline.decontamination(spark, docs, SF)
    assert got.columns == COLUMNS
    hit = {r["doc_id"] for r in decontaminate.op2_decontamination(spark, SF).collect()}
    assert sorted(map(str, (r["doc_id"] for r in got.collect()))) == sorted(str(r["doc_id"]) for r in docs.collect() if r["doc_id"] not in hit)


def test_the_whole_pipeline(spark):
    got = pipeline.run(spark, SF).toPandas()
    assert set(got.columns) == {"doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"} and got["doc_id"].is_unique
    items = pd.read_parquet(f"{SF}/benchmark.parquet")["text"]
    text = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")["text"]
    assert not any(t in text[d] for d in got["doc_id"] for t in items)
    assert len(got) > 0.7 * len(text) and [n for n, _ in pipeline.STAGES] == ["toxicity", "simhash", "suffix_dedup", "decontamination", "bpe"]
    assert (got["ids"].str.len() == got["n_tokens"]).all() and all(re.fullmatch("[0-9a-f]{64}", h) for h in got["ids_sha256"])


def test_stages_of_an_empty_table(spark, docs):
    none = docs.where(F.lit(False))
    for name, stage in pipeline.STAGES:
        none = stage(spark, none, SF)
        assert none.count() == 0, name


def test_near_copies_are_all_linked(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    base = [f"w{i}" for i in range(300)]
    # A chain of copies, each a word further from the first, and a group with more members than SMALL.
    chain = [(90000 + k, " ".join(base[: 100 + k])) for k in range(0, 60, 10)]
    group = [(91000 + k, " ".join([*base[200:260], f"x{k}"])) for k in range(40)]
    odd = [(92000, None), (92001, ""), (92002, "a b"), (92003, "A  b"), (92004, "a b c")]
    rows = rows.unionByName(spark.createDataFrame(chain + group + odd, rows.schema))
    texts = sorted((r["doc_id"], r["text"]) for r in rows.collect())
    sets = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        near = set().union(*(holders.get(x, ()) for x in s))
        for j in near:
            common = len(s & sets[j])
            if 5 * common >= 4 * (len(s) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for x in s:
            holders.setdefault(x, []).append(i)
    want = {d: texts[find(i)][0] for i, (d, _) in enumerate(texts)}
    got = {r["doc_id"]: r["component_id"] for r in near_copy_groups(rows).collect()}
    assert got == want
    assert got[90050] == 90000 and len({got[d] for d, _ in group}) == 1 and [got[d] for d, _ in odd] == [got[92000], got[92000], 92002, 92002, 92004]
    stage = dict(pipeline.STAGES)["simhash"]
    columns = [F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.length("text").alias("n_chars")]
    kept = stage(spark, rows.select("*", *columns), SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_simhash_is_a_step_of_its_stage(spark):
    # Every fifth word of a long text of one repeated line differs: the bits are those of the line, the sets are not alike.
    words = [f"w{i}" for i in range(20)]
    texts = [" ".join(words * 100), " ".join(words * 100) + " " + " ".join(f"y{i}" for i in range(30)), "something else altogether stands here"]
    assert (fingerprint(texts[0]) ^ fingerprint(texts[1])).bit_count() <= 3
    df = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert len({r["component_id"] for r in near_copy_groups(df).collect()}) == 3
    assert sorted(r["doc_id"] for r in dict(pipeline.STAGES)["simhash"](spark, df, SF).collect()) == [0, 2]


def test_members_that_differ_are_no_candidates():
    # A bucket of 400 sets of 100 shingles that share one shingle, and two that are near.
    rng = np.random.default_rng(5)
    held = [np.append(rng.integers(0, 1 << 64, 99, np.uint64), np.uint64(7)) for _ in range(400)]
    held.append(np.append(held[0][:-2], rng.integers(0, 1 << 64, 2, np.uint64)))
    n = len(held)
    rows = [np.full(n, 7), np.arange(n), np.full(n, 100), np.arange(n), [nearcopies.sketch(np.unique(s)) for s in held]]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in rows], ["shingle", "node", "n", "part", "sketch"])
    pairs = [(r["a"], r["b"]) for b in nearcopies.other_pairs(iter([batch])) for r in b.to_pylist()]
    assert (0, n - 1) in pairs and len(pairs) < n


def test_sketches_of_long_sets_tell_them_apart():
    # Sets of 150 and of 3,000 shingles with as many in common as makes them 0.6, 0.75 and 0.8 alike.
    rng = np.random.default_rng(6)
    for n in (150, 3000):
        own = rng.integers(0, 1 << 64, 2 * n, np.uint64)
        held = [np.unique(np.append(own[:same], rng.integers(0, 1 << 64, n - same, np.uint64))) for same in (n, 3 * n // 4, 6 * n // 7, -(-8 * n // 9))]
        held += [np.unique(rng.integers(0, 1 << 64, n - 3 * k, np.uint64)) for k in range(40)]
        m = len(held)
        rows = [np.full(m, 7), np.arange(m), np.array([len(s) for s in held]), np.arange(m), [nearcopies.sketch(s) for s in held]]
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in rows], ["shingle", "node", "n", "part", "sketch"])
        pairs = {(r["a"], r["b"]) for b in nearcopies.other_pairs(iter([batch])) for r in b.to_pylist()}
        assert (0, 3) in pairs and (0, 1) not in pairs and not any(b > 3 for _, b in pairs)


def test_near_copies_give_a_pair_a_member_at_first():
    # A bucket of 100 near copies: each is tried against one other, not against all.
    rng = np.random.default_rng(7)
    own = rng.integers(0, 1 << 64, 400, np.uint64)
    held = [np.unique(np.append(own[:390], rng.integers(0, 1 << 64, 10 + k % 7, np.uint64))) for k in range(100)]
    rows = [np.full(100, 7), np.arange(100), np.array([len(s) for s in held]), np.arange(100), [nearcopies.sketch(s) for s in held]]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in rows], ["shingle", "node", "n", "part", "sketch"])
    assert sum(b.num_rows for b in nearcopies.other_pairs(iter([batch]))) == 4950
    assert sum(b.num_rows for b in nearcopies.nearest_pairs(iter([batch]))) == 99


def test_large_buckets_of_the_same_members_are_told():
    node = np.tile(np.arange(40), 3)
    node[80:] += 1
    rows = [np.repeat([5, 6, 7], 40), node, node, np.full(120, 50)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in rows], ["shingle", "node", "part", "n"])
    found = [r for b in nearcopies.first_pairs(iter([batch])) for r in b.to_pylist()]
    names = {r["a"]: (r["large"], r["b"]) for r in found if r["large"]}
    assert len([r for r in found if not r["large"]]) == 3 * 39 and names[5] == names[6] != names[7]


def test_links_are_thinned_to_what_connects():
    ends = [(a, b) for a in range(50) for b in range(a + 1, 50)] + [(70, 71), (72, 71)]
    batch = pa.RecordBatch.from_arrays([pa.array([a for a, _ in ends]), pa.array([b for _, b in ends])], ["a", "b"])
    (kept,) = nearcopies.forest(iter([batch]))
    root = {x: x for e in ends for x in e}
    for r in kept.to_pylist():
        old, new = root[r["b"]], root[r["a"]]
        root = {x: new if y == old else y for x, y in root.items()}
    assert kept.num_rows == 51 and len(set(root.values())) == 2


def test_stages_keep_columns_with_clashing_names(spark):
    names = ["score", "score_", "scores", "hits", "_score", "_cut", "_hits", "n", "record", "spans", "kept", "ids", "ord", "component_id", "fp", "node"]
    rows = [(i, f"document {i} says " + " ".join(f"w{i}x{k}" for k in range(40)), *[f"{c}{i}" for c in names]) for i in range(20)]
    docs_ = spark.createDataFrame(rows, ["doc_id", "text", *names])
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, docs_, SF)
        assert got.columns == docs_.columns, name
        assert sorted(map(tuple, got.collect())) == sorted(rows), name
    assert pipeline.STAGES[-1][1](spark, docs_, SF).count() == 20

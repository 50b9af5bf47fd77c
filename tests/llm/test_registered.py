"""Every registered corpus query: against SQL, or against brute force, a round trip or held-out labels."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
import public_tokenizers
import tiktoken
import xxhash

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from bastionlog.llm.bpe import read_ranks
from bastionlog.llm.oracles import ORACLES
from bastionlog.llm.queries import REGISTRY
from tests.compare import connect, rows_of

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = connect(SF_DIR)
    yield con
    con.close()


def fetch(con, sql):
    return con.execute(sql).fetchall()


def rows(spark, name):
    return {r[0]: r for r in REGISTRY[name](spark, SF_DIR).collect()}


def test_all_are_registered():
    assert {n.split("_")[0] for n in REGISTRY} == {f"op{n}" for n in range(1, 14)}
    assert set(REGISTRY) | {"pipeline"} <= set(queries())
    assert set(ORACLES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = REGISTRY[name](spark, SF_DIR)
    result = duck.execute(ORACLES[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in result.description], result.fetchall())


@pytest.mark.parametrize(("name", "label", "folds", "fold", "cut"), [("op2_toxicity", "toxic", 4, 2, 0.3), ("op7_quality", "quality", 3, 1, 0.5)])
def test_classifiers_on_held_out_labels(spark, name, label, folds, fold, cut):
    """On 10,000 documents: enough labels to learn from."""
    large = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in REGISTRY[name](spark, large).collect()}
    labels = duckdb.sql(f"select doc_id, {label} from '{large}/labels.parquet'").fetchall()
    assert len(got) == 10_000
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % folds == fold) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut) for r in got.values())
    held = [(got[i]["predicted"], y) for i, y in labels if got[i]["held_out"]]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)


def test_neighbours_recall(spark, duck):
    vectors = fetch(duck, "select vec_id, embedding from embeddings order by 1")
    ids, x = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors], dtype=float)
    found = {}
    for r in REGISTRY["op3_neighbours"](spark, SF_DIR).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(found) == {i for i in ids.tolist() if i % 20 == 0}
    hits = total = 0
    for q, ranked in found.items():
        exact = x @ x[np.searchsorted(ids, q)]
        order = [i for i in np.lexsort((ids, -exact)) if ids[i] != q][:20]
        hits += len({v for v, _ in ranked.values()} & set(ids[order].tolist()))
        total += len(order)
        assert sorted(ranked) == list(range(1, len(order) + 1))
        assert all(abs(exact[np.searchsorted(ids, v)] - s) < 1e-12 for v, s in ranked.values())
        assert [v for _, v in sorted(ranked.items())] == sorted(ranked.values(), key=lambda t: (-t[1], t[0]))
    assert hits >= 0.95 * total


def brute_components(texts):
    def bits(text):
        words = (text or "").encode().lower().split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    marks = {i: bits(t) for i, t in texts}
    leader = {i: i for i in marks}
    changed = True
    while changed:
        changed = False
        for a in marks:
            for b in marks:
                if leader[b] < leader[a] and (marks[a] ^ marks[b]).bit_count() <= 4:
                    leader[a], changed = leader[b], True
    return {i: (f"{marks[i]:016x}", leader[i]) for i in marks}


def test_simhash(spark, duck):
    want = brute_components(fetch(duck, "select doc_id, text from documents"))
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in rows(spark, "op4_simhash").items()} == want


def test_tokens_as_the_library(spark, duck):
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows(spark, "op5_bpe")
    for i, text in fetch(duck, "select doc_id, text from documents"):
        ids = library.encode_ordinary(text or "")
        listed = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        decoded = hashlib.sha256((text or "").encode()).hexdigest()
        assert tuple(got[i])[1:] == (len(ids), listed, decoded)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near-duplicates", "decontamination", "secrets", "tokens"]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF_DIR)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "tokens":
            assert docs.columns == before.columns
    scores = rows(spark, "op7_quality")
    assert set(kept["quality"]) == {i for i, r in scores.items() if r["predicted"]}
    quality = [(i, r["text"]) for i, r in kept["quality"].items()]
    assert set(kept["near-duplicates"]) == {leader for _, leader in brute_components(quality).values()}
    dirty = {i for i, r in rows(spark, "op10_decontaminate").items() if r["contaminated"]}
    assert set(kept["decontamination"]) == set(kept["near-duplicates"]) - dirty
    assert set(kept["secrets"]) == set(kept["decontamination"]) == set(kept["tokens"])
    spans = {i: r["spans"] for i, r in rows(spark, "op6_secrets").items()}
    for i, r in kept["secrets"].items():
        assert ("[REDACTED]" in r["text"]) == bool(spans[i])
        assert r["n_chars"] == len(r["text"])
    run = {tuple(r) for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    assert run == {tuple(r) for r in kept["tokens"].values()}

"""Every query of the subpackage: against its SQL, brute force, or held-out labels."""

import hashlib
import re

import numpy as np
import pytest

from sigmaflow.llm.queries import QUERIES, SQL
from tests.conftest import SF_MID, SF_SMALL
from tests.oracle_check import compare, duck

TESTDATA_LARGE = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, SF_SMALL).toPandas(), duck(SF_SMALL).sql(SQL[name]).df()) == "OK"


@pytest.mark.parametrize("name", ["op2_mixing", "op4_repeats", "op5_jaccard"])
def test_matches_sql_on_more(spark, name):
    assert compare(QUERIES[name](spark, SF_MID).toPandas(), duck(SF_MID).sql(SQL[name]).df()) == "OK"


def test_nearest_recall(spark):
    got = QUERIES["op6_hnsw"](spark, SF_MID).toPandas()
    rows = spark.read.parquet(f"{SF_MID}/embeddings.parquet").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    found = []
    for q, mine in got.groupby("query_id"):
        s = v @ v[ids == q][0]
        order = [ids[i] for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        mine = mine.sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21))
        assert np.allclose(mine["score"], [s[ids == i][0] for i in mine["vec_id"]], atol=1e-12)
        found.append(len(set(order) & set(mine["vec_id"])) / 20)
    assert len(found) == (ids % 20 == 0).sum() and np.mean(found) >= 0.9


def _auc(score, y):
    rank = np.argsort(np.argsort(score))
    return (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (1 - y).sum())


@pytest.mark.parametrize(("name", "label", "least"), [("op3_toxicity", "toxic", 0.95), ("op10_quality", "quality", 0.99)])
def test_held_out_accuracy(spark, name, label, least):
    got = QUERIES[name](spark, TESTDATA_LARGE).toPandas()
    labels = spark.read.parquet(f"{TESTDATA_LARGE}/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    both = both[both.held_out]
    assert len(got) == 10_000 and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    assert _auc(both.score.to_numpy(), both[label].to_numpy()) >= least


# Fixed patterns of the query's contract.
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(x - 9 if x > 9 else x for x in twice) % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def plain_spans(text):
    return sorted((m.start(), r, m.end(), k) for r, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if _passes(k, m.group()))


def test_personal_data(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op8_pii"](spark, SF_MID).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain_spans(texts[r.doc_id])
        names = [f"{k}:{s}:{e}" for s, _, e, k in want]
        assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(w[3] == k for w in want) for k in PLAIN)
        assert set(names) <= set(r.spans.split(",")) | {""}


def test_pipeline_stages(spark):
    """Each stage against its operator's own rows on the stage's input."""
    import corpus_pipeline as P
    from sigmaflow.llm import decontaminate, jaccard, mixing, toxicity
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for name, step in P.STAGES:
        out = P.stage(step(spark, docs, SF_SMALL), "test-stage")
        before, after = [r.doc_id for r in docs.collect()], sorted(r.doc_id for r in out.collect())
        if name != "order":
            assert out.columns == docs.columns
        if name == "toxicity":
            w = toxicity.train(docs, spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
            assert after == sorted(r.doc_id for r in toxicity.score(docs, w).filter("toxicity < 0.3").collect())
        if name == "jaccard":
            assert after == sorted({r.class_id for r in jaccard.similar(docs).collect()})
        if name == "decontamination":
            bad = {r.doc_id for r in decontaminate.find_windows(docs, spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")).filter("contaminated").collect()}
            assert after == sorted(set(before) - bad)
        if name == "mixing":
            assert after == sorted(x for r in mixing.mix(docs).collect() for x in [r.doc_id] * r.copies)
        if name == "order":
            assert set(after) == set(before)
            assert sorted(r.slot for r in out.collect()) == list(range(out.count()))
        docs = out
    assert QUERIES.keys().isdisjoint({"pipeline"}) and docs.count() > 0

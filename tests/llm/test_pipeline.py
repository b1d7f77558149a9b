"""``corpus_pipeline.run`` from end to end, against a chain of SQL and plain Python that shares no operator with it."""

import hashlib
import math
import re

import numpy as np

import corpus_pipeline
from sigmaflow.llm import kit, order, toxicity
from sigmaflow.llm.queries import SQL
from tests.conftest import SF_MID
from tests.oracle_check import duck

FULL = (1 << 64) - 1


def _plain_mix(h):
    h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & FULL
    h = ((h ^ h >> 27) * 0x94D049BB133111EB) & FULL
    return h ^ h >> 31


def _plain_buckets(word, known={}):  # noqa: B006
    """Buckets of a word and of its prefixes, from the polynomial's definition."""
    if word not in known:
        power = [pow(int(kit._MULT), i, 1 << 64) for i in range(len(word))]
        value = lambda w, add: _plain_mix((sum(int(kit.LETTER[b]) * p for b, p in zip(w, power, strict=False)) + add) & FULL)
        codes = [value(word, len(word)), *(value(word[:k], -k) for k in toxicity.PREFIXES)]
        known[word] = [c >> 64 - toxicity.BITS for c in codes]
    return known[word]


def _plain_score(text, w):
    """Noisy-or over the sentences of a text."""
    clean = 1.0
    for sentence in re.split(rb"[\n!.?]", (text or "").encode()):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", sentence.lower())
        if words:
            z = float(w[-1]) + sum(float(w[b]) for word in words for b in _plain_buckets(word))
            clean *= 1 / (1 + math.exp(min(z, 700.0)))
    return 1 - clean


def _only(con, ids):
    con.execute("CREATE OR REPLACE TEMP TABLE chosen AS SELECT unnest(?::BIGINT[]) AS doc_id", [ids])
    con.execute("CREATE OR REPLACE TABLE left_over AS SELECT documents.* FROM documents JOIN chosen USING (doc_id)")
    con.execute("CREATE OR REPLACE TABLE held AS SELECT * FROM left_over")
    con.execute("CREATE OR REPLACE VIEW documents AS SELECT * FROM held")


def _count(con):
    return con.execute("SELECT count(*) FROM documents").fetchall()[0][0]


def test_run_equals_a_chain_of_sql(spark):
    con = duck(SF_MID)
    con.execute("SET threads = 8")
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    assert len(texts) == _count(con) and None not in texts
    counts = [len(texts)]

    docs, labels = (spark.read.parquet(f"{SF_MID}/{t}.parquet") for t in ("documents", "labels"))
    weights = toxicity.train(docs, labels)
    assert np.count_nonzero(weights) > 1
    _only(con, sorted(i for i, t in texts.items() if _plain_score(t, weights) < toxicity.CUT))
    counts.append(_count(con))
    for name, rule in (("op5_jaccard", "doc_id = class_id"), ("op1_decontamination", "NOT contaminated")):
        _only(con, [i for (i,) in con.execute(f"SELECT doc_id FROM ({SQL[name]}) WHERE {rule}").fetchall()])
        counts.append(_count(con))
    assert all(b < a for a, b in zip(counts, counts[1:], strict=False))  # each stage has something to drop

    copies = "CAST(b.whole + CASE WHEN w.took THEN 1 ELSE 0 END AS BIGINT)"
    sql = SQL["op2_mixing"].replace("SELECT d.doc_id, d.size,", f"SELECT d.doc_id, {copies} AS copies, d.size,")
    mixed = dict(con.execute(f"SELECT doc_id, copies FROM ({sql})").fetchall())
    assert set(mixed.values()) >= {1, 2} and min(mixed.values()) == 0

    parts = []
    for i in sorted(mixed):
        raw = (texts[i] or "").encode()
        parts += [(i, k, raw) for _ in range(mixed[i]) for k in range(len(raw) // order.LENGTH + 1)]
    slot = order.slots(np.arange(len(parts)), len(parts)).tolist()
    want = sorted((i, k, s, s // order.ROWS, s % order.ROWS * order.LENGTH, min(order.LENGTH, len(raw) + 1 - k * order.LENGTH),
                   hashlib.sha256(raw[k * order.LENGTH : (k + 1) * order.LENGTH]).hexdigest()) for (i, k, raw), s in zip(parts, slot, strict=True))
    got = corpus_pipeline.run(spark, SF_MID).select("doc_id", "part", "slot", "shard", "offset", "n_tokens", "text_sha256").collect()
    assert sorted(map(tuple, got)) == want

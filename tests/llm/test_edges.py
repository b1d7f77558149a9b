"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sigmaflow.llm import chat, decontaminate, graphs, hnsw, jaccard, mixing, order, pii, quality, repeats, toxicity
from tests.llm.conftest import CLASH, LONG

ITEMS = "item_id long, text string"


def test_decontaminate(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "Short ONE"), (None, "漢字"), (2, None), (3, ""), (1, "x"), (4, " ".join(LONG.split()[5:16]))], ITEMS)
    got = {(r.doc_id, r.text): r for r in decontaminate.find_windows(odd_docs, items).collect()}
    assert got[3, "Short one."].hit_items == ["1"] and got[3, "Short one."].n_hit == 2
    assert got[1, None].n_words == 0 and not got[2, ""].contaminated
    assert got[4, LONG].hit_items == ["4"] and got[4, LONG].n_words == 40_000
    assert [r.hit_items for k, r in got.items() if k[0] == 8] == [[""]]
    clean = decontaminate.decontaminate(odd_docs, items)
    assert clean.columns == odd_docs.columns and sorted(r.doc_id or 0 for r in clean.collect()) == [0, 0, 1, 2]
    assert decontaminate.find_windows(odd_docs, items.limit(0)).filter("contaminated").isEmpty()
    assert decontaminate.find_windows(no_docs, items).isEmpty()


def test_decontaminate_in_blocks(spark, odd_docs, monkeypatch):
    items = spark.createDataFrame([(i, f"word{i} and{i % 61} word{i + 1}") for i in range(50)] + [(99, "short one")], ITEMS)
    rows = lambda **o: sorted(map(str, decontaminate.find_windows(odd_docs, items, **o).select("doc_id", "n_words", "n_hit", "hit_items", "hit_spans").collect()))
    assert rows(block_bytes=200) == rows()
    repeated = items.unionByName(spark.range(300).select(F.lit(99).cast("long").alias("item_id"), F.lit("short one").alias("text")))
    one, made = rows(), []
    items = repeated  # copies of an item neither fill a block nor change what is found
    monkeypatch.setattr(decontaminate, "window_sets", lambda texts, width, plain=decontaminate.window_sets: made.append(len(texts)) or plain(texts, width))
    assert rows(block_bytes=200) == one and len(made) > 2 and sum(made) == 51 and max(made) < 51
    assert decontaminate.find_windows(odd_docs.limit(0), items, block_bytes=200).isEmpty()


def test_mixing(odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == 11 and all(r.taken in (0, r.size, 2 * r.size) for r in rows)
    total = sum(r.size for r in rows)
    assert abs(sum({r.source: r.target for r in rows}.values()) - min(1.5 * total, 2 * total)) < 1e-3
    assert {r.source for r in rows} == {"a", "b", "z", None}
    again = mixing.mixed(odd_docs)
    assert again.columns == odd_docs.columns and again.count() == sum(r.copies for r in rows)
    assert mixing.mix(no_docs).isEmpty()


def test_mixing_is_near_target(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    got = mixing.mix(docs).groupBy("source", "target").agg(F.sum("taken").alias("n")).collect()
    assert all(0 <= r.target - r.n <= 0.002 * r.target + 1 for r in got)


def test_labelled_sample_is_bounded(spark):
    """One text an id, however many rows have it; bounded rows and bytes; the held-out fold and unlabelled ids stay out."""
    import zlib
    from sigmaflow.llm.kit import labelled_sample
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 5 + 1).cast("int")).alias("text"))
    hot = spark.range(500).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("hot "), F.col("id") % 3).alias("text"))
    docs = docs.unionByName(hot).unionByName(docs.filter("doc_id = 8").select("doc_id", F.repeat(F.lit("y"), 4000).alias("text")))
    labels = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic")).unionByName(spark.createDataFrame([(5, None), (None, 1), (6, 1)], "doc_id long, toxic long"))
    inside = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 != 2]
    every = labelled_sample(docs, labels, "toxic", 4, 2, 1000).collect()
    assert len(every) == len(inside) and sum(r.text.startswith("hot") for r in every) <= 1
    assert len(labelled_sample(docs, labels, "toxic", 4, 2, 50).collect()) == 50
    few = labelled_sample(docs, labels, "toxic", 4, 2, 1000, most_bytes=160).collect()
    assert 0 < sum(len(r.text) for r in few) <= 160 and len(few) < 170 and few == labelled_sample(docs.repartition(7), labels, "toxic", 4, 2, 1000, most_bytes=160).collect()
    assert labelled_sample(docs, labels.limit(0), "toxic", 4, 2, 50).isEmpty()


def test_toxicity(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 1, "plain words here. you vile fiend! more words").otherwise("plain words here. more of them. quite so").alias("text"))
    w = toxicity.train(docs, labels)
    got = {(r.doc_id, r.text): r for r in toxicity.score(odd_docs.unionByName(docs.filter("doc_id > 30"), allowMissingColumns=True), w).collect()}
    assert got[2, ""].toxicity == 0 and got[1, None].toxicity == 0
    bad = [r for k, r in got.items() if k[0] in (31, 33)]
    assert all(r.toxicity > 0.5 and "vile fiend" in r.text[r.toxic_sentences[0].start : r.toxic_sentences[0].end] for r in bad)
    assert got[32, "plain words here. more of them. quite so"].toxicity < 0.3
    none = toxicity.train(docs, labels.limit(0))
    assert {r.toxicity for r in toxicity.score(odd_docs, none).collect()} <= {0.0} | {r.toxicity for r in toxicity.score(odd_docs, none).filter("toxicity < 1e-9").collect()}
    assert toxicity.score(no_docs, w).isEmpty()
    assert toxicity.drop_toxic(odd_docs, labels).columns == odd_docs.columns


def test_quality(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1)], "doc_id long, quality int")
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 1, "Plain words in a sentence.").otherwise("$$$ ### !!! JUNK JUNK JUNK").alias("text"))
    m = quality.train(docs, labels)
    got = {r.doc_id: r.quality for r in quality.score(docs, m).collect()}
    assert min(v for k, v in got.items() if k % 2) > 0.5 > max(v for k, v in got.items() if not k % 2)
    assert quality.score(odd_docs, m).count() == 11 and quality.score(no_docs, m).isEmpty()
    none = quality.train(docs, labels.limit(0))
    assert {r.quality for r in quality.score(odd_docs, none).collect()} == {0.5}


def test_pairs_identity():
    import numpy as np
    rng = np.random.default_rng(1)
    dense, v, w = rng.normal(size=(1, 4)), rng.normal(size=(7, 3)), rng.normal(size=7)
    row, bucket = np.array([0, 0]), np.array([1, 2])
    x = np.concatenate([[0, 2**-0.5, 2**-0.5], dense[0]])
    want = w @ x + sum(v[i] @ v[j] * x[i] * x[j] for i in range(7) for j in range(i))
    assert abs(quality._pairs(row, bucket, dense, w, v)[0][0] - want) < 1e-9


def test_repeats(odd_docs, no_docs):
    got = [(r.doc_id, r.n_bytes, len(r.kept), [tuple(x) for x in r.removed]) for r in repeats.cut_repeats(odd_docs).collect()]
    n = len(LONG)
    assert (4, n, 0, [(0, n)]) in got and (5, n, 0, [(0, n)]) in got
    assert (1, 0, 0, []) in got and got.count((6, 1, 1, [])) == 2 and len(got) == 11
    assert repeats.cut_repeats(no_docs).isEmpty()


@pytest.mark.parametrize("group", [2000, 3])
def test_repeats_brute_force(spark, monkeypatch, group):
    """Shared passages with unlike surroundings; with a small group bound the counting way runs too."""
    import random
    rng = random.Random(11)
    some = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n))
    line, passage = some(420), some(900)
    texts = [some(rng.randint(0, 300)) + rng.choice([line, passage, passage[100:700], line[:405], ""]) + some(rng.randint(0, 300)) for _ in range(40)] + ["ab" * 500, "ab" * 420, passage + passage]
    raw = [t.encode() for t in texts]
    seen: dict[bytes, int] = {}
    for t in raw:
        for s in range(len(t) - 399):
            seen[t[s : s + 400]] = seen.get(t[s : s + 400], 0) + 1
    monkeypatch.setattr(repeats, "GROUP", group)
    got = {r.doc_id: r.kept for r in repeats.cut_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(raw):
        gone = {x for s in range(len(t) - 399) if seen[t[s : s + 400]] > 1 for x in range(s, s + 400)}
        assert bytes(got[i]) == bytes(b for x, b in enumerate(t) if x not in gone)


def test_jaccard(odd_docs, no_docs):
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard.similar(odd_docs).collect()), key=str)
    want = [(None, None, 0), (None, None, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 1), (5, 4, 1), (6, 6, 2), (6, 6, 2), (7, 6, 2), (8, 8, 0)]
    assert got == sorted(want, key=str)
    left = jaccard.drop_similar(odd_docs)
    assert left.columns == odd_docs.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 0, 1, 2, 3, 4, 6, 8]
    assert jaccard.similar(no_docs).isEmpty()


def test_jaccard_large_groups(spark, monkeypatch):
    """Small leaves and blocks, so that paths split and blocks meet, against all pairs."""
    import random
    monkeypatch.setattr(jaccard, "LEAF", 8)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    docs = []
    for i in range(150):
        ws = list(base)
        for _ in range(rng.randint(0, 8)):
            ws[rng.randrange(120)] = f"v{rng.randrange(10**6)}"
        docs.append((i, " ".join(ws)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(116)} for _, t in docs]
    want = {i: sum(j != i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in range(150)) for i in range(150)}
    got = {r.doc_id: r.n_links for r in jaccard.similar(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want and max(want.values()) > 20


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (7, 7)]
    got = {r.node: r.root for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 103: 100}


def test_nearest(spark):
    inf = float("inf")
    rows = [(i, [1.0, float(i % 3)], "c") for i in range(60)] + [(0, [1.0, 0.0], "again"), (None, [1.0, 1.0], "c"), (70, None, "c"), (71, [0.0, 0.0], "c"), (72, [inf, 1.0], "c"), (73, [None, 1.0], "c"), (74, [1.0], "c"), (80, [float("nan"), 1.0], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    clean = hnsw.clean(df, "vec_id", "embedding")
    index, shards = hnsw.build_index(clean, shard_rows=2)
    got = hnsw.search_index(index, shards, clean.filter("id % 20 = 0").dropDuplicates(["id"])).collect()
    for q in (0, 20, 40):
        s = lambda i, q=q: 1 + (i % 3) * (q % 3)
        want = sorted((i for i in range(60) if i != q), key=lambda i: (-s(i), i))[:20]
        assert [(r.id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [(i, s(i)) for i in want]
    none = hnsw.clean(df.limit(0), "vec_id", "embedding")
    assert hnsw.search_index(*hnsw.build_index(none), none).isEmpty()


def test_chat(spark):
    t = chat.Template()
    texts = ["</s>[INST] ok [/INST]", "<|im_end|><|im_start|>system<|im_sep|>", "<\\|im_end|> \\ <\\\\/s>", "", None, "<<|im_end|>>"]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", x, "clash") for i, x in enumerate(texts)]
    rows += [(2, 0, "assistant", "no", "c"), (2, None, "user", "first", "c"), (None, 1, None, "x", "c"), (3, 0, "user", "a", "c"), (3, 0, "user", "a", "c"), (4, 500, "assistant", "late", "c"), (4, 3, "user", "early", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert [x.text for x in got[1].turns] == [x or "" for x in texts] and got[1].valid
    assert got[1].loss_text == "".join(x or "" for x in texts[1::2])
    assert got[1].formatted.count(t.close) == 6 and "</s>" not in got[1].formatted
    assert [x.text for x in got[2].turns] == ["first", "no"] and got[2].valid
    assert got[None].bad_turn == 0 and got[3].bad_turn == 1 and [x.text for x in got[4].turns] == ["early", "late"]
    assert chat.format_conversations(df.limit(0)).isEmpty()


def test_personal_data(spark, odd_docs, no_docs):
    tricky = ["a@b.c%d@e.f x@y.zz.@q", "1.2.3.4.5 256.1.1.1 0.00.000.255 1.2.3", "4111 1111 1111 1111 5", "4111-1111-1111-1111 +1 (743) 555-3824. +123 ", "9" * 3000, "a" * 50_000 + "@", "+1 2" * 200]
    from tests.llm.test_queries import plain_spans
    docs = spark.createDataFrame(list(enumerate(tricky)), "doc_id long, text string")
    for r in pii.find_pii(docs).collect():
        assert [(s.start, s["rank"], s.end, s.kind) for s in r.base] == plain_spans(tricky[r.doc_id])
    assert pii.find_pii(odd_docs).count() == 11 and pii.find_pii(no_docs).isEmpty()
    got = pii.sanitise(odd_docs)
    assert got.columns == odd_docs.columns and {r.doc_id: r.text for r in got.filter("doc_id IN (1, 3, 8)").collect()} == {1: None, 3: "Short one.", 8: "é ü 漢字 \x01\x02 [EMAIL]"}


def test_words_touch_no_span(spark):
    """Words and spans of texts in which they lie side by side or run into each other, against comparing all with all."""
    import re
    texts = ["é1.2.3.4é abc+12345678901def x@y.zzé", "wörd@a.b.cö 4111 1111 1111 1111abc a@b.c1.2.3.4 \x04abc\x04", "+1 2345678901 4111111111111111 (ab) 256.1.1.1 word", "", "none at all"]
    texts.append(" ".join(f"p{i}@q.org {i}.1.2.3 word{i}" for i in range(500)))
    df = spark.createDataFrame([(i, x.replace("\x04", "\x03")) for i, x in enumerate(texts)], "i int, text string").withColumn("base", pii.base_spans(F.col("text")))
    for r in df.withColumn("words", pii._words(F.col("text"), F.col("base"))).collect():
        want = [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[^\W_]{3,}", r.text) if not any(m.start() < b.end and b.start < m.end() for b in r.base)]
        assert [tuple(w) for w in r.words] == want


def test_many_spans_in_linear_time(spark):
    """Twelve times the addresses take far less than 144 times as long."""
    import time
    took = []
    for n in (8_000, 8_000, 96_000):  # the first warms up
        df = spark.createDataFrame([(" ".join(f"p{i}@q.org word" for i in range(n)),)], "text string").withColumn("base", pii.base_spans(F.col("text")))
        begin = time.perf_counter()
        got = df.select(F.size("base"), F.size(pii._words(F.col("text"), F.col("base")))).first()
        took.append(time.perf_counter() - begin)
        assert tuple(got) == (n, n)
    assert took[2] < 40 * max(took[1], 0.2)


def _sure(n, n_t, n_e, d_e, n_te, threshold):
    """The rule, by search: the least true rate of the term that d_e texts don't rule out has the threshold's share."""
    import math
    q = n_te / n_e
    kl = lambda p: q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0)
    lo, hi = 0.0, q
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mid <= 0 or d_e * kl(mid) >= math.log(n) else (lo, mid)
    return lo > 0 and math.log2(lo * n / n_t) / math.log2(n / n_e) >= threshold


def test_disclosing_terms(spark):
    """Shares by the formula; a term everywhere discloses nothing, nor does one in too few different texts."""
    import math
    docs = [(i, f"the zarkov desk7 wrote to p@q.org about {i} the") for i in range(12)] + [(i, f"the weather of day{i} is the same") for i in range(12, 200)]
    docs += [(i, "a unique word for one@q.org") for i in range(200, 240)] + [(i, f"few{i} seldom or two@q.org {i}") for i in range(240, 243)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r.doc_id: {t.term for t in r.terms} for r in pii.find_pii(df).collect()}
    assert rows[0] == {"zarkov", "desk7", "wrote", "about"} and not rows[15]
    assert not rows[200] and not rows[240]  # forty copies are one text; three texts are too few
    near = spark.createDataFrame([(i, "e", t) for i in range(12) for t in ("zarkov", "the")], "rid long, entity string, term string")
    share = {r.term: r["share"] for r in pii.disclosing(df.withColumnRenamed("doc_id", "rid"), near, threshold=-9.0).collect()}
    assert abs(share["zarkov"] - 1) < 1e-9 and abs(share["the"] - math.log2(243 * 12 / (200 * 12)) / math.log2(243 / 12)) < 1e-9
    assert "[EMAIL]" in pii.sanitise(df).filter("doc_id = 0").first().text and "zarkov" not in pii.sanitise(df).filter("doc_id = 0").first().text


def test_disclosing_terms_in_all_documents(spark, monkeypatch):
    """By the formula over whole documents, in Python: pairs far apart, copies, and terms where no entity stands."""
    import re
    far = " ".join(f"fill{i} the" for i in range(200))
    texts = [f"Zarkov {far} p@q.org x{i % 12}" for i in range(13)] + ["p3@q.org and the lonely one", "we met ZARKOV and the lonely desk7", "desk7 call +1 (743) 555-3824", "é the x@y.de5 1.2.3.4"]
    texts += [f"the weather of day{i} is the same" for i in range(160)] + [f"p2@q.org at desk{i}" + " zarkov" * (i == 3) + " often" * (i > 0) for i in range(20)] + ["often " * (i % 7) for i in range(3)]
    plain = {i: [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W_]{3,}", x)] for i, x in enumerate(texts)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (pii.BROADCAST_ROWS, 0):  # 0: hashed, with hot terms salted
        monkeypatch.setattr(pii, "BROADCAST_ROWS", most)
        rows = {r.doc_id: r for r in pii.find_pii(docs).collect()}
        free = {i: [w for w in ws if not any(w[0] < b.end and b.start < w[1] for b in rows[i].base)] for i, ws in plain.items()}
        terms, n = set(), len(texts)
        for e in {b.entity for r in rows.values() for b in r.base}:
            held = [i for i, r in rows.items() if e in {b.entity for b in r.base}]
            for t in {w[2] for i in held for w in free[i]}:
                n_te, n_t = sum(t in {w[2] for w in free[i]} for i in held), sum(t in {w[2] for w in ws} for ws in plain.values())
                if _sure(n, n_t, len(held), len({texts[i] for i in held}), n_te, pii.THRESHOLD):
                    terms.add(t)
        assert {"zarkov", "often", "fill199"} <= terms and terms.isdisjoint({"the", "lonely", "desk7"})
        for i, r in rows.items():
            assert [tuple(x) for x in r.terms] == [w for w in free[i] if w[2] in terms]
    assert {r.text for r in pii.sanitise(docs).filter("doc_id = 14").collect()} == {"we met  and the lonely desk7"}


def test_order(spark, odd_docs, no_docs, tmp_path):
    got = order.sequences(odd_docs, length=64, rows=8)
    rows = got.collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert all(r.shard == r.slot // 8 and r.offset == r.slot % 8 * 64 and len(r.tokens) == 64 for r in rows)
    text = {}
    for r in sorted(rows, key=lambda r: (r.doc_id or 0, r.part)):
        text.setdefault(r.doc_id, []).append(bytes(r.tokens[: r.n_tokens]))
    assert b"".join(text[4]) == LONG.encode() + b"\xfe" and text[1] == [b"\xfe"] and text[6] == [b"x\xfe"] * 2
    assert sorted(map(str, rows)) == sorted(map(str, order.sequences(odd_docs.repartition(5), length=64, rows=8).collect()))
    path = str(tmp_path / "shards")
    order.write_shards(odd_docs, path, length=64, rows=8)
    assert [r.slot for r in order.read_from(spark, path, 20).limit(5).collect()] == [20, 21, 22, 23, 24]
    assert order.sequences(no_docs).isEmpty()


def test_order_of_copies(spark, monkeypatch):
    """Copies of a row get slots of their own, the same ones however many tasks make them; numbers go by key."""
    import numpy as np
    texts = {1: "b" * 100, 2: "a text", 3: "", 4: "c" * 64}
    copies = {1: 1, 2: 90, 3: 7, 4: 1}
    docs = spark.createDataFrame([(k, texts[k], "s") for k, m in copies.items() for _ in range(m)], "doc_id long, text string, source string").repartition(5)
    rows = lambda: sorted((r.slot, r.doc_id, r.part, r.n_tokens, bytes(r.tokens)) for r in order.sequences(docs, length=64, rows=8).collect())
    want = rows()
    monkeypatch.setattr(order, "COPIES", 4)
    assert rows() == want
    n = {k: len(x) // 64 + 1 for k, x in texts.items()}
    total = sum(n[k] * m for k, m in copies.items())
    assert [r[0] for r in want] == list(range(total))
    for k, slots in {k: {r[0] for r in want if r[1] == k} for k in texts}.items():
        assert len(slots) == n[k] * copies[k]
    every = {(r[1], r[2]): [] for r in want}
    for r in want:
        every[r[1], r[2]].append(r[0])
    # the first key has the first numbers, one for each part
    assert sorted(order.slots(np.arange(2), total).tolist()) == sorted(every[1, 0] + every[1, 1])


def test_shards_are_files_of_fixed_stride(spark, odd_docs, no_docs, tmp_path):
    """Every slot stands at byte (s % rows) * stride of its shard's file, and the parts of the index are ranges of slots."""
    import os
    want = {r.slot: r for r in order.sequences(odd_docs, length=64, rows=8).collect()}
    path = str(tmp_path / "shards")
    got = {r.slot: r for r in order.write_shards(odd_docs, path, length=64, rows=8).collect()}
    assert got == want and len(os.listdir(f"{path}/shards")) == -(-len(want) // 8)
    for slot, r in want.items():
        with open(order.shard_file(path, slot // 8), "rb") as f:
            f.seek(slot % 8 * 64)
            assert f.read(64) == bytes(r.tokens)
    assert sum(os.path.getsize(f"{path}/shards/{x}") for x in os.listdir(f"{path}/shards")) == 64 * len(want)
    parts = [sorted(r.slot for r in spark.read.parquet(f"{path}/index/{x}").collect()) for x in os.listdir(f"{path}/index") if x.endswith(".parquet")]
    parts = sorted(x for x in parts if x)
    assert len(parts) > 1 and all(x == list(range(x[0], x[-1] + 1)) for x in parts)
    for shard in range(2):  # a resume opens no file of an earlier shard
        os.remove(order.shard_file(path, shard))
    assert [r.slot for r in order.read_from(spark, path, 20).collect()] == list(range(20, len(want)))
    assert order.write_shards(no_docs, str(tmp_path / "none")).isEmpty()


def test_order_with_tokenizer(spark):
    import os
    path = "/opt/tokenizers/byte_bpe_50k.json"
    if not os.path.exists(path):
        pytest.skip("no tokenizer files")
    from tokenizers import Tokenizer
    docs = spark.createDataFrame([(1, "Hello there, world. " * 30), (2, None)], "doc_id long, text string")
    rows = sorted(order.sequences(docs, length=32, tokenizer=path).collect(), key=lambda r: (r.doc_id, r.part))
    import numpy as np
    ids = np.concatenate([np.frombuffer(r.tokens, "<u2")[: r.n_tokens] for r in rows if r.doc_id == 1])
    assert Tokenizer.from_file(path).decode(ids[:-1].tolist()) == "Hello there, world. " * 30


def test_pipeline_on_odd_documents(spark, odd_docs, no_docs, tmp_path):
    import corpus_pipeline as P
    spark.createDataFrame([(i, i % 2, i % 2) for i in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "x")], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        for step, fn in P.STAGES:
            docs = P.stage(fn(spark, docs, str(tmp_path)), f"{name}-{step}")
            assert step == "order" or docs.columns == odd_docs.columns
        assert (docs.count() > 0) == (name == "odd")
    assert len(CLASH) == 20 and hashlib.sha256(b"").hexdigest()[:4] == "e3b0"

"""Merkle manifest against a plain recursion: depths, lone nodes, copies, nulls, tampering."""

import hashlib
import zlib

import pytest

from sigmaflow.llm import merkle

COLS = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, tampered=False):
    text = row[4]
    if tampered and text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    values = [row[0], row[1], row[2], row[3], text]
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves):
    """The root, and for each leaf its path of (left, right) texts."""
    paths, level, of = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(level) > 1:
        up, members = [], []
        for a in range(0, len(level), 8):
            run = level[a : a + 8]
            for j in range(len(run)):
                for i in of[a + j]:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(H(*run))
            members.append([i for j in range(len(run)) for i in of[a + j]])
        level, of = up, members
    return level[0], paths


def plain(rows):
    first = lambda v: (v is not None, v if v is not None else 0)
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    groups = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (first(r[0]), plain_leaf(r))) for g in langs}
    trees = {g: plain_tree([plain_leaf(r) for r in rs]) for g, rs in groups.items()}
    root, upper = plain_tree([trees[g][0] for g in langs])
    out = []
    for g, up in zip(langs, upper, strict=True):
        for r, path in zip(groups[g], trees[g][1], strict=True):
            whole, h = path + up, plain_leaf(r, tampered=True)
            for left, right in whole:
                h = H(left, h, right)
            out.append((r[0], plain_leaf(r), trees[g][0], root, H(*(a + b for a, b in whole)), h, h == root))
    return sorted(map(str, out))


def got(spark, rows, tmp_path):
    spark.createDataFrame(rows, COLS).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    df = merkle.op13_merkle(spark, str(tmp_path))
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(str(tuple(r)) for r in df.collect())


def sample(n, lang, at=0):
    return [(at + i, f"s{i % 3}", lang, i, f"Text {i} Of é {lang}" if i % 5 else "lower only") for i in range(n)]


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 8}, {"a": 9, "b": 1}, {"a": 65, "b": 64, None: 2, "": 7}, {f"l{i:02d}": 1 + i % 3 for i in range(70)}])
def test_depths(spark, tmp_path, sizes):
    rows = [r for i, (g, n) in enumerate(sizes.items()) for r in sample(n, g, 1000 * i)]
    assert got(spark, rows, tmp_path) == plain(rows)


def test_copies_nulls_and_ties(spark, tmp_path):
    rows = sample(20, "a") + [(3, "x", "a", 1, "Copy")] * 30 + [(None, None, None, None, None)] * 3 + [(None, "s", "a", 0, ""), (3, "x", "a", None, "Copy"), (7, "s", None, 2, "X" * 100_000)]
    assert got(spark, rows, tmp_path) == plain(rows)


def test_many_copies_are_made_in_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "RUN", 7)
    rows = [(5, "x", "a", 1, "Copy")] * 50 + sample(3, "a")
    assert got(spark, rows, tmp_path) == plain(rows)


def test_empty_and_clashing(spark, odd_docs, no_docs, tmp_path):
    assert got(spark, [], tmp_path) == []
    named = odd_docs.withColumnsRenamed({"_row": "g", "_t": "at", "_key": "lang", "_text": "n_chars", "x0": "leaf", "x1": "path", "sid": "child"})
    rows = [(r.doc_id, r.source, "clash", "clash", r.text) for r in odd_docs.collect()]
    found = merkle.manifest(named)
    assert sorted(merkle_row["leaf"].hex() for merkle_row in found.collect()) == sorted(map(plain_leaf, rows))

"""Byte-level BPE: token ids of whole texts, and texts from token ids, from a ``tokenizers`` JSON file.

A text is cut at the added tokens' strings, then into words by the byte-level pattern. A word starts as its bytes'
symbols in a doubly linked list; a priority queue holds its neighbours' merges by (rank, place). The least entry is
popped; it is stale, and skipped, unless its left symbol is still there and the pair now standing there merges
to the same symbol. Otherwise the pair becomes that symbol, and the merges with its new neighbours enter the queue: n log n steps
for a word of n bytes, however long. Each task keeps the ids of the words it has met (at most ``KEPT_WORDS`` of up to
``KEPT_CHARS`` characters, and as many that it met before them); results don't depend on that. Decoding concatenates the ids' vocabulary strings,
maps their characters to bytes, and reads those as UTF-8 with replacement characters for broken sequences.

One pass over the table without a shuffle. What a task holds is the model (broadcast; the file is bounded by
``MODEL_BYTES``), its words and a batch.

Defined results: a null or empty text has no tokens; rows that repeat are encoded each; null token ids decode to the empty
text; an id outside the vocabulary decodes to nothing; columns named like the new ones are replaced, others stay; an empty table gives none.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigmaflow.llm.kit import as_bytes, prepare, scan, table

KEPT_WORDS = 250_000
KEPT_CHARS = 64
MODEL_BYTES = 64 << 20

# The byte-level word pattern, and the letters and numbers that Unicode got after version 16, which the
# tokenizers library treats as neither.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATER = ("558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE "
         "11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 "
         "18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 "
         "1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F")
_LATER = "".join("-".join(f"\\U{int(x, 16):08X}" for x in part.split("-")) for part in LATER.split())
_WORDS = regex.compile(PATTERN)
_WORDS_LATER = regex.compile(r"(?V1)" + PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]{_LATER}]")
                             .replace(r" ?\p{L}", rf" ?[\p{{L}}--[{_LATER}]]").replace(r" ?\p{N}", rf" ?[\p{{N}}--[{_LATER}]]"))
_ANY_LATER = re.compile(f"[{_LATER}]")


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it is printable Latin-1, otherwise the next from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class Words(dict):
    """Ids of words as little-endian 32-bit numbers, merged when first asked for."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe
        self.earlier: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        found = self.earlier.get(word)
        if found is None:
            ids = self.bpe.merge(word.encode())
            found = pack(f"<{len(ids)}I", *ids)
        if len(word) <= KEPT_CHARS:
            if len(self) >= KEPT_WORDS:
                self.earlier = dict(self)
                self.clear()
            self[word] = found
        return found


class Bpe:
    """Merges, vocabulary and added tokens of a byte-level BPE model."""

    def __init__(self, source: str):
        t = json.loads(source)
        model, pre = t["model"], t["pre_tokenizer"] or {}
        used = (model.get("type"), pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex", True), t.get("normalizer"))
        unused = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if used != ("BPE", "ByteLevel", False, True, None) or any(model.get(x) for x in unused):
            raise ValueError("only plain byte-level BPE models are read")
        vocab, chars = model["vocab"], byte_characters()
        self.first = [vocab[c] for c in chars]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: pair of ids -> (rank, id of what it becomes)
        self.merges = {vocab[a] << 32 | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.added = {a["content"]: a["id"] for a in t.get("added_tokens", []) if a["content"]}
        if any(a.get(x) for a in t.get("added_tokens", []) for x in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("only added tokens that are matched as they stand are read")
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        byte_of = {c: b for b, c in enumerate(chars)}
        strings = {**{i: s for s, i in vocab.items()}, **{i: s for s, i in self.added.items()}}
        self.strings = [b""] * (max(strings, default=-1) + 1)
        for i, s in strings.items():
            self.strings[i] = bytes(byte_of[c] for c in s) if all(c in byte_of for c in s) else s.encode()
        self.words = Words(self)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        ids, merges = [self.first[b] for b in word], self.merges
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        found = [merges.get(a << 32 | b) for a, b in zip(ids, ids[1:], strict=False)]
        queue = [(m[0], i, m[1]) for i, m in enumerate(found) if m]
        heapify(queue)
        while queue:
            _, i, made = heappop(queue)
            j = after[i]
            if ids[i] < 0 or j < 0:
                continue
            m = merges.get(ids[i] << 32 | ids[j])
            if m is None or m[1] != made:
                continue
            ids[i], ids[j], k, h = made, -1, after[j], before[i]
            after[i] = k
            if k >= 0:
                before[k] = i
                m = merges.get(made << 32 | ids[k])
                if m:
                    heappush(queue, (m[0], i, m[1]))
            if h >= 0:
                m = merges.get(ids[h] << 32 | made)
                if m:
                    heappush(queue, (m[0], h, m[1]))
        return [x for x in ids if x >= 0]

    def _plain(self, text: str) -> bytes:
        pattern = _WORDS if text.isascii() or not _ANY_LATER.search(text) else _WORDS_LATER
        return b"".join(map(self.words.__getitem__, pattern.findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers."""
        if self.cut is None:
            return self._plain(text)
        parts = self.cut.split(text)
        if len(parts) == 1:
            return self._plain(text)
        return b"".join(np.array([self.added[p]], "<u4").tobytes() if i % 2 else self._plain(p) for i, p in enumerate(parts))

    def decode(self, ids: bytes) -> str:
        """The text of ids; nothing for ids outside the vocabulary."""
        strings, n = self.strings, len(self.strings)
        each = np.frombuffer(ids, "<u4")
        if len(each) and each.max() >= n:
            each = each[each < n]
        return b"".join(map(strings.__getitem__, each.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _model(source: str) -> Bpe:
    return Bpe(source)


def read_model(spark: SparkSession, tokenizer: str):
    """The tokenizer file, broadcast: from the driver's disk if it is there, otherwise from any store that Spark reads."""
    if os.path.exists(tokenizer):
        if os.path.getsize(tokenizer) > MODEL_BYTES:
            raise ValueError(f"{tokenizer} is larger than {MODEL_BYTES} bytes")
        with open(tokenizer, encoding="utf-8") as file:
            source = file.read()
    else:
        found = spark.read.format("binaryFile").load(tokenizer)
        if found.select("length").first()[0] > MODEL_BYTES:
            raise ValueError(f"{tokenizer} is larger than {MODEL_BYTES} bytes")
        source = found.select("content").first()[0].decode()
    _model(source)  # refuse here what can't be read
    return spark.sparkContext.broadcast(source)


def encode(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """The rows with ``tokens``, the ids of the text as little-endian unsigned 32-bit numbers, and ``n_tokens``."""
    shared = read_model(docs.sparkSession, tokenizer)

    def run(batch: pa.RecordBatch) -> dict:
        bpe = _model(shared.value)
        made = [bpe.encode(t.decode("utf-8", "replace")) for t in as_bytes(batch.column(batch.schema.get_field_index(text)))]
        return {"tokens": made, "n_tokens": [len(t) // 4 for t in made]}

    keep = [c for c in docs.columns if c not in ("tokens", "n_tokens")]
    return scan(docs.select(*(F.col(f"`{c}`") for c in keep)), run, [("tokens", T.BinaryType()), ("n_tokens", T.LongType())], keep)


def decode(rows: DataFrame, tokenizer: str, tokens: str = "tokens") -> DataFrame:
    """The rows with ``decoded``, the text of their ids."""
    shared = read_model(rows.sparkSession, tokenizer)

    def run(batch: pa.RecordBatch) -> dict:
        bpe = _model(shared.value)
        return {"decoded": [bpe.decode(t or b"") for t in batch.column(batch.schema.get_field_index(tokens)).to_pylist()]}

    keep = [c for c in rows.columns if c != "decoded"]
    return scan(rows.select(*(F.col(f"`{c}`") for c in keep)), run, [("decoded", T.StringType())], keep)


def op12_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Digests of the ids of every document and of what they decode to."""
    prepare(spark)
    if tokenizer is None:
        import public_tokenizers
        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    made = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer).drop("text")
    return decode(made, tokenizer).select("doc_id", "n_tokens", F.sha2("tokens", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

"""Personal data: base patterns, and terms that disclose them (DataFrame operations only).

Base spans are e-mail addresses, IPv4 addresses, card and phone numbers, found by
pattern and checked (parts, digits, Luhn). Each value is a protected entity e.

Information-theoretic sanitisation: the words of documents that hold an entity, outside its spans, are
terms t. Over all documents, n_e hold the entity, n_t the term anywhere, n_te both. Pointwise mutual
information log2(N n_te / (n_t n_e)), against the entity's information log2(N / n_e), is the share of the
entity that the term gives away. A term is a span of kind ``term`` wherever it stands, in documents with and
without the entity, when its share of any entity is ``THRESHOLD`` or more beyond the sampling error of
n_te / n_e: that share is estimated from d_e different texts (copies are no further evidence), and the
bound of large deviations, d_e KL(n_te / n_e || rate) >= ln N, must rule out, but for a chance of 1 / N, that
the true rate is only the one at which the share would be the threshold. It follows that no entity in
fewer than 1 / (1 - threshold) different texts and no term in fewer documents can pass; these are left out
before pairs are counted.
``sanitise`` replaces base spans by their kind, generalises terms with digits and removes other terms.

Defined results: a null or empty text has no spans; rows are documents, so repeated rows count
as documents and get the same spans; an empty table gives no rows; other columns are ignored by
``find_pii`` and kept by ``sanitise``. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmaflow.llm.kit import prepare, stage, table, text_keys

# Fixed patterns. They find the same matches as the plain forms, without backtracking over long runs:
# a match can only begin where a run of its first characters begins, or where the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # fourteen digits or more; shorter chains of digits would be dropped in any case
    "card": r"(?<![0-9])(?<![0-9][\x20-])(?=(?:[0-9][\x20-]?){13}[0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
LETTERS = r"\p{L}\p{N}"
TERM = f"[{LETTERS}]{{3,}}"
#: Parts of a text whose offsets are summed at once.
BLOCK = 64
THRESHOLD = 0.75
BROADCAST_ROWS = 500_000
#: A term or entity in more than one of so many documents is hot; its rows are dealt over ``SALTS`` parts.
HOT = 1000
SALTS = 64


def _let(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once."""
    return F.transform(F.array(value), fn)[0]


def _parts(text: Column, pattern: str) -> Column:
    """The text cut before all matches, each match ended by U+0002; the text must not hold U+0001 and U+0002."""
    return F.split(F.regexp_replace(text, pattern, "\u0001$0\u0002"), "\u0001")


def _marked(text: Column, pattern: str) -> Column:
    """(start, end, value) of all matches, in time linear in the text: offsets are summed by blocks of parts."""
    def block(parts: Column, at: Column, i: Column) -> Column:
        walk = F.aggregate(
            F.slice(parts, i * BLOCK + 2, F.lit(BLOCK)),
            F.struct(at.alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out")),
            lambda a, p: F.struct(
                (a.at + F.length(p) - 1).alias("at"),
                F.concat(a.out, F.array(F.struct(a.at.alias("start"), (a.at + F.locate("\u0002", p) - 1).alias("end"), F.substring_index(p, "\u0002", 1).alias("value")))).alias("out")))
        return walk.out

    def located(parts: Column) -> Column:
        n = F.greatest(F.floor((F.size(parts) - 2) / BLOCK).cast("int"), F.lit(0))
        ends = F.aggregate(F.sequence(F.lit(0), n), F.array(F.length(parts[0])), lambda a, i: F.concat(a, F.array(
            F.aggregate(F.slice(parts, i * BLOCK + 2, F.lit(BLOCK)), F.element_at(a, -1), lambda x, p: x + F.length(p) - 1))))
        return _let(ends, lambda e: F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: block(parts, F.get(e, i), i))))

    return _let(_parts(text, pattern), located)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + _luhn_digit(digits, i))
    return total % 10 == 0


def _luhn_digit(digits: Column, i: Column) -> Column:
    d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
    return F.when(d > 9, d - 9).otherwise(d)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substr(F.ltrim(p, F.lit("0")), F.lit(1), F.lit(3)).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        n = F.length(_digits(value))
        return F.when((n >= 14) & (n <= 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _entity(kind: str, value: Column) -> Column:
    return F.concat(F.lit(kind + ":"), F.lower(value) if kind == "email" else value if kind == "ip" else _digits(value))


_GUARD = {"email": "@", "phone": "+"}


def _of_kind(text: Column, rank: int, kind: str) -> Column:
    valid = F.filter(_marked(text, PATTERNS[kind]), lambda s: _valid(kind, s.value))
    spans = F.transform(valid, lambda s: F.struct(s.start.alias("start"), F.lit(rank).alias("rank"), s.end.alias("end"), F.lit(kind).alias("kind"), _entity(kind, s.value).alias("entity")))
    mark = F.contains(text, F.lit(_GUARD[kind])) if kind in _GUARD else F.rlike(text, F.lit(r"[0-9]\.[0-9]" if kind == "ip" else r"[0-9][\x20-]?[0-9]"))
    return F.when(mark, spans).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,entity:string>>"))


def base_spans(text: Column) -> Column:
    """array<(start, rank, end, kind, entity)> by start, then kind as listed."""
    return F.array_sort(F.concat(*(_of_kind(text, rank, kind) for rank, kind in enumerate(KINDS))))


def _touched(text: Column, kind: str) -> Column:
    """For each word, whether a valid match of the kind covers some of it."""
    def part(p: Column) -> Column:
        value, rest = F.substring_index(p, "\u0002", 1), F.substring_index(p, "\u0002", -1)
        covered = F.when(_valid(kind, value), F.regexp_replace(value, f"[{LETTERS}]", "\u0004")).otherwise(value)
        return F.when(F.contains(p, F.lit("\u0002")), F.concat(covered, rest)).otherwise(p)

    # a letter is covered by one sign that counts as a letter, so that words begin and end where they did
    covered = F.array_join(F.transform(_parts(text, PATTERNS[kind]), part), "")
    return F.transform(F.regexp_extract_all(covered, F.lit(f"[{LETTERS}\u0004]{{3,}}"), F.lit(0)), lambda w: F.contains(w, F.lit("\u0004")))


def _words(text: Column, spans: Column) -> Column:
    """All words that touch no span: array<(term, start, end)>; words and spans meet in one pass over the text for each kind."""
    found = _marked(text, TERM)
    touched = F.struct(*(F.when(F.exists(spans, lambda s: s.kind == kind), _touched(text, kind)).alias(kind) for kind in KINDS))  # noqa: B023

    def free(t: Column) -> Column:
        def apart(_: Column, i: Column) -> Column:
            hit = F.lit(False)
            for kind in KINDS:
                hit = hit | F.coalesce(F.get(t[kind], i), F.lit(False))
            return ~hit
        return F.filter(found, apart)

    kept = F.when(F.size(spans) == 0, found).otherwise(_let(touched, free))
    return F.transform(kept, lambda w: F.struct(F.lower(w.value).alias("term"), w.start.alias("start"), w.end.alias("end")))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _meet(rows: DataFrame, known: DataFrame, on: str, hot: DataFrame, salt: Column) -> DataFrame:
    """Rows joined with ``known`` (a row for each value of ``on``): broadcast when counted small, else hashed.

    Hashed rows of the values in ``hot`` are dropped before the shuffle when not known, and dealt over ``SALTS`` parts by ``salt`` when known.
    """
    if known.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(known), on)
    hot = hot.join(known.select(on, F.lit(SALTS).alias("_w")), on, "left").withColumn("_w", F.coalesce("_w", F.lit(0)))
    dealt = rows.join(F.broadcast(hot), on, "left").filter("_w IS NULL OR _w > 0")
    dealt = dealt.withColumn("_salt", F.pmod(F.xxhash64(salt), F.coalesce("_w", F.lit(1)).cast("long"))).drop("_w")
    copies = known.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_w", F.lit(1)).cast("long") - 1))).drop("_w")
    return dealt.join(copies, [on, "_salt"]).drop("_salt")


def _share(n: int) -> tuple[Column, Column]:
    """The share of the entity that the term gives away, and the entity's information."""
    info = F.log2(F.lit(float(n)) / F.col("n_e"))
    return F.log2(F.lit(float(n)) * F.col("n_te") / (F.col("n_t") * F.col("n_e"))) / info, info


def _beyond_chance(n: int, threshold: float) -> Column:
    """Whether the share is the threshold or more, beyond the sampling error of n_te / n_e at a chance of 1 / n."""
    rate = F.col("n_t") / F.lit(float(n)) * F.pow(F.lit(float(n)) / F.col("n_e"), F.lit(threshold))  # of n_te / n_e at the threshold
    q = F.col("n_te") / F.col("n_e")
    apart = q * F.ln(q / rate) + F.when(q < 1, (1 - q) * F.ln((1 - q) / (1 - rate))).otherwise(0.0)
    return F.when((rate < 1) & (q >= rate), F.col("d_e") * apart >= F.ln(F.lit(float(n)))).otherwise(False)


def least_support(threshold: float) -> float:
    """Different texts of an entity, and documents of a term, below which no pair can pass: there d_e KL <= n_te (1 - threshold) ln N."""
    return 1 / (1 - threshold) - 1e-9 if threshold < 1 else float("inf")


def _disclosing(pairs: DataFrame, entities: DataFrame, n: int, threshold: float) -> DataFrame:
    """Pairs above the threshold. pairs: entity, term, n_te, n_t; entities: entity, n_e, d_e."""
    hot = entities.filter(F.col("n_e") * HOT > n).select("entity")
    got = _meet(pairs, entities, "entity", hot, F.col("term"))
    share, info = _share(n)
    return got.filter(info > 0).withColumn("share", share).filter(_beyond_chance(n, threshold)).select("entity", "term", "share")


def disclosing(docs: DataFrame, near: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(entity, term) pairs above the threshold, with their share.

    docs: rid, text of all documents; near: rid, entity, term, one row of each.
    """
    n_t = docs.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    held = near.select("rid", "entity").distinct().join(docs.select("rid", *text_keys()), "rid")
    entities = held.groupBy("entity", "x0", "x1").count().groupBy("entity").agg(F.sum("count").alias("n_e"), F.count("*").alias("d_e"))
    pairs = near.groupBy("entity", "term").agg(F.count("*").alias("n_te"))
    return _disclosing(pairs.join(n_t, "term"), entities, docs.count(), threshold)


def _disclosing_terms(base: DataFrame, held: DataFrame, entities: DataFrame, hot: DataFrame, words: DataFrame, n: int, threshold: float) -> DataFrame:
    """Terms that disclose any entity. held: entity, x0, x1, m, the documents of that text; words: term, n_t, those that may."""
    entities = entities.filter(F.col("d_e") >= least_support(threshold))
    often = entities.filter(F.col("n_e") * HOT > n).select("entity")
    of = _meet(held, entities.select("entity"), "entity", often, F.col("x0")).groupBy("x0", "x1").agg(F.first("m").alias("m"), F.collect_list("entity").alias("held"))
    texts = base.filter(F.size("base") > 0).select("x0", "x1", "text", "base").dropDuplicates(["x0", "x1"]).join(of, ["x0", "x1"])
    rows = texts.select("x0", "m", "held", F.explode(F.array_distinct(F.transform(_words(F.col("text"), F.col("base")), lambda w: w.term))).alias("term"))
    near = _meet(rows, words, "term", hot, F.col("x0")).select("term", "n_t", "m", F.explode("held").alias("entity"))
    pairs = near.groupBy("entity", "term").agg(F.sum("m").alias("n_te"), F.first("n_t").alias("n_t"))
    return _disclosing(pairs, entities, n, threshold).select("term").distinct()


def find_pii(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: the key, x0 and x1 (of the text), base and terms (arrays of spans)."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    clean = docs.select("_key", *text_keys(), F.translate("text", "\u0001\u0002\u0004", "\u0003\u0003\u0003").alias("text"))
    base = stage(clean.withColumn("rid", F.monotonically_increasing_id()).withColumn("base", base_spans(F.col("text"))), "pii-base")
    n = base.count()
    held = base.select("x0", "x1", F.explode(F.array_distinct(F.transform("base", lambda s: s.entity))).alias("entity"))
    held = stage(held.groupBy("entity", "x0", "x1").agg(F.count("*").alias("m")), "pii-held")
    entities = stage(held.groupBy("entity").agg(F.sum("m").alias("n_e"), F.count("*").alias("d_e")), "pii-entities")
    most = entities.agg(F.max("n_e")).first()[0] or 0
    # n_te is n_e at most, so that no pair with a term in more documents reaches the threshold
    limit = n * (most / max(n, 1)) ** max(threshold, 0.0) * (1 + 1e-9)
    counted = base.select((F.size("base") > 0).alias("_in"), F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"), F.max("_in").alias("_in"))
    may, often = F.col("_in") & F.col("n_t").between(least_support(threshold), limit), F.col("n_t") * HOT > n
    counted = stage(counted.withColumn("may", may).withColumn("hot", often).filter("may OR hot"), "pii-words")
    hot = counted.filter("hot").select("term")
    terms = stage(_disclosing_terms(base, held, entities, hot, counted.filter("may").select("term", "n_t"), n, threshold), "pii-disclosing")
    words = base.select("rid", F.explode(_words(F.col("text"), F.col("base"))).alias("w")).select("rid", "w.*")
    spans = _meet(words, terms, "term", hot, F.col("rid")).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "end", "term"))).alias("terms"))
    out = base.drop("text").join(spans, "rid", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,term:string>>")))
    return out.select(F.col("_key").alias(key), "x0", "x1", "base", "terms")


def sanitise(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with every span replaced: [EMAIL], [IP], [CARD], [PHONE]; [NUMBER] for terms with digits; other terms removed."""
    found = find_pii(docs, key=key, text=text, **options)
    spans = found.filter((F.size("base") > 0) | (F.size("terms") > 0)).dropDuplicates(["x0", "x1"]).select(
        F.col("x0").alias("_x0"), F.col("x1").alias("_x1"),
        F.array_sort(F.concat(F.transform("base", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.concat(F.lit("["), F.upper(s.kind), F.lit("]")).alias("by"))),
                              F.transform("terms", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.when(F.rlike(s.term, F.lit("[0-9]")), F.lit("[NUMBER]")).otherwise("").alias("by"))))).alias("_spans"))
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).isNull().alias("_null"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    df = packed.select("*", *text_keys("_t")).join(spans, (F.col("x0") == F.col("_x0")) & (F.col("x1") == F.col("_x1")), "left")
    walk = F.aggregate("_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), lambda a, s: F.struct(
        F.greatest(a.at, s.end).alias("at"),
        F.when(s.start < a.at, a.out).otherwise(F.concat(a.out, F.substr("_t", a.at + 1, s.start - a.at), s.by)).alias("out")))
    df = df.withColumn("_w", walk)
    new = F.when(F.col("_spans").isNull(), F.col("_t")).otherwise(F.concat("_w.out", F.substr("_t", F.col("_w.at") + 1, F.length("_t"))))
    return df.select(F.col("_row").withField(f"`{text}`", F.when(~F.col("_null"), new)).alias("_row")).select("_row.*")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest of the base spans, and all spans of every document."""
    found = find_pii(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    name = lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))
    every = F.array_sort(F.concat(F.transform("base", lambda s: F.struct(s.start.alias("start"), s.rank.alias("rank"), s.end.alias("end"), s.kind.alias("kind"))),
                                  F.transform("terms", lambda s: F.struct(s.start.alias("start"), F.lit(len(KINDS)).alias("rank"), s.end.alias("end"), F.lit("term").alias("kind")))))
    return found.select("doc_id", *map(count, KINDS), F.sha2(F.concat_ws(",", F.transform("base", name)), 256).alias("base_sha256"),
                        F.concat_ws(",", F.transform(every, name)).alias("spans"), F.size("terms").cast("long").alias("n_term"))

"""Operator 5, information-theoretic sanitisation; DataFrame operations only.

Base kinds are found by expressions whose matches, and the gaps between them,
give every span's place without leaving the JVM. The method adds terms: words
that share documents with a protected entity, anywhere in them, are candidates,
and the whole corpus says how much they disclose. A term discloses an entity if
the two were seen together in at least MIN_CONTEXTS different contexts (the words
beside the entity and beside the term, so that copies count once; or the term
itself stood beside the entity in so many), if P(entity | term) over all
documents is at least MIN_SHARE, if knowing the term adds at least MIN_GAIN of
the bits that can be added, log2(P(entity | term) / P(entity)) of
log2(1 / P(entity)), and if that is no chance: the term's documents together
give at least MIN_BITS bits against P(entity), so that as many would hold the
entity by chance with a probability of 2 ** -MIN_BITS at most. Words of e-mail
addresses do not count as words of a document. All whole
words that are such terms are spans of kind `term`, in every document.
`sanitise` replaces spans by their kind in brackets and removes terms.

Null and empty texts have no spans; repeated rows are reported each; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, documents, id_key, stored, text_key, texts, tidy

_LOCAL, _LABEL = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
#: The base kinds in their order. Runs are possessive and begin where a run or the last match ends, so that no text takes quadratic time.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = "term"
#: A term is a word of letters and digits that begins with a letter.
_WORD = r"(?<![\p{L}\p{N}])\p{L}[\p{L}\p{N}]*+"
#: Contexts are made of longer words.
_LONG_WORD = r"(?<![\p{L}\p{N}])\p{L}[\p{L}\p{N}]{3,}"
NEAR_WORDS, NEAR_CHARS = 3, 64
MIN_CONTEXTS, MIN_SHARE, MIN_GAIN, MIN_BITS = 3, 0.5, 0.5, 8.0
#: Candidate terms are broadcast up to this many (about 40 bytes each); beyond that they are joined by a shuffle.
BROADCAST_TERMS = 500_000
#: Disclosing terms that are literals of the expressions, a hash set that every text's words are held against; beyond that words are joined with them by a shuffle.
LITERAL_TERMS = 2_000
_STRETCH = 512


def _sums(values: Column, first: Column) -> Column:
    """Inclusive running sums of a short array of longs."""
    start = F.struct(F.array().cast("array<bigint>").alias("out"), first.alias("sum"))
    return F.aggregate(values, start, lambda acc, x: F.struct(F.concat(acc["out"], F.array(acc["sum"] + x)).alias("out"), (acc["sum"] + x).alias("sum")), lambda acc: acc["out"])


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, r"[^0-9]", "")


def _accepted(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.coalesce(F.when(F.length(F.regexp_replace(p, "^0+", "")) <= 3, p.cast("decimal(38,0)") <= 255), F.lit(False)))
    if kind == "card":
        return F.when(F.length(_digits(match)).between(12, 19), F.call_function("luhn_check", _digits(match))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _add_spans(df: DataFrame, name: str, pattern: Column, number: int, may: Column) -> DataFrame:
    """Adds array<struct<start, kind, end, value, before, after>> of an expression's matches, leftmost and without overlap.

    Lambdas are evaluated for each element, with all that they refer to; so each
    array is a column of its own first, and lambdas refer to their arguments
    only. Running sums of gaps and matches are made in stretches, so that long
    arrays do not take quadratic time.
    """
    text, zero = F.col("text"), F.lit(0).cast("bigint")
    long_ = lambda c: F.transform(c, lambda x: F.char_length(x).cast("bigint"))
    some = F.size("_m") > 0
    df = df.withColumn("_m", F.when(may, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("_g", F.when(some, F.split(text, pattern, -1)))
    df = df.withColumn("_step", F.when(some, F.zip_with(long_("_g"), F.concat(F.array(zero), long_("_m")), lambda g, m: g + m)))
    stretches = F.sequence(F.lit(0), F.floor((F.size("_step") - 1) / _STRETCH).cast("int"))
    df = df.withColumn("_parts", F.when(some, F.transform(stretches, lambda b: F.slice("_step", b * _STRETCH + 1, F.lit(_STRETCH)))))
    before = _sums(F.transform("_parts", lambda p: F.aggregate(p, zero, lambda acc, x: acc + x)), zero)
    df = df.withColumn("_before", F.when(some, F.concat(F.array(zero), before)))
    starts = F.flatten(F.zip_with("_parts", F.slice("_before", F.lit(1), F.size("_parts")), _sums))
    zipped = F.arrays_zip(F.col("_m").alias("m"), starts.alias("s"), F.col("_g").alias("g"), F.slice("_g", F.lit(2), F.size("_g")).alias("h"))
    spans = F.transform(
        F.filter(zipped, lambda z: z["m"].isNotNull()),
        lambda z: F.struct(
            z["s"].alias("start"),
            F.lit(number).alias("kind"),
            (z["s"] + F.char_length(z["m"])).alias("end"),
            z["m"].alias("value"),
            F.right(z["g"], F.lit(NEAR_CHARS)).alias("before"),
            F.left(z["h"], F.lit(NEAR_CHARS)).alias("after"),
        ),
    )
    return df.withColumn(name, F.when(some, spans).otherwise(F.array().cast(_SPANS))).drop("_m", "_g", "_step", "_parts", "_before")


_SPANS = "array<struct<start: bigint, kind: int, end: bigint, value: string, before: string, after: string>>"


def with_base_spans(docs: DataFrame) -> DataFrame:
    """Adds _spans: the accepted base spans by start, then kind. The text must not be null."""
    digit = F.col("text").rlike("[0-9]")
    may = {"email": F.contains(F.col("text"), F.lit("@")), "phone": F.contains(F.col("text"), F.lit("+")), "ip": digit, "card": digit}
    for n, kind in enumerate(KINDS):
        docs = _add_spans(docs, f"_{kind}", F.lit(PATTERNS[kind]), n, may[kind])
    accepted = [F.filter(f"_{k}", _accept(k)) for k in KINDS]
    return docs.withColumn("_spans", F.sort_array(F.concat(*accepted))).drop(*(f"_{k}" for k in KINDS))


def _accept(kind: str):
    return lambda s: _accepted(kind, s["value"])


def _contexts(spanned: DataFrame) -> DataFrame:
    """A row for each entity in each document: entity, context (a hash of the words beside it) and those words."""
    one = spanned.filter(F.size("_spans") > 0).select("_id", "_text", F.explode("_spans").alias("s"))
    cut_before = F.when(F.length("s.before") >= NEAR_CHARS, F.regexp_replace("s.before", r"^\S*+", "")).otherwise(F.col("s.before"))
    cut_after = F.when(F.length("s.after") >= NEAR_CHARS, F.regexp_replace("s.after", r"(?<!\S)\S++$", "")).otherwise(F.col("s.after"))
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(_LONG_WORD), F.lit(0))
    before, after = words(cut_before), words(cut_after)
    near = F.concat(F.slice(before, F.greatest(F.size(before) - NEAR_WORDS + 1, F.lit(1)), F.lit(NEAR_WORDS)), F.slice(after, F.lit(1), F.lit(NEAR_WORDS)))
    entity = F.xxhash64(F.col("s.kind"), F.lower(F.col("s.value")))
    return one.select("_id", "_text", entity.alias("_entity"), near.alias("_near")).withColumn("_context", F.xxhash64("_near"))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def _own_words(text: Column) -> Column:
    """The words of a text outside of its e-mail addresses, the only base kind with letters."""
    return _words(F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, F.lit(PATTERNS["email"]), F.lit(" "))).otherwise(text))


def _entity_documents(spanned: DataFrame, contexts: DataFrame, proposed: DataFrame) -> DataFrame:
    """_id, _text, _entity, _copies (of the row), _beside (a hash of the entity's contexts there), _n_entity, of entities that may have terms."""
    copies = spanned.filter(F.size("_spans") > 0).groupBy("_id", "_text").agg(F.count("*").alias("_copies"))
    each = contexts.groupBy("_id", "_text", "_entity").agg(F.xxhash64(F.sort_array(F.collect_set("_context"))).alias("_beside")).join(copies, ["_id", "_text"])
    n_entity = each.groupBy("_entity").agg(F.count("*").alias("_n_docs"), F.sum("_copies").alias("_n_entity"))
    kept = n_entity.join(proposed.select("_entity").distinct().withColumn("_near", F.lit(True)), "_entity", "left").filter((F.col("_n_docs") >= MIN_CONTEXTS) | F.col("_near"))
    return each.join(kept.select("_entity", "_n_entity"), "_entity")


def _joint_counts(keyed: DataFrame, spanned: DataFrame) -> DataFrame:
    """_entity, _term, _n_both, _n_term, _n_entity: documents with both, anywhere in their texts, and with either, of the pairs with enough contexts and share."""
    contexts = stored(_contexts(spanned), "contexts")
    near = contexts.select("_entity", "_context", F.explode("_near").alias("_term")).distinct()
    proposed = near.groupBy("_entity", "_term").agg(F.count("*").alias("_n")).filter(F.col("_n") >= MIN_CONTEXTS).select("_entity", "_term")
    proposed = stored(proposed, "proposed")
    entities = stored(_entity_documents(spanned, contexts, proposed), "entity_documents")
    held = entities.groupBy("_id", "_text").agg(F.max("_copies").alias("_copies"))

    # words of documents with entities, with the words beside them
    some = spanned.filter(F.size("_spans") > 0).select("_id", "_text", "_w").dropDuplicates(["_id", "_text"])
    zipped = F.arrays_zip(F.col("_w").alias("w"), F.concat(F.array(F.lit("")), F.col("_w")).alias("p"), F.slice("_w", F.lit(2), F.size("_w")).alias("n"))
    inside = some.select("_id", "_text", F.explode(zipped).alias("_z")).filter("_z.w is not null")
    inside = inside.groupBy("_id", "_text", F.col("_z.w").alias("_term")).agg(F.min(F.xxhash64("_z.p", "_z.n")).alias("_around"))
    inside = stored(inside.join(held, ["_id", "_text"]), "entity_words")

    # a term is in at least as many documents as it shares with one entity, so most common words are out before pairs are made
    n_inside = inside.groupBy("_term").agg(F.count("*").alias("_n_docs"), F.sum("_copies").alias("_n_inside"))
    n_term = keyed.select(F.explode(F.array_distinct(_own_words(F.col("text")))).alias("_term")).groupBy("_term").agg(F.count("*").alias("_n_term"))
    wanted = n_inside.join(n_term, "_term").filter(F.col("_n_inside") >= MIN_SHARE * F.col("_n_term"))
    wanted = wanted.join(proposed.select("_term").distinct().withColumn("_near", F.lit(True)), "_term", "left").filter((F.col("_n_docs") >= MIN_CONTEXTS) | F.col("_near"))
    wanted = stored(wanted.select("_term", "_n_term"), "candidate_terms")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_TERMS else wanted

    pairs = inside.drop("_copies").join(wanted, "_term").join(entities, ["_id", "_text"]).filter(F.col("_n_entity") >= MIN_SHARE * F.col("_n_term"))
    # by context first, so that no pair's documents meet in one task
    pairs = pairs.groupBy("_entity", "_term", "_n_term", "_n_entity", F.xxhash64("_beside", "_around").alias("_context")).agg(F.sum("_copies").alias("_n"))
    pairs = pairs.groupBy("_entity", "_term", "_n_term", "_n_entity").agg(F.sum("_n").alias("_n_both"), F.count("*").alias("_contexts")).filter(F.col("_n_both") >= MIN_SHARE * F.col("_n_term"))
    pairs = pairs.join(proposed.withColumn("_near", F.lit(True)), ["_entity", "_term"], "left")
    return pairs.filter((F.col("_contexts") >= MIN_CONTEXTS) | F.col("_near")).drop("_contexts", "_near")


def _spanned(keyed: DataFrame) -> DataFrame:
    """doc_id, _id, _text, _spans of all documents and _w, the words of those with spans, stored, so that spans are looked for once."""
    words = F.when(F.size("_spans") > 0, _own_words(F.col("text"))).alias("_w")
    return stored(keyed.select("doc_id", "_id", "_text", "_spans", words), "spans")


def disclosing_terms(spanned: DataFrame, keyed: DataFrame) -> DataFrame:
    """_term: all disclosing terms. keyed: documents with text, _id and _text, spanned: their spans and words."""
    total = spanned.agg(F.count("*").alias("_n"))
    share, base = F.col("_n_both") / F.col("_n_term"), F.col("_n_entity") / F.col("_n")
    gain = F.log2(share / base)
    without = F.when(share < 1, (1 - share) * F.log2((1 - share) / (1 - base))).otherwise(F.lit(0.0))
    # an entity of all documents has no bits to give
    told = F.when(base < 1, (gain >= MIN_GAIN * -F.log2(base)) & (F.col("_n_term") * (share * gain + without) >= MIN_BITS)).otherwise(F.lit(False))
    chosen = _joint_counts(keyed, spanned).crossJoin(F.broadcast(total)).filter((share >= MIN_SHARE) & told)  # one row
    return stored(chosen.select("_term").distinct(), "terms")


def _own_terms(docs: DataFrame, chosen: DataFrame, most: int) -> DataFrame:
    """docs with _terms, the disclosing terms that a document has, null if none."""
    words = F.array_distinct(_words(F.col("text")))
    few = [r["_term"] for r in chosen.limit(most + 1).collect()]
    if not few:
        return docs.withColumn("_terms", F.lit(None).cast("array<string>"))
    if len(few) <= most:
        docs = docs.withColumn("_terms", F.sort_array(F.filter(words, lambda w: w.isin(*few))))
        return docs.withColumn("_terms", F.when(F.size("_terms") > 0, F.col("_terms")))
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_TERMS else chosen
    having = docs.select("_id", "_text", F.explode(words).alias("_term")).join(chosen, "_term", "left_semi")
    having = stored(having.groupBy("_id", "_text").agg(F.sort_array(F.collect_set("_term")).alias("_terms")), "disclosing")  # of one document
    return docs.join(F.broadcast(having) if having.count() <= BROADCAST_ROWS else having, ["_id", "_text"], "left")


def _with_terms(docs: DataFrame, chosen: DataFrame, most: int = LITERAL_TERMS) -> DataFrame:
    """Adds the term spans of documents with text, _id, _text and _spans."""
    either = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join("_terms", "|"), F.lit(r")(?![\p{L}\p{N}])"))
    joined = _own_terms(docs, chosen, most)
    joined = _add_spans(joined.withColumn("_either", either), "_own", F.col("_either"), len(KINDS), F.col("_terms").isNotNull())
    return joined.withColumn("_spans", F.sort_array(F.concat("_spans", "_own"))).drop("_terms", "_either", "_own")


@tidy
def find_pii(docs: DataFrame, most: int = LITERAL_TERMS) -> DataFrame:
    """doc_id and _spans (start, kind as a place in KINDS or after them for terms, end, value, before, after) of every document."""
    plain = texts(docs)
    keyed = with_base_spans(plain.withColumn("_id", id_key()).withColumn("_text", text_key()))
    spanned = _spanned(keyed)
    chosen = disclosing_terms(spanned, keyed)
    if chosen.isEmpty():
        return spanned.select("doc_id", "_spans")
    return _with_terms(keyed, chosen, most).select("doc_id", "_spans")


@tidy
def sanitise(docs: DataFrame) -> DataFrame:
    """docs with spans in their texts replaced: base kinds by [kind], terms by nothing. A null text stays null."""
    columns = docs.columns
    held = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = with_base_spans(held.withColumn("_id", id_key()).withColumn("_text", text_key()))
    spanned = _spanned(keyed)
    chosen = disclosing_terms(spanned, keyed)
    found = keyed if chosen.isEmpty() else _with_terms(keyed, chosen)
    # overlapping spans become one, under the kind of the first
    span = "struct<start: bigint, kind: int, end: bigint>"
    merged = F.aggregate(
        F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))),
        F.struct(F.array().cast(f"array<{span}>").alias("out"), F.lit(None).cast(span).alias("last")),
        lambda acc, s: F.when(acc["last"].isNull(), F.struct(acc["out"].alias("out"), s.alias("last")))
        .when(s["start"] < acc["last"]["end"], F.struct(acc["out"].alias("out"), F.struct(acc["last"]["start"].alias("start"), acc["last"]["kind"].alias("kind"), F.greatest(acc["last"]["end"], s["end"]).alias("end")).alias("last")))
        .otherwise(F.struct(F.concat(acc["out"], F.array(acc["last"])).alias("out"), s.alias("last"))),
        lambda acc: F.when(acc["last"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["last"]))),
    )
    found = found.withColumn("_merged", F.when(F.size("_spans") > 0, merged))
    names = F.array(*(F.lit(f"[{k}]") for k in KINDS), F.lit(""))
    first = lambda i: F.coalesce(F.get(F.col("_merged"), i - 1)["end"], F.lit(0).cast("bigint"))
    parts = F.transform("_merged", lambda s, i: F.concat(F.substr(F.col("text"), (first(i) + 1).cast("int"), (s["start"] - first(i)).cast("int")), F.get(names, s["kind"])))
    tail = F.substr(F.col("text"), (F.element_at("_merged", -1)["end"] + 1).cast("int"))
    clean = F.when(F.col("_merged").isNull(), F.col("_row.text")).otherwise(F.concat(F.array_join(parts, ""), tail))
    out = found.select(*((clean.alias(c) if c == "text" else F.col("_row")[c].alias(c)) for c in columns))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their spans and all spans as a string."""
    names = F.array(*(F.lit(k) for k in (*KINDS, TERM)))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(test) -> Column:
        return F.filter("_spans", test)

    counts = [F.size(of(_is(n))).cast("long").alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(of(lambda s: s["kind"] < len(KINDS))), 256).alias("base_sha256"), joined(F.col("_spans")).alias("spans"))


def _is(n: int):
    return lambda s: s["kind"] == n


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_pii(documents(spark, sf_dir)))

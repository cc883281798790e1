"""Personal data: exact base patterns, and terms that reveal a protected entity, with built-in functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.llm.common import Workspace, let, running, table

#: Kinds of spans: entities, terms that go, and terms that become the class of what they reveal.
KINDS = ("email", "ip", "card", "phone", "removed", "generalised_email", "generalised_ip", "generalised_card", "generalised_phone")
#: What stands in the place of each.
NAMES = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "", "[EMAIL HOLDER]", "[IP HOLDER]", "[CARD HOLDER]", "[PHONE HOLDER]")
REMOVED = KINDS.index("removed")
#: Base patterns for Java. Possessive repeats and look-behind change no match: what follows a repeat cannot begin
#: inside it, and a start inside a run of the same characters fails if the run's own start fails (\G: the place
#: where the last match ended is such a start). They keep long runs of such characters linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Quick tests that every text with a match passes.
MAY_HAVE = {"email": r"@[A-Za-z0-9-]+\.", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
TERM = r"\p{L}{3,}+"

#: A term is judged on an entity if they share at least this many different contexts.
LEAST_CONTEXTS = 2
#: Contexts without the entity that every term is taken to have besides those seen: few contexts are weak evidence.
PRIOR = 1.0
#: Share of an entity's information that a term gives: from here on the term is replaced by a class ...
GENERALISE = 0.90
#: ... and from here on removed.
REMOVE = 0.96
#: Candidate terms that may be broadcast: at most this many, none longer than 64 characters, so below 32 MB.
BROADCAST_TERMS = 100_000
#: Code points in a piece, when a text is cut at many places.
PIECE = 1024


def _positions(text: Column | str, pattern: str, kind: str, valid: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<s, k, e, t>> of leftmost non-overlapping matches that are valid: code points, end exclusive.

    The pieces between matches (split) and the matches themselves, laid end to end, are the text, so running sums of
    their lengths are the places.
    """
    text = F.col(text) if isinstance(text, str) else text
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    number = KINDS.index(kind)
    pairs = F.filter(F.zip_with(pieces, hits, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: x["b"].isNotNull())

    def placed(p: Column) -> Column:
        ends = running(F.transform(p, lambda x: F.char_length(x["a"]) + F.char_length(x["b"])), "int", lambda x, before: x + F.coalesce(before, F.lit(0)))
        return let(ends, lambda at: F.transform(p, lambda x, i: F.struct((F.get(at, i) - F.char_length(x["b"])).alias("s"), F.lit(number).alias("k"), F.get(at, i).alias("e"), x["b"].alias("t"))))

    found = let(pairs, placed)
    return F.filter(found, lambda x: valid(x["t"])) if valid else found


def _replaced(text: Column, spans: Column, name: Callable[[Column], Column]) -> Column:
    """The text with name(span) in the place of each span. spans are in order; of overlapping ones the first names the
    place, and all of them go. The text is cut in pieces first, so that no cut counts its place from the beginning."""

    def part(pieces: Column, start: Column, end: Column) -> Column:
        first, last = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
        return F.when(end > start, F.substring(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), start % PIECE + 1, end - start)).otherwise("")

    def built(pieces: Column, upto: Column) -> Column:
        before = lambda i: F.coalesce(F.get(upto, i - 1), F.lit(0))
        body = F.transform(spans, lambda x, i: F.concat(part(pieces, before(i), x["s"]), F.when(x["s"] >= before(i), name(x)).otherwise("")))
        return F.concat(F.array_join(body, ""), part(pieces, before(F.size(upto)), F.char_length(text)))

    upto = running(F.transform(spans, lambda x: x["e"]), "int", lambda x, before: F.greatest(x, before))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return let(pieces, lambda p: let(upto, lambda u: built(p, u)))


def _small_number(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) <= 3) & (F.when(bare == "", 0).otherwise(F.substring(bare, 1, 3).cast("int")) <= 255)


def _luhn(digits: Column) -> Column:
    twice = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    backwards = F.transform(F.split(F.reverse(digits), ""), lambda d: F.when(d == "", 0).otherwise(d.cast("int")))
    weighed = F.transform(backwards, lambda d, i: F.when(i % 2 == 1, twice(d)).otherwise(d))
    return F.aggregate(weighed, F.lit(0), lambda a, d: a + d) % 10 == 0


def base_spans(text: str = "text") -> dict[str, Column]:
    """kind -> array of valid base matches of a column without nulls."""
    none = F.expr("cast(array() as array<struct<s:int,k:int,e:int,t:string>>)")
    digits = lambda t: F.regexp_replace(t, "[^0-9]", "")
    valid = {
        "email": None,
        "ip": lambda t: F.forall(F.split(t, r"\."), _small_number),
        "card": lambda t: F.length(digits(t)).between(14, 19) & _luhn(digits(t)),
        "phone": lambda t: F.length(digits(t)).between(10, 15),
    }
    out = {}
    for kind, pattern in PATTERNS.items():
        out[kind] = F.when(F.col(text).rlike(MAY_HAVE[kind]), _positions(text, pattern, kind, valid[kind])).otherwise(none)
    return out


def _with_base(df: DataFrame) -> DataFrame:
    """Adds a column for each kind, and base: all of them by start, then kind."""
    df = df.withColumns(base_spans())
    return df.withColumn("base", F.array_sort(F.concat(*PATTERNS)))


def _text_only(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("text", F.lit("")).alias("text"))


def _contexts(docs: DataFrame, *keep: str) -> DataFrame:
    """A row each line with a visible character: line, near (it with the lines before and after), context (a hash of
    the three). Signatures and tables have a name on one line and what belongs to it on the next."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"\S"))
    three = let(lines, lambda l: F.transform(l, lambda x, i: F.struct(F.get(l, i - 1).alias("a"), x.alias("b"), F.get(l, i + 1).alias("c"))))
    rows = docs.select(*keep, F.explode_outer(three).alias("x")).where("x is not null")
    none = F.lit("\n")
    return rows.select(*keep, F.col("x.b").alias("line"), F.concat_ws("\n", "x.a", "x.b", "x.c").alias("near"), F.xxhash64(F.coalesce("x.a", none), "x.b", F.coalesce("x.c", none)).alias("context"))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def _ratio(n_contexts: int) -> Column:
    """Share of the entity's information that the term gives, from counts c_te, c_t and c_e."""
    own = F.log2(F.lit(float(max(n_contexts, 2))) / F.col("c_e"))
    return 1 - F.log2((F.greatest(F.col("c_t"), F.col("c_te")) + PRIOR) / F.col("c_te")) / F.greatest(own, F.lit(1e-9))


def revealing_terms(work: Workspace, docs: DataFrame, least: int = LEAST_CONTEXTS, generalise: float = GENERALISE, remove: float = REMOVE) -> tuple[DataFrame, DataFrame]:
    """(terms: term, entity, ratio, action; occurrences: doc, context, term) over the whole corpus.

    A context is a line with its neighbours; equal contexts are one, so copies of a document add none. c(t, e) counts
    contexts whose line has the term and that hold the entity, c(t) those whose line has the term, c(e) those that
    hold the entity, N all. The pointwise information that t gives of e, log2(P(e|t) / P(e)), with PRIOR contexts
    without e added to c(t), is set against the information of e itself, -log2 P(e); at a ratio of `generalise` or
    more the term discloses the entity, whose class is that of its kind. Terms and entities that share fewer than
    `least` contexts are not judged.
    """
    texts = _text_only(docs)
    n_contexts = _contexts(texts).select("context").distinct().count()
    may = "|".join(f"(?:{p})" for p in MAY_HAVE.values())
    some = _contexts(texts.where(F.col("text").rlike(may))).where(F.col("near").rlike(may))
    some = _with_base(some.groupBy("context").agg(F.first("line").alias("line"), F.first("near").alias("text"))).withColumnRenamed("base", "held")
    some = _with_base(some.select("context", "held", F.col("line").alias("text")))
    held = some.select("context", _terms(_replaced(F.col("text"), F.col("base"), lambda x: F.lit(" "))).alias("terms"), F.array_distinct(F.transform("held", lambda x: F.concat(x["k"].cast("string"), F.lit(":"), F.lower(x["t"])))).alias("entities"))
    held = work.keep(held.where(F.size("entities") > 0), "contexts")
    of_entity = work.keep(held.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("c_e")), "entities")
    pairs = held.select(F.explode_outer("entities").alias("entity"), "terms").select("entity", F.explode_outer("terms").alias("term")).where("term is not null")
    pairs = work.keep(pairs.groupBy("term", "entity").agg(F.count("*").alias("c_te")).where(F.col("c_te") >= least), "pairs")
    # A term stands in no fewer contexts than in those with entities: what discloses too little by that count is out
    # before the corpus is searched, and so are all common words.
    seen = held.select(F.explode_outer("terms").alias("term")).where("term is not null")
    seen = work.keep(seen.groupBy("term").agg(F.count("*").alias("c_t")), "seen")
    pairs = work.keep(pairs.join(seen, "term").join(of_entity, "entity").withColumn("ratio", _ratio(n_contexts)).where(F.col("ratio") >= generalise).select("term", "entity", "c_te"), "likely")
    candidates = work.keep(pairs.select(F.col("term").alias("candidate")).distinct(), "candidates")  # written, so that a hot term's join can be split
    if candidates.count() <= BROADCAST_TERMS and candidates.where("length(candidate) > 64").isEmpty():
        candidates = F.broadcast(candidates)
    spread = _contexts(texts.withColumn("doc", F.xxhash64("text")), "doc").select("doc", "context", F.explode_outer(_terms(F.col("line"))).alias("term"))
    occurrences = work.keep(spread.join(candidates, F.col("term") == F.col("candidate"), "left_semi").distinct(), "occurrences")
    of_term = work.keep(occurrences.select("term", "context").distinct().groupBy("term").agg(F.count("*").alias("c_t")), "terms")
    judged = pairs.join(of_term, "term").join(of_entity, "entity")
    judged = judged.withColumn("ratio", _ratio(n_contexts)).where(F.col("ratio") >= generalise)
    best = judged.groupBy("term").agg(F.max(F.struct("ratio", "entity")).alias("b")).select("term", "b.entity", "b.ratio")
    kind = F.substring_index("entity", ":", 1).cast("int")
    action = F.when(F.col("ratio") >= remove, REMOVED).otherwise(REMOVED + 1 + kind)
    return work.keep(best.withColumn("action", action), "judged"), occurrences


def _clear(base: Column, more: Column) -> Column:
    """base and those spans of more that overlap none of base, by start, then kind."""
    far = F.lit(2**31 - 1)
    is_base = lambda x: x["k"] < REMOVED

    def kept(spans: Column) -> Column:
        ends = running(F.transform(spans, lambda x: F.when(is_base(x), x["e"]).otherwise(0)), "int", lambda x, before: F.greatest(x, before))
        starts = F.reverse(running(F.reverse(F.transform(spans, lambda x: F.when(is_base(x), x["s"]).otherwise(far))), "int", lambda x, after: F.least(x, after)))
        free = lambda e, s, x, i: (F.coalesce(F.get(e, i - 1), F.lit(0)) <= x["s"]) & (F.coalesce(F.get(s, i + 1), far) >= x["e"])
        return let(ends, lambda e: let(starts, lambda s: F.filter(spans, lambda x, i: is_base(x) | free(e, s, x, i))))

    return let(F.array_sort(F.concat(base, more)), kept)


def personal_data(work: Workspace, docs: DataFrame, least: int = LEAST_CONTEXTS, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone, found (array<struct<s, k, e, t>> by start, then kind; k is the
    place in KINDS) and base (those of them that the base patterns found).

    Null texts count as empty and hold nothing; repeated rows are treated each; texts are searched whole, whatever
    their length and number of matches; of terms that disclose several entities alike much the last entity names the
    class; an empty table gives no row; columns of docs with one of the names added here give way.
    """
    terms, occurrences = revealing_terms(work, docs, least, generalise, remove)
    listed = occurrences.join(terms.select("term", "action"), "term").groupBy("doc").agg(F.collect_set(F.struct("term", "action")).alias("terms_"))
    listed = work.keep(listed, "listed")
    kept = [c for c in docs.columns if c not in {"found", "base", *[f"n_{k}" for k in PATTERNS]}]
    df = docs.select(*[F.col(f"`{c}`").alias(f"in_{c}") for c in kept], F.coalesce("text", F.lit("")).alias("text")).withColumn("doc_", F.xxhash64("text"))
    df = df.join(listed, df.doc_ == listed.doc, "left").drop("doc", "doc_")
    df = _with_base(df)
    action = lambda t: F.get(F.filter("terms_", lambda x: x["term"] == F.lower(t)), F.lit(0))["action"]
    seen = F.transform(_positions("text", TERM, "removed"), lambda x: F.struct(x["s"].alias("s"), action(x["t"]).alias("k"), x["e"].alias("e"), x["t"].alias("t")))
    df = df.withColumn("more", F.when(F.col("terms_").isNotNull(), F.filter(seen, lambda x: x["k"].isNotNull())))
    df = df.withColumn("found", F.when(F.col("more").isNull() | (F.size("more") == 0), F.col("base")).otherwise(_clear(F.col("base"), F.col("more"))))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS]
    return df.select(*[F.col(f"`in_{c}`").alias(c) for c in kept], *counts, "base", "found")


def spelled(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def sanitised(df: DataFrame) -> DataFrame:
    """personal_data()'s rows with text changed: an entity becomes its kind in brackets, a generalised term the class of
    what it reveals, a removed term goes. Overlapping spans are one, named by the first. Null texts stay null."""
    names = F.array(*[F.lit(t) for t in NAMES])
    clean = _replaced(F.col("text"), F.col("found"), lambda x: F.element_at(names, x["k"] + 1))
    return df.withColumn("text", F.when(F.size("found") > 0, clean).otherwise(F.col("text")))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = personal_data(Workspace(spark, "op6"), table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", *[f"n_{k}" for k in PATTERNS], F.sha2(spelled("base"), 256).alias("base_sha256"), spelled("found").alias("spans"))

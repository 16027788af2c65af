"""Personal data and the terms that give it away, in DataFrame operations only.

Base spans (e-mail, IP address, card and phone numbers) are protected
entities.  Words near an entity can reveal it even when the entity itself is
masked.  How strongly follows from co-occurrence in the whole corpus: a term t
tells log2(p(e | t) / p(e)) bits about an entity e, of the log2(1 / p(e)) bits
that e holds.  A term whose share of those bits exceeds ``disclosure``, in at
least ``support`` different contexts, is sanitised wherever it stands near the
entity; ordinary words tell next to nothing, and a word seen once next to an
entity is no evidence.

A term is a maximal run of letters and digits outside all base spans,
lower-cased, of any length and script.  It stands near an entity if it lies
within the ``CONTEXT`` characters before or after it, whatever else stands
there.  p(e | t) is the number of places where t stands near e over all places
of t in the corpus, p(e) the number of places of e over the characters of the
corpus.  Counts are aggregated before they are shuffled and joined on the term,
so a frequent word is one row.

Positions are running sums over the lengths of matches and gaps, in two levels
(``_running``), and contexts are cut from chunks of the text, so the cost of a
document grows in step with its number of matches.

Edge cases: a NULL or empty text has no spans; repeated rows are scanned each
for itself and count as so many places; rows with a NULL id are told apart by
their text; an empty table gives an empty result; other columns, whatever
their names, are ignored by ``scan`` and kept by ``sanitise``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, doc_columns

# The base patterns in order.  Possessive quantifiers match the same strings as greedy ones here,
# since no repeated class holds what must follow it, and need no stack for long runs.
EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"  # shorter runs cannot hold 14 digits
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

#: Kind of the spans of disclosing terms.
TERM = "term"
CONTEXT = 64
DISCLOSURE = 0.95
SUPPORT = 2

_TERM_PATTERN = r"[\p{L}\p{N}]++"
_GROUP, _CHUNK = 128, 256
_PLACE = "array<struct<start:bigint,end:bigint,value:string>>"
_SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string,before:string,after:string>>"


def _luhn(digits: Column) -> Column:
    """Luhn check of a string of at most 19 digits."""
    back = F.reverse(digits)
    total = F.lit(0)
    for i in range(1, 20):
        d = F.coalesce(F.substring(back, i, 1).try_cast("int"), F.lit(0))
        total = total + (d if i % 2 else d * 2 - F.when(d > 4, 9).otherwise(0))
    return total % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(match, r"\."),
                        lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3)
                        & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return (F.length(digits) <= 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _upto(low: Column, high: Column) -> Column:
    """low, low + 1, ..., high; empty if there are none (``sequence`` would count down)."""
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def _running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running results of ``op`` (with zero as neutral element) over an array of longs.

    Groups of ``_GROUP`` values are folded first, so that a place needs its own group and the result before it.
    """
    zero, one = F.lit(0).cast("long"), F.lit(1)

    def group(i: Column) -> Column:  # of place i, from 0
        return F.floor((i - 1) / _GROUP).cast("int")

    def fold(start: Column, low: Column, high: Column, of: Column) -> Column:
        return F.aggregate(_upto(low, high), start, lambda a, j: op(a, F.element_at(of, j)))

    def result(v: Column) -> Column:
        n = F.size(v)
        groups = F.transform(_upto(one, group(n) + 1), lambda k: fold(
            zero, (k - 1) * _GROUP + 1, F.least(k * _GROUP, n), v))
        heads = _let(groups, lambda g: F.transform(_upto(one, F.size(g)), lambda k: fold(zero, one, k - 1, g)))
        return _let(heads, lambda h: F.transform(_upto(one, n), lambda i: fold(
            F.element_at(h, group(i) + 1), group(i) * _GROUP + 1, i, v)))

    return F.when(F.size(values) > 0, _let(values, result)).otherwise(F.array().cast("array<bigint>"))


def _placed(text: Column, pattern: str) -> Column:
    """Matches of a pattern with start and end, from the gaps between them."""
    def places(p: Column) -> Column:
        numbers = _upto(F.lit(1), F.size(p.matches))
        steps = F.transform(numbers, lambda i: (F.length(F.element_at(p.gaps, i))
                                                + F.length(F.element_at(p.matches, i))).cast("long"))
        return _let(_running(steps, lambda a, b: a + b), lambda ends: F.transform(numbers, lambda i: F.struct(
            (F.element_at(ends, i) - F.length(F.element_at(p.matches, i))).alias("start"),
            F.element_at(ends, i).alias("end"), F.element_at(p.matches, i).alias("value"))))

    return _let(F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("matches"),
                         F.split(text, pattern, -1).alias("gaps")), places).cast(_PLACE)


def _chunks(text: Column) -> Column:
    """The text in parts of ``_CHUNK`` characters, from which ``_cut`` takes stretches without walking through it."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % _CHUNK), 0)


def _cut(chunks: Column, start: Column, end: Column) -> Column:
    """Characters from start up to end; places outside the text have none."""
    low, high = F.floor(start / _CHUNK).cast("int"), F.floor((end - 1) / _CHUNK).cast("int")

    def part(k: Column) -> Column:
        at = F.greatest((start - k * _CHUNK).cast("int"), F.lit(0))
        return F.substring(F.element_at(chunks, k + 1), at + 1, (end - k * _CHUNK).cast("int") - at)

    return F.array_join(F.transform(_upto(low, F.least(high, F.size(chunks) - 1)), part), "")


def _of_kind(text: Column, chunks: Column, rank: int, kind: str, pattern: str) -> Column:
    """Valid matches, with ``CONTEXT`` characters and one more on either side."""
    placed = F.filter(_placed(text, pattern), lambda m: _valid(kind, m.value))
    return F.transform(placed, lambda m: F.struct(
        m.start.alias("start"), F.lit(rank).alias("rank"), m.end.alias("end"), F.lit(kind).alias("kind"),
        m.value.alias("value"),
        _cut(chunks, F.greatest(m.start - CONTEXT - 1, F.lit(0)), m.start).alias("before"),
        _cut(chunks, m.end, m.end + CONTEXT + 1).alias("after"))).cast(_SPAN)


def base_spans(text: Column) -> Column:
    """Base spans by start and then kind, with what stands on both sides."""
    text, none = F.coalesce(text, F.lit("")), F.array().cast(_SPAN)
    signs = [F.contains(text, F.lit("@")), text.rlike(IP), text.rlike(CARD), F.contains(text, F.lit("+"))]
    kinds = list(zip(KINDS, [EMAIL, IP, CARD, PHONE], signs))
    return F.when(signs[0] | signs[1] | signs[2] | signs[3], _let(_chunks(text), lambda chunks: F.array_sort(F.concat(
        *[F.when(sign, _of_kind(text, chunks, i, kind, pattern)).otherwise(none)
          for i, (kind, pattern, sign) in enumerate(kinds)])))).otherwise(none)


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"),
                                                                 s.end.cast("string"))), ",")


def _terms(text: Column, at: Column) -> Column:
    """Runs of letters and digits: the lower-cased run, start and end; ``at`` is where the text starts."""
    return F.transform(_placed(text, _TERM_PATTERN), lambda r: F.struct(
        F.lower(r.value).alias("term"), (at + r.start).alias("start"), (at + r.end).alias("end")))


def _near(e: Column) -> Column:
    """Whole runs within ``CONTEXT`` characters of an entity; one that goes on outside or in the entity is left out."""
    run = _TERM_PATTERN
    before = F.when(F.length(e.before) > CONTEXT, F.regexp_replace(e.before, f"^(?s:{run}|.)", "")).otherwise(e.before)
    after = F.when(F.length(e.after) > CONTEXT, F.regexp_replace(e.after, f"(?s:{run}|.)$", "")).otherwise(e.after)
    left = F.when(e.value.rlike(f"^{run}"), F.regexp_replace(before, f"{run}$", "")).otherwise(before)
    cut_off = F.when(e.value.rlike(f"{run}$"), F.regexp_extract(after, f"^{run}", 0)).otherwise("")
    return F.concat(_terms(left, e.start - F.length(before)),
                    _terms(F.substr(after, F.length(cut_off) + 1), e.end + F.length(cut_off)))


def _inside(e: Column) -> Column:
    """Runs that share characters with an entity, written start:term; whole if up to ``CONTEXT`` stand outside."""
    left = F.when(e.value.rlike(f"^{_TERM_PATTERN}"), F.regexp_extract(e.before, f"{_TERM_PATTERN}$", 0)).otherwise("")
    right = F.when(e.value.rlike(f"{_TERM_PATTERN}$"), F.regexp_extract(e.after, f"^{_TERM_PATTERN}", 0)).otherwise("")
    return F.transform(_terms(F.concat(left, e.value, right), e.start - F.length(left)),
                       lambda t: F.concat_ws(":", t.start.cast("string"), t.term))


def found(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text and the base spans of every row."""
    return doc_columns(docs, "doc_id", "text").select(
        "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        base_spans(F.col("text")).alias("base"))


def disclosing(docs: DataFrame, base: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """Terms near entities that give them away: doc_id, text_hash and their spans."""
    some = base.filter(F.size("base") > 0)
    entity = F.explode("base").alias("e")
    name = F.concat_ws(":", "e.kind", F.lower("e.value")).alias("entity")
    e = F.col("e")
    near = some.select("doc_id", "text_hash", entity).select(
        "doc_id", "text_hash", name,
        F.xxhash64(F.right("e.before", F.lit(CONTEXT)), F.left("e.after", F.lit(CONTEXT))).alias("context"),
        F.explode(_near(e)).alias("t")).select("doc_id", "text_hash", "entity", "context", "t.*")
    written_runs = F.array_distinct(F.flatten(F.transform("base", _inside)))
    inside = cut(some.select("doc_id", "text_hash", F.explode(written_runs).alias("run")).select(
        "doc_id", "text_hash", F.substring_index("run", ":", 1).cast("long").alias("start"),
        F.substring_index("run", ":", -1).alias("term")))
    taken = inside.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), F.col("start").alias("at"))
    placed = cut(near.join(taken, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
                           & (F.col("start") == F.col("at")), "left_anti"))

    entities = (some.select(entity).select(name)
                .groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")))
    together = placed.groupBy("term", "entity").agg(
        F.count(F.lit(1)).alias("n_both"), F.count_distinct("context").alias("n_contexts"))
    candidates = together.filter(F.col("n_contexts") >= support)
    text = F.lower(F.coalesce("text", F.lit("")))
    terms = (docs.select(F.explode(F.regexp_extract_all(text, F.lit(_TERM_PATTERN), 0)).alias("term"))
             .groupBy("term").agg(F.count(F.lit(1)).alias("n_all"))
             .join(inside.groupBy("term").agg(F.count(F.lit(1)).alias("n_inside")), "term", "left")
             .select("term", (F.col("n_all") - F.coalesce("n_inside", F.lit(0))).alias("n_term")))
    counted = cut(terms.join(candidates.select("term").distinct(), "term", "right"))
    total = docs.select(F.sum(F.length("text"))).first()[0] or 0  # places in the corpus, counted in characters
    bits = F.log2(F.lit(float(max(total, 2))) / F.col("n_entity"))
    told = bits - F.log2(F.greatest(F.col("n_term"), F.col("n_both")) / F.col("n_both"))
    telling = (candidates.join(counted, "term").join(entities, "entity")
               .filter(told > disclosure * bits).select("term", "entity"))
    return (placed.join(telling, ["term", "entity"]).groupBy("doc_id", "text_hash")
            .agg(F.collect_set(F.struct(F.col("start").cast("long").alias("start"),
                                        F.lit(len(KINDS)).alias("rank"), F.col("end").cast("long").alias("end"),
                                        F.lit(TERM).alias("kind"))).alias("terms")))


def _spans(docs: DataFrame, disclosure: float, support: int) -> DataFrame:
    """doc_id, text_hash, the base spans and all spans of every row."""
    base = cut(found(docs))
    extra = disclosing(docs, base, disclosure, support).withColumnRenamed("doc_id", "id") \
        .withColumnRenamed("text_hash", "hash")
    short = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"
    only = F.transform("base", lambda s: F.struct(s.start.alias("start"), s.rank.alias("rank"), s.end.alias("end"),
                                                  s.kind.alias("kind"))).cast(short)
    terms = F.coalesce("terms", F.array().cast(short)).cast(short)
    return (base.join(extra, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left")
            .select("doc_id", "text_hash", only.alias("base"),
                    F.array_sort(F.concat(only, terms)).alias("spans")))


def scan(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """doc_id, the number of base spans by kind, base_sha256 and all spans of every row."""
    spans = _spans(docs, disclosure, support)
    kinds = F.transform("base", lambda s: s.kind)
    n = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return spans.select("doc_id", *n, F.sha2(written(F.col("base")), 256).alias("base_sha256"),
                        written(F.col("spans")).alias("spans"))


def sanitise(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """The rows of ``docs`` with every span of ``text`` generalised to its kind, such as [EMAIL]."""
    spans = _spans(docs, disclosure, support).filter(F.size("spans") > 0).select("doc_id", "text_hash", "spans") \
        .groupBy("doc_id", "text_hash").agg(F.first("spans").alias("spans"))  # repeated rows have the same spans
    text, row = F.col("row.text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    joined = docs.select(row, key.alias("key")).join(
        spans, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_hash")), "left")

    def masked(p: Column) -> Column:
        reach = _running(F.transform(p.spans, lambda s: s.end), F.greatest)

        def piece(i: Column, ends: Column) -> Column:
            before = F.when(i > 1, F.element_at(ends, F.greatest(i - 1, F.lit(1)))).otherwise(F.lit(0).cast("long"))
            s = F.element_at(p.spans, i)  # nothing for one that overlaps what was replaced before
            return F.when(s.start >= before, F.concat(_cut(p.chunks, before, s.start), F.lit("["), F.upper(s.kind),
                                                      F.lit("]"))).otherwise("")

        return _let(reach, lambda ends: F.concat(
            F.array_join(F.transform(_upto(F.lit(1), F.size(p.spans)), lambda i: piece(i, ends)), ""),
            _cut(p.chunks, F.element_at(ends, -1), p.size)))

    parts = F.struct(F.col("spans").alias("spans"), _chunks(text).alias("chunks"),
                     F.length(text).cast("long").alias("size"))
    return joined.select(*[F.when(F.col("spans").isNull(), text).otherwise(_let(parts, masked)).alias(c)
                           if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])

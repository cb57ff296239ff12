"""Personal data by fixed patterns and by contextual bootstrapping, in DataFrame functions only.

Four kinds of identifiers are found by pattern. They are the seeds of a bootstrap: whole seeds and every other
identifier-like token are instances, the word before and the word after are patterns, a coarse shape is one more, and
instances and patterns score each other over their graph for a few rounds. Words that keep to one kind and that enough
different seeds support then name unseen identifiers of that kind, whatever their shape.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.session import cut_lineage

from .buffers import take
from .graph import FOLD

#: The kinds in their listed order, what a match must hold, and the pattern. Possessive quantifiers and
#: look-behinds keep the time linear; they change no match, as each class ends where the next one starts.
KINDS = {
    "email": (r"@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){13}", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}

_BYTE_PART = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"

#: An identifier-like token: number groups with spaces, brackets, dots or hyphens between them, or a run of letters and
#: digits with joiners inside that has a digit or a joiner.
CANDIDATE = (
    r"(?<![A-Za-z0-9@._%+:/#-])(?:"
    r"[+(]{0,2}[0-9]++(?![A-Za-z@_%:/#])(?:[\x20().-]{1,3}+[0-9]++(?![A-Za-z@_%:/#]))++"
    r"|\+?(?=[A-Za-z]*+(?:[0-9]|[@._%+:/#-]++[A-Za-z0-9]))[A-Za-z0-9]++(?:[@._%+:/#-]++[A-Za-z0-9]++)*+)"
)

#: What every text with such a token or with personal data holds.
MAY_HOLD = r"[0-9]|@|[A-Za-z][._%+:/#-]++[A-Za-z]"

#: Characters beside a candidate in which its neighbouring words are looked for.
CONTEXT = 48

#: Patterns that are broadcast at most; their number is counted first, more are joined by a shuffle.
BROADCAST_PATTERNS = 100_000

SPAN = "struct<start:int,rank:int,end:int>"

PLACED = "array<struct<start:int,end:int,value:string,left:string,right:string>>"

#: Java's white space, at which the words beside an instance end.
BLANKS = r"[ \t\n\x0B\f\r]+"


def _matches(text: Column, pattern: str) -> tuple[Column, Column]:
    """All matches of a pattern, and the texts between them."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _placed(text: Column, pattern: str) -> Column:
    """Matches as array<struct<start, end, value, left, right>> in code points, with the text on both sides."""
    found, between = _matches(text, pattern)
    return _let(F.struct(found.alias("found"), between.alias("between")), lambda x: _place(x["found"], x["between"]))


def _place(found: Column, between: Column) -> Column:
    n = F.size(found)
    ahead = F.zip_with(F.slice(between, 2, n), F.slice(found, 2, n), lambda a, m: F.left(F.concat(a, F.coalesce(m, F.lit(""))), F.lit(CONTEXT)))
    pairs = F.zip_with(F.zip_with(found, F.slice(between, 1, n), lambda m, b: F.struct(m.alias("m"), b.alias("b"))), ahead, lambda p, a: F.struct(p["m"].alias("m"), p["b"].alias("b"), a.alias("a")))
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("last"), F.array().cast(PLACED).alias("out"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["b"])
        end = start + F.length(pair["m"])
        left = F.right(F.concat(state["last"], pair["b"]), F.lit(CONTEXT))
        one = F.struct(start.alias("start"), end.alias("end"), pair["m"].alias("value"), left.alias("left"), pair["a"].alias("right"))
        return F.struct(end.alias("at"), pair["m"].alias("last"), F.array_append(state["out"], one).alias("out"))

    return F.aggregate(pairs, first, step, lambda state: state["out"])


def _luhn(value: Column) -> Column:
    """14 to 19 digits that pass the check sum."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)

    def weight(i: Column) -> Column:
        digit = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        double = digit * 2
        return F.when(i % 2 == 1, digit).when(double > 9, double - 9).otherwise(double)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), n), weight), F.lit(0), lambda a, b: a + b)
    return F.when(n.between(14, 19), total % 10 == 0).otherwise(F.lit(False))


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^(?:{_BYTE_PART}\.){{3}}{_BYTE_PART}$")
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def _base(text: Column, kind: str) -> Column:
    """Matches of one kind with the words beside them: leftmost ones that do not overlap, failing ones dropped."""
    needs, pattern = KINDS[kind]
    rank = list(KINDS).index(kind)
    kept = F.filter(_placed(text, pattern), lambda m: _passes(kind, m["value"]))
    spans = F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), *_words(m)))
    return F.when(text.rlike(needs), spans).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,value:string,before:string,after:string>>"))


def _words(m: Column) -> list[Column]:
    """The value of a placed match, and the words before and after it."""
    before = F.regexp_extract(m["left"], r"(\S++)\s*$", 1)
    after = F.regexp_extract(m["right"], r"^\s*(\S+)", 1)
    return [F.lower(c).alias(name) for c, name in ((m["value"], "value"), (before, "before"), (after, "after"))]


def _candidates(text: Column) -> Column:
    """Identifier-like tokens with the words beside them: array<struct<start, end, value, before, after>>."""
    found = F.transform(_placed(text, CANDIDATE), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), *_words(m)))
    return F.when(text.rlike(MAY_HOLD), found).otherwise(F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>"))


def _shape(value: Column) -> Column:
    """Which of the sign @, letters and digits a value holds."""
    return F.concat(*[F.when(value.rlike(part), name).otherwise("") for part, name in (("@", "@"), ("[A-Za-z]", "a"), ("[0-9]", "9"))])


def _patterns(c: str) -> Column:
    """The patterns of an instance: the word before, the word after, the shape. Missing words are none."""
    named = F.array(*[F.when(F.col(f"{c}.{side}") != "", F.concat(F.lit(f"{side} "), f"{c}.{side}")) for side in ("before", "after")])
    return F.array_append(F.array_compact(named), F.concat(F.lit("shape "), _shape(F.col(f"{c}.value"))))


def plain_words(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, plain): about how many different words that are no identifiers stand in the place of a pattern.

    ``patterns`` has the wanted patterns once each. Up to :data:`BROADCAST_PATTERNS` of them are broadcast, so that no
    word of the texts is exchanged. The number is a HyperLogLog estimate with a deviation of 5 %, near exact for small
    ones.
    """
    words = texts.select(F.array_remove(F.split(F.lower("text"), BLANKS), "").alias("words")).where(F.size("words") > 1)
    n = F.size("words") - 1
    pairs = words.select(F.explode(F.arrays_zip(F.slice("words", 1, n).alias("b"), F.slice("words", 2, n).alias("a"))).alias("w"))
    before = F.struct(F.concat(F.lit("before "), F.right("w.b", F.lit(CONTEXT))).alias("pattern"), F.col("w.a").alias("word"))
    after = F.struct(F.concat(F.lit("after "), F.left("w.a", F.lit(CONTEXT))).alias("pattern"), F.col("w.b").alias("word"))
    seen = pairs.select(F.explode(F.array(before, after)).alias("s")).select("s.pattern", "s.word")
    few = patterns.count() <= BROADCAST_PATTERNS
    held = seen.join(F.broadcast(patterns) if few else patterns, "pattern", "left_semi")
    return held.groupBy("pattern").agg(F.approx_count_distinct(F.when(~F.col("word").rlike(MAY_HOLD), F.col("word"))).alias("plain"))


def trusted_patterns(seen: DataFrame, rounds: int, support: int, precision: float, texts: DataFrame | None = None) -> DataFrame:
    """(pattern, rank): patterns that name one kind, by mutual scoring of patterns and instances.

    ``seen`` has (instance, pattern, rank), rank null where the instance is no seed. A pattern's score for a kind is
    the mean score of its distinct instances; a seed scores one for its kind and zero for others; any other instance
    scores the mean of its patterns; each different plain word of ``texts`` in a pattern's place scores zero. Trusted
    patterns reach ``precision`` and hold ``support`` different seeds; those with fewer seeds score zero.
    """
    edges = cut_lineage(seen.groupBy("instance", "pattern").agg(F.min("rank").alias("rank")), FOLD)
    seeds = edges.where("rank is not null").groupBy("pattern", "rank").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= support)
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    base = cut_lineage(seeds.join(sizes, "pattern"), FOLD)
    if texts is not None:
        words = plain_words(texts, base.where("pattern not like 'shape %'").select("pattern").distinct())
        base = cut_lineage(base.join(words, "pattern", "left").select("pattern", "rank", "seeds", (F.col("n") + F.coalesce("plain", F.lit(0))).alias("n")), FOLD)
    scores = base.select("pattern", "rank", "seeds", "n", (F.col("seeds") / F.col("n")).alias("score"))
    unknown = edges.where("rank is null").select("instance", "pattern")
    degree = unknown.groupBy("instance").agg(F.count("*").alias("degree"))
    for _ in range(rounds):
        # Each round reads the one before once, so nothing is written between them.
        voted = unknown.join(scores.select("pattern", "rank", "score"), "pattern").groupBy("instance", "rank").agg(F.sum("score").alias("total"))
        held = voted.join(degree, "instance").select("instance", "rank", (F.col("total") / F.col("degree")).alias("held"))
        gained = unknown.join(held, "instance").groupBy("pattern", "rank").agg(F.sum("held").alias("gained"))
        scores = base.join(gained, ["pattern", "rank"], "left").select("pattern", "rank", "seeds", "n", ((F.col("seeds") + F.coalesce("gained", F.lit(0.0))) / F.col("n")).alias("score"))
    return scores.where(F.col("score") >= precision).select("pattern", "rank")


def find_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = 3, support: int = 5, precision: float = 0.8) -> DataFrame:
    """(doc_id, key, base, spans) for every row; both are arrays of <start, rank, end>, rank the place in KINDS.

    ``base`` holds the matches of the fixed patterns, ``spans`` these and the discovered identifiers that overlap none
    of them, both sorted. ``key`` is a hash of id and text: repeated rows share it. Null text is empty; rows without an
    id are handled like others; an empty table gives no rows.
    """
    plain = take(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.xxhash64("doc_id", "text").alias("key")
    seeds = F.array_sort(F.concat(*[_base(F.col("text"), k) for k in KINDS]))
    rows = cut_lineage(plain.select("doc_id", key, seeds.alias("seeds"), _candidates(F.col("text")).alias("found")))
    base = F.transform("seeds", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))

    # Whole base spans are the seeds; a candidate that one touches is none.
    seed = rows.where(F.size("seeds") > 0).select(F.explode("seeds").alias("c"))
    one = rows.where(F.size("found") > 0).select("doc_id", "key", "seeds", F.explode("found").alias("c"))
    one = one.where(~F.exists("seeds", lambda s: (s["start"] < F.col("c.end")) & (s["end"] > F.col("c.start"))))
    occurrences = one.select("doc_id", "key", "c.start", "c.end", F.col("c.value").alias("instance"), F.explode(_patterns("c")).alias("pattern"))
    known = seed.select(F.col("c.value").alias("instance"), F.explode(_patterns("c")).alias("pattern"), "c.rank")
    seen = known.unionByName(occurrences.select("instance", "pattern", F.lit(None).cast("int").alias("rank")))
    trusted = trusted_patterns(seen, rounds, support, precision, plain.select("text")).where("pattern not like 'shape %'")
    fresh = occurrences.join(trusted.withColumnRenamed("rank", "kind"), "pattern")
    named = fresh.groupBy("doc_id", "key", "start", "end").agg(F.min("kind").alias("rank"))
    more = named.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "rank", "end")).alias("more")).withColumnRenamed("doc_id", "_id").withColumnRenamed("key", "_key")
    joined = rows.select("doc_id", "key", base.alias("base")).join(more, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(f"array<{SPAN}>"))))
    return joined.select("doc_id", "key", "base", spans.alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how: float) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one, named by the first.

    All rows and columns stay, whatever their names; null texts stay null.
    """
    found = find_spans(docs, doc_id, text, **how).where(F.size("spans") > 0)
    found = found.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("spans").alias("_spans")).dropDuplicates(["_id", "_key"])
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    names = docs.columns
    plain = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    id_, body = F.col(f"_c{names.index(doc_id)}"), F.col(f"_c{names.index(text)}")

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(body, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        apart = s["start"] >= state["at"]
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(apart, F.concat(state["out"], gap, kinds[s["rank"]])).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(F.col("_spans"), start, step, lambda state: F.concat(state["out"], F.substring(body, state["at"] + 1, F.length(body))))
    match = (F.xxhash64(id_.cast("long"), F.coalesce(body, F.lit(""))) == F.col("_key")) & id_.eqNullSafe(F.col("_id"))
    joined = plain.join(found, match, "left")
    return joined.withColumn(f"_c{names.index(text)}", F.when(F.col("_spans").isNull(), body).otherwise(clean)).select(*plain.columns).toDF(*names)

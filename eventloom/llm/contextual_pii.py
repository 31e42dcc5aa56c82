"""Personal data: spans of fixed forms, and further identifiers found by bootstrapped contexts.

Base.  Addresses, numbers of cards and phones are found by patterns of their own, leftmost and without
overlaps per kind.  The patterns here take no more than linear time: a run of letters or digits is only
tried from its start (or from where the last match ended), and repeats never give back what they took.

Method.  Base finds are the seeds.  What stands before a find, its last word and its last two words (in
lower case, as written, within TAIL characters), are lexical patterns.  Other runs of digits, codes and
loose addresses that no base find overlaps are candidates.  Patterns, and the texts (instances) that follow them
anywhere in the corpus, make a graph.  In each round a pattern is scored for each kind:

    sum of scores of its instances of the kind / (that + other instances + plain words that follow it
    anywhere + UNKNOWN * candidates of a fitting shape),

an instance by 1 - product(1 - score of the pattern) over the patterns held to be sure (SURE, and
SEEDS instances' worth of support).  Candidates so found join the seeds of the next round, until
nothing changes or ROUNDS are done.  Every place of a found candidate becomes a span of its kind.
Instances count once for each distinct text, however often a document is copied.

Cases: a null text is empty; a document without finds has zeros and empty lists; rows of one doc_id and
null ids are rows of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import joinable, stage

KINDS = ("email", "ip", "card", "phone")
CANDIDATE = len(KINDS)
TAIL = 64
SURE, SEEDS, UNKNOWN, ROUNDS = 0.8, 3, 0.5, 5
BITS = 1024

PATTERNS = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    r"(?<![0-9A-Za-z@])\+?\(?[0-9](?:[\x20().:/-]{0,2}[0-9]){4,}+"
    r"|(?<![0-9A-Za-z@-])[A-Za-z]{1,4}-?[0-9](?:-?[0-9A-Za-z]){4,}+"
    r"|(?<![A-Za-z0-9@._%+-])[A-Za-z0-9._%+-]++(?:@|\(at\)|\[at\])[A-Za-z0-9-]++(?:(?:\.|\(dot\)|\[dot\])[A-Za-z0-9-]++)*+",
)
#: What a text must have for a pattern to be tried at all.
HINTS = ("@", r"[0-9]\.[0-9]", r"[0-9][\x20-]?[0-9]", r"\+[0-9]", r"@|[\[(]at[\])]|[0-9][^0-9]{0,2}[0-9]")
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_MATCHED = "array<struct<kind:int,gap:int,tail:string,text:string>>"


def _matches(text: Column, kind: int) -> Column:
    """The pattern's matches in order: characters since the match before, the last TAIL of them, the match."""
    pairs = F.arrays_zip(F.split(text, PATTERNS[kind], -1).alias("before"), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)).alias("match"))
    rows = F.transform(
        F.filter(pairs, lambda x: x["match"].isNotNull()),
        lambda x: F.struct(F.lit(kind).alias("kind"), F.length(x["before"]).alias("gap"), F.right(x["before"], F.lit(TAIL)).alias("tail"), x["match"].alias("text")),
    )
    return F.when(text.rlike(HINTS[kind]), rows.cast(_MATCHED)).otherwise(F.array().cast(_MATCHED))


def _found(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(row, doc_id, matches) of every document, without its text."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    each = [_matches(F.col("__text"), k) for k in range(len(PATTERNS))]
    return stage(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(*each).alias("matches")), "pii-matches")


def _entities(found: DataFrame) -> DataFrame:
    """(row, kind, start, end, form, fits, last, two): base finds, and candidates that none of them overlaps.

    form is the text's letters and digits, fits a bit for each kind whose shape it has, last and two are
    the words before it (null where there are none)."""
    text, digits = F.col("text"), F.regexp_replace("text", "[^0-9]", "")
    n, letters, mail = F.length(digits), text.rlike("[A-Za-z]"), text.rlike(r"@|[\[(]at[\])]")
    one = found.select("row", F.posexplode("matches").alias("pos", "m")).select("row", "pos", "m.*")
    order = W.partitionBy("row", "kind").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = one.withColumn("end", F.sum(F.col("gap") + F.length("text")).over(order).cast("long")).withColumn("start", F.col("end") - F.length("text"))
    valid = [
        F.lit(True),
        text.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        n.between(12, 19) & F.call_function("luhn_check", digits),
        n.between(9, 15),
        F.lit(True),
    ]
    kept = placed.filter(reduce(lambda x, k: x.when(F.col("kind") == k, valid[k]), range(1, len(valid)), F.when(F.col("kind") == 0, valid[0])))
    base, at = F.col("kind") < CANDIDATE, W.partitionBy("row").orderBy("start", "kind")
    reached = F.max(F.when(base, F.col("end"))).over(at.rowsBetween(W.unboundedPreceding, -1))
    follows = F.expr(f"lead(if(kind < {CANDIDATE}, start, null), 1) IGNORE NULLS OVER (PARTITION BY row ORDER BY start, kind)")
    apart = kept.withColumn("reached", reached).withColumn("follows", follows)
    apart = apart.filter(base | ((F.coalesce("reached", F.lit(0)) <= F.col("start")) & (F.coalesce("follows", F.col("end")) >= F.col("end"))))
    marks = F.length(F.regexp_replace("text", "[^.:]", ""))
    shape = [mail, ~mail & ~letters & n.between(4, 12) & (marks >= 3), ~mail & (n >= 8), ~mail & ~letters & n.between(6, 15)]
    bits = reduce(lambda x, y: x + y, [F.when(s, F.lit(1 << k)).otherwise(0) for k, s in enumerate(shape)])
    words = F.split(F.trim(F.regexp_replace(F.lower("tail"), r"[\x20\x09-\x0D]+", " ")), " ")
    named = apart.withColumn("words", F.filter(words, lambda w: w != ""))
    whole = F.when(F.length("tail") < TAIL, F.size("words")).otherwise(F.size("words") - 1)  # the first may have been cut
    return named.select(
        "row",
        "kind",
        "start",
        "end",
        F.lower(F.regexp_replace("text", "[^0-9A-Za-z@]", "")).alias("form"),
        F.when(base, F.expr("shiftleft(1, kind)")).otherwise(bits).cast("int").alias("fits"),
        F.when(whole >= 1, F.element_at("words", -1)).alias("last"),
        F.when(whole >= 2, F.concat_ws(" ", F.slice("words", -2, 2))).alias("two"),
    )


def _followers(docs: DataFrame, text: str, patterns: DataFrame) -> DataFrame:
    """(pattern, forms, next) for every place where a pattern of (pattern, forms) is followed by a word without
    digits or @."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size("w")
    some = docs.select(words.alias("w")).filter(n > 1).select(F.explode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), n).alias("b"), F.slice("w", F.lit(3), n).alias("c"))).alias("x"))
    both = some.select(F.explode(F.array(F.struct(F.col("x.a").alias("pattern"), F.col("x.b").alias("next")), F.struct(F.concat("x.a", F.lit(" "), "x.b").alias("pattern"), F.col("x.c").alias("next")))).alias("y"))
    met = both.select("y.*").filter("next IS NOT NULL").join(joinable(patterns, "octet_length(pattern) + 32"), "pattern")
    return met.filter(~F.col("next").rlike("[0-9@]"))


def _plain_followers(docs: DataFrame, text: str, patterns: DataFrame) -> DataFrame:
    """(pattern, plain): distinct words without digits or @ that follow a pattern anywhere in the corpus.

    A word sets one of BITS bits of its pattern.  A pattern with more bits than could leave it sure, were all
    its forms of one kind, has its number of bits for a count; only for others are words told apart."""
    place = F.pmod(F.xxhash64("next"), F.lit(BITS))
    masks = [F.bit_or(F.when(F.floor(place / 64) == i, F.expr(f"shiftleft(1L, cast(pmod(xxhash64(next), {BITS}) % 64 AS int))")).otherwise(F.lit(0).cast("long"))) for i in range(BITS // 64)]
    met = _followers(docs, text, patterns).groupBy("pattern").agg(F.first("forms").alias("forms"), reduce(lambda x, y: x + y, [F.bit_count(m).cast("long") for m in masks]).alias("plain"))
    met = stage(met.withColumn("dead", F.col("plain") * SURE > F.col("forms") * (1 - SURE)), "pii-followers")
    exact = _followers(docs, text, met.filter("NOT dead").select("pattern", "forms")).select("pattern", "next").distinct().groupBy("pattern").agg(F.count(F.lit(1)).alias("plain"))
    return met.filter("dead").select("pattern", "plain").unionByName(exact)


def _scored_patterns(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(pattern, kind, score) of the patterns that are sure.  edges: (pattern, form, kind, fits, plain)."""
    labelled = edges.join(known.withColumnRenamed("kind", "label"), "form", "left")
    label = F.when(F.col("kind") < CANDIDATE, F.col("kind")).otherwise(F.col("label"))
    worth = F.when(F.col("kind") < CANDIDATE, F.lit(1.0)).otherwise(F.col("score"))
    rows = labelled.select("pattern", "plain", "fits", label.alias("label"), worth.alias("worth"))
    sums = []
    for k in range(len(KINDS)):
        fitting = F.col("label").isNull() & (F.col("fits").bitwiseAND(1 << k) != 0)
        sums.append(F.sum(F.when(F.col("label") == k, F.col("worth")).otherwise(0.0)).alias(f"good{k}"))
        sums.append(F.sum(F.when(F.col("label") == k, 0.0).when(fitting, UNKNOWN).otherwise(1.0)).alias(f"bad{k}"))
    total = rows.groupBy("pattern").agg(F.first("plain").alias("plain"), *sums)
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"good{k}").alias("good"), F.col(f"bad{k}").alias("bad")) for k in range(len(KINDS))]))
    each = total.select("pattern", "plain", kinds.alias("s")).select("pattern", "s.kind", "s.good", (F.col("s.good") / (F.col("s.good") + F.col("s.bad") + F.col("plain"))).alias("score"))
    return each.filter((F.col("good") >= SEEDS) & (F.col("score") >= SURE)).select("pattern", "kind", "score")


def _scored_instances(edges: DataFrame, sure: DataFrame) -> DataFrame:
    """(form, kind, score) of the candidates that sure patterns of a fitting kind extract; the best kind of each."""
    met = edges.filter(F.col("kind") == CANDIDATE).select("pattern", "form", "fits").join(sure, "pattern")
    fitting = met.filter(F.expr("fits & shiftleft(1, kind)") != 0)
    missed = F.sum(F.log(F.lit(1.0) - F.least(F.col("score"), F.lit(1 - 1e-9))))
    each = fitting.groupBy("form", "kind").agg(F.round(F.lit(1.0) - F.exp(missed), 9).alias("score")).filter(F.col("score") >= SURE)
    best = each.groupBy("form").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("best"))
    return best.select("form", (-F.col("best.k")).cast("int").alias("kind"), F.col("best.score").alias("score"))


def bootstrap(docs: DataFrame, entities: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Sure patterns (pattern, kind, score) and found candidates (form, kind, score)."""
    pattern = F.explode(F.array("last", "two")).alias("pattern")
    pairs = stage(entities.select(pattern, "form", "kind", "fits").filter("pattern IS NOT NULL").distinct(), "pii-pairs")
    support = stage(pairs.groupBy("pattern").agg(F.count(F.lit(1)).alias("forms")).filter(F.col("forms") >= SEEDS), "pii-patterns")
    plain = _plain_followers(docs, text, support)
    edges = stage(pairs.join(support.select("pattern"), "pattern").join(plain, "pattern", "left").fillna(0, ["plain"]), "pii-edges")
    seeds = edges.filter(F.col("kind") < CANDIDATE).groupBy("form").agg(F.min("kind").alias("kind")).withColumn("score", F.lit(1.0))
    found, seen = None, None
    for _ in range(ROUNDS):
        known = seeds if found is None else seeds.unionByName(found.join(seeds.select("form"), "form", "left_anti"))
        sure = stage(_scored_patterns(edges, known), "pii-sure")
        found = stage(_scored_instances(edges, sure), "pii-instances")
        now = tuple(found.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("form", "kind", "score")), F.lit(0))).first())
        if now == seen:
            break
        seen = now
    return sure, found


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, spans) of each row: sorted arrays of (start, kind, end), kind as its place in KINDS;
    offsets in code points, end exclusive."""
    found = _found(docs, doc_id, text)
    entities = stage(_entities(found), "pii-entities")
    _, new = bootstrap(docs, entities, text)
    base = entities.filter(F.col("kind") < CANDIDATE).select("row", F.struct("start", "kind", "end").alias("span"), F.lit(True).alias("base"))
    extra = entities.filter(F.col("kind") == CANDIDATE).select("row", "start", "end", "form").join(joinable(new.select("form", "kind"), "octet_length(form) + 16"), "form")
    spans = base.unionByName(extra.select("row", F.struct("start", "kind", "end").alias("span"), F.lit(False).alias("base")))
    each = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.when(F.col("base"), F.col("span")))).alias("base"), F.sort_array(F.collect_list("span")).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return found.select("row", "doc_id").join(each, "row", "left").select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

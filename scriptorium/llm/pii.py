"""Personal data: fixed patterns, and identifiers found by bootstrapped contextual extraction.

Everything here is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

# What counts as a match, in the order in which kinds are listed. Fixed values. The possessive forms and
# the lookbehinds match what the plain ones do, in linear time and without deep recursion.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A token that may be an identifier: what stands after = or : (4 to 128 characters, marks inside), whatever it looks like; elsewhere 12 to
#: 64 letters and digits, with a digit.
SLOT = r"""(?<=[=:][ ]?["']?)[A-Za-z0-9][A-Za-z0-9_.+/=-]{2,126}[A-Za-z0-9=](?![A-Za-z0-9])"""
TOKEN = SLOT + r"|(?<![A-Za-z0-9])(?=[A-Za-z]{0,63}[0-9])[A-Za-z0-9]{12,64}(?![A-Za-z0-9])"
#: Seeds beside the fixed patterns: digests, and access key ids of a published form.
SEEDS = r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{32,64}$|^AKIA[0-9A-Z]{16}$"


def _let(value: Column, body) -> Column:
    """`body` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


BLOCK = 64


def _blocks(values: Column) -> Column:
    """An array's values, BLOCK at a time."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda j: F.slice(values, j * BLOCK + 1, F.lit(BLOCK)))


def before_each(values: Column, combine, start: Column, levels: int = 3) -> Column:
    """For each number of an array, `start` and those before it combined (added, say). Blocks are combined, and their results
    so again, so the work grows with the length: BLOCK steps a number and level at most (but the top level's with its square)."""
    def inside(a: Column, first: Column) -> Column:
        return F.transform(a, lambda _, i: F.aggregate(F.slice(a, F.lit(1), i), first, combine))

    if not levels:
        return inside(values, start)

    def outer(v: Column) -> Column:
        def of(parts: Column) -> Column:
            whole = F.transform(parts, lambda x: F.aggregate(x, start, combine))
            return F.flatten(F.zip_with(parts, before_each(whole, combine, start, levels - 1), inside))

        return _let(_blocks(v), of)

    return _let(values, lambda v: F.when(F.size(v) <= BLOCK, inside(v, start)).otherwise(outer(v)))


def places(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match, before>> of the leftmost non-overlapping matches, in code points.
    The text splits into what lies before, between and after them."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = _let(found, lambda f: F.arrays_zip(F.slice(gaps, F.lit(1), F.size(f)).alias("before"), f.alias("match")))

    def placed(rows: Column) -> Column:
        def of(at: Column) -> Column:
            def one(r: Column, i: Column) -> Column:
                start = F.get(at, i) + F.length(r["before"])
                return F.struct(start.alias("start"), (start + F.length(r["match"])).alias("end"), r["match"].alias("match"), r["before"].alias("before"))

            return F.transform(rows, one)

        lengths = F.transform(rows, lambda r: F.length(r["before"]) + F.length(r["match"]))
        return _let(before_each(lengths, lambda x, y: x + y, F.lit(0)), of)

    return _let(rows, placed)


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda a, b: a + b) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        part = r"0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9]?)"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<start, kind (its number), end>> of the fixed patterns, in order."""
    def of(number: int, kind: str) -> Column:
        ok = F.filter(places(text, PATTERNS[kind]), lambda m: valid(kind, m["match"]))
        return F.transform(ok, lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end")))

    parts = [of(number, kind) for number, kind in enumerate(PATTERNS)]
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return F.when(text.rlike("[0-9@]"), F.array_sort(F.concat(*parts))).otherwise(none)


def count(spans: Column, number: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("long")


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, [*PATTERNS, "id"]))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def patterns_of(t: Column) -> Column:
    """The lexical patterns that a token is an instance of: the word and marks to its left, the capitals
    that it starts with, and for mixed tokens its shape."""
    own = t["match"]
    left = F.regexp_extract(F.lower(F.substring(t["before"], -40, 40)), r"(\p{L}+[^\p{L}\p{N}]{0,6})$", 1)
    start = F.regexp_extract(own, "^([A-Z]{4})[A-Z]*[0-9]", 1)
    shape = F.when(own.rlike("^[0-9]+$"), F.lit(None)).when(own.rlike("^[0-9a-f]+$"), "hex").when(own.rlike("^[0-9A-F]+$"), "HEX")
    rows = F.array(F.when(left != "", F.concat(F.lit("left "), left)), F.when(start != "", F.concat(F.lit("start "), start)), F.concat(F.lit("shape "), shape))
    return F.filter(rows, lambda p: p.isNotNull())


def bootstrap(tokens: DataFrame, rounds: int = 3) -> DataFrame:
    """(pattern, confidence, support) from rows (instance, seed, pattern): seeds score 1; a pattern's
    confidence is the mean score of its different instances, an instance scores its best pattern's
    confidence; again for `rounds` rounds. Rows are summed before any join, so copies cost little."""
    edges = cut(tokens.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    scored = edges.withColumn("score", F.col("seed").cast("double"))
    for k in range(rounds):
        patterns = scored.groupBy("pattern").agg(F.avg("score").alias("confidence"), F.count(F.lit(1)).alias("support"))
        if k < rounds - 1:
            best = edges.join(patterns.where("support > 2").select("pattern", "confidence"), "pattern").groupBy("instance").agg(F.max("confidence").alias("best"))
            scored = edges.join(best, "instance", "left").select("pattern", "instance", "seed", F.greatest(F.col("seed").cast("double"), F.coalesce("best", F.lit(0.0))).alias("score"))
            scored = cut(scored)
    return patterns


def discovered(found: DataFrame, least: float = 0.6, support: int = 3) -> DataFrame:
    """(text_key, ids): the identifiers in each text that the fixed patterns don't have: seeds, and
    instances of patterns of at least `least` confidence with `support` different instances."""
    t = found.where(F.size("tokens") > 0).groupBy("text_key").agg(F.first("tokens").alias("tokens"))
    t = t.select("text_key", F.explode("tokens").alias("t"))
    t = cut(t.select("text_key", "t.start", "t.end", F.xxhash64("t.match").alias("instance"), F.col("t.seed").cast("int").alias("seed"), "t.base", F.col("t.patterns").alias("patterns")))
    rows = t.withColumn("pattern", F.explode("patterns"))
    sure = bootstrap(rows.select("instance", "seed", "pattern")).where((F.col("confidence") >= least) & (F.col("support") >= support)).select("pattern")
    hits = rows.join(sure, "pattern", "left_semi").select("text_key", "start", "end", "base").unionByName(t.where("seed = 1").select("text_key", "start", "end", "base"))
    hits = hits.where("NOT base").groupBy("text_key").agg(F.sort_array(F.collect_set(F.struct("start", F.lit(len(PATTERNS)).alias("kind"), "end"))).alias("ids"))
    return hits


def scan(docs: DataFrame) -> DataFrame:
    """`docs` without its text, plus text_key, base spans, and candidate tokens with their patterns."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumn("text_key", F.md5(text)).withColumn("base", base_spans(text))
    none = F.array().cast("array<struct<start:int,end:int,match:string,before:string>>")
    raw = F.when(text.rlike("[0-9=:]"), places(text, TOKEN)).otherwise(none)

    def token(t: Column) -> Column:
        over = F.exists(F.col("base"), lambda s: (s["start"] < t["end"]) & (s["end"] > t["start"]))
        within = F.exists(F.col("base"), lambda s: (s["start"] <= t["start"]) & (s["end"] >= t["end"]))
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), t["match"].alias("match"), (over | t["match"].rlike(SEEDS)).alias("seed"), within.alias("base"), patterns_of(t).alias("patterns"))

    return rows.withColumn("tokens", F.transform(raw, token)).drop("text")


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): for every row the spans of the fixed patterns, and those with what the
    bootstrapped patterns find, as arrays of (start, kind, end) in code points.

    Null text counts as empty. Results depend on the text alone: copies get the same. Null and repeated
    ids: each row by itself. Empty table: no rows. Very long texts: time in proportion to their matches. Other columns,
    whatever their names, are dropped.
    """
    found = cut(scan(docs.select("doc_id", "text")))
    ids = discovered(found).withColumnRenamed("text_key", "k")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    both = found.join(ids, F.col("text_key") == F.col("k"), "left")
    return both.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("ids", none))).alias("spans"))


def replaced(text: Column, spans: Column, names: Column) -> Column:
    """`text` with its spans (start, kind, end), in order, replaced by their kinds' names; spans that overlap as one, by the first
    one's. A block of spans takes its own stretch of the text, so long texts aren't read again for each span."""
    def of(spans: Column) -> Column:
        done = before_each(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y), F.lit(0))
        apart = F.filter(F.transform(F.arrays_zip(spans.alias("s"), done.alias("done")), lambda z: F.struct(z["done"].alias("from"), z["s"]["start"].alias("to"), z["s"]["kind"].alias("kind"))), lambda z: z["to"] >= z["from"])

        def block(part: Column) -> Column:
            at, end = F.element_at(part, 1)["from"], F.element_at(part, -1)["to"]

            def cut_from(stretch: Column) -> Column:
                return F.array_join(F.transform(part, lambda z: F.concat(F.substring(stretch, z["from"] - at + 1, z["to"] - z["from"]), F.element_at(names, z["kind"] + 1))), "")

            return _let(F.substring(text, at + 1, end - at), cut_from)

        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(F.transform(_let(apart, _blocks), block), ""), F.substring(text, last + 1, F.length(text)))

    return _let(spans, of)


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with each span that `detect` finds replaced by its kind in brackets; spans that overlap
    are replaced as one, by the first one's kind. n_chars, where there is one, follows.

    Null text stays null; an empty table gives no rows; repeated rows and null ids stay as they are; very long texts take
    time in proportion to their matches. Columns of any name stay."""
    plain = docs.select("text").where(F.col("text").rlike("[0-9@=:]"))
    ids = discovered(cut(scan(plain))).withColumnRenamed("text_key", "pii_key").withColumnRenamed("ids", "pii_ids")
    rows = docs.select(F.struct("*").alias("row"), "text", F.md5("text").alias("key"))
    rows = rows.join(ids, F.col("key") == F.col("pii_key"), "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    spans = F.array_sort(F.concat(base_spans(F.col("text")), F.coalesce("pii_ids", none)))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in [*PATTERNS, "id"]])
    text = F.when(F.size(spans) > 0, replaced(F.col("text"), spans, names)).otherwise(F.col("text"))
    out = rows.select("row", text.alias("text"))
    changed = {"text": F.col("text"), "n_chars": F.length("text")}
    return out.select(*(changed[f.name].cast(f.dataType).alias(f.name) if f.name in changed else F.col("row")[f.name].alias(f.name) for f in docs.schema))

"""Words of texts without blanks: the cheapest path through a graph of words with tags, and the phrase that a text ends in."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- Fixed values: which tags make a phrase, which end it, and which may dangle behind it. ----
CONTENT = ["n", "nr", "ns", "nt", "nz", "nl", "ng", "a", "ad", "an", "ag", "vn", "eng", "j", "l", "i", "b", "z"]
TRAILING = ["u", "y", "k", "h", "q", "m", "f", "x"]
#: Words of closed classes by tag: prepositions, conjunctions, pronouns and articles, adverbs, particles, verbs.
CLOSED = {
    "p": ["从", "在", "把", "被", "对", "向", "由", "以", "为", "与", "of", "in", "at", "to", "from", "by", "with", "for", "on", "de", "à", "en", "dans", "pour", "von", "mit", "zu", "por", "con"],
    "c": ["和", "或", "但", "而", "若", "and", "or", "but", "et", "ou", "mais", "und", "oder", "y", "o", "pero"],
    "r": ["你", "我", "他", "她", "它", "这", "那", "这个", "那个", "the", "a", "an", "this", "that", "he", "she", "it", "le", "la", "les", "un", "une", "der", "die", "das", "el", "los", "las", "una"],
    "d": ["就", "也", "还", "都", "不", "很", "将", "已", "not", "also", "ne", "pas", "nicht", "auch", "no"],
    "u": ["的", "地", "得", "了", "着", "过"],
    "f": ["中", "上", "下", "内", "外", "里", "前", "后"],
    "v": ["是", "有", "会", "可以", "困在", "is", "are", "was", "be", "est", "sont", "ist", "sind", "es", "son"],
}
UNKNOWN = "x"


def lexicon(counts: DataFrame, closed: Mapping[str, list[str]] = CLOSED, tag: str = "n") -> DataFrame:
    """(word, tag, cost) from distinct words (word, n): a closed class's tag, or `tag`; the cost is a thousand times the natural
    logarithm of how many words come for each of this one, rounded. Words of closed classes that aren't counted count as one."""
    spark = counts.sparkSession
    known = spark.createDataFrame([(w, t) for t, words in closed.items() for w in words], "closed string, as string").groupBy("closed").agg(F.min("as").alias("as"))
    rows = counts.where("word <> '' AND n > 0").join(F.broadcast(known), F.col("word") == F.col("closed"), "full")
    rows = rows.select(F.coalesce("word", "closed").alias("word"), F.coalesce("as", F.lit(tag)).alias("tag"), F.coalesce("n", F.lit(1)).cast("long").alias("n"))
    total = rows.agg(F.sum("n")).head()[0] or 1
    return rows.select("word", "tag", F.round(F.log(F.lit(float(total)) / F.col("n")) * 1000).cast("long").alias("cost"))


def word_graph(texts: DataFrame, words: DataFrame, unknown: int = 20_000) -> DataFrame:
    """(text, end, edges): for each place of each text the words that end there, as (start, cost, tag). A code point that is no
    word itself is one of cost `unknown`, so every text has a path."""
    longest = words.agg(F.max(F.length("word"))).head()[0] or 1
    n = F.length("text")
    starts = texts.select("text").where(n > 0).select("text", F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    spans = starts.select("text", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), n - F.col("start")))).alias("long"))
    spans = spans.select("text", "start", "long", F.substring("text", F.col("start") + 1, F.col("long")).alias("span"))
    found = spans.join(words, F.col("span") == F.col("word"), "left").where(F.col("cost").isNotNull() | (F.col("long") == 1))
    edge = F.struct("start", F.coalesce("cost", F.lit(unknown).cast("long")).alias("cost"), F.coalesce("tag", F.lit(UNKNOWN)).alias("tag"))
    return found.repartition("text").groupBy("text", (F.col("start") + F.col("long")).alias("end")).agg(F.collect_list(edge).alias("edges"))


def segmented(texts: DataFrame, words: DataFrame, unknown: int = 20_000) -> DataFrame:
    """(text, words array<struct<word, tag>>) of the distinct texts: the path of the least cost; of equal ones that with the longest
    last word, and so on back. `words`: (word, tag, cost), each word once.

    Candidate words come from a join with the lexicon, so that may be of any size; a text's own graph is one row. Null and
    empty texts are left out.
    """
    graph = word_graph(texts.select("text").distinct(), words, unknown)
    rows = graph.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("end", "edges"))).alias("graph"))
    first = F.array(F.struct(F.lit(0).cast("long").alias("cost"), F.lit(0).alias("start"), F.lit("").alias("tag")))

    def best(acc: Column, at: Column) -> Column:
        ways = F.transform(at["edges"], lambda e: F.struct((F.get(acc, e["start"])["cost"] + e["cost"]).alias("cost"), e["start"].alias("start"), e["tag"].alias("tag")))
        return F.concat(acc, F.array(F.array_min(ways)))

    paths = rows.select("text", F.aggregate("graph", first, best).alias("best"))
    n = F.length("text")

    def back(acc: Column, i: Column) -> Column:
        step = F.get(F.col("best"), i)
        word = F.struct(F.substring(F.col("text"), step["start"] + 1, i - step["start"]).alias("word"), step["tag"].alias("tag"))
        return F.when(i == acc["at"], F.struct(step["start"].alias("at"), F.concat(F.array(word), acc["words"]).alias("words"))).otherwise(acc)

    none = F.array().cast("array<struct<word:string,tag:string>>")
    return paths.select("text", F.aggregate(F.sequence(n, F.lit(1), F.lit(-1)), F.struct(n.alias("at"), none.alias("words")), back, lambda a: a["words"]).alias("words"))


def trailing_phrase(text: Column, words: Column) -> Column:
    """STR-19: the content words that a text ends in, without what dangles behind them. Texts of four code points or fewer, those that
    don't end in a content word, and those whose phrase is one code point stay whole."""
    start = F.struct(F.lit(0).alias("phase"), F.lit("").alias("phrase"))

    def step(acc: Column, w: Column) -> Column:
        dangles = (acc["phase"] == 0) & F.substring(w["tag"], 1, 1).isin(TRAILING)
        taken = (acc["phase"] < 2) & w["tag"].isin(CONTENT)
        more = F.struct(F.lit(1).alias("phase"), F.concat(w["word"], acc["phrase"]).alias("phrase"))
        return F.when(dangles, acc).when(taken, more).otherwise(F.struct(F.lit(2).alias("phase"), acc["phrase"].alias("phrase")))

    phrase = F.aggregate(F.reverse(words), start, step, lambda a: a["phrase"])
    return F.when((F.length(text) > 4) & (F.length(phrase) >= 2), phrase).otherwise(text)


def trimmed(rows: DataFrame, column: str, words: DataFrame) -> DataFrame:
    """STR-19: `rows` with a text column cut to its trailing phrase. Each distinct text longer than four code points is segmented once."""
    texts = rows.select(F.col(column).alias("text")).where(F.length(column) > 4)
    cut = segmented(texts, words).select("text", trailing_phrase(F.col("text"), F.col("words")).alias("phrase"))
    out = rows.select(F.struct("*").alias("row"), F.col(column).alias("whole")).join(cut, F.col("whole") == F.col("text"), "left")
    return out.select(*(F.coalesce("phrase", "whole").alias(c) if c == column else F.col("row")[c].alias(c) for c in rows.columns))

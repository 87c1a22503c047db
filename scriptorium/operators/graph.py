"""Chains and degrees of link graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut


def chase(edges: DataFrame, starts: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """GRF-01, GRF-02: (start, final, cycle, hops) for each start, following src -> tgt.

    '' and null mean that the target is not known, and the chain ends there. A chain stops at a node that
    it has seen (cycle) or once `limit` nodes are seen. Each round is one join of the chains still open.
    """
    known = edges.where("tgt IS NOT NULL AND tgt <> ''").select("src", "tgt").dropDuplicates(["src"])
    starts = (edges.select("src") if starts is None else starts.toDF("src")).distinct()
    open_ = starts.select(F.col("src").alias("start"), F.col("src").alias("at"), F.array("src").alias("seen"))
    done = None
    for _ in range(limit):
        again = F.array_contains("seen", F.col("tgt"))
        ended = F.col("tgt").isNull() | again | (F.size("seen") >= limit)
        step = cut(open_.join(known, F.col("at") == F.col("src"), "left").withColumn("ended", ended))
        closed = step.where("ended").select("start", F.col("at").alias("final"), F.coalesce(again, F.lit(False)).alias("cycle"), (F.size("seen") - 1).alias("hops"))
        done = closed if done is None else done.unionByName(closed)
        open_ = step.where("NOT ended").select("start", F.col("tgt").alias("at"), F.concat("seen", F.array("tgt")).alias("seen"))
        if not open_.limit(1).count():
            break
    return done.unionByName(open_.select("start", F.col("at").alias("final"), F.lit(False).alias("cycle"), (F.size("seen") - 1).alias("hops")))


def canonical_target(candidates: DataFrame, edges: DataFrame, rendered: DataFrame) -> DataFrame:
    """GRF-03: (src, final): of each src's candidates, in order of pos, the first whose chain ends at a
    rendered title. candidates: src, pos, candidate."""
    ends = chase(edges, candidates.select("candidate").distinct())
    ok = candidates.join(ends, F.col("candidate") == F.col("start")).join(rendered.select(F.col("title").alias("final")).distinct(), "final", "left_semi")
    return ok.groupBy("src").agg(F.min_by("final", "pos").alias("final"))


def redirect_candidates(edges: DataFrame, suffixes: list[str]) -> DataFrame:
    """(src, pos, candidate) for canonical_target: the target, with blanks for underscores, without its
    bracketed part with each suffix in both kinds of brackets, its parts between slashes, and without
    any bracket."""
    t = F.col("tgt")
    plain = F.replace(t, F.lit("_"), F.lit(" "))
    bare = F.trim(F.regexp_replace(plain, r"[（(][^）)]*[）)]\s*$", ""))
    tries = [t, plain, *(F.concat(bare, F.lit(f"（{s}）")) for s in suffixes), *(F.concat(bare, F.lit(f" ({s})")) for s in suffixes)]
    every = F.array_distinct(F.concat(F.array(*tries), F.split(plain, "/"), F.array(bare)))
    return edges.where("tgt <> ''").select("src", F.posexplode(F.filter(every, lambda c: c != "")).alias("pos", "candidate"))


def version_chain(hops: DataFrame, current: str, latest: str, guard: int = 100) -> DataFrame:
    """GRF-04: one row (steps, n_steps, size_mb) of the hops from current to latest, or none if they
    don't lead there. The chain is a few rows, so the recursion is one query."""
    spark = hops.sparkSession
    hops.createOrReplaceTempView("version_hops")
    return spark.sql(
        """
        WITH RECURSIVE walk(at, depth, steps, size_mb) MAX RECURSION LEVEL 200 AS (
          SELECT :current, 0, CAST(array() AS array<string>), CAST(0 AS double)
          UNION ALL
          SELECT h.to_version, w.depth + 1, concat(w.steps, array(h.url)), w.size_mb + coalesce(h.size_mb, 0)
          FROM walk w JOIN version_hops h ON h.from_version = w.at WHERE w.at <> :latest AND w.depth < :guard)
        SELECT steps, depth AS n_steps, round(size_mb, 2) AS size_mb FROM walk WHERE at = :latest AND depth > 0
        """,
        args={"current": current, "latest": latest, "guard": guard},
    )


def inlinks(links: DataFrame) -> DataFrame:
    """GRF-05, FLT-04: (title, inlinks) over links (title, exists, ns): every occurrence counts."""
    ok = links.where(F.coalesce("exists", F.lit(False)) & F.col("ns").isin(0, 14, 102, 3500) & (F.coalesce("title", F.lit("")) != ""))
    return ok.groupBy("title").agg(F.count(F.lit(1)).alias("inlinks"))


def invert_categories(pages: DataFrame) -> DataFrame:
    """GRF-06: (category, members) of pages (ns, title, categories array<struct<category, sortkey>>), in
    order of sort key, then title."""
    rows = pages.select("ns", "title", F.explode("categories").alias("c"))
    rows = rows.select(F.replace(F.col("c.category"), F.lit("_"), F.lit(" ")).alias("category"), F.lower(F.coalesce(F.nullif(F.col("c.sortkey"), F.lit("")), F.col("title"))).alias("key"), "ns", "title")
    return rows.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("key", "title", "ns"))).alias("members"))


def stub_chains(stubs: DataFrame) -> DataFrame:
    """GRF-07: (self_loops, stub_to_stub) over stubs (src, tgt)."""
    other = stubs.select(F.col("src").alias("next")).distinct()
    both = stubs.join(other, F.col("tgt") == F.col("next"), "left")
    return both.agg(F.count_if(F.col("src") == F.col("tgt")).alias("self_loops"), F.count_if(F.col("next").isNotNull() & (F.col("src") != F.col("tgt"))).alias("stub_to_stub"))


def pseudo_categories(members: DataFrame, pages: DataFrame) -> DataFrame:
    """FLT-07: (category, class): BLOB for names that are lists, B_SYNTH for sets of subpages, A_SELF
    for the only page of its own name, PAGELESS without a page, else PLAIN. members: category, ns, title;
    pages: the categories that have a page (title)."""
    own = members.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.min("ns").alias("ns"), F.min("title").alias("title"))
    own = own.join(pages.select(F.col("title").alias("category"), F.lit(True).alias("has")).distinct(), "category", "left")
    kind = F.when(F.col("category").rlike("[,;，；]"), "BLOB").when(F.col("category").endswith("子页面"), "B_SYNTH")
    kind = kind.when((F.col("n") == 1) & (F.col("ns") == 0) & (F.col("title") == F.col("category")), "A_SELF").when(F.col("has").isNull(), "PAGELESS").otherwise("PLAIN")
    return own.select("category", "n", kind.alias("class"))


def title_index(pages: DataFrame, priority: dict[int, int]) -> DataFrame:
    """JOI-27, WIN-01, WIN-02: (key, dir, fn) of pages (ns, title, dir, bare, fn, ord): full titles, and
    bare ones where no full title is the same, by namespace priority, then order. A file name that differs
    from an earlier one in its directory only by case gets a digest."""
    prio = F.lit(99)
    for ns, p in priority.items():
        prio = F.when(F.col("ns") == ns, p).otherwise(prio)
    clash = F.row_number().over(Window.partitionBy("dir", F.lower("fn")).orderBy("ord"))
    named = pages.withColumn("fn", F.when(clash > 1, F.concat("fn", F.lit("~"), F.substring(F.sha1("title"), 1, 6))).otherwise(F.col("fn")))
    keys = named.withColumn("prio", prio).withColumn("key", F.explode(F.array(F.struct(F.col("title").alias("k"), F.lit(0).alias("b")), F.struct(F.col("bare").alias("k"), F.lit(1).alias("b")))))
    keys = keys.select(F.col("key.k").alias("key"), F.col("key.b").alias("bare_key"), "prio", "ord", "dir", "fn")
    best = keys.groupBy("key").agg(F.min_by(F.struct("dir", "fn"), F.struct("bare_key", "prio", "ord")).alias("p"))
    return best.select("key", "p.dir", "p.fn")


def resolve_links(links: DataFrame, redirects: DataFrame, index: DataFrame) -> DataFrame:
    """JOI-01, JOI-02: `links` (title) plus the page they lead to: of the redirect's target, else of the
    title itself; null if there is none."""
    r = redirects.where("tgt <> ''").select(F.col("src").alias("r_src"), F.col("tgt").alias("r_tgt")).dropDuplicates(["r_src"])
    i = index.select(F.col("key").alias("i_key"), F.concat("dir", F.lit("/"), "fn").alias("i_path"))
    j = index.select(F.col("key").alias("j_key"), F.concat("dir", F.lit("/"), "fn").alias("j_path"))
    out = links.join(r, F.col("title") == F.col("r_src"), "left").join(i, F.col("r_tgt") == F.col("i_key"), "left").join(j, F.col("title") == F.col("j_key"), "left")
    return out.withColumn("path", F.coalesce("i_path", "j_path")).drop("r_src", "r_tgt", "i_key", "i_path", "j_key", "j_path")


def lookup_variants(wanted: DataFrame, table: DataFrame, variants) -> DataFrame:
    """JOI-03, JOI-05: `wanted` (name) joined to `table` (key, value) by the first of the keys that
    `variants`, a column of arrays, gives for a name. value is null if none fits."""
    tries = wanted.select("name").distinct().select("name", F.posexplode(variants).alias("pos", "key"))
    best = tries.join(table, "key").where("value IS NOT NULL").groupBy("name").agg(F.min_by("value", "pos").alias("value"))
    return wanted.join(best, "name", "left")

"""Mix overlapping sources to target weights by min-cost flow.

A document belongs to one or more sources. Every source gets a quota of words; a document may be taken up to
``most`` times, and its r-th copy costs r - 1 a word, so repetition is used only where fresh words run out.

1. **Patterns.** Documents with the same sources are interchangeable for the flow: one row a pattern, with the
   words that it holds.
2. **Quotas.** The sources' weights share the total; a quota stops at ``most`` times its source's words, and the
   excess is shared again by weight until no quota is above. Each round is one aggregate over the sources, and
   the arithmetic is in whole numbers.
3. **Flow.** Words flow from patterns through their sources to the quotas. Only the arcs out of the root cost
   something, and their costs rise with the copy: the least cost is reached by as many maximum flows, one
   after another, as copies are allowed. Patterns that share no source, directly or over others, do not
   affect each other: each component of the pattern-source graph is solved in a task of its own, which holds a row
   for each pattern and source, never one for a document.
4. **Documents.** A pattern that is to give f of its c words gives every document f div c times, and the rest
   from documents in a seeded order, up to the one where the rest is reached: that one gives the words still
   missing. The place in the order is found from sums over 4,096 and again 4,096 ranges of the order's hash, so
   only documents of one range of the second kind are ever sorted together.

The order is the MD5 of the seed and the doc_id, and so is the same in every run.

Edge cases: a null or empty text has size 0 and gives 0 words; a null source is a source of its own, after all
others; a document without any source is in no mix (its source is null in the query, so that does not occur there);
rows that share a doc_id are rows of their own, next to each other in the order by size; rows alike in doc_id and size give
equally many words (the missing words are dealt out among them, rounded down); a null doc_id is ordered by its text; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelsplit.llm.common import row_key, store, table
from panelsplit.llm.components import components

WORDS = r"([^\x20\x09-\x0D]+)"
#: Code points order names; a null sorts behind all others.
_NULL, _NAMED = "1", "0"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def source_key(source: str | Column) -> Column:
    """A name that is never null and sorts as the source, null last."""
    source = F.col(source) if isinstance(source, str) else source
    return F.coalesce(F.concat(F.lit(_NAMED), source), F.lit(_NULL))


def sized_rows(docs: DataFrame, sources: Column, seed: int = 0) -> DataFrame:
    """doc_id, row_key, size, members (sorted source keys), pattern and at (32 hex digits: the place in the seeded order)."""
    known = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    rows = docs.select(
        "doc_id", F.coalesce(row_key(), F.lit(0).cast("long")).alias("row_key"), word_count().alias("size"),
        F.array_sort(F.array_distinct(F.transform(sources, source_key))).alias("members"),
        F.md5(F.concat(F.lit(f"{seed}|"), known).cast("binary")).alias("at"))
    return rows.withColumn("pattern", F.to_json("members"))


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """``sizes`` (source, ...) with rank from 0 by source: sorted in ranges, the ranges numbered by their counts."""
    nth = F.monotonically_increasing_id()
    dealt = store(sizes.repartitionByRange("source").sortWithinPartitions("source")
                  .withColumn("part", F.shiftright(nth, 33)).withColumn("nth", nth.bitwiseAND((1 << 33) - 1)), "ranked-sources")
    ends = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = ends.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row a range
    return dealt.join(before, "part").withColumn("rank", F.col("before") + F.col("nth")).drop("part", "nth", "before")


def quotas(sources: DataFrame, total: int, most: int = 3) -> DataFrame:
    """``sources`` (source, source_size, weight: whole numbers) with target (double) and quota (whole words).

    The sources whose share is above their limit are those below a water level num / den; each round sets the level
    to what their limits leave for the other weights, until no further source is below it.
    """
    limit = (F.col("source_size") * most).cast("decimal(19,0)")

    def above(num: int, den: int) -> Column:
        return limit * F.lit(den).cast("decimal(18,0)") < F.col("weight").cast("decimal(9,0)") * F.lit(num).cast("decimal(19,0)")

    num, den = 0, 1
    while True:
        stopped = above(num, den) if num else F.lit(False)
        r = sources.agg(F.sum(F.when(stopped, limit)).alias("used"), F.sum(F.when(~stopped, F.col("weight"))).alias("free")).collect()[0]
        level = (total - int(r["used"] or 0), int(r["free"] or 0))
        if not level[1] or level[0] * den == num * level[1]:
            break
        num, den = level
    stopped = above(num, den)
    # The exact share is weight * num / den; it is divided once.
    share = F.col("weight").cast("double") * F.lit(float(num)) / F.lit(float(den))
    words = F.expr(f"cast((cast(2 * weight as decimal(10,0)) * cast('{num}' as decimal(19,0)) + {den}) div cast('{2 * den}' as decimal(19,0)) as bigint)")
    return sources.withColumn("target", F.when(stopped, limit.cast("double")).otherwise(share)).withColumn(
        "quota", F.when(stopped, limit.cast("long")).otherwise(words))


def cheapest_flow(supply: dict, demand: dict, arcs: list[tuple], most: int = 3) -> dict:
    """Words on each arc (pattern, source): as much of ``demand`` as can be met, at the least cost, when a pattern gives
    its ``supply`` up to ``most`` times and the r-th time costs r - 1 a word.

    A path that adds to the flow leaves the root by one arc, whose copy is its cost, so paths of cost 0 are used up
    first, then those of cost 1, and so on; each time by Dinic's method.
    """
    patterns, sources = sorted(supply), sorted(demand)
    node = {("p", p): i + 2 for i, p in enumerate(patterns)} | {("s", s): i + 2 + len(patterns) for i, s in enumerate(sources)}
    out = [[] for _ in range(len(node) + 2)]  # arc numbers; arc k ^ 1 is the way back
    head, room = [], []

    def arc(a: int, b: int, words: int) -> int:
        out[a].append(len(head))
        out[b].append(len(head) + 1)
        head.extend((b, a))
        room.extend((words, 0))
        return len(head) - 2

    roots = [(arc(0, node["p", p], 0), supply[p]) for p in patterns]
    inner = {(p, s): arc(node["p", p], node["s", s], most * supply[p]) for p, s in sorted(arcs)}
    for s in sources:
        arc(node["s", s], 1, demand[s])

    def levels():
        level = [-1] * len(out)
        level[0] = 0
        queue = deque([0])
        while queue:
            a = queue.popleft()
            for k in out[a]:
                if room[k] and level[head[k]] < 0:
                    level[head[k]] = level[a] + 1
                    queue.append(head[k])
        return level

    for _ in range(most):
        for k, words in roots:
            room[k] += words
        while (level := levels())[1] >= 0:
            nth = [0] * len(out)
            path = []
            while True:
                a = head[path[-1]] if path else 0
                if a == 1:
                    words = min(room[k] for k in path)
                    for k in path:
                        room[k] -= words
                        room[k ^ 1] += words
                    path = path[:next(i for i, k in enumerate(path) if not room[k])]
                    continue
                while nth[a] < len(out[a]):
                    k = out[a][nth[a]]
                    if room[k] and level[head[k]] == level[a] + 1:
                        path.append(k)
                        break
                    nth[a] += 1
                else:
                    if not path:
                        break
                    path.pop()
                    nth[head[path[-1]] if path else 0] += 1
    return {pair: room[k ^ 1] for pair, k in inner.items()}


def route(patterns: DataFrame, sources: DataFrame, most: int = 3) -> DataFrame:
    """pattern, source, words of the cheapest flow from ``patterns`` (pattern, members, capacity) to the quotas of ``sources``."""
    arcs = patterns.select("pattern", "capacity", F.explode("members").alias("source")).join(sources.select("source", "quota"), "source")
    links = patterns.where(F.size("members") > 1).select(F.col("members")[0].alias("a"), F.explode("members").alias("b")).where("a <> b")
    labels = components(links).withColumnRenamed("id", "source")
    arcs = arcs.join(labels, "source", "left").withColumn("component", F.coalesce("component", "source"))

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        pairs = list(zip(part["pattern"], part["source"]))
        flow = cheapest_flow({p: int(c) for p, c in zip(part["pattern"], part["capacity"])},
                             {s: int(q) for s, q in zip(part["source"], part["quota"])}, pairs, most)
        return pd.DataFrame({"pattern": [p for p, _ in flow], "source": [s for _, s in flow], "words": pd.Series(list(flow.values()), dtype="int64")})

    return arcs.groupBy("component").applyInPandas(solve, "pattern string, source string, words bigint")


def _range_of(digits: int) -> Column:
    """Number of the order's range that ``at`` is in: its hex digits from ``digits`` on, three of them."""
    return F.conv(F.substring("at", digits, 3), 16, 10).cast("int")


def _reached(sums: DataFrame, number: str) -> DataFrame:
    """For sums (pattern, number, words, before_all, rest) the range of each pattern where the rest is reached."""
    upto = F.sum("words").over(Window.partitionBy("pattern").orderBy(number))  # at most 4,096 ranges
    return (sums.withColumn("before", F.col("before_all") + upto - F.col("words"))
            .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words"))).select("pattern", number, "before"))


def select_documents(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` (stored) with taken: words that each gives, when its pattern is to give ``words`` (pattern, capacity, words)."""
    wanted = store(wanted.select(
        "pattern", F.expr("if(capacity = 0, 0, words div capacity)").alias("copies"), F.expr("if(capacity = 0, 0, words % capacity)").alias("rest")), "wanted")
    need = wanted.where("rest > 0").select("pattern", "rest")
    placed = rows.withColumn("r1", _range_of(1)).withColumn("r2", _range_of(4))
    first = placed.join(need, "pattern").groupBy("pattern", "r1").agg(F.sum("size").alias("words"), F.first("rest").alias("rest")).withColumn("before_all", F.lit(0).cast("long"))
    at1 = _reached(first, "r1").withColumnRenamed("before", "before1")
    second = (placed.join(need.join(at1, "pattern"), ["pattern", "r1"]).groupBy("pattern", "r2")
              .agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("before1").alias("before_all")))
    at2 = _reached(second, "r2").withColumnRenamed("before", "before2")
    edge = store(need.join(at1.select("pattern", F.col("r1").alias("e1")), "pattern").join(at2.select("pattern", F.col("r2").alias("e2"), "before2"), "pattern"), "edges")
    # Documents of the range where the rest is reached, alike ones counted first.
    last = (placed.join(edge, "pattern").where("r1 = e1 and r2 = e2").groupBy("pattern", "at", "size")
            .agg(F.count(F.lit(1)).alias("alike"), F.first("rest").alias("rest"), F.first("before2").alias("before2")))
    upto = F.sum(F.col("size") * F.col("alike")).over(Window.partitionBy("pattern").orderBy("at", "size"))
    left = F.col("rest") - F.col("before2") - (upto - F.col("size") * F.col("alike"))
    given = store(last.withColumn("left", F.greatest(left, F.lit(0).cast("long")))
                  .select("pattern", "at", "size", F.least("size", F.expr("left div alike")).alias("part")), "last-documents")
    parts = given.where("part > 0")
    out = placed.join(wanted.select("pattern", "copies"), "pattern", "left").join(edge.select("pattern", "e1", "e2"), "pattern", "left").join(parts, ["pattern", "at", "size"], "left")
    whole = F.when((F.col("r1") < F.col("e1")) | ((F.col("r1") == F.col("e1")) & (F.col("r2") < F.col("e2"))), F.col("size")).otherwise(0)
    taken = F.coalesce("copies", F.lit(0)) * F.col("size") + whole + F.coalesce("part", F.lit(0))
    return out.select(*rows.columns, taken.cast("long").alias("taken"))


def weighted_sources(rows: DataFrame, weights=(1, 2, 3)) -> tuple[DataFrame, DataFrame]:
    """The patterns (pattern, members, capacity) and the sources (source, source_size, weight) of sized rows; by rank the
    sources weigh ``weights``, which repeat."""
    patterns = store(rows.groupBy("pattern").agg(F.first("members").alias("members"), F.sum("size").alias("capacity")), "patterns")
    sizes = patterns.select(F.explode("members").alias("source"), "capacity").groupBy("source").agg(F.sum("capacity").alias("source_size"))
    nth = F.pmod(F.col("rank"), F.lit(len(weights))).cast("int")
    return patterns, ranked_sources(sizes).select("source", "source_size", F.array(*map(F.lit, weights))[nth].alias("weight"))


def mix(docs: DataFrame, sources: Column, weights=(1, 2, 3), most: int = 3, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows with the words taken of each (doc_id, row_key, size, members, taken), the sources (source, source_size,
    weight, target, quota) and the flow (pattern, source, words). ``sources`` is the array of a row's sources."""
    rows = store(sized_rows(docs, sources, seed), "sized")
    patterns, weighed = weighted_sources(rows, weights)
    total = patterns.agg(F.sum("capacity")).collect()[0][0] or 0
    shares = store(quotas(store(weighed, "weighed-sources"), int(total), most), "quotas")
    flow = store(route(patterns, shares, most), "flow")
    wanted = patterns.join(flow.groupBy("pattern").agg(F.sum("words").alias("words")), "pattern").select("pattern", "capacity", "words")
    return select_documents(rows, wanted), shares, flow


def mixed_texts(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """The mix itself: doc_id, copy (from 0) and text, for ``taken`` as ``mix`` gives it. A copy of which only part is taken
    has its first words, joined by a space; whole copies keep their text."""
    of = taken.where("taken > 0").select(F.col("doc_id").alias("t_id"), F.col("row_key").alias("t_key"), "size", "taken").distinct()
    rows = docs.select("doc_id", "text", F.coalesce(row_key(), F.lit(0).cast("long")).alias("d_key"))
    rows = rows.join(of, F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("d_key") == F.col("t_key")))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(taken - 1) div size"))))
    here = F.least("size", F.col("taken") - F.col("copy") * F.col("size"))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORDS), F.lit(1)), 1, here.cast("int")), " ")
    return rows.select("doc_id", "copy", F.when(here == F.col("size"), F.col("text")).otherwise(cut).alias("text"))


def op12_source_mixing(spark, sf_dir: str) -> DataFrame:
    rows, shares, _ = mix(table(spark, sf_dir, "documents"), F.array("source"))
    of = shares.select("source", "source_size", "target")
    return rows.withColumn("source", F.col("members")[0]).join(of, "source").select("doc_id", "size", "source_size", "target", "taken")


OP12_SQL = r"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
           md5('0|' || coalesce(CAST(doc_id AS VARCHAR), 't' || md5(coalesce(text, '')))) AS place
    FROM documents),
s AS (
    SELECT source, CAST(sum(size) AS HUGEINT) AS source_size,
           CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS HUGEINT) AS weight
    FROM d GROUP BY source),
lined AS (  -- by limit to weight: those that stop at their limit come first
    SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS num,
           sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS den
    FROM s
    WINDOW before AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
    SELECT num, den FROM lined WHERE 3 * source_size * den >= weight * num ORDER BY den DESC LIMIT 1),
quota AS (
    SELECT source, source_size, 3 * source_size * l.den < weight * l.num AS stops,
           CASE WHEN 3 * source_size * l.den < weight * l.num THEN CAST(3 * source_size AS DOUBLE)
                ELSE CAST(weight AS DOUBLE) * CAST(l.num AS DOUBLE) / CAST(l.den AS DOUBLE) END AS target,
           CASE WHEN 3 * source_size * l.den < weight * l.num THEN 3 * source_size
                ELSE (2 * weight * l.num + l.den) // (2 * l.den) END AS words
    FROM s, level l),
placed AS (
    SELECT doc_id, d.source, size, source_size, target,
           CASE WHEN source_size = 0 THEN 0 ELSE words // source_size END AS copies,
           CASE WHEN source_size = 0 THEN 0 ELSE words % source_size END AS rest,
           sum(size) OVER (PARTITION BY d.source ORDER BY place, size) AS upto,
           count(*) OVER (PARTITION BY d.source, place, size) AS alike
    FROM d JOIN quota ON d.source IS NOT DISTINCT FROM quota.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(copies * size + greatest(0, least(size, (rest - (upto - alike * size)) // alike)) AS BIGINT) AS taken
FROM placed
"""

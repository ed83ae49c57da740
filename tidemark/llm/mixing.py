"""Mixing sources to target weights, with DataFrame functions only.

Every source gets a target number of words.  Its documents are put in the order of a hash key, the
running sum of their sizes is taken over that order, and the cut falls exactly on the target; a source
whose target is above its size is taken whole as often as it fits before the last, partial epoch.

The order is cut into key ranges ("buckets", as many as the source's row count asks for): range totals
are summed first, their running sums are the offsets, and rows are only ordered within a range.  So a
source that holds a third of all rows is spread over many tasks and no task orders a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, word_count

#: Rows that one key range holds about.
ROWS_PER_RANGE = 512
#: Most key ranges of one source; beyond it ranges hold more rows.
MOST_RANGES = 1 << 20


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """One row per source of ``sizes`` (source, size): place, source_size, n_rows, target.

    Sources in code point order, null last, get ``weights`` in turn and share ``share`` of all words;
    no target is above ``epochs`` times its source's size, and what is cut off there goes to the others
    by weight until none is above.  That end state is target = least(cap, level * weight); with sources
    ordered by cap / weight, the level is the largest of the levels reached by capping the first 0, 1, 2
    ... of them.  This is one small sort over sources, not over documents.  An empty table gives no rows.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    s = (totals.withColumn("place", place)
         .withColumn("weight", F.element_at(turn, (((F.col("place") - 1) % len(weights)) + 1).cast("int")))
         .withColumn("cap", F.col("source_size") * F.lit(float(epochs))))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    s = (s.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
         .withColumn("all_weight", F.sum("weight").over(every))
         .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
         .withColumn("capped_weight", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
         .withColumn("level", (F.col("budget") - F.col("capped")) / (F.col("all_weight") - F.col("capped_weight"))))
    s = s.withColumn("level", F.max("level").over(every))
    return s.select("source", "place", "source_size", "n_rows",
                    F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, epochs: float = 2.0, seed: str = "mix",
        keep: list[str] | None = None) -> DataFrame:
    """Documents with ``size``, ``source_size``, ``target``, ``taken`` (words taken, repeats counted) and
    ``copies`` (``taken`` in whole documents: a document cut by the budget counts if at least half fits).

    ``keep`` names the columns of ``docs`` to carry (all by default); one that is named like a result
    gives way to it.  Null or empty texts have size 0 and take no words; they get the copies of their
    place in the order.  A null source is a source of its own.  The order is by the hash of ``seed`` and
    doc_id, then doc_id and size, so reruns and other partitionings agree; rows that are equal in all of
    these are interchangeable.  A null doc_id is ordered by the hash of the seed alone.
    """
    out = ("size", "source_size", "target", "taken", "copies")
    carried = [c for c in (keep or docs.columns) if c.lower() not in out]
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), "doc_id", "source",
                       word_count(F.col("text")).alias("size"))
    base = cut(base) if "text" not in carried else base
    sources = cut(source_targets(base.select("source", "size"), weights, share, epochs))
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    part = F.conv(F.substring("key", 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))
    ranges = F.least(F.lit(MOST_RANGES), F.ceil(F.col("n_rows") / ROWS_PER_RANGE))
    placed = (base.withColumnRenamed("source", "own").join(sources, F.col("own").eqNullSafe(F.col("source")))
              .withColumn("key", key).withColumn("range", F.floor(part * ranges)))
    # the totals read only sizes and ids
    totals = placed.groupBy("place", "range").agg(F.sum("size").alias("words"))
    offsets = totals.select("place", "range", F.coalesce(F.sum("words").over(
        Window.partitionBy("place").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    within = (Window.partitionBy("place", "range").orderBy("key", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    summed = (placed.join(offsets, ["place", "range"])
              .withColumn("before", F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0))))
    budget, size = F.floor("target"), F.col("size")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - F.col("whole") * F.col("source_size") - F.col("before")
    last = F.greatest(F.lit(0), F.least(size, F.col("rest")))
    return (summed.withColumn("whole", whole.cast("long")).withColumn("rest", rest.cast("long"))
            .select("row.*", "size", "source_size", F.col("target").cast("double").alias("target"),
                    (F.col("whole") * size + last).alias("taken"),
                    (F.col("whole") + F.when((F.col("rest") > 0) & (last * 2 >= size), 1).otherwise(0)).alias("copies")))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as many times as it is taken, with the columns of ``docs``."""
    m = mix(docs.select(F.struct("*").alias("whole_row"), "doc_id", "source", "text"), keep=["whole_row"], **options)
    return m.filter(F.col("copies") > 0).select("whole_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("whole_row.*")


#: DuckDB twin of ``mix`` for the columns of the query.
SQL = r"""
with sized as (
  select doc_id, source, text is not null as has, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size
  from documents),
totals as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
placed as (select *, row_number() over (order by source asc nulls last) as place from totals),
weighted as (select *, cast([3, 1, 2][1 + (place - 1) % 3] as double) as weight, source_size * 2.0::double as cap from placed),
levels as (
  select *, (sum(source_size) over () * 1.5::double
             - coalesce(sum(cap) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0))
            / (sum(weight) over ()
             - coalesce(sum(weight) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0)) as l
  from weighted),
targets as (select source, source_size, least(cap, max(l) over () * weight) as target from levels),
ordered as (
  select d.doc_id, d.size, t.source_size, t.target,
         coalesce(sum(d.size) over (partition by t.source order by md5('mix' || coalesce(cast(d.doc_id as varchar), '')), d.doc_id, d.size
                                    rows between unbounded preceding and 1 preceding), 0) as before,
         case when t.source_size > 0 then floor(floor(t.target) / t.source_size) else 0 end as whole
  from sized d join targets t on d.source is not distinct from t.source)
select doc_id, size, cast(source_size as bigint) as source_size, cast(target as double) as target,
       cast(whole * size + greatest(0, least(size, floor(target) - whole * source_size - before)) as bigint) as taken
from ordered
"""

"""URL filters with dated lists, with DataFrame functions only.

List entries are dated: an entry is added, removed, perhaps added again.  They become validity intervals
[valid_from, valid_to), and every capture is judged by the entries that were active when it was fetched.

Intervals are clipped to calendar months and joined on (value, month) with the dates as a condition.
Dates are days, so one value has at most 31 intervals a month in each list, however often it changed:
the join's output stays in proportion to the captures even if one host holds a third of both sides.
Captures are judged once per (url, day); repeated rows only share the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL, else the empty string."""
    return F.coalesce(F.regexp_extract(F.lower(url), HOST, 1), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals (list, kind, value, valid_from, valid_to) of dated entries.

    ``entries``: list ('block' or 'allow'), kind ('domain' or 'prefix'), value, on (date), action ('add'
    or 'remove').  An entry holds from the day it is added to the day before it is next mentioned; on
    one day a removal comes last.  A removal without an entry does nothing; repeated rows count once.
    Rows with a null in any of these columns say nothing and are left out.  ``valid_to`` is null while
    nothing follows.
    """
    use = ["list", "kind", "value", "on", "action"]
    w = Window.partitionBy("list", "kind", "value").orderBy("on", "action")  # 'add' sorts before 'remove'
    return (entries.select(*use).dropna(subset=use).distinct()
            .withColumn("valid_to", F.lead("on").over(w))
            .filter((F.col("action") == "add") & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("on"))))
            .select("list", "kind", "value", F.col("on").alias("valid_from"), "valid_to"))


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (url, fetched date, any further columns) with host, verdict, rule, rule_list, n_active.

    A 'domain' entry matches its host and all hosts below; a 'prefix' entry is host/segment/... and
    matches paths that start with these whole segments.  Of the active entries that match, a prefix
    counts before a domain and a longer one before a shorter; at the same value 'allow' wins.  verdict is
    'blocked', 'allowed' (by an entry) or 'clean' (no active entry).  A null or malformed url, or a null
    date, is 'clean' with n_active 0.  Result columns replace input columns of the same name.
    """
    out = ("host", "verdict", "rule", "rule_list", "n_active")
    rows = captures.select(*[F.col(f"`{c}`") for c in captures.columns if c.lower() not in out])
    distinct = rows.select("url", "fetched").distinct().withColumn("host", host_of(F.col("url")))
    spans = intervals(entries)
    horizon = captures.agg(F.max("fetched")).first()[0]
    depth = spans.filter("kind = 'prefix'").agg(F.max(F.size(F.split("value", "/")) - 1)).first()[0] or 0
    clipped = (spans.withColumn("valid_to", F.coalesce("valid_to", F.date_add(F.greatest("valid_from", F.lit(horizon).cast("date")), 1)))
               .withColumn("month", F.explode(F.sequence(F.trunc("valid_from", "month"), F.trunc(F.date_sub("valid_to", 1), "month"), F.expr("interval 1 month")))))
    labels = F.split("host", r"\.")
    segments = F.filter(F.split(path_of(F.col("url")), "/"), lambda s: s != "")
    domains = F.transform(F.sequence(F.lit(1), F.size("labels")),
                          lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice("labels", i, F.size("labels")), ".").alias("value")))
    prefixes = F.when(F.size("segments") > 0, F.transform(
        F.sequence(F.lit(1), F.size("segments")),
        lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(F.col("host"), F.lit("/"), F.array_join(F.slice("segments", 1, i), "/")).alias("value"))))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    keys = (distinct.filter((F.col("host") != "") & F.col("fetched").isNotNull())
            .withColumn("labels", labels).withColumn("segments", F.slice(segments, 1, int(depth)) if depth else F.array().cast("array<string>"))
            .withColumn("key", F.explode(F.concat(domains, F.coalesce(prefixes, none))))
            .select("url", "fetched", "key.kind", "key.value", F.trunc("fetched", "month").alias("month")))
    active = (keys.join(clipped, ["kind", "value", "month"])
              .filter((F.col("fetched") >= F.col("valid_from")) & (F.col("fetched") < F.col("valid_to"))))
    rank = F.struct((F.col("kind") == "prefix").cast("int").alias("k"), F.length("value").alias("n"),
                    (F.col("list") == "allow").cast("int").alias("a"), F.col("value"), F.col("list"))
    decided = active.groupBy("url", "fetched").agg(F.max(rank).alias("top"), F.count(F.lit(1)).alias("n_active"))
    return (rows.join(decided.withColumnRenamed("url", "u").withColumnRenamed("fetched", "f"),
                      (F.col("url") == F.col("u")) & (F.col("fetched") == F.col("f")), "left")
            .select(*[F.col(f"`{c}`") for c in rows.columns], host_of(F.col("url")).alias("host"),
                    F.when(F.col("top").isNull(), "clean").when(F.col("top.list") == "allow", "allowed").otherwise("blocked").alias("verdict"),
                    F.col("top.value").alias("rule"), F.col("top.list").alias("rule_list"),
                    F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active")))


# --- the query's captures and lists, derived from the pages table ------------------------------------

def _number(x: Column, of: int) -> Column:
    return F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long") % of


def page_captures(pages: DataFrame) -> DataFrame:
    """Pages as captures; the table has no fetch dates, so a day of 2024 is hashed from the page id."""
    day = _number(F.coalesce(F.col("page_id").cast("string"), F.lit("")), 366)
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), day.cast("int")).alias("fetched"))


def page_lists(pages: DataFrame) -> DataFrame:
    """Dated entries made from the hosts and first path segments that occur in ``pages``.

    A third of the hosts are blocked for some time, and blocked again later; a quarter of the
    first-level prefixes are allowed, a quarter blocked.
    """
    start = F.lit("2024-01-01").cast("date")
    url = pages.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).filter("host <> ''")
    first = F.element_at(F.filter(F.split("path", "/"), lambda s: s != ""), 1)
    domain = url.select(F.lit("block").alias("list"), F.lit("domain").alias("kind"), F.col("host").alias("value"), _number(F.col("host"), 3).alias("pick")).distinct().filter("pick = 0")
    prefix = (url.filter(F.size(F.filter(F.split("path", "/"), lambda s: s != "")) > 0)
              .select(F.concat("host", F.lit("/"), first).alias("value")).distinct()
              .withColumn("pick", _number(F.col("value"), 4)).filter("pick < 2")
              .select(F.when(F.col("pick") == 0, "allow").otherwise("block").alias("list"), F.lit("prefix").alias("kind"), "value", "pick"))
    both = domain.unionByName(prefix)
    at = [(_number(F.concat("value", F.lit("a")), 200), "add"), (_number(F.concat("value", F.lit("a")), 200) + 20 + _number(F.concat("value", F.lit("b")), 60), "remove"),
          (F.lit(300) + _number(F.concat("value", F.lit("c")), 60), "add")]
    event = F.explode(F.array(*[F.struct(F.date_add(start, d.cast("int")).alias("on"), F.lit(a).alias("action")) for d, a in at]))
    return both.withColumn("event", event).select("list", "kind", "value", "event.on", "event.action")


_H = "regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)"
_P = "regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def _n(x: str, of: int) -> str:
    return f"(('0x' || substr(md5({x}), 1, 8))::bigint % {of})"


#: DuckDB twin of the query.
SQL = f"""
with u as (select page_id, url, {_H} as host, list_filter(string_split({_P}, '/'), lambda s: s <> '') as segs,
                  date '2024-01-01' + cast({_n("coalesce(cast(page_id as varchar), '')", 366)} as integer) as fetched from pages),
picked as (
  select distinct 'block' as list, 'domain' as kind, host as value from u where host <> '' and {_n('host', 3)} = 0
  union all
  select case when pick = 0 then 'allow' else 'block' end, 'prefix', value
  from (select value, {_n('value', 4)} as pick from (select distinct host || '/' || segs[1] as value from u where host <> '' and len(segs) > 0)) where pick < 2),
spans as (
  select list, kind, value, date '2024-01-01' + cast({_n("value || 'a'", 200)} as integer) as valid_from,
         date '2024-01-01' + cast({_n("value || 'a'", 200)} + 20 + {_n("value || 'b'", 60)} as integer) as valid_to from picked
  union all
  select list, kind, value, date '2024-01-01' + cast(300 + {_n("value || 'c'", 60)} as integer), date '9999-01-01' from picked),
hits as (
  select u.page_id, u.url, u.fetched, s.list, s.kind, s.value
  from u join spans s on u.fetched >= s.valid_from and u.fetched < s.valid_to and u.host <> ''
   and ((s.kind = 'domain' and (u.host = s.value or ends_with(u.host, '.' || s.value)))
     or (s.kind = 'prefix' and len(segs) > 0 and u.host || '/' || segs[1] = s.value))),
top as (
  select url, fetched, count(distinct (list, kind, value)) as n_active,
         arg_max({{'value': value, 'list': list}}, (case kind when 'prefix' then 1 else 0 end, length(value), case list when 'allow' then 1 else 0 end, value)) as best
  from hits group by url, fetched)
select u.page_id, u.url, u.fetched, u.host,
       case when best is null then 'clean' when best.list = 'allow' then 'allowed' else 'blocked' end as verdict,
       best.value as rule, best.list as rule_list, cast(coalesce(n_active, 0) as bigint) as n_active
from u left join top on u.url = top.url and u.fetched = top.fetched
"""

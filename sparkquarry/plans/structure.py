"""Queries over nested and linked material in the driver's tables: elements of pages, and what leads to what in a user's events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquarry.operators import flow, intervals, labels, prefilter, references
from sparkquarry.streaming import watch

from .corpus import table

#: Elements that are always closed in these pages, and those of them that hold others.
TAGS = "html|head|body|nav|ul|li|a|div|article|h1|footer|title|style|script"
TAG = rf"(</?(?:{TAGS}))[ >]"
HOLDERS = ["head", "nav", "li", "div", "article", "footer", "body"]


def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, tag, lo, hi): elements with the places of their tags among all tags of the page.

    A tag's level is a running count of what is open; an element ends at the next tag of its level.
    """
    tags = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(TAG), F.lit(1))).alias("pos", "t"))
    return spark.sql(
        """
        with d as (select *, sum(case when t like '</%' then -1 else 1 end) over (partition by page_id order by pos) + case when t like '</%' then 1 else 0 end as level from {tags}),
        e as (select *, lead(pos) over (partition by page_id, level order by pos) as hi from d)
        select page_id, replace(t, '<', '') as tag, pos as lo, hi from e where t not like '</%' and hi is not null""",
        tags=tags,
    )


def page_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which element of a page lies in which."""
    e = page_elements(spark, sf_dir)
    value = F.struct("tag", "lo")
    pairs = intervals.contained(e.select("page_id", "lo", "hi", value.alias("outer")), e.select("page_id", F.col("lo").alias("at"), value.alias("inner")), ["page_id"])
    return pairs.select("page_id", F.col("outer.tag").alias("outer_tag"), F.col("outer.lo").alias("outer_at"), F.col("inner.tag").alias("tag"), F.col("inner.lo").alias("tag_at"))


def innermost_holder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest element that holds each element, of those that hold others."""
    e = page_elements(spark, sf_dir)
    holders = e.where(F.col("tag").isin(HOLDERS)).select("page_id", "lo", "hi", F.struct("tag", "lo").alias("outer"))
    pairs = intervals.contained(holders, e.select("page_id", F.col("lo").alias("at"), F.struct("tag", "lo").alias("inner")), ["page_id"], innermost=True)
    return pairs.select("page_id", F.col("outer.tag").alias("holder"), F.col("outer.lo").alias("holder_at"), F.col("inner.tag").alias("tag"), F.col("inner.lo").alias("tag_at"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, node, next, first): events as nodes of their user's graph, with the node that comes next."""
    return spark.sql(
        """
        select user_id, concat(event_type, event_id % 3) as node, lead(concat(event_type, event_id % 3)) over w as next, row_number() over w = 1 as first
        from {events} where user_id is not null window w as (partition by user_id order by ts, event_id)""",
        events=table(spark, sf_dir, "events"),
    )


def _edges(rows: DataFrame) -> DataFrame:
    return rows.where("next is not null").select(F.col("user_id").alias("graph"), F.col("node").alias("a"), F.col("next").alias("b")).distinct()


def marks_through_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the marks of each signup of a user are carried; a purchase lets none through."""
    rows = _events(spark, sf_dir)
    starts = rows.where("node like 'signup%'").select(F.col("user_id").alias("graph"), F.col("node").alias("origin"), "node").distinct()
    kills = rows.where("node like 'purchase%'").select(F.col("user_id").alias("graph"), "node").distinct()
    return flow.carried(starts, _edges(rows), kills).select(F.col("graph").alias("user_id"), "origin", "node")


def event_dominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every way from a user's first event to another passes."""
    rows = _events(spark, sf_dir)
    entries = rows.where("first").select(F.col("user_id").alias("graph"), "node")
    return flow.dominators(_edges(rows), entries).select(F.col("graph").alias("user_id"), "node", "dominator")


def labelled_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who lies below whom by interval labels: customers under their nation and their segment, nations under their region, segments under the first."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    edges = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    edges = edges.union(customer.select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey")))
    edges = edges.union(customer.select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("s"), "c_mktsegment"))).union(customer.select(F.concat(F.lit("s"), "c_mktsegment"), F.lit("r0")).distinct())
    return labels.descendants(edges)


def word_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word of each source and language: does it stand elsewhere, in a later language, in the source's other languages, or in its own?

    The first word of a document is its heading.
    """
    docs = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("unit"), F.coalesce("lang", F.lit("")).alias("owner"), F.posexplode(F.regexp_extract_all("text", F.lit("([A-Za-z]{3,})"), F.lit(1))).alias("pos", "word"))
    uses = docs.select("word", "unit", "owner", (F.col("pos") == 0).alias("heading"))
    langs = table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("")).alias("owner")).distinct()
    later = langs.join(langs.select(F.col("owner").alias("descendant")), F.col("owner") < F.col("descendant"))
    out = references.references(uses.select("word", "unit", "owner").distinct(), uses, later)
    return out.select("word", F.col("home").alias("source"), F.col("owner").alias("lang"), "external", "subclass", F.col("unit").alias("source_too"), F.col("self").alias("own"))


def benchmark_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which first words of benchmark items stand in each document, as the words of a bitset."""
    first = F.regexp_extract("text", "([A-Za-z]+)", 1)
    tokens = [r["w"] for r in table(spark, sf_dir, "benchmark").select(F.lower(first).alias("w")).where("w <> ''").distinct().orderBy("w").collect()]  # some hundred items
    bits = prefilter.token_bits(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", tokens)
    return bits.select("doc_id", F.posexplode("bits").alias("word_no", "bits"))


def accepted_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user as they arrive, by id: those whose value is above all values before, as a watch would let versions of a file through."""
    events = table(spark, sf_dir, "events").where("user_id is not null").select("event_id", "user_id", "value")
    return watch.accepted(events, "user_id", "event_id", "value").select("user_id", "event_id", "value", F.col("generation").cast("long").alias("generation"))


ELEMENTS = rf"""
t as (select page_id, regexp_extract_all(html, '(</?(?:{TAGS}))[ >]', 1) as l from pages),
x as (select page_id, unnest(l) as t, (generate_subscripts(l, 1) - 1)::int as pos from t),
d as (select *, sum(case when t like '</%' then -1 else 1 end) over (partition by page_id order by pos) + case when t like '</%' then 1 else 0 end as level from x),
n as (select *, lead(pos) over (partition by page_id, level order by pos) as hi from d),
e as (select page_id, replace(t, '<', '') as tag, pos as lo, hi from n where t not like '</%' and hi is not null)"""
EVENTS = """
v as (select user_id, event_type || (event_id % 3) as node, lead(event_type || (event_id % 3)) over w as next, row_number() over w = 1 as first
  from events where user_id is not null window w as (partition by user_id order by ts, event_id)),
e as (select distinct user_id, node as a, next as b from v where next is not null)"""

SQL = {
    "accepted_versions": """
with a as (select user_id, event_id, value, max(value) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as before from events where user_id is not null)
select user_id, event_id, value, row_number() over (partition by user_id order by event_id) as generation from a where value is not null and (before is null or value > before)""",
    "labelled_descendants": """
with recursive e as (select 'n' || n_nationkey as child, 'r' || n_regionkey as parent from nation union select 'c' || c_custkey, 'n' || c_nationkey from customer
  union select 'c' || c_custkey, 's' || c_mktsegment from customer union select 's' || c_mktsegment, 'r0' from customer),
up as (select parent as ancestor, child as node from e union select e.parent, up.node from up join e on e.child = up.ancestor)
select ancestor, node from up""",
    "word_uses": """
with t as (select coalesce(source, '') as source, coalesce(lang, '') as lang, regexp_extract_all(text, '([A-Za-z]{3,})', 1) as l from documents),
w as (select source, lang, unnest(l) as word, generate_subscripts(l, 1) = 1 as heading from t),
u as (select distinct * from w), m as (select distinct word, source, lang from u)
select m.word, m.source, m.lang, max((u.source <> m.source and not (u.lang > m.lang) and not (u.lang = m.lang and u.heading))::int) as external, max((u.lang > m.lang)::int) as subclass,
  max((u.source = m.source and u.lang <> m.lang)::int) as source_too, max((u.source = m.source and u.lang = m.lang and not u.heading)::int) as own
from m join u on u.word = m.word group by 1, 2, 3""",
    "benchmark_tokens": """
with k as (select distinct lower(regexp_extract(text, '([A-Za-z]+)', 1)) as w from benchmark where regexp_extract(text, '([A-Za-z]+)', 1) <> ''),
n as (select w, row_number() over (order by w) - 1 as i from k),
b as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
s as (select distinct i // 64 as word_no from n),
x as (select doc_id, i // 64 as word_no, sum(case when i % 64 = 63 then -9223372036854775808::hugeint else (1::hugeint << (i % 64)::int) end) as bits from b join n on contains(t, w) group by 1, 2)
select b.doc_id, s.word_no::int as word_no, coalesce(x.bits, 0)::bigint as bits from b cross join s left join x on x.doc_id = b.doc_id and x.word_no = s.word_no""",
    "page_containment": f"with {ELEMENTS} select a.page_id, a.tag as outer_tag, a.lo as outer_at, b.tag, b.lo as tag_at from e a join e b on a.page_id = b.page_id and b.lo > a.lo and b.lo <= a.hi",
    "innermost_holder": f"""with {ELEMENTS} select b.page_id, arg_max(a.tag, a.lo) as holder, max(a.lo) as holder_at, b.tag, b.lo as tag_at from e a join e b on a.page_id = b.page_id and b.lo > a.lo and b.lo <= a.hi
        where a.tag in ({", ".join(f"'{h}'" for h in HOLDERS)}) group by b.page_id, b.tag, b.lo""",
    "marks_through_events": f"""with recursive {EVENTS},
        r as (select distinct user_id, node as origin, node from v where node like 'signup%' union select r.user_id, r.origin, e.b from r join e on e.user_id = r.user_id and e.a = r.node where e.b not like 'purchase%')
        select user_id, origin, node from r""",
    "event_dominators": f"""with recursive {EVENTS},
        s as (select user_id, node from v where first),
        reach as (select user_id, node from s union select e.user_id, e.b from reach r join e on e.user_id = r.user_id and e.a = r.node),
        avoid as (select s.user_id, d.node as without, s.node from s join reach d on d.user_id = s.user_id and d.node <> s.node
          union select e.user_id, r.without, e.b from avoid r join e on e.user_id = r.user_id and e.a = r.node and e.b <> r.without)
        select n.user_id, n.node, d.node as dominator from reach n join reach d on d.user_id = n.user_id left join avoid a on a.user_id = n.user_id and a.without = d.node and a.node = n.node where a.node is null""",
}

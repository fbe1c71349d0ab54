"""Playlist tree: closure, integrity, plans, proofs."""

from pyspark.sql import functions as F

from tonearm.operators import tree
from tonearm.sources.views import MEMBERS_SQL, TREE_SQL, members
from tonearm.sources.views import tree as tree_view

from .registry import query

_T = f"with recursive t as ({TREE_SQL}), m as ({MEMBERS_SQL})"


@query(f"""{_T}, w(a, n) as (select id, id from t union all select w.a, t.id from w join t on t.parent = w.n)
  select a as id, count(distinct item) as items from w join m on m.id = w.n group by a""")
def tree_closure_members(spark, sf_dir):
    """Items of each folder and all below it."""
    down = tree.descendants(tree_view(spark, sf_dir).select("id", "parent"))
    return down.join(members(spark, sf_dir), F.col("node") == F.col("id")).groupBy(F.col("ancestor").alias("id")).agg(F.count_distinct("item").alias("items"))


_BROKEN_SQL = """(select id, case when id = 'n3' then 'gone' when id = 'n5' then 'n6' when id = 'n6' then 'n5' else parent end as parent, name, kind from t)"""


def broken(spark, sf_dir):
    """The tree with one dangling parent and one cycle."""
    parent = F.when(F.col("id") == "n3", "gone").when(F.col("id") == "n5", "n6").when(F.col("id") == "n6", "n5").otherwise(F.col("parent"))
    return tree_view(spark, sf_dir).withColumn("parent", parent)


@query(f"""{_T}, b as {_BROKEN_SQL}, r(id) as (select id from b where parent is null union select b.id from r join b on b.parent = r.id)
  select id, case when parent is not null and parent not in (select id from b) then 'dangling' when id not in (select id from r) then 'unrooted' else 'ok' end as problem from b""")
def tree_integrity(spark, sf_dir):
    return tree.integrity(broken(spark, sf_dir).select("id", "parent"))


_PLAN_SQL = """(select id, case when id in ('n1', 'n2') then 'x1' else parent end as parent, case when id = 'r0' then 'renamed' else name end as name from t where id not in ('c7', 'c8') union all select 'x1', 'root', 'new')"""


def plan(spark, sf_dir):
    nodes = tree_view(spark, sf_dir)
    make = spark.createDataFrame
    deletes = make([("c7",), ("c8",)], "id string")
    after = tree.overlay(nodes, make([("x1", "root", "new")], "id string, parent string, name string"), make([("r0", "renamed")], "id string, to_name string"), make([("n1", "x1"), ("n2", "x1")], "id string, to_parent string"), deletes)
    return nodes, after, deletes


@query(f"{_T} select * from {_PLAN_SQL}")
def tree_plan_overlay(spark, sf_dir):
    return plan(spark, sf_dir)[1]


@query(f"{_T} select distinct item from m where item not in (select item from m where id in (select id from {_PLAN_SQL}))")
def tree_orphans(spark, sf_dir):
    _, after, _ = plan(spark, sf_dir)
    return tree.orphans(members(spark, sf_dir), after)


@query(f"""{_T}, a as {_PLAN_SQL}, am as (select * from m where id in (select id from a))
  select (select count(*) from t) as nodes_before, (select count(*) from a) as nodes_after, (select count(distinct item) from m) as items_before, (select count(distinct item) from am) as items_after,
  (select count(distinct item) from m where item not in (select item from am)) as lost, 0::bigint as bad,
  case when (select count(distinct item) from m where item not in (select item from am)) = 0 then 'PASS' else 'FAIL' end as verdict""")
def tree_invariants(spark, sf_dir):
    before, after, _ = plan(spark, sf_dir)
    m = members(spark, sf_dir)
    return tree.invariants(before, after, m, m.join(after.select("id"), "id", "left_semi"))


@query(f"""{_T}, r as (select 'c' || (range * 7) as id, 'folder' as wanted from range(40) union all select 'n' || range, 'folder' from range(40) union all select 'zz', 'list')
  select r.id, wanted, case when kind is null then 'missing' else 'wrong kind' end as problem from r left join t on t.id = r.id where kind is null or kind <> wanted""")
def tree_reference_errors(spark, sf_dir):
    refs = spark.range(40).select(F.concat(F.lit("c"), (F.col("id") * 7).cast("string")).alias("id"), F.lit("folder").alias("wanted"))
    refs = refs.unionByName(spark.range(40).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"), F.lit("folder").alias("wanted"))).unionByName(spark.createDataFrame([("zz", "list")], "id string, wanted string"))
    return tree.plan_errors(tree_view(spark, sf_dir), refs)


@query(f"""{_T}, d as (select id from t where id in ('c7', 'c8', 'n1', 'r0', 'c9')) select id from d where id in (select id from m) or id in (select parent from t where id not in (select id from d))""")
def tree_nonempty_deletes(spark, sf_dir):
    d = tree_view(spark, sf_dir).where(F.col("id").isin("c7", "c8", "n1", "r0", "c9")).select("id")
    return tree.nonempty_deletes(tree_view(spark, sf_dir), members(spark, sf_dir), d)


@query(f"{_T}, names as (select unnest(['AFRICA', 'africa', 'Brazil', 'none']) as wanted) select wanted, min(t.id) as id from names left join t on lower(t.name) = lower(wanted) and t.kind = 'folder' group by wanted")
def tree_name_lookup(spark, sf_dir):
    names = spark.createDataFrame([(x,) for x in ("AFRICA", "africa", "Brazil", "none")], "wanted string")
    t = tree_view(spark, sf_dir).where("kind = 'folder'")
    return names.join(t, F.lower("name") == F.lower("wanted"), "left").groupBy("wanted").agg(F.min("id").alias("id"))

"""Queries on density clustering and dimension reduction."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.catalog import query, table
from flowsieve.operators.components import connected_components
from flowsieve.operators.density import density_cluster
from flowsieve.operators.reduce import explained_variance

_EPS_1D = 40.0


@query(f"""with p as (select c_custkey, floor(c_acctbal / ({_EPS_1D}::double / 2)) as cell from customer),
d as (select *, count(*) over (order by cell range between 2 preceding and 2 following) as density from p),
core as (select * from d where density >= 10),
gap as (select *, case when cell - lag(cell) over (order by cell) <= 2 then 0 else 1 end as fresh from core),
isle as (select *, sum(fresh) over (order by cell rows unbounded preceding) as run from gap),
-- rows of one cell may differ in 'fresh' by position only when the gap test is 0 for all but the first
big as (select run, min(c_custkey) as first_id, max(density) as peak from isle group by run having count(*) >= 20),
named as (select run, peak, row_number() over (order by first_id) - 1 as cluster_label from big),
l as (select c_custkey, cluster_label, density / peak as prob from isle join named using (run))
select c_custkey, cast(coalesce(cluster_label, -1) as int) as cluster_label, round(coalesce(prob, 0.0), 6) as cluster_probability
from p left join l using (c_custkey)""")
def density_1d(spark, sf_dir):
    """Customers grouped by account balance; the oracle walks gaps and islands."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    out = density_cluster(customers, "c_custkey", ["c_acctbal"], _EPS_1D, 10, 20)
    return out.select("c_custkey", "cluster_label", F.round("cluster_probability", 6).alias("cluster_probability"))


def _thirds_sql() -> str:
    parts = [(1, 21), (22, 42), (43, 64)]
    return ", ".join(
        f"cast(floor(list_sum(list_transform(embedding[{a}:{b}], lambda x: x::double)) / 0.15::double) as bigint) as g{i}"
        for i, (a, b) in enumerate(parts))


@query(f"""with recursive p as (select vec_id, {_thirds_sql()} from embeddings),
cell as (select g0, g1, g2, count(*) as weight, min(vec_id) as node from p group by all),
near as (select a.node as u, b.node as v, b.weight from cell a join cell b
 on (a.g0 - b.g0) * (a.g0 - b.g0) + (a.g1 - b.g1) * (a.g1 - b.g1) + (a.g2 - b.g2) * (a.g2 - b.g2) <= 4),
dens as (select u as node, sum(weight) as density from near group by u),
core as (select node, density from dens where density >= 10),
link as (select u, v from near where u in (select node from core) and v in (select node from core)),
reach(root, node) as (select node, node from core union select r.root, l.v from reach r join link l on l.u = r.node),
grp as (select node, min(root) as root from reach group by node),
size as (select root, sum(weight) as n, max(density) as peak from grp join core using (node) join cell using (node)
 group by root having sum(weight) >= 20),
named as (select root, peak, row_number() over (order by root) - 1 as cluster_label from size)
select p.vec_id, cast(coalesce(cluster_label, -1) as int) as cluster_label,
 round(coalesce(density / peak, 0.0), 6) as cluster_probability
from p join cell using (g0, g1, g2) left join grp on grp.node = cell.node left join named using (root)
left join core on core.node = cell.node""")
def density_embeddings(spark, sf_dir):
    """Vectors grouped in three dimensions, the sums over the thirds of each vector."""
    def part(a: int, n: int):
        return F.aggregate(F.slice("embedding", a, n), F.lit(0.0), lambda s, x: s + x.cast("double"))

    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", part(1, 21).alias("x"), part(22, 21).alias("y"), part(43, 22).alias("z"))
    out = density_cluster(vectors, "vec_id", ["x", "y", "z"], 0.3, 10, 20)
    return out.select("vec_id", "cluster_label", F.round("cluster_probability", 6).alias("cluster_probability"))


_PLACED = "case when o_orderkey <= 3 then 1e9 * (1 + o_orderkey) else {center} + {width} * ({u} - floor({u})) end"


def _at(axis: int) -> str:
    """A coordinate of four planted groups: two dense ones near each other, two wide ones far off; three rows lie farther."""
    pick = lambda values: f"case o_orderkey % 4 when 0 then {values[0]} when 1 then {values[1]} when 2 then {values[2]} else {values[3]} end"
    center = pick([(0, 40, 0, 4000), (0, 0, 4000, 4000)][axis])
    share = f"(o_orderkey * cast({[0.7548776662466927, 0.5698402909980532][axis]} as double))"
    return _PLACED.format(center=center, width=pick((2, 2, 500, 500)), u=share)


@query(f"""with p as (select o_orderkey, case when o_orderkey <= 3 then null else o_orderkey % 4 end as g from orders),
n as (select g, row_number() over (order by min(o_orderkey)) - 1 as label from p where g is not null group by g)
select o_orderkey, cast(coalesce(label, -1) as int) as cluster_label from p left join n using (g)""")
def density_levels(spark, sf_dir):
    """Groups of unlike density among orders placed by their key, without a radius; three far rows are noise."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.expr(f"cast({_at(0)} as double)").alias("x"), F.expr(f"cast({_at(1)} as double)").alias("y"))
    return density_cluster(orders, "o_orderkey", ["x", "y"]).select("o_orderkey", "cluster_label")


#: Steps the oracle of ``components`` takes; the graph's diameter is smaller.
_HOPS = 10


def _components_sql() -> str:
    steps = [f"""l{i} as (select node, min(root) as root from (select node, root from l{i - 1}
 union all select b.v, l.root from both_ways b join l{i - 1} l on b.u = l.node) group by node)""" for i in range(1, _HOPS + 1)]
    return f"""with e as (select distinct l_suppkey as u, -1 - l_partkey as v from lineitem),
both_ways as materialized (select u, v from e union select v, u from e),
l0 as (select distinct u as node, u as root from both_ways), {', '.join(steps)}
select node, root from l{_HOPS}"""


@query(_components_sql())
def components(spark, sf_dir):
    """Suppliers and parts linked by orders: connected components. The oracle spreads the lowest label step by step."""
    return connected_components(table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("u"), (-1 - F.col("l_partkey")).alias("v")))


@query("""with v as (select var_samp(l_discount) as a, var_samp(l_tax) as b, covar_samp(l_discount, l_tax) as c from lineitem),
e as (select (a + b) / 2 as mid, sqrt((a - b) * (a - b) / 4 + c * c) as half from v)
select cast(i as int) as component, round(case when i = 0 then mid + half else mid - half end / (2 * mid), 6) as share
from e, (values (0), (1)) t(i)""")
def pca_two_columns(spark, sf_dir):
    """Variance shares of two columns; the oracle solves the quadratic equation."""
    shares = explained_variance(table(spark, sf_dir, "lineitem"), ["l_discount", "l_tax"], 2)
    return spark.createDataFrame(
        [(i, round(v, 6)) for i, v in enumerate(shares)], "component int, share double")


@query()
def pca_variance(spark, sf_dir):
    """Variance shares of the first five principal components of the line item measures."""
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
    rows = table(spark, sf_dir, "lineitem")
    shares = explained_variance(rows, columns, 5)
    return spark.createDataFrame(
        [(i, round(v, 9)) for i, v in enumerate(shares)], "component int, share double")

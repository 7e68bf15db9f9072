"""Views of the test tables in DuckDB's SQL, the same as those of `sources.matrix`."""

EMB = "emb as (select vec_id as sample_id, label, list_transform(embedding, lambda x: x::double) as f from embeddings)"
ARCH = "arch as (select 'archetype_' || (sample_id + 1) as arch, sample_id + 1 as arch_id, f as p from emb where sample_id < 3)"
DIST = "dist as (select sample_id, arch, round(list_distance(f, p), 6) as dist from emb, arch)"
BINS = """bins as (select arch, sample_id from (
  select *, row_number() over (partition by arch order by dist, sample_id) as rn, count(*) over (partition by arch) as n from dist) where rn <= round_even(n * 0.1, 0))"""
EMB_LONG = "long_ as (select sample_id, 'V' || i as feature, f[i] as value from emb, range(1, 65) t(i))"
CNT = "cnt as (select user_id as sample_id, event_type as feature, count(*)::double as value from events group by 1, 2)"
CNT_FULL = """cnt_long as (
  select u.sample_id, e.feature, coalesce(c.value, 0.0::double) as value from (select distinct sample_id from cnt) u, (select distinct feature from cnt) e
  left join cnt c on c.sample_id = u.sample_id and c.feature = e.feature)"""
QTY = "qty as (select l_suppkey as sample_id, l_partkey::varchar as feature, sum(l_quantity) as value from lineitem group by 1, 2)"
EMB_ALL = f"{EMB}, {ARCH}, {DIST}, {BINS}"


def ranks(table: str) -> str:
    """ranked: average rank of each value within its feature."""
    return f"""ranked as (select *, rank() over (partition by feature order by value) + (count(*) over (partition by feature, value) - 1) / 2.0::double as r,
  count(*) over (partition by feature, value) as t, count(*) over (partition by feature) as n from {table})"""


def rank_test(table: str, bins: str = "bins") -> str:
    """tests: the rank statistics of each archetype and feature."""
    return f"""{ranks(table)},
per as (select feature, n, sum(value) as sum_all, sum((t * t - 1)::double) as ties from ranked group by 1, 2),
got as (select b.arch, r.feature, count(*)::double as n1, sum(r.r) as r1, sum(r.value) as s1 from ranked r join {bins} b on b.sample_id = r.sample_id group by 1, 2),
parts as (select *, n1 * (n - n1) / 12 * ((n + 1) - ties / (n::double * (n - 1))) as var, r1 - n1 * (n1 + 1) / 2 as u from got join per using (feature)),
tests as (select arch as x_name, feature as y_name, n1 as sample_count, u, case when var > 0 then (u - n1 * (n - n1) / 2 - 0.5) / sqrt(var) end as z,
  s1 / n1 - (sum_all - s1) / (n - n1) as mean_diff, s1 / n1 as top_bin_mean from parts)"""

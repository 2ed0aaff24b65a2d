"""Oracle SQL of the catalogue: each query as DuckDB runs it on the same tables."""

ORACLE_SQL: dict[str, str] = {
    # getitem list
    "project_keep_index": """select o_totalprice, o_orderkey from orders""",
    # take(mask)
    "filter_mask": """select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice > 100000""",
    # take(indexes)
    "take_positions": """select v.k, o.o_orderkey, o.o_totalprice from (select *, row_number() over (order by o_orderkey)-1 as pos from orders) o join (values (0,0),(1,5),(2,5),(3,14999)) v(k,p) on o.pos = v.p""",
    # iloc[10:100:7]
    "iloc_slice": """select pos, o_orderkey from (select *, row_number() over (order by o_orderkey)-1 as pos from orders) o where pos >= 10 and pos < 100 and (pos-10) % 7 = 0""",
    # iloc[int]
    "iloc_row": """select o_orderkey, o_custkey from (select *, row_number() over (order by o_orderkey)-1 as pos from orders) o where pos = 42""",
    # setitem scalar
    "set_column_scalar": """select o_orderkey, cast(2 as bigint) as flag from orders""",
    # rename
    "rename_swap": """select o_custkey as o_orderkey, o_orderkey as o_custkey from orders""",
    # astype
    "astype_trunc": """select o_orderkey, cast(trunc(o_totalprice) as bigint) as total from orders""",
    # isnull/notnull
    "isnull_mask": """select doc_id, quality is null as isnull, quality is not null as notnull from (select d.doc_id, l.quality from documents d left join labels l using (doc_id)) t""",
    # fillna
    "fillna_column": """select d.doc_id, coalesce(l.quality, 5) as quality from documents d left join labels l on d.doc_id = l.doc_id""",
    # isin
    "isin_mask": """select o_orderkey, coalesce(o_orderpriority in ('1-URGENT','2-HIGH'), false) as m from orders""",
    # isin invert
    "isin_invert": """select o_orderkey, not coalesce(o_orderpriority in ('1-URGENT','2-HIGH'), false) as m from orders""",
    # nonemin/nonemax
    "nonemin_nonemax": """select min(value) as lo, max(value) as hi from events where value is not null and not isnan(value)""",
    # unique
    "unique_sorted": """select distinct o_orderpriority, dense_rank() over (order by o_orderpriority) as r from orders""",
    # duplicated keep=first
    "duplicated_first": """select o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) > 1 as dup from orders""",
    # duplicated keep=last
    "duplicated_last": """select o_orderkey, row_number() over (partition by o_custkey order by o_orderkey desc) > 1 as dup from orders""",
    # drop_duplicates first
    "drop_duplicates_first": """select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderkey) rn from orders) t where rn = 1""",
    # drop_duplicates last
    "drop_duplicates_last": """select o_custkey, o_orderstatus, o_orderkey from (select *, row_number() over (partition by o_custkey, o_orderstatus order by o_orderkey desc) rn from orders) t where rn = 1""",
    # drop_duplicates()
    "drop_duplicates_all": """select distinct l_returnflag, l_linestatus from lineitem""",
    # sort_values multi asc
    "sort_values_rank": """select o_orderkey, row_number() over (order by o_orderstatus, o_totalprice, o_orderkey) as r from orders""",
    # sort_values desc (ties reversed)
    "sort_values_desc_ties": """select o_orderkey, row_number() over (order by o_orderpriority desc, o_orderkey desc) as r from orders""",
    # sort_values na_position=last
    "sort_na_last": """select doc_id, row_number() over (order by quality asc nulls last, doc_id) as r from (select d.doc_id, l.quality from documents d left join labels l on d.doc_id=l.doc_id) t""",
    # sort_values desc na_position=first
    "sort_na_first_desc": """select doc_id, row_number() over (order by quality desc nulls first, doc_id desc) as r from (select d.doc_id, l.quality from documents d left join labels l on d.doc_id=l.doc_id) t""",
    # groupby + add.reduceat
    "groupby_sum": """select l_returnflag, l_linestatus, cast(sum(l_linenumber) as bigint) as s, round(sum(l_quantity),2) as q, count(*) as c from lineitem group by l_returnflag, l_linestatus""",
    # maximum/minimum.reduceat
    "groupby_minmax": """select o_custkey, min(o_totalprice) as lo, max(o_totalprice) as hi from orders group by o_custkey""",
    # logical_and/or.reduceat
    "groupby_bool": """select o_custkey, bool_and(o_totalprice > 1000) as a, bool_or(o_orderstatus='F') as o from orders group by o_custkey""",
    # Grouper.counts
    "groupby_counts": """select o_custkey, o_orderstatus, count(*) as c from orders group by o_custkey, o_orderstatus""",
    # Grouper.group_indexes
    "groupby_group_indexes": """select o_custkey, min(pos) as first_pos from (select *, row_number() over (order by o_orderkey)-1 as pos from orders) o group by o_custkey""",
    # Grouper.__iter__
    "groupby_iter": """select o_custkey, string_agg(cast(pos as varchar), ',' order by pos) as idx from (select *, row_number() over (order by o_orderkey)-1 as pos from orders) o group by o_custkey""",
    # groupby(array)
    "groupby_external": """select pos % 2 as k, count(*) as c from (select *, row_number() over (order by o_orderkey)-1 as pos from orders) o group by pos % 2""",
    # explode
    "explode_array": """select vec_id, label, unnest(embedding) as embedding from embeddings""",
    # explode: empty dropped, null kept
    "explode_null_empty": """select vec_id, unnest(case when vec_id % 3 = 0 then [cast(null as float)] when vec_id % 3 = 1 then cast([] as float[]) else embedding end) as e from embeddings""",
    # concat
    "concat_strict": """select n_nationkey, n_name from nation union all select n_nationkey, n_name from nation where n_nationkey < 5""",
    # concat strict=False
    "concat_nonstrict": """select c_custkey, c_acctbal, cast(0 as bigint) as s_suppkey from customer union all select cast(0 as bigint), s_acctbal, s_suppkey from supplier""",
    # join left, zero fill
    "join_left_fill": """select c.c_custkey, c.c_name, coalesce(g.n, 0) as n from customer c left join (select o_custkey, count(*) as n from orders group by o_custkey) g on c.c_custkey = g.o_custkey""",
    # join left dup keys in first
    "join_left_dupes": """select o.o_custkey, o.o_orderkey, c.c_mktsegment from orders o left join customer c on o.o_custkey = c.c_custkey""",
    # join inner x3
    "join_inner_three": """select a.n_nationkey, a.n_name, b.c, d.s from nation a join (select c_nationkey, count(*) as c from customer group by c_nationkey) b on a.n_nationkey=b.c_nationkey join (select s_nationkey, count(*) as s from supplier group by s_nationkey) d on a.n_nationkey=d.s_nationkey""",
    # join right
    "join_right": """select c.c_custkey, coalesce(g.n,0) as n, c.c_acctbal from (select o_custkey, count(*) as n from orders group by o_custkey) g right join customer c on g.o_custkey=c.c_custkey""",
    # join outer
    "join_outer": """select coalesce(d.doc_id, l.doc_id) as doc_id, d.n_chars is not null as in_l, coalesce(d.n_chars, 0) as n_chars, coalesce(l.quality, 0) as quality from (select * from documents where lang = 'en') d full join labels l on d.doc_id = l.doc_id""",
    # join, null keys match (H3)
    "join_nullsafe": """select a.k, a.v, b.w from (select quality as k, count(*) as v from (select d.doc_id, l.quality from documents d left join labels l on d.doc_id=l.doc_id) t group by quality) a join (select quality as k, max(doc_id) as w from (select d.doc_id, l.quality from documents d left join labels l on d.doc_id=l.doc_id) t group by quality) b on a.k is not distinct from b.k""",
    # join suffixes
    "join_suffix": """select a.o_custkey, a.n, coalesce(b.n, 0) as n_ from (select o_custkey, count(*) as n from orders group by o_custkey) a left join (select o_custkey, count(*) as n from orders where o_orderstatus='F' group by o_custkey) b on a.o_custkey=b.o_custkey""",
    # join without suffix (overlay)
    "join_overlay": """select a.o_custkey, case when b.o_custkey is not null then b.n else a.n end as n from (select o_custkey, count(*) as n from orders group by o_custkey) a left join (select o_custkey, 100 as n from orders where o_orderstatus='F' group by o_custkey) b on a.o_custkey=b.o_custkey""",
    # Index.is_unique
    "index_is_unique": """select count(*) = count(distinct o_custkey) as is_unique from orders""",
    # is_monotonic_increasing
    "index_is_monotonic": """select coalesce(bool_and(case when p1 is null then true when p1 < l_orderkey then true when p1 = l_orderkey then p2 <= l_linenumber else false end), true) as mono from (select l_orderkey, l_linenumber, lag(l_orderkey) over (order by l_orderkey, l_linenumber) p1, lag(l_linenumber) over (order by l_orderkey, l_linenumber) p2 from lineitem) t""",
    # Index.diff
    "index_diff": """select a.o_custkey, min(a.pos) as pos from (select *, row_number() over (order by o_orderkey)-1 as pos from orders) a where not exists (select 1 from customer b where b.c_custkey = a.o_custkey and b.c_acctbal > 0) group by a.o_custkey""",
    # reset_index(drop)
    "set_reset_index_drop": """select o_custkey, o_totalprice from orders""",
    # native intersection
    "sorted_intersection": """select c_custkey as k from customer intersect select o_custkey from orders""",
    # shape
    "shape": """select count(*) as rows, cast(6 as bigint) as cols from orders""",
    # merge_to_str on two int64
    "key_merge": """select o_orderkey, concat(lpad(hex(o_orderkey),16,'0'), lpad(hex(o_custkey),16,'0'), '3B') as h from orders""",
    # join, two index levels
    "join_multilevel": """select a.o_custkey, a.o_orderstatus, a.n, coalesce(b.m, 0) as m from (select o_custkey, o_orderstatus, count(*) as n from orders group by o_custkey, o_orderstatus) a left join (select o_custkey, o_orderstatus, count(*) as m from orders where o_totalprice > 100000 group by o_custkey, o_orderstatus) b on a.o_custkey is not distinct from b.o_custkey and a.o_orderstatus is not distinct from b.o_orderstatus""",
    # join outer x3 with fills
    "join_outer_three": """select coalesce(a.k, b.k, c.k) as k, coalesce(a.n,0) as an, coalesce(b.n,0) as bn, coalesce(c.n,0) as cn from (select p_size as k, count(*) as n from part where p_size < 20 group by p_size) a full join (select p_size as k, count(*) as n from part where p_size > 10 group by p_size) b on a.k=b.k full join (select p_size as k, count(*) as n from part where p_size % 5 = 0 group by p_size) c on coalesce(a.k,b.k)=c.k""",
    # isin(column of another frame)
    "semi_join_isin": """select o_orderkey from orders o where exists (select 1 from customer c where c.c_custkey=o.o_custkey and c.c_mktsegment='BUILDING')""",
    # isin(invert) of another frame
    "anti_join_isin_invert": """select o_orderkey from orders o where not exists (select 1 from customer c where c.c_custkey=o.o_custkey and c.c_mktsegment='BUILDING')""",
    # isnull on float with NaN
    "isnull_nan": """select event_id, (v is null or isnan(v)) is true as m from (select event_id, case when event_id % 5 = 0 then cast('NaN' as double) when event_id % 7 = 0 then null else value end as v from events) t""",
    # nonemin/nonemax with NaN
    "nonemin_nan": """select min(case when isnan(v) then null else v end) as lo, max(case when isnan(v) then null else v end) as hi from (select case when event_id % 5 = 0 then cast('NaN' as double) else value end as v from events) t""",
    # groupby, NaN and null are one group
    "groupby_nan_key": """select k, count(*) as c from (select case when event_id % 5 < 2 then null else event_id % 5 end as k from events) t group by k""",
    # values at group_indexes
    "groupby_first_row": """select o_custkey, arg_min(o_totalprice, o_orderkey) as first_total from orders group by o_custkey""",
    # add.reduceat / counts
    "groupby_mean": """select o_custkey, cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / 100e0 / count(*) as m from orders group by o_custkey""",
    # bitwise_and/or/xor.reduceat
    "groupby_bits": """select o_custkey, bit_and(o_orderkey) as a, bit_or(o_orderkey) as o, bit_xor(o_orderkey) as x from orders group by o_custkey""",
    # unique(unordered=True)
    "unique_unordered": """select distinct user_id from events""",
    # explode of list of str
    "explode_words": """select p_partkey, unnest(string_split(p_type, ' ')) as w from part""",
    # sort_index
    "sort_index": """select o_custkey, o_orderkey, row_number() over (order by o_custkey, o_orderkey) as r from orders""",
    # sort_values + iloc[:k]
    "top_k": """select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey desc limit 10""",
    # Index.duplicated
    "index_duplicated": """select event_id, row_number() over (partition by user_id, event_type order by event_id) > 1 as dup from events""",
    # fillna on all columns
    "fillna_all": """select doc_id, coalesce(quality, 5) as quality, coalesce(toxic, 5) as toxic from (select d.doc_id, l.quality, l.toxic from documents d left join labels l on d.doc_id=l.doc_id) t""",
    # del df[k]
    "drop_column": """select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders""",
    # join + isin + groupby + sort
    "flagship": """select n.n_name, count(*) as orders, round(sum(o.o_totalprice),2) as total from orders o left join customer c on o.o_custkey=c.c_custkey left join nation n on c.c_nationkey=n.n_nationkey where o.o_orderpriority in ('1-URGENT','2-HIGH') group by n.n_name""",
}

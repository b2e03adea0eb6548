"""SQL pieces shared by the oracle queries."""


def r6(x: str) -> str:
    return f"floor(({x}) * 1000000.0 + 0.5000001) / 1000000.0"


BUCKET = ("case when amount is null then null when amount <= 0 then 0 "
          "when amount < 5000 then cast(ceil(amount / 100) as int) else 50 end")

DON = """don as (
  select o_orderkey as order_id, o_custkey as donor_id, l_suppkey as recipient_id,
         l_partkey as part_id, cast(year(o_orderdate) + year(o_orderdate) % 2 as bigint) as cycle,
         l_extendedprice / 10 - 500 as amount, l_returnflag as transaction_type,
         s_acctbal / 5000 - 1 as candidate_score, o_orderstatus as status,
         o_orderpriority as priority
  from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey)"""

DONORS = """donors as (
  select c_custkey as donor_id, nullif(c_nationkey, 7) as city, c_mktsegment as segment,
         concat_ws('-', cast(c_nationkey as varchar), nullif(c_mktsegment, 'BUILDING')) as zip,
         c_acctbal / 5000 - 1 as static_score
  from customer)"""

DYN = f"""bucketed as (
  select donor_id, cycle, {BUCKET} as w, transaction_type, candidate_score as s from don),
doubled as (
  select * from bucketed union all select * replace (cycle + 2 as cycle) from bucketed),
dyn as (
  select d.donor_id, d.cycle, sum(s * w) as weighted_sum, cast(sum(w) as bigint) as weight,
         sum(s * w) / sum(w) as dynamic_score
  from doubled d
  where w > 0 and s is not null and transaction_type in ('A', 'N')
    and exists (select 1 from don o where o.donor_id = d.donor_id and o.cycle = d.cycle)
  group by all)"""

COMPANIES = """base_names as (
  select *, concat_ws(' ', p_name, p_type, p_brand) as real_name, p_partkey % 8 as v,
         cast(floor(p_partkey / 8) as int) % 9 + 2 as k,
         cast(100 + p_size * 10 + cast(regexp_extract(p_brand, '([0-9]+)', 1) as int) as int)
           as code
  from part),
companies as (
  select p_partkey, p_size, p_brand, p_type, p_name, real_name, code,
    case v when 0 then null when 1 then real_name || ', Inc.' when 2 then upper(real_name)
      when 3 then real_name[1:k] || real_name[k + 2:]
      when 4 then real_name[1:k] || 'x' || real_name[k + 1:]
      when 5 then real_name[1:k - 1] || real_name[k + 1:k + 1] || real_name[k:k]
                  || real_name[k + 2:]
      when 6 then reverse(real_name)
      else real_name[1:k] || 'q' || real_name[k + 2:k + 5] || real_name[k + 7:] || ' Co.' end
      as employer
  from base_names)"""


def norm_sql(x: str) -> str:
    """Normalised name: tokens of the lower-cased, punctuation-free text, legal forms left out."""
    return (f"array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(lower({x})"
            f", '\\p{{P}}', ' ', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g')), ' '), lambda t: t not in ("
            "'inc', 'incorporated', 'corp', 'corporation', 'co', 'company', 'llc', 'llp', 'ltd',"
            " 'limited', 'plc', 'lp')), ' ')")


REGISTER = f"""register as (
  select norm, real_name, cik, sic, sic_description from (
    select *, row_number() over (partition by norm order by cik) as rn from (
      select {norm_sql('real_name')} as norm, real_name, p_partkey as cik,
             case when p_size <> 50 then lpad(cast(code as varchar), 4, '0') end as sic,
             p_type as sic_description
      from companies)
    where sic is not null and norm <> '')
  where rn = 1)"""


def matches_sql(strict: float, loose: float) -> str:
    """All names against all register rows, on the whole tables."""
    return f"""names as (
  select employer as employer_raw, {norm_sql('employer')} as qn
  from (select distinct employer from companies where employer is not null)),
qnames as (select distinct qn from names where qn <> ''),
exact as (select qn, 0.0 as distance, r.* from qnames join register r on qn = r.norm),
scored as (
  select qn, 1 - jaro_similarity(r.norm, qn) as distance, r.*
  from qnames join register r on true
  where qn not in (select qn from exact)),
fuzzy as (
  select * exclude (rn) from (
    select *, row_number() over (partition by qn order by distance, cik) as rn
    from scored where distance <= {loose})
  where rn = 1),
best as (select *, 'exact' as kind from exact union all select *, 'fuzzy' as kind from fuzzy),
matches as (
  select employer_raw, distance, coalesce(kind, 'none') as match_type,
         case when kind is null then 'no_match' when distance <= {strict} then 'auto_accept'
              else 'needs_review' end as status,
         cik, real_name as matched_name, sic, sic_description
  from names left join best using (qn))"""


NAMES_TO_PARTS = "companies join matches on employer = employer_raw"

DEFS = """cells as (
  select distinct cast(regexp_extract(p_brand, '([0-9]+)', 1) as int) as b, p_size as z
  from part),
defs as (
  select 12 as scheme, b % 11 + 1 as ff_num, 'G' || (b % 11 + 1) as ff_abbr,
         'Group ' || (b % 11 + 1) as ff_name, 100 + z * 150 as sic_from,
         120 + z * 150 + b as sic_to, cast(null as varchar) as range_desc
  from cells
  union all
  select 48, b, 'I' || b, case when b % 2 = 0 then 'Industry ' || b else 'I' || b end,
         100 + z * 190, 100 + z * 190 + b * 7, 'size ' || z from cells
  union all
  select 49, b, case b when 17 then 'Softw' when 3 then 'Hardw' when 8 then 'Chips'
         else 'B' || b end, 'Brand ' || b, 100 + z * 10 + b, 100 + z * 10 + b + z % 7,
         'size ' || z from cells
  union all select * from (values
    (12, 12, 'Other', 'Everything else', null, null, null),
    (48, 48, 'Other', 'Other', null, null, null),
    (49, 49, 'Other', 'Almost nothing', null, null, null)))"""

CROSSWALK = """codes as (select unnest(generate_series(100, 9999))::int as sic_int),
hits as (
  select sic_int, d.*, row_number() over (
    partition by sic_int, scheme order by sic_to - sic_from, ff_num, sic_from) as rn
  from codes join defs d on sic_int between sic_from and sic_to),
assigned as (
  select c.sic_int, o.scheme, coalesce(h.ff_num, o.ff_num) as ff_num,
         coalesce(h.ff_abbr, o.ff_abbr) as ff_abbr, coalesce(h.ff_name, o.ff_name) as ff_name,
         h.range_desc as detail, h.ff_num is not null as explicit
  from codes c
  cross join (select scheme, ff_num, ff_abbr, ff_name from defs where sic_from is null) o
  left join (select * from hits where rn = 1) h on h.sic_int = c.sic_int and h.scheme = o.scheme),
listed as (
  select sic_int, sec_office, sec_title from (
    select cast(code as int) as sic_int, p_type as sec_office, p_name as sec_title,
           row_number() over (partition by code order by p_name, p_type) as rn
    from (select distinct code, p_type, p_name from companies))
  where rn = 1),
crosswalk as (
  select lpad(cast(sic_int as varchar), 4, '0') as sic, sic_int, sec_title is not null as in_sec,
         sec_office, sec_title, a.ff_num as ff12, a.ff_abbr as ff12_abbr, a.ff_name as ff12_name,
         a.explicit as ff12_explicit, b.ff_num as ff48, b.ff_abbr as ff48_abbr,
         b.ff_name as ff48_name, b.explicit as ff48_explicit, c.ff_num as ff49,
         c.ff_abbr as ff49_abbr, c.ff_name as ff49_name, c.explicit as ff49_explicit,
         c.detail as sic_detail
  from (select * from assigned where scheme = 12) a
  join (select * from assigned where scheme = 48) b using (sic_int)
  join (select * from assigned where scheme = 49) c using (sic_int)
  left join listed using (sic_int))"""

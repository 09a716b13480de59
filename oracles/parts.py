"""Named sub-queries; ``compose`` puts the ones a statement mentions in front of it."""

from __future__ import annotations

import re

ALPHABET = "23456789CFGHJMPQRVWX"


def hex_int(digest: str, digits: int = 8) -> str:
    return f"('0x'||substr({digest},1,{digits}))::bigint"


def cell(lat: str, lon: str) -> str:
    """Row and column of the plus-code cell as ``a, b``."""
    return (
        f"least(floor(round(({lat}+90)*25000000,6)/1250000),3599)::bigint as a, "
        f"(floor(round(({lon}+180)*8192000,6)/409600)::bigint) % 7200 as b"
    )


def cell_text(a: str = "a", b: str = "b") -> str:
    digits = [f"({x}//{s})%20" for s in (400, 20, 1) for x in (a, b)]
    return "||".join(f"substr('{ALPHABET}',({d})::int+1,1)" for d in digits)


def fmt(t: str) -> str:
    return f"strftime({t},'%Y-%m-%d %H:%M:%S')"


def number(text: str) -> str:
    return f"try_cast(nullif(trim({text}),'') as double)"


def sid(codes: str) -> str:
    return f"array_to_string(list_transform({codes}, lambda c, i: '<'||chr(96+i::int)||'_'||c||'>'),'')"


def windows(name: str, where: str, first: str, last: str) -> str:
    """Evaluation windows over ``name_pos`` (uid, pos, n, pid, time): positions first..last, the last one is the target."""
    return f"""
      select uid, 0 as seq_no,
             list(pid order by pos) filter (pos < {last}) as pids,
             list({fmt('time')} order by pos) filter (pos < {last}) as times,
             max(pid) filter (pos = {last}) as target,
             max({fmt('time')}) filter (pos = {last}) as target_time
      from {name} where ({where}) and pos between {first} and {last} group by uid"""


def top_items(source: str, item: str, top: int) -> str:
    """Top five items of the ``top`` most frequent prefixes."""
    return f"""
      select prefix, item, n, rank from (
        select prefix, {item} as item, count(*) as n,
               row_number() over (partition by prefix order by count(*) desc, {item}) as rank
        from {source} where prefix in (
          select prefix from {source} group by prefix
          order by count(*) desc, list_transform(string_split(prefix,','), lambda x: x::int) limit {top})
        group by prefix, {item}) t where rank <= 5"""


# Run names that some of the orders take.
_KNOWN = (
    "['rqvae-nyc-div0.25-commit0.5-lr5e-5','rqvae-tky-div0.25-commit0.25-lr5e-5','Nrqvae-NYC-div0.25-commit0.25-lr1e-3','Nrqvae-TKY-div0.25-commit0.25-lr1e-3',"
    "'Nrqvae-NYC_Exploration-div0.25-commit0.25-lr1e-3','Nrqvae-TKY_Exploration-div0.25-commit0.25-lr1e-3','rqvae-nyc-div0.25-commit0.5-lr5e-5-without_L_quant']"
)

PARTS: dict[str, str] = {
    # check-ins of the events
    "ev": """
      select event_id as row_id, concat('u',user_id) as uid, concat('v',k) as pid, event_type as catname,
             40.513::double + 0.05::double*(k%10) as lat, (-74.187)::double + 0.05::double*floor(k/10) as lon,
             case user_id%4 when 0 then -300 when 1 then -240 when 2 then 0 else 540 end as tz_offset, ts as utc_time
      from (select *, regexp_extract(props,'[0-9]+',0)::int as k from events) e""",
    "raw": """
      select event_id as row_id, concat('u',user_id) as uid, concat('v',k) as pid, 'c-'||event_type as cat_id,
             'Café, '||event_type as catname,
             case a when '0' then 'abc' when '1' then '' when '2' then '90' when '3' then '-90' when '4' then '90.0001'
               else substr(y,1,2)||'.'||substr(y,3,3) end as lat,
             case b when '0' then '180' when '1' then '-180' when '2' then '181' when '3' then '1e2'
               else '-'||substr(x,1,2)||'.'||substr(x,3,3) end as lon,
             case c when '0' then '' when '1' then 'n/a' else
               case when substr(md5(event_id::varchar),5,1) = '0' then '330.5' else case user_id%4 when 0 then '-300' when 1 then '-240' when 2 then '0' else '540' end end end as tz_offset,
             case d when '0' then 'bad' else
               strftime(ts,'%a %b %d %H:%M:%S')||(case d when '1' then ' +0130 ' else ' +0000 ' end)||strftime(ts,'%Y') end as utc_time,
             case when d = '0' then null when d = '1' then date_trunc('second',ts) - interval 90 minute else date_trunc('second',ts) end as utc
      from (select *, substr(md5(event_id::varchar),1,1) as a, substr(md5(event_id::varchar),2,1) as b,
                   substr(md5(event_id::varchar),3,1) as c, substr(md5(event_id::varchar),4,1) as d,
                   (40513+50*(k%10))::varchar as y, (74187-50*(k//10))::varchar as x
            from (select *, regexp_extract(props,'[0-9]+',0)::int as k from events) e) e""",
    "numeric": f"""
      select * exclude (lat, lon, tz_offset), {number('lat')} as lat, {number('lon')} as lon,
             case when {number('tz_offset')} = floor({number('tz_offset')}) then try_cast({number('tz_offset')} as int) end as tz_offset from raw""",
    "valid": "select * from numeric where lat between -90 and 90 and lon between -180 and 180",
    "valid_region": f"select *, {cell_text()} as region from (select *, {cell('lat','lon')} from valid) v",
    # check-ins of the line items
    "li": """
      select lpad(l_orderkey::varchar,10,'0')||lpad(l_linenumber::varchar,2,'0')
             ||lpad(l_partkey::varchar,10,'0')||lpad(l_suppkey::varchar,8,'0')||strftime(l_shipdate,'%Y%m%d') as row_id,
             o_custkey as uid, l_partkey as pid, p_type as catname,
             (-59.987)::double+(l_partkey%120) as lat, (-119.987)::double+floor((l_partkey%2400)/10) as lon,
             (60*(o_custkey%5)-120)::int as tz_offset,
             l_shipdate + ((l_partkey*7+l_linenumber)%24) * interval '1' hour as utc_time
      from lineitem join orders on l_orderkey=o_orderkey join part on l_partkey=p_partkey""",
    "clean": f"""
      select row_id, uid, pid, catname, {cell_text()} as region,
             date_trunc('second', utc_time + tz_offset * interval '1' minute) as time,
             (max(year(utc_time)*12+month(utc_time)) over () - (year(utc_time)*12+month(utc_time)))::int as recency
      from (select *, {cell('lat','lon')} from li) c""",
    "visits": """
      select * from (select *, count(pid) over (partition by uid) as per_user
                     from (select *, count(uid) over (partition by pid) as per_place from clean) p where per_place >= 25) u
      where per_user >= 30""",
    "dict": """
      select dictionary, original, row_number() over (partition by dictionary order by md5('2024|'||original)) as mapped
      from (select 'uid' as dictionary, uid::varchar as original from visits union select 'pid', pid::varchar from visits
            union select 'catname', catname from visits union select 'region', region from visits) d""",
    "enc": """
      select v.row_id, u.mapped as uid, p.mapped as pid, c.mapped as catname, r.mapped as region, v.time, v.recency
      from visits v join dict u on u.dictionary='uid' and u.original=v.uid::varchar
      join dict p on p.dictionary='pid' and p.original=v.pid::varchar
      join dict c on c.dictionary='catname' and c.original=v.catname
      join dict r on r.dictionary='region' and r.original=v.region""",
    # graph
    "forward": """
      select src, dst, count(*) as freq, min(spot) as first_at from (
        select pid as src, lead(pid) over (partition by uid order by row_id) as dst,
               row_number() over (order by uid, row_id) as spot from visits) s
      where dst is not null group by src, dst""",
    "forward_ranked": """
      select src, dst, freq, row_number() over (partition by src order by freq desc, first_at) as rank from forward""",
    "around": """
      select src, dst, count(*) as freq, min(spot) as first_at from (
        select pid as src, unnest([lag(pid) over w, lead(pid) over w]) as dst,
               unnest([2*row_number() over (order by uid, row_id), 2*row_number() over (order by uid, row_id)+1]) as spot
        from visits window w as (partition by uid order by row_id)) s
      where dst is not null group by src, dst""",
    "around_ranked": """
      select src, dst, freq, row_number() over (partition by src order by freq desc, first_at) as rank from around""",
    "heads": """
      select pid, arg_min(catname, row_id) as catname, arg_min(region, row_id) as region from visits group by pid""",
    "place_users": "select pid, uid, min(row_id) as first_row, min(recency) as recency from visits group by pid, uid",
    "place_times": "select pid, time, min(row_id) as first_row from visits group by pid, time",
    "enc_heads": "select pid, arg_min(catname, row_id) as catname, arg_min(region, row_id) as region from enc group by pid",
    "enc_users": "select pid, uid, min(row_id) as first_row, min(recency) as recency from enc group by pid, uid",
    "sizes": "select count(distinct pid) as p, count(distinct catname) as c, count(distinct region) as r, count(distinct uid) as u from visits",
    "f_category": "select pid, catname-1 as idx, 1.0::double as value from enc_heads",
    "f_users": """
      select pid, uid-1 as idx, 1.0::double as value from (
        select *, row_number() over (partition by pid order by first_row) as k from enc_users) u where k <= 10""",
    "f_hours": """
      select pid, h as idx, 1.0::double as value from (
        select pid, h, row_number() over (partition by pid order by count(*) desc, min(first_row)) as k from (
          select pid, hour(time) as h, time, min(row_id) as first_row from enc group by pid, time) t
        group by pid, h) s where k <= 10""",
    # split
    "marked": """
      select *, (row_number() over (order by time, row_id) <= floor(0.8::double*(count(*) over ())))::int as is_train from clean""",
    "train": "select * from marked where is_train=1",
    "test": """
      select * from marked where is_train=0 and uid in (select uid from train) and pid in (select pid from train)""",
    "all_rows": "select * from train union all select * from test",
    "hist": """
      select uid, pid, time, row_number() over (partition by uid order by time, row_id) as pos,
             count(*) over (partition by uid) as n
      from (select *, row_number() over (partition by uid order by time desc, row_id desc) as back from train) t where back <= 80""",
    "ends": """
      select uid, n, ends[i]::bigint as e, i-1 as seq_no from (
        select uid, n, case when n>=50 then list_reverse(list_filter(range(1,n+1), lambda x: x>=50 and (n-x)%10=0)) else [n] end as ends
        from (select distinct uid, n from hist where n>=10) u) s, unnest(range(1,len(ends)+1)) t(i)""",
    "win": """
      select s.uid, s.seq_no, s.n, s.e, least(s.e,50) as len, h.pid, h.time,
             h.pos - greatest(s.e-50,0) - 1 as i
      from ends s join hist h on h.uid=s.uid and h.pos > s.e-50 and h.pos <= s.e""",
    "aim": f"""
      select *, case when len=50 and u1/4294967296::double < 0.1::double then floor(u2/4294967296::double*(len-1))::bigint else len-1 end as goal
      from (select *, {hex_int("md5('2024|mask|'||uid||'|'||e)")} as u1, {hex_int("md5('2024|spot|'||uid||'|'||e)")} as u2 from win) w""",
    "seq_train": f"""
      select uid, seq_no, list(pid order by i) filter (i<>goal) as pids, list({fmt('time')} order by i) filter (i<>goal) as times,
             max(pid) filter (i=goal) as target, max({fmt('time')}) filter (i=goal) as target_time
      from aim group by uid, seq_no""",
    "test_pos": "select uid, pid, time, row_number() over (partition by uid order by time, row_id) as pos, count(*) over (partition by uid) as n from test",
    "both_pos": "select uid, pid, time, row_number() over (partition by uid order by time, row_id) as pos, count(*) over (partition by uid) as n from all_rows",
    "clean_pos": "select uid, pid, time, row_number() over (partition by uid order by time, row_id) as pos, count(*) over (partition by uid) as n from clean",
    "seq_val": windows("test_pos", "n>50 or n between 3 and 49", "greatest(n-50,1)", "n-1"),
    "seq_test": windows("test_pos", "n>=3", "greatest(n-49,1)", "n"),
    "seq_test_all": windows("both_pos", "n>=3", "greatest(n-49,1)", "n"),
    "seqs": """
      select 'train' as split, * from seq_train union all select 'val', * from seq_val
      union all select 'test', * from seq_test union all select 'test_all', * from seq_test_all""",
    # codes
    "vec": f"""
      select vec_id+1 as pid, embedding::double[] as x, label+1 as cat_id, 'category '||label as catname, g as region_id,
             {cell_text()} as region
      from (select *, {cell('40.513::double+0.05::double*(g%5)', '(-74.187)::double+0.05::double*floor(g/5)')}
            from (select *, vec_id%25 as g from embeddings) e) v""",
    "words": """
      select l as level, vec_id%16 as code,
             list_transform(arg_min(embedding::double[], md5(l||'|'||vec_id)), lambda v: v*any_value(s)) as c
      from embeddings, (values (0,1.0::double),(1,0.5::double),(2,0.25::double)) t(l,s) group by l, vec_id%16""",
    "q0": """
      select pid, x, x as rest, code as c0, c from (
        select pid, x, code, c, row_number() over (partition by pid order by list_distance(x,c), code) as k
        from vec, words where level=0) d where k=1""",
    "r1": "select pid, x, c0, list_transform(list_zip(rest,c), lambda z: z[1]-z[2]) as rest from q0",
    "q1": """
      select pid, x, rest, c0, code as c1, c from (
        select pid, x, rest, c0, code, c, row_number() over (partition by pid order by list_distance(rest,c), code) as k
        from r1, words where level=1) d where k=1""",
    "r2": "select pid, x, c0, c1, list_transform(list_zip(rest,c), lambda z: z[1]-z[2]) as rest from q1",
    "q2": """
      select pid, x, rest, c0, c1, code as c2, c from (
        select pid, x, rest, c0, c1, code, c, row_number() over (partition by pid order by list_distance(rest,c), code) as k
        from r2, words where level=2) d where k=1""",
    "r3": "select pid, x, c0, c1, c2, list_transform(list_zip(rest,c), lambda z: z[1]-z[2]) as rest from q2",
    "coded": """
      select pid, [c0,c1,c2] as codes, list_transform(list_zip(x,rest), lambda z: z[1]-z[2]) as q, rest from r3""",
    "assigned": """
      select 0 as level, c0 as code, x as rest, list_inner_product(r.rest,r.rest) as sq from q0 join (select pid, rest from r1) r using (pid)
      union all select 1, c1, q1.rest, list_inner_product(r.rest,r.rest) from q1 join (select pid, rest from r2) r using (pid)
      union all select 2, c2, q2.rest, list_inner_product(r.rest,r.rest) from q2 join (select pid, rest from r3) r using (pid)""",
    "usage": """
      select w.level, w.code, count(a.level) as n from words w left join assigned a on a.level=w.level and a.code=w.code group by w.level, w.code""",
    "book": """
      select c.pid, codes, q, x, v.cat_id, v.catname, v.region_id, v.region, v.catname||' @ Region '||v.region_id as cat_and_region
      from coded c join vec v using (pid)""",
    "by1": "select *, codes[1]::varchar as prefix from book",
    "by2": "select *, codes[2]::varchar as prefix from book",
    "by12": "select *, codes[1]||','||codes[2] as prefix from book",
    "pbook": """
      select p_partkey as pid, b.codes, b.q, b.catname, b.region_id from part
      join book b on b.pid = p_partkey % (select count(*) from embeddings) + 1""",
    "drawable": """
      select 'level_1' as report, 50 as least, pid, codes[1]::varchar as prefix, catname as item from pbook
      union all select 'level_2', 50, pid, codes[2]::varchar, catname from pbook
      union all select 'combo_category', 18, pid, codes[1]||','||codes[2], catname from pbook
      union all select 'combo_region', 15, pid, codes[1]||','||codes[2], region_id::varchar from pbook""",
    "chosen": """
      select report, prefix, n, slot from (
        select report, prefix, n, row_number() over (partition by report order by md5('42|'||prefix)) as slot from (
          select report, prefix, count(*) as n from drawable group by report, prefix having count(*) >= any_value(least)) p) q
      where slot <= 4""",
    # Regions are ordered as numbers, categories as text.
    "drawn_items": """
      select report, prefix, slot, item, n from (
        select d.report, d.prefix, slot, item, count(*) as n, row_number() over (
                 partition by d.report, d.prefix order by count(*) desc, try_cast(item as int), item) as k
        from drawable d join chosen c on c.report=d.report and c.prefix=d.prefix group by d.report, d.prefix, slot, item) t
      where k <= 5""",
    "place_sid": f"""
      select p_partkey as pid, {sid('codes')} as sid from part
      join coded c on c.pid = p_partkey % (select count(*) from embeddings) + 1""",
    # prompts
    "toks": """
      select s.split, s.uid, s.seq_no, s.times, s.target_time,
             list(t.sid order by s.i) as tokens, any_value(g.sid) as target_token
      from (select *, unnest(pids) as pid, generate_subscripts(pids,1) as i from seqs) s
      join place_sid t on t.pid=s.pid join place_sid g on g.pid=s.target
      group by s.split, s.uid, s.seq_no, s.times, s.target_time""",
    "timed": """
      select split, uid, seq_no,
        'Here is a record of a user''s POI accesses, your task is based on the history to predict the POI that the user is likely to access at the specified time.' as instruction,
        'User_'||uid||' visited: '||array_to_string(list_transform(list_zip(tokens,times), lambda z: z[1]||' at '||z[2]),', ')
          ||'. When '||target_time||' user_'||uid||' is likely to visit:' as input, target_token as output from toks""",
    "prompted": "select split, uid, seq_no, instruction||chr(10)||input||' ' as prompt, output as completion from timed",
    "mentions": """
      select *, regexp_extract(lower(prompt),'user_[0-9]+') as user,
             list_distinct(list_concat(regexp_extract_all(lower(prompt),'(?:<\\w+>)+'), regexp_extract_all(lower(completion),'(?:<\\w+>)+'))) as sids
      from prompted""",
    "dialogue": """
      select q.conv_id, q.turn, 'Answer the user.' as instruction, q.text as input, a.text as output
      from conversations q join conversations a on a.conv_id=q.conv_id and a.turn=q.turn+1
      where q.role='user' and a.role='assistant'""",
    "lens": "select len(regexp_extract_all(text,'\\S+')) as n from documents",
    # predictions
    "next_place": """
      select src, dst from (
        select src, dst, row_number() over (partition by src order by count(*) desc, min(spot)) as k from (
          select pid as src, lead(pid) over (partition by uid order by row_id) as dst,
                 row_number() over (order by uid, row_id) as spot from train) s
        where dst is not null group by src, dst) e where k=1""",
    "guessed": """
      select split, uid, seq_no, target, dst as predicted from seqs left join next_place on src = pids[len(pids)]""",
    "answers": """
      select split, uid, seq_no, g.sid as gold, coalesce(substr(p.sid,4),'') as answer
      from guessed join place_sid g on g.pid=target left join place_sid p on p.pid=predicted""",
    "results": """
      select split, uid, seq_no, gold,
             coalesce(arg_min(text, attempt) filter (attempt<5 and text<>''),'') as result
      from (select split, uid, seq_no, gold, attempt, trim(raw, ' '||chr(9)||chr(10)||chr(13)||chr(160)) as text
            from (select split, uid, seq_no, gold, t as attempt,
                         s||(case when t<5 and substr(md5('try|'||split||'|'||uid||'|'||seq_no||'|'||t),1,1) < 'a' then '' else answer||s end) as raw
                  from (select *, [' ',chr(10),chr(9)||' '||chr(13)||chr(10),chr(160)][(uid%4+1)::int] as s from answers) w, range(0,6) r(t)) b) a
      group by split, uid, seq_no, gold""",
    "scored": "select *, contains('<a_'||result, gold)::int as hit, 'run-'||(case when split='val' then uid%3 else uid%4 end) as run_name from results",
    "metrics": """
      select run_name, avg(hit) filter (split='train') as train_acc, avg(hit) filter (split='val') as val_acc,
             avg(hit) filter (split='test_all') as test_all_acc, avg(hit) filter (split='test') as test_acc
      from scored group by run_name""",
    "losses": """
      select o_orderpriority as run, month(o_orderdate) as epoch, round(avg(o_totalprice)/100000,6) as eval_loss
      from orders group by all""",
    # regions
    "top_combo_regions": top_items("by12", "region_id", 30),
    "centers": f"""
      select distinct region_id, 40.5+0.05*(region_id%5)+0.025 as lat, -74.2+0.05*(region_id//5)+0.025 as lon from vec""",
    "km": """
      select a.prefix as combo, a.item as region_1, b.item as region_2,
             sqrt(pow((x.lat-y.lat)*111,2)+pow((x.lon-y.lon)*111*cos(radians((x.lat+y.lat)/2)),2))::double as km
      from top_combo_regions a join top_combo_regions b on a.prefix=b.prefix and a.item<b.item
      join centers x on x.region_id=a.item join centers y on y.region_id=b.item""",
    "compact": """
      select combo, avg(km) as mean_km, row_number() over (order by round(avg(km),9), combo) as rank from km group by combo""",
    # runs
    "run_ids": f"""
      select o_orderkey as order_key, 'org/'||case when o_orderkey%13=0 then {_KNOWN}[((o_orderkey//13)%7+1)::int] else
        ['rqvae','llama3','Nrqvae-withKL','baseline'][(o_custkey%4+1)::int]||'-'
        ||['nyc','tky','NYC_Exploration','TKY_Exploration','NYC','none'][(o_orderkey%6+1)::int]
        ||(case when o_orderkey%11=0 then '' else '-div0.'||lpad((o_orderkey%4*25)::varchar,2,'0') end)
        ||(case when o_custkey%3=0 then '' else '-commit0.'||(o_custkey%10) end)
        ||(case when o_orderkey%5=0 then '' else '-lr'||(o_orderkey%9+1)||'e-'||(o_custkey%4+2) end)
        ||(case when o_orderkey%7=0 then '-without_L_quant' when o_orderkey%7=1 then '-without_L_reconstruction' else '' end) end as run_id
      from orders""",
    "named": """
      select order_key, string_split(run_id,'/')[2] as run_name, lower(run_id) as low,
        case when low like '%nyc\\_exploration%' escape '\\' then 'NYC_Exploration' when low like '%tky\\_exploration%' escape '\\' then 'TKY_Exploration'
             when low like '%nyc%' then 'NYC' when low like '%tky%' then 'TKY' end as dataset_name,
        coalesce(try_cast(nullif(regexp_extract(run_id,'div(\\d+\\.?\\d*)',1),'') as double),0.25) as div_weight,
        coalesce(try_cast(nullif(regexp_extract(run_id,'commit(\\d+\\.?\\d*)',1),'') as double),0.25) as commitment_weight,
        coalesce(try_cast(nullif(regexp_extract(run_id,'lr(\\d+e-\\d+)',1),'') as double),5e-5) as lr,
        (case when contains(low,'without_l_quant') then 0 else 1 end)::double as quant_weight,
        (case when contains(low,'without_l_reconstruction') then 0 else 1 end)::double as recon_weight,
        contains(low,'withkl')::int as use_kl_divergence
      from run_ids""",
    "run_metrics": """
      select 'run-'||o_custkey as run_name, round(avg((o_orderstatus='F')::int),6) as train_acc, round(avg((o_orderstatus='O')::int),6) as val_acc,
             round(avg((o_orderstatus='P')::int),6) as test_all_acc, round(avg((o_orderpriority='5-LOW')::int),6) as test_acc
      from orders group by o_custkey""",
}


# The split and the sequences again, of the filtered and encoded rows.
_CHAIN = ["marked", "train", "test", "all_rows", "hist", "ends", "win", "aim", "seq_train", "test_pos", "both_pos", "seq_val", "seq_test", "seq_test_all", "seqs"]
PARTS |= {
    f"{name}_e": re.sub(rf"\b(from|join) ({'|'.join(_CHAIN)})\b", r"\1 \2_e", PARTS[name]).replace("from clean", "from enc")
    for name in _CHAIN
}


def compose(statement: str) -> str:
    ordered: list[str] = []

    def visit(sql: str, above: tuple[str, ...]) -> None:
        for name in PARTS:
            if name not in ordered and name not in above and re.search(rf"\b(?:from|join)\s+{name}\b|,\s*{name}\s+where\b", sql):
                visit(PARTS[name], (*above, name))
                if name not in ordered:
                    ordered.append(name)

    visit(statement, ())
    if not ordered:
        return statement
    head = "with recursive " + ",\n".join(f"{name} as ({PARTS[name]})" for name in ordered)
    own = re.match(r"\s*with (recursive )?", statement)
    return f"{head},\n{statement[own.end():]}" if own else f"{head}\n{statement}"

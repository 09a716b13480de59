"""One statement per query key."""

from __future__ import annotations

from oracles.parts import cell, cell_text, compose, fmt, hex_int, sid, top_items, windows
from oracles.vectors import fitted_codewords, projected, trained_codewords


def _csv(column: str, sep: str = ",") -> str:
    return f"array_to_string({column},'{sep}')"


def _sequences(source: str, extra: str = "") -> str:
    return f"select {extra}uid, seq_no, {_csv('pids')} as pids, {_csv('times')} as times, target, target_time from {source}"


_TOKENS = "array_to_string(list_transform(pids, lambda p: '<'||p||'>'),' ')"

_LABELS = f"""
  select conv_id, turn, {_csv('input_ids')} as input_ids,
         array_to_string(list_transform(input_ids, lambda t, i: case when i <= inside then -100 else t end),',') as labels
  from (select conv_id, turn, len(regexp_extract_all(prompt,'\\S+')) as inside,
               list_transform(regexp_extract_all(prompt||completion||'</s>','\\S+')[1:2048],
                              lambda w: {hex_int('md5(w)', 7)}) as input_ids
        from (select conv_id, turn, instruction||chr(10)||input||' ' as prompt, output as completion from dialogue) d) t"""

_DECODED = f"""
  select region, round(a*0.05::double-90,6) as lat_min, round(a*0.05::double-90+0.05,6) as lat_max,
         round(b*0.05::double-180,6) as lon_min, round(b*0.05::double-180+0.05,6) as lon_max,
         round(a*0.05::double-90+0.025,6) as center_lat, round(b*0.05::double-180+0.025,6) as center_lon
  from (select distinct {cell_text()} as region, a, b
        from (select {cell('lat','lon')} from (select lat, lon from li union all select lat, lon from ev) p) c) r"""

STATEMENTS: dict[str, str] = {
    # sources and sinks
    "read_checkins": "select row_id, uid, pid, cat_id, catname, lat, lon, tz_offset, utc_time from raw",
    "read_checkins_in_order": """
      select uid, 0::bigint as segment, string_agg(pid, ',' order by place) as pids, string_agg(name, '|' order by place) as catnames from (
        select uid, pid, md5(row_id::varchar) as place,
               case when substr(md5(row_id::varchar),32,1) < '8' then catname||','||chr(13)||chr(10)||'"second" line'||chr(10)||cat_id else catname end as name
        from raw) r group by uid""",
    "parse_list_column": """
      select o_orderkey, case when o_orderkey%5 in (3,4) then 2 else 0 end as n,
             case when o_orderkey%5 in (3,4) then o_custkey||','||o_orderkey else '' end as ints,
             o_orderpriority||'|'||o_orderstatus as words from orders""",
    "read_instructions": "select instruction, input, output from dialogue",
    "read_instruction_array": "select instruction, input, output from dialogue",
    "first_instructions": "select instruction, input, output from dialogue order by conv_id, turn limit 50",
    "write_instructions": """
      select ['train','val','test'][(conv_id%3+1)::int]||'_id_notime.json' as file_name, instruction, input, output from dialogue""",
    "split_from_filename": """
      select ['train','val','test','test_all'][(conv_id%4+1)::int] as split, count(*) as examples, sum(length(output))::bigint as chars
      from dialogue group by 1""",
    "read_codebook": f"select pid, {_csv('codes')} as codes, round(list_sum(q),6) as vector_sum from coded",
    "write_tables": """
      select 'dictionary_'||dictionary as table_name, count(*) as n, sum(mapped)::bigint as total from dict group by dictionary
      union all select 'visits', count(*), sum(uid+3*pid+5*catname+7*region)::bigint from enc
      union all select 'train', count(*), sum(uid+3*pid)::bigint from train_e
      union all select 'test', count(*), sum(uid+3*pid)::bigint from test_e
      union all select 'profile', (select count(*) from heads), ((select count(*) from place_users) + 3*(select count(*) from place_times)
        + 5*(select count(*) from around) + 7*(select count(*) from forward))::bigint
      union all select 'sequences_'||split, count(*), sum(target+3*len(pids)+5*pids[1])::bigint from seqs_e group by split
      union all select 'metadata', 1, (c+r+24+u)::bigint from sizes
      union all select 'features', count(*), sum(idx)::bigint from (
        select idx from f_category union all select (select c from sizes)+region-1 from enc_heads
        union all select (select c+r from sizes)+idx from f_hours union all select (select c+r+24 from sizes)+idx from f_users) f""",
    "append_new_runs": """
      select run_name, train_acc, val_acc, test_all_acc,
             case when substr(md5(run_name),1,1) < '8' then -1.0::double else test_acc end as test_acc from run_metrics""",
    "feature_metadata": """
      select p as num_pois, c as num_categories, r as num_regions, u as num_users, 24::bigint as num_time_bins, c+r+24+u as total_dim,
             0::bigint as category_offset, c as region_offset, c+r as temporal_offset, c+r+24 as collaborative_offset from sizes""",
    # cleaning
    "coerce_numeric": """
      select row_id, coalesce(lat,-999) as lat, coalesce(lon,-999) as lon, coalesce(tz_offset,-999) as tz_offset from numeric""",
    "valid_coords": "select row_id, lat, lon from valid",
    "plus_code_region": "select row_id, region from valid_region",
    "parse_utc": f"select row_id, {fmt('utc')} as utc_time from raw where utc is not null",
    "local_time": f"""
      select row_id, {fmt("utc + tz_offset * interval '1' minute")} as time_text from numeric where utc is not null and tz_offset is not null""",
    "project_rename": f"select row_id, uid, pid, catname, region, {fmt('time')} as time from clean",
    "visit_recency": "select row_id, recency from clean",
    "frequency_filter": "select row_id, uid, pid from visits",
    "frequency_filter_events": """
      select row_id, uid, pid from (
        select *, count(pid) over (partition by uid) as per_user
        from (select *, count(uid) over (partition by pid) as per_place from ev) p where per_place >= 95) u where per_user >= 62""",
    "clean_checkins": f"""
      select row_id, uid, pid, catname, region, {fmt("utc + tz_offset * interval '1' minute")} as time, recency
      from (select *, (max(year(utc)*12+month(utc)) over () - (year(utc)*12+month(utc)))::int as recency
            from valid_region where utc is not null) v where tz_offset is not null""",
    # dictionaries
    "build_dictionary": "select dictionary, original, mapped from dict",
    "apply_dictionary": "select row_id, uid, pid, catname, region from enc",
    "reverse_dictionary": """
      select h.pid, d.mapped as catname, d.original as category from heads h join dict d on d.dictionary='catname' and d.original=h.catname""",
    # profiles and graph
    "user_place_sequence": """
      select uid, 0::bigint as segment, string_agg(pid::varchar, ',' order by row_id) as pids, string_agg(catname, ',' order by row_id) as catnames
      from visits group by uid""",
    "forward_neighbors": "select src, dst, freq, rank from forward_ranked",
    "neighbors": "select src, dst, freq, rank from around_ranked",
    "forward_neighbors_events": """
      select src, dst, freq, row_number() over (partition by src order by freq desc, first_at) as rank from (
        select src, dst, count(*) as freq, min(spot) as first_at from (
          select pid as src, lead(pid) over (partition by uid order by row_id) as dst, row_number() over (order by uid, row_id) as spot from ev) s
        where dst is not null group by src, dst having count(*) >= 2) e""",
    "place_profile": f"""
      select h.pid, 0::bigint as segment, h.catname, h.region, u.uids, t.times from heads h
      join (select pid, string_agg(uid::varchar, ',' order by first_row) as uids from place_users group by pid) u using (pid)
      join (select pid, string_agg({fmt('time')}, ',' order by first_row) as times from place_times group by pid) t using (pid)""",
    "attach_neighbors": """
      select h.pid, 0::bigint as segment, h.catname, coalesce(a.l,'') as neighbors, coalesce(f.l,'') as forward_neighbors from heads h
      left join (select src, string_agg(dst::varchar, ',' order by rank) as l from around_ranked group by src) a on a.src=h.pid
      left join (select src, string_agg(dst::varchar, ',' order by rank) as l from forward_ranked group by src) f on f.src=h.pid""",
    "latest_visit_per_user": """
      select pid, row_number() over (partition by pid order by recency, first_row) as position, uid, recency from place_users""",
    # features
    "onehot_block": "select pid, idx, value from f_category",
    "multihot_topk_users": "select pid, idx, value from f_users",
    "multihot_topk_hours": "select pid, idx, value from f_hours",
    "recency_weighted_users": """
      select pid, uid-1 as idx, case when recency<100 then round(pow(0.5,recency),6) else 0 end as value from enc_users""",
    "assemble_features": """
      select pid, idx, value from f_category
      union all select pid, (select c from sizes)+region-1, 1.0 from enc_heads
      union all select pid, (select c+r from sizes)+idx, value from f_hours
      union all select pid, (select c+r+24 from sizes)+idx, value from f_users""",
    "recency_pipeline": """
      select pid, idx, value from f_category
      union all select pid, (select c from sizes)+region-1, 1.0 from enc_heads
      union all select pid, (select c+r from sizes)+idx, value from f_hours
      union all select pid, (select c+r+24 from sizes)+uid-1, case when recency<100 then round(pow(0.5,recency),6) else 0 end from enc_users""",
    "feature_vectors": """
      select pid, (select c+r+24+u from sizes) as dim, string_agg(idx::varchar, ',' order by idx) as indices,
             string_agg('1.0', ',' order by idx) as values
      from (select pid, idx from f_category
            union all select pid, (select c from sizes)+region-1 from enc_heads
            union all select pid, (select c+r from sizes)+idx from f_hours
            union all select pid, (select c+r+24 from sizes)+idx from f_users) e group by pid""",
    "pid_to_index": "select pid, row_number() over (order by pid)-1 as index from heads",
    # split and sequences
    "time_split": "select row_id, is_train from marked",
    "drop_cold_test_rows": "select row_id, uid, pid from test",
    "union_train_test": f"select row_id, uid, pid, {fmt('time')} as time from all_rows",
    "cap_history": "select uid, n, string_agg(pid::varchar, ',' order by pos) as pids from hist group by uid, n",
    "train_windows": """
      select uid, seq_no, e as end, len as n, string_agg(pid::varchar, ',' order by i) as pids from win where len=50 group by uid, seq_no, e, len""",
    "short_history_example": """
      select uid, e as end, len as n, string_agg(pid::varchar, ',' order by i) as pids from win where len<50 group by uid, e, len""",
    "mask_augment": _sequences("seq_train"),
    "test_examples": _sequences("(" + windows("clean_pos", "n>=3", "greatest(n-49,1)", "n") + ") s"),
    "val_examples": _sequences("(" + windows("clean_pos", "n>50 or n between 3 and 49", "greatest(n-50,1)", "n-1") + ") s"),
    "generate_all_splits": _sequences("seqs", "split, "),
    "format_times": f"select uid, string_agg({fmt('time')}, ',' order by pos) as times from clean_pos where pos > n-80 group by uid",
    # residual quantisation
    "nearest_codeword": "select pid, c0 as code from q0",
    "residual_codes": f"select pid, {_csv('codes')} as codes from coded",
    "fit_codebooks": fitted_codewords(levels=3, words=16, steps=5),
    "train_codebooks": trained_codewords(epochs=3),
    "ema_codebook_update": """
      select level, code, round(size,6) as ema_size, round(list_sum(centroid),6) as centroid_sum, round(centroid[1],6) as centroid_0 from (
        select level, code, size, list_transform(s, lambda v: v / ((size+1e-5::double)/(total+16*1e-5::double)*total)) as centroid from (
          select level, code, size, s, sum(size) over (partition by level) as total from (
            select w.level, w.code, 0.99::double + 0.01::double*u.n as size,
                   list_transform(list_zip(w.c, coalesce(a.sums, list_transform(w.c, lambda z: 0.0::double))), lambda z: 0.99::double*z[1]+0.01::double*z[2]) as s
            from words w join usage u on u.level=w.level and u.code=w.code
            left join (select level, code, list(t order by i) as sums from (
                         select level, code, i, sum(v) as t from (
                           select level, code, unnest(rest) as v, generate_subscripts(rest,1) as i from assigned) e group by level, code, i) f
                       group by level, code) a on a.level=w.level and a.code=w.code) m) n) o""",
    "quantization_loss": "select level, round(avg(sq)/64,6) as mse, round(avg(sq)/64*1.25::double,6) as loss from assigned group by level",
    "utilization_loss": """
      select level, round(avg(abs(n-even)),6) as utilization
      from (select *, sum(n) over (partition by level)/16.0::double as even from usage) u group by level""",
    "compactness_loss": """
      select a.level, round(2*avg(list_distance(a.c,b.c)),6) as compactness from words a join words b on a.level=b.level and a.code<b.code group by a.level""",
    "kl_usage": """
      select level, round(avg(1/16.0::double*(ln(1/16.0::double)-ln(n/total+1e-8::double))),6) as kl_divergence
      from (select *, (sum(n) over (partition by level))::double as total from usage) u group by level""",
    "weighted_loss": """
      select run, epoch, round(r+q+case when epoch>=6 then 0.25*(u+c) else 0 end,6) as loss,
             round(r+q+case when epoch>=6 then 0.5*k else 0 end,6) as loss_kl
      from (select o_orderpriority as run, month(o_orderdate) as epoch, avg(o_totalprice)/1e5::double as r, max(o_totalprice)/1e6::double as q,
                   count(*)::double as u, min(o_totalprice)/1e4::double as c, count(distinct o_custkey)/1e3::double as k
            from orders group by all) t""",
    "reconstruction_mse": "select round(avg(list_inner_product(rest,rest))/64,6) as mse from coded",
    "format_sid": f"select pid, {sid('codes')} as sid from coded",
    "encode_places": f"select pid, {_csv('codes')} as codes, round(list_sum(q),6) as vector_sum, round(q[1],6) as vector_0 from coded",
    # prompts
    "sequence_to_sids": f"select split, uid, seq_no, {_csv('tokens',' ')} as tokens, target_token from toks",
    "sequence_to_ids": f"select split, uid, seq_no, {_TOKENS} as tokens, '<'||target||'>' as target_token from seqs",
    "prompt_with_time": "select split, uid, seq_no, instruction, input, output from timed",
    "prompt_no_time": f"""
      select split, uid, seq_no,
        'Here is a record of a user''s POI accesses, your task is based on the history to predict the next POI that the user is likely to access.' as instruction,
        'The user_'||uid||' visited: '||{_csv('tokens', ', ')}||', and in the next time user_'||uid||' is likely to visit:' as input,
        target_token as output from toks""",
    "prompt_completion": "select conv_id, turn, instruction||chr(10)||input||' ' as prompt, output as completion from dialogue",
    "mask_prompt_labels": _LABELS,
    "load_tokenized": f"""
      select {_csv('input_ids')} as input_ids,
             array_to_string(list_transform(input_ids, lambda t, i: case when starts[i] < inside then -100 else t end),',') as labels
      from (select inside, list_transform(words, lambda w: {hex_int('md5(w)', 7)}) as input_ids,
                   list_transform(words, lambda w, i: coalesce(list_sum(list_transform(words[1:i-1], lambda v: len(v))), 0)) as starts
            from (select len(instruction||chr(10)||input||' ') as inside,
                         regexp_extract_all(instruction||chr(10)||input||' '||output||'</s>','[0-9A-Za-z_]+|[^0-9A-Za-z_]')[1:64] as words
                  from dialogue) d) t""",
    "token_length_stats": """
      select count(*) as examples, min(n) as min_len, max(n) as max_len, round(avg(n),6) as mean_len,
             (list(n order by n))[(count(*)//2+1)::bigint] as median_len from lens""",
    "token_length_histogram": "select n//100*100 as bucket, count(*) as examples from lens group by 1",
    "extract_user_sids": "select split, uid, seq_no, user, array_to_string(list_sort(sids),' ') as sids from mentions",
    "collect_users_sids": """
      select 'user' as kind, user as value from mentions where split='train'
      union select 'sid', unnest(sids) from mentions where split='train'""",
    "filter_cold_prompts": """
      with train_sids as (select distinct uid%2 as half, unnest(sids) as s from mentions where split='train'),
      train_users as (select distinct uid%2 as half, user from mentions where split='train'),
      cold as (select d.half, t.uid, t.seq_no from (select uid, seq_no, unnest(sids) as s from mentions where split='test') t,
                      (values (0),(1)) d(half) where (d.half, t.s) not in (select half, s from train_sids))
      select case half when 0 then 'even' else 'odd' end as train_dataset, uid, seq_no, completion
      from mentions t join train_users u using (user)
      where split='test' and (half, uid, seq_no) not in (select half, uid, seq_no from cold)""",
    "variant_matrix": """
      select dataset, model, kind, mode, with_time, mode||'_'||kind||(case when with_time=1 then '' else '_notime' end)||'.json' as file_name
      from (select distinct dataset_name as dataset, run_name as model, 'codebook' as kind, 1 as with_time from named where dataset_name is not null
            union all select distinct dataset_name, run_name, 'codebook', 0 from named where dataset_name is not null and run_name in ('rqvae-nyc-div0.25-commit0.5-lr5e-5','rqvae-tky-div0.25-commit0.25-lr5e-5','Nrqvae-NYC-div0.25-commit0.25-lr1e-3','Nrqvae-TKY-div0.25-commit0.25-lr1e-3','Nrqvae-NYC_Exploration-div0.25-commit0.25-lr1e-3','Nrqvae-TKY_Exploration-div0.25-commit0.25-lr1e-3')
            union all select distinct dataset_name, '', 'id', 1 from named where dataset_name is not null) v,
           (select unnest(['train','val','test','test_all']) as mode) m""",
    # predictions
    "batch_predict": "select split, uid, seq_no, target, coalesce(predicted,-1) as predicted from guessed",
    "first_nonempty_attempt": "select split, uid, seq_no, gold, result from results",
    "top1_accuracy": "select split, count(*) as examples, round(avg(hit),6) as accuracy from scored group by split",
    "plain_id_accuracy": """
      select split, count(*) as examples, round(avg(contains('<'||coalesce(predicted||'>',''), '<'||target||'>')::int),6) as accuracy
      from guessed group by split""",
    "metrics_by_split": """
      select run_name, round(coalesce(train_acc,-1),6) as train_acc, round(coalesce(val_acc,-1),6) as val_acc,
             round(coalesce(test_all_acc,-1),6) as test_all_acc, round(coalesce(test_acc,-1),6) as test_acc from metrics""",
    "format_metrics": """
      select run_name, coalesce(printf('%.4f',train_acc),'-') as train_acc, coalesce(printf('%.4f',val_acc),'-') as val_acc,
             coalesce(printf('%.4f',test_all_acc),'-') as test_all_acc, coalesce(printf('%.4f',test_acc),'-') as test_acc from metrics""",
    "cross_eval_matrix": """
      select train_dataset, round(avg(hit) filter (uid%2=0),6) as even, round(avg(hit) filter (uid%2=1),6) as odd from (
        select d.name as train_dataset, s.uid, contains('<a_'||coalesce(substr(p.sid,4),''), g.sid)::int as hit
        from seq_test s join (values ('even',0),('odd',1)) d(name,half) on true
        left join (select half, src, dst from (
            select half, src, dst, row_number() over (partition by half, src order by count(*) desc, min(spot)) as k from (
              select uid%2 as half, pid as src, lead(pid) over (partition by uid order by row_id) as dst,
                     row_number() over (order by uid, row_id) as spot from train) e
            where dst is not null group by half, src, dst) r where k=1) n on n.half=d.half and n.src=s.pids[len(s.pids)]
        join place_sid g on g.pid=s.target left join place_sid p on p.pid=n.dst) t group by train_dataset""",
    "evaluate_runs": """
      with ex as (
        select 'times' as folder, '<a_' as hint, split, uid, instruction||chr(10)||input||' ' as prompt, output as completion, answer
        from timed join answers using (split, uid, seq_no)
        union all
        select 'ids', '<', split, uid,
               'Here is a record of a user''s POI accesses, your task is based on the history to predict the next POI that the user is likely to access.'
                 ||chr(10)||'The user_'||uid||' visited: '||array_to_string(list_transform(pids, lambda p: '<'||p||'>'), ', ')
                 ||', and in the next time user_'||uid||' is likely to visit: ',
               '<'||s.target||'>', coalesce(predicted||'>','')
        from seqs s join guessed g using (split, uid, seq_no)),
      keyed as materialized (
        select row_number() over () as row, * from (
          select *, md5(prompt||hint) as key from ex union all
          select 'half', hint, split, uid, prompt, completion, answer, md5(prompt||hint) from ex
          where folder='times' and (split='test' or (split='train' and uid%2=0))) f),
      said as (select key, min(answer) as answer from keyed group by key),
      spoken as (
        select row, folder, split, regexp_extract(lower(prompt),'user_[0-9]+') as user,
               list_distinct(list_concat(regexp_extract_all(lower(prompt),'(?:<\\w+>)+'), regexp_extract_all(lower(completion),'(?:<\\w+>)+'))) as sids
        from keyed),
      warm as (
        select row from spoken t where split<>'test' or ((folder, user) in (select folder, user from spoken where split='train')
          and row not in (select row from (select row, folder, unnest(sids) as sid from spoken where split='test') m
                          where (folder, sid) not in (select folder, unnest(sids) from spoken where split='train')))),
      asked as (
        select run_name, split, hint, completion, said.answer,
               len(list_filter(range(0,5), lambda t: substr(md5('try|'||run_name||'|'||k.key||'|'||t),1,1) >= 'a')) as tries
        from keyed k join warm using (row) join said on said.key=k.key
        join (values ('run-a','times'),('run-b','times'),('run-c','ids'),('run-d','half')) r(run_name, of) on r.of=k.folder),
      hits as (select run_name, split, contains(hint||(case when tries>0 then answer else '' end), completion)::int as hit from asked)
      select run_name, round(coalesce(avg(hit) filter (split='train'),-1),6) as train_acc, round(coalesce(avg(hit) filter (split='val'),-1),6) as val_acc,
             round(coalesce(avg(hit) filter (split='test_all'),-1),6) as test_all_acc, round(coalesce(avg(hit) filter (split='test'),-1),6) as test_acc
      from hits group by run_name
      union all select 'run-old', 0.5, -1.0, -1.0, 0.25""",
    "prediction_log": "select (gold='<a_'||result)::int as correct, gold, '<a_'||result as prediction from results",
    "perplexity": "select run, epoch, round(case when epoch%2=0 then 1.5 else exp(eval_loss) end,6) as perplexity from losses",
    "best_epoch_early_stop": """
      with recursive ordered as (select *, row_number() over (partition by run order by epoch) as k from (
          select o_orderpriority as run, month(o_orderdate) as epoch, round(avg(o_totalprice)/100000,6) as eval_loss from orders group by all) l),
      walk as (
        select run, k, epoch, eval_loss, 1 as improved, epoch as best_epoch, eval_loss as best, 0 as stopped from ordered where k=1
        union all
        select o.run, o.k, o.epoch, o.eval_loss, (o.eval_loss<w.best)::int, case when o.eval_loss<w.best then o.epoch else w.best_epoch end,
               least(o.eval_loss,w.best), (o.epoch-(case when o.eval_loss<w.best then o.epoch else w.best_epoch end)>2)::int
        from walk w join ordered o on o.run=w.run and o.k=w.k+1 where w.stopped=0)
      select run, epoch, eval_loss, improved, best_epoch, stopped from walk""",
    # semantic-id reports
    "sid_collisions": """
      select dataset, model, count(distinct s) as unique_sid, count(distinct s) filter (places>=2) as collided_sid_buckets, sum(n)::bigint as total_pois
      from (select dataset, model, s, count(distinct pid) as places, count(*) as n from (
              select dataset, model, pid, case when model='three-levels' then s else substr(s,1,instr(s,'<c_')-1) end as s
              from (select 'parts' as dataset, pid, sid as s from place_sid
                    union all select 'embeddings', pid, '<a_'||codes[1]||'><b_'||codes[2]||'><c_'||codes[3]||'>' from coded) a,
                   (values ('three-levels'),('two-levels')) m(model)) b group by dataset, model, s) c
      group by dataset, model""",
    "enrich_codebook": """
      select pid, d.mapped as cat_id, v.catname, v.region_id, v.catname||' @ Region '||v.region_id as cat_and_region
      from vec v join (select original, row_number() over (order by md5('2024|'||original)) as mapped
                       from (select distinct catname as original from vec) o) d on d.original=v.catname""",
    "prefix_frequency": """
      select * from (select prefix, count(*) as n, 1 as level from by1 group by prefix order by n desc, prefix::int limit 50) a
      union all select * from (select prefix, count(*) as n, 2 as level from by2 group by prefix order by n desc, prefix::int limit 50) b""",
    "combo_frequency": """
      select prefix, count(*) as n from by12 group by prefix
      order by n desc, split_part(prefix,',',1)::int, split_part(prefix,',',2)::int limit 30""",
    "top_categories_per_prefix": top_items("by1", "catname", 50),
    "top_cat_region_per_prefix": top_items("by1", "cat_and_region", 50),
    "top_regions_per_prefix": f"""
      select *, 1 as level from ({top_items('by1', 'region_id', 20)}) a union all select *, 2 from ({top_items('by2', 'region_id', 50)}) b""",
    "top_categories_per_combo": top_items("by12", "catname", 30),
    "top_regions_per_combo": "select prefix, item, n, rank from top_combo_regions",
    "sample_frequent_prefixes": "select report, prefix, n, slot from chosen",
    "aligned_prefix_matrix": """
      select report, item, coalesce(sum(n) filter (slot=1),0)::bigint as slot_1, coalesce(sum(n) filter (slot=2),0)::bigint as slot_2,
             coalesce(sum(n) filter (slot=3),0)::bigint as slot_3, coalesce(sum(n) filter (slot=4),0)::bigint as slot_4
      from drawn_items group by report, item""",
    "projection_subset": """
      select distinct d.pid, d.prefix, d.item, d.report from drawable d
      join chosen c on c.report=d.report and c.prefix=d.prefix
      join (select distinct report, item from drawn_items) i on i.report=d.report and i.item=d.item""",
    "project_2d": projected("""
      select distinct d.pid, p.catname, p.q from drawable d join pbook p on p.pid=d.pid
      join chosen c on c.report=d.report and c.prefix=d.prefix
      join (select distinct report, item from drawn_items) i on i.report=d.report and i.item=d.item where d.report='level_1'"""),
    # regions
    "decode_region": f"""
      select *, 'https://www.google.com/maps/search/?api=1&query='||printf('%.3f,%.3f',center_lat,center_lon) as map_url from ({_DECODED}) d""",
    "region_pair_distance": "select combo, region_1, region_2, round(km,6) as km from km",
    "combo_distance_stats": """
      select combo, count(*) as pairs, round(avg(km),6) as mean_km, round(min(km),6) as min_km, round(max(km),6) as max_km, round(stddev_pop(km),6) as std_km,
             (list(region_1||'-'||region_2 order by round(km,9), region_1, region_2))[1] as nearest,
             (list(region_1||'-'||region_2 order by round(km,9) desc, region_1, region_2))[1] as farthest
      from km group by combo""",
    "rank_combos_by_compactness": "select combo, round(mean_km,6) as mean_km, rank from compact",
    "first_combo_of_region": """
      select item as region, (list(prefix order by rank))[1] as combo
      from (select t.item, t.prefix, c.rank from top_combo_regions t join compact c on c.combo=t.prefix) x group by item""",
    "geo_extent": f"""
      select min(center_lat) as lat_min, max(center_lat) as lat_max, min(center_lon) as lon_min, max(center_lon) as lon_max,
             round((max(center_lat)-min(center_lat))*111,6) as north_south_km,
             round((max(center_lon)-min(center_lon))*111*cos(radians(avg(center_lat))),6) as east_west_km
      from (select distinct round(a*0.05::double-90+0.025,6) as center_lat, round(b*0.05::double-180+0.025,6) as center_lon
            from (select {cell('lat','lon')} from li) c) d""",
    # runs
    "parse_run_name": """
      select order_key, run_name, coalesce(dataset_name,'') as dataset_name, div_weight, commitment_weight, lr, quant_weight, recon_weight,
             use_kl_divergence, (dataset_name is null)::int as has_error from named""",
    "filter_runs_by_keywords": """
      select 'quantiser' as preset, order_key, run_id from run_ids where contains(lower(run_id),'vae')
      union all select 'language', order_key, run_id from run_ids
        where regexp_matches(lower(run_id),'llm|llama|gpt|bert|roberta|t5|transformer')
      union all select 'nyc', order_key, run_id from run_ids where contains(lower(run_id),'nyc')""",
    "codebook_size_for_dataset": """
      select dataset_name, case when dataset_name like 'NYC%' then 32 else 64 end as codewords, count(*) as runs
      from named where dataset_name is not null group by all""",
}


def statements() -> dict[str, str]:
    return {key: compose(statement) for key, statement in STATEMENTS.items()}

"""Statements of several rounds: fitted codewords and principal axes."""

from __future__ import annotations


def fitted_codewords(levels: int, words: int, steps: int) -> str:
    """Lloyd's steps per level from the vectors of the smallest digests, sums in units of 2**-24."""
    parts = ["rest_0 as materialized (select pid, x as rest from vec)"]
    for level in range(levels):
        parts.append(f"""
      c_{level}_0 as materialized (
        select (row_number() over (order by draw) - 1)::int as code, rest as c from (
          select rest, md5('2024|{level}|'||pid) as draw from rest_{level} order by draw limit {words}) d)""")
        for step in range(steps + 1):
            parts.append(f"""
      near_{level}_{step} as materialized (
        select pid, rest, code, c from (
          select pid, rest, code, c, row_number() over (partition by pid order by list_distance(rest,c), code) as k
          from rest_{level}, c_{level}_{step}) d where k=1)""")
            if step < steps:
                parts.append(f"""
      c_{level}_{step + 1} as materialized (
        select w.code, coalesce(s.m, w.c) as c from c_{level}_{step} w left join (
          select code, list(t order by i) as m from (
            select code, i, sum(floor(v*16777216+0.5::double)::hugeint)::double/16777216/count(*) as t from (
              select code, unnest(rest) as v, generate_subscripts(rest,1) as i from near_{level}_{step}) e group by code, i) f
          group by code) s on s.code=w.code)""")
        parts.append(f"""
      rest_{level + 1} as materialized (
        select pid, list_transform(list_zip(rest,c), lambda z: z[1]-z[2]) as rest from near_{level}_{steps})""")
    found = " union all ".join(
        f"select {level} as level, w.code, w.c, (select count(*) from near_{level}_{steps} a where a.code=w.code) as n from c_{level}_{steps} w"
        for level in range(levels)
    )
    return (
        f"with {','.join(parts)} select level, code, round(list_sum(c),6) as centroid_sum, round(c[1],6) as centroid_0, n from ({found}) t"
    )


def _powers(name: str, matrix: str) -> str:
    """A symmetric matrix squared again and again, scaled by its trace: its rows turn into the leading eigenvector."""
    return f"""
      {name}_p(k, m) as (
        select 0, m from {matrix}
        union all
        select k+1, list_transform(m, lambda a: list_transform(m, lambda b: list_inner_product(a,b)/t/t)) from (
          select k, m, list_sum(list_transform(range(1,len(m)+1), lambda i: m[i][i])) as t from {name}_p where k < 26) p),
      {name} as (
        select list_transform(v, lambda e: e * (case when v[list_position(list_transform(v, lambda q: abs(q)), list_max(list_transform(v, lambda q: abs(q))))] < 0
                                                    then -1 else 1 end)) as v
        from (select list_transform(r, lambda e: e/sqrt(list_inner_product(r,r))) as v from (
                select m[list_position(d, list_max(d))] as r from (
                  select m, list_transform(range(1,len(m)+1), lambda i: m[i][i]) as d from {name}_p where k = 26) q) s) u)"""


def projected(rows: str) -> str:
    """``rows`` (pid, catname, q) along the two leading eigenvectors of the covariance of ``q``."""
    return f"""
      with recursive points as materialized ({rows}),
      cols as materialized (
        select i, list(v order by pid) as c from (select pid, unnest(q) as v, generate_subscripts(q,1) as i from points) e group by i),
      cov as materialized (
        select list(r order by i) as m from (
          select a.i, list(list_inner_product(a.c,b.c)/len(a.c) - list_avg(a.c)*list_avg(b.c) order by b.i) as r
          from cols a, cols b group by a.i) t),
      {_powers('first_axis', 'cov')},
      deflated as materialized (
        select list_transform(m, lambda a, i: list_transform(a, lambda e, j: e - l*v[i]*v[j])) as m from (
          select m, v, list_inner_product(list_transform(m, lambda a: list_inner_product(a,v)), v) as l from cov, first_axis) d),
      {_powers('second_axis', 'deflated')}
      select pid, catname, round(list_inner_product(q,a.v),6) as x, round(list_inner_product(q,b.v),6) as y
      from points, first_axis a, second_axis b"""


def trained_codewords(epochs: int, levels: int = 3, diversity_from: int = 1) -> str:
    """Moving averages over epochs from one row at each word of ``words``, the losses of each epoch and the sums of the last state."""
    parts = ["w_0 as materialized (select level, code::int as code, 1.0::double as size, c as s, c from words)"]
    logs = []
    for e in range(epochs):
        parts.append(f"rest_{e}_0 as materialized (select pid, x as rest from vec)")
        for level in range(levels):
            parts.append(f"""
      near_{e}_{level} as materialized (
        select pid, rest, code, c, list_transform(list_zip(rest,c), lambda z: z[1]-z[2]) as left_over from (
          select pid, rest, code, c, row_number() over (partition by pid order by list_distance(rest,c), code) as k
          from rest_{e}_{level}, w_{e} where level={level}) d where k=1)""")
            parts.append(f"rest_{e}_{level + 1} as materialized (select pid, left_over as rest from near_{e}_{level})")
        given = " union all ".join(f"select {level} as level, code, rest, left_over from near_{e}_{level}" for level in range(levels))
        parts.append(f"given_{e} as materialized ({given})")
        parts.append(f"""
      used_{e} as materialized (
        select w.level, w.code, count(g.level) as n from w_{e} w left join given_{e} g on g.level=w.level and g.code=w.code group by w.level, w.code)""")
        parts.append(f"""
      w_{e + 1} as materialized (
        select level, code, size, s, list_transform(s, lambda v: v / ((size+1e-5::double)/(total+k*1e-5::double)*total)) as c from (
          select level, code, size, s, sum(size) over (partition by level) as total, count(*) over (partition by level) as k from (
            select w.level, w.code, 0.99::double*w.size + 0.01::double*u.n as size,
                   list_transform(list_zip(w.s, coalesce(a.sums, list_transform(w.s, lambda z: 0.0::double))), lambda z: 0.99::double*z[1]+0.01::double*z[2]) as s
            from w_{e} w join used_{e} u on u.level=w.level and u.code=w.code
            left join (select level, code, list(t order by i) as sums from (
                         select level, code, i, sum(v) as t from (
                           select level, code, unnest(rest) as v, generate_subscripts(rest,1) as i from given_{e}) x group by level, code, i) y
                       group by level, code) a on a.level=w.level and a.code=w.code) m) o)""")
        parts.append(f"""
      loss_{e} as materialized (
        select {e} as epoch, arg_max(mse, level) as reconstruction, sum(mse)*1.25::double as quantization,
               sum(utilization) as utilization, sum(compactness) as compactness, sum(kl) as kl_divergence from (
          select level, avg(list_inner_product(left_over,left_over))/64 as mse from given_{e} group by level) m
        join (select level, avg(abs(n-even)) as utilization, avg((1/k)*(ln(1/k)-ln(n/total+1e-8::double))) as kl from (
                select *, sum(n) over (partition by level)/count(*) over (partition by level)::double as even,
                       (count(*) over (partition by level))::double as k, (sum(n) over (partition by level))::double as total from used_{e}) u
              group by level) d using (level)
        join (select a.level, 2*avg(list_distance(a.c,b.c)) as compactness from w_{e} a join w_{e} b on a.level=b.level and a.code<b.code
              group by a.level) p using (level))""")
        logs.append(f"select * from loss_{e}")
    return f"""
      with {','.join(parts)}
      select epoch, round(reconstruction,6) as reconstruction, round(quantization,6) as quantization, round(utilization,6) as utilization,
             round(compactness,6) as compactness, round(kl_divergence,6) as kl_divergence,
             round(reconstruction+quantization+case when epoch>={diversity_from} then 0.25::double*(utilization+compactness) else 0 end,6) as loss,
             (select round(sum(list_sum(c)),6) from w_{epochs}) as centroid_sum, (select round(sum(size),6) from w_{epochs}) as ema_size
      from ({' union all '.join(logs)}) l"""

"""Building blocks of the check SQL: the same series tables and rules as plain SQL."""

from __future__ import annotations

from workload.bindings import KINDS

_mean = lambda cond="": (f"cast(sum(c){cond} as double) / (count(c){cond}) / 100")
_kind = ", ".join(f"{_mean(chr(32) + 'filter (where event_type = ' + chr(39) + k + chr(39) + ')')} as {k}"
                  for k in KINDS)

CTE: dict[str, str] = {
    "ev": """select user_id as id, cast(date_diff('day', date '2024-01-01', cast(ts as date)) + 1 as int) as day,
             event_type, cast(round(value * 100) as bigint) as c, value, ts from events where user_id is not null""",
    "ud": f"""select id, day, {_mean()} as level, count(*) as n_events, {_kind} from ev group by id, day""",
    "dy": """select ud.*, cast(sum(n_events) over w as double) as exposure,
             case when count(purchase) over w > 0 then 0.0::double else 1.0::double end as setpoint,
             c_mktsegment as segment from ud left join customer on c_custkey = id
             window w as (partition by id order by day rows between unbounded preceding and current row)""",
    "mo0": """select l_suppkey as id, cast((year(l_shipdate) - 1995) * 12 + month(l_shipdate) as int) as day,
              cast(sum(cast(round(l_quantity * 100) as bigint)) as double) / 100 as level,
              sum(cast(round(l_extendedprice * 100) as bigint)) as price,
              cast(sum(cast(round(l_discount * 100) as bigint)) as double) / count(*) / 100 as discount,
              cast(sum(cast(round(l_tax * 100) as bigint)) as double) / count(*) / 100 as tax,
              count(*) filter (where l_returnflag = 'R') as r from lineitem group by 1, 2""",
    "mo": """select id, day, level, discount, tax, cast(sum(price) over w as double) / 100 as exposure,
             case when sum(r) over w > 0 then 0.0::double else 1.0::double end as setpoint from mo0
             window w as (partition by id order by day rows between unbounded preceding and current row)""",
    "fl": "select id, day, level, n_events, " + ", ".join(
        f"last_value({k} ignore nulls) over (partition by id order by day rows between unbounded preceding and current row) as {k}"
        for k in KINDS) + " from ud",
}


def grid(src: str, name: str, cols: tuple[str, ...] = ("level",), where: str = "true") -> dict[str, str]:
    """Daily grid of ``src`` with interpolated columns: id, day, cols, last_day."""
    parts = []
    for c in cols:
        parts.append(f"""case when {c} is not null then {c} when p_{c} is null then nv_{c}
            when n_{c} is null then pv_{c}
            else (nv_{c} - pv_{c}) / (n_{c} - p_{c}) * (day - p_{c}) + pv_{c} end as {c}""")
    back = "over (partition by id order by day rows between unbounded preceding and current row)"
    fwd = "over (partition by id order by day rows between current row and unbounded following)"
    look = []
    for c in cols:
        d = f"case when {c} is not null then day end"
        look += [f"last_value({d} ignore nulls) {back} as p_{c}", f"last_value({c} ignore nulls) {back} as pv_{c}",
                 f"first_value({d} ignore nulls) {fwd} as n_{c}", f"first_value({c} ignore nulls) {fwd} as nv_{c}"]
    return {
        f"{name}_src": f"select * from {src} where {where}",
        f"{name}_d": f"""select id, last_day, cast(unnest(generate_series(1, last_day)) as int) as day
                         from (select id, max(day) as last_day from {name}_src group by id)""",
        f"{name}_j": f"""select d.id, d.day, d.last_day, {', '.join('s.' + c for c in cols)} from {name}_d d
                         left join {name}_src s on s.id = d.id and s.day = d.day""",
        f"{name}_l": f"select *, {', '.join(look)} from {name}_j",
        name: f"select id, day, last_day, {', '.join(parts)} from {name}_l",
    }


def detect(src: str, name: str, width: int = 3, n: int = 2, threshold: float = 0.30, refine: bool = True,
           min_peak: float | None = None) -> dict[str, str]:
    """Detection as set operations: candidates joined to later days of their own series."""
    out = grid(src, f"{name}_g")
    before, after = width // 2, (width - 1) // 2
    s = "level" if width <= 1 else (f"avg(level) over (partition by id order by day rows between {before} preceding "
                                    f"and {after} following)")
    falls = " and ".join(f"coalesce(lead(s, {k}) over w < {'s' if k == 1 else f'lead(s, {k - 1}) over w'}, false)"
                         for k in range(1, n + 1))
    out[f"{name}_s"] = f"select id, day, last_day, level, {s} as s from {name}_g"
    out[f"{name}_c"] = f"select *, {falls} as falls from {name}_s window w as (partition by id order by day)"
    floor = "" if min_peak is None else f" and s >= {min_peak}"
    out[f"{name}_o"] = f"""select c.id, c.day, c.s, min(x.day) filter (where x.s > c.s) as stop from
        (select * from {name}_c where falls and s > 0{floor}) c
        left join {name}_s x on x.id = c.id and x.day > c.day group by 1, 2, 3"""
    out[f"{name}_w"] = f"""select o.id, o.day, o.s, min(x.s) as low from {name}_o o join {name}_s x
        on x.id = o.id and x.day >= o.day and (o.stop is null or x.day < o.stop) group by 1, 2, 3"""
    out[f"{name}_f"] = f"""select id, min(day) as day, min_by(s, day) as s, min_by(low, day) as low
        from {name}_w where (s - low) / s >= {threshold} group by id"""
    half = width // 2 if refine and width > 1 else 0
    out[name] = f"""select i.id, f.id is not null as occurred, cast(p.peak as double) as day,
        (f.s - f.low) / f.s as drop_fraction, f.s as peak_value, cast(i.last_day as double) as censoring_day,
        cast(coalesce(p.peak, i.last_day) as double) as time,
        case when i.nv = 0 then 'no_data' when i.last_day <= {n} then 'too_short'
             when f.id is null then 'no_fall' else 'event' end as reason_code
        from (select id, max(last_day) as last_day, count(level) as nv from {name}_g group by id) i
        left join {name}_f f on f.id = i.id
        left join (select f.id, arg_max(x.day, struct_pack(v := x.level, d := -x.day)) as peak from {name}_f f
                   join {name}_s x on x.id = f.id and x.day between f.day - {half} and f.day + {half}
                   and x.level is not null group by f.id) p on p.id = i.id"""
    return out


def rates(src: str, name: str, dilutions=(0.0,), where: str = "level is not null and exposure is not null",
          min_rows: int = 4) -> dict[str, str]:
    """Interval rates: dilution, id, day, level, exposure, smoothed, rate."""
    out = {f"{name}_in": f"""select id, day, level, exposure from {src} where {where}
                             qualify count(*) over (partition by id) >= {min_rows}"""}
    out |= grid(f"{name}_in", f"{name}_g", ("level", "exposure"))
    out[f"{name}_s"] = f"""select *, avg(level) over (partition by id order by day rows between 1 preceding and 1 following)
                           as smoothed from {name}_g"""
    out[f"{name}_n"] = f"""select *, lead(smoothed) over w as s1, lead(exposure) over w as x1 from {name}_s
                           window w as (partition by id order by day)"""
    vals = ", ".join(f"({d}::double)" for d in dilutions)
    out[name] = f"""select dilution, id, day, level, exposure, smoothed, last_day,
        case when (exposure + x1) / 2 > 0 then ((s1 - smoothed) + dilution * ((smoothed + s1) / 2)) / ((exposure + x1) / 2)
        end as rate from {name}_n, (values {vals}) t(dilution)"""
    return out


def rate_label(rate: str, name: str, fall: float = 0.15) -> dict[str, str]:
    """Rate-based label: dilution, id, day."""
    return {
        f"{name}_c": f"""select *, coalesce(rate < 0 and lead(rate) over w < 0, false) and coalesce(
            max(rate) over (partition by id, dilution order by day rows between unbounded preceding and 1 preceding) > 0, false)
            as cand from {rate} window w as (partition by id, dilution order by day)""",
        f"{name}_o": f"""select c.dilution, c.id, c.day, c.smoothed as s, min(x.day) filter (where x.smoothed > c.smoothed) as stop
            from (select * from {name}_c where cand and smoothed > 0) c left join {rate} x
            on x.id = c.id and x.dilution = c.dilution and x.day > c.day group by 1, 2, 3, 4""",
        f"{name}_w": f"""select o.dilution, o.id, o.day, o.s, min(x.smoothed) as low from {name}_o o join {rate} x
            on x.id = o.id and x.dilution = o.dilution and x.day >= o.day and (o.stop is null or x.day < o.stop)
            group by 1, 2, 3, 4""",
        f"{name}_f": f"select dilution, id, min(day) as day from {name}_w where (s - low) / s >= {fall} group by 1, 2",
        f"{name}_p": f"""select f.dilution, f.id, arg_max(x.day, struct_pack(v := x.level, d := -x.day)) as peak
            from {name}_f f join {rate} x on x.id = f.id and x.dilution = f.dilution
            and x.day between f.day - 1 and f.day + 1 group by 1, 2""",
        name: f"""select i.dilution, i.id, cast(p.peak as double) as day from (select distinct dilution, id from {rate}) i
            left join {name}_p p on p.id = i.id and p.dilution = i.dilution""",
    }


def labels(src: str, name: str, dilutions=(0.0, 0.02, 0.05)) -> dict[str, str]:
    """Label table of the rate rule, one row per series."""
    out = rates(src, f"{name}_r", dilutions) | rate_label(f"{name}_r", f"{name}_k")
    wide = ", ".join(f"max(day) filter (where dilution = {d}::double) as day_d{round(d * 100)}" for d in dilutions)
    first = f"day_d{round(dilutions[0] * 100)}"
    out[f"{name}_v"] = f"select id, {wide} from {name}_k group by id"
    out[name] = f"""select s.id, s.last_day, v.* exclude (id), v.{first} as day, v.{first} is not null as event,
        coalesce(v.{first}, s.last_day) as time, coalesce(s.peak < 0.03, false) as never_accumulates,
        coalesce(v.{first} <= 3, false) or coalesce(s.peak < 0.03, false) as excluded
        from (select id, cast(max(day) as double) as last_day, max(level) as peak from {src} group by id) s
        left join {name}_v v on v.id = s.id"""
    return out


def person_period(src: str, lab: str, name: str, lead: int = 1, blind: bool = False) -> dict[str, str]:
    """At-risk rows of the daily table; see the operator of the same name."""
    need = [*KINDS, "exposure", "setpoint"]
    ff = ", ".join(f"last_value({c} ignore nulls) over w as {c}" for c in need)
    end = "last_day" if blind else "case when event then day else time end"
    ev = "false" if blind else "event"
    flags = ", ".join(f"cast(day = {k} as int) as d{k}" for k in range(3, 12)) + ", cast(day >= 12 as int) as d12p"
    meas = [*KINDS, "exposure", "d_exposure"]
    if lead == 1:
        cols = ", ".join([*meas, "setpoint", "low_today", "drops_tomorrow"])
    else:
        cols = ", ".join(f"lag({c}) over (partition by id order by day) as {c}"
                         for c in [*meas, "setpoint", "low_today"])
        cols += ", greatest(low_today, drops_tomorrow) as drops_tomorrow"
    return {
        f"{name}_k": f"select id, cast({end} as int) as last_risk, {ev} as happens from {lab} where not excluded",
        f"{name}_d": f"""select id, segment, cast(unnest(generate_series(1, m)) as int) as day from (select id,
            max(day) as m, arg_min(segment, day) filter (where segment is not null) as segment
            from {src} where id in (select id from {name}_k) group by id)""",
        f"{name}_f": f"""select d.id, d.day, d.segment, {ff} from {name}_d d left join {src} s on s.id = d.id and s.day = d.day
            window w as (partition by d.id order by d.day rows between unbounded preceding and current row)""",
        f"{name}_x": f"""select *, exposure - lag(exposure) over w as d_exposure,
            coalesce(cast(setpoint < lag(setpoint) over w as int), 0) as low_today,
            coalesce(cast(lead(setpoint) over w < setpoint as int), 0) as drops_tomorrow
            from {name}_f window w as (partition by id order by day)""",
        f"{name}_y": f"select id, day, segment, {cols} from {name}_x",
        name: f"""select y.*, {flags}, cast(happens and day = last_risk as int) as y from {name}_y y
            join {name}_k k on k.id = y.id where day between 2 and last_risk""",
    }


def with_ctes(parts: dict[str, str], final: str) -> str:
    """Assemble a statement; base tables are added where a later part names them."""
    import re

    need: dict[str, str] = {}

    def visit(text: str) -> None:
        for base in CTE:
            if base not in need and base not in parts and re.search(rf"\b{base}\b", text):
                visit(CTE[base])
                need[base] = CTE[base]

    for t in parts.values():
        visit(t)
    visit(final)
    body = ", ".join(f"{k} as ({v})" for k, v in {**need, **parts}.items())
    return f"with recursive {body} {final}" if body else final

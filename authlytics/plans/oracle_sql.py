"""DuckDB SQL that states each registered query a second time, independently of
the Spark plan (plain PARTITION BY key windows, no buckets, no deltas). Used
as the correctness oracle on the driver's tables.
"""

from __future__ import annotations

from ..functions import constants as K
from ..sources.fixtures import events_sql, metrics_sql

# window of the registered feature queries: the fixture is sparse (about three
# events per IP and day at sf0.01), so 7 days replaces the default 5 minutes
QUERY_WINDOW_SECONDS = 7 * 86400


def _iv(seconds: float) -> str:
    micros = int(round(seconds * 1e6)) - 1
    return f"INTERVAL '{micros // 1000000}.{micros % 1000000:06d} seconds'"


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def features_sql(window_seconds: float = QUERY_WINDOW_SECONDS, compat: bool = False) -> str:
    """One row per event: the 14 features (intended semantics unless compat)."""
    iv = _iv(window_seconds)
    lolbin_any = "(" + "|".join(K.LOLBINS) + ")"
    acct = "(" + "|".join(K.ACCOUNT_CHANGE_COMMANDS) + ")"
    if compat:
        lolbin = f"regexp_matches(lower(coalesce(message, '')), '{lolbin_any}')"
    else:
        lolbin = (f"coalesce(regexp_extract(coalesce(nullif(regexp_extract(message, 'COMMAND=(\\S+)', 1), ''), "
                  f"nullif(regexp_extract(message, '^Executed: (\\S+)', 1), '')), '([^/]+)$', 1) in {_in(K.LOLBINS)}, false)")
    return f"""
with ev as ({events_sql('duckdb')}),
p as (
  select event_id, ts, nullif(source_ip, '') as ip, nullif(username, '') as usr, auth_method, event_type, message,
    case when instr(event_type, 'failed') > 0 then 1 else 0 end as is_failed,
    event_type = 'login_success' as is_login,
    case when event_type = 'login_success' then (hour(ts) * 60 + minute(ts))::hugeint end as login_h,
    case when instr(event_type, 'sudo') > 0 then 1 else 0 end as is_sudoish,
    case when event_type = 'sudo_failure' then 1 else 0 end as is_sudo_fail,
    event_type = 'sudo_success' as is_sudo_ok,
    case when event_type in ('sudo_success', 'process_execution') then 1 else 0 end as is_cmd,
    case when regexp_matches(coalesce(message, ''), '{acct}') then 1 else 0 end as is_acct,
    {lolbin} as lolbin
  from ev
),
ipw as (
  select event_id, count(*) over wi as n, sum(is_failed) over wi as f,
    count(distinct usr) over wi as u, count(distinct coalesce(auth_method, chr(0))) over wi as m,
    min(ts) over wi as tmin,
    usr is not null and row_number() over (partition by ip, usr order by ts, event_id) = 1 as new_ip
  from p where ip is not null
  window wi as (partition by ip order by ts range between {iv} preceding and current row)
),
u1 as (
  select *, count(*) filter (where is_cmd = 1) over (partition by usr order by ts range between unbounded preceding and current row) as r
  from p where usr is not null
),
usw as (
  select event_id,
    count(*) over wu as un, sum(is_sudo_fail) over wu as fs, sum(is_acct) over wu as ac,
    max(case when is_login then ts end) over wu as last_login,
    r, max(case when is_login then r end) over wu as rl,
    case when count(login_h) over wh >= 2 then sqrt((count(login_h) over wh * sum(login_h * login_h) over wh - sum(login_h) over wh * sum(login_h) over wh)::double
      / (count(login_h) over wh::double * (count(login_h) over wh - 1)::double)) / 60.0 else 0.0 end as std,
    is_sudo_ok and coalesce(sum(is_sudoish) over (partition by usr order by ts, event_id rows between unbounded preceding and 1 preceding), 0) = 0 as first_sudo
  from u1
  window wu as (partition by usr order by ts range between {iv} preceding and current row),
    wh as (partition by usr order by ts, event_id rows between unbounded preceding and current row)
)
select p.event_id, p.event_type, p.ts, p.ip as source_ip, p.usr as username,
  coalesce(ipw.n, 0)::bigint as ip_window_events, coalesce(usw.un, 0)::bigint as user_window_events,
  coalesce(ipw.f, 0)::bigint as ip_failed_logins,
  coalesce(ipw.u, 0)::bigint as ip_unique_users_attempted,
  coalesce(ipw.f / ipw.n, 0.0) as ip_failed_to_success_ratio,
  case when ipw.n >= 2 then date_diff('microsecond', ipw.tmin, p.ts) / 1e6 / (ipw.n - 1) else 0.0 end as ip_avg_inter_attempt_seconds,
  coalesce(ipw.m / ipw.n, 0.0) as ip_auth_method_variance,
  coalesce(usw.std, 0.0) as user_login_time_std_devs,
  {"(p.usr is null or p.ip is null)" if compat else "coalesce(ipw.new_ip, false)"} as user_new_ip_detected,
  {"false" if compat else "coalesce(usw.first_sudo, false)"} as user_first_sudo_usage,
  coalesce(usw.fs, 0)::bigint as user_failed_sudo_attempts,
  false as user_login_from_new_asn,
  case when p.is_sudo_ok and usw.last_login > p.ts - {iv} - INTERVAL '1 microsecond'
       then date_diff('microsecond', usw.last_login, p.ts) / 1e6 else 0.0 end as session_login_to_privesc_seconds,
  {"0.0::double" if compat else f"case when usw.last_login > p.ts - {iv} - INTERVAL '1 microsecond' and p.ts > usw.last_login then (usw.r - usw.rl) / (date_diff('microsecond', usw.last_login, p.ts) / 60e6) else 0.0 end"} as session_post_login_command_rate,
  p.lolbin as session_lolbin_executed,
  {"0" if compat else "coalesce(usw.ac, 0)"}::bigint as session_account_changes
from p left join ipw using (event_id) left join usw using (event_id)
"""


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def parsed_sql(lines_sql: str, year: int = 2024) -> str:
    """The parser stated in DuckDB: same patterns, same precedence."""
    blank = r"regexp_matches(value, '^\s*$')"
    ssh = "instr(value, 'sshd[') > 0"
    sudo = "instr(value, 'sudo: ') > 0"
    P = {n: _q(getattr(K, n)) for n in ("RE_SSH_FAILED", "RE_SSH_SUCCESS", "RE_SSH_INVALID", "RE_SUDO_SUCCESS",
                                         "RE_SUDO_FAILURE", "RE_AUDIT_EXECVE", "RE_AUDIT_EPOCH")}
    kind = f"""case when source = 'audit_log' then
        (case when {blank} or instr(value, 'type=') = 0 then null when regexp_matches(value, {P['RE_AUDIT_EXECVE']}) then 7 end)
      else (case when {blank} then null
        when {ssh} and regexp_matches(value, {P['RE_SSH_FAILED']}) then 1
        when {ssh} and regexp_matches(value, {P['RE_SSH_SUCCESS']}) then 2
        when {ssh} and regexp_matches(value, {P['RE_SSH_INVALID']}) then 3
        when {sudo} and regexp_matches(value, {P['RE_SUDO_SUCCESS']}) then 4
        when {sudo} and regexp_matches(value, {P['RE_SUDO_FAILURE']}) then 5
        else 6 end) end"""

    def x(p, g):
        return f"regexp_extract(value, {P[p]}, {g})"
    stamp = (f"case kind when 1 then {x('RE_SSH_FAILED', 1)} when 2 then {x('RE_SSH_SUCCESS', 1)} "
             f"when 3 then {x('RE_SSH_INVALID', 1)} when 4 then {x('RE_SUDO_SUCCESS', 1)} "
             f"when 5 then {x('RE_SUDO_FAILURE', 1)} end")
    return f"""
with l as ({lines_sql}),
k as (select *, {kind} as kind from l),
r as (
  select event_id, source, value, kind,
    case kind when 1 then {x('RE_SSH_FAILED', 3)} when 2 then {x('RE_SSH_SUCCESS', 4)} when 3 then {x('RE_SSH_INVALID', 3)} end as ip_s,
    case kind when 1 then {x('RE_SSH_FAILED', 4)} when 2 then {x('RE_SSH_SUCCESS', 5)} when 3 then {x('RE_SSH_INVALID', 4)} end as port_s,
    case kind when 1 then {x('RE_SSH_FAILED', 2)} when 2 then {x('RE_SSH_SUCCESS', 3)} when 3 then {x('RE_SSH_INVALID', 2)}
      when 4 then {x('RE_SUDO_SUCCESS', 2)} when 5 then {x('RE_SUDO_FAILURE', 2)} end as user_s,
    {stamp} as stamp
  from k where kind is not null
)
select event_id, source,
  case when kind = 7 then make_timestamp(cast(cast(regexp_extract(value, {P['RE_AUDIT_EPOCH']}, 1) as decimal(24,6)) * 1000000 as bigint))
       when kind = 6 then null
       else strptime('{year} ' || regexp_replace(stamp, ' +', ' ', 'g'), '%Y %b %d %H:%M:%S') end as event_time,
  'localhost' as host,
  nullif(ip_s, '') as source_ip,
  try_cast(nullif(port_s, '') as integer) as source_port,
  nullif(user_s, '') as username,
  case when kind in (1, 3) then 'password' when kind = 2 then {x('RE_SSH_SUCCESS', 2)} when kind in (4, 5) then 'sudo'
       when kind = 7 then 'exec' else 'unknown' end as auth_method,
  case kind when 1 then 'login_failed' when 2 then 'login_success' when 3 then 'invalid_user_attempt'
       when 4 then 'sudo_success' when 5 then 'sudo_failure' when 7 then 'process_execution' else 'unknown' end as event_type,
  case when kind in (1, 2, 3) then 'sshd' when kind in (4, 5) then 'sudo' when kind = 7 then 'auditd' else 'unknown' end as service,
  case when kind = 7 then 'Executed: ' || {x('RE_AUDIT_EXECVE', 1)} else value end as message,
  value as raw_line
from r
"""


# ----------------------------------------------------------------- shared pieces

def scored_sql(compat: bool = False) -> str:
    """Features + deterministic fixture score (no forest) per event."""
    return f"""select f.*, e.value, -(e.value / (e.value + 50.0)) as raw_score,
  e.value / (e.value + 50.0) as anomaly_score, e.value >= 50.0 as is_anomaly
from ({features_sql(compat=compat)}) f join (select event_id, value from events) e using (event_id)"""


def risk_sql(score: str) -> str:
    return (f"case when {score} >= 0.9 then 'CRITICAL' when {score} >= 0.8 then 'HIGH' "
            f"when {score} >= 0.6 then 'MEDIUM' when {score} >= 0.4 then 'LOW' else 'NORMAL' end")


def rules_sql() -> str:
    """Technique ids in rule order, comma separated ('' when none)."""
    return """concat_ws(',',
    case when event_type = 'login_failed' and ip_failed_logins > 5 then 'T1110,T1110.001' end,
    case when event_type = 'invalid_user_attempt' then 'T1110' end,
    case when event_type = 'login_success' and ip_failed_to_success_ratio > 0.5 then 'T1110.004,T1078' end,
    case when event_type = 'login_success' and user_new_ip_detected then 'T1078,T1078.001' end,
    case when instr(event_type, 'sudo') > 0 then 'T1548,T1548.003' end,
    case when event_type = 'sudo_success' and user_first_sudo_usage then 'T1548' end,
    case when event_type = 'sudo_failure' and user_failed_sudo_attempts > 3 then 'T1548.003' end,
    case when session_login_to_privesc_seconds > 0 and session_login_to_privesc_seconds < 60 then 'T1548' end,
    case when session_lolbin_executed then 'T1059.004,T1105' end)"""


def dim_sql() -> str:
    rows = ", ".join(f"({_q(i)}, {_q(n)}, {_q(t)}, {_q(d)}, {k})" for k, (i, n, t, d, _) in enumerate(K.TECHNIQUES))
    return f"select * from (values {rows}) d(technique_id, name, tactic, description, dim_pos)"


def explanation_sql() -> str:
    return """case when not is_anomaly then 'Event appears normal'
  when coalesce(concat_ws('; ',
    case when ip_failed_logins > 5 then printf('High failed login attempts (%d)', ip_failed_logins) end,
    case when ip_unique_users_attempted > 5 then printf('Scanning multiple users (%d)', ip_unique_users_attempted) end,
    case when ip_failed_to_success_ratio > 0.7 then 'High failure rate (' || printf('%.1f%%', round(ip_failed_to_success_ratio * 100.0, 1)) || ')' end,
    case when user_new_ip_detected then 'Login from new IP address' end,
    case when user_first_sudo_usage then 'First sudo usage for user' end,
    case when user_failed_sudo_attempts > 3 then printf('Multiple failed sudo attempts (%d)', user_failed_sudo_attempts) end,
    case when session_login_to_privesc_seconds > 0 and session_login_to_privesc_seconds < 60 then printf('Rapid privilege escalation (%ds after login)', cast(trunc(session_login_to_privesc_seconds) as bigint)) end,
    case when session_lolbin_executed then 'Potential LOLBin execution detected' end), '') = ''
  then 'Anomaly detected but specific factors unclear'
  else 'Possible attack detected: ' || concat_ws('; ',
    case when ip_failed_logins > 5 then printf('High failed login attempts (%d)', ip_failed_logins) end,
    case when ip_unique_users_attempted > 5 then printf('Scanning multiple users (%d)', ip_unique_users_attempted) end,
    case when ip_failed_to_success_ratio > 0.7 then 'High failure rate (' || printf('%.1f%%', round(ip_failed_to_success_ratio * 100.0, 1)) || ')' end,
    case when user_new_ip_detected then 'Login from new IP address' end,
    case when user_first_sudo_usage then 'First sudo usage for user' end,
    case when user_failed_sudo_attempts > 3 then printf('Multiple failed sudo attempts (%d)', user_failed_sudo_attempts) end,
    case when session_login_to_privesc_seconds > 0 and session_login_to_privesc_seconds < 60 then printf('Rapid privilege escalation (%ds after login)', cast(trunc(session_login_to_privesc_seconds) as bigint)) end,
    case when session_lolbin_executed then 'Potential LOLBin execution detected' end) end"""


def contributions_list_sql() -> str:
    """Sorted contribution structs (k = -value, idx, name, value), kept > 0.1."""
    items = ", ".join(
        f"{{'k': -least(abs({n}::double), 1.0), 'idx': {i}, 'name': '{n}', 'value': least(abs({n}::double), 1.0)}}"
        for i, n in enumerate(K.FEATURE_NAMES))
    return f"list_sort(list_filter([{items}], lambda x: x.value > 0.1))"


def actions_sql(scored: str) -> str:
    """Decisions per anomaly (default thresholds), one row per action."""
    return f"""
lvl as (select *, case risk_level when 'NORMAL' then 1 when 'LOW' then 2 when 'MEDIUM' then 3
          when 'HIGH' then 4 when 'CRITICAL' then 5 end as lv
        from (select *, {risk_sql('anomaly_score')} as risk_level from ({scored}) s where is_anomaly) a),
acts as (
  select event_id, 0 as seq, 'alert_only' as action_type, coalesce(username, 'unknown') as target,
    'Anomaly detected: ' || event_type || ' (score: ' || printf('%.2f', round(anomaly_score, 2)) || ')' as reason,
    risk_level as severity, ts from lvl
  union all select event_id, 1, 'block_ip', coalesce(source_ip, 'unknown'), 'Blocking IP after ' || event_type, risk_level, ts from lvl where lv >= 4
  union all select event_id, 2, 'lock_account', coalesce(username, 'unknown'), 'Locking account after ' || event_type, risk_level, ts from lvl where lv >= 4
  union all select event_id, 3, 'terminate_session', coalesce(username, 'unknown'),
    'Terminating sessions for ' || coalesce(username, 'unknown') || ' (CRITICAL)', risk_level, ts from lvl where lv >= 5
)"""


def cooldown_sql(enable_actions: bool) -> str:
    """Greedy cooldown as a recursive chain per action:target (after actions_sql)."""
    live = "true" if enable_actions else "action_type = 'alert_only'"
    return f"""
ca as (select *, action_type || ':' || target as k, epoch_us(ts) as t,
         case action_type when 'lock_account' then 300 when 'block_ip' then 600 when 'terminate_session' then 180 else 300 end as cd_s,
         {live} as live
       from acts),
ord as (select *, row_number() over (partition by k order by t, event_id, seq) as rn from ca where live),
nxt as (select a.k, a.rn, min(b.rn) as nrn from ord a left join ord b on a.k = b.k and b.t >= a.t + a.cd_s * 1000000
        group by a.k, a.rn),
chain(k, rn) as (select k, rn from ord where rn = 1
                 union all select n.k, n.nrn from chain c join nxt n on n.k = c.k and n.rn = c.rn where n.nrn is not null),
cooled as (select ca.*, case when not ca.live then true else c.rn is not null end as allowed
           from ca left join ord o on o.event_id = ca.event_id and o.seq = ca.seq
           left join chain c on c.k = o.k and c.rn = o.rn)"""


def outcome_sql() -> str:
    return """
outc as (select *,
  case when not allowed then 'blocked_cooldown' when not live then 'dry_run' else 'executed' end as status,
  case when not allowed then printf('Action blocked by cooldown (cooldown: %ds)', cd_s)
       when not live then 'Automated actions disabled (dry-run mode)'
       when action_type = 'lock_account' then printf('Account %s locked (simulated)', target)
       when action_type = 'block_ip' then printf('IP %s blocked (simulated)', target)
       when action_type = 'terminate_session' then printf('Sessions for %s terminated (simulated)', target)
       else 'Alert: ' || reason end as result_message,
  case when allowed and live then
    case action_type when 'lock_account' then 'usermod -U ' || target
                     when 'block_ip' then 'iptables -D INPUT -s ' || target || ' -j DROP' end end as reversal_command
  from cooled)"""


def incident_id_sql() -> str:
    return ("'INC-' || strftime(ts, '%Y%m%d') || '-' || "
            "lpad(cast(row_number() over (partition by cast(ts as date) order by ts, event_id) as varchar), 6, '0')")


def forest_sql(fsql: str, p) -> str:
    """CTEs that restate the forest over feature rows: ``z`` (scaled features), ``nodes``,
    ``scores`` (event_id, raw) and ``cut`` (the contamination offset). Trees grow level by
    level: each level's rows, their ranges by node, the drawn split, and the next level."""
    names = list(K.FEATURE_NAMES)
    k = len(names)

    def draw(*parts: str) -> str:
        return f"(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 13))::bigint / 4503599627370496.0::double)"

    zs = ", ".join(f"({n}::double - avg({n}::double) over ()) / case when stddev_pop({n}::double) over () = 0 then 1.0 "
                   f"else stddev_pop({n}::double) over () end as z{i}" for i, n in enumerate(names))
    cols = ", ".join(f"z{i}" for i in range(k))
    out = f"""f as materialized ({fsql}), z as materialized (select event_id, {zs} from f),
size as (select count(*) as n_rows, least({p.max_samples}, count(*)) as psi, least(1.0::double, 1.5::double * least({p.max_samples}, count(*)) / count(*)) as per_tree from z),
rate as materialized (select *, least(1.0::double, per_tree * {p.n_trees}) as q, greatest(1, ceil(log2(greatest(psi, 2))))::int as deep from size),
near as (select z.*, r.* from z, rate r where r.q >= 1 or {draw(f"'{p.seed}'", 'event_id')} < r.q),
drawn as (select t.tree, x.* from near x, range(0, {p.n_trees}) t(tree) where {draw(f"'{p.seed}'", 't.tree', 'event_id')} < per_tree / q),
s0 as materialized (select tree, event_id, 1 as node, {cols} from drawn
  qualify row_number() over (partition by tree order by {draw(f"'{p.seed + 1}'", 'tree', 'event_id')}, event_id) <= psi)"""
    depth = max(1, (max(p.max_samples, 2) - 1).bit_length())
    feature = "case i " + " ".join(f"when {i} then z{i}" for i in range(k)) + " end"
    for d in range(depth + 1):
        out += f""",
b{d} as (select tree, node, i, min({feature}) as lo, max({feature}) as hi, count(*) as n from s{d}, range(0, {k}) r(i) group by tree, node, i),
c{d} as (select tree, node, i, lo, hi from b{d}, rate where n > 1 and hi > lo and {d} < deep
  qualify row_number() over (partition by tree, node order by {draw(f"'{p.seed}'", 'tree', 'node', 'i')}, i) = 1),
n{d} as materialized (select g.tree, g.node, coalesce(c.i, -1) as feature,
  coalesce(c.lo + {draw(f"'{p.seed}'", 'g.tree', 'g.node')} * (c.hi - c.lo), 0.0) as threshold, {d} as depth, g.n
  from (select tree, node, max(n) as n from b{d} group by tree, node) g left join c{d} c using (tree, node)),
s{d + 1} as materialized (select s.tree, s.event_id, 2 * s.node + case when case n.feature {" ".join(f"when {i} then z{i}" for i in range(k))} end <= n.threshold then 0 else 1 end as node, {cols}
  from s{d} s join n{d} n using (tree, node) where n.feature >= 0)"""
    out += ",\nnodes as materialized (" + " union all ".join(f"select * from n{d}" for d in range(depth + 1)) + ")"
    out += f""",
p0 as (select z.event_id, t.tree, 1 as node, 0 as steps, {cols} from z, range(0, {p.n_trees}) t(tree))"""
    # every row falls through every tree; leaves stay where they are
    for d in range(depth):
        out += f""",
p{d + 1} as (select p.event_id, p.tree, case when n.feature < 0 then p.node else 2 * p.node +
  case when case n.feature {" ".join(f"when {i} then z{i}" for i in range(k))} end <= n.threshold then 0 else 1 end end as node, p.steps, {cols}
  from p{d} p join nodes n on n.tree = p.tree and n.node = p.node)"""
    path = "case when {0} > 2 then 2.0 * (ln({0} - 1.0) + 0.5772156649) - 2.0 * ({0} - 1.0) / {0} when {0} = 2 then 1.0 else 0.0 end"
    out += f""",
scores as materialized (select p.event_id, -pow(2.0, -(list_sum(list(n.depth + {path.format('n.n')} order by p.tree)) / {p.n_trees})
    / (select {path.format('psi')} from rate)) as raw
  from p{depth} p join nodes n on n.tree = p.tree and n.node = p.node group by p.event_id),
cut as (select quantile_cont(raw, {p.contamination}) as cut_at from scores)"""
    return out

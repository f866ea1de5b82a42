"""The same results in plain SQL over the given tables, for DuckDB.

Each text starts from the fixture views and states what the query means, with none of the
engine-side rewrites: joins are joins, positions are row numbers over the whole table.
"""

from __future__ import annotations

from hostwin.operators.text import SPACES
from hostwin.schemas import KEPT_DAYS, NULL_TOKENS, TEST_DAYS, TRAIN_DAYS
from hostwin.sources.fixtures import duckdb_ctes

SIX_HOURS = 21_600


def _days(days) -> str:
    return "(" + ", ".join(map(str, days)) + ")"


def _with(views: list[str], *ctes: str) -> str:
    return "with " + ",\n".join([duckdb_ctes(views), *ctes]) + "\n"


def _keyed(kind: str, width: int) -> str:
    """Usable rows of a log with day and win; '?' is missing."""
    host = "computer" if kind == "proc" else "src_comp"
    return f"""{kind}_rows as (select * exclude (src_comp), h as src_comp, t // 86400 as day,
 (t // {width}) * {width} as win
 from (select *, {"h as src_comp," if kind == "proc" else ""} from (
  select *, nullif({host}, '?') as h, try_cast(nullif(time, '?') as bigint) as t from {kind}))
 where t is not null and h is not null)"""


def _count(condition: str, name: str) -> str:
    return f"count(*) filter (where {condition}) as {name}"


def _auth(width: int) -> str:
    kinds = {"interactive": "Interactive", "remote": "RemoteInteractive", "service": "Service",
             "batch": "Batch", "network": "Network", "unlock": "Unlock"}
    counters = ",\n ".join(
        _count(f"logon_type = '{v}'", f"auth_{n}") for n, v in kinds.items())
    known = ", ".join(f"'{v}'" for v in kinds.values())
    return f"""{_keyed("auth", width)},
auth_f as (select *, auth_failure / auth_total as auth_fail_rate from (
 select src_comp, day, win, count(*) as auth_total,
 {_count("result = 'Success'", "auth_success")}, {_count("result = 'Failure'", "auth_failure")},
 {counters}, {_count(f"logon_type <> '?' and logon_type not in ({known})", "auth_other")}
 from auth_rows group by 1, 2, 3))"""


def _proc(width: int) -> str:
    return f"""{_keyed("proc", width)},
proc_f as (select *, proc_events - proc_service_events as proc_user_events from (
 select src_comp, day, win, count(*) as proc_events,
 {_count("event = 'Start'", "proc_start")}, {_count("event = 'End'", "proc_end")},
 {_count("contains(user, '$@')", "proc_service_events")}
 from proc_rows group by 1, 2, 3))""".replace("contains(user,", 'contains("user",')


def _flows(width: int) -> str:
    def total(c: str, name: str) -> str:
        return f"coalesce(sum(try_cast({c} as double)), 0.0) as {name}"

    port = "try_cast(dst_port as double)"
    return f"""{_keyed("flows", width)},
flows_f as (select *, flows_bytes / flows_count as bytes_per_flow,
 flows_packets / flows_count as packets_per_flow, tcp_flows / flows_count as tcp_fraction,
 wellknown_dst_flows / flows_count as wellknown_fraction from (
 select src_comp, day, win, count(*) as flows_count, {total("bytes", "flows_bytes")},
 {total("packets", "flows_packets")}, {total("duration", "flows_duration_sum")},
 {_count("protocol = '6'", "tcp_flows")}, {_count("protocol = '17'", "udp_flows")},
 {_count(port + " <= 1024", "wellknown_dst_flows")}, {_count(port + " = 80", "http80_flows")},
 {_count(port + " = 443", "https443_flows")}
 from flows_rows group by 1, 2, 3))"""


def _dns(width: int) -> str:
    return f"""{_keyed("dns", width)},
dns_f as (select src_comp, day, win, count(*) as dns_queries, count(distinct resolved) as
 dns_distinct from dns_rows group by 1, 2, 3)"""


def _bad(width: int) -> str:
    return f"""bad as (select distinct unnest([src_comp, dst_comp]) as src_comp, t // 86400 as day,
 (t // {width}) * {width} as win, cast(1 as int) as label
 from (select *, try_cast(time as bigint) as t from redteam)
 where t is not null and src_comp <> '?' and dst_comp <> '?')"""


_LOGS = ["auth", "proc", "flows", "dns", "redteam"]
_KEYS = "src_comp, day, win"
_EDR = """src_comp, day, win, auth_total, auth_success, auth_failure, auth_interactive, auth_remote,
 auth_service, auth_batch, auth_network, auth_unlock, auth_other, auth_fail_rate, proc_events,
 proc_start, proc_end, proc_service_events, proc_user_events"""
_NET = """flows_count, flows_bytes, flows_packets, flows_duration_sum, tcp_flows, udp_flows,
 wellknown_dst_flows, http80_flows, https443_flows, bytes_per_flow, packets_per_flow,
 tcp_fraction, wellknown_fraction, dns_queries"""


def _zero(names: str) -> str:
    return ", ".join(f"coalesce({n.strip()}, 0) as {n.strip()}" for n in names.split(","))


def _master(width: int, how: str = "left") -> list[str]:
    features = _EDR.split("win,")[1]
    return [_auth(width), _proc(width), _flows(width), _dns(width), _bad(width), f"""
xdr as (select {_KEYS}, {_zero(features)}, {_zero(_NET)}, coalesce(label, 0) as label
 from auth_f full join proc_f using ({_KEYS}) {how} join flows_f using ({_KEYS})
 {how} join dns_f using ({_KEYS}) left join bad using ({_KEYS})),
edr as (select {_EDR}, label from xdr)"""]


def _on_master(width: int, body: str, *ctes: str) -> str:
    return _with(_LOGS, *_master(width), *ctes) + body


_INDEXED = f"""indexed as (select row_number() over (order by day, win, src_comp) - 1 as idx, *
 from edr where day in {_days(KEPT_DAYS)})"""


def _hash(*parts: str) -> str:
    text = " || ':' || ".join(f"cast({p} as varchar)" for p in parts)
    return f"cast(('0x' || substr(md5({text}), 1, 13)) as bigint)"


def _sizes(lo: int, hi: int, seed: int) -> str:
    n = hi - lo + 1
    return f"""sizes as (select idx as event,
 {lo} + {_hash(seed, "'size'", "'before'", "idx")} % {n} as k_before,
 {lo} + {_hash(seed, "'size'", "'after'", "idx")} % {n} as k_after
 from indexed where label = 1)"""


def _candidates(window: int) -> str:
    return f"""cands as (select p.idx as event, n.idx as cand,
 case when n.idx < p.idx then 'before' else 'after' end as side
 from indexed p join indexed n on n.idx between p.idx - {window} and p.idx + {window}
 where p.label = 1 and n.label = 0)"""


def _kept(lo: int, hi: int, window: int, seed: int) -> list[str]:
    key = f"cast({seed} as varchar) || ':' || side || ':' || event || ':' || cand"
    return [_INDEXED, _sizes(lo, hi, seed), _candidates(window), f"""
ranked as (select *, row_number() over (partition by event, side order by md5({key}), cand) as r
 from cands),
kept as (select idx from indexed where label = 1 union
 select cand from ranked join sizes using (event)
 where r <= case side when 'before' then k_before else k_after end)"""]


_NUMERIC = """num as (select event_id as row_id, cast(case when k < 7 then 1 else 0 end as int) as label,
 floor(value * 100) as x, cast(k as double) as z, cast(floor(t / 3600) as double) as hour from b)"""

# Metrics of a confusion table (model, y, pred, n)
_CELLS = "conf as (select model, y, pred, count(*) as n from {0} group by 1, 2, 3)"
_CLASSES = """cls as (select model, class, sum(hit) as hit, sum(support) as support,
 sum(guessed) as guessed from (
 select model, y as class, case when y = pred then n else 0 end as hit, n as support,
 0 as guessed from conf
 union all select model, pred, 0, 0, n from conf) group by 1, 2),
per as (select model, class, support, hit,
 case when guessed > 0 then hit / guessed else 0 end as precision,
 case when support > 0 then hit / support else 0 end as recall from cls),
perf as (select *, case when precision + recall > 0
 then 2 * precision * recall / (precision + recall) else 0 end as f1 from per)"""
_BINARY = """bin as (select *, case when precision + recall > 0
 then 2 * precision * recall / (precision + recall) else 0.0 end as f1 from (
 select model, sum(n) filter (where y = pred) / sum(n) as accuracy,
 coalesce(sum(n) filter (where y = 1 and pred = 1) / nullif(sum(n) filter (where pred = 1), 0), 0)
  as precision,
 coalesce(sum(n) filter (where y = 1 and pred = 1) / nullif(sum(n) filter (where y = 1), 0), 0)
  as recall from conf group by 1))"""
_ERRORS = """err as (select *, 100.0 * fp / (fp + tn) as fp_rate, 100.0 * fn / (fn + tp) as miss_rate
 from (select model, cast(sum(n) filter (where y = 0 and pred = 0) as bigint) as tn,
 cast(sum(n) filter (where y = 0 and pred = 1) as bigint) as fp,
 cast(sum(n) filter (where y = 1 and pred = 0) as bigint) as fn,
 cast(sum(n) filter (where y = 1 and pred = 1) as bigint) as tp from conf group by 1))"""
_RANKED = """sc as (select model, score, sum(y) as pos, sum(1 - y) as neg from scored
 where score is not null group by 1, 2),
rk as (select *, sum(pos) over w as pc, sum(neg) over w as nc, sum(pos) over v as pt,
 sum(neg) over v as nt from sc
 window w as (partition by model order by score desc), v as (partition by model))"""
_AREAS = """areas as (select model, sum(neg * (pc - pos + pos / 2)) / any_value(pt * nt) as roc_auc,
 sum(pos * pc / (pc + nc)) / any_value(pt) as pr_auc from rk group by 1)"""
_BALACC = """bal as (select model, avg(recall) as balanced_accuracy from per where support > 0
 group by 1)"""
_COMPARE = """cmp as (select model, accuracy, balanced_accuracy, precision, recall, f1, roc_auc,
 pr_auc from bin join bal using (model) left join areas using (model))"""
_TUNE_MAX = """tune as (select *, coalesce(share_positive < 0.9, false) as threshold_tuned from (
 select model, max(score) filter (where pc / pt >= 0.8) as threshold,
 min(pc + nc) filter (where pc / pt >= 0.8) / any_value(pt + nt) as share_positive
 from rk group by 1))"""
_SCORED = [_CELLS.format("scored")]


def _six(views: list[str], ctes: list[str], source: str, *doubles: str, columns: str = "*",
         tail: str = "") -> str:
    """Everything from ``source``, with the given DOUBLE columns rounded to six digits."""
    each = ", ".join(f"round(cast({n} as double), 6) as {n}" for n in doubles)
    replaced = f" replace ({each})" if doubles else ""
    return _with(views, *ctes) + f"select *{replaced} from (select {columns} from {source} {tail})"


_RATIOS = ["bytes_per_flow", "packets_per_flow", "tcp_fraction", "wellknown_fraction"]
_MASTER_DOUBLES = ["auth_fail_rate", *_RATIOS, "flows_bytes", "flows_packets",
                   "flows_duration_sum"]
_WORDS = f"[w for w in regexp_split_to_array(text, '{SPACES}') if w <> '']"
_PAIRS = f"""w as (select doc_id, {_WORDS} as l from documents),
pairs as (select doc_id, i - 1 as pos, l[i] as word, l[i + 1] as next
 from (select doc_id, l, unnest(range(1, len(l))) as i from w))"""
_TOKEN_LIST = ", ".join(f"'{t}'" for t in NULL_TOKENS)
_CLEAN_X = "case when isfinite(x) then x end"
_SIDES = f"""d as (select * replace ({_CLEAN_X} as x), case when day < 21 then 'train'
 else 'test' end as split from dirty)"""


def _bag_weight(rate: str) -> str:
    """Inverse Poisson distribution function at u, as a sum of steps."""
    steps, factorial = [], 1
    for i in range(30):
        factorial *= max(i, 1)
        steps.append(f"power({rate}, {i}) / {factorial}.0")
    sums = [" + ".join(steps[:i + 1]) for i in range(18)]
    return " + ".join(f"case when u >= exp(-({rate})) * ({s}) then 1 else 0 end" for s in sums)


def oracle_sql() -> dict[str, str]:
    """Name of query -> DuckDB SQL."""
    x300 = [*_master(300)]
    x6h = [*_master(SIX_HOURS)]
    edr_all, xdr_all = f"{_EDR}, label", f"{_EDR}, {_NET}, label"
    out: dict[str, str] = {}

    out["scan_null_tokens"] = _with(["coerce_raw"]) + f"""select event_id,
 case when time not in ({_TOKEN_LIST}) then time end as time,
 case when n = floor(n) then cast(n as bigint) end as as_int, n as as_num,
 cast(floor(n) as bigint) as as_floor
 from (select *, try_cast(time as double) as n from coerce_raw)"""
    out["window_day"] = _with(["coerce_raw"]) + """select event_id, cast(n as bigint) as t,
 cast(floor(n / 300) * 300 as bigint) as win, cast(floor(n / 86400) as bigint) as day
 from (select *, try_cast(time as double) as n from coerce_raw) where n = floor(n)"""
    out["unparseable_days"] = _with(["coerce_raw"]) + """select event_id,
 cast(trim(time) as bigint) as day from coerce_raw
 where regexp_full_match(trim(time), '[+-]?[0-9]+')"""
    out["clean_infinities"] = _with(["dirty"]) + f"""select * replace (round({_CLEAN_X}, 6) as x)
 from dirty"""
    out["threshold_classes"] = _with(["scored"]) + """select model, row_id,
 cast(score >= 0.5 as int) as pred from scored where score is not null"""
    out["outlier_labels"] = _with([]) + """select event_id,
 cast(case when k < 7 then 1 else 0 end as int) as label from b"""
    out["whole_text"] = f"""select word, count(*) as n
 from (select unnest({_WORDS}) as word from documents) group by 1"""

    for width, tag in ((300, ""), (SIX_HOURS, "_6h")):
        out[f"auth_features{tag}"] = _six(["auth"], [_auth(width)], "auth_f", "auth_fail_rate")
        out[f"proc_features{tag}"] = _six(["proc"], [_proc(width)], "proc_f")
        out[f"flow_features{tag}"] = _six(
            ["flows"], [_flows(width)], "flows_f", *_MASTER_DOUBLES[1:])
    out["dns_features"] = _six(["dns"], [_dns(300)], "dns_f", columns=f"{_KEYS}, dns_queries")
    out["dns_distinct_6h"] = _six(["dns"], [_dns(SIX_HOURS)], "dns_f")
    out["merge_partials"] = out["auth_features_6h"]
    out["dns_distinct_merged"] = out["dns_distinct_6h"]
    out["csv_log_scan"] = out["auth_features"]
    out["stream_auth_features"] = out["auth_features"]
    out["redteam_keys"] = _six(["redteam"], [_bad(300)], "bad")

    out["edr_master"] = _six(_LOGS, x300, "edr", "auth_fail_rate")
    out["xdr_master"] = _six(_LOGS, x300, "xdr", *_MASTER_DOUBLES, columns=xdr_all)
    out["xdr_master_6h"] = _six(_LOGS, x6h, "xdr", *_MASTER_DOUBLES, columns=xdr_all)
    out["xdr_network_only"] = _six(_LOGS, _master(300, "full"), "xdr", *_MASTER_DOUBLES,
                                   columns=xdr_all)
    out["edr_join"] = _six(_LOGS, x6h, "edr", "auth_fail_rate", columns=edr_all)
    for name in ("xdr_join", "csv_master", "csv_round_trip"):
        out[name] = out["xdr_master_6h"]
    for name, how in (("semi_keys", "semi"), ("anti_keys", "anti")):
        out[name] = _six(["auth", "flows"], [_auth(300), _flows(300)], "auth_f", "auth_fail_rate",
                         tail=f"{how} join flows_f using ({_KEYS})")
    summary = """select '{0}' as dataset, count(*) as n_rows, cast(sum(label) as bigint) as malicious,
 count(distinct day) as days, max(day) as last_day from {1}"""
    out["dataset_summary"] = (
        _with(_LOGS, *x300, "e as materialized (" + summary.format("EDR", "edr") + ")")
        + "select * from e union all select * from ("
        + _with(_LOGS, *x6h) + summary.format("XDR", "xdr") + ")")

    out["column_subset"] = _six(_LOGS, x300, "xdr", columns="src_comp, win, label")
    out["append_partials"] = _six(_LOGS, x6h, "edr", columns=f"{_KEYS}, auth_total, label")
    out["repeated_days"] = out["append_partials"]
    out["typed_csv"] = _with([]) + """select event_id, cast(k as bigint) as Class, round(value, 6) as value, host,
 case when k > 5 then k > 50 end as high, case when k < 9 then 'x' else cast(k as varchar) end as mixed,
 cast(dense_rank() over (order by k) - 1 as int) as y,
 'event_id bigint, Class bigint, value double, host string, high boolean, mixed string' as kinds from b"""
    out["class_probabilities_auc"] = _with([]) + """,
s as (select event_id, cast(k % 3 as int) as y, c, ((k + 37 * c + (event_id * 7919) % 20) % 100)::double / 100 as score
 from b, range(3) g(c)),
n as (select c, score, count(*) filter (where y = c) as pos, count(*) filter (where y <> c) as neg from s group by 1, 2),
a as (select c, sum(p.pos * (p.below + p.neg / 2.0)) / (sum(p.pos) * sum(p.neg)) as area, sum(p.pos) as support from (
 select *, coalesce(sum(neg) over (partition by c order by score rows between unbounded preceding and 1 preceding), 0) as below
 from n) p group by c)
select 'tri' as model, round(sum(area * support) / sum(support), 6) as roc_auc from a"""
    out["train_three_classes"] = _with([]) + """,
t as (select count(*) as n from b where floor(t / 86400) >= 21)
select m as model, n as n_rows, 3::bigint as answers, 0::bigint as odd_sums,
 case when m = 'SGD SVM' then 0 else n end::bigint as with_scores, true as informed, m <> 'SGD SVM' as with_area
from t, (select unnest(['Logistic Regression', 'Random Forest (SMOTE)', 'LightGBM', 'Balanced RF', 'SGD SVM']) as m) x"""
    out["sorted_files"] = _six(_LOGS, x300, "edr", columns=f"{_KEYS}, auth_total")
    out["sorted_filtered"] = _six(_LOGS, [*x300, _INDEXED], "indexed", "auth_fail_rate")
    last = """case when day > (select max(day) from edr) - 7 then 'test' else 'train' end as split"""
    fixed = f"""case when day in {_days(TRAIN_DAYS)} then 'train'
 when day in {_days(TEST_DAYS)} then 'test' end as split"""
    out["split_last_days"] = _six(_LOGS, x300, "edr", columns=f"{_KEYS}, label, {last}")
    out["split_fixed_days"] = _six(
        _LOGS, x300, "xdr", columns=f"{_KEYS}, dns_queries, label, {fixed}",
        tail=f"where day in {_days(KEPT_DAYS)}")
    out["split_round_trip"] = _six(
        _LOGS, x300, "edr", columns=f"{_KEYS}, label, {fixed}",
        tail=f"where day in {_days(KEPT_DAYS)}")
    sides = f"(select *, {last} from {{0}})"
    per_side = """select split, '{0}' as dataset, count(*) as n_rows,
 cast(sum(label) as bigint) as malicious{1} from {2} group by 1"""
    span = ", min(day) as first_day, max(day) as last_day"
    out["split_and_save"] = _on_master(
        SIX_HOURS, per_side.format("EDR", span, sides.format("edr")) + " union all "
        + per_side.format("XDR", span, sides.format("xdr")))

    out["context_candidates"] = _on_master(
        300, "select event, cand, side from cands", _INDEXED, _candidates(150))
    out["draw_sizes"] = _on_master(300, "select * from sizes", _INDEXED, _sizes(75, 150, 0))
    kept = _kept(75, 150, 150, 0)
    out["context_balance_edr"] = _six(
        _LOGS, [*x300, *kept], "indexed", "auth_fail_rate", tail="semi join kept using (idx)")
    chosen = f"chosen as (select {_KEYS} from indexed join kept using (idx))"
    out["context_balance_xdr"] = _six(
        _LOGS, [*x300, *kept, chosen], "xdr", *_MASTER_DOUBLES, columns=xdr_all, tail=f"join chosen using ({_KEYS})")
    out["slice_like"] = _six(
        _LOGS, [*x300, *_kept(5, 10, 20, 7), chosen], "xdr", columns=f"{_KEYS}, flows_count, label",
        tail=f"join chosen using ({_KEYS})")
    out["context_balance_tight"] = _six(
        _LOGS, [*x300, *_kept(5, 10, 20, 7)], "indexed", columns=f"idx, {_KEYS}, label",
        tail="semi join kept using (idx)")
    out["study_splits"] = _on_master(
        300, per_side.format("EDR", "", "chosen") + " union all "
        + per_side.format("XDR", "", "chosen"), *_kept(5, 20, 20, 0),
        f"chosen as (select *, {fixed} from indexed semi join kept using (idx))")

    out["smote_rows"] = out["smote_blocks"] = _with(
        [], _NUMERIC, """mins as (select *, row_number() over (order by row_id) - 1 as id
 from num where label = 1),
size as (select count(*) filter (where label = 1) as m, count(*) filter (where label = 0) as j
 from num),
near as (select a.id, a.x, a.z, a.hour, n.x as x2, n.z as z2, n.hour as hour2, row_number() over (
  partition by a.id order by (a.x - n.x) * (a.x - n.x) + (a.z - n.z) * (a.z - n.z)
  + (a.hour - n.hour) * (a.hour - n.hour), n.id) as r
 from mins a join mins n on a.id <> n.id),
s as (select s from size, range(cast(floor(0.5 * j) as bigint) - m) g(s)),""" + f"""
draws as (select s, {_hash(42, "'base'", "s")} % m as id, {_hash(42, "'near'", "s")} % 5 + 1 as r,
 {_hash(42, "'part'", "s")} / 4503599627370496.0::double as u from s, size)""") + """
select s, cast(1 as int) as label, round(x + u * (x2 - x), 6) as x, round(z + u * (z2 - z), 6) as z,
 round(hour + u * (hour2 - hour), 6) as hour from draws join near using (id, r)"""
    out["balanced_bags"] = _with([], _NUMERIC, f"""rates as (select
 sum(label) / 0.5 / sum(1 - label) as high from num),
draws as (select row_id, label, bag, high,
 {_hash(42, "bag", "row_id")} / 4503599627370496.0::double as u
 from num, rates, (select unnest(range(4)) as bag))""") + f"""
select row_id, label, cast(bag as int) as bag, cast(weight as int) as weight from (
 select *, case when label = 0 then {_bag_weight("high")} else {_bag_weight("1.0")} end as weight
 from draws) where weight > 0"""

    out["prepare_train_test"] = _with(
        ["dirty"], _SIDES, """med as (select median(x) as mx, median(z) as mz from d
 where split = 'train'),
f as (select row_id, label, split, coalesce(x, mx) as x, z, case split when 'train' then konst
 else 0 end as konst, day from d, med),
st as (select avg(x) as ax, stddev_pop(x) as sx, avg(z) as az, stddev_pop(z) as sz,
 avg(day) as ad, stddev_pop(day) as sd from f where split = 'train')""") + """
select row_id, round((x - ax) / sx, 6) as x, round((z - az) / sz, 6) as z,
 cast(konst - 5 as double) as konst, round((day - ad) / sd, 6) as day, label as y, split from f, st"""
    quant = """select '{0}' as feature, round(quantile_cont({0}, {1}), 6) as quantile from d
 where split = 'train'"""
    out["column_medians"] = _with(["dirty"], _SIDES) + " union all ".join(
        quant.format(c, 0.5) for c in ("x", "z", "konst", "cast(day as double)")).replace(
        "'cast(day as double)'", "'day'")
    out["medians_of_increments"] = out["column_medians"]
    out["column_quantiles"] = _with(["dirty"], _SIDES) + " union all ".join(
        quant.format(c, 0.93) for c in ("x", "z"))
    out["encode_labels"] = """select event_id, event_type,
 cast(dense_rank() over (order by event_type) - 1 as int) as y from events"""
    out["align_columns"] = _with(["dirty"]) + """select row_id, z, cast(0 as int) as absent, day
 from dirty where day >= 21"""
    out["class_balance"] = _with(["dirty"]) + """select label as class, n,
 round(min(n) over () / max(n) over () * 100, 6) as balance_pct,
 min(n) over () / max(n) over () < 0.01 as extreme_imbalance
 from (select label, count(*) as n from dirty group by 1)"""
    out["overview"] = _with(["dirty"]) + """select case when day < 21 then 'train' else 'test' end
 as split, count(*) as n_rows, cast(6 as int) as n_columns, cast(5 as int) as n_features,
 count(*) filter (where x is null or isnan(x)) as missing from dirty group by 1"""
    out["class_weights"] = _with(["dirty"]) + """select n, p as positives,
 round(p / n, 6) as contamination, round((n - p) / p, 6) as pos_weight,
 round(n / (2 * (n - p)), 6) as weight_0, round(n / (2 * p), 6) as weight_1
 from (select count(*) as n, cast(sum(label) as bigint) as p from dirty where day < 21)"""
    out["baseline_accuracy"] = _with(["dirty"], """top as (select label from dirty where day < 21
 group by 1 order by count(*) desc, label limit 1)""") + """
select any_value(top.label) as majority,
 round(avg(case when dirty.label = top.label then 1.0 else 0.0 end), 6) as accuracy
 from dirty, top where day >= 21"""

    out["confusion"] = _six(["scored"], _SCORED, "conf")
    out["confusion_pct"] = _six(
        ["scored"], _SCORED, "conf", "pct",
        columns="*, 100.0 * n / sum(n) over (partition by model, y) as pct")
    out["error_rates"] = _six(["scored"], [*_SCORED, _ERRORS], "err", "fp_rate", "miss_rate")
    out["confusion_multi"] = _with(["scored3"]) + """select distinct model, cast(null as bigint) as tn,
 cast(null as bigint) as fp, cast(null as bigint) as fn, cast(null as bigint) as tp,
 0.0::double as fp_rate, 0.0::double as miss_rate from scored3"""
    out["binary_metrics"] = _six(["scored"], [*_SCORED, _BINARY], "bin", "accuracy", "precision",
                                 "recall", "f1")
    tri = [_CELLS.format("scored3"), _CLASSES]
    weighted = ", ".join(f"sum({c} * support) / sum(support) as {c}"
                         for c in ("precision", "recall", "f1"))
    out["weighted_metrics"] = _six(["scored3"], tri, "perf", "precision", "recall", "f1",
                                   columns=f"model, {weighted}", tail="group by 1")
    out["balanced_accuracy"] = _six(
        ["scored", "scored3"],
        ["every as (select model, y, pred from scored union all select model, y, pred from scored3)",
         _CELLS.format("every"), _CLASSES, _BALACC], "bal", "balanced_accuracy")
    out["class_report"] = _six(["scored3"], [*tri, """rep as (
 select model, cast(class as varchar) as class, precision, recall, f1,
 cast(support as bigint) as support from perf
 union all select model, 'accuracy', null, null, sum(hit) / sum(support),
 cast(sum(support) as bigint) from perf group by model)"""], "rep", "precision", "recall", "f1")

    ranked = [_RANKED]
    out["roc_auc"] = _six(["scored"], [_RANKED, _AREAS], "areas", "roc_auc",
                          columns="model, roc_auc")
    out["average_precision"] = _six(["scored"], [_RANKED, _AREAS], "areas", "pr_auc",
                                    columns="model, pr_auc")
    out["roc_auc_ovr"] = _with(["scored3"], """ovr as (select model, c,
 case when y = c then 1 else 0 end as y, case when pred = c then 1 else 0 end as score
 from scored3, (select unnest([0, 1, 2]) as c)),
auc as (select model, c, (count(*) filter (where y = 1 and score = 1)
  * count(*) filter (where y = 0 and score = 0)
  + 0.5 * count(*) filter (where y = 1 and score = 1) * count(*) filter (where y = 0 and score = 1)
  + 0.5 * count(*) filter (where y = 1 and score = 0) * count(*) filter (where y = 0 and score = 0))
  / (sum(y) * sum(1 - y)) as a, sum(y) as s from ovr group by 1, 2)""") + """
select model, round(sum(a * s) / sum(s), 6) as roc_auc from auc group by 1"""
    hits = _with(["scored3"]) + """select model, round(avg(case when y = pred then 1.0 else 0.0 end), 6)
 as accuracy from scored3 group by 1"""
    out["compare_classes"] = f"""with w as ({out["weighted_metrics"]}), a as ({out["roc_auc_ovr"]}),
ba as ({out["balanced_accuracy"]}), h as ({hits})
select model, accuracy, balanced_accuracy, precision, recall, f1, roc_auc, null::double as pr_auc
 from w join a using (model) join ba using (model) join h using (model)"""
    roc = """roc as (select model, score as threshold, nc / nt as fpr, pc / pt as tpr,
 row_number() over (partition by model order by score desc) as i,
 lead(pos) over (partition by model order by score desc) as np,
 lead(neg) over (partition by model order by score desc) as nn, pos, neg from rk)"""
    origin = "select distinct model, cast(null as double) as threshold, {0} from rk"
    points = "select model, threshold, fpr, tpr from roc"
    out["roc_curve_full"] = _six(["scored"], [*ranked, roc], f"({points} union all "
                                 + origin.format("0 as fpr, 0 as tpr") + ")", "threshold", "fpr",
                                 "tpr")
    out["roc_curve"] = _six(
        ["scored"], [*ranked, roc], f"({points} where i = 1 or np is null or np <> pos or nn <> neg"
        " union all " + origin.format("0 as fpr, 0 as tpr") + ")", "threshold", "fpr", "tpr")
    out["pr_curve"] = _six(
        ["scored"], ranked, """(select model, score as threshold, pc / (pc + nc) as precision,
 pc / pt as recall from rk union all """ + origin.format("1 as precision, 0 as recall") + ")",
        "threshold", "precision", "recall")
    out["threshold_sweep"] = _with(["scored"], """grid as (select i * 0.01::double as threshold
 from range(101) g(i)),
sw as (select model, threshold, count(*) filter (where y = 1 and score >= threshold) as tp,
 count(*) filter (where y = 0 and score >= threshold) as fp, sum(y) as p
 from scored, grid where score is not null group by 1, 2),
pr as (select model, threshold, coalesce(tp / nullif(tp + fp, 0), 0) as precision, tp / p as recall
 from sw)""") + """select model, round(threshold, 6) as threshold,
 round(cast(precision as double), 6) as precision, round(recall, 6) as recall,
 round(cast(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as double), 6) as f1
 from pr"""
    out["score_histogram"] = _with(["scored"], """span as (select model, min(score) as a,
 max(score) as b, count(*) as total from scored where score is not null group by 1),
edges as (select model, cast(i as int) as bin, total, a + i * ((b - a) / 30) as lo,
 case when i = 29 then b else a + (i + 1) * ((b - a) / 30) end as hi
 from span, range(30) g(i)),
hist as (select e.model, bin, lo, hi, total, count(score) as n from edges e left join scored s
 on s.model = e.model and score >= lo and (score < hi or (bin = 29 and score <= hi))
 group by 1, 2, 3, 4, 5)""") + """select model, bin, round(lo, 6) as lo, round(hi, 6) as hi, n,
 round(n / (total * (hi - lo)), 6) as density from hist"""
    out["percent_positive"] = _with(["scored"]) + """select model,
 round(avg(case when score >= 0.25 then 1.0 else 0.0 end), 6) as share_positive
 from scored where score is not null group by 1"""
    out["tune_threshold_first"] = _six(["scored"], [*ranked, """first as (select *,
 coalesce(share_positive < 0.9, false) as threshold_tuned from (select model,
 min(score) filter (where (pc - pos) / pt >= 0.8) as threshold,
 max(pc + nc) filter (where (pc - pos) / pt >= 0.8) / any_value(pt + nt) as share_positive
 from rk group by 1))"""], "first", "threshold", "share_positive")
    out["tune_threshold_max"] = _six(["scored"], [*ranked, _TUNE_MAX], "tune", "threshold",
                                     "share_positive")
    final = """final as (select model, y, case when coalesce(threshold_tuned, false)
 then cast(score >= threshold as int) else pred end as pred
 from scored left join tune using (model))"""
    out["tuned_predictions"] = _six(
        ["scored"], [*ranked, _TUNE_MAX, final, _CELLS.format("final")], "conf")
    compared = [*_SCORED, _CLASSES, _BINARY, _BALACC, _RANKED, _AREAS, _COMPARE]
    metrics = ["accuracy", "balanced_accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc"]
    out["compare"] = _six(["scored"], compared, "cmp", *metrics)
    out["compare_rounded"] = _with(["scored"], *compared) + "select model, " + ", ".join(
        f"round(cast({m} as double), 4) as {m}" for m in metrics) + " from cmp"
    long = " union all ".join(
        [f"select '{m}' as metric, model, {m} as score, {m} as v from cmp" for m in metrics]
        + [f"select '{m}', model, {m}, -{m} from err" for m in ("fp_rate", "miss_rate")])
    out["best_models"] = _six(["scored"], [*compared, _ERRORS, f"every as ({long})", """
top as (select *, row_number() over (partition by metric order by v desc,
 list_position(['noise', 'blend', 'no_score'], model)) as r from every where score is not null)"""],
        "top", "score", columns="metric, model, score", tail="where r = 1")

    sections = {
        "comparison": "select model, 1 as n from cmp", "errors": "select model, 1 as n from cmp",
        "tuning": "select model, 1 as n from tune",
        "confusion": "select model, count(*) as n from (select distinct model, y, pred from final)"
                     " group by 1",
        "class_report": "select model, 3 as n from cmp",
        "roc_curve": "select model, count(*) + 1 as n from roc where i = 1 or np is null or np <> pos"
                     " or nn <> neg group by 1",
        "pr_curve": "select model, count(*) + 1 as n from rk group by 1",
        "threshold_sweep": "select model, 101 as n from tune",
        "score_histogram": "select model, 30 as n from tune",
    }
    sections["best_models"] = "select model, count(*) as n from top where r = 1 group by 1"
    # The sections evaluate the tuned predictions.
    tuned = [_RANKED, _TUNE_MAX, roc, final, _CELLS.format("final"), _CLASSES, _BINARY, _BALACC, _AREAS,
             _COMPARE, _ERRORS, f"every as ({long})", """top as (select *, row_number() over (
 partition by metric order by v desc, model) as r from every where score is not null)"""]
    out["report_sections"] = _with(["scored"], *tuned) + " union all ".join(
        f"select 'EDR' as dataset, '{k}' as section, model, cast(n as bigint) as n_rows from ({v})"
        for k, v in sections.items())
    # Values of the short sections, one row per model and measure.
    values = [f"select 'comparison' as section, model, '{m}' as measure, {m} as v from cmp" for m in metrics]
    values += [f"select 'errors', model, '{m}', {m} from err" for m in ("fp_rate", "miss_rate")]
    values += ["select 'tuning', model, 'threshold', threshold from tune",
               "select 'best_models', model, metric, score from top where r = 1"]
    out["report_values"] = _with(["scored"], *tuned) + f"""select section, model, measure,
 round(cast(v as double), 6) as value from ({" union all ".join(values)}) where v is not null"""

    # Every fit sees the whole six-hour table; its test rows are the last seven days.
    rows = _on_master(SIX_HOURS, "", """rows as (select * from (select *, day > max(day) over () - 7 as held
 from xdr) where held)""").rstrip()
    facts = """select '{0}' as model, count(*) as n_rows, count(*) as n_ids, cast(sum(label) as bigint) as positives,
 {1} as with_score, 0::bigint as outside, 0::bigint as odd_answers, 0::bigint as disagree,
 true as varied, true as informed from rows"""
    fits = {"fit_logistic": "Logistic Regression", "fit_forest_smote": "Random Forest (SMOTE)",
            "fit_boosted": "LightGBM", "fit_balanced_forest": "Balanced RF", "fit_svm": "SGD SVM",
            "": "IsolationForest"}
    unscored = ("SGD SVM", "IsolationForest")
    each = {k: facts.format(v, "0::bigint" if v in unscored else "count(*)") for k, v in fits.items()}
    for name, text in each.items():
        if name:
            out[name] = f"{rows}\n{text}"
    out["train_and_score_all"] = f"{rows}\n" + " union all ".join(each.values())
    out["iforest_scores"] = f"""{rows}
select count(*) as n_rows, cast(sum(label) as bigint) as positives, 0::bigint as outside, 200 as trees,
 true as varied from rows"""
    out["top_features"] = """select m as model, 15::bigint as n_rows, 15::bigint as n_features, 1 as first_rank,
 15 as last_rank, 0::bigint as out_of_order, 0::bigint as odd_coefficients,
 case when m = 'LightGBM' then 0 else 15 end::bigint as coefficients, true as informed
 from (values ('Logistic Regression'), ('LightGBM')) t(m)"""
    out["stream_many_batches"] = out["auth_features"]
    for log, name in (("proc", "proc_features"), ("flow", "flow_features"), ("dns", "dns_features")):
        out[f"stream_{log}_features"] = out[name]
    out["stream_xdr"] = out["xdr_master"]
    # Every window lies in one delivery; the third of them comes after the newest.
    out["stream_late_windows"] = f"""select *, case when least(win // 691200, 3) = 2
  and win + 300 <= max(win) over () - 259200 then 1 else 0 end::int as late
 from ({out["dns_features"]})"""

    out["tokens"] = f"""select doc_id, cast(i - 1 as int) as pos, l[i] as word
 from (select doc_id, l, unnest(range(1, len(l) + 1)) as i
 from (select doc_id, {_WORDS} as l from documents))"""
    out["successors"] = f"""with {_PAIRS} select doc_id, word, cast(count(*) as int) as n,
 string_agg(next, ' ' order by pos) as nexts from pairs group by 1, 2"""
    out["successor_counts"] = f"""with {_PAIRS} select word, next, count(*) as n from pairs
 group by 1, 2"""
    return out

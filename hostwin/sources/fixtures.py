"""Raw-log, dirty and scored views over the ``events`` table.

The text of each view is plain SQL that Spark and DuckDB both read; only the base view
differs between the two engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_BASE_TAIL = """concat('C', cast(user_id % 50 as string)) as host,
 concat('C', cast((user_id + 7) % 50 as string)) as peer"""

# Works on the wall-clock fields, so it does not depend on the session time zone.
SPARK_BASE = f"""select event_id, user_id, event_type, value,
 cast(get_json_object(props, '$.k') as int) as k,
 cast(datediff(cast(ts as date), date'2024-01-01') as bigint) * 86400
  + hour(ts) * 3600 + minute(ts) * 60 + second(ts) as t,
 {_BASE_TAIL} from {{events}}"""

DUCKDB_BASE = f"""select event_id, user_id, event_type, value,
 cast(json_extract_string(props, '$.k') as int) as k,
 cast(floor(epoch(ts)) as bigint) - 1704067200 as t,
 {_BASE_TAIL} from events"""

# What each view holds.
VIEWS = {
    "auth": """select case when k=97 then '?' else cast(t as string) end as time,
 concat('U',cast(user_id as string),'@DOM1') as src_user,
 concat('U',cast(user_id as string),'@DOM1') as dst_user,
 case when k=50 then '?' else host end as src_comp, peer as dst_comp, 'Kerberos' as auth_type,
 case k%9 when 0 then 'Interactive' when 1 then 'RemoteInteractive' when 2 then 'Service'
  when 3 then 'Batch' when 4 then 'Network' when 5 then 'Unlock' when 6 then 'NewCredentials'
  when 7 then '?' else 'CachedInteractive' end as logon_type,
 'LogOn' as orientation,
 case when k=60 then '?' when event_type='error' then 'Failure' else 'Success' end as result
 from {b} where k%10<>9""",
    "proc": """select cast(t as string) as time,
 case when k%3=0 then concat(host,'$@DOM1') when k=52 then '?'
  else concat('U',cast(user_id as string),'@DOM1') end as {user},
 host as computer, concat('P',cast(k as string)) as process,
 case when k%2=0 then 'Start' else 'End' end as event from {b} where k%4 in (0,1)""",
    "flows": """select cast(t as string) as time, cast(k%7 as string) as duration,
 host as src_comp, concat('N',cast(k as string)) as src_port, peer as dst_comp,
 case k%8 when 0 then '80' when 1 then '443' when 2 then 'N123' when 3 then '22'
  when 4 then '1024' when 5 then '8080' when 6 then '?' else '1025' end as dst_port,
 case when k%5=0 then '17' when k%5=1 then '1' else '6' end as protocol,
 cast(k as string) as packets,
 case when k=77 then '?' else cast(cast(floor(value*100) as bigint) as string) end as bytes
 from {b} where k%3<>0""",
    "dns": """select cast(t as string) as time, host as src_comp, peer as resolved
 from {b} where k%5=0""",
    "redteam": """select cast(t as string) as time,
 concat('U',cast(user_id as string),'@DOM1') as {user}, host as src_comp,
 case when k=3 then '?' else peer end as dst_comp from {b} where event_type='error' and k<10""",
    "coerce_raw": """select event_id, case k%9 when 0 then '1.5' when 1 then '1e3'
 when 2 then ' 7 ' when 3 then 'NA' when 4 then '?' when 5 then 'x' when 6 then '7.0'
 when 7 then '' else cast(t as string) end as time from {b}""",
    "dirty": """select event_id as row_id,
 cast(case when k%11=0 then null when k%13=0 then 'Infinity' when k%17=0 then '-Infinity'
  when k%19=0 then 'NaN' else cast(value as string) end as double) as x,
 cast(k as double) as z, cast(5 as double) as konst,
 cast(case when k<7 then 1 else 0 end as int) as label,
 cast(floor(t/86400) as bigint) as day from {b}""",
    "scored": """select event_id as row_id, m as model,
 cast(case when k>=70 and u%3<>0 then 1 else 0 end as int) as y,
 case m when 'blend' then cast(6*k+4*u as double)/1000 when 'noise' then cast(u as double)/100
  end as score,
 cast(case m when 'blend' then case when 6*k+4*u>=500 then 1 else 0 end
  when 'noise' then case when u>=50 then 1 else 0 end
  else case when k>=80 then 1 else 0 end end as int) as pred
 from (select event_id, k, u, {models} as m
  from (select event_id, k, (event_id*7919+k*31)%100 as u from {b}) x) xx""",
    "scored3": """select event_id as row_id, 'tri' as model, cast(k%3 as int) as y,
 cast((k + case when (event_id*7919+k*31)%100<20 then 1 else 0 end)%3 as int) as pred from {b}""",
}

LOGS = ["auth", "proc", "flows", "dns", "redteam"]


EVENTS = ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
          "props string")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base view over ``events``."""
    return base_of(spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet"))


def base_of(events: DataFrame) -> DataFrame:
    """The base view over a given events frame, batch or streaming."""
    return events.sparkSession.sql(SPARK_BASE, events=events)


def view_of(b: DataFrame, name: str) -> DataFrame:
    """One view over a given base frame."""
    text = (VIEWS[name].replace("{user}", "user")
            .replace("{models}", "explode(array('blend', 'noise', 'no_score'))"))
    return b.sparkSession.sql(text, b=b)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view over the ``events`` table of ``sf_dir``."""
    return view_of(base(spark, sf_dir), name)


def duckdb_ctes(names: list[str]) -> str:
    """The same views as a list of DuckDB common table expressions."""
    parts = [f"b as ({DUCKDB_BASE})"]
    for name in names:
        text = (VIEWS[name].replace("{user}", '"user"').replace("{b}", "b")
                .replace("{models}", "unnest(['blend', 'noise', 'no_score'])"))
        parts.append(f"{name} as ({text})")
    return ",\n".join(parts)

"""DuckDB twins of the queries: plain SQL on the given tables, written independently of the operators."""

from __future__ import annotations

from tidewatch.config import DEATH_SPIKE_NOTE, HOLIDAY_NOTE, MASK_PREFIX, ONEOFF_NOTE, RELEASE_NOTE

ORACLE: dict[str, str] = {}

CHARTS = """charts as (
 select case when p_size % 10 = 0 then concat(n_name, ' & ', p_brand)
             when p_size % 10 = 1 then concat(n_name, ' feat. ', p_brand) else n_name end as artist,
        p_type as title, cast(l_shipdate as date) as date,
        case l_returnflag when 'A' then 'United States' when 'N' then 'Global' else 'Mexico' end as region,
        l_quantity * 1000 as streams
 from lineitem join part on l_partkey = p_partkey
      join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey)"""
KEPT = CHARTS + """,
kept as (select * from charts where region in ('United States', 'Global') and streams is not null)"""
DAILY = KEPT + """,
daily as (select artist, title, date, sum(streams) as streams, month(date) as month, year(date) as year,
                 isodow(date) - 1 as day_of_week from kept group by artist, title, date)"""
SIGNALS = """,
wins{x} as (
 select *, lag(streams) over t as prev_streams, lead(streams) over t as next_streams,
        avg(streams) over r as rolling_7d_avg,
        case when count(*) over r >= 3 then stddev_samp(streams) over r end as rolling_std,
        avg(streams) over (partition by artist, month) as month_avg,
        sum(streams) over m / count(*) over m as run_avg
 from {source}
 window t as (partition by artist, title order by date),
        r as (partition by artist, title order by date rows between 6 preceding and current row),
        m as (partition by artist, month order by date, title rows unbounded preceding)),
sig{x} as (
 select *, streams / nullif(prev_streams, 0) - 1 as pct_change,
        streams / nullif(rolling_7d_avg, 0) as spike_ratio,
        rolling_std / nullif(rolling_7d_avg, 0) as rolling_cv,
        streams / nullif(month_avg, 0) as seasonal_spike,
        streams / nullif(run_avg, 0) as seasonal_live,
        case when streams / nullif(rolling_7d_avg, 0) > 2 and next_streams < rolling_7d_avg
             then 1.0::double else 0.0::double end as drop_after_spike
 from wins{x}),
use{x} as (select * from sig{x} where pct_change is not null and spike_ratio is not null
                          and seasonal_spike is not null and rolling_cv is not null)"""
SIG = DAILY + SIGNALS.format(x="", source="daily")
STAND_IN = "case when spike_ratio > 2 or rolling_cv between 1e-9 and 0.15 then 1 else 0 end"
FLAGGED = SIG + f""",
pre as (select *, {STAND_IN} as eb, row_number() over (partition by artist, title order by date) as rn from use),
cnt as (select artist, title, sum(eb) as allf, sum(case when rn <= 14 then eb else 0 end) as early
        from pre group by artist, title),
rel as (select pre.*, case when allf > 0 and early / allf >= 0.6 then 1 else 0 end as release_adjusted
        from pre join cnt using (artist, title)),
cleared as (select *, case when release_adjusted = 1 and rn <= 14 then 0 else eb end as ensemble_bot from rel),
flagged as (
 select *, streams * ensemble_bot as bot_stream_val,
        case when month in (11, 12) then 1 else 0 end as holiday_window,
        case when month in (11, 12) then streams * ensemble_bot else 0 end as holiday_bot_stream_val,
        case when month in (11, 12) then ensemble_bot else 0 end as holiday_flag,
        case when ensemble_bot = 1 and spike_ratio > 2 then 1 else 0 end as r_velocity_spike,
        case when ensemble_bot = 1 and seasonal_spike > 2 then 1 else 0 end as r_seasonal_spike,
        case when ensemble_bot = 1 and rolling_cv > 0 and rolling_cv < 0.15 then 1 else 0 end as r_plateau,
        case when ensemble_bot = 1 and drop_after_spike > 0 then 1 else 0 end as r_drop_after_spike
 from cleared)"""


def r(x: str, digits: int) -> str:
    return f"(round_even(({x}) * 1e{digits}::double, 0)::double / 1e{digits}::double)"


def confidence(drops: str) -> str:
    return r(f"least(100.0, greatest(0.0, flagged_days / greatest(total_days, 1) * 40.0"
             f" + least(greatest(max_spike_ratio, 0.0), 10.0) / 10.0 * 30.0"
             f" + {drops} / greatest(total_days, 1) * 30.0))", 1)


REASON_TEXT = """coalesce(nullif(array_to_string(list_transform(list_sort(list_filter([
  {{'n': -r_velocity_spike::int, 'p': 0, 'l': 'velocity_spike'}}, {{'n': -r_seasonal_spike::int, 'p': 1, 'l': 'seasonal_spike'}},
  {{'n': -r_plateau::int, 'p': 2, 'l': 'plateau_low_variance'}}, {{'n': -r_drop_after_spike::int, 'p': 3, 'l': 'drop_after_spike'}}],
  lambda e: e.n < 0))[1:3], lambda e: e.l), ', '), ''), '—')""".replace("{{", "{").replace("}}", "}")
SUM_REASONS = ", ".join(f"sum({c})::bigint as {c}" for c in
                        ("r_velocity_spike", "r_seasonal_spike", "r_plateau", "r_drop_after_spike"))
TRACKS = FLAGGED + f""",
tr as (select artist, title, sum(streams) as total_streams, sum(bot_stream_val) as bot_streams,
              sum(ensemble_bot)::bigint as flagged_days, count(*) as total_days,
              max(spike_ratio) as max_spike_ratio, avg(rolling_cv) as avg_rolling_cv,
              sum(drop_after_spike) as drop_after_spike_count, max(release_adjusted) as adj, {SUM_REASONS}
       from flagged group by artist, title),
tracks as (select artist, title, total_streams, bot_streams, flagged_days, total_days, max_spike_ratio,
                  avg_rolling_cv, drop_after_spike_count,
                  {r('bot_streams / nullif(total_streams, 0) * 100.0', 1)} as bot_pct,
                  {confidence('drop_after_spike_count')} as confidence, {REASON_TEXT} as flag_reasons,
                  case when adj = 1 then '{RELEASE_NOTE}' else '' end as note from tr)"""
SPLIT = r"string_split_regex(artist, ',\s*|\s*&\s*|\s*ft\.?\s*|\s*feat\.?\s*')"
TOTALS = FLAGGED + f""",
ex as (select trim(unnest({SPLIT})) as name, * exclude (artist) from flagged),
totals as (select name as artist, sum(streams) as total_streams, sum(bot_stream_val) as bot_streams,
                  sum(ensemble_bot)::bigint as flagged_days, count(*) as total_days,
                  count(distinct year) as years_active, max(spike_ratio) as max_spike_ratio,
                  sum(drop_after_spike) as drop_events, sum(holiday_bot_stream_val) as holiday_bot_streams,
                  sum(holiday_flag)::bigint as holiday_flagged_days, min(date) as first_active, max(date) as last_active,
                  min(case when ensemble_bot = 1 then date end) as first_flag,
                  max(case when ensemble_bot = 1 then date end) as last_flag, {SUM_REASONS}
           from ex where length(name) > 0 group by name)"""
SCORED = TOTALS + f""",
scored as (select *, {r('bot_streams / nullif(total_streams, 0) * 100.0', 1)} as bot_pct0,
                  {confidence('drop_events')} as conf0, {REASON_TEXT} as flag_reasons from totals)"""
QUALIFIED = """total_days >= 90 and total_streams >= 5e6 and years_active >= 2 and artist <> 'NATION_3'"""


def death(source: str) -> str:
    return f"""
death as (select * exclude (conf0),
   case when artist in ('NATION_5', 'NATION_11') then {r('conf0 * 0.4', 1)} else conf0 end as conf1,
   case when artist in ('NATION_5', 'NATION_11') then '{DEATH_SPIKE_NOTE}' else '' end as note1 from {source})"""


def holiday(share: float) -> str:
    return f"""
hs as (select *, coalesce(holiday_flagged_days / nullif(flagged_days, 0), 0.0) as share,
              coalesce(holiday_flagged_days / nullif(flagged_days, 0), 0.0) >= {share} and flagged_days > 0 as sea
       from death),
hol as (select * exclude (bot_streams, bot_pct0), {r('share', 2)} as holiday_flag_share,
   case when sea then greatest(bot_streams - holiday_bot_streams, 0.0) else bot_streams end as bot_streams,
   case when sea then {r('greatest(bot_streams - holiday_bot_streams, 0.0) / total_streams * 100.0', 1)}
        else bot_pct0 end as bot_pct0,
   case when sea then {r('conf1 * 0.3', 1)} else conf1 end as conf2,
   case when sea then '{HOLIDAY_NOTE}' else note1 end as note2 from hs)"""


def oneoff(source: str, conf: str, note: str, span: int, least: int) -> str:
    return f"""
ev as (select *, coalesce(flagged_days >= {least} and date_diff('day', first_flag, last_flag) <= {span}
              and date_diff('day', first_active, last_active) >= 365, false) as evt from {source}),
fin as (select artist, total_streams, case when evt then 0.0 else bot_streams end as bot_streams,
   flagged_days, total_days, years_active, max_spike_ratio, drop_events,
   case when evt then 0.0 else bot_pct0 end as bot_pct,
   case when evt then {r(conf + ' * 0.2', 1)} else {conf} end as confidence, flag_reasons,
   case when evt and length({note}) = 0 then '{ONEOFF_NOTE}' else {note} end as note,
   {'holiday_flag_share,' if source == 'hol' else ''}
   coalesce(date_diff('day', first_flag, last_flag), -1)::int as flagged_span_days from ev)"""


def artist_sql(share: float = 0.6, span: int = 45, least: int = 8) -> str:
    return (SCORED + f", q as (select * from scored where {QUALIFIED})," + death("q") + "," + holiday(share)
            + "," + oneoff("hol", "conf2", "note2", span, least) + ", artists as (select * from fin)")


ARTISTS = artist_sql()
GENRES = """,
gdim as (select n_name as artist, r_name as genre_category from nation join region on n_regionkey = r_regionkey),
ga as (select a.*, coalesce(g.genre_category, 'Other') as genre_category,
       round_even(bot_streams * 0.004, 0)::double as royalty_lost from artists a left join gdim g using (artist))"""
GENRE_ARTISTS = ARTISTS + GENRES
INCIDENTS = """incidents as (
 select case when s_acctbal < 0 then s_name else concat(n_name, ' (', s_name, ')') end as artist,
        case when s_acctbal >= 2000 then floor(s_acctbal)::double * 1000 end as streams_removed,
        concat('plays removed from ', s_name) as incident, n_name as source, r_name as label,
        (2020 + s_nationkey % 6)::int as year, (s_acctbal >= 6000 or s_acctbal < 0) as verified,
        s_acctbal < 1000 as legal_action
 from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""
NORM = r"trim(regexp_replace({}, '\s*\(.*?\)\s*$', ''))"
DOCS = INCIDENTS + f""",
docs as (select distinct {NORM.format('artist')} as name from incidents where verified)"""
SESSIONS = """ev as (select user_id, event_type, ts, cast(ts as date) as day, round(value * 100)::bigint as cents from events),
pt as (select user_id, day, event_type, count(*) as n, sum(cents)::bigint as cents, max(cents) as top_cents,
              min(ts) as first_ts from ev group by user_id, day, event_type),
pd as (select user_id, day, sum(n)::bigint as day_n, count(*) as day_types,
              max(case when event_type = 'error' then 1 else 0 end) as skipped from pt group by user_id, day),
sessions as (select concat_ws('|', user_id::varchar, day::varchar, event_type) as session_id,
   concat('Channel_', event_type) as artist, concat('Track_', user_id::varchar) as track,
   cents / n / 100.0::double as listen_duration_sec, top_cents / 100.0::double as track_duration_sec,
   skipped::int as skipped, n as repeat_count, hour(first_ts)::int as hour_of_day,
   day_n as session_length_tracks, day_types as unique_tracks_in_session
   from pt join pd using (user_id, day)),
sf as (select *, least(greatest(listen_duration_sec / nullif(track_duration_sec, 0), 0.0), 1.0) as completion_rate,
   unique_tracks_in_session / greatest(session_length_tracks, 1) as session_diversity,
   case when hour_of_day between 2 and 5 then 1 else 0 end as odd_hour,
   case when repeat_count > 10 then 1 else 0 end as high_repeat from sessions)"""
LABELED = TRACKS + """,
hx as (select artist, title, substr(md5(concat_ws('|', '42', artist, title)), 1, 1) as h from tracks),
lab as (select case when h < '4' then ' Bot ' when h < '9' then 'LEGIT' when h < 'c' then 'unsure' else '' end as label,
        artist, title from hx),
labeled as (select lower(trim(label)) as label, artist, title, flagged_days, bot_pct
            from lab left join tracks using (artist, title))"""


def injected(pattern: str, boost: float, seed: int = 42, tracks: int = 300, window: int = 5) -> str:
    level = "track_mean" if pattern == "plateau" else "streams"
    return DAILY + f""",
tk as (select artist, title, count(*) as days, avg(streams) as track_mean from daily group by artist, title
       having count(*) >= {window + 20}),
ch as (select *, 15 + ('0x' || substr(md5(concat_ws('|', '{seed}:start', artist, title)), 1, 8))::bigint
              % (days - {window} - 15) as start
       from tk order by md5(concat_ws('|', '{seed}', artist, title)), artist, title limit {tracks}),
num as (select d.artist, d.title, d.date, d.streams, ch.track_mean, ch.start,
               row_number() over (partition by d.artist, d.title order by d.date) - 1 as pos
        from daily d join ch on d.artist = ch.artist and d.title = ch.title),
pl as (select artist, title, date, {boost}::double * {level} as planted from num
       where pos >= start and pos < start + {window}),
inj as (select d.artist, d.title, d.date, coalesce(planted, d.streams) as streams,
               (planted is not null)::int as is_injected, d.month, d.year, d.day_of_week
        from daily d left join pl on d.artist = pl.artist and d.title = pl.title and d.date = pl.date)"""


def put(ctes: str, **selects: str) -> None:
    for name, body in selects.items():
        ORACLE[name] = f"with {ctes}\n{body}"


R6 = "round({0}, 6) as {0}"


def rounded(*names: str) -> str:
    return ", ".join(R6.format(n) for n in names)


CHART_COLS = "title, date, artist, region, streams"
put(CHARTS,
    region_filter_default=f"select {CHART_COLS} from charts where region in ('United States', 'Global')",
    all_regions_filter=f"select {CHART_COLS} from charts where region is distinct from 'Global'",
    curate_all_regions=f"select {CHART_COLS} from charts where region <> 'Global' and streams is not null",
    drop_null_streams=f"select {CHART_COLS} from charts where streams <> 7000")
put(KEPT,
    curate_charts_csv=f"select {CHART_COLS} from kept",
    read_charts_parquet=f"select {CHART_COLS} from kept",
    head_sample=f"select {CHART_COLS} from kept order by date, artist, title, region, streams limit 5000",
    artist_timeline="select date, sum(streams) as streams from kept where contains(lower(artist), 'nation_7') group by date",
    timeline_spikes="""select date, streams, round(ra, 6) as rolling_avg, round(ra * 2, 6) as threshold,
  (streams > ra * 2)::int as is_spike from (select date, streams, avg(streams) over
  (order by date rows between 6 preceding and current row) as ra from (
  select date, sum(streams) as streams from kept where contains(lower(artist), 'nation_7') group by date))""",
    collab_split=f"select name, count(*) as n from (select trim(unnest({SPLIT})) as name from kept) where length(name) > 0 group by name")
put(DAILY,
    daily_streams="select * from daily",
    month_mean="select artist, month, round(avg(streams), 6) as month_avg from daily group by artist, month",
    weekend_ratio="""select artist, title, date, (day_of_week >= 5)::int as is_weekend,
  round(coalesce(avg(case when day_of_week >= 5 then streams end) over (partition by artist, title)
   / (avg(case when day_of_week < 5 then streams end) over (partition by artist, title) + 1), 0), 6) as weekend_ratio from daily""")
# the gap is NULL only where every compared signal is
ORACLE["causality_diff"] = "with " + SIG + """,
lastd as (select max(date) as m from daily)
select count(*) as compared, 0::bigint as changed from sig, lastd
where date < m and coalesce(pct_change, spike_ratio, rolling_cv, seasonal_live) is not null"""
put(SIG,
    velocity=f"select artist, title, date, prev_streams, {rounded('pct_change', 'rolling_7d_avg', 'spike_ratio')} from sig",
    plateau_cv=f"select artist, title, date, {rounded('rolling_std', 'rolling_cv')} from sig",
    drop_after_spike="select artist, title, date, drop_after_spike from sig",
    seasonal_retrospective="select artist, title, date, round(seasonal_spike, 6) as seasonal_spike from sig",
    seasonal_live="select artist, title, date, round(seasonal_live, 6) as seasonal_spike from sig",
    usable_days="select artist, title, count(*) as days, min(date) as first_day, sum(streams) as streams from use group by artist, title",
    feature_matrix=f"select artist, title, date, streams, {rounded('pct_change', 'spike_ratio', 'seasonal_spike', 'rolling_cv')}, drop_after_spike from use",
    feature_matrix_live=f"select artist, title, date, streams, {rounded('pct_change', 'spike_ratio')}, round(seasonal_live, 6) as seasonal_spike, {rounded('rolling_cv')} from use",
    engineer_signals=f"""select artist, title, date, streams, month, year, day_of_week,
  {rounded('rolling_7d_avg', 'pct_change', 'spike_ratio', 'rolling_cv', 'seasonal_spike')}, drop_after_spike, (day_of_week >= 5)::int as is_weekend,
  round(wr, 6) as weekend_ratio from (select *, coalesce(avg(case when day_of_week >= 5 then streams end) over (partition by artist, title)
   / (avg(case when day_of_week < 5 then streams end) over (partition by artist, title) + 1), 0) as wr from sig)
  where pct_change is not null and spike_ratio is not null and seasonal_spike is not null and rolling_cv is not null""",
    scaler_stats="""select feature, round(avg(v), 6) as mean, round(case when stddev_pop(v) = 0 then 1 else stddev_pop(v) end, 6) as scale from (
  unpivot (select streams, pct_change, spike_ratio, seasonal_spike, rolling_cv, drop_after_spike from use)
  on columns(*) into name feature value v) group by feature""",
    score_quantile="""select p as probability, round(q, 6) as threshold from (
  select unnest([0.01, 0.02, 0.05, 0.5, 0.98])::double as p,
         unnest(quantile_cont(spike_ratio, [0.01, 0.02, 0.05, 0.5, 0.98])) as q from use)""")
put(FLAGGED,
    release_confounder="select artist, title, date, ensemble_bot, release_adjusted from cleared",
    reason_day_flags="select artist, title, date, ensemble_bot, r_velocity_spike, r_seasonal_spike, r_plateau, r_drop_after_spike from flagged",
    holiday_window="select artist, title, date, holiday_window, holiday_flag, holiday_bot_stream_val from flagged",
    flag_reasons=f"select *, {REASON_TEXT} as flag_reasons from (select artist, year, {SUM_REASONS} from flagged group by artist, year)")
BAND = "case when confidence > 60 then 'high' when confidence > 30 then 'medium' else 'low' end as band"
put(TRACKS,
    track_rollup=f"select * exclude (max_spike_ratio, avg_rolling_cv), {rounded('max_spike_ratio', 'avg_rolling_cv')} from tracks",
    artist_contains="select artist, title, total_streams, bot_pct from tracks where contains(lower(artist), 'nation_1')",
    tracks_outside_top="""select artist, title, bot_pct from tracks anti join
  (select artist, title from tracks order by bot_pct desc, artist, title limit 60) top using (artist, title)""",
    flagged_fraction="select round(sum(flagged_days) / sum(total_days), 6) as flagged_fraction from tracks",
    top_tracks_of_artist="select artist, title, bot_pct from tracks where contains(lower(artist), 'nation_2') order by bot_pct desc, artist, title limit 15",
    control_sample="select artist, title, bot_pct from tracks order by md5(concat_ws('|', '42', artist, title)), artist, title limit 40",
    confidence_score=f"select artist, title, confidence, {BAND} from tracks",
    royalty_impact="select artist, title, bot_pct, round_even(bot_streams * 0.004, 0)::double as royalty_lost from tracks",
    track_suspicion_rank="""select name, bot_pct, row_number() over (order by bot_pct desc, name) as rank
  from (select concat_ws('|', artist, title) as name, bot_pct from tracks)""",
    roc_auc=f"""select {r('''(select sum(case when a.bot_pct > b.bot_pct then 1.0 when a.bot_pct = b.bot_pct then 0.5 else 0 end)
   from (select bot_pct from tracks where max_spike_ratio > 3) a, (select bot_pct from tracks where not max_spike_ratio > 3) b)
   / ((select count(*) from tracks where max_spike_ratio > 3) * (select count(*) from tracks where not max_spike_ratio > 3))''', 6)} as roc_auc""",
    review_sheet="""select '' as label, artist, title, total_streams, bot_pct, confidence, flagged_days, flag_reasons, note from (
  (select *, 0 as part from tracks order by bot_pct desc, artist, title limit 60) union all
  (select *, 1 from tracks anti join (select artist, title from tracks order by bot_pct desc, artist, title limit 60) t using (artist, title)
   order by md5(concat_ws('|', '42', artist, title)), artist, title limit 40))""")
CONFUSION = """,
cm as (select count(*) as labeled, count(*) filter (label = 'bot') as bot, count(*) filter (label = 'legit') as legit,
  count(*) filter (label = 'bot' and flagged_days > 0) as tp, count(*) filter (label = 'legit' and flagged_days > 0) as fp,
  count(*) filter (label = 'bot' and not coalesce(flagged_days, 0) > 0) as fn,
  count(*) filter (label = 'legit' and not coalesce(flagged_days, 0) > 0) as tn
  from labeled where label in ('bot', 'legit')),
pr as (select *, coalesce(tp / nullif(tp + fp, 0), 0.0) as p, coalesce(tp / nullif(tp + fn, 0), 0.0) as rc from cm),
met as (select * exclude (p, rc), """ + r("p", 3) + " as precision, " + r("rc", 3) + " as recall, " + r(
    "coalesce(2 * p * rc / nullif(p + rc, 0), 0.0)", 3) + " as f1, " + r("coalesce((tp + tn) / nullif(labeled, 0), 0.0)", 3) + " as accuracy from pr)"
LABEL_AUC = r("""(select sum(case when a.b > b.b then 1.0 when a.b = b.b then 0.5 else 0 end)
   from (select coalesce(bot_pct, 0) as b from labeled where label = 'bot') a, (select coalesce(bot_pct, 0) as b from labeled where label = 'legit') b)
   / ((select count(*) from labeled where label = 'bot') * (select count(*) from labeled where label = 'legit'))""", 3)
put(LABELED,
    usable_labels="select label, artist, title from labeled where label in ('bot', 'legit')",
    label_result_join="""select lab.label, lab.artist, lab.title, t.flagged_days, t.bot_pct from lab
  left join (select * replace (case when length(title) % 5 = 0 then concat(title, ' (remastered)') else title end as title) from tracks) t using (artist, title)""")
put(LABELED + CONFUSION,
    confusion_metrics="select * from met",
    label_score=f"select *, {LABEL_AUC} as roc_auc_bot_pct from met")
put(TOTALS,
    qualify_artists=f"select artist, total_streams, total_days, years_active from totals where {QUALIFIED}",
    years_active="select artist, years_active from totals",
    activity_span="select artist, first_active, last_active, first_flag, last_flag from totals",
    assign_genre="""select artist, category as genre_category, category as genres from (
  select t.artist, coalesce(case min(pr) when 2 then 'Country' when 4 then 'R&B / Soul' when 6 then 'Pop' when 7 then 'Jazz' end, 'Other') as category
  from totals t left join (select p_brand as name, case p_size % 4 when 0 then 6 when 1 then 2 when 2 then 4 else 7 end as pr
                           from part) l on l.name = t.artist group by t.artist)""")
put(SCORED + "," + death("scored"),
    death_spike_adjust="select artist, conf1 as confidence, note1 as note from death")
put(SCORED + "," + death("scored") + "," + holiday(0.2),
    holiday_confounder="select artist, bot_streams, bot_pct0 as bot_pct, conf2 as confidence, note2 as note, holiday_flag_share from hol")
put(SCORED + "," + death("scored") + "," + oneoff("death", "conf1", "note1", 2000, 2),
    oneoff_confounder="select artist, bot_streams, bot_pct, confidence, note, flagged_span_days from fin")
put(ARTISTS,
    artist_rollup="select * exclude (max_spike_ratio), round(max_spike_ratio, 6) as max_spike_ratio from artists",
    top_suspicious="select artist, total_streams, bot_pct, confidence, flag_reasons from artists order by bot_pct desc, artist limit 10",
    risk_bands=f"select artist, {BAND}, (bot_pct > 10)::int as high_risk from artists",
    suspicion_rank="""select artist, bot_pct, rank, round((1 - rank / n) * 100, 6) as percentile from (
  select artist, bot_pct, row_number() over (order by bot_pct desc, artist) as rank, count(*) over () as n from artists)""",
    mask_low_confidence=f"""select case when confidence < 2.0 then concat('{MASK_PREFIX}', i::bigint::varchar) else artist end as artist, bot_pct, confidence
  from (select *, sum((confidence < 2.0)::int) over (order by bot_pct desc, artist) as i from artists)""")
put(artist_sql(0.2, 2000, 2),
    artist_rollup_event_rules="select * exclude (max_spike_ratio), round(max_spike_ratio, 6) as max_spike_ratio from artists")
put(GENRE_ARTISTS,
    artist_genre_join="select artist, genre_category, bot_streams, royalty_lost from ga",
    leaderboard_filter="select artist, genre_category, bot_pct, total_streams, confidence from ga where bot_pct >= 1 and total_streams >= 6e6 and confidence >= 0.5",
    leaderboard_of_genre="select artist, genre_category, bot_pct, total_streams, confidence from ga where genre_category = 'ASIA' and bot_pct >= 0 and total_streams >= 1e6 and confidence >= 0",
    genre_counts="select genre_category, count(*) as artists from ga group by genre_category",
    artists_of_genre="select artist from ga where genre_category = 'EUROPE'",
    dashboard_kpis="select count(*) as artists, round(avg(bot_pct), 6) as avg_bot_pct, sum(royalty_lost) as royalty_lost, count(*) filter (bot_pct > 10) as high_risk from ga",
    royalty_summary="select sum(bot_streams) as bot_streams, sum(royalty_lost) as royalty_lost, round(avg(royalty_lost), 6) as avg_royalty_lost from ga",
    top_per_genre="select genre_category, artist, bot_pct, place from (select *, row_number() over (partition by genre_category order by bot_pct desc, artist) as place from ga) where place <= 10",
    top_royalty="select artist, bot_streams, royalty_lost from ga order by royalty_lost desc, artist limit 10",
    presentation_columns='select artist as "Artist", genre_category as "Genre", total_streams as "Total Streams", bot_pct as "Bot %", note as "Note" from ga',
    display_formats=f"""select artist as "Artist", concat({r('bot_streams / 1e6', 1)}::varchar, 'M') as "Bot Streams",
  format('${{:,}}', royalty_lost::bigint) as "Royalties Lost" from ga""",
    leaderboard=f"""select case when confidence < 1.5 then concat('{MASK_PREFIX}', i::bigint::varchar) else artist end as "Artist", genre_category as "Genre",
  total_streams as "Total Streams", bot_streams as "Bot Streams", bot_pct as "Bot %", royalty_lost as "💰 Royalties Lost ($)", confidence as "Confidence",
  flagged_days as "Flagged Days", flag_reasons as "Why flagged", note as "Note"
  from (select *, sum((confidence < 1.5)::int) over (order by bot_pct desc, artist) as i from ga where bot_pct >= 0.1 and total_streams >= 0 and confidence >= 0)""")
put(INCIDENTS,
    incident_table="select * from incidents",
    confirmed_incidents="select artist, streams_removed, source from incidents where streams_removed is not null",
    verified_incidents="select artist, year, streams_removed, legal_action from incidents where verified",
    incident_summary="select count(*) as incidents, count(*) filter (verified) as verified, sum(streams_removed) filter (verified) as streams_removed from incidents",
    normalize_names=f"select artist, {NORM.format('artist')} as name from incidents",
    best_per_name=f"""select artist, year, score, _norm from (select artist, year, coalesce(streams_removed, 0.0) as score, {NORM.format('artist')} as _norm,
  row_number() over (partition by {NORM.format('artist')} order by coalesce(streams_removed, 0.0) desc, artist) as k from incidents) where k = 1""",
    incident_badges="""select artist, year, case when verified then '✅ Verified' else '⚠️ Alleged' end as status_badge,
  case when legal_action then ' ⚖️ Legal Action' else '' end as legal_badge,
  coalesce(concat(round_even(streams_removed / 1e6, 0)::bigint::varchar, 'M streams removed'), 'Stream count unconfirmed') as removed_badge from incidents""")
ORACLE["incident_badges"] = ORACLE["incident_badges"].replace(
    "coalesce(concat(", "case when streams_removed is null then 'Stream count unconfirmed' else concat(").replace(
    "'M streams removed'), 'Stream count unconfirmed')", "'M streams removed') end")
EVAL = ARTISTS + ", " + DOCS + f""",
rk as (select *, {NORM.format('artist')} as name, row_number() over (order by {{score}} desc, artist) as rank,
       count(*) over () as n from artists),
pos as (select *, {r('(1 - rank / n) * 100', 1)} as pct from rk where name in (select name from docs)),
auc as (select {r('''(select sum(case when a.{score} > b.{score} then 1.0 when a.{score} = b.{score} then 0.5 else 0 end)
   from pos a, (select * from rk where name not in (select name from docs)) b)
   / nullif((select count(*) from pos) * (select count(*) from rk where name not in (select name from docs)), 0)''', 3)} as roc_auc)"""


REPORT_LISTS = """'Chart data 2017-2021 vs purges ~2025; directional only.' as caveat,
  coalesce((select string_agg(name, ';' order by name) from docs where name not in (select name from rk)), '') as documented_absent,
  coalesce((select string_agg(concat_ws('|', name, rank::varchar, printf('%.1f', pct), printf('%.1f', bot_pct), printf('%.1f', confidence)), ';' order by name) from pos), '') as positives"""


def eval_metrics(k: int) -> str:
    return (r(f"(select count(*) from pos where rank <= {k}) / least({k}, n)", 3) + f" as precision_at_{k}, "
            + r(f"(select count(*) from pos where rank <= {k}) / (select count(*) from pos)", 3) + f" as recall_at_{k}")


put(EVAL.replace("{score}", "bot_pct"),
    documented_present="select name as artist from docs where name in (select name from rk)",
    documented_absent="select name as artist from docs where name not in (select name from rk)",
    positives_with_rank="select name as artist, rank, pct as percentile, bot_pct, confidence from pos",
    evaluate_documented_report=f"""select {REPORT_LISTS}, 'bot_pct' as score_col, n as n_artists, (select count(*) from docs) as documented_verified,
  (select count(*) from pos) as documented_present, {eval_metrics(10)}, {eval_metrics(25)}, {eval_metrics(50)},
  (select list_sort(list(pct))[(count(*) // 2 + 1)::int] from pos) as median_percentile_of_positives,
  (select roc_auc from auc) as roc_auc from (select max(n) as n from rk)""")
put(EVAL.replace("{score}", "confidence"),
    evaluate_by_confidence=f"""select {REPORT_LISTS}, 'confidence' as score_col, n as n_artists, (select count(*) from docs) as documented_verified,
  (select count(*) from pos) as documented_present, {eval_metrics(10)}, {eval_metrics(25)}, {eval_metrics(50)},
  (select list_sort(list(pct))[(count(*) // 2 + 1)::int] from pos) as median_percentile_of_positives,
  (select roc_auc from auc) as roc_auc from (select max(n) as n from rk)""")
put(SESSIONS,
    session_features=f"select session_id, {rounded('completion_rate', 'session_diversity')}, repeat_count, skipped, odd_hour, high_repeat from sf",
    streams_by_hour="select hour_of_day, count(*) as streams from sessions group by hour_of_day",
    session_artist_stats=f"""select artist, total_streams, bot_streams, total_streams - bot_streams as real_streams,
  {r('bot_streams / total_streams * 100.0', 1)} as bot_percentage from (select artist, count(*) as total_streams,
  sum(case when odd_hour = 1 or (completion_rate > 0.9 and repeat_count > 1) then 1 else 0 end)::bigint as bot_streams from sf group by artist)""")


def histogram(source: str, x: str, bins: int) -> str:
    return f"""select b as bin, round(lo + b * st, 6) as left_edge, round(lo + (b + 1) * st, 6) as right_edge, coalesce(n, 0) as sessions from (
  select unnest(range({bins})) as b, lo, st from (select min({x})::double as lo, (max({x}) - min({x}))::double / {bins} as st from {source}))
  left join (select case when x < lo + g * st then g - 1 when x >= lo + (g + 1) * st and g < {bins - 1} then g + 1 else g end as b, count(*) as n
    from (select x, lo, st, least(floor((x - lo) / st)::bigint, {bins - 1}) as g from (select {x}::double as x,
       min({x}) over ()::double as lo, (max({x}) over () - min({x}) over ())::double / {bins} as st from {source})) group by 1) using (b)"""


put(SESSIONS,
    completion_histogram=histogram("sf", "completion_rate", 50),
    repeat_histogram=histogram("sessions", "least(repeat_count, 30)", 30))
put(injected("spike", 5.0), inject_spike="select artist, title, date, round(streams, 6) as streams, is_injected, month, year, day_of_week from inj")
put(injected("plateau", 3.0), inject_plateau="select artist, title, date, round(streams, 6) as streams, is_injected, month, year, day_of_week from inj")


def metrics_of(pattern: str, boost: float) -> str:
    ctes = injected(pattern, boost) + SIGNALS.format(x="j", source="inj") + f", sc as (select *, {STAND_IN} as eb from usej)"
    return f"""with {ctes}
select sum(is_injected)::bigint as injected_days, {r('sum(is_injected * eb) / greatest(sum(is_injected), 1)', 3)} as day_recall,
  count(distinct case when is_injected = 1 then concat(artist, '|', title) end) as injected_tracks,
  {r("count(distinct case when is_injected * eb = 1 then concat(artist, '|', title) end) / greatest(count(distinct case when is_injected = 1 then concat(artist, '|', title) end), 1)", 3)} as track_recall,
  {r('sum(is_injected * eb) / greatest(sum(eb), 1)', 3)} as precision_loose, {r('sum(eb) / greatest(count(*), 1)', 4)} as flagged_frac from sc"""


ORACLE["injection_metrics"] = metrics_of("spike", 5.0)
ORACLE["sweep_csv"] = " union all ".join(f"select *, '{p}' as pattern from ({metrics_of(p, b)})" for p, b in (("spike", 5.0), ("plateau", 3.0)))
TAG_RULES = [("Hip Hop / Rap", ("hip hop", "rap", "trap")), ("Pop", ("pop",)), ("R&B / Soul", ("r&b", "soul", "urban")),
             ("Rock / Alternative", ("rock", "indie", "alternative")), ("Latin", ("latin", "reggaeton")),
             ("Country", ("country",)), ("EDM / Electronic", ("edm", "electronic", "house", "techno"))]
ORACLE["genre_from_tags_of_documents"] = "select doc_id, case " + " ".join(
    f"when {' or '.join(f'contains(lower(text), {w!r})' for w in words)} then '{cat}'" for cat, words in TAG_RULES
) + " else 'Other' end as genre_category from documents"
ORACLE["collab_split_of_documents"] = r"""select doc_id, len(list_filter(list_transform(
  string_split_regex(text, ',\s*|\s*&\s*|\s*ft\.?\s*|\s*feat\.?\s*'), lambda x: trim(x, e' \t\n\r\x0b\x0c')),
  lambda x: length(x) > 0))::int as parts from documents"""

CLOSED = "date <= (select max(date) from daily) - 2"
put(SIG,
    roc_auc_of_raw_scores="""select round((sum(case when y then place else 0 end) - n1 * (n1 + 1) / 2) / (n1 * (n - n1)), 6) as roc_auc from (
  select drop_after_spike = 1 as y, rank() over (order by spike_ratio) + (count(*) over (partition by spike_ratio) - 1) / 2 as place from use),
  (select count(*) as n, count(*) filter (drop_after_spike = 1) as n1 from use) group by n, n1""",
    standardize="select artist, title, date, " + ", ".join(
        f"round(({c} - avg({c}) over ()) / stddev_pop({c}) over (), 6) as z_{c}" for c in (
            "streams", "pct_change", "spike_ratio", "seasonal_spike", "rolling_cv", "drop_after_spike")) + " from use",
    ensemble_flags="""select artist, title, date, (seasonal_spike > 1.8)::int as iso_bot, (spike_ratio > 1.8)::int as lof_bot,
  (seasonal_spike > 1.8 and spike_ratio > 1.8)::int as ensemble_bot from use""",
    live_daily=f"select * from daily where {CLOSED}",
    live_signals=f"""select artist, title, date, {rounded('pct_change', 'spike_ratio')}, round(seasonal_live, 6) as seasonal_spike, {rounded('rolling_cv')}
  from use where {CLOSED}""")
KNN = """e as (select vec_id as id, embedding::double[] as v from embeddings),
d as (select a.id as p, b.id as o, list_distance(a.v, b.v) as dist from e a join e b on a.id <> b.id),
k as (select * from (select *, row_number() over (partition by p order by dist, o) as rk from d) where rk <= {k})"""
LRD = KNN.replace("{k}", "20") + """,
kd as (select p, max(dist) as kdist from k group by p),
lrd as (select k.p, 1.0 / (avg(greatest(kd.kdist, k.dist)) + 1e-10) as lrd from k join kd on kd.p = k.o group by k.p)"""
PARTS = """e as (select min(p_partkey) as id, v from (select p_partkey, [p_size * 20.0::double, p_retailprice] as v from part) group by v)"""
FEATURE_KNN, FEATURE_LRD = (PARTS + x[x.index(",\nd as"):] for x in (KNN, LRD))
put(FEATURE_KNN.replace("{k}", "10"), knn_features="select p as id, rk as rank, o as neighbor, round(dist, 6) as distance from k")
put(FEATURE_LRD, lof_features="""select k.p as id, round(avg(b.lrd) / any_value(a.lrd), 6) as lof
  from k join lrd a on a.p = k.p join lrd b on b.p = k.o group by k.p""")
put(KNN.replace("{k}", "10"), knn_embeddings="select p as id, rk as rank, o as neighbor, round(dist, 6) as distance from k")
put(LRD, lof_embeddings="""select k.p as id, round(avg(b.lrd) / any_value(a.lrd), 6) as lof
  from k join lrd a on a.p = k.p join lrd b on b.p = k.o group by k.p""")
put(LRD + """,
nd as (select a.id as p, b.id as o, list_distance(list_reverse(a.v), b.v) as dist from e a join e b on true),
nk as (select * from (select *, row_number() over (partition by p order by dist, o) as rk from nd) where rk <= 20),
nl as (select nk.p, 1.0 / (avg(greatest(kd.kdist, nk.dist)) + 1e-10) as lrd from nk join kd on kd.p = nk.o group by nk.p)""",
    lof_novelty_embeddings="""select nk.p as id, round(avg(b.lrd) / any_value(a.lrd), 6) as lof
  from nk join nl a on a.p = nk.p join lrd b on b.p = nk.o group by nk.p""")

# Tables that are written and read again hold what they held; an empty text in a CSV file is NULL.
put(CHARTS, first_existing_source=f"select {CHART_COLS} from charts")
put(LABELED, labels_csv="select nullif(label, '') as label, artist, title from lab")
for read, written in (("published_results", "track_rollup"), ("incidents_csv", "incident_table"), ("report_json", "evaluate_documented_report")):
    ORACLE[read] = ORACLE[written]
ORACLE["genres_csv"] = "select n_name as artist, r_name as genre_category, r_name as genres from nation join region on n_regionkey = r_regionkey"
ORACLE["review_sheet_of_few_columns"] = f"""select label, artist, title, total_streams, bot_pct, flagged_days, '' as confidence, '' as flag_reasons, '' as note
from ({ORACLE["review_sheet"]})"""
ORACLE["artists_csv"] = f"select * replace (nullif(note, '') as note) from ({ORACLE['artist_rollup']})"


# ---- isolation forest: the same integers, grown level by level

def forest(source: str, key: list[str], features: list[str], trees: int, sample: int = 256, seed: int = 42, depth: int = 8) -> str:
    """CTEs: scaled (rid, x), node_0 .. node_8, nodes (the forest) and iso (rid, iso_score)."""
    n, prime = len(features), (1 << 31) - 1
    draw = lambda *parts: "('0x' || substr(md5(concat_ws(':', " + ", ".join(parts) + ")), 1, 8))::bigint"
    scaled = ", ".join(f"({f}::double - avg({f}::double) over ()) / coalesce(nullif(stddev_pop({f}::double) over (), 0), 1)" for f in features)
    digest = "md5(concat_ws('|', '" + str(seed) + "', " + ", ".join(f"coalesce({k}::varchar, '')" for k in key) + "))"
    out = f""",
scaled as materialized (select row_number() over () as rid, *, [{scaled}] as x from {source}),
pool as materialized (select x, row_number() over (order by h) as place from (select x, {digest} as h from scaled order by h limit {trees * sample})),
tree_draws as materialized (select t as tree, 1 + {draw(f"'{seed}'", 't::varchar', "'a'")} % {prime - 1} as a, {draw(f"'{seed}'", 't::varchar', "'b'")} % {prime} as b from range({trees}) r(t)),
rows_0 as materialized (select tree, 1::bigint as node, x from (select tree, x, row_number() over (partition by tree order by (a * place + b) % {prime}) as k from pool, tree_draws) where k <= {sample})"""
    for level in range(depth + 1):
        ends = ", ".join(f"min(x[{i + 1}])" for i in range(n)), ", ".join(f"max(x[{i + 1}])" for i in range(n))
        out += f""",
ends_{level} as materialized (select *, list_filter(range(1, {n + 1}), lambda f: hi[f] > lo[f]) as usable
  from (select tree, node, count(*) as size, [{ends[0]}] as lo, [{ends[1]}] as hi from rows_{level} group by tree, node)),
picked_{level} as materialized (select *, case when size > 1 and len(usable) > 0 and {level} < {depth}
  then usable[1 + {draw(f"'{seed}'", 'tree::varchar', 'node::varchar', "'feature'")} % len(usable)] end as f from ends_{level}),
node_{level} as materialized (select tree, node, f, size, {level} as depth, case when f is not null and p >= hi[f] then lo[f] else p end as split
  from (select *, case when f is not null then lo[f] + (hi[f] - lo[f]) * ({draw(f"'{seed}'", 'tree::varchar', 'node::varchar', "'split'")} / 4294967296.0::double) end as p from picked_{level}))"""
        if level < depth:
            out += f""",
rows_{level + 1} as materialized (select r.tree, 2 * r.node + case when r.x[n.f] <= n.split then 0 else 1 end as node, r.x
  from rows_{level} r join node_{level} n on r.tree = n.tree and r.node = n.node where n.f is not null)"""
    out += """,
nodes as materialized (""" + " union all ".join(f"select * from node_{i}" for i in range(depth + 1)) + ")"
    at = f"select rid, x, tree, 1::bigint as node from scaled, tree_draws"
    for level in range(depth):
        at = f"""select p.rid, p.x, p.tree, case when n.f is null then p.node else 2 * p.node + case when p.x[n.f] <= n.split then 0 else 1 end end as node
  from ({at}) p join nodes n on p.tree = n.tree and p.node = n.node"""
    mean = "case when {n} <= 1 then 0.0 when {n} = 2 then 1.0 else 2.0 * (ln({n} - 1.0) + 0.5772156649015329) - 2.0 * ({n} - 1.0) / {n} end"
    return out + f""",
iso as materialized (select rid, -pow(2, -round(sum(n.depth + {mean.format(n="n.size")}), 9) / ({trees} * (select {mean.format(n="size")} from node_0 limit 1))) as iso_score
  from ({at}) p join nodes n on p.tree = n.tree and p.node = n.node group by rid)"""


MODEL_FEATURES = ["streams", "pct_change", "spike_ratio", "seasonal_spike", "rolling_cv", "drop_after_spike"]
ORACLE["iforest_nodes"] = f"with {SIG}{forest('use', ['artist', 'title', 'date'], MODEL_FEATURES, 200)}" + """
select tree::int as tree, node::int as node, coalesce(f - 1, -1)::int as feature, round(coalesce(split, 0), 6) as split,
  case when f is null then -1 else 2 * node end::int as "left", case when f is null then -1 else 2 * node + 1 end::int as "right", size::int as size, depth::int as depth from nodes"""
ORACLE["iforest_scores"] = f"with {SIG}{forest('use', ['artist', 'title', 'date'], MODEL_FEATURES, 200)}" + """
select artist, title, date, round(iso_score, 6) as iso_score from scaled join iso using (rid)"""
SESSION_MODEL = f"with {SESSIONS}" + forest("sf", ["session_id"], ["completion_rate", "session_diversity", "repeat_count", "skipped", "odd_hour", "high_repeat"], 100) + """,
flagged_sessions as (select session_id, artist, iso_score - (select quantile_cont(iso_score, 0.05) from iso) as anomaly_score from scaled join iso using (rid))"""
ORACLE["session_anomaly"] = SESSION_MODEL + """
select session_id, artist, round(anomaly_score, 6) as anomaly_score, (anomaly_score < 0)::int as is_bot from flagged_sessions"""
ORACLE["session_anomaly_stats"] = SESSION_MODEL + f"""
select artist, total_streams, bot_streams, total_streams - bot_streams as real_streams, {r('bot_streams / total_streams * 100.0', 1)} as bot_percentage
from (select artist, count(*) as total_streams, sum((anomaly_score < 0)::int)::bigint as bot_streams from flagged_sessions group by artist)"""

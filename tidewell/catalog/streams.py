"""Streaming jobs over the test tables, each of which arrives in several slices."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from tidewell.catalog.corpus import chunk_sql, now
from tidewell.catalog.knowledge import STRAT_SQL, shown_strategies
from tidewell.catalog.logs import EV_SQL
from tidewell.catalog.registry import query
from tidewell.operators import library as L
from tidewell.plans.blocked import seq_block
from tidewell.session import fresh_path
from tidewell.streaming import jobs as J


def in_slices(t, name, order, run, n=3):
    """Feeds a table to ``run(stream)`` in ``n`` slices by ``order``, each after the one before was read; the last result."""
    rows = getattr(t, name)
    folder = fresh_path(t.spark, f"arriving-{name}")
    ends = rows.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    lo, width = ends["lo"] or 0, (ends["hi"] or 0) - (ends["lo"] or 0) + 1
    out = None
    for i in range(n):
        rows.where(F.floor((F.col(order) - lo) * n / width) == i).write.mode("append").parquet(folder)
        stream = J.stream_table(t.spark, folder)
        out = run(SimpleNamespace(spark=t.spark, **{name: stream}))
    return out


@query("k01_streaming_encounters", f"""with {EV_SQL},
dmg as (select log_id, enc_seq, sum(amount)::bigint as dmg from inside where kind = 'damage' group by 1, 2)
select log_id, enc_seq, enc_end_ms - enc_start_ms as duration_ms, coalesce(dmg, 0) as total_damage from bounds left join dmg using (log_id, enc_seq) where end_seq is not null""")
def k01(t):
    from tidewell.catalog.logs import log_events
    root = fresh_path(t.spark, "k01")
    totals, _ = in_slices(t, "events", "event_id", lambda s: J.stream_encounters(t.spark, log_events(s), root, lambda: seq_block("seq")))
    return totals.select("log_id", "enc_seq", "duration_ms", "total_damage")


@query("k01_streaming_abilities", f"""with {EV_SQL},
per as (select log_id, enc_seq, 'a' || (k % 5) as ability, sum(amount) filter (kind = 'damage')::bigint as damage, count(*) filter (kind = 'cast') as casts
        from inside group by all having count(*) filter (kind = 'damage') > 0) select * from per""")
def k01_abilities(t):
    from tidewell.catalog.logs import log_events
    root = fresh_path(t.spark, "k01")
    _, abilities = in_slices(t, "events", "event_id", lambda s: J.stream_encounters(t.spark, log_events(s), root, lambda: seq_block("seq")))
    return abilities.select("log_id", "enc_seq", "ability", "damage", "casts")


@query("k02_streaming_ingest", f"""with {chunk_sql("select url as key, html as text from pages")},
counts as (select key as url, count(*) as chunk_count from chunks group by 1)
select url, case when regexp_matches(html, '\\S') then sha256(html) else '' end as content_hash, 0 as change_count, 0.75::double as trust_score,
  coalesce(chunk_count, 0) as chunk_count from pages left join counts using (url)
qualify row_number() over (partition by url order by page_id desc) = 1""")
def k02(t):
    library = L.create_library(t.spark, fresh_path(t.spark, "k02"))

    def run(s):
        arriving = s.pages.select("url", F.col("url").alias("title"), F.lit("guide").alias("source_type"), F.col("html").alias("text"), F.col("page_id").alias("seq"))
        J.run_to_end(arriving, J.ingest_step(library, lambda b: now()), library.root)
        return library.sources()

    return in_slices(t, "pages", "page_id", run).select("url", "content_hash", "change_count", "trust_score", "chunk_count")


@query("k03_running_trust", """
select 'src' || (user_id % 20) as source, round(sum(case event_type when 'error' then -0.1::double when 'purchase' then 0.05::double else 0::double end), 6) as delta_sum, count(*) as n_events
from events group by 1""")
def k03(t):
    from tidewell.catalog.retrieval import trust_events
    root = fresh_path(t.spark, "k03")
    got = in_slices(t, "events", "event_id", lambda s: J.running_trust(t.spark, trust_events(s), root))
    return got.select("source", F.round("delta_sum", 6).alias("delta_sum"), "n_events")


@query("k04_running_strategies", f"with {STRAT_SQL} select * from st")
def k04(t):
    from tidewell.catalog.knowledge import uses
    root = fresh_path(t.spark, "k04")
    return shown_strategies(in_slices(t, "events", "event_id", lambda s: J.running_strategies(t.spark, uses(s), root)))

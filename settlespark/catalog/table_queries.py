"""Sources, projections, reshaping, joins and defects."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from settlespark.catalog import sql
from settlespark.catalog.registry import query, rounded
from settlespark.functions.features import CLASSIC, CURRENT
from settlespark.functions.scalar import box_muller
from settlespark.operators import joins as jo
from settlespark.operators import perturb as pe
from settlespark.operators import project as pr
from settlespark.operators import reshape as rs
from settlespark.operators.features import grouped_features, meta_table
from settlespark.operators.sequence import with_position
from settlespark.operators.settle import Rule, labels
from settlespark.plans.flows import classic_features_of_wide
from settlespark.plans.skew import checkpoint_dir
from settlespark.signals import Signals
from settlespark.sources import io
from settlespark.sources import tables as t


def _folder(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- sources and sinks -------------------------------------------------------

@query("s1_read_signals", f"""
SELECT user_id AS wave_id, event_id AS sample, {sql.r('value', 'value')} FROM events""")
def _(spark, sf):
    df = io.read_signals(spark, f"{sf}/events.parquet")
    return rounded(df.select(F.col("user_id").alias("wave_id"), F.col("event_id").alias("sample"), "value"))


_TRAIN = f"""
WITH {sql.EMBEDDINGS}
SELECT wave_id, sample, {sql.r('time_ms', 'time_ms')},
       CASE WHEN sample % 9 <> 4 THEN {sql.r('value', 'x').removesuffix(' AS x')} END AS value,
       CAST(0.5 AS DOUBLE) AS sd, CAST(-1 AS DOUBLE) AS low_limit, CAST(1 AS DOUBLE) AS high_limit
FROM d1"""


def _train_table(spark, sf):
    rows = t.embeddings(spark, sf)
    value = F.when(F.col("sample") % 9 != 4, F.col("value"))
    return rows.select(
        "wave_id", F.col("sample").cast("int").alias("sample"), "time_ms", value.alias("value"),
        F.lit(0.5).alias("sd"), F.lit(-1.0).alias("low_limit"), F.lit(1.0).alias("high_limit"),
    )


@query("s1_read_signals_csv", _TRAIN)
def _(spark, sf):
    path = _folder(spark, "train") + ".csv"
    io.write_table(_train_table(spark, sf), path, format="csv")
    return rounded(io.read_signals(spark, path))


@query("s1_read_signals_csv_scoring", f"""
WITH {sql.EMBEDDINGS}
SELECT wave_id, sample, {sql.r('time_ms', 'time')}, {sql.r('value', 'value')},
       CAST(-1 AS DOUBLE) AS low_limit, CAST(1 AS DOUBLE) AS high_limit
FROM d1""")
def _(spark, sf):
    path = _folder(spark, "scoring") + ".csv"
    rows = t.embeddings(spark, sf).select(
        "wave_id", F.col("sample").cast("int").alias("sample"), F.col("time_ms").alias("time"),
        "value", F.lit(-1.0).alias("low_limit"), F.lit(1.0).alias("high_limit"),
    )
    io.write_table(rows, path, format="csv")
    return rounded(io.read_signals(spark, path))


@query("s2_write_table", _TRAIN)
def _(spark, sf):
    path = _folder(spark, "train")
    io.write_table(_train_table(spark, sf), path)
    return rounded(io.read_signals(spark, path, io.TRAIN_SCHEMA))


@query("s2_write_bucketed", f"""
WITH {sql.D1P} SELECT wave_id, {sql.features(CURRENT)} FROM p GROUP BY wave_id""")
def _(spark, sf):
    name = f"waves_{uuid.uuid4().hex}"
    rows = t.embeddings(spark, sf).drop("label")
    io.write_bucketed(rows, name, _folder(spark, "bucketed"), buckets=8)
    return rounded(grouped_features(Signals(spark.table(name))))


@query("s4_run_outputs", f"""
WITH {sql.D2P}, {sql.settle('exit')}
SELECT wave_id, {sql.r('wait_time_ms', 'wait_time_ms')}, '20240102_090000' AS run_id FROM s""")
def _(spark, sf):
    path = _folder(spark, "labels")
    sig = t.price_signals(spark, sf)
    io.write_run(labels(sig), path, "20240101_090000")
    io.write_run(labels(sig, Rule("exit")), path, "20240102_090000")
    return rounded(io.read_run(spark, path, "20240102_090000"))


@query("s4_list_runs", f"""
WITH {sql.D2P}, {sql.settle()}
SELECT '20240101_090000' AS run_id, (SELECT count(*) FROM s) AS rows
UNION ALL SELECT '20240102_090000', (SELECT count(DISTINCT user_id) FROM events)""")
def _(spark, sf):
    """The finished runs with their rows; the second replaces one of another size."""
    path = _folder(spark, "runs")
    table = labels(t.price_signals(spark, sf))
    io.write_run(table, path, "20240101_090000")
    io.write_run(table, path, "20240102_090000")
    io.write_run(jo.distinct_ids(t.events(spark, sf)), path, "20240102_090000")
    return io.list_runs(spark, path).select("run_id", "rows")


_ROLES = f"""
WITH {sql.EVENTS}
SELECT wave_id, {sql.r('time_ms', 'time')}, {sql.r('value', 'value')}, kind FROM d3"""


@query("s5a_normalize_roles_alias", _ROLES)
def _(spark, sf):
    df = t.events(spark, sf).select(
        F.col("wave_id").alias("Wave"), F.col("time_ms").alias("T"), "kind",
        F.col("value").alias("Current"),
    )
    return rounded(pr.normalize_roles(df))


@query("s5a_normalize_roles_keeps_columns", f"""
WITH {sql.EVENTS}
SELECT wave_id, {sql.r('time_ms', 'time')}, {sql.r('value', 'value')},
       {sql.r('amount', 'value_other')} FROM d3""")
def _(spark, sf):
    df = t.events(spark, sf).select(
        "wave_id", "time_ms", F.col("value").alias("current"), F.col("amount").alias("value"),
    )
    return rounded(pr.normalize_roles(df))


@query("s5b_normalize_roles_preferred", _ROLES)
def _(spark, sf):
    df = t.events(spark, sf).select(
        "wave_id", F.col("time_ms").alias("time"), "kind", F.col("value").alias("current"),
    )
    return rounded(pr.normalize_roles(df, "preferred"))


# --- projections and filters -------------------------------------------------

@query("p1_drop_meta", f"""
WITH {sql.PRICES} SELECT wave_id, order_key, line_no, {sql.r('value', 'value')} FROM d2""")
def _(spark, sf):
    df = t.prices(spark, sf).select(
        "wave_id", "order_key", "line_no", "value", F.col("price").alias("force_mA"),
        F.col("quantity").alias("range_V"),
    )
    return rounded(pr.drop_meta(df, keep=["wave_id"]))


@query("p2_drop_unlabelled", f"""
WITH {sql.EVENTS} SELECT event_id, {sql.r('amount', 'wait_time_ms')} FROM d3
WHERE kind <> 'view' AND amount >= 10""")
def _(spark, sf):
    label = F.when(F.col("kind") != "view", F.when(F.col("amount") < 10, F.lit(float("nan")))
                   .otherwise(F.col("amount")))
    df = t.events(spark, sf).select("event_id", label.alias("wait_time_ms"))
    return rounded(pr.drop_unlabelled(df))


@query("p3_front_columns", f"""
WITH {sql.SUPPLIER_LINE}
SELECT wave_id, {sql.r('wait_time_ms', 'wait_time_ms')}, {sql.r('x', 'x')} FROM d7""")
def _(spark, sf):
    df = t.supplier_line(spark, sf).select("x", "wait_time_ms", "wave_id")
    return rounded(pr.front_columns(df, "wave_id", "wait_time_ms"))


# Wide tables are compared in long form, so that no query has a width.

def _wide(spark, sf, **options):
    return rs.to_wide(Signals(t.embeddings(spark, sf)), **options)


def _unpivoted(wide, **options):
    """The samples of a wide table as rows, beside its other columns."""
    return rs.to_long(wide, **options).join(rs.non_series_columns(wide), "wave_id")


_LONG = f"SELECT wave_id, sample, {sql.r('value', 'value')} FROM d1"
_LONG_P = f"SELECT wave_id, pos AS sample, {sql.r('value', 'value')} FROM p"
# every wave with every sample number that occurs
_FILLED = """
filled AS (SELECT w.wave_id, s.pos AS sample, coalesce(p.value, CAST(0 AS DOUBLE)) AS value
           FROM (SELECT DISTINCT wave_id FROM p) AS w CROSS JOIN (SELECT DISTINCT pos FROM p) AS s
           LEFT JOIN p ON p.wave_id = w.wave_id AND p.pos = s.pos)"""


@query("p4_non_series_columns", "SELECT vec_id AS wave_id, CAST(label AS BIGINT) AS label FROM embeddings")
def _(spark, sf):
    sig = Signals(t.embeddings(spark, sf))
    return rounded(rs.non_series_columns(rs.wide_with_meta(sig, label="none")))


@query("p5_fill_series_zero", f"""
WITH {sql.D3P}, {_FILLED} SELECT wave_id, sample, {sql.r('value', 'value')} FROM filled""")
def _(spark, sf):
    return rounded(_unpivoted(rs.fill_series(_ragged_wide(spark, sf))))


def _ragged(spark, sf, **columns):
    """The event waves with a sample number."""
    df = with_position(t.event_signals(spark, sf), pos="sample").drop("n")
    return Signals(df.withColumns(columns) if columns else df)


def _ragged_wide(spark, sf):
    return rs.to_wide(_ragged(spark, sf))


_GAPS = f"""
{sql.EMBEDDINGS}, gaps AS (
  SELECT wave_id, sample, time_ms, value FROM d1 WHERE (sample + wave_id) % 5 <> 2)"""


def _gaps(spark, sf):
    gone = F.when((F.col("sample") + F.col("wave_id")) % 2 == 0, F.lit(float("nan")))
    value = F.when((F.col("sample") + F.col("wave_id")) % 5 == 2, gone).otherwise(F.col("value"))
    return t.embeddings(spark, sf).withColumn("value", value).drop("label")


@query("p6_drop_missing_samples", f"""
WITH {_GAPS}, {sql.positions('gaps', 'sample')}
SELECT wave_id, sample, pos, n, {sql.r('value', 'value')} FROM p""")
def _(spark, sf):
    df = with_position(Signals(_gaps(spark, sf), missing="skip"))
    return rounded(df.drop("time_ms"))


@query("p6_features_skip_missing", f"""
WITH {_GAPS}, {sql.positions('gaps', 'sample')}
SELECT wave_id, {sql.features(CURRENT)} FROM p GROUP BY wave_id""")
def _(spark, sf):
    return rounded(grouped_features(Signals(_gaps(spark, sf), missing="skip")))


@query("p12_rename_series", f"WITH {sql.EMBEDDINGS} {_LONG}")
def _(spark, sf):
    return rounded(_unpivoted(_wide(spark, sf, on_duplicate="max")))


# --- reshape -----------------------------------------------------------------

@query("r1_to_wide", f"WITH {sql.EMBEDDINGS} {_LONG}")
def _(spark, sf):
    return rounded(_unpivoted(_wide(spark, sf)))


@query("r1_to_wide_ragged", f"WITH {sql.D3P} {_LONG_P}")
def _(spark, sf):
    return rounded(_unpivoted(_ragged_wide(spark, sf)))


@query("r1_to_wide_selected", f"WITH {sql.D3P} {_LONG_P} WHERE pos IN (0, 3, 60)")
def _(spark, sf):
    return rounded(_unpivoted(rs.to_wide(_ragged(spark, sf), [0, 3, 60], select=True)))


@query("r1_to_dense_long_waves", """
SELECT l_linenumber AS wave_id, l_orderkey AS sample, round(max(l_extendedprice), 6) AS value
FROM lineitem GROUP BY 1, 2""")
def _(spark, sf):
    # some waves with more samples than a table has columns
    rows = t.table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("wave_id"), F.col("l_orderkey").alias("sample"),
        F.col("l_extendedprice").alias("value"))
    dense = rs.to_dense(Signals(rows), on_duplicate="max").select("wave_id", "segment", F.posexplode("values").alias("at", "value"))
    return rounded(dense.filter(F.col("value").isNotNull()).select(
        "wave_id", (F.col("segment") * rs.SEGMENT + F.col("at")).alias("sample"), "value"))


@query("r1b_duplicate_samples", """
SELECT user_id AS wave_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS sample,
       count(*) AS n
FROM events GROUP BY 1, 2 HAVING count(*) > 1""")
def _(spark, sf):
    rows = t.table(spark, sf, "events").select(
        F.col("user_id").alias("wave_id"),
        F.datediff("ts", F.lit("2024-01-01")).alias("sample"), "value",
    )
    return rounded(rs.duplicate_samples(Signals(rows)))


def _chunks(chunk: int) -> str:
    return f"""
WITH {sql.EMBEDDINGS}
SELECT wave_id, CAST(sample // {chunk} AS BIGINT) AS part,
       array_to_string(list(CAST(floor(value * CAST(100000 AS DOUBLE)) AS BIGINT) ORDER BY sample), ',')
         AS values
FROM d1 GROUP BY ALL"""


def _text(df):
    whole = F.transform("values", lambda x: F.floor(x * F.lit(100000.0)).cast("string"))
    return df.withColumn("values", F.array_join(whole, ","))


@query("r2_to_array", _chunks(rs.CHUNK))
def _(spark, sf):
    return _text(rs.to_array(Signals(t.embeddings(spark, sf))))


@query("r2_to_array_parts", _chunks(20))
def _(spark, sf):
    return _text(rs.to_array(Signals(t.embeddings(spark, sf)), chunk=20))


@query("r3_to_long", f"WITH {sql.EMBEDDINGS} {_LONG}")
def _(spark, sf):
    return rounded(rs.to_long(_wide(spark, sf)))


@query("r3_to_long_ragged", f"WITH {sql.D3P} {_LONG_P}")
def _(spark, sf):
    return rounded(rs.to_long(_ragged_wide(spark, sf)))


@query("r4_wide_plus_features", f"""
WITH {sql.D3P}, {_FILLED},
f AS (SELECT wave_id, min_by(kind, pos) AS kind, {sql.features(CURRENT)} FROM p GROUP BY wave_id)
SELECT sample, {sql.r('value', 'value')}, f.* FROM filled JOIN f USING (wave_id)""")
def _(spark, sf):
    sig = _ragged(spark, sf)
    sig = sig.replace(sig.df.drop("event_id", "amount"))
    return rounded(_unpivoted(rs.wide_plus_features(sig)))


@query("r4_classic_features_of_wide", f"""
WITH {sql.D3P}, {sql.settle('suffix')},
f AS (SELECT wave_id, {sql.features(tuple(c for c in CLASSIC if c != 'settle_idx'))}
      FROM p GROUP BY wave_id)
SELECT f.*, CAST(settle_idx AS BIGINT) AS settle_idx FROM f JOIN s USING (wave_id)""")
def _(spark, sf):
    return rounded(classic_features_of_wide(_ragged_wide(spark, sf)))


@query("x4_wide_with_label", f"""
WITH {sql.EMBEDDINGS}
SELECT wave_id, sample, {sql.r('value', 'value')}, CAST(label AS BIGINT) AS wait_time_ms FROM d1""")
def _(spark, sf):
    sig = Signals(t.embeddings(spark, sf).withColumnRenamed("label", "wait_time_ms"))
    return rounded(_unpivoted(rs.wide_with_meta(sig)))


@query("x5_wide_with_time_meta", f"""
WITH {sql.D3P}
SELECT wave_id, pos AS sample, {sql.r('value', 'value')},
       {sql.r('min(time_ms) OVER (PARTITION BY wave_id)', 'time_ms')} FROM p""")
def _(spark, sf):
    sig = _ragged(spark, sf)
    sig = sig.replace(sig.df.drop("event_id", "amount", "kind"))
    return rounded(_unpivoted(rs.wide_with_meta(sig, exclude=())))


# --- joins -------------------------------------------------------------------

@query("j1_attach_meta", f"""
WITH {sql.EMBEDDINGS}
SELECT wave_id, sample, {sql.r('value', 'value')}, CAST(label AS BIGINT) AS label FROM d1""")
def _(spark, sf):
    sig = Signals(t.embeddings(spark, sf))
    return rounded(_unpivoted(rs.attach_meta(_wide(spark, sf), meta_table(sig, ["label"]))))


@query("j2_append_features", f"""
WITH {sql.D2P}, f AS (SELECT wave_id, {sql.features(CURRENT)} FROM p GROUP BY wave_id)
SELECT s_suppkey AS wave_id, s_name, f.* EXCLUDE (wave_id)
FROM supplier LEFT JOIN f ON f.wave_id = s_suppkey""")
def _(spark, sf):
    meta = t.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("wave_id"), "s_name")
    return rounded(rs.append_features(meta, grouped_features(t.price_signals(spark, sf))))


@query("j6_disjoint_ids", """
SELECT DISTINCT l_suppkey AS wave_id FROM lineitem
WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 3000)""")
def _(spark, sf):
    chosen = t.table(spark, sf, "supplier").filter(F.col("s_acctbal") < 3000)
    return jo.disjoint_ids(t.prices(spark, sf), chosen.select(F.col("s_suppkey").alias("wave_id")))


@query("l4_distinct_ids", "SELECT DISTINCT user_id AS wave_id FROM events")
def _(spark, sf):
    return jo.distinct_ids(t.events(spark, sf))


@query("l5_first_ids", "SELECT DISTINCT user_id AS wave_id FROM events ORDER BY 1 LIMIT 12")
def _(spark, sf):
    return jo.first_ids(t.events(spark, sf), 12)


@query("l7_set_difference", """
SELECT DISTINCT l_partkey AS wave_id FROM lineitem
WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)""")
def _(spark, sf):
    items = t.table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "wave_id")
    return jo.disjoint_ids(items, items.filter(F.col("l_quantity") >= 50))


# --- controlled defects ------------------------------------------------------

def _key(id: str) -> str:
    return f"({id} * 7919 + 42) % 10007"


@query("a1_sample_ids", f"""
SELECT wave_id FROM (SELECT DISTINCT l_suppkey AS wave_id FROM lineitem)
ORDER BY {_key('wave_id')}, wave_id LIMIT 10""")
def _(spark, sf):
    return pe.sample_ids(t.prices(spark, sf), 10, 42, key=F.expr(_key("wave_id")))


@query("a1_sample_ids_hashed", """
SELECT wave_id FROM (SELECT DISTINCT l_suppkey AS wave_id FROM lineitem)
ORDER BY md5(wave_id::VARCHAR || ':42'), wave_id LIMIT 10""")
def _(spark, sf):
    key = F.md5(F.concat(F.col("wave_id").cast("string"), F.lit(":42")))
    return pe.sample_ids(t.prices(spark, sf), 10, 42, key=key)


@query("a2_disjoint_groups", f"""
WITH ids AS (SELECT DISTINCT user_id AS wave_id FROM events),
ranked AS (SELECT wave_id, row_number() OVER (ORDER BY {_key('wave_id')}, wave_id) AS k FROM ids)
SELECT wave_id, CASE WHEN k <= 7 THEN 'first' ELSE 'second' END AS grp FROM ranked WHERE k <= 14""")
def _(spark, sf):
    first, second = pe.disjoint_groups(t.events(spark, sf), 7, 42, key=F.expr(_key("wave_id")))
    return first.withColumn("grp", F.lit("first")).unionByName(
        second.withColumn("grp", F.lit("second"))
    )


_CHOSEN = f"""
chosen AS (SELECT wave_id FROM (SELECT DISTINCT wave_id FROM p)
           ORDER BY {_key('wave_id')}, wave_id LIMIT 7)"""


@query("a3_inject_late_oscillation", f"""
WITH {sql.D3P}, {_CHOSEN}
SELECT wave_id, event_id, {sql.r(f'''CASE
         WHEN wave_id IN (SELECT wave_id FROM chosen)
              AND pos >= floor(n * CAST('0.6' AS DOUBLE))
         THEN value + CAST(3 AS DOUBLE) * sin(CAST('{2 * math.pi!r}' AS DOUBLE)
              * CAST('0.0001' AS DOUBLE) * (time_ms / CAST(1000 AS DOUBLE)))
         ELSE value END''', 'value')}
FROM p""")
def _(spark, sf):
    sig = t.event_signals(spark, sf)
    ids = pe.sample_ids(sig.df, 7, 42, key=F.expr(_key("wave_id")))
    df = pe.inject_late_oscillation(sig, ids, F.lit(3.0), F.lit(0.0001))
    return rounded(df.select("wave_id", "event_id", "value"))


@query("a4_truncate_waves", f"""
WITH {sql.D3P}, {_CHOSEN}
SELECT wave_id, event_id, {sql.r('value', 'value')} FROM p
WHERE wave_id NOT IN (SELECT wave_id FROM chosen) OR pos < floor(n * CAST('0.7' AS DOUBLE))""")
def _(spark, sf):
    sig = t.event_signals(spark, sf)
    ids = pe.sample_ids(sig.df, 7, 42, key=F.expr(_key("wave_id")))
    df = pe.truncate_waves(sig, ids, F.lit(0.7))
    return rounded(df.select("wave_id", "event_id", "value"))


# The numbers for the noise come from the event id by arithmetic, so that SQL has them too.
_UNIT = "CAST((event_id * {0} + {1}) % {2} AS DOUBLE) / CAST({2} AS DOUBLE)"
_NOISY = (
    "value + CAST('0.5' AS DOUBLE) * (sqrt(CAST(-2 AS DOUBLE) * ln(CAST(1 AS DOUBLE) - a))"
    f" * cos(CAST('{2 * math.pi!r}' AS DOUBLE) * b))"
)


@query("a5_add_noise", f"""
WITH {sql.EVENTS},
u AS (SELECT *, {_UNIT.format(7919, 1, 10007)} AS a, {_UNIT.format(104729, 2, 10009)} AS b FROM d3)
SELECT wave_id, event_id, {sql.r(_NOISY, 'value')} FROM u""")
def _(spark, sf):
    def unit(a: int, b: int, c: int):
        return F.pmod(F.col("event_id") * a + b, F.lit(c)).cast("double") / F.lit(float(c))
    normal = box_muller(unit(7919, 1, 10007), unit(104729, 2, 10009))
    df = pe.add_noise(t.event_signals(spark, sf), 0.5, seed=7, normal=normal)
    return rounded(df.select("wave_id", "event_id", "value"))


@query("a6_limit_band", f"""
WITH {sql.EMBEDDINGS}
SELECT wave_id, sample, {sql.r("value - CAST('0.25' AS DOUBLE) / 2", 'low_limit')},
       {sql.r("value + CAST('0.25' AS DOUBLE) / 2", 'high_limit')}
FROM d1""")
def _(spark, sf):
    df = pe.limit_band(t.embeddings(spark, sf), "value", F.lit(0.25))
    return rounded(df.select("wave_id", "sample", "low_limit", "high_limit"))

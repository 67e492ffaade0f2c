"""Queries over the driver's tables, one or more for each operator, with SQL where it can tell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions import labels, metrics, timeindex, vectors, windows
from framelake.operators import centroids, encoders, integrity, linalg
from framelake.operators.dataset import WindowedDataset
from framelake.plans.tables import FRAMES_SQL, frames, table
from framelake.schema import recording_fields
from framelake.sources import catalog
from framelake.streaming import recorder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def r6(c) -> F.Column:
    return F.round(c, 6)


# frames and windows -------------------------------------------------------------------------


@query(f"WITH {FRAMES_SQL} SELECT recording_id, CAST(frame_idx AS BIGINT) AS frame_idx, round(ts_s, 6) AS ts_s, value, k FROM f")
def frames_from_events(spark, d):
    return frames(spark, d).select("recording_id", "frame_idx", r6("ts_s").alias("ts_s"), "value", "k")


def _window_query(size, stride, start=0, stop=None, drop_last=False):
    def run(spark, d):
        rows = windows.windows(frames(spark, d), size, stride, start, stop, drop_last)
        return rows.groupBy("recording_id", "window", "window_start").agg(
            F.count(F.lit(1)).alias("n_frames"), F.min("ts_s").alias("first_s"), F.max("ts_s").alias("last_s"),
            r6(F.avg("value")).alias("mean_value")
        )

    end = "n" if stop is None else f"least(n, {stop})"
    count = f"CASE WHEN span < {size} THEN 0 ELSE (span - {size}) // {stride} + 1 END" if drop_last else f"(span + {stride - 1}) // {stride}"
    sql = f"""WITH {FRAMES_SQL}, r AS (SELECT recording_id, greatest({end} - {start}, 0) AS span FROM (SELECT recording_id, count(*) AS n
  FROM f GROUP BY 1)),
    w AS (SELECT recording_id, unnest(range(0, {count})) AS j, span FROM r)
    SELECT w.recording_id, CAST(j AS BIGINT) AS "window", CAST(j * {stride} + {start} AS BIGINT) AS window_start, CAST(count(*) AS BIGINT) AS n_frames, min(ts_s) AS first_s, max(ts_s) AS last_s, round(avg(value), 6) AS mean_value
    FROM w
  JOIN f ON f.recording_id = w.recording_id AND f.frame_idx >= j * {stride} + {start} AND f.frame_idx < least(j * {stride} + {size}, span) + {start}
  GROUP BY ALL"""
    return run, sql


for _name, _args in {
    "tumbling_frame_windows": (16, 16),
    "sliding_frame_windows": (16, 8),
    "gapped_frame_windows": (8, 12),
    "windows_drop_last": (16, 8, 0, None, True),
    "windows_bounded": (10, 7, 5, 40, False),
}.items():
    QUERIES[_name], SQL[_name] = _window_query(*_args)


def _lengths(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("user_id").alias("recording_id")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT user_id AS recording_id, CAST(count(*) AS BIGINT) AS n, CAST(ceil(count(*) / 8.0) AS BIGINT) AS sliding,
  CAST(CASE WHEN count(*) < 16 THEN 0 ELSE (count(*) - 16) // 8 + 1 END AS BIGINT) AS complete, CAST(ceil(greatest(least(count(*), 40) - 5, 0) / 7.0) AS BIGINT) AS bounded
  FROM events GROUP BY 1""")
def window_counts(spark, d):
    n = F.col("n")
    return _lengths(spark, d).select(
        "recording_id", "n", windows.window_count(n, 16, 8).alias("sliding"),
        windows.window_count(n, 16, 8, drop_last=True).alias("complete"), windows.window_count(n, 10, 7, 5, 40).alias("bounded")
    )


@query("SELECT CAST(sum(CAST(ceil(n / 8.0) AS BIGINT)) AS BIGINT) AS n_windows FROM (SELECT count(*) AS n FROM events GROUP BY user_id)")
def total_windows(spark, d):
    return _lengths(spark, d).agg(F.sum(windows.window_count(F.col("n"), 16, 8)).alias("n_windows"))


@query("""SELECT recording_id, n_windows, CAST(coalesce(sum(n_windows) OVER (ORDER BY recording_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_index
  FROM (SELECT user_id AS recording_id, CAST(ceil(count(*) / 8.0) AS BIGINT) AS n_windows FROM events GROUP BY 1)""")
def window_locate(spark, d):
    return windows.locate(_lengths(spark, d).select("recording_id", windows.window_count(F.col("n"), 16, 8).alias("n_windows")), "recording_id")


@query(f"""WITH {FRAMES_SQL}, r AS (SELECT recording_id, count(*) AS n, min(event_type) AS label FROM f GROUP BY 1), c AS (SELECT *, dense_rank() OVER (ORDER BY label) AS y, (n + 7) // 8 AS n_windows FROM r),
  g AS (SELECT *, coalesce(sum(n_windows) OVER (ORDER BY recording_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
  FROM c), w AS (SELECT *, unnest(range(0, n_windows)) AS j FROM g)
  SELECT CAST(first + j AS BIGINT) AS "index", w.recording_id, CAST(j AS BIGINT) AS "window", CAST(y AS BIGINT) AS y, CAST(count(*) AS BIGINT) AS n_frames, round(sum(value), 4) AS total
  FROM w JOIN f ON f.recording_id = w.recording_id AND frame_idx >= j * 8 AND frame_idx < j * 8 + 16 GROUP BY 1, 2, 3, 4""")
def labelled_windows(spark, d):
    """Windows of all recordings with their global index and their label's class."""
    f = frames(spark, d).withColumn("values", F.array("value"))
    recordings = f.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n_frames"), F.min("event_type").alias("label"))
    rows = WindowedDataset(f, recordings, 16, 8).windows()
    return rows.select(
        "index", "recording_id", "window", "y", F.size("x").cast("long").alias("n_frames"),
        F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v[0]), 4).alias("total")
    )


@query(
    f"""
    WITH {FRAMES_SQL}
    SELECT recording_id, CAST(frame_idx // 16 AS BIGINT) AS "window", min(ts_s) AS first_s, max(ts_s) AS last_s, sha256(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY frame_idx)) AS checksum
    FROM f GROUP BY 1, 2
    """
)
def window_timestamps(spark, d):
    rows = windows.windows(frames(spark, d), 16)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "event_id"))), lambda e: e["event_id"].cast("string")), ",")
    return rows.groupBy("recording_id", "window").agg(
        F.min("ts_s").alias("first_s"), F.max("ts_s").alias("last_s"), F.sha2(ids, 256).alias("checksum")
    )


@query(
    f"""
    WITH {FRAMES_SQL}, q AS (SELECT DISTINCT recording_id, t AS time_s FROM f, (VALUES (0.0), (3600.5), (86400.0), (1e9)) v(t))
    SELECT recording_id, CAST(time_s AS DOUBLE) AS time_s, CAST(arg_min(frame_idx, (abs(ts_s - time_s), frame_idx)) AS BIGINT) AS frame_idx
    FROM f JOIN q USING (recording_id) GROUP BY 1, 2
    """
)
def frame_index_at_timestamps(spark, d):
    f = frames(spark, d)
    lookups = f.select("recording_id").distinct().select("recording_id", F.explode(F.array(*map(F.lit, (0.0, 3600.5, 86400.0, 1e9)))).alias("time_s"))
    return timeindex.nearest_frame(f, lookups)


@query(
    """
    SELECT user_id AS recording_id, CAST(t AS DOUBLE) AS time_s, CAST(greatest(0, least(CAST(round_even(t * 30, 0) AS BIGINT), count(*) - 1)) AS BIGINT) AS frame_idx
    FROM events, (VALUES (0.0), (0.05), (0.0833), (1.01), (99.0)) v(t) GROUP BY 1, 2, t
    """
)
def frame_index_at_rate(spark, d):
    rows = _lengths(spark, d).select("recording_id", "n", F.explode(F.array(*map(F.lit, (0.0, 0.05, 0.0833, 1.01, 99.0)))).alias("time_s"))
    return rows.select("recording_id", "time_s", timeindex.frame_at_rate(F.col("time_s"), F.lit(30), F.col("n")).alias("frame_idx"))


@query(f"WITH {FRAMES_SQL} SELECT recording_id, CAST(frame_idx AS BIGINT) AS frame_idx, value FROM f WHERE frame_idx >= 10 AND frame_idx < 20")
def frame_slice(spark, d):
    return timeindex.slice_of(frames(spark, d), 10, 20).select("recording_id", "frame_idx", "value")


@query(f"WITH {FRAMES_SQL} SELECT recording_id, CAST(frame_idx AS BIGINT) AS frame_idx, value, k FROM f WHERE frame_idx = 7")
def frame_at(spark, d):
    return timeindex.frame(frames(spark, d), 7).select("recording_id", "frame_idx", "value", "k")


@query(
    f"""
    WITH {FRAMES_SQL} SELECT recording_id, CAST(frame_idx AS BIGINT) AS frame_idx, ts_s AS t, k AS c0, value AS c1, k AS c2 FROM f
    WHERE frame_idx < 30
    """
)
def signal_trace(spark, d):
    rows = timeindex.trace(frames(spark, d).withColumn("values", F.array("value", "k")), [1, 0, -1], 30)
    return rows.select("recording_id", "frame_idx", "t", *(F.get("picked", F.lit(i)).alias(f"c{i}") for i in range(3)))


@query(
    f"""
    WITH {FRAMES_SQL} SELECT recording_id, CAST(c AS INTEGER) AS channel, CASE c WHEN 0 THEN value ELSE k END AS x
    FROM f, (VALUES (0), (1)) v(c) WHERE frame_idx = 3
    """
)
def frame_signals(spark, d):
    return timeindex.signals(frames(spark, d).withColumn("values", F.array("value", "k")), 3)


@query(
    f"""
    WITH {FRAMES_SQL}
    SELECT recording_id, CAST(frame_idx AS BIGINT) AS frame_idx, round(coalesce((abs(value - lag(value) OVER w) + abs(k - lag(k) OVER w)) / 2, 0), 6) AS change
    FROM f WINDOW w AS (PARTITION BY recording_id ORDER BY frame_idx)
    """
)
def lag_diff(spark, d):
    f = frames(spark, d).withColumn("v", F.array("value", "k"))
    before = F.lag("v").over(integrity.lag_window())
    return f.select("recording_id", "frame_idx", r6(metrics.change(F.col("v"), before)).alias("change"))


@query(
    f"""
    WITH {FRAMES_SQL}
    SELECT recording_id, CAST(frame_idx AS BIGINT) AS frame_idx, round(value - first_value(value) OVER (PARTITION BY recording_id ORDER BY frame_idx), 6) AS shift
    FROM f
    """
)
def baseline_diff(spark, d):
    return frames(spark, d).select("recording_id", "frame_idx", r6(F.col("value") - F.first("value").over(integrity.lag_window())).alias("shift"))


@query(
    f"""
    WITH {FRAMES_SQL}, n AS (SELECT recording_id, greatest(1, count(*) // 4) AS size FROM f GROUP BY 1)
    SELECT recording_id, CAST(frame_idx // size AS BIGINT) AS segment, CAST(count(*) AS BIGINT) AS n_frames, round(avg(value), 6) AS mean_value
    FROM f JOIN n USING (recording_id) WHERE frame_idx // size < 4 GROUP BY 1, 2
    """,
    "segments",
)
def segments_(spark, d):
    n = F.count(F.lit(1)).over(Window.partitionBy("recording_id"))
    return (
        windows.segments(frames(spark, d).withColumn("n", n), F.col("n"), 4)
        .groupBy("recording_id", "segment")
        .agg(F.count(F.lit(1)).alias("n_frames"), r6(F.avg("value")).alias("mean_value"))
    )


@query(
    f"""
    WITH {FRAMES_SQL}
    SELECT recording_id, count(*) AS n_frames, round(max(ts_s) - min(ts_s), 6) AS duration_s, bool_or(ts_s IS NOT NULL) AS has_timestamps
    FROM f GROUP BY 1
    """
)
def recording_durations(spark, d):
    facts = (
        frames(spark, d)
        .groupBy("recording_id")
        .agg(F.count(F.lit(1)).alias("n_frames"), F.count("ts_s").alias("n"), F.min("ts_s").alias("first"), F.max("ts_s").alias("last"))
    )
    ends = F.when(F.col("n") > 1, F.array("first", "last")).otherwise(F.array().cast("array<double>"))
    return facts.select(
        "recording_id", "n_frames", r6(timeindex.duration_s(ends, F.col("n_frames"), F.lit(30.0))).alias("duration_s"),
        (F.col("n") > 0).alias("has_timestamps")
    )


# labels ------------------------------------------------------------------------------------


@query("SELECT event_type, CAST(('0x' || substr(sha256(event_type), 1, 8)) AS BIGINT) AS code, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def label_hash_encode(spark, d):
    return (
        table(spark, d, "events")
        .groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("event_type", labels.hash_code(F.col("event_type")).alias("code"), "n")
    )


@query(
    """
    SELECT doc_id, lang, CAST(CASE WHEN lang IS NULL THEN 0 ELSE dense_rank() OVER (ORDER BY lang NULLS LAST) END AS BIGINT) AS class
    FROM documents
    """
)
def label_dictionary(spark, d):
    return labels.dictionary_encode(table(spark, d, "documents").select("doc_id", "lang"), "lang").select("doc_id", "lang", "class")


@query(
    """
    SELECT doc_id, q AS quality, CAST(CASE WHEN q IS NULL THEN 0 ELSE dense_rank() OVER (ORDER BY q NULLS LAST) END AS BIGINT) AS class
    FROM (SELECT d.doc_id, CAST(quality AS VARCHAR) AS q FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
    """
)
def label_dictionary_nulls(spark, d):
    rows = (
        table(spark, d, "documents")
        .select("doc_id")
        .join(table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("quality")), "doc_id", "left")
    )
    return labels.dictionary_encode(rows, "quality").select("doc_id", "quality", "class")


@query(
    """
    SELECT d.doc_id, coalesce(CASE WHEN toxic = 1 THEN 'toxic' END, nullif(source, ''), 'unknown') AS label FROM documents d LEFT
    JOIN labels l ON l.doc_id = d.doc_id
    """
)
def record_label_fallback(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return rows.select(
        "doc_id",
        labels.fallback(F.when(F.col("toxic") == 1, F.lit("toxic")).when(F.col("toxic") == 0, F.lit("")), F.col("source")).alias("label")
    )


@query(
    """
    SELECT event_id, event_type, value
    FROM (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn
    FROM events) WHERE rn <= 3
    """
)
def top_per_label(spark, d):
    return centroids.best_rows(
        table(spark, d, "events").select("event_id", "event_type", "value"), "event_type", [F.desc("value"), F.asc("event_id")], 3
    )


# catalog -----------------------------------------------------------------------------------


def _episodes(spark, d) -> DataFrame:
    """Documents as episodes: language for sensor, source for modality, quality for material."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    known = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("material"))
    return docs.join(known, "doc_id", "left").select(
        "doc_id", F.col("lang").alias("sensor_type"), F.col("source").alias("modality"), "material",
        F.col("n_chars").alias("size_bytes")
    )


_EPISODES_SQL = "e AS (SELECT d.doc_id, lang AS sensor_type, source AS modality, CAST(quality AS VARCHAR) AS material, n_chars AS size_bytes FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"


def _as_recordings(rows: DataFrame, **columns: F.Column) -> DataFrame:
    """Rows in the shape of recordings; columns that aren't given are null."""
    out = []
    for part in recording_fields():
        given = columns.get(part.name)
        out.append((F.lit(None) if given is None else given).cast(part.dataType).alias(part.name))
    return rows.select(*out)


def _struct(kind: str, **given: F.Column) -> F.Column:
    """A struct of one of the schema's kinds with some of its fields; others are null."""
    fields = next(f for f in recording_fields() if f.name == kind).dataType.fields
    return F.struct(*((given[f.name] if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


@query("""SELECT conv_id, CAST(count(*) AS BIGINT) AS n_frames, CAST(sum(length(text)) AS BIGINT) AS size_bytes, arg_min(role, turn) AS first_role,
  CAST(count(DISTINCT role) AS BIGINT) AS n_roles, CAST(count(*) / 2.0 AS DOUBLE) AS duration_s, false AS has_timestamps, CAST(count(*) AS VARCHAR) || '×1' AS shape_str
  FROM conversations GROUP BY 1""")
def episode_summary(spark, d):
    """Conversations as recordings of turns, two a second, summarised."""
    rows = (
        table(spark, d, "conversations")
        .groupBy("conv_id")
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("bytes"), F.min_by("role", "turn").alias("first"),
            F.collect_set("role").alias("roles")
        )
    )
    recordings = _as_recordings(
        rows, path=F.col("conv_id"), n_frames=F.col("n"), size_bytes=F.col("bytes"), sampling_rate_hz=F.lit(2.0), shape=F.array(F.col("n"), F.lit(1)), sensor=_struct("sensor", type=F.col("first")), labels=_struct("labels", custom_tags=F.col("roles"))
    )
    kind = dict(rows.dtypes)["conv_id"]
    return catalog.summary(recordings).select(
        F.col("path").cast(kind).alias("conv_id"), "n_frames", "size_bytes", F.col("sensor_type").alias("first_role"),
        F.size("custom_tags").cast("long").alias("n_roles"), "duration_s", "has_timestamps", "shape_str"
    )


@query(f"""WITH {_EPISODES_SQL} SELECT CAST(doc_id AS VARCHAR) AS name, sensor_type, modality, material, n_frames, 100.0::DOUBLE AS sampling_rate_hz, round(n_frames / 100.0, 3) AS duration_s, round(size_bytes / 1e6, 2) AS size_mb, false AS has_unified, modality || '/' || doc_id AS path
  FROM (SELECT *, CAST(size_bytes AS BIGINT) AS n_frames FROM e)""")
def gallery(spark, d):
    """Documents as recordings of characters, 100 a second, in the gallery."""
    rows = _episodes(spark, d)
    recordings = _as_recordings(
        rows, path=F.concat_ws("/", "modality", F.col("doc_id").cast("string")), modality=F.col("modality"), n_frames=F.col("size_bytes"), size_bytes=F.col("size_bytes"), sampling_rate_hz=F.lit(100.0),
        sensor=_struct("sensor", type=F.col("sensor_type")), labels=_struct("labels", material=F.col("material")),
    )
    return catalog.gallery(catalog.summary(recordings)).drop("object_name", "task", "interaction_type")


@query(
    f"""
    WITH {_EPISODES_SQL} SELECT doc_id, sensor_type, modality, material FROM e
    WHERE sensor_type IN ('en', 'de') AND modality IN ('src0', 'src1', 'src2') AND material IN ('1')
    """
)
def gallery_filtered(spark, d):
    return catalog.filtered(
        _episodes(spark, d), ["en", "de"], ["src0", "src1", "src2"], ["1"]
    ).select("doc_id", "sensor_type", "modality", "material")


@query(f"WITH {_EPISODES_SQL} SELECT DISTINCT material FROM e WHERE material IS NOT NULL")
def gallery_filter_options(spark, d):
    return catalog.options(_episodes(spark, d), "material")


@query("SELECT doc_id, n_chars FROM documents ORDER BY source, doc_id LIMIT 25")
def scan_limit(spark, d):
    """The first 25 episodes by path: the limit is what is asked for."""
    return table(spark, d, "documents").select("doc_id", "source", "n_chars").orderBy("source", "doc_id").limit(25).select("doc_id", "n_chars")


@query("SELECT source AS dataset, CAST(count(*) AS BIGINT) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def cache_info(spark, d):
    """Documents as files of a folder a source."""
    files = table(spark, d, "documents").select(
        F.concat_ws("/", "source", F.lit("texts"), F.col("doc_id").cast("string")).alias("path"),
        F.col("n_chars").cast("long").alias("length")
    )
    return catalog.sizes_by_dataset(files)


_CATALOG_SQL = """c AS (SELECT CAST(page_id AS VARCHAR) AS name, CASE WHEN page_id % 11 <> 0 THEN url END AS license, 'S' || (page_id % 3) || ', S' || (page_id % 5) AS sensor_type,
  CASE WHEN page_id % 7 = 0 THEN 'ftp://x' ELSE url END AS url, CASE WHEN page_id % 13 = 0 THEN 0 ELSE length(html) END AS size_bytes, CASE WHEN page_id % 17 = 0 THEN 'xyz' ELSE sha256(url) END AS sha256,
  CASE WHEN page_id % 4 = 0 THEN sha256('S0') WHEN page_id % 4 = 1 THEN sha256('S1') END AS encoder_sha256 FROM pages),
  w AS (SELECT 'S' || i AS sensor_type, sha256('S' || i) AS sha256 FROM range(4) t(i))"""


@query(f"""WITH {_CATALOG_SQL}, own AS (SELECT name, 'missing license' AS problem FROM c WHERE license IS NULL UNION ALL SELECT name, 'missing url' FROM c WHERE url IS NULL UNION ALL SELECT name, 'missing size_bytes' FROM c WHERE size_bytes IS NULL
  UNION ALL SELECT name, 'size must be positive' FROM c WHERE size_bytes <= 0 OR size_bytes IS NULL
  UNION ALL SELECT name, 'not a web address' FROM c WHERE url IS NULL OR NOT regexp_matches(url, '^https?://')
  UNION ALL SELECT name, 'not a SHA-256' FROM c WHERE NOT regexp_full_match(sha256, '[0-9a-f]{{64}}')),
  s AS (SELECT name, encoder_sha256, unnest(string_split(sensor_type, ', ')) AS sensor_type FROM c WHERE encoder_sha256 IS NOT NULL)
  SELECT * FROM own UNION ALL SELECT name, 'encoder differs from the published one: ' || s.sensor_type FROM s LEFT
  JOIN w USING (sensor_type) WHERE w.sha256 IS NULL OR w.sha256 <> encoder_sha256""")
def catalog_validate(spark, d):
    """Pages as entries of a catalog, some with something wrong, against published weights of four sensors."""
    p, n = table(spark, d, "pages"), F.col("page_id")
    sha = lambda t: F.sha2(F.lit(t), 256)
    entries = p.select(
        n.cast("string").alias("name"), F.lit("t").alias("title"), F.lit("d").alias("description"), F.concat(F.lit("S"), n % 3, F.lit(", S"), n % 5).alias("sensor_type"), F.lit("dynamic").alias("modality"),
        F.when(n % 7 == 0, F.lit("ftp://x")).otherwise(F.col("url")).alias("url"), F.when(n % 11 != 0, F.col("url")).alias("license"), F.lit("c").alias("citation"),
        F.when(n % 13 == 0, F.lit(0)).otherwise(F.length("html")).cast("long").alias("size_bytes"), F.lit("zip").alias("format"),
        F.when(n % 17 == 0, F.lit("xyz")).otherwise(F.sha2("url", 256)).alias("sha256"), F.when(n % 4 == 0, sha("S0")).when(n % 4 == 1, sha("S1")).alias("encoder_sha256"),
    )
    weights = spark.range(4).select(F.concat(F.lit("S"), "id").alias("sensor_type")).withColumn("sha256", F.sha2("sensor_type", 256))
    return catalog.problems(entries, weights)


# vectors -----------------------------------------------------------------------------------


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings")


_V = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
_U = _V + ", u AS (SELECT vec_id, label, list_transform(v, lambda x: x / CASE WHEN n = 0 THEN 1 ELSE n END) AS u FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v))"
_C = _U + ", e AS (SELECT label, i, avg(u[i]) AS x FROM u, range(1, 65) t(i) GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) AS mean FROM e GROUP BY 1)"


@query(f"WITH {_V} SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, CASE WHEN i <= 64 THEN v[i] ELSE 0.0 END AS x FROM v, range(1, 71) t(i)")
def pad_to_dim(spark, d):
    return _vectors(spark, d).select("vec_id", F.posexplode(vectors.pad_to(F.col("embedding"), 70)).alias("dim", "x"))


@query(f"WITH {_V} SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, v[i] AS x FROM v, range(1, 17) t(i)")
def truncate_to_dim(spark, d):
    return _vectors(spark, d).select("vec_id", F.posexplode(vectors.pad_to(F.col("embedding"), 16)).alias("dim", "x"))


@query(f"WITH {_U} SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, round(u[i], 6) AS x FROM u, range(1, 65) t(i)")
def l2_normalize(spark, d):
    return _vectors(spark, d).select("vec_id", F.posexplode(vectors.unit(F.col("embedding"))).alias("dim", "x")).withColumn("x", r6("x"))


@query(
    f"""
    WITH {_V}, m AS (SELECT vec_id, v, list_min(v) AS lo, list_max(v) AS hi FROM v)
    SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, CAST(CASE WHEN hi - lo < 1e-9 THEN 0 ELSE round_even((v[i] - lo) / (hi - lo) * 255, 0) END AS INTEGER) AS x
    FROM m, range(1, 65) t(i)
    """
)
def minmax_uint8(spark, d):
    return _vectors(spark, d).select("vec_id", F.posexplode(vectors.to_uint8(F.col("embedding").cast("array<double>"))).alias("dim", "x"))


@query(f"WITH {_V} SELECT CAST(i - 1 AS INTEGER) AS dim, round(avg(v[i]), 6) AS x FROM v, range(1, 65) t(i) GROUP BY i")
def global_mean(spark, d):
    return vectors.sums(_vectors(spark, d), "embedding").select("dim", r6(F.col("x") / F.col("n")).alias("x"))


@query(f"WITH {_V} SELECT vec_id // 5 AS record, CAST(i - 1 AS INTEGER) AS dim, round(avg(v[i]), 6) AS x FROM v, range(1, 65) t(i) GROUP BY 1, i")
def mean_pool(spark, d):
    rows = _vectors(spark, d).withColumn("record", F.floor(F.col("vec_id") / 5).cast("long"))
    return vectors.mean_vectors(rows, "embedding", "record").select("record", F.posexplode("mean").alias("dim", "x")).withColumn("x", r6("x"))


@query(f"WITH {_C} SELECT label, CAST(i - 1 AS INTEGER) AS dim, round(mean[i], 6) AS x FROM c, range(1, 65) t(i)")
def class_centroids(spark, d):
    return centroids.centroids(_vectors(spark, d)).select("label", F.posexplode("mean").alias("dim", "x")).withColumn("x", r6("x"))


_NEAREST = _C + ", s AS (SELECT vec_id, u.label, c.label AS p, list_sum(list_transform(range(1, 65), lambda i: u[i] * mean[i])) / (sqrt(list_sum(list_transform(mean, lambda x: x * x))) + 1e-12) AS sim FROM u, c), best AS (SELECT vec_id, label, arg_min(p, (-sim, p)) AS predicted, max(sim) AS sim FROM s GROUP BY 1, 2)"


@query(f"WITH {_NEAREST} SELECT vec_id, predicted, round(sim, 6) AS similarity FROM best")
def nearest_centroid(spark, d):
    v = _vectors(spark, d)
    return centroids.nearest(v, centroids.centroids(v), "vec_id").withColumn("similarity", r6("similarity"))


@query(f"WITH {_NEAREST} SELECT round(count(*) FILTER (predicted = label) / greatest(1, count(*)), 4) AS accuracy FROM best")
def centroid_accuracy(spark, d):
    v = _vectors(spark, d)
    return centroids.accuracy(v.select("vec_id", "label").join(centroids.nearest(v, centroids.centroids(v), "vec_id"), "vec_id"))


@query(
    f"""
    WITH {_U}
    SELECT a.vec_id AS a, b.vec_id AS b, round(list_sum(list_transform(range(1, 65), lambda i: a.u[i] * b.u[i])), 6) AS similarity
    FROM u a JOIN u b ON b.vec_id = a.vec_id + 1
    """
)
def cosine_pairs(spark, d):
    v = _vectors(spark, d)
    a, b = v.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), v.select(
        F.col("vec_id").alias("b"), (F.col("vec_id") - 1).alias("a"), F.col("embedding").alias("y")
    )
    return a.join(b, "a").select("a", "b", r6(vectors.cosine(F.col("x"), F.col("y"))).alias("similarity"))


@query("SELECT DISTINCT label FROM embeddings WHERE vec_id % 2 = 0 INTERSECT SELECT label FROM embeddings WHERE vec_id % 2 = 1")
def shared_labels(spark, d):
    """Labels that both of two modalities have: vectors of even and of odd vec_id."""
    v = _vectors(spark, d)
    return v.where("vec_id % 2 = 0").select("label").intersect(v.where("vec_id % 2 = 1").select("label"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def missing_keys(spark, d):
    return table(spark, d, "documents").select("doc_id").distinct().join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query(
    """
    SELECT CAST(0 AS INTEGER) AS pos, user_id AS recording_id, event_id FROM events WHERE event_type = 'click' UNION ALL
    SELECT CAST(1 AS INTEGER), user_id, event_id FROM events WHERE event_type <> 'click'
    """
)
def concat_episodes(spark, d):
    e = table(spark, d, "events").select("event_type", F.col("user_id").alias("recording_id"), "event_id")
    of = lambda rows, pos: rows.select(F.lit(pos).alias("pos"), "recording_id", "event_id")
    return of(e.where("event_type = 'click'"), 0).unionByName(of(e.where("event_type <> 'click'"), 1))


@query(f"""WITH {_U}, t AS (SELECT label, i, sum(u[i]) AS x, count(*) AS n FROM u, range(1, 65) r(i) GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) AS total, max(n) AS n FROM t GROUP BY 1),
m AS (SELECT vec_id, u.label, c.label AS p, u, n - CASE WHEN u.label = c.label THEN 1 ELSE 0 END AS n, CASE WHEN u.label = c.label THEN list_transform(range(1, 65), lambda i: total[i] - u[i]) ELSE total END AS total FROM u, c),
s AS (SELECT vec_id, label, p, list_sum(list_transform(range(1, 65), lambda i: u[i] * total[i] / n)) / (sqrt(list_sum(list_transform(total, lambda x: x / n * x / n))) + 1e-12) AS sim FROM m WHERE n > 0)
SELECT vec_id, label, predicted FROM (SELECT vec_id, label, arg_min(p, (-sim, p)) AS predicted FROM s GROUP BY 1, 2)""")
def loo_accuracy_centroid_only(spark, d):
    return centroids.leave_one_out(_vectors(spark, d), "vec_id")


@query(
    f"""
    WITH {_V}
    SELECT vec_id, round(avg(v[i]), 6) AS mean, round(stddev_pop(v[i]), 6) AS std, count(*) FILTER (v[i] < 0) / 64.0 AS contact
    FROM v, range(1, 65) t(i) GROUP BY 1
    """
)
def frame_metrics(spark, d):
    v = F.col("v")
    return (
        _vectors(spark, d)
        .select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
        .select("vec_id", r6(metrics.mean_of(v)).alias("mean"), r6(metrics.std_of(v)).alias("std"), metrics.share_below(v, 0).alias("contact"))
    )


@query(
    f"""
    WITH {_V} SELECT label, CAST(i - 1 AS INTEGER) AS dim, round(avg(v[i]), 6) AS mean, round(stddev_pop(v[i]), 6) AS std
    FROM v, range(1, 65) t(i) GROUP BY 1, i
    """
)
def temporal_mean_std(spark, d):
    return (
        metrics.temporal(_vectors(spark, d).select("label", F.col("embedding").cast("array<double>").alias("values")), "label")
        .withColumn("mean", r6("mean"))
        .withColumn("std", r6("std"))
    )


@query(
    f"""
    WITH {_V}, p AS (SELECT label, i, v[i] AS x FROM v, range(1, 65) t(i)),
    d AS (SELECT label, (i - 1) % 4 AS channel, i, stddev_pop(x) AS s FROM p GROUP BY 1, 2, 3),
    e AS (SELECT label, channel, avg(s) AS s FROM d GROUP BY 1, 2)
    SELECT p.label, CAST((p.i - 1) % 4 AS INTEGER) AS channel, round(avg(p.x), 6) AS mean, round(stddev_pop(p.x), 6) AS std, round(any_value(e.s), 6) AS temporal_std
    FROM p JOIN e ON e.label = p.label AND e.channel = (p.i - 1) % 4 GROUP BY p.label, (p.i - 1) % 4
    """
)
def channel_mean_std(spark, d):
    rows = metrics.channel_statistics(_vectors(spark, d).select("label", F.col("embedding").cast("array<double>").alias("values")), 4, "label")
    return rows.select("label", "channel", *(r6(c).alias(c) for c in ("mean", "std", "temporal_std")))


@query(
    f"""
    WITH {_V}, c AS (SELECT vec_id, ((i - 1) // 8) // 2 * 4 + ((i - 1) % 8) // 2 AS cell, avg(v[i]) AS x FROM v, range(1, 65) t(i)
    GROUP BY 1, 2), a AS (SELECT vec_id, CAST(cell AS INTEGER) AS place, x FROM c WHERE cell < 10 UNION ALL
    SELECT vec_id, 10, avg(v[i]) FROM v, range(1, 65) t(i) GROUP BY 1 UNION ALL SELECT vec_id, 11, stddev_pop(v[i])
    FROM v, range(1, 65) t(i) GROUP BY 1) SELECT vec_id, place, round(x, 6) AS x FROM a
    """
)
def grid_summary(spark, d):
    rows = _vectors(spark, d).select(
        F.col("vec_id").alias("recording_id"), F.lit(0).alias("frame_idx"),
        F.col("embedding").cast("array<double>").alias("values")
    )
    return (
        metrics.cell_summary(rows, 8, 8, 4, 4)
        .select(F.col("recording_id").alias("vec_id"), F.posexplode("features").alias("place", "x"))
        .withColumn("x", r6("x"))
    )


@query(
    """
    SELECT event_type, CAST(least(floor(value / (256.0 / 32)), 31) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n FROM events
    WHERE value >= 0 AND value <= 256 GROUP BY 1, 2
    """
)
def histogram32(spark, d):
    return metrics.histogram(table(spark, d, "events"), F.col("value"), 0, 256, 32, "event_type")


@query(
    f"""
    WITH {_V} SELECT vec_id, CAST(((i - 1) // 8) // 2 * 4 + ((i - 1) % 8) // 2 AS INTEGER) AS cell, round(avg(v[i]), 6) AS mean
    FROM v, range(1, 65) t(i) GROUP BY 1, 2
    """
)
def grid_cells(spark, d):
    rows = _vectors(spark, d).select(
        F.col("vec_id").alias("recording_id"), F.lit(0).alias("frame_idx"),
        F.col("embedding").cast("array<double>").alias("values")
    )
    return metrics.cells(rows, 8, 8, 4, 4).select(F.col("recording_id").alias("vec_id"), "cell", r6("mean").alias("mean"))


# linear algebra: rows only, tests hold them against numpy --------------------------------------


@query(
    """
    SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END::DOUBLE AS x
    FROM range(64) a(i), range(64) b(j)
    """
)
def whitened_gram(spark, d):
    """The Gram matrix of the whitened vectors, row by row: the identity."""
    v = _vectors(spark, d)
    m = linalg.moments(v, "embedding")
    gram = linalg.gram(linalg.mapped(v, "embedding", m.mean, linalg.whitening(m), "white"), "white")
    return gram.select("i", "j", (F.round("x", 4) + 0.0).alias("x"))


@query()
def encode_trained(spark, d):
    """Each vector's class by an encoder fitted to all of them, 24 records of 6 classes."""
    rows = _vectors(spark, d).select(
        (F.col("vec_id") % 24).alias("recording_id"), (F.col("vec_id") % 24 % 6).cast("string").alias("label"), "vec_id",
        F.col("embedding").cast("array<double>").alias("values")
    )
    fitted = encoders.Encoder("BioTac").fit(rows, evaluate=False)
    found = fitted.encode(rows).select("vec_id", "label", "embedding")
    near = centroids.nearest(found, centroids.centroids(found), "vec_id")
    return near.select("vec_id", "predicted", F.round("similarity", 4).alias("similarity"))


@query()
def leave_one_record_out(spark, d):
    """The published benchmark's procedure on the vectors: 24 records of 6 classes, each left out in turn."""
    rows = _vectors(spark, d).select(
        (F.col("vec_id") % 24).cast("string").alias("record"), (F.col("vec_id") % 24 % 6).cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("features")
    )
    return spark.createDataFrame([(encoders.leave_one_record_out(rows),)], "score double")


@query()
def cca_correlations(spark, d):
    v = _vectors(spark, d).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("features"))
    e = encoders.CrossModalEncoder(16).fit(v.where("vec_id % 2 = 0"), v.where("vec_id % 2 = 1"), "vec_id")
    return spark.createDataFrame([(i, float(c)) for i, c in enumerate(e.correlations[: len(e.classes) - 1])], "i int, correlation double")


@query(f"""WITH {_V}, x AS (SELECT vec_id, i, v[i] AS x FROM v, range(1, 65) t(i)), c AS (SELECT a.i, b.i AS j, abs(corr(a.x, b.x)) AS r FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY 1, 2)
SELECT round(2 * sum(r) / (64 * 64), 6) AS before, 0.0::DOUBLE AS after FROM c""")
def decorrelation_score(spark, d):
    m = linalg.moments(_vectors(spark, d), "embedding")
    return spark.createDataFrame(
        [(round(linalg.decorrelation(m.r), 6), round(linalg.decorrelation(m.r @ linalg.whitening(m)), 4))],
        "before double, after double"
    )


# integrity and recording -----------------------------------------------------------------------


@query(
    f"""
    WITH {FRAMES_SQL} SELECT recording_id, sha256(string_agg(event_id || ':' || event_type || ';', '' ORDER BY frame_idx)) AS checksum
    FROM f GROUP BY 1
    """
)
def recording_checksum(spark, d):
    f = frames(spark, d).withColumn("payload", F.concat(F.col("event_id").cast("string"), F.lit(":"), "event_type", F.lit(";")).cast("binary"))
    return integrity.checksums(f)


@query(
    f"""
    WITH {FRAMES_SQL}
    SELECT recording_id, CAST(count(*) AS BIGINT) AS n_frames, '1' AS shape, 'uint8' AS dtype, round(min(ts_s), 6) AS first_s, round(max(ts_s), 6) AS last_s, sha256(string_agg(CAST(event_id AS VARCHAR), '' ORDER BY frame_idx)) AS checksum
    FROM f GROUP BY 1
    """
)
def recorder_finalize(spark, d):
    f = frames(spark, d).withColumns(
        {"payload": F.col("event_id").cast("string").cast("binary"), "shape": F.array(F.lit(1)).cast("array<bigint>"), "dtype": F.lit("uint8")}
    )
    return recorder.finalized(f, with_times=False).select(
        "recording_id", "n_frames", F.array_join(F.col("shape").cast("array<string>"), "x").alias("shape"), "dtype",
        r6("first_s").alias("first_s"), r6("last_s").alias("last_s"), "checksum"
    )


@query(
    """
    SELECT l_orderkey AS recording_id, CAST((l_linenumber - 1) // 2 AS BIGINT) AS \"window\", CAST(count(*) AS BIGINT) AS n_frames, CAST(sum(l_quantity) AS DOUBLE) AS quantity
    FROM lineitem GROUP BY 1, 2
    """
)
def lineitem_windows(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("recording_id"), (F.col("l_linenumber") - 1).cast("long").alias("frame_idx"), "l_quantity"
    )
    return windows.windows(rows, 2).groupBy("recording_id", "window").agg(F.count(F.lit(1)).alias("n_frames"), F.sum("l_quantity").alias("quantity"))



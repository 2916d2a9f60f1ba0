"""The entities of the operators as views over the given tables, in Spark and in SQL.

Operators take frames and column names; these views only give them real rows. The SQL twins are
the CTEs the oracles start from.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import Ordered, ordinal
from ..operators.sampling import number_frames

LINE_ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
    "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


class Tables:
    """The given tables of one directory and the entity views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.dir = spark, str(sf_dir).rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def frames(self) -> DataFrame:
        """Events as frames: ``seq, t, event_id, lum, kind, k, lag_us``."""
        late = (
            F.when(F.col("event_type") == "view", 2_000_000)
            .when(F.col("event_type") == "purchase", 29_000_000).otherwise(0)
        )
        return self.events.select(
            F.col("user_id").alias("seq"), micros("ts").alias("t"), "event_id",
            F.col("value").alias("lum"), F.col("event_type").alias("kind"),
            F.get_json_object("props", "$.k").cast("int").alias("k"), late.cast("bigint").alias("lag_us"),
        )

    @cached_property
    def numbered(self) -> DataFrame:
        return number_frames(self.frames, "seq", ["t", "event_id"])

    @cached_property
    def poses(self) -> DataFrame:
        """Embeddings as camera poses: ``seq, image, cx, cy, cz, ax, ay, az``."""
        e = lambda i: F.get("embedding", F.lit(i)).cast("double")
        length = F.sqrt(e(3) * e(3) + e(4) * e(4) + e(5) * e(5))
        return self.embeddings.select(
            F.col("label").alias("seq"), F.col("vec_id").alias("image"),
            e(0).alias("cx"), e(1).alias("cy"), e(2).alias("cz"),
            (e(3) / length).alias("ax"), (e(4) / length).alias("ay"), (e(5) / length).alias("az"),
            e(6).alias("logit"),
        )

    @cached_property
    def rasters(self) -> DataFrame:
        """Embeddings as 8x8 frames of 0–255 pixels: ``seq, frame, data``."""
        pixel = lambda v: F.floor((v.cast("double") + 1.0) * 127.5).cast("double")
        return self.embeddings.select(
            F.col("label").alias("seq"), F.col("vec_id").alias("frame"),
            F.transform("embedding", pixel).alias("data"),
        )

    @cached_property
    def masks(self) -> DataFrame:
        """Keep masks of the rasters: a pixel is kept below 140."""
        return self.rasters.select("seq", "frame", F.transform("data", lambda v: v < 140).alias("keep"))

    @cached_property
    def raster_pairs(self) -> DataFrame:
        """A raster and the one before it as truth and prediction on [0, 1]."""
        small = F.transform("data", lambda v: v / 255.0)
        truth = self.rasters.select("seq", "frame", small.alias("truth"))
        guess = self.rasters.select((F.col("frame") + 1).alias("frame"), small.alias("guess"))
        return truth.join(guess, "frame")

    @cached_property
    def observations(self) -> DataFrame:
        """Order lines as observations of points: ``point, image, v, s, l, a, b``."""
        return self.lineitem.select(
            F.col("l_partkey").alias("point"), F.col("l_suppkey").alias("image"),
            F.col("l_discount").alias("v"), F.col("l_tax").alias("s"), F.col("l_quantity").alias("l"),
            (F.col("l_discount") * 10).alias("a"), (F.col("l_tax") * 10).alias("b"),
            "l_orderkey", *LINE_ORDER,
        )

    @cached_property
    def views(self) -> DataFrame:
        """Order lines as scored views: ``run, view, psnr, ssim, lpips``."""
        numeric = self.lineitem.withColumn("l_ship", micros("l_shipdate"))
        order = [c if c != "l_shipdate" else "l_ship" for c in LINE_ORDER]
        placed = Ordered(numeric, ["l_orderkey"], order).add(view=ordinal()).df
        return placed.select(
            F.col("l_orderkey").alias("run"), "view", F.col("l_quantity").alias("psnr"),
            F.col("l_discount").alias("ssim"), F.col("l_tax").alias("lpips"),
            F.col("l_returnflag").alias("flag"),
        )

    @cached_property
    def runs(self) -> DataFrame:
        """Orders as runs: ``run, condition, sequence, status, price, t, n_images``."""
        return self.orders.select(
            F.col("o_orderkey").alias("run"), F.col("o_orderpriority").alias("condition"),
            F.col("o_custkey").alias("sequence"), F.col("o_orderstatus").alias("status"),
            F.col("o_totalprice").alias("price"), micros("o_orderdate").alias("t"),
        )

    @cached_property
    def log(self) -> DataFrame:
        """Conversation turns as mapper log lines: ``run, line, role, text``."""
        return self.conversations.select(
            F.col("conv_id").alias("run"), F.col("turn").alias("line"), "role", "text"
        )


FRAMES = """frames AS (
  SELECT user_id AS seq, epoch_us(ts) AS t, event_id, value AS lum, event_type AS kind,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CAST(CASE event_type WHEN 'view' THEN 2000000 WHEN 'purchase' THEN 29000000 ELSE 0 END AS BIGINT) AS lag_us
  FROM events)"""

NUMBERED = FRAMES + """, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY seq ORDER BY t, event_id) - 1 AS ord,
         count(*) OVER (PARTITION BY seq) AS n_total FROM frames)"""

POSES = """poses AS (
  SELECT label AS seq, vec_id AS image, e[1] AS cx, e[2] AS cy, e[3] AS cz,
         e[4] / sqrt(e[4]*e[4] + e[5]*e[5] + e[6]*e[6]) AS ax,
         e[5] / sqrt(e[4]*e[4] + e[5]*e[5] + e[6]*e[6]) AS ay,
         e[6] / sqrt(e[4]*e[4] + e[5]*e[5] + e[6]*e[6]) AS az, e[7] AS logit
  FROM (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))"""

RASTERS = """rasters AS (
  SELECT label AS seq, vec_id AS frame,
         [floor((CAST(v AS DOUBLE) + 1.0) * 127.5) FOR v IN embedding] AS data FROM embeddings)"""

PIXELS = RASTERS + """, pixels AS (
  SELECT seq, frame, i AS p, i // 8 AS y, i % 8 AS x, data[i + 1] AS v
  FROM rasters, (SELECT unnest(range(64)) AS i))"""

PAIRS = PIXELS + """, raster_pairs AS (
  SELECT a.seq, a.frame, a.p, a.y, a.x, a.v / 255.0 AS truth, b.v / 255.0 AS guess, a.v AS v
  FROM pixels a JOIN pixels b ON a.frame = b.frame + 1 AND a.p = b.p)"""

OBSERVATIONS = """observations AS (
  SELECT l_partkey AS point, l_suppkey AS image, l_discount AS v, l_tax AS s, l_quantity AS l,
         l_discount * 10 AS a, l_tax * 10 AS b, * FROM lineitem)"""

VIEWS = """views AS (
  SELECT l_orderkey AS run, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
           l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS view,
         l_quantity AS psnr, l_discount AS ssim, l_tax AS lpips, l_returnflag AS flag FROM lineitem)"""

RUNS = """runs AS (
  SELECT o_orderkey AS run, o_orderpriority AS condition, o_custkey AS sequence, o_orderstatus AS status,
         o_totalprice AS price, epoch_us(o_orderdate) AS t FROM orders)"""

LOG = "log AS (SELECT conv_id AS run, turn AS line, role, text FROM conversations)"

"""How well estimators price unseen cars: hash splits, a pooled ridge, strict comparables, errors, intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lotlens.functions.lineage import settle
from lotlens.functions.selection import numbered
from lotlens.operators import strict

CATEGORIES = ["make", "model_of", "body_style", "fuel_type", "transmission", "seller_type"]
NUMBERS = ["age", "age_over_5", "age_over_10", "log_mileage", "log_power"]


def bucket(key: Column) -> Column:
    """0 to 99 from a digest of a key, the same for all rows of a vehicle or dealer."""
    return (F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long") % 100).cast("int")


def part(key: Column) -> Column:
    b = bucket(key)
    return F.when(b < 60, "train").when(b < 75, "tuning").when(b < 85, "calibration").otherwise("test")


def features(listings: DataFrame, year: int) -> DataFrame:
    """What an estimator may see of a car: everything but its price."""
    age = F.greatest(F.lit(0), F.lit(year) - F.col("model_year")).cast("double")
    return listings.withColumns(
        {
            "age": age,
            "age_over_5": F.greatest(F.lit(0.0), age - 5),
            "age_over_10": F.greatest(F.lit(0.0), age - 10),
            "log_mileage": F.log1p("mileage_km"),
            "log_power": F.log("horsepower"),
            "model_of": F.concat_ws(":", "make", "model"),
            "log_price": F.log("price"),
        }
    )


def ridge(train: DataFrame, strength: float) -> PipelineModel:
    """Log price on one-hot categories and scaled numbers with an L2 penalty."""
    indexed = [StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep") for c in CATEGORIES]
    hot = OneHotEncoder(inputCols=[f"{c}_i" for c in CATEGORIES], outputCols=[f"{c}_h" for c in CATEGORIES], handleInvalid="keep", dropLast=False)
    plain = VectorAssembler(inputCols=NUMBERS, outputCol="numbers")
    scaled = StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True)
    together = VectorAssembler(inputCols=["scaled", *[f"{c}_h" for c in CATEGORIES]], outputCol="x")
    fit = LinearRegression(featuresCol="x", labelCol="log_price", predictionCol="log_predicted", regParam=strength, elasticNetParam=0.0, standardization=False)
    return Pipeline(stages=[*indexed, hot, plain, scaled, together, fit]).fit(train)


def predicted(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return rows.join(model.transform(rows).select("listing_id", F.exp("log_predicted").alias("predicted")), "listing_id")


def strict_median(targets: DataFrame, pool: DataFrame, nearest: int = 40, least: int = 3) -> DataFrame:
    """The median price of the nearest cars that agree in every respect; none where they are too few."""
    keys = ["make", "model", "body_style", "fuel_type", "transmission", "horsepower"]
    t = targets.filter("body_style <> 'other'").dropna(subset=[*keys, "vehicle_id"]).select(*keys, F.col("listing_id").alias("t_id"), F.col("vehicle_id").alias("t_vehicle"), F.col("model_year").alias("t_year"), F.col("mileage_km").alias("t_km"))
    c = pool.filter("body_style <> 'other'").dropna(subset=[*keys, "vehicle_id"]).select(*keys, "listing_id", "vehicle_id", "model_year", "mileage_km", F.col("price").cast("double").alias("price"))
    names = (t.columns[len(keys) :], c.columns[len(keys) :])
    both = t.withColumn("is_target", F.lit(True)).unionByName(c.withColumn("is_target", F.lit(False)), allowMissingColumns=True)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        ours, theirs = rows.filter(rows["is_target"]).select(names[0]), rows.filter(pc.invert(rows["is_target"])).select(names[1])
        if len(ours) and len(theirs):
            yield from strict.medians_in(ours, theirs, nearest, least).to_batches()

    return both.groupBy(*keys).applyInArrow(made, StructType([StructField("listing_id", t.schema["t_id"].dataType), StructField("predicted", DoubleType())]))


def log_radius(calibration: DataFrame, coverage: float = 0.9) -> float | None:
    """The conformal radius: the right order statistic of absolute log errors."""
    errors = calibration.filter("predicted > 0").select(F.abs(F.log(F.col("predicted") / F.col("price"))).alias("e"))
    n = errors.count()
    rank = -int(-(n + 1) * coverage // 1)
    if not 1 <= rank <= n:
        return None
    return errors.orderBy("e").offset(rank - 1).limit(1).first()[0]


def errors(rows: DataFrame, radius: float | None = None) -> DataFrame:
    """One row of errors of predictions (price, predicted); a missing prediction counts against coverage."""
    usable = F.col("predicted") > 0
    ratio = F.when(usable, F.col("predicted") / F.col("price"))
    log = F.abs(F.log(ratio))
    return rows.agg(
        F.count("*").alias("targets"),
        F.count_if(usable).alias("valued"),
        (F.count_if(usable) / F.nullif(F.count("*"), F.lit(0))).alias("coverage"),
        F.avg(F.when(usable, F.abs(F.col("predicted") - F.col("price")))).alias("mae"),
        F.percentile(F.abs(ratio - 1), 0.5).alias("median_absolute_percentage"),
        F.avg(log).alias("mean_absolute_log"),
        F.percentile(F.log(ratio), 0.5).alias("median_signed_log"),
        F.expr("percentile_disc(0.95) within group (order by case when predicted > 0 then abs(ln(predicted / price)) end)").alias("p95_absolute_log"),
        (F.percentile(F.when(usable, F.col("predicted") * (F.exp(F.lit(radius)) - F.exp(F.lit(-radius)))), 0.5) if radius is not None else F.lit(None).cast("double")).alias("median_interval_width"),
        (F.avg((log <= radius).cast("double")) if radius is not None else F.lit(None).cast("double")).alias("interval_coverage"),
    )


def hybrid(targets: DataFrame, pool: DataFrame, predictions: DataFrame, nearest: int = 40, least: int = 3) -> DataFrame:
    """Strict comparables, each price carried to the target by the ratio of their model predictions; their median.

    predictions: (listing_id, modelled) of targets and pool. A target outside the years or mileages of its comparables
    has none, as has one without a prediction of its own.
    """
    keys = ["make", "model", "body_style", "fuel_type", "transmission", "horsepower"]
    t = targets.filter("body_style <> 'other'").select(*keys, F.col("listing_id").alias("t_id"), F.col("vehicle_id").alias("t_vehicle"), F.col("model_year").alias("t_year"), F.col("mileage_km").alias("t_km"))
    far = F.abs(F.col("model_year") - F.col("t_year")) * 60_000 + F.abs(F.col("mileage_km") - F.col("t_km"))
    near = Window.partitionBy("t_id").orderBy(far, "listing_id")
    c = pool.select(*keys, "listing_id", "vehicle_id", "model_year", "mileage_km", "price")
    pairs = c.join(t, keys).filter(F.col("vehicle_id") != F.col("t_vehicle")).withColumn("k", F.row_number().over(near)).filter(F.col("k") <= nearest)
    inside = pairs.groupBy("t_id").agg(F.count("*").alias("n"), F.max("t_km").between(F.min("mileage_km"), F.max("mileage_km")).alias("km"), F.max("t_year").between(F.min("model_year"), F.max("model_year")).alias("year")).filter((F.col("n") >= least) & F.col("km") & F.col("year")).select("t_id")
    carried = pairs.join(inside, "t_id").join(predictions.select("listing_id", "modelled"), "listing_id").join(predictions.select(F.col("listing_id").alias("t_id"), F.col("modelled").alias("t_modelled")), "t_id")
    carried = carried.filter("modelled > 0 and t_modelled > 0").withColumn("carried", F.col("price") * F.col("t_modelled") / F.col("modelled"))
    return carried.groupBy(F.col("t_id").alias("listing_id")).agg(F.count("*").alias("n"), F.percentile("carried", 0.5).alias("predicted")).filter(F.col("n") >= least).drop("n")


#: Fixed values of the seeded draws: x -> (A x + C) mod 2^32 from SEED; replicates, and the order statistics of the interval.
LCG_A, LCG_C, SEED = 1_664_525, 1_013_904_223, 37
REPLICATES, LOWER, UPPER = 500, 12, 487
#: Differences that a task of the draws holds at once; beyond, each part is drawn for anew.
PLACES = 1 << 23


def _jump(steps: int) -> int:
    """The generator's number after so many steps."""
    x, a, c = SEED, LCG_A, LCG_C
    while steps:
        if steps & 1:
            x = (a * x + c) % 2**32
        a, c, steps = a * a % 2**32, (a * c + c) % 2**32, steps >> 1
    return x


def paired_bootstrap(a: DataFrame, b: DataFrame, key: str = "vehicle_id", replicates: int = REPLICATES) -> DataFrame:
    """One row (paired, difference, low, high): absolute log errors of b less those of a on the cars that both price,
    with the interval of seeded resamples.

    a, b: (key, price, predicted), one row a key. A replicate's start in the generator's numbers is a jump, so that replicates
    need no order of running. A task draws for a block of them and holds the differences of PLACES places and DRAWS numbers;
    only sums leave it. The differences are copied once a block, not once a draw. Positions go by key.
    """
    error = F.abs(F.log(F.col("predicted") / F.col("price")))
    # Written first: predictions may be long expressions, which a filter on them would repeat all the way down.
    side = lambda x, name: settle(x.select(key, F.col("price").cast("double").alias("price"), F.col("predicted").cast("double").alias("predicted"))).filter("predicted > 0 and price > 0").select(key, error.alias(name))
    deltas = side(a, "ea").join(side(b, "eb"), key).select(key, (F.col("eb") - F.col("ea")).alias("delta"))
    deltas = settle(numbered(deltas, key))
    n = deltas.count()
    if not n:
        return deltas.sparkSession.range(1).select(F.lit(0).cast("long").alias("paired"), *[F.lit(None).cast("double").alias(c) for c in ("difference", "low", "high")])
    blocks = min(replicates, max(8, 2 * deltas.sparkSession.sparkContext.defaultParallelism))
    starts = [_jump(r * n) for r in range(replicates)]

    def sums(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, first, rows = key[0].as_py(), key[1].as_py() * PLACES, pa.Table.from_batches(batches)
        values = np.empty(len(rows))
        values[rows["place"].to_numpy() - first] = rows["delta"].to_numpy()
        of = strict.drawn_in(values, first, n, {r: starts[r] for r in range(block, replicates, blocks)}, LCG_A, LCG_C)
        yield pa.RecordBatch.from_pydict({"replicate": pa.array(of.keys(), pa.int32()), "total": pa.array(of.values(), pa.float64())})

    copies = deltas.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.floor(F.col("place") / PLACES).alias("part"), F.col("place").cast("long").alias("place"), "delta")
    totals = copies.repartition(blocks, "block", "part").groupBy("block", "part").applyInArrow(sums, "replicate int, total double")
    means = totals.groupBy("replicate").agg((F.sum("total") / n).alias("mean"))
    ends = means.agg(F.sort_array(F.collect_list("mean")).alias("m")).select(F.get("m", F.lit(LOWER)).alias("low"), F.get("m", F.lit(UPPER)).alias("high"))
    return deltas.agg(F.count("*").alias("paired"), F.avg("delta").alias("difference")).crossJoin(F.broadcast(ends))

"""Data behind distribution charts: histograms, box statistics, densities, Q-Q pairs, map cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normal_quantile, round_half_even
from ..session import stage
from .joins import attach_stats, join_null_safe
from .ordered import exact_quantiles, running_sums

RANKS_PER_ROW = 100_000
#: cells of a density in the smallest bandwidth, powers summed in each, and how far a kernel is followed
CELLS_PER_BANDWIDTH = 8
MOMENTS = 10
REACH = 9.2


def _on_axis(df: DataFrame, c: str, log10: bool, by: Sequence[str]) -> DataFrame:
    value = F.col(c).cast("double")
    if log10:
        return df.filter(F.col(c) > 0).select(*by, F.log10(value).alias("__x"))
    return df.filter(F.col(c).isNotNull()).select(*by, value.alias("__x"))


def histogram(df: DataFrame, c: str, bins: int = 30, log10: bool = False, by: str | None = None) -> DataFrame:
    """Equal-width bin counts over [min, max], last bin closed; empty bins are listed with 0.

    With ``log10`` the bins are over log10 of the positive values. ``by`` counts each
    group on the same bins.
    """
    keys = [by] if by else []
    x = _on_axis(df, c, log10, keys)
    limits = x.agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    number = F.when(F.col("__hi") == F.col("__lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("__x") - F.col("__lo")) / width).cast("int"), F.lit(bins - 1))
    )
    counts = attach_stats(x, limits).groupBy(*keys, number.alias("bin")).agg(F.count("*").alias("n"))
    if by:
        frame = attach_stats(counts.select(by).distinct(), limits)
    else:
        frame = limits
    frame = frame.select(
        *keys,
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"),
        "__lo",
        width.alias("__w"),
    )
    return join_null_safe(frame, counts, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        (F.col("__lo") + F.col("bin") * F.col("__w")).alias("bin_lo"),
        (F.col("__lo") + (F.col("bin") + 1) * F.col("__w")).alias("bin_hi"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"),
    )


def box_stats(df: DataFrame, by: str, c: str, log10: bool = True) -> DataFrame:
    """Per group: quartiles, whiskers at the furthest value within 1.5 IQR, outlier count."""
    x = _on_axis(df, c, log10, [by]).groupBy(by, "__x").agg(F.count("*").alias("__rows"))
    quartiles = exact_quantiles(x, "__x", {"q1": 0.25, "median": 0.5, "q3": 0.75}, [by], weight="__rows")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    kept = F.col("__x").between(F.col("q1") - reach, F.col("q3") + reach)
    return attach_stats(x, quartiles, [by]).groupBy(by).agg(
        F.sum("__rows").alias("n"),
        F.min("q1").alias("q1"),
        F.min("median").alias("median"),
        F.min("q3").alias("q3"),
        F.min(F.when(kept, F.col("__x"))).alias("whisker_lo"),
        F.max(F.when(kept, F.col("__x"))).alias("whisker_hi"),
        F.sum(F.when(kept, 0).otherwise(F.col("__rows"))).alias("n_outliers"),
    )


def density(
    df: DataFrame,
    c: str,
    by: str,
    adjust: float = 2.0,
    grid: int = 512,
    limits: tuple[float, float] | None = (1.0, 350_000.0),
    log10: bool = True,
    count_scale: float = 2.0,
) -> DataFrame:
    """Gaussian kernel density per group, scaled to counts: (by, grid_no, x, density).

    The grid spans ``limits`` (given on the raw axis), or all values when None. The bandwidth
    takes the smaller of deviation and quartile spread; where that is 0 the deviation, else
    the size of the smallest value, else 1, so a group of equal values has a density too.

    The rows are read once into cells an eighth of the smallest bandwidth wide, as sums of the
    first ``MOMENTS`` powers of the distance from the cell's middle. The kernel's expansion in
    these (Hermite polynomials of the distance between cell and grid point) is cut after the
    last of them, which leaves out at most 6e-16 of the kernel's height per row; a cell adds
    to the grid points within ``REACH`` bandwidths, beyond which a kernel is below 1e-18 of
    its height. So the work after the first pass follows the cells, not the rows.
    """
    x = _on_axis(df, c, log10, [by])
    if limits:
        ends = [F.log10(F.lit(float(v))) if log10 else F.lit(float(v)) for v in limits]
        x = x.filter(F.col("__x").between(*ends))
        span = None
    else:
        span = x.agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    moments = x.groupBy(by).agg(F.count("*").alias("__n"), F.stddev_samp("__x").alias("__sd"), F.min("__x").alias("__least"))
    quartiles = exact_quantiles(x, "__x", {"__q1": 0.25, "__q3": 0.75}, [by])
    choices = [F.least(F.col("__sd"), (F.col("__q3") - F.col("__q1")) / 1.34), F.col("__sd"), F.abs("__least"), F.lit(1.0)]
    spread = F.coalesce(*[F.when(v > 0, v) for v in choices])
    bandwidth = join_null_safe(moments, quartiles, [by]).select(
        by, "__n", (F.lit(adjust * 0.9) * spread * F.pow(F.col("__n"), -0.2)).alias("__h")
    )
    # read by the cells, by their sums and by the grid
    bandwidth = stage(
        attach_stats(bandwidth, span)
        if span is not None
        else bandwidth.withColumns({"__lo": ends[0], "__hi": ends[1]}),
        "bandwidth",
    )
    finest = bandwidth.agg(F.min("__h").alias("__finest"), F.min("__lo").alias("__from"))
    placed = attach_stats(x, finest)
    width = F.col("__finest") / CELLS_PER_BANDWIDTH
    cell = F.floor((F.col("__x") - F.col("__from")) / width)
    middle = F.col("__from") + (cell + 0.5) * width
    placed = placed.select(by, cell.alias("__cell"), middle.alias("__at"), "__finest", ((F.col("__x") - middle) / F.col("__finest")).alias("__u"))
    powers, power = [], F.lit(1.0)
    for p in range(MOMENTS):
        powers.append(F.sum(power).alias(f"__m{p}"))
        power = power * F.col("__u")
    cells = placed.groupBy(by, "__cell").agg(F.min("__at").alias("__at"), F.min("__finest").alias("__finest"), *powers)
    step = (F.col("__hi") - F.col("__lo")) / (grid - 1)
    reach = F.lit(REACH) * F.col("__h")
    near = lambda side: F.when(step > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(grid - 1)), side)))
    first = F.coalesce(near(F.ceil((F.col("__at") - reach - F.col("__lo")) / step)), F.lit(0.0)).cast("int")
    last = F.coalesce(near(F.floor((F.col("__at") + reach - F.col("__lo")) / step)), F.lit(float(grid - 1))).cast("int")
    local = join_null_safe(cells, bandwidth, [by]).withColumn("grid_no", F.explode(F.when(first <= last, F.sequence(first, last))))
    z = (F.col("__lo") + F.col("grid_no") * step - F.col("__at")) / F.col("__h")
    narrower = F.col("__finest") / F.col("__h")
    # sum over p of He_p(z) v**p / p!, the polynomials by their recurrence
    before, polynomial, factor, total = F.lit(0.0), F.lit(1.0), F.lit(1.0), F.col("__m0")
    local = local.withColumns({"__z": z, "__v": narrower})
    for p in range(1, MOMENTS):
        local = local.withColumns({f"__p{p}": F.col("__z") * polynomial - (p - 1) * before, f"__f{p}": factor * F.col("__v") / p})
        before, polynomial, factor = polynomial, F.col(f"__p{p}"), F.col(f"__f{p}")
        total = total + polynomial * factor * F.col(f"__m{p}")
    sums = local.groupBy(by, "grid_no").agg(F.sum(F.exp(-0.5 * F.col("__z") * F.col("__z")) * total).alias("__s"))
    points = bandwidth.withColumn("grid_no", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    root = 2.5066282746310002  # sqrt(2 pi)
    return join_null_safe(points, sums, [by, "grid_no"], "left").select(
        by,
        "grid_no",
        (F.col("__lo") + F.col("grid_no") * step).alias("x"),
        (F.coalesce("__s", F.lit(0.0)) / (F.col("__h") * root) * count_scale).alias("density"),
    )


def qq_normal(df: DataFrame, c: str, log10: bool = False) -> DataFrame:
    """Normal Q-Q pairs (rank, sample, theoretical), one per value.

    Equal values are ranked as one run of ranks; a long run is cut into pieces that
    are spread over the tasks before it is written out.
    """
    x = _on_axis(df, c, log10, []).withColumn("__one", F.lit(1).cast("long"))
    runs = running_sums(x, "__x", ["__one"])
    first, last = F.col("__one_before") + 1, F.col("__one_before") + F.col("__one")
    pieces = (
        runs.select(
            F.col("__x").alias("sample"),
            F.col("__one_total").alias("__n"),
            last.alias("__last"),
            F.explode(F.sequence(first, last, F.lit(RANKS_PER_ROW).cast("long"))).alias("__first"),
        )
        .repartition("sample", "__first")
    )
    ranks = pieces.select(
        "sample",
        "__n",
        F.explode(
            F.sequence("__first", F.least("__last", F.col("__first") + (RANKS_PER_ROW - 1)))
        ).alias("rank"),
    )
    return ranks.select("rank", "sample", normal_quantile(plotting_position("rank", "__n")).alias("theoretical"))


def plotting_position(rank: str, n: str):
    """(i - a) / (n + 1 - 2a) with a = 3/8 up to ten values and 1/2 beyond."""
    a = F.when(F.col(n) <= 10, F.lit(0.375)).otherwise(F.lit(0.5))
    return (F.col(rank) - a) / (F.col(n) + 1 - 2 * a)


def qq_line(df: DataFrame, c: str, log10: bool = False) -> DataFrame:
    """Slope and intercept of the line through the quartile pairs."""
    q = exact_quantiles(_on_axis(df, c, log10, []), "__x", {"q1": 0.25, "q3": 0.75})
    z = normal_quantile(F.lit(0.75))
    slope = (F.col("q3") - F.col("q1")) / (2 * z)
    return q.select(slope.alias("slope"), (F.col("q1") + slope * z).alias("intercept"))


def geo_grid(df: DataFrame, lat: str, lon: str, target: str, digits: int = 2) -> DataFrame:
    """Map cells: latitude and longitude rounded, a ``lat:lon`` label, rows per class."""
    cell = df.select(
        round_half_even(F.col(lat).cast("double"), digits).alias("cell_lat"),
        round_half_even(F.col(lon).cast("double"), digits).alias("cell_lon"),
        target,
    )
    counts = cell.groupBy("cell_lat", "cell_lon", target).agg(F.count("*").alias("n"))

    def text(c: str):
        return F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")

    return counts.withColumn("latlong", F.concat_ws(":", text("cell_lat"), text("cell_lon")))

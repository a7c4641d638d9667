"""Synthetic power-law graphs by recursive quadrant sampling, and vertex scrambles; nothing depends on partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = 4294967295
INITIATOR = (0.57, 0.19, 0.19, 0.05)
WEIGHT_LEVEL, CELL_LEVEL = 63, 62


def normalize_initiator(initiator) -> list[float]:
    total = sum(initiator)
    if len(initiator) != 4 or total <= 0 or min(initiator) < 0:
        raise ValueError("the initiator needs four non-negative values with a positive sum")
    return [x / total for x in initiator]


def uniforms_sql(key: str, levels: str, seed: int) -> str:
    """An array of uniforms in [0, 1), one for each level: a 32-bit integer mix of (seed, key, level)."""
    term = f"(({seed * 40503 & MASK} + shiftright({key}, 26) * 668265263) & {MASK})"
    x = f"transform({levels}, l -> (((({key}) * 64 + l) & {MASK}) * -1640531535 + {term}) & {MASK})"
    x = f"transform({x}, x -> ((x ^ shiftright(x, 16)) * 2146121005) & {MASK})"
    x = f"transform({x}, x -> ((x ^ shiftright(x, 15)) * -2073254261) & {MASK})"
    return f"transform({x}, x -> (x ^ shiftright(x, 16)) / 4294967296D)"


def compatible_sql(v: str, scale: int, seed: int = 42) -> str:
    """The benchmark's own scramble; it merges vertices."""
    x = f"(((({v}) & {MASK}) * -1640531535 + {seed * 1013904223 & MASK}) & {MASK})"
    return f"(({x} ^ shiftright({x}, {scale})) & {(1 << scale) - 1})"


def times_sql(x: str, factor: int, scale: int) -> str:
    """x * factor modulo 2**scale without overflow, for x of scale bits: in two halves beyond 31 bits, up to 46."""
    m = (1 << scale) - 1
    if scale <= 31:
        return f"((({x}) * {factor}) & {m})"
    if scale > 46:
        raise ValueError("a scale of more than 46 bits")
    return f"(((({x}) & 65535) * {factor} + shiftleft((shiftright({x}, 16) * {factor}) & {m >> 16}, 16)) & {m})"


def bijective_sql(v: str, scale: int) -> str:
    """Odd multiply, xor-shift by half the bits, odd multiply, each modulo 2**scale: no two vertices merge."""
    half = (scale + 1) // 2
    x = times_sql(v, 2654435761, scale)
    return times_sql(f"({x} ^ shiftright({x}, {half}))", 2146121005, scale)


SCRAMBLES = {"bijective": bijective_sql, "compatible": compatible_sql}


def scramble_bijective(spark: SparkSession, scale: int) -> DataFrame:
    return spark.range(1 << scale).selectExpr("id AS vertex", f"{bijective_sql('id', scale)} AS scrambled")


def stochastic(spark: SparkSession, scale: int, edge_factor: int = 16, initiator=INITIATOR, seed: int = 42, scramble: str | None = None) -> DataFrame:
    """(src, dst, w): edge_factor * 2**scale samples, a quadrant for each bit, the highest bit first."""
    a, b, c, _ = normalize_initiator(initiator)
    draws = spark.range(edge_factor << scale).select(F.expr(uniforms_sql("id", f"concat(sequence(0L, {scale - 1}L), array({WEIGHT_LEVEL}L))", seed)).alias("r"))
    quadrant = f"transform(slice(r, 1, {scale}), x -> case when x < {a}D then 0L when x < {a + b}D then 1L when x < {a + b + c}D then 2L else 3L end)"
    q = draws.selectExpr(f"{quadrant} q", f"element_at(r, {scale + 1}) w")
    edges = q.selectExpr("aggregate(q, 0L, (s, x) -> s * 2 + shiftright(x, 1)) src", "aggregate(q, 0L, (s, x) -> s * 2 + (x & 1)) dst", "w")
    return scrambled(edges, scale, scramble)


def scrambled(edges: DataFrame, scale: int, scramble: str | None) -> DataFrame:
    return edges.selectExpr(f"{SCRAMBLES[scramble]('src', scale)} src", f"{SCRAMBLES[scramble]('dst', scale)} dst", "w") if scramble else edges


def cell_probabilities(spark: SparkSession, scale: int, initiator=INITIATOR) -> DataFrame:
    """(cell, src, dst, p) of the full Kronecker power; the cells are one range, not a cross join."""
    a, b, c, d = normalize_initiator(initiator)
    m = (1 << scale) - 1
    cells = spark.range(1 << 2 * scale).selectExpr("id cell", f"shiftright(id, {scale}) src", f"id & {m} dst")
    p = f"pow({a}D, {scale} - bit_count(src | dst)) * pow({b}D, bit_count(~src & dst & {m})) * pow({c}D, bit_count(src & ~dst & {m})) * pow({d}D, bit_count(src & dst))"
    return cells.selectExpr("cell", "src", "dst", f"{p} p")


def exact(spark: SparkSession, scale: int, initiator=INITIATOR, seed: int = 42, scramble: str | None = None) -> DataFrame:
    """(src, dst, w): one Bernoulli draw for each cell."""
    drawn = cell_probabilities(spark, scale, initiator).withColumn("r", F.expr(uniforms_sql("cell", f"array({CELL_LEVEL}L, {WEIGHT_LEVEL}L)", seed)))
    return scrambled(drawn.where("r[0] < p").selectExpr("src", "dst", "r[1] w"), scale, scramble)

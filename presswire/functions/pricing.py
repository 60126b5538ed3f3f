"""Model prices and call costs, as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def price_of(model: Column) -> Column:
    """``struct(input, output)``: the first price whose key starts the model id."""
    def pair(cost_in, cost_out):
        return F.struct(F.lit(cost_in).alias("input"), F.lit(cost_out).alias("output"))

    hits = [F.when(F.startswith(model, F.lit(key)), pair(i, o)) for key, i, o in C.PRICES]
    return F.coalesce(*hits, pair(*C.DEFAULT_PRICE))


def _tokens(col: Column) -> Column:
    return F.coalesce(col.cast("double"), F.lit(0.0))


def call_cost(model: Column, uncached: Column, output: Column, cache_read: Column, cache_write: Column) -> Column:
    price = price_of(model)
    return (
        _tokens(uncached) * price["input"]
        + _tokens(cache_write) * price["input"] * C.CACHE_WRITE_MULTIPLIER
        + _tokens(cache_read) * price["input"] * C.CACHE_READ_MULTIPLIER
        + _tokens(output) * price["output"]
    ) / 1_000_000


def speech_cost(prompt: Column, output: Column) -> Column:
    cost_in, cost_out = C.SPEECH_PRICES
    return (_tokens(prompt) * cost_in + _tokens(output) * cost_out) / 1_000_000

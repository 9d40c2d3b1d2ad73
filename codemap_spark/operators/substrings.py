"""Which names hold which tokens, for many tokens in one plan (JN18, AGG2, FLT1).

Names are indexed by their runs of three letters.  A token looks at the run of
its own that the fewest names hold, and only those names are searched for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Length of the runs; a shorter token is one run of its own length.
GRAM = 3


def grams(text: Column, size: int) -> Column:
    """Distinct runs of ``size`` characters."""
    starts = F.sequence(F.lit(1), F.char_length(text) - size + 1)
    return F.when(F.char_length(text) >= size, F.array_distinct(F.transform(starts, lambda i: text.substr(i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def _by_size(text: Column, sizes: list[int]) -> Column:
    return F.flatten(F.array(*[grams(text, s) for s in sizes]))


def rarest(names: DataFrame, tokens: DataFrame) -> DataFrame:
    """token, gram, candidates: the run of each token that the fewest names
    (name, distinct) hold, and how many; tokens with a run that no name has are
    left out, as no name can hold them."""
    own = F.when(F.char_length("token") >= GRAM, grams(F.col("token"), GRAM)).otherwise(F.array("token"))
    wanted = tokens.where("token <> ''").select("token", F.explode(own).alias("gram")).distinct()
    known = names.select(F.explode(_by_size(F.col("name"), list(range(1, GRAM + 1)))).alias("gram")).join(wanted.select("gram").distinct(), "gram", "left_semi")
    held = known.groupBy("gram").agg(F.count("*").alias("held"))
    best = wanted.join(held, "gram", "left").groupBy("token").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "gram")).alias("x"))
    return best.where("x.held > 0").select("token", "x.gram", F.col("x.held").alias("candidates"))


def containing(names: DataFrame, tokens: DataFrame) -> DataFrame:
    """name, token of every pair where the name holds the token.

    ``names`` (name) and ``tokens`` (token) are distinct; null names and empty
    tokens meet nothing."""
    names, tokens = names.where("name IS NOT NULL"), tokens.select("token").distinct()
    chosen = rarest(names, tokens)
    postings = names.select("name", F.explode(_by_size(F.col("name"), list(range(1, GRAM + 1)))).alias("gram"))
    return postings.join(chosen.select("token", "gram"), "gram").where(F.contains("name", "token")).select("name", "token")

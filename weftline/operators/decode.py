"""Post-processing of logits: penalties, cuts, commits, truncation.

Logits come as ``(key, pos, logit)`` rows.  A position's vocabulary is a window partition of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEVER = float("-inf")


def suppressed(logit: Column, token: Column, ids: tuple[int, ...]) -> Column:
    """Padding and mask ids can never be drawn."""
    return F.when(token.isin(*ids), F.lit(NEVER)).otherwise(logit)


def penalized(logit: Column, count: Column, presence: float, frequency: float) -> Column:
    """Logit less the penalty of a token already seen ``count`` times."""
    c = F.coalesce(count, F.lit(0.0))
    return logit - (F.when(c > 0, presence).otherwise(0.0) + frequency * c)


def softmax(df: DataFrame, key: list[str], logit: str = "logit", prob: str = "prob", temperature: float = 1.0) -> DataFrame:
    """Probabilities within a key; a temperature of 0 counts as 1e-6."""
    w = Window.partitionBy(*key)
    z = F.col(logit) / max(temperature, 1e-6)
    e = df.withColumn("__e", F.exp(z - F.max(z).over(w)))
    return e.withColumn(prob, F.col("__e") / F.sum("__e").over(w)).drop("__e")


def top_k(df: DataFrame, key: list[str], k: int, logit: str = "logit") -> DataFrame:
    """Rows whose logit is not below the k-th largest; ties with it stay."""
    w = Window.partitionBy(*key).orderBy(F.desc(logit))
    return df.withColumn("__r", F.rank().over(w)).where(F.col("__r") <= k).drop("__r")


def nucleus(df: DataFrame, key: list[str], p: float, prob: str = "prob", tie: str = "token") -> DataFrame:
    """Rows kept while the probability before them is at most ``p``; the largest always stays."""
    w = Window.partitionBy(*key).orderBy(F.desc(prob), tie).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__before", F.coalesce(F.sum(prob).over(w), F.lit(0.0))).where(F.col("__before") <= p).drop("__before")


def nucleus_by_value(df: DataFrame, key: list[str], p: float, temperature: float = 1.0, prob: str = "prob", tie: str = "token") -> DataFrame:
    """The variant that cuts by value: ties at the cut share what is left to ``p``; the temperature is a power afterwards.

    ``p`` must be below 1.  Rows below the cut get probability 0.
    """
    w = Window.partitionBy(*key)
    down = w.orderBy(F.desc(prob), tie).rowsBetween(Window.unboundedPreceding, 0)
    cum = df.withColumn("__cum", F.sum(prob).over(down))
    cut = cum.withColumn("__cut", F.max(F.when(F.col("__cum") >= p, F.col(prob))).over(w))
    kept = cut.withColumn("__p", F.when(F.col(prob) < F.col("__cut"), 0.0).otherwise(F.col(prob)))
    tied = kept.withColumn("__tied", F.sum(F.when(F.col("__p") == F.col("__cut"), 1).otherwise(0)).over(w)).withColumn("__sum", F.sum("__p").over(w))
    shared = F.when(F.col("__p") == F.col("__cut"), F.col("__cut") + (F.lit(p) - F.col("__sum")) / F.col("__tied")).otherwise(F.col("__p"))
    out = shared if temperature == 1.0 else F.pow(shared, F.lit(1.0 / temperature))
    return tied.withColumn(prob, out).drop("__cum", "__cut", "__p", "__tied", "__sum")


def drawn(df: DataFrame, key: list[str], u: Column, prob: str = "prob", tie: str = "token") -> DataFrame:
    """One token a key: the first whose cumulative share exceeds the uniform number ``u``."""
    w = Window.partitionBy(*key)
    cum = df.withColumn("__cum", F.sum(prob).over(w.orderBy(tie)) / F.sum(prob).over(w)).withColumn("__u", u)
    hit = cum.where(F.col("__cum") > F.col("__u"))
    return hit.groupBy(*key).agg(F.min(tie).alias(tie))


def committed(df: DataFrame, block: list[str], threshold: float, steps: int, block_size: int, minimum: int = 0, confidence: str = "confidence", pos: str = "pos", masked: str = "is_masked") -> DataFrame:
    """Add ``commit``: masked positions above the threshold if there are enough of them, else the most confident.

    Ties in confidence go to the earlier position.
    """
    floor = minimum if minimum > 0 else max(1, block_size // max(steps, 1))
    w = Window.partitionBy(*block)
    above = F.col(masked) & (F.col(confidence) > threshold)
    place = F.row_number().over(w.orderBy(F.desc(masked), F.desc(confidence), pos))
    enough = F.sum(F.when(above, 1).otherwise(0)).over(w) >= floor
    return df.withColumn("commit", F.when(enough, above).otherwise(F.col(masked) & (place <= floor)))


def committed_linear(df: DataFrame, block: list[str], step: Column, steps: int, block_size: int, confidence: str = "confidence", pos: str = "pos", masked: str = "is_masked") -> DataFrame:
    """Add ``commit``: as many of the most confident as the linear schedule lacks at this step."""
    w = Window.partitionBy(*block)
    clean = F.sum(F.when(F.col(masked), 0).otherwise(1)).over(w)
    target = F.least(F.floor(F.lit(float(block_size)) * step / steps), F.lit(block_size))
    place = F.row_number().over(w.orderBy(F.desc(masked), F.desc(confidence), pos))
    return df.withColumn("commit", F.col(masked) & (place <= F.greatest(F.lit(0), target - clean)))


def decayed_counts(blocks: DataFrame, key: list[str], decay: float, block: str = "block", token: str = "token") -> DataFrame:
    """``(key, token, count)`` after the last block: counts of each block decayed once for every block since."""
    n = blocks.groupBy(*key, block, token).agg(F.count(F.lit(1)).alias("n"))
    last = n.withColumn("__last", F.max(block).over(Window.partitionBy(*key)))
    return last.groupBy(*key, token).agg(F.sum(F.col("n") * F.pow(F.lit(decay), (F.col("__last") - F.col(block)).cast("double"))).alias("count"))


def truncated(tokens: Column, length: int, eos: int = 0) -> tuple[Column, Column]:
    """Tokens before the first end token and ``stop``, else the first ``length`` and ``length``."""
    at = F.array_position(tokens, eos)
    return F.when(at > 0, F.slice(tokens, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int"))).otherwise(F.slice(tokens, 1, length)), F.when(at > 0, "stop").otherwise("length")


def text_ids(tokens: Column, special: tuple[int, ...] = (65534, 65535)) -> Column:
    """Without special ids; repeated ids stay."""
    return F.filter(tokens, lambda t: ~t.isin(*special))


def in_region(df: DataFrame, key: list[str], pos: str, token: str, begin, end) -> DataFrame:
    """Add ``inside``: positions after the last ``begin`` up to and with the next ``end``."""
    w = Window.partitionBy(*key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col(token).isin(begin, end), F.col(token))
    return df.withColumn("inside", F.coalesce(F.last(mark, ignorenulls=True).over(w) == begin, F.lit(False)))

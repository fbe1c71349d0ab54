"""Mixing sources to target weights by iterative proportional fitting, in Spark expressions only.

Documents are aggregated to cells (one per combination of source, language and topic).
The cells' token weights are raked to each marginal in turn until all marginals hold; a
document is then kept with its cell's calibrated probability, by a hash of its key, so
the sample is the same in every run.

A marginal's target is given as shares by label, or is its token share raised to
``power`` and normalised: below 1 it favours small categories. A cell asked for more than
it holds gives all it has, and the shares miss the targets by that. The sample is as large
as it can be with at most ``LOSS`` of its tokens missed so, so neither a rare label nor a
few cells bound it; marginals that no weights meet (a label that occurs with one other
label only) are missed in the same way. A given ``fraction`` sets the size instead.

Defined results: nulls are a category of their own in each dimension; a label without a
given share has none, and given shares of labels that do not occur are left out, the
others scaled to one; a null or empty text weighs nothing and shares its cell's
probability; a cell without tokens keeps all its rows; equal keys share their fate;
columns of any name are carried; no rows give no rows. Given targets that no weights of
the cells there are can meet raise ``ValueError``; shares by power that cannot be met
give a warning that names the share missed, and the last dimension's hold.
"""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop, require, save, small_enough

#: Raking ends when all marginals hold to ``TOLERANCE``, tested every ``TEST_EVERY`` rounds; at ``ROUNDS`` at most the share ``MISS`` of the tokens may lie with other labels than wanted.
ROUNDS, TEST_EVERY, TOLERANCE, MISS = 32, 8, 1e-12, 1e-2
#: Part of the sample's tokens that cells asked for too much may lack; sizes that are tried, as parts of one.
LOSS, SIZES = 0.0005, 1000
#: Cells that one task rakes.
CELLS_IN_ONE_TASK = 100_000
#: Exponents of the target shares by dimension.
POWERS = {"source": 0.7, "lang": 0.7, "topic": 0.9}


def token_weight(text: Column) -> Column:
    """Tokens of a text, taken as a quarter of its UTF-8 bytes, rounded up."""
    return F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / F.lit(4.0)).cast("long")


def topic_of(text: Column) -> Column:
    """A text's coarse topic by what it contains."""
    return F.when(text.contains(" | "), "table").when(text.contains("Licensed"), "licence").when(text.contains("@"), "contact").otherwise("prose")


def uniform(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from the first 52 bits of the key's MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substr(digest, F.lit(1), F.lit(13)), 16, 10).cast("double") / F.lit(float(1 << 52))


def _label(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("\x00null"))


def _with_targets(cells: DataFrame, dims: list[str], powers: dict[str, float], targets: dict[str, dict[str, float]]) -> DataFrame:
    """``cells`` with each dimension's target total in ``target_<dim>``."""
    out = cells
    for dim in dims:
        sums = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("t")).where("t > 0")
        if dim in targets:
            given = F.create_map(*[F.lit(x) for pair in targets[dim].items() for x in pair])
            part = F.coalesce(F.try_element_at(given, F.col(dim)), F.lit(0.0)).cast("double")
        else:
            part = F.pow("t", F.lit(powers[dim]))
        scale = sums.agg((F.sum("t") / F.nullif(F.sum(part), F.lit(0.0))).alias("scale"), F.count("*").alias("n")).first()
        if scale["n"] and scale["scale"] is None:
            raise ValueError(f"no label of {dim} that occurs has a target")
        out = out.join(small_enough(sums.select(dim, (part * F.lit(scale["scale"] or 0.0)).alias(f"target_{dim}"))), dim, "left")
    return out.select(*cells.columns, *[f"target_{d}" for d in dims])


def rake(cells: DataFrame, powers: dict[str, float] = POWERS, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (dimensions, tokens) with ``weight``: tokens raked to the targets, with the same total.

    A step is a window over one dimension; some rounds are one plan, in one task where a
    count shows few cells, and are written before their marginals are tested.
    """
    dims = list(powers)
    cells = save(cells, "cells")
    one_task = cells.count() <= CELLS_IN_ONE_TASK
    now = save(_with_targets(cells, dims, powers, targets or {}).withColumn("weight", F.col("tokens").cast("double")), "cells")
    done = 0
    while done < rounds:
        step = now.coalesce(1) if one_task else now
        for _ in range(min(TEST_EVERY, rounds - done)):
            for dim in dims:
                has = F.sum("weight").over(Window.partitionBy(dim))
                step = step.withColumn("weight", F.when(has > 0, F.col("weight") * F.col(f"target_{dim}") / has).otherwise(F.col("weight")))
        done += TEST_EVERY
        before, now = now, save(step, "cells")
        drop(before)
        miss = 0.0
        for dim in dims:
            off = F.abs(F.sum("weight") - F.max(f"target_{dim}"))
            sums = now.groupBy(dim).agg(off.alias("off"), F.sum("weight").alias("has")).agg(F.sum("off"), F.sum("has")).first()
            miss = max(miss, (sums[0] or 0.0) / 2 / max(sums[1] or 0.0, 1.0))
        if miss < TOLERANCE:
            break
    if miss > MISS:
        found = f"no weights meet all targets: {miss:.3f} of the tokens lie with other labels after {rounds} rounds"
        if targets:
            raise ValueError(found)
        warnings.warn(found, stacklevel=2)
    drop(cells)
    return now.drop(*[f"target_{d}" for d in dims])


def largest_fraction(raked: DataFrame) -> float:
    """The largest size at which cells asked for more than they hold lack at most ``LOSS`` of the sample.

    Cells are summed by the size from which they lack tokens; ``SIZES`` rows at most come to the driver.
    """
    total = raked.agg(F.sum("weight")).first()[0] or 0.0
    short = raked.where("weight > 0 and tokens < weight").groupBy(F.ceil(F.col("tokens") / F.col("weight") * SIZES).alias("k")).agg(F.sum("weight").alias("weight"), F.sum("tokens").alias("tokens"))
    found = {r.k: (r.weight, r.tokens) for r in short.collect()}
    weight = tokens = 0.0
    for k in range(SIZES + 1):
        weight, tokens = weight + found.get(k, (0.0, 0))[0], tokens + found.get(k, (0.0, 0))[1]
        if k and (k / SIZES * weight - tokens) / (k / SIZES * total or 1.0) > LOSS:
            return max(k - 1, 1) / SIZES
    return 1.0


def named(column: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def mix(docs: DataFrame, dims: dict[str, Column], key: str = "doc_id", text: str = "text", fraction: float | None = None, powers: dict[str, float] = POWERS, targets: dict[str, dict[str, float]] | None = None, seed: int = 0, name: str = "mix") -> DataFrame:
    """All columns of ``docs`` with a struct ``name``: dimensions, tokens, probability, kept.

    ``targets`` gives shares by dimension and label, in place of the power of the token share.
    ``fraction`` is the wanted total against the tokens there are, before cells give out;
    none given: that of ``largest_fraction``.
    Cells are few against documents; they are broadcast where a count shows it, else
    joined by shuffle, where AQE splits a hot cell.
    """
    require(docs, key, text)
    if name in docs.columns:
        raise ValueError(f"there is a column {name} already; give another name")
    tag = f"__mix_{uuid.uuid4().hex[:8]}_"
    marked = docs.select("*", *[_label(c).alias(tag + d) for d, c in dims.items()], token_weight(docs[text]).alias(tag + "tokens"))
    cells = marked.groupBy(*[F.col(tag + d).alias(d) for d in dims]).agg(F.sum(tag + "tokens").alias("tokens"))
    raked = rake(cells, {d: powers[d] for d in dims}, targets)
    if fraction is None:
        fraction = largest_fraction(raked)
    wanted = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.lit(fraction) * F.col("weight") / F.col("tokens"))).otherwise(F.lit(1.0))
    chance = small_enough(raked.select(*[F.col(d).alias(tag + d) for d in dims], wanted.alias(tag + "p")))
    out = marked.join(chance, [tag + d for d in dims])
    facts = [*[F.col(tag + d).alias(d) for d in dims], F.col(tag + "tokens").alias("tokens"), F.col(tag + "p").alias("probability"), (uniform(docs[key], seed) < F.col(tag + "p")).alias("kept")]
    return out.select(*[named(c) for c in docs.columns], F.struct(*facts).alias(name))


def document_dims(docs: DataFrame) -> dict[str, Column]:
    """Source, language and topic of a table like ``documents``."""
    return {"source": docs["source"], "lang": docs["lang"], "topic": topic_of(F.coalesce(docs["text"], F.lit("")))}


def mix_documents(docs: DataFrame, fraction: float | None = None, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, probability, kept) for each document."""
    docs = docs.select("doc_id", "text", "source", "lang")
    return mix(docs, document_dims(docs), fraction=fraction, targets=targets).select("doc_id", "mix.source", "mix.lang", "mix.topic", "mix.tokens", F.round("mix.probability", 6).alias("probability"), "mix.kept")


def keep_mixed(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """The documents that the mix keeps, columns unchanged."""
    name = f"__mix_{uuid.uuid4().hex[:8]}"
    return mix(docs, document_dims(docs), targets=targets, name=name).where(f"{name}.kept").drop(name)

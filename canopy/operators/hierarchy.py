"""Label hierarchy as data: relabelled, capped training sets for each level, and routing (H0 to H4, M3).

A ``Level`` says which taxa it takes, how they are renamed and how many of which are kept.
``LEVELS`` is the default hierarchy; any other list of levels works the same way.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.operators.windows import first_n, n_individuals, shuffled_first_n

#: The focal taxon, the conifers besides it, and the mark of oak codes.
FOCAL, CONIFERS, OAK_MARK = "PIPA2", ("PICL", "PIEL", "PITA"), "QU"


@dataclass(frozen=True)
class Caps:
    """Ceilings of the sampled levels."""

    other: int = 500
    evergreen: int = 70
    oaks: int = 200
    conifer_share: int = 11
    oak_share: int = 5


@dataclass(frozen=True)
class Level:
    """``takes``: rows of the level; ``renames``: their label; ``sample``: training rows kept."""

    number: int
    takes: Callable[[Column], Column]
    renames: Callable[[Column], Column]
    sample: Callable[[DataFrame, str, str, list[str], int], DataFrame]


def _oak(t: Column) -> Column:
    return t.contains(OAK_MARK)


def _conifer(t: Column) -> Column:
    return t.isin(list(CONIFERS))


def _cap_individuals(df: DataFrame, keys: list[str], individual: str, n, seed: int, order: str = "id") -> DataFrame:
    return n_individuals(df, keys, individual, n, order=order, seed=seed)


def levels(caps: Caps = Caps(), order: str = "id") -> list[Level]:
    """The default hierarchy. ``order``: which individuals a cap keeps, the first by ``id`` or a seeded ``hash``."""

    def other(df, taxon, individual, seq, seed):
        focal = F.col(taxon) == FOCAL
        rest = df.filter(~focal)
        first = first_n(rest, [individual], seq)
        ids = first_n(first, [taxon], [individual, *seq], caps.other).select(individual)
        return df.filter(focal).unionByName(rest.join(ids, individual, "left_semi"))

    def broadleaf(df, taxon, individual, seq, seed):
        conifer = _conifer(F.col(taxon))
        cap = -(-df.filter(conifer).count() // caps.conifer_share)
        kept = _cap_individuals(df.filter(~conifer), [taxon], individual, cap, seed, order).select(individual)
        ids = kept.union(df.filter(conifer).select(individual)).distinct()
        return df.join(ids, individual, "left_semi")

    def oak(df, taxon, individual, seq, seed):
        is_oak = _oak(F.col(taxon))
        rest = df.filter(~is_oak)
        cap = rest.count() // caps.oak_share
        key = F.concat_ws("|", F.col(individual).cast("string"), *[F.col(c).cast("string") for c in seq])
        rows = shuffled_first_n(df.filter(is_oak).withColumn("__key", key), [taxon], "__key", cap, seed).select(individual)
        return df.join(rows.union(rest.select(individual)).distinct(), individual, "left_semi")

    def evergreen(df, taxon, individual, seq, seed):
        return first_n(df, [taxon], seq, caps.evergreen)

    def oaks(df, taxon, individual, seq, seed):
        return _cap_individuals(df, [taxon], individual, caps.oaks, seed, order)

    return [
        Level(0, lambda t: t.isNotNull(), lambda t: F.when(t == FOCAL, t).otherwise(F.lit("OTHER")), other),
        Level(1, lambda t: t != FOCAL, lambda t: F.when(_conifer(t), F.lit("CONIFER")).otherwise(F.lit("BROADLEAF")), broadleaf),
        Level(2, lambda t: (t != FOCAL) & ~_conifer(t), lambda t: F.when(_oak(t), F.lit("OAK")).otherwise(t), oak),
        Level(3, _conifer, lambda t: t, evergreen),
        Level(4, _oak, lambda t: t, oaks),
    ]


def level_data(df: DataFrame, level: Level, *, taxon: str = "taxonID", individual: str = "individual", seq: list[str] | None = None, train: bool = True, seed: int = 0) -> DataFrame:
    """H0 to H4: the rows of a level with their level label; only training rows are sampled."""
    rows = df.filter(level.takes(F.col(taxon)))
    if train:
        rows = level.sample(rows, taxon, individual, seq or ["seq"], seed)
    return rows.withColumn("level", F.lit(level.number)).withColumn("level_taxon", level.renames(F.col(taxon)))


def all_levels(df: DataFrame, hierarchy: list[Level] | None = None, **names) -> DataFrame:
    """Rows of all levels under one another."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [level_data(df, level, **names) for level in hierarchy or levels()])


def label_order(df: DataFrame, taxon: str = "level_taxon", seq: str = "seq", last: str | None = "OAK") -> DataFrame:
    """H2: labels in order of first appearance, one of them at the end; numbers from 0."""
    from pyspark.sql.window import Window

    first = df.groupBy(taxon).agg(F.min(seq).alias("__first")).withColumn("__last", F.coalesce(F.col(taxon) == F.lit(last), F.lit(False)))
    return first.withColumn("label", (F.row_number().over(Window.orderBy("__last", "__first")) - 1).cast("int")).drop("__first", "__last")


@dataclass(frozen=True)
class Route:
    """At ``level``: ``go`` leads from a label to the next level; any other label is final, or ``otherwise`` a level."""

    level: int
    go: dict[str, int]
    otherwise: int | None = None


#: The focal taxon stops; the rest goes on by broadleaf, oak and conifer.
ROUTES = (Route(0, {FOCAL: -1}, 1), Route(1, {"BROADLEAF": 2}, 3), Route(2, {"OAK": 4}), Route(3, {}), Route(4, {}))


def route(df: DataFrame, routes=ROUTES, taxon: str = "taxon_level_{}", score: str = "score_level_{}") -> DataFrame:
    """M3: ensembleTaxonID, ens_score and ens_level from the labels and scores of all levels."""
    by = {r.level: r for r in routes}

    def walk(level: int, what) -> Column:
        r, here = by[level], F.col(taxon.format(level))
        end = what(level)
        rest = end if r.otherwise is None else walk(r.otherwise, what)
        for label, to in r.go.items():
            rest = F.when(here == label, end if to < 0 else walk(to, what)).otherwise(rest)
        return rest

    return df.withColumns({
        "ensembleTaxonID": walk(0, lambda k: F.col(taxon.format(k))),
        "ens_score": walk(0, lambda k: F.col(score.format(k))),
        "ens_level": walk(0, lambda k: F.lit(k)),
    })

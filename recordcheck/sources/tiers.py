"""Searches in tiers: which source is asked for which citations, as a table of conditions.

A tier names a source and a condition on what is known of a citation when its turn comes. Each tier is an anti-join by that condition: citations
that no longer need it are not asked for, and a tier with none left is not run. What a tier found is judged and stored before the next.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordcheck.sources.lookups import Source
from recordcheck.storage import stored


@dataclass(frozen=True)
class Tier:
    """`when`: SQL over the columns of the asked citations and strong, strong_published, strong_preprint. `number` orders records."""

    source: str
    number: int
    when: str
    #: Leave out citations for which the source was asked in an earlier tier.
    fresh: bool = False


#: A source is asked as long as nothing it could add to is settled: published versions for preprints, DataCite where there is no DOI.
DISCOVERY = (
    Tier("Crossref", 3, "discover"),
    Tier("DBLP", 4, "discover AND (NOT strong_published OR wants_published)"),
    Tier("OpenAlex", 5, "discover AND NOT strong"),
    Tier("DBLP", 6, "clean", fresh=True),
    Tier("DataCite", 7, "no_doi AND NOT strong"),
)


@dataclass(frozen=True)
class Tiered:
    """records: (citation_id, tier, nth, work, strong); statuses: (citation_id, source, status); asked: per tier how many citations."""

    records: DataFrame
    statuses: list[DataFrame]
    asked: list[tuple[str, int]]


def strength(records: DataFrame) -> DataFrame:
    """(citation_id, work, strong) -> (citation_id, strong, strong_published, strong_preprint)."""
    preprint = F.coalesce("work.is_preprint", F.lit(False))
    return records.groupBy("citation_id").agg(F.max("strong").alias("strong"), F.max(F.col("strong") & ~preprint).alias("strong_published"), F.max(F.col("strong") & preprint).alias("strong_preprint"))


def with_strength(asked: DataFrame, records: DataFrame) -> DataFrame:
    return asked.join(strength(records), "citation_id", "left").fillna(False, ["strong", "strong_published", "strong_preprint"])


def search_tiers(asked: DataFrame, known: DataFrame, sources: dict[str, Source], judge: Callable[[DataFrame], DataFrame], tiers: Sequence[Tier] = DISCOVERY) -> Tiered:
    """asked (citation_id, norm_title, and columns that conditions name), known records -> Tiered.

    judge: (citation_id, tier, nth, work) -> the same with `strong`. Both inputs are stored tables.
    """
    records, statuses, counts = known, [], []
    done: dict[str, list[DataFrame]] = {}
    for tier in tiers:
        chosen = with_strength(asked, records).filter(tier.when)
        if tier.fresh:
            for before in done.get(tier.source, ()):
                chosen = chosen.join(before, "citation_id", "left_anti")
        chosen = stored(chosen.select("citation_id", "norm_title"), "tier-chosen")
        counts.append((tier.source, chosen.count()))
        if not counts[-1][1]:
            continue
        hits = stored(sources[tier.source].search(chosen), "tier-hits")
        statuses.append(hits.select("citation_id", F.lit(tier.source).alias("source"), "status").distinct())
        got = hits.filter("status = 'OK'").select("citation_id", F.lit(tier.number).alias("tier"), F.col("pos").alias("nth"), "work")
        records = stored(records.unionByName(judge(got)), "tier-records")
        done.setdefault(tier.source, []).append(chosen.select("citation_id"))
    return Tiered(records, statuses, counts)

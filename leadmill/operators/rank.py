"""Search results: relevance, cleaning, scoring, choice of engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.functions import phrases, urls, vocab
from leadmill.functions.text import phrase_array
from leadmill.functions.vocab import Niche
from leadmill.operators import deny
from leadmill.operators.reuse import computed_once
from leadmill.operators.merge import first_per_key, top_n_per_key


def clean_candidates(
    results: DataFrame, deny_hosts: Sequence[str] | DataFrame = vocab.DEFAULT_DENY_HOSTS
) -> DataFrame:
    """Content pages become their site root, then junk addresses are dropped."""
    rooted = computed_once(results.withColumn("url", urls.to_site_root("url")))
    return deny.drop_denied(rooted.filter(urls.is_page_url("url")), "url", deny_hosts)


def haystack(url: str = "url", title: str = "title") -> Column:
    return F.lower(F.concat(F.col(url), F.lit(" "), F.coalesce(F.col(title), F.lit(""))))


def is_relevant(n: Column, hits: Column, min_ratio: float = vocab.RELEVANT_RATIO) -> Column:
    """Enough of *n* results hit the niche; no results pass."""
    needed = F.greatest(F.lit(1), F.floor(n * F.lit(min_ratio)).cast("int"))
    return (n == 0) | (hits >= needed)


def result_hits(niches: Sequence[Niche] = vocab.NICHES) -> Column:
    return phrases.in_scope(haystack(), "niche", niches)


def relevance(
    results: DataFrame,
    by: list[str],
    niches: Sequence[Niche] = vocab.NICHES,
    min_ratio: float = vocab.RELEVANT_RATIO,
) -> DataFrame:
    """Per group of results: how many, how many hit the niche, the verdict."""
    agg = results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_results"),
        F.count_if(result_hits(niches)).alias("n_hits"),
    )
    return agg.withColumn("relevant", is_relevant(F.col("n_results"), F.col("n_hits"), min_ratio))


def candidate_score(niches: Sequence[Niche] = vocab.NICHES) -> Column:
    """Relevance of one result to its niche; expects ``hay, url, title, niche``."""

    def of_niche(pick) -> Column:
        return phrases.by_niche(
            "niche", niches, lambda n: phrase_array(pick(n)), phrase_array([])
        )

    scope = phrases.hits("hay", of_niche(lambda n: n.scope_keywords))
    exclusion = phrases.hits("hay", of_niche(lambda n: n.exclusion_keywords))
    junk = phrases.hits("hay", phrase_array(vocab.JUNK_TITLE_PHRASES))
    shallow = F.when(urls.path_depth("url") <= 1, F.lit(1)).otherwise(F.lit(0))
    return F.when(phrases.name_denied("title"), F.lit(-100)).otherwise(
        scope * 2 - exclusion * 4 - junk * 3 + shallow
    )


def score_candidates(results: DataFrame, niches: Sequence[Niche] = vocab.NICHES) -> DataFrame:
    hay = results.withColumn("hay", haystack())
    return hay.withColumn("score", candidate_score(niches).cast("int")).drop("hay")


def query_order(results: DataFrame) -> list[str]:
    """Order of results inside a niche: the place of their query there, then their rank.

    ``query_pos`` is that place; results without it go by the text of the query.
    Discovered results also carry ``source_rank``: those of the cache come first.
    """
    place = "query_pos" if "query_pos" in results.columns else "query"
    return [place, *(["source_rank"] if "source_rank" in results.columns else []), "rank"]


def probe_budget(max_leads: int) -> int:
    return max(15, max_leads * 3)


def rank_candidates(
    results: DataFrame,
    max_leads: int = 20,
    niches: Sequence[Niche] = vocab.NICHES,
    order: Sequence[str] | None = None,
    budget: int | None = None,
) -> DataFrame:
    """Best candidates per niche, as many as the probe budget allows.

    *budget* defaults to `probe_budget` of *max_leads*.

    ``probe_pos`` is the place of a candidate in its niche.
    """
    scored = computed_once(score_candidates(results, niches)).filter(
        F.col("score") >= vocab.CANDIDATE_MIN_SCORE
    )
    return top_n_per_key(
        scored, ["niche"], [F.desc("score"), *(order or query_order(results))],
        probe_budget(max_leads) if budget is None else budget, pos="probe_pos"
    )


def skip_prior(candidates: DataFrame, prior: DataFrame) -> DataFrame:
    """Drop candidates on a domain the prior leads hold; no domain is kept."""
    known = (
        prior.select(urls.domain_of("website").alias("_domain"))
        .filter(F.col("_domain").isNotNull())
        .distinct()
    )
    return (
        candidates.withColumn("_domain", urls.domain_of("url"))
        .join(known, "_domain", "left_anti")
        .drop("_domain")
    )


def first_results(results: DataFrame, by: list[str], n: int) -> DataFrame:
    """First *n* distinct results of each engine query."""
    return top_n_per_key(first_per_key(results, [*by, "url"], ["rank"]), by, ["rank"], n)


def first_engine(
    results: DataFrame,
    niches: Sequence[Niche] = vocab.NICHES,
    deny_hosts: Sequence[str] | DataFrame = vocab.DEFAULT_DENY_HOSTS,
) -> DataFrame:
    """Results of the first engine, in priority order, that served the query.

    An engine serves a query when it returned something and what survives
    cleaning is on topic for the niche that asked.  Engines are judged from counts, so the results
    themselves are only joined to the small table of choices.
    """
    rooted = computed_once(
        results.select("query", "niche", "engine_pos", "title", urls.to_site_root("url").alias("_root"))
    )
    rooted = deny.flag_denied(rooted, "_root", "_denied", deny_hosts)
    clean = urls.is_page_url("_root") & ~F.col("_denied")
    hay = F.lower(F.concat("_root", F.lit(" "), F.coalesce("title", F.lit(""))))
    tested = rooted.select(
        "query", "niche", "engine_pos", clean.alias("_clean"),
        phrases.in_scope(hay, "niche", niches).alias("_hit"),
    )
    judged = (
        computed_once(tested)
        .groupBy("query", "niche", "engine_pos")
        .agg(
            F.count_if("_clean").alias("n"),
            F.count_if(F.col("_clean") & F.col("_hit")).alias("hits"),
        )
        .filter(is_relevant(F.col("n"), F.col("hits")))
    )
    chosen = judged.groupBy("query", "niche").agg(F.min("engine_pos").alias("engine_pos"))
    return results.join(chosen, ["query", "niche", "engine_pos"], "left_semi")


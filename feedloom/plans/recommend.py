"""End-to-end recommendation for a set of users."""

from __future__ import annotations

from dataclasses import astuple, dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.config import Settings
from feedloom.operators import candidates as C
from feedloom.operators import catalogue as K
from feedloom.operators import diversity as Y
from feedloom.operators import encoding as E
from feedloom.operators import history as H
from feedloom.operators import profiles as P
from feedloom.operators import ranking as R
from feedloom.operators import user_slices
from feedloom.operators.pairwise import Sizes
from feedloom.session import materialise, materialise_all
from feedloom.taxonomy import Taxonomy


@dataclass
class Inputs:
    """The tables a run reads. ``vectors`` may live in any space; ``slot_names`` names its dimensions.

    ``users`` (user_id) says whom a run serves, users without any history included; by default all users of the log.
    ``stored`` holds profiles and creator affinities that were built before; without it both are built from the log.
    """

    events: DataFrame
    items: DataFrame
    features: DataFrame
    vectors: DataFrame
    tax: Taxonomy
    slot_names: list[str]
    s: Settings
    users: DataFrame | None = None
    stored: tuple[DataFrame, DataFrame] | None = None

    @property
    def dim(self) -> int:
        return len(self.slot_names)

    @cached_property
    def eligible(self) -> DataFrame:
        return K.eligible_items(self.items, self.vectors, self.features, self.tax.version, self.dim)

    @cached_property
    def ranking_items(self) -> DataFrame:
        return K.ranking_items(self.eligible, self.features, H.popularity(self.engagement), self.tax, self.s)

    @cached_property
    def tags(self) -> DataFrame:
        return E.item_tags(self.features, self.tax)

    @cached_property
    def usable_vectors(self) -> DataFrame:
        return K.current_vectors(self.vectors, self.tax.version, self.dim)

    @cached_property
    def pairs(self) -> DataFrame:
        """One row per (user, item): profiles, creator affinity and the seen set all start here. Stored profiles leave only the seen set."""
        return P.signal_pairs(self.user_events, self.s) if self.stored is None else H.seen_pairs(self.user_events)

    @cached_property
    def user_events(self) -> DataFrame:
        """The log of the users served. What is known about items comes from the whole log."""
        return self.events if self.users is None else self.events.join(self.users.select("user_id").distinct(), "user_id", "left_semi")

    @cached_property
    def seen(self) -> DataFrame:
        return self.pairs.select("user_id", "item_id")

    @cached_property
    def history(self) -> DataFrame:
        return P.history(self.pairs, self.items, self.usable_vectors)

    @cached_property
    def profiles(self) -> DataFrame:
        if self.stored is not None:
            known = self._served(self.stored[0])
        else:
            known = P.build_profiles(self.history, self.usable_vectors, self.slot_names, self.tax.version, self.s)
        return known if self.users is None else P.with_cold_users(known, self.users, self.slot_names, self.tax.version)

    @cached_property
    def creator_affinity(self) -> DataFrame:
        return P.creator_affinity(self.history, self.s) if self.stored is None else self._served(self.stored[1])

    def _served(self, rows: DataFrame) -> DataFrame:
        return rows if self.users is None else rows.join(self.users.select("user_id").distinct(), "user_id", "left_semi")

    def without_newcomers(self) -> tuple[Inputs, DataFrame | None, int]:
        """These inputs for the users with history, the users (user_id) without an event or stored profile, if any, and how many these are."""
        if self.users is None:
            return self, None, 0
        known = self.pairs.select("user_id") if self.stored is None else self.pairs.select("user_id").union(self.stored[0].select("user_id"))
        marked = self.users.select("user_id").distinct().join(known.distinct().withColumn("known", F.lit(True)), "user_id", "left")
        parted = materialise(marked.select("user_id", (F.col("known").isNotNull() | F.col("user_id").isNull()).alias("known")))
        newcomers = parted.where("NOT known").select("user_id")
        n = newcomers.count()
        rest = replace(self, users=parted.where("known").select("user_id"))
        rest.pairs = self.pairs
        return (rest, newcomers, n) if n else (self, None, 0)

    @cached_property
    def engagement(self) -> DataFrame:
        return H.engagement(self.events, self.s)

    @cached_property
    def recent(self) -> DataFrame:
        return H.recent_items(self.user_events, self.eligible, self.s)


@dataclass
class Recommendation:
    """``per_source`` (user_id, item_id, source) is what the sources gave users with history, as written. Scoring and selecting combine these rows where they meet
    users and items; only who asks for ``candidates`` has them combined and written. Candidates of ``newcomers`` (user_id) are made by whatever reads them."""

    per_source: DataFrame
    profiles: DataFrame
    newcomers: DataFrame | None
    affinity: DataFrame
    repetition: DataFrame
    items: DataFrame
    seen: DataFrame
    size: Sizes
    n_newcomers: int
    inputs: Inputs
    limit: int

    @cached_property
    def _everyone(self) -> DataFrame:
        if self.newcomers is None:
            return self.profiles
        return self.profiles.unionByName(P.cold_profiles(self.newcomers, self.profiles, self.inputs.slot_names, self.inputs.tax.version))

    @property
    def _sides(self) -> tuple[DataFrame, ...]:
        return self.items, self._everyone, self.affinity, self.repetition

    @property
    def _all(self) -> Sizes:
        return Sizes(self.size.users + self.n_newcomers, self.size.items)

    @property
    def _new(self) -> DataFrame:
        return R.score_newcomers(self.newcomers, self.items, self.inputs.s, Sizes(self.n_newcomers, self.size.items))

    @cached_property
    def base(self) -> DataFrame:
        return C.user_base(self._everyone, self.seen)

    @cached_property
    def candidates(self) -> DataFrame:
        known = C.union_sources(self.per_source)
        return materialise(known if self.newcomers is None else known.unionByName(self._new.select(*known.columns)))

    def score(self, candidates: DataFrame) -> DataFrame:
        return R.score_candidates(candidates, *self._sides, self.inputs.s, size=self._all)

    @property
    def scored(self) -> DataFrame:
        """All candidates with their terms. ``selected`` does not read it: it scores and selects in one pass."""
        if self.newcomers is None:
            return self.score(self.per_source)
        known = R.score_candidates(self.per_source, self.items, self.profiles, self.affinity, self.repetition, self.inputs.s, size=self.size)
        return known.unionByName(self._new)

    @cached_property
    def selected(self) -> DataFrame:
        rows = self.per_source if self.newcomers is None else self.candidates
        return user_slices.selected(rows, *self._sides, *astuple(self._all), self.limit, self.inputs.s)


def recommend(inputs: Inputs, limit: int, users: DataFrame | None = None) -> Recommendation:
    """Candidates, scores and the diversified list. ``users`` (user_id) overrides the users of ``inputs``.

    The log is cut to these users before profiles, affinities and seen sets are built; users without history are cold and get
    the global sources. Profiles and the item table feed several branches, so each is written once to the shared folder.
    """
    if users is not None:
        inputs = replace(inputs, users=materialise(users.select("user_id").distinct()))
    s = inputs.s
    inputs.pairs, items = materialise_all(inputs.pairs, inputs.ranking_items)
    inputs, newcomers, n_newcomers = inputs.without_newcomers()
    profiles = materialise(inputs.profiles)
    size = Sizes.of(profiles, items)
    sources = C.generate(C.user_base(profiles, inputs.seen), items, inputs.seen, inputs.tax, size, s)
    listed, similar, explore, affinity, repetition = materialise_all(
        *sources.values(),
        inputs.creator_affinity,
        H.recent_repetition(H.recent_items(inputs.user_events, items, s), items, inputs.tax.dim),
    )
    per_source = listed.unionByName(similar).unionByName(explore)
    return Recommendation(per_source, profiles, newcomers, affinity, repetition, items, inputs.seen, size, n_newcomers, inputs, limit)


def diagnostics(run: Recommendation, limit: int) -> DataFrame:
    counts = C.candidate_counts(run.base, run.candidates, run.items, run.seen, limit)
    cold = run.base.select("user_id", F.col("is_cold_start").alias("cold_start"))
    return (
        counts.join(cold, "user_id")
        .join(Y.relaxation(run.selected), "user_id", "left")
        .fillna({"returned": 0, "relaxed_count": 0, "diversity_relaxed": False})
        .withColumn("requested_limit", F.lit(limit))
    )

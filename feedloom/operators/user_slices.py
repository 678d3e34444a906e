"""Scoring and re-ranking of candidates in slices of users.

A slice takes its users, their creator affinities, each item that one of its candidates names, once, and the candidates as bare ids. So the wide rows
that cross the network are users plus (slice, item) pairs, never candidates, and nothing wide is sorted. A task holds the users and items
of one slice; the candidates stream past it by user, and numpy scores some ten thousand at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.config import RANK_TERMS, Settings
from feedloom.functions.hashing import FNV_PRIME, FNV_SPACE, fnv_states
from feedloom.operators.diversity import RESULT, pick

FEATURES = ("content_similarity", "tag_affinity", "creator_affinity", "popularity", "freshness", "fatigue", "exploration", "quality")
_ITEM_NUMS = ("vector_norm", "popularity", "freshness", "quality", "quality_available")
_SLICE_ROWS, _CHUNK_ROWS = 2_000_000, 40_000
_USER, _AFFINITY, _ITEM, _CANDIDATE = range(4)
_BODY, _NAMES = "array<double>", "array<string>"
_SCORED = "user_id bigint, item_id bigint, bits int, " + ", ".join(f"{x} double" for x in FEATURES) + ", quality_available boolean"


def _sliced(candidates: DataFrame, items: DataFrame, users: list[DataFrame], n_users: int, n_items: int, per_user: int) -> DataFrame:
    """Rows (slice, kind, a, b, bits, score, body, names), dealt by slice and sorted by kind and ids. ``items``: (item_id, body, names).

    Candidates have empty lists, not null: Arrow's writer looks through a run of null lists again for every row.
    """
    wide = candidates.sparkSession.sparkContext.defaultParallelism
    n = max(1, math.ceil(n_users * per_user / _SLICE_ROWS), min(4 * wide, math.ceil(n_users / 64)))
    of = F.pmod(F.xxhash64("user_id"), F.lit(n)).cast("int").alias("slice")
    candidates = candidates.where("user_id IS NOT NULL AND item_id IS NOT NULL")
    asked = candidates.select(of, F.lit(_CANDIDATE).alias("kind"), F.col("user_id").alias("a"), F.col("item_id").alias("b"), "bits", "score", F.array().cast(_BODY).alias("body"), F.array().cast(_NAMES).alias("names"))
    if n * n_items <= n_users * per_user:
        named = items.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slice"), "*")
    else:
        named = candidates.select(of, "item_id").distinct().join(items, "item_id")
    empty = [F.lit(0).cast("bigint").alias("b"), F.lit(0).alias("bits"), F.lit(None).cast("double").alias("score"), "body", "names"]
    rows = asked.unionByName(named.select("slice", F.lit(_ITEM).alias("kind"), F.col("item_id").alias("a"), *empty))
    for kind, side in zip((_USER, _AFFINITY), users):
        rows = rows.unionByName(side.where("user_id IS NOT NULL").select(of, F.lit(kind).alias("kind"), F.col("user_id").alias("a"), *empty))
    return rows.repartitionById(n, F.col("slice")).sortWithinPartitions("slice", "kind", "a", "b")


def _body(*parts: F.Column) -> F.Column:
    """Lists of numbers in one list, behind their lengths. One column instead of many keeps the rows of candidates short."""
    lists = [F.coalesce(p.cast(_BODY), F.array().cast(_BODY)) for p in parts]
    return F.concat(F.array(*[F.size(x).cast("double") for x in lists]), *lists).alias("body")


def _named(*names: F.Column) -> F.Column:
    return F.array(*[n.cast("string") for n in names]).alias("names")


def _terms_input(candidates: DataFrame, items: DataFrame, profiles: DataFrame, affinity: DataFrame, repetition: DataFrame, n_users: int, n_items: int, per_user: int) -> DataFrame:
    nums = F.array(*[F.col(x).cast("double") for x in _ITEM_NUMS])
    known = items.select("item_id", _body(F.col("vector"), nums, F.col("tag_slots"), F.col("div_slots")), _named(F.col("creator_id")))
    flags = F.array(F.col("is_cold_start").cast("double"), F.coalesce("recent_size", F.lit(0)).cast("double"))
    people = profiles.select("user_id", "vector", "is_cold_start").join(repetition, "user_id", "left").select(
        "user_id", _body(F.col("vector"), flags, F.col("recent_slots")), F.coalesce("recent_creators", F.array().cast(_NAMES)).alias("names")
    )
    liked = affinity.select("user_id", _body(F.array("score")), _named(F.col("creator_id")))
    return _sliced(candidates, known, [people, liked], n_users, n_items, per_user)


def scored_terms(candidates: DataFrame, items, profiles, affinity, repetition, n_users: int, n_items: int, s: Settings) -> DataFrame:
    """``candidates`` (user_id, item_id, bits) with their ranking features. Rows of one candidate, such as one per source, become one with the bits of all."""
    rows = _terms_input(candidates.withColumn("score", F.lit(None).cast("double")), items, profiles, affinity, repetition, n_users, n_items, sum(s.source_limits.values()))

    def run(batches):
        for slice_, chunk in _chunks(batches):
            chunk = _combined(chunk)
            terms = slice_.terms(chunk, s)
            keep = terms.pop("found")
            table = pa.table({"user_id": chunk["a"][keep], "item_id": chunk["b"][keep], "bits": chunk["bits"][keep], **{x: pa.array(terms[x], from_pandas=True) for x in FEATURES}, "quality_available": terms["quality_available"] > 0})
            yield from table.to_batches(max_chunksize=20_000)

    return rows.mapInArrow(run, _SCORED)


def selected(candidates: DataFrame, items, profiles, affinity, repetition, n_users: int, n_items: int, limit: int, s: Settings) -> DataFrame:
    """Each user's diversified list: scores and selection in one pass, so that scores are never rows. A candidate may have several rows."""
    rows = _terms_input(
        candidates.select("user_id", "item_id", F.lit(0).alias("bits"), F.lit(None).cast("double").alias("score")),
        items, profiles, affinity, repetition, n_users, n_items, sum(s.source_limits.values()),
    )

    def run(batches):
        for slice_, chunk in _chunks(batches):
            chunk = _combined(chunk)
            terms = slice_.terms(chunk, s)
            yield from slice_.picked(chunk["a"][terms["found"]], terms["item"], base_score(terms, s), limit, s)

    return rows.mapInArrow(run, RESULT)


def reranked(scored: DataFrame, items: DataFrame, n_users: int, n_items: int, per_user: int, limit: int, s: Settings) -> DataFrame:
    """``scored`` (user_id, item_id, base_score), diversified with ``items`` (item_id, creator_id, div_slots, vector)."""
    none = F.array().cast(_BODY)
    known = items.select("item_id", _body(F.col("vector"), none, none, F.col("div_slots")), _named(F.col("creator_id")))
    given = scored.select("user_id", "item_id", F.lit(0).alias("bits"), F.col("base_score").alias("score"))

    def run(batches):
        for slice_, chunk in _chunks(batches):
            item, found = slice_.item_rows(chunk["b"])
            yield from slice_.picked(chunk["a"][found], item, chunk["score"][found], limit, s)

    return _sliced(given, known, [], n_users, n_items, per_user).mapInArrow(run, RESULT)


def base_score(terms: dict, s: Settings) -> np.ndarray:
    named = {**terms, "affinity": (terms["content_similarity"] + terms["tag_affinity"]) / 2}
    total = None
    for t in RANK_TERMS:
        part = (-s.rank_weights[t] if t == "fatigue" else s.rank_weights[t]) * named[t]
        total = part if total is None else total + part
    return np.round(total, 12)


def _chunks(batches):
    """(slice, candidates of whole users) as arrays; ``batches`` are sorted by slice, kind, user and item."""
    slice_, held = None, []

    def cut(last: bool):
        rows = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        held.clear()
        end = len(rows["a"]) if last else int(np.searchsorted(rows["a"], rows["a"][-1]))
        if end < len(rows["a"]):
            held.append({k: v[end:] for k, v in rows.items()})
        return {k: v[:end] for k, v in rows.items()}

    for batch in batches:
        t = pa.Table.from_batches([batch])
        number, kinds = t["slice"].to_numpy(), t["kind"].to_numpy()
        edges = np.r_[0, np.flatnonzero((number[1:] != number[:-1]) | (kinds[1:] != kinds[:-1])) + 1, len(kinds)]
        for start, stop in zip(edges[:-1], edges[1:]):
            if stop == start:
                continue
            if slice_ is None or slice_.number != number[start]:
                if held:
                    yield slice_, cut(True)
                slice_ = _Slice(int(number[start]))
            part = t.slice(start, stop - start)
            if kinds[start] != _CANDIDATE:
                slice_.add(int(kinds[start]), part)
                continue
            slice_.close()
            held.append({k: part[k].to_numpy() for k in ("a", "b", "bits", "score")})
            if sum(len(h["a"]) for h in held) >= _CHUNK_ROWS:
                rows = cut(False)
                if len(rows["a"]):
                    yield slice_, rows
    if held:
        yield slice_, cut(True)


def _combined(chunk: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """One row per user and item, which stand side by side, with the bits of all its rows."""
    new = np.r_[True, (chunk["a"][1:] != chunk["a"][:-1]) | (chunk["b"][1:] != chunk["b"][:-1])]
    if new.all():
        return chunk
    starts = np.flatnonzero(new)
    return {k: np.bitwise_or.reduceat(v, starts) if k == "bits" else v[starts] for k, v in chunk.items()}


def _sizes(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)


def _parts(column: pa.Array, fills: tuple) -> list[np.ndarray]:
    """The lists of ``_body`` as one matrix each; shorter rows are filled up."""
    n, flat = len(fills), pc.list_flatten(column).to_numpy(zero_copy_only=False)
    sizes = _sizes(column)
    starts = np.cumsum(sizes) - sizes
    lengths = flat[starts[:, None] + np.arange(n)].astype("i8")
    out, at = [], starts + n
    for k, fill in enumerate(fills):
        wide = int(lengths[:, k].max(initial=0))
        inside = np.arange(wide) < lengths[:, k, None]
        rows = np.full(inside.shape, fill, dtype="f8")
        rows[inside] = flat[(at[:, None] + np.arange(wide))[inside]]
        out.append(rows)
        at = at + lengths[:, k]
    return out


def _stack(parts: list[np.ndarray], fill) -> np.ndarray:
    """Rows of all parts; narrower parts are filled up."""
    wide = max((p.shape[1] for p in parts), default=0)
    even = [p if p.shape[1] == wide else np.pad(p, ((0, 0), (0, wide - p.shape[1])), constant_values=fill) for p in parts]
    return np.concatenate(even) if parts else np.zeros((0, wide))


class _Slice:
    """Users and items of one slice as arrays."""

    def __init__(self, number: int):
        self.number, self.open = number, True
        self.parts: dict[int, list] = {k: [] for k in (_USER, _AFFINITY, _ITEM)}

    def add(self, kind: int, t: pa.Table) -> None:
        ids, body, names = t["a"].to_numpy(), t["body"].combine_chunks(), t["names"].combine_chunks()
        if kind == _USER:
            owner = np.repeat(np.arange(len(ids)), _sizes(names)) + sum(len(p[0]) for p in self.parts[kind])
            self.parts[kind].append((ids, *_parts(body, (0, 0, 0)), owner, pc.list_flatten(names)))
        elif kind == _AFFINITY:
            self.parts[kind].append((ids, _parts(body, (0,))[0][:, 0], pc.list_flatten(names)))
        else:
            vectors, nums, slots, div = _parts(body, (0, 0, -1, -1))
            short = vectors.astype("f4")
            self.parts[kind].append((ids, short if (short == vectors).all() else vectors, nums, slots.astype("i4"), div.astype("i4"), pc.list_flatten(names).dictionary_encode()))

    def close(self) -> None:
        if not self.open:
            return
        self.open = False
        items, users, liked = self.parts.pop(_ITEM), self.parts.pop(_USER), self.parts.pop(_AFFINITY)
        column = lambda rows, k: [r[k] for r in rows]
        self.items = np.concatenate(column(items, 0)) if items else np.zeros(0, "i8")
        self.vectors, self.nums = _stack(column(items, 1), 0), _stack(column(items, 2), 0)
        self.slots, self.div = _stack(column(items, 3), -1).astype("i4"), _stack(column(items, 4), -1).astype("i4")
        names = pa.chunked_array(column(items, 5)).unify_dictionaries() if items else None
        self.names = names.chunk(0).dictionary if items else pa.array([], pa.string())
        codes = [c.indices for c in names.chunks] if items else []
        self.creator = pc.fill_null(pa.chunked_array(codes), -1).to_numpy().astype("i4") if items else np.zeros(0, "i4")
        blank = pc.index_in(pa.scalar("", self.names.type), self.names).as_py()
        if blank is not None:
            self.creator[self.creator == blank] = -1
        self.width = max(1, len(self.names))
        if not users:
            return
        self.users, self.profile, nums, recent = (f(column(users, k)) for k, f in enumerate((np.concatenate, lambda p: _stack(p, 0.0), lambda p: _stack(p, 0.0), lambda p: _stack(p, 0))))
        self.profile_norm = np.sqrt((self.profile * self.profile).sum(axis=1))
        self.profile = np.pad(self.profile, ((0, 0), (0, 1)))  # a slot of another space, or none, counts 0
        self.warm, self.recent_size = nums[:, 0] == 0, nums[:, 1]
        self.recent = np.pad(recent, ((0, 0), (0, 1)))
        self.state = fnv_states([f"{u}|" for u in self.users.tolist()])
        key = self._keys(np.concatenate(column(users, 4)), pa.chunked_array(column(users, 5)))
        self.recent_key, self.recent_n = np.unique(key[key >= 0], return_counts=True)
        at = np.searchsorted(self.users, np.concatenate(column(liked, 0))) if liked else np.zeros(0, "i8")
        score = np.concatenate(column(liked, 1)) if liked else np.zeros(0)
        at = np.minimum(at, len(self.users) - 1)
        mine = self.users[at] == np.concatenate(column(liked, 0)) if liked else np.zeros(0, bool)
        key = np.where(mine, self._keys(at, pa.chunked_array(column(liked, 2), pa.string()) if liked else pa.chunked_array([], pa.string())), -1)
        order = np.argsort(key[key >= 0])
        self.liked_key, self.liked = key[key >= 0][order], score[key >= 0][order]
        texts = [str(i) for i in self.items.tolist()]
        self.digits = np.array([len(x) for x in texts])
        self.codes = np.array(texts, dtype=f"S{max(1, int(self.digits.max(initial=1)))}").view("u1").reshape(len(texts), -1) if texts else np.zeros((0, 1), "u1")

    def _keys(self, owner: np.ndarray, names: pa.ChunkedArray) -> np.ndarray:
        """One number per (user, creator) of this slice's items, -1 for creators no item has."""
        code = pc.fill_null(pc.index_in(names, value_set=self.names), -1).to_numpy().astype("i8")
        known = (code >= 0) & ~pc.is_null(names).to_numpy() if len(code) else code >= 0
        return np.where(known, owner * self.width + code, -1)

    def _looked_up(self, keys, values, user, item) -> np.ndarray:
        key = user * self.width + self.creator[item]
        at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
        hit = (keys[at] == key) & (self.creator[item] >= 0) if len(keys) else np.zeros(len(key), bool)
        return np.where(hit, values[at], 0.0) if len(keys) else np.zeros(len(key))

    def item_rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of every id that is an item, and which ids are."""
        at = np.minimum(np.searchsorted(self.items, ids), max(0, len(self.items) - 1))
        found = self.items[at] == ids if len(self.items) else np.zeros(len(ids), bool)
        return at[found], found

    def terms(self, chunk: dict, s: Settings) -> dict[str, np.ndarray]:
        """Ranking features of the candidates whose user and item are known (``found``)."""
        n_users = len(getattr(self, "users", ()))
        user = np.minimum(np.searchsorted(self.users, chunk["a"]), n_users - 1) if n_users else np.zeros(len(chunk["a"]), "i8")
        mine = self.users[user] == chunk["a"] if n_users else np.zeros(len(user), bool)
        item, found = self.item_rows(chunk["b"])
        found_both = found & mine
        item, user = item[mine[found]], user[found_both]
        if not len(item):
            return {"found": found_both, "item": item, **{x: np.zeros(0) for x in (*FEATURES, "quality_available")}}
        norm, popularity, freshness, quality, available = self.nums[item].T
        warm, dim = self.warm[user], self.profile.shape[1] - 1
        norms = self.profile_norm[user] * norm
        dot = np.einsum("ij,ij->i", self.profile[user, :dim], self.vectors[item])
        tags, total = self.slots[item], np.zeros(len(item))
        for k in range(tags.shape[1]):
            total += self.profile[user, np.where((tags[:, k] >= 0) & (tags[:, k] < dim), tags[:, k], dim)]
        n_tags = (tags >= 0).sum(axis=1)
        div, most = self.div[item], self._looked_up(self.recent_key, self.recent_n, user, item)
        last = self.recent.shape[1] - 1
        for k in range(div.shape[1]):
            most = np.maximum(most, self.recent[user, np.where((div[:, k] >= 0) & (div[:, k] < last), div[:, k], last)])
        n = self.recent_size[user]

        def share(part, whole):
            return np.divide(part, whole, out=np.zeros(len(item)), where=whole != 0)

        def personal(x):
            return np.where(warm & np.isfinite(x), x, 0.0)

        return {
            "found": found_both, "item": item, "content_similarity": personal(share(dot, norms)), "tag_affinity": personal(share(total, n_tags)),
            "creator_affinity": personal(self._looked_up(self.liked_key, self.liked, user, item)), "popularity": popularity, "freshness": freshness,
            "fatigue": share(most, n) * np.minimum(1.0, n / float(s.fatigue_window_items)), "exploration": self._hashes(user, item, s.now[:10]) / FNV_SPACE,
            "quality": quality, "quality_available": available,
        }

    def _hashes(self, user: np.ndarray, item: np.ndarray, day: str) -> np.ndarray:
        """FNV-1a of ``user|item|day``."""
        h, digits, prime = self.state[user], self.digits[item], np.uint32(FNV_PRIME)
        for j in range(int(digits.max())):
            h = np.where(j < digits, (h ^ self.codes[item, j]) * prime, h)
        for c in f"|{day}".encode("ascii"):
            h = (h ^ np.uint32(c)) * prime
        return h

    def picked(self, user, item, base, limit: int, s: Settings):
        """Result rows of whole users, a bounded number of vector components at a time."""
        if not len(user):
            return
        starts = np.r_[np.flatnonzero(np.r_[True, user[1:] != user[:-1]]), len(user)]
        step = max(1, 4_000_000 // (max(1, self.vectors.shape[1]) * int(np.diff(starts).max())))
        for k in range(0, len(starts) - 1, step):
            edges = starts[k : k + step + 1]
            rows = slice(edges[0], edges[-1])
            at, rank, penalty, relaxed = pick(base[rows], self.vectors[item[rows]], self.creator[item[rows]], self.div[item[rows]], edges - edges[0], limit, s)
            at = at + edges[0]
            creator = self.creator[item[at]]
            names = self.names.take(pa.array(creator, mask=creator < 0))
            table = pa.table({"user_id": user[at], "item_id": self.items[item[at]], "rank": rank, "creator_id": names, "base_score": base[at], "diversity_penalty": penalty, "final_score": base[at] - penalty, "relaxed": relaxed})
            yield from table.to_batches(max_chunksize=20_000)

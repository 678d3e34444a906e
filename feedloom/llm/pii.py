"""Personal data: high-recall generators propose spans, boosted trees over format and context choose among them.

Base matches always stay. Beside them, wide generators propose overlapping spans that no base rule accepts: number groups without a plus sign,
cards with other separators, spelled-out addresses and the like. Gradient-boosted trees score each proposal. They are trained on the corpus
itself: base matches written the way that people disguise or shorten them, against other numbers in the same places and against the
corpus' own proposals in plain contexts (see ``weak_labels``). A threshold per kind, calibrated on held-out candidates, decides, and of
proposals that overlap the best stays.
"""

from __future__ import annotations

import pickle
import re
import zlib
from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.llm.common import id_text, share
from feedloom.session import materialise

BASE = ("email", "ip", "card", "phone")
#: Kinds that only proposals have.
MORE = ("address", "number")
KINDS = BASE + MORE

#: The base patterns. Possessive repeats match what greedy ones would, without trying again.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Proposals; none has an upper bound of length.
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)++", re.IGNORECASE | re.ASCII)
_NUMBER = re.compile(r"[(+]?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,}+")
_LOCAL_NUMBER = re.compile(r"(?<![0-9])\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20./-][0-9]{3,4}(?![0-9])")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each at sign outwards: its local part is the run of allowed letters before it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        tail = _DOMAIN.match(text, at + 1) if start < at else None
        done = tail.end() if tail else max(done, at + 1)
        if tail:
            out.append((start, done))
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base matches, by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append((1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            if 16 <= m.end() - m.start() <= 38:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append((3, m.start(), m.end()))
    return out


def proposals(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of wide candidates, sorted; they may overlap one another and base matches."""
    out = set()
    if "(" in text or "[" in text:
        out.update((4, m.start(), m.end()) for m in _SPELLED.finditer(text))
    if _DIGIT.search(text):
        for pattern in (_NUMBER, _LOCAL_NUMBER):
            out.update((5, m.start(), m.end()) for m in pattern.finditer(text))
    return sorted(out)


class Taken:
    """Stretches of a text that are spoken for, as sorted intervals that do not overlap."""

    def __init__(self, spans=()):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def touches(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return i > 0 and self.ends[i - 1] > start

    def add(self, start: int, end: int) -> None:
        """Take a span that touches none taken before."""
        i = bisect_left(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


# ---- features ----

#: Words that often stand before personal data; fixed values.
CUES = ("mail", "e-mail", "contact", "tel", "phone", "call", "fax", "mobile", "card", "visa", "account", "iban", "ip", "host", "address", "ssn")
FEATURES = ("length", "digits", "groups", "first_group", "last_group", "longest_group", "dots", "dashes", "spaces", "brackets", "plus", "at", "slashes", "luhn", "small_parts", "cue", "left_letter", "right_letter", "left_digit", "right_digit", "distinct_digits", "ends_digit", "letters")


def features(text: str, start: int, end: int) -> list[float]:
    """Format of the span and the context around it."""
    span = text[start:end]
    groups = re.findall(r"[0-9]+", span)
    digits = "".join(groups)
    before, after = text[max(0, start - 24) : start], text[end : end + 1]
    left = before[-1:]
    words = re.findall(r"[a-z-]+", before.lower())
    return [
        len(span), len(digits), len(groups), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0, max(map(len, groups), default=0),
        span.count("."), span.count("-"), span.count(" "), span.count("(") + span.count(")"), span.startswith("+"), span.count("@"), span.count("/"),
        len(digits) >= 12 and luhn(digits), len(groups) == 4 and all(len(g) < 4 and int(g) < 256 for g in groups), any(w in CUES for w in words[-3:]),
        left.isalpha(), after.isalpha(), left.isdigit(), after.isdigit(), len(set(digits)), span[-1:].isdigit(), sum(map(str.isalpha, span)),
    ]


# ---- boosted trees ----


@dataclass(frozen=True)
class Settings:
    #: Up to so many different candidates are learned from in one task; more are learned from by distributed passes.
    train_rows: int = 20_000
    trees: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    least_rows: int = 8
    #: Precision that a kind's threshold must reach on held-out candidates, and what it is if none does.
    precision: float = 0.98
    never: float = 1.1


@dataclass
class Forest:
    """Trees as arrays: per inner node the feature and the cut, per leaf a value; children of node i are 2i+1 and 2i+2."""

    prior: float
    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray
    #: Per kind (its number) the least score of a proposal that counts; a kind that is not here never counts.
    thresholds: dict[int, float] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> np.ndarray:
        odds = np.full(len(x), self.prior)
        inner = self.features.shape[1] if len(self.features) else 0
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves):
            node = np.zeros(len(x), np.int64)
            while inner and node.min(initial=inner) < inner:
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
            odds += leaf[node - inner]
        return 1 / (1 + np.exp(-odds))


def gains(gl, hl, nl, g, h, n, settings: Settings) -> np.ndarray:
    """What each cut of a node gains; ``gl``, ``hl`` and ``nl`` are gradient, weight and rows below it, the others those of the node."""
    gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
    gain[(nl < settings.least_rows) | (n - nl < settings.least_rows)] = 0
    return gain


def fit_forest(x: np.ndarray, y: np.ndarray, settings: Settings) -> Forest:
    """Gradient boosting of the logistic loss, by histograms over quantile bins. Rows count alike: the labels are balanced by how rows are made."""
    n, share_of_1 = len(y), (y.sum() + 1) / (len(y) + 2)
    prior = float(np.log(share_of_1 / (1 - share_of_1)))
    inner = 2**settings.depth - 1
    empty = Forest(prior, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if not n or y.min() == y.max():
        return empty
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, settings.bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], axis=1)  # bin b holds x <= cuts[b]
    odds, made = np.full(n, prior), ([], [], [])
    for _ in range(settings.trees):
        p = 1 / (1 + np.exp(-odds))
        gradient, weight = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for i in range(inner):
            rows = np.flatnonzero(node == i)
            best = (1e-6, 0, np.inf)
            g, h = gradient[rows].sum(), weight[rows].sum()
            for j, c in enumerate(cuts):
                if len(rows) < 2 * settings.least_rows or not len(c):
                    continue
                b = binned[rows, j]
                gl = np.cumsum(np.bincount(b, gradient[rows], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, weight[rows], len(c) + 1))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                gain = gains(gl, hl, nl, g, h, len(rows), settings)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, float(c[k]))
            feature[i], cut[i] = best[1], best[2]
            node[rows] = 2 * i + 1 + (x[rows, feature[i]] > cut[i])
        leaf = node - inner
        g, h = np.bincount(leaf, gradient, inner + 1), np.bincount(leaf, weight, inner + 1)
        value = settings.rate * g / (h + 1)
        odds += value[leaf]
        for out, got in zip(made, (feature, cut, value)):
            out.append(got)
    return Forest(prior, *map(np.array, made))


def calibrated(forest: Forest, x: np.ndarray, y: np.ndarray, settings: Settings, weight: np.ndarray | None = None) -> float:
    """A threshold from which on the share of label 1 is ``precision`` or more, on held-out rows that count ``weight`` times.

    Of the thresholds with the most rows that do so it is the one half way to the next row below, or one half where no row is below.
    """
    p = forest.predict(x)
    order = np.argsort(-p, kind="stable")
    n = (np.ones(len(y)) if weight is None else np.asarray(weight, np.float64))[order]
    right = np.cumsum(y[order] * n) / np.cumsum(n)
    last = np.r_[p[order][1:] != p[order][:-1], True] if len(p) else np.zeros(0, bool)  # equal scores stand or fall together
    good = np.flatnonzero((right >= settings.precision) & last)
    if not len(good):
        return settings.never
    lowest = good[-1]
    return float(max((p[order][lowest] + p[order][lowest + 1]) / 2 if lowest + 1 < len(y) else 0.5, 0.5))


# ---- training rows ----

_JOINTS = (" ", "-", ".", "/")


def _letters(name: str) -> str:
    return re.sub(r"[^A-Za-z]+", "", name) or "x"


def disguises(kind: int, span: str) -> list[str]:
    """How people write a base match so that its rule misses it. Which ways are taken hangs on the span alone."""
    turn = zlib.crc32(span.encode())
    if kind == 0:
        local, domain = span.split("@")
        out = []
        for name, t in ((local, turn), (_letters(local), turn // 8)):
            left, right = (("(", ")"), ("[", "]"))[t % 2]
            gap, whole = (" ", "")[t // 2 % 2], t // 4 % 2
            out.append(f"{name}{gap}{left}at{right}{gap}{domain if whole else domain.replace('.', f'{gap}{left}dot{right}{gap}')}")
        return out
    groups = re.findall(r"[0-9]+", span)
    if kind == 2:
        digits, joint = "".join(groups), _JOINTS[2 + turn % 2]
        return [joint.join(digits[i : i + 4] for i in range(0, len(digits), 4))]
    if kind == 3:
        if len(groups) > 1 and sum(map(len, groups[1:])) >= 7:
            groups = groups[1:]  # a local number has no country code
        joint = _JOINTS[turn % 4]
        out = [joint.join(groups)]
        if len(groups) > 1:
            out.append(f"({groups[0]}) {_JOINTS[turn // 4 % 4].join(groups[1:])}")
        return out
    return []


def decoys(span: str) -> list[str]:
    """Numbers and words that are nobody's data, for the place of a base match: a date, a moment, a range, a count, a version, a marked aside."""
    turn = zlib.crc32(span.encode(), 7)
    year, month, day, joint = 1950 + turn % 100, 1 + turn // 100 % 12, 1 + turn // 1200 % 28, _JOINTS[1 + turn // 7 % 3]
    date = f"{year}{joint}{month:02d}{joint}{day:02d}" if turn % 2 else f"{day:02d}{joint}{month:02d}{joint}{year}"
    count = turn * (1 + turn % 9973)
    numbers = [date, f"{date} {turn % 24:02d}", f"{year}-{year + turn // 100 % 60}", str(count), f"{turn % 40}.{month}.{day}.{turn // 31}", f"{count / 1000:.4f}"]
    name = span.split("@")[0]
    aside = [f"{x} (at) {turn % 900}.{turn // 900 % 100:02d}" for x in (name, _letters(name))] if "@" in span else []
    return [numbers[turn % len(numbers)], numbers[(turn // 6) % len(numbers)], *aside]


def put_in_place(text: str, start: int, end: int, new: str) -> list[tuple[int, list[float]]]:
    """(kind, features) of the proposals that cover exactly ``new`` where it stands in place of text[start:end]."""
    before = text[max(0, start - 40) : start]
    near = f"{before}{new}{text[end : end + 8]}"
    a, b = len(before), len(before) + len(new)
    return [(k, features(near, c, d)) for k, c, d in proposals(near) if (c, d) == (a, b)]


def weak_labels(text: str) -> list[tuple[int, list[float], int]]:
    """Training rows (kind, features, label) of one text.

    Label 1 is a base match in disguise, as a generator proposes it in the place of that match. Label 0 is a decoy in the same place, so that the
    place alone decides nothing, and each proposal of the text that touches no base match and has no cue before it. Proposals behind
    a cue may be personal data that no rule knows, so they teach nothing.
    """
    base = base_spans(text)
    rows = []
    for k, a, b in base:
        for label, written in ((1, disguises(k, text[a:b])), (0, decoys(text[a:b]))):
            rows += [(kind, x, label) for new in written for kind, x in put_in_place(text, a, b, new)]
    taken, cue = Taken((a, b) for _, a, b in base), FEATURES.index("cue")
    free = [(k, features(text, a, b)) for k, a, b in proposals(text) if not taken.touches(a, b)]
    return rows + [(k, x, 0) for k, x in free if not x[cue]]


def _tables(batches, *names):
    for batch in batches:
        if batch.num_rows:
            yield (np.array(batch.column("x").to_pylist(), np.float64), *(batch.column(c).to_numpy() for c in names))


def fit_forest_whole(rows: DataFrame, settings: Settings) -> Forest:
    """The trees of ``fit_forest`` over all ``rows`` (x, y), however many: each level of a tree is one job that adds up histograms.

    The driver gets sums per node, feature and bin. Cuts are approximate quantiles of all rows.
    """
    spark = rows.sparkSession
    at = [k / settings.bins for k in range(1, settings.bins)]
    first = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"), *[F.percentile_approx(F.col("x")[j], at, 10_000).alias(f"c{j}") for j in range(len(FEATURES))]).first()
    n, ones = first.n, first.y or 0
    share_of_1 = (ones + 1) / (n + 2)
    prior = float(np.log(share_of_1 / (1 - share_of_1)))
    inner = 2**settings.depth - 1
    forest = Forest(prior, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if ones in (0, n):
        return forest
    cuts = [np.unique(first[f"c{j}"]) for j in range(len(FEATURES))]
    wide = settings.bins
    for _ in range(settings.trees):
        feature, cut, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
        for level in range(settings.depth):
            low, nodes = 2**level - 1, 2**level
            state = share(spark, (forest, feature.copy(), cut.copy()))

            def add_up(batches, state=state, level=level, low=low, nodes=nodes):
                model, feature, cut = state()
                sums = np.zeros((3, nodes, len(cuts), wide))
                for x, y in _tables(batches, "y"):
                    p = model.predict(x)
                    node = np.zeros(len(x), np.int64)
                    for _ in range(level):
                        node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
                    for j, c in enumerate(cuts):
                        cell = (node - low) * wide + np.searchsorted(c, x[:, j])
                        for k, weight in enumerate((y - p, p * (1 - p), None)):
                            sums[k, :, j] += np.bincount(cell, weight, nodes * wide).reshape(nodes, wide)
                flat = sums.reshape(3, -1)
                used = np.flatnonzero(flat[2])
                yield pa.RecordBatch.from_arrays([pa.array(used), *map(pa.array, flat[:, used])], ["cell", "g", "h", "n"])

            got = rows.mapInArrow(add_up, "cell bigint, g double, h double, n double").groupBy("cell").agg(*[F.sum(c).alias(c) for c in "ghn"]).collect()
            sums = np.zeros((3, nodes * len(cuts) * wide))
            for r in got:
                sums[:, r.cell] = round(r.g, 9), round(r.h, 9), r.n  # the order of adding decides nothing
            sums = sums.reshape(3, nodes, len(cuts), wide)
            for i in range(nodes):
                g, h, m = sums[:, i, 0].sum(axis=1)
                best, below = (1e-6, 0, np.inf), (g, h)
                for j, c in enumerate(cuts):
                    if m < 2 * settings.least_rows or not len(c):
                        continue
                    gl, hl, nl = np.cumsum(sums[:, i, j], axis=1)[:, : len(c)]
                    gain = gains(gl, hl, nl, g, h, m, settings)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best, below = (float(gain[k]), j, float(c[k])), (gl[k], hl[k])
                feature[low + i], cut[low + i] = best[1], best[2]
                if level == settings.depth - 1:
                    leaf = 2 * (low + i) + 1 - inner
                    value[leaf] = settings.rate * below[0] / (below[1] + 1)
                    value[leaf + 1] = settings.rate * (g - below[0]) / (h - below[1] + 1)
        forest = Forest(prior, np.vstack([forest.features, feature]), np.vstack([forest.cuts, cut]), np.vstack([forest.leaves, value]))
    return forest


_STEPS = 10_000


def calibrated_whole(forest: Forest, held: DataFrame, settings: Settings) -> dict[int, float]:
    """Thresholds as ``calibrated`` sets them, from all ``held`` rows (k, x, y, n), in steps of 1 / 10,000 of the score."""
    shared = share(held.sparkSession, forest)

    def score(batches):
        model = shared()
        for x, k, y, n in _tables(batches, "k", "y", "n"):
            step = np.floor(model.predict(x) * _STEPS).astype("i8")
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(step), pa.array(n), pa.array(n * y)], ["k", "step", "n", "ones"])

    sums = held.mapInArrow(score, "k int, step bigint, n bigint, ones bigint").groupBy("k", "step").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
    out, all_rows = {}, sorted(map(tuple, sums.collect()), reverse=True)
    for kind in {r[0] for r in all_rows if r[3]}:
        step, n, ones = np.array([r[1:] for r in all_rows if r[0] == kind], np.float64).T
        good = np.flatnonzero(np.cumsum(ones) / np.cumsum(n) >= settings.precision)
        out[int(kind)] = float(max(step[good[-1]] / _STEPS, 0.5)) if len(good) else settings.never
    return out


def train(docs: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> Forest:
    """Fit the trees on candidates of ``docs`` and set each kind's threshold on every fourth of them, which the trees do not see.

    All different candidates take part: in one task up to ``train_rows`` of them, beyond that in distributed passes. A threshold counts each as
    often as the corpus has it. A kind without candidates of label 1 is never chosen, and without candidates of both labels no proposal is.
    """
    settings = settings or Settings()

    def collect(batches):
        for batch in batches:
            ks, xs, ys = [], [], []
            for text in batch.column("text").to_pylist():
                for k, x, y in weak_labels(text):
                    ks.append(k)
                    xs.append([float(v) for v in x])
                    ys.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.int32())], ["k", "x", "y"])

    rows = id_text(docs, id_col, text_col).select("text").mapInArrow(collect, "k int, x array<double>, y int")
    order = F.xxhash64("k", "x", "y")
    found = materialise(rows.groupBy("k", "x", "y").agg(F.count(F.lit(1)).alias("n")))
    if found.count() > settings.train_rows:
        held = F.pmod(order, F.lit(4)) == 3
        forest = fit_forest_whole(found.where(~held).select("x", "y"), settings)
        if len(forest.features):
            forest.thresholds = calibrated_whole(forest, found.where(held), settings)
        return forest

    def learn(batches):
        got = pa.Table.from_batches(list(batches)).to_pydict()
        k, y, n = (np.array(got[c], np.int64) for c in ("k", "y", "n"))
        x = np.array(got["x"], np.float64).reshape(len(y), len(FEATURES))
        held = np.arange(len(y)) % 4 == 3
        forest = fit_forest(x[~held], y[~held], settings)
        if len(y) and y.min() != y.max():
            for kind in np.unique(k[held & (y == 1)]):
                mine = held & (k == kind)
                forest.thresholds[int(kind)] = calibrated(forest, x[mine], y[mine], settings, n[mine])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((forest.prior, forest.features, forest.cuts, forest.leaves, forest.thresholds))], pa.binary())], ["model"])

    ordered = found.withColumn("_o", order).repartition(1).sortWithinPartitions("_o", "k", "x", "y").drop("_o")
    row = ordered.mapInArrow(learn, "model binary").first()
    return Forest(*pickle.loads(row.model)) if row else fit_forest(np.zeros((0, len(FEATURES))), np.zeros(0, np.int64), settings)


def chosen_spans(text: str, forest: Forest) -> list[tuple[int, int, int]]:
    """Base matches, and proposals that reach their kind's threshold and touch no base match; all by kind, then start.

    Of chosen proposals that overlap, the one with the highest score stays, then the longer, then the one that starts first.
    """
    base = base_spans(text)
    taken = Taken((a, b) for _, a, b in base)
    wide = [c for c in proposals(text) if forest.thresholds.get(c[0], 2.0) <= 1 and not taken.touches(c[1], c[2])]
    if wide:
        p = forest.predict(np.array([features(text, a, b) for _, a, b in wide], np.float64))
        for _, _, a, b, k in sorted((-score, a - b, a, b, k) for (k, a, b), score in zip(wide, p) if score >= forest.thresholds[k]):
            if not taken.touches(a, b):
                taken.add(a, b)
                base.append((k, a, b))
    return sorted(base)


def find_pii(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """(doc_id, spans[, redacted]), one row per input row; spans of (kind, start, end) by kind as listed, then start.

    Positions are code points, the end exclusive. ``redacted`` is the text with each span replaced by its kind in angle brackets; where spans overlap,
    the one that starts first, then the longer, counts. Null and empty texts have no spans. Rows are handled alone: repeated rows get the same
    result, null ids are kept. Other columns are not read.
    """
    source = id_text(docs, id_col, text_col)
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    fields = [T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("spans", span)]
    shared = share(docs.sparkSession, forest)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        model = shared()
        for batch in batches:
            spans, texts = [], []
            for text in batch.column("text").to_pylist():
                got = chosen_spans(text, model)
                spans.append([{"kind": KINDS[k], "start": a, "end": b} for k, a, b in got])
                if redact:
                    out, at = [], 0
                    for a, _, b, k in sorted((a, -b, b, k) for k, a, b in got):
                        if a >= at:
                            out += [text[at:a], f"<{KINDS[k]}>"]
                            at = b
                    texts.append("".join(out) + text[at:])
            columns = [batch.column("doc_id"), pa.array(spans, kind), *([pa.array(texts, pa.string())] if redact else [])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "spans", *["redacted"] * redact])

    return source.mapInArrow(run, T.StructType([*fields, *[T.StructField("redacted", T.StringType())] * redact]))

"""Operator 5: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features need no vocabulary-sized vectors: lexicon densities (a given list and one learned from labels), lexicon
words near second-person ones, capitals, punctuation, and rates of obfuscation (signs or digits inside words, drawn
out letters, spaced letters, masked letters), each also read back to the lexicon.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import LETTER, SPACE, bounded_sample, char_classes, code_points, free_name, in_parts, narrow, saved, segments, span_hashes, words

#: Hostile words of four languages, a parameter of train(); words that the labels show are added to them.
LEXICON = tuple(
    "arrogant asshole bastard bitch brainless buffoon clown clowns coward cretin degenerate despicable dimwit disgrace disgusting dumb dumbass "
    "dunce failure filth filthy fool fools foolish freak garbage halfwit horrible hypocrite idiot idiotic idiots ignorant imbecile incompetent "
    "ignoramus jerk laughable liar loser losers lowlife lunatic maggot moron moronic morons nasty nitwit numbskull parasite pathetic "
    "psycho repulsive retard ridiculous rotten rubbish scum scumbag shameful shit shut sickening simpleton skank sleazy slime slut stupid stupidity "
    "thug toxic trash traitor troll twit useless vermin vile weakling weirdo whore wimp witless worthless wretched "
    "arschloch abschaum blöd blödmann dreck dumm dummkopf dämlich ekelhaft erbärmlich hässlich idioten lügner mistkerl müll penner schwachkopf trottel "
    "verlierer versager wertlos widerlich abruti bouffon connard conne crétin débile dégoûtant idiote imbécile lâche menteur merde minable moche "
    "ordure pathétique pourri raté salaud stupide asqueroso basura cobarde cretino estúpida estúpido feo idiota imbécil inútil maldito mentiroso "
    "mierda payaso patético perdedor repugnante tonto".split()
)
SECOND_PERSON = tuple("you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta vous votre vos tú usted ustedes vosotros tus".split())
#: Words between a lexicon word and a second-person one that still count as near.
NEAR = 6
#: Labelled rows that train() fits on at most, chosen by hash.
MAX_LABELLED = 20_000

FEATURES = ("lexicon", "lexicon_density", "learned", "learned_density", "near_you", "near_you_density", "you_density", "capitals", "capital_words", "exclaims", "questions", "punctuation", "sign_runs", "digits", "inner_signs", "drawn_out", "spaced", "hidden", "hidden_density")


def _hashes(terms: tuple[str, ...] | list[str]) -> np.ndarray:
    terms = [t.lower() for t in terms]
    cp, at = code_points(terms)
    return np.unique(span_hashes(cp, at[:-1], at[1:])) if terms else np.zeros(0, np.uint64)


def _among(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    small = np.zeros(1 << 16, bool)  # most words are told apart by 16 bits
    small[(table & np.uint64(0xFFFF)).astype(np.int64)] = True
    out = small[(x & np.uint64(0xFFFF)).astype(np.int64)]
    at = np.flatnonzero(out)
    out[at] = np.isin(x[at], table)
    return out


#: Signs that join words to one token and stand for no letter.
_JOINTS = re.compile(r"[^\w*#@$!|€]+|_+")
_LEET = str.maketrans("013457@$!|€", "oieastasiie")


class Counter:
    """Counts by text that the features come from."""

    def __init__(self, lexicon: tuple[str, ...] = LEXICON, learned: tuple[str, ...] = ()):
        self.lexicon, self.learned, self.you = _hashes(lexicon), _hashes(learned), _hashes(SECOND_PERSON)
        self.words = {t.lower() for t in (*lexicon, *learned) if len(t) > 3}
        self.by_size: dict[int, list[str]] = {}
        for w in self.words:
            self.by_size.setdefault(len(w), []).append(w)

    def _reads(self, token: str) -> bool:
        """Whether an obfuscated token, or a part of it between other signs, can be read as a word of the lexicon."""
        token = token.lower().strip(".,;:?!\"'()")
        if self._reads_whole(token):
            return True
        parts = _JOINTS.split(token)
        return len(parts) > 1 and any(len(x) > 3 and x not in self.words and self._reads_whole(x) for x in parts)

    def _reads_whole(self, token: str) -> bool:
        plain = token.translate(_LEET)
        for t in (plain, re.sub(r"[^\w]|_", "", plain), re.sub(r"(.)\1{2,}", r"\1", plain), re.sub(r"(.)\1{2,}", r"\1\1", plain)):
            if t in self.words:
                return True
        if "*" in token or "#" in token:
            p = re.compile("".join("." if c in "*#" else re.escape(c) for c in token))
            return sum(c.isalpha() for c in token) >= 2 and any(p.fullmatch(w) for w in self.by_size.get(len(token), ()))
        return False

    def counts(self, parts: list[str]) -> np.ndarray:
        n = len(parts)
        raw, at = code_points(parts)
        cp, starts, ends, text, h = words(parts, lower=True)
        by = lambda x: np.bincount(x, minlength=n).astype(float)
        owner = lambda p: np.searchsorted(at, p, "right") - 1
        cls = char_classes()[raw]
        lex, learned, you = _among(h, self.lexicon), _among(h, self.learned), _among(h, self.you)
        hit = np.flatnonzero(lex | learned)
        near = np.zeros(len(hit), bool)
        at_you = np.flatnonzero(you)
        if len(at_you):
            k = np.searchsorted(at_you, hit)
            for j in (np.maximum(k - 1, 0), np.minimum(k, len(at_you) - 1)):
                near |= (np.abs(at_you[j] - hit) <= NEAR) & (text[at_you[j]] == text[hit])
        letter = cls == LETTER
        upper = letter & (cp != raw)
        ups = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(upper, out=ups[1:])
        per = lambda m: np.add.reduceat(np.append(m, 0), at[:-1], dtype=np.int64) * (np.diff(at) > 0) if n else np.zeros(0)
        sign = (cls == 0) & (raw > 32)
        size = ends - starts
        loud = (size > 1) & (ups[ends] - ups[starts] == size)
        # obfuscation: a sign or digit between letters; letters three times or more; single letters in a row
        odd = np.zeros(len(raw) + 2, bool)
        twist = np.isin(raw, [48, 49, 51, 52, 53, 55, 64, 36, 33, 124, 42, 35, 8364, 46, 45, 95])
        odd[1:-1] = twist
        inner = np.flatnonzero(odd[1:-1] & np.append(letter[1:], False) & np.append(False, letter[:-1] | twist[:-1]))
        three = np.flatnonzero(letter[2:] & (cp[2:] == cp[1:-1]) & (cp[1:-1] == cp[:-2])) if len(cp) > 2 else np.zeros(0, np.int64)
        hidden = []
        if len(inner) or len(three):
            gap = np.flatnonzero((cls == SPACE))
            where = np.unique(np.concatenate([inner, three]))
            k = np.searchsorted(gap, where)
            own = owner(where)
            a = np.maximum(np.where(k > 0, gap[np.maximum(k - 1, 0)] + 1 if len(gap) else 0, 0), at[own])
            b = np.minimum(np.where(k < len(gap), gap[np.minimum(k, max(len(gap) - 1, 0))] if len(gap) else len(raw), len(raw)), at[own + 1])
            spans, first = np.unique(a, return_index=True)
            for s, e, o in zip(spans.tolist(), b[first].tolist(), own[first].tolist()):
                if e - s > 3 and self._reads(parts[o][s - at[o] : e - at[o]]):
                    hidden.append(o)
        single = np.flatnonzero((size == 1) & letter[starts]) if len(starts) else np.zeros(0, np.int64)
        spaced = np.zeros(0, np.int64)
        if len(single) > 3:
            joined = (np.diff(single) == 1) & (starts[single[1:]] - starts[single[:-1]] == 2) & (text[single[1:]] == text[single[:-1]])
            edge = np.diff(np.concatenate([[0], joined.astype(np.int8), [0]]))
            a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            keep = b - a >= 3
            spaced = text[single[a[keep]]]
            for s, e in zip(a[keep].tolist(), b[keep].tolist()):
                if "".join(map(chr, cp[starts[single[s : e + 1]]])) in self.words:
                    hidden.append(int(text[single[s]]))
        runs = np.flatnonzero(sign[1:] & sign[:-1]) + 1
        one = lambda c: by(owner(np.flatnonzero(raw == c)))
        return np.stack([
            by(text), by(text[lex]), by(text[learned]), by(text[hit[near]]), by(text[you]), np.diff(at).astype(float), per(letter), per(upper), by(text[loud]),
            one(33), one(63), per(sign), by(owner(runs)), per(cls == 2), by(owner(inner)), by(owner(three)), by(spaced), by(np.array(hidden, np.int64)),
        ], axis=1)

    def features(self, texts: list[str | None]) -> np.ndarray:
        """A row of FEATURES for each text, over its whole length."""
        c = np.zeros((len(texts), 18))
        for rows, parts in segments(texts):
            np.add.at(c, rows, self.counts(parts))
        n, lex, learned, near, you, chars, letters, upper, loud, bang, ask, sign, runs, digit, inner, three, spaced, hidden = c.T
        w, k = np.maximum(n, 1), np.maximum(chars, 1)
        return np.stack([
            lex, lex / w, learned, learned / w, near, near / w, you / w, upper / np.maximum(letters, 1), loud / w,
            bang / k, ask / k, sign / k, runs / k, digit / k, inner / w, three / w, spaced / w, hidden, hidden / w,
        ], axis=1)


@dataclass
class Trees:
    """Complete binary trees, each level's split read from its node's place."""

    start: float = 0.0
    depth: int = 3
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 7), np.int64))
    cut: np.ndarray = field(default_factory=lambda: np.zeros((0, 7)))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 8)))

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        every = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[every, f[node]] > c[node])
            out += v[node - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, rate: float = 0.15, depth: int = 3, bins: int = 48, ridge: float = 1.0, gain_least: float = 4.0) -> Trees:
    """Gradient boosting of logistic loss with second-order splits on histograms; the same for the same rows.

    A leaf holds at least a quarter as many rows as there are positive ones (3 to 20), so that mislabelled rows don't
    get leaves of their own, and a split has to gain what chance seldom gives over all features' cuts.
    """
    n, m = x.shape
    least = min(20.0, max(3.0, y.sum() / 4))
    rate0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    t = Trees(float(np.log(rate0 / (1 - rate0))), depth)
    cuts = []
    for j in range(m):
        u = np.unique(x[:, j])
        mid = (u[1:] + u[:-1]) / 2
        if len(mid) > bins:
            mid = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 2)[1:-1]))
            zero = u[u > u[0]]
            mid = np.unique(np.append(mid, (u[0] + zero[0]) / 2))
        cuts.append(mid)
    width = max(map(len, cuts), default=0) + 1
    code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    s = np.full(n, t.start)
    feats, thresholds, leaves = [], [], []
    base = np.arange(m) * width
    for _ in range(trees):
        p = 1 / (1 + np.exp(-s))
        g, h = y - p, p * (1 - p)
        f, c, node = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            lo = 2**level - 1
            key = ((node - lo)[:, None] * m * width + base + code).ravel()
            size = 2**level * m * width
            G = np.bincount(key, np.repeat(g, m), size).reshape(-1, m, width).cumsum(2)
            H = np.bincount(key, np.repeat(h, m), size).reshape(-1, m, width).cumsum(2)
            N = np.bincount(key, minlength=size).reshape(-1, m, width).cumsum(2)
            gt, ht, nt = G[:, :, -1:], H[:, :, -1:], N[:, :, -1:]
            gain = G**2 / (H + ridge) + (gt - G) ** 2 / (ht - H + ridge) - gt**2 / (ht + ridge)
            gain[(N < least) | (nt - N < least)] = -1
            for k in range(2**level):
                j, b = divmod(int(gain[k].argmax()), width)
                if gain[k, j, b] > gain_least and b < len(cuts[j]):
                    f[lo + k], c[lo + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), f[node]] > c[node])
        at = node - (2**depth - 1)
        v = rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + ridge)
        s += v[at]
        feats.append(f)
        thresholds.append(c)
        leaves.append(v)
    t.feature, t.cut, t.leaf = np.array(feats), np.array(thresholds), np.array(leaves)
    return t


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (scores, shares of y), both rising; equal scores are pooled first."""
    u, inv = np.unique(score, return_inverse=True)
    weight, mean = np.bincount(inv).astype(float), np.bincount(inv, y) / np.bincount(inv)
    blocks: list[list[float]] = []
    for i, (w, v) in enumerate(zip(weight, mean)):
        blocks.append([v, w, i, i])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
    xs, ys = [], []
    for v, _, a, b in blocks:
        xs += [u[int(a)], u[int(b)]]
        ys += [v, v]
    return np.array(xs), np.array(ys)


@dataclass
class Model:
    lexicon: tuple[str, ...]
    learned: tuple[str, ...]
    trees: Trees | None
    xs: np.ndarray
    ys: np.ndarray

    def __post_init__(self) -> None:
        self._counter: Counter | None = None

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """Calibrated probability for each text."""
        if self._counter is None:
            self._counter = Counter(self.lexicon, self.learned)
        return self.of(self._counter.features(texts))

    def of(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:  # nothing to learn from: two lexicon words, or one in fifty
            k = FEATURES.index
            found, share = x[:, k("lexicon")] + x[:, k("hidden")], x[:, k("lexicon_density")] + x[:, k("hidden_density")]
            return np.where((found >= 2) & (share >= 0.002) | (share >= 0.02), 1.0, 0.0)
        return np.interp(self.trees.score(x), self.xs, self.ys)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_counter": None}


def fit(x: np.ndarray, y: np.ndarray, fold: np.ndarray, lexicon: tuple[str, ...], learned: tuple[str, ...]) -> Model:
    """Trees on all rows; the calibration from scores that trees of the other half of the rows gave."""
    if not len(y) or y.min() == y.max():
        return Model(lexicon, learned, None, np.zeros(1), np.zeros(1))
    out = np.zeros(len(y))
    for k in (0, 1):
        rest = y[fold != k]
        out[fold == k] = boost(x[fold != k], rest).score(x[fold == k]) if len(rest) and rest.min() != rest.max() else 0.0
    return Model(lexicon, learned, boost(x, y), *isotonic(out, y))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, lexicon: tuple[str, ...] = LEXICON, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from at most max_labelled labelled rows, chosen by a hash of the id; null labels, ids and texts are left out.

    Three folds by hash: the first gives the learned lexicon (words many times as frequent in toxic rows, in three at
    least), the other two the trees and their calibration. Without labels of both kinds the model is a fixed rule on
    the lexicon. Rows labelled twice count twice; of equal hashes the rows come in the order of their columns; very long
    texts are read whole, empty ones have no words; other columns are not read.
    """
    picked = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).where("k is not null and y is not null")
    picked = bounded_sample(picked, max_labelled, F.xxhash64("k"))
    texts = docs.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").alias("t")).where("k is not null and t is not null")
    sample = saved(texts.join(F.broadcast(picked), "k"))  # as many rows as max_labelled: small whatever the tables
    sample = sample.withColumn("fold", F.pmod(F.xxhash64("k", F.lit(5)), F.lit(3)))
    first = sample.where("fold = 0")
    term = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit(r"[\p{L}\p{N}]{3,}"), 0))).alias("term")
    total = first.agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n")).first()
    learned: tuple[str, ...] = ()
    if total["p"] and total["n"]:
        by = first.select("y", term).groupBy("term").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
        share = (F.col("p") + 0.0) / total["p"]
        strong = by.where((F.col("p") >= 3) & (share > 20 * (F.col("n") + 0.25) / total["n"]) & (share >= 0.02))
        learned = tuple(sorted(r["term"] for r in strong.select("term").collect()))  # at least a fiftieth of toxic rows each

    counter = Counter(lexicon, learned)

    @F.arrow_udf("array<double>")
    def features(t: pa.Array) -> pa.Array:
        return pa.array([x for part in in_parts(t) for x in counter.features(part)], pa.list_(pa.float64()))

    rows = sample.where("fold > 0").select("k", "y", "fold", features("t").alias("x")).orderBy("k", "y").collect()
    x = np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r["y"] for r in rows], float), np.array([r["fold"] - 1 for r in rows]), lexicon, learned)


def _scorer(model: Model):
    @F.arrow_udf("double")
    def score(t: pa.Array) -> pa.Array:
        made = [model.predict(part) for part in in_parts(t)]
        return pa.array(np.concatenate(made) if made else np.zeros(0), mask=t.is_null().to_numpy(zero_copy_only=False))

    return score


def score(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, toxicity, toxic) for every row; one pass, no shuffle.

    A null text has null toxicity and isn't toxic; an empty one scores like any text without words; repeated rows and
    null ids keep a row each; a score at the threshold itself is toxic; other columns are not read; an empty table gives no
    rows. Whole texts are read, in segments.
    """
    p = narrow(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("doc_id"), _scorer(model)(F.col(f"`{text_col}`")).alias("toxicity"))
    return p.withColumn("toxic", F.coalesce(F.col("toxicity") >= threshold, F.lit(False)))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows that aren't toxic, with docs' columns; only texts go to Python and only scores come back.

    Rows with a null text stay, empty texts are judged like any without words; repeated rows and null ids stay or go each by
    its text; a score at the threshold itself goes; long texts are read whole; docs' columns may have any names; an empty
    table gives no rows.
    """
    p = free_name(docs, "toxicity")
    return docs.withColumn(p, _scorer(model)(F.col(f"`{text_col}`"))).where(F.col(p).isNull() | (F.col(p) < threshold)).drop(p)

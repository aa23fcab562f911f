"""Language identification by interpolated Kneser-Ney character models.

One model of order five for each language, fitted on a bounded sample of labelled documents. The models of all languages share
sorted arrays of n-gram hashes: a row holds the interpolated log probability under every language, so that one binary search
scores a character for all of them. An n-gram that no language saw backs off by the log weight of its context. A document goes
to the language with the lowest cross-entropy per character; its rejection compares that entropy with what held-back documents
of the language show. A language with too few of them is calibrated by cross-validation over all its sampled documents.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import mix, slices

#: The order of the models; documents sampled for each language; languages at most; one in so many sampled documents calibrates.
ORDER, SAMPLE, LANGUAGES, FOLDS = 5, 1000, 1000, 5
#: Characters after which the score grows no surer; how far beyond the calibration documents a rejected one must lie, and how far
#: above the language's mean entropy, so that a passage in another language rejects no document.
SURE, BEYOND, ABOVE = 64, 1.5, 2.0
#: A language with fewer correct calibration documents of 200 letters is rare; spread of a rare language where no other has one.
FEW, SPREAD = 5, 0.1
#: Bytes of text that are scored at once: a character takes some 100 bytes for a few languages.
STRETCH = 1 << 20
UND = "und"
_C = np.uint64(0x9E3779B97F4A7C15)
_KINDS: dict[str, np.ndarray] = {}


def _kinds() -> np.ndarray:
    """By code point: 2 for letters, 1 for marks, 0 for the rest."""
    if "all" not in _KINDS:
        _KINDS["all"] = np.fromiter(({"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)
    return _KINDS["all"]


def normalise(texts: list[str | None], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts in one row, the positions to score, and each text's number of them.

    Letters are lower-cased, runs of other characters become one space, and each text follows order - 1 spaces. A text without
    letters has no position.
    """
    low = [(t or "").lower() for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    doc = np.repeat(np.arange(len(low)), sizes)
    kind = _kinds()[codes]
    some = np.zeros(len(low), bool)
    some[doc[kind == 2]] = True
    inside = kind > 0
    follows = np.concatenate(([False], inside[:-1] & (doc[1:] == doc[:-1]))) if len(codes) else inside
    keep = (inside | follows) & some[doc]
    codes, doc = np.where(inside, codes, np.uint32(32))[keep], doc[keep]
    out = np.full(len(codes) + len(low) * (order - 1), 32, np.uint32)
    at = np.arange(len(codes)) + (doc + 1) * (order - 1)
    out[at] = codes
    return out, at, np.bincount(doc, minlength=len(low))


def hash_at(codes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n characters that end at each position; zero for n = 0."""
    h = np.full(len(at), n, np.uint64)
    for j in range(n):
        h = h * _C + codes[at - (n - 1 - j)].astype(np.uint64) + np.uint64(1)
    return mix(h)


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # by order - 1: sorted hashes, log probabilities
    backs: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # by order - 1: sorted context hashes, log weights
    unknown: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    centre: np.ndarray = field(default_factory=lambda: np.zeros(0))
    spread: np.ndarray = field(default_factory=lambda: np.zeros(0))
    grain: np.ndarray = field(default_factory=lambda: np.zeros(0))
    limit: np.ndarray = field(default_factory=lambda: np.zeros(0))
    floor: np.ndarray = field(default_factory=lambda: np.zeros(0))  # entropy that a rejected document exceeds

    def entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character of each text under each language, and the number of characters."""
        codes, at, sizes = normalise(texts)
        score = np.zeros((len(at), len(self.languages)), np.float32)
        pending = np.arange(len(at))
        for n in range(len(self.grams), 0, -1):
            keys, logs = self.grams[n - 1]
            h = hash_at(codes, at[pending], n)
            slot = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            found = keys[slot] == h
            score[pending[found]] += logs[slot[found]]
            pending = pending[~found]
            if not len(pending):
                break
            keys, logs = self.backs[n - 1]
            h = hash_at(codes, at[pending] - 1, n - 1)
            slot = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            found = keys[slot] == h
            score[pending[found]] += logs[slot[found]]
        score[pending] += self.unknown
        starts = np.cumsum(sizes) - sizes
        total = np.zeros((len(sizes), len(self.languages)))
        if (some := sizes > 0).any():
            total[some] = np.add.reduceat(score, starts[some], axis=0, dtype=np.float64)
        return -total / np.maximum(sizes, 1)[:, None], sizes

    def strange(self, ce: np.ndarray, sizes: np.ndarray, best: np.ndarray) -> np.ndarray:
        """How many spreads the entropy under the best language lies above that language's usual one."""
        return (ce - self.centre[best]) / np.sqrt(self.spread[best] ** 2 + self.grain[best] / np.maximum(sizes, 1))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of top-order n-grams by language, a gram in two integers of 21 bits a character."""
    for b in slices(batches, "text"):
        names = b.column("lang").to_pylist()
        texts = b.column("text").to_pylist()
        for lang in sorted(set(names)):
            codes, at, _ = normalise([t for t, x in zip(texts, names, strict=True) if x == lang])
            back = [codes[at - j].astype(np.int64) for j in range(ORDER - 1, -1, -1)]
            high, low = back[0] << 42 | back[1] << 21 | back[2], back[3] << 21 | back[4]
            order = np.lexsort((low, high))
            high, low = high[order], low[order]
            new = np.flatnonzero(np.concatenate(([True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])))) if len(high) else np.zeros(0, np.int64)
            count = np.diff(np.append(new, len(high)))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(new), pa.string()), pa.array(high[new]), pa.array(low[new]), pa.array(count, pa.int64())], ["lang", "high", "low", "n"])


def _sum(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the sums of their values, and an example position of each."""
    distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
    return distinct, np.bincount(which, values, len(distinct)), first


def build(counts: pd.DataFrame) -> Model:
    """Interpolated Kneser-Ney models from counts of top-order n-grams (lang, high, low, n)."""
    model = Model(sorted(counts["lang"].unique()))
    if not model.languages:
        return model
    split = lambda x, shifts: np.stack([(x >> s) & 0x1FFFFF for s in shifts], axis=1)
    grams, own = [], []
    for lang in model.languages:
        rows = counts[counts["lang"] == lang]
        grams.append(np.concatenate([split(rows["high"].to_numpy(), (42, 21, 0)), split(rows["low"].to_numpy(), (21, 0))], axis=1).astype(np.uint32))
        own.append(rows["n"].to_numpy().astype(np.float64))
    orders: list[list[tuple]] = []  # by language, from the top: gram hashes, counts, characters
    for chars, n in zip(grams, own, strict=True):
        levels = []
        for order in range(ORDER, 0, -1):
            flat, end = chars.reshape(-1), np.arange(len(chars)) * order + order - 1
            h, n, first = _sum(hash_at(flat, end, order), n)
            chars = chars[first]
            levels.append((h, n, chars))
            chars, n = chars[:, 1:], np.ones(len(chars))  # continuation counts: each distinct gram counts once for its suffix
        orders.append(levels[::-1])
    width = len(model.languages)
    letters = len(np.unique(np.concatenate([o[0][0] for o in orders]))) + 1
    lower_keys, lower = np.zeros(0, np.uint64), np.zeros((0, width))
    for n in range(1, ORDER + 1):
        keys, first = np.unique(np.concatenate([o[n - 1][0] for o in orders]), return_index=True)
        chars = np.concatenate([o[n - 1][2] for o in orders])[first]
        flat, end = chars.reshape(-1), np.arange(len(chars)) * n + n - 1
        contexts = hash_at(flat, end - 1, n - 1) if n > 1 else np.full(len(chars), mix(np.zeros(1, np.uint64))[0])
        context_keys, of = np.unique(contexts, return_inverse=True)
        if n > 1:
            below = lower[np.searchsorted(lower_keys, hash_at(flat, end, n - 1))]
        else:
            below = np.full((len(keys), width), 1 / letters)
        p, weights = np.zeros((len(keys), width)), np.ones((len(context_keys), width))
        for k, o in enumerate(orders):
            h, c, _ = o[n - 1]
            ones, twos = (c == 1).sum(), (c == 2).sum()
            discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
            mine = np.zeros(len(keys))
            mine[np.searchsorted(keys, h)] = c
            total = np.bincount(of, mine, len(context_keys))
            kinds = np.bincount(of, mine > 0, len(context_keys))
            seen = total > 0
            weights[seen, k] = discount * kinds[seen] / total[seen]
            p[:, k] = np.maximum(mine - discount, 0) / np.maximum(total, 1)[of] + weights[of, k] * below[:, k]
        model.grams.append((keys, np.log(p).astype(np.float32)))
        model.backs.append((context_keys, np.log(weights).astype(np.float32)))
        lower_keys, lower = keys, p
    model.unknown = np.full(width, -np.log(letters), np.float32)
    return model


def _counts(texts: list[str]) -> pd.DataFrame:
    batch = pa.RecordBatch.from_pydict({"lang": pa.array([""] * len(texts), pa.string()), "text": pa.array(texts, pa.string())})
    return pd.concat([pd.DataFrame({"lang": [], "high": [], "low": [], "n": []}), *(b.to_pandas() for b in _count(iter([batch])))]).astype({"high": "int64", "low": "int64", "n": "int64"})


def _cross(rows: pd.DataFrame) -> pd.DataFrame:
    """(lang, n_letters, entropy, noise) of every document of one language under a model of the others, and of random words of its letters."""
    lang, texts = rows["lang"].iloc[0], rows.sort_values("doc_id")["text"].tolist()
    texts = [t for t, n in zip(texts, normalise(texts)[2], strict=True) if n > 1]
    if len(texts) == 1:  # its halves, by letters
        letters = "".join(map(chr, normalise(texts)[0])).strip()
        texts = [letters[: len(letters) // 2], letters[len(letters) // 2 :]]
    folds = min(FOLDS, len(texts))
    letters = sorted({c for t in texts for c in t.lower() if _kinds()[ord(c)]})
    rng = np.random.default_rng(0)
    noise = " ".join("".join(rng.choice(letters, rng.integers(1, 11))) for _ in range(400)) if letters else ""
    out = []
    for k in range(folds):
        model = build(_counts([t for i, t in enumerate(texts) if i % folds != k]))
        if not model.languages:
            continue
        every, sizes = model.entropy([noise, *texts[k::folds]])
        out += [(lang, int(n), float(e), float(every[0, 0])) for n, e in zip(sizes[1:], every[1:, 0], strict=True) if n]
    return pd.DataFrame(out, columns=["lang", "n_letters", "entropy", "noise"])


def _calibrate_rare(model: Model, chosen: DataFrame, rare: list[int]) -> None:
    """Finite limits for languages of too few calibration documents, from their own cross-validation.

    A small model is flat, so twice its entropy may be more than noise has: a rejected document lies beyond the middle between
    the language's documents and noise.
    """
    common = np.setdiff1d(np.arange(len(model.languages)), rare)
    spread = model.spread[common].max() if len(common) else SPREAD
    grain = model.grain[common].max() if len(common) else 4.0
    rows = chosen.where(F.col("lang").isin([model.languages[k] for k in rare])).select("doc_id", "lang", "text")
    seen = rows.groupBy("lang").applyInPandas(_cross, "lang string, n_letters long, entropy double, noise double").toPandas()
    for k in rare:
        own = seen[seen["lang"] == model.languages[k]]
        n, ce = own["n_letters"].to_numpy(), own["entropy"].to_numpy()
        # A language of a letter or two shows nothing: what the model gives to unknown letters stands for its noise.
        noise = float(own["noise"].mean()) if len(own) else -float(model.unknown[k])
        centre = float(np.average(ce, weights=n)) if len(own) else noise / ABOVE
        model.centre[k], model.grain[k] = centre, grain
        model.spread[k] = max(spread, float(ce[n >= 200].std()) if (n >= 200).any() else 0.0)
        model.floor[k] = min(ABOVE * centre, max(centre, (centre + noise) / 2))
        strange = model.strange(ce, n, np.full(len(n), k)).max() if len(own) else 0.0
        model.limit[k] = BEYOND * max(3.0, float(strange))


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that no model may learn from: crc32 of the doc_id's digits leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit and calibrate on about ``sample`` labelled documents a language, chosen by a hash of doc_id from those not held out."""
    usable = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = {r.lang: r["count"] for r in usable.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not sizes:
        return Model()
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    rate = F.coalesce(*(F.when(F.col("lang") == x, int(min(1.0, sample / n) * (1 << 30))) for x, n in sizes.items()))
    chosen = usable.where(spread < rate)
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS))
    counts = chosen.where(fold != 0).select("lang", "text").mapInArrow(_count, "lang string, high long, low long, n long")
    names = sorted(sizes)
    # Numbers stand for the names on the way to the driver, where a string for each n-gram takes more room than all the rest.
    code = F.array_position(F.array(*(F.lit(x) for x in names)), F.col("lang")).cast("int")
    summed = counts.groupBy(code.alias("code"), "high", "low").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    summed["lang"] = pd.Categorical.from_codes(summed.pop("code") - 1, names)
    model = build(summed)
    width = len(model.languages)
    model.centre, model.spread, model.grain, model.limit = np.zeros(width), np.ones(width), np.full(width, 4.0), np.full(width, np.inf)
    model.floor = np.zeros(width)
    if width:
        seen = identify(chosen.where(fold == 0), model, "lang").toPandas()
        rare = []
        for k, lang in enumerate(model.languages):
            own = seen[(seen["lang"] == lang) & (seen["lang_pred"] == lang)]
            long = own[own["n_letters"] >= 200]
            if len(long) < FEW:
                rare.append(k)
                continue
            model.centre[k], model.spread[k] = long["entropy"].mean(), max(0.02, long["entropy"].std())
            short = own[own["n_letters"] < 200]
            if len(short) >= 5:
                model.grain[k] = max(0.5, float(((short["entropy"] - model.centre[k]) ** 2 * short["n_letters"]).mean()))
            model.limit[k] = BEYOND * max(3.0, model.strange(own["entropy"].to_numpy(), own["n_letters"].to_numpy(), np.full(len(own), k)).max())
        model.floor = ABOVE * model.centre
        if rare:
            _calibrate_rare(model, chosen, rare)
    return model


def identify(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """``keep`` columns and lang_pred, score, entropy, n_letters, rejected of every row.

    Null text and text without letters are ``und`` with score 0, entropy null, and rejected. Without any language to choose
    from, all rows are ``und`` with score 0, and those with letters are not rejected, for nothing speaks against them. Repeated
    rows stay. A rejected row still names its nearest language. The score grows no surer after ``SURE`` letters: characters are
    not independent, so a probability over all of a long text would be 1 for any text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = pa.array([*m.languages, UND], pa.string())
        for b in slices(batches, "_text", STRETCH):
            texts = b.column("_text").to_pylist()
            if m.languages:
                every, sizes = m.entropy(texts)
                best = every.argmin(axis=1)
                ce = every[np.arange(len(best)), best]
                share = 1 / np.exp(np.clip((ce[:, None] - every) * np.minimum(sizes, SURE)[:, None], -700, 0)).sum(axis=1)
                far = (m.strange(ce, sizes, best) > m.limit[best]) & (ce > m.floor[best])
            else:
                sizes = normalise(texts)[2]
                best, ce, share, far = sizes * 0, sizes * 0.0, sizes * 0.0, sizes < 0
            none = (sizes == 0) | (not m.languages)
            columns = [pa.DictionaryArray.from_arrays(pa.array(np.where(none, len(m.languages), best)), names).cast(pa.string()), pa.array(np.where(none, 0.0, share)), pa.array(ce, mask=none), pa.array(sizes), pa.array(far | (sizes == 0))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *columns], [*keep, "lang_pred", "score", "entropy", "n_letters", "rejected"])

    rows = docs.select(*keep, F.col("text").alias("_text"))
    return rows.mapInArrow(score, ", ".join(x for x in (fields, "lang_pred string, score double, entropy double, n_letters long, rejected boolean") if x))

"""Toxic spans by a linear-chain conditional random field of two tags.

Training. Labelled documents give labelled tokens: a feature (a word, or a prefix of it) that a
likelihood-ratio test ties to toxic documents marks its tokens in toxic documents; all other tokens
are clean. The chain is fitted to them by Adagrad on exact forward-backward expectations. It is fitted
on the driver, on at most ``MOST_TOXIC`` + ``MOST_CLEAN`` labelled documents, chosen by hash among those
of at most ``MOST_CHARS`` characters.

Scoring. Every whole text is tagged: forward and backward ratios run over all texts of a group at
once, token by token. A document's score is that of its highest marginal, moved so that the
threshold that parts the training documents best is 0.5; tokens with a marginal of at least a half
give the offending offsets. Scores depend on the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ._scratch import ship, tidy

MOST_TOXIC = 1500
MOST_CLEAN = 3000
#: Longer documents aren't fitted on, though scored whole: this bounds what the driver holds.
MOST_CHARS = 18_000
DIMENSIONS = 1 << 18
#: Prefixes that are features beside the word itself.
PREFIXES = (4, 5, 6)
#: Natural logarithm of the likelihood ratio from which a feature marks tokens.
EVIDENCE = 14.0
#: Share of the toxic documents of the sample that a marking feature must stand in.
LEAST_SHARE = 0.01
EPOCHS = 30
#: Words whose scores a worker keeps, about 30 MB.
MEMO_WORDS = 200_000
GROUP_BYTES = 16 << 20

_LETTERS = r"[^\pL]+"


def lowered(texts):
    """The texts in lower case, code point by code point, so that offsets stay; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), ""))


def word_offsets(texts, i: int) -> list[tuple[int, int]]:
    """Start and end, in code points, of the words of text ``i`` that ``words_of`` has, found by the same pattern."""
    import pyarrow.compute as pc

    one = lowered(texts.slice(i, 1))
    text, at, out = one[0].as_py(), 0, []
    for w in filter(None, pc.split_pattern_regex(one, _LETTERS)[0].as_py()):
        at = text.index(w, at)
        out.append((at, at + len(w)))
        at += len(w)
    return out


def words_of(texts) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Word codes in order, the end of each text's codes (a leading 0 too), and the words in lower case."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.split_pattern_regex(lowered(texts), _LETTERS)
    offsets, flat = lists.offsets.to_numpy(), pc.dictionary_encode(lists.flatten())
    there = np.array([w != "" for w in flat.dictionary.to_pylist()], bool)
    codes = flat.indices.to_numpy()
    held = there[codes] if len(codes) else np.zeros(0, bool)
    return codes[held], np.concatenate([[0], np.cumsum(held)])[offsets - offsets[0]], flat.dictionary.to_pylist()


def features(words: Sequence[str]) -> np.ndarray:
    """(words, 1 + prefixes) feature numbers."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    out = np.fromiter((h(x) for w in words for x in (w, *(f"{w[:n]}*{n}" for n in PREFIXES))), np.uint64, len(words) * (1 + len(PREFIXES)))
    return (out.reshape(len(words), -1) % np.uint64(DIMENSIONS)).astype(np.int64)


def ratios(emit: np.ndarray, ends: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward ratios, tag 1 to tag 0, of each token; ``emit``: exp of its score, ``chain``: [[a00, a01], [a10, a11], [start0, start1]] as weights."""
    (a00, a01), (a10, a11), (s0, s1) = chain.tolist()
    lengths = np.diff(ends)
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = ends[:-1][order], lengths[order]
    forward, backward = np.empty(len(emit)), np.empty(len(emit))
    longest = int(sizes[0]) if len(sizes) else 0
    alive = len(sizes) - np.searchsorted(sizes[::-1], np.arange(longest), side="right")
    r = np.full(len(sizes), s1 / s0)
    for t, n in enumerate(alive.tolist()):
        at = starts[:n] + t
        r = (r[:n] if t == 0 else (a01 + r[:n] * a11) / (a00 + r[:n] * a10)) * emit[at]
        forward[at] = r
    last = starts + sizes - 1
    b = np.ones(len(sizes))
    for t, n in enumerate(alive.tolist()):
        at = last[:n] - t
        if t == 0:
            b = b[:n]
        else:
            x = emit[at + 1] * b[:n]
            b = (a10 + a11 * x) / (a00 + a01 * x)
        backward[at] = b
    return forward, backward


@dataclass
class Tagger:
    weights: np.ndarray
    bias: float
    chain: np.ndarray
    threshold: float

    def marginals(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """P(toxic) of each token, and the ends of each text's tokens."""
        codes, ends, words = words_of(texts)
        emit = np.exp(np.clip(self.word_scores(words), -30, 30))[codes] if len(codes) else np.zeros(0)
        f, b = ratios(emit, ends, self.chain)
        return f * b / (1 + f * b), ends

    def word_scores(self, words: list[str]) -> np.ndarray:
        """The weights' sum of each word; words seen before are looked up, in a memo that starts anew when it is full."""
        memo = self.__dict__.setdefault("memo", {})
        if len(memo) > MEMO_WORDS:
            memo.clear()
        fresh = [w for w in words if w not in memo]
        if fresh:
            memo.update(zip(fresh, (self.weights[features(fresh)].sum(axis=1) + self.bias).tolist(), strict=True))
        return np.fromiter(map(memo.__getitem__, words), np.float64, len(words))

    def scores(self, p: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A document's score from its marginals; 0 without words."""
        out = np.zeros(len(ends) - 1)
        full = np.flatnonzero(np.diff(ends))
        if len(full):
            top = np.clip(np.maximum.reduceat(p, ends[:-1][full]), 1e-9, 1 - 1e-9)
            out[full] = 1 / (1 + np.exp(np.log(self.threshold / (1 - self.threshold)) - np.log(top / (1 - top))))
        return out


def fit(texts: Sequence[str], toxic: Sequence[int]) -> Tagger | None:
    """A tagger from documents and their labels; None where a label is missing altogether."""
    import pyarrow as pa

    distinct = dict(zip(texts, toxic, strict=True))  # copies of a document are no further evidence
    texts, y = list(distinct), np.array(list(distinct.values()), bool)
    if not y.any() or y.all():
        return None
    codes, ends, words = words_of(pa.array(texts, pa.string()))
    of = np.repeat(np.arange(len(y)), np.diff(ends))
    table = features(words)
    seen = np.unique(of * len(words) + codes)
    doc, word = seen // len(words), seen % len(words)
    pairs = np.unique((doc[:, None] * DIMENSIONS + table[word]).ravel())
    in_toxic = y[pairs // DIMENSIONS]
    n1 = np.bincount(pairs[in_toxic] % DIMENSIONS, minlength=DIMENSIONS)
    n = n1 + np.bincount(pairs[~in_toxic] % DIMENSIONS, minlength=DIMENSIONS)
    prior, rate = y.mean(), n1 / np.maximum(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        evidence = np.nan_to_num(n1 * np.log(rate / prior)) + np.nan_to_num((n - n1) * np.log((1 - rate) / (1 - prior)))
    marking = (evidence >= EVIDENCE) & (rate > 0.5) & (n1 >= LEAST_SHARE * y.sum())
    tags = (marking[table].any(axis=1)[codes] & y[of]).astype(np.float64)
    starts = ends[:-1][np.diff(ends) > 0]
    inner = np.ones(len(codes), bool)
    inner[starts] = False
    follow = np.flatnonzero(inner)
    counted = np.zeros((3, 2))
    np.add.at(counted, (tags[follow - 1].astype(int), tags[follow].astype(int)), 1)
    np.add.at(counted[2], tags[starts].astype(int), 1)
    params = np.concatenate([np.zeros(DIMENSIONS), [-4.0], np.zeros(6)])
    steps = np.full(len(params), 1e-8)
    for _ in range(EPOCHS):
        chain = np.exp(params[-6:].reshape(3, 2))
        emit = np.exp(np.clip(params[:DIMENSIONS][table].sum(axis=1) + params[DIMENSIONS], -30, 30))[codes]
        f, b = ratios(emit, ends, chain)
        p = f * b / (1 + f * b)
        x = emit[follow] * b[follow]
        joint = np.stack([np.full(len(follow), chain[0, 0]), chain[0, 1] * x, chain[1, 0] * f[follow - 1], chain[1, 1] * f[follow - 1] * x])
        expected = (joint / joint.sum(axis=0)).sum(axis=1)
        by_word = np.bincount(codes, tags - p, minlength=len(words))
        grad = np.concatenate([np.bincount(table.ravel(), np.repeat(by_word, table.shape[1]), minlength=DIMENSIONS) - 0.02 * params[:DIMENSIONS], [by_word.sum()], (counted[:2].ravel() - expected), counted[2] - [(1 - p[starts]).sum(), p[starts].sum()]])
        steps += grad * grad
        params += 0.7 * grad / np.sqrt(steps)
    chain = np.exp(params[-6:].reshape(3, 2))
    tagger = Tagger(params[:DIMENSIONS], float(params[DIMENSIONS]), chain, 0.5)
    p, _ = tagger.marginals(pa.array(texts, pa.string()))
    top = tagger.scores(p, ends)
    tagger.threshold = _best_threshold(top, y)
    return tagger


def _best_threshold(score: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest gap (in log-odds) among the cuts with the fewest errors."""
    order = np.argsort(score, kind="stable")
    s, t = np.clip(score[order], 1e-9, 1 - 1e-9), y[order]
    wrong = np.concatenate([[0], np.cumsum(t)]) + np.concatenate([[0], np.cumsum(~t[::-1])])[::-1]
    odds = np.concatenate([[np.log(1e-9)], np.log(s / (1 - s)), [-np.log(1e-9)]])
    gap = np.diff(odds)
    cut = max(np.flatnonzero((wrong == wrong[gap > 0].min()) & (gap > 0)), key=lambda i: gap[i])
    return float(1 / (1 + np.exp(-(odds[cut] + odds[cut + 1]) / 2)))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text is divisible by 5; null ids aren't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Tagger | None:
    """Fit on a bounded sample of the labelled rows that aren't held out, chosen by hash of doc_id.

    Null texts, ids and labels are left out, as are documents of over MOST_CHARS characters; these go before the sample
    is drawn, so the sample is as large as the labels allow. Copies of a text count once, the label of the
    last one holds. Labels without documents have no effect; empty tables, and labels of one class only, give no tagger.
    """
    open_rows = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("id"), (F.col("toxic") > 0).cast("int").alias("y"))
    texts = docs.filter(F.length("text") <= MOST_CHARS).select(F.col("doc_id").cast("long").alias("id"), "text")
    open_rows = open_rows.join(texts.select("id"), "id", "left_semi")
    by = (F.xxhash64("id"), F.col("id"))
    chosen = open_rows.filter("y = 1").orderBy(*by).limit(MOST_TOXIC).unionByName(open_rows.filter("y = 0").orderBy(*by).limit(MOST_CLEAN))
    rows = texts.join(F.broadcast(chosen), "id").select("id", "text", "y").toPandas().sort_values(["id", "text"])  # at most MOST_TOXIC + MOST_CLEAN ids are broadcast
    return fit(rows["text"].tolist(), rows["y"].tolist())


def score(docs: DataFrame, tagger: Tagger | None, text: str = "text", keep: Sequence[str] = ("doc_id",), with_spans: bool = True) -> DataFrame:
    """``keep``, score (0 to 1) and, if asked for, spans (array of start, end, word) of tokens tagged toxic, in code points.

    A null text is empty and scores 0, as does every text where labels had only one class. No other
    column is read. An empty table gives an empty one; repeated rows give repeated results.
    """
    ship(docs.sparkSession)
    kept = [f"k{i}" for i in range(len(keep))]
    narrow = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept, strict=True)], F.col(f"`{text}`").cast("string").alias("t"))
    schema = ", ".join([*(f"{k} {narrow.schema[k].dataType.simpleString()}" for k in kept), "score double"]) + ", spans array<struct<start: int, end: int, word: string>>" * with_spans
    model = docs.sparkSession.sparkContext.broadcast(tagger)

    def tag(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        from plumbline.llm._tokens import balanced, regrouped

        tagger = model.value
        for batch in regrouped(batches, GROUP_BYTES):  # the ratios step through the longest text of a group
            column = batch.column(batch.num_columns - 1)
            for a, b in balanced(pc.fill_null(pc.binary_length(column), 0).to_pylist(), GROUP_BYTES):
                texts = column.slice(a, b - a)
                p, ends = tagger.marginals(texts) if tagger else (np.zeros(0), np.zeros(b - a + 1, np.int64))
                scores = tagger.scores(p, ends) if tagger else np.zeros(b - a)
                out = [*batch.slice(a, b - a).columns[:-1], pa.array(scores)]
                if with_spans:
                    spans: list[list[dict]] = [[] for _ in range(b - a)]
                    for i in np.flatnonzero(scores >= 0.5).tolist():
                        text, found = texts[i].as_py(), word_offsets(texts, i)
                        toxic = np.flatnonzero(p[ends[i] : ends[i + 1]] >= 0.5).tolist()
                        spans[i] = [{"start": found[j][0], "end": found[j][1], "word": text[found[j][0] : found[j][1]]} for j in toxic]
                    out.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("word", pa.string())]))))
                yield pa.RecordBatch.from_arrays(out, names=[*kept, "score"] + ["spans"] * with_spans)

    return narrow.mapInArrow(tidy(tag), schema).withColumnsRenamed(dict(zip(kept, keep, strict=True)))

"""Quality rules by line labelling: a linear-chain conditional random field, decoded by Viterbi.

Each line with a word is one position; the field marks it content or boilerplate. The share of a
text's word characters that lie on content lines decides whether it is retained. The field is
trained here, from documents of the ``labels`` table. The labels are of documents, the states of
lines are latent: they are decoded under the document's label, which bounds the share of content
(at least half of a good one, at most half of a bad one), and the field is fitted to them, in turns.
Training uses a bounded sample: ``sample`` documents of each class, those with the least hash of
their id, and of their lines 4 * ``sample`` pieces of at most 48 lines.

Null texts have no words and fail the base rules, as empty ones do. Without labels of both classes
the field keeps every line as content. Repeated rows come back repeated; very long texts are read
whole. Only doc_id and text are read, so other columns may have any names; ``keep_good`` passes them on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches

_UPPER = bytes(range(65, 91))
_LETTER = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGIT = bytes(range(48, 58))
_SYMBOL = b"#*$%&|<>"
_PUNCT = b"!?.,;:"
N_FEATURES = 11
#: Lines of a training sequence at most.
PIECE = 48


def line_features(line: bytes, words: list[bytes], again: bool) -> list[float]:
    n, size = len(words), max(len(line), 1)
    letters = max(size - len(line.translate(None, _LETTER)), 1)
    symbols = size - len(line.translate(None, _SYMBOL))
    ends = line.rstrip()[-1:]
    return [
        1.0,
        min(symbols / n, 3.0),
        min(2.0 * line.count(b"|") / n, 2.0),
        min(line.count(b"!") / n, 3.0),
        (size - len(line.translate(None, _UPPER))) / letters,
        min((size - len(line.translate(None, _DIGIT))) / letters, 2.0),
        1.0 - len(set(words)) / n,
        1.0 if again else 0.0,
        0.0 if ends in (b".", b"!", b"?") else 1.0,
        1.0 if n < 3 else 0.0,
        min((size - len(line.translate(None, _PUNCT))) / n, 3.0),
    ]


def text_lines(text: bytes) -> tuple[list[list[float]], list[int], int]:
    """(features, word characters) of each line with a word, and the number of repeated such lines."""
    seen: set[bytes] = set()
    rows, weights, dup = [], [], 0
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            continue
        again = line in seen
        seen.add(line)
        dup += again
        rows.append(line_features(line, words, again))
        weights.append(sum(map(len, words)))
    return rows, weights, dup


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more, the first occurrence included."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == n:
        return 0
    count: dict = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    total, upto = 0, 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            total += i + 3 - max(i, upto)
            upto = i + 3
    return total


def viterbi(emit: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best state of each position; ``emit`` is n x 2, ``trans`` 2 x 2 (from, to)."""
    a, b = float(emit[0, 0]), float(emit[0, 1])
    (t00, t01), (t10, t11) = trans.tolist()
    back = []
    for e0, e1 in emit[1:].tolist():
        x0, x1 = a + t00, b + t10
        y0, y1 = a + t01, b + t11
        back.append((x1 > x0, y1 > y0))
        a, b = max(x0, x1) + e0, max(y0, y1) + e1
    state = int(b > a)
    path = [state]
    for step in reversed(back):
        state = int(step[state])
        path.append(state)
    return np.array(path[::-1])


def batches_of(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sequences as one padded array, and where it holds lines."""
    top = max(map(len, sequences))
    x, mask = np.zeros((len(sequences), top, N_FEATURES)), np.zeros((len(sequences), top))
    for i, s in enumerate(sequences):
        x[i, : len(s)], mask[i, : len(s)] = s, 1
    return x, mask


def train_crf(sequences: list[np.ndarray], states: list[np.ndarray], rounds: int = 150, rate: float = 0.15, decay: float = 1e-3, start: tuple[np.ndarray, np.ndarray] | None = None, chain: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x 2) and transitions (2 x 2) that maximise the conditional likelihood of ``states``.

    State 1 is content. Forward-backward runs on all sequences at once. Both states count alike,
    whatever the number of their lines. Without ``chain`` the transitions stay 0 and lines are alone.
    """
    w, t = (start[0].copy(), start[1].copy()) if start else (np.zeros((N_FEATURES, 2)), np.zeros((2, 2)))
    if len({y for s in states for y in np.unique(s).tolist()}) < 2:
        return w, t
    x, mask = batches_of(sequences)
    n, top = mask.shape
    gold = np.zeros((n, top, 2))
    for i, y in enumerate(states):
        gold[i, np.arange(len(y)), y] = 1
    # A sequence weighs by its states, so that their lines count alike in all.
    share = gold.sum(1) @ (0.5 / gold.sum((0, 1))) / mask.sum(1)
    held = np.einsum("nta,ntb,n->ab", gold[:, :-1], gold[:, 1:], share)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    for step in range(1, rounds + 1):
        emit = x @ w
        if chain:
            node, pair = marginals(emit, mask, t)
            gt = held - np.einsum("ntab,n->ab", pair, share) - decay * t
        else:
            node, gt = np.exp(emit - np.logaddexp.reduce(emit, axis=2)[..., None]) * mask[..., None], np.zeros((2, 2))
        gw = np.einsum("ntf,nts,n->fs", x, gold - node, share, optimize=True) - decay * w
        for k, (p, g) in enumerate(((w, gw), (t, gt))):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w, t


def marginals(emit: np.ndarray, mask: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward: the probabilities of states (n, top, 2) and of neighbouring states (n, top - 1, 2, 2)."""
    n, top = mask.shape
    alpha, beta = np.zeros((n, top, 2)), np.zeros((n, top, 2))
    alpha[:, 0] = emit[:, 0]
    for i in range(1, top):
        now = np.logaddexp.reduce(alpha[:, i - 1, :, None] + t[None], axis=1) + emit[:, i]
        alpha[:, i] = np.where(mask[:, i, None] > 0, now, alpha[:, i - 1])
    for i in range(top - 2, -1, -1):
        now = np.logaddexp.reduce(t[None] + (emit[:, i + 1] + beta[:, i + 1])[:, None, :], axis=2)
        beta[:, i] = np.where(mask[:, i + 1, None] > 0, now, 0)
    z = np.logaddexp.reduce(alpha[:, -1], axis=1)
    node = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
    pair = np.exp(alpha[:, :-1, :, None] + t[None, None] + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
    return node, pair


def bound_states(emit: np.ndarray, trans: np.ndarray, sizes: np.ndarray, label: int) -> np.ndarray:
    """The best states under the document's label: content is at least half of a good one, at most half of a bad one.

    Where the free path breaks that, content is favoured (or disfavoured) by the least bias that mends it.
    """
    path = viterbi(emit, trans)
    fits = lambda p: (p @ sizes * 2 >= sizes.sum()) if label else (p @ sizes * 2 <= sizes.sum())
    if fits(path):
        return path
    lean = np.array([0.0, 1.0 if label else -1.0])
    low, high = 0.0, 1.0
    while not fits(viterbi(emit + high * lean, trans)):
        low, high = high, 2 * high
    for _ in range(12):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(viterbi(emit + mid * lean, trans)) else (mid, high)
    return viterbi(emit + high * lean, trans)


def train_lines(sequences: list[np.ndarray], sizes: list[np.ndarray], labels: list[int], passes: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The field fitted with latent line states: only the label of the document around the lines is known.

    The first fit takes each line alone, with its document's label. Then states are decoded under the
    label's bound on the share of content, and the chain is fitted to them, ``passes`` times. So prose
    in a bad document becomes content, junk in a good one boilerplate, and states change within texts.
    """
    if len(set(labels)) < 2:
        return np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    w, t = train_crf(sequences, [np.full(len(s), y) for s, y in zip(sequences, labels)], chain=False)
    for i in range(passes):
        states = [bound_states(s @ w, t, c, y) for s, c, y in zip(sequences, sizes, labels)]
        w, t = train_crf(sequences, states, rounds=40, start=(w, t))
    return w, t


def content_share(rows: list[list[float]], weights: list[int], w: np.ndarray, t: np.ndarray) -> float:
    if not rows:
        return 0.0
    if not w.any():
        return 1.0
    path, size = viterbi(np.array(rows) @ w, t), np.array(weights, float)
    return float((size * path).sum() / size.sum())


def _judge(w: np.ndarray, t: np.ndarray, least: float):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"]

    def run(batches):
        for batch in batches:
            out = []
            for raw in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist():
                raw = raw or b""
                words = raw.split()
                joined = b"".join(words)
                chars = len(joined) - len(joined.translate(None, bytes(range(128, 192))))
                rows, weights, dup = text_lines(raw)
                again = repeated_words(words)
                failed = len(words) < 50 or 100 * again > 50 * len(words)
                share = content_share(rows, weights, w, t)
                out.append((len(words), len(joined) - chars, len(raw) - len(raw.translate(None, _SYMBOL)), dup, again, failed, not failed and share >= least, share))
            if out:
                arrays = [pa.array(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], [*batch.schema.names[:-1], *names])

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """The field's weights from at most ``sample`` labelled documents of each class."""
    spark = docs.sparkSession
    arrow_batches(spark)
    marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = [r for q in (0, 1) for r in marks.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    if not picked:
        return np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    ids = spark.createDataFrame([(int(r.doc_id), int(r.quality)) for r in picked], "id long, quality int")

    def features(batches):
        for batch in batches:
            for quality, text in zip(batch.column(0), batch.column(1)):
                rows, sizes, _ = text_lines((text.as_py() or "").encode())
                for i in range(0, len(rows), PIECE):
                    cut = np.array(rows[i : i + PIECE])
                    yield pa.RecordBatch.from_arrays([pa.array([quality.as_py()], pa.int32()), pa.array([cut.ravel().tolist()], pa.list_(pa.float64())), pa.array([sizes[i : i + PIECE]], pa.list_(pa.int64()))], ["quality", "x", "sizes"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    texts = plain.join(F.broadcast(ids), F.col("doc") == F.col("id")).select("quality", "text")  # at most 2 * sample ids
    got = texts.mapInArrow(features, "quality int, x array<double>, sizes array<long>").orderBy(F.xxhash64("x"), "quality", "sizes").limit(4 * sample).collect()
    return train_lines([np.array(r.x).reshape(-1, N_FEATURES) for r in got], [np.array(r.sizes, float) for r in got], [r.quality for r in got])


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = 600, least: float = 0.5) -> DataFrame:
    """One row for each document: the base counts, the verdict, and the share of content."""
    w, t = fit_quality(docs, labels, sample)
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_judge(w, t, least), schema)


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = 600, least: float = 0.5) -> DataFrame:
    """The documents that the rules keep, unchanged."""
    w, t = fit_quality(docs, labels, sample)
    judge = _judge(w, t, least)
    names = docs.columns

    def run(batches):
        for batch in batches:
            probe = pa.RecordBatch.from_arrays([batch.column(names.index("text")).cast(pa.string())], ["text"])
            for verdict in judge(iter([probe])):
                yield batch.filter(verdict.column("kept"))

    return docs.mapInArrow(run, docs.schema)

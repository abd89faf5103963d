"""Language identification by a small convolutional network over bytes.

Bytes of the lower-cased text get learned vectors; filters of several widths
slide over fixed-length windows, each keeps its largest response, and a softmax
turns those into languages. The network is trained in numpy on windows of a
bounded sample of labelled documents, and applied to every window of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundplan.llm.units import tidy
from groundplan.llm.words import Texts, blocks, read_texts

UNKNOWN = "und"
WINDOW = 128
WIDTHS = (2, 3, 4, 5)
FILTERS = 8  # of each width
BYTE_SIZE = 12
# the training sample: about this many documents of each language, and windows of each
SAMPLE_DOCUMENTS = 1000
SAMPLE_WINDOWS = 6
# windows scored together
_TOGETHER = 128


def windows_of(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts, the last of each filled up with zero bytes, and how many each text has."""
    sizes = np.diff(texts.offsets)
    counts = np.maximum(-(-sizes // WINDOW), 1)
    laid = np.zeros(int(counts.sum()) * WINDOW, np.uint8)
    shift = (np.cumsum(counts) - counts) * WINDOW - texts.offsets[:-1]
    laid[np.arange(len(texts.data)) + np.repeat(shift, sizes)] = texts.data
    return laid.reshape(-1, WINDOW), counts


@dataclass
class Network:
    """Byte vectors, one filter bank per width, and the softmax layer."""

    languages: list[str]
    vectors: np.ndarray  # 256 x BYTE_SIZE
    banks: list[np.ndarray]  # width x BYTE_SIZE x FILTERS
    bias: np.ndarray
    weights: np.ndarray  # filters x languages
    offset: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.vectors, *self.banks, self.bias, self.weights, self.offset]

    def tables(self) -> list[np.ndarray]:
        """Response of the filters to each byte at each place in the filter; narrower filters come first and drop out."""
        rows = []
        for place in range(max(WIDTHS)):
            rows.append(np.concatenate([self.vectors @ bank[place] for bank in self.banks if len(bank) > place], axis=1))
        return rows

    def responses(self, windows: np.ndarray, tables: list[np.ndarray], places: bool = False):
        """Largest response of each filter in each window, and where it is."""
        total = len(WIDTHS) * FILTERS
        best = np.empty((len(windows), total), np.float32)
        at = np.empty((len(windows), total), np.int64) if places else None
        for first in range(0, len(windows), _TOGETHER):
            part = windows[first : first + _TOGETHER]
            sums = np.take(tables[0], part, axis=0)
            for place in range(1, max(WIDTHS)):
                table = tables[place]
                sums[:, : WINDOW - place, total - table.shape[1] :] += np.take(table, part[:, place:], axis=0)
            for k, width in enumerate(WIDTHS):
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                valid = sums[:, : WINDOW - width + 1, own]
                best[first : first + len(part), own] = valid.max(axis=1)
                if places:
                    at[first : first + len(part), own] = valid.argmax(axis=1)
        return best + self.bias, at

    def chances(self, hidden: np.ndarray) -> np.ndarray:
        raw = np.maximum(hidden, 0) @ self.weights + self.offset
        raw = np.exp(raw - raw.max(axis=1, keepdims=True))
        return raw / raw.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], rounds: int = 6, batch: int = 128, seed: int = 7) -> Network:
    """Fit the network by Adam on shuffled batches; the same windows give the same network."""
    rng = np.random.default_rng(seed)
    total = len(WIDTHS) * FILTERS
    net = Network(
        languages,
        rng.normal(0, 0.5, (256, BYTE_SIZE)).astype(np.float32),
        [rng.normal(0, 1 / np.sqrt(w * BYTE_SIZE), (w, BYTE_SIZE, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(total, np.float32),
        rng.normal(0, 0.1, (total, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    # languages count alike, however many windows they have
    share = np.bincount(labels, minlength=len(languages)).astype(np.float64)
    weight = (len(labels) / len(languages) / np.maximum(share, 1))[labels]
    time = 0
    for _ in range(rounds):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            grads = _gradients(net, windows[rows], labels[rows], weight[rows])
            time += 1
            for p, g, m, v in zip(net.parameters(), grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (0.005 * (m / (1 - 0.9**time)) / (np.sqrt(v / (1 - 0.99**time)) + 1e-7)).astype(np.float32)
    return net


def _gradients(net: Network, windows: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    hidden, at = net.responses(windows, net.tables(), places=True)
    error = net.chances(hidden)
    error[np.arange(len(labels)), labels] -= 1
    error *= (weight / len(labels))[:, None]
    back = (error @ net.weights.T) * (hidden > 0)
    vectors, banks = np.zeros_like(net.vectors), []
    for k, (width, bank) in enumerate(zip(WIDTHS, net.banks)):
        own = slice(k * FILTERS, (k + 1) * FILTERS)
        seen = windows[np.arange(len(windows))[:, None, None], at[:, own, None] + np.arange(width)]
        banks.append(np.einsum("nf,nfwd->wdf", back[:, own], net.vectors[seen]))
        np.add.at(vectors, seen, np.einsum("nf,wdf->nfwd", back[:, own], bank))
    return [vectors, *banks, back.sum(axis=0), np.maximum(hidden, 0).T @ error, error.sum(axis=0)]


def _lowered(column: pa.Array) -> Texts:
    return read_texts(pc.utf8_lower(column))


def sample_windows(labelled: DataFrame, documents: int = SAMPLE_DOCUMENTS, windows: int = SAMPLE_WINDOWS) -> DataFrame:
    """Windows of about ``documents`` rows (doc_id, text, lang) of each language, picked by a hash of the id and text.

    A language with fewer rows gives them all. Of each text ``windows`` windows
    are taken at even distances, so the sample does not grow with the table.
    """
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    shares = usable.groupBy("lang").agg((F.lit(float(documents)) / F.count(F.lit(1))).alias("_share"))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    picked = usable.join(F.broadcast(shares), "lang").filter(draw < F.col("_share")).select("doc_id", "lang", "text")  # a row per language

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, past, texts in blocks(_lowered(batch.column(2))):
                laid, counts = windows_of(texts)
                ends = np.cumsum(counts)
                taken = [np.unique(np.linspace(0, c - 1, min(windows, c)).astype(np.int64)) for c in counts.tolist()]
                rows = np.repeat(np.arange(first, past), [len(t) for t in taken])
                places = np.concatenate([t + e - c for t, e, c in zip(taken, ends, counts)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)).cast(pa.int64()), batch.column(1).take(pa.array(rows)), pa.array([w.tobytes() for w in laid[places]], pa.binary())],
                    ["doc_id", "lang", "bytes"],
                )

    return picked.mapInArrow(tidy(cut), "doc_id long, lang string, bytes binary")


def fit(labelled: DataFrame, documents: int = SAMPLE_DOCUMENTS) -> Network | None:
    """Train on a bounded sample of labelled rows (doc_id, text, lang); None if no row can be used."""
    rows = sample_windows(labelled, documents).toArrow()
    if not rows.num_rows:
        return None
    data = np.frombuffer(b"".join(rows.column("bytes").to_pylist()), np.uint8).reshape(-1, WINDOW)
    names = rows.column("lang").to_pylist()
    languages = sorted(set(names))
    labels = np.array([languages.index(n) for n in names])
    order = np.lexsort((*data.T[:24], labels, np.array(rows.column("doc_id").fill_null(-1))))
    return train(data[order], labels[order], languages)


def predict(documents: DataFrame, network: Network | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Add the predicted language and its score, under the two ``names``, to the rows of ``documents``, from the whole text.

    The score is the mean chance of the language over all windows. A null text,
    or one without a letter, is ``und`` with score 0, as is every text when
    there is no network. Columns of those two names are replaced; rows stay as
    they are, repeated ones included.
    """
    kept = [c for c in documents.columns if c.lower() not in names]
    tables = network.tables() if network else []
    readable = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = np.array(network.languages, object)
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            readable = batch.column(len(kept)).to_numpy(zero_copy_only=False).astype(bool)
            for first, past, texts in blocks(_lowered(text)):
                laid, counts = windows_of(texts)
                chances = network.chances(network.responses(laid, tables)[0])
                mean = np.add.reduceat(chances, np.cumsum(counts) - counts, axis=0) / counts[:, None]
                best = mean.argmax(axis=1)
                sure = readable[first:past]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(i).slice(first, past - first) for i in range(len(kept))],
                        pa.array(np.where(sure, languages[best], UNKNOWN), pa.string()),
                        pa.array(np.where(sure, np.minimum(mean.max(axis=1), 1), 0).astype(np.float64)),
                    ],
                    [*kept, *names],
                )

    if network is None:
        return documents.select(*kept, F.lit(UNKNOWN).alias(names[0]), F.lit(0.0).alias(names[1]))
    schema = documents.select(*kept).schema.add(names[0], "string").add(names[1], "double")
    return documents.select(*kept, readable.alias("_readable")).mapInArrow(tidy(score), schema)


def held_out() -> Column:
    """Documents kept away from training: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def identify(documents: DataFrame) -> DataFrame:
    """Train on the documents that are not held out, and predict all."""
    network = fit(documents.filter(~held_out()))
    return predict(documents.select("doc_id", "text"), network).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(documents: DataFrame, least: float = 0.35) -> DataFrame:
    """The documents whose language is recognised with a score of at least ``least``.

    Texts in two languages share the score among them, hence the low limit; a
    null text or one without letters is rejected.
    """
    lang, score = "_lang_pred", "_score"
    while {lang, score} & {c.lower() for c in documents.columns}:
        lang, score = f"_{lang}", f"_{score}"
    scored = predict(documents, fit(documents.filter(~held_out())), (lang, score))
    return scored.filter((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).select(*documents.columns)

"""Languages of words and documents by a linear-chain conditional random field.

Emissions come from hashed character n-grams (those at a word's edge are its affixes) and
from lexicons; transitions between languages are learned from spliced sentences, so that
code-switched text gets a label per word. Forward-backward runs over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm.common import documents, register, shipped

SLOTS = 1 << 15  # hashed n-gram features
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


class Settings(NamedTuple):
    """What bounds the labelled sample and the fit. The sample is for fitting alone."""

    docs_per_language: int = 300  # expected number, drawn by hash
    window_chars: int = 4000  # one window at a hashed offset of each sampled document
    sequences: int = 1200  # spliced training sequences
    sequence_words: int = 48
    run_words: int = 12  # mean words before a splice
    lexicon_words: int = 1500  # most frequent sampled words per language
    steps: int = 40
    rate: float = 0.15
    decay: float = 1e-4
    seed: int = 7


class Model(NamedTuple):
    languages: list[str]
    grams: np.ndarray  # SLOTS x L
    lexicon: dict[str, np.ndarray]  # word -> which lexicons hold it, as 0 / 1 per language
    lexical: np.ndarray  # L x L: weight of being in lexicon i for label j
    transitions: np.ndarray  # L x L log weights


def gram_slots(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of all words in a row, and where each word's slots begin.

    n-grams of 2 and 3 characters anywhere (the edge counts as a character), of 4 at an edge.
    """
    text = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    edge = text == 10
    word = np.cumsum(edge) - 1  # a position belongs to the word after the edge before it
    slots, owners = [], []
    for n in (2, 3, 4):
        m = len(text) - n + 1
        if m <= 0:
            continue
        fine = np.ones(m, bool)
        for k in range(1, n - 1):
            fine &= ~edge[k : m + k]
        if n == 4:
            fine &= edge[:m] | edge[n - 1 :]
        at = np.flatnonzero(fine)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = (h ^ text[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        slots.append((h % np.uint64(SLOTS)).astype(np.int64))
        owners.append(word[at])
    slots, owners = np.concatenate(slots), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    starts = np.searchsorted(owners[order], np.arange(len(words)))
    return slots[order], starts


def emissions(words: list[str], model: Model) -> np.ndarray:
    """Log scores (words x languages). Every word has two edge n-grams at least."""
    slots, starts = gram_slots(words)
    scores = np.add.reduceat(model.grams[slots], starts, axis=0)
    known = [(i, model.lexicon[w]) for i, w in enumerate(words) if w in model.lexicon]
    if known:
        scores[[i for i, _ in known]] += np.array([x for _, x in known]) @ model.lexical
    return scores


def marginals(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, block: int = 32) -> np.ndarray:
    """Forward-backward over many chains at once; exact, in blocks.

    ``scores`` holds the chains one after the other. Each block of a chain is first reduced to
    the matrix that carries a forward vector across it, then vectors are carried from block to
    block, and last all blocks are run with their true entry vectors. So the number of numpy
    steps depends on the block length and the longest chain / block length, not on the words.
    """
    n, size = scores.shape
    lengths = lengths[lengths > 0]
    psi = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)
    jump = np.exp(transitions - transitions.max())
    blocks = -(-lengths // block)
    total = int(blocks.sum())
    ordinal = np.arange(total) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = np.repeat(np.cumsum(lengths) - lengths, blocks) + ordinal * block
    count = np.minimum(block, np.repeat(lengths, blocks) - ordinal * block)
    at = np.minimum(begin[:, None] + np.arange(block), n - 1)
    real = np.arange(block) < count[:, None]
    p = psi[at]  # blocks x block x languages

    carry = np.broadcast_to(np.eye(size), (total, size, size)).copy()
    for t in range(block):
        following = (carry @ jump) * p[:, t, None, :]
        following /= following.max(axis=(1, 2), keepdims=True)
        carry = np.where(real[:, t, None, None], following, carry)

    entry, leave = np.empty((total, size)), np.empty((total, size))
    first = np.cumsum(blocks) - blocks
    longest_first = np.argsort(-blocks, kind="stable")
    ranked = blocks[longest_first]
    forward = np.full((len(lengths), size), 1.0 / size)
    for j in range(int(ranked[0]) if len(ranked) else 0):
        live = longest_first[: np.searchsorted(-ranked, -j, side="left")]
        b = first[live] + j
        entry[b] = forward[live]
        moved = np.einsum("ni,nij->nj", forward[live], carry[b])
        forward[live] = moved / moved.sum(axis=1, keepdims=True)
    backward = np.full((len(lengths), size), 1.0)
    for j in range(int(ranked[0]) - 1 if len(ranked) else -1, -1, -1):
        live = longest_first[: np.searchsorted(-ranked, -j, side="left")]
        b = first[live] + j
        leave[b] = backward[live]
        moved = np.einsum("nij,nj->ni", carry[b], backward[live])
        backward[live] = moved / moved.max(axis=1, keepdims=True)

    alpha = np.empty((total, block, size))
    a = entry
    for t in range(block):
        following = (a @ jump) * p[:, t]
        following /= following.sum(axis=1, keepdims=True)
        a = np.where(real[:, t, None], following, a)
        alpha[:, t] = a
    back = leave
    for t in range(block - 1, -1, -1):
        alpha[:, t] *= back
        before = (p[:, t] * back) @ jump.T
        before /= before.max(axis=1, keepdims=True)
        back = np.where(real[:, t, None], before, back)
    gamma = alpha[real]
    return gamma / gamma.sum(axis=1, keepdims=True)


def fit(sample: list[tuple[str, str]], settings: Settings = Settings()) -> Model | None:
    """Learn from (language, text) windows; None without a usable window."""
    languages = sorted({lang for lang, _ in sample})
    by_language: dict[str, list[list[str]]] = {lang: [] for lang in languages}
    for lang, text in sorted(sample):
        words = LETTERS.findall(text.lower())
        if words:
            by_language[lang].append(words)
    languages = [lang for lang in languages if by_language[lang]]
    if not languages:
        return None
    size, rng = len(languages), np.random.default_rng(settings.seed)

    lexicon: dict[str, np.ndarray] = {}
    for j, lang in enumerate(languages):
        words, counts = np.unique(np.array([w for doc in by_language[lang] for w in doc], dtype=object), return_counts=True)
        for i in np.lexsort((words, -counts))[: settings.lexicon_words]:
            if counts[i] >= 3:
                lexicon.setdefault(words[i], np.zeros(size))[j] = 1.0

    # Sequences spliced from runs of several languages teach the transitions.
    words, labels = [], []
    length = settings.sequence_words
    for _ in range(settings.sequences):
        made = 0
        while made < length:
            j = int(rng.integers(size))
            docs = by_language[languages[j]]
            doc = docs[int(rng.integers(len(docs)))]
            run = min(length - made, int(rng.geometric(1.0 / settings.run_words)), len(doc))
            start = int(rng.integers(len(doc) - run + 1))
            words += doc[start : start + run]
            labels += [j] * run
            made += run
    distinct, which = np.unique(np.array(words, dtype=object), return_inverse=True)
    labels = np.array(labels).reshape(-1, length)
    slots, starts = gram_slots(list(distinct))
    per_word = np.diff(np.append(starts, len(slots)))
    inside = np.array([lexicon.get(w, np.zeros(size)) for w in distinct])
    truth = np.eye(size)[labels]
    pairs_seen = np.einsum("sti,stj->ij", truth[:, :-1], truth[:, 1:])

    params = [np.zeros((SLOTS, size)), np.zeros((size, size)), np.zeros((size, size))]
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in params]
    for step in range(1, settings.steps + 1):
        grams, lexical, transitions = params
        by_word = np.add.reduceat(grams[slots], starts, axis=0) + inside @ lexical
        psi = by_word[which].reshape(-1, length, size)
        psi = np.exp(psi - psi.max(axis=2, keepdims=True))
        jump = np.exp(transitions)
        alpha, beta = np.empty_like(psi), np.ones_like(psi)
        a = np.full((len(psi), size), 1.0 / size)
        for t in range(length):
            a = (a @ jump) * psi[:, t]
            a /= a.sum(axis=1, keepdims=True)
            alpha[:, t] = a
        for t in range(length - 2, -1, -1):
            b = (psi[:, t + 1] * beta[:, t + 1]) @ jump.T
            beta[:, t] = b / b.max(axis=1, keepdims=True)
        gamma = alpha * beta
        gamma /= gamma.sum(axis=2, keepdims=True)
        joint = alpha[:, :-1, :, None] * jump * (psi[:, 1:] * beta[:, 1:])[:, :, None, :]
        joint /= joint.sum(axis=(2, 3), keepdims=True)
        error = (truth - gamma).reshape(-1, size)
        on_word = np.stack([np.bincount(which, error[:, j], len(distinct)) for j in range(size)], axis=1)
        on_slot = np.repeat(on_word, per_word, axis=0)
        up = [
            np.stack([np.bincount(slots, on_slot[:, j], SLOTS) for j in range(size)], axis=1),
            inside.T @ on_word,
            pairs_seen - joint.sum(axis=(0, 1)),
        ]
        for k, (x, g) in enumerate(zip(params, up)):
            g = g / len(psi) - settings.decay * x
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += settings.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(languages, params[0].astype(np.float32), lexicon, params[1], params[2])


def label_texts(texts: list[str | None], model: Model | None, words_at_once: int = 200_000) -> pd.DataFrame:
    """Language, score, words and label changes of each text. Whole texts, some at a time."""
    out = [("und", 0.0, 0, 0)] * len(texts)
    if model is None:
        return pd.DataFrame(out, columns=["lang_pred", "score", "n_letter_words", "n_switches"])

    def run(ids: list[int], words: list[str], lengths: list[int]) -> None:
        codes, distinct = pd.factorize(np.array(words, dtype=object))
        gamma = marginals(emissions(list(distinct), model)[codes], np.array(lengths), model.transitions)
        starts = np.cumsum([0, *lengths[:-1]])
        mean = np.add.reduceat(gamma, starts, axis=0) / np.array(lengths)[:, None]
        label = gamma.argmax(axis=1)
        changed = np.append(label[1:] != label[:-1], False)
        changed[np.cumsum(lengths) - 1] = False
        switches = np.add.reduceat(changed.astype(np.int64), starts)
        for i, m, n, s in zip(ids, mean, lengths, switches):
            out[i] = (model.languages[int(m.argmax())], float(min(1.0, m.max())), n, int(s))

    ids, words, lengths = [], [], []
    for i, text in enumerate(texts):
        found = LETTERS.findall(text.lower()) if text else []
        if not found:
            continue
        if words and len(words) + len(found) > words_at_once:
            run(ids, words, lengths)
            ids, words, lengths = [], [], []
        ids.append(i)
        words += found
        lengths.append(len(found))
    if ids:
        run(ids, words, lengths)
    return pd.DataFrame(out, columns=["lang_pred", "score", "n_letter_words", "n_switches"])


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, settings: Settings = Settings()) -> Model | None:
    """Fit on a bounded sample of the labelled documents that are not held out.

    Languages are counted over all of them; then each language gets the share of its rows
    that makes ``docs_per_language`` in expectation, chosen by a hash of the id. Of each
    sampled text one window at a hashed offset comes to the driver: about
    languages x docs_per_language x window_chars characters, whatever the corpus holds.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.select("doc_id", "lang", "text")
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.lit(0.0)
    for lang, count in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, settings.docs_per_language / count))).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(settings.seed)), F.lit(1 << 20)) / float(1 << 20)
    length = F.length("text")
    offset = F.pmod(F.xxhash64("doc_id", F.lit(settings.seed + 1)), F.greatest(F.lit(1), length - settings.window_chars + 1))
    window = F.substring("text", (offset + 1).cast("int"), F.lit(settings.window_chars))
    sample = usable.where(draw < share).select("lang", window.alias("text")).collect()
    return fit([(r["lang"], r["text"]) for r in sample], settings)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, n_letter_words, n_switches, held_out of every document.

    The label is the language with the largest mean word probability, the score that mean;
    ties go to the first language by name. ``und`` with score 0 where the text is null or
    holds no letter, or where nothing could be learned. Only ``text`` is an input of the
    prediction; repeated rows are labelled row by row; other columns are not looked at.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = label_texts(batch["text"].tolist(), model)
            yield pd.concat([batch[["doc_id", "held_out"]].reset_index(drop=True), found], axis=1)

    picked = docs.select(F.col("doc_id").cast("string").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    schema = "doc_id string, held_out boolean, lang_pred string, score double, n_letter_words long, n_switches long"
    return picked.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def in_a_language(docs: DataFrame, model: Model | None, least: float = 0.4) -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language with a score of ``least`` or more.

    All columns pass unchanged and no row is shuffled; null texts and texts without a letter go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = label_texts(batch.column("text").to_pylist(), model)
            yield batch.filter(pa.array(((found["lang_pred"] != "und") & (found["score"] >= least)).to_numpy(bool)))

    return docs.mapInArrow(run, docs.schema)


shipped(__name__)


@register("op3_language_crf")
def op3_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, learn(docs)).select("doc_id", "held_out", "lang_pred", "score", "n_letter_words", "n_switches")

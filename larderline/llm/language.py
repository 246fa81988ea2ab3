"""Language identification of mixed text: scripts, word scores and Viterbi.

The script of a word leaves the languages that were seen in that script; byte n-grams score
the word for each of them; Viterbi with a penalty for changing the language labels spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larderline.llm import words as W

BUCKETS = 1 << 16
FLUSH_WORDS = 1_500_000
UNKNOWN = "und"

# Code point ranges of letters by script (fixed values): first, last, script.
SCRIPTS = [
    (0x41, 0x5A, "latin"), (0x61, 0x7A, "latin"), (0xAA, 0xAA, "latin"), (0xBA, 0xBA, "latin"),
    (0xC0, 0xD6, "latin"), (0xD8, 0xF6, "latin"), (0xF8, 0x2AF, "latin"),
    (0x370, 0x373, "greek"), (0x376, 0x377, "greek"), (0x37B, 0x37D, "greek"),
    (0x386, 0x386, "greek"), (0x388, 0x3FF, "greek"), (0x400, 0x481, "cyrillic"),
    (0x48A, 0x52F, "cyrillic"), (0x531, 0x556, "armenian"), (0x561, 0x587, "armenian"),
    (0x5D0, 0x5EA, "hebrew"), (0x620, 0x64A, "arabic"), (0x671, 0x6D3, "arabic"),
    (0x750, 0x77F, "arabic"), (0x904, 0x939, "devanagari"), (0x985, 0x9B9, "bengali"),
    (0xA05, 0xA39, "gurmukhi"), (0xA85, 0xAB9, "gujarati"), (0xB85, 0xBB9, "tamil"),
    (0xC05, 0xC39, "telugu"), (0xC85, 0xCB9, "kannada"), (0xD05, 0xD39, "malayalam"),
    (0xE01, 0xE30, "thai"), (0x10A0, 0x10FF, "georgian"), (0x1100, 0x11FF, "hangul"),
    (0x1E00, 0x1EFF, "latin"), (0x1F00, 0x1FFC, "greek"), (0x3041, 0x3096, "hiragana"),
    (0x30A1, 0x30FA, "katakana"), (0x3400, 0x4DBF, "han"), (0x4E00, 0x9FFF, "han"),
    (0xAC00, 0xD7A3, "hangul"), (0x20000, 0x2FA1F, "han"),
]
SCRIPT_NAMES = sorted({name for _, _, name in SCRIPTS})
# Letters outside the table: each 128 code points are a script of their own.
BLOCK_BITS = 7
ALL_SCRIPTS = len(SCRIPT_NAMES) + (0x110000 >> BLOCK_BITS)
_first = np.array([a for a, _, _ in SCRIPTS])
_last = np.array([b for _, b, _ in SCRIPTS])
_script = np.array([SCRIPT_NAMES.index(s) for _, _, s in SCRIPTS], dtype=np.int16)


@lru_cache
def _is_letter() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions of letters, and their scripts."""
    at = np.flatnonzero((data < 128) | (data >= 0xC0))
    lead = data[at].astype(np.int64)
    padded = np.concatenate([data, np.zeros(3, dtype=np.uint8)]).astype(np.int64)
    code = lead.copy()
    two, three, four = lead >= 0xC0, lead >= 0xE0, lead >= 0xF0
    code[two] = (lead[two] & 0x1F) << 6 | padded[at[two] + 1] & 0x3F
    code[three] = (
        (lead[three] & 0x0F) << 12
        | (padded[at[three] + 1] & 0x3F) << 6
        | padded[at[three] + 2] & 0x3F
    )
    code[four] = (
        (lead[four] & 0x07) << 18
        | (padded[at[four] + 1] & 0x3F) << 12
        | (padded[at[four] + 2] & 0x3F) << 6
        | padded[at[four] + 3] & 0x3F
    )
    ascii_ = code < 128
    script = np.full(len(at), -1, dtype=np.int16)
    script[ascii_ & np.isin(code, np.r_[65:91, 97:123])] = SCRIPT_NAMES.index("latin")
    rest = np.flatnonzero(~ascii_)
    part = np.searchsorted(_first, code[rest], "right") - 1
    inside = code[rest] <= _last[part]
    script[rest[inside]] = _script[part[inside]]
    other = rest[~inside]
    other = other[_is_letter()[np.minimum(code[other], 0x10FFFF)]] if len(other) else other
    script[other] = len(SCRIPT_NAMES) + (code[other] >> BLOCK_BITS)
    keep = script >= 0
    return at[keep], script[keep]


def word_scripts(words: W.Words) -> np.ndarray:
    """Script of the first letter of each word, -1 for words without a letter."""
    at, script = letters(words.data)
    if not len(at):
        return np.full(len(words.start), -1, dtype=np.int16)
    k = np.minimum(np.searchsorted(at, words.start), len(at) - 1)
    inside = (at[k] >= words.start) & (at[k] < words.end)
    return np.where(inside, script[k], np.int16(-1))


def grams(words: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the 3-grams and 4-grams around every byte of every word.

    What stands outside the word is a blank, so a word's grams depend on the word alone.
    Returns an array with two buckets for each byte, and the first byte of each word in it.
    """
    n = words.end - words.start
    first = np.concatenate([[0], np.cumsum(n)])
    # Words laid out one after the other, a blank before and two behind each.
    lead = np.arange(len(n)) * 3 + 1
    at = np.arange(first[-1])
    owner = np.repeat(np.arange(len(n)), n)
    text = np.full(first[-1] + 3 * len(n), 32, dtype=np.uint32)
    spot = at + lead[owner]
    text[spot] = W.LOWER[words.data[at + (words.start - first[:-1])[owner]]]
    three = text[spot - 1] << np.uint32(16) | text[spot] << np.uint32(8) | text[spot + 1]
    four = three * np.uint32(0x9E3779B1) + text[spot + 2] * np.uint32(0x85EBCA6B)
    out = np.stack([three * np.uint32(0xC2B2AE35), four * np.uint32(0x27D4EB2F)], axis=1)
    return (out >> np.uint32(16)).astype(np.int64), first


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    logs: np.ndarray  # gram bucket x language
    allowed: np.ndarray  # script x language


def fraction_of(share, *columns):
    """True for about that share of the rows, the same ones in every run."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(11), *columns), 11).cast("double")
    return bits < share * F.lit(float(2**53))


def train_languages(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    rows_per_language: int = 1500,
    longest_chars: int = 100_000,
    least_share: float = 0.001,
) -> LanguageModel:
    """Count grams and scripts by language over a bounded sample of the labelled rows.

    About ``rows_per_language`` rows of each language are used, chosen by a hash of the text
    among texts of at most ``longest_chars`` characters. Rows without text or language teach
    nothing. A script belongs to a language if ``least_share`` of its words are in it. Only
    sums come to the driver: one row for each language and gram bucket or script.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where(
        F.col("text").isNotNull() & F.col("lang").isNotNull()
        & (F.length("text") <= longest_chars)
    )
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        empty = np.zeros((BUCKETS, 0), dtype=np.float32)
        return LanguageModel([], empty, np.zeros((ALL_SCRIPTS, 0), dtype=bool))
    number = F.create_map(*[F.lit(x) for i, k in enumerate(languages) for x in (k, i)])
    share = F.create_map(
        *[F.lit(x) for k in languages for x in (k, min(1.0, rows_per_language / counts[k]))]
    )
    sample = rows.where(fraction_of(share[F.col("lang")], F.col("text"))).select(
        "text", number[F.col("lang")].alias("lang")
    )
    wide = len(languages)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((BUCKETS + ALL_SCRIPTS) * wide, dtype=np.int64)
        for batch in W.pieces(batches, "text"):
            words = W.words_of(batch.column("text"))
            label = np.repeat(batch.column("lang").to_numpy(), words.counts)
            buckets, first = grams(words)
            per_byte = np.repeat(label, np.diff(first))
            keys = (buckets * wide + per_byte[:, None]).ravel()
            script = word_scripts(words)
            known = script >= 0
            more = (BUCKETS + script[known].astype(np.int64)) * wide + label[known]
            found += np.bincount(np.concatenate([keys, more]), minlength=len(found))
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], ["cell", "n"])

    sums = sample.mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(
        F.sum("n").alias("n")
    )
    cells = sums.toArrow()
    table = np.zeros((BUCKETS + ALL_SCRIPTS) * wide)
    table[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    table = table.reshape(-1, wide)
    seen, scripts = table[:BUCKETS], table[BUCKETS:]
    logs = np.log((seen + 0.5) / (seen.sum(axis=0) + 0.5 * BUCKETS))
    allowed = scripts >= least_share * np.maximum(scripts.sum(axis=0), 1)
    return LanguageModel(languages, logs.astype(np.float32), allowed & (scripts > 0))


def word_scores(model: LanguageModel, words: W.Words, floor: float) -> np.ndarray:
    """Log probability of each language for each word, not below ``floor``; zeros for words
    without a letter of a script that any language uses."""
    buckets, first = grams(words)
    out = np.zeros((len(words.start), len(model.languages)), dtype=np.float32)
    if not out.size:
        return out
    part = model.logs[buckets[:, 0]] + model.logs[buckets[:, 1]]
    out = np.add.reduceat(part, first[:-1], axis=0)
    script = word_scripts(words)
    open_ = model.allowed[np.maximum(script, 0)]
    out = np.where(open_, out, np.float32(-1e30))
    out -= out.max(axis=1, keepdims=True)
    out -= np.log(np.exp(out).sum(axis=1, keepdims=True))
    out = np.maximum(out, np.float32(floor))
    out[(script < 0) | ~open_.any(axis=1)] = 0
    return out


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best labels of each sequence of words; all sequences advance together."""
    n, langs = scores.shape
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    begin, left = first[order], counts[order]
    labels = np.zeros(n, dtype=np.int16)
    if not len(order):
        return labels
    back = np.zeros((n, langs), dtype=np.int16)
    own = np.arange(langs, dtype=np.int16)
    value = scores[begin].copy()
    ends = np.zeros(len(order), dtype=np.int16)
    live = len(order)
    for t in range(1, int(left[0]) + 1):
        still = int(np.searchsorted(-left, -t, "left"))  # sequences with more than t words
        if still < live:
            ends[still:live] = value[still:live].argmax(axis=1)
            live = still
        if not live:
            break
        value = value[:live]
        best = value.argmax(axis=1)
        jump = value[np.arange(live), best][:, None] - np.float32(penalty)
        stay = value >= jump
        at = begin[:live] + t
        back[at] = np.where(stay, own, best[:, None].astype(np.int16))
        value = np.where(stay, value, jump) + scores[at]
    labels[begin + left - 1] = ends
    now = ends.copy()
    longest = int(left[0])
    for t in range(longest - 1, 0, -1):
        live = int(np.searchsorted(-left, -t, "left"))
        at = begin[:live] + t
        now[:live] = back[at, now[:live]]
        labels[at - 1] = now[:live]
    return labels


def _labelled(model: LanguageModel, held, penalty: float, floor: float):
    """lang_pred, score and spans of the texts in some pieces."""
    counts = np.concatenate([c for _, c, _, _, _ in held])
    first = np.concatenate([[0], np.cumsum(counts)])
    scores = np.concatenate([s for _, _, s, _, _ in held])
    lettered = np.concatenate([h >= 0 for _, _, _, h, _ in held])
    learned = np.append(model.allowed.any(axis=1), False)
    has = np.concatenate([learned[h] for _, _, _, h, _ in held])
    bare = np.concatenate([x for _, _, _, _, x in held])
    docs, langs = len(counts), len(model.languages)
    labels = viterbi(scores, first, penalty).astype(np.int64) if langs else np.zeros(len(has), int)
    owner = np.repeat(np.arange(docs), counts)
    votes = np.bincount(
        owner[has] * max(langs, 1) + labels[has], minlength=docs * max(langs, 1)
    ).reshape(docs, -1)
    best = votes.argmax(axis=1)
    total = votes.sum(axis=1)
    share = np.where(total > 0, votes.max(axis=1) / np.maximum(total, 1), 0.0)
    known = (total > 0) & (langs > 0)
    # Words in scripts that no language was seen in do not vote, but count in the share.
    share *= total / np.maximum(np.bincount(owner[lettered], minlength=docs), 1)
    # Letters of scripts that were not learned: a text, but none of the learned languages stands out.
    names = np.array([*model.languages, UNKNOWN], dtype=object)
    guess = np.where(known, best, np.where(bare & (langs > 0), 0, langs))
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (labels[1:] != labels[:-1])
    starts = np.flatnonzero(new)
    ends = np.concatenate([starts[1:], [len(owner)]]) if len(starts) else starts
    spans = pa.StructArray.from_arrays(
        [
            pa.array(names[labels[starts]] if langs else [UNKNOWN] * len(starts), pa.string()),
            pa.array(starts - first[owner[starts]]),
            pa.array(ends - starts),
        ],
        names=["lang", "start", "words"],
    )
    offsets = np.searchsorted(owner[starts], np.arange(docs + 1)).astype(np.int32)
    return (
        pa.array(names[guess], pa.string()),
        pa.array(np.where(known, share, 0.0)),
        pa.ListArray.from_arrays(pa.array(offsets), spans),
    )


def label_languages(
    docs: DataFrame,
    model: LanguageModel,
    text: str = "text",
    penalty: float = 6.0,
    floor: float = -8.0,
) -> DataFrame:
    """Adds ``lang_pred``, ``score`` and ``spans`` (language, first word, words) to every row.

    The prediction is the language of most words; ``score`` is their share among the words
    with a letter. Words without letters take the language around them and do not vote. Texts
    without any letter, missing and empty ones are ``und`` with score 0 and no or unvoted
    spans. A text whose letters are all of scripts that were not learned gets the first language
    with score 0. Ties go to the first language in text order. Without learned languages
    everything is ``und``. Columns of ``docs`` with an added name are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score", "spans")
    span = T.StructType(
        [
            T.StructField("lang", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("words", T.LongType()),
        ]
    )
    schema = T.StructType(
        [
            *docs.schema.fields,
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("spans", T.ArrayType(span)),
        ]
    )
    names = schema.names

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value

        def done(held) -> Iterator[pa.RecordBatch]:
            found = _labelled(known, held, penalty, floor)
            at = 0
            for batch, *_ in held:
                added = [c.slice(at, batch.num_rows) for c in found]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=names)
                at += batch.num_rows

        held, size = [], 0
        for batch in W.pieces(batches, text):
            words = W.words_of(batch.column(text))
            has = word_scripts(words)
            learned = known.allowed.any(axis=1)
            votes = (has >= 0) & learned[np.maximum(has, 0)]
            voting = np.bincount(words.row()[votes], minlength=len(words)) > 0
            bare = np.zeros(len(words), dtype=bool)
            for i in np.flatnonzero(~voting):
                value = batch.column(text)[int(i)].as_py()
                bare[i] = value is not None and any(c.isalpha() for c in value)
            held.append((batch, words.counts, word_scores(known, words, floor), has, bare))
            size += len(words.start)
            if size >= FLUSH_WORDS:
                yield from done(held)
                held, size = [], 0
        if held:
            yield from done(held)

    return docs.mapInArrow(label, schema)

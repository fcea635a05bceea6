"""Language identification by rank-order n-gram profiles.

A profile is a language's PROFILE most frequent character n-grams (1 to 3 letters of lower-cased
words, with a mark at word ends) in rank order. A text's own ranking is compared with each profile
by out-of-place distance: the sum over the text's most frequent n-grams of how far their ranks lie
apart, PROFILE for an n-gram that the profile lacks. The nearest profile wins, the first by name
among equals; score is 1 - distance / the largest distance possible.

Profiles are learned from a bounded sample: for each language the TRAIN_DOCS training documents
whose hashed id is least. Predictions read whole texts and nothing but the text.

keep_identified rejects by the score. Over held-out documents (sf0.01) the lowest is 0.52, over all of
them 0.46, and 0.46 over their passages of 5 words or more (0.43 in sf0.001); random letters score 0.3
or less from 8 words on (99 of 100) and 0.23 from 40 words, base64 0.22, sentences of five unlearned
languages 0.18 to 0.28: MIN_SCORE lies between. A text of one or two words may score 0.3 in its own
language as random letters do, so texts of fewer than MIN_GRAMS distinct n-grams (some six words) need
only SHORT_SCORE. An unlearned language close to a learned one may pass.

Defined cases: null text or text without a letter: 'und', score 0; rows with null lang are not
learned from; a null id counts as an empty one for the split; without training rows every text is
'und'; repeated rows are predicted each on their own; empty table, empty result; further columns
are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, keyed, rows_of, ship

UNKNOWN = "und"
PROFILE = 300
TRAIN_DOCS = 1000
#: More languages than this are an error: profiles are held on the driver and sent to every task.
MOST_LANGS = 500
DEALT = 16
FOLDS = 5
MIN_SCORE = 0.3
MIN_GRAMS = 60
SHORT_SCORE = 0.05
MARK = 0x20
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter; made once a process."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(text: str) -> np.ndarray:
    """All n-grams of a text, n from 1 to 3, as integers of 21 bits a character; a gram is within a
    word, with MARK for the word's ends."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    is_letter = letters()[c]
    if not is_letter.any():
        return np.empty(0, np.int64)
    c = np.concatenate([[MARK], np.where(is_letter, c, MARK), [MARK]])
    mark = c == MARK
    c = c[~(mark & np.concatenate([[False], mark[:-1]]))]  # one mark between words
    mark = c == MARK
    one = c[~mark]
    two = (c[:-1] << 21) | c[1:]
    three = (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
    return np.concatenate([one, two, three[~mark[1:-1]]])


def ranking(text: str, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first; equal counts by the n-gram's integer."""
    values, counts = np.unique(grams(text), return_counts=True)
    return values[np.argsort(-counts, kind="stable")[:most]]


class Profiles:
    """Ranked n-grams of each language, laid out for lookups."""

    def __init__(self, ranked: dict[str, list[int]], size: int = PROFILE) -> None:
        self.size = size
        self.langs = sorted(ranked)
        self.known = np.unique(np.array([g for x in ranked.values() for g in x], np.int64))
        self.ranks = np.full((len(self.langs), len(self.known) + 1), -1, np.int64)
        for row, lang in zip(self.ranks, self.langs, strict=True):
            row[np.searchsorted(self.known, np.array(ranked[lang], np.int64))] = np.arange(len(ranked[lang]))

    def distances(self, own: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, own)
        at[self.known[np.minimum(at, len(self.known) - 1)] != own] = len(self.known)
        ranks = self.ranks[:, at]
        apart = np.abs(ranks - np.arange(len(own)))
        return np.where(ranks < 0, self.size, np.minimum(apart, self.size)).sum(axis=1)

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.nearest(self.own(text))

    def accepted(self, text: str | None, min_score: float = MIN_SCORE) -> str | None:
        """The language of a text that scores enough, else None."""
        own = self.own(text)
        lang, score = self.nearest(own)
        enough = min_score if len(own) >= MIN_GRAMS else min(min_score, SHORT_SCORE)
        return lang if lang != UNKNOWN and score >= enough else None

    def own(self, text: str | None) -> np.ndarray:
        return ranking(text, self.size) if text and self.langs else np.empty(0, np.int64)

    def nearest(self, own: np.ndarray) -> tuple[str, float]:
        if not len(own):
            return UNKNOWN, 0.0
        far = self.distances(own)
        best = int(far.argmin())
        return self.langs[best], float(1 - far[best] / (self.size * len(own)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


def first_of_each(rows: DataFrame, key: str, order: list, spread: Column, most: int) -> DataFrame:
    """The first `most` rows of each key: first within DEALT parts of a key, then among what is left of it, so
    that no task gets a frequent key's rows together."""
    part = F.pmod(spread, F.lit(DEALT))
    for own in ([F.col(key), part], [F.col(key)]):
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*own).orderBy(*order))).where(F.col("place") <= most)
    return rows.drop("place")


def learn_profiles(
    docs: DataFrame, size: int = PROFILE, train_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang",
) -> Profiles:
    """Profiles from the training folds. Sample ids are ranked without their texts and broadcast, at most
    train_docs a language; n-gram counts are summed in the tasks first, and `size` n-grams a language
    reach the driver. Languages are counted before, and at most MOST_LANGS."""
    src = keyed(docs, doc_id=id_col, text=text_col, lang=lang_col)
    ids = src.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    if ids.select("lang").distinct().limit(MOST_LANGS + 1).count() > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    sample = first_of_each(ids, "lang", ["h", "doc_id"], F.xxhash64("doc_id", F.lit(1)), train_docs)
    chosen = F.broadcast(sample.select(F.col("doc_id").alias("i"), F.col("lang").alias("l")).distinct())
    train = src.join(chosen, (F.col("doc_id") == F.col("i")) & (F.col("lang") == F.col("l")), "left_semi")
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for langs, texts in rows_of(batch):
                sums: dict[str, Counter] = {}
                for lang, text in zip(langs, texts, strict=True):
                    values, counts = np.unique(grams(text or ""), return_counts=True)
                    sums.setdefault(lang, Counter()).update(dict(zip(values.tolist(), counts.tolist(), strict=True)))
                rows = [(lang, g, n) for lang, c in sums.items() for g, n in c.items()]
                cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())],
                    ["lang", "gram", "n"],
                )

    sums = (
        train.select("lang", "text")
        .mapInArrow(count, "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    ranked: dict[str, list[int]] = {}
    best = first_of_each(sums, "lang", [F.desc("n"), "gram"], F.xxhash64("gram"), size)
    for r in best.orderBy("lang", F.desc("n"), "gram").collect():
        ranked.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(ranked, size)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per input row, without a shuffle."""
    from pyspark.sql.pandas.types import to_arrow_type

    src = keyed(docs, doc_id=id_col, text=text_col)
    src = src.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = src.schema["doc_id"].dataType

    def run(ids: list, held: list, texts: list):
        for i, h, t in zip(ids, held, texts, strict=True):
            yield (i, h, *profiles.predict(t))

    schema = pa.schema(
        [("doc_id", to_arrow_type(kind)), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())]
    )
    return arrow_rows(src, run, schema, f"doc_id {kind.simpleString()}, held_out boolean, lang_pred string, score double")


def keep_identified(
    docs: DataFrame, profiles: Profiles, min_score: float = MIN_SCORE, text_col: str = "text",
    langs: tuple[str, ...] | None = None, label_col: str | None = None,
) -> DataFrame:
    """Input rows whose text has a language (one of langs, if given) with at least min_score (SHORT_SCORE
    for very short texts). Columns stay as they are, but that label_col, if given, becomes the
    language found."""
    schema = docs.schema
    at = schema.names.index(text_col)
    label = None if label_col is None else schema.names.index(label_col)
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[str | None] = []
            for start in range(0, batch.num_rows, 512):
                for text in batch.column(at).slice(start, 512).to_pylist():
                    lang = profiles.accepted(text, min_score)
                    found.append(lang if langs is None or lang in langs else None)
            if label is not None:
                batch = batch.set_column(label, batch.schema.field(label), pa.array(found, batch.schema.field(label).type))
            yield batch.filter(pa.array([x is not None for x in found], pa.bool_()))

    return docs.mapInArrow(run, schema)

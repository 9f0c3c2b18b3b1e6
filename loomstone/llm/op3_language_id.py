"""Language identification by hierarchical discrimination.

A text is the square roots of the shares of its hashed byte bigrams and trigrams (ASCII letters in lower case, other ASCII
as space). A linear support vector machine per language family, one against the rest, names the family; within it,
linear support vector machines one-versus-one between its languages vote. Squared hinge loss, solved here by
accelerated gradients.

Learning takes at most ``per_language`` different labelled rows of each language (chosen by a digest of id and text), of
the ``most_languages`` most frequent languages, and at most ``most_rows`` in all; only their hashed features, of bounded size,
come to the driver. Scoring is a narrow map over whole texts, read in pieces, so memory does not grow with a text.

Defined results: a null text, or one without a letter, is ``und`` with score 0; with no labelled row every text is
``und``; with a single language every text is that one; rows are predicted one by one, so repeated rows agree; in
learning, rows equal in id and text count once and others with an equal or no id are apart; other columns are not looked at
and may have any name; an empty table gives an empty result. Language codes without a known family are a family of their own.

A score says which of the learned languages a text is, not whether it is one of them. ``Model.likeness`` says that:
the mean log ratio of the text's n-grams in its language to n-grams dealt evenly over all features, as a share of the
median that the language's training texts have (each against the others). It is about 1 for texts of the language, about
0 or below for other scripts and random letters. Only letters count. A text without an n-gram and a language whose
training texts are not alike (as where there is one only) give nothing to compare: then it is 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstone.llm import textvec as V
from loomstone.llm.common import crc_mod, lean, release, table

DIM = 4096
PER_LANGUAGE = 600
MOST_ROWS = 4000
MOST_LANGUAGES = 400
SLOPE = 4.0
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, family string"
#: Families of common languages by ISO 639-1 code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi fo",
    "romance": "fr es pt it ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "indo-aryan": "hi ur bn pa gu mr ne si or as",
    "iranian": "fa ps ku tg",
    "semitic": "ar he mt am",
    "dravidian": "ta te kn ml",
    "austronesian": "id ms tl jv su mg mi",
    "sinitic": "zh",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_HIGH = np.arange(256) >= 128
_CLEAN = np.arange(256, dtype=np.uint8)
_CLEAN[:128][~_LETTER[:128]] = 32
_CLEAN[65:91] += 32


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.split("-")[0].lower(), f"only {lang}")


def features(b: V.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: document, feature and value of every feature that is not 0. The squares of a document's values sum to 1."""
    n = len(b.data)
    if b.docs * DIM > 4 << 20 and b.docs > 1:  # many short texts
        half = b.docs // 2
        parts = [V.Block(b.first + i, b.data[b.at[i] : b.at[j]], b.at[i : j + 1] - b.at[i]) for i, j in ((0, half), (half, b.docs))]
        (d0, k0, v0), (d1, k1, v1) = map(features, parts)
        return np.concatenate((d0, d1 + half)), np.concatenate((k0, k1)), np.concatenate((v0, v1))
    count = np.zeros(b.docs * DIM, np.uint32)
    for s in range(0, n, V.PIECE):
        e = min(n, s + V.PIECE)
        x = _CLEAN[b.data[s : e + 2]].astype(np.uint32)  # an n-gram begins in the piece and may end behind it
        d0, d1 = int(np.searchsorted(b.at, s, "right")) - 1, int(np.searchsorted(b.at, min(n, e + 2), "left"))
        of = np.repeat(np.arange(d0, d1, dtype=np.int32), np.diff(np.clip(b.at[d0 : d1 + 1], s, min(n, e + 2))))
        for k in (2, 3):
            m = min(e - s, len(x) - k + 1)
            if m <= 0:
                continue
            h = x[:m] ^ np.uint32(0x9E3779B1 * k & 0xFFFFFFFF)
            for j in range(1, k):
                h = h * np.uint32(0x01000193) ^ x[j : m + j]
            h = h * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
            solid = (of[:m] == of[k - 1 : m + k - 1]) & ~((x[:m] == 32) & (x[1 : m + 1] == 32))
            key = of[:m][solid] * np.int32(DIM) + (h[solid] & np.uint32(DIM - 1)).astype(np.int32)
            count += np.bincount(key, minlength=len(count)).astype(np.uint32)
    key = np.flatnonzero(count)
    count = count[key]
    doc = key // DIM
    total = np.bincount(doc, count, b.docs)
    return doc, key % DIM, np.sqrt(count / total[doc])


def has_letter(b: V.Block) -> np.ndarray:
    found = V.byte_counts(b, _LETTER) > 0
    for i in np.flatnonzero(~found & (V.byte_counts(b, _HIGH) > 0)):
        raw = b.data[b.at[i] : b.at[i + 1]].tobytes()
        found[i] = any(c.isalpha() for c in raw.decode("utf-8", "replace"))
    return found


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss (mean over rows, classes weighing alike); weights and bias."""
    y = y.astype(np.float32)
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    centre = share @ x
    z = np.ones((len(x), x.shape[1] + 1), np.float32)
    np.subtract(x, centre, out=z[:, :-1])
    v = np.ones(z.shape[1], np.float32)
    for _ in range(12):
        v = z.T @ (share * (z @ v))
        top = np.linalg.norm(v)
        v /= max(top, 1e-30)
    rate = np.float32(1 / (1.05 * 2 * c * top + 1))
    ridge = np.append(np.ones(x.shape[1], np.float32), np.float32(0))
    w = u = np.zeros(z.shape[1], np.float32)
    t = 1.0
    for _ in range(steps):
        gap = np.maximum(0, 1 - y * (z @ u))
        new = u - rate * (ridge * u - np.float32(2 * c) * (z.T @ (share * y * gap)))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, w, t = new + np.float32((t - 1) / t2) * (new - w), new, t2
    return w[:-1].astype(float), float(w[-1] - w[:-1] @ centre)


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    families: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((DIM, 0)))  # families first, then pairs
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    pairs: list[tuple[int, int]] = field(default_factory=list)
    ratio: np.ndarray = field(default_factory=lambda: np.zeros((DIM, 0)))  # by language: log of a feature's share over an even one
    typical: np.ndarray = field(default_factory=lambda: np.zeros(0))  # by language: median over training texts of their mean ratio

    @classmethod
    def fit(cls, rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
        """rows: language, features, values."""
        langs = sorted({r[0] for r in rows})
        families = sorted({family_of(x) for x in langs})
        x = np.zeros((len(rows), DIM), np.float32)
        for i, (_, index, value) in enumerate(rows):
            x[i, index] = value
        lang = np.array([langs.index(r[0]) for r in rows])
        family = np.array([families.index(family_of(langs[k])) for k in range(len(langs))] or [0])
        out = []
        if len(families) > 1:
            out += [svm(x, np.where(family[lang] == f, 1.0, -1.0)) for f in range(len(families))]
        pairs = [(a, b) for a, b in combinations(range(len(langs)), 2) if family[a] == family[b]]
        for a, b in pairs:
            own = (lang == a) | (lang == b)
            out.append(svm(x[own], np.where(lang[own] == a, 1.0, -1.0)))
        ratio, typical = np.zeros((DIM, len(langs))), np.zeros(len(langs))
        for k in range(len(langs)):
            share = x[lang == k].astype(float) ** 2
            total = share.sum(axis=0) + 1 / DIM  # an even text besides
            ratio[:, k] = np.log(total * DIM / (len(share) + 1))
            typical[k] = np.median([r[r > 0] @ np.log((total - r)[r > 0] * DIM / len(share)) for r in share])
        return cls(langs, families, np.array([w for w, _ in out]).reshape(-1, DIM).T.copy(), np.array([b for _, b in out]), pairs, ratio, typical)

    def likeness(self, b: V.Block, found: tuple[np.ndarray, np.ndarray, np.ndarray], langs: list[str]) -> np.ndarray:
        """How typical each document of a block, with these features, is of the language named for it; see the module."""
        doc, index, value = found
        at = {x: k for k, x in enumerate(self.langs)}
        k = np.array([at.get(x, 0) for x in langs], int)
        mean = np.bincount(doc, value**2 * self.ratio[index, k[doc]], b.docs)
        judged = (np.bincount(doc, minlength=b.docs) > 0) & (self.typical[k] > 0)
        return np.divide(mean, self.typical[k], out=np.ones(b.docs), where=judged)

    def predict(self, b: V.Block, found: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[list[str], np.ndarray, list[str]]:
        """Language, score and family of each document of a block. found: its features, if they are there already."""
        known = has_letter(b)
        if not self.langs:
            return [UNKNOWN] * b.docs, np.zeros(b.docs), [UNKNOWN] * b.docs
        doc, index, value = features(b) if found is None else found
        m = np.empty((b.docs, len(self.bias)))
        for k in range(len(self.bias)):
            m[:, k] = np.bincount(doc, value * self.weights[index, k], b.docs) + self.bias[k]
        p = 1 / (1 + np.exp(-SLOPE * np.clip(m, -50, 50)))
        nf = len(self.families) if len(self.families) > 1 else 0
        best_f = np.argmax(m[:, :nf], axis=1) if nf else np.zeros(b.docs, int)
        p_family = p[np.arange(b.docs), best_f] if nf else np.ones(b.docs)
        family = np.array([self.families.index(family_of(x)) for x in self.langs])
        votes, belief = np.zeros((b.docs, len(self.langs))), np.zeros((b.docs, len(self.langs)))
        for k, (i, j) in enumerate(self.pairs, nf):
            votes[:, i] += m[:, k] >= 0
            votes[:, j] += m[:, k] < 0
            belief[:, i] += p[:, k]
            belief[:, j] += 1 - p[:, k]
        rivals = np.array([max(1, (family == f).sum() - 1) for f in family])
        belief = np.where(np.array([(family == f).sum() == 1 for f in family]), 1.0, belief / rivals)
        inside = family[None, :] == best_f[:, None]
        best = np.argmax(np.where(inside, votes + belief / 2, -1.0), axis=1)
        score = np.where(known, p_family * belief[np.arange(b.docs), best], 0.0)
        return [self.langs[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)], score, [self.families[f] if ok else UNKNOWN for f, ok in zip(best_f, known, strict=True)]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS, most_languages: int = MOST_LANGUAGES) -> Model:
    """Learns from the labelled rows of docs; see the module on the bounds, which hold for every input.

    Per language, rows count once for each different pair of id and text. About twice as many of these as are wanted pass a
    threshold on a digest, those of a task are made one before they are moved, and the smallest digests are taken."""
    d = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.lit(17), id_col, text_col).alias("digest")
    )
    common = d.groupBy("lang").agg(F.approx_count_distinct("digest").alias("different"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(min(most_languages, most_rows)).collect()
    if not common:
        return Model()
    per = min(per_language, most_rows // len(common))
    share = F.create_map(*[F.lit(v) for r in common for v in (r["lang"], min(1.0, (2 * per + 100) / max(r["different"], 1)))])
    passed = F.pmod(F.xxhash64(F.lit(18), "digest"), F.lit(1 << 30)) < share[F.col("lang")] * F.lit(float(1 << 30))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("digest"))
    drawn = d.where(passed).groupBy("lang", "digest").agg(F.first("text").alias("text")).withColumn("rank", rank).where(F.col("rank") <= per).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in V.blocks(batch.column(1)):
                doc, index, value = features(b)
                cut = np.searchsorted(doc, np.arange(1, b.docs))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(b.first, b.docs), pa.array([x.astype("<u2").tobytes() for x in np.split(index, cut)]), pa.array([x.astype("<f4").tobytes() for x in np.split(value, cut)])], ["lang", "index", "value"]
                )

    rows = drawn.mapInArrow(lean(run), "lang string, index binary, value binary").collect()
    return Model.fit([(r[0], np.frombuffer(r[1], "<u2").astype(int), np.frombuffer(r[2], "<f4")) for r in sorted(rows, key=lambda r: (r[0], bytes(r[1]), bytes(r[2])))])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score and family."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in V.blocks(batch.column(2)):
                lang, score, family = model.predict(b)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first, b.docs), batch.column(1).slice(b.first, b.docs), pa.array(lang, pa.string()), pa.array(score), pa.array(family, pa.string())], ["doc_id", "held_out", "lang_pred", "score", "family"])

    held_out = crc_mod(id_col, 4) == 2
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), SCHEMA)


def keep_believed(docs: DataFrame, model: Model, least_score: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose language is known with at least this score and this likeness (with a model that
    knows none: whose text has a letter). A filter: only texts go to Python, and only a verdict comes back."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("boolean")
    def believed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            keep = [np.zeros(0, bool)]
            for b in V.blocks(part):
                if model.langs:
                    found = features(b)
                    lang, score, _ = model.predict(b, found)
                    keep.append((np.array(lang) != UNKNOWN) & (score >= least_score) & (model.likeness(b, found, lang) >= least_score))
                else:
                    keep.append(has_letter(b))
            yield pa.array(np.concatenate(keep))
            del part
            release()

    return docs.where(believed(F.col(text_col).cast("string")))


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the labelled rows that are not held out, and predicts every row."""
    return predict(docs, train(docs.where(crc_mod("doc_id", 4) != 2)))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op3_language_id": op3_language_id}
ORACLE_SQL: dict[str, str] = {}

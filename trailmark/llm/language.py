"""Language identification by hierarchical discrimination.

A text is a vector of hashed letter runs of one to three letters. One-versus-one linear support
vector machines first choose the language family, then the language within it, so that each
machine of the second step is trained on closely related languages only. Every machine is trained in
a task of its own, on a bounded sample; every text is then predicted from all of its letters.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.book import query
from trailmark.llm.common import bound_batches, once, table, unused
from trailmark.session import cut_lineage

#: Languages by family. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "indo-iranian": ("bn", "fa", "gu", "hi", "ku", "mr", "ne", "pa", "ps", "ur"),
    "semitic": ("am", "ar", "he", "mt"),
    "sino-tibetan": ("my", "zh"),
    "austronesian": ("id", "jv", "mg", "ms", "su", "tl"),
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}

#: Labelled texts per language in the sample (expected number at most; distinct texts).
PER_LANGUAGE = 400
FEATURES = 1 << 12
UNKNOWN = "und"
EPOCHS = 15
#: Letters whose runs are counted at one time.
RUN = 1 << 20

_FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
_LETTERS: list[np.ndarray] = []


def _is_letter(points: np.ndarray) -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(i).isalpha() for i in range(0x30000)] + [False]))
    return _LETTERS[0][np.minimum(points, 0x30000)]


def features(text: str) -> np.ndarray | None:
    """Unit vector of square roots of the counts; None if the text has no letter."""
    counts = np.zeros(FEATURES, np.int64)
    found = False
    for at in range(0, len(text), RUN):
        part = text[max(0, at - 2) : at + RUN].lower()
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _is_letter(points)
        if not letter.any():
            continue
        found = True
        # anything between words is one symbol
        symbols = np.where(letter, points, np.uint32(32))
        keep = np.ones(len(symbols), bool)
        keep[1:] = letter[1:] | letter[:-1]
        symbols = np.concatenate(([np.uint32(32)], symbols[keep], [np.uint32(32)]))
        runs = [symbols * _FACTORS[0]]
        runs.append(runs[0][:-1] * np.uint32(31) + symbols[1:] * _FACTORS[1])
        runs.append(runs[1][:-1] * np.uint32(37) + symbols[2:] * _FACTORS[2])
        for r in runs:
            r = (r ^ (r >> np.uint32(15))) * _FACTORS[0]
            counts += np.bincount(r >> np.uint32(20), minlength=FEATURES)
    if not found:
        return None
    x = np.sqrt(counts.astype(np.float32))
    return x / np.linalg.norm(x)


def train_machine(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine, by dual coordinate descent. y is +1 or -1."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1).astype(np.float64)
    w, alpha, square = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(axis=1)
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(x)):
            step = alpha[i] - (y[i] * (x[i] @ w) - 1) / square[i]
            new = min(max(step, 0.0), c)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w[:-1], float(w[-1])


class Model:
    """The machines of both steps, and what they say about a matrix of feature vectors."""

    def __init__(self, languages: list[str], machines: dict[tuple[str, str], tuple[np.ndarray, float]]):
        self.members: dict[str, list[str]] = {}
        for lang in sorted(languages):
            self.members.setdefault(family(lang), []).append(lang)
        self.machines = machines

    def _step(self, x: np.ndarray, names: list[str], kind: str):
        """(index of the winner, its confidence) per row; votes first, then margins, then order."""
        votes = np.zeros((len(x), len(names)))
        trust = np.zeros((len(x), len(names)))
        for a, b in combinations(range(len(names)), 2):
            w, bias = self.machines[f"{kind}{names[a]}", f"{kind}{names[b]}"]
            p = 1 / (1 + np.exp(np.clip(-4 * (x @ w + bias), -60, 60)))
            votes[:, a] += p >= 0.5
            votes[:, b] += p < 0.5
            trust[:, a] += p
            trust[:, b] += 1 - p
        rivals = max(1, len(names) - 1)
        won = np.argmax(votes + trust / (rivals + 1), axis=1)
        return won, (trust[np.arange(len(x)), won] / rivals if len(names) > 1 else np.ones(len(x)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        vectors = {i: v for i, t in enumerate(texts) if t and (v := features(t)) is not None}
        if not vectors or not self.members:
            return langs, scores
        rows, x = list(vectors), np.stack(list(vectors.values()))
        families = list(self.members)
        won, sure = self._step(x, families, "family:")
        for k, name in enumerate(families):
            mine = np.flatnonzero(won == k)
            if len(mine):
                lang, within = self._step(x[mine], self.members[name], "")
                for j, at, s in zip(lang, mine, within, strict=True):
                    langs[rows[at]] = self.members[name][j]
                    scores[rows[at]] = float(min(s, sure[at]))
        return langs, scores


def family(lang: str) -> str:
    return _FAMILY.get(lang, f"({lang})")


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model of the non-null ``lang`` values of ``labelled`` (lang, text).

    The sample takes distinct texts by a hash of the text, at a rate that gives ``per_language``
    of each language. Rows without letters teach nothing. Only the machines come to the driver.
    """
    bound_batches(labelled.sparkSession)
    digest = F.xxhash64("text")
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", digest.alias("digest"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("digest").alias("n")).collect()
    rate = F.create_map(*[F.lit(v) for r in counts for v in (r.lang, min(1.0, per_language / max(1, r.n)))]) if counts else None
    if rate is None:
        return Model([], {})
    drawn = F.pmod(F.xxhash64(F.lit("sample"), "digest"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.filter(drawn < F.element_at(rate, F.col("lang"))).dropDuplicates(["lang", "digest"])

    def vectors(batches):
        for batch in batches:
            out = {"lang": [], "digest": [], "at": [], "value": []}
            for lang, text, key in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (x := features(text)) is not None:
                    at = np.flatnonzero(x)
                    for k, v in zip(out, (lang, key, at.astype(np.int16).tobytes(), x[at].tobytes()), strict=True):
                        out[k].append(v)
            kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema(list(zip(out, kinds, strict=True))))

    learned = cut_lineage(sample.mapInArrow(vectors, "lang string, digest long, at binary, value binary"))
    languages = [r.lang for r in learned.select("lang").distinct().collect()]
    groups: dict[str, set[str]] = {}
    for lang in languages:
        groups.setdefault(family(lang), set()).add(lang)
    contests = [(f"family:{a}", f"family:{b}", groups[a], groups[b]) for a, b in combinations(list(Model(languages, {}).members), 2)]
    contests += [(a, b, {a}, {b}) for langs in groups.values() for a, b in combinations(sorted(langs), 2)]
    if not contests:
        return Model(languages, {})
    roles: dict[str, list] = {lang: [] for lang in languages}
    for k, (_, _, left, right) in enumerate(contests):
        for lang in left | right:
            roles[lang].append((k, 1 if lang in left else -1))
    spark = learned.sparkSession
    dealt = spark.createDataFrame(
        [(lang, k, y) for lang, own in roles.items() for k, y in own], "lang string, contest int, side int"
    )

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["digest", "lang"])
        x = np.zeros((len(group), FEATURES), np.float32)
        for i, (at, value) in enumerate(zip(group["at"], group["value"], strict=True)):
            x[i, np.frombuffer(at, np.int16)] = np.frombuffer(value, np.float32)
        w, b = train_machine(x, group["side"].to_numpy())
        return pd.DataFrame({"contest": [group["contest"].iloc[0]], "weights": [w.astype(np.float32).tobytes()], "bias": [b]})

    fitted = learned.join(dealt, "lang").groupBy("contest").applyInPandas(fit, "contest int, weights binary, bias double")
    machines = {contests[r.contest][:2]: (np.frombuffer(r.weights, np.float32), r.bias) for r in fitted.collect()}
    return Model(languages, machines)


def predictor(model: Model):
    """The model as a function of a text column, giving lang and score."""
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.arrow_udf(kind)
    def predict(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for at in range(0, len(texts), 128):
            found = model.predict(texts.slice(at, 128).to_pylist())
            langs += found[0]
            scores += found[1]
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return once(predict)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and lang_score (0 to 1); columns of these names are replaced.

    A null text, one without letters, and any text under a model without languages is ``und`` with
    score 0. Only the text has an influence, so repeated rows get equal answers.
    """
    bound_batches(docs.sparkSession)
    name = unused("_found", docs)
    found = docs.withColumn(name, predictor(model)(F.col(text)))
    return found.withColumns({"lang_pred": F.col(name)["lang"], "lang_score": F.col(name)["score"]}).drop(name)


def held_out(key: str = "doc_id") -> Column:
    """Whether the row is kept from training. A missing id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 4 == 2


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language is ``und``; a missing lang becomes the predicted one.

    Where no row has a lang there is nothing to learn, and no row is rejected.
    """
    model = train(docs.filter(~held_out()).select("lang", "text"))
    if not model.members:
        return docs
    name = unused("_found", docs)
    found = docs.withColumn(name, predictor(model)(F.col("text"))).filter(F.col(name)["lang"] != UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", F.col(name)["lang"])).select(*docs.columns)


@query("op8_language_id")
def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out()).select("lang", "text"))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))

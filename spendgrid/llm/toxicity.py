"""A counterfactual-regularised toxicity classifier: logistic regression on hashed words, trained on labelled texts and on copies of
them in which identity terms are swapped for others and for neutral words; a text's score and those of its copies are pulled together, so
that neither which group is named nor that one is named counts by itself."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import FOLDED, Rolling, materialize, slices, text_buffer, with_columns_of, words

#: Buckets of the hashed words.
BUCKETS = 1 << 20
#: Identity terms in English, French, German and Spanish, by the neutral word that may stand for each of a language's terms; a term may also stand for each other
#: one of its line.
IDENTITY_TERMS = {
    "people": """
women men
woman man
girls boys
girl boy
mothers fathers
daughters sons
gay straight lesbian bisexual transgender queer
gays lesbians heterosexuals
black white asian latino indigenous arab
blacks whites asians latinos arabs
muslim christian jewish hindu buddhist atheist sikh
muslims christians jews hindus buddhists atheists sikhs
immigrants citizens refugees foreigners migrants natives
immigrant citizen refugee foreigner migrant native
african european american chinese indian mexican
africans europeans americans chinese indians mexicans
old young elderly
deaf blind disabled autistic
rich poor
""",
    "personnes": """
femmes hommes
femme homme
filles garçons
noirs blancs arabes asiatiques
noir blanc arabe asiatique
musulmans chrétiens juifs hindous bouddhistes athées
musulman chrétien juif hindou bouddhiste athée
immigrés citoyens réfugiés étrangers migrants
homosexuels hétérosexuels lesbiennes bisexuels
vieux jeunes handicapés sourds aveugles
""",
    "menschen": """
frauen männer
frau mann
mädchen jungen
schwarze weiße araber asiaten
muslime christen juden hindus buddhisten atheisten
muslim christ jude hindu buddhist atheist
einwanderer bürger flüchtlinge ausländer migranten
homosexuelle heterosexuelle lesben schwule
alte junge behinderte gehörlose blinde
""",
    "personas": """
mujeres hombres
mujer hombre
niñas niños
negros blancos árabes asiáticos
musulmanes cristianos judíos hindúes budistas ateos
musulmán cristiano judío hindú budista ateo
inmigrantes ciudadanos refugiados extranjeros
homosexuales heterosexuales lesbianas bisexuales
viejos jóvenes discapacitados sordos ciegos
""",
}
#: The same as (neutral word, terms...), a tuple for each line.
IDENTITY_GROUPS = tuple((neutral, *line.split()) for neutral, lines in IDENTITY_TERMS.items() for line in lines.strip().splitlines())
_EDGE = np.ones(256, bool)  # bytes that are not part of a word's core
_EDGE[48:58] = _EDGE[65:91] = _EDGE[97:123] = False
_EDGE[128:] = False


def bucket_of(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(Rolling(raw, FOLDED).of(np.array([0]), np.array([len(raw)]))[0] >> np.uint64(44))


def _features(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document index, bucket), distinct and ascending, of the words of whole texts (at most 4096) without punctuation at their ends."""
    buf, off = text_buffer(col)
    solid = buf.copy()
    solid[_EDGE[buf]] = 32
    start, end, doc = words(solid, off)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = Rolling(solid, FOLDED).of(start, end) >> np.uint64(44)
    both = np.unique((doc.astype(np.uint64) << np.uint64(20)) | h)
    return (both >> np.uint64(20)).astype(np.int64), (both & np.uint64(BUCKETS - 1)).astype(np.int64)


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float

    def score(self, col: pa.Array) -> np.ndarray:
        doc, bucket = _features(col)
        z = np.bincount(doc, self.weights[bucket], minlength=len(col)) if len(doc) else np.zeros(len(col))
        return 1 / (1 + np.exp(-np.clip(z + self.bias, -30, 30)))


def swapped(text: str, groups=IDENTITY_GROUPS) -> list[str]:
    """Copies of text with all mentions of one identity term replaced by another of its group or by the group's neutral word (its first), for each term
    that it holds."""
    held = set(re.findall(r"\w+", text.lower()))
    out = []
    for neutral, *terms in groups:
        for a in terms:
            if a in held:
                out += [re.sub(rf"\b{a}\b", b, text, flags=re.I) for b in (*terms, neutral) if b != a]
    return out


def fit(doc: np.ndarray, local: np.ndarray, y: np.ndarray, d: int, of: np.ndarray, copy: np.ndarray, copy_local: np.ndarray, counterfactual: float = 20.0, ridge: float = 1e-4, steps: int = 300) -> tuple[np.ndarray, float]:
    """(weights of d words, bias) that minimise the mean log loss plus ridge * |w|^2 / 2 plus counterfactual * the mean squared
    difference between the scores of a text and of its swapped copies. Class weights are balanced half-way. Accelerated gradient steps.

    (doc, local): words of texts; of: the text of each swapped copy; (copy, copy_local): words of copies."""
    n, m = len(y), len(of)
    positive = max(y.mean(), 1e-6) if n else 0.5
    weight = np.where(y == 1, (0.5 / positive) ** 0.5, 1.0)
    weight /= weight.sum() if n else 1.0
    b = float(np.log(positive / max(1 - positive, 1e-6)))
    size = np.bincount(doc, minlength=n)
    # a bound on the curvature by columns makes steps of its own size for each weight
    lips = 0.25 * np.bincount(local, (weight * np.maximum(size, 1) ** 0.5)[doc], minlength=d) + ridge
    if m:
        rate, grown = 2 * counterfactual / m, np.bincount(copy, minlength=m) ** 0.5
        lips += rate / 4 * np.bincount(copy_local, grown[copy], minlength=d)
        lips += rate / 4 * np.bincount(local, (np.bincount(of, grown, minlength=n))[doc], minlength=d)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    u, v, c, t = np.zeros(d), np.zeros(d), b, 1.0
    for _ in range(steps):
        p = sigmoid(np.bincount(doc, v[local], minlength=n) + c)
        r = weight * (p - y)
        slope = r.copy()
        grad = ridge * v
        if m:
            q = sigmoid(np.bincount(copy, v[copy_local], minlength=m) + c)
            change = rate * (p[of] - q)
            slope += np.bincount(of, change * (p * (1 - p))[of], minlength=n)
            grad -= np.bincount(copy_local, (change * q * (1 - q))[copy], minlength=d)
        grad += np.bincount(local, slope[doc], minlength=d)
        new = v - grad / lips
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        if ((new - u) * (v - new)).sum() > 0:  # momentum points uphill: start it anew
            t_new = 1.0
        v = new + (t - 1) / t_new * (new - u) if t_new > 1 else new.copy()
        u, t = new, t_new
        c -= r.sum() / max(0.25 * weight.sum(), 1e-9)
    return u, c


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", sample: int = 16_000, evidence: float = 15.0, groups=IDENTITY_GROUPS, **options) -> ToxicityModel:
    """A model from at most `sample` labelled rows (the first by a hash of the key; that bound is the driver's share).

    labels: (key, label 0 or 1); null labels and keys that docs lacks teach nothing, repeated rows teach each. Inputs are identity terms and the words (of whole
    texts) whose chi-squared statistic against the labels is at least `evidence`; Spark counts them, and the driver receives of each
    text and of each of its swapped copies (made from the words, as a copy differs in one of them) only these. Without labels scores are 0.5."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("y"), F.xxhash64(F.lit(5), F.col(key)).alias("h"))
    chosen = chosen.orderBy("h", "y").limit(sample).select("_key", "y")
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "_key").select("y", "text")
    rows = materialize(rows, "labelled", compression="zstd")
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n:
        return ToxicityModel(np.zeros(BUCKETS), 0.0)

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                doc, bucket = _features(piece.column(1))
                names, local = np.unique(bucket, return_inverse=True)
                yes = np.bincount(local, piece.column(0).to_numpy()[doc], minlength=len(names)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.bincount(local, minlength=len(names))), pa.array(yes)], names=["bucket", "holds", "toxic"])

    counts = rows.mapInArrow(holders, "bucket long, holds long, toxic long").groupBy("bucket").agg(F.sum("holds").alias("holds"), F.sum("toxic").alias("toxic"))
    # words whose share among toxic and other texts differs beyond chance (chi-squared) are inputs, and identity terms
    expected = F.col("holds") * F.lit(toxic / n)
    spread = F.greatest(expected * F.lit(1 - toxic / n) * (1 - F.col("holds") / F.lit(float(n))), F.lit(1e-9))
    terms = {bucket_of(w) for _, *g in groups for w in g}
    told = counts.where((F.col("holds") >= 3) & (F.pow(F.col("toxic") - expected, F.lit(2)) >= F.lit(float(evidence)) * spread)).select("bucket").toPandas()["bucket"]
    names = np.unique(np.r_[told.to_numpy().astype(np.int64), np.array(sorted(terms), np.int64)])
    shared = docs.sparkSession.sparkContext.broadcast(names)  # at most BUCKETS numbers

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value

        place = {w: int(np.searchsorted(known, bucket_of(w))) for _, *g in groups for w in g}
        others = {}  # of each term's place: the places that its copies hold instead, of a neutral word only if that is an input
        for neutral, *terms_ in groups:
            at = int(np.searchsorted(known, bucket_of(neutral)))
            told = [at] if at < len(known) and known[at] == bucket_of(neutral) else [None]
            for a in terms_:
                others.setdefault(place[a], []).extend([*(place[b] for b in terms_ if b != a), *told])

        for batch in batches:
            for piece in slices(batch):
                doc, bucket = _features(piece.column(1))
                at = np.minimum(np.searchsorted(known, bucket), len(known) - 1)
                fine = known[at] == bucket
                doc, at = doc[fine], at[fine]
                cut = np.searchsorted(doc, np.arange(piece.num_rows + 1))
                own, changed = [], []
                for i in range(piece.num_rows):
                    held = at[cut[i] : cut[i + 1]]
                    own.append(held.astype("<i4").tobytes())
                    # a copy differs from its text in one word, so its words are made from the text's own
                    copies = ((a, b) for a in held.tolist() if a in others for b in others[a])
                    changed.append([np.union1d(held[held != a], [] if b is None else [b]).astype("<i4").tobytes() for a, b in copies])
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(own, pa.binary()), pa.array(changed, pa.list_(pa.binary()))], names=["y", "words", "swapped"])

    got = rows.mapInArrow(inputs, "y int, words binary, swapped array<binary>").toPandas()
    flat = lambda cells: (np.repeat(np.arange(len(cells)), [len(x) // 4 for x in cells]), np.frombuffer(b"".join(cells), "<i4").astype(np.int64))
    of = np.repeat(np.arange(len(got)), [len(x) for x in got["swapped"]])
    weights, bias = fit(*flat(list(got["words"])), got["y"].to_numpy().astype(np.float64), len(names), of, *flat([c for x in got["swapped"] for c in x]), **options)
    full = np.zeros(BUCKETS)
    full[names] = weights
    return ToxicityModel(full, bias)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """All rows of docs with toxicity, the score of the whole text (null counts as empty; a text without known words scores the bias alone).

    Rows are scored each for itself, so null keys, repeated rows and an empty table need nothing of their own; a long text is
    read whole. An existing column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights, whatever the input's size
    return with_columns_of(docs, text, {"toxicity": DoubleType()}, lambda col: [pa.array(shared.value.score(col))])

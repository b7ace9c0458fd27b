"""Operator 6: toxicity.

A counterfactual-regularised classifier.  Each labelled text that mentions an identity term gets twins in which every term
of a group is swapped for another term of the same group; learning penalises the squared change of the score between the
text and its twins, so the weight of a group mention is pulled to that of any other group, and a neutral mention isn't
taken for an insult because one group was insulted more often in the labelled texts.

Features are hashed words in lower case, and hashed strings of the first 4 to 8 bytes of words of that length or more
(inflected forms share them).  Values are presences, so an insult counts as much in a long text as in a short one.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lepidus.llm import _text, ftrl

BITS = 20
MAX_TRAIN = 12000
REJECT = 0.25  # of 0..1; labelled toxic texts are one in ten, and letting one through costs more
STARTS = (4, 5, 6, 7, 8)
PULL = 2.0
TWINS = 2
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics"),
    ("gay", "lesbian", "bisexual", "straight", "transgender", "queer"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("mexican", "american", "chinese", "german", "french", "spanish", "russian", "indian"),
    ("immigrants", "natives", "refugees", "citizens"),
    ("disabled", "blind", "deaf", "autistic"),
    ("young", "old", "elderly"),
    # German, French and Spanish
    ("frauen", "männer", "mädchen", "jungen"),
    ("frau", "mann"),
    ("muslime", "christen", "juden", "hinduisten", "buddhisten", "atheisten", "katholiken"),
    ("muslimisch", "christlich", "jüdisch", "buddhistisch", "katholisch"),
    ("schwul", "lesbisch", "bisexuell", "heterosexuell"),
    ("schwarze", "weiße", "asiaten", "araber", "türken", "deutsche", "russen"),
    ("ausländer", "einwanderer", "flüchtlinge", "einheimische"),
    ("behinderte", "blinde", "gehörlose"),
    ("femmes", "hommes", "filles", "garçons"),
    ("femme", "homme"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées", "catholiques"),
    ("homosexuels", "lesbiennes", "bisexuels", "hétérosexuels"),
    ("noirs", "blancs", "asiatiques", "arabes", "africains", "européens"),
    ("immigrés", "réfugiés", "étrangers", "citoyens"),
    ("handicapés", "aveugles", "sourds"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("mujer", "hombre"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos", "católicos"),
    ("homosexuales", "lesbianas", "bisexuales", "heterosexuales"),
    ("negros", "blancos", "asiáticos", "árabes", "africanos", "europeos", "latinos"),
    ("inmigrantes", "refugiados", "extranjeros", "ciudadanos"),
    ("discapacitados", "ciegos", "sordos"),
)


def swapper(groups: tuple[tuple[str, ...], ...] = IDENTITY, n: int = TWINS):
    """text -> its twins: for k = 1..n, every identity term replaced by the k-th after it in its group, case kept at the first letter."""
    place = {t: (g, i) for g in groups for i, t in enumerate(g)}
    # one word at most as long as the longest term; the dictionary decides
    words = re.compile(r"\b[^\W\d_]{%d,%d}\b" % (min(map(len, place), default=1), max(map(len, place), default=1)))

    def twins(text: str) -> list[str]:
        if not any(w.lower() in place for w in words.findall(text)):
            return []

        def swap(m: re.Match, k: int) -> str:
            old = m[0]
            if old.lower() not in place:
                return old
            g, i = place[old.lower()]
            new = g[(i + k) % len(g)]
            return new.capitalize() if old[0].isupper() else new

        return [t for k in range(1, n + 1) if (t := words.sub(lambda m, k=k: swap(m, k), text)) != text]

    return twins


def featurize(data: np.ndarray, at: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, 1.0), each feature once a text; with weights ``w``, only features whose weight isn't zero."""
    data = _text.lower(data)
    s, e, doc = _text.tokens(data, at)
    hash_ = _text.hasher(data)
    parts = []
    for n in (0, *STARTS):
        long = e - s >= n
        d, a = doc[long], s[long]
        h = _text.mix(hash_(a, a + n), n) if n else hash_(s, e)
        f = (h & np.uint64((1 << BITS) - 1)).astype(np.int64)
        if w is not None:
            some = w[f] != 0
            d, f = d[some], f[some]
        parts.append(d << BITS | f)
    key = np.concatenate(parts)
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return key >> BITS, key & ((1 << BITS) - 1), np.ones(len(key))


def fit(docs: DataFrame, labels: DataFrame, at_most: int = MAX_TRAIN, pull: float = PULL, groups: tuple = IDENTITY) -> np.ndarray:
    return ftrl.train(ftrl.sample(docs, labels, "toxic", at_most), featurize, ftrl.Ftrl(BITS, alpha=0.3, l1=10.0, l2=0.1), epochs=4, twins=swapper(groups), pull=pull, empty=-35.0)


def classify(docs: DataFrame, labels: DataFrame, at_most: int = MAX_TRAIN, reject: float = REJECT) -> DataFrame:
    """(doc_id, toxicity, toxic) of every row of ``docs``.

    ``at_most`` bounds the labelled rows that the model is fitted to; scoring covers every row and whole texts.  A null or
    empty text gets the bias alone; a null doc_id is scored and stays null; repeated rows get equal scores; other columns are
    ignored; with no labelled rows every score is 0 and none is toxic.
    """
    w = fit(docs, labels, at_most)
    return ftrl.score(docs.select("doc_id", "text"), featurize, w, "toxicity").select("doc_id", F.round("toxicity", 6).alias("toxicity"), (F.col("toxicity") > reject).alias("toxic"))


def stage(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with their columns."""
    name = _text.fresh(docs.columns, "toxicity")
    return ftrl.score(docs, featurize, fit(docs, labels), name).where(F.col(name) <= REJECT).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic documents with their scores: the classifier over the whole documents table, what it rejects."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels).where("toxic")

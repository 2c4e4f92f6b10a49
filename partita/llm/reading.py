"""Reading level of each document: regularised ordinal regression calibrated to graded samples.

Two models are fitted on the graded samples (a bounded table: at most MOST_SAMPLES rows): whether a text is
running prose (level 0 is not), a ridge logistic regression over the make-up of its characters and words, and how
demanding prose is (levels 1 to 4), a ridge proportional-odds regression over lexical diversity, word rarity,
connectives, a clause-depth proxy and lengths. Word rarity comes from the prose of all documents, counted in a
table of BUCKETS hashed counters whose size doesn't depend on the corpus.
"""

from __future__ import annotations

import functools
import html
import math
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partita.llm.bpe import texts_of
from partita.tables import stash, table

BUCKETS = 1 << 20
MOST_SAMPLES = 10_000
RIDGE = 0.5
WINDOW = 40
#: Words that the means of the graded prose weigh in a text's measures, so that a note of four words is no evidence of a level.
PRIOR_WORDS = 10

#: Closed classes of words that join clauses, as grammars list them: subordinating conjunctions, relative pronouns
#: and conjunctive adverbs of English, German, French and Spanish. No list was made from the graded samples.
CONNECTIVES = frozenset(
    """after although as because before if inasmuch insofar lest once provided since than that though till unless until when whenever where whereas wherever whether while
    which who whom whose accordingly besides consequently conversely finally furthermore hence however indeed instead likewise meanwhile moreover
    nevertheless nonetheless notwithstanding otherwise similarly subsequently then thereby therefore thus either neither nor
    als bevor bis da damit dass daß ehe falls indem nachdem ob obgleich obschon obwohl seit seitdem sobald sodass sofern solange sooft soweit während weil wenn wenngleich wobei wodurch wofür womit
    welche welchem welchen welcher welches deren dessen allerdings außerdem daher dagegen dann darum demnach demzufolge dementsprechend dennoch deshalb deswegen ferner folglich gleichwohl hingegen
    indessen infolgedessen insbesondere jedoch keineswegs mithin nichtsdestoweniger somit sonst trotzdem überdies vielmehr weder zudem zwar
    afin alors attendu avant comme depuis lorsque malgré parce pendant pourvu puisque quand que qui quoi quoique sauf selon si sinon tandis
    dont où lequel laquelle lesquels lesquelles auquel auxquels duquel desquels ainsi cependant certes conséquemment donc enfin ensuite néanmoins nonobstant notamment pourtant toutefois
    antes apenas aunque como conforme cuando después donde mientras porque pues puesto según sino siempre
    cual cuales cuya cuyas cuyo cuyos quien quienes además ahora así asimismo consiguientemente embargo entonces luego obstante particularmente pero tampoco""".split()
)

_MOJIBAKE = re.compile("[\u00c2-\u00f4][\u0080-\u00bf]+")
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,80}>|<\|[^<>|\n]{0,40}\|>|</?s>|\[/?(?:INST|PAD|CLS|SEP|MASK|UNK|BOS|EOS)\]", re.I)
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2028-\u202e\u2060-\u2064\ufeff\ufffd\x00-\x08\x0b-\x1f\x7f-\x9f]")
_BROKEN = re.compile(r"(\w)-[ \t]*\n[ \t]*(?=[^\W\d_])")
_LEAD = re.compile(r"^[ \t]*(?:[>*#•·-]+[ \t]+|\d{1,3}[.)][ \t]+)+", re.M)
_LINK = re.compile(r"https?://\S+|\[([^\]\n]*)\]\([^)\n]*\)")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_END = re.compile(r"[.!?…]+(?=[\"'»”)\]]*(?:\s|$))|\n{2,}")
_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")
_CLAUSE = re.compile(r"[,;:()–—]|\s-\s")
_ABBREVIATION = re.compile(r"\b(?:cf|ff|pp?|vgl|bzw|z|e\.g|i\.e|etc|no|nr|fig|bd|vol|ca|ed|eds|op)\.", re.I)


def clean(text: str) -> str:
    """The text without what its transport has done to it: entities, tags, hidden characters, wrongly decoded bytes, ligatures, broken words, quote and list marks."""
    t = html.unescape(html.unescape(text)) if "&" in text else text

    def undo(m: re.Match) -> str:
        for code in ("latin-1", "cp1252"):
            try:
                return m.group().encode(code).decode("utf-8")
            except UnicodeError:
                continue
        return m.group()

    # what cannot occur in a text is not looked for
    if not t.isascii():
        if "Â" in t or "Ã" in t or "â" in t:
            t = _MOJIBAKE.sub(undo, t)
        t = unicodedata.normalize("NFKC", t)
    t = _HIDDEN.sub("", t.replace("\r\n", "\n").replace("\r", "\n"))
    if "<" in t or "[" in t:
        t = _TAG.sub(" ", t)
    if "http" in t or "](" in t:
        t = _LINK.sub(lambda m: m.group(1) or " ", t)
    if "-" in t and "\n" in t:
        t = _BROKEN.sub(r"\1", t)
    return _LEAD.sub("", t)


def _bare(word: str) -> str:
    """A word without case and accents, which rough texts get wrong."""
    w = word.casefold()
    return w if w.isascii() else "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) & (BUCKETS - 1)


_BARE_CONNECTIVES = frozenset(_bare(w) for w in CONNECTIVES)


@functools.lru_cache(maxsize=200_000)
def _is_word(token: str) -> bool:
    w = token.strip("\"'.,;:!?()[]{}«»“”„¿¡…*_–—-`")
    return bool(w) and all(c.isalpha() or c in "'’-/" for c in w) and (len(w) > 1 or w.lower() in "aiyoeàóúè&")


@functools.lru_cache(maxsize=200_000)
def _token(token: str) -> tuple[int, int, int, int, int, int, int, str]:
    """(characters, letters, digits, a word, a word of three or more, a word that ends in a mark, a word of two letters or more, the token without the dot of an abbreviation)."""
    word = _is_word(token)
    return (len(token), sum(map(len, _LETTERS.findall(token))), sum(map(len, _DIGITS.findall(token))), int(word), int(word and len(token) > 2), int(word and token[-1] in ".,;:!?"), int(word and len(token) > 1 and len(token.strip(".,;:!?()")) > 1), _ABBREVIATION.sub(lambda m: m.group()[:-1], token))


@functools.lru_cache(maxsize=200_000)
def _facts(word: str) -> tuple[str, int, int, bool]:
    """(bare word, bucket, letters, whether a connective)."""
    w = _bare(word)
    return w, bucket(w), len(w.replace("-", "").replace("'", "").replace("\u2019", "")), w in _BARE_CONNECTIVES


SHAPE = ("letters", "digits", "symbols", "words", "long_words", "plain_end")
LEVEL = ("sentence_length", "word_length", "long_words", "clause_depth", "connectives", "diversity", "rarity", "length_x_word")
RARITY = LEVEL.index("rarity")


def measure(text: str) -> tuple[list[float], list[float], list[int]]:
    """(shape, level, buckets) of a cleaned text: what it is made of, how its prose is written (LEVEL, with rarity still 0), and the bucket of each word of its prose.

    Prose are the lines of which at least half are words of two letters or more, and blank ones; lines of notes,
    chords, numbers and code are none.
    """
    n = letters = digits = words = long = ends = count = 0
    keep = []
    for line in text.split("\n"):
        tokens = line.split()
        if not tokens:
            keep.append("")
            continue
        *facts, plain = zip(*map(_token, tokens))
        a, b, c, d, e, f, g = map(sum, facts)
        n, letters, digits, words, long, ends, count = n + a, letters + b, digits + c, words + d, long + e, ends + f, count + len(tokens)
        if 2 * g >= len(tokens):
            keep.append(" ".join(plain))
    n, count = max(1, n), max(1, count)
    shape = [letters / n, digits / n, (n - letters - digits) / n, words / count, long / count, ends / max(1, words)]

    prose = "\n".join(keep)
    lengths, found = [], []
    for sentence in _END.split(prose):
        if sentence and (here := _WORD.findall(sentence)):
            lengths.append(len(here))
            found += here
    if not found:
        return shape, [0.0] * len(LEVEL), []
    bare, buckets, sizes, connective = zip(*map(_facts, found))
    n, joined = len(bare), sum(connective)
    # each word counts its own sentence's length, so that a heading or a stray line weighs little
    length = sum(k * k for k in lengths) / n
    marks = len(_CLAUSE.findall(prose)) + joined
    size = min(WINDOW, n)
    starts = list(range(0, n - size + 1, max(1, size // 2)))
    if starts[-1] < n - size:  # the last words count as well
        starts.append(n - size)
    different = sum(len(set(bare[i : i + size])) for i in starts) / (size * len(starts))
    mean = sum(sizes) / n
    level = [
        math.log(length + 1), mean, sum(x >= 10 for x in sizes) / n, math.log1p(marks / len(lengths)),
        joined / n, different, 0.0, math.log(length + 1) * mean / 10,
    ]
    return shape, level, list(buckets)


def shape_features(text: str) -> list[float]:
    """What a cleaned text is made of; for the prose model."""
    return measure(text)[0]


def level_features(text: str, rarity: np.ndarray) -> list[float]:
    """How a cleaned text's prose is written; for the level model. `rarity`: bits of each bucket."""
    _, level, buckets = measure(text)
    if buckets:
        level[RARITY] = float(rarity[np.array(buckets)].mean(dtype=np.float64))
    return level


MEASURED = "shape array<double>, level array<double>, buckets array<int>"


def measured(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """id and the measures of every text, by one pass over the texts. Null texts are measured as empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b.column(1))
            for lo in range(0, len(texts), 500):
                shape, level, buckets = zip(*(measure(clean(t) if t else "") for t in texts[lo : lo + 500]))
                ends = np.concatenate([[0], np.cumsum([len(x) for x in buckets])]).astype(np.int32)
                flat = np.fromiter((x for y in buckets for x in y), np.int32, ends[-1])
                fixed = lambda m: pa.FixedSizeListArray.from_arrays(pa.array(np.array(m, dtype=float).ravel()), len(m[0])).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 500), fixed(shape), fixed(level), pa.ListArray.from_arrays(ends, pa.array(flat))], names=[id_, "shape", "level", "buckets"])

    return docs.select(id_, text).mapInArrow(run, f"`{id_}` {docs.schema[id_].dataType.simpleString()}, {MEASURED}")


def bucket_counts(done: DataFrame) -> np.ndarray:
    """How often the words of each bucket occur in all measured texts. Each task sums its own counters before they are shuffled; the result always has BUCKETS numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            acc += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False), minlength=BUCKETS)
        at = np.flatnonzero(acc)
        for lo in range(0, len(at), 100_000):
            part = at[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(acc[part])], names=["bucket", "n"])

    got = done.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS)
    out[got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy()
    return out


def word_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    return bucket_counts(measured(docs.select(F.lit(0).alias("id"), text), "id", text))


def rarity_bits(counts: np.ndarray) -> np.ndarray:
    return np.minimum(20.0, -np.log2((counts + 0.5) / (counts.sum() + 1))).astype(np.float32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


class OrdinalModel:
    """P(level > k) = sigmoid(x w - cut_k), fitted with a ridge on w by damped Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = RIDGE):
        self.levels = np.unique(y)
        self.mean, sd = x.mean(0), x.std(0)
        self.sd = np.where(sd < 1e-12, 1.0, sd)
        z, k = self._scaled(x), len(self.levels) - 1
        above = (y[:, None] > self.levels[:-1]).astype(float)
        p = np.concatenate([np.zeros(x.shape[1]), np.linspace(-1, 1, k) if k > 1 else np.zeros(k)])
        d = x.shape[1]
        for _ in range(200):
            s = _sigmoid(z @ p[:d, None] - p[d:])
            r, v = s - above, s * (1 - s)
            grad = np.concatenate([z.T @ r.sum(1) + ridge * p[:d], -r.sum(0)])
            h = np.zeros((d + k, d + k))
            h[:d, :d] = (z * v.sum(1)[:, None]).T @ z + ridge * np.eye(d)
            h[:d, d:] = -z.T @ v
            h[d:, :d] = h[:d, d:].T
            h[d:, d:] = np.diag(v.sum(0) + 1e-6)
            move = np.linalg.solve(h, grad)
            p = p - move * min(1.0, 2.0 / max(1e-12, np.abs(move).max()))
            if np.abs(move).max() < 1e-9:
                break
        self.w, self.cuts = p[:d], np.sort(p[d:])

    def even_cuts(self, x: np.ndarray, y: np.ndarray) -> None:
        """Moves each cut to where its two neighbouring levels err equally often, taking their scores as normal. The fitted cuts of a wide gap lie anywhere in it."""
        score = self.score(x)
        mean, sd = (np.array([f(score[y == k]) for k in self.levels]) for f in (np.mean, np.std))
        sd = np.maximum(sd, 1e-6)
        self.cuts = np.sort((mean[1:] * sd[:-1] + mean[:-1] * sd[1:]) / (sd[1:] + sd[:-1]))

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.sd, -4, 4)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self._scaled(x) @ self.w

    def level(self, x: np.ndarray) -> np.ndarray:
        return self.levels[(self.score(x)[:, None] > self.cuts).sum(1)]

    def expected(self, x: np.ndarray) -> np.ndarray:
        """The mean of the levels under the model."""
        return self.levels[0] + _sigmoid(self.score(x)[:, None] - self.cuts) @ np.diff(self.levels)


class Reader:
    """Both models and the rarity table; small enough to go to every task."""

    def __init__(self, samples: list[tuple[int, str]], rarity: np.ndarray):
        self.rarity = rarity
        texts = [(level, clean(t)) for level, t in samples if t and level is not None]
        level = np.array([x for x, _ in texts])
        shape = np.array([shape_features(t) for _, t in texts])
        self.prose = OrdinalModel(shape, (level > 0).astype(int))
        keep = level > 0
        feats, words = self._measures([t for (_, t), k in zip(texts, keep) if k])
        self.centre = feats.mean(0)
        self.hard = OrdinalModel(self._steady(feats, words), level[keep])
        self.hard.even_cuts(self._steady(feats, words), level[keep])

    def _measures(self, cleaned: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([level_features(t, self.rarity) for t in cleaned]), np.array([len(measure(t)[2]) for t in cleaned])

    def _steady(self, feats: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The measures of few words drawn towards the means of the graded prose."""
        return self.centre + (feats - self.centre) * (words / (words + PRIOR_WORDS))[:, None]

    def grade(self, shape: np.ndarray, feats: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(prose, level, score): the probability of running prose, the level (0 where that is below a half or there is no word), and the expected level of the prose (0 without any)."""
        some, feats = words > 0, self._steady(feats, words)
        prose = np.where(some, _sigmoid(self.prose.score(shape) - self.prose.cuts[0]), 0.0)
        yes = prose >= 0.5
        return prose, np.where(yes, self.hard.level(feats), 0), np.where(yes, self.hard.expected(feats), 0.0)

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """grade() of texts."""
        cleaned = [clean(t) if t else "" for t in texts]
        return self.grade(np.array([shape_features(t) for t in cleaned]), *self._measures(cleaned))

    def grade_measured(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """grade() of a batch of measured texts."""
        shape, feats = (b.column(c).flatten().to_numpy().reshape(b.num_rows, -1).copy() for c in ("shape", "level"))
        size = b.column("buckets").value_lengths().to_numpy(zero_copy_only=False)
        bits = self.rarity[b.column("buckets").flatten().to_numpy()].astype(np.float64)
        feats[:, RARITY] = np.bincount(np.repeat(np.arange(b.num_rows), size), bits, b.num_rows) / np.maximum(size, 1)
        return self.grade(shape, feats, size)


def fit(done: DataFrame, samples: DataFrame) -> Reader:
    rows = samples.filter("level is not null and text is not null").select("level", "text").limit(MOST_SAMPLES + 1).collect()
    if len(rows) > MOST_SAMPLES:
        raise ValueError(f"more than {MOST_SAMPLES} graded samples")
    return Reader(sorted((int(r.level), r.text) for r in rows), rarity_bits(bucket_counts(done)))


def levels(docs: DataFrame, samples: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, prose, level, score) of every row. Null, empty and blank texts have level 0 and prose 0; repeated rows stay. The samples must hold at least two levels above 0, and level 0.

    The texts are read once; their measures are written, counted and graded.
    """
    done = stash(measured(docs, id_, text), "measured")
    reader = docs.sparkSession.sparkContext.broadcast(fit(done, samples))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prose, level, score = reader.value.grade_measured(b)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prose), pa.array(level.astype(np.int32)), pa.array(score)], names=[id_, "prose", "level", "score"])

    return done.mapInArrow(run, f"`{id_}` {docs.schema[id_].dataType.simpleString()}, prose double, level int, score double")


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    return levels(table(spark, d, "documents"), table(spark, d, "level_samples"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_levels(spark, d).filter("level = 4").select("doc_id")


def p9_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each source and level."""
    docs = table(spark, d, "documents")
    return levels(docs, table(spark, d, "level_samples")).join(docs.select("doc_id", "source"), "doc_id").groupBy("source", "level").agg(F.count(F.lit(1)).alias("n"))

"""Language of documents by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on windows of a bounded sample of
documents. It labels every byte of every text, in windows; the probabilities of a document's positions are
averaged, and the language with the highest average is the prediction. Gates and candidates use
``x / (1 + |x|)`` in place of the logistic function and tanh, which costs a division only.

``train(..., other=True)`` adds a label for text in no learned language. It is learned from junk: shuffled
bytes of the windows, random words of Latin letters and digits, and scripts that the windows do not use. A text
is in no learned language if the label's average probability is above ``0.5 + slack / sqrt(bytes)``; the slack
is ``MARGIN`` times the least with which every document drawn to fit it stays.

Defined results: ``und`` with score 0 where a text is null or has no letter, is in no learned language, or
where nothing was learned; ties go to the language that comes first in order; extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.llm.batches import extended, slices

UNKNOWN = "und"
HIDDEN = 8
#: Documents per language that the network learns from, about this many at most, and windows of each.
PER_LANGUAGE, WINDOWS, TRAINED = 600, 4, 64
STEPS, BATCH, RATE = 240, 256, 0.02
WINDOW = 128
SLICE_BYTES = 1 << 19
#: The other label: first and last letters of scripts, factor on the fitted slack, and the documents below
#: which no text is held to be in another language.
SCRIPTS = ("ͰϿ", "Аџ", "את", "ءي", "अह", "กฮ", "ぁゖ", "一龥", "가힣")
LATIN = "abcdefghijklmnopqrstuvwxyz"
MARGIN, LEAST = 3, 100


def _squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


@dataclass
class Direction:
    """Input rows by byte for update gate, reset gate and candidate; recurrent weights of both."""

    e: np.ndarray
    u: np.ndarray
    c: np.ndarray

    @classmethod
    def drawn(cls, draw: np.random.Generator, h: int) -> Direction:
        make = lambda *shape: (draw.normal(size=shape) * 0.3).astype("f4")
        return cls(make(256, 3 * h), make(h, 2 * h), make(h, h))

    def step(self, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The next state; ``x`` holds a byte per row."""
        size = h.shape[1]
        given = np.take(self.e, x, axis=0)
        gates = h @ self.u
        gates += given[:, : 2 * size]
        spread = np.abs(gates)
        spread += 1
        gates /= spread
        gates += 1
        gates *= 0.5
        new = (gates[:, size:] * h) @ self.c
        new += given[:, 2 * size :]
        spread = np.abs(new)
        spread += 1
        new /= spread
        new -= h
        new *= gates[:, :size]
        new += h
        return new


@dataclass
class Network:
    """Labels are the languages, and a last one for other text if ``slack`` is set."""

    languages: list[str]
    ahead: Direction
    back: Direction
    w: np.ndarray
    b: np.ndarray
    slack: float | None = None

    def parameters(self) -> list[np.ndarray]:
        return [self.ahead.e, self.ahead.u, self.ahead.c, self.back.e, self.back.u, self.back.c, self.w, self.b]

    def positions(self, x: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Sums over the positions ``inside`` of each row's label probabilities; ``x`` is time by rows."""
        steps, rows = x.shape
        size = self.ahead.u.shape[0]
        logits = np.empty((steps, rows, len(self.b)), "f4")
        h = np.zeros((rows, size), "f4")
        for t in range(steps):
            h = self.ahead.step(x[t], h)
            np.matmul(h, self.w[:size], out=logits[t])
        sums = np.zeros((rows, len(self.b)), "f4")
        h[:] = 0
        for t in range(steps - 1, -1, -1):
            h = self.back.step(x[t], h)
            p = h @ self.w[size:]
            p += logits[t]
            p += self.b
            p -= p.max(1, keepdims=True)
            np.exp(p, out=p)
            p *= (inside[t] / p.sum(1))[:, None]
            sums += p
        return sums

    def documents(self, given: list[bytes]) -> np.ndarray:
        """Average label probabilities of each text; zeros for an empty one."""
        lengths = np.array([len(g) for g in given])
        result = np.zeros((len(given), len(self.b)))
        if not lengths.sum():
            return result
        buffer = np.frombuffer(b"".join(given), np.uint8)
        ends = lengths.cumsum()
        windows = -(-lengths // WINDOW)
        owner = np.repeat(np.arange(len(given)), windows)
        number = np.arange(len(owner)) - np.repeat(windows.cumsum() - windows, windows)
        starts = (ends - lengths)[owner] + number * WINDOW
        for at in range(0, len(owner), 4096):
            some = slice(at, at + 4096)
            places = starts[some] + np.arange(WINDOW)[:, None]
            inside = places < ends[owner[some]]
            x = np.where(inside, buffer[np.minimum(places, len(buffer) - 1)], 0).astype(np.intp)
            np.add.at(result, owner[some], self.positions(x, inside.astype("f4")))
        return result / np.maximum(lengths, 1)[:, None]

    def foreign(self, p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Whether texts of ``lengths`` bytes with the average probabilities ``p`` are in no learned language."""
        if self.slack is None:
            return np.zeros(len(p), bool)
        return p[:, len(self.languages)] > 0.5 + self.slack / np.sqrt(np.maximum(lengths, 1))


def _run(d: Direction, x: np.ndarray) -> tuple[list, list]:
    """States before each step and after, and what the backward pass needs."""
    size, h, kept, states = d.u.shape[0], np.zeros((x.shape[1], d.u.shape[0]), "f4"), [], []
    for row in x:
        given = d.e[row]
        a = _squash(given[:, : 2 * size] + h @ d.u)
        z, r = (a[:, :size] + 1) / 2, (a[:, size:] + 1) / 2
        n = _squash(given[:, 2 * size :] + (r * h) @ d.c)
        kept.append((h, a, z, r, n))
        h = h + z * (n - h)
        states.append(h)
    return states, kept


def _learn(d: Direction, x: np.ndarray, kept: list, grads: list[np.ndarray]) -> list[np.ndarray]:
    """Gradients of one direction by backpropagation through time; ``grads`` come from the labels."""
    size = d.u.shape[0]
    du, dc, dh = np.zeros_like(d.u), np.zeros_like(d.c), np.zeros_like(kept[0][0])
    inputs = np.empty((len(x), x.shape[1], 3 * size), "f4")
    for t in range(len(x) - 1, -1, -1):
        h, a, z, r, n = kept[t]
        dh = dh + grads[t]
        dn = dh * z * (1 - np.abs(n)) ** 2
        back = dn @ d.c.T
        da = np.concatenate([dh * (n - h), back * h], 1) * (1 - np.abs(a)) ** 2 / 2
        dc += (r * h).T @ dn
        du += h.T @ da
        inputs[t] = np.concatenate([da, dn], 1)
        dh = dh * (1 - z) + back * r + da @ d.u.T
    flat, places = inputs.reshape(-1, 3 * size), x.ravel()
    de = np.column_stack([np.bincount(places, flat[:, k], 256) for k in range(3 * size)]).astype("f4")
    return [de, du, dc]


def fit(windows: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = STEPS) -> Network:
    """Trains on windows (a row of bytes each) whose every position has the window's label."""
    draw = np.random.default_rng(17)
    network = Network(languages, Direction.drawn(draw, HIDDEN), Direction.drawn(draw, HIDDEN),
                      (draw.normal(size=(2 * HIDDEN, len(languages))) * 0.3).astype("f4"), np.zeros(len(languages), "f4"))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in network.parameters()]
    each = [np.flatnonzero(labels == k) for k in range(len(languages))]
    for step in range(1, steps + 1):
        rows = np.concatenate([draw.choice(own, -(-BATCH // len(each))) for own in each])
        x, y = windows[rows].T.astype(np.intp), labels[rows]
        ahead, kept = _run(network.ahead, x)
        behind, kept_back = _run(network.back, x[::-1])
        states = np.concatenate([np.stack(ahead), np.stack(behind[::-1])], 2)
        logits = states @ network.w + network.b
        p = np.exp(logits - logits.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        p[:, np.arange(len(y)), y] -= 1
        p /= p.shape[0] * p.shape[1]
        flat = p.reshape(-1, p.shape[2])
        back = p @ network.w.T
        one = _learn(network.ahead, x, kept, list(back[:, :, :HIDDEN]))
        two = _learn(network.back, x[::-1], kept_back, list(back[::-1, :, HIDDEN:]))
        grads = [*one, *two, states.reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(0)]
        rate = RATE * (1 - 0.8 * step / steps)
        for value, grad, (m, v) in zip(network.parameters(), grads, moments):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype("f4")
    return network


def junk(windows: np.ndarray, number: int) -> np.ndarray:
    """Windows of text in no language."""
    draw = np.random.default_rng(23)
    size = windows.shape[1]
    share = np.bincount(windows.ravel(), minlength=256) / windows.size
    # A script is known by its first byte; those of the windows may be languages to learn.
    foreign = [s for s in SCRIPTS if share[s[0].encode()[0]] < 0.001]
    mixed = [c.encode() for c in LATIN.upper() + LATIN + "0123456789"]
    alphabets = [([c.encode() for c in LATIN], 12), (mixed, 40)]

    def words(letters: list[bytes], longest: int) -> bytes:
        made = b""
        while len(made) < size:
            made += b"".join(letters[i] for i in draw.integers(0, len(letters), draw.integers(2, longest))) + b" "
        return made[:size]

    out = []
    for k in range(number):
        if k % 4 == 0:
            out.append(draw.permutation(windows[draw.integers(len(windows))]))
            continue
        letters, longest = alphabets[k % 2]
        if k % 4 == 3 and foreign:
            first, last = map(ord, foreign[draw.integers(len(foreign))])
            letters, longest = [chr(c).encode() for c in draw.integers(first, last + 1, 64)], 12
        out.append(np.frombuffer(words(letters, longest), np.uint8))
    return np.array(out)


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
          per_language: int = PER_LANGUAGE, other: bool = False) -> Network | None:
    """Learns from documents that have a language and letters and are not held out.

    A hash of the id draws about ``per_language`` documents of each language, and a few windows of each go
    to the driver. None if there is nothing to learn from. ``other`` adds the label for other text, which
    needs ``LEAST`` documents; its slack is fitted on the documents drawn, none of them held out.
    """
    labelled = docs.select(F.col(key).alias("id"), F.col(text).alias("t"), F.col(lang).alias("lang")).filter(
        F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("t").isNotNull())
    usable = labelled.filter(~held_out("id"))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, max(1.0, n / per_language))])[F.col("lang")]
    chosen = (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) * share < (1 << 20)) & F.rlike("t", F.lit(r"\p{L}"))
    drawn = usable.filter(chosen)
    data = drawn.select("id", "lang", F.encode("t", "UTF-8").alias("bytes"), F.explode(F.sequence(F.lit(0), F.lit(WINDOWS - 1))).alias("k"))
    last = F.greatest(F.octet_length("bytes") - TRAINED, F.lit(0)) + 1
    cut = F.substring("bytes", (F.pmod(F.xxhash64("id", "k"), last) + 1).cast("int"), F.lit(TRAINED))
    rows = sorted((r["lang"], r["id"], r["k"], bytes(r["w"])) for r in data.select("lang", "id", "k", cut.alias("w")).collect())
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    windows = np.array([np.frombuffer(w.ljust(TRAINED), np.uint8) for *_, w in rows])
    labels = np.array([languages.index(r[0]) for r in rows])
    if not other or len(rows) < LEAST * WINDOWS:
        return fit(windows, labels, languages)
    made = junk(windows, len(windows) // len(languages) + 1)
    network = fit(np.concatenate([windows, made]), np.concatenate([labels, np.full(len(made), len(languages))]),
                  [*languages, UNKNOWN])
    network.languages = languages
    network.slack = MARGIN * fitted_slack(drawn.select("t"), network)
    return network


def fitted_slack(docs: DataFrame, network: Network) -> float:
    """The least slack, 0 or more, with which none of the texts ``t`` is held to be in another language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", SLICE_BYTES):
            given = batch.column("t").cast(pa.binary()).to_pylist()
            p = network.documents(given)[:, len(network.languages)]
            yield pa.RecordBatch.from_pydict({"need": (p - 0.5) * np.sqrt([len(g) for g in given])})

    return max(0.0, docs.mapInArrow(run, "need double").agg(F.max("need")).first()[0] or 0.0)


def identify(docs: DataFrame, network: Network | None, text: str = "text", into: str = "lang_pred",
             score: str = "score") -> DataFrame:
    """Adds the language and the average probability of every whole text; replaces columns of these names."""
    kept = docs.drop(into, score)
    if network is None:
        return kept.withColumns({into: F.lit(UNKNOWN), score: F.lit(0.0)})
    letters = F.coalesce(F.rlike(text, F.lit(r"\p{L}")), F.lit(False))
    schema = T.StructType([*kept.schema.fields, T.StructField(into, T.StringType()), T.StructField(score, T.DoubleType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, SLICE_BYTES):
            given = batch.column(text).cast(pa.binary()).to_pylist()
            p = network.documents([g or b"" for g in given])
            best = p[:, : len(network.languages)].argmax(1)
            foreign = network.foreign(p, np.array([len(g or b"") for g in given]))
            yield extended(batch, arrow, **{
                into: [UNKNOWN if f else network.languages[k] for k, f in zip(best, foreign)],
                score: np.where(foreign, 0, np.clip(p[np.arange(len(best)), best], 0, 1)).round(6)})

    labelled = kept.mapInArrow(run, schema)
    return labelled.withColumns({
        into: F.when(letters, F.col(into)).otherwise(UNKNOWN), score: F.when(letters, F.col(score)).otherwise(0.0)})

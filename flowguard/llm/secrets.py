"""Secret scans: fixed patterns, and a character network that judges every candidate in context.

The base findings come from three patterns. Candidates are runs of sixteen or more characters
that keys are made of, with a digit among them, and any run of six or more behind a separator or a
quote; each is read, with the text around it, by a
convolutional network over characters. The network is trained on labelled findings while the
context is hidden at random, so that it has to know a secret by its own characters as well.
Its threshold is the highest that keeps a wanted recall on findings set aside, and its
scores are calibrated there. A candidate that passes and touches no base finding is added.

Training takes all different findings (of up to ``LONGEST`` characters), by what stands around them, copies
counted once. They are dealt to tasks, whose networks are averaged after every round. Everything else
covers all rows and whole texts.

Defined cases: a null text counts as empty and has no findings; a null id is kept as null;
repeated rows give repeated results; an empty table gives an empty result; without findings to
learn from, no span is added. A very long run is convolved part by part, and its parts pooled together. Only :func:`redact` passes other columns on.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowguard.llm.common import blocks, texts
from flowguard.operators.metrics import score_curve
from flowguard.session import materialised

#: The base kinds in their order, with their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"""([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MODEL_KIND = "model"

DIGIT = re.compile(r"[0-9]")
CANDIDATE = re.compile(r"(?=[A-Za-z0-9+/_=-]{16})[A-Za-z0-9+/_=-]+")
#: A run behind a separator or a quote may be a secret from the base's six characters on.
GIVEN = re.compile(r"""(?:[:=]\x20*["']?|(?<![A-Za-z0-9])["'])([A-Za-z0-9+/_-]{6,}=*)""")
#: Longest finding to learn from, characters of a long run that are convolved at a time, and places of
#: a batch of windows.
LONGEST, PLACES = 2_000, 60_000
CONTEXT = 20
OTHER = 96
CODES = OTHER + 2


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base findings, by start, then in the order of the kinds."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text)
                  if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)
                  if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2], x[1]))]


def candidates(text: str, plain: bool = False) -> list[tuple[int, int]]:
    """What the network judges: runs of 16 or more key characters with a digit, and all runs of six
    or more behind a separator or a quote. Spans do not overlap.

    With ``plain``, a text with digits also gives its long runs that hold none.
    """
    spans = []
    if DIGIT.search(text):
        spans = [m.span() for m in CANDIDATE.finditer(text) if plain or DIGIT.search(m.group())]
    if ":" in text or "=" in text or '"' in text or "'" in text:
        more = [m.span(1) for m in GIVEN.finditer(text)]
        spans = sorted(spans + [(s, e) for s, e in more
                                if all(e <= a or b <= s for a, b in spans)])
    return spans


def window(text: str, start: int, end: int) -> tuple[str, str, str]:
    """What stands before the candidate, the whole candidate, and what follows."""
    return text[max(0, start - CONTEXT):start], text[start:end], text[end:end + CONTEXT]


def encode(windows: list[tuple[str, str, str]]) -> np.ndarray:
    """Character codes, padded to the longest: 0 nothing, 1 to 95 ASCII, 96 others; the candidate's
    own characters are marked by an offset of ``CODES``."""
    lead = CONTEXT
    size = 2 * CONTEXT + max((len(c) for _, c, _ in windows), default=0)
    out = np.zeros((len(windows), size), np.int64)
    for row, (before, own, after) in zip(out, windows):
        for part, at, offset in ((before, lead - len(before), 0), (own, lead, CODES),
                                 (after, lead + len(own), 0)):
            codes = np.frombuffer(part.encode("utf-32-le"), np.uint32).astype(np.int64)
            codes = np.where((codes >= 32) & (codes < 127), codes - 31, OTHER)
            row[at:at + len(codes)] = codes + offset
    return out


@dataclass
class SecretNetwork:
    """Embedding, one convolution, the maximum and mean over places, one output."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    temperature: float = 1.0
    threshold: float = 2.0

    WIDTH = 5

    @classmethod
    def start(cls, seed: int = 7, dim: int = 12, filters: int = 24) -> "SecretNetwork":
        g = np.random.default_rng(seed)
        return cls(g.normal(0, 0.3, (2 * CODES, dim)),
                   g.normal(0, (2 / (cls.WIDTH * dim)) ** 0.5, (cls.WIDTH * dim, filters)),
                   np.zeros(filters), g.normal(0, 0.2, 2 * filters), 0.0)

    def convolved(self, codes: np.ndarray):
        """Columns, filters, and which places are the candidate's, of encoded windows."""
        x = self.embed[codes]
        n, size, dim = x.shape
        view = np.lib.stride_tricks.sliding_window_view(x, self.WIDTH, axis=1)
        cols = view.transpose(0, 1, 3, 2).reshape(n, size - self.WIDTH + 1, self.WIDTH * dim)
        conv = np.maximum(cols @ self.kernel + self.bias, 0)
        inside = (codes[:, self.WIDTH // 2:size - self.WIDTH // 2] >= CODES)[:, :, None]
        return cols, conv, inside

    def forward(self, codes: np.ndarray):
        cols, conv, inside = self.convolved(codes)
        total = np.maximum(inside.sum(axis=1), 1)
        pooled = np.concatenate([conv.max(axis=1), (conv * inside).sum(axis=1) / total], axis=1)
        return pooled @ self.out + self.out_bias, (cols, conv, inside, total, pooled)

    def logits(self, codes: np.ndarray) -> np.ndarray:
        """The outputs alone; long windows are convolved and pooled part by part."""
        n, size = codes.shape
        step = max(self.WIDTH, PLACES // max(n, 1))
        most, total, places = 0.0, 0.0, 0
        for at in range(0, size - self.WIDTH + 1, step):
            _, conv, inside = self.convolved(codes[:, at:at + step + self.WIDTH - 1])
            most = np.maximum(most, conv.max(axis=1))
            total = total + (conv * inside).sum(axis=1)
            places = places + inside.sum(axis=1)
        pooled = np.concatenate([most, total / np.maximum(places, 1)], axis=1)
        return pooled @ self.out + self.out_bias

    def scores(self, windows: list[tuple[str, str, str]], batch: int = 256) -> np.ndarray:
        """Calibrated probabilities; windows of like length are computed together."""
        out = np.zeros(len(windows))
        order = sorted(range(len(windows)), key=lambda i: len(windows[i][1]))
        at = 0
        while at < len(order):
            longest = len(windows[order[min(at + batch, len(order)) - 1]][1])
            take = order[at:at + max(1, min(batch, PLACES // (longest + 2 * CONTEXT)))]
            logit = self.logits(encode([windows[i] for i in take])) / self.temperature
            out[take] = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            at += len(take)
        return out


#: Steps of training that even a small sample gets.
LEAST_STEPS = 300


def _gradients(net: SecretNetwork, windows, y: np.ndarray, weight: np.ndarray):
    """Gradients of the weighted logistic loss, added up over parts of bounded size."""
    grads = {n: np.zeros_like(getattr(net, n)) for n in ("embed", "kernel", "bias", "out")}
    d_bias, at = 0.0, 0
    order = sorted(range(len(windows)), key=lambda i: len(windows[i][1]))
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * len(windows[order[to]][1]) <= PLACES // 8:
            to += 1
        part = order[at:to]
        at = to
        codes = encode([windows[i] for i in part])
        logit, (cols, conv, inside, total, pooled) = net.forward(codes)
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[part]) * weight[part]
        filters, dim = conv.shape[2], net.embed.shape[1]
        d_pool = error[:, None] * net.out[None, :]
        d_conv = np.where(inside, (d_pool[:, filters:] / total)[:, None, :], 0.0)
        best = conv.argmax(axis=1)
        rows = np.arange(len(part))[:, None]
        d_conv[rows, best, np.arange(filters)[None, :]] += d_pool[:, :filters]
        d_conv *= conv > 0
        d_cols = d_conv @ net.kernel.T
        for k in range(net.WIDTH):
            np.add.at(grads["embed"], codes[:, k:k + conv.shape[1]],
                      d_cols[:, :, k * dim:(k + 1) * dim])
        grads["out"] += pooled.T @ error
        grads["bias"] += d_conv.sum(axis=(0, 1))
        grads["kernel"] += np.tensordot(cols, d_conv, axes=([0, 1], [0, 1]))
        d_bias += error.sum()
    return grads, d_bias


NAMES = ("embed", "kernel", "bias", "out", "out_bias")
#: Findings that are trained on in one go, and the places of a number that sums keep (as whole numbers,
#: so their order is of no matter).
PART, FINE = 2_000, 2.0 ** 48


def flat_state(net: SecretNetwork) -> np.ndarray:
    """The network's numbers, with a first and a second moment of nought for each."""
    own = np.concatenate([np.ravel(getattr(net, n)) for n in NAMES])
    return np.concatenate([own, np.zeros(2 * len(own))])


def load_state(net: SecretNetwork, state: np.ndarray) -> None:
    at = 0
    for n in NAMES:
        shape = np.shape(getattr(net, n))
        size = int(np.prod(shape))
        part = state[at:at + size]
        setattr(net, n, part.reshape(shape).copy() if shape else float(part[0]))
        at += size


def train_part(state: np.ndarray, windows, y: np.ndarray, weight: np.ndarray, passes: int,
               steps: int, seed) -> np.ndarray:
    """The state after ``passes`` over one part, ``steps`` of Adam having been made before."""
    g = np.random.default_rng(seed)
    net = SecretNetwork.start()
    own, m, v = (x.copy() for x in np.split(state, 3))
    batches = max(1, len(y) // 64)
    for _ in range(passes):
        for part in np.array_split(g.permutation(len(y)), batches):
            steps += 1
            shown = [(("" if g.random() < 0.5 else b), c, ("" if g.random() < 0.5 else a))
                     for b, c, a in (windows[i] for i in part)]
            load_state(net, own)
            grads, d_bias = _gradients(net, shown, y[part], weight[part] / len(part))
            grad = np.concatenate([*(np.ravel(grads[n]) for n in NAMES[:-1]), [d_bias]])
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad ** 2
            own = own - 0.01 * (m / (1 - 0.9 ** steps)) / (np.sqrt(v / (1 - 0.999 ** steps)) + 1e-8)
    return np.concatenate([own, m, v])


def _dealt(rows: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The findings in parts of about ``PART``, by hash, stored once; and the number of parts."""
    parts = -(-n // PART)
    key = F.xxhash64("before", "own", "after")
    dealt = (rows.withColumn("part", F.pmod(key, F.lit(parts)).cast("int")).repartition(parts, "part")
             .sortWithinPartitions("part", key, "before", "own", "after", "y"))
    return materialised(dealt.select("part", "before", "own", "after", "y")), parts


def _round(dealt: DataFrame, state: np.ndarray, share: dict, n: int, passes: int, steps: int,
           seed: int, turn: int) -> np.ndarray:
    """Every part goes on from one state; the new states are averaged, by their findings."""
    def trained(part, rows):
        windows = [r[:3] for r in rows]
        y = np.array([r[3] for r in rows], float)
        weight = np.where(y > 0, share[1], share[0])
        out = train_part(state, windows, y, weight, passes, steps, (seed, turn, part))
        sums = np.rint(np.clip(out, -4096, 4096) * (len(rows) / n) * FINE).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], ["i", "v"])

    def run(batches):
        held, at = [], None
        for batch in batches:
            for part, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and part != at:
                    yield trained(at, held)
                    held = []
                at = part
                held.append(row)
        if held:
            yield trained(at, held)

    sums = dealt.mapInArrow(run, "i int, v long").groupBy("i").agg(F.sum("v").alias("v"))
    found = sums.toArrow()
    out = np.zeros(len(state))
    out[found["i"].to_numpy()] = found["v"].to_numpy() / FINE
    return out


def _calibrate(net: SecretNetwork, judged: DataFrame, recall: float, precision: float) -> None:
    """Temperature and threshold from all findings of ``judged``, their context hidden."""
    def run(batches):
        for batch in batches:
            own, y = (batch.column(i).to_pylist() for i in (0, 1))
            logits = [float(net.logits(encode([("", c, "")]))[0]) for c in own]
            yield pa.RecordBatch.from_arrays(
                [pa.array(logits, pa.float64()), pa.array(y, pa.int32())], ["logit", "y"])

    rows = materialised(judged.select("own", "y").mapInArrow(run, "logit double, y int"))

    def loss(t):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("logit") / t))))
        p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
        return F.avg(-F.when(F.col("y") == 1, F.log(p)).otherwise(F.log(1 - p)))

    heats = (0.25, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0)
    *losses, secrets = rows.agg(*[loss(t) for t in heats], F.sum("y")).first()
    net.temperature = heats[losses.index(min(losses))]
    curve = materialised(score_curve(rows, "y", "logit"))
    score, held = F.col("score"), F.col("cum_pos")
    highest, pure = curve.agg(
        F.max(F.when(held >= secrets - int((1 - recall) * secrets), score)),
        F.min(F.when(held / (held + F.col("cum_neg")) >= precision, score))).first()
    least = highest if pure is None else pure
    wrong = curve.where((F.col("neg") > 0) & (score < least)).agg(F.max(score)).first()[0]
    middle = (highest + (highest if wrong is None else wrong)) / 2
    net.threshold = float(1 / (1 + np.exp(-np.clip(min(middle, highest) / net.temperature,
                                                   -30, 30))))


def fit_findings(rows: DataFrame, recall: float = 0.95, precision: float = 0.99, epochs: int = 12,
                 seed: int = 7) -> SecretNetwork:
    """Trains on four fifths of the findings; calibrates and sets the threshold on the rest.

    Findings are dealt to parts of about ``PART``. In each of ``epochs`` rounds all parts train from the
    same state, in tasks, and their states are averaged; so every finding counts, and
    neither the driver nor a task holds more than one part.

    On the rest, with the context hidden, a threshold may be no higher than the score that still finds
    ``recall`` of the secrets, and should be no lower than the score from which ``precision`` of
    what passes are secrets. It is put in the middle, on the scale of the network's output; where
    both can't be met, recall counts.
    """
    net = SecretNetwork.start(seed)
    digest = F.sha2(F.concat_ws("\0", "before", "own", "after"), 256)
    rows = materialised(rows.withColumn("aside", F.conv(F.substring(digest, 1, 8), 16, 10)
                                        .cast("long") % 5 == 0))
    n = {(r["aside"], r["y"]): r["n"] for r in
         rows.groupBy("aside", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    both = [n.get((False, y), 0) + n.get((True, y), 0) for y in (0, 1)]
    if not all(both):
        return net
    if all(n.get((side, y), 0) for side in (False, True) for y in (0, 1)):
        kept, judged = rows.where("NOT aside"), rows.where("aside")
        both = [n[False, y] for y in (0, 1)]
    else:
        kept = judged = rows
    total = sum(both)
    dealt, parts = _dealt(kept, total)
    share = {y: 0.5 * total / both[y] for y in (0, 1)}
    batches = max(1, total // parts // 64)
    passes = -(-max(epochs, -(-LEAST_STEPS // batches)) // epochs)
    state = flat_state(net)
    for turn in range(epochs):
        state = _round(dealt, state, share, total, passes, turn * passes * batches, seed, turn)
        state[2 * len(state) // 3:] = np.maximum(state[2 * len(state) // 3:], 0.0)
    load_state(net, state)
    _calibrate(net, judged, recall, precision)
    return net


def fit(windows: list[tuple[str, str, str]], labels: list[int], **fitting) -> SecretNetwork:
    """:func:`fit_findings` of findings given as lists."""
    if not 0 < sum(labels) < len(labels):
        return SecretNetwork.start(fitting.get("seed", 7))
    spark = SparkSession.getActiveSession()
    return fit_findings(spark.createDataFrame(
        [(*w, int(y)) for w, y in zip(windows, labels)],
        "before string, own string, after string, y int"), **fitting)


def labelled_findings(docs: DataFrame, per_class: int | None = None) -> DataFrame:
    """(before, own, after, y): values of base findings, and candidates that touch none of them,
    among them runs without a digit. None is longer than ``LONGEST``. Each once, however often it stands in the texts. All of
    them, unless ``per_class`` asks for so many of each class, those with the smallest hash.
    """
    def run(batches):
        for batch, values in blocks(batches):
            rows = []
            for text in values:
                spans = base_spans(text)
                for s, e, kind in spans:
                    if kind == "assign":
                        s = ASSIGN.match(text, s).start(2)
                    rows.append((*window(text, s, e), 1))
                for s, e in candidates(text, plain=True):
                    if all(e <= a or b <= s for a, b, _ in spans):
                        rows.append((*window(text, s, e), 0))
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string()) for c in cols[:3]] + [pa.array(cols[3], pa.int32())],
                ["before", "own", "after", "y"])

    rows = texts(docs).mapInArrow(run, "before string, own string, after string, y int")
    rows = rows.where(F.length("own") <= LONGEST).distinct()
    if per_class is None:
        return rows
    key = F.xxhash64("before", "own", "after")
    return (rows.filter("y = 0").orderBy(key, "before", "own", "after").limit(per_class)
            .unionAll(rows.filter("y = 1").orderBy(key, "before", "own", "after")
                      .limit(per_class)))


def train(docs: DataFrame, per_class: int | None = None, **fitting) -> SecretNetwork:
    """A network fitted on the findings that :func:`labelled_findings` takes from ``docs``."""
    return fit_findings(labelled_findings(docs, per_class), **fitting)


def all_spans(values: list[str], net: SecretNetwork) -> list[tuple[list, list]]:
    """Per text its base findings and all findings."""
    base = [base_spans(t) for t in values]
    asked, windows = [], []
    for i, text in enumerate(values):
        for s, e in candidates(text):
            if all(e <= a or b <= s for a, b, _ in base[i]):
                asked.append((i, s, e))
                windows.append(window(text, s, e))
    more: dict[int, list] = {}
    if windows:
        for (i, s, e), p in zip(asked, net.scores(windows)):
            if p >= net.threshold:
                more.setdefault(i, []).append((s, e, MODEL_KIND))
    order = {k: i for i, k in enumerate((*KINDS, MODEL_KIND))}
    return [(b, sorted(b + more.get(i, []), key=lambda x: (x[0], order[x[2]], x[1])))
            for i, b in enumerate(base)]


def scan(docs: DataFrame, net: SecretNetwork) -> DataFrame:
    """Per document the base findings and all findings, as arrays of (start, end, kind)."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()),
                               ("kind", pa.string())]))

    def run(batches):
        for batch, values in blocks(batches):
            found = all_spans(values, shared.value)
            cols = [pa.array([[dict(start=s, end=e, kind=k) for s, e, k in f[i]] for f in found],
                             span) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols],
                                             ["doc_id", "base", "spans"])

    kind = "array<struct<start:long,end:long,kind:string>>"
    return texts(docs).mapInArrow(run, f"doc_id long, base {kind}, spans {kind}")


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every finding replaced; findings that overlap are replaced together."""
    out, at, end = [], 0, -1
    for s, e, _ in sorted(spans):
        if s >= end:
            out += [text[at:s], "[REDACTED]"]
            end = e
        at = end = max(end, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, net: SecretNetwork, length_col: str = "n_chars") -> DataFrame:
    """All documents and columns, findings in the text replaced, the length column renewed.

    Texts without findings, and their length, stay as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index("text")
    size = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches):
        for batch, values in blocks(batches, at):
            found = all_spans(values, shared.value)
            hit = {i: redacted(values[i], f[1]) for i, f in enumerate(found) if f[1]}
            cols = list(batch.columns)
            if hit:
                old = cols[at].to_pylist()
                cols[at] = pa.array([hit.get(i, t) for i, t in enumerate(old)], cols[at].type)
                if size is not None:
                    old = cols[size].to_pylist()
                    cols[size] = pa.array([len(hit[i]) if i in hit else n
                                           for i, n in enumerate(old)], cols[size].type)
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)

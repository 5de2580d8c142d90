"""Secrets in texts: fixed patterns, and a character convolutional network.

The patterns give the base spans. The network reads every candidate, a run of
16 or more key characters, with the characters around it, and adds those it
takes for keys, whether or not a base span touches them. A run of which a
pattern hits a part is so reported whole beside that part. The network is
trained on labelled findings: the candidates of all documents, labelled by the
patterns, and findings drawn by rule. It starts from drawn findings; then the
distinct findings of the documents lie in blocks, each round trains a copy of
the network on every block in its own task, and the copies are averaged. Its
scores are calibrated on all findings kept back, and the threshold is the
highest that still finds the wanted share of them."""

from __future__ import annotations

import copy
import hashlib
import re
from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from marketloom.operators.ranking import value_ranks
from marketloom.session import cut_lineage

KINDS = ("assign", "access", "hex")
ADDED = "model"
#: Findings of a block, and rounds over all blocks. Beyond LABEL_WEIGHT findings the more frequent label weighs no more than the other.
BLOCK_FINDINGS, PASSES, LABEL_WEIGHT = 4_096, 4, 1_500
#: Least number of drawn findings (a fifth of it); drawn ones to one of the documents, by weight; one finding in KEPT is kept for the calibration.
DRAWN, DRAWN_SHARE, KEPT = 1_200, 2, 5
RECALL = 0.98
#: Characters before a candidate, of it, and behind it that the network reads. A longer candidate is read in windows that overlap by half.
BEFORE, BODY, BEHIND = 24, 64, 8
WIDTH, FILTERS, DEPTH, ROUNDS, RATE, LATER_RATE = 5, 24, 12, 3, 0.003, 0.002
#: Averaged values are summed as whole numbers of this unit, so that no order of tasks matters.
UNIT = 2.0 ** -32

_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_SHORTEST = 16
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{_SHORTEST},}}+")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, in code points."""
    low = text.lower()
    spans = []
    if any(k in low for k in _KEYWORDS):
        spans = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    spans += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    spans += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return spans


def candidates(text: str) -> list[tuple[int, int]]:
    """Whole runs of 16 or more key characters."""
    return [m.span() for m in _CANDIDATE.finditer(text)]


#: Codes: 1 to 95 for printable ASCII, 96 for anything else, 0 for no character; those of the characters around a candidate are 96 more.
def _codes(text: str, length: int, right: bool = False, around: int = 0) -> list[int]:
    codes = [(ord(c) - 31 if " " <= c <= "~" else 96) + around for c in text]
    pad = [0] * (length - len(codes))
    return pad + codes if right else codes + pad


def window(text: str, start: int, end: int) -> list[int]:
    return _codes(text[max(0, start - BEFORE):start], BEFORE, True, 96) + _codes(text[start:end], BODY) + _codes(text[end:end + BEHIND], BEHIND, around=96)


def parts(start: int, end: int) -> Iterator[tuple[int, int]]:
    """The whole candidate, or overlapping windows of BODY characters that cover a longer one."""
    while end - start > BODY:
        yield start, start + BODY
        start = min(start + BODY // 2, end - BODY)
    yield start, end


class Network:
    """Embedded characters, one convolution with the largest and the mean
    response of each filter over the candidate, and a logistic output."""

    def __init__(self, seed: int = 5) -> None:
        draw = np.random.default_rng(seed)
        self.values = {"embed": draw.normal(0, 0.3, (193, DEPTH)), "filters": draw.normal(0, (WIDTH * DEPTH) ** -0.5, (WIDTH * DEPTH, FILTERS)),
                       "bias": np.zeros(FILTERS), "out": draw.normal(0, 0.2, 2 * FILTERS), "level": np.zeros(1)}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, codes: np.ndarray):
        v = self.values
        embedded = v["embed"][codes] * (codes > 0)[:, :, None]
        spans = np.lib.stride_tricks.sliding_window_view(embedded, WIDTH, axis=1).transpose(0, 1, 3, 2)
        spans = spans.reshape(len(codes), -1, WIDTH * DEPTH)
        sums = spans @ v["filters"] + v["bias"]
        active = np.maximum(sums, 0)
        peak = active.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(active, peak[:, None, :], 1)[:, 0], active.mean(axis=1)], axis=1)
        return spans, sums, peak, pooled, pooled @ v["out"] + v["level"][0]

    def logits(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(codes[i:i + 512])[-1] for i in range(0, len(codes), 512)]) if len(codes) else np.empty(0)

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        return self._curve(self.logits(codes))

    def _curve(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -50, 50)))

    def train(self, codes: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None, rounds: int = ROUNDS, rate: float = RATE) -> None:
        weights = np.ones(len(labels)) if weights is None else weights
        draw = np.random.default_rng(9)
        first = {k: np.zeros_like(x) for k, x in self.values.items()}
        second = {k: np.zeros_like(x) for k, x in self.values.items()}
        turn = 0
        for _ in range(rounds):
            order = draw.permutation(len(codes))
            for at in range(0, len(order), 64):
                pick = order[at:at + 64]
                slopes = self._slopes(codes[pick], labels[pick], weights[pick])
                turn += 1
                for k, slope in slopes.items():
                    first[k] = 0.9 * first[k] + 0.1 * slope
                    second[k] = 0.999 * second[k] + 0.001 * slope ** 2
                    self.values[k] = self.values[k] - rate * (first[k] / (1 - 0.9 ** turn)) / (np.sqrt(second[k] / (1 - 0.999 ** turn)) + 1e-8)

    def _slopes(self, codes: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> dict[str, np.ndarray]:
        v = self.values
        spans, sums, peak, pooled, logits = self._forward(codes)
        error = (1 / (1 + np.exp(-np.clip(logits, -50, 50))) - labels)
        error = error / len(labels) if weights is None else error * weights / weights.sum()
        at_pool = error[:, None] * v["out"]
        at_active = np.repeat(at_pool[:, None, FILTERS:] / sums.shape[1], sums.shape[1], axis=1)
        np.put_along_axis(at_active, peak[:, None, :], np.take_along_axis(at_active, peak[:, None, :], 1) + at_pool[:, None, :FILTERS], 1)
        at_sums = at_active * (sums > 0)
        at_spans = (at_sums @ v["filters"].T).reshape(len(codes), -1, WIDTH, DEPTH)
        at_embedded = np.zeros((len(codes), codes.shape[1], DEPTH))
        for k in range(WIDTH):
            at_embedded[:, k:k + at_spans.shape[1]] += at_spans[:, :, k]
        embed = np.zeros_like(v["embed"])
        np.add.at(embed, codes, at_embedded * (codes > 0)[:, :, None])
        return {"embed": embed, "filters": np.einsum("nlk,nlf->kf", spans, at_sums), "bias": at_sums.sum(axis=(0, 1)),
                "out": pooled.T @ error + 1e-4 * v["out"], "level": np.array([error.sum()])}

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.values.values()])

    def take(self, flat: np.ndarray) -> None:
        for k, x in self.values.items():
            self.values[k], flat = flat[:x.size].reshape(x.shape), flat[x.size:]

    def calibrate(self, found: DataFrame) -> None:
        """A logistic curve over all kept findings (logit, label, weight), and
        the highest threshold that finds RECALL of the keys among them."""
        rows = found.select(F.array("logit").alias("x"), F.col("label").cast("double").alias("label"), "weight")
        curve = LogisticRegression(weightCol="weight", regParam=1e-4).fit(rows.withColumn("features", array_to_vector("x")))
        self.scale, self.shift = float(curve.coefficients[0]), float(curve.intercept)
        ranks = value_ranks(found.where("label = 1"), [], "logit", "weight")
        missed = F.lit(1 - RECALL) * found.where("label = 1").agg(F.sum("weight")).scalar()
        lowest = ranks.where(F.col("below") <= missed).agg(F.max("logit")).first()[0]
        if lowest is not None:
            self.threshold = float(self._curve(np.array([lowest]))[0])


def drawn_findings(n: int = DRAWN, seed: int | list[int] = 3) -> list[tuple[list[int], int]]:
    """Findings made by rule: keys of common layouts in a line, and other long
    runs of key characters (dates, paths, identifiers, numbered words)."""
    draw = np.random.default_rng(seed)
    low, high, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda letters, k: "".join(letters[i] for i in draw.integers(0, len(letters), k))
    word = lambda: "".join(("th", "en", "ra", "to", "li", "co", "mi", "ne", "sa", "or")[i] for i in draw.integers(0, 10, draw.integers(1, 4)))
    out = []
    for i in range(n):
        size = int(draw.integers(18, 48))
        if i % 2:
            key = [some(low + high + digit, size), some("0123456789abcdef", size + 6), some(high + digit, size), some(low + high + digit + "+/", size) + "=",
                   "_".join((some(low, 2), some(low, 4), some(low + high + digit, size))), some(low + digit, size)][i // 2 % 6]
        else:
            number = int(draw.integers(1, 4000))
            key = ["-".join((word(), word(), word(), word(), str(number))), f"{word()}_{word()}_{word()}_{word()}_{number}",
                   f"{word()}/{word()}/{word()}/{word()}/{number}", f"20{number % 30:02d}-{number % 12 + 1:02d}-{number % 28 + 1:02d}T{number % 24:02d}-00-00",
                   word() + word() + word() + word() + word() + str(number % 100), f"IMG_20{number % 30:02d}{number % 12 + 1:02d}11_{number:06d}",
                   f"{word()}-v{number % 9}-{word()}-{number % 99}-{word()}", some("a", 16) + str(number)][i // 2 % 8]
            key = key if len(key) >= _SHORTEST else key + "-" + word() + word() + "-0" + word()
        text = f"{word()} {word()} {('', 'key: ', 'id ', 'is ', '= ')[i % 5]}{key} {word()} {word()}"
        start = text.index(key)
        out += [(window(text, *part), i % 2) for part in parts(start, start + len(key))]
    return out


_SYLLABLES = ("the", "en", "ra", "to", "li", "com", "mi", "ne", "sa", "or", "ver", "schaft", "fahrt", "ung", "keit", "pre", "tion", "ment", "al", "ge", "stra", "ly", "ci", "ble",
              "dampf", "in", "er", "inter", "na", "ness", "que", "mar", "pro", "able", "un", "ter", "ism", "ique", "haupt", "ver", "bo", "du", "ki", "wa", "phy", "og",
              "file", "name", "path", "data", "main", "log", "test", "user", "list", "page")


def drawn_runs(n: int = 4 * DRAWN, seed: int | list[int] = 4) -> list[tuple[list[int], int]]:
    """Findings made by rule: keys of letters only or of digits only in a line,
    and long words, names, paths, numbers and rulers."""
    draw = np.random.default_rng(seed)
    low, high, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda letters, k: "".join(letters[i] for i in draw.integers(0, len(letters), k))
    word = lambda: "".join(_SYLLABLES[i] for i in draw.integers(0, len(_SYLLABLES), draw.integers(1, 4)))
    out = []
    for i in range(n):
        size = int(draw.integers(18, 48))
        if i % 2:
            key = [some(low + high, size), some(low, size), some(high, size), some(digit, size + 14)][i // 2 % 4]
        else:
            words = [word() for _ in range(6)]
            key = ["".join(words), "".join(words).title(), "".join(w.title() for w in words), "_".join(words).upper(), "-".join(words), "/".join(words),
                   "/".join(words[:3]) + "-" + words[3] + "-" + some(digit, 4), some(digit, 16), some(digit, 16), "20" + some(digit, 14 + size % 4), some(digit, 16 + size % 3), "-=_/+"[size % 5] * size][i // 2 % 12]
            key = key if len(key) >= _SHORTEST else key + "schaftlichkeiten"
        head = f"{word()} {word()}{(' ', ' key: ', ' id ', ' is ', ' = ', '; see ', ', ', ' (', ' card ')[draw.integers(0, 9)]}"
        head = some(low + high + digit, 30) + head[-12:] if i % 6 == 0 else head
        text, start = f"{head}{key}{(' ', '. ', ', ', ') ')[draw.integers(0, 4)]}{word()} {word()}", len(head)
        out += [(window(text, *part), i % 2) for part in parts(start, start + len(key))]
    return out


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes, labels = [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            runs = candidates(text)
            base = base_spans(text) if runs else []
            for a, b in (part for run in runs for part in parts(*run)):
                codes.append(bytes(window(text, a, b)))
                labels.append(int(any(a < e and s < b for _, s, e in base)))
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.binary()), pa.array(labels, pa.int32())], ["codes", "label"])


def _read(codes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(codes), np.uint8).reshape(-1, BEFORE + BODY + BEHIND).astype(int)


def _trained(batches: Iterator[pa.RecordBatch], network: Network, weights: dict[int, float], least: int, turn: int) -> Iterator[pa.RecordBatch]:
    """The values of a copy of the network trained on each block and on as many
    drawn findings as its weight asks for, `least` for each fifth at least, in
    whole UNITs by position."""
    for batch in batches:
        for row in batch.to_pylist():
            codes, labels = _read([f["codes"] for f in row["findings"]]), np.array([f["label"] for f in row["findings"]], float)
            weight = np.array([weights[int(y)] for y in labels])
            n = max(least, int(np.ceil(DRAWN_SHARE * weight.sum() / 5)))
            drawn = drawn_findings(n, [3, turn, row["block"]]) + drawn_runs(4 * n, [4, turn, row["block"]])
            own = copy.deepcopy(network)
            own.train(np.concatenate([codes, np.array([c for c, _ in drawn])]), np.concatenate([labels, [y for _, y in drawn]]),
                      np.concatenate([weight, np.ones(len(drawn))]), 1, LATER_RATE)
            flat = own.flat()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(np.rint(flat / UNIT).astype(np.int64))], ["place", "units"])


def _scored(batches: Iterator[pa.RecordBatch], network: Network) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(network.logits(_read(batch.column("codes").to_pylist())), pa.float64()), batch.column("label")], ["logit", "label"])


def findings(docs: DataFrame) -> DataFrame:
    """(codes, label), the distinct labelled candidates of all documents."""
    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_learn, "codes binary, label int").distinct()


def fit(docs: DataFrame) -> Network:
    """A network from the findings of all documents and from drawn ones, of which
    one in KEPT is kept for the calibration. The driver holds drawn findings,
    counts and the network's values only."""
    found = cut_lineage(findings(docs).withColumn("kept", F.pmod(F.xxhash64(F.lit("kept"), "codes", "label"), F.lit(KEPT)) == 0), "findings")
    counts = {(r["label"], r["kept"]): r["count"] for r in found.groupBy("label", "kept").count().collect()}
    number = {label: sum(n for (y, _), n in counts.items() if y == label) for label in (0, 1)}
    weights = {label: min(1.0, max(LABEL_WEIGHT, min(number.values())) / max(1, n)) for label, n in number.items()}

    drawn = drawn_findings() + drawn_runs()
    codes, labels = np.array([c for c, _ in drawn]), np.array([y for _, y in drawn], float)
    back = np.random.default_rng(1).random(len(codes)) < 1 / KEPT
    network = Network()
    network.train(codes[~back], labels[~back])

    blocks = -(-sum(n for (_, kept), n in counts.items() if not kept) // BLOCK_FINDINGS)
    if blocks:
        dealt = found.where("NOT kept").withColumn("block", F.pmod(F.xxhash64("codes", "label"), F.lit(blocks)).cast("int")).repartitionByRange(blocks, "block")
        packed = cut_lineage(dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("codes", "label"))).alias("findings")), "finding-blocks")
        for turn in range(PASSES):
            step = packed.mapInArrow(partial(_trained, network=network, weights=weights, least=-(-DRAWN // blocks), turn=turn), "place int, units long")
            mean = step.groupBy("place").agg(F.sum("units").alias("units"), F.count("*").alias("n")).orderBy("place").collect()
            network.take(np.array([r["units"] / r["n"] * UNIT for r in mean]))

    own = found.where("kept").mapInArrow(partial(_scored, network=network), "logit double, label int")
    own = own.withColumn("weight", F.when(F.col("label") == 1, weights[1]).otherwise(weights[0]))
    whole = sum(n * weights[y] for (y, kept), n in counts.items() if kept)
    share = max(1.0, DRAWN_SHARE * whole / int(back.sum()))
    rest = found.sparkSession.createDataFrame([(float(x), int(y), share) for x, y in zip(network.logits(codes[back]), labels[back])], "logit double, label int, weight double")
    network.calibrate(cut_lineage(own.unionByName(rest), "finding-logits"))
    return network


def joined(spans: list[tuple[str, int, int]]) -> str:
    order = (*KINDS, ADDED)
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(set(spans), key=lambda s: (s[1], order.index(s[0]), s[2])))


def find_all(texts: list[str | None], network: Network) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """(base spans, all spans) of every text; candidates of a batch, those that
    touch a base span among them, are scored together. A candidate is added if
    the largest score of its windows reaches the network's threshold."""
    base = [base_spans(t or "") for t in texts]
    every = [list(b) for b in base]
    windows = ((i, run, part) for i, t in enumerate(texts) for run in candidates(t or "") for part in parts(*run))
    added: dict[tuple[int, tuple[int, int]], None] = {}
    while some := list(islice(windows, 4096)):
        scores = network.probabilities(np.array([window(texts[i], *part) for i, _, part in some]))
        added.update({(i, run): None for (i, run, _), p in zip(some, scores) if p >= network.threshold})
    for i, (a, b) in added:
        every[i].append((ADDED, a, b))
    return list(zip(base, every))


def _apply(batches: Iterator[pa.RecordBatch], network: Network) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = find_all(part.column("text").to_pylist(), network)
            count = [[sum(s[0] == k for s in b) for b, _ in found] for k in KINDS]
            digest = [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in count), pa.array(digest, pa.string()),
                                              pa.array([joined(e) for _, e in found], pa.string())],
                                             ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans), one row for each
    row of `docs`. The counts and the digest are of the base spans; `spans` has
    those and the added ones. A null text is an empty one. Only doc_id and text
    are read."""
    network = fit(docs)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(lambda it: _apply(it, network), f"doc_id long, {counts}, base_sha256 string, spans string")

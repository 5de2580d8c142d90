"""Personal data in texts: fixed patterns, and a linear-chain conditional random field.

The patterns give the base spans. The field labels tokens near digits, at signs
and spelled-out ones ("(at)", "{AT}", "at example dot net") by their shapes and adds what the patterns' letters miss: addresses that
are spelled out, numbers without a plus sign or with other separators. It is
trained from a small labelled table: the base spans of a bounded sample of
documents, those spans written in other ways, and the marked lines below. It is
decoded by Viterbi in numpy over batches of sequences."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone")
#: Documents whose spans are learned from at most, and sequences of them.
FIT_DOCS, FIT_SEQUENCES = 4_000, 2_000
#: Tokens on either side of a token with a digit or an at sign, written or spelled out, and the characters they are looked for in.
CONTEXT, REACH = 3, 80
#: Tokens that are decoded as one chain at most; a longer run is cut into several.
CHAIN = 256
BUCKETS, ROUNDS, RATE, SHRINK = 1 << 13, 15, 0.3, 1e-4

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){12,}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOT = r"(?:\s*+[(\[{]\s*+dot\s*+[)\]}]\s*+|\s++dot\s++|\.(?=\w)|\s++\.\s++)[\w-]++"
#: Digits, at signs, and spelled-out ones with the host behind them: in brackets, or bare before a word with a dot behind it.
_TRIGGER = re.compile(rf"[0-9@]+|[(\[{{]\s*+at\s*+[)\]}}](?:\s*+[\w-]++(?:{_DOT})*+)?|(?<=\s)at\s++[\w-]++(?:{_DOT})++", re.I)
_TOKEN = re.compile(r"\S+")

#: Marked lines, as [kind:text] (fixed values).
MARKED = """call me at [phone:555-123-4567] today
my phone is [phone:(212) 555-0147] thanks
tel [phone:020 7946 0958] or fax
phone: [phone:+44 20 7946 0958].
mobile [phone:0151.234.5678] please
reach us on [phone:1-800-555-0199]
write to [email:jane.doe (at) example (dot) com] soon
mail [email:john [at] mail [dot] org] now
contact [email:info at example dot net] for help
ask [email:jo.park (AT) mail (DOT) org] or wait
try [email:kim {at} post {dot} com] first
see [email:sales ( at ) shop ( dot ) net] there
write [email:OFFICE AT EXAMPLE DOT ORG] today
mail [email:bob [at] post.org] or [email:tim.ray [at] shop.net] soon
reach [email:eve.adams at web dot org] now or [email:tom at mail dot web dot com] later
email [email:a.b@mail.example.com] is mine
the server [ip:10.0.0.12] is down
host [ip:192.168.1.20:8080] answers
from [ip:172.16.4.9] to [ip:172.16.4.10]
card [card:4111 1111 1111 1111] exp 12/26
pay with [card:5500-0000-0000-0004] now
number [card:4111.1111.1111.1111] was used
version 1.2.3 of 2024-01-15 costs 1,299.00 euro
in 1999 and 2020 there were 12000 of 35 items
section 3.1.4 on page 12 line 7
order 100200300 of 10:30 has 5 parts
build 20240115123456 id 0000123456789012345678901234567890
token 9a8b99b6f89edc9746a2ef7e89e21f68bcb4543d and 0xff12
ratio 3.14159265 or 2,718 at 99.9% on 4x4 in A4
see @handle and #42 at 5 pm
ISBN 978-3-16-148410-0 and 12/31/1999"""


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[0::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in text.split("."))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """One pass over the at signs: the local part is the run before one, so no
    run of characters is read twice."""
    done, at = 0, text.find("@")
    while at >= 0:
        if at >= done:
            start = at
            while start > done and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                yield start, m.end()
                done = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, in code points, by kind and start."""
    spans = [("email", a, b) for a, b in _emails(text)]
    spans += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _octets(m.group())]
    spans += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    spans += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return spans


def chains(text: str) -> list[list[tuple[int, int]]]:
    """Token spans around every token with a digit or an at sign, written or spelled out."""
    out, done = [], 0
    triggers = [m.span() for m in _TRIGGER.finditer(text)]
    for k, (first, behind) in enumerate(triggers):
        if behind <= done:
            continue
        first = start = max(first, done)
        before = [t.start() for t in _TOKEN.finditer(text, max(done, start - REACH), start)]
        start = before[-(CONTEXT + 1):][0] if before else start
        if start > done and not text[start - 1].isspace():  # the window cut this token
            while start > done and not text[start - 1].isspace():
                start -= 1
        tokens, last = [], 0
        for t in _TOKEN.finditer(text, start):
            tokens.append(t.span())
            while k < len(triggers) and triggers[k][1] <= t.start():
                k += 1
            last = 0 if k < len(triggers) and triggers[k][0] < t.end() else last + 1
            if last > CONTEXT and t.start() > first or len(tokens) == CHAIN:
                break
        if tokens:
            done = tokens[-1][1]
            out.append(tokens)
    return out


def shape(token: str) -> str:
    """Letters and digits by class, runs of a class written once."""
    s = re.sub(r"[^\W\d_]", lambda m: "X" if m.group().isupper() else "x", token)
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[0-9]", "d", s))


def _hash(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % BUCKETS


def token_features(text: str, spans: list[tuple[int, int]]) -> list[list[int]]:
    tokens = [text[a:b] for a, b in spans]
    shapes = [shape(t)[:24] for t in tokens]
    words = [t.lower().strip(".,:;()[]{}") if t.strip(".,:;()[]{}").isalpha() and len(t) < 12 else "" for t in tokens]
    out = []
    for i, t in enumerate(tokens):
        d, s = _digits(t), shapes[i]
        near = [(shapes[j] if 0 <= j < len(tokens) else "|", words[j] if 0 <= j < len(tokens) else "") for j in (i - 2, i - 1, i + 1, i + 2)]
        names = ["1", f"s{s}", f"n{min(len(d), 20)}", f"l{min(len(t), 20) // 2}", f"w{words[i]}", f"a{s[0]}", f"z{s[-1]}", f"g{re.sub('[0-9]+', lambda m: str(len(m.group())), t)[:24] if d else ''}",
                 f"@{'@' in t}{t.count('.')}", f"u{luhn(d) if 13 <= len(d) <= 19 else ''}", f"o{_octets(m.group()) if (m := _IP.search(t)) else ''}"]
        names += [f"{k}s{a}" for k, (a, _) in zip("abcd", near)] + [f"{k}w{b}" for k, (_, b) in zip("abcd", near) if b]
        names += [f"p{near[1][0]}>{s}", f"q{s}>{near[2][0]}"]
        out.append([_hash(n) for n in names])
    return out


TAGS = ["O", *(f"{b}-{k}" for k in KINDS for b in "BI")]


def _tags(spans: list[tuple[int, int]], marks: list[tuple[str, int, int]]) -> list[int]:
    tags = []
    for a, b in spans:
        hit = next(((k, s) for k, s, e in marks if a < e and s < b), None)
        tags.append(0 if hit is None else TAGS.index(("B-" if hit[1] >= a else "I-") + hit[0]))
    return tags


def _marked(line: str) -> tuple[str, list[tuple[str, int, int]]]:
    text, marks, at = "", [], 0
    for m in re.finditer(r"\[(email|ip|card|phone):((?:[^\[\]]|\[\w+\])+)\]", line):
        text += line[at:m.start()]
        marks.append((m[1], len(text), len(text) + len(m[2])))
        text += m[2]
        at = m.end()
    return text + line[at:], marks


def _rewritten(kind: str, span: str) -> list[str]:
    """The same datum in ways the patterns do not know."""
    d = _digits(span)
    if kind == "phone" and len(d) >= 10:
        n = d[-10:]
        return [f"({n[:3]}) {n[3:6]}-{n[6:]}", f"{n[:3]}-{n[3:6]}-{n[6:]}", f"{n[:3]}.{n[3:6]}.{n[6:]}"]
    if kind == "email":
        name, _, host = span.partition("@")
        return [f"{name} (at) {host.replace('.', ' (dot) ')}", f"{name} at {host.replace('.', ' dot ')}", f"{name} [at] {host}",
                f"{name} (AT) {host.replace('.', ' (DOT) ')}", f"{name} {{at}} {host.replace('.', ' {dot} ')}", f"{name} ( at ) {host.replace('.', ' ( dot ) ')}"]
    if kind == "card":
        return [".".join(d[i:i + 4] for i in range(0, len(d), 4)), "/".join(d[i:i + 4] for i in range(0, len(d), 4))]
    return []


def _examples(text: str) -> Iterator[tuple[list[list[int]], list[int]]]:
    """Sequences of a document with the tags of its base spans, and of the
    same passages with a span written otherwise."""
    spans = base_spans(text)
    for tokens in chains(text):
        low, high = tokens[0][0], tokens[-1][1]
        own = [(k, a - low, b - low) for k, a, b in spans if low <= a and b <= high]
        part = text[low:high]
        moved = [(a - low, b - low) for a, b in tokens]
        # whether a spelled-out at sign is an address is not known here, so such a passage teaches nothing
        if all(m[0][0] in "0123456789@" for m in _TRIGGER.finditer(part)):
            yield token_features(part, moved), _tags(moved, own)
        for k, a, b in own[:2]:
            for form in _rewritten(k, part[a:b]):
                left, right = part[:a].split()[-CONTEXT:], part[b:].split()[:CONTEXT]
                head = " ".join(left) + " " if left else ""
                changed = f"{head}{form} {' '.join(right)}".strip()
                again = [m.span() for m in _TOKEN.finditer(changed)]
                marks = [(k, len(head), len(head) + len(form))] + base_spans(" " * (len(head) + len(form)) + changed[len(head) + len(form):])
                yield token_features(changed, again), _tags(again, marks)


class Field:
    """Weights of a linear-chain field: features by tags, and tag to tag."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray) -> None:
        self.weights, self.moves = weights, moves

    def scores(self, sequences: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        longest = max(map(len, sequences))
        out = np.zeros((len(sequences), longest, len(TAGS)))
        for i, seq in enumerate(sequences):
            lengths = [len(f) for f in seq]
            flat = self.weights[np.concatenate([np.asarray(f) for f in seq])]
            out[i, :len(seq)] = np.add.reduceat(flat, np.concatenate([[0], np.cumsum(lengths)[:-1]]), axis=0)
        return out, np.array([len(s) for s in sequences])

    def decode(self, sequences: list[list[list[int]]]) -> list[list[int]]:
        """Viterbi over a batch: one array step for each position."""
        if not sequences:
            return []
        scores, lengths = self.scores(sequences)
        n, longest, k = scores.shape
        best, back = scores[:, 0], np.zeros((n, longest, k), np.int8)
        for t in range(1, longest):
            paths = best[:, :, None] + self.moves
            back[:, t] = paths.argmax(axis=1)
            step = paths.max(axis=1) + scores[:, t]
            best = np.where((t < lengths)[:, None], step, best)
        tags = np.zeros((n, longest), int)
        last = best.argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            tags[:, t] = last
            inside = (t > 0) & (t < lengths)
            last = np.where(inside, back[np.arange(n), t, last], last)
        return [tags[i, :m].tolist() for i, m in enumerate(lengths)]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(examples: list[tuple[list[list[int]], list[int]]]) -> Field:
    """Maximum likelihood by forward-backward and adaptive gradient steps over
    batches of sequences of like length."""
    k = len(TAGS)
    field = Field(np.zeros((BUCKETS, k)), np.zeros((k, k)))
    seen = np.full_like(field.weights, 1e-6), np.full_like(field.moves, 1e-6)
    examples = sorted((e for e in examples if e[1]), key=lambda e: len(e[1]))
    batches = [examples[i:i + 128] for i in range(0, len(examples), 128)]
    order = np.random.default_rng(11)
    for _ in range(ROUNDS):
        for which in order.permutation(len(batches)):
            batch = batches[which]
            scores, lengths = field.scores([f for f, _ in batch])
            n, longest, _ = scores.shape
            there = np.arange(longest)[None, :] < lengths[:, None]
            ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
            ahead[:, 0] = scores[:, 0]
            for t in range(1, longest):
                ahead[:, t] = _logsum(ahead[:, t - 1][:, :, None] + field.moves, 1) + scores[:, t]
            for t in range(longest - 2, -1, -1):
                step = _logsum(field.moves + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
                behind[:, t] = np.where((t + 1 < lengths)[:, None], step, 0.0)
            total = _logsum(ahead[np.arange(n), lengths - 1], 1)
            marginal = np.exp(ahead + behind - total[:, None, None]) * there[:, :, None]
            moves = np.zeros((k, k))
            for t in range(1, longest):
                live = t < lengths
                pair = ahead[:, t - 1][:, :, None] + field.moves + (scores[:, t] + behind[:, t])[:, None, :] - total[:, None, None]
                moves -= np.exp(pair[live]).sum(axis=0)
            slope = np.zeros_like(field.weights)
            gap = -marginal[there]
            gap[np.arange(len(gap)), [t for _, tags in batch for t in tags]] += 1
            flat = [f for features, _ in batch for f in features]
            np.add.at(slope, np.concatenate([np.asarray(f) for f in flat]), np.repeat(gap, [len(f) for f in flat], axis=0))
            for _, tags in batch:
                np.add.at(moves, (tags[:-1], tags[1:]), 1)
            for at, (value, step) in enumerate(((field.weights, slope), (field.moves, moves))):
                step -= SHRINK * len(batch) * value
                seen[at][...] += step ** 2
                value += RATE * step / np.sqrt(seen[at] + 1)
    return field


def _sane(kind: str, span: str) -> bool:
    d = _digits(span)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(d) <= 15
    if kind == "ip":
        return (m := _IP.search(span)) is not None and _octets(m.group())
    return "@" in span or re.search(r"\bat\b", span, re.I) is not None and re.search(r"\.|\bdot\b", span, re.I) is not None


def added_spans(text: str, base: list[tuple[str, int, int]], tokens: list[tuple[int, int]], tags: list[int]) -> list[tuple[str, int, int]]:
    """Spans of one decoded chain that touch no base span."""
    out, at = [], 0
    while at < len(tags):
        if tags[at] == 0:
            at += 1
            continue
        kind, end = TAGS[tags[at]][2:], at + 1
        while end < len(tags) and TAGS[tags[end]] == f"I-{kind}":
            end += 1
        a, b = tokens[at][0], tokens[end - 1][1]
        while b > a and text[b - 1] in ".,;:!?\"'":
            b -= 1
        while a < b and text[a] in "\"',;:":
            a += 1
        if a < b and _sane(kind, text[a:b]) and not any(a < e and s < b for _, s, e in base):
            out.append((kind, a, b))
        at = end
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(set(spans), key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find_all(texts: list[str | None], field: Field) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """(base spans, all spans) of every text; the chains of a batch are decoded together."""
    base = [base_spans(t or "") for t in texts]
    every = [list(b) for b in base]
    found = [(i, tokens) for i, t in enumerate(texts) for tokens in chains(t or "")]
    found.sort(key=lambda x: len(x[1]))
    at = 0
    while at < len(found):
        take = max(1, min(512, 16_384 // len(found[at][1])))
        part = found[at:at + take]
        for (i, tokens), tags in zip(part, field.decode([token_features(texts[i], tokens) for i, tokens in part])):
            every[i] += added_spans(texts[i], base[i], tokens, tags)
        at += take
    return list(zip(base, every))


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        features, tags = [], []
        for text in batch.column("text").to_pylist():
            for f, t in _examples(text or ""):
                features.append(f)
                tags.append(t)
        yield pa.RecordBatch.from_arrays([pa.array(features, pa.list_(pa.list_(pa.int32()))), pa.array(tags, pa.list_(pa.int32()))], ["features", "tags"])


def fit(docs: DataFrame) -> Field:
    """A field from the marked lines and the base spans of about FIT_DOCS
    documents, chosen by a hash of their id. At most FIT_SEQUENCES sequences
    reach the driver, whatever the documents hold."""
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    n = rows.count()
    picked = rows.where(F.pmod(F.xxhash64(F.lit("pii"), "id"), F.lit(max(1, n // FIT_DOCS))) == 0)
    learned = picked.mapInArrow(_learn, "features array<array<int>>, tags array<int>")
    some = F.exists("tags", lambda t: t > 0)
    sequences = (learned.where(some).orderBy(F.xxhash64("features"), "tags").limit(2 * FIT_SEQUENCES // 3).collect()
                 + learned.where(~some).orderBy(F.xxhash64("features")).limit(FIT_SEQUENCES // 3).collect())
    examples = [(r["features"], r["tags"]) for r in sequences]
    for line in MARKED.split("\n"):
        text, marks = _marked(line)
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        examples += [(token_features(text, tokens), _tags(tokens, marks))] * 4
    return train(examples)


def _apply(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = find_all(part.column("text").to_pylist(), field)
            count = [[sum(s[0] == k for s in b) for b, _ in found] for k in KINDS]
            digest = [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in count), pa.array(digest, pa.string()),
                                              pa.array([joined(e) for _, e in found], pa.string())],
                                             ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row for
    each row of `docs`. The counts and the digest are of the base spans; `spans`
    has those and the added ones. A null text is an empty one. Only doc_id and
    text are read."""
    field = fit(docs)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(lambda it: _apply(it, field), f"doc_id long, {counts}, base_sha256 string, spans string")

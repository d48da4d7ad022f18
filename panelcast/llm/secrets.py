"""Secret scans: fixed patterns, and formats inferred from labelled credentials.

The fixed patterns label credentials in the documents. From a bounded sample of them a probabilistic
automaton per kind is inferred: a prefix tree of character classes whose states are merged while
their counts are statistically compatible (Hoeffding bounds on stopping and on every next class).
Another automaton is inferred from other strings of the same characters. Every candidate, a run of
credential characters as long as the shortest labelled value, is scored by the logarithm of the
likelihood ratio; those above a fixed limit become further spans. What fixed spans leave of a run is a
candidate of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.expressions import named
from panelcast.llm.text import filled, map_texts, slices

# Fixed patterns of the rule.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "format")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 8, 16, 32

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")  # as long as MIN_VALUE
SAMPLE = 1000  # strings per kind the automata are inferred from, at most
LEARN_LENGTH = 128  # longer strings are scored but not learned from
ALPHA = 0.05
LIMIT = 12.0  # least log likelihood ratio of a further span

# Cheap linear searches that tell which rows the patterns can match.
_MAY = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]""",
    "access": r"AKIA[A-Z0-9]{12}",
    "hex": r"[0-9a-f]{32}",
}

CLASSES = "dhlHU+/_.=-"  # digit, a-f, g-z, A-F, G-Z, and the marks themselves
_CLASS_OF = np.full(128, -1, np.int64)
for _chars, _name in (("0123456789", "d"), ("abcdef", "h"), ("ABCDEF", "H")):
    for _c in _chars:
        _CLASS_OF[ord(_c)] = CLASSES.index(_name)
for _c in range(ord("g"), ord("z") + 1):
    _CLASS_OF[_c] = CLASSES.index("l")
    _CLASS_OF[_c - 32] = CLASSES.index("U")
for _c in "+/_.=-":
    _CLASS_OF[ord(_c)] = CLASSES.index(_c)


def classes_of(token: str) -> np.ndarray:
    return _CLASS_OF[np.frombuffer(token.encode("ascii"), np.uint8)]


@dataclass
class Automaton:
    """Transitions (states x classes, -1 none) and log probabilities; the last column is stopping."""

    step: np.ndarray
    logp: np.ndarray


def _differs(a: int, n: int, b: int, m: int, slack: float) -> bool:
    """Hoeffding test: shares a / n and b / m are too far apart to be the same."""
    return abs(a / n - b / m) > slack * (1 / np.sqrt(n) + 1 / np.sqrt(m))


def infer(tokens: Sequence[str], alpha: float = ALPHA) -> Automaton:
    """Merges compatible states of the prefix tree of the tokens' classes, large states first."""
    width = len(CLASSES)
    child: list[list[int]] = [[-1] * width]
    count, ends = [0], [0]
    for token in tokens:
        state = 0
        count[0] += 1
        for c in classes_of(token).tolist():
            if child[state][c] < 0:
                child[state][c] = len(child)
                child.append([-1] * width)
                count.append(0)
                ends.append(0)
            state = child[state][c]
            count[state] += 1
        ends[state] += 1
    passed = [[count[k] if k >= 0 else 0 for k in row] for row in child]
    slack = np.sqrt(0.5 * np.log(2 / alpha))

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            n, m = count[x], count[y]
            if not n or not m:
                continue
            if _differs(ends[x], n, ends[y], m, slack):
                return False
            for c in range(width):
                if _differs(passed[x][c], n, passed[y][c], m, slack):
                    return False
                if child[x][c] >= 0 and child[y][c] >= 0 and min(passed[x][c], passed[y][c]) > 3:
                    todo.append((child[x][c], child[y][c]))
        return True

    def fold(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            count[x] += count[y]
            ends[x] += ends[y]
            for c in range(width):
                passed[x][c] += passed[y][c]
                if child[y][c] >= 0:
                    if child[x][c] < 0:
                        child[x][c] = child[y][c]
                    elif child[x][c] != child[y][c]:
                        todo.append((child[x][c], child[y][c]))

    settled = [0]
    while True:
        fresh = [
            (count[k], s, c, k)
            for s in settled
            for c, k in enumerate(child[s])
            if k >= 0 and k not in settled
        ]
        if not fresh:
            break
        _, s, c, k = max(fresh, key=lambda f: (f[0], -f[3]))
        for other in settled:
            if compatible(other, k):
                child[s][c] = other
                fold(other, k)
                break
        else:
            settled.append(k)
    number = {s: i for i, s in enumerate(settled)}
    step = np.array([[number[k] if k >= 0 else -1 for k in child[s]] for s in settled])
    seen = np.array([[*passed[s], ends[s]] for s in settled], float) + 0.1
    return Automaton(step, np.log(seen / seen.sum(axis=1, keepdims=True)))


def likelihood(automaton: Automaton, tokens: Sequence[str]) -> np.ndarray:
    """Log likelihood of whole tokens, all tokens a step at a time; after an unseen class the walk
    starts over at the first state."""
    total = np.zeros(len(tokens))
    if not len(tokens):
        return total
    sizes = np.array([len(t) for t in tokens])
    order = np.argsort(-sizes, kind="stable")
    points = classes_of("".join(tokens))
    starts = (np.cumsum(sizes) - sizes)[order]
    state, own = np.zeros(len(tokens), np.int64), np.zeros(len(tokens))
    live = len(tokens)
    for k in range(int(sizes.max())):
        while live and sizes[order[live - 1]] <= k:
            live -= 1
        c = points[starts[:live] + k]
        own[:live] += automaton.logp[state[:live], c]
        state[:live] = np.maximum(automaton.step[state[:live], c], 0)
    own += automaton.logp[state, -1]
    total[order] = own
    return total


@dataclass
class SecretModel:
    kinds: dict[str, Automaton] = field(default_factory=dict)
    other: Automaton | None = None

    def ratio(self, tokens: Sequence[str]) -> np.ndarray:
        """Log likelihood of the best credential format over that of other strings."""
        if not self.kinds or self.other is None:
            return np.full(len(tokens), -np.inf)
        best = np.max([likelihood(a, tokens) for a in self.kinds.values()], axis=0)
        return best - likelihood(self.other, tokens)


def base_spans(text: str, may: dict[str, bool]) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, credential) of the fixed patterns."""
    found = []
    if may["assign"]:
        for m in ASSIGN.finditer(text):
            if len(m.group(2)) >= MIN_VALUE:
                found.append((m.start(), 0, m.end(), m.group(2)))
    if may["access"]:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= MIN_ACCESS:
                found.append((m.start(), 1, m.end(), m.group()))
    if may["hex"]:
        for m in HEX.finditer(text):
            if m.end() - m.start() >= MIN_HEX:
                found.append((m.start(), 2, m.end(), m.group()))
    return sorted(found)


def _apart(spans: list, start: int, end: int) -> Iterator[tuple[int, int]]:
    """What spans, by start, leave of a stretch."""
    for s, _, e, _ in spans:
        if s < end and start < e:
            if start < s:
                yield start, s
            start = max(start, e)
    if start < end:
        yield start, end


def _scanned(texts: pa.Array) -> Iterator[tuple[int, list, list[tuple[int, int, str]]]]:
    """(row, fixed spans, candidates apart from them) of the rows that hold any."""
    texts = filled(texts)
    may = {k: pc.match_substring_regex(texts, p).to_numpy(zero_copy_only=False) for k, p in _MAY.items()}
    fixed = np.logical_or.reduce(list(may.values()))
    for row, text in enumerate(texts.to_pylist()):
        spans = base_spans(text, {k: v[row] for k, v in may.items()}) if fixed[row] else []
        if spans:
            parts = [x for m in CANDIDATE.finditer(text) for x in _apart(spans, *m.span())]
            others = [(a, b, text[a:b]) for a, b in parts if b - a >= MIN_VALUE]
        else:
            others = [(m.start(), m.end(), m.group()) for m in CANDIDATE.finditer(text)]
        if spans or others:
            yield row, spans, others


def infer_formats(
    docs: DataFrame, text: str = "text", sample: int = SAMPLE, alpha: float = ALPHA
) -> SecretModel:
    """Infers an automaton per labelled kind and one of other strings.

    At most ``sample`` different strings per kind, those of smallest hash over all documents, of at
    most ``LEARN_LENGTH`` characters. A kind with fewer than five strings gets no automaton.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, dict[str, int]] = {k: {} for k in range(4)}
        most = dict.fromkeys(kept, 1 << 63)  # larger hashes are no longer among the smallest

        def trim(own: dict[str, int]) -> dict[str, int]:
            return dict(sorted(own.items(), key=lambda x: (x[1], x[0]))[:sample])

        for batch in batches:
            for part in slices(batch, "__text"):
                found: dict[int, set[str]] = {k: set() for k in range(4)}
                for _, spans, others in _scanned(part.column("__text")):
                    for _, kind, _, token in spans:
                        found[kind].add(token)
                    found[3].update(token for _, _, token in others)
                for kind, tokens in found.items():
                    tokens = [t for t in tokens if len(t) <= LEARN_LENGTH]
                    if tokens:
                        hashes = hash_array(np.array(tokens, dtype=object), categorize=False) >> np.uint64(1)
                        small = np.flatnonzero(hashes <= np.uint64(most[kind])).tolist()
                        kept[kind].update((tokens[i], int(hashes[i])) for i in small)
                        if len(kept[kind]) > 4 * sample:
                            kept[kind] = trim(kept[kind])
                            most[kind] = max(kept[kind].values())
        rows = [(k, t, h) for k, own in kept.items() for t, h in trim(own).items()]
        columns = zip(*rows) if rows else ([], [], [])
        kinds = (pa.int32(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["kind", "token", "h"]
        )

    tokens = docs.select(named(text).alias("__text")).mapInArrow(
        run, "kind int, token string, h bigint"
    )
    ranked = tokens.distinct().withColumn(
        "rank", F.row_number().over(Window.partitionBy("kind").orderBy("h", "token"))
    )
    by_kind: dict[int, list[str]] = {}
    for r in ranked.filter(F.col("rank") <= sample).orderBy("kind", "h", "token").collect():
        by_kind.setdefault(r["kind"], []).append(r["token"])
    automata = {KINDS[k]: infer(v, alpha) for k, v in by_kind.items() if k < 3 and len(v) >= 5}
    other = infer(by_kind.get(3, []) or ["0" * 16], alpha)
    return SecretModel(automata, other)


def scan_secrets(
    docs: DataFrame,
    model: SecretModel,
    key: str = "doc_id",
    text: str = "text",
    keep: Sequence[str] = (),
    limit: float = LIMIT,
    redact: str | None = None,
) -> DataFrame:
    """Spans of secrets in every whole text.

    Returns ``key``, ``keep`` and n_assign, n_access, n_hex, base_spans and spans. Spans read
    kind:start:end in code points, end exclusive, by start, then kind, joined by commas; ``spans`` adds
    kind format: runs of 8 or more credential characters, or what base spans leave of them,
    whose likelihood ratio reaches ``limit``. Texts are whole, however long. With ``redact`` a column redacted holds the text with every
    span replaced by that mark (overlapping spans by one mark; a null text stays null). A null text
    counts as empty. Repeated rows give repeated results, an empty table an empty one. Columns of
    ``keep`` named like a new column are dropped.
    """

    def work():
        def compute(texts: pa.Array):
            n = len(texts)
            counts = np.zeros((3, n), np.int64)
            base, every = [""] * n, [""] * n
            clean = texts.to_pylist() if redact is not None else None
            scanned = list(_scanned(texts))
            coded = pa.array([t for _, _, others in scanned for _, _, t in others], pa.string()).dictionary_encode()
            above = model.ratio(coded.dictionary.to_pylist()) >= limit
            high = iter(above[coded.indices.to_numpy()].tolist())
            for row, spans, others in scanned:
                own = [(s, k, e) for s, k, e, _ in spans]
                for _, k, _ in own:
                    counts[k, row] += 1
                base[row] = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in own)
                own = sorted(own + [(a, 3, b) for a, b, _ in others if next(high)])
                every[row] = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in own)
                if clean is not None and own:
                    clean[row] = _redacted(clean[row], own, redact)
            made = [*counts, base, every]
            return made if clean is None else [*made, clean]

        return compute

    added = [(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex")]
    added += [("base_spans", T.StringType()), ("spans", T.StringType())]
    if redact is not None:
        added.append(("redacted", T.StringType()))
    return map_texts(docs, key, text, added, work, keep)


def _redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, done = [], 0
    for start, _, end in spans:
        if start >= done:
            out += [text[done:start], mark]
        done = max(done, end)
    return "".join([*out, text[done:]])

"""Personal data by fixed patterns and a skip-chain conditional random field.

Base spans come from four patterns (below). A document's *mentions* are its base spans and every other
expression of similar shape: digit groups with at least ``MIN_DIGITS`` digits and tokens around an @ sign. They
are the nodes of a conditional random field with labels other, email, ip, card, phone:

* a node potential from the shape of the mention and the word before it (multinomial logistic regression); a label
  whose digit count or @ sign the mention does not have is ruled out,
* a chain potential between neighbouring mentions,
* a skip potential between mentions, however distant, that are equal or similar: the same letters and
  digits without separators, the same last eight digits, or the same name before the @ sign. Each mention is
  linked to the next one like it, so a mention that repeats n times has n - 1 skip edges.

Base spans are observed. Loopy sum-product message passing, run on all documents of a slice at once, gives
the other mentions' marginals; those whose best label is not *other* with at least ``min_marginal`` become spans.

Potentials are fitted by expectation maximisation on a bounded sample (``sample_docs`` documents by hash order, of each
the first ``MENTIONS_A_DOC`` mentions). Labels of base spans are known, those of all other mentions are hidden: message
passing gives their marginals, potentials are fitted piecewise to these, and so on. What a pattern misses looks like what
it finds but for the pattern's own tests, so base spans also count without those features, by the weight of the share
``PATTERN_RECALL`` leaves to be found. ``hidden_found`` hides a share of base spans and measures what comes back.

Null text is empty text. Rows are treated one by one; a table without rows gives none.
"""

from __future__ import annotations

import hashlib
import re
from zlib import crc32
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone")
MIN_DIGITS, MAX_DIGITS = 7, 19
MENTIONS_A_DOC = 500
#: Share of the true mentions that the patterns are taken to find.
PATTERN_RECALL = 0.9
#: Pairs of neighbours that a fit is taken to have seen before, with independent labels.
CHAIN_PRIOR = 200
#: Buckets of the word before a mention.
WORDS = 32
SLICE_CHARS = 1 << 21

# A possessive quantifier or a look-behind below never changes the match: a digit run that cannot start
# a match at its first digit cannot start one later, and matches end at run ends.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(r"\+?[0-9](?:[\x20().-]{0,2}[0-9])+")
# A run with an @ before its last character; only run starts are tried, and up to the first @ nothing is given back.
_AROUND_AT = re.compile(r"(?<![^\s<>()\[\],;:\"'])[^\s<>()\[\],;:\"'@]*+@[^\s<>()\[\],;:\"']+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of name@domain, found from the @ signs in linear time."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four patterns, by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return out


def mentions(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, label) in text order; label -1 where nothing was observed."""
    found = [(a, b, KINDS.index(k) + 1) for k, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    others = []
    if _DIGIT.search(text):
        others = [m.span() for m in _NUMBER.finditer(text) if MIN_DIGITS <= sum(c.isdigit() for c in m[0]) <= MAX_DIGITS]
    if "@" in text:
        others += [m.span() for m in _AROUND_AT.finditer(text)]
    others.sort()
    i, reach = 0, 0
    for a, b in others:
        while i < len(taken) and taken[i][0] < b:
            reach = max(reach, taken[i][1])
            i += 1
        if reach <= a:
            found.append((a, b, -1))
    return sorted(found)


def _traits(mention: str) -> tuple[int, bool, bool]:
    """Digits, whether an @ occurs, whether the mention is four dotted numbers."""
    at = "@" in mention
    groups = re.split(r"\D+", mention.strip("+ ")) if not at and mention.count(".") == 3 else ()
    return sum(c.isdigit() for c in mention), at, len(groups) == 4 and all(0 < len(g) <= 3 for g in groups)


def shape(mention: str, before: str = "") -> list[float]:
    """Features of a mention behind the text ``before``; those at ``PATTERN_TESTS`` are what the patterns ask for."""
    digits, at, quad = _traits(mention)
    word = before.split()[-1:]
    near = [0.0] * WORDS
    if word:
        near[crc32(word[0].lower().strip(".,:;!?()").encode("utf-8", "replace")) % WORDS] = 1.0
    return [
        1.0,
        at,
        at and "." in mention.split("@", 1)[1],
        mention.startswith("+"),
        quad,
        8 <= digits <= 15 and not at,
        16 <= digits <= 19 and not at,
        16 <= digits <= 19 and not at and luhn("".join(c for c in mention if c in "0123456789")),
        "(" in mention,
        *near,
    ]


PATTERN_TESTS = [2, 3, 7]


def fits(mention: str, glued: bool = False) -> list[bool]:
    """Which labels the mention may have at all: other, email, ip, card, phone. Digits ``glued`` to a letter are part of a word."""
    digits, at, quad = _traits(mention)
    number = not at and not glued
    return [True, at, number and quad, number and 16 <= digits <= 19, number and not quad and MIN_DIGITS <= digits <= 15]


def likeness(mention: str) -> list[str]:
    """Keys; mentions that share one are equal or similar."""
    bare = "".join(c for c in mention.lower() if c.isalnum())
    if "@" in mention:
        return ["=" + bare, "@" + mention.lower().split("@", 1)[0]]
    return ["=" + bare, "#" + bare[-8:]] if len(bare) >= 8 else ["=" + bare]


@dataclass
class Potentials:
    weights: np.ndarray  # [features, labels]
    chain: np.ndarray  # [labels, labels], log
    skip: float  # log-odds of equal labels


def described(text: str, found: list[tuple[int, int, int]]) -> tuple[list, list, list]:
    """Features, fitting labels and likeness keys of the mentions of a text."""
    spans = [(text[a:b], text[max(0, a - 24) : a], text[b : b + 1]) for a, b, _ in found]
    fitting = [fits(m, before[-1:].isalnum() or after.isalnum()) for m, before, after in spans]
    return [shape(m, before) for m, before, _ in spans], fitting, [likeness(m) for m, *_ in spans]


class Graph:
    """Mentions of many documents with their chain and skip edges."""

    def __init__(self):
        self.owner, self.spans, self.labels, self.shapes, self.fits = [], [], [], [], []
        self.chain, self.skip = [], []

    def add(self, owner: int, text: str, found: list[tuple[int, int, int]]):
        self.add_described(owner, found, *described(text, found))

    def add_described(self, owner: int, found: list[tuple[int, int, int]], shapes: list, fitting: list, keys: list):
        last: dict = {}
        for k, (a, b, label) in enumerate(found):
            node = len(self.spans)
            self.owner.append(owner)
            self.spans.append((a, b))
            self.labels.append(label)
            self.shapes.append(shapes[k])
            self.fits.append(fitting[k])
            if k:
                self.chain.append((node - 1, node))
            linked = set()
            for key in keys[k]:
                if key in last and last[key] not in linked:
                    self.skip.append((last[key], node))
                    linked.add(last[key])
                last[key] = node

    def marginals(self, p: Potentials, rounds: int = 20, damping: float = 0.3) -> np.ndarray:
        n, k = len(self.spans), len(KINDS) + 1
        unary = np.where(np.asarray(self.fits, bool).reshape(n, k), np.asarray(self.shapes, float).reshape(n, -1) @ p.weights, -50.0)
        labels = np.asarray(self.labels)
        seen = np.flatnonzero(labels >= 0)
        unary[seen] = -50.0
        unary[seen, labels[seen]] = 0.0
        edges = np.asarray(self.chain + self.skip, int).reshape(-1, 2)
        if not len(edges):
            return _soft(unary)
        pair = np.concatenate([np.broadcast_to(p.chain, (len(self.chain), k, k)), np.broadcast_to(p.skip * np.eye(k), (len(self.skip), k, k))])
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        pair = np.concatenate([pair, pair.transpose(0, 2, 1)])  # [edge, from, to]
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        message = np.zeros((len(source), k))
        for _ in range(rounds):
            total = unary.copy()
            np.add.at(total, target, message)
            out = total[source] - message[back]
            new = np.logaddexp.reduce(out[:, :, None] + pair, axis=1)
            new -= new.max(axis=1, keepdims=True)
            change = np.abs(new - message).max()
            message = (1 - damping) * new + damping * message
            if change < 1e-4:
                break
        total = unary.copy()
        np.add.at(total, target, message)
        return _soft(total)


def _soft(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def learned(graph: Graph, recall: float = PATTERN_RECALL, rounds: int = 10, ridge: float = 1e-3) -> Potentials:
    """Expectation maximisation: labels of base spans, a share ``recall`` of the true ones, are known, all others hidden."""
    n, k = len(graph.spans), len(KINDS) + 1
    x = np.asarray(graph.shapes, float).reshape(n, len(shape("")))
    allowed = np.asarray(graph.fits, bool).reshape(n, k)
    labels = np.asarray(graph.labels, int)
    seen, hidden = labels >= 0, np.flatnonzero(labels < 0)
    y = np.zeros((n, k))
    y[seen, labels[seen]] = 1
    allowed[seen, labels[seen]] = True
    missed = (1 - recall) / recall
    # at first a hidden mention carries a label as often as the patterns are taken to miss it
    expected = missed * y[seen].sum(0)
    y[hidden] = np.minimum(expected / np.maximum(allowed[hidden].sum(0), 1), 0.5 / k) * allowed[hidden]
    y[hidden, 0] = 1 - y[hidden, 1:].sum(1)
    penalty = np.full((x.shape[1], 1), ridge)
    penalty[-WORDS:] = 10 * ridge
    plain = x[seen].copy()
    plain[:, PATTERN_TESTS] = 0
    features, allows = np.concatenate([x, plain]), np.concatenate([allowed, allowed[seen]])
    share = np.concatenate([np.ones(n), np.full(len(plain), missed)])[:, None]
    chain, skips = np.asarray(graph.chain, int).reshape(-1, 2), np.asarray(graph.skip, int).reshape(-1, 2)
    known = skips[seen[skips].any(1)]
    p = Potentials(np.zeros((x.shape[1], k)), np.zeros((k, k)), 0.0)
    for _ in range(rounds if n else 1):
        target = np.concatenate([y, y[seen]])
        for _ in range(200 if n else 0):
            error = _soft(np.where(allows, features @ p.weights, -50.0)) - target
            p.weights -= 1.0 * (features.T @ (share * error) / share.sum() + penalty * p.weights)
        # shrunk towards independent neighbours by as many pairs as CHAIN_PRIOR
        pairs = np.ones((k, k)) + y[chain[:, 0]].T @ y[chain[:, 1]]
        pairs += CHAIN_PRIOR * pairs.sum(1, keepdims=True) * pairs.sum(0, keepdims=True) / pairs.sum() ** 2
        p.chain = np.log(pairs / (pairs.sum(1, keepdims=True) * pairs.sum(0, keepdims=True) / pairs.sum()))
        same = (y[known[:, 0]] * y[known[:, 1]]).sum()
        # a prior of eight agreeing pairs: similar mentions carry one label unless the sample says otherwise
        p.skip = float(max(np.log((same + 8) / (len(known) - same + 1)) + np.log(k - 1), 0.0))
        if not len(hidden):
            break
        new = graph.marginals(p)[hidden]
        # no kind gets more hidden mentions than the patterns are taken to miss, or the labels drift to what is frequent
        new[:, 1:] *= np.minimum(1, expected[1:] / np.maximum(new[:, 1:].sum(0), 1e-9))
        new[:, 0] = 1 - new[:, 1:].sum(1)
        change, y[hidden] = np.abs(new - y[hidden]).max(), new
        if change < 1e-3:
            break
    return p


def estimate(texts: list[str]) -> Potentials:
    """Potentials learned from whole texts."""
    graph = Graph()
    for i, text in enumerate(texts):
        graph.add(i, text, mentions(text, base_spans(text)))
    return learned(graph)


def sampled(documents: DataFrame, sample_docs: int = 2000) -> Graph:
    """The mentions of up to ``sample_docs`` documents that have any, by hash order of the text.

    One scan: tasks describe the mentions of documents whose hash is low enough for 16 times the sample, and only
    descriptions, without the words themselves, leave them.
    """
    n = documents.count()
    share = min(1.0, 16 * sample_docs / n) if n else 1.0
    place = F.xxhash64("text")
    low = F.pmod(place, F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1)
    rows = documents.filter(low & F.col("text").rlike("[0-9@]")).select(place.alias("place"), "text")

    def run(batches):
        for batch in batches:
            out = {"place": [], "spans": [], "shapes": [], "fits": [], "keys": []}
            for place, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                found = mentions(text, base_spans(text))[:MENTIONS_A_DOC]
                if found:
                    shapes, fitting, keys = described(text, found)
                    out["place"].append(place)
                    out["spans"].append([v for span in found for v in span])
                    out["shapes"].append([float(v) for row in shapes for v in row])
                    out["fits"].append([v for row in fitting for v in row])
                    out["keys"].append([[hash_key(key) for key in row] for row in keys])
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.bool_()), pa.list_(pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    schema = "place long, spans array<long>, shapes array<float>, fits array<boolean>, keys array<array<long>>"
    graph, width, k = Graph(), len(shape("")), len(KINDS) + 1
    for i, row in enumerate(rows.mapInArrow(run, schema).orderBy("place", "spans").limit(sample_docs).collect()):
        found = [tuple(row["spans"][j : j + 3]) for j in range(0, len(row["spans"]), 3)]
        shapes = [row["shapes"][j : j + width] for j in range(0, len(row["shapes"]), width)]
        fitting = [row["fits"][j : j + k] for j in range(0, len(row["fits"]), k)]
        graph.add_described(i, found, shapes, fitting, row["keys"])
    return graph


def hash_key(key: str) -> int:
    return int.from_bytes(hashlib.blake2b(key.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def fit(documents: DataFrame, sample_docs: int = 2000) -> Potentials:
    """Estimate potentials from the mentions of a bounded sample."""
    return learned(sampled(documents, sample_docs))


def hidden_found(graph: Graph, one_in: int = 4, plain: bool = False, skip: bool = True, min_marginal: float = 0.8) -> tuple[int, int, int]:
    """Hide one in ``one_in`` base spans while fitting: (hidden, found again with their kind, found in all).

    With ``plain`` the hidden ones also lose the features that the patterns test, as if a pattern had missed them. All
    that is found beyond the hidden spans counts as wrong.
    """
    truth = np.asarray(graph.labels, int)
    picked = np.array([t >= 0 and crc32(f"{o}:{s[0]}".encode()) % one_in == 0 for t, o, s in zip(truth, graph.owner, graph.spans)], bool)
    test = Graph()
    test.__dict__.update(graph.__dict__)
    test.labels = np.where(picked, -1, truth).tolist()
    p = learned(test, PATTERN_RECALL * (1 - 1 / one_in))
    if not skip:
        test.skip = []
    if plain:
        shapes = np.asarray(graph.shapes, float)
        shapes[np.ix_(picked, PATTERN_TESTS)] = 0
        test.shapes = shapes.tolist()
    marginal = test.marginals(p)
    best = np.where(marginal.max(1) >= min_marginal, marginal.argmax(1), 0)
    found = (np.asarray(test.labels) < 0) & (best > 0)
    return int(picked.sum()), int((found & picked & (best == truth)).sum()), int(found.sum())


def tag(texts: list[str], p: Potentials, min_marginal: float = 0.8) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text, both by kind, then start."""
    base = [base_spans(t) for t in texts]
    graph = Graph()
    for i, (text, spans) in enumerate(zip(texts, base)):
        found = mentions(text, spans)
        if any(label < 0 for _, _, label in found):  # otherwise everything is observed
            graph.add(i, text, found)
    added: dict[int, list] = {}
    if graph.spans:
        marginal = graph.marginals(p)
        for node in np.flatnonzero((np.asarray(graph.labels) < 0) & (marginal.argmax(1) > 0) & (marginal.max(1) >= min_marginal)):
            added.setdefault(graph.owner[node], []).append((KINDS[marginal[node].argmax() - 1], *graph.spans[node]))
    order = {k: i for i, k in enumerate(KINDS)}
    return [(b, sorted(b + added[i], key=lambda s: (order[s[0]], s[1])) if i in added else b) for i, b in enumerate(base)]


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(documents: DataFrame, p: Potentials, min_marginal: float = 0.8) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all, as kind:start:end in code points)."""
    shared = documents.sparkSession.sparkContext.broadcast(p)
    frame = documents.select("doc_id", "text")
    kind = frame.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows, part, held = [], [], 0
            for i, text in enumerate(batch.column(1)):
                part.append(text.as_py() or "")
                held += len(part[-1])
                if held >= SLICE_CHARS or i == batch.num_rows - 1:
                    rows += tag(part, shared.value, min_marginal)
                    part, held = [], 0
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in rows], pa.int64()) for k in KINDS]
            digest = pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in rows], pa.string())
            spans = pa.array([_joined(every) for _, every in rows], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, spans], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return frame.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")

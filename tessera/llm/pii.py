"""Personal data: fixed patterns, and a skip-chain conditional random field over number-like and address-like tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_sample

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns; matches are leftmost and non-overlapping per kind, and dropped without a retry if they fail.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_HINT = re.compile(r"[0-9@]")
_NODE = re.compile(r"[^\s]*[0-9@][^\s]*")
LABELS = ("none", *KINDS)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in code points, by start and then kind."""
    found = []
    if "@" in text:
        last = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                found.append((start, 0, last := m.end()))
    if _HINT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.groups())]
        for m in _CARD.finditer(text):
            if 14 <= m.end() - m.start() <= 60 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15]
    return sorted(found)


#: Words before a number that say what it is, in the languages of the training samples.
CUES = {
    0: ("order", "invoice", "id", "ref", "isbn", "page", "version", "build", "ticket", "serial", "seite", "bestellung", "commande", "pedido", "página"),
    1: ("mail", "email", "write", "contact", "courriel", "correo"),
    2: ("ip", "host", "server", "from", "login", "serveur", "servidor"),
    3: ("card", "visa", "pay", "charged", "karte", "carte", "tarjeta"),
    4: ("call", "phone", "tel", "fax", "mobile", "anrufen", "appelez", "llame"),
}
_CUE = {w: i for i, w in enumerate(w for words in CUES.values() for w in words)}
_BEFORE = re.compile(r"(\w+)[\s:.#(]*$")
_EDGE_LEFT, _EDGE_RIGHT = re.compile(r"^[^\w@+(\[]+"), re.compile(r"[^\w\])]+$")
_IPV6 = re.compile(r"[0-9a-fA-F]{0,4}(?::[0-9a-fA-F]{0,4}){2,7}")
SHAPES = 26
FEATURES = 22 + SHAPES + len(_CUE)


def features(token: str, before: str) -> list[int]:
    """Numbers of the features of a token that follows the text `before`: its count of digits, its shape, and a cue word right before it."""
    digits, core = "".join(_DIGITS.findall(token)), _EDGE_RIGHT.sub("", _EDGE_LEFT.sub("", token))
    n, (local, at, domain) = len(digits), core.partition("@")
    shape = (
        bool(at), bool(at and local and "." in domain.strip(".")), bool(at and local and domain), core.count(".") == 3, core.count(".") in (1, 2), core[:1] == "+", core[:1] in "([",
        "-" in core, core.isdigit(), 14 <= n <= 19, n == 16, n == 16 and core.isdigit(), 14 <= n <= 19 and luhn(digits), len(core) > 24, any(c.isalpha() for c in core), ")" in core, ":" in core, "/" in core, "," in core,
        bool(_IP.fullmatch(core)), "=" in core or '"' in token, bool(_IPV6.fullmatch(core)) and n > 0, bool(re.fullmatch(r"[0-9]{3,4}[-.][0-9]{4}", core)), bool(re.fullmatch(r"0[0-9]{2,4}", core)),
        bool(re.fullmatch(r"[0-9]{4}(?:[.-][0-9]{4}){3}", core)), bool(re.fullmatch(r"(?:19|20)[0-9]{2}-[0-9]{2}(?:-[0-9]{2})?", core)),
    )
    cue = _BEFORE.search(before)
    said = [22 + SHAPES + _CUE[w] for w in [cue[1].lower()] if w in _CUE] if cue else []
    return [0, 1 + min(n, 20), *[22 + i for i, on in enumerate(shape) if on], *said]


def similar_keys(token: str) -> list[str]:
    """Tokens that share a key are taken for mentions of one thing: equal ones without marks around them and in lower case; those of equal digits, six or more,
    however grouped; and those whose last seven digits agree, which a number with and one without its area code do."""
    digits = "".join(_DIGITS.findall(token))
    keys = [token.strip(".,;:()\"'!#*%&$").lower()]
    if len(digits) >= 6:
        keys.append("=" + digits)
    if len(digits) >= 7:
        keys.append("~" + digits[-7:])
    return keys


@dataclass(frozen=True)
class Field:
    unary: np.ndarray  # feature, label
    chain: np.ndarray  # label, label: log potential of a node and the next one
    skip: np.ndarray  # label, label: log potential of equal or similar nodes (symmetric)


@dataclass
class Graph:
    """Nodes (text, start, end, token) with their features, chain edges (neighbouring tokens with only white space between) and skip edges (each node to the
    last and to the first one that shares a key)."""

    nodes: list[tuple[int, int, int, str]]
    marks: list[list[int]]
    chain: np.ndarray
    skip: np.ndarray


#: From so many nodes on, the next text begins a graph of its own, which bounds a worker's memory. A text, however long, is never divided, and those of one graph don't touch each other,
#: so this changes no result.
MOST_NODES = 50_000


def graphs(texts: list[str], most: int = MOST_NODES) -> Iterator[Graph]:
    g, chain, skip = Graph([], [], None, None), [], []

    def done() -> Graph:
        g.chain, g.skip = (np.array(x, dtype=np.int64).reshape(-1, 2) for x in (chain, sorted(set(skip))))
        return g

    for i, text in enumerate(texts):
        if not _HINT.search(text):
            continue
        if len(g.nodes) >= most:
            yield done()
            g, chain, skip = Graph([], [], None, None), [], []
        first: dict[str, int] = {}
        last: dict[str, int] = {}
        for m in _NODE.finditer(text):
            at, keys = len(g.nodes), similar_keys(m[0])
            if g.nodes and g.nodes[-1][0] == i and m.start() - g.nodes[-1][2] <= 2:
                chain.append((at - 1, at))
            for key in keys:
                skip += {(x, at) for x in (last.get(key), first.get(key)) if x is not None}
                last[key] = at
                first.setdefault(key, at)
            g.nodes.append((i, m.start(), m.end(), m[0]))
            g.marks.append(features(m[0], text[max(0, m.start() - 24) : m.start()]))
    if g.nodes:
        yield done()


def node_labels(nodes: list[tuple[int, int, int, str]], spans: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """The kind (from 1) of the first span that each node overlaps, else 0. Nodes and spans are in order."""
    labels, at, of = np.zeros(len(nodes), dtype=np.int64), 0, -1
    for n, (i, start, end, _) in enumerate(nodes):
        if i != of:
            at, of = 0, i
        own = spans[i]
        while at < len(own) and own[at][2] <= start:
            at += 1
        for s, kind, e in own[at : at + 4]:
            if s < end and start < e:
                labels[n] = kind + 1
                break
    return labels


def labelled_texts(n: int = 1500, seed: int = 1) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated texts with their true spans (start, kind, end): entities as the fixed patterns know them and as they don't (local phone numbers, hosts without a
    dot, IPv6, cards in other groups or with a wrong digit), with and without cue words, mentioned again later; among numbers that are nothing of the kind.

    A fixed, bounded set. Another seed gives other texts, to measure on."""
    rng = np.random.default_rng(seed)
    some = lambda *x: x[int(rng.integers(len(x)))]
    num = lambda k, first="0123456789": some(*first) + "".join(map(str, rng.integers(0, 10, k - 1)))
    word = lambda: "".join(some(*"aeioulnrstdmpch") for _ in range(int(rng.integers(2, 9))))

    def card() -> list[str]:
        d, wrong = num(15), rng.random() < 0.6
        d += next(c for c in "0123456789" if luhn(d + c) != wrong)
        groups = [d[i : i + 4] for i in range(0, 16, 4)]
        return [some(d, d, " ".join(groups), "-".join(groups), ".".join(groups)), d]

    def phone() -> list[str]:
        area, a, b = num(3), num(3), num(4)
        return [some(f"+1 ({area}) {a}-{b}", f"({area}) {a}-{b}", f"+{num(2, '345')} {area} {a}{b}", f"0{area} {a} {b}", f"{area}-{a}-{b}", f"{a}-{b}"), some(f"{a}-{b}", f"({area}) {a}-{b}")]

    def email() -> list[str]:
        x = f"{word()}{some('.', '_', '')}{some(word(), num(2))}@{some(f'mail{num(1)}.example.com', f'{word()}.org', word() + num(1), 'localhost')}"
        return [x, x]

    def ip() -> list[str]:
        x = some(".".join(str(rng.integers(0, 256)) for _ in range(4)), ":".join(f"{rng.integers(0, 65536):x}" for _ in range(8)), f"2001:db8::{rng.integers(1, 9999)}")
        return [x, x]

    def nothing() -> str:
        return some(
            f"{rng.integers(1950, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}", f"{rng.integers(1, 13)}/{rng.integers(1, 29)}/{rng.integers(1990, 2030)}", f"{rng.integers(0, 24)}:{rng.integers(10, 60)}",
            f"{rng.integers(0, 9)}.{rng.integers(0, 20)}.{rng.integers(0, 9)}", f"{rng.integers(1, 99)},{num(3)}.{num(2)}", f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", f"INV-{num(4)}-{num(5)}", f"#{num(5)}", num(int(rng.integers(1, 12))),
            num(int(rng.integers(20, 28))), num(13), f"@{word()}", f"{num(2)}kg", f"{num(2)}-{num(2)}", f"{num(1)}.{num(1)}", f"{some(*'abcdef')}{num(20)}{some(*'abcdef')}", f'"{num(8)}f{num(9)}a{num(12)}"', f"v{num(1)}.{num(2)}", str(rng.integers(1900, 2030)),
        )

    out = []
    for _ in range(n):
        parts: list[tuple[str, int | None]] = []
        again: list[tuple[str, int]] = []
        for _ in range(int(rng.integers(4, 14))):
            parts += [(word(), None) for _ in range(int(rng.integers(1, 6)))]
            if again and rng.random() < 0.35:
                parts.append(again[int(rng.integers(len(again)))])
            elif rng.random() < 0.5:
                kind = int(rng.integers(4))
                shown, later = (email, ip, card, phone)[kind]()
                bare = kind == 3 and not shown.startswith("+")
                if rng.random() < (0.9 if bare else 0.4):
                    parts.append((some(*CUES[kind + 1]), None))
                parts.append((shown, kind))
                again.append((later, kind))
            elif rng.random() < 0.15:  # as long as a card, but said to be something else
                parts += [(some(*CUES[0]), None), (num(int(rng.integers(14, 20))), None)]
            else:
                parts += [(some(*CUES[0]), None)] * int(rng.random() < 0.3) + [(nothing(), None)]
        text, spans = "", []
        for shown, kind in parts:
            text += some(" ", " ", " ", ". ", "\n") if text else ""
            if kind is not None:
                spans.append((len(text), kind, len(text) + len(shown)))
            text += shown
        out.append((text + ".", spans))
    return out


def train(texts: list[str], rounds: int = 400, seed: int = 3) -> Field:
    """Node, chain and skip potentials, fitted together by pseudo-likelihood: every node's label given its features and its neighbours' labels.

    Learned from labelled_texts(), and from `texts` of the corpus: there, tokens in spans of the fixed patterns and plain short numbers are labelled, others
    are not used. In each round a part of the nodes is shown without neighbours, and of others the shape is hidden, so that context has to carry the label.
    """
    made = labelled_texts()
    marks: list[list[int]] = []
    labels, chains, skips = [], [], []
    for source, spans in (([t for t, _ in made], [s for _, s in made]), (texts, [base_spans(t) for t in texts])):
        for g in graphs(source):
            y = node_labels(g.nodes, spans)
            if source is texts:  # what no pattern finds may still be personal
                y = np.where((y == 0) & np.array([len("".join(_DIGITS.findall(n[3]))) > 5 or "@" in n[3] for n in g.nodes], dtype=bool), -1, y)
            chains.append(g.chain + len(marks))
            skips.append(g.skip + len(marks))
            labels.append(y)
            marks += g.marks
    y, chain, skip, size = np.concatenate(labels), np.concatenate(chains), np.concatenate(skips), len(LABELS)
    x = np.zeros((len(y), FEATURES), dtype=np.float32)
    for n, of in enumerate(marks):
        x[n, of] = 1
    one = np.where((y >= 0)[:, None], np.eye(size)[y], 0.0)
    sides = np.zeros((3, len(y), size))  # labels of the node before, of the node after, of similar nodes
    np.add.at(sides[0], chain[:, 1], one[chain[:, 0]])
    np.add.at(sides[1], chain[:, 0], one[chain[:, 1]])
    for a, b in ((0, 1), (1, 0)):
        np.add.at(sides[2], skip[:, a], one[skip[:, b]])
    known, rng = y >= 0, np.random.default_rng(seed)
    z = np.concatenate([x, *sides], axis=1).astype(np.float32)[known]
    target, w = one[known], np.zeros((z.shape[1], size))
    mean, square = np.zeros_like(w), np.zeros_like(w)
    rate, linked = 0.05, z[:, FEATURES + 2 * size :].any(axis=1)
    for k in range(1, rounds + 1):
        shown = z.copy()
        chance = rng.random(len(z))
        shown[chance < 0.3, FEATURES:] = 0
        shown[np.ix_((chance > 0.8) & linked, range(1, FEATURES))] = 0
        logit = shown @ w
        p = np.exp(logit - logit.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        step = shown.T @ (target - p) / len(z) - 2e-4 * w
        mean, square = 0.9 * mean + 0.1 * step, 0.999 * square + 0.001 * step**2
        w += rate * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.999**k)) + 1e-8)
    before, after, similar = (w[FEATURES + i * size : FEATURES + (i + 1) * size] for i in range(3))
    return Field(w[:FEATURES], (before + after.T) / 2, (similar + similar.T) / 2)


#: Edges whose messages are computed at once, which bounds memory.
EDGE_BLOCK = 100_000


def beliefs(unary: np.ndarray, chain: np.ndarray, skip: np.ndarray, field: Field, texts: np.ndarray | None = None, most_rounds: int = 300, tolerance: float = 1e-4) -> np.ndarray:
    """Marginals by loopy sum-product message passing with damping. `texts`: the text of each node, in rising order (all one, if not given). A text's messages rest once none of them changes by
    more than the tolerance (or, where loops swing, after most_rounds), whatever the others do, so its marginals don't depend on what shares the graph."""
    pairs, half = np.concatenate([chain, skip]), len(chain) + len(skip)
    ends = np.concatenate([pairs, pairs[:, ::-1]])  # directed edges from, to
    kind = np.tile(np.repeat([0, 2], [len(chain), len(skip)]), 2) + np.repeat([0, 1], half)
    potential = np.stack([field.chain, field.chain.T, field.skip, field.skip])
    messages, total = np.zeros((2 * half, len(LABELS))), unary.copy()
    back = np.roll(np.arange(2 * half), half)  # the same edge the other way
    of = np.zeros(len(unary), dtype=np.int64) if texts is None else np.unique(texts, return_inverse=True)[1]
    edge_of, awake = of[ends[:, 0]], np.arange(2 * half)
    for _ in range(most_rounds):
        if not len(awake):
            break
        old, change = messages.copy(), np.zeros(int(of[-1]) + 1)
        for at in range(0, len(awake), EDGE_BLOCK):
            e = awake[at : at + EDGE_BLOCK]
            new = np.logaddexp.reduce((total[ends[e, 0]] - old[back[e]])[:, :, None] + potential[kind[e]], axis=1)
            messages[e] = 0.5 * old[e] + 0.5 * (new - new.max(axis=1, keepdims=True))
            np.maximum.at(change, edge_of[e], np.abs(messages[e] - old[e]).max(axis=1))
        moved = np.zeros(len(unary), dtype=bool)
        moved[ends[awake, 1]] = True
        total[moved] = unary[moved]
        np.add.at(total, ends[awake, 1], messages[awake])  # a text's edges are awake all or none
        awake = awake[change[edge_of[awake]] >= tolerance]
    p = np.exp(total - total.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


#: How sure the field must be of an added span; chosen on held-out texts, see the tests.
SURE = 0.8
#: Digits that an added span must have, and from how many on it takes no further token.
_DIGITS_OF = {3: (13, 19, 14), 4: (7, 15, 10)}


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], field: Field, sure: float, most: int = MOST_NODES) -> list[list[tuple[int, int, int]]]:
    """Spans of nodes that the field is sure of and that touch no base span. Neighbouring nodes of a phone or card number are one span, as far as one number goes;
    a span that can't be what it is taken for (by its digits, or without an address) is left out."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]

    def close(span: list | None) -> None:
        if span is None:
            return
        i, start, label, stop, digits, token = span
        fits = _DIGITS_OF[label][0] <= digits <= _DIGITS_OF[label][1] if label in _DIGITS_OF else all(token.partition("@")[::2]) if label == 1 else token.count(".") == 3 or token.count(":") >= 2
        if fits:
            out[i].append((start, label - 1, stop))

    for g in graphs(texts, most):
        unary = np.zeros((len(g.nodes), len(LABELS)))
        for n, of in enumerate(g.marks):
            unary[n] = field.unary[of].sum(axis=0)
        p = beliefs(unary, g.chain, g.skip, field, np.array([node[0] for node in g.nodes]))
        free, best, follows = node_labels(g.nodes, base) == 0, p.argmax(axis=1), set(g.chain[:, 1].tolist())
        span: list | None = None
        for n, (i, start, end, token) in enumerate(g.nodes):
            label = int(best[n])
            if not (free[n] and label and p[n, label] >= sure):
                close(span)
                span = None
                continue
            left = len(token) - len(_EDGE_LEFT.sub("", token))
            core = _EDGE_RIGHT.sub("", token[left:])
            digits, stop = sum(map(len, _DIGITS.findall(core))), start + left + len(core)
            if span and n in follows and span[2] == label and label in _DIGITS_OF and span[4] < _DIGITS_OF[label][2] and span[4] + digits <= _DIGITS_OF[label][1]:
                span[3:] = [stop, span[4] + digits, core]
            else:
                close(span)
                span = [i, start + left, label, stop, digits, core]
        close(span)
    return out


@lru_cache(maxsize=4)
def trained(texts: tuple[str, ...]) -> Field:
    """train(), once for a sample."""
    return train(list(texts))


def training_texts(docs: DataFrame, most: int = 400, most_chars: int = 1 << 20) -> list[str]:
    """The distinct texts with digits or @ with the smallest hashes, at most so many, none over most_chars: the bounded sample that the field is fitted on."""
    marked = docs.filter(F.rlike("text", F.lit("[0-9@]")) & (F.char_length("text") <= most_chars)).select("text")
    return sorted({r["text"] for r in bounded_sample(marked, None, most, "text").collect()})


def find_personal_data(docs: DataFrame, field: Field | None = None, sure: float = SURE) -> DataFrame:
    """doc_id, base, spans for every row of docs (doc_id, text): arrays of (start, kind, end) in code points, kind a number in KINDS, by start and kind.

    `spans` are the base spans and those that the field adds. A null or empty text has none. Texts are scanned whole, each in its own row;
    repeated rows get equal results; an empty table gives no rows; other columns are ignored. Without a field one is trained on training_texts(docs).
    """
    spark = docs.sparkSession
    field = field or trained(tuple(training_texts(docs)))
    model = spark.sparkContext.broadcast(field)
    span = "array<struct<start:int,kind:int,end:int>>"

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        rows = lambda spans: [dict(zip(("start", "kind", "end"), x)) for x in spans]
        for batch in batches:
            texts = [t or "" for t in batch]
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, base, model.value, sure)
            yield pd.DataFrame({"base": [rows(b) for b in base], "spans": [rows(sorted(b + m)) for b, m in zip(base, more)]})

    return docs.select("doc_id", F.pandas_udf(of, f"base {span}, spans {span}")("text").alias("_found")).select("doc_id", "_found.base", "_found.spans")

"""Personal data: exact patterns, and a skip-chain conditional random field that makes labels agree in a document.

Patterns find email addresses, IP addresses, payment cards and phone numbers (leftmost, non-overlapping for each kind;
what fails its check is dropped). The field then looks at the words that hold a digit or an at sign: every other word is
no entity. Its labels are the four kinds, secrets (keys, access tokens) and none. Its nodes have features of a word's form
and of the words around it; neighbouring nodes share a transition potential; and words of a document that repeat, or are
similar (the last seven digits of a number, however it is written; the local part of an address; the beginning or end of a
long token), share a skip potential, however far apart. Nodes that a pattern found are observed;
loopy message passing over all texts of a step at once gives the rest their marginals, and words of a marginal of a
threshold or more are added as spans of that kind.

The field is trained by pseudo-likelihood on at most FIT_UNITS stretches of FIT_NODES nodes, those of least hash among the
stretches of about FIT_DOCS documents. Labels are what the patterns find and, for secrets, values that are assigned to a
telling name, and so are words that repeat them; evidence is hidden: each labelled word has a hidden twin, of the same label and linked to it, that lacks the
signs patterns go by and the words around it, and so do words of label none. A fifth of the stretches is held out, with
secrets and twins unobserved there; for each label the least threshold of LEVELS at which PRECISE of what is added is right
is taken, and nothing of that label is added if there is none.

Defined cases: a null or empty text has no spans; repeated rows have the same spans; where a text holds no entity to
learn from, nothing is added; an empty table gives an empty result; extra columns are left alone. Positions are code
points, ends exclusive.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import KEY, keyed, text_steps

#: Kinds of the patterns, and then the one that only the field gives.
KINDS = ("email", "ip", "card", "phone")
LABELS = (*KINDS, "secret")
FIT_DOCS = 4000
FIT_UNITS, FIT_NODES = 4000, 100
LEVELS, PRECISE = (0.85, 0.9, 0.95, 0.98, 0.99), 0.98
ROUNDS = 15
#: Nodes or links of one numpy step.
BLOCK = 1 << 15

# Names to which secrets are assigned.
_SECRET = re.compile(r"""\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth)["']?\x20?[=:]\x20?["']?([A-Za-z0-9+/_=-]{16,})""", re.IGNORECASE)
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't begin within a run of digits unless it begins with the run: the run's end would fail it alike.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: From a digit or an at sign to its word's end.
_REST = re.compile(r"[0-9@][^\x20\x09-\x0D]*")
_BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what the patterns find, by kind, then start."""
    found = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 37 and 16 <= len(digits := re.sub("[ -]", "", m[0])) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    found.append((3, m.start(), m.end()))
    return found


def node_words(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each word that holds a digit or an at sign; every character is looked at a few times at most."""
    upto = 0
    for m in _REST.finditer(text):
        start = max(upto - 1, *(text.rfind(c, upto, m.start()) for c in _BLANKS)) + 1
        yield start, m.end()
        upto = m.end()


FORMS, BUCKETS = 27, 48
N_FEATURES = FORMS + 3 * BUCKETS
_TRIM = ".,;:!?()[]{}<>\"'#*$%&|"


def _form(word: str, digits: int) -> list[int]:
    """Indices of a word's features."""
    f = [0, 1 + min(digits, 20) // 3]  # 1..7
    f.append(8 + (0 if word.isdigit() else 1 if "@" in word else 2 if any(c.isalpha() for c in word) else 3))
    f += [12 + min(word.count("."), 4), 17 + min(word.count("-") + word.count("("), 3)]
    if word.startswith("+"):
        f.append(21)
    if "@" in word and "." in word[word.index("@") :]:
        f.append(22)
    if len(word) > 20:
        f.append(23)
    if digits and word.isalnum() and not word.isdigit():
        f.append(24)
        if all(c in "0123456789abcdefABCDEF" for c in word):
            f.append(25)
    return f


def _around(text: str, start: int, end: int) -> list[int]:
    """Features of the two words before and the one after."""
    before = text[max(0, start - 80) : start].lower().split()
    after = text[end : end + 40].lower().split()
    bucket = lambda w: zlib.crc32(w.strip(_TRIM + "=").encode() or w.encode()) % BUCKETS
    f = [FORMS + BUCKETS * nth + bucket(words[0]) for nth, words in enumerate((before[-1:], before[-2:-1], after[:1])) if words]
    if before and before[-1].rstrip("\"'")[-1:] in ("=", ":"):
        f.append(26)
    return f


def secret_values(text: str) -> list[tuple[int, int]]:
    """Where values that are assigned to a telling name lie: labels to learn from."""
    return [m.span(1) for m in _SECRET.finditer(text) if any("0" <= c <= "9" for c in m[1])]


#: What a node is: still open, observed, or a hidden twin.
OPEN, SEEN, TWIN = 0, 1, 2


class Forms:
    """Features of nodes, one after the other."""

    def __init__(self, rows: Iterable[list[int]] = ()):
        self.flat, self.sizes = array("H"), array("B")
        for row in rows:
            self.add(row)

    def add(self, row: list[int]) -> None:
        self.flat.extend(row)
        self.sizes.append(len(row))

    def __len__(self) -> int:
        return len(self.sizes)

    def rows(self, a: int, b: int) -> list[list[int]]:
        at = sum(self.sizes[:a])
        out = []
        for n in self.sizes[a:b]:
            out.append(self.flat[at : at + n].tolist())
            at += n
        return out

    def scores(self, node: np.ndarray) -> np.ndarray:
        """The sum of each node's weights; every node has a feature."""
        sizes = np.frombuffer(self.sizes, np.uint8).astype(np.int64)
        edges = np.concatenate([[0], sizes.cumsum()])
        flat = np.frombuffer(self.flat, np.uint16)
        out = np.empty((len(sizes), node.shape[1]))
        for lo in range(0, len(sizes), BLOCK):
            hi = min(lo + BLOCK, len(sizes))
            out[lo:hi] = np.add.reduceat(node[flat[edges[lo] : edges[hi]]], edges[lo:hi] - edges[lo], 0)
        return out


def link_keys(word: str, digits: int, before: str) -> tuple[set[str], str]:
    """(keys, digits so far): words of a document that share a key are linked: the same but for case; a number of the same last seven digits, however it is written, or spread over words; the local part of an address; the beginning and the end of a long token."""
    keys = {word.lower()} if digits >= 6 or "@" in word or len(word) >= 16 else set()
    if "@" in word:
        local = word.partition("@")[0].lower()
        if len(local) >= 5:
            keys.add(f"{local}@")
    elif len(word) >= 20 and word.isascii():
        keys |= {f"{word[:12].lower()}..", f"..{word[-12:].lower()}"}
    number = "".join(c for c in word if "0" <= c <= "9")
    plain = len(number) >= 2 and not any(c.isalpha() or c in "@_=" for c in word)
    so_far = (before + number)[-15:] if plain else ""
    if digits >= 6 or len(so_far) >= 7:
        tail = number if len(number) >= 7 else so_far
        if len(tail) >= 7:
            keys.add(f"#{tail[-7:]}")
    return keys, so_far


class Field:
    """The nodes of some texts: features, labels (0: none, kind + 1), which are observed, chain links and skip links.

    In a field to learn from, secrets have their label, and twins follow each node. A node takes some 300 bytes here and
    while messages pass.
    """

    def __init__(self, texts: list[tuple[int, str, list[tuple[int, int, int]]]], learn: bool = False):
        self.text, self.start, self.end, self.forms = array("i"), array("q"), array("q"), Forms()
        labels, roles = array("b"), array("b")
        chain, skip = array("i"), array("i")

        def add(nth: int, a: int, b: int, label: int, role: int, form: list[int]) -> int:
            self.text.append(nth)
            self.start.append(a)
            self.end.append(b)
            labels.append(label)
            roles.append(role)
            self.forms.add(form)
            return len(roles) - 1

        for nth, text, base in texts:
            last_of: dict[str, int] = {}
            spans = Spans(base)
            told = Spans([(len(KINDS), a, b) for a, b in secret_values(text)] if learn else [])
            last, last_end, so_far = -1, -2, ""
            for begin, stop in node_words(text):
                whole = text[begin:stop]
                word = whole.strip(_TRIM)
                digits = sum("0" <= c <= "9" for c in word)
                if not digits and "@" not in word:
                    continue
                a = begin + whole.index(word)
                b = a + len(word)
                label = spans.label(a, b)
                i = add(nth, a, b, label or told.label(a, b), SEEN if label else OPEN, _form(word, digits) + _around(text, begin, stop))
                if begin == last_end + 1:
                    chain.extend((last, i))
                else:
                    so_far = ""
                last, last_end = i, stop
                keys, so_far = link_keys(word, digits, so_far)
                for key in keys:
                    if key in last_of:
                        skip.extend((last_of[key], i))
                    last_of[key] = i
                if learn:
                    hidden = word.lstrip("+(").replace("-", "").rstrip(")")
                    skip.extend((i, add(nth, a, b, labels[i], TWIN, _form(hidden, digits))))
        pairs = lambda x: np.frombuffer(x, np.int32).reshape(-1, 2) if len(x) else np.zeros((0, 2), np.int32)
        self.chain, self.skip = pairs(chain), np.unique(pairs(skip), axis=0)
        self.label, self.role = np.array(labels, np.int8), np.array(roles, np.int8)
        if learn:
            # A word that repeats what a pattern found is of that kind, whether a pattern sees it or not.
            links = list(map(tuple, self.skip.tolist()))
            for some in (links, links[::-1]):
                for i, j in some:
                    self.label[i], self.label[j] = self.label[i] or self.label[j], self.label[j] or self.label[i]
        self.seen = self.role == SEEN


class Spans:
    """Spans (kind, start, end) in which a place is looked up; those of a kind don't overlap."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.of: dict[int, tuple[list[int], list[int]]] = {}
        for kind, a, b in sorted(spans):
            starts, ends = self.of.setdefault(kind, ([], []))
            starts.append(a)
            ends.append(b)

    def label(self, a: int, b: int) -> int:
        """Kind + 1 of the first span that meets a to b, or 0."""
        best = None
        for kind, (starts, ends) in self.of.items():
            i = bisect_right(ends, a)
            if i < len(ends) and starts[i] < b and (best is None or (starts[i], ends[i], kind) < best):
                best = (starts[i], ends[i], kind)
        return 0 if best is None else best[2] + 1


def dense(forms: list[list[int]]) -> np.ndarray:
    x = np.zeros((len(forms), N_FEATURES), np.float32)
    x[np.repeat(np.arange(len(forms)), [len(f) for f in forms]), [i for f in forms for i in f]] = 1
    return x


class Weights:
    def __init__(self):
        n = len(LABELS) + 1
        self.node, self.chain, self.skip = np.zeros((N_FEATURES, n)), np.zeros((n, n)), np.zeros((n, n))
        #: Least marginal of what is added, by label.
        self.least = np.full(len(LABELS), 2.0)


def _shares(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def train(x: np.ndarray, label: np.ndarray, chain: np.ndarray, skip: np.ndarray, rounds: int = 300, rate: float = 0.1, ridge: float = 1e-4) -> Weights:
    """Pseudo-likelihood: each node given its neighbours' labels, and as often without them, so that what a node's own signs tell isn't left to its neighbours; chain and skip are pairs of nodes."""
    w = Weights()
    n = w.node.shape[1]
    if not len(label) or not label.any():
        return w
    hot = np.eye(n)[label]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w.node, w.chain, w.skip)]
    for t in range(1, rounds + 1):
        alone = x @ w.node
        z = alone.copy()
        np.add.at(z, chain[:, 1], w.chain[label[chain[:, 0]]])
        np.add.at(z, chain[:, 0], w.chain[:, label[chain[:, 1]]].T)
        np.add.at(z, skip[:, 1], w.skip[label[skip[:, 0]]])
        np.add.at(z, skip[:, 0], w.skip[label[skip[:, 1]]])
        g, g_alone = hot - _shares(z), hot - _shares(alone)
        g_chain = hot[chain[:, 0]].T @ g[chain[:, 1]] + g[chain[:, 0]].T @ hot[chain[:, 1]]
        g_skip = hot[skip[:, 0]].T @ g[skip[:, 1]] + hot[skip[:, 1]].T @ g[skip[:, 0]]
        for param, gradient, (m, v) in zip((w.node, w.chain, w.skip), (x.T @ ((g + g_alone) / 2), g_chain, (g_skip + g_skip.T) / 2), moments):
            gradient = gradient / len(label) - ridge * param
            m += 0.1 * (gradient - m)
            v += 0.01 * (gradient * gradient - v)
            param += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def marginals(field: Field | Sample, w: Weights, rounds: int = ROUNDS) -> np.ndarray:
    """(nodes, labels) by loopy sum-product messages; observed nodes are fixed. A text's messages stop when none of them changes much, whatever other texts are there."""
    forms = field.forms if isinstance(field.forms, Forms) else Forms(field.forms)
    unary = forms.scores(w.node)
    unary[field.seen] = np.where(np.arange(unary.shape[1]) == np.asarray(field.label)[field.seen, None], 0.0, -50.0)
    text = np.asarray(field.text, np.int64) if len(field.text) == len(unary) else np.zeros(len(unary), np.int64)
    kinds = [(np.asarray(links), pair.astype(np.float32)) for links, pair in ((field.chain, w.chain), (field.skip, w.skip)) if len(links)]
    # Messages to the second and to the first node of each link.
    messages = [[np.zeros((len(links), unary.shape[1]), np.float32) for _ in range(2)] for links, _ in kinds]

    def totals() -> np.ndarray:
        total = unary.copy()
        for (links, _), pair in zip(kinds, messages):
            for side, message in zip((1, 0), pair):
                for label in range(total.shape[1]):
                    total[:, label] += np.bincount(links[:, side], message[:, label], len(total))
        return total

    live = np.ones(int(text.max(initial=0)) + 1, bool)
    for _ in range(rounds if kinds else 0):
        total, change = totals(), np.zeros(len(live), np.float32)
        for (links, potential), pair in zip(kinds, messages):
            for lo in range(0, len(links), BLOCK):
                at = lo + np.flatnonzero(live[text[links[lo : lo + BLOCK, 0]]])
                if len(at):
                    old = [pair[0][at], pair[1][at]]
                    for side in (0, 1):
                        new = _passed(total[links[at, side]] - old[1 - side], potential.T if side else potential)
                        np.maximum.at(change, text[links[at, 0]], np.abs(new - old[side]).max(1))
                        pair[side][at] = (old[side] + new) / 2
        live &= change >= 1e-3
        if not live.any():
            break
    return _shares(totals())


def _passed(sent: np.ndarray, potential: np.ndarray) -> np.ndarray:
    """What arrives over links of one potential, in logarithms, the largest 0."""
    out = sent[:, :, None] + potential
    top = out.max(1, keepdims=True)
    new = np.log(np.maximum(np.exp(out - top).sum(1), 1e-30)) + top[:, 0]
    return new - new.max(1, keepdims=True)


def added_spans(field: Field, w: Weights) -> dict[int, list[tuple[int, int, int]]]:
    """Spans by text that the field adds; neighbouring words of a kind make one span, but for secrets."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    if not len(field.label) or not w.node.any():
        return out
    p = marginals(field, w)
    best = p[:, 1:].argmax(1)
    before_of = np.full(len(field.label), -1, np.int32)
    before_of[field.chain[:, 1]] = field.chain[:, 0]
    made: dict[int, tuple[int, int]] = {}
    for i in np.flatnonzero(~field.seen & (p[:, 1:].max(1) >= w.least[best])).tolist():
        kind, spans = int(best[i]), out.setdefault(field.text[i], [])
        if (before := int(before_of[i])) in made and made[before][1] == kind < len(KINDS):
            at = made[before][0]
            spans[at] = (kind, spans[at][1], field.end[i])
        else:
            at = len(spans)
            spans.append((kind, field.start[i], field.end[i]))
        made[i] = (at, kind)
    return out


_LOOK = np.zeros(256, bool)
_LOOK[48:58] = _LOOK[64] = True


def _texts(column: pa.Array, step_bytes: int = 4 << 20) -> Iterator[tuple[int, int, list[tuple[int, str, list[tuple[int, int, int]]]]]]:
    """(first row, row after the last, texts with a digit or an at sign and what the patterns find in them)."""
    for lo, hi, data, offsets in text_steps(column, step_bytes):
        sums = np.concatenate([[0], _LOOK[data].cumsum()])
        rows = np.flatnonzero(sums[offsets[1:]] > sums[offsets[:-1]])
        texts = [data[offsets[r] : offsets[r + 1]].tobytes().decode() for r in rows.tolist()]
        yield lo, hi, [(r, t, base_spans(t)) for r, t in zip(rows.tolist(), texts)]


_UNIT = f"k {KEY}, nth int, sizes array<int>, forms array<int>, label array<int>, role array<int>, chain array<int>, skip array<int>"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training nodes, a row for each stretch of FIT_NODES nodes of a text; links between stretches are left out."""
    ints = pa.list_(pa.int32())
    for batch in batches:
        out: list[list] = [[], [], [], [], [], [], [], []]
        for lo, _, texts in _texts(batch.column(1)):
            for r, text, base in texts:
                field = Field([(r, text, base)], learn=True)
                for nth in range(-(-len(field.label) // FIT_NODES)):
                    a, b = nth * FIT_NODES, min(len(field.label), (nth + 1) * FIT_NODES)
                    forms = field.forms.rows(a, b)
                    within = [x[((x >= a) & (x < b)).all(1)] - a for x in (field.chain, field.skip)]
                    row = [lo + r, nth, [len(f) for f in forms], [i for f in forms for i in f], field.label[a:b].tolist(), field.role[a:b].tolist(), *[x.ravel().tolist() for x in within]]
                    for o, v in zip(out, row):
                        o.append(v)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *[pa.array(o, ints) for o in out[2:]]], ["k", "nth", "sizes", "forms", "label", "role", "chain", "skip"]
        )


class Sample:
    """Stretches put together: what Field has, without places."""

    def __init__(self, rows: list[dict]):
        self.text = np.repeat(np.arange(len(rows)), [len(r["sizes"]) for r in rows])
        self.forms, chain, skip, at = [], [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)], 0
        for r in rows:
            edges = np.concatenate([[0], np.cumsum(r["sizes"])])
            self.forms += [r["forms"][a:b] for a, b in zip(edges[:-1], edges[1:])]
            chain.append(np.array(r["chain"], np.int64).reshape(-1, 2) + at)
            skip.append(np.array(r["skip"], np.int64).reshape(-1, 2) + at)
            at += len(r["sizes"])
        self.x, self.chain, self.skip = dense(self.forms), np.concatenate(chain), np.concatenate(skip)
        self.label = np.array([x for r in rows for x in r["label"]], np.int64)
        self.role = np.array([x for r in rows for x in r["role"]], np.int64)
        self.seen = self.role == SEEN


def thresholds(held: Sample, w: Weights) -> np.ndarray:
    """For each label the least of LEVELS at which PRECISE of what would be added is right, or 2 if there is none: among the twins, and among the other words alike."""
    least = np.full(len(LABELS), 2.0)
    if not len(held.label) or not w.node.any():
        return least
    p = marginals(held, w)[:, 1:]
    best, most = p.argmax(1), np.where(held.seen, 0.0, p.max(1))
    for kind in range(len(LABELS)):
        for level in LEVELS:
            hit = (best == kind) & (most >= level)
            right = held.label == kind + 1
            if hit.any() and all(right[hit & group].mean() >= PRECISE for group in (held.role == TWIN, held.role == OPEN) if (hit & group).any()):
                least[kind] = level
                break
    return least


def learn(rows: list[dict]) -> Weights:
    """Weights of stretches, of which every fifth is held out for the threshold."""
    fitted, held = Sample([r for i, r in enumerate(rows) if i % 5]), Sample(rows[::5])
    w = train(fitted.x, fitted.label, fitted.chain, fitted.skip)
    w.least = thresholds(held, w)
    return w


def fit(rows: DataFrame, fit_docs: int = FIT_DOCS, fit_units: int = FIT_UNITS) -> Weights:
    """Weights from the stretches of about fit_docs of rows (k, text) that hold a digit or an at sign, at most fit_units."""
    rows = rows.select("k", "text").filter(F.col("text").rlike("[0-9@]"))
    n = rows.count()
    parts = 1 << 30
    cut = parts if n <= fit_docs else max(1, parts * fit_docs // n)
    units = rows.filter(F.pmod(F.xxhash64("k", F.lit("fit")), F.lit(parts)) < cut).mapInArrow(_units, _UNIT)
    sample = units.orderBy(F.xxhash64("k", "nth"), "k", "nth").limit(fit_units).drop("k", "nth").toArrow()
    return learn(sample.to_pylist())


def _find(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Weights = weights.value
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            for lo, hi, texts in _texts(batch.column(1)):
                more = added_spans(Field(texts), w)
                base, spans = [[] for _ in range(hi - lo)], [[] for _ in range(hi - lo)]
                for r, _, found in texts:
                    as_rows = lambda x: [{"kind": LABELS[k], "start": a, "end": b} for k, a, b in sorted(x)]
                    base[r] = as_rows(found)
                    spans[r] = as_rows(found + more.get(r, [])) if r in more else base[r]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(base, pa.list_(kind)), pa.array(spans, pa.list_(kind))], ["doc_id", "base", "spans"])

    return run


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end), of the patterns alone and of all."""
    rows = keyed(docs, id_col, text_col)
    weights = docs.sparkSession.sparkContext.broadcast(fit(rows))
    spans = "array<struct<kind: string, start: long, end: long>>"
    return rows.select("doc_id", "text").mapInArrow(_find(weights), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, base {spans}, spans {spans}")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in KINDS]
    added = F.size("spans") - F.size("base")
    return found.select(
        "doc_id", *counts, F.sha2(line(F.col("base")).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), added.cast("long").alias("n_added"), F.size("spans").cast("long").alias("n_spans")
    )

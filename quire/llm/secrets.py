"""Secret scans: fixed base rules, and probabilistic automata inferred from labelled credentials.

Learning: one pass over all texts gives the credentials that the base rules label, of which each kind's ``per_kind`` first
by hash go to the driver (so the sample is bounded and drawn from the whole corpus), with ten times as many ordinary
tokens of one document in ``sample_of``. Public token formats are labelled by generated examples. For each kind of 20
examples or more a prefix tree with counts is built and states are merged into a probabilistic automaton: of the red
states whose continuations are statistically compatible (Hoeffding bound on symbols and ends) and whose expected
remaining length is the same, as far as the counts can tell, the nearest in remaining length. So prefix and length of a
format stay in the automaton, and what varies at a place is pooled.

Scoring (all texts): every token of 12 characters on, whatever its letters, is scored by the best automaton's log
likelihood over that of the best other explanation: the character pairs of ordinary tokens, or characters drawn at random
from the classes that the token uses. A token that only looks random (a UUID, base64, a checksum) has no advantage over
the latter. From ``threshold`` (nats) on it is a span of kind ``format``; beside a base span the rest of its token is
scored, too, and the whole token if it explains more than the span in it. Base spans are never touched. Positions are code
points, ends exclusive; a base span is the whole match.

Nulls: a null text counts as empty; a null id is kept. Empty tables give empty results. Repeated rows and ids are judged
one by one. A very long text is scanned whole, in time linear in its length. Columns of other names pass through;
``find`` replaces one called q_spans, ``redact`` one called redacted.
"""

from __future__ import annotations

import heapq
import math
import random
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import annotate, lean

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")  # the runs that HEX's matches keep after the length test
KINDS = ("assign", "access", "hex", "format")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{12,}")
_MIXED = re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])")
MAX_SYMBOLS = 256  # of a training string: the prefix tree is bounded, and a cut counts no end; scoring reads whole tokens


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind index, end, secret) of the base rules, by start, then kind."""
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX_LONG.finditer(text)]
    return sorted(out)


class Automaton:
    """A probabilistic automaton: per state the counts of symbols, their targets and of ends, and the sums of the lengths
    (and of their squares) that remained there."""

    back = 20.0  # how many observations the symbols of the whole format weigh against a state's own

    def __init__(self):
        self.count: list[dict[str, int]] = []
        self.to: list[dict[str, int]] = []
        self.ends: list[int] = []
        self.left: list[list[int]] = []
        self.logs: list[dict[str, float]] = []

    def new(self) -> int:
        self.count.append({})
        self.to.append({})
        self.ends.append(0)
        self.left.append([0, 0, 0])  # strings, remaining lengths, their squares
        return len(self.ends) - 1

    def total(self, q: int) -> int:
        return self.left[q][0]

    @classmethod
    def tree(cls, words) -> Automaton:
        a = cls()
        a.new()
        for w in words:
            q, n = 0, min(len(w), MAX_SYMBOLS)
            for i in range(n + 1):
                left = a.left[q]
                left[0], left[1], left[2] = left[0] + 1, left[1] + n - i, left[2] + (n - i) ** 2
                if i < n:
                    c = w[i]
                    a.count[q][c] = a.count[q].get(c, 0) + 1
                    if c not in a.to[q]:
                        a.to[q][c] = a.new()
                    q = a.to[q][c]
            a.ends[q] += len(w) <= MAX_SYMBOLS  # a cut is no end
        return a

    def apart(self, p: int, q: int) -> float | None:
        """How far the expected remaining lengths are apart; None if further than their counts explain."""
        (n, s, s2), (m, t, t2) = self.left[p], self.left[q]
        far = abs(s / n - t / m)
        spread = max(0.0, (s2 + t2) / (n + m) - ((s + t) / (n + m)) ** 2 - n * m * far * far / (n + m) ** 2)
        return far if far <= max(0.5, 2 * math.sqrt(spread * (1 / n + 1 / m))) else None

    def compatible(self, p: int, q: int, alpha: float) -> bool:
        todo, factor = [(p, q)], math.sqrt(0.5 * math.log(2 / alpha))
        while todo:
            p, q = todo.pop()
            n, m = self.total(p), self.total(q)
            if not n or not m:
                continue
            bound = factor * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if bound >= 1:  # so few strings contradict nothing, and neither do those below
                continue
            if abs(self.ends[p] / n - self.ends[q] / m) > bound:
                return False
            for c in self.count[p].keys() | self.count[q].keys():
                if abs(self.count[p].get(c, 0) / n - self.count[q].get(c, 0) / m) > bound:
                    return False
                if c in self.to[p] and c in self.to[q] and self.to[p][c] != self.to[q][c]:
                    todo.append((self.to[p][c], self.to[q][c]))
        return True

    def fold(self, p: int, q: int) -> list[tuple[int, str]]:
        """Add the subtree of ``q`` to ``p``; the transitions that are new."""
        todo, gained = [(p, q)], []
        while todo:
            p, q = todo.pop()
            self.ends[p] += self.ends[q]
            self.left[p] = [x + y for x, y in zip(self.left[p], self.left[q], strict=True)]
            for c, n in self.count[q].items():
                self.count[p][c] = self.count[p].get(c, 0) + n
                if c in self.to[p]:
                    todo.append((self.to[p][c], self.to[q][c]))
                else:
                    self.to[p][c] = self.to[q][c]
                    gained.append((p, c))
        return gained

    @classmethod
    def infer(cls, words, alpha: float = 0.02) -> Automaton:
        a = cls.tree(sorted(words))
        red, known = [0], {0}
        blue = [(-a.total(q), q, 0, c) for c, q in a.to[0].items()]  # states of many strings first: they tell most
        heapq.heapify(blue)
        while blue:
            _, q, parent, c = heapq.heappop(blue)
            near = sorted((far, r) for r in red if (far := a.apart(r, q)) is not None)
            for _, r in near:
                if a.compatible(r, q, alpha):
                    a.to[parent][c] = r
                    new = [(p, s) for p, s in a.fold(r, q) if p in known]
                    break
            else:
                red.append(q)
                known.add(q)
                new = [(q, s) for s in a.to[q]]
            for p, s in new:
                t = a.to[p][s]
                if t not in known:
                    heapq.heappush(blue, (-a.total(t), t, p, s))
        return a.packed(red)

    def packed(self, red: list[int]) -> Automaton:
        at, out = {q: i for i, q in enumerate(red)}, Automaton()
        every: dict[str, int] = {}
        for q in red:
            for c, n in self.count[q].items():
                every[c] = every.get(c, 0) + n
        symbols = sum(every.values())
        seen = lambda c: (every.get(c, 0) + 0.5) / (symbols + 48)
        for q in red:
            n = self.total(q) + self.back
            out.count.append(dict(self.count[q]))
            out.to.append({c: at[t] for c, t in self.to[q].items()})
            out.ends.append(self.ends[q])
            out.left.append(list(self.left[q]))
            # the ends of all states are as many as the strings: one in symbols / strings places
            end = self.total(0) / max(1, symbols + self.total(0))
            table = {c: math.log((self.count[q].get(c, 0) + self.back * (1 - end) * seen(c)) / n) for c in every}
            table[""] = math.log((self.ends[q] + self.back * end) / n)
            table["?"] = math.log(self.back * (1 - end) * seen("") / n)
            out.logs.append(table)
        return out

    def score(self, word: str) -> float:
        """Log likelihood; a symbol that a state has not seen keeps the state."""
        q, total = 0, 0.0
        for c in word:
            table = self.logs[q]
            total += table.get(c, table["?"])
            q = self.to[q].get(c, q)
        return total + self.logs[q][""]


class Ordinary:
    """Character pairs of ordinary tokens, with the same treatment of the unseen."""

    def __init__(self, words):
        self.pair: dict[str, int] = {}
        self.one: dict[str, int] = {}
        for w in words:
            for a, b in zip("^" + w, w + "$", strict=True):
                self.pair[a + b] = self.pair.get(a + b, 0) + 1
                self.one[a] = self.one.get(a, 0) + 1

    def score(self, word: str) -> float:
        """A word in capitals is as ordinary as it is in small letters, but for one in about 50 words written so."""
        return max(self._pairs(word), self._pairs(word.lower()) - 4.0) if word.isupper() else self._pairs(word)

    def _pairs(self, word: str) -> float:
        return sum(math.log((self.pair.get(a + b, 0) + 0.5) / (self.one.get(a, 0) + 48)) for a, b in zip("^" + word, word + "$", strict=True))


_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/_.=-")


def at_random(word: str) -> float:
    """Log likelihood of characters drawn evenly from the classes that the word uses (hexadecimal ones are a class of their
    own); any length up to 64 is as likely."""
    used = set(word)
    size = 16 if used <= set("0123456789abcdef") else sum(len(c) for c in _CLASSES if used & set(c)) or 96
    return -len(word) * math.log(size) - math.log(64)


#: Public token formats as (prefix, alphabet, length after the prefix).
FORMATS = {
    "access": ("AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16),
    "github": ("ghp_", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 36),
    "slack": ("xoxb-", "0123456789", 24),
    "google": ("AIza", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-", 35),
    "stripe": ("sk_live_", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 24),
    "jwt": ("eyJhbGciOi", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-", 60),
}


def generated(n: int, seed: int = 7) -> dict[str, list[str]]:
    r = random.Random(seed)
    return {kind: [prefix + "".join(r.choices(letters, k=length)) for _ in range(n)] for kind, (prefix, letters, length) in FORMATS.items()}


class Model:
    def __init__(self, credentials: dict[str, list[str]], ordinary: list[str]):
        self.kinds = {k: Automaton.infer(v) for k, v in credentials.items() if len(v) >= 20}
        self.ordinary = Ordinary(ordinary)

    def advantage(self, token: str) -> float:
        """By how many nats the best format explains the token better than ordinary text or chance do."""
        if not self.kinds:
            return -math.inf
        return max(a.score(token) for a in self.kinds.values()) - max(self.ordinary.score(token), at_random(token))


def learn(docs: DataFrame, text: str = "text", key: str = "doc_id", sample_of: int = 16, per_kind: int = 400) -> Model:
    """The model of a corpus, from one pass over it: at most ``per_kind`` credentials of each kind, and ten times that of the
    ordinary tokens of one in ``sample_of`` documents, the first by hash."""
    limits = {"assign": per_kind, "hex": per_kind, "access": per_kind, "plain": 10 * per_kind}

    def values(batches):
        for b in batches:
            found: set[tuple[str, str]] = set()
            for t, sampled in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                spans = base_spans(t or "")
                found.update((KINDS[k], v[: MAX_SYMBOLS + 1]) for _, k, _, v in spans)  # one more tells of a cut
                if sampled:
                    secret = {v for *_, v in spans}
                    plain = {w[:MAX_SYMBOLS] for w in re.findall(r"[A-Za-z0-9+/_.=-]{4,}", t or "")} - secret
                    # long mixed tokens are candidates, not ordinary ones
                    found.update(("plain", w) for w in plain if not (len(w) >= 20 and _MIXED.match(w)) and not any(w in s or s in w for s in secret))
            rows = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.string())], names=["kind", "value"])

    sampled = F.coalesce(F.pmod(F.xxhash64(F.col(key), F.lit("secrets")), F.lit(sample_of)) == 0, F.lit(False))
    got = docs.select(F.col(text), sampled.alias("sampled")).mapInArrow(lean(values), "kind string, value string").distinct()
    # the limit of the rank is applied before the rows are sent
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value"))
    rows = got.withColumn("rank", rank).filter(F.col("rank") <= 10 * per_kind)
    credentials, plain = generated(per_kind), []
    for r in rows.collect():  # at most 40 x per_kind strings of at most MAX_SYMBOLS + 1 characters
        if r["rank"] <= limits[r["kind"]]:
            (plain if r["kind"] == "plain" else credentials.setdefault(r["kind"], [])).append(r["value"])
    return Model(credentials, sorted(plain))


def format_spans(t: str, base: list[tuple[int, int]], advantage, threshold: float) -> list[tuple[int, int]]:
    """The spans (start, end) that the automata add to ``base``, sorted base spans: one walk over tokens and spans."""
    out, live, nxt = [], [], 0
    for m in CANDIDATE.finditer(t):
        low, high = m.span()
        while nxt < len(base) and base[nxt][0] < high:
            live.append(base[nxt])
            nxt += 1
        live = [x for x in live if x[1] > low]  # a span that ends before this token meets no later one
        inside = [(max(s, low), min(e, high)) for s, e in live]
        # a token that holds base spans must be explained better as a whole than they are, or a part beside them
        at, beside = low, []
        for s, e in inside:
            beside.append((at, s))
            at = max(at, e)
        beside = [(s, e) for s, e in [*beside, (at, high)] if s < e]
        if not beside:
            continue
        known = max((advantage(t[s:e]) for s, e in inside), default=0.0)
        if advantage(m[0]) >= threshold + max(known, 0.0):
            out.append((low, high))
        elif inside:
            out += [(s, e) for s, e in beside if e - s >= 12 and advantage(t[s:e]) >= threshold]
    return out


def find(docs: DataFrame, model: Model, text: str = "text", threshold: float = 10.0) -> DataFrame:
    """``docs`` with q_spans array<struct<kind string, start int, end int>>, by start, then kind."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(texts):
        advantage = lru_cache(100_000)(model.advantage)
        out = []
        for t in texts.to_pylist():
            spans = [(s, k, e) for s, k, e, _ in base_spans(t)] if t else []
            if t:
                spans += [(s, 3, e) for s, e in format_spans(t, sorted((s, e) for s, _, e in spans), advantage, threshold)]
            out.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(spans)])
        return [pa.array(out, kind)]

    return annotate(docs, "q_spans array<struct<kind string, start int, end int>>", run, [text])


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` (with q_spans) with the spans' texts replaced by ``mark``; overlapping spans become one mark."""

    def run(texts, spans):
        out = []
        for t, found in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            if t is None:
                out.append(None)
                continue
            parts, at = [], 0
            for s in found:
                if s["start"] >= at:
                    parts += (t[at : s["start"]], mark)
                at = max(at, s["end"])
            out.append("".join([*parts, t[at:]]))
        return [pa.array(out, pa.string())]

    return annotate(docs, "redacted string", run, [text, "q_spans"])


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from what ``find`` found."""
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("q_spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("q_spans", lambda s: s["kind"] != "format")
    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("q_spans")).alias("spans"))



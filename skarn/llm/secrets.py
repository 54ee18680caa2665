"""Secret scan: fixed patterns, and formats that are inferred from what the patterns find.

Base patterns (leftmost, not overlapping within a kind; matches that are too short are dropped): ``assign`` (a name like ``token``, ``:`` or ``=``, and a
value of 12 characters), ``access`` (``AKIA`` and capitals or digits, 18 in all) and ``hex`` (16 digits or ``a``-``f``).  A base span is the whole match.

Method: grammar inference.  Matches of the base patterns are labelled credentials.  For each kind a prefix tree of its values is
folded into a probabilistic automaton: states whose endings and next characters (and those of their successors) don't differ by more than a Hoeffding
bound are merged (``infer``).  A further automaton learns ordinary tokens.  Every candidate of every document is then scored: a maximal
run of 12 value characters or more that touches no base span.  It is added with the kind of highest likelihood if

- its likelihood a character is ``RATIO`` nats or more above that under the ordinary automaton,
- it is no less likely than all but ``UNUSUAL`` of the kind's credentials that were kept out of training,
- and ``LEAST_LENGTH`` of the kind's credentials are about as long (within a tenth).

The ordinary automaton is learned from candidates, of which some may be secrets that no pattern finds, so it is learned twice: the second time
without those that the first one's scores would add.

One pass over the texts writes spans, values and candidates; training reads up to ``PER_KIND`` different values of each kind and ``ORDINARY`` different
candidates, by hash order (the documented bound of the sample; values longer than ``LONGEST`` are not learned from, but all are scored).  A kind with fewer than
``LEAST_LABELLED`` values learns nothing and adds nothing.  A model can be kept and used on other tables.

Defined cases: null and empty texts have no spans; texts are read whole, whatever their length; repeated rows give repeated results; an empty
table gives no rows; other columns are not read.  Offsets are code points.  Spans are ordered by start, then by kind as listed.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import pieces, text_buffers

KINDS = ("assign", "access", "hex")
#: Fixed patterns and least lengths.
ASSIGN = re.compile(rb"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 12, 18, 16

#: Size of the training samples, and of the values in them.
PER_KIND, ORDINARY, LONGEST, LEAST_LABELLED = 1000, 3000, 256, 20
#: Merging is refused where frequencies differ with this confidence.
ALPHA = 0.01
SMOOTHING = 0.02
RATIO, UNUSUAL, LEAST_LENGTH = 0.5, 0.01, 0.01

_HEX, _TOKEN, _SYMBOLS = np.zeros(256, bool), np.zeros(256, bool), b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
_HEX[list(b"0123456789abcdef")] = True
_TOKEN[list(_SYMBOLS.replace(b"=", b""))] = True

FOUND_SCHEMA = "doc_id long, base array<struct<kind:int,start:int,end:int>>, cands array<struct<start:int,end:int,token:string>>, known array<struct<kind:int,value:string>>"
SPAN_SCHEMA = "doc_id long, spans array<struct<kind:int,start:int,end:int,base:boolean,score:double>>"


def runs(raw: np.ndarray, at: np.ndarray, inside: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of ``inside`` bytes within one text, of ``least`` bytes or more."""
    held = np.zeros(len(raw) + 2, bool)
    held[1:-1] = inside[raw]
    change = held[1:] != held[:-1]
    starts, ends = np.flatnonzero(change & held[1:]), np.flatnonzero(change & held[:-1])
    inner = np.unique(at[(at > 0) & (at < len(raw))])
    inner = inner[held[inner] & held[inner + 1]]  # a text ends within a run
    starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
    long = ends - starts >= least
    return starts[long], ends[long]


def _hits(data: bytes, word: bytes) -> Iterator[int]:
    at = data.find(word)
    while at >= 0:
        yield at
        at = data.find(word, at + 1)


def _base(data: bytes, raw: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """(kind, start, end, value) of base matches, at byte places of a piece; texts without a pattern's fixed part are not searched for it."""
    found = [(2, int(i), int(j), data[i:j]) for i, j in zip(*runs(raw, at, _HEX, LEAST_HEX), strict=True)]
    low = data.lower()
    for kind, pattern, where in ((0, ASSIGN, [p for n in NAMES for p in _hits(low, n)]), (1, ACCESS, list(_hits(data, b"AKIA")))):
        for d in np.unique(np.searchsorted(at, np.array(where, np.int64), side="right") - 1).tolist():
            for m in pattern.finditer(data[at[d] : at[d + 1]]):
                value = m[1] if kind == 0 else m[0]
                if len(value) >= (LEAST_ACCESS if kind else LEAST_VALUE):
                    found.append((kind, int(at[d]) + m.start(), int(at[d]) + m.end(), value))
    return sorted(found, key=lambda f: (f[1], f[0]))


def _candidates(data: bytes, raw: np.ndarray, at: np.ndarray, base: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int]]:
    """Byte spans of candidates: runs with up to two ``=`` after them, without marks at the ends, that touch no base span."""
    starts, ends = runs(raw, at, _TOKEN, LEAST_VALUE)
    limit = at[np.searchsorted(at, starts, side="right")]
    for _ in range(2):
        more = ends < limit
        more[more] = raw[ends[more]] == 61
        ends = ends + more
    if base:
        covered = np.zeros(len(raw) + 1, np.int64)
        for _, i, j, _ in base:
            covered[i] += 1
            covered[j] -= 1
        total = np.concatenate([[0], np.cumsum(np.cumsum(covered)[:-1] > 0)])
        free = total[ends] == total[starts]
        starts, ends = starts[free], ends[free]
    out = []
    for i, j in zip(starts.tolist(), ends.tolist(), strict=True):
        token = data[i:j]
        i += len(token) - len(token.lstrip(b"./_-"))
        j -= len(token) - len(token.rstrip(b"./_-"))
        if j - i >= LEAST_VALUE:
            out.append((i, j))
    return out


def _lists(owner: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), values)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in pieces(batch.column("text")):
            raw, at = text_buffers(batch.column("text")[lo:hi])
            data = raw.tobytes()
            base = _base(data, raw, at)
            cands = _candidates(data, raw, at, base)
            after = np.concatenate([[0], np.cumsum((raw & 0xC0) == 0x80)])
            spans = np.array([f[1:3] for f in base] + cands, np.int64).reshape(-1, 2)
            text = np.searchsorted(at, spans[:, 0], side="right") - 1
            start, end = (pa.array(p.astype(np.int32)) for p in (spans - after[spans] - (at[text] - after[at[text]])[:, None]).T)
            n = len(base)
            kinds = pa.array([f[0] for f in base], pa.int32())
            known = pa.StructArray.from_arrays([kinds, pa.array([f[3].decode() for f in base], pa.string())], ["kind", "value"])
            found = pa.StructArray.from_arrays([kinds, start[:n], end[:n]], ["kind", "start", "end"])
            tokens = pa.StructArray.from_arrays([start[n:], end[n:], pa.array([data[i:j].decode() for i, j in cands], pa.string())], ["start", "end", "token"])
            size = hi - lo
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], _lists(text[:n], size, found), _lists(text[n:], size, tokens), _lists(text[:n], size, known)], ["doc_id", "base", "cands", "known"])


@dataclass
class Automaton:
    """Log-probabilities: ``step[state, byte]``, ``stop[state]``; ``move[state, byte]`` is the next state."""

    step: np.ndarray
    stop: np.ndarray
    move: np.ndarray

    def scores(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Mean log-likelihood a character (the end counts as one) of tokens that lie end to end; all tokens take a step together."""
        size = np.diff(at)
        order = np.argsort(-size, kind="stable")
        begin, total, state = at[:-1][order], np.zeros(len(size)), np.zeros(len(size), np.int64)
        down = -size[order]
        for j in range(int(size.max(initial=0))):
            m = int(np.searchsorted(down, -j, side="left"))  # tokens longer than j
            c = raw[begin[:m] + j]
            total[:m] += self.step[state[:m], c]
            state[:m] = self.move[state[:m], c]
        total += self.stop[state]
        out = np.empty(len(size))
        out[order] = total / (size[order] + 1)
        return out


def infer(values: Sequence[bytes], alpha: float = ALPHA) -> Automaton:
    """A probabilistic automaton of ``values``.

    States of their prefix tree are looked at by falling count.  Each is merged with the compatible state under which what follows it is
    likeliest (rare states are compatible with many), or kept if there is none.
    """
    count, ends, child = [0], [0], [{}]
    for v in values:
        s = 0
        count[0] += 1
        for c in v:
            if c not in child[s]:
                child[s][c] = len(count)
                count.append(0)
                ends.append(0)
                child.append({})
            s = child[s][c]
            count[s] += 1
        ends[s] += 1
    reach = math.sqrt(0.5 * math.log(2 / alpha))
    taken: list[defaultdict[int, int]] = [defaultdict(int, {c: count[t] for c, t in child[s].items()}) for s in range(len(count))]

    def differ(a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) > reach * (n**-0.5 + m**-0.5)

    def compatible(r: int, q: int) -> bool:
        todo = [(r, q)]
        while todo:
            x, y = todo.pop()
            n, m = count[x], count[y]
            if differ(ends[x], n, ends[y], m) or any(differ(taken[x].get(c, 0), n, taken[y].get(c, 0), m) for c in taken[x].keys() | taken[y].keys()):
                return False
            todo += [(child[x][c], t) for c, t in child[y].items() if c in child[x] and child[x][c] != t]
        return True

    def fold(r: int, q: int) -> None:
        """Adds the subtree of ``q``, which no merged state reaches, to ``r``."""
        todo = [(r, q)]
        while todo:
            x, y = todo.pop()
            count[x] += count[y]
            ends[x] += ends[y]
            for c, n in taken[y].items():
                taken[x][c] += n
            for c, t in child[y].items():
                if c in child[x]:
                    todo.append((child[x][c], t))
                else:
                    child[x][c] = t

    def chance(n: int, whole: int) -> float:
        return math.log((n + SMOOTHING) / (whole + SMOOTHING * (len(_SYMBOLS) + 1)))

    def likely(r: int, q: int) -> float:
        return ends[q] * chance(ends[r], count[r]) + sum(n * chance(taken[r].get(c, 0), count[r]) for c, n in taken[q].items())

    kept, done = [0], {0}
    while True:
        open_ = [(r, c, t) for r in kept for c, t in sorted(child[r].items()) if t not in done]
        if not open_:
            break
        parent, c, q = max(open_, key=lambda o: count[o[2]])
        same = [r for r in kept if compatible(r, q)]
        if same:
            r = max(same, key=lambda r: likely(r, q))
            child[parent][c] = r
            fold(r, q)
        else:
            kept.append(q)
            done.add(q)

    number = {s: i for i, s in enumerate(kept)}
    k, symbols = len(kept), list(_SYMBOLS)
    step, stop, move = np.full((k, 256), -50.0), np.zeros(k), np.zeros((k, 256), np.int64)
    for s, i in number.items():
        stop[i] = chance(ends[s], count[s])
        for c in symbols:
            step[i, c] = chance(taken[s].get(c, 0), count[s])
            move[i, c] = number[child[s][c]] if c in child[s] else 0  # an unknown character begins anew
    return Automaton(step, stop, move)


@dataclass
class Format:
    """What is known of one kind: its automaton, the least usual likelihood, and sorted lengths of its credentials."""

    kind: int
    automaton: Automaton
    least: float
    sizes: np.ndarray

    def usual(self, size: np.ndarray) -> np.ndarray:
        near = np.searchsorted(self.sizes, np.floor(1.1 * size), side="right") - np.searchsorted(self.sizes, np.ceil(0.9 * size), side="left")
        return near >= max(1, LEAST_LENGTH * len(self.sizes))


@dataclass
class Model:
    formats: list[Format]
    ordinary: Automaton

    def judge(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Kind (-1: none) and score (likelihood ratio a character) of tokens that lie end to end."""
        size = np.diff(at)
        kind, score, best = np.full(len(size), -1), np.full(len(size), -np.inf), np.full(len(size), -np.inf)
        if not len(size) or not self.formats:
            return kind, score
        plain = self.ordinary.scores(raw, at)
        for f in self.formats:
            own = f.automaton.scores(raw, at)
            good = (own - plain >= RATIO) & (own >= f.least) & f.usual(size) & (own > best)
            kind[good], score[good], best[good] = f.kind, (own - plain)[good], own[good]
        return kind, score


def _joined(values: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(values), np.uint8), np.concatenate([[0], np.cumsum([len(v) for v in values], dtype=np.int64)]).astype(np.int64)


def train(known: dict[int, list[bytes]], ordinary: list[bytes]) -> Model:
    """``known``: credentials of each kind; ``ordinary``: tokens, some of which may be credentials.  One value in five sets the limits."""
    formats = []
    for kind, values in sorted(known.items()):
        if len(values) >= LEAST_LABELLED:
            automaton = infer([v for i, v in enumerate(values) if i % 5])
            kept_out = np.sort(automaton.scores(*_joined(values[::5])))
            formats.append(Format(kind, automaton, float(kept_out[int(UNUSUAL * len(kept_out))]), np.sort([len(v) for v in values])))
    model = Model(formats, infer(ordinary))
    if ordinary and formats:
        kind, _ = model.judge(*_joined(ordinary))
        doubtful = [k >= 0 or _likely(formats, model.ordinary, v) for k, v in zip(kind, ordinary, strict=True)]
        model.ordinary = infer([v for d, v in zip(doubtful, ordinary, strict=True) if not d])
    return model


def _likely(formats: list[Format], ordinary: Automaton, token: bytes) -> bool:
    """A token that is usual for a kind, and likelier so than as an ordinary one."""
    one = _joined([token])
    own = max(f.automaton.scores(*one)[0] if f.automaton.scores(*one)[0] >= f.least else -np.inf for f in formats)
    return own > ordinary.scores(*one)[0]


def _sampled(rows: DataFrame, value: str, n: int) -> list[bytes]:
    """``n`` different values by hash order; lists end up in the driver, ``n * LONGEST`` bytes at most."""
    some = rows.where(F.length(value) <= LONGEST).select(value).distinct()
    return [r[0].encode() for r in some.orderBy(F.xxhash64(value), value).limit(n).collect()]


def learn(found: DataFrame) -> Model:
    """A model of the credentials and candidates of a scanned table."""
    known = found.select(F.explode("known").alias("k")).select("k.kind", "k.value")
    tokens = found.select(F.explode("cands").alias("c")).select("c.token")
    return train({i: _sampled(known.where(F.col("kind") == i), "value", PER_KIND) for i in range(len(KINDS))}, _sampled(tokens, "token", ORDINARY))


def _judged(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            owner = lambda c: np.repeat(np.arange(len(batch)), batch.column(c).value_lengths().to_numpy(zero_copy_only=False))  # noqa: B023, E731
            base, cands = batch.column("base").flatten(), batch.column("cands").flatten()
            kind, score = model.judge(*text_buffers(cands.field("token")))
            new = np.flatnonzero(kind >= 0)
            number = lambda x, c: x.field(c).to_numpy(zero_copy_only=False)
            of = np.concatenate([owner("base"), owner("cands")[new]])
            kinds = np.concatenate([number(base, "kind"), kind[new]]).astype(np.int32)
            start, end = (np.concatenate([number(base, c), number(cands, c)[new]]).astype(np.int32) for c in ("start", "end"))
            order = np.lexsort((kinds, start, of))
            own = np.arange(len(of)) < len(base)
            scores = np.concatenate([np.zeros(len(base)), score[new]])
            spans = pa.StructArray.from_arrays([pa.array(kinds[order]), pa.array(start[order]), pa.array(end[order]), pa.array(own[order]), pa.array(scores[order], mask=own[order])], ["kind", "start", "end", "base", "score"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(of[order], len(batch), spans)], ["doc_id", "spans"])

    return run


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id`` and ``spans`` (array of kind, start, end, whether a base pattern found it, and the score of added ones) of every row.

    Without a ``model`` one is learned from ``docs``.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = scratch.write(rows.mapInArrow(_scan, FOUND_SCHEMA), "found")
    sent = docs.sparkSession.sparkContext.broadcast(model or learn(found))
    names = F.array(*[F.lit(k) for k in KINDS])
    judged = found.select("doc_id", "base", "cands").mapInArrow(_judged(sent), SPAN_SCHEMA)
    return judged.select("doc_id", F.transform("spans", lambda s: s.withField("kind", F.get(names, s["kind"]))).alias("spans"))


def digests(spans: DataFrame) -> DataFrame:
    """Counts of base spans by kind, a digest of them, and all spans as text."""
    listed = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["base"])
    of_kind = F.transform(base, lambda x: x["kind"])
    counts = [(F.size(base) - F.size(F.array_remove(of_kind, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return spans.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))

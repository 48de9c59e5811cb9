"""Personal data in texts: base patterns, and a linear-chain conditional random field over word shapes.

The field labels white-space separated tokens with the inside and outside tags of four kinds. Tokens without
a digit or an at sign are outside by definition, so Viterbi decoding falls apart, exactly, into the runs of
tokens between them; runs of equal length are decoded together in numpy. A run's features include the plain
words before and after it. The field adds what the patterns drop, such as a card number that runs into the next
number, or a phone number without a plus sign after a word that announces one.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pii_table
from .common import map_slices, sample_of

# The kinds in their order and the base patterns.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

TAGS = ("O", *(f"{b}-{k}" for k in KINDS for b in "BI"))
NEAR = re.compile(r"[0-9@]")
#: Documents that the patterns label, token runs of theirs that are fitted (each of at most LONGEST tokens), and passes over them.
LABELLED, RUNS, LONGEST, PASSES, SEED = 20_000, 3000, 40, 12, 3
#: How often the labelled table counts beside them.
WEIGHT = 5


def digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def luhn(number: str) -> bool:
    total = sum(int(c) for c in number[::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in number[-2::-2])
    return total % 10 == 0


def is_kind(kind: str, text: str) -> bool:
    """Whether the text of a span can be of this kind."""
    n = digits(text)
    if kind == "email":
        return text.count("@") == 1 and DOMAIN.search(text.split("@")[1]) is not None and text[0] != "@"
    if kind == "ip":
        return (m := IP.fullmatch(text)) is not None and all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))
    return 13 <= len(n) <= 19 and luhn(n) if kind == "card" else 9 <= len(n) <= 15


#: What an added phone number may look like, and what numbers of other kinds do: groups of three, and plain or few digits.
DIALLED = re.compile(r"\+?\(?\+?[0-9][0-9 ]{0,5}\)?[0-9 ./-]*[0-9]")
AMOUNT = re.compile(r"[0-9]{1,3}([ .,][0-9]{3})+|[0-9]+([.,][0-9]+)?")
YEARS = re.compile(r"(1[5-9]|20)[0-9]{2}([ /-]+(1[5-9]|20)[0-9]{2})+")


def is_phone(text: str, announced: bool) -> bool:
    """Whether a span that the field found can be a phone number: 9 to 15 digits, 7 where a word announces it. What looks like an
    amount, plain digits, or nothing but years needs that word too."""
    if not DIALLED.fullmatch(text) or YEARS.fullmatch(text):
        return False
    n = len(digits(text))
    return 7 <= n <= 15 if announced else 9 <= n <= 15 and not AMOUNT.fullmatch(text)


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each at sign: the run of name characters before it and the domain after it."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > floor and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            found.append((begin, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end of the patterns' matches that pass their kind's test, by kind and then start."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if NEAR.search(text):
        for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
            found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if is_kind(kind, m[0])]
    return found


def tokens(text: str) -> list[tuple[int, int]]:
    """Bounds of the white-space separated tokens that have a digit or an at sign."""
    found, end = [], 0
    for m in NEAR.finditer(text):
        if m.start() < end:
            continue
        begin = m.start()
        while begin > end and not text[begin - 1].isspace():
            begin -= 1
        end = m.end()
        while end < len(text) and not text[end].isspace():
            end += 1
        found.append((begin, end))
    return found


def trim(text: str, a: int, b: int) -> tuple[int, int]:
    """Without the punctuation around a span; an opening bracket that is closed inside stays."""
    while b > a and not (text[b - 1].isalnum() or text[b - 1] == ")" and "(" in text[a:b]):
        b -= 1
    while b > a and not (text[a].isalnum() or text[a] in "+(" and (text[a] == "+" or ")" in text[a:b])):
        a += 1
    return a, b


@dataclass(frozen=True)
class Run:
    """Tokens that follow each other with only white space between, their bounds, and the plain words around them."""

    words: list[str]
    bounds: list[tuple[int, int]]
    before: str = ""
    after: str = ""


def plain(word: str) -> str:
    return word.strip(".,;:!?()\"'").lower()


def runs(text: str) -> list[Run]:
    out: list[list[tuple[int, int]]] = []
    for a, b in tokens(text):
        if out and text[out[-1][-1][1] : a].isspace():
            out[-1].append((a, b))
        else:
            out.append([(a, b)])
    found = []
    for bounds in out:
        a, b = bounds[0][0], bounds[-1][1]
        before, after = text[max(0, a - 24) : a].split()[-1:], text[b : b + 24].split()[:1]
        found.append(Run([text[x:y] for x, y in bounds], bounds, plain("".join(before)), plain("".join(after))))
    return found


def shape(token: str) -> tuple[str, ...]:
    """Features of a token: its shape in full and collapsed, digit counts, and the signs in it."""
    full = re.sub("[0-9]", "d", re.sub(r"[^\W\d_]", "a", token.strip(",;:!?\"'<>")))[:24]
    n = len(digits(token))
    return ("bias", f"s={full}" if n <= 19 else "s=long", "c=" + re.sub(r"(.)\1+", r"\1", full)[:16], f"n={min(n, 20)}", *(f"has{c}" for c in "@+().-/" if c in token))


def token_features(run: Run, cues: frozenset[str]) -> list[list[str]]:
    """Features of each token: its own, its neighbours' shapes, and at the ends of a run the word outside, if it is a cue."""
    own, last = [shape(w) for w in run.words], len(run.words) - 1
    out = []
    for k, mine in enumerate(own):
        left = [f"<w={run.before}"] if k == 0 and run.before in cues else []
        right = [f">w={run.after}"] if k == last and run.after in cues else []
        out.append([*mine, *("<" + x for x in (own[k - 1][2:4] if k else ("edge",))), *(">" + x for x in (own[k + 1][2:4] if k < last else ("edge",))), *left, *right])
    return out


@dataclass
class Field:
    """Emission weights by feature and tag, transition weights by tag and next tag (the last row and column: edges), the cue words, and
    those that announce a phone number."""

    index: dict[str, int]
    emit: np.ndarray
    move: np.ndarray
    cues: frozenset[str] = frozenset()
    announcing: frozenset[str] = frozenset()

    def scores(self, run: Run) -> np.ndarray:
        return np.stack([self.emit[[self.index[f] for f in fs if f in self.index]].sum(0) for fs in token_features(run, self.cues)])

    def decode(self, sequences: list[Run]) -> list[np.ndarray]:
        """The best tags of each run: Viterbi, over all runs of one length at a time."""
        by_length: dict[int, list[int]] = {}
        for k, s in enumerate(sequences):
            by_length.setdefault(len(s.words), []).append(k)
        out: list[np.ndarray] = [np.array([])] * len(sequences)
        edge, inner = len(TAGS), self.move[:-1, :-1]
        for n, of in by_length.items():
            scores = np.stack([self.scores(sequences[k]) for k in of])
            best, back = scores[:, 0] + self.move[edge, :-1], []
            for t in range(1, n):
                step = best[:, :, None] + inner
                back.append(step.argmax(1))
                best = step.max(1) + scores[:, t]
            tags = [(best + self.move[:-1, edge]).argmax(1)]
            for prev in reversed(back):
                tags.append(np.take_along_axis(prev, tags[-1][:, None], 1)[:, 0])
            for k, row in zip(of, np.stack(tags[::-1], 1), strict=True):
                out[k] = row
        return out


def allowed() -> np.ndarray:
    """An inside tag only follows a tag of its kind; the edges are outside."""
    n = len(TAGS)
    ok = np.ones((n + 1, n + 1), bool)
    for k, tag in enumerate(TAGS):
        if tag[0] == "I":
            ok[:, k] = [x[2:] == tag[2:] for x in TAGS] + [False]
    return np.where(ok, 0.0, -1e4)


def forward_backward(scores: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the tags and of the neighbouring tags, edges included."""
    n, tags = scores.shape
    f, b = np.empty((n, tags)), np.empty((n, tags))
    lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
    f[0], b[-1] = scores[0] + move[-1, :-1], move[:-1, -1]
    for t in range(1, n):
        f[t] = scores[t] + lse(f[t - 1][:, None] + move[:-1, :-1], 0)
    for t in range(n - 2, -1, -1):
        b[t] = lse(move[:-1, :-1] + (scores[t + 1] + b[t + 1])[None], 1)
    z = lse(f[-1] + b[-1], 0)
    node, pair = np.exp(f + b - z), np.zeros_like(move)
    for t in range(1, n):
        pair[:-1, :-1] += np.exp(f[t - 1][:, None] + move[:-1, :-1] + (scores[t] + b[t])[None] - z)
    pair[-1, :-1], pair[:-1, -1] = node[0], node[-1]
    return node, pair


def fit(sequences: list[tuple[Run, list[int]]], cues: Iterable[str] = (), passes: int = PASSES) -> Field | None:
    """Stochastic gradient ascent (adaptive steps) on the likelihood of the labelled token runs; None without any."""
    if not sequences:
        return None
    index: dict[str, int] = {}
    cues = frozenset(cues)
    rows = [([[index.setdefault(f, len(index)) for f in fs] for fs in token_features(run, cues)], tags) for run, tags in sequences]
    fixed, n = allowed(), len(TAGS)
    emit, move = np.zeros((len(index), n)), np.zeros((n + 1, n + 1))
    seen_emit, seen_move = np.full_like(emit, 1e-3), np.full_like(move, 1e-3)
    rng = np.random.default_rng(SEED)
    for _ in range(passes):
        for k in rng.permutation(len(rows)):
            features, tags = rows[k]
            g, pair = gradient(np.stack([emit[f].sum(0) for f in features]), move + fixed, tags)
            for f, x in zip(features, g, strict=True):
                seen_emit[f] += x * x
                emit[f] += 0.3 * x / np.sqrt(seen_emit[f])
            seen_move += pair * pair
            move += 0.3 * pair / np.sqrt(seen_move)
    return Field(index, emit, move + fixed, cues, announcing(sequences))


def announcing(sequences: list[tuple[Run, list[int]]]) -> frozenset[str]:
    """Words that stand before phone numbers in the labelled runs, and before no other number."""
    phone = TAGS.index("B-phone")
    return frozenset(run.before for run, tags in sequences if tags[0] == phone and run.before.isalpha()) - frozenset(run.before for run, tags in sequences if tags[0] != phone)


def gradient(scores: np.ndarray, move: np.ndarray, tags: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of a run's log likelihood, by its token scores and by the transitions: what is there less what is expected."""
    node, pair = forward_backward(scores, move)
    g, pair = -node, -pair
    g[np.arange(len(tags)), tags] += 1
    for a, b in zip([len(TAGS), *tags], [*tags, len(TAGS)], strict=True):
        pair[a, b] += 1
    return g, pair


class Overlaps:
    """Spans of which those of a kind don't overlap, found by bisection."""

    def __init__(self, spans: Iterable[tuple[str, int, int]]) -> None:
        self.by_kind: dict[str, tuple[list[int], list[int]]] = {}
        for kind, a, b in sorted(spans, key=lambda s: s[1]):
            starts, ends = self.by_kind.setdefault(kind, ([], []))
            starts.append(a)
            ends.append(b)

    def first(self, a: int, b: int) -> tuple[str, int, int] | None:
        """The first by kind, then start, that shares a character with [a, b)."""
        for kind in KINDS:
            starts, ends = self.by_kind.get(kind, ((), ()))
            k = bisect_left(ends, a + 1)
            if k < len(ends) and starts[k] < b:
                return kind, starts[k], ends[k]
        return None


def tagged(run: Run, spans: Overlaps) -> list[int]:
    tags, last = [], None
    for a, b in run.bounds:
        of = spans.first(a, b)
        tags.append(0 if of is None else TAGS.index(("I-" if of == last else "B-") + of[0]))
        last = of
    return tags


def table_runs() -> list[tuple[Run, list[int]]]:
    """The labelled table's token runs with their tags."""
    return [(run, tagged(run, Overlaps(spans))) for text, spans in pii_table.rows() for run in runs(text)]


def labelled_runs(text: str) -> list[tuple[Run, list[int]]]:
    """Token runs of a text with the tags of the base spans; runs where a pattern's match was dropped are unsure and left out."""
    spans, out = Overlaps(base_spans(text)), []
    dropped = Overlaps((kind, *m.span()) for kind, p in (("ip", IP), ("card", CARD), ("phone", PHONE)) for m in p.finditer(text) if not is_kind(kind, m[0]) and len(digits(m[0])) > 8)
    for run in runs(text):
        if not dropped.first(run.bounds[0][0], run.bounds[-1][1]):
            out.append((run, tagged(run, spans)))
    return out


def augmented(single: list[tuple[Run, list[int]]]) -> list[tuple[Run, list[int]]]:
    """The labelled runs, and runs of two random ones joined, as numbers do follow each other."""
    order = np.random.default_rng(SEED).permutation(len(single)).tolist()
    pairs = [(single[a], single[b]) for a, b in zip(order, order[1:], strict=False) if any(single[a][1]) and any(single[b][1])]
    return single + [(Run(x.words + y.words, [], x.before, y.after), [*s, *t]) for (x, s), (y, t) in pairs]


def train(docs: DataFrame, rows: int = LABELLED) -> Field:
    """From the labelled table, and at most RUNS runs of so many documents, as the base patterns label them.

    The documents are those with the smallest hash of doc_id; null doc_ids are left out. An empty table leaves the labelled one.
    """
    ids = sample_of(docs.select("doc_id").where("doc_id is not null").distinct(), rows, "doc_id")
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where(F.col("text").rlike("@|[0-9]{4}"))
    kinds = "h long, at int, words array<string>, tags array<int>, before string, after string"

    def label(batch) -> dict:
        out: dict[str, list] = {"h": [], "at": [], "words": [], "tags": [], "before": [], "after": []}
        for h, text in zip(batch["h"].to_pylist(), batch["text"].to_pylist(), strict=True):
            for at, (run, tags) in enumerate(labelled_runs(text)):
                if len(tags) <= LONGEST:
                    for k, v in zip(out, (h, at, run.words, tags, run.before, run.after), strict=True):
                        out[k].append(v)
        return out

    every = map_slices(found.select(F.xxhash64("text").alias("h"), "text"), label, kinds).dropDuplicates(["h", "at"])
    got = [(Run(list(r["words"]), [], r["before"], r["after"]), list(r["tags"])) for r in sample_of(every, RUNS, "h", "at").collect()]
    table = table_runs()
    return fit(augmented(got) + augmented(table) * WEIGHT, {w for run, _ in table for w in (run.before, run.after) if w})


def find_spans(texts: list[str | None], field: Field | None) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """Base spans and all spans of each text. An added span overlaps no base span and passes its kind's test, a phone number a stricter one."""
    texts = [t or "" for t in texts]
    base = [base_spans(t) for t in texts]
    taken = [Overlaps(b) for b in base]
    added: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    asked = [(k, run) for k, t in enumerate(texts) for run in runs(t)] if field else []
    decoded = field.decode([run for _, run in asked]) if asked else []
    for (k, run), tags in zip(asked, decoded, strict=True):
        at = 0
        while at < len(tags):
            tag, end = TAGS[tags[at]], at + 1
            if tag[0] == "B":
                while end < len(tags) and TAGS[tags[end]] == "I-" + tag[2:]:
                    end += 1
                a, b = trim(texts[k], run.bounds[at][0], run.bounds[end - 1][1])
                fits = is_phone(texts[k][a:b], at == 0 and run.before in field.announcing) if tag == "B-phone" else is_kind(tag[2:], texts[k][a:b])
                if b > a and fits and not taken[k].first(a, b):
                    added[k].append((tag[2:], a, b))
            at = end
    order = lambda spans: sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))
    return [(order(b), order(b + more)) for b, more in zip(base, added, strict=True)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, counts of base spans, the digest of the base spans, all spans and their number, of every row's whole text.

    Null and empty texts have no spans. Without a field (nothing to learn from) the base spans are all.
    Repeated rows and null doc_ids come out each; an empty table gives no rows; extra columns are ignored.
    """

    def find(rows) -> dict:
        found = find_spans(rows["text"].to_pylist(), field)
        counts = {f"n_{k}": [sum(s[0] == k for s in base) for base, _ in found] for k in KINDS}
        return {"doc_id": rows["doc_id"], **counts, "base_sha256": [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], "spans": [joined(every) for _, every in found], "n_spans": [len(every) for _, every in found]}

    return map_slices(docs.select("doc_id", "text"), find, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_spans long")


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span, or union of overlapping ones, replaced by the first one's kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: s[1:]):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field | None) -> DataFrame:
    """The documents with their personal data replaced, all columns, whatever their names; n_chars, where there is one, is the new text's length, null for a null text.

    Null and empty texts stay as they are, repeated rows come out each; an empty table gives no rows.
    """
    import pyarrow as pa

    from .common import in_slices

    def replace(batches):
        for rows in in_slices(batches):
            texts = rows["text"].to_pylist()
            new = [None if t is None else redacted(t, every) for t, (_, every) in zip(texts, find_spans(texts, field), strict=True)]
            rows = rows.set_column(rows.schema.get_field_index("text"), rows.schema.field("text"), pa.array(new, rows.schema.field("text").type))
            if "n_chars" in rows.schema.names:
                field_ = rows.schema.field("n_chars")
                rows = rows.set_column(rows.schema.get_field_index("n_chars"), field_, pa.array([None if t is None else len(t) for t in new], field_.type))
            yield rows

    return docs.mapInArrow(replace, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))

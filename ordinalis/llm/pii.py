"""Personal data: fixed patterns, and further spans by a semi-Markov conditional random field trained in numpy."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# The lookbehind and the possessive digits only skip starts that cannot match, so that long digit runs cost linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]+)++")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches: for each at-sign the run of local characters before it, not before the last match, and a domain."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        if at >= end and (m := _DOMAIN.match(text, at + 1)):
            start = at
            while start > end and _LOCAL.match(text[start - 1]):
                start -= 1
            if start < at:
                found.append((start, m.end()))
                end = m.end()
        at = text.find("@", at + 1)
    return found


def base_spans(text: str) -> dict[str, list[Span]]:
    """Spans of the fixed patterns by kind; matches that fail their check are dropped, nothing is tried again."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    out["email"] = emails(text)
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out["ip"].append(m.span())
        for m in _CARD.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                out["card"].append(m.span())
        for m in _PHONE.finditer(text):
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                out["phone"].append(m.span())
    return out


# --- the random field

#: Longest entity in tokens; characters around a marker that a window takes in.
MOST_TOKENS, AROUND = 14, 48
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
_SPELLED = re.compile(r"[\[({]\s?at\s?[\])}]|\bat\b(?=[^\n]{1,40}\bdot\b)", re.IGNORECASE)
_MARK = re.compile(r"[0-9]+|@")
Token = tuple[str, int, int]


def windows(text: str) -> list[Span]:
    """Stretches of text around the marks that every entity holds: digits, at-signs and spelled-out ones."""
    marks = [m.span() for m in _MARK.finditer(text)]
    low = text.lower() if "at" in text or "AT" in text or "At" in text else ""
    if "(at" in low or "[at" in low or "{at" in low or "( at" in low or "[ at" in low or " dot " in low:
        marks += [m.span() for m in _SPELLED.finditer(text)]
    out: list[list[int]] = []
    for a, b in sorted(marks):
        a, b = max(0, a - AROUND), min(len(text), b + AROUND)
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def tokens_of(text: str, window: Span) -> list[Token]:
    return [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(text, *window)]


def kind_of(token: str) -> str:
    return "d" if token[0].isdigit() else "a" if token[0].isalpha() else token


def features(text: str, tokens: list[Token], i: int, j: int) -> list[str] | None:
    """Features of the whole span of tokens i..j, or None if no entity can look like that."""
    first, last = tokens[i][0], tokens[j][0]
    if not (first[0].isalnum() or first in "+(") or not (last[0].isalnum() or last == ")"):
        return None
    start, end = tokens[i][1], tokens[j][2]
    span = text[start:end]
    if "\n" in span or "  " in span:
        return None
    low = span.lower()
    groups = re.findall("[0-9]+", span)
    digits = "".join(groups)
    at = "@" if "@" in span else "box" if re.search(r"[\[({] ?at ?[\])}]", low) else "word" if re.search(r" at .* dot ", low) else ""
    if not digits and not at:
        return None
    before, after = (text[start - 1] if start else "\n"), (text[end] if end < len(text) else "\n")
    shape = re.sub(r"[^\W\d_]+", "a", re.sub("[0-9]+", "d", span))
    letters = any(c.isalpha() for c in span)
    if at:
        short = re.sub(r"(?:a|d)(?:[._%+-](?:a|d))*", "w", shape)
        own = [f"mail:{short[:24]}", f"at:{at}", f"dots:{min(low.count('.'), 3)}", f"word dots:{min(len(re.findall(r' dot | ?[(] ?dot ?[)] ?|\[dot\]', low)), 3)}",
               f"starts:{kind_of(first)}", f"ends:{kind_of(last)}", f"tail:{len(last) if last[0].isalpha() else 0}", f"spaces:{min(low.count(' '), 6)}"]
    else:
        own = [f"shape:{shape[:24]}", f"groups:{'-'.join(str(len(g)) for g in groups[:7])}", f"digits:{min(len(digits), 20)}",
               f"letters:{letters}", f"marks:{''.join(sorted(set(re.sub('[^ ().+/:,-]', '', span))))}"]
        if 13 <= len(digits) <= 19 and not letters:
            own.append(f"luhn:{luhn(digits)}")
        if shape == "d.d.d.d":
            own.append(f"octets:{all(len(g) <= 3 and int(g) <= 255 for g in groups)}")
    edge = lambda c: "glued" if c.isalnum() else "sign" if c in "#$%&*+-./:=@_" else "free"
    return [*own, f"left:{edge(before)}", f"right:{edge(after) if after != '.' else 'free'}", f"left:{before if before in '+=#$' else ''}", "any"]


class Field:
    """Scores of (span, kind); a token outside entities scores 0."""

    def __init__(self) -> None:
        self.names: dict[str, int] = {}
        self.weights = np.zeros((0, len(KINDS)))

    def lattice(self, text: str, window: Span, grow: bool = False, blocked: list[Span] = ()) -> tuple[list[Token], list[tuple[int, int, list[int]]]]:
        """Tokens, and the candidate segments (first token, one past the last, feature numbers), ordered by their end."""
        tokens = tokens_of(text, window)
        found = []
        for j in range(len(tokens)):
            for i in range(max(0, j - MOST_TOKENS + 1), j + 1):
                if tokens[j][2] - tokens[i][1] > 80 or any(a < tokens[j][2] and tokens[i][1] < b for a, b in blocked):
                    continue
                if (f := features(text, tokens, i, j)) is not None:
                    ids = [self.names.setdefault(x, len(self.names)) if grow else self.names.get(x, -1) for x in f]
                    found.append((i, j + 1, [x for x in ids if x >= 0]))
        return tokens, found

    def scores(self, segments: list[tuple[int, int, list[int]]]) -> np.ndarray:
        return np.array([self.weights[f].sum(0) for _, _, f in segments]).reshape(len(segments), len(KINDS))

    @staticmethod
    def marginals(n: int, segments: list, s: np.ndarray) -> tuple[np.ndarray, float]:
        """Chance of each (segment, kind) under all segmentations, and the log of their sum."""
        forward, backward = np.zeros(n + 1), np.zeros(n + 1)
        total = np.logaddexp.reduce(s, 1) if len(segments) else np.zeros(0)
        ends: list[list[int]] = [[] for _ in range(n + 1)]
        starts: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (i, j, _) in enumerate(segments):
            ends[j].append(k)
            starts[i].append(k)
        for t in range(1, n + 1):
            forward[t] = np.logaddexp.reduce([forward[t - 1], *[forward[segments[k][0]] + total[k] for k in ends[t]]])
        for t in range(n - 1, -1, -1):
            backward[t] = np.logaddexp.reduce([backward[t + 1], *[total[k] + backward[segments[k][1]] for k in starts[t]]])
        at = np.array([forward[i] + backward[j] for i, j, _ in segments]) if segments else np.zeros(0)
        return np.exp(s + (at - forward[n])[:, None]) if segments else s, float(forward[n])

    def best(self, n: int, segments: list, s: np.ndarray) -> list[tuple[int, int]]:
        """(segment, kind) of the best segmentation: one pass over the ends, each looking back over bounded segments."""
        value, back = np.zeros(n + 1), [(-1, -1)] * (n + 1)
        kinds = s.argmax(1) if len(segments) else []
        k = 0
        for t in range(1, n + 1):
            value[t] = value[t - 1]
            while k < len(segments) and segments[k][1] == t:
                v = value[segments[k][0]] + s[k, kinds[k]]
                if v > value[t]:
                    value[t], back[t] = v, (k, int(kinds[k]))
                k += 1
        out, t = [], n
        while t > 0:
            if back[t][0] >= 0:
                out.append(back[t])
                t = segments[back[t][0]][0]
            else:
                t -= 1
        return out[::-1]

    def fit(self, examples: list[tuple[str, dict[str, list[Span]]]], epochs: int = 8, rate: float = 0.3, decay: float = 1e-3, seed: int = 5) -> Field:
        """Maximum likelihood of the given segmentations, one window after the other with adaptive steps."""
        cases = []
        for text, spans in examples:
            for window in windows(text):
                tokens, segments = self.lattice(text, window, grow=True)
                gold = {(a, b): KINDS.index(k) for k in KINDS for a, b in spans.get(k, [])}
                truth = np.zeros((len(segments), len(KINDS)))
                for k, (i, j, _) in enumerate(segments):
                    y = gold.get((tokens[i][1], tokens[j - 1][2]))
                    if y is not None:
                        truth[k, y] = 1
                if segments and truth.sum() == sum(1 for a, b in gold if window[0] <= a and b <= window[1]):
                    cases.append((len(tokens), segments, truth))
        self.weights = np.zeros((len(self.names), len(KINDS)))
        seen = np.full_like(self.weights, 1e-2)
        order = random.Random(seed)
        for _ in range(epochs):
            order.shuffle(cases)
            for n, segments, truth in cases:
                flat = np.concatenate([f for _, _, f in segments])
                push = truth - self.marginals(n, segments, self.scores(segments))[0]
                used, where = np.unique(flat, return_inverse=True)
                rows = np.repeat(push, [len(f) for _, _, f in segments], 0)
                grad = np.stack([np.bincount(where, rows[:, k], len(used)) for k in range(len(KINDS))], 1) - decay * self.weights[used]
                seen[used] += grad * grad
                self.weights[used] += rate * grad / np.sqrt(seen[used])
        return self

    def spans(self, text: str, base: dict[str, list[Span]], least: float = 0.9) -> list[tuple[str, int, int]]:
        """Further spans that touch no base span: those of the best segmentation that are likely enough on their own."""
        taken = sorted(x for k in KINDS for x in base[k])
        out = []
        for window in windows(text):
            near = [x for x in taken if x[0] < window[1] and window[0] < x[1]] if taken else []
            tokens, segments = self.lattice(text, window, blocked=near)
            if segments:
                s = self.scores(segments)
                if s.max() <= 0:
                    continue
                p, _ = self.marginals(len(tokens), segments, s)
                out += [(KINDS[y], tokens[segments[k][0]][1], tokens[segments[k][1] - 1][2])
                        for k, y in self.best(len(tokens), segments, s) if p[k, y] >= least]
        return out


# --- training texts


def invented(n: int, pieces: list[str], seed: int = 3) -> list[tuple[str, dict[str, list[Span]]]]:
    """Texts with entities in forms the patterns miss and with numbers that are none, set between words of real texts."""
    rng = random.Random(seed)
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    words = [w for p in pieces for w in p.split() if w.isalpha()] or ["lorem", "ipsum", "dolor", "sit", "amet"]
    word = lambda: rng.choice(words).lower()
    ascii_word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 8)))

    def email() -> str:
        at, dot = rng.choice([("(at)", "."), ("[at]", "."), (" (at) ", "."), (" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", "[dot]"), ("@", "."), (" @ ", ".")])
        tail = rng.choice([f"{ascii_word()}{number(1)}", ascii_word()]) + dot + rng.choice(["com", "org", "net", "io", "de", "example" + dot + "com"])
        return ascii_word() + rng.choice(["", "." + ascii_word(), "." + number(2), "_" + ascii_word()]) + at + tail

    def card() -> str:
        body = rng.choice("3456") + number(14)
        digits = next(body + c for c in "0123456789" if luhn(body + c))
        return rng.choice([".", " ", "-", "", " - ", "/"]).join(digits[i:i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        area, mid, line = "2345"[rng.randrange(4)] + number(2), number(3), number(4)
        return rng.choice([f"({area}) {mid}-{line}", f"{area}-{mid}-{line}", f"{area}.{mid}.{line}", f"1-{area}-{mid}-{line}", f"({area}){mid}-{line}",
                           f"+1 ({area}) {mid}-{line}", f"+{number(2)} {area} {mid}{line}", f"00{rng.choice('134')}{number(1)} {area} {mid}{line}"])

    def ip() -> str:
        parts = [str(rng.randint(1, 255)) for _ in range(4)]
        return rng.choice([".".join(parts), "[.]".join(parts), " . ".join(parts), "(.)".join(parts)])

    def nothing() -> str:
        year = rng.randint(1900, 2030)
        return rng.choice([number(rng.randint(1, 12)), f"{year}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{year}",
                           f"{rng.randint(0, 23)}:{number(2)}", f"{number(2)}.{number(2)}", f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}", f"{number(1)},{number(3)},{number(3)}",
                           f"{number(3)} {number(2)}", f"{number(3)}-{number(2)}", "".join(rng.choice("0123456789abcdef") for _ in range(32)), f"id={number(9)}", f"{number(16)}",
                           f"{number(4)} {number(4)}", f"{word()} at {word()}", f"{word()} dot {word()}", f"AKIA{number(3)}XY{number(4)}Q", f"{number(3)}-{number(4)}", f"ISBN {number(3)}-{number(1)}-{number(4)}-{number(4)}-{number(1)}",
                           f"{number(1)}.{number(1)}.{number(1)}.{number(1)}.{number(1)}", f"${number(4)}.{number(2)}", f"v{number(1)}.{number(2)}"])

    makers = {"email": email, "card": card, "phone": phone, "ip": ip}
    out = []
    for k in range(n):
        kind = KINDS[k // 2 % len(KINDS)] if k % 2 else ""
        entity = makers[kind]() if kind else nothing()
        if not kind and luhn(re.sub("[^0-9]", "", entity) or "1") and len(re.sub("[^0-9]", "", entity)) >= 13:
            continue
        head = " ".join(word() for _ in range(rng.randint(2, 6))) + " "
        tail = rng.choice([" ", ". ", ", ", " "]) + " ".join(word() for _ in range(rng.randint(1, 5)))
        out.append((head + entity + tail, {kind: [(len(head), len(head) + len(entity))]} if kind else {}))
    return out


def sample_pieces(docs: DataFrame, most: int, chars: int, doc_id: str, text: str) -> list[str]:
    """At most `most` pieces of `chars` characters around the first digit or at-sign of a text, by hash of the id and text."""
    base = docs.select(F.xxhash64(doc_id, text).alias("k"), F.col(text).alias("text"), F.regexp_instr(F.col(text), F.lit("[0-9@]")).alias("at"))
    cut = base.where("at > 0").select("k", F.expr(f"substring(text, greatest(1, at - {chars // 2}), {chars})").alias("piece"))
    return [r["piece"] for r in cut.orderBy("k", "piece").limit(most).collect()]


def train(pieces: list[str], made: int = 1200) -> Field:
    """A field fitted on the pieces as the patterns label them, and on as many invented texts as `made` says."""
    silver = []
    for piece in pieces:
        spans = base_spans(piece)
        flat = sorted(x for k in KINDS for x in spans[k])
        if all(a[1] <= b[0] for a, b in zip(flat, flat[1:], strict=False)):
            silver.append((piece, spans))
    return Field().fit(silver + invented(made, pieces))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find_pii(docs: DataFrame, most: int = 300, chars: int = 400, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every whole text; the counts are of the patterns.

    `spans` lists the pattern spans and those the random field adds where no pattern matched, as kind:start:end in code
    points. The field scores whole candidate segments of at most MOST_TOKENS tokens and picks boundaries and kinds together;
    every entity holds a digit or an at-sign, so only the stretches around those are decoded, over the whole text. It is
    trained on the driver on a bounded sample (`most` pieces of `chars` characters, labelled by the patterns) and on
    invented texts, and broadcast; it has some thousand weights whatever the table.

    A null text is empty. Repeated rows, rows without an id and empty tables are nothing special. Other columns are not read.
    """
    field = docs.sparkSession.sparkContext.broadcast(train(sample_pieces(docs, most, chars, doc_id, text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column("text"):
                content = t.as_py() or ""
                base = base_spans(content)
                own = [(k, a, b) for k in KINDS for a, b in base[k]]
                rows.append([*[len(base[k]) for k in KINDS], hashlib.sha256(written(own).encode()).hexdigest(), written(own + field.value.spans(content, base))])
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:4]], *[pa.array(c, pa.string()) for c in cols[4:]]],
                                             names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return base.mapInArrow(run, f"doc_id {dict(base.dtypes)['doc_id']}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")

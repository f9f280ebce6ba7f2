"""Quality rules: counts over whole texts, and a linear-chain CRF that marks each line as content or boilerplate.

The chain has two states. Its weights are fitted here, by maximum likelihood, to a bounded sample of labelled
documents: all lines of good documents are content; in bad ones the lines count as boilerplate at first, then as
the first fit decodes them (at least the likeliest one). Viterbi decoding marks the lines of every document; the
share of words in content lines decides retention.

Defined cases: a null text has no words and no lines; lines without a word take no part; where no labelled
document exists every line is content; repeated rows are judged alike; other columns pass through, and a column
bearing an output's name is replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType

from tessera.llm.common import map_rows

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
DIGITS = b"0123456789"
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: What notices and page furniture say.
NOTICE = re.compile(rb"(?i)licen[sc]ed? |copyright|all rights reserved|cookie|subscribe|sign up|log ?in|click here|read more|terms of (?:use|service)|privacy policy")
N_FEATURES = 12
N_GRAM = 5

#: The fit takes this many labelled documents of each class at most, none above so many characters or lines.
FIT_DOCS, FIT_CHARS, FIT_LINES = 300, 20_000, 1000
#: Lines, with those that pad shorter documents, that are fitted at a time.
FIT_CELLS = 1 << 14
FIT_STEPS = 80


def repeated_words(words: list[bytes], n: int = N_GRAM) -> int:
    """Words that lie in an n-word window found twice or more, the first time included."""
    if len(words) <= n:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(number) == len(words):
        return 0
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    code, span, have = ids, len(number), 1
    while have < n:
        if span * len(number) >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            span = int(code.max()) + 1
        code = code[: len(words) - have] * len(number) + ids[have:]
        span *= len(number)
        have += 1
    ordered = np.sort(code)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    twice = np.flatnonzero(np.isin(code, again))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + n, -1)
    return int((np.cumsum(edge) > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int, list[bytes]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the lines that have a word."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    word_chars = len(text) - (len(raw) - len(raw.translate(None, SPACE)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), word_chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), lines


def line_features(line: bytes, seen: bool) -> list[float]:
    words = line.split()
    n, size = len(words), len(line)
    share = lambda chars: (size - len(line.translate(None, chars))) / size
    upper = size - len(line.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = size - len(line.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    same = sum(map(bytes.__eq__, words, words[1:]))
    return [
        1.0, min(np.log1p(n) / 4, 2.0), 5 * share(MARKS), 2 * upper / max(1, upper + lower), len(set(words)) / n, 2 * same / n, min(size / n / 10, 3.0), 5 * share(DIGITS),
        float(line.rstrip()[-1:] in b".!?:"), float(seen), float(bool(NOTICE.search(line))), 5 * share(SYMBOLS),
    ]


def features(lines: list[bytes]) -> np.ndarray:
    seen: set[bytes] = set()
    out = []
    for line in lines:
        out.append(line_features(line, line in seen))
        seen.add(line)
    return np.array(out, np.float64).reshape(-1, N_FEATURES)


@dataclass(frozen=True)
class Chain:
    """Scores: emission[f] for boilerplate against content, move[i][j] for state j after i (0 content, 1 boilerplate)."""

    emission: np.ndarray
    move: np.ndarray

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """The likeliest states; content where scores tie."""
        if not len(x):
            return np.zeros(0, np.int8)
        e = (x @ self.emission).tolist()
        (aa, ab), (ba, bb) = self.move.tolist()
        a, b, back = 0.0, e[0], []
        for s in e[1:]:
            from_a, from_b = b + ba > a + aa, b + bb > a + ab
            back.append((from_a, from_b))
            a, b = max(a + aa, b + ba), max(a + ab, b + bb) + s
        state, out = int(b > a), []
        for step in reversed(back):
            out.append(state)
            state = int(step[state])
        return np.array([state, *reversed(out)], np.int8)


def _gradient(w: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray, on: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of a batch of padded sequences and its derivatives by the emission and the move scores."""
    n, longest = on.shape
    pair = on[:, 1:] & on[:, :-1]
    e = np.stack([np.zeros((n, longest)), x @ w], axis=2)
    f, b = np.zeros_like(e), np.zeros_like(e)
    f[:, 0] = e[:, 0]
    for t in range(1, longest):
        step = np.logaddexp(f[:, t - 1, 0, None] + m[0], f[:, t - 1, 1, None] + m[1]) + e[:, t]
        f[:, t] = np.where(on[:, t, None], step, f[:, t - 1])
    for t in range(longest - 2, -1, -1):
        nxt = e[:, t + 1] + b[:, t + 1]
        step = np.logaddexp(m[:, 0] + nxt[:, 0, None], m[:, 1] + nxt[:, 1, None])
        b[:, t] = np.where(on[:, t + 1, None], step, 0.0)
    z = np.logaddexp(f[:, -1, 0], f[:, -1, 1])[:, None]
    p = np.exp(f + b - z[:, :, None]) * on[:, :, None]
    two = np.exp(f[:, :-1, :, None] + m + (e + b)[:, 1:, None, :] - z[:, :, None, None]) * pair[:, :, None, None]
    seen = np.array([[((y[:, :-1] == i) & (y[:, 1:] == j) & pair).sum() for j in (0, 1)] for i in (0, 1)], float)
    own = (e[:, :, 1] * y * on).sum() + (seen * m).sum() - z.sum()
    return own, np.einsum("ntf,nt->f", x, y * on - p[:, :, 1]), seen - two.sum(axis=(0, 1))


def _batches(xs: list[np.ndarray], ys: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sequences of like length together, FIT_CELLS padded lines at a time (or a single sequence)."""
    order = sorted(range(len(xs)), key=lambda i: len(xs[i]))
    out, some = [], []
    for i in order:
        if some and (len(some) + 1) * len(xs[i]) > FIT_CELLS:
            out.append(some)
            some = []
        some.append(i)
    made = []
    for some in [*out, some]:
        longest = len(xs[some[-1]])
        x, y, on = np.zeros((len(some), longest, N_FEATURES), np.float32), np.zeros((len(some), longest), np.int8), np.zeros((len(some), longest), bool)
        for row, i in enumerate(some):
            n = len(xs[i])
            x[row, :n], y[row, :n], on[row, :n] = xs[i], ys[i], True
        made.append((x, y, on))
    return made


def fit_chain(xs: list[np.ndarray], ys: list[np.ndarray], steps: int = FIT_STEPS, rate: float = 0.3, decay: float = 0.02) -> Chain:
    """Maximum likelihood with a Gaussian prior, by AdaGrad over all sequences, a batch of bounded size at a time."""
    batches, total = _batches(xs, ys), sum(map(len, xs))
    w, m = np.zeros(N_FEATURES), np.zeros((2, 2))
    gw, gm = np.full(N_FEATURES, 1e-8), np.full((2, 2), 1e-8)
    for _ in range(steps):
        found = [_gradient(w, m, *batch) for batch in batches]
        dw = sum(f[1] for f in found) / total - decay * w / 10
        dm = sum(f[2] for f in found) / total - decay * m / 10
        gw += dw * dw
        gm += dm * dm
        w, m = w + rate * dw / np.sqrt(gw), m + rate * dm / np.sqrt(gm)
    return Chain(w, m)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", per_class: int = FIT_DOCS) -> Chain:
    """Fits to per_class labelled documents of each class at most, those of the least hash of the id; of rows that share an id one text."""
    wanted = None
    for q in (0, 1):
        part = labels.where(F.col(quality_col) == q).select(F.col(id_col).alias("of"), F.lit(q).alias("q")).dropDuplicates(["of"]).orderBy(F.xxhash64("of"), "of").limit(per_class)
        wanted = part if wanted is None else wanted.unionByName(part)
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(wanted), F.col("id") == F.col("of")).where(F.length("t") <= FIT_CHARS)
    # One text of each id and class, that of the least hash, however many rows bear the id.
    rows = some.groupBy("id", "q").agg(F.min_by("t", F.struct(F.xxhash64("t"), "t")).alias("t")).select("q", "t", "id").collect()
    rows.sort(key=lambda r: (r["id"], r["q"]))
    found = [(r["q"], base_counts(r["t"])[-1]) for r in rows]
    found = [(q, features(lines)) for q, lines in found if 0 < len(lines) <= FIT_LINES]
    none = Chain(np.r_[-1.0, np.zeros(N_FEATURES - 1)], np.zeros((2, 2)))
    if len({q for q, _ in found}) < 2:
        return none
    xs = [x for _, x in found]
    first = fit_chain(xs, [np.full(len(x), 1 - q) for q, x in found])

    def again(q: int, x: np.ndarray) -> np.ndarray:
        if q:
            return np.zeros(len(x), int)
        y = first.viterbi(x).astype(int)
        y[int(np.argmax(x @ first.emission))] = 1
        return y

    return fit_chain(xs, [again(q, x) for q, x in found])


RULES = [("n_words", LongType()), ("word_chars", LongType()), ("n_symbols", LongType()), ("n_dup_lines", LongType()), ("n_repeat_words", LongType()), ("base_failed", BooleanType()), ("content_share", DoubleType()), ("kept", BooleanType())]


def apply_rules(df: DataFrame, chain: Chain, text_col: str = "text", min_words: int = 10, max_repeat_percent: int = 20, min_content: float = 0.5) -> DataFrame:
    """Appends the counts, base_failed, the share of words in content lines and the verdict."""

    def one(text: str | None) -> tuple:
        n_words, word_chars, n_symbols, n_dup, n_repeat, lines = base_counts(text)
        failed = n_words < min_words or 100 * n_repeat > max_repeat_percent * n_words
        states = chain.viterbi(features(lines))
        content = sum(len(line.split()) for line, s in zip(lines, states.tolist(), strict=True) if not s)
        share = content / n_words if n_words else 0.0
        return n_words, word_chars, n_symbols, n_dup, n_repeat, failed, share, not failed and share >= min_content

    return map_rows(df, [text_col], RULES, lambda: lambda rows: [one(t) for (t,) in rows])

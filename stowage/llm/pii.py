"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import bound_batches, fresh, stage_table

#: Kinds of spans in the order of ties: four with a fixed definition, two that the method adds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "number")

_ANY = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a dotted or digit run that fails from its first digit fails from a later one too, so only run starts are tried
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z_-]*+[0-9][A-Za-z0-9_-]*+")
_PLAIN_NUMBER = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{2,3}[ .-][0-9]{4}(?![0-9A-Za-z-])")
#: Shortest token that may be a secret.
SECRET_LENGTH = 12


def _emails(text: str):
    """Matches of local@domain, leftmost first and non-overlapping, without trying each start of a long word."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if k % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of emails, IP addresses, card and phone numbers, sorted."""
    if not _ANY.search(text):
        return []
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Looser spans that don't touch a base span: tokens with digits, and numbers cut like phone or social numbers."""
    found = [(m.start(), 5, m.end()) for m in _PLAIN_NUMBER.finditer(text)]
    for m in _TOKEN.finditer(text):
        if m.end() - m.start() >= SECRET_LENGTH:
            found.append((m.start(), 4, m.end()))
    found.sort(key=lambda s: (s[0], -s[2]))
    out, end, k = [], 0, 0
    for a, kind, b in found:
        while k < len(base) and base[k][2] <= a:
            k += 1
        if a >= end and not any(x[0] < b and x[2] > a for x in base[k:k + 4]):
            out.append((a, kind, b))
            end = b
    return out


# Gazetteers (fixed values): prefixes of issued keys, words that announce personal data, words that announce other numbers.
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "xoxb-", "xoxp-", "sk-", "pk_", "AIza", "eyJ")
NAMES_DATA = ("password", "passwd", "pwd", "token", "secret", "apikey", "api_key", "key", "auth", "phone", "tel",
              "mobile", "call", "fax", "ssn", "social security", "iban", "account", "card", "passport")
NAMES_OTHER = ("version", "page", "chapter", "figure", "table", "section", "isbn", "doi", "rfc", "copyright", "license")

ABSTAIN, NO, YES = 0, 1, 2


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def votes(text: str, span: tuple[int, int, int]) -> tuple[int, ...]:
    """What each labeler says of a span: 0 abstains, 1 no, 2 yes."""
    a, kind, b = span
    s, before = text[a:b], text[max(0, a - 24):a].lower()
    letters, digits = sum(c.isalpha() for c in s), sum(c.isdigit() for c in s)
    near = before.rstrip(" \"'=:([")
    hexed = all(c in "0123456789abcdefABCDEF" for c in s)
    return (
        YES if kind == 4 and s.startswith(KEY_PREFIXES) else ABSTAIN,  # gazetteer of issued keys
        YES if near.endswith(NAMES_DATA) else ABSTAIN,  # context: announced
        YES if before.endswith(("=", '= "', "=\"", ": ", ':"', "='")) else ABSTAIN,  # context: assigned
        NO if any(w in before for w in NAMES_OTHER) else ABSTAIN,  # context: another number
        (YES if len(s) >= 16 and letters and digits >= 3 else ABSTAIN) if hexed else ABSTAIN,  # pattern: hexadecimal
        (YES if _entropy(s) >= 3.2 and letters and digits >= 2 else NO if _entropy(s) < 2.5 else ABSTAIN),  # pattern: random
        (NO if not letters and kind == 4 else ABSTAIN),  # pattern: digits that failed the card and phone checks
        (NO if "-" in s and max((len(p) for p in s.split("-")), default=0) < 8 and kind == 4 else ABSTAIN),  # pattern: words
        (YES if kind == 5 and digits in (9, 10) else ABSTAIN),  # pattern: cut like a social or phone number
    )


LABELERS = 9
#: Slots of a span's hashed features; ridge on their weights beside the mean loss.
SLOTS, RIDGE = 512, 1e-5


def span_features(text: str, span: tuple[int, int, int]) -> tuple[int, ...]:
    """Slots of a span's hashed features: kind, shape, length, character kinds, the word before."""
    a, kind, b = span
    s = text[a:b]
    shape = re.sub(r"[0-9]+", "0", re.sub(r"[A-Z]+", "A", re.sub(r"[a-z]+", "a", s)))[:12]
    near = re.findall(r"[a-z_]+|[=:\"]", text[max(0, a - 24):a].lower())[-1:]
    letters, digits = sum(c.isalpha() for c in s), sum(c.isdigit() for c in s)
    said = (f"k{kind}", f"s{shape[:3]}", f"n{min(b - a, 48) // 8}", f"d{10 * digits // (b - a)}", f"l{letters > 0}",
            f"e{int(2 * _entropy(s))}", f"w{near[0] if near and near[0] in ('=', ':', chr(34), *NAMES_DATA) else ''}",
            f"u{s.isupper()}", f"x{all(c in '0123456789abcdef' for c in s)}", f"p{s[:4] if s[:4] in KEY_PREFIXES else ''}")
    return tuple(sorted({zlib.crc32(f.encode()) % SLOTS for f in said}))


@dataclass
class Reliabilities:
    """EM's estimates: share of personal spans, and P(vote | class) of each labeler."""
    prior: float
    given: np.ndarray  # labeler, class, vote

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        logs = np.log([1 - self.prior, self.prior])[None, :] + sum(
            np.log(self.given[j][:, patterns[:, j]]).T for j in range(patterns.shape[1]))
        logs -= logs.max(1, keepdims=True)
        p = np.exp(logs)
        return p[:, 1] / p.sum(1)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> Reliabilities:
    """Expectation-maximisation over counts of vote patterns, started from the majority of votes.

    An abstention says little by itself: its probability is shared by both classes, so only
    votes move the posterior.  Votes keep a smoothing of one span in each class.
    """
    yes, no = (patterns == YES).sum(1), (patterns == NO).sum(1)
    q = np.where(yes > no, 0.9, np.where(no > yes, 0.1, 0.3))
    k = patterns.shape[1]
    r = None
    for _ in range(rounds):
        given = np.zeros((k, 2, 3))
        for j in range(k):
            for v in (NO, YES):
                on = patterns[:, j] == v
                n1, n0 = (counts * q)[on].sum(), (counts * (1 - q))[on].sum()
                given[j, 1, v] = (n1 + 1) / ((counts * q).sum() + 3)
                given[j, 0, v] = (n0 + 1) / ((counts * (1 - q)).sum() + 3)
                # a labeler is taken to be right more often than wrong
                hi, lo = max(given[j, :, v]), min(given[j, :, v])
                given[j, :, v] = (lo, hi) if v == YES else (hi, lo)
            given[j, :, ABSTAIN] = 1.0
        r = Reliabilities(float(np.clip((counts * q).sum() / counts.sum(), 0.05, 0.95)), given)
        new = r.posterior(patterns)
        if np.abs(new - q).max() < 1e-9:
            break
        q = new
    return r


@dataclass
class SpanModel:
    weight: np.ndarray
    bias: float

    def spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Base spans, and the candidates that the classifier takes for personal data."""
        if not _ANY.search(text):
            return []
        more = [s for s in candidates(text, base) if self.weight[list(span_features(text, s))].sum() + self.bias > 0]
        return sorted(base + more)


def _sums(pairs: DataFrame, soft: dict[str, float], w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic loss over all pairs, its gradient and its Hessian at ``w``, the last of whose SLOTS + 1 weights is the bias.

    Each task sums its pairs and hands on a line of the matrix per row, so that the lines, not whole matrices, are added up
    by all executors; the driver gets the SLOTS + 2 sums.
    """
    size = SLOTS + 2  # the last column takes what rows with fewer features lack, and in the gradient's line the loss
    full = np.append(w, 0.0)

    def run(batches):
        lines, loss = np.zeros((SLOTS + 2, size)), 0.0
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                n = b.column("n").to_numpy().astype(float)
                y = np.array([soft[v] for v in b.column("votes").to_pylist()])
                lens = pc.list_value_length(b.column("slots")).to_numpy()
                x = np.full((len(n), lens.max() + 1), SLOTS + 1)
                x[:, :-1][np.arange(lens.max()) < lens[:, None]] = b.column("slots").flatten().to_numpy()
                x[:, -1] = SLOTS
                z = full[x].sum(1)
                q = 1 / (1 + np.exp(-z))
                lines[-1] += np.bincount(x.ravel(), weights=np.repeat((q - y) * n, x.shape[1]), minlength=size)
                lines[:-1] += np.bincount((x[:, :, None] * size + x[:, None, :]).ravel(),
                                          weights=np.repeat(n * q * (1 - q), x.shape[1] ** 2),
                                          minlength=size * size).reshape(size, size)[:-1]
                loss += (n * (np.logaddexp(0, z) - y * z)).sum()
        lines[:, -1] = 0
        lines[-1, -1] = loss
        on = np.flatnonzero(lines.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int32()),
                                          pa.array(np.full(len(on), TaskContext.get().partitionId()), pa.int32()),
                                          pa.array(list(lines[on]), pa.list_(pa.float64()))], names=["line", "task", "x"])

    def add(part: pa.Table) -> pa.Table:
        part = part.sort_by("task")  # sums don't depend on the order of arrival
        x = np.zeros(size)
        for row in part["x"]:
            x += row.values.to_numpy()
        return pa.table({"line": part["line"][:1], "x": pa.array([x], pa.list_(pa.float64()))})

    lines = np.zeros((SLOTS + 2, size))
    for r in (pairs.mapInArrow(run, "line int, task int, x array<double>").groupBy("line")
              .applyInArrow(add, "line int, x array<double>").collect()):
        lines[r["line"]] = r["x"]
    return lines[-1, -1], lines[-1, :-1], lines[:-1, :-1]


def _newton(pairs: DataFrame, soft: dict[str, float], total: float, rounds: int = 14) -> np.ndarray:
    """Weights and bias of the logistic regression of least mean loss, by Newton steps, halved where the loss would grow."""
    ridge = np.append(np.full(SLOTS, RIDGE), 1e-9)
    w, step, best = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1), np.inf
    for _ in range(rounds):
        loss, slope, bend = _sums(pairs, soft, w + step)
        loss = loss / total + 0.5 * (ridge * (w + step) ** 2).sum()
        if loss > best:
            step = step / 2
            continue
        done, best, w = best - loss < 1e-9, loss, w + step
        if done:
            break
        step = -np.linalg.solve(bend / total + np.diag(ridge), slope / total + ridge * w)
    return w


def fit_spans(docs: DataFrame, text_col: str = "text") -> SpanModel:
    """Train the span classifier without labelled text.

    Every candidate of every text is reduced to its votes and feature slots, and equal ones are counted
    (pre-aggregated in each batch).  EM runs on the counts of all vote patterns, of which there are at most 3 ** 9;
    its posteriors are the soft labels of a logistic regression on all (votes, features) pairs, weighted by their
    counts: the pairs stay a table, of which each of a dozen Newton steps sums loss, gradient and Hessian.  Without candidates nothing is added to the
    base spans.
    """
    def run(batches):
        for b in batches:
            n: Counter = Counter()
            for t in b.column(0).to_pylist():
                if t and _ANY.search(t):
                    for s in candidates(t, base_spans(t)):
                        n["".join(map(str, votes(t, s))), span_features(t, s)] += 1
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n]),
                                                  pa.array([k[1] for k in n], pa.list_(pa.int32())),
                                                  pa.array(list(n.values()), pa.int64())], names=["votes", "slots", "n"])

    found = (docs.select(F.col(text_col).alias("t")).mapInArrow(run, "votes string, slots array<int>, n long")
             .groupBy("votes", "slots").agg(F.sum("n").alias("n")))
    found = stage_table(found, "pii-pairs")
    seen = {r["votes"]: r["n"] for r in found.groupBy("votes").agg(F.sum("n").alias("n")).collect()}
    if not seen:
        return SpanModel(np.zeros(SLOTS), -1.0)
    names = sorted(seen)
    patterns = np.array([[int(c) for c in v] for v in names])
    counts = np.array([seen[v] for v in names], dtype=float)
    soft = dict(zip(names, estimate(patterns, counts).posterior(patterns).tolist()))
    w = _newton(found, soft, counts.sum())
    return SpanModel(w[:-1], float(w[-1]))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def span_digest(text: Column, model: SpanModel) -> Column:
    """struct of base counts, the base spans and all spans, written as kind:start:end."""
    @F.arrow_udf("struct<n_email: long, n_ip: long, n_card: long, n_phone: long, base: string, spans: string>")
    def digest(texts: pa.Array) -> pa.Array:
        cols = [[] for _ in range(6)]
        for t in texts.to_pylist():
            base = base_spans(t or "")
            for k in range(4):
                cols[k].append(sum(s[1] == k for s in base))
            cols[4].append(written(base))
            cols[5].append(written(model.spans(t or "", base)))
        return pa.StructArray.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]),
                                           *(pa.array(c, pa.string()) for c in cols[4:])],
                                          names=["n_email", "n_ip", "n_card", "n_phone", "base", "spans"])

    return digest.asNondeterministic()(text)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data of every whole text: id_col, n_email, n_ip, n_card, n_phone, base, spans.

    ``base`` and ``spans`` list kind:start:end (code points, end exclusive) by start.  Base kinds follow
    their fixed patterns and checks; ``spans`` has them too and those that the classifier
    adds (see :func:`fit_spans`).  Null texts count as empty and have no spans; repeated rows each get a
    row; an empty table gives no rows.  Only ``id_col`` and ``text_col`` are read.
    """
    bound_batches(docs.sparkSession)
    model = fit_spans(docs, text_col)
    return docs.select(F.col(id_col), span_digest(F.col(text_col), model).alias("s")).select(id_col, "s.*")


def _redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for a, k, b in spans:
        if b > at:  # a span that overlaps the last one only adds what sticks out
            out.append(text[at:max(a, at)])
            out.append(f"<{KINDS[k].upper()}>")
            at = b
    return "".join(out) + text[at:]


def redact_pii(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind, as <EMAIL>; columns and rows stay.

    ``length_col``, if there, is counted anew where the text changed.  Null texts stay null.
    """
    bound_batches(docs.sparkSession)
    model = fit_spans(docs, text_col)

    @F.arrow_udf("string")
    def redact(texts: pa.Array) -> pa.Array:
        return pa.array([t and _redacted(t, model.spans(t, base_spans(t))) for t in texts.to_pylist()], pa.string())

    new = fresh(docs, "redacted")
    out = docs.withColumn(new, redact.asNondeterministic()(F.col(text_col)))
    same = F.col(new).eqNullSafe(F.col(text_col))
    cols = []
    for c in docs.columns:
        if c == text_col:
            cols.append(F.col(new).alias(c))
        elif c == length_col:
            cols.append(F.when(same, F.col(c)).otherwise(F.char_length(new)).cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col(c))
    return out.select(*cols)

"""Personal data by weak supervision: labelers vote on candidate spans, their reliabilities are estimated
without labels, and a classifier trained on the outcome decides.

Candidates are the matches of the base formats (email, ip, card, phone) and of wider patterns: numbers
written like telephone or card numbers, long keys and assigned secrets. Labelers look at the format
(regular expressions and checksums), at word lists (gazetteers) and at the words around (context); each
says yes, no or nothing. Spark counts how often each pattern of votes and features occurs over the whole
corpus. Their number is bounded by the design of the votes, so expectation maximisation (one accuracy per
labeler and class, one prior per kind) and a logistic classifier on votes and features, trained on the
posteriors, run over that small table. Base matches always stay; others stay if the classifier says so.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from snaptext.scale import stored

KINDS = ("email", "ip", "card", "phone", "secret", "number")
BASE = KINDS[:4]

#: Gazetteers and context words (fixed values).
TOP_DOMAINS = frozenset("com org net edu gov info biz io dev app de fr es uk eu us ca it nl ch at pl ru cn jp in br au".split())
PHONE_WORDS = frozenset("phone tel telephone telefon téléphone teléfono mobile cell call fax ring whatsapp handy".split())
CARD_WORDS = frozenset("card visa mastercard amex credit debit karte kreditkarte carte tarjeta iban konto account cuenta compte".split())
SECRET_WORDS = frozenset("password passwd passwort pwd token secret apikey api_key key contraseña auth bearer credential".split())
PUBLIC_WORDS = frozenset("version figure table page chapter isbn issn doi year line build release section".split())

_DIGIT = re.compile(r"[0-9]")
_AT_RUN = re.compile(r"[A-Za-z0-9._%+-]+@?")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits matches whole or not at all: starting inside it cannot help.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_PHONE = re.compile(r"(?<![\w+(])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![\w])")
_CLOUD_KEY = re.compile(r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])")
_ASSIGNED = re.compile(r"""(?i)(?<![\w])(?:password|passwd|pwd|token|secret|api_?key)\s{0,2}[=:]\s{0,2}["']?([^\s"'<>]{6,}+)""")
_HEX = re.compile(r"(?<![0-9A-Za-z])(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{32,}+(?![0-9A-Za-z])")
_WORDS_BEFORE = re.compile(r"[^\W\d]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of local part, @, dotted domain; linear in the text."""
    at = 0
    while run := _AT_RUN.search(text, at):
        at = run.end()
        if text[at - 1] == "@" and (domain := _DOMAIN.match(text, at)):
            yield run.start(), domain.end()
            at = domain.end()


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans of the base formats; overlaps between kinds are kept."""
    if "@" in text:
        for start, end in emails(text):
            yield "email", start, end
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        parts = [part.lstrip("0") or "0" for part in m.groups()]
        if all(len(part) <= 3 and int(part) <= 255 for part in parts):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = re.sub("[^0-9]", "", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                yield "phone", *m.span()


def wider_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Candidates beyond the base formats."""
    if "AKIA" in text or "ASIA" in text:
        for m in _CLOUD_KEY.finditer(text):
            yield "secret", *m.span()
    if "=" in text or ":" in text:
        for m in _ASSIGNED.finditer(text):
            yield "secret", *m.span(1)
    if not _DIGIT.search(text):
        return
    for m in _HEX.finditer(text):
        yield "secret", *m.span()
    for m in _LOCAL_PHONE.finditer(text):
        yield "phone", *m.span()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 8 and 8 <= len(re.sub("[^0-9]", "", m[0])) <= 34:
            yield "number", *m.span()


# Labelers: 1 yes, -1 no, 0 nothing. Each gets (kind, span's text, words before, words after).


def _format(kind: str, span: str, before: list[str], after: list[str]) -> int:
    digits = re.sub("[^0-9]", "", span)
    if kind == "email":
        return 1
    if kind == "ip":
        return 1 if not digits.startswith(("0", "127")) else -1
    if kind == "card":
        return 1 if span[0] in "3456" else 0
    if kind == "phone":
        return 1 if 9 <= len(digits) <= 15 else -1
    if kind == "number":
        return 1 if 12 <= len(digits) <= 19 and luhn(digits) else -1
    return 1 if len(span) >= 16 and len(digits) >= 2 else -1


def _shape(kind: str, span: str, before: list[str], after: list[str]) -> int:
    """Strict writing: no leading dots, one style of separators, mixed characters in keys."""
    if kind == "email":
        return -1 if span[0] in ".-%+" or ".." in span else 1
    if kind in ("card", "number", "phone"):
        separators = set(re.sub("[0-9()+]", "", span))
        return 1 if len(separators) <= 2 and (kind != "number" or len(span) >= 16) else -1
    if kind == "ip":
        return -1 if re.search(r"(^|\.)0[0-9]", span) else 1
    return 1 if re.search("[0-9]", span) and re.search("[A-Za-z]", span) else -1


def _gazetteer(kind: str, span: str, before: list[str], after: list[str]) -> int:
    if kind == "email":
        return 1 if span.rsplit(".", 1)[-1].lower() in TOP_DOMAINS else -1
    if kind in ("card", "number"):
        return 1 if span[:1] in "45" and len(re.sub("[^0-9]", "", span)) == 16 else -1 if set(span) <= {"0"} else 0
    if kind == "secret":
        return 1 if span.startswith(("AKIA", "ASIA")) else 0
    return 0


def _context(kind: str, span: str, before: list[str], after: list[str]) -> int:
    wanted = {"phone": PHONE_WORDS, "card": CARD_WORDS, "number": CARD_WORDS | PHONE_WORDS, "secret": SECRET_WORDS}.get(kind, frozenset())
    if wanted & set(before):
        return 1
    return -1 if PUBLIC_WORDS & set(before[-2:]) else 0


def _surroundings(kind: str, span: str, before: list[str], after: list[str]) -> int:
    """Running prose on both sides speaks for an inserted item; code and figures against it."""
    return 1 if before and after else 0


LABELERS = (_format, _shape, _gazetteer, _context, _surroundings)


def _around(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    before = _WORDS_BEFORE.findall(text[max(0, start - 48) : start].lower())
    after = _WORDS_BEFORE.findall(text[end : end + 24].lower())
    return before[-4:], after[:2]


def candidates_of(text: str) -> list[tuple[int, int, int, bool, str]]:
    """(start, kind number, end, base, pattern) by start, then kind as listed; no repeats."""
    found: dict[tuple[int, int, int], bool] = {}
    for kind, start, end in base_spans(text):
        found[start, KINDS.index(kind), end] = True
    starts, ends = _merged((start, end) for start, _, end in found)
    for kind, start, end in wider_spans(text):
        at = bisect_left(starts, end) - 1
        # A secret that goes on beyond a base match inside it stays whole.
        if at < 0 or ends[at] <= start or kind == "secret" and not starts[at] <= start < end <= ends[at]:
            found.setdefault((start, KINDS.index(kind), end), False)
    out = []
    for (start, kind, end), base in sorted(found.items()):
        span = text[start:end]
        around = _around(text, start, end)
        votes = "".join("-0+"[label(KINDS[kind], span, *around) + 1] for label in LABELERS)
        long = min((end - start) // 8, 4)
        out.append((start, kind, end, base, f"{KINDS[kind]} {votes} {long}"))
    return out


def _merged(spans: Iterable[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of some spans, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for start, end in sorted(spans):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def reliabilities(patterns: list[tuple[str, str]], counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """P(personal) of each (kind, votes) pattern by expectation maximisation over independent labelers.

    Starts from the majority of the votes. Probabilities of a vote given the class are shared by all
    kinds, with one more observation of each vote; every kind has its own prior.
    """
    if not len(patterns):
        return np.zeros(0)
    kinds = np.array([KINDS.index(k) for k, _ in patterns])
    votes = np.array([["-0+".index(v) for v in p] for _, p in patterns])
    yes = (votes - 1).sum(axis=1)
    posterior = np.clip(0.5 + 0.2 * yes, 0.05, 0.95)
    for _ in range(rounds):
        prior = np.array([(1 + (counts * posterior)[kinds == k].sum()) / (2 + counts[kinds == k].sum()) for k in range(len(KINDS))])
        log = np.stack([np.log(1 - prior[kinds]), np.log(prior[kinds])], axis=1)
        for labeler in range(votes.shape[1]):
            seen = np.zeros((2, 3))
            for v in range(3):
                at = votes[:, labeler] == v
                seen[:, v] = (counts[at] * (1 - posterior[at])).sum() + 1, (counts[at] * posterior[at]).sum() + 1
            rate = np.log(seen / seen.sum(axis=1, keepdims=True))
            log += rate[:, votes[:, labeler]].T
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -30, 30)))
        if np.abs(new - posterior).max() < 1e-9:
            break
        posterior = new
    return posterior


def _features(kind: str, votes: str, long: str) -> np.ndarray:
    x = np.zeros(1 + len(KINDS) + 3 * len(LABELERS) + 5)
    x[0] = x[1 + KINDS.index(kind)] = 1
    for i, v in enumerate(votes):
        x[1 + len(KINDS) + 3 * i + "-0+".index(v)] = 1
    x[1 + len(KINDS) + 3 * len(LABELERS) + int(long)] = 1
    return x


def classifier(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic model of soft labels (Newton steps)."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (target - p)) - ridge * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Decision:
    """Patterns of candidates that count as personal."""

    patterns: frozenset[str]


def decide(candidates: DataFrame, threshold: float = 0.5) -> Decision:
    """Fit on all ``spans`` of ``candidates``; only the counts of the patterns come to the driver."""
    rows = candidates.select(F.explode("spans.pattern").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n")).collect()
    rows = sorted(rows, key=lambda r: r["pattern"])
    if not rows:
        return Decision(frozenset())
    split = [tuple(r["pattern"].split(" ")) for r in rows]
    n = np.array([r["n"] for r in rows], dtype=float)
    posterior = reliabilities([(k, v) for k, v, _ in split], n)
    x = np.stack([_features(*s) for s in split])
    p = 1 / (1 + np.exp(-np.clip(x @ classifier(x, posterior, n), -30, 30)))
    return Decision(frozenset(r["pattern"] for r, q in zip(rows, p) if q >= threshold))


SPAN = "struct<start:int,kind:int,end:int,base:boolean,pattern:string>"


def candidates(docs: DataFrame) -> DataFrame:
    """(``doc_id``, ``spans``) for every row of (``doc_id``, ``text``); null texts are empty."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    fields = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("pattern", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("start", "kind", "end", "base", "pattern")
        for batch in batches:
            spans = [[dict(zip(names, c)) for c in candidates_of(t.as_py() or "")] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(fields))], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, spans array<{SPAN}>")


def _kept(spans: Column, decision: Decision) -> Column:
    yes = F.array(*[F.lit(p) for p in sorted(decision.patterns)]).cast("array<string>")
    return F.filter(spans, lambda s: s["base"] | F.array_contains(yes, s["pattern"]))


def _written(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def find(docs: DataFrame) -> DataFrame:
    """(``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256``, ``spans``, ``n_spans``) for every row.

    The counts and ``base_sha256`` are about base matches, ``spans`` holds them and those the classifier adds,
    as ``kind:start:end`` by start, then kind. Positions are code points, ends exclusive. Null and empty
    texts have no spans; repeated rows give repeated rows; an empty table gives none.
    """
    found = stored(candidates(docs), "pii")
    kept = found.select("doc_id", _kept(F.col("spans"), decide(found)).alias("kept")).withColumn(
        "base", F.filter("kept", lambda s: s["base"])
    )
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return kept.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.col("kept")).alias("spans"),
        F.size("kept").cast("long").alias("n_spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every found span replaced by its kind, as in ``[EMAIL]``; overlapping spans become one.

    All columns stay; a null text stays null.
    """
    decision = decide(candidates(docs))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column("text"):
                text = text.as_py()
                spans = [(s, e, k) for s, k, e, base, p in candidates_of(text or "") if base or p in decision.patterns]
                first = {s: k for s, _, k in reversed(spans)}
                out, at = [], 0
                for start, end in zip(*_merged((s, e) for s, e, _ in spans)):
                    kind = first[start]
                    out += [text[at:start], f"[{KINDS[kind].upper()}]"]
                    at = end
                texts.append(text if not out else "".join([*out, text[at:]]))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names], names=names)

    return docs.mapInArrow(run, docs.schema)

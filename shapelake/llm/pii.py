"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Candidates are the base matches (exact rules, always reported), looser look-alikes of them and secrets (values given to
names like `token`, keys of known forms). Regex, gazetteer and context labelers vote for, against or abstain;
expectation-maximisation finds each labeler's reliability and the probability of every vote pattern, and a logistic
classifier over votes and the span's shape (length, kinds of characters) is trained on these probabilities. Texts are
scanned once: candidates with their votes are stored, and what is learned comes from counts of patterns over the whole
corpus, of which there are only so many, whatever its size.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelake.llm.common import read, stored, text_blocks

KINDS = ("email", "ip", "card", "phone", "secret")
CUE_WINDOW = 32


class Gazetteers(NamedTuple):
    """Lists the labelers look values and their surroundings up in; a caller may pass others. The defaults are fixed values."""

    #: Top-level domains of more than two letters; every one of two letters counts as a country's.
    top_domains: frozenset[str] = frozenset("com org net edu gov int mil info biz pro name museum app dev cloud online site tech store shop blog news email live arpa".split())
    #: Domains and names that documentation uses for nobody.
    nobody: tuple[str, ...] = ("noreply@", "no-reply@", "donotreply@", "user@host", "foo@bar", "name@domain")
    #: First digits of card issuers.
    issuers: tuple[str, ...] = ("34", "35", "36", "37", "38", "4", "51", "52", "53", "54", "55", "6011", "62", "64", "65")
    #: Country calling codes.
    calling_codes: frozenset[str] = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 94 98 212 213 216 218 234 254 351 352 353 354 358 359 370 371 372 380 385 386 420 421 852 886 966 971 972".split())
    #: First parts of addresses that name no host on the internet.
    reserved: tuple[str, ...] = ("0.", "10.", "127.", "169.254.", "192.168.", "255.", *(f"172.{k}." for k in range(16, 32)))
    #: Values that stand for a secret, but are none.
    placeholders: tuple[str, ...] = ("example", "changeme", "your", "xxxx", "****", "placeholder", "dummy", "redacted", "test", "sample", "secret", "password", "token", "12345")
    #: Words before a span that tell its kind.
    cues: tuple[tuple[str, ...], ...] = (
        ("mail", "contact", "write to", "correo", "courriel", "kontakt", "from", "to"),
        ("ip", "host", "server", "address", "addr", "login from", "client", "adresse"),
        ("card", "visa", "credit", "payment", "carte", "karte", "tarjeta", "mastercard", "amex"),
        ("phone", "tel", "call", "mobile", "fax", "cell", "telefon", "llama", "appel", "dial", "handy"),
        ("token", "key", "secret", "password", "passwd", "pwd", "credential", "auth", "login", "bearer"),
    )
    #: Words before a span that tell of something else.
    against: tuple[str, ...] = ("version", "release", "section", "isbn", "order no", "invoice", "part no", "chapter", "commit", "sha1", "md5", "checksum", "build", "serial")


LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CLUSTER = re.compile(r"[0-9]++(?:[\x20.-][0-9]++)*+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOOSE_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[(] ?dot ?[\])] ?)[A-Za-z0-9-]{1,63}){1,8}", re.I)
#: Names that are given secrets, as they end before `=` or `:`; a value, which has a digit; keys that show by their form.
SECRET_NAME = re.compile(r"(?:token|secret|passwor[dt]|passwd|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|bearer)[A-Za-z0-9_-]{0,16}[\"']?[\x20\t]{0,3}\Z", re.I)
SECRET_VALUE = re.compile(r"[\x20\t]{0,3}[\"']?((?=[^\s\"'<>,;]*[0-9])[^\s\"'<>,;]{8,200})")
KNOWN_KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,72}|sk_live_[0-9a-zA-Z]{24}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,})(?![A-Za-z0-9])")
KEY_MARKS = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk_live_", "eyJ")
LOOSE_PHONE = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")


class Span(NamedTuple):
    start: int
    kind: int
    end: int
    base: bool
    strict: bool


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of the base rule, found from their @ so that long runs cost linear time."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def secrets(text: str) -> Iterator[Span]:
    """Values given to names of secrets, and keys of known forms, which don't overlap."""
    free = 0
    if any(mark in text for mark in KEY_MARKS):
        for m in KNOWN_KEY.finditer(text):
            yield Span(m.start(), 4, m.end(), False, True)
    for sign in re.finditer("[=:]", text):
        at = sign.start()
        if at >= free and SECRET_NAME.search(text, max(0, at - 48), at) and (m := SECRET_VALUE.match(text, at + 1)) and not KNOWN_KEY.match(m[1]):
            free = m.end()
            yield Span(m.start(1), 4, m.end(1), False, False)


def candidates(text: str | None) -> list[Span]:
    """Base matches and look-alikes that don't overlap one, by start, then kind. Null counts as empty."""
    if not text:
        return []
    found = [Span(a, 0, b, True, True) for a, b in emails(text)] if "@" in text else []
    loose: list[Span] = []
    for cluster in CLUSTER.finditer(text):
        a, b = cluster.span()
        if b - a < 7:
            continue
        chunk = cluster[0]
        if chunk.count(".") >= 3:
            for m in IP.finditer(chunk):
                good = all(len(p.lstrip("0") or "0") <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))
                found += [Span(a + m.start(), 1, a + m.end(), True, True)] if good else []
        if b - a >= 14:
            for m in CARD.finditer(chunk):
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19:
                    (found if luhn(digits) else loose).append(Span(a + m.start(), 2, a + m.end(), luhn(digits), luhn(digits)))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append(Span(m.start(), 3, m.end(), True, True))
    lowered = text.lower() if "at" in text or "AT" in text else ""
    if any(mark in lowered for mark in ("[at", "(at", "[ at", "( at")):
        loose += [Span(m.start(), 0, m.end(), False, False) for m in LOOSE_EMAIL.finditer(text)]
    loose += [Span(m.start(), 3, m.end(), False, False) for m in LOOSE_PHONE.finditer(text)]
    loose += secrets(text)
    if loose:
        taken = sorted((s.start, s.end) for s in found)
        starts = [s for s, _ in taken]
        ends = list(itertools.accumulate((e for _, e in taken), max))
        found += [s for s in loose if not ((k := int(np.searchsorted(starts, s.end))) and ends[k - 1] > s.start)]
    return sorted(found)


# Labelers: 1 votes for, -1 against, 0 abstains.


def vote_rule(text: str, s: Span, lists: Gazetteers) -> int:
    """For what a strict rule matches; it has no say about the rest."""
    return 1 if s.strict else 0


def vote_alone(text: str, s: Span, lists: Gazetteers) -> int:
    """A match that stands alone between white space or marks, not within a longer code."""
    before, after = text[s.start - 1 : s.start], text[s.end : s.end + 1]
    return -1 if before.isalnum() or after.isalnum() or before in "/#_" and before or after in "/=_" and after else 1


def vote_gazetteer(text: str, s: Span, lists: Gazetteers) -> int:
    value = text[s.start : s.end]
    if s.kind == 0:
        top = re.split(r"[^a-z0-9]+", value.lower())[-1]
        return -1 if value.lower().startswith(lists.nobody) else 1 if top in lists.top_domains or len(top) == 2 and top.isalpha() else -1
    if s.kind == 1:
        return -1 if value.startswith(lists.reserved) or value.endswith(".0") else 1
    if s.kind == 4:
        return -1 if any(word in value.lower() for word in lists.placeholders) else 0
    digits = re.sub(r"[^0-9]", "", value)
    if s.kind == 2:
        return 1 if digits.startswith(lists.issuers) else -1
    if not value.startswith("+"):
        return 0
    return 1 if any(digits[:k] in lists.calling_codes for k in (1, 2, 3)) else -1


def vote_context(text: str, s: Span, lists: Gazetteers) -> int:
    around = text[max(0, s.start - CUE_WINDOW) : s.start].lower()
    if any(re.search(rf"(?<![a-z]){re.escape(cue)}", around) for cue in lists.cues[s.kind]):
        return 1
    return -1 if any(word in around for word in lists.against) else 0


def bits_a_character(value: str) -> float:
    counts = Counter(value)
    return -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())


def vote_structure(text: str, s: Span, lists: Gazetteers) -> int:
    """What the value itself says: check digit, how evenly its characters are spread, how its digits are grouped."""
    value = text[s.start : s.end]
    digits = re.sub(r"[^0-9]", "", value)
    if s.kind == 0:
        return 1 if re.search(r"[A-Za-z]", value.split("@")[0]) else -1
    if s.kind == 1:
        return -1 if any(len(p) > 1 and p.startswith("0") for p in value.split(".")) else 0
    if s.kind == 2:
        return 1 if luhn(digits) and len(set(digits)) > 3 else -1
    if s.kind == 3:
        return -1 if len(set(digits)) < 4 or digits in "01234567890123456789" or digits[-10:-7] in ("000", "111") else 1
    turns = len(re.findall(r"[A-Za-z][0-9]|[0-9][A-Za-z]", value))
    return 1 if turns > 2 and bits_a_character(value) >= 2.75 else 0 if turns > 1 else -1


LABELERS = (vote_rule, vote_alone, vote_gazetteer, vote_context, vote_structure)
START = np.array([1, 1, 2, 1, 2])
#: Classes of length (to 11, to 19, longer) times number of kinds of characters (1, 2, 3 of digits, letters, marks).
SHAPES = 9


def shape(value: str) -> int:
    kinds = sum(bool(re.search(p, value)) for p in ("[0-9]", "[A-Za-z]", "[^0-9A-Za-z]"))
    return 3 * ((len(value) > 11) + (len(value) > 19)) + max(kinds, 1) - 1


def pattern(text: str, s: Span, lists: Gazetteers) -> int:
    """Kind, votes and shape as one number."""
    code = s.kind
    for labeler in LABELERS:
        code = code * 3 + labeler(text, s, lists) + 1
    return code * SHAPES + shape(text[s.start : s.end])


def read_pattern(code: int) -> tuple[int, tuple[int, ...], int]:
    """(kind, votes, shape) of a number that `pattern` gave."""
    code, form = divmod(code, SHAPES)
    votes = []
    for _ in LABELERS:
        code, v = divmod(code, 3)
        votes.append(v - 1)
    return code, tuple(reversed(votes)), form


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("base", pa.bool_()), ("pattern", pa.int32())]))


def label(docs: DataFrame, lists: Gazetteers = Gazetteers()) -> DataFrame:
    """doc_id and spans, array of (start, end, kind, base, pattern) of all candidates of each row, by start, then kind, in code points; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, texts in text_blocks(batch.column(1)):
                rows = [[(s.start, s.end, s.kind, s.base, pattern(t, s, lists)) for s in candidates(t)] for t in texts]
                yield pa.record_batch([batch.column(0).slice(i, len(texts)), pa.array([[dict(zip(("start", "end", "kind", "base", "pattern"), s)) for s in r] for r in rows], SPANS)], ["doc_id", "spans"])

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_kind}, spans array<struct<start:int,end:int,kind:int,base:boolean,pattern:int>>"), "candidates", "zstd")


def pattern_counts(labelled: DataFrame) -> dict[int, int]:
    """How often each pattern occurs in the corpus: at most 5 * 3 ** 5 * SHAPES rows reach the driver."""
    return {r.pattern: r.n for r in labelled.select(F.explode("spans.pattern").alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}


class Learned(NamedTuple):
    """reliabilities[kind][labeler][truth][vote + 1], the classifier's weights by kind, probability of each pattern seen."""

    reliabilities: np.ndarray
    weights: np.ndarray
    probability: dict[int, float]


def expectation_maximisation(votes: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each vote pattern and P(vote | truth) of each labeler, the labelers taken as independent.

    Starts from the sum of the votes, START's weights making lists and structure count double. A weak prior (a labeler is right more often than wrong, abstains as often either
    way, the strict rule is rarely for what is false, the structure rarely against what is true) keeps patterns that are rare or alone from deciding it all.
    """
    prior = np.full((votes.shape[1], 2, 3), 2.0)
    prior[:, 1, 2] = prior[:, 0, 0] = 6
    prior[0, 0, 2] = prior[-1, 1, 0] = 0.2
    q = 1 / (1 + np.exp(-1.5 * (votes @ START - 1)))
    theta = prior / prior.sum(axis=2, keepdims=True)
    for _ in range(rounds):
        count = prior.copy()
        for labeler in range(votes.shape[1]):
            for truth, weight in ((1, q * n), (0, (1 - q) * n)):
                count[labeler, truth] += np.bincount(votes[:, labeler] + 1, weight, 3)
        theta = count / count.sum(axis=2, keepdims=True)
        share = (2 + (q * n).sum()) / (4 + n.sum())
        log = [np.log(p) + sum(np.log(theta[k, t][votes[:, k] + 1]) for k in range(votes.shape[1])) for t, p in ((0, 1 - share), (1, share))]
        q = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return q, theta


def features(votes: np.ndarray, forms: np.ndarray) -> np.ndarray:
    """1, for each labeler whether it votes for and whether it votes against, and the shape."""
    return np.concatenate([np.ones((len(votes), 1)), votes == 1, votes == -1, forms[:, None] == np.arange(SHAPES)], axis=1).astype(float)


def learn(counts: dict[int, int], steps: int = 300, rate: float = 0.5, ridge: float = 1e-3) -> Learned:
    """Reliabilities by EM, then a logistic classifier for each kind fitted to EM's probabilities."""
    theta_all, weights, probability = np.zeros((len(KINDS), len(LABELERS), 2, 3)), np.zeros((len(KINDS), 1 + 2 * len(LABELERS) + SHAPES)), {}
    for kind in range(len(KINDS)):
        own = sorted((code, n) for code, n in counts.items() if read_pattern(code)[0] == kind)
        votes = np.array([read_pattern(code)[1] for code, _ in own], int).reshape(-1, len(LABELERS))
        forms, n = np.array([read_pattern(code)[2] for code, _ in own], int), np.array([n for _, n in own], float)
        q, theta_all[kind] = expectation_maximisation(votes, n)
        x, w = features(votes, forms), weights[kind]
        for _ in range(steps if len(n) else 0):
            error = (1 / (1 + np.exp(-x @ w)) - q) * np.log1p(n)
            w -= rate * (x.T @ error / np.log1p(n).sum() + ridge * w)
        probability |= {code: float(p) for (code, _), p in zip(own, 1 / (1 + np.exp(-x @ w)))}
    return Learned(theta_all, weights, probability)


def decide(labelled: DataFrame, learned: Learned, threshold: float = 0.5) -> DataFrame:
    """doc_id and spans: array of (start, end, kind, base, probability) by start, then kind, of a result of `label`.

    Base matches are all there; look-alikes and secrets are if the classifier gives them the threshold or more.
    """
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans in batch.column(1).to_pylist():
                sure = [(s, learned.probability.get(s["pattern"], 0.0)) for s in spans]
                out.append([{"start": s["start"], "end": s["end"], "kind": KINDS[s["kind"]], "base": s["base"], "probability": p} for s, p in sure if s["base"] or p >= threshold])
            yield pa.record_batch([batch.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    id_kind = labelled.schema["doc_id"].dataType.simpleString()
    return labelled.mapInArrow(run, f"doc_id {id_kind}, spans array<struct<start:int,end:int,kind:string,base:boolean,probability:double>>")


def find_spans(docs: DataFrame, threshold: float = 0.5, lists: Gazetteers = Gazetteers()) -> DataFrame:
    """Labels docs, learns from all of them and decides; see label and decide. Null texts are empty, null ids and repeated rows are kept, an empty table gives no rows, other columns aren't read."""
    labelled = label(docs, lists)
    return decide(labelled, learn(pattern_counts(labelled)), threshold)


def digests(found: DataFrame) -> DataFrame:
    """The counts, base_sha256 and spans columns of a result of find_spans; n_added counts the spans that the method adds."""
    base = F.filter("spans", lambda s: s["base"])
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    added = F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:4]), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"), added, F.size("spans").cast("long").alias("n_spans"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find_spans(read(spark, sf_dir, "documents")))

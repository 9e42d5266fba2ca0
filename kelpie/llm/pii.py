"""Personal data: high-recall candidate spans, boosted trees on format and context, calibrated cuts.

Base spans are exact patterns with checks (email, ip, card, phone) and always stay. Generators
propose further, overlapping spans of kinds that patterns alone cannot settle: secrets, numbers
of persons or accounts, phone numbers without a country, and masked addresses. Boosted trees
judge each from its form and the text around it; for each kind the lowest threshold that keeps
the wanted precision on calibration examples selects the redactions, best first, without overlap
(but a secret may hold base spans, and goes before its own parts).

No table marks personal data, so the trees learn from examples made by rule here (``examples``).
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.llm import kernels as K
from kelpie.llm.boosting import BoostedTrees

BASE = ("email", "ip", "card", "phone")
MORE = ("secret", "person", "account", "local", "masked")
KINDS = BASE + MORE
#: Share of selected calibration spans that must be right.
PRECISION = 0.995
#: Characters around a span that the trees see.
AROUND = 32
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits fails alike wherever it is entered, so it is entered at its start only.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")

_ASSIGNED = re.compile(r"(?i)(?<![a-z])(?:password|passwd|pwd|secret|token|credential|api[_ -]?key|access[_ -]?key|private[_ -]?key)['\"]?\s*(?:[:=]|is)\s*[\"']?([^\s\"']{6,}+)")
_OPAQUE = re.compile(r"(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])[A-Za-z0-9_]{16,}+")
_PERSON = re.compile(r"(?<![0-9.-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])")
_ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?|(?: ?[A-Z0-9]{4}){2} ?[A-Z0-9]{3})(?![A-Za-z0-9])")
_LOCAL = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_MASKED = re.compile(r"(?i)[a-z0-9._-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[a-z0-9-]{1,64}(?: ?(?:\(dot\)|\[dot\]| dot ) ?[a-z]{2,24}){1,4}")
_DOT = re.compile(r"(?i)[\[( ]dot[\]) ]")
_WORDS = {
    "secret": re.compile(r"(?i)password|passwd|pwd|secret|token|credential|key"),
    "person": re.compile(r"(?i)ssn|social|security|tax|passport|national|id\b"),
    "account": re.compile(r"(?i)iban|account|bank|transfer|bic"),
    "local": re.compile(r"(?i)phone|tel|call|mobile|cell|fax|reach|contact"),
    "masked": re.compile(r"(?i)mail|write|contact|reach|address"),
}
_AGAINST = re.compile(r"(?i)version|isbn|issn|doi|commit|sha|checksum|page|section|order|part|model|serial|figure|http|www|/")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start: leftmost matches without overlap in a kind, checked, no retries."""
    out = []
    at, after = text.find("@"), 0
    while at >= 0:
        start = at
        while start > after and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            after = m.end()
        at = text.find("@", max(at + 1, after))
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if len(m[0]) < 40 and 13 <= len(digits := re.sub(r"[ -]", "", m[0])) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Possible spans of the further kinds; they may overlap one another and base spans."""
    out = [("secret", *m.span(1)) for m in _ASSIGNED.finditer(text)]
    if _ANY.search(text):
        out += [("secret", *m.span()) for m in _OPAQUE.finditer(text)]
        for kind, pattern in (("person", _PERSON), ("account", _ACCOUNT), ("local", _LOCAL)):
            out += [(kind, *m.span()) for m in pattern.finditer(text)]
    for d in _DOT.finditer(text):
        low = max(0, d.start() - 160)
        out += [("masked", *m.span()) for m in _MASKED.finditer(text, low, min(len(text), d.end() + 120))]
    return list(dict.fromkeys(out))


def _iban(value: str) -> bool:
    s = value.replace(" ", "")
    try:
        return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    except ValueError:
        return False


def form(text: str, kind: str, start: int, end: int) -> list[float]:
    value = text[start:end]
    before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    n = len(value)
    counts = Counter(value)
    digits = sum(v for c, v in counts.items() if "0" <= c <= "9")
    upper = sum(v for c, v in counts.items() if "A" <= c <= "Z")
    lower = sum(v for c, v in counts.items() if "a" <= c <= "z")
    entropy = -sum(v / n * math.log2(v / n) for v in counts.values())
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(value, value[1:], strict=False))
    assigned = re.search(r"[:=]\s*[\"']?$", before) is not None
    return [
        MORE.index(kind), n, digits / n, upper / n, lower / n, (n - digits - upper - lower) / n, entropy, entropy / math.log2(max(2, n)),
        changes / n, len(counts) / n, float(assigned), float(before.endswith(('"', "'"))), float(after.startswith(('"', "'"))),
        float(_WORDS[kind].search(before) is not None), float(_AGAINST.search(before) is not None), float(before[-1:].isalnum() or after[:1].isalnum()),
        float(kind == "account" and _iban(value)), float(kind == "secret" and re.match(r"(?:AKIA|ASIA|gh[pousr]_|sk_|xox[a-z])", value) is not None),
        float(kind == "person" and (value[:3] in ("000", "666") or value[0] == "9")), float(any(c in value for c in "([")),
    ]


def examples(n: int = 3000, seed: int = 11) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Forms, labels and kinds of made-up spans: personal data and look-alikes in made-up text."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[rng.integers(len(xs))]
    chars = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(len(alphabet), size=k))
    low, up, dig, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    words = lambda k: " ".join(chars(low, int(rng.integers(1, 9))) for _ in range(k))

    def iban() -> str:
        country, body = chars(up, 2), chars(dig, int(rng.integers(12, 24)))
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        s = f"{country}{check:02d}{body}"
        return pick(s, " ".join(s[i : i + 4] for i in range(0, len(s), 4)))

    def one(kind: str, real: bool) -> tuple[str, str, str]:
        if kind == "secret" and real:
            key = pick("AKIA" + chars(up + dig, 16), chars(hexa, int(rng.integers(18, 64))), chars(up + low + dig, int(rng.integers(20, 48))), pick("ghp_", "sk_") + chars(up + low + dig, 32))
            if key.startswith(("AKIA", "ghp_", "sk_")) and rng.random() < 0.6:
                return pick("", words(2) + " "), key, ""
            name = pick("password", "token", "secret", "api_key", "pwd", "Password", "access key")
            quote = pick("", '"', "'")
            return f"{name}{pick('=', ' = ', ': ')}{quote}", key, quote
        if kind == "secret":
            return pick(
                ("commit ", chars(hexa, 40), ""), ("", chars(low, 14) + chars(dig, 2), ""), (f"{words(1)} ", chars(low, 9) + "_" + chars(low, 6) + chars(dig, 1), ""),
                ("model ", chars(up, 3) + chars(dig, 14), ""), ("", chars(dig, int(rng.integers(16, 30))), ""), ("token is ", chars(low, int(rng.integers(6, 12))), ""),
                ("secret: ", chars(low, int(rng.integers(6, 12))), ""), ("http://a/", chars(low + dig, 20), ""), ("", chars("1", 18), ""), ("password is ", chars(low, 8), ","),
            )
        if kind == "person":
            a, b, c = chars(dig[1:8], 3), chars(dig, 2), chars(dig, 4)
            if real:
                return pick("SSN ", "ssn: ", "social security number ", "tax id ", "Passport "), f"{a}-{b}-{c}", ""
            return pick("part ", "order ", "version ", "serial ", words(1) + " "), pick(f"{a}-{b}-{c}", f"{a} {b} {c}", f"000-{b}-{c}"), ""
        if kind == "account":
            if real:
                return pick("IBAN ", "account: ", "", words(1) + " "), iban(), ""
            return pick("part ", "", words(1) + " ", "serial "), chars(up, 2) + chars(dig, 2) + chars(up + dig, int(rng.integers(12, 24))), ""
        if kind == "local":
            value = pick(f"({chars(dig, 3)}) {chars(dig, 3)}-{chars(dig, 4)}", f"{chars(dig, 3)}-{chars(dig, 3)}-{chars(dig, 4)}", f"{chars(dig, 3)}.{chars(dig, 3)}.{chars(dig, 4)}")
            if real:
                return pick("phone ", "Tel: ", "call ", "mobile: ", "contact me at ", "fax "), value, ""
            return pick("part ", "isbn ", "order no ", "model ", "section "), f"{chars(dig, 3)}{pick(' ', '.')}{chars(dig, 3)}{pick(' ', '.')}{chars(dig, 4)}", ""
        if real:
            at, dot = pick(("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), (" (at) ", " (dot) "))
            return pick("mail ", "contact ", "write to ", ""), f"{chars(low, 6)}{at}{chars(low, 6)}{dot}{pick('com', 'org', 'net', 'de')}", ""
        return pick("look ", words(1) + " "), f"{chars(low, 4)} at {chars(low, 3)} dot {chars(low, int(rng.integers(4, 9)))}", ""

    forms, labels, kinds = [], [], []
    for i in range(n):
        kind, real = MORE[i % len(MORE)], bool(rng.integers(2))
        lead, value, close = one(kind, real)
        head = words(int(rng.integers(1, 8))) + pick(" ", ". ", "\n") + lead
        forms.append(form(f"{head}{value}{close}{pick('', ' ', '. ')}{words(4)}", kind, len(head), len(head) + len(value)))
        labels.append(float(real))
        kinds.append(kind)
    return np.array(forms), np.array(labels), kinds


def fit(seed: int = 11) -> tuple[BoostedTrees, dict[str, float]]:
    """Trees and each kind's threshold, from two thirds and one third of the examples."""
    x, y, kinds = examples(seed=seed)
    held = np.arange(len(y)) // len(MORE) % 3 == 0
    trees = BoostedTrees().fit(x[~held], y[~held])
    p, kind = trees.probability(x[held]), np.array(kinds)[held]
    cuts = {}
    for k in MORE:
        score, right = p[kind == k], y[held][kind == k]
        order = np.argsort(-score)
        good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= PRECISION)
        cuts[k] = max(0.5, float(score[order][good[-1]])) if len(good) else 1.1
    return trees, cuts


class Overlaps:
    """Spans by start, to be asked for those that overlap another."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.spans = sorted((s, e) for _, s, e in spans)
        self.reach = list(itertools.accumulate((e for _, e in self.spans), max))

    def of(self, start: int, end: int) -> Iterator[tuple[int, int]]:
        at = bisect.bisect_left(self.spans, (end, 0)) - 1
        while at >= 0 and self.reach[at] > start:
            if self.spans[at][1] > start:
                yield self.spans[at]
            at -= 1


class Finder:
    def __init__(self, trees: BoostedTrees, cuts: dict[str, float]):
        self.trees, self.cuts = trees, cuts

    def find(self, texts: list[str]) -> list[tuple[list, list]]:
        """For each text its base spans and all its spans, each by kind as in ``KINDS``, then start."""
        based = [base_spans(t) if _ANY.search(t) else [] for t in texts]
        proposed = [(i, *c) for i, t in enumerate(texts) for c in candidates(t)]
        chosen: dict[int, list] = {}
        if proposed:
            p = self.trees.probability(np.array([form(texts[i], k, s, e) for i, k, s, e in proposed]))
            good = [j for j, c in enumerate(proposed) if p[j] >= self.cuts[c[1]]]
            inner, last, reach = set(), None, -1
            for j in sorted(good, key=lambda j: (*proposed[j][:3], -proposed[j][3])):
                i, kind, _, end = proposed[j]
                if (i, kind) == last and end <= reach:
                    inner.add(j)  # a run of a longer value: the whole value goes first
                else:
                    last, reach = (i, kind), end
            base = {i: Overlaps(based[i]) for i, *_ in proposed}
            for j in sorted(good, key=lambda j: (j in inner, -p[j], proposed[j][2] - proposed[j][3])):
                i, kind, start, end = proposed[j]
                taken = chosen.setdefault(i, [])
                at = bisect.bisect_left(taken, (start, end))  # by start; they don't overlap
                free = (at == len(taken) or taken[at][0] >= end) and (at == 0 or taken[at - 1][1] <= start)
                whole = lambda s, e: kind == "secret" and start <= s and e <= end and e - s < end - start  # noqa: E731  a base span, such as digits like a card's, within a secret
                if free and all(whole(s, e) for s, e in base[i].of(start, end)):
                    taken.insert(at, (start, end, kind))
            chosen = {i: [(k, s, e) for s, e, k in taken] for i, taken in chosen.items()}
        order = lambda span: (KINDS.index(span[0]), span[1])
        return [(b, sorted((*b, *chosen.get(i, ())), key=order)) for i, b in enumerate(based)]


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_fitted: dict[str, Finder] = {}  # of the latest model that this worker has used


def _per_batch(sent, make, schema_names: list[str]):
    """An Arrow mapper whose rows are made from (batch, texts, found)."""
    model = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _fitted:
            _fitted.clear()
            _fitted[model] = Finder(*sent.value)
        for batch in batches:
            texts = [t or "" for t in K.column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays(make(batch, texts, _fitted[model].find(texts)), names=schema_names)

    return K.giving_back(run)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_spans for each row.

    Whole texts are searched; a null text is empty. Positions are code points, ends exclusive.
    Repeated rows are searched each, an empty table gives no rows, other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit())

    def make(batch, texts, found):
        return [
            K.column(batch, "id"),
            *[pa.array([sum(s[0] == k for s in b) for b, _ in found], pa.int64()) for k in BASE],
            pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], pa.string()),
            pa.array([joined(a) for _, a in found], pa.string()),
            pa.array([len(a) for _, a in found], pa.int64()),
        ]

    names = ["id", *[f"n_{k}" for k in BASE], "base_sha256", "spans", "n_spans"]
    schema = "id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string, n_spans long"
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return out.mapInArrow(_per_batch(sent, make, names), schema).withColumnRenamed("id", id_col)


def redact_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with its texts redacted; null texts stay null, other columns, whatever their names, are untouched.

    Repeated rows are redacted each, an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit())
    place = {c: "text" if c == text_col else f"c{i}" for i, c in enumerate(docs.columns)}
    inner = docs.toDF(*place.values())

    def make(batch, texts, found):
        nulls = K.column(batch, "text").is_null().to_pylist()
        made = [None if null else redact(t, a) for null, t, (_, a) in zip(nulls, texts, found, strict=True)]
        return [pa.array(made, pa.string()) if c == "text" else K.column(batch, c) for c in place.values()]

    return inner.mapInArrow(_per_batch(sent, make, list(place.values())), inner.schema).toDF(*docs.columns)


def op4_pii_boosted(spark, sf_dir: str) -> DataFrame:
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))

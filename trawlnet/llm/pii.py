"""Personal data and secrets: generators propose spans, boosted trees judge them, calibrated thresholds choose what to redact.

Generators aim at recall: any address, phone-like, card-like, dotted-quad, IPv6, account-like, national-number-like or key-like run of
characters (16 or more, digits or not) is proposed in every text, and proposals may overlap. Every proposal is described by its format (length, digits, checksums,
octets, entropy) and its context (neighbouring words). The trees are fitted here, on labelled proposals made from templates by a
seeded generator; nothing of a corpus is used. A split of those rows calibrates the probabilities; another sets, per
kind, the lowest threshold that reaches the wanted precision. Of overlapping choices the likeliest stays.
"""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted
from .textkit import chunks

KINDS = ("email", "phone", "card", "ip", "account", "national", "secret")
PRECISION = 0.98
SPANS = "doc_id bigint, kind string, start int, end int, probability double"

_GENERATORS = {
    "phone": re.compile(r"(?<![\w.])\+?\(?\d(?:[ .()/-]{0,2}\d){6,14}(?![\w])"),
    "card": re.compile(r"(?<![\w.-])\d(?:[ -]?\d){11,18}(?![\w-])"),
    "ip": re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w])(?!\.\d)"),
    "account": re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "national": re.compile(r"(?<![\w-])\d{3}[- ]\d{2}[- ]\d{4}(?![\w-])"),
    "secret": re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}(?![A-Za-z0-9_+/=-])"),
}
_IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}(?:\d{1,3}(?:\.\d{1,3}){3}|[0-9A-Fa-f]{0,4})(?!\w|:[\w:])")
_EMAIL = re.compile(r"(?<![\w.+%'-])[\w.+%'-]++@(?=([\w-]++(?:\.[\w-]++)*+))")
_WORD = re.compile(r"\w+")
_HINTS = {
    "email": {"mail", "email", "contact", "write", "reach"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telephone", "contact", "dial"},
    "card": {"card", "visa", "credit", "debit", "payment", "mastercard"},
    "ip": {"ip", "host", "server", "address", "client", "from"},
    "account": {"iban", "account", "bank", "transfer"},
    "national": {"ssn", "social", "security"},
    "secret": {"token", "key", "secret", "password", "passwd", "api", "apikey", "bearer", "auth", "credential", "pwd", "passphrase"},
}
_AGAINST = {"version", "v", "release", "build", "order", "invoice", "isbn", "issn", "page", "section", "figure", "fig", "commit", "sha", "md5", "checksum", "hash", "revision", "id", "ref", "part", "serial", "chapter", "doi", "date", "total", "population", "number", "no", "tracking"}
_PASSWORD = {"password", "passwd", "pwd", "passphrase", "secret"}


def _is_ipv6(s: str) -> bool:
    try:
        return bool(ipaddress.IPv6Address(s))
    except ValueError:
        return False


def proposals(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all proposed spans; each generator's own don't overlap, those of different ones may."""
    out = [("email", m.start(), m.end(1)) for m in _EMAIL.finditer(text)] if "@" in text else []
    for kind, pattern in _GENERATORS.items():
        out += [(kind, *m.span()) for m in pattern.finditer(text)]
    out += [("ip", *m.span()) for m in _IPV6.finditer(text) if _is_ipv6(m[0])]
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _entropy(s: str) -> float:
    n = np.array([s.count(c) for c in set(s)]) / max(1, len(s))
    return float(-(n * np.log2(n)).sum())


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    s = text[start:end]
    digits = "".join(c for c in s if "0" <= c <= "9")
    before = [w.lower() for w in _WORD.findall(text[max(0, start - 48) : start])][-4:]
    after = [w.lower() for w in _WORD.findall(text[end : end + 32])][:2]
    octets = [int(x) for x in s.split(".")] if kind == "ip" and ":" not in s else []
    moved = s.replace(" ", "")
    iban = kind == "account" and len(moved) >= 15 and int("".join(str(int(c, 36)) for c in moved[4:] + moved[:4])) % 97 == 1
    host = s.rpartition("@")[2].split(".") if kind == "email" else [""]
    return [
        *[float(kind == k) for k in KINDS],
        float(len(s)),
        float(len(digits)),
        len(digits) / max(1, len(s)),
        sum(c.isalpha() for c in s) / max(1, len(s)),
        float(sum(not c.isalnum() for c in s)),
        float(kind in ("card", "phone") and 12 <= len(digits) <= 19 and luhn(digits)),
        float(max(octets, default=0)),
        float(min(octets, default=0)),
        float(iban),
        float(s.startswith("+")),
        float("(" in s),
        float(len(set(digits))),
        _entropy(s),
        float(len(host)),
        float(len(host[-1])),
        float(host[-1].isalpha()),
        float(all(c in "0123456789abcdef" for c in s.lower())),
        float(any(c.isupper() for c in s) and any(c.islower() for c in s)),
        float(any(w in _HINTS[kind] for w in before)),
        float(any(w in _HINTS[k] for k in KINDS if k != kind for w in before)),
        float(any(w in _AGAINST for w in before)),
        float(any(w in _AGAINST for w in before[-1:])),
        float(any(w.isdigit() for w in before[-1:] + after[:1])),
        float(text[start - 1 : start] in ("'", '"', "=", ":") and start > 0),
        float(text[end : end + 1] in ("%", "€", "$")),
        float(s.count(":")),
        float(any(w in _PASSWORD for w in before)),
    ]


def _training_texts(seed: int, n: int) -> Iterator[tuple[str, int, str, int, int]]:
    """Kind, label, made-up sentence and where in it the value stands: n of each kind and label."""
    rng = np.random.default_rng(seed)
    digit = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    letters = lambda k, of="abcdefghijklmnopqrstuvwxyz": "".join(rng.choice(list(of), k))
    pick = lambda *xs: xs[rng.integers(len(xs))]
    word = lambda: letters(int(rng.integers(2, 11)))

    def card(valid: bool) -> str:
        while luhn(s := pick("4", "5", "37", "6011", "35") + digit(int(rng.integers(11, 15)))) != valid:
            pass
        s = s[:16] if luhn(s[:16]) == valid else s
        return pick(s, s, " ".join(re.findall(".{1,4}", s)), "-".join(re.findall(".{1,4}", s)))

    def iban() -> str:
        body = digit(int(rng.integers(12, 19)))
        country = pick("DE", "FR", "ES", "GB", "NL")
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        s = f"{country}{check:02d}{body}"
        return pick(s, " ".join(re.findall(".{1,4}", s)))

    def ipv6() -> str:
        groups = [pick(letters(4, "0123456789abcdef"), f"{rng.integers(0, 1 << 16):x}", "0") for _ in range(8)]
        groups[0] = pick("2001", "2a02", "fe80", "fd" + letters(2, "0123456789abcdef"))
        s = str(ipaddress.IPv6Address(":".join([*groups[:1], *pick(groups[1:], [*groups[1:3], *"0000", groups[7]][:7])])))
        return pick(s, s, s.upper())

    def phrase(least: int, joint: str) -> str:
        s = word()
        while len(s) < least:
            s += joint + word()
        return s

    def title(s: str) -> str:
        return "".join(x.capitalize() for x in s.split("-"))

    octets = lambda top, low=0: ".".join(str(x) for x in rng.integers(low, top, 4))
    good = {
        "email": lambda: f"{pick(word(), word(), word(), letters(int(rng.integers(30, 120))))}{pick('', '.' + word(), digit(2), '.' + digit(2))}@{word()}{digit(int(rng.integers(0, 2)))}.{pick('example.com', 'com', 'org', 'net', 'de', 'co.uk')}",
        "phone": lambda: pick(f"+1 ({digit(3)}) 555-{digit(4)}", f"+{digit(2)} {digit(3)} {digit(7)}", f"({digit(3)}) {digit(3)}-{digit(4)}", f"{digit(3)}-{digit(3)}-{digit(4)}", f"+{digit(11)}", f"0{digit(2)} {digit(4)} {digit(4)}"),
        "card": lambda: card(True),
        "ip": lambda: pick(octets(256), octets(256), ipv6()),
        "account": iban,
        "national": lambda: f"{rng.integers(1, 666):03d}-{digit(2)}-{digit(4)}",
        "secret": lambda: pick(letters(40, "0123456789abcdef"), letters(32, "0123456789abcdef"), letters(24, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), "AKIA" + letters(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), "ghp_" + letters(36, "ABCDEFGHabcdefgh0123456789"), "AKIA" + letters(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), letters(24, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), phrase(20, pick("-", "_", ""))),
    }
    bad = {
        "email": lambda: pick(f"{word()}@{word()}", f"{word()}@{digit(3)}", f"{digit(2)}@{digit(2)}.{digit(2)}", f"{word()}@{word()}.{digit(2)}"),
        "phone": lambda: pick(f"{rng.integers(1900, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}", f"{rng.integers(1900, 2030)}-{rng.integers(1900, 2030)}", digit(8), f"{digit(1)}.{digit(2)}.{digit(4)}", digit(13), f"{digit(4)} {digit(4)} {digit(4)}", digit(7), octets(256), f"978-{digit(1)}-{digit(4)}-{digit(4)}-{digit(1)}"),
        "card": lambda: pick(card(False), card(False), digit(14)),
        "ip": lambda: pick(octets(1000, 200), octets(10), octets(20), f"{letters(int(rng.integers(1, 5)), 'abcdef')}::{letters(int(rng.integers(1, 5)), 'abcdef')}", "::"),
        "account": lambda: f"{letters(2, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')}{digit(2)} {letters(4, 'ABCDEF0123456789')} {letters(4, 'ABCDEF0123456789')} {digit(4)}",
        "national": lambda: f"{digit(3)}-{digit(2)}-{digit(4)}",
        "secret": lambda: pick(f"{word()}-{word()}-{word()}-{digit(4)}", f"{word()}_{word()}_{word()}_{digit(2)}", letters(40, "0123456789abcdef"), digit(20), f"{word()}/{word()}/{word()}/{digit(4)}", "=" * 12 + digit(2) + "=" * 12, phrase(16, "-"), phrase(16, "_"), phrase(16, "/"), phrase(16, ""), title(phrase(16, "-")), phrase(16, "").upper(), pick("-", "=", "_", "+") * int(rng.integers(16, 80))),
    }
    needs_against = {"ip", "national"}  # right format, but named as something else
    for kind in KINDS:
        for label, make in ((1, good[kind]), (0, bad[kind])):
            for _ in range(n):
                s = make()
                lead = [word() for _ in range(int(rng.integers(2, 6)))]
                if label and (rng.random() < 0.35 or (kind == "secret" and (rng.random() < 0.9 or s[:4] not in ("AKIA", "ghp_")))):
                    of = _PASSWORD if kind == "secret" and s.islower() and not re.search(r"\d", s) else _HINTS[kind]
                    lead.append(pick(*sorted(of)) + pick("", ":", " =", " is"))
                elif not label and (kind in needs_against and ":" not in s and not (kind == "ip" and max(map(int, s.split("."))) > 255) or rng.random() < 0.3):
                    lead.append(pick(*sorted(_AGAINST)) + pick("", "", ":"))
                quote = pick("", '"') if kind == "secret" else ""
                before = f"{' '.join(lead)} {quote}"
                yield kind, label, f"{before}{s}{quote}{pick('', '', '.', ',')} {word()} {word()}", len(before), len(before) + len(s)


def _training_rows(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of those of the texts' values that are proposed."""
    x, y = [], []
    for kind, label, text, start, end in _training_texts(seed, n):
        for k, a, b in proposals(text):
            if k == kind and a <= start + 1 and b >= end - 1:
                x.append(features(text, k, a, b))
                y.append(label)
                break
    return np.array(x), np.array(y, float)


@lru_cache(maxsize=4)
def model(precision: float = PRECISION, rows: int = 300) -> tuple[Boosted, dict[str, float]]:
    """The trees, calibrated, and for each kind the threshold; the same in every process."""
    boosted = Boosted().fit(*_training_rows(1, rows)).calibrate(*_training_rows(2, rows))
    x, y = _training_rows(3, rows)
    p = boosted.probability(x)
    limits = {}
    for k, kind in enumerate(KINDS):
        mine = x[:, k] == 1
        right = [t for t in np.unique(p[mine]) if y[mine][p[mine] >= t].mean() >= precision]
        limits[kind] = float(min(right, default=1.0))
    return boosted, limits


def judged(texts: list[str], judge: tuple[Boosted, dict[str, float]]) -> list[list[tuple[str, int, int, float]]]:
    """For each text its chosen spans, in order and apart from one another."""
    boosted, limits = judge
    found = [[(t, *p) for p in proposals(t)] for t in texts]
    flat = [p for f in found for p in f]
    scores = boosted.probability(np.array([features(*p) for p in flat]).reshape(len(flat), -1)) if flat else []
    out, at = [], 0
    for f in found:
        mine = sorted((-scores[at + k], a - b, a, b, kind) for k, (_, kind, a, b) in enumerate(f) if scores[at + k] >= limits[kind])
        at += len(f)
        chosen: list[tuple[int, int, str, float]] = []  # in order and apart, so only the neighbours can overlap
        for p, _, a, b, kind in mine:
            k = bisect(chosen, (a, b))
            if (k == 0 or chosen[k - 1][1] <= a) and (k == len(chosen) or chosen[k][0] >= b):
                chosen.insert(k, (a, b, kind, -p))
        out.append([(kind, a, b, p) for a, b, kind, p in chosen])
    return out


def spans(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """(doc_id, kind, start, end, probability) of each span of docs (doc_id, text) to redact; offsets in characters.

    Null and empty texts have none; a null doc_id stays null; repeated rows give repeated spans; other columns are ignored.
    """
    judge = model(precision)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches):
            texts, ids = [t or "" for t in piece.column("text").to_pylist()], piece.column("doc_id").to_pylist()
            rows = [(i, *s) for i, chosen in zip(ids, judged(texts, judge)) for s in chosen]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64()))], ["doc_id", "kind", "start", "end", "probability"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SPANS)


def redacted(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """docs with each span to redact replaced by its kind in brackets; n_chars, where there, is the new length of changed texts; other columns stay.

    Null and empty texts stay as they are, whatever the doc_id; repeated rows are changed alike; an empty table stays empty; columns may have any names.
    """
    judge = model(precision)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches):
            texts = [t or "" for t in piece.column("text").to_pylist()]
            changed = {}
            for k, (t, chosen) in enumerate(zip(texts, judged(texts, judge))):
                if chosen:
                    parts, at = [], 0
                    for kind, a, b, _ in chosen:
                        parts += [t[at:a], f"[{kind.upper()}]"]
                        at = b
                    changed[k] = "".join([*parts, t[at:]])
            if changed:
                columns = list(piece.columns)
                mask = np.zeros(piece.num_rows, bool)
                mask[list(changed)] = True
                where = names.index("text")
                columns[where] = pa.compute.replace_with_mask(columns[where], pa.array(mask), pa.array([changed[k] for k in sorted(changed)], columns[where].type))
                if "n_chars" in names:
                    n = names.index("n_chars")
                    columns[n] = pa.compute.replace_with_mask(columns[n], pa.array(mask), pa.array([len(changed[k]) for k in sorted(changed)], columns[n].type))
                piece = pa.RecordBatch.from_arrays(columns, schema=piece.schema)
            yield piece

    return docs.mapInArrow(run, docs.schema)

"""Personal data by weak supervision.

Base spans (email, ip, card, phone) follow fixed rules and always stay.  Beyond them,
looser patterns propose candidates: written-out emails, cards that fail the checksum,
national phone numbers, id numbers, bank accounts, names.  Labelers vote on every span
(1 yes, 0 no, 2 no opinion):

    rule       the strict rule of the kind holds
    checksum   Luhn, modulo 97, number ranges
    gazetteer  known domains endings, card issuers, countries, first names
    context    a telling word shortly before
    setting    0 where the surroundings speak against it (part of a longer token, a key)

The vote patterns are counted over all documents; expectation-maximisation (two classes,
labelers independent given the class) estimates how each labeler votes in each class,
and so a probability for each pattern.  With these as soft labels a logistic classifier
is fitted on the features of the spans; it decides on the candidates.

Votes and features are small sets of values, so the counts that reach the driver are
bounded by the number of patterns, not by the corpus.  Documents are read twice, never
shuffled.  Patterns use possessive repeats or start from a rare character, so they are
linear in very long texts.

Defined results: null text counts as empty; no spans give an empty string (and the hash
of one); repeated rows are returned each; overlapping spans of different base kinds
stay, an added span that touches a base span or an earlier added one does not; columns
that the operator adds replace columns of the same name; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopstream.llm.workers import lean

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "id", "iban", "name")
LABELERS = ("rule", "checksum", "gazetteer", "context", "setting")
YES, NO, NONE = 1, 0, 2

# fixed values: short lists of the gazetteer and context labelers
ENDINGS = frozenset("com org net edu gov io co de fr es it nl uk us eu info biz ch at be pl se".split())
IBAN_COUNTRIES = frozenset("AT BE CH CZ DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())
FIRST_NAMES = frozenset("""Anna Maria Peter Paul John James Robert Michael William David Mary Linda Barbara Susan Jessica
Sarah Thomas Charles Daniel Laura Emma Julia Sophie Marie Jean Pierre Claire Hans Klaus Karl Heinz Ursula Jürgen Carlos
José Juan Carmen Lucia Antonio Miguel Elena""".split())
CONTEXT = {
    "email": ("mail", "contact", "write", "correo", "courriel", "kontakt"), "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "móvil", "appelez"),
    "id": ("ssn", "social", "passport", "id", "ausweis", "dni"), "iban": ("iban", "account", "konto", "cuenta", "compte"),
    "name": ("name", "mr", "mrs", "ms", "dr", "herr", "frau", "señor", "señora", "mme", "regards", "sincerely")}

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}").finditer
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])++").finditer
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_written = re.compile(r"([A-Za-z0-9._%+-]{1,64})\x20?[\[(]at[\])]\x20?([A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]{1,63})+)").finditer
_national = re.compile(r"(?<![0-9+(])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])").finditer
_number = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])").finditer
_iban = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])").finditer
_name = re.compile(r"(?<!\w)(?:" + "|".join(sorted(FIRST_NAMES)) + r")\x20[A-ZÀ-Þ]\w{1,30}(?:\x20[A-ZÀ-Þ]\w{1,30})?").finditer
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the email rule, found from the at signs."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _domain(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        else:
            end = max(end, at)
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the fixed rules, by kind and start."""
    out = [("email", a, b) for a, b in emails(text)]
    for m in _ip(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _card(text):
        if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in _phone(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def candidate_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Looser proposals that touch no base span."""
    found = []
    if "(at)" in text or "[at]" in text:
        found += [("email", *m.span()) for m in _written(text)]
    found += [("card", *m.span()) for m in _card(text) if 13 <= len(_digits(m[0])) <= 19]
    found += [("phone", *m.span()) for m in _national(text)]
    found += [("id", *m.span()) for m in _number(text)]
    found += [("iban", *m.span()) for m in _iban(text)]
    found += [("name", *m.span()) for m in _name(text)]
    if not found:
        return found
    taken = sorted((a, b) for _, a, b in base)
    out = []
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if all(b <= x or a >= y for x, y in taken) and (not out or a >= out[-1][2]):
            out.append((kind, a, b))
    return out


def votes(text: str, kind: str, a: int, b: int, strict: bool) -> tuple[int, ...]:
    span, d = text[a:b], _digits(text[a:b])
    checksum = {"card": lambda: luhn(d), "iban": lambda: mod97(span), "id": lambda: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00",
                "phone": lambda: 9 <= len(d) <= 15}.get(kind)
    known = {"email": lambda: span.rstrip(")]").lower().split(".")[-1] in ENDINGS,
             "card": lambda: d[0] in "3456", "iban": lambda: span[:2] in IBAN_COUNTRIES,
             "name": lambda: span.split(" ")[0] in FIRST_NAMES}.get(kind)
    before = text[max(0, a - 40):a].lower()
    tokens = re.findall(r"\w+", before)
    near = any(w in CONTEXT[kind] for w in tokens[-4:])
    left, right = text[a - 1:a], text[b:b + 1]
    against = left.isalnum() or right.isalnum() or left in ("=", "_", "/", "#") or right in ("=", "_", "/")
    return (YES if strict else NO if kind in BASE else NONE,
            NONE if checksum is None else YES if checksum() else NO,
            NONE if known is None else YES if known() else NO,
            YES if near else NONE, NO if against else NONE)


def features(text: str, kind: str, a: int, b: int) -> tuple[int, ...]:
    """Small whole numbers: kind, length class, digit share in quarters, separators, edges."""
    span = text[a:b]
    n = b - a
    return (KINDS.index(kind), min(7, n // 4), 4 * len(_digits(span)) // n, min(3, sum(c in " -.()" for c in span)),
            int(text[a - 1:a].isalnum()), int(text[b:b + 1].isalnum()), int(text[max(0, a - 1):a] in ("", " ", "\n", ":", "(")))


FEATURE_SIZES = (len(KINDS), 8, 5, 4, 2, 2, 2)


def estimate_reliability(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns [p, labelers] with counts.

    Returns the vote probabilities [class, labeler, vote] and each pattern's probability of
    being personal data.  Pseudo-counts say that labelers are right more often than not.
    """
    n_lab = patterns.shape[1]
    pseudo = np.ones((2, n_lab, 3))
    pseudo[1, :, YES] += 3
    pseudo[0, :, NO] += 3
    table = pseudo / pseudo.sum(axis=2, keepdims=True)
    prior, post = 0.5, np.full(len(patterns), 0.5)
    scale = 1000.0 / max(1.0, counts.sum())  # pseudo-counts weigh alike at every size
    weight = counts * scale * 10
    for _ in range(rounds):
        logp = np.log([1 - prior, prior])[:, None] + sum(np.log(table[:, k, patterns[:, k]]) for k in range(n_lab))
        post = 1 / (1 + np.exp(np.clip(logp[0] - logp[1], -50, 50)))
        prior = (1 + (weight * post).sum()) / (2 + weight.sum())
        for c, w in ((0, weight * (1 - post)), (1, weight * post)):
            for k in range(n_lab):
                seen = pseudo[c, k] + np.bincount(patterns[:, k], weights=w, minlength=3)
                table[c, k] = seen / seen.sum()
    return table, post


def one_hot(rows: np.ndarray) -> np.ndarray:
    out = np.ones((len(rows), 1 + sum(FEATURE_SIZES) + 2 * len(LABELERS)))
    col = 1
    for k, size in enumerate((*FEATURE_SIZES, *[2] * len(LABELERS))):
        out[:, col:col + size] = rows[:, k, None] == np.arange(size)  # no opinion: all zero
        col += size
    return out


def fit_classifier(rows: np.ndarray, soft: np.ndarray, counts: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic classifier of soft labels; weighted Newton steps."""
    x = one_hot(rows)
    w = np.zeros(x.shape[1])
    counts = counts * (1000.0 / max(1.0, counts.sum()))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (counts * (p - soft)) + ridge * w
        h = (x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w


def _observed(text: str):
    base = base_spans(text)
    extra = candidate_spans(text, base)
    return base, extra, [(k, a, b, strict) for strict, spans in ((True, base), (False, extra)) for k, a, b in spans]


def count_patterns(docs: DataFrame) -> DataFrame:
    """pattern (features, then votes, as a string) and n, over all documents."""
    def run(batches):
        seen: dict[str, int] = {}
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    for kind, a, b, strict in _observed(text)[2]:
                        key = ",".join(map(str, (*features(text, kind, a, b), *votes(text, kind, a, b, strict))))
                        seen[key] = seen.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"])
    return docs.select("text").mapInArrow(lean(run), "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> np.ndarray | None:
    """Classifier weights from all documents; None if no span was found."""
    found = sorted(tuple(r) for r in count_patterns(docs).collect())  # bounded by the number of patterns
    if not found:
        return None
    rows = np.array([[int(v) for v in p.split(",")] for p, _ in found])
    counts = np.array([n for _, n in found], float)
    vote_rows, which = np.unique(rows[:, len(FEATURE_SIZES):], axis=0, return_inverse=True)
    _, post = estimate_reliability(vote_rows, np.bincount(which.ravel(), weights=counts))
    return fit_classifier(rows, post[which.ravel()], counts)


def find(text: str | None, weights: np.ndarray | None, accept: float) -> tuple[list, list]:
    """Base spans and all spans of a text, ordered by kind, then start."""
    if not text:
        return [], []
    base, extra, _ = _observed(text)
    if extra and weights is not None:
        rows = np.array([[*features(text, *s), *votes(text, *s, False)] for s in extra])
        extra = [s for s, z in zip(extra, one_hot(rows) @ weights) if z >= np.log(accept / (1 - accept))]
    else:
        extra = []
    order = lambda s: (KINDS.index(s[0]), s[1])
    return sorted(base, key=order), sorted(base + extra, key=order)


def detect(docs: DataFrame, weights: np.ndarray | None, *, accept: float = 0.9) -> DataFrame:
    """All columns plus ``base_spans`` and ``spans``: array<struct<kind, start, end>>."""
    keep = docs.select(*[c for c in docs.columns if c not in ("base_spans", "spans")])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            both = [find(text, weights, accept) for text in batch.column("text").to_pylist()]
            cols = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in pair[i]] for pair in both], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, "base_spans", "spans"])

    one = "array<struct<kind:string,start:int,end:int>>"
    schema = keep.withColumn("base_spans", F.lit(None).cast(one)).withColumn("spans", F.lit(None).cast(one)).schema
    return keep.mapInArrow(lean(run), schema)


def redact(docs: DataFrame, weights: np.ndarray | None, *, accept: float = 0.9) -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in angle brackets; overlapping spans as one."""
    names = docs.columns

    def clean(text: str | None) -> str | None:
        parts, end = [], 0
        for kind, a, b in sorted(find(text, weights, accept)[1], key=lambda s: (s[1], -s[2])):
            if a >= end:
                parts += [text[end:a], f"<{kind.upper()}>"]
            end = max(end, b)
        return "".join([*parts, text[end:]]) if parts else text

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(map(clean, batch.column(c).to_pylist()), pa.string()) if c == "text" else batch.column(c) for c in names], names=names)
    return docs.mapInArrow(lean(run), docs.schema)


def digest(found: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id", *[_count(k) for k in BASE], F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def _count(kind: str):
    return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op8_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(detect(docs, fit(docs)))

"""Personal data by weak supervision.

Candidates are spans of four kinds: the base patterns' matches (kept or dropped by
their own check) and looser forms (masked or spelled addresses, spaced or bracketed and version 6 network
addresses, national telephone numbers and those behind 00, cards with other separators).  Six labelers vote for or against each:
the strict pattern, a checksum or range check, a gazetteer (top-level domains, issuer
prefixes, reserved addresses), words before the span, characters that touch it, and
signs of a technical number.  The votes of all candidates of all documents are counted per kind
and vote pattern (at most 4 * 3^6 * 4 rows), expectation maximisation estimates each labeler's
reliability from them, and a logistic classifier of votes and shape is trained on the
estimates.  Base spans are always reported; a looser span is added where the
classifier gives it CUT or more and it meets no base span.

Defined cases: a null text is empty; offsets are code points; rows that repeat a
doc_id are each judged; nothing to vote on gives no added spans; other columns are
ignored by the query and kept by the redaction.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, table
from .textscan import pieces

KINDS = ("email", "ip", "card", "phone")
CUT = 0.9
LABELERS = 6

# The base patterns. Where one could be slow on long runs, an equal form without backtracking is used.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# The looser forms.
MASKED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:[\[({<](?:at|AT)[\])}>]|@) ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[({<](?:dot|DOT)[\])}>]|\.) ?[A-Za-z0-9-]{2,63}){1,4}")
SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} (?:at|AT) [A-Za-z0-9-]{1,63}(?: (?:dot|DOT) [A-Za-z0-9-]{2,63}){1,4}")
SPACED_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?\. ?| ?\[\.\] ?| ?\(\.\) ?)[0-9]{1,3}(?: ?\. ?| ?\[\.\] ?| ?\(\.\) ?)[0-9]{1,3}(?: ?\. ?| ?\[\.\] ?| ?\(\.\) ?)[0-9]{1,3}(?![0-9])")
IP6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])|(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])")
LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])")
ABROAD = re.compile(r"(?<![0-9A-Za-z+.-])00[1-9][0-9]{0,2}[ ./-][0-9() ./-]{5,16}[0-9](?![0-9A-Za-z])")
TRUNK = re.compile(r"(?<![0-9A-Za-z])\(0[0-9]{1,4}\)[ -]?[0-9][0-9 -]{3,10}[0-9](?![0-9A-Za-z])")
SPACED_CARD = re.compile(r"(?<![0-9A-Za-z.])(?:[0-9]{4}([._/]|  |\t|\u00a0)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{2}([._/]|  |\t|\u00a0)[0-9]{6}\2[0-9]{5})(?![0-9A-Za-z])")
#: (kind, what a text must hold one of, form)
LOOSE = (
    (0, ("[at]", "(at)", "[AT]", "(AT)", "{at}", "{AT}", "<at>", "<AT>", " @", "@ "), MASKED), (0, (" dot ", " DOT "), SPELLED), (1, (" . ", ". ", "[.]", "(.)"), SPACED_IP), (1, (":",), IP6),
    (2, (), SPACED_CARD), (3, (), LOCAL_PHONE), (3, ("00",), ABROAD), (3, ("(0",), TRUNK),
)

# The gazetteers.
DOMAINS = frozenset("com org net edu gov mil int info biz io co us uk de fr es it nl ch at eu be se no dk fi pl pt ru cn jp in br au ca example test".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "36", "30", "35", "6011", "65", "62", "22", "23", "24", "25", "26", "27")
NEAR = {
    "email": frozenset("email e-mail mail contact write reach address courriel correo".split()),
    "ip": frozenset("ip host server address client from addr".split()),
    "card": frozenset("card visa mastercard credit debit payment karte carte tarjeta pan".split()),
    "phone": frozenset("phone call tel mobile fax cell contact telefon telephone number".split()),
}
TECHNICAL = re.compile(r"(?:version|ver|v|build|rev|token|key|id|isbn|sha|hash|no|nr|#|=|\"|')\W{0,3}$", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in s.split("."))


def base(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, passed) for the base patterns' matches."""
    out = []
    if "@" in text:
        done = 0
        for m in DOMAIN.finditer(text):
            at = start = m.start()
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                out.append((start, 0, m.end(), True))
                done = m.end()
    out += [(m.start(), 1, m.end(), _octets(m[0])) for m in IP.finditer(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = _digits(m[0])
            if len(d) >= 12:
                out.append((m.start(), 2, m.end(), len(d) <= 19 and luhn(d)))
    if "+" in text:
        out += [(m.start(), 3, m.end(), 9 <= len(_digits(m[0])) <= 15) for m in PHONE.finditer(text)]
    return out


def loose(text: str, taken: list) -> list[tuple[int, int, int]]:
    out = [(m.start(), kind, m.end()) for kind, signs, form in LOOSE if not signs or any(x in text for x in signs) for m in form.finditer(text)]
    out = sorted(x for x in out if not any(x[0] < e and s < x[2] for s, _, e, *_ in taken))
    kept: list[tuple[int, int, int]] = []
    for x in out:  # leftmost first, without overlaps
        if not kept or x[0] >= kept[-1][2]:
            kept.append(x)
    return kept


def votes(text: str, start: int, kind: int, end: int, strict: int) -> int:
    """The labelers' votes (0 against, 1 none, 2 for) and the shape, as one number."""
    span, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 1]
    digits = _digits(span)
    if kind == 0:
        check = 2 if 6 <= len(span) <= 254 else 0
        tail = re.split(r"[^A-Za-z]+", span.rstrip(")]"))[-1].lower()
        known = 2 if tail in DOMAINS else 1
    elif kind == 1:
        check = 2 if ":" in span or all(int(x) <= 255 for x in re.findall("[0-9]+", span) if len(x) <= 3) else 0
        known = 2 if "::" in span or span.count(":") == 7 else 0 if digits.strip("0") == "" or span.startswith(("0.", "127.")) else 1
    elif kind == 2:
        check = 2 if 12 <= len(digits) <= 19 and luhn(digits) else 0
        known = 2 if digits.startswith(ISSUERS) else 0
    else:
        check = 2 if 9 <= len(digits) <= 15 else 0
        known = 0 if len(set(digits[-7:])) < 3 else 2 if digits[-10:-7].lstrip("01")[:1] else 1
    words = [w.lower() for w in re.findall(r"[A-Za-z-]+", before)[-3:]]
    near = 2 if any(w in NEAR[KINDS[kind]] for w in words) else 1
    touch = 0 if (before[-1:].isalnum() or before[-1:] in "_@/=" and before or after.isalnum() or after in "_@/=" and after) else 2
    technical = 0 if TECHNICAL.search(before[-12:]) else 1
    shape = min(3, len(digits) // 5)
    code = 0
    for v in (strict, check, known, near, touch, technical):
        code = 3 * code + v
    return 4 * code + shape


def find(text: str):
    """(base spans that pass, looser spans with their votes, votes of all candidates)."""
    every = base(text)
    passed = sorted((s, k, e) for s, k, e, ok in every if ok)
    extra = loose(text, [x for x in every if x[3]])
    seen = [(k, votes(text, s, k, e, 2 if ok else 0)) for s, k, e, ok in every]
    added = [(s, k, e, votes(text, s, k, e, 1)) for s, k, e in extra]
    return passed, added, seen + [(k, v) for _, k, _, v in added]


SPAN = "struct<start:int,kind:int,end:int,votes:int>"
FOUND = f"doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<{SPAN}>, added array<{SPAN}>, seen array<int>"


def _scan(batches):
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("votes", pa.int32())])
    for batch in batches:
        for piece in pieces(batch):
            cols: list[list] = [[] for _ in range(8)]
            for text in piece.column("text"):
                passed, added, seen = find(text.as_py() or "")
                for k in range(4):
                    cols[k].append(sum(1 for x in passed if x[1] == k))
                cols[4].append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in passed).encode()).hexdigest())
                cols[5].append([{"start": s, "kind": k, "end": e, "votes": 0} for s, k, e in passed])
                cols[6].append([{"start": s, "kind": k, "end": e, "votes": v} for s, k, e, v in added])
                cols[7].append([k * 4 * 3**LABELERS + v for k, v in seen])
            kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(span), pa.list_(span), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], [f.split()[0] for f in "doc_id n_email n_ip n_card n_phone base_sha256 base added seen".split()])


def _features(codes: np.ndarray) -> np.ndarray:
    """One-hot votes and shape, kind, and a constant."""
    out, rest = [np.ones(len(codes))], codes.copy()
    out += [(rest % 4 == k).astype(float) for k in range(1, 4)]
    rest //= 4
    for _ in range(LABELERS):
        out += [(rest % 3 == 0).astype(float), (rest % 3 == 2).astype(float)]
        rest //= 3
    return np.stack([*out, *[(rest == k).astype(float) for k in range(1, 4)]], axis=1)


def _votes(codes: np.ndarray) -> np.ndarray:
    rest, out = codes // 4, []
    for _ in range(LABELERS):
        out.append(rest % 3)
        rest = rest // 3
    return np.stack(out, axis=1)


def reliabilities(codes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Posterior that each pattern is personal data, by expectation maximisation (two classes, labelers independent given the class)."""
    v = _votes(codes)
    p = np.clip((v == 2).mean(axis=1) - (v == 0).mean(axis=1) + 0.5, 0.05, 0.95)
    for _ in range(rounds):
        logit = np.zeros(len(codes))
        for weight, sign in ((p, 1), (1 - p, -1)):
            w = weight * counts
            logit += sign * np.log(w.sum() + 1)
            for j in range(LABELERS):
                table_ = np.array([w[v[:, j] == x].sum() for x in range(3)]) + 1.0
                logit += sign * np.log(table_ / table_.sum())[v[:, j]]
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return p


def fit(codes: np.ndarray, counts: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights of the span classifier: logistic regression on the estimates, by Newton steps with a small ridge."""
    p, x = reliabilities(codes, counts), _features(codes)
    w = np.zeros(x.shape[1])
    scale = counts
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (scale * q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w += np.clip(np.linalg.solve(h, x.T @ (scale * (p - q)) - 0.1 * w), -5, 5)
    return w


def model(counted: list[tuple[int, int]]) -> np.ndarray | None:
    """Classifier weights from (pattern, count) over all candidates."""
    if not counted:
        return None
    codes, counts = (np.array(x) for x in zip(*sorted(counted), strict=True))
    return fit(codes, counts.astype(float))


def accepted(weights: np.ndarray | None, codes) -> set[int]:
    codes = np.array(sorted(set(codes)), dtype=np.int64)
    if weights is None or not len(codes):
        return set()
    score = 1 / (1 + np.exp(-np.clip(_features(codes) @ weights, -30, 30)))
    return set(codes[score >= CUT].tolist())


def _fitted(found: DataFrame) -> set[int]:
    """Patterns (of at most 4 * 4 * 3^6) whose looser spans are personal data by the trained classifier."""
    rows = found.select(F.explode("seen").alias("code")).groupBy("code").count().collect()
    return accepted(model([(r["code"], r["count"]) for r in rows]), [r["code"] for r in rows])


def op2(spark, sf_dir):
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    found = scratch.save(docs.mapInArrow(_scan, FOUND))
    yes = sorted(_fitted(found))
    fits = lambda x: F.array_contains(F.lit(yes) if yes else F.array().cast("array<int>"), (x["kind"] * (4 * 3**LABELERS) + x["votes"]).cast("int"))
    every = F.array_sort(F.concat("base", F.filter("added", fits)))
    name = F.array(*[F.lit(k) for k in KINDS])
    spans = F.array_join(F.transform(every, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with [KIND] in place of every span; n_chars, where there is one, follows the text."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.save(docs.select(F.lit(0).cast("long").alias("doc_id"), "text").mapInArrow(_scan, FOUND).select("seen").where("size(seen) > 0"))
    yes = _fitted(found)

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                texts = []
                for value in piece.column("text"):
                    text = value.as_py()
                    passed, added, _ = find(text or "")
                    spans = sorted(passed + [(s, k, e) for s, k, e, v in added if k * 4 * 3**LABELERS + v in yes])
                    parts, at = [], 0
                    for s, k, e in spans:
                        if s >= at:
                            parts += [text[at:s], f"[{KINDS[k].upper()}]"]
                        at = max(at, e)
                    texts.append("".join([*parts, text[at:]]) if spans else text)
                cols = {n: piece.column(n) for n in piece.schema.names}
                cols["text"] = pa.array(texts, pa.string()).cast(piece.schema.field("text").type)
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out

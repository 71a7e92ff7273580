"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans (e-mail, IPv4, payment card with check digit, phone), leftmost and non-overlapping per
kind, over whole texts. The field then labels tokens O, email, ip, card or phone:

* a token's own potential is the smoothed log share of each label among tokens of its shape (digits, letters and marks
  in runs, hashed to 65,536 values), counted over all documents with the base spans as labels; base tokens are held at
  their label,
* neighbouring tokens share the log ratio of how often labels follow one another,
* distant tokens that repeat or resemble one another (the same digits, or the same name before an @ sign) share a
  potential that favours equal labels; each is tied to its next occurrence, so links grow with the text only.

Loopy message passing runs over the tokens that hold a digit, an @ or a tied name; all others are fixed at O, their
only likely label. A token whose belief in one label reaches ``least`` and that overlaps no base span adds a span.

Null and empty texts have no spans. Rows that share a doc_id are separate. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telvane.llm.common import ship, shipped

KINDS = ["email", "ip", "card", "phone"]
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Rounds of messages, weight of ties, belief that adds a span, shapes kept, characters of a shape.
ROUNDS, TIE, LEAST = 10, 2.0, 0.9
#: Shapes are hashed to so many values, whatever the size of the corpus.
SHAPES = 1 << 16


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """An @ with the longest local part before it (after the previous match) and a domain behind it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            free = found.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out["ip"].append(m.span())
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                    out["phone"].append(m.span())
    return out


def shape(token: str) -> str:
    """Runs of letters as a, of digits as 9 with their count, marks as they are; of the whole token, hashed."""
    parts = re.findall(r"[0-9]+|[^\W\d_]+|.", token, re.S)
    written = "".join(f"9{len(p)}" if p[0] in "0123456789" else "a" if p[0].isalpha() else p for p in parts)
    return str(zlib.crc32(written.encode("utf-8", "replace")) % SHAPES)


def core(token: str, start: int) -> tuple[str, int]:
    """The token without marks around it, and where it starts."""
    left = len(token) - len(token.lstrip("\"'([{<,;:.!?|*#$%&"))
    inner = token[left:].rstrip("\"')]}>,;:.!?|*#$%&")
    return inner, start + left


class Tokens:
    """The tokens of a text that may carry a label, their base labels, neighbours and ties."""

    def __init__(self, text: str, spans: dict[str, list[tuple[int, int]]]):
        marked = sorted((a, b, k) for k, kind in enumerate(KINDS, 1) for a, b in spans[kind])
        names = {text[a:b].partition("@")[0] for a, b in spans["email"]}
        names = {x for x in names if len(x) >= 5 and not x.isalpha()}
        self.start, self.end, self.label, self.shape, self.place, keys = [], [], [], [], [], []
        i = 0
        for n, m in enumerate(TOKEN.finditer(text)):
            token, start = core(m[0], m.start())
            if not token or not ("@" in token or DIGIT.search(token) or token in names):
                continue
            end = start + len(token)
            while i < len(marked) and marked[i][1] <= start:
                i += 1
            label = next((k for a, b, k in marked[i : i + 4] if a < end and b > start), 0)
            digits = re.sub(r"[^0-9]", "", token)
            name = token.partition("@")[0]
            self.start.append(start)
            self.end.append(end)
            self.label.append(label)
            self.shape.append(shape(token))
            self.place.append(n)
            keys.append(("n", name) if name in names else ("d", digits) if len(digits) >= 7 and len(digits) * 2 >= len(token) else ("t", token))
        last: dict[tuple[str, str], int] = {}
        self.ties = []
        for j, key in enumerate(keys):
            if key in last:
                self.ties.append((last[key], j))
            last[key] = j
        self.chain = [(j, j + 1) for j in range(len(keys) - 1) if self.place[j + 1] == self.place[j] + 1]


def texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def observe(docs: DataFrame) -> DataFrame:
    """(kind, key, label, n): label counts of each shape, and of each pair of neighbours' labels."""

    def run(batches):
        for batch in batches:
            counts: dict[tuple[str, str, int], int] = {}
            for text in texts(batch):
                if "@" not in text and not DIGIT.search(text):
                    continue
                t = Tokens(text, base_spans(text))
                for s, label in zip(t.shape, t.label):
                    counts["shape", s, label] = counts.get(("shape", s, label), 0) + 1
                for a, b in t.chain:
                    key = ("pair", str(t.label[a]), t.label[b])
                    counts[key] = counts.get(key, 0) + 1
            rows = [(*k, n) for k, n in counts.items()]
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["kind", "key", "label", "n"])

    return docs.mapInArrow(run, "kind string, key string, label long, n long")


class Field:
    """Log potentials of shapes and of neighbouring labels."""

    def __init__(self, shapes: dict[str, np.ndarray], pairs: np.ndarray, prior: np.ndarray):
        self.shapes = {k: np.log((v + 0.5 * prior) / (v.sum() + 0.5)) for k, v in shapes.items()}
        self.prior = np.log(prior)
        joint = (pairs + 0.5) / (pairs + 0.5).sum()
        self.next = np.log(joint / np.outer(joint.sum(axis=1), joint.sum(axis=0)))

    def beliefs(self, t: Tokens) -> np.ndarray:
        """Label probabilities after ROUNDS of loopy sum-product messages; edges carry messages both ways."""
        own = np.array([self.shapes.get(s, self.prior) for s in t.shape])
        for i, label in enumerate(t.label):
            if label:
                own[i] = np.where(np.arange(5) == label, 0.0, -30.0)
        pairs = np.array(t.chain + t.ties, np.int64).reshape(-1, 2)
        weights = np.concatenate([np.repeat(self.next[None], len(t.chain), 0), np.repeat(TIE * np.eye(5)[None], len(t.ties), 0)])
        source, target = np.r_[pairs[:, 0], pairs[:, 1]], np.r_[pairs[:, 1], pairs[:, 0]]
        weights = np.concatenate([weights, weights.transpose(0, 2, 1)])
        back = np.r_[np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))]
        sent = np.zeros((len(source), 5))
        for _ in range(ROUNDS if len(pairs) else 0):
            total = own.copy()
            np.add.at(total, target, sent)
            carried = (total[source] - sent[back])[:, :, None] + weights
            top = carried.max(axis=1)
            new = top + np.log(np.exp(carried - top[:, None, :]).sum(axis=1))
            sent = 0.5 * sent + 0.5 * (new - new.max(axis=1, keepdims=True))
        np.add.at(own, target, sent)
        own = np.exp(own - own.max(axis=1, keepdims=True))
        return own / own.sum(axis=1, keepdims=True)


def learn(docs: DataFrame) -> Field:
    """Potentials from the counts of all documents: one row for each of SHAPES hashed shapes."""
    counts = observe(docs).groupBy("kind", "key", "label").agg(F.sum("n").alias("n")).persist()
    total = np.ones(5)
    for r in counts.where("kind = 'shape'").groupBy("label").agg(F.sum("n").alias("n")).collect():  # five rows
        total[r["label"]] += r["n"]
    by_shape = counts.where("kind = 'shape'").groupBy("key").agg(*[F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).alias(f"l{k}") for k in range(5)])
    kept = by_shape.collect()  # at most SHAPES rows
    pairs = np.zeros((5, 5))
    for r in counts.where("kind = 'pair'").collect():  # 25 rows at most
        pairs[int(r["key"]), r["label"]] += r["n"]
    counts.unpersist()
    return Field({r["key"]: np.array([r[f"l{k}"] for k in range(5)], float) for r in kept}, pairs, total / total.sum())


def listed(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added of every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    shared = ship(docs.sparkSession, learn(docs.select("text")))
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches):
        field = shipped(shared)
        for batch in batches:
            rows = []
            for text in texts(batch):
                if "@" not in text and not DIGIT.search(text):
                    rows.append((0, 0, 0, 0, empty, "", 0))
                    continue
                spans = base_spans(text)
                base, t, added = listed(spans), Tokens(text, spans), 0
                counts = [len(spans[k]) for k in KINDS]
                taken = sorted(x for k in KINDS for x in spans[k])
                if t.start:
                    belief = field.beliefs(t)
                    for i in np.flatnonzero((belief[:, 1:].max(axis=1) >= LEAST) & (np.array(t.label) == 0)).tolist():
                        if not any(a < t.end[i] and b > t.start[i] for a, b in taken):
                            spans[KINDS[int(belief[i, 1:].argmax())]].append((t.start[i], t.end[i]))
                            added += 1
                rows.append((*counts, hashlib.sha256(base.encode()).hexdigest(), listed(spans) if added else base, added))
            columns = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")] + [pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", *NAMES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


NAMES = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]

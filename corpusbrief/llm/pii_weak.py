"""Operator 4, personal data by weak supervision.

Candidates are the base matches (four strict patterns, always kept) and looser forms: national phone
numbers, card-like digit groups with a wrong check digit, e-mail addresses with spelled-out marks.
Five labelers vote yes, no or nothing on each: strict form and check digit (regex), issuer, top-level
domain, area code (gazetteer), and helpful or misleading words before it (context).

1. One scan counts (kind, votes, features) over all documents.  Their number is bounded by the product
   of the categories, whatever the corpus, so the counts are summed in Spark and read by the driver.
2. Expectation-maximisation (one latent truth per candidate, one vote table per labeler and class)
   estimates each labeler's reliability from the counts; no labels are used.
3. A logistic span classifier is trained on the features with EM's posteriors as targets.
4. A second scan keeps base spans, and other candidates the classifier accepts (``threshold``) that
   overlap no base span and no earlier accepted one.

Offsets count code points, ends are exclusive.  Rows: a NULL or empty text has no spans; repeated rows
give repeated results; an empty table gives an empty table; texts are scanned whole, in linear time.
Only id and text are read.
"""
from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_place, give_back, prep, table

KINDS = ("email", "ip", "card", "phone")
DIGIT = re.compile("[0-9]")
LOCAL = re.compile("[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match never starts inside a run of digits: what fails at its start fails further in, too
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NATIONAL = re.compile(r"(?<![0-9A-Za-z+.)(-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])")
CARDLIKE = re.compile(r"(?<![0-9-])(?:[0-9]{4}[ -]){3}[0-9]{4}(?![0-9-])|(?<![0-9-])[0-9]{15,16}(?![0-9-])")
SPELLED = re.compile(r"[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9-]+(?:(?: ?[\[(] ?(?:dot|DOT) ?[\])] ?|\.)[A-Za-z0-9-]+)+")
# fixed values: gazetteers and context words
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65", "22", "23", "24", "25", "26", "27")
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu")
HELPS = {"email": "mail email e-mail contact write adresse correo", "ip": "ip host server address from login",
         "card": "card visa mastercard credit carte karte tarjeta", "phone": "phone tel telephone call mobile fax ruf móvil"}
MISLEADS = "order invoice isbn no nr id serial version part article page bestellung commande pedido".split()
HELPS = {k: frozenset(v.split()) for k, v in HELPS.items()}
MISLEADS = frozenset(MISLEADS)
WORD = re.compile(r"[^\W\d_][\w-]*")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the four strict patterns, sorted by start, then kind as listed."""
    out, last, p = [], 0, text.find("@")
    while p >= 0:
        s = p
        while s > last and LOCAL.match(text, s - 1):
            s -= 1
        m = DOMAIN.match(text, p + 1) if s < p else None
        if m:
            out.append((s, m.end(), "email"))
            last = m.end()
        else:
            last = max(last, p + 1)  # a later local part cannot reach over this mark
        p = text.find("@", last)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.group().split(".")):
                out.append((*m.span(), "ip"))
        for m in CARD.finditer(text):
            if m.end() - m.start() <= 37:
                d = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append((*m.span(), "card"))
        for m in PHONE.finditer(text):
            n = sum(map(m.group().count, "0123456789"))
            if 9 <= n <= 15:
                out.append((*m.span(), "phone"))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def extra_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Looser candidates that overlap no base span and no earlier candidate."""
    found = []
    if DIGIT.search(text):
        found += [(*m.span(), "phone") for m in NATIONAL.finditer(text)]
        found += [(*m.span(), "card") for m in CARDLIKE.finditer(text)]
    if "at" in text or "AT" in text:
        for m in SPELLED.finditer(text):
            s = m.start()
            if s and text[s - 1] == " ":
                s -= 1
            e = s
            while s and LOCAL.match(text, s - 1):
                s -= 1
            if s < e:
                found.append((s, m.end(), "email"))
    if not found:
        return []
    ends = sorted((s, e) for s, e, _ in base)
    reach = np.maximum.accumulate([e for _, e in ends]).tolist()
    out, last = [], 0
    for s, e, k in sorted(found):
        i = bisect_left(ends, (e, -1))  # base spans that start before e
        if s >= last and not (i and reach[i - 1] > s):
            out.append((s, e, k))
            last = e
    return out


def votes(text: str, s: int, e: int, kind: str) -> tuple[int, ...]:
    """One vote per labeler: 0 none, 1 no, 2 yes."""
    x = text[s:e]
    digits = "".join(c for c in x if "0" <= c <= "9")
    strict = {"email": "@" in x, "ip": True, "card": not (" " in x and "-" in x), "phone": x.startswith("+")}[kind]
    check = {"email": 0, "ip": 0, "card": 2 if luhn(digits) else 1, "phone": 2 if 9 <= len(digits) <= 15 else 1}[kind]
    if kind == "email":
        known = 2 if x.rpartition(".")[2].lower() in DOMAINS else 0
    elif kind == "card":
        known = 2 if digits.startswith(ISSUERS) else 1
    elif kind == "phone":
        area = digits[-10:-7]
        known = 2 if len(area) == 3 and area[0] in "23456789" else 1
    else:
        known = 1 if x.startswith(("0.", "127.", "255.")) else 2
    before = {w.lower() for w in WORD.findall(text[max(0, s - 40):s])[-4:]}
    return (2 if strict else 0, check, known, 2 if before & HELPS[kind] else 0, 1 if before & MISLEADS else 0)


def features(text: str, s: int, e: int, v: tuple[int, ...]) -> tuple[int, ...]:
    """Small categories of the span's shape, beside the votes."""
    x = text[s:e]
    n = sum("0" <= c <= "9" for c in x)
    return (min(n, 20) // 4, min(3, sum(x.count(c) for c in " ().-")), int(s > 0 and text[s - 1].isalnum()),
            int(e < len(text) and text[e].isalnum()), *v)


@dataclass
class SpanModel:
    reliability: dict = field(default_factory=dict)  # kind -> (prior, table[class][labeler][vote])
    weights: dict = field(default_factory=dict)  # (kind, place, value) -> weight; (kind,) -> bias

    def score(self, kind: str, f: tuple[int, ...]) -> float:
        z = self.weights.get((kind,), -8.0) + sum(self.weights.get((kind, i, x), 0.0) for i, x in enumerate(f))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def expectation_maximisation(counts: dict[tuple[int, ...], int], rounds: int = 50):
    """(prior, vote tables, posterior by vote pattern) of one kind from its vote pattern counts."""
    v = np.array(list(counts), int)
    n = np.array(list(counts.values()), float)
    post = np.clip(((v == 2).sum(1) + 0.5) / ((v > 0).sum(1) + 1.0), 0.05, 0.95)  # start: share of yes votes
    for _ in range(rounds):
        prior = ((n * post).sum() + 1) / (n.sum() + 2)
        p = np.empty((2, v.shape[1], 3))
        for c, w in enumerate((n * (1 - post), n * post)):
            for j in range(v.shape[1]):
                p[c, j] = (np.bincount(v[:, j], w, 3) + (0.5, 0.5 + (c == 0), 0.5 + (c == 1))) / (w.sum() + 2.5)
        logs = [math.log(x) + sum(np.log(p[c, j][v[:, j]]) for j in range(v.shape[1]))
                for c, x in enumerate((1 - prior, prior))]
        post = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -30, 30)))
    return prior, p, dict(zip(counts, post.tolist()))


def fit(rows: list[tuple[str, tuple[int, ...], int]], steps: int = 300, rate: float = 0.5) -> SpanModel:
    """EM and the span classifier from (kind, features with votes, count)."""
    model = SpanModel()
    for kind in sorted({k for k, _, _ in rows}):
        own = [(f, n) for k, f, n in sorted(rows) if k == kind]
        by_vote: Counter = Counter()
        for f, n in own:
            by_vote[f[4:]] += n
        prior, p, post = expectation_maximisation(dict(by_vote))
        model.reliability[kind] = (prior, p.tolist())
        names = sorted({(kind, i, x) for f, _ in own for i, x in enumerate(f)})
        at = {k: i for i, k in enumerate(names)}
        x = np.zeros((len(own), len(names) + 1))
        x[:, -1] = 1
        for r, (f, _) in enumerate(own):
            x[r, [at[(kind, i, c)] for i, c in enumerate(f)]] = 1
        y, n = np.array([post[f[4:]] for f, _ in own]), np.array([float(c) for _, c in own])
        w = np.zeros(len(names) + 1)
        for _ in range(steps):
            g = x.T @ (n / n.sum() * (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y))
            w -= rate * 4 * (g + 1e-4 * w)
        model.weights |= {k: float(w[i]) for k, i in at.items()} | {(kind,): float(w[-1])}
    return model


def learn(docs: DataFrame, text_col: str = "text") -> SpanModel:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    base = base_spans(t)
                    for s, e, k in base + extra_spans(t, base):
                        c[(k, features(t, s, e, votes(t, s, e, k)))] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in c], pa.string()),
                                          pa.array([list(f) for _, f in c], pa.list_(pa.int32())),
                                          pa.array(list(c.values()), pa.int64())], names=["kind", "f", "n"])

    rows = (docs.select(F.col(text_col).alias("text")).mapInArrow(count, "kind string, f array<int>, n long")
            .groupBy("kind", "f").agg(F.sum("n").alias("n")).collect())  # bounded: see the module text
    return fit([(r.kind, tuple(r.f), r.n) for r in rows])


def all_spans(text: str | None, model: SpanModel, threshold: float) -> tuple[list, list]:
    """(base spans, all spans), each sorted by start, then kind."""
    if not text:
        return [], []
    base = base_spans(text)
    more = [(s, e, k) for s, e, k in extra_spans(text, base)
            if model.score(k, features(text, s, e, votes(text, s, e, k))) >= threshold]
    return base, sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2]))) if more else base


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find(docs: DataFrame, model: SpanModel, id_col: str = "doc_id", text_col: str = "text",
         threshold: float = 0.8) -> DataFrame:
    """(id, base, spans): the spans as ``kind:start:end`` lists, comma-joined."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [all_spans(t, shared.value, threshold) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([joined(x) for x, _ in found], pa.string()),
                                              pa.array([joined(y) for _, y in found], pa.string())],
                                             names=["id", "base", "spans"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("base", T.StringType()),
                           T.StructField("spans", T.StringType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def mask(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """``text`` with each span replaced by its kind; overlapping spans become one mark."""
    out, last = [], 0
    for s, e, k in spans:
        if s >= last:
            out += [text[last:s], f"[{k.upper()}]"]
        last = max(last, e)
    return text if not spans else "".join([*out, text[last:]])


def op4_pii_weak(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find(docs, learn(docs))
    n = [F.size(F.regexp_extract_all("base", F.lit(f"{k}:"), F.lit(0))).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select(F.col("id").alias("doc_id"), *n, F.sha2("base", 256).alias("base_sha256"), "spans")


def stage(spark, docs, sf_dir, threshold: float = 0.8) -> DataFrame:
    """Every document stays; its personal data is replaced by [EMAIL], [IP], [CARD] or [PHONE]."""
    prep(spark)
    shared = spark.sparkContext.broadcast(learn(docs))
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols, texts = list(b.columns), b.column(at).to_pylist()
            new = [mask(t, all_spans(t, shared.value, threshold)[1]) for t in texts]
            cols[at] = pa.array(new, cols[at].type)
            if "n_chars" in names and pa.types.is_integer(cols[names.index("n_chars")].type):
                c = names.index("n_chars")
                cols[c] = pa.array([n if x is y or x == y else len(y) for x, y, n in zip(texts, new, cols[c].to_pylist())],
                                   cols[c].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)
        give_back()

    return by_place(docs).mapInArrow(run, docs.schema)

"""Personal data: rule spans, and further spans from weak supervision.

1. ``scan`` reads each text once: the base spans by their patterns and checks, and *candidates*, broad
   patterns of anything that might be personal or secret (digit groups, long mixed tokens, contact
   addresses with spelt-out signs). Labelers vote on each candidate: regex labelers on its form,
   gazetteer labelers on key words, endings and dialling codes near it, context labelers on the characters around it.
   A vote is for (1), against (-1) or none (0).
2. ``fit_label_model`` estimates each labeler's reliability by expectation-maximisation from the counts of
   vote patterns over all candidates of all documents (at most 3**labelers patterns, in practice a few
   hundred, whatever the corpus's size) and gives each pattern its probability.
3. ``fit_span_classifier`` trains a logistic regression on form and context features with these
   probabilities as soft labels, on a bounded sample (``max_candidates``) of candidates by hash.
4. Candidates it accepts become spans unless they touch a base span: base spans always stay.

Defined results: null is empty text; offsets are code points; a match that fails its check is dropped and
not retried; no candidates at all give no further spans; repeated rows get the same spans each; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import column, only, shared_table, texts

#: The base kinds in order, with their patterns.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
KINDS = [*BASE, "contact", "number", "secret"]
#: The same matches in linear time: a run of leading characters is taken whole, and counts if group 1 follows. What
#: follows can't begin inside the run, so a run that fails at its start fails at every place in it.
LINEAR = BASE | {
    "email": re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?"),
    "ip": re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?"),
}
#: Candidate patterns of the further kinds, taken in the same way; a secret also needs a digit and a letter.
CANDIDATES = {
    "contact": re.compile(r"[A-Za-z0-9._%+-]{2,}+(\s?(?:\(at\)|\[at\]|\{at\}|@)\s?[A-Za-z0-9-]{2,}+(?:\s?(?:\(dot\)|\[dot\]|\.)\s?[A-Za-z]{2,}+)*+)?", re.I),
    "secret": re.compile(r"([A-Za-z0-9_\-+/]{16,}+={0,2})"),
    "number": re.compile(r"(\(?[0-9](?:[ ().\-/]{0,3}[0-9]){6,}+)"),
}
MIXED = re.compile(r"[A-Za-z_\-+/]*+[0-9]"), re.compile(r"[0-9_\-+/]*+[A-Za-z]")
#: Gazetteers.
SECRET_WORDS = ("token", "key", "secret", "password", "passwd", "pwd", "bearer", "auth", "credential", "passwort", "clave", "contraseña", "mot de passe")
CONTACT_WORDS = ("tel", "phone", "call", "mobile", "fax", "mail", "contact", "kontakt", "telefon", "teléfono", "téléphone", "correo", "courriel", "ssn", "passport", "iban", "account")
ENDINGS = ("com", "org", "net", "edu", "gov", "de", "fr", "es", "io", "info")
SIGNIFICANT = re.compile(r"[0-9@]|\bat\b|\(at\)|\[at\]", re.I)
LABELERS = ["form_hex", "form_mixed", "form_phone", "form_long_number", "form_luhn", "form_address", "word_secret", "word_contact", "ending", "assigned", "quoted", "stands_alone", "decimal", "monotone"]
FEATURES = ["bias", "contact", "number", "secret", "length", "digits", "letters", "spaces", "upper", "distinct", "runs", "before_equals", "before_quote", "before_letter", "after_letter", "after_quote", "word_secret", "word_contact", "hex", "grouped"]


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-1][::2])
    return total % 10 == 0


def _valid(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in s.split(".")))
    if kind == "email":
        return True
    digits = re.sub("[^0-9]", "", s)
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def base_spans(text: str, shift: int = 0) -> list[tuple[str, int, int]]:
    """Base spans of a text (or of one of its lines, at ``shift``), by kind, then start."""
    return [(kind, shift + m.start(), shift + m.end()) for kind, p in LINEAR.items() for m in p.finditer(text) if (not p.groups or m[1] is not None) and _valid(kind, m.group())]


def votes(kind: str, s: str, before: str, after: str) -> list[int]:
    digits = re.sub("[^0-9]", "", s)
    letters = sum(c.isalpha() for c in s)
    near = before.lower()
    is_hex = bool(re.fullmatch("[0-9a-fA-F]{32,}", s))
    mixed = kind == "secret" and len(digits) >= 4 and letters >= 4
    phone = bool(re.search(r"\(?[0-9]{3}\)?[ .\-][0-9]{3}[ .\-][0-9]{4}$", s))
    alone = not before[-1:].isalnum() and not after[:1].isalnum()
    return [
        1 if is_hex else 0,
        1 if mixed else -1 if kind == "secret" else 0,
        (1 if phone else -1) if kind == "number" else 0,
        (1 if 13 <= len(digits) <= 19 else 0) if kind == "number" else 0,
        (1 if luhn(digits) else -1) if kind == "number" and 13 <= len(digits) <= 19 else 0,
        (1 if re.search(r"\w@\w|\(at\)|\[at\]|\{at\}", s, re.I) else -1) if kind == "contact" else 0,
        1 if any(w in near for w in SECRET_WORDS) else 0,
        1 if any(re.search(rf"\b{w}", near) for w in CONTACT_WORDS) else 0,
        (1 if s.rpartition(".")[2].lower() in ENDINGS or s.lower().split()[-1] in ENDINGS else -1) if kind == "contact" else 0,
        1 if re.search(r"[=:]\s*[\"']?$", before) else 0,
        1 if before[-1:] in "\"'" and after[:1] in "\"'" and before and after else 0,
        1 if alone else -1,
        -1 if kind == "number" and re.fullmatch(r"[0-9]{1,3}(?:[.,][0-9]{3})+(?:[.,][0-9]+)?|[0-9]+[.,][0-9]+", s) else 0,
        -1 if len(set(s)) <= 3 else 0,
    ]


def features(kind: str, s: str, before: str, after: str) -> list[float]:
    n = max(1, len(s))
    share = lambda f: sum(map(f, s)) / n
    near = before.lower()
    return [
        1.0, kind == "contact", kind == "number", kind == "secret", min(len(s), 80) / 40, share(str.isdigit), share(str.isalpha), share(str.isspace), share(str.isupper), len(set(s)) / n,
        sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:], strict=False)) / n, bool(re.search(r"[=:]\s*[\"']?$", before)), before[-1:] in ("'", '"'), before[-1:].isalnum(), after[:1].isalnum(), after[:1] in ("'", '"'),
        any(w in near for w in SECRET_WORDS), any(re.search(rf"\b{w}", near) for w in CONTACT_WORDS), bool(re.fullmatch("[0-9a-fA-F]{32,}", s)), bool(re.search(r"[0-9][ .\-][0-9]", s)),
    ]


def candidates(line: str, taken: list[tuple[int, int]], shift: int = 0) -> list[tuple[str, int, int, list[int], list[float]]]:
    """Candidates of one line that touch none of the ``taken`` spans nor an earlier candidate."""
    out: list = []
    starts: list[int] = []  # of disjoint stretches that are taken, in order
    ends: list[int] = []
    for a, b in sorted(taken):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for kind, p in CANDIDATES.items():
        for m in p.finditer(line):
            s, e = m.span()
            if m[1] is None or kind == "secret" and not all(x.match(m[1]) for x in MIXED):
                continue
            k = bisect_left(starts, shift + e)
            if k and ends[k - 1] > shift + s:
                continue
            starts.insert(k, shift + s)
            ends.insert(k, shift + e)
            before, after = line[max(0, s - 40) : s], line[e : e + 10]
            out.append((kind, shift + s, shift + e, votes(kind, m.group(), before, after), [float(x) for x in features(kind, m.group(), before, after)]))
    return out


def scan_text(text: str) -> tuple[list, list]:
    """Base spans (by kind, then start) and candidates. No pattern crosses a line, so bare lines are skipped."""
    spans, found, at = [], [], 0
    if SIGNIFICANT.search(text):
        for line in text.split("\n"):
            if SIGNIFICANT.search(line):
                own = base_spans(line, at)
                spans += own
                found += candidates(line, [x[1:] for x in own], at)
            at += len(line) + 1
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(spans, key=lambda x: (order[x[0]], x[1])), found


_SPAN = pa.struct([("kind", pa.string()), ("s", pa.int64()), ("e", pa.int64())])
_CANDIDATE = pa.struct([("kind", pa.string()), ("s", pa.int64()), ("e", pa.int64()), ("votes", pa.list_(pa.int8())), ("x", pa.list_(pa.float32()))])
_DDL = "doc_id long, base array<struct<kind: string, s: long, e: long>>, found array<struct<kind: string, s: long, e: long, votes: array<tinyint>, x: array<float>>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and candidates with votes and features, per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, found = [], []
            for t in texts(b):
                s, c = scan_text(t.decode("utf-8", "surrogateescape")) if t else ([], [])
                base.append([dict(zip(("kind", "s", "e"), x, strict=True)) for x in s])
                found.append([dict(zip(("kind", "s", "e", "votes", "x"), x, strict=True)) for x in c])
            yield pa.RecordBatch.from_arrays([column(b, "doc_id").cast(pa.int64()), pa.array(base, pa.list_(_SPAN)), pa.array(found, pa.list_(_CANDIDATE))], ["doc_id", "base", "found"])

    return only(docs, "doc_id", "text").mapInArrow(run, _DDL)


@dataclass(frozen=True)
class LabelModel:
    """Naive label model: P(vote | class) per labeler, and the prior."""

    prior: float
    log_odds: np.ndarray  # labelers x votes (-1, 0, 1)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        z = np.log(self.prior / (1 - self.prior)) + sum(self.log_odds[k, patterns[:, k] + 1] for k in range(patterns.shape[1]))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> LabelModel:
    """Estimate the labelers' reliabilities from pattern counts; starts from the majority of the votes."""
    p = 1 / (1 + np.exp(-1.5 * patterns.sum(1)))
    total = counts.sum()
    for _ in range(rounds):
        w1, w0 = counts * p, counts * (1 - p)
        prior = float(np.clip(w1.sum() / total, 0.02, 0.98))
        odds = np.empty((patterns.shape[1], 3))
        for k in range(patterns.shape[1]):
            for v in (-1, 0, 1):
                at = patterns[:, k] == v
                a, b = (w1[at].sum() + 1) / (w1.sum() + 3), (w0[at].sum() + 1) / (w0.sum() + 3)
                odds[k, v + 1] = np.log(a / b)
        model = LabelModel(prior, odds)
        q = model.posterior(patterns)
        if np.abs(q - p).max() < 1e-6:
            break
        p = q
    return model


def fit_label_model(found: DataFrame) -> LabelModel | None:
    rows = found.groupBy("votes").count().collect()  # vote patterns: bounded by the labelers, not by the corpus
    if not rows:
        return None
    rows = sorted((list(r["votes"]), r["count"]) for r in rows)
    return expectation_maximisation(np.array([r[0] for r in rows], int), np.array([r[1] for r in rows], float))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weights by Newton's method on soft labels."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + l2 * w
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + l2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_span_classifier(found: DataFrame, labels: LabelModel, max_candidates: int = 20_000) -> np.ndarray:
    """Trained on at most ``max_candidates`` candidates, taken by a hash of their place."""
    rows = found.orderBy(F.xxhash64("doc_id", "s", "e"), "doc_id", "s").limit(max_candidates).select("votes", "x").collect()
    x = np.array([r.x for r in rows], float)
    return logistic(x, labels.posterior(np.array([list(r.votes) for r in rows], int)))


def find_spans(docs: DataFrame, threshold: float = 0.5, max_candidates: int = 20_000) -> DataFrame:
    """doc_id, base and extra: arrays of (kind, s, e); extra spans are the method's."""
    scanned = shared_table(scan(docs), "pii-scan")
    found = scanned.select("doc_id", F.explode("found").alias("c")).select("doc_id", "c.*")
    model = fit_label_model(found)
    if model is None:
        return scanned.select("doc_id", "base", F.slice("base", 1, 0).alias("extra"))
    w = fit_span_classifier(found, model, max_candidates)
    score = lambda c: sum((c["x"][k].cast("double") * float(v) for k, v in enumerate(w)), F.lit(0.0))
    cut = float(np.log(threshold / (1 - threshold)))
    extra = F.transform(F.filter("found", lambda c: score(c) > cut), lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e")))
    return scanned.select("doc_id", "base", F.array_sort(extra).alias("extra"))


def joined(spans: str):
    """kind:start:end, comma-joined, in the array's order."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Documents with every span replaced by its kind in angle brackets; other columns kept. doc_id must be unique."""
    both = spans.select("doc_id", F.array_sort(F.transform(F.concat("base", "extra"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))).alias("_spans"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    step = lambda text: lambda acc, x: F.when(x["s"] < acc["at"], acc).otherwise(F.struct(F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, (x["s"] - acc["at"]).cast("int")), F.lit("<"), x["kind"], F.lit(">")).alias("out"), x["e"].alias("at")))
    text = F.coalesce(F.col("text"), F.lit(""))
    done = F.aggregate("_spans", start, step(text), lambda acc: F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, F.length(text))))
    return docs.join(both, "doc_id", "left").withColumn("text", F.when(F.size("_spans") > 0, done).otherwise(F.col("text"))).drop("_spans")



"""Secret scans: candidate strings are told from false positives by a random forest trained on labelled findings.

The forest sees a candidate's length, whether it has a published format, the likelihood of its character transitions, how much of it
dictionary words cover, the document's path and the neighbouring words. Transitions and dictionary are counted over all documents. Labelled
findings may be given; where none are, planted() makes them: secrets and harmless look-alikes of many kinds, drawn at random, are set
into excerpts of a bounded sample of the documents, so a label never comes from a rule over the features. The fitted forest is read from its
saved tables and scores every whole text where it lies: nothing is joined back, so rows without ids or with repeated ids serve too.
"""

from __future__ import annotations

import base64
import math
import random
import re
import string
import zlib
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_id, scratch_path, written

#: Dictionary words, excerpts that findings are planted in, findings of each label for the forest, and distinct words that a task counts before it passes them on.
DICTIONARY_WORDS, MAX_EXCERPTS, MAX_FINDINGS, COUNTED = 20000, 3000, 8000, 200000
#: Characters of an excerpt, and how often five findings are planted in it.
EXCERPT, PLANTED = 600, 4
#: A candidate is a secret from this score on: below one half, as a secret left in costs more than a word masked.
THRESHOLD = 0.4
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{12,}={0,2}(?![A-Za-z0-9+/_\-])")
WORD = re.compile(r"\w+")
AROUND = 48
WORD_SLOTS, PATH_SLOTS = 24, 8

# Published formats of keys, names that secrets are assigned to, and stand-ins that are no secrets.
NAMES = r"(?:token|secret|passw(?:or)?d|pwd|api_?-?key|access_?-?key|auth|credential|private_?-?key)\w{0,64}[\"']?\s{0,32}(?:=>|:=|=|:)\s{0,32}"
#: A whole assigned value: between quotes, or up to white space.
VALUE = re.compile(NAMES + r"""(?:"((?:[^"\\\n]|\\.)+)"|'((?:[^'\\\n]|\\.)+)'|["']?([^\s"']\S*))""", re.I)
NAME = re.compile(NAMES, re.I)
PEM_BEGIN, PEM_END = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,4}PRIVATE KEY(?: BLOCK)?-----"), re.compile(r"-----(BEGIN|END) [A-Z0-9 ]{0,64}-----")
#: The lines of a private key whose end is missing.
PEM_LINES = re.compile(r"(?:(?:\s|\\[nr])+[A-Za-z0-9+/=]{16,})*")
FORMATS = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,4}PRIVATE KEY[\s\S]*|(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{10,}|AIza[A-Za-z0-9_-]{35}|glpat-[A-Za-z0-9_-]{20}")
ASSIGNED = re.compile(NAMES + r"[\"']?\Z", re.I)
#: A password within an address, and a signed token of three parts.
ADDRESS, SIGNED = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]{0,24}://[^\s/:@]{0,64}:([^\s/@]+)@"), re.compile(r"eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{4,}\.[A-Za-z0-9_\-]{4,}")
#: Whole values that stand for a secret to be filled in.
STAND_IN = re.compile(r"<.*>|\$\{.*\}|\{\{.*\}\}|\$\w+|%\w+%|[x*.\-]+|(?:your|my|the|insert)[-_ ].*|change_?me|example|sample|dummy|placeholder|none|null|true|false|todo", re.I)

def _fold(c: str) -> int:
    """Letters by themselves without case, then digits, marks and the rest."""
    o = ord(c)
    return o - 97 if 97 <= o <= 122 else o - 65 if 65 <= o <= 90 else 26 if 48 <= o <= 57 else 27 if o < 128 else 28


class Lexicon:
    """Log probabilities of one character after another in ordinary words, and a dictionary."""

    def __init__(self, pairs: dict[int, int], words: set[str]):
        rows = [sum(pairs.get(a * 29 + b, 0) + 1 for b in range(29)) for a in range(29)]
        self.logs = [[math.log((pairs.get(a * 29 + b, 0) + 1) / rows[a]) for b in range(29)] for a in range(29)]
        self.words = words

    def transitions(self, s: str) -> float:
        codes = [_fold(c) for c in s]
        return sum(self.logs[a][b] for a, b in zip(codes, codes[1:], strict=False)) / max(1, len(codes) - 1)

    def coverage(self, s: str) -> float:
        """Share of the characters that dictionary words of 3 to 12 letters cover, longest first from the left."""
        low, at, covered = s.lower(), 0, 0
        while at < len(low):
            n = next((n for n in range(12, 2, -1) if low[at : at + n] in self.words and at + n <= len(low)), 0)
            covered, at = covered + n, at + max(n, 1)
        return covered / max(1, len(low))


def learn_lexicon(docs: DataFrame, words: int = DICTIONARY_WORDS) -> Lexicon:
    """From docs(id, text): character pairs and words counted over all documents; the commonest words are the dictionary."""

    def rows(seen):
        pairs = Counter()
        for w, n in seen.items():
            codes = [_fold(c) for c in w]
            for a, c in zip(codes, codes[1:], strict=False):
                pairs[a * 29 + c] += n
        out = [(w, n) for w, n in seen.items() if 3 <= len(w) <= 12 and w.isalpha()] + [(str(k), n) for k, n in pairs.items()]
        return pd.DataFrame(out, columns=["key", "n"])

    def count(batches):
        seen = Counter()
        for b in batches:
            for t in b["text"]:
                seen.update(WORD.findall((t or "").lower()))
                if len(seen) >= COUNTED:
                    yield rows({w: n for w, n in seen.items() if not w.isdigit()})
                    seen.clear()
        yield rows({w: n for w, n in seen.items() if not w.isdigit()})

    counted = docs.select("text").mapInPandas(count, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counted = written(counted, "counted")
    is_pair = F.col("key").rlike("^[0-9]+$")
    pairs = {int(r["key"]): r["n"] for r in counted.where(is_pair).collect()}
    common = counted.where(~is_pair).orderBy(F.desc("n"), "key").limit(words).collect()
    return Lexicon(pairs, {r["key"] for r in common})


def _features(value: str, before: str, after: str, path: str, lexicon: Lexicon) -> list[float]:
    n = len(value)
    counts = Counter(value)
    kinds = [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in value]
    out = [
        min(n, 4096),
        lexicon.transitions(value),
        lexicon.coverage(value),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        kinds.count(0) / n,
        kinds.count(2) / n,
        -sum(k / n * math.log2(k / n) for k in counts.values()),
        len(counts) / n,
        float(all(c in "0123456789abcdefABCDEF" for c in value)),
        float(before[-1:] in ("'", '"')),
        float(bool(re.search(r"[=:]\s*[\"']?\Z", before))),
        float(bool(FORMATS.fullmatch(value))),
        float(bool(STAND_IN.fullmatch(value))),
        float(bool(ASSIGNED.search(before))),
    ]
    near, paths = [0.0] * WORD_SLOTS, [0.0] * PATH_SLOTS
    for w in [*WORD.findall(before.lower())[-2:], *WORD.findall(after.lower())[:1]]:
        near[zlib.crc32(w.encode()) % WORD_SLOTS] = 1.0
    for w in WORD.findall(path.lower()):
        paths[zlib.crc32(w.encode()) % PATH_SLOTS] = 1.0
    return [*out, *near, *paths]


def _places(text: str) -> list[tuple[int, int]]:
    """[start, stop) of the candidates, in order: private keys from BEGIN to END, whole assigned values, passwords of addresses, signed tokens,
    and runs of key characters.

    Places may overlap, as a run within an assigned value; runs within a private key are part of it.
    """
    keys: list[tuple[int, int]] = []
    at = 0
    while begin := PEM_BEGIN.search(text, at):
        end = PEM_END.search(text, begin.end())
        at = end.end() if end and end[1] == "END" else PEM_LINES.match(text, begin.end()).end()
        keys.append((begin.start(), at))
    found = {m.span(1) for m in ADDRESS.finditer(text)} | {m.span() for m in SIGNED.finditer(text)}
    at = 0
    while m := VALUE.search(text, at):
        found.add(m.span(m.lastindex))
        own = NAME.search(text, m.start(3), m.end() + AROUND) if m[3] else None
        at = m.start(3) if own and own.start() < m.end() < own.end() else m.end()  # a value may be the name of the next one
    for m in CANDIDATE.finditer(text):
        value = m[0]
        if any(c.isdigit() for c in value) or FORMATS.fullmatch(value) or ASSIGNED.search(text, max(0, m.start() - AROUND), m.start()):
            found.add(m.span())
    if keys:
        starts = [a for a, _ in keys]
        found = {(a, b) for a, b in found if not ((i := bisect_right(starts, a) - 1) >= 0 and b <= keys[i][1])}
    return sorted(found.union(keys))


class Kinds:
    """Secrets and harmless look-alikes of many kinds, drawn from one generator; what they stand in is drawn apart from what they are."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def some(self, letters: str, low: int, high: int | None = None) -> str:
        return "".join(self.r.choices(letters, k=self.r.randint(low, high or low)))

    def word(self, words: list[str]) -> str:
        """One of the words at hand, or one that no dictionary has."""
        if self.r.random() < 0.6:
            return self.r.choice(words)
        return "".join(self.some("bcdfghjklmnprstvwz", 1) + self.some("aeiou", 1) + self.some("lnrst", 0, 1) for _ in range(self.r.randint(2, 4)))

    def password(self, words: list[str]) -> str:
        r, alnum, word = self.r, string.ascii_letters + string.digits, self.word(words)
        leet = word.translate(str.maketrans("aeiost", "431057"))
        kinds = [self.some(alnum, 8, 24), self.some(alnum + "!@#$%^&*-_+?.", 8, 24), leet + self.some("!@#$%&*-_?", 1, 2) + self.some(string.digits, 1, 4), word.capitalize() + self.some(string.digits + "!#$&", 2, 6),
                 word + self.word(words)[:6] + self.some(string.digits, 0, 4), word[:8] + self.some(string.digits, 1, 2) + word[: r.randint(2, 6)], word[:8] + self.some(string.digits, 1, 2) + self.word(words)[:6], " ".join([*r.sample(words, min(2, len(words))), self.some(alnum + "'", 1, 6)]), self.some(alnum + "!?#", 4, 7),
                 self.some(alnum, 12, 18) + self.some("$#!%&*.:;", 1) + self.some(alnum, 2, 10)]
        return r.choice(kinds).replace('"', "").replace("\\", "").replace("\n", " ").strip()

    def secret(self, words: list[str]) -> tuple[str, bool]:
        """A secret, and whether its form is published, so that it stands by itself too."""
        r, alnum, key = self.r, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
        kind = r.randrange(17)
        if kind < 4:
            return self.some("0123456789abcdef", r.choice([16, 20, 32, 40, 64])), False
        if kind < 6:
            return self.some(key, 20, 64), False
        if kind < 13:
            return self.password(words), False
        if kind == 13:
            return r.choice(["AKIA", "ASIA"]) + self.some(string.ascii_uppercase + "234567", 16), True
        if kind == 14:
            return r.choice(["ghp_", "gho_"]) + self.some(alnum, 36), True
        if kind == 15:
            return r.choice(["sk_live_", "glpat-", "AIza"]) + self.some(alnum, 20, 24), False
        part = lambda n: base64.urlsafe_b64encode(self.r.randbytes(n)).decode().rstrip("=")
        return f"eyJ{part(24)}.eyJ{part(40)}.{part(32)}", True

    def private_key(self) -> str:
        kind = self.r.choice(["RSA ", "EC ", "", "OPENSSH "])
        lines = "\n".join(self.some(string.ascii_letters + string.digits + "+/", 64) for _ in range(self.r.randint(2, 12)))
        return f"-----BEGIN {kind}PRIVATE KEY-----\n{lines}\n-----END {kind}PRIVATE KEY-----"

    def name(self) -> str:
        name = self.r.choice(["token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "access_key", "auth_token", "client_secret", "db_password", "credential", "secret_key"])
        return self.r.choice([name, name.upper(), name.title()])

    def assigned(self, value: str) -> tuple[str, str]:
        """What comes before and after a value that a name is given."""
        quote = self.r.choice(['"', "'"]) if " " in value or "'" not in value and self.r.random() < 0.5 else ""
        quote = '"' if "'" in value else quote
        return self.name() + self.r.choice([" = ", "=", ": ", " => ", ":"]) + quote, quote

    def offending(self, words: list[str]) -> tuple[str, str, str]:
        kind = self.r.random()
        if kind < 0.06:
            return "", self.private_key(), ""
        value, published = self.secret(words)
        if published and kind < 0.4:
            return "", value, ""
        if kind > 0.92 and re.fullmatch(r"[^\s/@:]+", value):
            return self.r.choice(["postgres", "https", "mysql", "redis"]) + "://" + self.r.choice(["admin", "root", "app"]) + ":", value, "@db." + self.r.choice(["local", "example.org", "internal"]) + "/x"
        before, after = self.assigned(value)
        return before, value, after

    def harmless(self, words: list[str]) -> tuple[str, str, str]:
        r, hexes = self.r, "0123456789abcdef"
        word = lambda: self.word(words)
        bare = [
            self.some(string.digits, 12, 20), f"{self.some(string.digits, 3)}-{self.some(string.digits, 3)}-{self.some(string.digits, 4)}-{self.some(string.digits, 4)}", "-".join(self.some(hexes, n) for n in (8, 4, 4, 4, 12)),
            f"{word()}-{r.randrange(99)}-{word()}-{word()}", f"{word()}_{word()}_{r.randrange(1000)}", f"{word()}/{word()}/{word()}{r.randrange(100)}", f"20{self.some(string.digits, 2)}-0{r.randint(1, 9)}-1{r.randrange(10)}T10-{self.some(string.digits, 2)}-00",
        ]
        kind = r.random()
        if kind < 0.45:
            return "", r.choice(bare), ""
        if kind < 0.6:
            return r.choice(["commit ", "sha256: ", "checksum = ", "revision ", "digest=", "id: ", "build "]), self.some(hexes, r.choice([12, 16, 32, 40, 64])), ""
        if kind < 0.8:
            value = r.choice(["changeme", "your-api-key", "your_token_here", "<token>", "${TOKEN}", "$SECRET", "example", "xxxxxxxx", "********", "placeholder", "none", "null", "{{ secret }}", "insert-key-here", "dummy", "..."])
            before, after = self.assigned(value)
            return before, value, after
        if kind < 0.93:
            return self.name() + r.choice([": ", " = ", "="]), r.choice([word(), word(), f"{word()}.{word()}", f"get_{word()}()", f"os.environ['{word().upper()}']", f"{word()},"]).replace(" ", "") or "the", ""
        return f"https://{word()}.example.org/", f"{word()}/{word()}/{self.some(string.digits, 8, 12)}", ""


def planted(docs: DataFrame, lexicon: Lexicon, excerpts: int = MAX_EXCERPTS, seed: int = 1) -> DataFrame:
    """Labelled findings (id, start, label, features): random secrets and look-alikes set into excerpts of so many of docs(id, text, path) at most.

    A secret that no candidate covers exactly is lost to the scan whatever the forest says; such a row has null features. Look-alikes
    without a candidate raise no finding and have no row. Excerpts are chosen, and cut, by hash.
    """
    at = F.expr(f"pmod(xxhash64(text), greatest(length(text) - {EXCERPT}, 1)) + 1")
    # about twice as many as wanted go on, so that no task ever sorts more; copies of a text are told apart by id
    share = min(1.0, (2 * excerpts + 1000) / max(1, docs.count()))
    pieces = docs.where(F.length("text") > 0).select(F.substring(F.col("text"), at.cast("int"), F.lit(EXCERPT)).alias("text"), F.coalesce("path", F.lit("")).alias("path"), F.xxhash64("id", "text").alias("h"))
    pieces = pieces.where(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20))).orderBy("h", "text", "path").limit(excerpts)

    def each(batches):
        for b in batches:
            rows = []
            for text, path, h in zip(b["text"], b["path"], b["h"], strict=True):
                kinds, words = Kinds((h & 0xFFFFFFFF) * 31 + seed), [w for w in WORD.findall(text) if w.isalpha()] or ["word"]
                for label in (0, 0, 1, 1, 0) * PLANTED:
                    before, value, after = (kinds.offending if label else kinds.harmless)(words)
                    spots = [m.start() for m in re.finditer(r"\s", text)] or [len(text)]
                    spot = kinds.r.choice(spots)
                    whole = f"{text[:spot]} {before}{value}{after} {text[spot:]}"
                    start = spot + 1 + len(before)
                    hits = {(a, z) for a, z in _places(whole) if a < start + len(value) and z > start}
                    if label:
                        hits = hits & {(start, start + len(value))} or {None}
                    for hit in sorted(hits, key=str):
                        rows.append((h, start, label, hit and _features_at(whole, *hit, path, lexicon)))
            yield pd.DataFrame(rows, columns=["id", "start", "label", "features"])

    return pieces.repartition(16, "h").mapInPandas(each, "id long, start int, label int, features array<double>")


def _features_at(text: str, start: int, stop: int, path: str, lexicon: Lexicon) -> list[float]:
    return _features(text[start:stop], text[max(0, start - AROUND) : start], text[stop : stop + AROUND], path, lexicon)


def train(findings: DataFrame, max_findings: int = MAX_FINDINGS, trees: int = 24, depth: int = 10) -> RandomForestClassificationModel | None:
    """A forest from labelled findings (label 0 or 1, features): so many of each label at most, chosen by hash.

    None if a label is missing: then there is nothing to tell apart. Findings without features are left out.
    """
    findings = findings.where("features is not null")
    order = F.xxhash64("id", "start")
    parts = [findings.where(F.col("label") == k).orderBy(order, "id", "start").limit(max_findings) for k in (0, 1)]
    rows = written(parts[0].union(parts[1]).select("label", array_to_vector("features").alias("vector")), "findings")
    if rows.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=trees, maxDepth=depth, maxBins=32, featureSubsetStrategy="onethird", seed=7).fit(rows)


class Forest:
    """A fitted forest as arrays of nodes, read from the tables that Spark saves it in, for scoring inside a scan."""

    def __init__(self, model: RandomForestClassificationModel, spark):
        path = scratch_path(spark, "forest")
        model.write().save(path)
        rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
        base, at = {}, 0
        for r in rows:
            base.setdefault(r["treeID"], at)
            at += 1
        self.roots = list(base.values())
        inner = np.array([r["leftChild"] >= 0 for r in rows])
        self.left, self.right = (np.array([base[r["treeID"]] + r[side] if r[side] >= 0 else i for i, r in enumerate(rows)]) for side in ("leftChild", "rightChild"))
        self.feature = np.array([r["split"]["featureIndex"] if i else 0 for i, r in zip(inner, rows, strict=True)])
        self.limit = np.array([r["split"]["leftCategoriesOrThreshold"][0] if i else 0.0 for i, r in zip(inner, rows, strict=True)])
        self.share = np.array([r["impurityStats"][1] / max(sum(r["impurityStats"]), 1e-12) for r in rows])

    def scores(self, features: list[list[float]]) -> np.ndarray:
        """The mean share of secrets in the leaves that each row falls to."""
        x, total = np.array(features), np.zeros(len(features))
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                after = np.where(x[np.arange(len(x)), self.feature[at]] <= self.limit[at], self.left[at], self.right[at])
                if (after == at).all():
                    break
                at = after
            total += self.share[at]
        return total / len(self.roots)


def _outer_first(found: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Places in order, each with the largest score of those within it: a value that holds a secret is one."""
    out, open_ = [], []
    for a, b, score in sorted(found, key=lambda x: (x[0], -x[1])):
        while open_ and out[open_[-1]][1] < b:
            open_.pop()
        out.append((a, b, score))
        for i in reversed(open_):
            if out[i][2] >= score:
                break
            out[i] = (*out[i][:2], score)
        open_.append(len(out) - 1)
    return sorted(out)


@dataclass
class Scanner:
    """What tells secrets apart: a lexicon, and a forest (without one, only published formats are secrets)."""

    lexicon: Lexicon
    forest: Forest | None
    threshold: float = THRESHOLD

    def found(self, texts: list[str | None], paths: list[str | None]) -> list[list[tuple[int, int, float]]]:
        """(start, stop, score) of every candidate of each text."""
        places = [_places(t) if t else [] for t in texts]
        if self.forest is None:
            return [[(a, b, float(bool(FORMATS.fullmatch(t[a:b])))) for a, b in own] for t, own in zip(texts, places, strict=True)]
        features = [_features_at(t, a, b, p or "", self.lexicon) for t, p, own in zip(texts, paths, places, strict=True) for a, b in own]
        scores = iter(self.forest.scores(features).tolist() if features else ())
        # a private key says what it is
        return [_outer_first([(a, b, max(next(scores), float(bool(PEM_BEGIN.match(t, a))))) for a, b in own]) for t, own in zip(texts, places, strict=True)]

    def masked(self, text: str | None, found: list[tuple[int, int, float]], mark: str) -> str | None:
        """text with mark in place of its secrets, one mark where they overlap."""
        merged: list[list[int]] = []
        for start, stop, score in sorted(found):
            if score >= self.threshold:
                if merged and start < merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], stop)
                else:
                    merged.append([start, stop])
        for start, stop in reversed(merged):
            text = text[:start] + mark + text[stop:]
        return text


def _rows(docs: DataFrame, id_col: str, text_col: str, path_col: str | None) -> DataFrame:
    path = F.col(f"`{path_col}`").cast("string") if path_col else F.lit("")
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), path.alias("path"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", findings: DataFrame | None = None) -> Scanner:
    """A scanner for docs, from labelled findings (label, features, id, start) if given, else from planted ones."""
    rows = _rows(docs, id_col, text_col, path_col)
    lexicon = learn_lexicon(rows)
    model = train(planted(rows, lexicon) if findings is None else findings)
    return Scanner(lexicon, None if model is None else Forest(model, docs.sparkSession))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", scanner: Scanner | None = None) -> DataFrame:
    """(id, start, stop, score, secret) of every candidate of every whole text; start and stop count characters.

    Null and empty texts have none; rows with repeated or null ids give their own; an empty table gives no rows. Candidates may overlap.
    """
    scanner = scanner or fit(docs, id_col, text_col, path_col)
    rows = _rows(docs, id_col, text_col, path_col)

    def each(batches):
        for b in batches:
            found = scanner.found(list(b["text"]), list(b["path"]))
            out = [(doc, *place, place[2] >= scanner.threshold) for doc, own in zip(b["id"], found, strict=True) for place in own]
            yield pd.DataFrame(out, columns=["id", "start", "stop", "score", "secret"])

    return by_id(rows, each, "start int, stop int, score double, secret boolean")


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", mark: str = "[SECRET]", scanner: Scanner | None = None) -> DataFrame:
    """docs, every row and column, with the secrets that scan() finds replaced by mark, one mark where they overlap.

    Texts are masked where they are scanned: nothing is joined, so null and repeated ids, repeated rows and any other columns are
    rows and columns like others. Texts without secrets, and nulls, are unchanged.
    """
    scanner = scanner or fit(docs, id_col, text_col, path_col)

    def each(batches):
        for b in batches:
            texts = b.column(text_col).to_pylist()
            paths = [None if p is None else str(p) for p in b.column(path_col).to_pylist()] if path_col else [None] * len(texts)
            new = [scanner.masked(t, own, mark) for t, own in zip(texts, scanner.found(texts, paths), strict=True)]
            at = b.schema.get_field_index(text_col)
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    return docs.mapInArrow(each, docs.schema)


def op3(spark, sf_dir):
    """Every candidate of every document with its decision. Repeated ids give their own rows; an empty table gives none."""
    from .common import table

    return scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")

"""Secret scans: candidates found by pattern, and a random forest that removes the false ones.

Every whole text is searched for candidates: tokens of well-known formats, values assigned to names such as
password, passwords in URLs, and long tokens that mix letters and digits. A candidate is described by its length, its characters and
their transitions, how much of it dictionary words cover, words of the path that the text comes from, and the words
next to it. A random forest trained on labelled findings decides which candidates stay.

The labelled findings are a table (text, first, last, path, label), bounded by FINDINGS rows. Where none are given,
``made_findings`` makes one from a sample of the corpus: a token is put between words of a document of the sample. True ones are
secrets as services and configurations write them; false ones are what the corpus itself offers in their place: digests of its texts,
its words joined to identifiers, paths, versions and assigned values, and placeholders. The dictionary is the corpus's frequent words
besides a fixed list. All samples are bounded (DOCUMENTS, WORDS_MOST), so the model's size does not depend on the corpus; it goes to the
tasks with the code, and scanning is one pass without a shuffle.

Defined cases: null and empty texts have no candidates; equal texts of equal paths have equal findings; a token of any length is
one candidate; of an empty corpus no findings can be made, and without findings of both labels every candidate stays; other columns pass
through, whatever their names (but for the three that are added, which are replaced).
"""

from __future__ import annotations

import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import checkpoint, output_schema

#: Documented bounds: labelled findings that are learned from, documents of the sample that findings are made in, and frequent words.
FINDINGS = 20_000
DOCUMENTS = 2000
WORDS_MOST = 3000
#: Trees, depth, features tried at a split, and the share of trees' votes that keeps a finding.
TREES, DEPTH, TRIED, KEEP = 40, 10, 6, 0.5
MADE = 6000

#: Kinds with their patterns, most specific first; the group named v is the secret itself. A text without any of a kind's marks (in any
#: case, if they are written in lower case) has none of that kind.
KINDS = [
    ("private-key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?P<v>(?:[^-]++|-(?!----))++)-----END", ("-----BEGIN",)),
    ("aws-key", r"\b(?P<v>(?:AKIA|ASIA)[0-9A-Z]{16})\b", ("AKIA", "ASIA")),
    ("github-token", r"\b(?P<v>gh[pousr]_[A-Za-z0-9]{36,})\b", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    ("slack-token", r"\b(?P<v>xox[abprs]-[A-Za-z0-9-]{10,})", ("xox",)),
    ("api-key", r"\b(?P<v>sk[-_](?:live_|test_|proj-)?[A-Za-z0-9]{16,})", ("sk-", "sk_")),
    ("google-key", r"\b(?P<v>AIza[0-9A-Za-z_-]{35})", ("AIza",)),
    ("jwt", r"\b(?P<v>eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", ("eyJ",)),
    ("url-password", r"(?<![\w.+-])[A-Za-z][\w+.-]{1,30}://[^\s:/@]{1,256}:(?P<v>[^\s:/@]{3,256})@", ("://",)),
    ("bearer", r"(?i:\bbearer)\s+(?P<v>[A-Za-z0-9._~+/-]{16,}=*)", ("bearer",)),
    # the name may have anything before it, as DB_PASSWORD and clientSecret have; atomic, so that a long name is read once
    ("assigned", r"(?i:(?<!\w)(?>\w*?(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)\w*+))(?:[\"']|&quot;)?\s*[:=]\s*(?:[\"']|&quot;)?(?P<v>[^\s\"',;&]{6,})", ("passw", "pwd", "secret", "token", "key", "auth")),
    ("mixed", r"(?<![A-Za-z0-9+/_-])(?P<v>(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}={0,2})", ()),
]
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16}")
_PATTERNS = [(i, re.compile(p), marks) for i, (_, p, marks) in enumerate(KINDS)]
_NEAR = ("key", "secret", "token", "password", "auth", "credential", "commit", "sha", "md5", "hash", "checksum", "uuid", "id", "version", "example", "sample", "test", "digest", "build", "file")
_PATHS = ("test", "example", "doc", "lock", "env", "config", "src")
_WORD = re.compile(r"[A-Za-z]+")


def candidates(text: str | None) -> list[tuple[int, int, int]]:
    """(first, last + 1, kind) of each candidate, in order; of those that overlap, the most specific kind stays."""
    if not text:
        return []
    found: list[tuple[int, int, int]] = []
    low = text.lower()
    for kind, pattern, marks in _PATTERNS:
        if any(m in text if m != m.lower() else m in low for m in marks) if marks else _RUN.search(text):
            found += [(*m.span("v"), kind) for m in pattern.finditer(text)]
    found.sort(key=lambda x: (x[2], x[0]))
    # places taken by more specific kinds, kept in order
    out: list[tuple[int, int, int]] = []
    for kind in dict.fromkeys(x[2] for x in found):
        taken = np.array(sorted((a, b) for a, b, _ in out), np.int64).reshape(-1, 2)
        for a, b, _ in (x for x in found if x[2] == kind):
            i = np.searchsorted(taken[:, 0], b) - 1
            if i < 0 or taken[i, 1] <= a:
                out.append((a, b, kind))
    return sorted(out)


#: Words of programs, which speak against a secret as the frequent words of the corpus do.
WORDS = (
    "the and for with from that this which user name value index table column query result data file path module class function method object string number "
    "array list map key token secret password config service server client request response error message event handler manager factory builder parser reader "
    "writer buffer stream socket thread process memory cache storage database schema model view controller component element node tree graph edge vertex layer "
    "filter sort search find create update delete insert select remove append merge split join count size length width height color style theme button label "
    "input output form field text image audio video media content header footer body title page link action state status type kind version build release test "
    "example sample demo default custom global local public private static final abstract interface package import export library utils helper common core base "
    "main application system network security session account customer order product price total amount date time year month day hour minute second internal "
    "external primary secondary current previous next first last left right top bottom start end begin stop open close read write your here changeme placeholder"
).split()


class Lexicon:
    """Words that speak against a secret: how much of a token they cover, and how usual its steps from character to character are in them."""

    def __init__(self, words: tuple[str, ...] = ()):
        import ahocorasick

        self.words = tuple(words)
        own = [w for w in {*WORDS, *self.words} if len(w) > 2]
        self.automaton = ahocorasick.Automaton()
        for w in own:
            self.automaton.add_word(w, len(w))
        self.automaton.make_automaton()
        counts = np.full((128, 128), 0.05)
        for w in sorted(own):
            c = np.minimum(np.frombuffer(f" {w} ".encode("ascii", "replace"), np.uint8), 127)
            np.add.at(counts, (c[:-1], c[1:]), 1)
        self.log = np.log(counts / counts.sum(axis=1, keepdims=True))

    def __reduce__(self):
        return Lexicon, (self.words,)

    def transitions(self, low: str) -> float:
        c = np.minimum(np.frombuffer(low.encode("ascii", "replace"), np.uint8), 127)
        return float(self.log[c[:-1], c[1:]].mean()) if len(c) > 1 else 0.0

    def covered(self, low: str) -> int:
        """Characters under words: the longest one at each place, from the left."""
        return sum(n for _, n in self.automaton.iter_long(low))


def describe(text: str, first: int, last: int, kind: int, path: str | None, lexicon: Lexicon) -> list[float]:
    token = text[first:last]
    n = len(token)
    low = token.lower()
    counts = Counter(token)
    entropy = -sum(c / n * np.log2(c / n) for c in counts.values()) if n else 0.0
    groups = [sum(counts[c] for c in counts if c in s) / max(n, 1) for s in (string.ascii_lowercase, string.ascii_uppercase, string.digits, "0123456789abcdefABCDEF", "-_")]
    classes = "".join("d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in token)
    changes = sum(a != b for a, b in zip(classes, classes[1:])) / max(len(classes) - 1, 1)
    covered = lexicon.covered(low) / max(n, 1)
    longest = max((m.end() - m.start() for m in re.finditer(r"(?s)(.)\1*", token)), default=0) / max(n, 1)
    before, after = text[max(0, first - 48) : first].lower(), text[last : last + 32].lower()
    near = set(_WORD.findall(before)[-4:]) | set(_WORD.findall(after)[:2])
    home = (path or "").lower()
    return [
        np.log1p(n), entropy, entropy / np.log2(n + 2), *groups, changes, lexicon.transitions(low), covered, longest, len(counts) / max(n, 1),
        float(before.rstrip().endswith(("=", ":", '"', "'"))), float(low.startswith(("akia", "asia", "gh", "sk", "xox", "eyj", "aiza"))), float(bool(re.search(r"example|xxxx|changeme|placeholder|your|1234|abcd|dummy", low))),
        float(bool(re.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", low))), float(n in (32, 40, 64) and groups[3] == 1), float(kind),
        *(float(any(w.startswith(k) for w in near)) for k in _NEAR), *(float(k in home) for k in _PATHS),
    ]


@dataclass
class Forest:
    """Trees as arrays: feature (-1 at a leaf), threshold, children, share of true findings."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                inner = np.flatnonzero(feature[at] >= 0)
                if not inner.size:
                    break
                node = at[inner]
                low = x[inner, feature[node]] <= threshold[node]
                at[inner] = np.where(low, left[node], right[node])
            total += share[at]
        return total / max(len(self.trees), 1)


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int) -> tuple:
    """One tree by Gini impurity, over a random choice of features at each split."""
    nodes: list[list] = []

    def split(own: np.ndarray, level: int) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, 0, 0, float(y[own].mean())])
        if level == depth or len(own) < 4 or y[own].min() == y[own].max():
            return at
        best = (1e-9, -1, 0.0)
        whole = y[own].mean()
        for f in rng.choice(x.shape[1], min(TRIED, x.shape[1]), replace=False):
            v = x[own, f]
            order = np.argsort(v, kind="stable")
            v, t = v[order], y[own][order]
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not cut.size:
                continue
            left = np.cumsum(t)[cut]
            n, m = cut + 1, len(t) - cut - 1
            p, q = left / n, (t.sum() - left) / m
            gain = whole * (1 - whole) - (n * p * (1 - p) + m * q * (1 - q)) / len(t)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), int(f), float((v[cut[i]] + v[cut[i] + 1]) / 2))
        if best[1] < 0:
            return at
        low = x[own, best[1]] <= best[2]
        nodes[at][:2] = best[1:]
        nodes[at][2] = split(own[low], level + 1)
        nodes[at][3] = split(own[~low], level + 1)
        return at

    split(np.arange(len(y)), 0)
    f, t, a, b, s = zip(*nodes)
    return np.array(f), np.array(t), np.array(a), np.array(b), np.array(s)


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 10) -> Forest:
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees if len(y) else 0):
        own = rng.integers(0, len(y), len(y))
        out.append(grow(x[own], y[own], rng, depth))
    return Forest(out)


@dataclass
class Model:
    """What tells secrets from other candidates."""

    forest: Forest
    lexicon: Lexicon

    def votes(self, found: list[tuple[str, int, int, int, str | None]]) -> np.ndarray:
        """The share of the trees that hold each candidate (text, first, last, kind, path) for a secret; all, if nothing was learned."""
        if not self.forest.trees:
            return np.ones(len(found))
        return self.forest.predict(np.array([describe(*f, self.lexicon) for f in found], float)) if found else np.zeros(0)


def fit(findings: DataFrame, words: tuple[str, ...] = (), limit: int = FINDINGS) -> Model:
    """A model from labelled findings: text, first, last (code points, last exclusive), path, label 0 or 1; words: the corpus's own."""
    sound = findings.filter(F.col("label").isin(0, 1) & F.col("text").isNotNull() & (F.col("first") < F.col("last")))
    rows = sound.orderBy(F.xxhash64("text", "first", "last"), "text", "first", "last", "path", "label").limit(limit).collect()
    lexicon = Lexicon(words)
    x = [describe(r["text"], r["first"], r["last"], kind_of(r["text"], r["first"], r["last"]), r["path"], lexicon) for r in rows]
    y = np.array([r["label"] for r in rows], float)
    known = len(y) > 0 and y.min() < y.max()
    return Model(train(np.array(x, float).reshape(len(y), -1), y) if known else Forest([]), lexicon)


def kind_of(text: str, first: int, last: int) -> int:
    return next((k for a, b, k in candidates(text) if (a, b) == (first, last)), len(KINDS))


def corpus_sample(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = "source", documents: int = DOCUMENTS) -> DataFrame:
    """(id, text, path) of the documents of lowest hash: ids are chosen without their texts, which are looked up for those alone."""
    named = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), (F.col(path).cast("string") if path else F.lit("")).alias("path"))
    ids = named.filter("id is not null and text is not null").select("id").distinct()
    chosen = checkpoint(ids.orderBy(F.xxhash64("id", F.lit(10)), "id").limit(documents))  # a bounded number
    return checkpoint(named.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("path").alias("path")))


def frequent_words(docs: DataFrame, most: int = WORDS_MOST) -> tuple[str, ...]:
    """The words of letters of all docs (text), most frequent first; a bounded number of them goes to the driver."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,20}"), 0)).alias("word"))
    top = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(F.desc("n"), "word").limit(most)
    return tuple(r["word"] for r in top.collect())


def contexts(sample: DataFrame) -> list[tuple[str, str, str]]:
    """(window, path, digest) of each document of the sample: a bounded piece of it, from a place that its id's hash says, and its whole text's digest."""
    at = F.pmod(F.xxhash64("id"), F.greatest(F.length("text") - 120, F.lit(1))).cast("int") + 1
    rows = sample.select(F.xxhash64("id").alias("h"), F.substring("text", at, F.lit(120)).alias("window"), "path", F.sha2("text", 512).alias("digest")).collect()
    return [(r["window"], r["path"] or "", r["digest"]) for r in sorted(rows, key=lambda r: (r["h"], r["digest"]))]


_NAMES = ["password", "DB_PASSWORD", "MYSQL_PWD", "PGPASSWORD", "APP_TOKEN", "client_secret", "clientSecret", "dbPassword", "secret", "token", "api_key", "apiKey", "auth_token", "ACCESS_KEY", "SECRET_KEY", "user.token"]
_SIGNS = [("=", ""), (": ", ""), (" = ", ""), ('="', '"'), (': "', '"'), (' = "', '"'), ("='", "'"), ('": "', '"')]


def made_rows(places: list[tuple[str, str, str]], words: tuple[str, ...] = (), n: int = MADE, seed: int = 10, taken=lambda label, form: True) -> list[tuple[str, int, int, str, int]]:
    """Labelled findings (text, first, last, path, label), half of them true, put into places (window, path, digest) of a corpus, from a seed.

    taken says which forms of either label are made, so that a model can be tried on forms that it has not seen.
    """
    rng = random.Random(seed)
    letters, alnum, hexa = string.ascii_letters, string.ascii_letters + string.digits, "0123456789abcdef"
    upper, base64 = string.ascii_uppercase + string.digits, alnum + "+/"
    known = [w for w in words if len(w) > 3] or WORDS
    some = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    word = lambda: rng.choice(known if rng.random() < 0.7 else WORDS)
    several = lambda k, sep="": sep.join(word() for _ in range(k))

    def assigned(value: str) -> tuple[str, str, str]:
        sign, end = rng.choice(_SIGNS)
        return rng.choice(["", "", "export ", '"' if sign.startswith('"') else ""]) + rng.choice(_NAMES) + sign, value, end

    body = lambda: "\n" + "".join(some(base64, 64) + "\n" for _ in range(rng.randint(3, 26)))
    headers = lambda: f"\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,{some(hexa.upper(), 32)}\n"
    true = [
        lambda d: ("", "AKIA" + some(upper, 16)), lambda d: ("", "ghp_" + some(alnum, 36)), lambda d: ("", "sk-" + some(alnum, rng.randint(24, 48))), lambda d: ("", "xoxb-" + some(string.digits, 11) + "-" + some(alnum, 24)),
        lambda d: ("", "AIza" + some(alnum, 35)), lambda d: ("", "eyJ" + some(alnum, 20) + "." + some(alnum, 40) + "." + some(alnum, 43)),
        lambda d: assigned(some(hexa, rng.choice([16, 20, 24, 32, 40, 48, 64]))), lambda d: assigned(some(alnum + "!@#%", rng.randint(8, 32))), lambda d: assigned(some(base64, rng.randint(20, 60)) + rng.choice(["", "=", "=="])),
        lambda d: assigned(word().title() + some(string.digits, rng.randint(2, 4)) + rng.choice("!@#%$") + some(alnum, rng.randint(0, 4))), lambda d: (rng.choice(["key ", "credential ", "secret "]), some(alnum, rng.randint(24, 44))),
        lambda d: ("Authorization: Bearer ", some(alnum + "-_", rng.randint(20, 60))), lambda d: (rng.choice(["postgres", "mysql", "amqp", "https", "redis"]) + "://" + word() + ":", some(alnum, rng.randint(8, 24)), f"@{word()}.{word()}/{word()}"),
        lambda d: ("-----BEGIN RSA PRIVATE KEY-----", rng.choice(["", headers()]) + body(), "-----END RSA PRIVATE KEY-----"),
    ]
    false = [
        lambda d: (rng.choice(["commit ", "sha ", "digest ", "md5 ", "checksum ", "sha256:", "etag ", "blob ", "revision ", ""]), d[: rng.choice([32, 40, 64])]), lambda d: (rng.choice(["id ", "uuid ", "build ", ""]), "-".join(d[i:j] for i, j in ((0, 8), (8, 12), (12, 16), (16, 20), (20, 32)))),
        lambda d: ("", several(rng.randint(3, 5), "_") + some(string.digits, rng.randint(1, 3))), lambda d: ("", "".join(w.title() for w in several(4, " ").split()) + some(string.digits, 2)),
        lambda d: assigned(rng.choice(["changeme", "your_password_here", "example", "xxxxxxxxxxxx", "placeholder", "${PASSWORD}", "<password>", "undefined", "dummy1234", "process.env.TOKEN", "os.environ", "getpass()"])),
        lambda d: ("", "AKIA" + "X" * 16), lambda d: ("", "AKIA" + several(3).upper()[:9].ljust(9, "X") + "EXAMPLE"), lambda d: ("version ", f"{several(2, '-')}-{rng.randint(1, 20)}-{rng.randint(0, 9)}-{rng.randint(0, 99)}"),
        lambda d: (rng.choice(["file ", "https://", "/"]), several(rng.randint(3, 6), "/") + f"/{word()}{rng.randint(1, 99)}"), lambda d: assigned(several(rng.randint(1, 2)).ljust(6, "e")), lambda d: assigned(f"{word()}.{word()}_{word()}"),
        lambda d: (rng.choice(["the token: ", "a secret: ", "of auth: ", "token = "]), word().ljust(6, "n")), lambda d: ("token ", some(letters, 1) * 20 + some(string.digits, 2)), lambda d: ("", several(3)[:20].ljust(16, "s") + some(string.digits, 1)),
        lambda d: ("", f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}-{rng.randint(10, 59)}-{word()}"), lambda d: ("", "data-" + several(2, "-") + f"-{rng.randint(100, 99999)}"),
        lambda d: (rng.choice(["http", "ftp"]) + "://" + word() + ":", rng.choice(["password", "pass", "example", "xxxx", "user"]), f"@{word()}.example/"),
    ]
    forms = {v: [f for i, f in enumerate(own) if taken(v, i)] for v, own in ((1, true), (0, false))}
    out = []
    for i in range(n if places else 0):
        window, path, digest = places[rng.randrange(len(places))]
        label = i % 2
        lead, token, *tail = rng.choice(forms[label])(digest)
        cut = rng.randint(0, len(window))
        before, after = window[:cut] + " " + lead, "".join(tail) + " " + window[cut:]
        out.append((before + token + after, len(before), len(before) + len(token), path, label))
    return out


def made_findings(spark: SparkSession, places: list[tuple[str, str, str]], words: tuple[str, ...] = (), n: int = MADE, seed: int = 10) -> DataFrame:
    return spark.createDataFrame(made_rows(places, words, n, seed), "text string, first int, last int, path string, label int")


def fit_to_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = "source", n: int = MADE, seed: int = 10) -> Model:
    """A model whose findings are made in a bounded number of docs, with the frequent words of all of them as the dictionary."""
    sample = corpus_sample(docs, key, text, path)
    words = frequent_words(docs.select(F.col(text).alias("text")))
    return fit(made_findings(docs.sparkSession, contexts(sample), words, n, seed), words)


FOUND = "array<struct<first:bigint,last:bigint,kind:string,score:double>>"


def scan(df: DataFrame, model: Model, text: str = "text", path: str | None = "source", keep: float = KEEP) -> DataFrame:
    """df without the text, with n_candidates, n_secrets and secrets: places (code points, last exclusive), kinds and scores."""
    added = ("n_candidates", "n_secrets", "secrets")
    kept = [c for c in df.columns if c != text and c.lower() not in added]
    taken = {c.lower() for c in df.columns}
    own_text, own_path = (next(n for n in (f"{base}{i}" for i in range(len(taken) + 1)) if n not in taken) for base in ("scanned_text", "scanned_path"))
    source = df.select(*kept, F.col(text).alias(own_text), (F.col(path).cast("string") if path else F.lit("")).alias(own_path))
    schema = output_schema(source, (own_text, own_path), f"n_candidates bigint, n_secrets bigint, secrets {FOUND}")
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(kept)
            texts, paths = batch.column(n).to_pylist(), batch.column(n + 1).to_pylist()
            found = [candidates(t) for t in texts]
            votes = model.votes([(t, *c, p) for t, p, cs in zip(texts, paths, found) for c in cs])
            out, at = [], 0
            for cs in found:
                own = votes[at : at + len(cs)].tolist()
                at += len(cs)
                out.append([{"first": a, "last": b, "kind": KINDS[k][0], "score": round(v, 6)} for (a, b, k), v in zip(cs, own) if v >= keep])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array([len(c) for c in found], pa.int64()), pa.array([len(o) for o in out], pa.int64()), pa.array(out, kind)], names=[*kept, *added])

    return source.mapInArrow(run, schema)

"""Secret scans: candidates by patterns, false positives removed by a random forest.

Candidates are

* runs of at least ``SHORTEST`` key characters with a digit, with upper and lower case letters inside, or of a well-known
  key's shape; a run of any length is one candidate, scored and replaced whole (so a key inside a path is judged with the path);
* values assigned to a name like password or token, of at least ``ASSIGNED_LEAST`` characters without white space or
  quotes, symbols included;
* the password of a URL's ``user:password@host``, and a bot's number with its key.

Candidates that overlap are one. Features: length, shares of character classes, transitions between classes, entropy, coverage
by words of a dictionary and likelihood of letter transitions in it, shape of a path or placeholder, and the words, quotes and signs before
and after. The dictionary is counted over all texts of the corpus (``dictionary``): its ``MOST_WORDS`` words found in most
documents. The forest is trained on labelled findings: those given, or a documented, seeded set of made-up ones of both
kinds, ``FINDINGS`` of each.

Defined results: a null or empty text has no findings; repeated rows are each scanned; a text whose findings are all
rejected stays as it is; an empty table gives an empty result and an empty dictionary, for which a short list of words stands in;
words found in equally many documents come in the order of their letters; findings carry a hash, never the secret itself; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwise.llm.common import discard, map_arrow, schema_of, stored, table, text_rows

SHORTEST, ASSIGNED_LEAST = 12, 8
MOST_WORDS, WORD_LEAST, WORD_MOST = 20_000, 4, 12
FINDINGS, TREES, DEPTH, LEAST_SCORE = 1500, 40, 9, 0.5
AROUND = 40
MARK = "[SECRET]"
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_.\-])[A-Za-z0-9+/_.\-]{{{SHORTEST},}}={{0,2}}")
#: Words that name a secret, words that name another identifier, and common words for want of a corpus.
SECRET_WORDS = ["password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "key", "credential", "credentials", "auth", "authorization", "bearer", "private", "access"]
OTHER_WORDS = ["sha", "sha1", "sha256", "md5", "commit", "checksum", "digest", "hash", "uuid", "guid", "id", "isbn", "doi", "version", "file", "path", "url", "http", "https", "www", "image", "phone", "card", "order", "invoice", "serial", "tracking", "ticket", "part", "sku", "reference", "integrity", "etag", "build"]
COMMON_WORDS = ["that", "with", "this", "from", "dans", "pour", "index", "page", "news", "image", "report", "file", "test", "example", "version", "release", "data", "home", "user", "admin", "docs", "main", "config"]
#: Frequent letter pairs of running text, for want of a corpus.
PAIRS = set("th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur la el ta qu un ue ie ei ge et ai ns".split())
KEY_SHAPES = re.compile(r"^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36}|^sk[-_]|^xox[abp]-|^eyJ[A-Za-z0-9_-]+\.|^AIza[A-Za-z0-9_-]{35}$|^SK[0-9a-f]{32}$|^[0-9]{8,10}:[A-Za-z0-9_-]{35}$")
NAME_BEFORE = re.compile(r"(?i)(?:passwo?r?d|passphrase|pwd|secret|token|api_?key|access_?key|private_?key|credentials?)[A-Za-z0-9_]{0,24}[\"']?[ \t]{0,8}$")
SIGN = re.compile(r"(?::=|=>|[:=])[ \t]{0,8}[\"'`]?")
SIGN_BEFORE = re.compile(SIGN.pattern + "$")
VALUE = re.compile(rf"[^\s\"'`]{{{ASSIGNED_LEAST},}}")
IN_URL = re.compile(rf"://[^\s:/@]{{1,64}}:([^\s/@]{{{ASSIGNED_LEAST},}})@")
IN_URL_BEFORE = re.compile(r"://[^\s:/@]+:$")
BOT = re.compile(r"([0-9]{8,10}:[A-Za-z0-9_-]{35})(?![A-Za-z0-9_-])")
EMBEDDED = re.compile(r"base64,[ ]*$|(?i:integrity=[\"']?)$|\bsha(?:1|256|384|512)[-:][ ]*$")
EMBEDDED_START = re.compile(r"sha(?:1|256|384|512)[-_]")
PLACEHOLDER = re.compile(r"[$<%{\[]|.*\(|(?:\*+|x+|X+|\.+)$|(?i:your|my|the|some|change|example|process\.|os\.|env)[A-Za-z._\-]")
SYMBOLS = set("!@#$%^&*?~|<>;,:()[]{}")
LETTERS = re.compile(r"[a-z]+")
UUID = re.compile(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")


class Dictionary:
    """Words of running text with the number of texts each is found in, and how likely a letter follows another in them."""

    def __init__(self, counts: Mapping[str, int] | None = None):
        self.words = frozenset(counts or COMMON_WORDS)
        pairs: Counter[str] = Counter()
        for word, n in (counts or dict.fromkeys([*COMMON_WORDS, *PAIRS], 1)).items():
            for i in range(len(word) - 1):
                pairs[word[i : i + 2]] += n
        after: Counter[str] = Counter()
        for pair, n in pairs.items():
            after[pair[0]] += n
        # one made-up pair for every thousand counted, spread over the 26 letters
        extra = {a: max(1.0, after[a] / 1000) for a in "abcdefghijklmnopqrstuvwxyz"}
        self.likely = {a + b: math.log((pairs[a + b] + extra[a] / 26) / (after[a] + extra[a])) for a in extra for b in extra}

    def coverage(self, low: str) -> float:
        """The share of characters in words of the dictionary, the longest word at each place first."""
        covered = 0
        for m in LETTERS.finditer(low):
            run, at = m.group(), 0
            while at + WORD_LEAST <= len(run):
                n = next((n for n in range(min(WORD_MOST, len(run) - at), WORD_LEAST - 1, -1) if run[at : at + n] in self.words), 0)
                covered += n
                at += n or 1
        return covered / len(low)

    def transitions(self, low: str) -> float:
        """The mean logarithm of the likelihood of letters that follow letters; that of chance without any."""
        found = [self.likely[run[i : i + 2]] for run in LETTERS.findall(low) for i in range(len(run) - 1)]
        return sum(found) / len(found) if found else -math.log(26)


def dictionary(docs: DataFrame, text_col: str = "text", most: int = MOST_WORDS) -> Dictionary:
    """The most frequent words, by documents, of all texts: at most ``most``, of 4 to 12 letters a to z that stand alone, in two documents or more."""
    schema = schema_of(docs, [], "word string, n bigint")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: Counter[str] = Counter()
        for first in range(0, batch.num_rows, 256):
            for text in batch.column("text").slice(first, 256).to_pylist():
                alone = {x.strip(".,;:!?()\"'") for x in set(text.lower().split())} if text else ()
                counts.update(w for w in alone if WORD_LEAST <= len(w) <= WORD_MOST and w.isascii() and w.isalpha())
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    scratch: list[str] = []
    counts = stored(map_arrow(docs.select(F.col(text_col).alias("text")), run, schema).groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"), scratch)
    # an eighth of a doubling of n is a bin: at most 504 of them tell which words can be among the first, so that no more are sorted
    level = F.floor(F.log2("n") * 8).cast("int")
    bins = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect()
    lowest, taken = 0, 0
    for lowest, words in bins:
        taken += words
        if taken >= most:
            break
    found = {r.word: r.n for r in counts.where(level >= lowest).orderBy(F.desc("n"), "word").limit(most).collect()}
    discard(docs.sparkSession, scratch)
    return Dictionary(found)


def assigned(before: str) -> bool:
    """Whether a value that follows is assigned to a name of a secret."""
    sign = SIGN_BEFORE.search(before)
    return bool(sign) and bool(NAME_BEFORE.search(before[: sign.start()]))


DEFAULT = Dictionary()


def features(before: str, text: str, after: str, known: Dictionary = DEFAULT) -> list[float]:
    """Numbers that describe a candidate and what stands around it."""
    n = len(text)
    lower, upper = sum(c.islower() for c in text), sum(c.isupper() for c in text)
    digits = sum(c.isdigit() for c in text)
    kinds = ["l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "s" for c in text]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    counts = Counter(text)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    low = text.lower()
    parts = [p for p in re.split(r"[/._\-]", text) if p]
    words = set(re.findall(r"[a-z_0-9]+", before.lower())[-3:])
    near = before.rstrip()[-1:] if before.rstrip() else " "
    return [
        float(n), lower / n, upper / n, digits / n, turns / max(1, n - 1), entropy, known.transitions(low), known.coverage(low),
        float(text.count("/")), float(text.count(".")), float(text.count("-")), float(max((len(p) for p in parts), default=0)),
        float(any(any(s in w for s in SECRET_WORDS) for w in words)), float(bool(words & set(OTHER_WORDS))),
        float(near in "=:"), float(before[-1:] in "\"'`" and after[:1] in "\"'`"), float(bool(re.search(r"://\S*$|[/\\@]$|www\.\S*$", before))),
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", text)) and digits > 0), float(bool(KEY_SHAPES.search(text))), float(bool(UUID.match(text))),
        len(counts) / n, float(bool(re.match(r"\.[a-z]{2,4}\b|@|\(", after))), float(digits + text.count("-") + text.count(".") == n),
        sum(c in SYMBOLS for c in text) / n, float(assigned(before)), float(bool(IN_URL_BEFORE.search(before)) and after[:1] == "@"),
        float(bool(EMBEDDED.search(before) or EMBEDDED_START.match(text))), float(bool(PLACEHOLDER.match(text))),
    ]


def made_findings(n: int = FINDINGS, seed: int = 11, known: Dictionary = DEFAULT) -> list[tuple[str, str, str, bool]]:
    """Made-up labelled findings, n of each kind: (before, candidate, after, secret). Half of the words in them are the dictionary's."""
    rnd = random.Random(seed)
    pick = lambda chars, k: "".join(rnd.choice(chars) for _ in range(k))
    lower, upper, digits, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    every = lower + upper + digits
    syllables, real = sorted(PAIRS), sorted(known.words)
    word = lambda: rnd.choice(real) if rnd.random() < 0.5 else "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 5)))
    name = lambda: rnd.choice(["", "db_", "DB_", "user_", "admin "]) + rnd.choice(["password", "PASSWORD", "passwd", "pwd", "secret", "token", "api_key", "passphrase"])
    sign = lambda: rnd.choice([" = ", "=", ": ", ":", " := "])
    running = lambda: " ".join(word() for _ in range(5)) + " "
    out = []
    for _ in range(n):
        kind = rnd.randrange(9)
        lead, tail = running(), " " + running()
        if kind == 0:
            text = rnd.choice(["AKIA", "ASIA"]) + pick(upper + digits, 16)
        elif kind == 1:
            quote = rnd.choice(['"', "'", ""])
            text = rnd.choice([lambda: pick(hexa, rnd.choice([16, 18, 20, 32, 40, 64])), lambda: pick(every, rnd.randint(14, 48)), lambda: pick(every + "+/", rnd.randint(20, 60))])()
            lead, tail = lead + rnd.choice(SECRET_WORDS) + sign() + quote, quote + tail
        elif kind == 2:
            text = rnd.choice([lambda: rnd.choice(["ghp_", "gho_", "sk-", "xoxb-"]) + pick(every, 36), lambda: "AIza" + pick(every, 35), lambda: "SK" + pick(hexa, 32), lambda: pick(digits, rnd.randint(8, 10)) + ":" + pick(every + "_-", 35)])()
        elif kind == 3:
            text = "eyJ" + pick(every, 30) + "." + pick(every, 40) + "." + pick(every + "_-", 40)
        elif kind == 4:
            text = pick(every + "+/", rnd.randint(32, 64))
            lead += rnd.choice(["Authorization: Bearer ", "private key ", "secret "])
        elif kind in (5, 6):
            # a person's password: a word with changed letters, digits and symbols, or any characters
            spelt = lambda: "".join(rnd.choice([c, c.upper(), {"a": "@", "e": "3", "i": "1", "o": "0", "s": "$"}.get(c, c)]) for c in word())
            text = rnd.choice([lambda: spelt() + rnd.choice("!@#$%^&*?-_.") + pick(digits, rnd.randint(1, 4)), lambda: pick(every, rnd.randint(8, 12)), lambda: pick(every + "!@#$%^&*?-_", rnd.randint(8, 20))])()
            text = text.ljust(ASSIGNED_LEAST, rnd.choice("!7x"))
            quote = rnd.choice(['"', "'", ""])
            lead, tail = lead + name() + sign() + quote, quote + tail
        elif kind == 7:
            text = rnd.choice([lambda: pick(every, rnd.randint(8, 24)), lambda: word() + pick(every + "!$%*", 7)])()
            lead, tail = lead + rnd.choice(["postgres", "mysql", "redis", "amqp", "https", "mongodb+srv"]) + "://" + word() + ":", "@" + word() + ".example/" + tail
        else:
            text = pick(hexa, rnd.choice([16, 18, 24, 32, 40]))
            lead += rnd.choice(["password=", "token=", "api_key=", 'secret="', 'token = "'])
        out.append((lead[-AROUND:], text, tail[:AROUND], True))
    for _ in range(n):
        kind = rnd.randrange(15)
        lead, tail = running(), rnd.choice([" ", ". ", ", "]) + running()
        if kind == 0:
            text = pick(digits, rnd.randint(12, 19))
        elif kind == 1:
            text = "/".join(word() for _ in range(rnd.randint(2, 5))) + f"/{pick(digits, rnd.randint(1, 6))}"
            lead += rnd.choice(["https://", "http://www.", "/", "see "])
        elif kind == 2:
            text = "-".join(word() for _ in range(rnd.randint(3, 6))) + rnd.choice(["", f"-{pick(digits, 4)}"])
        elif kind == 3:
            text = (pick(hexa, 8) + "-" + "-".join(pick(hexa, 4) for _ in range(3)) + "-" + pick(hexa, 12))
            lead += rnd.choice(["id ", "uuid: ", "guid="])
        elif kind == 4:
            text = pick(hexa, rnd.choice([32, 40, 64]))
            lead += rnd.choice(["commit ", "sha256: ", "md5 ", "checksum=", "digest "])
        elif kind == 5:
            text = "".join(word() for _ in range(5)).capitalize()[: rnd.randint(12, 30)].ljust(12, "e") + rnd.choice(["", pick(digits, 2)])
        elif kind == 6:
            text = word() + word() + "." + word() + rnd.choice([".com", ".org", pick(digits, 2)]) + "ing"
            tail = rnd.choice(["@mail.example.com ", ".html "]) + tail
        elif kind == 7:
            text = f"20{pick(digits, 2)}-{pick(digits, 2)}-{pick(digits, 2)}T{pick(digits, 6)}"
        elif kind == 8:
            text = "".join(w.capitalize() for w in (word() for _ in range(4))) + pick(digits, rnd.randint(0, 2))
            text = text.ljust(SHORTEST, "a")
        elif kind == 9:
            # images, fonts and hashes of files, written in letters
            text = pick(every + "+/", rnd.choice([43, 64, 86, 120, 400])) + rnd.choice(["", "=", "=="])
            lead += rnd.choice(["src=\"data:image/png;base64,", "url(data:font/woff2;base64,", "integrity=\"sha256-", "data:image/svg+xml;base64,"])
            if rnd.random() < 0.4:
                lead, text = lead[: -len(lead.split(" ")[-1])] + 'integrity="', rnd.choice(["sha256-", "sha384-", "sha512-"]) + text
            tail = '"' + tail
        elif kind == 10:
            text = rnd.choice([pick(upper, 2) + pick(digits, 10), pick(digits, 4) + "-" + pick(digits, 6) + "-" + pick(upper, 2), pick(upper, 3) + "-" + pick(digits, 8), pick(upper + digits, 14)])
            lead += rnd.choice(["order ", "invoice no. ", "order number: ", "serial ", "tracking ", "ticket ", "part ", "reference "])
        elif kind == 11:
            # names of objects in URLs
            folder = "/".join(word() for _ in range(rnd.randint(1, 3)))
            text = f"//{word()}.example.com/{folder}/" + rnd.choice([pick(hexa, 32), pick(every, rnd.randint(11, 28)), pick(hexa, 40)]) + rnd.choice(["", ".js", ".png", ".min.css", "/view"])
            lead += rnd.choice(["https:", "see http:", 'href="https:', 'src="https:'])
        elif kind == 12:
            # what stands for a secret, or where one is looked up
            text = rnd.choice([lambda: "${" + word().upper() + "_PASS1}", lambda: "<your-" + word() + "-here>", lambda: "get_" + word() + "(user)", lambda: "os.environ[" + word().upper(), lambda: "{{" + word() + ".value}}", lambda: "*" * rnd.randint(8, 12), lambda: "your_" + word() + "_here", lambda: "process.env.DB_" + word().upper(), lambda: "$" + word().upper() + "_TOKEN"])()
            text = text.ljust(ASSIGNED_LEAST, text[-1])
            lead += name() + sign() + rnd.choice(['"', "'", ""])
        elif kind == 13:
            # words after a name of a secret
            text = rnd.choice([word() + "-" + word() + "-" + word(), word() + "," + word(), word() + "_" + word() + "_" + word(), word() + ";" + word(), word().capitalize() + "/" + word()]).ljust(ASSIGNED_LEAST, "e")
            lead += name() + sign()
        else:
            text = word() + "_" + word() + "_" + word() + "_" + pick(digits, 3)
        out.append((lead[-AROUND:], text, tail[:AROUND], False))
    return out


class Forest:
    """Decision trees as flat arrays: a node's feature (-1 for a leaf), threshold, children and share of secrets."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]], known: Dictionary = DEFAULT):
        self.trees, self.known = trees, known

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[node]
                go = x[np.arange(len(x)), np.maximum(f, 0)] <= threshold[node]
                node = np.where(f < 0, node, np.where(go, left[node], right[node]))
            total += value[node]
        return total / len(self.trees)


def _grow(x: np.ndarray, y: np.ndarray, rnd: np.random.Generator) -> tuple[np.ndarray, ...]:
    nodes: list[list[float]] = []

    def split(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        share = float(y[rows].mean())
        nodes.append([-1, 0.0, at, at, share])
        if depth == DEPTH or len(rows) < 4 or share in (0.0, 1.0):
            return at
        best = (share * (1 - share) * len(rows) - 1e-9, -1, 0.0)
        for f in rnd.choice(x.shape[1], max(1, round(math.sqrt(x.shape[1]))), replace=False):
            values = x[rows, f]
            for cut in np.unique(np.quantile(values, [0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9], method="lower")):
                low = values <= cut
                n = int(low.sum())
                if 0 < n < len(rows):
                    a, b = y[rows[low]].mean(), y[rows[~low]].mean()
                    impurity = a * (1 - a) * n + b * (1 - b) * (len(rows) - n)
                    if impurity < best[0]:
                        best = (impurity, int(f), float(cut))
        if best[1] >= 0:
            low = x[rows, best[1]] <= best[2]
            left, right = split(rows[low], depth + 1), split(rows[~low], depth + 1)
            nodes[at] = [best[1], best[2], left, right, share]
        return at

    split(rnd.integers(0, len(x), len(x)), 0)
    flat = np.array(nodes)
    return flat[:, 0].astype(np.int64), flat[:, 1], flat[:, 2].astype(np.int64), flat[:, 3].astype(np.int64), flat[:, 4]


def train(findings: Sequence[tuple[str, str, str, bool]] | None = None, trees: int = TREES, seed: int = 5, known: Dictionary = DEFAULT) -> Forest:
    """A forest from labelled findings (a bounded list, given or made up) and the dictionary its features use."""
    findings = made_findings(known=known) if findings is None else findings
    x = np.array([features(*f[:3], known) for f in findings])
    y = np.array([float(f[3]) for f in findings])
    rnd = np.random.default_rng(seed)
    return Forest([_grow(x, y, rnd) for _ in range(trees)], known)


def telling(run: str) -> bool:
    """Whether a run has a digit, a mix of cases inside or a symbol: words and names have none."""
    inner = run[1:]
    return any(c.isdigit() or c in SYMBOLS for c in run) or (inner.lower() != inner and inner.upper() != inner)


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of what may be a secret, in order; what overlaps is one."""
    out = []
    for m in CANDIDATE.finditer(text):
        run = m.group().rstrip(".-")
        if len(run) >= SHORTEST and (telling(run) or KEY_SHAPES.search(run)):
            out.append((m.start(), m.start() + len(run)))
    end = 0
    for m in SIGN.finditer(text):
        # a sign inside a value that was taken is part of it
        if m.start() >= end and NAME_BEFORE.search(text[max(0, m.start() - AROUND) : m.start()]) and (value := VALUE.match(text, m.end())):
            run, end = value.group(), value.end()
            if m.group()[-1] not in "\"'`":
                # without quotes the sentence's own signs may follow
                run = run.rstrip(".,;:)]}>")
            if len(run) >= ASSIGNED_LEAST and telling(run):
                out.append((m.end(), m.end() + len(run)))
    out += [m.span(1) for m in IN_URL.finditer(text) if telling(m.group(1))]
    out += [m.span(1) for m in BOT.finditer(text) if not text[max(0, m.start() - 1) : m.start()].isalnum()]
    out.sort()
    merged: list[tuple[int, int]] = []
    for a, b in out:
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def findings_in(texts: Sequence[str | None], forest: Forest, least: float = LEAST_SCORE) -> list[list[tuple[int, int, float]]]:
    """For each text the (start, end, score) of candidates that the forest takes for secrets."""
    out: list[list[tuple[int, int, float]]] = [[] for _ in texts]
    at, x = [], []
    for i, text in enumerate(texts):
        for a, b in candidates(text) if text else ():
            at.append((i, a, b))
            x.append(features(text[max(0, a - AROUND) : a], text[a:b], text[b : b + AROUND], forest.known))
    if x:
        for (i, a, b), score in zip(at, forest.score(np.array(x)).tolist(), strict=True):
            if score >= least:
                out[i].append((a, b, score))
    return out


def scan(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length (characters), secret_sha256, score of each secret found."""
    rows = text_rows(docs, id_col, text_col)
    schema = schema_of(rows, ["doc_id"], "start bigint, length bigint, secret_sha256 string, score double")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, start, length, digest, scores = [], [], [], [], []
        for first in range(0, batch.num_rows, 256):
            texts = batch.column("text").slice(first, 256).to_pylist()
            for i, found in enumerate(findings_in(texts, forest)):
                for a, b, score in found:
                    at.append(first + i)
                    start.append(a)
                    length.append(b - a)
                    digest.append(hashlib.sha256(texts[i][a:b].encode()).hexdigest())
                    scores.append(score)
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(digest, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return map_arrow(rows, run, schema)


def redacted(docs: DataFrame, forest: Forest, text_col: str = "text", mark: str = MARK) -> DataFrame:
    """docs, all columns and rows, with each secret in the text replaced by a mark."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for first in range(0, batch.num_rows, 256):
            part = batch.column(text_col).slice(first, 256).to_pylist()
            for text, found in zip(part, findings_in(part, forest), strict=True):
                for a, b, _ in reversed(found):
                    text = text[:a] + mark + text[b:]
                texts.append(text)
        columns = [pa.array(texts, pa.string()) if name == text_col else column for name, column in zip(batch.schema.names, batch.columns, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return map_arrow(docs, run, docs.schema)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per secret found in a document."""
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(known=dictionary(docs)))

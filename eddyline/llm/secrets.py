"""Secret scans: candidates from patterns, false positives removed by a random forest.

Method. Candidates are runs of 16 or more key characters; the whole quoted or blank-delimited value, of LEAST or more
characters of any kind, after a word that names a secret and an equals sign or colon on the same line; and the password of
user:password@host. A random forest (bagged trees on random feature subsets)
scores each by its length, the changes of character class inside it, the share of it that
dictionary words cover, its path and the words on either side. The dictionary is the most frequent words of the corpus,
counted over all documents. The forest is fitted on labelled findings; as no table of such is at hand, the default
ones are composed here from a fixed seed (hexadecimal and base64 keys, provider tokens and passwords in
assignments, against digests, identifiers, paths, UUIDs, words, code and placeholders). Give your own to ``fit``.

Scale. A built-in pattern turns away texts without a candidate before any Python; words are counted with sums within tasks
first, and only DICTIONARY of them leave the executors. Findings are as many as the texts hold.

Bounds: a secret that nothing names is found from 16 key characters on; between naming word and separator are at most
NAME characters, and user:password is looked for in the USERINFO characters before an @.

Defined results: of findings one inside the other the outer one stays; null and empty texts have no findings; spans are code points, end exclusive; a null path is
empty; equal rows have equal findings, each its own; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from eddyline.llm import base
from eddyline.sources import scratch

DICTIONARY, NEAR = 5000, 48
#: Characters: the shortest named secret, the most after a naming word, the most of user:password.
LEAST, NAME, USERINFO = 6, 48, 256
#: Rows of a candidate batch that are scored together.
BATCH = 2000
_KEY = "[A-Za-z0-9+/_.~-]"
#: A run of key characters, with what pads it; names before an equals sign are none of it.
CANDIDATE = re.compile(rf"(?<!{_KEY}){_KEY}{{16,}}+={{0,2}}")
_NAMING = "pass|pwd|secret|token|key|auth|cred|bearer|kennwort|contrase"
#: A naming word, what follows it in its name, a separator, and the scheme of an authorization.
NAMED = re.compile(rf"(?ia)(?:{_NAMING})[^\s=:]{{0,{NAME}}}[ \t]{{0,8}}(?::=|=>|={{1,3}}|:)[ \t]*(?:(?:bearer|basic|token)[ \t]+)?(?:[rbfu]{{1,2}}(?=[\"']))?")
QUOTED = re.compile(r"""(\\?["'`])((?:(?!\1)(?:[^\\\r\n]|\\[^\r\n]))*)\1""")
#: Where a value without quotes ends before the next blank: at a further assignment or a closing tag.
_NEXT = re.compile(r"[;&,|?](?=[\w.-]{1,40}=)|</")
_SPACED = re.compile(r"\S+")
_HOSTED = re.compile(r"@(?=[A-Za-z0-9\[])")
#: At least what candidates() finds, for built-in patterns: runs, named values, passwords before a host.
_RUN = rf"(?<!{_KEY}){_KEY}{{16}}"
_VALUE = rf"(?i:{_NAMING})[^=:\r\n]{{0,{NAME + 8}}}[=:]"
_HOST = rf":[^\s/]{{{LEAST},{USERINFO}}}@"
_PASSWORD = ("pass", "pwd", "secret", "cred", "kennwort", "contrase")
_POSITIVE = ("token", "secret", "password", "passwd", "pwd", "apikey", "api", "key", "auth", "credential", "bearer", "access", "private")
_NEGATIVE = ("sha", "md5", "checksum", "digest", "commit", "hash", "uuid", "integrity", "example", "revision", "http", "etag", "version", "public", "fingerprint")
#: How keys of well-known providers begin.
PROVIDERS = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "npm_", "pypi-", "sk_live_", "sk_test_", "rk_live_", "sk-", "xoxb-", "xoxp-", "SG.", "eyJ")
_PLACEHOLDERS = ("your", "example", "change", "replace", "insert", "placeholder", "redacted", "xxxx", "****", "dummy", "sample", "todo")
_PATHS = ("test", "example", "sample", "vendor", "node_modules", "lock", "min.js", "fixture", "doc")
_CLASSES = np.zeros(128, np.int8)
_CLASSES[ord("a") : ord("z") + 1] = 1
_CLASSES[ord("A") : ord("Z") + 1] = 2
_CLASSES[ord("0") : ord("9") + 1] = 3


def _runs(text: str) -> Iterator[tuple[int, str]]:
    for m in CANDIDATE.finditer(text):
        bare = m[0].lstrip(".-_~")
        value = bare.rstrip("." if len(bare) == len(m[0]) else ".=-_~")
        if len(value) >= 16:
            yield m.start() + len(m[0]) - len(bare), value


def _trimmed(value: str) -> str:
    """Without the punctuation that ends a sentence, and brackets and quotes that were opened before the value."""
    end = len(value)
    unopened = {b: value.count(b) - value.count(a) for a, b in ("()", "[]", "{}", "<>")}
    while end and (value[end - 1] in ".,;:\"'`" or unopened.get(value[end - 1], 0) > 0):
        end -= 1
        if value[end] in unopened:
            unopened[value[end]] -= 1
    return value[:end]


def _named(text: str) -> Iterator[tuple[int, str]]:
    m, blank = NAMED.search(text), 0
    while m:
        at = m.end()
        further = NAMED.match(text, at)
        if further:  # a name whose value is a name with a value
            m = further
            continue
        to = at
        if quoted := QUOTED.match(text, at):
            value, start = quoted[2], quoted.start(2)
            if not any(c.isspace() for c in value):  # else there may be assignments inside
                to = quoted.end()
        elif at < blank or (spaced := _SPACED.match(text, at)):
            blank = blank if at < blank else spaced.end()  # a run without blanks is looked through once
            end = _NEXT.search(text, at, blank)
            start, to = at, end.start() if end else blank
            value = _trimmed(text[at:to])
        else:
            value, start = "", at
        if len(value) >= LEAST:
            yield start, value
        m = NAMED.search(text, to)


def _hosted(text: str) -> Iterator[tuple[int, str]]:
    for m in _HOSTED.finditer(text):
        run = re.split(r"[\s/\"'`<>]", text[max(0, m.start() - USERINFO) : m.start()])[-1]
        user, _, value = run.partition(":")
        if user and len(value) >= LEAST:
            yield m.start() - len(value), value


def candidates(text: str) -> Iterator[tuple[int, str]]:
    """(start, candidate) in a text by start, without the punctuation of the sentence around it; some lie in others."""
    last = None
    for found in heapq.merge(_runs(text), _named(text), _hosted(text)):
        if found != last:
            yield found
        last = found


def _covered(value: str, words: frozenset[str]) -> float:
    """The share of characters inside dictionary words of four letters or more, longest first from the left."""
    low, at, n = value.lower(), 0, 0
    while at < len(low):
        size = next((k for k in range(min(14, len(low) - at), 3, -1) if low[at : at + k] in words), 0)
        n += size
        at += size or 1
    return n / len(low)


def features(value: str, before: str, after: str, path: str, words: frozenset[str]) -> list[float]:
    """Numbers of one candidate; long candidates are measured whole."""
    codes = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _CLASSES[np.minimum(codes, 127)]
    n = len(codes)
    share = np.bincount(kind, minlength=4) / n
    p = np.unique(codes, return_counts=True)[1] / n
    pairs = np.bincount(kind[:-1].astype(int) * 4 + kind[1:], minlength=16) / max(1, n - 1)
    near, low_path = before.lower()[-NEAR:], (path or "").lower()
    last = re.findall(r"[a-z0-9_]+", near)[-2:]
    return [
        math.log2(n),
        *share.tolist(),
        float(-(p * np.log2(p)).sum()),
        float((kind[1:] != kind[:-1]).mean()) if n > 1 else 0.0,
        *(pairs[k] for k in (5, 6, 7, 9, 11, 13, 14, 15)),
        float(bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value))),
        float(n in (32, 40, 64)),
        float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", value))),
        float(value.startswith(PROVIDERS)),
        float(max(Counter(value).values()) / n),
        value.count("/") / n,
        (value.count("_") + value.count("-") + value.count(".")) / n,
        _covered(value, words),
        float(bool(re.search(r"[=:]\s*[\"'`]?$", before))),
        float(before[-1:] in "\"'`" and after[:1] in "\"'`" and before[-1:] != ""),
        float(any(k in w for w in last for k in _POSITIVE)),
        float(any(k in near for k in _POSITIVE)),
        float(any(k in near for k in _NEGATIVE)),
        float(any(k in low_path for k in _PATHS)),
        float(any(k in w for w in last for k in _PASSWORD)),
        float(after[:1] == "@" and before[-1:] == ":"),
        float("://" in before[-NEAR:]),
        sum(value.count(c) for c in "()[]{}<>") / n,
        float(value[0] in "$%<{[(*@&"),
        sum(c.isspace() for c in value) / n,
        float(any(k in value.lower() for k in _PLACEHOLDERS)),
    ]


@dataclass
class Forest:
    """Trees as arrays: feature (-1 in leaves), threshold, left child (right is the next), share of label 1."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    words: frozenset[str]

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, value in self.trees:
            node = np.zeros(len(x), np.int64)
            while (inner := feature[node] >= 0).any():
                at = np.flatnonzero(inner)
                k = node[at]
                node[at] = left[k] + (x[at, feature[k]] > threshold[k])
            total += value[node]
        return total / max(1, len(self.trees))


def _tree(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int) -> tuple[np.ndarray, ...]:
    nodes: list[list[float]] = [[-1, 0.0, 0, 0.0]]
    todo = [(0, np.arange(len(y)), 0)]
    tries = max(1, round(math.sqrt(x.shape[1])))
    while todo:
        at, rows, level = todo.pop()
        nodes[at][3] = (y[rows].sum() + 0.5) / (len(rows) + 1)
        if level == depth or len(rows) < 2 * least or y[rows].min() == y[rows].max():
            continue
        best = (1e-9, -1, 0.0)
        here = y[rows].mean() * (1 - y[rows].mean())
        for f in rng.permutation(x.shape[1])[: tries * 2]:
            order = np.argsort(x[rows, f], kind="stable")
            v, ones = x[rows, f][order], np.cumsum(y[rows][order])
            n = np.arange(1, len(v))
            a, b = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(v) - n)
            gain = here - (n * a * (1 - a) + (len(v) - n) * b * (1 - b)) / len(v)
            gain[(v[1:] <= v[:-1]) | (n < least) | (len(v) - n < least)] = -1
            if len(gain) and gain.max() > best[0]:
                k = int(gain.argmax())
                best = (float(gain[k]), int(f), float((v[k] + v[k + 1]) / 2))
        if best[1] < 0:
            continue
        nodes[at][0], nodes[at][1], nodes[at][2] = best[1], best[2], len(nodes)
        side = x[rows, best[1]] > best[2]
        for part in (rows[~side], rows[side]):
            todo.append((len(nodes), part, level + 1))
            nodes.append([-1, 0.0, 0, 0.0])
    f, t, c, v = zip(*nodes, strict=True)
    return np.array(f, np.int64), np.array(t), np.array(c, np.int64), np.array(v)


def fit(findings: list[tuple[str, str, str, str, int]], words: frozenset[str], trees: int = 40, depth: int = 9, seed: int = 3) -> Forest:
    """findings: (candidate, text before, text after, path, 1 if a secret); some thousands at most, as they are fitted here."""
    x = np.array([features(*f[:4], words) for f in findings])
    y = np.array([f[4] for f in findings], float)
    rng = np.random.default_rng(seed)
    grown = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        grown.append(_tree(x[rows], y[rows], rng, depth, 2))
    return Forest(grown, words)


def composed_findings(words: list[str], n: int = 5000, seed: int = 9) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings of common shapes. words: some of the corpus' words, for benign candidates and surroundings."""
    r = random.Random(seed)
    words = sorted(w for w in words if w.isascii()) or ["the", "and", "with", "from", "that", "value"]
    hexa, base64, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda letters, k: "".join(r.choices(letters, k=k))
    prose = lambda k: " ".join(r.choices(words, k=k))

    signs = "!@#$%^&*-_+=?."
    word = lambda: r.choice((lambda: r.choice(words), lambda: "".join(draw("bcdfghklmnprstvwz", 1) + draw("aeiou", 1) for _ in range(r.randint(2, 4)))))()
    cased = lambda: r.choice((str, str.capitalize, str.upper))(word())

    def password() -> tuple[str, str, str, int]:
        leet = str.maketrans("aeios", "43105")
        make = r.choice((
            lambda: draw(alnum + signs * 2, r.randint(6, 20)),
            lambda: draw(alnum + signs * 2, r.randint(8, 15)),
            lambda: draw(alnum, r.randint(8, 15)),
            lambda: draw(alnum.lower(), r.randint(7, 15)),
            lambda: draw(hexa, r.randint(8, 15)),
            lambda: cased() + draw("0123456789", r.randint(1, 4)) + draw(signs, r.randint(0, 2)),
            lambda: cased() + draw(signs, 1) + draw("0123456789", r.randint(2, 4)),
            lambda: cased() + draw(signs, 1) + cased() + draw("0123456789", r.randint(1, 3)),
            lambda: (cased() + cased()).translate(leet) + draw("0123456789" + signs, r.randint(1, 3)),
            lambda: draw(alnum, r.randint(3, 8)) + draw(signs, 1) + draw(alnum, r.randint(3, 8)) + draw(signs, 1) + draw(alnum, r.randint(0, 8)),
            lambda: draw("0123456789", r.randint(6, 12)),
            lambda: draw("äöüßéñçλж", 1) + cased() + draw(alnum + signs, r.randint(3, 8)),
        ))
        fine = lambda v: len(v) >= LEAST and v[0] not in "$%&*@" and v[-1] not in ".," and (len(set(v)) > 3) and not re.fullmatch(r"[A-Z]?[a-z]+|[A-Z]+", v)
        value = next(v for v in iter(make, None) if fine(v))
        if r.random() < 0.25:  # user:password@host
            value = value.replace("@", "x").replace("/", "x")
            return value, f"{prose(4)} {r.choice(('postgres://', 'mysql://', 'https://', 'ftp://', 'mongodb+srv://', 'redis://', 'amqp://', '', ''))}{r.choice(('admin', 'root', 'user', 'app', word()))}:", f"@{r.choice(('db', 'host', 'localhost', word()))}{r.choice(('.example.com', ':5432/main', '', '/x'))} {prose(4)}", 1
        name = r.choice(("password", "password", "passwd", "pwd", "PWD", "secret", "Password", "DB_PASSWORD", "db.password", "user_pass", "passphrase", "client_secret", "kennwort", "credential"))
        if not value.isdigit():
            name = r.choice((name, name, name, "token", "api_key", "auth_token", "secret_key", "authkey"))
        before, after = r.choice(((f'{name} = "', '"'), (f"{name}='", "'"), (f"{name}: ", ""), (f'"{name}": "', '",'), (f"export {name}=", ""), (f"{name}=", ""), (f"--{name}=", ""), (f"{name} = ", ""), (f"{name}:", ""), (f"{name}=", ".")))
        return value, f"{prose(5)} {before}", f"{after} {prose(4)}", 1

    def short() -> tuple[str, str, str, int]:
        """Benign short values after names."""
        name = r.choice(("password", "passwd", "pwd", "secret", "token", "api_key", "key", "Key", "auth", "author", "DB_PASSWORD", "client_secret", "primary_key", "keyword", "tokens", "max_tokens", "passage", "compass", "passenger", "monkey", "authority", "credentials", "secretary"))
        joined = lambda sep, k: sep.join(r.choices(words, k=k))
        dotted = lambda: joined(r.choice((".", "_")), r.randint(2, 3))
        make = r.choice((
            word, word, word, cased, cased, lambda: word() + word(), lambda: r.choice((word(), word().capitalize())) + word().capitalize(),
            lambda: word() + r.choice(("-", "/", "_", "'")) + word(),
            dotted,
            lambda: f"{dotted()}({r.choice(('', word(), chr(34) + word() + chr(34)))})",
            lambda: f"{word()}[{r.choice(('0', word(), chr(39) + word() + chr(39)))}]",
            lambda: r.choice(("${%s}", "$%s", "{{%s}}", "%%%s%%", "<%s>", "[%s]", "$(%s)", "{%s}", "@%s")) % r.choice((word(), name, f"your_{name}", f"{name.upper()}_1", joined("_", 2))),
            lambda: r.choice("*xX.#•-_") * r.randint(6, 15),
            lambda: r.choice(("string", "String", "str,", "boolean", "undefined", "required", "Optional[str]", "bytes", "varchar(255)", "disabled", "enabled", "nullable", "[REDACTED]", "<redacted>", "changeme", "change-me", "your_password", "your-token", "password", "example", "placeholder", "required|min:8", "&str", "process.env.TOKEN", 'os.environ["TOKEN"]', "os.getenv('PASSWORD')", "request.form['pwd']", "self.token", "getpass.getpass()", "/run/secrets/token", "https://example.com/login", "function(a,b)", "(optional)", "12:30:00", "2024-01-31", "insert_here", "dummy-value", "sample_key")),
            lambda: joined(" ", r.randint(2, 8)),
        ))
        value = next(v for v in iter(make, None) if len(v) >= LEAST)
        if r.random() < 0.12 and name not in ("password", "passwd", "pwd", "secret", "DB_PASSWORD", "client_secret", "credentials"):
            value = draw("123456789", 1) + draw("0123456789", r.randint(5, 9))  # a number that is no password
        if r.random() < 0.15:  # no user:password@host
            return word().ljust(LEAST, "a"), f"{prose(4)} {r.choice(('mailto', 'email', 'contact', 'mail', 'from', 'cc'))}:", f"@{word()}.example.com {prose(4)}", 0
        styles = ((f'{name} = "', '"'), (f'"{name}": "', '",'), (f"{name}='", "'"))
        if " " not in value:
            styles += ((f"{name}: ", ""), (f"{name}: ", "."), (f"{name}: ", ","), (f"{name}=", ""), (f"{name} = ", ""), (f"{name}:", ""))
        before, after = r.choice(styles)
        return value, f"{prose(5)} {before}", f"{after} {prose(4)}", 0

    def secret() -> tuple[str, str, str, int]:
        key = lambda: r.choice((
            lambda: r.choice(("AKIA", "ASIA")) + draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16),
            lambda: r.choice(PROVIDERS) + draw(alnum, r.randint(20, 40)),
            lambda: "eyJ" + draw(alnum, 30) + "." + draw(alnum + "-_", 60) + "." + draw(alnum + "-_", 43),
        ))()
        if r.random() < 0.4:
            return password()
        if r.random() < 0.15:  # a provider's key tells by itself
            return key(), f"{prose(5)} {r.choice(('', '', '(', '\"'))}", f"{r.choice((' ', '. ', ', ', ')'))}{prose(4)}", 1
        value = r.choice((
            lambda: draw(hexa, r.choice((32, 40, 64, 48))),
            lambda: draw(hexa, r.randint(16, 24)),
            lambda: draw(hexa.upper(), r.choice((32, 40))),
            lambda: draw(base64, r.randint(20, 88)) + r.choice(("", "=", "==")),
            lambda: draw(alnum, r.randint(18, 64)),
            key,
            key,
        ))()
        name = r.choice(("token", "secret", "password", "api_key", "apikey", "auth_token", "access_key", "client_secret", "API_KEY", "SECRET_KEY", "passwd", "bearer", "private_key"))
        before, after = r.choice(((f'{name} = "', '"'), (f"{name}='", "'"), (f"{name}: ", ""), (f'"{name}": "', '",'), (f"export {name}=", ""), (f"Authorization: {name} ", ""), (f"{name} is ", " "), ('x = "', '"')))
        return value, f"{prose(5)} {before}", f"{after} {prose(4)}", 1

    def benign() -> tuple[str, str, str, int]:
        if r.random() < 0.4:
            return short()
        joined = lambda sep, k: sep.join(r.choices(words, k=k))
        long = lambda f: next((v for _ in range(20) if len(v := f()) >= 16), "a" * 16 + joined("_", 3))
        value, befores = r.choice((
            (lambda: draw(hexa, 40), ("commit ", "revision ", "at commit ", "git checkout ")),
            (lambda: draw(hexa, r.choice((32, 64))), ("sha256: ", "md5 ", "checksum = ", "digest=", "hash: ", 'etag: "')),
            (lambda: "-".join(draw(hexa, k) for k in (8, 4, 4, 4, 12)), ("id: ", "uuid=", "", "request ")),
            (lambda: long(lambda: joined("", r.randint(3, 8))), ("", " ", "(")),
            (lambda: long(lambda: joined("_", r.randint(2, 6))), ("", "call ", "def ", 'key = "', "token_name = ", "password_field: ")),
            (lambda: long(lambda: joined("-", r.randint(2, 6))), ("", 'class="', "see ")),
            (lambda: long(lambda: "".join(w.capitalize() for w in r.choices(words, k=r.randint(3, 6)))), ("", "new ", "class ", "import ")),
            (lambda: long(lambda: joined("/", r.randint(3, 8))), ("", "/", "path = ", "see ", "http:/")),
            (lambda: long(lambda: joined(".", r.randint(3, 6))), ("", "import ", "host ", "www.")),
            (lambda: r.choice("=-_.~*x0aX1").replace("*", "-") * r.randint(16, 80), ("", 'password = "', "api_key=", " ")),
            (lambda: r.choice(("your-api-key-goes-here", "INSERT_YOUR_TOKEN_HERE", "changeme-changeme", "xxxxxxxxxxxxxxxxxxxx", "example-secret-value", "test-token-test-token", "REPLACE_WITH_PASSWORD")), ('token = "', "api_key: ", "password=", 'secret = "')),
            (lambda: draw("0123456789", r.randint(16, 24)), ("", "order ", "no. ", " ")),
            (lambda: draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", r.randint(16, 24)), ("", "part ", "serial ", "sku ", "isin ")),
            (lambda: long(lambda: word() + draw("0123456789", r.randint(0, 2)) + "." + joined(".", r.randint(1, 3)) + r.choice((".com", ".org", ".net", ".de"))), (f"{word()}@", f"{word()}.{draw('0123456789', 2)}@", f"{word()}:{word()}1!@", "://", "mailto:x@", "host=")),
            (lambda: long(lambda: word() + draw("0123456789", r.randint(0, 2)) + "." + joined(".", r.randint(1, 3)) + r.choice((".com", ".org", ".net", ".de"))), (f"{word()}@", f"{word()}.{draw('0123456789', 2)}@", f"{word()}:{word()}1!@", "://", "mailto:x@", "host=")),
            (lambda: draw(base64, r.randint(60, 200)), ("integrity=sha512-", "data:image/png;base64,", "sha384-", "ssh-rsa ")),
        ))
        return value(), f"{prose(5)} {r.choice(befores)}", r.choice(("", " ", '" ', ". ", ")")) + prose(4), 0

    paths = ("src/app.py", "config/prod.env", "main.go", "", "", "web/index.js", "docs/readme.md", "tests/test_auth.py", "package-lock.json", "settings.yaml")
    out = []
    while len(out) < n:
        v, b, a, y = secret() if len(out) % 2 else benign()
        path = r.choice(paths if not y else paths[:6] + paths[-1:])
        # as a scan sees it
        over = [(i, c) for i, c in candidates(b + v + a) if i < len(b) + len(v) and i + len(c) > len(b)]
        at = (len(b), v) if (len(b), v) in over else next(iter(over), None)
        if at:
            i, c = at
            text = b + v + a
            out.append((c, text[:i], text[i + len(c) :], path, y))
    return out


def may_hold(text: Column) -> Column:
    """Whether a text may have candidates. Plain searches turn most texts away before the slower pattern."""
    low = F.lower(text)
    named = F.lit(False)
    for word in _NAMING.split("|"):
        named = named | low.contains(word)
    return text.rlike(_RUN) | (text.contains("@") & text.rlike(_HOST)) | (named & text.rlike(_VALUE))


def dictionary(docs: DataFrame, text: str = "text", size: int = DICTIONARY) -> list[str]:
    """The size most frequent words of four letters or more, over all documents."""
    words = docs.select(F.explode(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}]+")).alias("w"))
    counted = words.filter(F.char_length("w").between(4, 14)).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    with scratch.Scope(docs.sparkSession):
        top = base.most_frequent(base.written(counted, "secret-words"), "n", size, "w")
        return sorted(r[0] for r in base.written(top.select("w"), "secret-dictionary").collect())  # size of them


def scan(docs: DataFrame, forest: Forest, least: float = 0.5, ident: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """One row per finding: the id, start, end, secret (the text), score. path: the column that names
    where a text is from, if there is one."""
    spark = docs.sparkSession
    base.ship(spark)
    held = spark.sparkContext.broadcast(forest)
    kind = docs.schema[ident].dataType
    rows = docs.select(F.col(ident).alias("id"), F.col(text).alias("text"), (F.col(path).cast("string") if path else F.lit("")).alias("path")).filter(may_hold(F.col("text")))
    schema = pa.schema([("id", to_arrow_type(kind)), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.string()), ("score", pa.float64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = held.value
        found: list[tuple] = []
        numbers: list[list[float]] = []

        def scored() -> pa.RecordBatch:
            score = forest.scores(np.array(numbers)) if numbers else np.zeros(0)
            kept, reach = [], (-1, 0)
            for (row, *f), s in sorted(((f, float(s)) for f, s in zip(found, score, strict=True) if s >= least), key=lambda k: (k[0][0], k[0][2], -k[0][3])):
                if (row, f[2]) > reach:
                    kept.append((*f, s))
                    reach = (row, f[2])
            found.clear()
            numbers.clear()
            return pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], schema.field(i).type) for i in range(5)], schema=schema)

        row = 0
        for whole in batches:
            for k in range(whole.num_rows):
                ident, body, where = (whole.column(c)[k].as_py() for c in range(3))
                row, end = row + 1, 0
                for a, value in candidates(body):
                    if len(found) >= BATCH and a >= end:  # not between candidates that overlap
                        yield scored()
                    b = a + len(value)
                    end = max(end, b)
                    found.append((row, ident, a, b, value))
                    numbers.append(features(value, body[max(0, a - NEAR) : a], body[b : b + NEAR], where or "", forest.words))
        yield scored()

    return rows.mapInArrow(find, f"id {kind.simpleString()}, start long, end long, secret string, score double").withColumnRenamed("id", ident)


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    docs = base.read(spark, sf_dir, "documents")
    words = dictionary(docs)
    return scan(docs, fit(composed_findings(words[:: max(1, len(words) // 400)]), frozenset(words)))

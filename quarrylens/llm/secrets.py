"""Credentials in source code, found by a linear-chain conditional random field over lexical tokens.

Every string literal of any length (triple-quoted ones too), values of assignments and options in plain text, values beside a
keyword in a remark, tokens of a known format and frames of keys are cut into lexical tokens: letter-digit runs and single marks;
a key frame is one token. Each token has shape features (characters, case, length, what kind of value it belongs to) and context
features (the name the value is given to, the call it is passed to, the scheme word before it, its part of a URL or
connection string). The field scores the labels outside, begin and inside together with their transitions; the best label path
(Viterbi) gives the spans, so the field alone decides which characters are a secret and are redacted.

The model is trained here, by maximum likelihood on ``TRAINING_LINES`` generated lines (no table is read), once a
process, and is a few hundred kilobytes of weights whatever the input. Detection is a narrow map: no shuffle, nothing
collected, every whole text is read. Scores of tokens that look alike in alike places are remembered per worker; forgetting them
changes no result.

Edge cases: null and empty code has no secrets; equal secrets in one record are reported once but redacted wherever
they stand; a value in a repeated row is reported for each row; code that ends inside a literal is scanned to its end;
carriage returns and multi-byte characters are untouched; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import itertools
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
TRAINING_LINES = 5000
REPLACEMENT = "REDACTED"

# Words that name a secret value; compared with the parts of a name.
SECRET_WORDS = frozenset(
    "password passwd passwort pass pwd pw passphrase secret token apikey credential credentials kennwort contrasena "
    "contraseña passe auth authorization authtoken accesstoken bearer signing hmac 비밀번호 암호 clave geheim".split()
)
# Words that name something else, even beside a secret word.
OTHER_WORDS = frozenset(
    "digest sha sha1 sha256 sha512 md5 hash checksum etag integrity commit revision uuid guid id pub public fingerprint "
    "icon logo image pixel png hint label message bucket csrf expected build version data payload blob bytes buffer font wasm body content sample".split()
)
PLACEHOLDERS = frozenset(
    "changeme change_me replace_me replaceme todo example dummy placeholder none null secret password redacted token "
    "test default required unset your-secret-here dummy-token not-a-real-key".split()
)
# Openings of well-known token formats.
PREFIXES = (
    "AKIA", "ASIA", "AIza", "sk-", "sk_live_", "rk_live_", "pk_live_", "sk_test_", "gho_", "ghp_", "ghs_", "ghu_",
    "github_pat_", "glpat-", "glx-", "xoxb-", "xoxp-", "xoxa-", "npm_", "pypi-", "dop_v1_", "eyJ", "key-", "pat-", "SG.",
)

_FRAME = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----(?s:.+?)-----END \1-----")
_LITERAL = re.compile(
    r"""(?<!\w)[bBrRfFuU]{0,2}(?:\"""((?s:.+?))\"""|\'\'\'((?s:.+?))\'\'\'|"((?:[^"\\\n]|\\.)+)"|'((?:[^'\\\n]|\\.)+)'|`((?:[^`\\\n]|\\.)+)`)"""
)
_PLAIN = re.compile(
    r"""(?<![\w.-])([A-Za-z_][\w.-]*|[가-힣]+)\s*[:=][ \t]*(?![A-Za-z_][\w.-]*[:=]\S)((?:(?:[Bb]earer|[Bb]asic|[Tt]oken)[ \t]+)?[^\s"'`,;(){}\[\]<>]{3,})(?![\w(\[])"""
)
_OPTION = re.compile(
    r"""(?<![\w-])(?:--([\w-]*(?:pass|pw|user|token|secret|key|auth)[\w-]*)[ =]+([^\s"'`;|&<>]{3,})|(-[pua])[ ]+([^\s"'`;|&<>-][^\s"'`;|&<>]{2,})|(-p)([^\s"'`;|&<>-][^\s"'`;|&<>]{2,}))"""
)
_REMARK = re.compile(r"\b(?:pass(?:word|wd|wort|phrase)?|pw|pwd|secret|token|key|login|creds?|kennwort|contraseña|비밀번호)\b(?=[^\w\n]*[ =:])", re.IGNORECASE)
_REMARK_VALUE = re.compile(r"""[^\s"'`,;(){}\[\]<>=:/]{3,}[^\s"'`,;(){}\[\]<>]*(?![\w(\[])""")
REMARK_WORDS = 4  # words behind a keyword of a remark that the field is asked about
_REMARK_MARK = re.compile(r"#|//|--|/\*")
_KNOWN = re.compile(r"(?<![\w-])(?:AKIA|ASIA)[A-Z0-9]{12,}\b|(?<![\w-])(?:gh[oprsu]_|github_pat_|glpat-|xox[abp]-|[sr]k_live_|npm_|dop_v1_|SG\.)[\w.-]{12,}|(?<![\w-])(?:AIza|eyJ)[\w.-]{24,}")
_KNOWN_HINTS = ("AKIA", "ASIA", "gho_", "ghp_", "ghr_", "ghs_", "ghu_", "github_pat_", "glpat-", "xoxa-", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "npm_", "dop_v1_", "SG.", "AIza", "eyJ")
_URL_LOGIN = re.compile(r"""\b[a-z][a-z0-9+.-]*://[^\s:/@"'`]*:[^\s"'`]+?@[\w.-]+""")
_NAME_WORD = re.compile(r"(?i)pass|pwd|secret|token|api_?key|auth|kennwort|contrase|cred|hmac|sign|비밀|암호|clave|_pw\b|_key\b|deploykey")
_NAME_HINTS = ("pass", "pwd", "pw", "secret", "token", "key", "auth", "login", "kennwort", "contrase", "cred", "hmac", "sign", "비밀", "암호", "clave", "bearer")
_SNAKE = re.compile(r"(?:[a-z]+[./])*(?:[a-z]+(?:_[a-z]+)*(?:_?\d{1,4})?|[a-z]+(?:[A-Z][a-z]+)*\d{0,3})(?:\(\))?")
_TOKENS = re.compile(r"-----BEGIN [A-Z0-9 ]+-----(?s:.+?)-----END [A-Z0-9 ]+-----|[A-Za-z0-9]+|\w+|\s+|.", re.DOTALL)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+|[가-힣]+|[^\W\d_a-zA-Z]+")
_TARGET = re.compile(
    r"""([\w.$-]+)["']?\s*\]?\s*(?::\s*[\w\[\], .]+?)?\s*(?::=|\+=|=>|[:=(])\s*(?:[bBrRfFuU]{0,2})["'`]?$"""
)
_ENVIRONMENT = re.compile(r"""(?:getenv|environ(?:\.get)?|[eE]nv(?:Or)?|process\.env|ENV)\W{1,3}["']?([A-Za-z_]\w*)["']?\]?\s*(?:,|\|\||\?\?|or)\s*["'`]?$""")
_ENVIRONMENT_NAME = re.compile(r"""(?i)(?:getenv|environ(?:\.get)?|process\.env|env(?:or)?|read_secret|get_secret|vault\.\w+)\s*[\[(]\s*["'`]?$""")
_LITERAL_PREFIX = re.compile(r"(?<!\w)[bBrRfFuU]{1,2}$")
_CALL = re.compile(r"""([\w.]+)\s*\([^()]*?(?:,\s*)?[bBrRfFuU]{0,2}["'`]?$""")
_HEX = re.compile(r"[0-9a-fA-F]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


def name_class(name: str) -> str:
    parts = [p.lower() for p in _NAME_PARTS.findall(name)]
    joined = set(parts) | {a + b for a, b in zip(parts, parts[1:])}
    if joined & OTHER_WORDS:
        return "other"
    if joined & SECRET_WORDS:
        return "secret"
    if "key" in parts and len(parts) > 1 and joined & {"api", "access", "private", "signing", "hmac", "deploy", "secret", "encryption", "service", "x"}:
        return "secret"
    return "key" if parts[-1:] == ["key"] else "plain"


def value_class(value: str) -> str:
    """What a value looks like, regardless of its name."""
    low = value.lower()
    if value.startswith("-----BEGIN"):
        return "frame-private" if "PRIVATE" in value[:60] else "frame-public"
    if low.strip("<>{}[]$%* ") in PLACEHOLDERS or re.fullmatch(r"(?i)(.)\1{3,}|[x*.#_-]{4,}", value):
        return "placeholder"
    if re.search(r"(?i)x{8,}|\*{4,}|\.{6,}|^<.*>$|^\$\{|^\{\{|^\$\(|^%\(|your[-_ ]|replace[-_ ]?me|change[-_ ]?me|[-_ ]here$|not[-_]a[-_]real|insert ", value):
        return "placeholder"
    if _UUID.fullmatch(value):
        return "uuid"
    if value.startswith("data:") or re.match(r"sha\d+-", value) or value.count("\\x") >= 4 or len(value) >= 120 and re.fullmatch(r"[\w+/=-]+", value):
        return "data"
    if " " in value.strip():
        return "command" if re.search(r"\s--?\w", value) else "phrase"
    if re.match(r"(?:process|os|import\.meta|System)\.|.*\benv(?:iron)?\b[.\[(]", value):
        return "reference"
    if not value.isascii() and not re.search(r"\d", value):
        return "foreign"
    if re.fullmatch(r"[A-Z][a-z]+[.:]?", value):
        return "name"
    if value.startswith(PREFIXES) and len(value) >= 16 and len(set(value[6:])) > 5:
        return "known"
    if _HEX.fullmatch(value) and len(value) >= 16 and re.search(r"\d", value) and re.search(r"[a-fA-F]", value):
        return f"hex{min(64, len(value) // 8 * 8)}"
    if re.fullmatch(r"[\d.,:_-]+", value):
        return "number"
    if re.fullmatch(r"\.{0,2}/?(?:[\w.-]+/)+[\w.-]*|[\w-]+\.(?:py|js|ts|go|json|png|html|txt|md|ya?ml)", value) and not re.search(r"[A-Z]\d|\d[A-Z]|[a-z][A-Z]{2}", value):
        return "path"
    if re.fullmatch(r"[a-z]{3,}(?:-[a-z]{3,}){1,4}-?\d{1,4}", value):
        return "wordchain"
    if re.fullmatch(r"[a-z]+(?:[-_][a-z]+)+", value):
        return "identifier"
    if re.fullmatch(r"[A-Za-z][a-z]{3,}[_.-]?\d{2,6}", value):
        return "wordnumber"
    if _SNAKE.fullmatch(value) and not re.fullmatch(r"[a-z]{3,5}\d{2}[A-Z]+\w?", value):
        return "identifier"
    if re.fullmatch(r"[A-Za-z]{3,}[!#$%&*~._@^+-]\d{2,6}", value):
        return "wordmark"
    if re.fullmatch(r"[A-Z][A-Z0-9_]*", value) and not re.search(r"\d.*[A-Z].*\d", value):
        return "constant"
    n = len(value)
    counts = Counter(value)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    mixed = bool(re.search(r"[a-z]", value)) + bool(re.search(r"[A-Z]", value)) + bool(re.search(r"\d", value))
    if mixed >= 2 and n >= 8 and entropy >= 2.7:
        return "random-long" if n >= 20 else "random"
    if n >= 6 and re.search(r"\d", value) and re.search(r"[A-Za-z]", value):
        return "mixed"
    return "words" if n >= 5 else "short"


def parts_of_value(value: str, name: str) -> list[tuple[int, int, str, str]]:
    """(start, end, name, place) of the pieces of a literal that can be a value of their own."""
    if value.startswith("-----BEGIN"):
        return [(0, len(value), name, "frame")]
    login = re.search(r"://([^\s:/@]*):([^\s]+?)@(?=[\w.-]+)", value)
    if login:
        return [(login.start(2), login.end(2), "login", "login")]
    query = [(m.start(2), m.end(2), m.group(1), "query") for m in re.finditer(r"[?&]([\w.-]+)=([^&\s#]+)", value)]
    if "://" in value:
        return query
    pairs = [(m.start(2), m.end(2), m.group(1), "pair") for m in re.finditer(r"(?:^|;)\s*([\w ]+?)\s*=\s*([^;]+)", value)]
    if len(pairs) > 1:
        return pairs
    scheme = re.match(r"(?i)(?:authorization:\s*)?(bearer|basic|token|apikey)\s+(\S+)$", value)
    if scheme:
        return [(scheme.start(2), scheme.end(2), name, "scheme-" + scheme.group(1).lower())]
    header = re.match(r"([\w-]+):\s*(?:(?:bearer|basic|token)\s+)?(\S+)$", value, re.IGNORECASE)
    if header and name_class(header.group(1)) == "secret":
        return [(header.start(2), header.end(2), header.group(1), "pair")]
    return [(0, len(value), name, "whole")]


def target_of(before: str) -> tuple[str, str]:
    """The name a value is given to and the kind of that place, from the text of the line before it."""
    bare = before.rstrip("\"'`")
    last = _LITERAL_PREFIX.sub("", bare).rstrip()[-2:]
    if last[-1:] in ("=", ":", ">"):
        m = _TARGET.search(before)
        return (m.group(1).rsplit(".", 1)[-1], "name") if m else ("", "bare")
    if last[-1:] not in ("(", "[", ",") and last not in ("||", "??", "or"):
        return "", "bare"
    m = _ENVIRONMENT.search(before)
    if m:
        return m.group(1), "default"
    if _ENVIRONMENT_NAME.search(before):
        return "", "environment"
    m = _CALL.search(before)
    if m:
        called = m.group(1).rsplit(".", 1)[-1].lower()
        second = last[-1:] == ","
        if "hmac" in m.group(1).lower() or called in ("sign", "hmac", "sign_with", "new_hmac", "createhmac"):
            return called, "sign-second" if second else "sign"
        if called in ("login", "connect", "auth", "authenticate", "signin", "credentials", "basic_auth", "setauth"):
            return called, "login-second" if second else "login-first"
        return called, "call"
    if re.search(r"(?i)auth\w*\s*=\s*\([^()]*,\s*[\"'`]?$", before):
        return "auth", "login-second"
    return "", "bare"


def _class(c: str) -> str:
    return "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c if c.isascii() else "x"


def _shape(token: str) -> str:
    shape = re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", token)))
    return re.sub(r"(.)\1+", r"\1", shape)[:8]


class _Kept(dict):
    """Results of a function by argument; forgotten when they get many."""

    def __init__(self, function):
        super().__init__()
        self.function = function

    def __missing__(self, key):
        if len(self) > 300_000:
            self.clear()
        self[key] = value = self.function(key)
        return value


_LOOKS = _Kept(value_class)
_PARTS = _Kept(lambda key: parts_of_value(*key))
_NAMES = _Kept(name_class)
_SHAPES = _Kept(lambda t: (_shape(t), min(6, len(t) // 4), _class(t[0]), _class(t[-1])))


def _places(tokens: list[str], part: tuple[int, int], whole: tuple[str, str, str, str]) -> list[tuple]:
    """All that the features of each token depend on."""
    looks = [_SHAPES[t] for t in tokens]
    first, end = part
    return [
        (
            first <= i < end, i == first, i == end - 1, shape, length, looks[i - 1][3] if i else "^",
            looks[i + 1][2] if i + 1 < len(looks) else "$", whole if first <= i < end else None,
        )
        for i, (shape, length, _, _) in enumerate(looks)
    ]


def _feature_ids(place: tuple) -> list[int]:
    """Hashed features of a token in its place; tokens outside the value are context."""
    inside, first, last, shape, length, before, behind, whole = place
    near = f"{inside}{first}{last}"
    f = [near, f"s{near}{shape}", f"l{inside}{length}", f"p{inside}{before}", f"n{inside}{behind}"]
    if whole:
        named, looks, kind, wide = whole
        f += [
            f"w{near}{named}|{looks}|{kind}|{wide}", f"a{near}{named}{looks}", f"b{near}{kind}{looks}", f"c{near}{wide}{looks}",
            f"d{near}{named}{wide}", f"e{near}{looks}", f"g{near}{kind}{named}", f"h{near}{named}{looks}{kind}",
        ]
    return [zlib.crc32(x.encode()) % BUCKETS for x in f]


def sequences(text: str) -> Iterator[tuple[list[str], int, list[tuple]]]:
    """(tokens, offset of the first, place of each) for each place of the text where a secret can stand."""
    taken: list[tuple[int, int]] = []
    if "-----BEGIN" in text:
        for m in _FRAME.finditer(text):
            taken.append(m.span())
            yield from _sequence(text, m.start(), m.end(), "frame", "frame")

    def free(a: int, b: int) -> bool:
        """Whether no taken span meets this one; taken spans are sorted and disjoint."""
        k = bisect.bisect_left(taken, (b, b))
        return not k or taken[k - 1][1] <= a

    whole = []
    for m in _LITERAL.finditer(text):
        k = m.lastindex
        a, b = m.span(k)
        if taken and not free(a, b):
            continue
        name, kind = target_of(text[max(text.rfind("\n", 0, a) + 1, a - 200) : a])
        if kind == "environment":  # a name to look up, not a value
            continue
        value = m.group(k)
        if not any(c.isspace() for c in value.strip()):
            whole.append((a, b))
        yield from _sequence(text, a, b, name, kind)
    taken = sorted(taken + whole)
    low = text.lower()
    named = any(k in low for k in _NAME_HINTS)
    if named:
        for m in _PLAIN.finditer(text):
            value = m.group(2)
            if value[0] in "=:" or not free(*m.span(2)):
                continue
            if value.startswith(PREFIXES) or _NAME_WORD.search(m.group(1)) or value[:6].lower() in ("bearer", "basic ", "token "):
                bisect.insort(taken, m.span(2))
                yield from _sequence(text, m.start(2), m.end(2), m.group(1).rsplit(".", 1)[-1], "plain")
        if "#" in text or "//" in text or "--" in text or "/*" in text:
            for m in _REMARK.finditer(text):
                if _REMARK_MARK.search(text, text.rfind("\n", 0, m.start()) + 1, m.start()):
                    line_end = text.find("\n", m.end())
                    values = _REMARK_VALUE.finditer(text, m.end(), line_end if line_end >= 0 else len(text))
                    for v in itertools.islice(values, REMARK_WORDS):
                        if free(*v.span()):
                            yield from _sequence(text, *v.span(), "password", "remark")
    if " -" in text:
        for m in _OPTION.finditer(text):
            k = m.lastindex
            a, b = m.span(k)
            option = m.group(k - 1)
            if option in ("-u", "user"):
                a += m.group(k).find(":") + 1
                if a == m.start(k):
                    continue
            if free(a, b):
                yield from _sequence(text, a, b, option if option[0] != "-" else "password", "option" + (option if option[0] == "-" else ""))
    for m in _KNOWN.finditer(text) if any(p in text for p in _KNOWN_HINTS) else ():
        if free(*m.span()):
            yield from _sequence(text, *m.span(), "", "plain")
    if "://" in text:
        for m in _URL_LOGIN.finditer(text):
            if free(*m.span()):
                yield from _sequence(text, m.start(), m.end(), "", "plain")


def _sequence(text: str, a: int, b: int, name: str, kind: str):
    value = text[a:b]
    for x, y, called, place in _PARTS[value, name]:
        if y <= x:
            continue
        begin, end = a + x, a + y
        before = _TOKENS.findall(text[max(0, begin - 12) : begin])[-2:]
        middle = _TOKENS.findall(text[begin:end])
        after = _TOKENS.findall(text[end : end + 4])[:1]
        tokens = before + middle + after
        part = (len(before), len(before) + len(middle))
        whole = (
            "secret" if place == "login" else _NAMES[called], _LOOKS[value[x:y]], kind, place.split("-")[0] if place.startswith("scheme") else place,
        )
        yield tokens, begin - sum(map(len, before)), _places(tokens, part, whole)


# --- training -------------------------------------------------------------------------------------------------------

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_ALNUM = _LETTERS + _LETTERS.upper() + "0123456789"


def _made(rng: random.Random, alphabet: str, low: int, high: int) -> str:
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(low, high)))


def _word(rng: random.Random) -> str:
    return rng.choice("bcdfgklmnprstvw") + rng.choice("aeiou") + _made(rng, _LETTERS, 1, 3) + rng.choice(["er", "et", "in", "or", "le"])


def _secret(rng: random.Random) -> str:
    kind = rng.randrange(13)
    if kind == 0:
        return rng.choice([p for p in PREFIXES if p != "eyJ"]) + _made(rng, _ALNUM, 18, 36)
    if kind == 1:
        return "eyJ" + _made(rng, _ALNUM, 20, 60) + "." + _made(rng, _ALNUM, 20, 60) + "." + _made(rng, _ALNUM + "-_", 20, 43)
    if kind == 2:
        return _made(rng, "0123456789abcdef", 32, 64)
    if kind == 3:
        return _made(rng, _ALNUM + "+/", 32, 60) + rng.choice(["", "=", "=="])
    if kind == 4:
        return "-".join(_word(rng) for _ in range(rng.randint(2, 4))) + str(rng.randint(1, 999))
    if kind == 5:
        return _word(rng).capitalize() + rng.choice("!#$%&*~._-@^+?") + str(rng.randint(10, 99999))
    if kind == 6:
        return _word(rng)[:4] + str(rng.randint(10, 99)) + _word(rng).upper() + rng.choice(_LETTERS)
    if kind == 7:
        return _word(rng) + "_" + _made(rng, _ALNUM, 18, 24)
    if kind == 8:
        return rng.choice([_word(rng) + str(rng.randint(10, 9999)), _word(rng) + "_" + str(rng.randint(100, 9999)), _word(rng)[:2] + "0" + _word(rng) + rng.choice("&!$") + str(rng.randint(1, 9))])
    if kind == 9:
        return rng.choice([_made(rng, _ALNUM, 6, 9), _word(rng) + _word(rng)])
    return _made(rng, _ALNUM, 9, 38)


def _stand_in(rng: random.Random) -> str:
    return rng.choice([
        "changeme", "REPLACE_ME", "YOUR_API_KEY", "<token>", "xxxxxxxxxxxxxxxx", "********", "example", "dummy-token", "TODO",
        "${API_KEY}", "{{ vault_pass }}", "your-secret-here", "not-a-real-key", "AKIA................", "sk_live_XXXXXXXXXXXXXXXXXXXX",
        "insert token here", "<redacted>", "placeholder", "process.env.KEY", "os.environ", "Enter your password", "none", "null", "",
        "secret rotation overdue", "Token " + _word(rng), _word(rng) + " " + _word(rng) + " " + _word(rng), "%s", "{}",
    ])


def _not_secret(rng: random.Random) -> str:
    kind = rng.randrange(9)
    hexa = "0123456789abcdef"
    if kind == 0:
        return _made(rng, hexa, 32, 32)
    if kind == 1:
        return _made(rng, hexa, 40, 40)
    if kind == 2:
        return _made(rng, hexa, 64, 64)
    if kind == 3:
        return "-".join(_made(rng, hexa, n, n) for n in (8, 4, 4, 4, 12))
    if kind == 4:
        return f"sha{rng.choice([256, 384, 512])}-" + _made(rng, _ALNUM + "+/", 43, 64)
    if kind == 5:
        return "data:image/png;base64," + _made(rng, _ALNUM + "+/", 40, 90) + "="
    if kind == 6:
        return _word(rng) + str(rng.randint(1, 999))
    if kind == 7:
        return _made(rng, _ALNUM + "+/", 40, 400) + rng.choice(["", "="])
    return _made(rng, _ALNUM, 8, 40)


def _ordinary(rng: random.Random) -> str:
    """Literals and values of everyday code."""
    a, b, c = _word(rng), _word(rng), _word(rng)
    return rng.choice([
        a, f"{a}_{b}", f"{a}-{b}", f"{a}{b.capitalize()}", f"{a} {b} {c}", f"{a}/{b}.py", f"/{a}/{b}", f"{a}.{b}", f"{a} %s {b} %d", f"{a}: {{}} {b}", f"{a.upper()}_{b.upper()}",
        "utf-8", "%Y-%m-%d", f"__{a}__", f"https://{a}.example.invalid/{b}", f"select {a} from {b} where id = ?", f"{rng.randint(0, 99999)}", f"{a}{rng.randint(1, 99)}", f"v{rng.randint(1, 9)}.{rng.randint(0, 9)}",
        f"application/{a}", f"{a}, {b} and {c} of {rng.randint(1, 99)}", "\\n", " ", f"{rng.randint(1000, 9999)}:{rng.randint(10, 99)}", f"{a}@{b}.invalid", f"#{_made(rng, '0123456789abcdef', 6, 6)}",
        f"Bearer {a}", "".join(f"\\x{rng.randint(16, 255):02x}" for _ in range(rng.randint(4, 40))),
    ])


def _frame(rng: random.Random, kind: str, line: str) -> str:
    body = line.join(_made(rng, _ALNUM + "+/", 64, 64) for _ in range(rng.randint(1, 8)))
    return f"-----BEGIN {kind}-----{line}{body}{line}-----END {kind}-----"


_SECRET_NAMES = (
    "password passwd db_password dbPassword apiKey API_KEY api_key secret client_secret token access_token authToken AUTH PASSWORD pwd signing_key hmac_key "
    "webhookSecret private_token deployKey passphrase passwort kennwort contrasena mot_de_passe clave 비밀번호 x_api_key SERVICE_TOKEN ROOT_PW smtpPassword pass_word"
).split()
_OTHER_NAMES = (
    "digest expected_digest etag sha256 commit checksum integrity request_id node_uuid icon logo pub_key build_hash fingerprint revision csrf_token_id public_key "
    "data payload blob DATA body sample font_bytes"
).split()


def training_text(rng: random.Random) -> tuple[str, tuple[str, ...]]:
    """A generated line of code and the secrets in it."""
    plain_names = ["label", "hint", "name", _word(rng), _word(rng), f"{_word(rng)}_{_word(rng)}", "value", "url", "cfg", "conn", "dsn", "x"]
    q = rng.choice("\"\"\'")
    end = rng.choice(["", ";", ","])
    lead = rng.choice(["", "    ", "self.", "config.", "const ", "let ", "var ", "this.", "cfg."])
    op = rng.choice([" = ", "=", ": str = ", " := ", ": ", " => "])
    name, plain, w = rng.choice(_SECRET_NAMES), rng.choice(plain_names), _word(rng)
    s = _secret(rng)
    word = rng.choice(["password", "token", "secret", "key", "pwd", "passphrase"])
    form = rng.randrange(30)
    if form <= 4:
        if rng.random() < 0.1:
            q = '"""'
        return f"{lead}{name}{op}{q}{s}{q}{end}", (s,)
    if form <= 6:
        return f"{lead}{name}{op}{q}{_stand_in(rng)}{q}{end}", ()
    if form <= 8:
        return f"{lead}{rng.choice(_OTHER_NAMES)}{op}{q}{_not_secret(rng)}{q}{end}", ()
    if form == 9:
        return f"{lead}{plain}{op}{q}{_not_secret(rng)}{q}{end}", ()
    if form == 10:
        s = rng.choice([p for p in PREFIXES if p != "eyJ"]) + _made(rng, _ALNUM, 18, 36)
        return rng.choice([f"{lead}{plain}{op}{q}{s}{q}{end}", f"{w}({q}{s}{q})"]), (s,)
    if form == 11:
        scheme = rng.choice(["postgres", "mysql", "https", "redis", "amqp", "ftp", "mongodb"])
        s = s.replace("/", "x").replace("@", "a").replace("%", "5").replace("#", "7").replace("&", "8").replace("?", "9")
        return f"{lead}{rng.choice([plain, 'DATABASE_URL'])}{op}{q}{scheme}://{w}:{s}@{_word(rng)}.internal.invalid:{rng.randint(1000, 9999)}/{_word(rng)}{q}{end}", (s,)
    if form == 12:
        s = s.replace("&", "8").replace("#", "7").replace("+", "p")
        key = rng.choice(["api_key", "token", "key", "access_token", "auth"])
        return f"{lead}url{op}{q}https://{w}.example.invalid/v{rng.randint(1, 4)}/{_word(rng)}?{key}={s}{rng.choice(['', f'&page={rng.randint(1, 9)}'])}{q}{end}", (s,)
    if form == 13:
        s = s.replace(";", "x").replace("=", "")
        return f"{lead}cs{op}{q}Server=db{rng.randint(1, 9)};Database={w};User Id=app;{rng.choice(['Password', 'Pwd'])}={s};Timeout={rng.randint(1, 60)};{q}{end}", (s,)
    if form == 14:
        scheme = rng.choice(["Bearer", "Token", "Basic", "bearer"])
        target = rng.choice(['headers = {"Authorization": ', "self.headers = {'Authorization': ", "auth_header = ", "hdr = "])
        return f"{target}{q}{scheme} {s}{q}" + ("}" if "{" in target else ""), (s,)
    if form == 15:
        return f"sig = {rng.choice(['hmac.new(b', 'sign(', 'hmac.new('])}{q}{s}{q}, body)", (s,)
    if form == 16:
        call = rng.choice(["client.login", f"{w}.connect", "session.auth = "])
        return rng.choice([f"{call}({q}svc{q}, {q}{s}{q})", f"{call}({w}, {q}{s}{q})"]), (s,)
    if form == 17:
        return rng.choice([f"{w} = os.getenv({q}{name.upper()}{q}, {q}{s}{q})", f"const {w} = process.env.{name.upper()} || {q}{s}{q}{end}", f"{w} = env.get({q}{name.upper()}{q}) or {q}{s}{q}"]), (s,)
    if form == 18:
        s = s.replace(";", "x")
        return rng.choice([f"# {w}: {name}={s}", f"// {name}: {s}", f"export {name.upper()}={s}", f"{name.upper()}={s}", f"# {w} {w}, {name} = {s}"]), (s,)
    if form == 19:
        kind = rng.choice(["RSA PRIVATE KEY", "EC PRIVATE KEY", "PRIVATE KEY", "OPENSSH PRIVATE KEY"])
        s = _frame(rng, kind, rng.choice(["\\n", "\n", "\n    "]))
        return f"{lead}{rng.choice(['key', 'pem', 'signer', 'idFile'])} = \"\"\"{s}\"\"\"", (s,)
    if form == 20:
        return f"{lead}{rng.choice(['pub', 'public_key', 'cert'])} = {q}{_frame(rng, rng.choice(['PUBLIC KEY', 'CERTIFICATE']), chr(92) + 'n')}{q}", ()
    if form == 21:
        return rng.choice([
            f"settings = {{\"{w}\": {rng.randint(1, 99)}, \"{name}\": \"{s}\"}}", f"conn = connect(host={w}, user=\"app\", {rng.choice(['password', 'passwd', 'token'])}=\"{s}\")",
        ]), (s,)
    if form == 22:
        s = s.replace(";", "x")
        return rng.choice([
            f"# {word} is {s}", f"# {word}: {s}", f"// use {word} {s}", f"# the {word} {s} expires soon", f"// {w} {word} = {s}", f"# {w} / {word} / {s}", f"# root {word} {s}",
            f"// {word} for {w}: {s}", f"# log in with {word} {s} first", f"# the former {word} was {s}", f"# sign in as {w} / {s}", f"// {w} login {w} / {s}", f"# login: {w} / {s}",
        ]), (s,)
    if form == 23:
        s = re.sub(r"[;&|<>^]", "x", s)
        tool = rng.choice([f"{w}ctl --password {s} start", f"{w} -u admin:{s} https://{w}.invalid", f"{w}pass -p {s} {w} a@b", f"{w}sql -h db -u root -p{s} {_word(rng)}",
                           f"{w} push --token {s}", f"{w} -a {s} ping", f"{name.upper()}={s} {w} run", f"{w} --api-key={s}"])
        return rng.choice([f"{rng.choice(['run', 'exec', 'os.system', 'sh'])}({q}{tool}{q})", f"$ {tool}", f"# {tool}"]), (s,)
    if form == 24:
        return rng.choice([f'req.Header.Set("Authorization", "Bearer {s}")', f"curl -H {q}Authorization: Bearer {s}{q} https://{w}.example.invalid"]), (s,)
    if form == 25:
        a, b = _word(rng), _word(rng)
        return rng.choice([
            f"# the token is checked in {a}/{b}_{a}.py", f"# key of {a}_{b}_{rng.randint(1, 99)} is kept", f"token_bucket = {a} if {b} else {q}{a}-{b}{q}",
            f"{a} = {b}(token_bucket, mode={q}{a}{q})", f"{a} = os.environ[{q}API_KEY{q}]", f"// token {a}.{b}{a.capitalize()}{b.capitalize()} is opaque",
            f"# Both {a}/{b}.py and `{a}.{b}{a.capitalize()}` drop the key", f"secret = read_secret({q}{a}/{b}{q})", f"password = {a}_{b}", f"token = {a}.{b}", f"auth: {b}",
            f"secret: {a}", f"// login {a} before {b}", f"# password {a} {b}", f"{name} = request.{a}", f"{name}: str", f"{name}={a}", f"# keep the {word} out of {a} {b}", f"{word} {a}",
            f"# {word} {b.capitalize()} {a}", f"const {name} = process.env.{a.upper()}", f"{name} = os.environ.{a.upper()}", f"# {word} 이름을 먼저 {a}", f"# {word} für {a} später", f"# {word} {rng.randint(1, 999)} of {rng.randint(1, 999)}", f"{a} = {b}.pop({q}{name}{q})", f"raise {a.capitalize()}Error({q}{word} {b} {a}{q})",
        ]), ()
    if form == 26:
        return rng.choice([
            f"run({q}mkdir -p {w}/{_word(rng)}{q})", f"run({q}docker run -p {rng.randint(80, 9999)}:{rng.randint(80, 9999)} {w}{q})", f"sh({q}sort -u {w}.txt{q})", f"# git log -p {w}.py",
            f"$ ps -u {w}", f"run({q}cp -a {w}/{w} /{w}{q})", f"# {w} -p {rng.randint(1, 99999)}", f"exec({q}{w} --token-file {w}.txt --user {w}{q})", f"x = {w} -u",
        ]), ()
    if form == 27:
        return rng.choice([f"{w}({q}{_ordinary(rng)}{q}, {rng.randint(1, 9)})", f"const {w} = {q}{_not_secret(rng)}{q};", f"case_{rng.randint(1, 9999)} = make({rng.randint(1, 50)}, '{_made(rng, '0123456789abcdef', 6, 10)}');"]), ()
    return rng.choice([
        f"{lead}{plain}{op}{q}{_ordinary(rng)}{q}{end}", f"{w}({q}{_ordinary(rng)}{q})", f"[{q}{_ordinary(rng)}{q}, {q}{_ordinary(rng)}{q}]", f"return {q}{_ordinary(rng)}{q}", f"if {w} == {q}{_ordinary(rng)}{q}:", f"if __{w}__ == {q}{_ordinary(rng)}{q}:",
        f"raise ValueError({q}{_ordinary(rng)}{q})", f"{w}[{q}{_ordinary(rng)}{q}] = {q}{_ordinary(rng)}{q}", f'"""{_ordinary(rng).capitalize()} {_ordinary(rng)}."""', f"{w}.{w}(mode={q}{_ordinary(rng)}{q})",
    ]), ()


def _batch(seqs):
    n, t = len(seqs), max(len(s[0]) for s in seqs)
    k = max(len(f) for s in seqs for f in s[0])
    ids = np.full((n, t, k), BUCKETS, dtype=np.int32)
    for i, (feats, _) in enumerate(seqs):
        for j, f in enumerate(feats):
            ids[i, j, : len(f)] = f
    mask = np.zeros((n, t), dtype=bool)
    for i, (feats, _) in enumerate(seqs):
        mask[i, : len(feats)] = True
    return ids, mask


def _lse(x, axis):
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


class Field:
    """Weights of the chain: features to labels (outside, begin, inside) and label to label."""

    def __init__(self):
        self.w = np.zeros((BUCKETS + 1, 3), dtype=np.float32)
        self.t = np.zeros((3, 3))

    def fit(self, data, epochs: int = 35, rate: float = 0.4, l2: float = 1e-4) -> Field:
        """Full-batch AdaGrad on the conditional log-likelihood, with forward and backward sums over all lines of like length at once."""
        groups = [[d for d in data if low < len(d[0]) <= high] for low, high in ((0, 4), (4, 8), (8, 16), (16, 32), (32, 1 << 20))]
        parts = []
        for group in filter(None, groups):
            ids, mask = _batch(group)
            gold = np.zeros(mask.shape, dtype=np.int64)
            for i, (_, labels) in enumerate(group):
                gold[i, : len(labels)] = labels
            parts.append((ids, mask, gold))
        gw, gt = np.full_like(self.w, 1e-6), np.full_like(self.t, 1e-6)
        for _ in range(epochs):
            dw, dt = np.zeros(self.w.shape), np.zeros((3, 3))
            for part in parts:
                self._gradient(*part, dw, dt)
            dw, dt = dw / len(data) - l2 * self.w, dt / len(data) - l2 * self.t
            dw[BUCKETS] = 0
            gw += dw * dw
            gt += dt * dt
            self.w += rate * dw / np.sqrt(gw)
            self.t += rate * dt / np.sqrt(gt)
        self.t[0, 2] = -1e4  # inside never follows outside
        return self

    def _gradient(self, ids, mask, gold, dw, dt) -> None:
        n, steps, k = ids.shape
        e = np.where(mask[:, :, None], self.w[ids].sum(axis=2), 0)
        alpha, beta = np.zeros((n, steps, 3)), np.zeros((n, steps, 3))
        alpha[:, 0] = e[:, 0]
        for j in range(1, steps):
            nxt = _lse(alpha[:, j - 1][:, :, None] + self.t[None], 1) + e[:, j]
            alpha[:, j] = np.where(mask[:, j][:, None], nxt, alpha[:, j - 1])
        z = _lse(alpha[:, -1], 1)
        for j in range(steps - 2, -1, -1):
            nxt = _lse(self.t[None] + (e[:, j + 1] + beta[:, j + 1])[:, None, :], 2)
            beta[:, j] = np.where(mask[:, j + 1][:, None], nxt, 0)
        grad = (np.eye(3)[gold] - np.exp(alpha + beta - z[:, None, None]))[mask]
        places = ids[mask]
        for c in range(3):
            dw[:, c] += np.bincount(places.reshape(-1), np.repeat(grad[:, c], k), BUCKETS + 1)
        for j in range(1, steps):
            ok = mask[:, j]
            np.add.at(dt, (gold[ok, j - 1], gold[ok, j]), 1)
            x = alpha[ok, j - 1][:, :, None] + self.t[None] + (e[ok, j] + beta[ok, j])[:, None, :] - z[ok][:, None, None]
            dt -= np.exp(x).sum(0)

    def ready(self) -> Field:
        """Plain numbers for decoding, and a memory of scores by place."""
        w = self.w
        self.scores = _Kept(lambda place: tuple(float(x) for x in w[_feature_ids(place)].sum(axis=0)))
        self.moves = [[float(x) for x in row] for row in self.t]
        return self

    def best_path(self, places: list[tuple]) -> list[int]:
        scores, moves = self.scores, self.moves
        s0, s1, s2 = scores[places[0]]
        s2 -= 1e4
        (a0, a1, a2), (b0, b1, b2), (c0, c1, c2) = moves
        back = []
        for place in places[1:]:
            e0, e1, e2 = scores[place]
            x0, x1, x2 = s0 + a0, s1 + b0, s2 + c0
            n0, f0 = (x0, 0) if x0 >= x1 and x0 >= x2 else (x1, 1) if x1 >= x2 else (x2, 2)
            x0, x1, x2 = s0 + a1, s1 + b1, s2 + c1
            n1, f1 = (x0, 0) if x0 >= x1 and x0 >= x2 else (x1, 1) if x1 >= x2 else (x2, 2)
            x0, x1, x2 = s0 + a2, s1 + b2, s2 + c2
            n2, f2 = (x0, 0) if x0 >= x1 and x0 >= x2 else (x1, 1) if x1 >= x2 else (x2, 2)
            s0, s1, s2 = n0 + e0, n1 + e1, n2 + e2
            back.append((f0, f1, f2))
        at = 0 if s0 >= s1 and s0 >= s2 else 1 if s1 >= s2 else 2
        path = [at]
        for step in reversed(back):
            at = step[at]
            path.append(at)
        return path[::-1]


def labelled(lines: int, seed: int):
    """Feature sequences and labels of generated lines."""
    rng = random.Random(seed)
    out = []
    for _ in range(lines):
        text, secrets = training_text(rng)
        spans = [(m.start(), m.end()) for s in secrets for m in re.finditer(re.escape(s), text)]
        for tokens, offset, places in sequences(text):
            labels, at = [], offset
            for t in tokens:
                hit = next(((a, b) for a, b in spans if a <= at and at + len(t) <= b), None)
                labels.append(0 if hit is None else 1 if hit[0] == at else 2)
                at += len(t)
            if len(tokens) <= 64:
                out.append(([_feature_ids(p) for p in places], labels))
    return out


_MODEL: Field | None = None


def model() -> Field:
    global _MODEL
    if _MODEL is None:
        _MODEL = Field().fit(labelled(TRAINING_LINES, seed=11)).ready()
    return _MODEL


# --- detection ------------------------------------------------------------------------------------------------------


def spans_of(text: str | None, field: Field) -> list[tuple[int, int]]:
    """Sorted, disjoint (start, end) of the secrets in a text."""
    if not text:
        return []
    found = []
    for tokens, offset, places in sequences(text):
        path = field.best_path(places)
        if not any(path):
            continue
        at, begin = offset, None
        for t, label in zip(tokens, path):
            if label == 1 or label == 0:
                if begin is not None:
                    found.append((begin, at))
                begin = at if label == 1 else None
            at += len(t)
        if begin is not None:
            found.append((begin, at))
    return _merged(found)


def everywhere(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans, and every other place where one of their values stands by itself."""
    found = list(spans)
    for value in {text[a:b] for a, b in spans}:
        found += [m.span() for m in re.finditer(r"(?<![A-Za-z0-9])" + re.escape(value) + r"(?![A-Za-z0-9])", text)]
    return _merged(found)


def _merged(found) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for a, b in sorted(set(found)):
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def _weights() -> tuple[np.ndarray, np.ndarray]:
    m = model()
    return m.w.astype(np.float32), m.t


def _field(weights) -> Field:
    field = Field()
    field.w, field.t = weights
    return field.ready()


def find_secrets(values: DataFrame) -> DataFrame:
    """tbl, row_id, secret: distinct secrets of each record of ``values`` (tbl, row_id, text)."""
    weights = _weights()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field = _field(weights)
        for pdf in batches:
            rows = [
                (t, r, s)
                for t, r, x in zip(pdf["tbl"], pdf["row_id"], pdf["text"])
                for s in dict.fromkeys(x[a:b] for a, b in spans_of(x, field))
            ]
            yield pd.DataFrame(rows, columns=["tbl", "row_id", "secret"])

    src = values.select("tbl", F.col("row_id").cast("long").alias("row_id"), "text").where(F.length("text") > 0)
    return src.mapInPandas(run, "tbl string, row_id long, secret string")


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], REPLACEMENT]
        at = b
    return "".join(out) + text[at:]


def redact_secrets(values: DataFrame) -> DataFrame:
    """tbl, row_id, redacted, secrets: the texts that held secrets, with only those replaced."""
    weights = _weights()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field = _field(weights)
        for pdf in batches:
            rows = []
            for t, r, x in zip(pdf["tbl"], pdf["row_id"], pdf["text"]):
                spans = everywhere(x, spans_of(x, field))
                if spans:
                    rows.append((t, r, redact(x, spans), len(spans)))
            yield pd.DataFrame(rows, columns=["tbl", "row_id", "redacted", "secrets"])

    src = values.select("tbl", F.col("row_id").cast("long").alias("row_id"), "text").where(F.length("text") > 0)
    return src.mapInPandas(run, "tbl string, row_id long, redacted string, secrets int")
